import random
import re

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import line_dedup, mixing, pii, quality, secrets, url_filter
from spanforge.llm.common import running


def by_id(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_running_sums(spark):
    for n in (0, 1, 255, 256, 257, 1500):
        df = spark.range(1).select(F.lit([1] * n).cast("array<bigint>").alias("x"))
        assert df.select(running(F.col("x"))).first()[0] == list(range(n))


def test_lines(spark, docs, rows):
    assert by_id(line_dedup.op4_query(docs)) == brute.lines(rows)
    same = [(i, f"Own {i}\n  COMMON\t\nÉ\n{'x' if i else 'y'}") for i in range(12)]
    got = by_id(line_dedup.dedup_lines(spark.createDataFrame(same, "doc_id int, text string")))
    assert got[0] == ("Own 0\ny", 4, 2) and got[5] == ("Own 5", 4, 3)


def test_lines_by_shuffled_join(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(line_dedup, "small", lambda df: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert by_id(line_dedup.op4_query(docs)) == brute.lines(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lines_edges(edges):
    got = line_dedup.dedup_lines(edges).collect()
    assert len(got) == edges.count()
    assert [(r.n_lines, r.n_dropped) for r in got if r.doc_id == 3] == [(1, 0)]
    assert line_dedup.op4_query(edges.limit(0)).count() == 0
    assert len(line_dedup.dedup_lines(edges, min_docs=1).where("n_dropped = 5").collect()) == 1


def test_quality_base(docs, rows):
    got = by_id(quality.op7_query(docs))
    assert all(got[d][:6] == brute.quality_base(t) for d, t in rows)


def test_quality_against_labels(spark):
    """The rules are never shown labels; they must agree with them."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.op7_query(docs).join(labels, "doc_id").where("NOT base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in got}
    assert n.get((1, False), 0) <= 0.005 * n[1, True] and n.get((0, True), 0) <= 0.1 * n[0, False]


def test_votes_are_weighed(spark):
    """Among rows with a bad vote some stay and some go, and p_good is what Bayes' rule gives from the fitted accuracies."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    measured = docs.select("doc_id", quality.measures(F.col("text")).alias("_m")).where(~quality._base_failed())
    votes = {r[0]: tuple(r)[1:] for r in measured.select("doc_id", *[v.alias(k) for k, v in quality.votes().items()]).collect()}
    share, tables = quality.fit_accuracies([(v, sum(x == v for x in votes.values())) for v in set(votes.values())])
    rows = {r.doc_id: r for r in quality.quality(docs).where("NOT base_failed").collect()}
    assert rows.keys() == votes.keys() and {rows[d].kept for d, v in votes.items() if -1 in v} == {True, False}
    for d, v in votes.items():
        good, bad = share, 1 - share
        for x, t in zip(v, tables, strict=True):
            good, bad = (good * t[x][0], bad * t[x][1]) if x else (good, bad)
        assert abs(rows[d].p_good - good / (good + bad)) < 1e-6 and rows[d].kept == (rows[d].p_good >= 0.5)
    assert all(good <= bad for good, bad in (t[-1] for t in tables))


def test_quality_edges(spark, edges):
    got = quality.quality(edges).collect()
    assert len(got) == edges.count() and not any(r.kept for r in got if r.n_words == 0)
    for r, (_, t, _) in zip(sorted(got, key=lambda r: r.word_chars), sorted(__import__("conftest").EDGES, key=lambda e: sum(map(len, brute.words(e[1])))), strict=True):
        assert (r.n_words, r.word_chars) == brute.quality_base(t)[:2]
    assert quality.quality(edges.limit(0)).count() == 0
    kept = quality.keep_good(edges)
    assert kept.columns == edges.columns


def test_accuracies_are_found():
    """Rows drawn from the model: rules of different accuracy that err independently given the class, and abstain."""
    rnd = random.Random(1)
    rates = [(0.002, 0.9), (0.02, 0.5), (0.05, 0.4), (0.1, 0.3), (0.2, 0.25), (0.02, 0.6)]
    counts = {}
    for _ in range(20_000):
        good = rnd.random() < 0.85
        vote = tuple(0 if rnd.random() < 0.2 else -1 if rnd.random() < rate[not good] else 1 for rate in rates)
        counts[vote] = counts.get(vote, 0) + 1
    share, tables = quality.fit_accuracies(list(counts.items()), weight=0.0001)
    assert abs(share - 0.85) < 0.02
    assert all(abs(t[-1][k] - rate[k]) < (0.01, 0.04)[k] for t, rate in zip(tables, rates, strict=True) for k in (0, 1))
    share, tables = quality.fit_accuracies(list(counts.items()))  # the priors draw these towards 0.01 and 0.3
    assert abs(share - 0.85) < 0.05 and all(min(r[1], 0.3) - 0.05 < t[-1][1] < max(r[1], 0.3) + 0.05 for t, r in zip(tables, rates, strict=True))
    assert quality.fit_accuracies([])[0] == quality.GOOD_SHARE


def test_secrets_base(spark, docs, rows, edges):
    got = by_id(secrets.op3_query(docs))
    assert all(got[d][:4] == brute.secrets(t) for d, t in rows)
    extra = [
        "token = token = abcdefgh", "SECRET:'abc' passwd==abcdef", "AKIAAKIA" + "A" * 20, "apikey=0123456789abcdef01234567",
        "paſſword: abcdefgh Kapi_key:abcdefgh", "😀 Token=" + "z" * 6 + " f" * 9, "deadbeef" * 30,
    ]
    got = by_id(secrets.op3_query(spark.createDataFrame(list(enumerate(extra)), "doc_id int, text string")))
    assert all(got[d][:4] == brute.secrets(t) for d, t in enumerate(extra))
    assert len(secrets.op3_query(edges).collect()) == edges.count()
    assert secrets.op3_query(edges.limit(0)).count() == 0


def test_random_strings_are_told_from_text(spark):
    rnd = random.Random(3)
    alphabets = ["0123456789abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"]
    key = lambda: "".join(rnd.choices(rnd.choice(alphabets), k=rnd.randint(44, 90)))
    plain = ["internationalizationally", "a" * 40, "abcdefghijklmnopqrstuvwxyz", "thethethethethethetheththe", "path/to/the/other/thing/and/then/some"]
    keys = [(i, f"word {key()} word") for i in range(200)]
    texts = [(1000 + i, f"word {rnd.choice(plain)} word") for i in range(200)]
    got = by_id(secrets.op3_query(spark.createDataFrame(keys + texts, "doc_id int, text string")))
    assert sum("random" in got[i][4] for i, _ in keys) >= 180
    assert not any("random" in got[i][4] for i, _ in texts)


def test_short_keys_are_found(spark):
    rnd = random.Random(7)
    least = {"hex_upper": 0.9, "lower": 0.4, "upper": 0.4, "base32": 0.55, "base36": 0.8, "alphanumeric": 0.95, "base64": 0.95}
    alphabets = {e[0]: e[1] for e in secrets.ENCODINGS}
    keys = [(name, "".join(rnd.choices(alphabets[name], k=32))) for name in least for _ in range(150)]
    rows = [(i, f"word {k} word") for i, (_, k) in enumerate(keys)]
    got = by_id(secrets.op3_query(spark.createDataFrame(rows, "doc_id int, text string")))
    found = {name: [("random" in got[i][4]) for i, (n, _) in enumerate(keys) if n == name] for name in least}
    assert {n: f for n, f in found.items() if sum(f) < least[n] * len(f)} == {}


def test_p_values_hold_for_text(spark, rows):
    rnd = random.Random(5)
    words = [w.lower() for _, t in rows for w in brute.words(t)[:40] if w.isascii() and w.isalpha()]
    forms = [lambda w: w.capitalize(), lambda w: w + "_", lambda w: w + "/", lambda w: w.upper(), lambda w: w, lambda w: w + str(rnd.randint(0, 2030)), lambda w: w.upper() + str(rnd.randint(0, 99))]
    texts = []
    for _ in range(4000):
        form, n, out = rnd.choice(forms), rnd.choice((20, 26, 40, 70)), ""
        while len(out) < n:
            out += form(rnd.choice(words))
        texts.append((out[: n + 3],))
    p = [r[0] for r in spark.createDataFrame(texts, "s string").select(secrets.battery(F.col("s"))["p_text"]).collect()]
    assert all(sum(x <= a for x in p) <= a * len(p) for a in (0.1, 0.01, 0.001))


def test_mixing(spark, docs, rows, edges):
    sources = {r.doc_id: r.source for r in docs.collect()}
    sizes, taken = {}, {}
    got = by_id(mixing.op9_query(docs))
    for d, t in rows:
        sizes[sources[d]] = sizes.get(sources[d], 0) + len(brute.words(t))
        taken[sources[d]] = taken.get(sources[d], 0) + got[d][4]
        assert got[d][0] == len(brute.words(t)) and got[d][4] <= 2 * got[d][0]
    want = brute.targets(sizes)
    for d, _ in rows:
        assert got[d][1] == sizes[sources[d]] and got[d][2] == pytest.approx(want[sources[d]])
    largest = max(got[d][0] for d, _ in rows)
    assert all(abs(taken[s] - want[s]) <= largest / 2 + 1 for s in want)
    assert by_id(mixing.op9_query(docs.repartition(7))) == got
    assert mixing.mix_decisions(edges).count() == edges.count() and mixing.mix_decisions(edges.limit(0)).count() == 0
    copies = mixing.mix_decisions(edges).agg(F.sum("copies")).first()[0]
    mixed = mixing.mix_sources(edges)
    assert mixed.columns == edges.columns and mixed.count() == copies


def test_mixing_sql(spark, docs):
    odd = [(900_001, None, None, None, 0), (900_002, "", "", "a", 0), (900_003, " \x0b one\x1ctwo é\u3000ü ", "", "b", 3), (900_004, "w " * 30_000, "", "Z", 9)]
    some = docs.union(spark.createDataFrame(odd, docs.schema)).toPandas()
    con = duckdb.connect()
    con.register("documents", some)
    want = sorted(con.sql(f"SELECT doc_id, {', '.join(mixing.NEW)} FROM (" + mixing.OP9_SQL + ")").fetchall())
    got = sorted(tuple(r) for r in mixing.op9_query(docs.union(spark.createDataFrame(odd, docs.schema))).collect())
    assert got == want


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, None: 5}, {"z": 0, "b": 7}, {"a": 0}, {"b": 100, "a": 3, "é": 9, "Z": 50}])
def test_targets(spark, sizes):
    table = spark.createDataFrame([(k is None, k or "", v) for k, v in sizes.items()], "_null boolean, _src string, source_size bigint")
    got = {None if r._null else r._src: r.target for r in mixing.source_targets(table).collect()}
    assert got == pytest.approx(brute.targets(sizes))


def luhn(s):
    d = [int(x) for x in s]
    return sum(x if i % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2) for i, x in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms(spark, docs, edges):
    rows = [
        (1, "a.Bc9@x.org 4845168114407329, 4845 1681 1440 7329 +1 (017) 555-7713 (017) 555-7713 152.143.1.2. 2024-02-29 29/02/2024 29.02.2024 123-45-6789 GB82 WEST 1234 5698 7654 32"),
        (2, "4111111111111112 300.1.1.1 2023-02-30 000-45-6789 GB83WEST12345698765432 24be64439e3e49cf46b2d7c90f3602a3d0b907ff 1.2.3.4.5"),
        (3, "a.Bc9@x.org"),
    ]
    out = {r.doc_id: r for r in pii.pseudonymize(spark.createDataFrame(rows, "doc_id int, text string"), "k").collect()}
    assert out[2].text == rows[1][1]
    t = out[1].text.split(" ")
    assert t[0] == out[3].text != "a.Bc9@x.org" and re.fullmatch(r"[a-z]\.[A-Z][a-z]\d@x\.org", t[0])
    card = t[1].rstrip(",")
    assert luhn(card) and card[0] == "4" and card != "4845168114407329" and "".join(t[2:6]) == card
    assert (out[1].n_card, out[1].n_phone, out[1].n_date, out[1].n_ip, out[1].n_ssn, out[1].n_iban, out[1].n_email) == (2, 2, 3, 1, 1, 1, 1)
    iso = re.search(r"\d{4}-\d\d-\d\d", out[1].text)[0]
    y, m, d = iso.split("-")
    assert f"{d}/{m}/{y}" in out[1].text and f"{d}.{m}.{y}" in out[1].text
    iban = re.search(r"GB.*", out[1].text)[0].replace(" ", "")
    moved = iban[4:] + iban[:4]
    assert int("".join(str(int(c, 36)) for c in moved)) % 97 == 1 and iban[4:8] == "WEST"
    whole = pii.op2_query(docs).join(docs.withColumnRenamed("text", "was"), "doc_id").collect()
    for r in whole:
        mails = re.findall(r"\w+\.\d+@mail\d+\.example\.com", r.was)
        assert r.n_email == len(mails) and len(r.text) >= len(r.was) - 60
        if not re.search(r"[0-9@]", r.was):
            assert r.text == r.was
    got = pii.pseudonymize(edges, "k").collect()
    assert len(got) == edges.count() and sum(r.text is None for r in got) == 2
    assert pii.pseudonymize(edges.limit(0), "k").count() == 0


def test_pseudonyms_against_plain_python(spark, docs, rows, edges):
    plain = brute.Pseudonyms("pseudonym-key-1")
    got = by_id(pii.op2_query(docs))
    assert all(got[d][0] == plain.text(t, pii.KINDS) for d, t in rows)
    odd = [
        "12/25/1980 25/12/1980 1980-12-25 13/13/1999 31.12.2099 01/01/2100 1900-01-01 31/11/1990 02/30/1990",
        "x@a" + ".a" * 3000 + " 4111 1111 1111 1111, 378282246310005 0000000000000 4111-1111-1111-1112",
        "GB82 WEST 1234 5698 7654 32 DE89370400440532013000 XX00 0000", "+49 30 1234 5678 (017) 555-7713 800-555-0199 +1 800-555-0199",
        "078-05-1120 666-12-1234 123-00-1234 10.0.0.1 256.1.1.1 1.2.3.4.5", "A@b.c a.B9@x.org .@a.b é@x.org Zz99._%+-@q.w", "", None,
    ]
    got = by_id(pii.pseudonymize(spark.createDataFrame(list(enumerate(odd)), "doc_id int, text string"), "k"))
    assert [got[i][0] for i in range(len(odd))] == [brute.Pseudonyms("k").text(t, pii.KINDS) for t in odd]


def test_an_email_of_very_many_labels(spark):
    text = "x@a" + ".a" * 100_000
    (r,) = pii.pseudonymize(spark.createDataFrame([(1, text)], "doc_id int, text string"), "k").collect()
    assert r.n_email == 1 and r.text[1:] == text[1:]


def test_dates_that_are_month_first_stay_so(spark):
    days = spark.range(0, pii.DAYS, 11).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "MM/dd/yyyy").alias("d")).where("substr(d, 4, 2) > 12")
    out = days.select("d", pii._date(pii.key_of("k", "date"), F.col("d")).alias("x"))
    assert out.where("substr(x, 4, 2) > 12 AND substr(x, 1, 2) <= 12").select("x").distinct().count() == days.count()


def test_permutations_are_one_to_one(spark):
    key = pii.key_of("k", "any")
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"), F.col("id"))
    assert df.select(pii.permuted_digits(key, F.col("d"))).distinct().count() == 1000
    days = spark.range(0, pii.DAYS, 7).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("d"))
    assert days.select(pii._date(key, F.col("d")).alias("x")).where("x IS NOT NULL AND try_to_date(x) IS NOT NULL").distinct().count() == days.count()
    mails = spark.range(26 * 26).select(F.concat(F.chr(F.col("id") % 26 + 97), F.chr(F.floor(F.col("id") / 26).cast("int") + 97)).alias("d"))
    assert mails.select(pii.permuted_local(key, F.col("d"))).distinct().count() == 26 * 26
    ips = spark.range(500).select(F.concat(F.lit("10.0."), F.floor(F.col("id") / 256).cast("int"), F.lit("."), F.col("id") % 256).alias("d"))
    assert ips.select(pii._ip(key, F.col("d"))).distinct().count() == 500


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def judged(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(brute.UPPER)
    fits = [(h + p, v) for r, v in RULES for h, p in [(r[: r.index("/")], r[r.index("/") :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda x: len(x[0]), default=None)


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://A.Net", "HTTP://a.NET/", "https://x.example.net/en/1?q#f", "https://example.net/EN/", "ftp://u@example.org:80/fr/x", "http://q.org/fr/#a", "http://b.example.com/de/", "http://net/x://y", "x://badnet/", "http://a.net?x=/en/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id int, url string, host string")
    labels = spark.createDataFrame([], "doc_id int, quality int, toxic int")
    got = by_id(url_filter.judge_urls(pages, labels))
    for i, u in enumerate(urls):
        host, path, rule = judged(u)
        assert got[i] == (host, path, rule[0] if rule else None, rule[1] if rule else "allow"), u
    assert url_filter.judge_urls(pages.limit(0), labels).count() == 0


def test_reputation(spark):
    rnd = random.Random(2)
    rows, outcome = [], []
    for h in range(60):
        bad = h < 8
        for _ in range(40 if h % 2 else 3):
            i = len(rows)
            rows.append((i, f"http://h{h}.site{h % 30}.{'org' if h % 3 else 'com'}/p"))
            if rnd.random() < 0.8:
                outcome.append((i, int(rnd.random() < (0.05 if bad else 0.9)), 0))
    pages, labels = spark.createDataFrame(rows, "page_id int, url string"), spark.createDataFrame(outcome + [(3, None, None)], "doc_id int, quality int, toxic int")
    got = by_id(url_filter.judge_urls(pages, labels, rules=[]))
    blocked = {got[i][0] for i, _ in rows if got[i][3] == "block"}
    assert {f"h{h}.site{h}." + ("org" if h % 3 else "com") for h in (1, 3, 5, 7)} <= blocked
    assert all(int(re.match(r"h(\d+)", b)[1]) < 8 for b in blocked)
    base = pages.select(F.col("page_id").alias("id"), url_filter.host_of(F.col("url")).alias("host"))
    rep = url_filter.host_reputation(base.join(labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("outcome")), "id", "left")).collect()
    assert all(0 < r.mean < 1 and r.low < r.mean < r.high for r in rep)
    assert url_filter.registered_domain is not None
    names = spark.createDataFrame([("a.b.co.uk",), ("b.co.uk",), ("x.org",), ("org",)], "h string")
    assert [r[0] for r in names.select(url_filter.registered_domain(F.col("h"), ("co.uk",))).collect()] == ["b.co.uk", "b.co.uk", "x.org", "org"]


def test_beta_quantiles(spark):
    shapes = [(0.05, 0.9), (0.4, 3.0), (1.0, 1.0), (2.0, 5.0), (0.7, 40.0), (30.0, 12.0), (900.0, 5000.0), (9000.0, 3.0)]
    got = spark.createDataFrame(shapes, "a double, b double").select(url_filter.beta_quantiles(F.col("a"), F.col("b"), [0.05, 0.95]).alias("q")).collect()
    draw = np.random.default_rng(3)
    for (a, b), r in zip(shapes, got, strict=True):
        x = draw.beta(a, b, 400_000)
        below = [float((x <= q).mean()) for q in r.q]
        assert below == pytest.approx([0.05, 0.95], abs=0.004), (a, b)


def test_names_and_domains(spark):
    hosts = {
        "u:p@a.example.org:8080": ("a.example.org", "example.org"), "x@y@shop.co.uk:": ("shop.co.uk", "shop.co.uk"), "10.0.0.17:80": ("10.0.0.17", "10.0.0.17"),
        "[::1]:80": ("[::1]", "[::1]"), "a.b.com.br": ("a.b.com.br", "b.com.br"), "com.br": ("com.br", "com.br"), "local": ("local", "local"), ":80": ("", ""),
    }
    name = url_filter.name_of(F.col("h"))
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", name, url_filter.registered_domain(name)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == hosts


def test_line_sql(docs, rows):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got = {r[0]: r[1:] for r in con.sql("SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM (" + line_dedup.OP4_SQL + ")").fetchall()}
    assert got == brute.lines(rows)
