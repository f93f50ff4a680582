"""Secrets in texts: known shapes, and strings that look random by a battery of tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running, written

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A match of AKIA[A-Z0-9]+ or [0-9a-f]+ reaches to the end of its run, so asking for the length in the pattern finds the same spans.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"

_VOWELS, _CONSONANTS = "aeiouAEIOU", "bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ"
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from the narrowest alphabet: name, alphabet, and what text in it is like at most or least: the excess of repeated
#: symbols (alphabet size times index of coincidence, less 1; at least), the share of neighbours of two classes (lower,
#: upper, digit, mark; at most) and that of neighbouring letters of which one is a vowel (at least). None: says nothing there.
ENCODINGS = [
    ("decimal", _DIGITS, 1.0, None, None),
    ("hex", _DIGITS + "abcdef", 1.0, 0.2, None),
    ("hex_upper", _DIGITS + "ABCDEF", 1.0, 0.2, None),
    ("lower", _LOWER, 0.7, None, 0.5),
    ("upper", _UPPER, 0.7, None, 0.5),
    ("base32", _UPPER + "234567", 1.1, 0.25, 0.5),
    ("base36", _DIGITS + _LOWER, 1.3, 0.25, 0.5),
    ("alphanumeric", _UPPER + _LOWER + _DIGITS, 2.8, 0.4, 0.5),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/", 2.9, 0.4, 0.5),
    ("base64url", _UPPER + _LOWER + _DIGITS + "_-", 2.9, 0.4, 0.5),
    ("other", _UPPER + _LOWER + _DIGITS + "+/_-", 3.0, 0.4, 0.5),
]
#: Lower ends of the length classes within which discoveries are controlled.
LENGTHS = [20, 28, 40, 64, 128]
#: p-values are kept as whole numbers of 1 / 20 decades, rounded up, 0 to 400.
P_STEPS, P_MOST = 20, 400


def find_spans(text: Column, pattern: str, group: int | None = None) -> Column:
    """Leftmost non-overlapping matches as array of (start, end, match[, group]); code points from 0, end exclusive."""

    def located(pieces: Column, found: Column, groups: Column | None) -> Column:
        lengths = F.transform(found, lambda m, i: (F.length(m) + F.length(F.get(pieces, i))).cast("bigint"))

        def rows(before: Column) -> Column:
            return F.transform(
                found,
                lambda m, i: F.struct(
                    (F.get(before, i) + F.length(F.get(pieces, i))).alias("start"),
                    (F.get(before, i) + F.length(F.get(pieces, i)) + F.length(m)).alias("end"),
                    m.alias("match"),
                    *([F.get(groups, i).alias("group")] if groups is not None else []),
                ),
            )

        return let(running(lengths), rows)

    every = lambda t, g: F.regexp_extract_all(t, F.lit(pattern), F.lit(g))
    body = lambda t, groups: let(F.split(t, pattern), lambda p: let(every(t, 0), lambda m: located(p, m, groups)))
    return body(text, None) if group is None else let(every(text, group), lambda g: body(text, g))


def base_spans(text: Column) -> dict[str, Column]:
    """kind: spans of the known shapes, kinds in the order of listing."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    only = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    gate = lambda test, spans: F.when(test, only(spans)).otherwise(empty)
    return {
        "assign": gate(text.rlike("(?i:pass|secret|token|api_?key)"), F.filter(find_spans(text, ASSIGN, 2), lambda s: F.length(s["group"]) >= 6)),
        "access": gate(text.contains("AKIA"), find_spans(text, ACCESS)),
        "hex": gate(text.rlike(HEX), find_spans(text, HEX)),
    }


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution, at most a few per cent too large in the far tail."""
    a = F.abs(z)
    density = F.exp(-a * a / 2) * F.lit(0.3989422804014327)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * a)
    near = density * t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * F.lit(1.330274429)))))
    far = density * 4 / (a * 3 + F.sqrt(a * a + 8))
    one = F.when(a < 4, near).otherwise(far)
    return F.when(z >= 0, one).otherwise(F.lit(1.0) - one)


def battery(token: Column) -> Column:
    """Tests of one string in the narrowest encoding that holds it.

    Struct of stratum (encoding and length class), p_text (how likely text is this much like a random string: the p-value
    that counts as discovery), and z-scores against true randomness: z_chi (chi-squared uniformity, Wilson-Hilferty),
    z_runs (runs of symbols in the alphabet's lower and upper half), z_serial (serial correlation of ranks).

    p_text puts together, by Fisher's method, those of three one-sided tests against text that the encoding allows:
    symbols more even (chi-squared), more runs of one class of symbols, and less of the turn from vowel to consonant and
    back that neighbours in words have.
    """
    body = F.rtrim(token, F.lit("="))

    def encoded(s: Column) -> Column:
        pick = F.lit(len(ENCODINGS) - 1)
        for i in reversed(range(len(ENCODINGS) - 1)):
            pick = F.when(F.length(F.translate(s, ENCODINGS[i][1], "")) == 0, F.lit(i)).otherwise(pick)
        return let(pick, lambda e: tested(s, e))

    def tested(s: Column, e: Column) -> Column:
        alphabet = F.element_at(F.array(*[F.lit(x[1]) for x in ENCODINGS]), e + 1)
        of = lambda i: F.element_at(F.array(*[F.lit(x[i]).cast("double") for x in ENCODINGS]), e + 1)
        ranks = lambda al: F.transform(F.split(s, ""), lambda c: F.instr(al, c).cast("double"))
        return let(alphabet, lambda al: let(ranks(al), lambda r: scores(s, e, al, of, r)))

    def neighbours(s: Column, kinds: dict[str, str], test: Callable[[Column, Column], Column]) -> Column:
        """Neighbours in s for which the test holds; symbols stand for their kind."""
        named = F.translate(s, "".join(kinds.values()), "".join(k * len(v) for k, v in kinds.items()))
        both = lambda xs: F.filter(F.transform(xs, lambda x, i: test(x, F.get(xs, i + 1))), lambda t: t)
        return F.size(let(F.split(named, ""), both)).cast("double")

    def scores(s: Column, e: Column, al: Column, of: Callable[[int], Column], r: Column) -> Column:
        n, k = F.length(s).cast("double"), F.length(al).cast("double")
        square = lambda c: (F.lit(0.0) + F.length(s) - F.length(F.replace(s, c, F.lit("")))) * (F.length(s) - F.length(F.replace(s, c, F.lit(""))))
        chi = F.aggregate(F.transform(F.split(al, ""), square), F.lit(0.0), lambda a, x: a + x) * k / n - n
        add = lambda f: F.aggregate(F.transform(r, f), F.lit(0.0), lambda a, x: a + x)
        nxt = lambda i: F.coalesce(F.get(r, i + 1), F.get(r, F.lit(0)))
        upper = lambda x: x > k / 2
        sums = F.struct(
            chi.alias("chi"),
            add(lambda x: x).alias("x"),
            add(lambda x: x * x).alias("xx"),
            add(lambda x, i: x * nxt(i)).alias("xy"),
            add(lambda x: upper(x).cast("double")).alias("hi"),
            add(lambda x, i: F.coalesce((upper(F.get(r, i + 1)) != upper(x)).cast("double"), F.lit(1.0))).alias("runs"),
            neighbours(s, {"a": _LOWER, "A": _UPPER, "0": _DIGITS, "-": "+/_-"}, lambda x, y: x != y).alias("changes"),
            neighbours(s, {"v": _VOWELS, "c": _CONSONANTS, "-": _DIGITS + "+/_"}, lambda x, y: (x != "-") & (y != "-")).alias("letters"),
            neighbours(s, {"v": _VOWELS, "c": _CONSONANTS, "-": _DIGITS + "+/_"}, lambda x, y: (x != "-") & (y != "-") & (x != y)).alias("turns"),
        )
        return let(sums, lambda m: F.struct(*finish(m, n, k, of, e)))

    def against_text(m: Column, n: Column, text_mean: Column, text_var: Column, of: Callable[[int], Column]) -> Column:
        even = _tail((text_mean - m["chi"]) / F.sqrt(text_var))
        changes, turns = of(3), of(4)
        many = _tail((m["changes"] - 0.5 - changes * (n - 1)) / F.sqrt(changes * (F.lit(1.0) - changes) * (n - 1)))
        few = F.when(m["letters"] > 0, _tail((turns * m["letters"] - m["turns"] - 0.5) / F.sqrt(turns * (F.lit(1.0) - turns) * m["letters"]))).otherwise(F.lit(1.0))
        log = lambda p: F.when(p.isNotNull(), -F.log(F.least(F.greatest(p, F.lit(1e-30)), F.lit(1.0))))
        said = F.array_compact(F.array(log(even), log(F.when(changes.isNotNull(), many)), log(F.when(turns.isNotNull(), few))))
        fisher = lambda x, tests: F.exp(-x) * F.when(tests == 1, 1.0).when(tests == 2, x + 1).otherwise(x * x / 2 + x + 1)
        return let(said, lambda a: let(F.aggregate(a, F.lit(0.0), lambda t, x: t + x), lambda x: fisher(x, F.size(a))))

    def finish(m: Column, n: Column, k: Column, of: Callable[[int], Column], e: Column) -> list[Column]:
        excess = of(2)
        text_mean, text_var = k - 1 + n * excess, (k - 1) * 2 + n * excess * 4
        cube = 2.0 / ((k - 1) * 9)
        lo = n - m["hi"]
        mean_runs = m["hi"] * lo * 2 / n + 1
        var_runs = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
        spread = n * m["xx"] - m["x"] * m["x"]
        serial = F.when(spread > 0, (n * m["xy"] - m["x"] * m["x"]) / spread).otherwise(F.lit(1.0))
        length_class = F.size(F.filter(F.array(*[F.lit(x) for x in LENGTHS]), lambda x: x <= n))
        return [
            (e * 10 + length_class).alias("stratum"),
            against_text(m, n, text_mean, text_var, of).alias("p_text"),
            ((F.pow(m["chi"] / (k - 1), F.lit(1 / 3)) - (F.lit(1.0) - cube)) / F.sqrt(cube)).alias("z_chi"),
            F.when(var_runs > 0, (m["runs"] - mean_runs) / F.sqrt(var_runs)).otherwise(F.lit(99.0)).alias("z_runs"),
            ((serial + F.lit(1.0) / (n - 1)) / (n / ((n - 1) * F.sqrt(n - 2)))).alias("z_serial"),
        ]

    return let(body, encoded)


def random_candidates(text: Column, taken: Column) -> Column:
    """Strings that could be random, outside the spans in taken: array of (start, end, stratum, p). p: steps of p_text; null where the battery rejects randomness."""

    def judged(s: Column) -> Column:
        return let(battery(s["match"]), lambda b: F.struct(s["start"].alias("start"), s["end"].alias("end"), b["stratum"].alias("stratum"), steps(b).alias("p")))

    def steps(b: Column) -> Column:
        p = F.greatest(F.least(F.floor(-F.log10(F.greatest(b["p_text"], F.lit(1e-30))) * P_STEPS), F.lit(P_MOST)), F.lit(0))
        random = (F.abs(b["z_chi"]) <= 3.3) & (F.abs(b["z_runs"]) <= 3.3) & (F.abs(b["z_serial"]) <= 3.3)
        # Fisher's method over the three two-sided tests, six degrees of freedom
        each = [F.greatest(_tail(F.abs(b[z])) * 2, F.lit(1e-30)) for z in ("z_chi", "z_runs", "z_serial")]
        x = -(F.log(each[0]) + F.log(each[1]) + F.log(each[2]))
        combined = F.exp(-x) * (x * x / 2 + x + 1)
        return F.when(random & (combined >= 0.001), p.cast("int"))

    free = lambda s: ~F.exists(taken, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"]))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,stratum:int,p:int>>")
    return F.when(text.rlike(CANDIDATE), F.transform(F.filter(find_spans(text, CANDIDATE), free), judged)).otherwise(empty)


def discovery_limits(candidates: DataFrame, q: float = 0.01) -> dict[int, int]:
    """Benjamini-Hochberg at level q in each stratum, from a column ``_c`` of candidate arrays: stratum: the least step of p that counts.

    Works on counts by stratum and step (at most strata times steps rows); within a step p-values count as its largest.
    """
    counts = candidates.select(F.explode("_c").alias("c")).groupBy("c.stratum", F.coalesce("c.p", F.lit(-1)).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    out: dict[int, int] = {}
    for stratum in sorted({r["stratum"] for r in counts}):
        here = sorted(((r["p"], r["n"]) for r in counts if r["stratum"] == stratum), reverse=True)
        total, found = sum(n for _, n in here), 0
        for p, n in here:
            found += n
            if p >= 0 and 10 ** (-p / P_STEPS) <= q * found / total:
                out[stratum] = p
    return out


def scan_secrets(docs: DataFrame, q: float = 0.01, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of secrets in each row's whole text: doc_id, base (array of start, end, kind for the shapes ``assign``,
    ``access`` and ``hex``) and found (the same, and ``random`` for strings the battery finds).

    A string of 20 or more key characters outside base spans counts as random if no test of the battery rejects
    randomness and its symbols are too even for text, with false discoveries held at q within each encoding and length
    class over all rows. Null and empty texts have no spans. Rows count for themselves where ids repeat or are null; further
    columns are ignored. An empty table gives no rows. Results of the one pass over the texts are written to the shared
    folder; thresholds are a few dozen numbers.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    kinds = F.create_map(*[x for k, v in base_spans(F.col("_text")).items() for x in (F.lit(k), v)])
    rows = docs.select(F.col(doc_id).alias("_id"), t.alias("_text")).select("_id", "_text", kinds.alias("_b"))
    every = lambda b: F.flatten(F.map_values(b))
    scanned = written(rows.select("_id", "_b", let(every(F.col("_b")), lambda b: random_candidates(F.col("_text"), b)).alias("_c")), "secrets")
    limits = discovery_limits(scanned, q)
    least = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]) if limits else F.create_map().cast("map<int,int>")
    random = F.filter("_c", lambda c: F.coalesce(c["p"] >= F.try_element_at(least, c["stratum"]), F.lit(False)))
    place = lambda spans, i, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("at"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    base = F.concat(*[place(F.col("_b")[k], i, k) for i, k in enumerate(("assign", "access", "hex"))])
    plain = lambda xs: F.transform(F.sort_array(xs), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return scanned.select(F.col("_id").alias(doc_id), plain(base).alias("base"), plain(F.concat(base, place(random, 3, "random"))).alias("found"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_query(docs: DataFrame) -> DataFrame:
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return scan_secrets(docs).select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), span_text(F.col("found")).alias("spans")
    )
