import random
import zlib

import brute
import numpy as np
import pytest
from conftest import EDGES

from spanforge.llm import align, common, decontam, near_dup, sketch, token_counts, token_store
from spanforge.llm.align import _banded, similar
from spanforge.llm.components import components
from spanforge.llm.fm_index import FMIndex
from spanforge.llm.huffman import Code, code_lengths

P = pytest.importorskip("public_tokenizers")
ODD = [
    "", "  ", "a<|endoftext|>b <|startoftext|>", "~ a~b ~~", "İΣ Σας x\x1cy z é ﬁ 'S it's IT'S 12½", "\x85a\x0bb\x0cc",
    "H\u0331 A\u030a h\u0331.", "<|ENDOFTEXT|>x", "Ab,.c d.,! e.F", "x" * 300, "▁ ▁▁ a", "<s> </s>", "\n\n \n", "日本語 テキスト。", "a.\u0301b",
]


def by_id(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_fm_index():
    rng = np.random.default_rng(0)
    for _ in range(40):
        n, k = int(rng.integers(1, 300)), int(rng.integers(2, 6))
        t = rng.integers(0, k, n)
        t[-1] = 0
        index = FMIndex(t, k, sample=int(rng.integers(1, 8)))
        for m in (1, 2, 3):
            phrases = rng.integers(1, k, (20, m))
            for p, a, b in zip(phrases, *index.search(phrases), strict=True):
                want = [i for i in range(n - m + 1) if (t[i : i + m] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_huffman_round_trip():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = int(rng.integers(1, 3000))
        sizes = rng.integers(0, 1000, 20)
        ids = (rng.zipf(1.3, int(sizes.sum())) % n).astype(np.uint32)
        counts = np.bincount(ids, minlength=n)
        lengths = code_lengths(counts, max(12, n.bit_length() + 1))
        used = lengths[lengths > 0].astype(float)
        assert len(used) <= 1 or abs((2.0**-used).sum() - 1) < 1e-9
        code = Code(lengths)
        assert (code.decode(*code.encode(ids, sizes), sizes) == ids).all()
    assert code_lengths(np.array([1, 1, 2, 4, 8, 16]), 3).max() == 3
    with pytest.raises(ValueError):
        code_lengths(np.ones(9, int), 3)


def test_encoder_gives_the_library_s_ids(rows):
    enc = token_store.Encoder(P.path("word_bpe_49k.json"), most=500)
    texts = [t for _, t in rows] + ODD
    assert enc.by_word
    for lo in range(0, len(texts), 50):
        part = texts[lo : lo + 50]
        ids, n = enc.encode([t.encode() for t in part], 1)
        want = [e.ids + [1] for e in enc.tokenizer.encode_batch(part, add_special_tokens=False)]
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    plain = token_store.Encoder(P.path("byte_bpe_50k.json"))
    assert not plain.by_word
    ids, n = plain.encode([t.encode() for t in texts[:20]])
    assert ids.tolist() == [i for t in texts[:20] for i in plain.tokenizer.encode(t, add_special_tokens=False).ids]


def test_word_table_grows():
    rng = np.random.default_rng(9)
    table, n = token_store.WordTable(bits=4), 0
    h, check = rng.integers(0, 1 << 20, 50_000).astype(np.uint64), rng.integers(0, 1 << 60, 50_000).astype(np.uint64)
    for k in (1, 10, 5_000, 44_989):
        table.add(h[n : n + k], check[n : n + k], np.arange(n, n + k, dtype=np.int32))
        n += k
        assert (table.find(h[:n], check[:n]) == np.arange(n)).all() and (table.find(h[n:], check[n:]) == -1).all()


def test_more_words_than_are_remembered():
    enc = token_store.Encoder(P.path("word_bpe_49k.json"), most=100)
    text = " ".join(f"w{i:x}" for i in range(150_000))
    for t in (text, "a b c", text):
        assert enc.encode([t.encode()])[0].tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


def token_files(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    out, at = [], 0
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_files(spark, docs, rows, edges, tmp_path):
    assert sorted(tuple(r) for r in token_store.op10_query(docs).collect()) == token_files(rows)
    got = sorted((tuple(r) for r in token_store.op10_query(edges).collect()), key=lambda r: r[1])
    want = token_files([(d, t) for d, t, _ in EDGES])
    assert [r[0] for r in got] == [r[0] for r in want] and sorted(r[2:] for r in got) == sorted(r[2:] for r in want)
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False))
    assert token_store.op10_query(edges.limit(0)).count() == 0
    path = f"file://{tmp_path}/tokens"
    token_store.write_tokens(docs, path, P.path("byte_bpe_50k.json"))
    read = {r.doc_id: r.ids for r in token_store.read_tokens(spark, path).collect()}
    plain = token_store.Encoder(P.path("byte_bpe_50k.json")).tokenizer
    assert all(read[d] == plain.encode(t, add_special_tokens=False).ids for d, t in rows)


def test_token_counts(docs, rows, edges):
    sp = token_counts.Counter(P.path("piece_bpe_32k.model"), chunk=300, overlap=8)
    assert sp.proven
    texts = [t for _, t in rows] + ODD + ["a" * 5000, "x  y   " * 2000, "▁ ▁▁ a" * 900, "é" * 3000 + " " + "日本" * 2000, " " * 5000, "word " * 3000]
    assert sp.counts(texts) == [len(x) for x in sp.model.encode(texts)]
    got = by_id(token_counts.op5_query(docs))
    assert all(got[d] == (len(t.encode()), n := len(sp.model.encode(t)), n > 4096) for d, t in rows)
    got = sorted(tuple(r)[1:] for r in token_counts.op5_query(edges).collect())
    assert got == sorted((len((t or "").encode()), n := len(sp.model.encode(t or "")), n > 4096) for _, t, _ in EDGES)
    assert token_counts.op5_query(edges.limit(0)).count() == 0


def test_decontamination(spark, docs, rows, benchmark, edges, monkeypatch):
    items = [tuple(r) for r in benchmark.collect()]
    assert by_id(decontam.op8_query(docs, benchmark)) == brute.contaminated(rows, items)
    odd = [(1, "Alpha beta"), (2, None), (3, ""), (4, "é x y alpha BETA gamma"), (5, "q " * 3 + " a b c d e f g h i j k l a b")]
    short = [(1, "alpha beta"), (None, "gamma"), (2, None), (3, ""), (4, "a b c d e f g h i j k l"), (4, "É"), (5, "a b")]
    frame = lambda x, c: spark.createDataFrame(x, f"{c} long, text string")
    want = brute.contaminated(odd, short)
    for size, shard in ((16 << 20, 1 << 20), (10, 3)):
        monkeypatch.setattr(decontam, "BLOCK_CHARS", size)
        monkeypatch.setattr(decontam, "SHARD_SYMBOLS", shard)
        assert by_id(decontam.op8_query(frame(odd, "doc_id"), frame(short, "item_id"))) == want
    monkeypatch.undo()
    assert decontam.op8_query(edges, frame(short, "item_id")).count() == edges.count()
    assert decontam.op8_query(edges.limit(0), benchmark).count() == 0
    assert decontam.op8_query(edges, benchmark.limit(0)).where("contaminated").count() == 0
    left = decontam.drop_passages(edges, benchmark)
    assert left.columns == edges.columns and sorted(map(repr, left.collect())) == sorted(map(repr, edges.collect()))
    x = spark.createDataFrame([(5, "Qa q! a, b c d e f g h i j k. l Zed.")], "doc_id long, text string")
    assert decontam.drop_passages(x, frame(short, "item_id")).first().text == "Qa q! Zed."


def distance(a, b):
    row = list(range(len(b) + 1))
    for n, u in enumerate(a, 1):
        d, row[0] = row[0], n
        for m, v in enumerate(b, 1):
            d, row[m] = row[m], min(row[m] + 1, row[m - 1] + 1, d + (u != v))
    return row[-1]


def test_alignment():
    rnd = random.Random(2)
    for _ in range(1500):
        a = [rnd.randint(0, 9) for _ in range(rnd.randint(0, 40))]
        b = a[:]
        for _ in range(rnd.randint(0, 10)):
            k = rnd.randint(0, len(b))
            b[k : k + rnd.randint(0, 1)] = [rnd.randint(0, 9)] * rnd.randint(0, 1)
        n = max(len(a), len(b), 1)
        x, y = np.array(a, np.uint32), np.array(b, np.uint32)
        d, most = distance(a, b), int(0.2 * n + 1e-9)
        assert similar(x, y, 0.8) == (d <= most)
        assert _banded(x, y, most) == (d <= most)


def test_alignment_in_blocks(monkeypatch):
    rnd = random.Random(3)
    for bits in (5, 16, 64):
        monkeypatch.setattr(align, "BITS", bits)
        for _ in range(500):
            a = [rnd.randint(0, 5) for _ in range(rnd.randint(0, 60))]
            b = [w for w in a if rnd.random() > 0.1]
            b[3:3] = [rnd.randint(0, 9) for _ in range(rnd.randint(0, 8))]
            x, y, d = np.array(a, np.uint32), np.array(b, np.uint32), distance(a, b)
            for most in (d - 1, d, d + 3, d // 2):
                got = align._distance(x, y, most) if most >= 0 else None
                assert got is None or (got == d if d <= most else got > most)
            assert similar(x, y, 0.8) == (d <= int(0.2 * max(len(a), len(b)) + 1e-9))


def test_alignment_of_a_million_words():
    rng = np.random.default_rng(7)
    a = rng.integers(0, 50_000, 1_000_000).astype(np.uint32)
    edited = lambda share: np.where(rng.random(len(a)) < share, rng.integers(0, 50_000, len(a)), a).astype(np.uint32)
    assert similar(a, edited(0.1), 0.8) and not similar(a, edited(0.3), 0.8)


def test_sketch_is_the_same_alone_and_together():
    texts = [b"a b c d e f g", b"", b"x", b"A, b! c d e f g", "é b".encode(), b"a b c " * 4, b"  "]
    words, n = sketch.word_hashes(texts)
    assert n.tolist() == [7, 0, 1, 7, 2, 12, 0]
    h = sketch.text_hashes(words, n)[0]
    keys = dict(zip(np.flatnonzero(n).tolist(), sketch.band_keys(*sketch.shingles(words, n)), strict=True))
    assert h[0] == h[3] and (keys[0] == keys[3]).all() and len(set(h.tolist())) == 5
    for k, t in enumerate(texts):
        w, m = sketch.word_hashes([t])
        one = sketch.band_keys(*sketch.shingles(w, m))
        assert sketch.text_hashes(w, m)[0][0] == h[k] and ((one[0] == keys[k]).all() if m[0] else not len(one))


def test_components(spark):
    links = [(1, 2), (3, 2), (3, 4), (10, 11), (12, 10), (20, 20), *[(30 + i, 31 + i) for i in range(40)]]
    got = sorted(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == sorted([(2, 1), (3, 1), (4, 1), (11, 10), (12, 10), *[(31 + i, 30) for i in range(40)]])


def edited(rnd, words, share):
    out = []
    for w in words:
        r = rnd.random()
        out += [] if r < share / 3 else [f"new{rnd.randrange(10**6)}"] if r < 2 * share / 3 else [w, f"add{rnd.randrange(10**6)}"] if r < share else [w]
    return out


def test_near_duplicates(spark, edges):
    """Copies, near copies of up to one edit in ten words, a group of many, texts that share half, and one long common passage."""
    rnd = random.Random(4)
    word = lambda: f"w{rnd.randrange(3000)}"
    passage = [f"p{i}" for i in range(60)]
    rows, group = [], {}
    for g in range(40):
        base = [word() for _ in range(rnd.randint(60, 400))]
        for _ in range(60 if g == 0 else rnd.randint(1, 4)):
            t = edited(rnd, base, rnd.choice([0, 0.02, 0.1]))
            rows.append((len(rows), " ".join(t).title()))
            group[len(rows) - 1] = g
    for g in range(100, 160):
        rows.append((len(rows), " ".join([word() for _ in range(80)] + passage)))
        group[len(rows) - 1] = g
    got = {r.doc_id: r.class_id for r in near_dup.op1_query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    words = {d: sketch.word_hashes([t.lower().encode()])[0].astype(np.uint32) for d, t in rows}
    want = {d: d for d, _ in rows}  # by increasing id, so a class is named by its least one
    for a, b in ((a, b) for a in words for b in words if a < b and group[a] == group[b]):
        if similar(words[a], words[b], 0.8):
            x, y = sorted((want[a], want[b]))
            want = {d: x if c == y else c for d, c in want.items()}
    # pairs of texts that are both a tenth away from what they were made of lie at the threshold itself
    assert sum(got[d] != want[d] for d in want) <= 0.01 * len(want) and len(set(want.values())) < 110
    out = {(r.doc_id, r.n_words): r.class_id for r in near_dup.near_duplicates(edges).collect()}
    assert out[2, 0] == 2 and out[3, 0] == 3 and out[4, 0] == 4 and out[1, 10] == 1 and out[None, 0] is None
    assert near_dup.op1_query(edges.limit(0)).count() == 0
    kept = near_dup.keep_one(edges)
    assert kept.columns == edges.columns and kept.count() == len(EDGES) - 1


def test_possible_pairs_leave_out_no_similar_pair():
    rnd = random.Random(6)
    texts = []
    for _ in range(30):
        base = [f"w{rnd.randrange(60)}" for _ in range(rnd.choice([4, 30, 300, 3000]))]
        texts += [np.array([zlib.crc32(w.encode()) for w in edited(rnd, base, rnd.choice([0, 0.05, 0.2]))] or [1], np.uint32) for _ in range(3)]
    texts.sort(key=len)
    n, ids = np.array([len(t) for t in texts]), np.arange(len(texts))
    bags = np.array([np.minimum(np.bincount(t % 256, minlength=256), 255) for t in texts], np.uint8)
    got = set(zip(*(x.tolist() for x in near_dup.possible(ids, n, ids, bags, None, 0.8)), strict=True))
    keys = np.array([[g // 2, 100 + g // 3, 200 + g % 5] for g in range(len(texts))])
    buckets = {k: np.flatnonzero((keys == k).any(1)) for k in np.unique(keys).tolist()}
    parts = [near_dup.possible(at, n[at], at, bags[at], None, 0.8, (k, keys[at])) for k, at in buckets.items()]
    found = [p for part in parts for p in zip(*(x.tolist() for x in part), strict=True)]
    met = {(a, b) for a, b in got if (keys[a] == keys[b]).any()}
    assert len(found) == len(set(found)) and set(found) == met
    want = {(a, b) for b in range(len(texts)) for a in range(b) if n[b] <= 1.3 * n[a] and similar(texts[a], texts[b], 0.8)}
    assert want and want <= got and len(got) < len(texts) ** 2 / 8


def test_near_duplicates_in_buckets_led_by_others(spark):
    """Letters that share a passage and are alike, where texts of lower ids that share it, too, are like none of them."""
    rnd = random.Random(5)
    fresh = lambda n: [f"f{rnd.randrange(10**9)}" for _ in range(n)]
    passage = [f"p{i}" for i in range(320)]
    rows = [(i, " ".join(fresh(150 + 5 * i) + passage + fresh(150))) for i in range(40)] + [(i, " ".join(passage + fresh(60))) for i in range(40, 60)]
    got = {r.doc_id: r.class_id for r in near_dup.op1_query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    words = {d: sketch.word_hashes([t.encode()])[0].astype(np.uint32) for d, t in rows}
    want = {d: d for d, _ in rows}
    for a, b in ((a, b) for a in words for b in words if a < b and similar(words[a], words[b], 0.8)):
        x, y = sorted((want[a], want[b]))
        want = {d: x if c == y else c for d, c in want.items()}
    assert all(want[d] == 40 for d in range(40, 60)) and got == want


def test_near_copies_quoted_by_longer_texts_of_lower_ids(spark):
    rnd = random.Random(8)
    fresh = lambda n: [f"f{rnd.randrange(10**9)}" for _ in range(n)]
    rows, want = [], []
    for _ in range(12):
        base = fresh(150)
        rows += [" ".join(fresh(300) + base + fresh(300)) for _ in range(40)]
        other = base[:]
        other[40], other[100] = fresh(2)
        want.append((len(rows), len(rows) + 1))
        rows += [" ".join(base), " ".join(other)]
    got = {r.doc_id: r.class_id for r in near_dup.op1_query(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert all(got[a] == got[b] == a for a, b in want) and len(set(got.values())) == len(rows) - 12


def test_ids_that_are_not_whole_numbers_are_refused(spark):
    docs = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    for query in (near_dup.op1_query, token_store.op10_query):
        with pytest.raises(TypeError):
            query(docs)


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "FEW", 10)
    rows = spark.createDataFrame([(k % 3 if k % 2 else 7, k) for k in range(200)], "k int, x int")
    keyed = common.written(rows.where("k != 1").groupBy("k").count(), "keyed")
    got = sorted(tuple(r) for r in common.spread_join(rows, keyed, ["k"], "count").select("k", "x", "count").collect())
    assert got == sorted(tuple(r) for r in rows.join(keyed, "k").select("k", "x", "count").collect()) and len(got) > 100


def test_near_duplicates_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = {r.doc_id: sketch.word_hashes([r.text.lower().encode()])[0].astype(np.uint32) for r in docs.collect()}
    ids, parent = sorted(words), {i: i for i in words}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = {i: set(words[i].tolist()) for i in ids}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n, m = len(words[a]), len(words[b])
            if min(n, m) and min(n, m) >= 0.8 * max(n, m) and len(bags[a] & bags[b]) >= 0.5 * max(len(bags[a]), len(bags[b])) and similar(words[a], words[b], 0.8):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: r.class_id for r in near_dup.op1_query(docs).collect()}
    wrong = [i for i in ids if got[i] != root(i)]
    assert len(wrong) <= 0.001 * len(ids)
