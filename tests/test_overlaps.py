import itertools
import random

import pytest

from spanforge.operators import overlaps
from spanforge.plans.seqinfo import seqinfo
from spanforge.sources.ingest import ranges

SPACES = ["chr1"] + ["chr2"] * 3 + ["chr1"] * 2 + ["chr3"] * 4


def hits(df):
    return sorted(tuple(r) for r in df.collect())


def base(spark, strand="-++**+++--"):
    return ranges(spark, SPACES, list(range(1, 11)), end=10, strand=list(strand))


@pytest.mark.parametrize(
    ("strand", "kind", "want"),
    [
        ("+--", "any", [(2, 7), (3, 1), (3, 5)]),
        ("+--", "start", [(3, 1)]),
        ("+--", "end", []),
        ("**-", "any", [(1, 1), (1, 5), (1, 6), (2, 7), (3, 1), (3, 5)]),
        ("**-", "start", [(1, 5), (3, 1)]),
        ("**-", "end", [(1, 1), (1, 5), (1, 6)]),
    ],
)
def test_literal(spark, strand, kind, want):
    subject = base(spark, "-+++------")
    query = ranges(spark, ["chr1", "chr3", "chr1"], [5, 2, 1], end=[10, 7, 5], strand=list(strand))
    assert hits(overlaps.find_overlaps(query, subject, kind=kind)) == want


@pytest.mark.parametrize("length", [9, 8, 7])
def test_circular(spark, length):
    x = ranges(spark, "A", [2, 4, 6, 8], width=3)
    info = seqinfo(spark, ["A"], [length], [True])
    on = lambda s: {(p - 1) % length for p in range(s, s + 3)}
    want = [(i + 1, j + 1) for i, a in enumerate([2, 4, 6, 8]) for j, b in enumerate([2, 4, 6, 8]) if on(a) & on(b)]
    assert hits(overlaps.find_overlaps(x, x, seqinfo=info)) == want


def brute(q, s, kind, maxgap, minoverlap, ignore):
    out = []
    for (i, a), (j, b) in itertools.product(enumerate(q, 1), enumerate(s, 1)):
        if a[0] != b[0] or not (ignore or "*" in (a[3], b[3]) or a[3] == b[3]):
            continue
        ov = max(0, min(a[2], b[2]) - max(a[1], b[1]) + 1)
        g, m = maxgap + 1, max(maxgap, 0)
        ok = {
            "any": b[1] <= a[2] + g and b[2] >= a[1] - g,
            "start": abs(a[1] - b[1]) <= m,
            "end": abs(a[2] - b[2]) <= m,
            "within": b[1] <= a[1] and a[2] <= b[2] and (maxgap < 0 or (b[2] - b[1]) - (a[2] - a[1]) <= maxgap),
            "equal": abs(a[1] - b[1]) <= m and abs(a[2] - b[2]) <= m,
        }[kind]
        if ok and ov >= minoverlap:
            out.append((i, j))
    return out


@pytest.mark.parametrize("kind", ["any", "start", "end", "within", "equal"])
@pytest.mark.parametrize(("maxgap", "minoverlap"), [(-1, 0), (0, 0), (2, 0), (-1, 2)])
def test_against_brute_force(spark, kind, maxgap, minoverlap):
    rnd = random.Random(f"{kind}{maxgap}{minoverlap}")
    row = lambda: (rnd.choice("AB"), s := rnd.randint(-20, 60), s + rnd.choice([0, 1, 3, 8, 40, 900]) - 1, rnd.choice("+-*"))
    q, s = [row() for _ in range(60)], [row() for _ in range(60)]
    frame = lambda rows: ranges(spark, *[list(c) for c in list(zip(*rows, strict=True))[:2]], end=[r[2] for r in rows], strand=[r[3] for r in rows])
    for ignore in (False, True):
        found = overlaps.find_overlaps(frame(q), frame(s), kind=kind, maxgap=maxgap, minoverlap=minoverlap, ignore_strand=ignore, bins=4)
        assert hits(found) == brute(q, s, kind, maxgap, minoverlap, ignore)


def test_exhaustive_grid_with_empty_ranges(spark):
    starts = [s for s in range(1, 7) for _ in range(7 - s)]
    ends = [e for s in range(0, 6) for e in range(s, 6)]
    q = [(c, s, s + 2, t) for c, t in (("chr1", "+"), ("chr2", "+"), ("chrM", "-")) for s in range(-3, 8)]
    t = [(c, s, e, k) for c, k in (("chr1", "+"), ("chr2", "-"), ("chrM", "*")) for s, e in zip(starts, ends, strict=True)]
    frame = lambda rows: ranges(spark, [r[0] for r in rows], [r[1] for r in rows], end=[r[2] for r in rows], strand=[r[3] for r in rows])
    for gap, least in [(-1, 0), (0, 0), (1, 0), (-1, 1), (-1, 3)]:
        assert hits(overlaps.find_overlaps(frame(q), frame(t), maxgap=gap, minoverlap=least)) == brute(q, t, "any", gap, least, False)


def test_select(spark):
    q, s = ranges(spark, "A", [1, 50], width=5), ranges(spark, "A", [1, 2, 3], width=3)
    found = overlaps.find_overlaps(q, s)
    assert hits(overlaps.select_hits(q, found, "first")) == [(1, 1), (2, None)]
    assert hits(overlaps.select_hits(q, found, "last")) == [(1, 3), (2, None)]
    assert hits(overlaps.select_hits(q, found, "count")) == [(1, 3), (2, 0)]
    assert [r.idx for r in overlaps.subset_by_overlaps(q, s, invert=True).collect()] == [2]


def test_lists(spark):
    from pyspark.sql import functions as F

    q = ranges(spark, "A", [1, 11, 21], width=5).withColumn("group", F.when(F.col("idx") < 3, 1).otherwise(2))
    s = ranges(spark, "A", [4, 12, 30], width=4).withColumn("group", F.when(F.col("idx") < 3, 1).otherwise(2))
    assert hits(overlaps.find_overlaps_lists(q, s)) == [(1, 1)]
    assert hits(overlaps.find_overlaps_lists(q, s, minoverlap=6)) == [(1, 1)]
    assert hits(overlaps.find_overlaps_lists(q, s, minoverlap=7)) == []
    assert hits(overlaps.find_overlaps_lists(q, s, kind="within")) == []
    assert hits(overlaps.find_overlaps_lists(s, s, kind="equal")) == [(1, 1), (2, 2)]
