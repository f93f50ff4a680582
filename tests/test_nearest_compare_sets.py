import random

import pytest
from pyspark.sql import functions as F

from spanforge.operators import compare, nearest, setops, tiling
from spanforge.plans.seqinfo import seqinfo
from spanforge.sources.ingest import ranges


def hits(df):
    return sorted(tuple(r) for r in df.select("query_idx", "subject_idx").collect())


def grid(spark):
    return ranges(spark, "chr1", list(range(1, 11)) * 3, width=1, strand=["+"] * 10 + ["*"] * 10 + ["-"] * 10)


@pytest.mark.parametrize(
    ("strand", "before", "after"),
    [("+", [8, 18], [3, 13]), ("-", [13, 23], [18, 28]), ("*", [8, 18, 23], [3, 13, 28])],
)
def test_precede_follow(spark, strand, before, after):
    q = ranges(spark, "chr1", [4], end=[7], strand=strand)
    for block in (None, 2):
        assert [s for _, s in hits(nearest.precede(q, grid(spark), block=block))] == before
        assert [s for _, s in hits(nearest.follow(q, grid(spark), block=block))] == after


def test_nearest(spark):
    q = ranges(spark, "A", [10, 30, 50], width=1)
    s = ranges(spark, "A", [10, 25, 35, 47], width=1)
    assert hits(nearest.nearest(q, s)) == [(1, 1), (2, 3), (3, 4)]
    assert hits(nearest.nearest(q, s, ties="both")) == [(1, 1), (2, 2), (2, 3), (3, 4)]
    assert sorted(tuple(r) for r in nearest.distance_to_nearest(q, s).collect()) == [(1, 1, 0), (2, 2, 4), (3, 4, 2)]
    assert hits(nearest.nearest_in_self(ranges(spark, "A", [1, 2], width=1))) == [(1, 2), (2, 1)]


def test_k_nearest(spark):
    x = ranges(spark, "chr1", [15], width=1)
    at = lambda starts, k, **how: [r.subject_idx for r in nearest.k_nearest(x, ranges(spark, "chr1", starts, width=1), k, **how).orderBy("rank").collect()]
    assert at([10, 20, 30], 1) == [2]
    assert at([10, 20, 30], 2) == [2, 1]
    assert at([10, 20, 30], 3) == [2, 1, 3]
    assert at([10, 20, 30], 1, select="all") == [2, 1]
    assert at([10, 20, 17, 30], 2, select="all") == [3, 2, 1]
    assert at([10, 20, 17, 30], 4) == [3, 2, 1, 4]


def test_distance(spark):
    x = ranges(spark, "A", [1, 1, 1, 1, 5], end=[5, 5, 5, 5, 4], strand=list("++*+*"))
    y = ranges(spark, ["A", "A", "A", "B", "A"], [6, 7, 3, 1, 8], end=[9, 9, 4, 5, 7], strand=list("+-+++"))
    assert [r.distance for r in nearest.distance(x, y).orderBy("idx").collect()] == [0, None, 0, None, 3]
    assert [r.distance for r in nearest.distance(x, y, ignore_strand=True).orderBy("idx").collect()][1] == 1


def test_order_and_rank(spark):
    x = ranges(spark, "chr1", [11, 12, 13, 13, 12, 11, 10, 11, 12], width=5, strand=list("++++---+-"))
    one = seqinfo(spark, ["chr1"])
    assert [r.idx for r in compare.sort_ranges(x, one).collect()] == [1, 8, 2, 3, 4, 7, 6, 5, 9]
    assert [r.idx for r in compare.sort_ranges(x, one, decreasing=True).collect()] == [5, 9, 6, 7, 3, 4, 2, 1, 8]
    assert [r.idx for r in compare.order_of(x, one).orderBy("place").collect()] == [1, 8, 2, 3, 4, 7, 6, 5, 9]
    assert [r["rank"] for r in compare.rank_of(x, one, "min").orderBy("idx").collect()] == [1, 3, 4, 4, 8, 7, 6, 1, 8]
    assert sorted(r["rank"] for r in compare.rank_of(x, one, "random").collect()) == list(range(1, 10))
    assert compare.is_unsorted(x, one).first()[0] is True
    ordered = compare.sort_ranges(x, one).select("seqnames", "start", "end", "strand").collect()
    y = ranges(spark, [r[0] for r in ordered], [r[1] for r in ordered], end=[r[2] for r in ordered], strand=[r[3] for r in ordered])
    assert compare.is_unsorted(y, one).first()[0] is False
    assert compare.is_unsorted(y, one, strictly=True).first()[0] is True


def covered(rows, strand):
    return {(c, p) for c, s, e, t in rows if t == strand for p in range(s, e + 1)}


def test_set_operations_by_position(spark):
    rnd = random.Random(5)
    row = lambda: (rnd.choice("AB"), s := rnd.randint(1, 40), s + rnd.randint(0, 9) - 1, rnd.choice("+-*"))
    xs, ys = [row() for _ in range(25)], [row() for _ in range(25)]
    frame = lambda rows: ranges(spark, [r[0] for r in rows], [r[1] for r in rows], end=[r[2] for r in rows], strand=[r[3] for r in rows])
    x, y = frame(xs), frame(ys)
    for op, test in ((setops.union_ranges, set.union), (setops.intersect_ranges, set.intersection), (setops.setdiff_ranges, set.difference)):
        for block in (None, 7):
            got = [tuple(r) for r in op(x, y, block=block).select("seqnames", "start", "end", "strand").collect()]
            for strand in "+-*":
                assert covered(got, strand) == test(covered(xs, strand), covered(ys, strand))
            assert len(got) == len(set(got))
    assert setops.setdiff_ranges(x, x).count() == 0


def test_parallel_operations(spark):
    x, y = ranges(spark, "A", [1, 10, 20], end=[5, 15, 25], strand=list("+*+")), ranges(spark, "A", [4, 16, 30], end=[8, 18, 33], strand=list("+-*"))
    rows = lambda df: [(r.start, r.end, r.strand) for r in df.orderBy("idx").collect()]
    got = setops.parallel_intersect(x, y)
    assert rows(got) == [(4, 5, "+"), (16, 15, "-"), (20, 19, "+")]
    assert [r.hit for r in got.orderBy("idx").collect()] == [True, True, False]
    assert rows(setops.parallel_union(x, y, fill_gap=True)) == [(1, 8, "+"), (10, 18, "-"), (20, 33, "+")]
    assert rows(setops.parallel_gap(x, y)) == [(4, 3, "+"), (16, 15, "-"), (26, 29, "+")]
    assert rows(setops.parallel_setdiff(x, y)) == [(1, 3, "+"), (10, 15, "-"), (20, 25, "+")]
    with pytest.raises(Exception, match="two"):
        setops.parallel_setdiff(ranges(spark, "A", [1], end=[9]), ranges(spark, "A", [3], end=[4])).collect()
    with pytest.raises(Exception, match="gap"):
        setops.parallel_union(x, y).collect()


def test_subtract(spark):
    x, y = ranges(spark, "A", [1, 20, 40], end=[10, 29, 41]), ranges(spark, "A", [3, 4, 20, 40], end=[4, 6, 29, 50])
    got = [(r.idx, r.start, r.end, r.piece) for r in setops.subtract(x, y).orderBy("idx", "piece").collect()]
    assert got == [(1, 1, 2, 1), (1, 7, 10, 2)]


def test_tiles(spark):
    toy = seqinfo(spark, ["chr1", "chr2", "chr3"], [60, 20, 25])
    rows = tiling.tile_axis(toy, n=5).groupBy("tile").agg(F.sum(F.expr("end - start + 1")).alias("w"), F.count("*").alias("n")).orderBy("tile").collect()
    assert [(r.w, r.n) for r in rows] == [(21, 1), (21, 1), (21, 2), (21, 2), (21, 1)]
    rows = tiling.tile_axis(toy, n=9).groupBy("tile").agg(F.sum(F.expr("end - start + 1")).alias("w"), F.count("*").alias("n")).orderBy("tile").collect()
    assert {r.w for r in rows} == {11, 12} and [r.tile for r in rows if r.n == 2] == [6, 7]
    assert tiling.tile_axis(toy, tile_width=20).select("tile").distinct().count() == 6
    assert {r.w for r in tiling.tile_spaces(toy, 24).select(F.expr("end - start + 1").alias("w")).collect()} == {24, 12, 20, 1}


def test_binned_average(spark):
    bins = ranges(spark, "A", [1, 4, 9, 3], end=[3, 6, 10, 2])
    runs = spark.createDataFrame([("A", 1, 4, 2.0), ("A", 5, 5, None)], "seqnames string, start int, end int, value double")
    got = [r.average for r in tiling.binned_average(bins, runs).orderBy("idx").collect()]
    assert got[:3] == [2.0, None, 0.0] and got[3] != got[3]
    assert [r.average for r in tiling.binned_average(bins, runs, na_rm=True).orderBy("idx").collect()][1] == 1.0
