import math

import pytest
from pyspark.sql import functions as F

from spanforge.operators import inter, intra, lists, transcripts
from spanforge.plans.seqinfo import in_order, merge_seqinfo, seqinfo
from spanforge.sources.ingest import ranges

SPACES = ["chr1"] + ["chr2"] * 3 + ["chr1"] * 2 + ["chr3"] * 4


def base(spark):
    return ranges(spark, SPACES, list(range(1, 11)), end=10, strand=list("-++**+++--"))


def info(spark, **how):
    return seqinfo(spark, ["chr1", "chr2", "chr3"], **how)


def bounds(df):
    return [(r.start, r.end) for r in df.orderBy("idx").collect()]


def table(df):
    return sorted(tuple(r) for r in df.collect())


def test_resize(spark):
    minus = {1, 9, 10}
    want = [(1, 10)] + [(s, s + 9) for s in range(2, 9)] + [(1, 10), (1, 10)]
    assert bounds(intra.resize(base(spark), 10)) == want
    want = [(1, 10) if i in minus else (i, i + 9) for i in range(1, 11)]
    assert bounds(intra.resize(base(spark), 10)) == want
    assert bounds(intra.resize(base(spark), 10, "end")) == [(i, i + 9) if i in minus else (1, 10) for i in range(1, 11)]
    center = [(i + math.floor((11 - i - 4) / 2),) * 1 for i in range(1, 11)]
    assert [b[:1] for b in bounds(intra.resize(base(spark), 4, "center"))] == center


def test_flank_and_friends(spark):
    minus = {1, 9, 10}
    assert bounds(intra.flank(base(spark), 10)) == [(11, 20) if i in minus else (i - 10, i - 1) for i in range(1, 11)]
    assert bounds(intra.flank(base(spark), 10, start=False)) == [(i - 10, i - 1) if i in minus else (11, 20) for i in range(1, 11)]
    assert bounds(intra.promoters(base(spark), 5, 3)) == [(8, 15) if i in minus else (i - 5, i + 2) for i in range(1, 11)]
    assert bounds(intra.terminators(base(spark), 5, 3)) == [(i - 2, i + 5) if i in minus else (5, 12) for i in range(1, 11)]
    with pytest.raises(ValueError):
        intra.promoters(base(spark), -1)
    assert bounds(intra.shift(intra.shift(base(spark), 10), -10)) == bounds(base(spark))


def test_restrict_and_trim(spark):
    assert bounds(intra.restrict(base(spark), 3, 7)) == [(max(i, 3), 7) for i in range(1, 9)]
    assert bounds(intra.restrict(base(spark), 3, 7, keep_all=True))[8:] == [(8, 7), (8, 7)]
    assert bounds(intra.restrict(base(spark), {"chr1": 4}, {"chr2": 5}))[:3] == [(4, 10), (2, 5), (3, 5)]
    assert bounds(intra.trim(base(spark), info(spark, lengths=[8, None, 9]))) == [(1, 8), (2, 10), (3, 10), (4, 10), (5, 8), (6, 8), (7, 9), (8, 9), (9, 9), (10, 9)]
    assert intra.out_of_bounds(base(spark), info(spark, lengths=[8, None, 9], circular=[True, None, False])).count() == 4


def test_narrow_tile_windows(spark):
    x = ranges(spark, "A", [11, 1], width=[10, 3])
    assert bounds(intra.narrow(x, start=2, end=-2)) == [(12, 19), (2, 2)]
    assert [(r.tile, r.start, r.end) for r in intra.tile(x, n=3).orderBy("idx", "tile").collect()] == [(1, 11, 13), (2, 14, 16), (3, 17, 20), (1, 1, 1), (2, 2, 2), (3, 3, 3)]
    assert [(r.start, r.end) for r in intra.sliding_windows(x, 4, 3).orderBy("idx", "window").collect()] == [(11, 14), (14, 17), (17, 20), (1, 3)]
    back = intra.relative(intra.absolute(x, seqinfo(spark, ["Z", "A"], [5, 30])), seqinfo(spark, ["Z", "A"], [5, 30]))
    assert bounds(back) == bounds(x)
    assert [r[0] for r in intra.is_small(seqinfo(spark, ["a", "b"], [1, None])).collect()] == [None]


def test_merge(spark):
    for block in (None, 3):
        got = inter.merge_ranges(base(spark), revmap=True, block=block)
        rows = [(r.seqnames, r.strand, r.start, r.end, r.revmap) for r in in_order(got, info(spark)).collect()]
        assert rows == [
            ("chr1", "+", 6, 10, [6]), ("chr1", "-", 1, 10, [1]), ("chr1", "*", 5, 10, [5]), ("chr2", "+", 2, 10, [2, 3]),
            ("chr2", "*", 4, 10, [4]), ("chr3", "+", 7, 10, [7, 8]), ("chr3", "-", 9, 10, [9, 10]),
        ]
    x = ranges(spark, "A", [1, 6, 10, 30, 30], end=[5, 8, 12, 29, 29])
    assert table(inter.merge_ranges(x).select("start", "end")) == [(1, 8), (10, 12), (30, 29)]
    assert table(inter.merge_ranges(x, min_gap=2, drop_empty=True).select("start", "end")) == [(1, 12)]
    assert table(inter.merge_ranges(x, min_gap=0, drop_empty=True).select("start", "end")) == [(1, 5), (6, 8), (10, 12)]


def test_gaps(spark):
    got = inter.gaps(base(spark), info(spark), ignore_strand=True)
    assert table(got.select("seqnames", "start", "end")) == [("chr2", 1, 1), ("chr3", 1, 6)]
    got = inter.gaps(base(spark), info(spark, lengths=[10, 10, 12]))
    assert got.where("strand = '*' AND seqnames = 'chr3'").select("start", "end").collect() == [(1, 12)]
    assert got.count() == 10


def test_disjoin(spark):
    got = inter.disjoin(base(spark), revmap=True)
    assert table(got.where("seqnames = 'chr2' AND strand = '+'").select("start", "end", "revmap")) == [(2, 2, [2]), (3, 10, [2, 3])]
    assert table(inter.disjoin(base(spark), ignore_strand=True).where("seqnames = 'chr1'").select("start", "end")) == [(1, 4), (5, 5), (6, 10)]
    assert inter.is_disjoint(base(spark)).first()[0] is False
    assert inter.is_disjoint(inter.disjoin(base(spark))).first()[0] is True


def test_disjoint_bins(spark):
    x = ranges(spark, "A", [1, 2, 4, 6, 20], end=[5, 3, 8, 9, 21])
    assert [(r.idx, r.bin) for r in inter.disjoint_bins(x).orderBy("idx").collect()] == [(1, 1), (2, 2), (3, 2), (4, 1), (5, 1)]


def test_coverage(spark):
    got = inter.coverage(base(spark))
    assert table(got.where("seqnames = 'chr2'").select("start", "end", "value")) == [(1, 1, 0), (2, 2, 1), (3, 3, 2), (4, 10, 3)]
    got = inter.coverage(base(spark), width={"chr1": 10, "chr2": 20, "chr3": 30}, weight={"chr1": 1, "chr2": 10, "chr3": 100}, shift={"chr1": 0, "chr2": 1, "chr3": 2})
    assert table(got.where("seqnames = 'chr2'").select("start", "end", "value")) == [(1, 2, 0), (3, 3, 10), (4, 4, 20), (5, 11, 30), (12, 20, 0)]
    x = ranges(spark, ["A", "B"], [5, 6], end=[11, 12])
    got = inter.coverage(x, seqinfo(spark, ["A", "B"], [10, None], [True, None]))
    assert table(got) == [("A", 1, 1, 1), ("A", 2, 4, 0), ("A", 5, 10, 1), ("B", 1, 5, 0), ("B", 6, 12, 1)]


def test_stitch(spark):
    x = ranges(spark, "A", [1, 3, 6, 5], end=[2, 5, 7, 5])
    assert bounds(inter.stitch(x)) == [(1, 7), (5, 5)]


def test_lists_equal_flat_by_element(spark):
    x = base(spark).withColumn("group", F.col("idx") % 2)
    whole = table(inter.merge_ranges(x, by=("group",)))
    apart = sorted((g, *r) for g in (0, 1) for r in table(inter.merge_ranges(x.where(F.col("group") == g).drop("group"))))
    assert whole == apart
    assert table(lists.flat(lists.nested(x)).select("group", "idx", "start")) == table(x.select("group", "idx", "start"))


def test_pruning(spark):
    x = ranges(spark, ["chr2", "chr2", "chr2", "chrMT", "chrY", "chrMT"], 1, width=5).withColumn("group", F.expr("array('A','A','B','B','C','C')[idx - 1]"))
    groups = spark.createDataFrame([(g,) for g in "ABCD"], "group string")
    keep = seqinfo(spark, ["chr2", "chr5"])
    kept = lambda p: sorted(r[0] for r in lists.keep_groups(groups, x, keep, p).collect())
    assert kept("coarse") == ["A", "D"] and lists.keep_spaces(x, keep, "coarse").count() == 2
    assert kept("fine") == ["A", "B", "C", "D"] and lists.keep_spaces(x, keep, "fine").count() == 3
    assert kept("tidy") == ["A", "B", "D"]
    with pytest.raises(Exception, match="space in use"):
        lists.keep_spaces(x, keep).collect()


def test_seqinfo_merge(spark):
    a, b = seqinfo(spark, ["x", "y"], [1, None]), seqinfo(spark, ["y", "z"], [2, 3])
    assert [(r.seqnames, r.seqlength) for r in merge_seqinfo(a, b).orderBy("seqid").collect()] == [("x", 1), ("y", 2), ("z", 3)]
    with pytest.raises(Exception, match="conflicting"):
        merge_seqinfo(b, seqinfo(spark, ["z"], [4])).collect()


def test_transcripts(spark):
    exons = ranges(spark, "A", [1, 11], width=3, strand="-").withColumn("group", F.lit(1))
    places = spark.createDataFrame([(1, t) for t in (1, 3, 4, 6, 7)], "group int, tloc int")
    at = lambda **how: [r.ref_pos for r in transcripts.to_reference(places, exons, **how).orderBy("tloc").collect()]
    assert at() == [3, 1, 13, 11, None]
    assert at(decreasing_on_minus=True) == [13, 11, 3, 1, None]
