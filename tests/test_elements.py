import pytest

from spanforge.operators import elements, inter, setops
from spanforge.plans import seqinfo as info

RANGES = "idx long, seqnames string, start int, end int, strand string"


@pytest.fixture(scope="module")
def x(spark):
    return spark.createDataFrame([(1, "a", 1, 4, "+"), (2, "a", 3, 6, "-"), (3, "b", 2, 1, "*"), (4, "a", 1, 4, "+")], RANGES)


@pytest.fixture(scope="module")
def variable(spark):
    return spark.createDataFrame([("a", 1, 3, 5), ("a", 4, 9, None), ("b", 1, 7, 2)], "seqnames string, start int, end int, value int")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_runs_as_ranges(spark, variable):
    spaces = info.seqinfo(spark, ["a", "b"], [9, 7])
    got = elements.runs_as_ranges(variable, spaces).orderBy("idx").collect()
    assert [tuple(r) for r in got] == [(1, "a", 1, 3, "*", 5), (4, "a", 4, 9, "*", None), (10, "b", 1, 7, "*", 2)]


def test_grouping(x):
    assert rows(elements.grouping_of(x)) == [(1, 1, 2), (2, 2, 1), (3, 3, 1), (4, 1, 2)]


def test_replace_rows(spark, x):
    y = x.selectExpr("*", "idx * 10 AS score")
    new = spark.createDataFrame([(2, "c", 7, 9, "*")], RANGES)
    assert rows(elements.replace_rows(y, new)) == [(1, "a", 1, 4, "+", 10), (2, "c", 7, 9, "*", None), (3, "b", 2, 1, "*", 30), (4, "a", 1, 4, "+", 40)]
    assert rows(elements.replace_rows(y, new, ["start"]).where("idx = 2")) == [(2, "a", 7, 6, "-", 20)]
    assert rows(elements.replace_rows(y, new.limit(0))) == rows(y)
    with pytest.raises(ValueError, match="no such columns"):
        elements.replace_rows(y, new, ["score"])
    with pytest.raises(Exception, match="no such idx"):
        elements.replace_rows(y, new.selectExpr("idx + 100 AS idx", "seqnames", "start", "end", "strand")).collect()


def test_lists(spark, x):
    listed = x.selectExpr("*", "cast(idx % 2 as long) AS group", "idx AS score")
    groups = spark.createDataFrame([(0, "even", 1.5), (1, "odd", 2.5), (2, "none", None)], "group long, group_name string, weight double")
    ranges, outer = elements.take_elements(listed, groups, spark.createDataFrame([(1,), (2,)], "group long"), ["score"])
    assert rows(ranges.select("idx")) == [(1,), (3,)] and rows(outer.select("group")) == [(1,), (2,)] and "weight" in outer.columns
    assert "weight" not in elements.take_elements(listed, groups.withColumnRenamed("weight", "w"), groups, ["w"])[1].columns
    for bad in (["score", "weight"], ["other"]):
        with pytest.raises(ValueError, match="nor all"):
            elements.take_elements(listed, groups, groups, bad)
    new = spark.createDataFrame([(9, "c", 1, 2, "+", 1)], RANGES + ", group long")
    assert rows(elements.replace_elements(listed, new).select("idx", "group", "score")) == [(2, 0, 2), (4, 0, 4), (9, 1, None)]
    assert rows(elements.replace_elements(listed, new.limit(0), groups.where("group = 0")).select("idx")) == [(1,), (3,)]
    assert rows(elements.local_idx(listed).select("group", "idx", "start")) == [(0, 1, 3), (0, 2, 1), (1, 1, 1), (1, 2, 2)]
    merged = inter.merge_ranges(elements.local_idx(listed), by=("group",), ignore_strand=True, revmap=True)
    assert rows(merged.where("group = 0").select("start", "end", "revmap")) == [(1, 6, [1, 2])]


def test_set_column(spark, x):
    listed = x.selectExpr("*", "cast(idx % 2 as long) AS group")
    values = spark.createDataFrame([(0, 1, 5), (0, 2, 6), (1, 1, None), (1, 2, 8)], "group long, place int, value int")
    assert rows(elements.set_column(listed, values, "score").select("idx", "score")) == [(1, None), (2, 5), (3, 8), (4, 6)]
    assert rows(elements.set_column(listed, values, "end").select("idx", "end").where("end IS NOT NULL")) == [(2, 5), (3, 8), (4, 6)]
    for bad in (values.where("place = 1"), values.selectExpr("group", "place + 1 AS place", "value")):
        with pytest.raises(Exception, match="shapes differ"):
            elements.set_column(listed, bad, "score").collect()


def test_slice_variable(x, variable):
    got = {r.idx: [tuple(p) for p in r.runs] for r in elements.slice_variable(variable, x).collect()}
    assert got == {1: [(1, 3, 5), (4, 1, None)], 2: [(3, 1, 5), (4, 3, None)], 3: [], 4: [(1, 3, 5), (4, 1, None)]}
    with pytest.raises(Exception, match="outside the variable"):
        elements.slice_variable(variable, x.selectExpr("idx", "seqnames", "start", "end + 9 AS end", "strand")).collect()
    assert elements.slice_variable(variable, x.limit(0)).collect() == []


def test_sets_take_ranges_only(x, variable):
    for op in (setops.union_ranges, setops.intersect_ranges, setops.setdiff_ranges):
        for a, b in ((x, variable), (variable, x)):
            with pytest.raises(TypeError, match="not a table of ranges"):
                op(a, b)
