"""Nearest neighbours by blocks against a plain version, and that nothing of theirs is broadcast."""

import os
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spanforge import catalog
from spanforge.operators import nearest
from spanforge.plans import blocks

SMALL, TYPE = "/root/testdata/sf0.001", "idx bigint, seqnames string, start int, end int, strand string"


def some(seed: int, n: int, far: int, widest: int) -> list[tuple]:
    rnd = random.Random(seed)
    ranges = [(i + 1, rnd.choice("AB"), s := rnd.randint(-far, far), s + rnd.choice([0, rnd.randint(0, widest)]) - 1, rnd.choice("+-*")) for i in range(n)]
    return [*ranges, (n + 1, None, 1, 2, "+"), (n + 2, "A", None, 2, "+")]


def touching(q: tuple, s: tuple, stranded: bool = True) -> bool:
    """Overlapping or adjacent, on strands that go together."""
    return None not in q[:4] + s[:4] and q[1] == s[1] and (not stranded or q[4] == s[4] or "*" in (q[4], s[4])) and s[2] <= q[3] + 1 and s[3] >= q[2] - 1


def unbroadcast(df) -> bool:
    return "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


# dense, with tables of running maxima; wide, compared one query at a time
@pytest.mark.parametrize(("n", "far", "widest", "cells"), [(60, 25, 8, 1 << 21), (80, 3000, 2000, 40)])
def test_last_touching(spark, monkeypatch, n, far, widest, cells):
    monkeypatch.setattr(blocks, "FEWEST", 4)
    monkeypatch.setattr(blocks, "CELLS", cells)
    qs, ss = some(1, n, far, widest), some(2, n, far, widest)
    q, s = spark.createDataFrame(qs, TYPE), spark.createDataFrame(ss, TYPE)
    got = sorted(map(tuple, nearest.nearest(q, s, select="arbitrary").collect()))
    want = {x[0]: max(hits) for x in qs if (hits := [y[0] for y in ss if touching(x, y)])}
    assert {a: b for a, b, _ in got if a in want} == want
    assert got == sorted(map(tuple, nearest.nearest(q, s, select="arbitrary", bins=64).collect()))


def test_distance_to_nearest_broadcasts_nothing(spark):
    assert unbroadcast(catalog.queries()["j11_distance_to_nearest"](spark, SMALL))
    q = catalog.orders(spark, SMALL)
    assert unbroadcast(nearest.distance_to_nearest(q, catalog.parts(spark, SMALL), bins=128))


def test_nearest_in_self(spark, monkeypatch):
    monkeypatch.setattr(blocks, "FEWEST", 4)
    xs = some(3, 60, 200, 12)
    x = spark.createDataFrame(xs, TYPE)
    got = sorted(map(tuple, nearest.nearest_in_self(x).collect()))
    want = sorted((a[0], b[0], 0) for a in xs for b in xs if a[0] != b[0] and touching(a, b))
    assert [r for r in got if r[2] == 0] == want
    assert got == sorted(map(tuple, nearest.nearest_in_self(x, bins=64).collect()))
    last = {r.query_idx: r.subject_idx for r in nearest.nearest_in_self(x, select="arbitrary").where("distance = 0").collect()}
    assert last == {a: b for a, b, _ in want}
    assert unbroadcast(catalog.queries()["j9_nearest_in_self"](spark, SMALL))


@pytest.mark.parametrize("ties", ["precede", "both"])
def test_nearest_all(spark, monkeypatch, ties):
    monkeypatch.setattr(blocks, "FEWEST", 4)
    monkeypatch.setattr(blocks, "ROWS", 7)
    qs, ss = some(4, 60, 200, 12), some(5, 60, 200, 12)
    q, s = spark.createDataFrame(qs, TYPE), spark.createDataFrame(ss, TYPE)
    got = sorted(map(tuple, nearest.nearest(q, s, ties=ties).collect()))
    want = {(a[0], b[0]) for a in qs for b in ss if touching(a, b)}
    touched = {a for a, _ in want}
    assert {r[:2] for r in got if r[0] in touched} == want and len(got) == len(set(got)) and touched < {r[0] for r in got}
    assert got == sorted(map(tuple, nearest.nearest(q, s, ties=ties, bins=64).collect()))
    plan = nearest.nearest(catalog.orders(spark, SMALL), catalog.parts(spark, SMALL), ties=ties)
    # pairs are not dealt out again by query
    assert unbroadcast(plan) and "LeftAnti" not in plan._jdf.queryExecution().executedPlan().toString()


def test_nearest_all_where_only_the_driver_has_the_package(spark, tmp_path):
    code = f"""import sys
sys.path.insert(0, {str(Path(__file__).parents[1])!r})
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
print("rows", __spark_entry__.queries()["j9_nearest_all"](spark, {SMALL!r}).count())
"""
    own = {k: v for k, v in os.environ.items() if not k.startswith(("PYTHONPATH", "PYSPARK_", "SPARK_"))}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=own | {"PYSPARK_PYTHON": sys.executable}, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    assert run.stdout.split()[-1] == str(catalog.queries()["j9_nearest_all"](spark, SMALL).count())


@pytest.mark.parametrize("select", ["all", "arbitrary"])
def test_k_nearest(spark, monkeypatch, select):
    monkeypatch.setattr(blocks, "FEWEST", 4)
    qs, ss = some(6, 60, 200, 12), some(7, 60, 200, 12)
    q, s = spark.createDataFrame(qs, TYPE), spark.createDataFrame(ss, TYPE)
    got = sorted(map(tuple, nearest.k_nearest(q, s, 2, select=select).collect()))
    hits = {a[0]: sorted(b[0] for b in ss if touching(a, b)) for a in qs}
    for a, found in hits.items():
        mine = [(r[1], r[3]) for r in got if r[0] == a and r[2] == 0]
        assert sorted(mine) == [(b, i + 1) for i, b in enumerate(found if select == "all" else found[:2])]
    assert {0, 1, 2} < {len(x) for x in hits.values()}
    assert got == sorted(map(tuple, nearest.k_nearest(q, s, 2, select=select, bins=64).collect()))
    assert unbroadcast(nearest.k_nearest(catalog.orders(spark, SMALL), catalog.parts(spark, SMALL), 3, select=select))
