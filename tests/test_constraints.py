from pyspark.sql import functions as F

from spanforge.plans import constraints
from spanforge.sources.ingest import ranges


def test_first_failure_is_reported(spark):
    x = ranges(spark, "A", [1, 5], width=[1, 1], strand=["+", "*"])
    of = lambda df, name: constraints.violations(df, name).first()[0]
    assert of(x, "ranges") is None and of(x, "stranded") == "stranded" and of(x, "positions") is None
    assert of(x.withColumn("end", F.col("start") - 2), "stranded") == "ranges"
    constraints.define("scored", ["score"], lambda: F.col("score") >= 0, refines="stranded")
    assert constraints.chain("scored") == ["ranges", "stranded", "scored"]
    assert of(x.where("idx = 1"), "scored") == "scored"
    assert of(x.where("idx = 1").withColumn("score", F.lit(1)), "scored") is None
