"""Coverage of a stream of ranges.

Depth changes at starts and ends add up whatever the order and the batches, so a stream only has to record them; islands
and gaps are not append-only and are taken from the recorded changes when asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..plans.prefix import depth


def changes(ranges: DataFrame) -> DataFrame:
    """seqnames, pos and value: by how much the depth changes there. ``weight``, if there is such a column, counts."""
    w = F.col("weight") if "weight" in ranges.columns else F.lit(1)
    ends = F.array(F.struct(F.col("start").alias("pos"), w.alias("value")), F.struct((F.col("end") + 1).alias("pos"), (-w).alias("value")))
    return ranges.where("end >= start").select("seqnames", F.explode(ends).alias("e")).select("seqnames", "e.pos", "e.value")


def record(stream: DataFrame, path: str) -> DataStreamWriter:
    """A writer that puts each batch's changes, summed by position, under path. A batch that is run again replaces its own."""

    def put(batch: DataFrame, batch_id: int) -> None:
        summed = changes(batch).groupBy("seqnames", "pos").agg(F.sum("value").alias("value"))
        summed.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(put)


def current(spark: SparkSession, path: str, block: int | None = None) -> DataFrame:
    """The coverage so far: seqnames, start, end, value, from the first to the last position covered."""
    recorded = spark.read.option("basePath", path).parquet(f"{path}/batch=*").select("seqnames", "pos", "value")
    return depth(recorded, ["seqnames"], ["value"], block)


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Sum the recorded changes of all batches into a fresh folder, for a stream that goes on there."""
    spark.read.option("basePath", path).parquet(f"{path}/batch=*").groupBy("seqnames", "pos").agg(F.sum("value").alias("value")).where("value <> 0").write.parquet(f"{to}/batch=0")
