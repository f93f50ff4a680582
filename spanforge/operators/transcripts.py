"""Widths of transcripts (groups of exons, in order of rank) and places within them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import width


def transcript_widths(exons: DataFrame) -> DataFrame:
    """group and width, the sum of its exons' widths; an error if one is negative."""
    checked = F.when(width() >= 0, width()).otherwise(F.raise_error(F.lit("negative exon width")))
    return exons.groupBy("group").agg(F.sum(checked).alias("width"))


def to_reference(places: DataFrame, exons: DataFrame, decreasing_on_minus: bool = False) -> DataFrame:
    """Where places within transcripts lie: places (any columns, with group and tloc, from 1) with ref_pos, null beyond the transcript.

    Exons follow each other in order of idx, as stored; on - backwards if decreasing_on_minus, and are then read from their ends.
    """
    minus = F.col("strand") == "-"
    order = F.when(minus & F.lit(decreasing_on_minus), -F.col("idx")).otherwise(F.col("idx"))
    before = F.coalesce(F.sum(width()).over(Window.partitionBy("group").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = exons.withColumn("_o", order).withColumn("_before", before)
    laid = laid.select(F.col("group").alias("_g"), F.col("start").alias("_s"), F.col("end").alias("_e"), minus.alias("_minus"), "_before")
    at = F.col("tloc") - F.col("_before")
    held = (F.col("group") == F.col("_g")) & (at >= 1) & (at <= F.col("_e") - F.col("_s") + 1)
    joined = places.join(laid, held, "left")
    return joined.withColumn("ref_pos", F.when(F.col("_minus"), F.col("_e") - at + 1).otherwise(F.col("_s") + at - 1)).select(*places.columns, "ref_pos")
