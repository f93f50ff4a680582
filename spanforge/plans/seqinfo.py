"""The table of spaces: seqid (order), seqnames, seqlength, is_circular, genome; unknown values null.

It has one row per space and is small beside any table of ranges, but operators join it without a hint, so that Spark broadcasts it only if it is.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "seqid int, seqnames string, seqlength int, is_circular boolean, genome string"


def seqinfo(spark: SparkSession, names: Iterable[str], lengths: Iterable[int | None] | None = None, circular: Iterable[bool | None] | None = None, genome: str | None = None) -> DataFrame:
    names = list(names)
    lengths = [None] * len(names) if lengths is None else list(lengths)
    circular = [None] * len(names) if circular is None else list(circular)
    if not len(names) == len(lengths) == len(circular) or len(set(names)) != len(names):
        raise ValueError("names must be unique, with one length and one circularity each")
    rows = [(i, n, x, r, genome) for i, (n, x, r) in enumerate(zip(names, lengths, circular, strict=True), 1)]
    return spark.createDataFrame(rows, SCHEMA)


def natural_key(name):
    """Order of space names: the prefix before digits, then numbers by value, then the rest (chr2 before chr10 before chrX)."""
    head = F.regexp_extract(name, r"^(\D*)", 1)
    number = F.regexp_extract(name, r"^\D*(\d+)", 1)
    return [head, F.when(number == "", 1).otherwise(0), F.when(number != "", number).cast("decimal(38,0)"), name]


def seqinfo_of(ranges: DataFrame) -> DataFrame:
    """Spaces that occur, in natural order, with unknown lengths."""
    from pyspark.sql import Window

    names = ranges.select("seqnames").distinct()
    order = Window.orderBy(*natural_key(F.col("seqnames")))  # one row per space
    return names.select(F.row_number().over(order).alias("seqid"), "seqnames", F.lit(None).cast("int").alias("seqlength"), F.lit(None).cast("boolean").alias("is_circular"), F.lit(None).cast("string").alias("genome"))


def merge_seqinfo(a: DataFrame, b: DataFrame) -> DataFrame:
    """All spaces of both, those of a first; unknown values are filled from the other; conflicting ones are an error when read."""
    from pyspark.sql import Window

    x, y = (t.select("seqnames", *[F.col(k).alias(f"{p}_{k}") for k in ("seqid", "seqlength", "is_circular", "genome")]) for t, p in ((a, "x"), (b, "y")))
    both = x.join(y, "seqnames", "full")

    def one(k):
        clash = F.col(f"x_{k}") != F.col(f"y_{k}")
        return F.when(F.coalesce(clash, F.lit(False)), F.raise_error(F.concat(F.lit(f"conflicting {k} of "), F.col("seqnames")))).otherwise(F.coalesce(f"x_{k}", f"y_{k}")).alias(k)

    order = Window.orderBy(F.col("x_seqid").isNull(), "x_seqid", "y_seqid")
    return both.select(F.row_number().over(order).alias("seqid"), "seqnames", one("seqlength"), one("is_circular"), one("genome"))


def in_order(ranges: DataFrame, info: DataFrame, *more: str) -> DataFrame:
    """ranges in natural order: space, strand, start, width, then ``more``."""
    from ..functions.ranges import strand_id, width

    ids = info.select("seqnames", F.col("seqid").alias("_seqid"))
    return ranges.join(ids, "seqnames").orderBy("_seqid", strand_id(F.col("strand")), "start", width(), *more).select(*ranges.columns)
