"""Comparison, order, rank and duplicates. Strands are compared strictly here: * equals only *."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranges as R
from .overlaps import side_by_side

COORDS = ["seqnames", "strand", "start", "end"]


def _keyed(df: DataFrame, ignore_strand: bool) -> DataFrame:
    return df.withColumn("_strand", F.lit("*") if ignore_strand else F.col("strand"))


def _with_order(df: DataFrame, seqinfo: DataFrame, ignore_strand: bool) -> tuple[DataFrame, list[Column]]:
    ids = seqinfo.select("seqnames", F.col("seqid").alias("_seqid"))
    strand = F.lit(0) if ignore_strand else R.strand_id(F.col("strand"))
    return df.join(ids, "seqnames"), [F.col("_seqid"), strand, F.col("start"), R.width()]


def compare_rows(x: DataFrame, y: DataFrame, seqinfo: DataFrame) -> DataFrame:
    """Rows with equal idx: idx and code, the range code of -6 to 6 on one space and strand, else 13 times the sign of the strands' order, or 39 times that of the spaces', added."""
    ids = lambda p: seqinfo.select(F.col("seqnames").alias(f"{p}seqnames"), F.col("seqid").alias(f"{p}seqid"))
    pairs = side_by_side(x, y).join(ids("q_"), "q_seqnames").join(ids("s_"), "s_seqnames")
    sign = lambda a, b: F.signum((a - b).cast("double")).cast("int")
    strand = sign(R.strand_id(F.col("q_strand")), R.strand_id(F.col("s_strand")))
    return pairs.select(F.col("q_idx").alias("idx"), (R.compare_code("q_", "s_") + (strand + sign(F.col("q_seqid"), F.col("s_seqid")) * 3) * 13).alias("code"))


def relation(x: DataFrame, y: DataFrame, op: str, seqinfo: DataFrame) -> DataFrame:
    """Rows with equal idx: idx and holds, for ==, !=, <, <=, > or >= in natural order (space, strand, start, width)."""
    ids = lambda p: seqinfo.select(F.col("seqnames").alias(f"{p}seqnames"), F.col("seqid").alias(f"{p}seqid"))
    pairs = side_by_side(x, y).join(ids("q_"), "q_seqnames").join(ids("s_"), "s_seqnames")
    key = lambda p: F.struct(F.col(f"{p}seqid").alias("a"), R.strand_id(F.col(f"{p}strand")).alias("b"), F.col(f"{p}start").cast("bigint").alias("c"), F.col(f"{p}end").cast("bigint").alias("d"))
    a, b = key("q_"), key("s_")
    test = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    return pairs.select(F.col("q_idx").alias("idx"), test.alias("holds"))


def duplicated(df: DataFrame, from_last: bool = False) -> DataFrame:
    """df with ``duplicated``: whether a row of lower idx (higher, if from_last) has the same range."""
    order = F.col("idx").desc() if from_last else F.col("idx")
    return df.withColumn("duplicated", F.row_number().over(Window.partitionBy(*COORDS).orderBy(order)) > 1)


def unique_ranges(df: DataFrame, from_last: bool = False) -> DataFrame:
    """One row of each range: that of the lowest (highest) idx."""
    pick = F.max if from_last else F.min
    keep = df.groupBy(*COORDS).agg(pick("idx").alias("idx")).select("idx")
    return df.join(keep, "idx", "left_semi")


def self_match(df: DataFrame, ignore_strand: bool = False) -> DataFrame:
    """idx and match_idx, the lowest idx of a row with the same range."""
    first = F.min("idx").over(Window.partitionBy("seqnames", "_strand", "start", "end"))
    return _keyed(df, ignore_strand).select("idx", first.alias("match_idx"))


def match(x: DataFrame, table: DataFrame, ignore_strand: bool = False) -> DataFrame:
    """idx of each row of x and match_idx, the lowest idx of an equal range of table; null if there is none."""
    firsts = _keyed(table, ignore_strand).groupBy("seqnames", "_strand", "start", "end").agg(F.min("idx").alias("match_idx"))
    return _keyed(x, ignore_strand).join(firsts, ["seqnames", "_strand", "start", "end"], "left").select("idx", "match_idx")


def is_in(x: DataFrame, table: DataFrame, ignore_strand: bool = False) -> DataFrame:
    """Rows of x with an equal range in table."""
    keys = ["seqnames", "_strand", "start", "end"]
    return _keyed(x, ignore_strand).join(_keyed(table, ignore_strand).select(*keys), keys, "left_semi").select(*x.columns)


def merge_tables(x: DataFrame, y: DataFrame, how: str = "inner") -> DataFrame:
    """Equal ranges of x and y side by side: coordinates and the other columns of both (those of both with _x and _y)."""
    other = lambda df, o, mark: [F.col(c).alias(c + mark if c in o.columns else c) for c in df.columns if c not in COORDS]
    a = x.select(*COORDS, *other(x, y, "_x"))
    b = y.select(*COORDS, *other(y, x, "_y"))
    return a.join(b, COORDS, how)


def is_unsorted(df: DataFrame, seqinfo: DataFrame, strictly: bool = False, ignore_strand: bool = False) -> DataFrame:
    """One row, is_unsorted: whether rows in order of idx are out of natural order (or, strictly, not rising).

    The order of all rows is what is asked for: rows are dealt by ranges of idx, compared within a range and, by its first
    and last row, between ranges.
    """
    keyed, order = _with_order(df, seqinfo, ignore_strand)
    key = F.struct(*[o.cast("bigint").alias(f"k{i}") for i, o in enumerate(order)])
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed.select("idx", key.alias("key")).repartitionByRange(n, "idx").withColumn("part", F.spark_partition_id())
    wrong = (lambda a, b: a >= b) if strictly else (lambda a, b: a > b)
    within = rows.withColumn("_before", F.lag("key").over(Window.partitionBy("part").orderBy("idx")))
    parts = within.groupBy("part").agg(F.max(F.coalesce(wrong(F.col("_before"), F.col("key")), F.lit(False)).cast("int")).alias("bad"), F.min(F.struct("idx", "key")).alias("first"), F.max(F.struct("idx", "key")).alias("last"))
    ahead = F.lag("last").over(Window.orderBy("part"))  # one row per part
    return parts.withColumn("_last", ahead).agg((F.coalesce(F.max(F.greatest(F.col("bad"), F.coalesce(wrong(F.col("_last.key"), F.col("first.key")), F.lit(False)).cast("int"))), F.lit(0)) == 1).alias("is_unsorted"))


def sort_ranges(df: DataFrame, seqinfo: DataFrame, decreasing: bool = False, ignore_strand: bool = False, by: list[Column] | None = None) -> DataFrame:
    """df in natural order, or by the columns given; ties stay in order of idx, also when decreasing."""
    keyed, order = _with_order(df, seqinfo, ignore_strand)
    order = by or order
    return keyed.orderBy(*[o.desc() if decreasing else o for o in order], "idx").select(*df.columns)


def order_of(df: DataFrame, seqinfo: DataFrame, decreasing: bool = False, ignore_strand: bool = False) -> DataFrame:
    """idx and place (1 ..) in natural order. Places are numbered within spaces and strands and carried over their counts."""
    return _placed(df, seqinfo, decreasing, ignore_strand).select("idx", F.col("place"))


def _placed(df: DataFrame, seqinfo: DataFrame, decreasing: bool, ignore_strand: bool) -> DataFrame:
    keyed, order = _with_order(df, seqinfo, ignore_strand)
    keyed = keyed.withColumns({"_s": order[1], "_w": order[3]})
    turn = (lambda c: F.col(c).desc()) if decreasing else F.col
    counts = keyed.groupBy("_seqid", "_s").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.orderBy(turn("_seqid"), turn("_s")).rowsBetween(Window.unboundedPreceding, -1))  # one row per space and strand
    counts = counts.select("_seqid", "_s", F.coalesce(before, F.lit(0)).alias("_before"))
    w = Window.partitionBy("_seqid", "_s").orderBy(turn("start"), turn("_w"), "idx")
    ties = Window.partitionBy("_seqid", "_s").orderBy(turn("start"), turn("_w"))
    same = Window.partitionBy("_seqid", "_s", "start", "_w")
    out = keyed.join(counts, ["_seqid", "_s"])
    return out.withColumns({"place": F.col("_before") + F.row_number().over(w), "_rank": F.col("_before") + F.rank().over(ties), "_same": F.count(F.lit(1)).over(same)})


def rank_of(df: DataFrame, seqinfo: DataFrame, ties: str = "average", ignore_strand: bool = False, seed: int = 1) -> DataFrame:
    """idx and rank in natural order; ties get the average, first (by idx), last, random, max or min of their places."""
    placed = _placed(df, seqinfo, False, ignore_strand)
    last = F.col("_rank") + F.col("_same") - 1
    of_ties = F.col("place") - F.col("_rank")
    if ties == "random":
        w = Window.partitionBy("_rank").orderBy(F.xxhash64(F.lit(seed), "idx"), "idx")
        return placed.select("idx", (F.col("_rank") + F.row_number().over(w) - 1).alias("rank"))
    rank = {"average": (F.col("_rank") + last) / 2, "first": F.col("place"), "last": last - of_ties, "max": last, "min": F.col("_rank")}[ties]
    return placed.select("idx", rank.alias("rank"))


def head(df: DataFrame, n: int) -> DataFrame:
    """The n rows of lowest idx."""
    return df.orderBy("idx").limit(n)


def tail(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.col("idx").desc()).limit(n)
