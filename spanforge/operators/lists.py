"""Lists of ranges: flat tables with a ``group`` column, beside a table of the groups that also holds those without ranges.

Row-wise operators work on them as they are; aggregates and set operations take by=("group",).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.seqinfo import natural_key


def concat(*tables: DataFrame) -> DataFrame:
    """Rows of all tables; attributes that one lacks are null there. idx is numbered anew in order of tables, then idx."""
    out = None
    for k, t in enumerate(tables):
        t = t.withColumn("_part", F.lit(k))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    counts = out.groupBy("_part").agg(F.max("idx").alias("_most"))  # one row per table
    before = F.coalesce(F.sum("_most").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_offset"))
    return out.join(F.broadcast(offsets), "_part").withColumn("idx", F.col("idx") + F.col("_offset")).drop("_part", "_offset")


def list_of(*tables: DataFrame, names: list[str] | None = None) -> DataFrame:
    """A list of one element per table: group (1 ..), group_name, and the tables' columns."""
    out = None
    for k, t in enumerate(tables):
        t = t.select(F.lit(k + 1).cast("bigint").alias("group"), F.lit(names[k] if names else None).cast("string").alias("group_name"), *t.columns)
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def split_by(ranges: DataFrame, column: str) -> DataFrame:
    """ranges as a list: group numbers the values of a column in natural order, group_name holds them. One row per value is ordered, not the table."""
    names = ranges.select(F.col(column).cast("string").alias("group_name")).distinct().where("group_name IS NOT NULL")
    numbered = names.select("group_name", F.row_number().over(Window.orderBy(*natural_key(F.col("group_name")))).cast("bigint").alias("group"))
    return ranges.withColumn("group_name", F.col(column).cast("string")).join(numbered, "group_name").select("group", "group_name", *ranges.columns)


def unlist(ranges: DataFrame) -> DataFrame:
    return ranges.drop("group", "group_name")


def relist(ranges: DataFrame, skeleton: DataFrame) -> DataFrame:
    """ranges with the groups of skeleton, by idx."""
    return skeleton.select("idx", "group", "group_name").join(ranges, "idx")


def element_sizes(ranges: DataFrame, groups: DataFrame) -> DataFrame:
    """group and n, 0 for empty elements."""
    counts = ranges.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    return groups.select("group").join(counts, "group", "left").select("group", F.coalesce("n", F.lit(0)).alias("n"))


def subset_elements(ranges: DataFrame, test: Column) -> DataFrame:
    """Ranges of the groups that pass a test of group or group_name."""
    return ranges.where(test)


def nested(ranges: DataFrame, *attributes: str) -> DataFrame:
    """One row per element: group and ranges, an array of structs in order of idx (for the edge of an API; operators use the flat form)."""
    fields = ["idx", "seqnames", "start", "end", "strand", *attributes]
    return ranges.groupBy("group").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("ranges"))


def flat(elements: DataFrame) -> DataFrame:
    """The inverse of ``nested``."""
    return elements.select("group", F.explode("ranges").alias("r")).select("group", "r.*")


def per_space(ranges: DataFrame) -> DataFrame:
    """One row per space: seqnames and ranges, an array of (start, end, strand) in order of idx."""
    part = F.transform(F.sort_array(F.collect_list(F.struct("idx", "start", "end", "strand"))), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["strand"].alias("strand")))
    return ranges.groupBy("seqnames").agg(part.alias("ranges"))


def keep_spaces(ranges: DataFrame, seqinfo: DataFrame, pruning: str = "error") -> DataFrame:
    """Ranges on the spaces of seqinfo. error: fails if there are others; coarse: groups with one go (rows, in a flat table); fine and
    tidy: rows on others go (see ``keep_groups`` for what becomes of the groups)."""
    known = seqinfo.select("seqnames")
    if pruning == "error":
        marked = ranges.join(known.withColumn("_known", F.lit(True)), "seqnames", "left")
        checked = F.when(F.col("_known"), F.col("seqnames")).otherwise(F.raise_error(F.concat(F.lit("space in use: "), F.col("seqnames"))))
        return marked.withColumn("seqnames", checked).select(*ranges.columns)
    if pruning == "coarse" and "group" in ranges.columns:
        bad = ranges.join(known, "seqnames", "left_anti").select("group").distinct()
        return ranges.join(bad, "group", "left_anti")
    if pruning not in ("coarse", "fine", "tidy"):
        raise ValueError(f"unknown pruning: {pruning}")
    return ranges.join(known, "seqnames", "left_semi")


def keep_groups(groups: DataFrame, ranges: DataFrame, seqinfo: DataFrame, pruning: str) -> DataFrame:
    """The groups that stay: coarse drops those with a range on another space, tidy those that became empty; fine keeps all, and groups that were empty stay."""
    outside = ranges.join(seqinfo.select("seqnames"), "seqnames", "left_anti").select("group").distinct()
    if pruning == "coarse":
        return groups.join(outside, "group", "left_anti")
    if pruning == "tidy":
        left = ranges.join(seqinfo.select("seqnames"), "seqnames", "left_semi").select("group").distinct()
        return groups.join(outside.join(left, "group", "left_anti"), "group", "left_anti")
    return groups


def factor_of(ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dictionary encoding: levels (level, seqnames, start, end, strand; numbered by first idx) and rows (idx, level)."""
    coords = ["seqnames", "start", "end", "strand"]
    firsts = ranges.groupBy(*coords).agg(F.min("idx").alias("level"))
    return firsts.select("level", *coords), ranges.join(firsts, coords).select("idx", "level")


def unfactor(levels: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.join(levels, "level").drop("level")


def order_within(ranges: DataFrame, seqinfo: DataFrame, decreasing: bool = False) -> DataFrame:
    """group, idx and place (1 ..) of each range in natural order within its element; ties in order of idx."""
    from ..functions.ranges import strand_id, width

    turn = (lambda c: c.desc()) if decreasing else (lambda c: c)
    order = [turn(F.col("_seqid")), turn(strand_id(F.col("strand"))), turn(F.col("start")), turn(width()), F.col("idx")]
    keyed = ranges.join(seqinfo.select("seqnames", F.col("seqid").alias("_seqid")), "seqnames")
    return keyed.select("group", "idx", F.row_number().over(Window.partitionBy("group").orderBy(*order)).alias("place"))
