"""Tiles of spaces, and variables along them as runs: (seqnames, start, end, value), disjoint."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import width
from ..plans.binning import interval_join


def tile_axis(seqinfo: DataFrame, n: int | None = None, tile_width: int | None = None) -> DataFrame:
    """All spaces end to end, cut into n tiles of near-equal size (tile k ends at ceil(total k / n)), or into as many as width
    tile_width allows: tile (1 ..), seqnames, start, end; a tile across spaces has a row for each."""
    if (n is None) == (tile_width is None):
        raise ValueError("give n or tile_width")
    one = Window.orderBy("seqid").rowsBetween(Window.unboundedPreceding, -1)  # one row per space
    size = F.col("seqlength").cast("bigint")
    spaces = seqinfo.select("seqid", "seqnames", size.alias("size"), F.coalesce(F.sum(size).over(one), F.lit(0)).alias("offset"), F.sum(size).over(Window.partitionBy()).alias("total"))
    count = F.lit(n).cast("bigint") if n is not None else F.ceil(F.col("total") / tile_width)
    spaces = spaces.withColumn("n", count)
    # tile k holds positions floor-exactly from ceil(total (k - 1) / n) + 1 to ceil(total k / n)
    end = lambda k: F.floor((F.col("total") * k + F.col("n") - 1) / F.col("n"))
    first = F.floor(F.col("offset") * F.col("n") / F.col("total")) + 1
    last = F.ceil((F.col("offset") + F.col("size")) * F.col("n") / F.col("total"))
    cut = spaces.where("size > 0").withColumn("tile", F.explode(F.sequence(F.greatest(first - 1, F.lit(1).cast("bigint")), F.least(last + 1, F.col("n")))))
    lo = F.greatest(end(F.col("tile") - 1), F.col("offset")) - F.col("offset") + 1
    hi = F.least(end(F.col("tile")), F.col("offset") + F.col("size")) - F.col("offset")
    return cut.select("tile", "seqnames", lo.cast("int").alias("start"), hi.cast("int").alias("end")).where("start <= end")


def tile_spaces(seqinfo: DataFrame, tile_width: int) -> DataFrame:
    """Each space cut into tiles of tile_width, its last one cut off: seqnames, start, end."""
    starts = F.sequence(F.lit(1), F.col("seqlength"), F.lit(tile_width))
    cut = seqinfo.where("seqlength >= 1").select("seqnames", "seqlength", F.explode(starts).alias("start"))
    return cut.select("seqnames", "start", F.least(F.col("start") + tile_width - 1, F.col("seqlength")).alias("end"))


def bind_variables(variables: dict[str, DataFrame]) -> DataFrame:
    """Several variables on common pieces: seqnames, start, end and a column for each, null where it has no run; pieces without any value go.

    Runs' ends cut; at each piece the last run of a variable that began counts, if it reaches so far.
    """
    runs = [
        v.where("value IS NOT NULL").select("seqnames", F.col("start").cast("bigint").alias("s"), F.col("end").cast("bigint").alias("e"), *[F.when(F.lit(k == name), F.struct(F.col("end").cast("bigint").alias("end"), F.col("value"))).otherwise(F.lit(None)).alias(k) if k == name else F.lit(None).cast(_run_type(variables[k])).alias(k) for k in variables])
        for name, v in variables.items()
    ]
    every = reduce(DataFrame.unionByName, runs)
    starts = every.select("seqnames", F.col("s").alias("pos"), *variables)
    stops = every.select("seqnames", (F.col("e") + 1).alias("pos"), *[F.lit(None).cast(_run_type(variables[k])).alias(k) for k in variables])
    points = starts.unionByName(stops).groupBy("seqnames", "pos").agg(*[F.max(k).alias(k) for k in variables])
    w = Window.partitionBy("seqnames").orderBy("pos")
    carried = points.select("seqnames", "pos", F.lead("pos").over(w).alias("next"), *[F.last(k, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(k) for k in variables])
    value = {k: F.when(F.col(f"{k}.end") >= F.col("pos"), F.col(f"{k}.value")) for k in variables}
    pieces = carried.where("next IS NOT NULL").select("seqnames", F.col("pos").cast("int").alias("start"), (F.col("next") - 1).cast("int").alias("end"), *[v.alias(k) for k, v in value.items()])
    return pieces.where(reduce(lambda a, b: a | b, [F.col(k).isNotNull() for k in variables]))


def _run_type(v: DataFrame) -> str:
    return f"struct<end:bigint,value:{v.schema['value'].dataType.simpleString()}>"


def column_as_runs(ranges: DataFrame, name: str, seqinfo: DataFrame | None = None) -> DataFrame:
    """A column of disjoint ranges (strand apart) as runs over each space, null in the gaps, equal neighbours joined; up to the space's length, else
    the largest end. An error if ranges overlap."""
    w = Window.partitionBy("seqnames").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = ranges.where("end >= start").select("seqnames", "start", "end", F.col(name).alias("value")).withColumn("_reach", reach)
    checked = F.when(F.coalesce(F.col("_reach") >= F.col("start"), F.lit(False)), F.raise_error(F.lit("column_as_runs: ranges overlap")).cast("int")).otherwise(F.col("start"))
    rows = rows.withColumn("start", checked)
    gap = rows.where(F.col("start") > F.coalesce("_reach", F.lit(0)) + 1).select("seqnames", (F.coalesce("_reach", F.lit(0)) + 1).alias("start"), (F.col("start") - 1).alias("end"), F.lit(None).alias("value"))
    pieces = rows.select("seqnames", "start", "end", "value").union(gap)
    if seqinfo is not None:
        ends = rows.groupBy("seqnames").agg(F.max("end").alias("_e"))
        tail = seqinfo.where("seqlength IS NOT NULL").join(ends, "seqnames", "left").where(F.coalesce("_e", F.lit(0)) < F.col("seqlength"))
        pieces = pieces.union(tail.select("seqnames", (F.coalesce("_e", F.lit(0)) + 1).alias("start"), F.col("seqlength").alias("end"), F.lit(None).alias("value")))
    new = F.when(F.lag("value").over(w).eqNullSafe(F.col("value")) & F.lag("start").over(w).isNotNull(), 0).otherwise(1)
    runs = pieces.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy("seqnames", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("value").alias("value")).drop("_run")


def binned_average(bins: DataFrame, variable: DataFrame, name: str = "average", na_rm: bool = False, bin_size: int | None = None) -> DataFrame:
    """bins (with idx) and the mean of the variable over each: positions without a run count as 0; nulls make it null, or with na_rm are left out; NaN
    for an empty bin or one with nothing left."""
    hits = interval_join(bins.select("idx", "seqnames", "start", "end"), variable.select("seqnames", "start", "end", "value"), (F.col("s_start") <= F.col("q_end")) & (F.col("s_end") >= F.col("q_start")), bins=bin_size)
    ov = F.least("q_end", "s_end") - F.greatest("q_start", "s_start") + 1
    sums = hits.groupBy(F.col("q_idx").alias("idx")).agg(F.sum(F.col("s_value").cast("double") * ov).alias("_sum"), F.sum(F.when(F.col("s_value").isNull(), ov).otherwise(0)).alias("_null"))
    joined = bins.join(sums, "idx", "left")
    nulls = F.coalesce("_null", F.lit(0))
    total = F.coalesce("_sum", F.lit(0.0))
    n = width() - nulls if na_rm else width()
    mean = F.when(n <= 0, F.lit(float("nan"))).otherwise(total / F.when(n > 0, n))
    if not na_rm:
        mean = F.when(nulls > 0, F.lit(None)).otherwise(mean)
    return joined.select(*bins.columns, mean.alias(name))


def views(ranges: DataFrame, variable: DataFrame, bin_size: int | None = None) -> DataFrame:
    """The runs of a variable within each range (idx): view_idx, seqnames, start, end, value."""
    hits = interval_join(ranges.select("idx", "seqnames", "start", "end"), variable, (F.col("s_start") <= F.col("q_end")) & (F.col("s_end") >= F.col("q_start")), bins=bin_size)
    return hits.select(F.col("q_idx").alias("view_idx"), F.col("q_seqnames").alias("seqnames"), F.greatest("q_start", "s_start").alias("start"), F.least("q_end", "s_end").alias("end"), F.col("s_value").alias("value"))
