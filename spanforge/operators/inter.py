"""Aggregates of ranges within groups: one per space and strand (* is a group of its own), and per list element if ``by`` names its column.

ignore_strand puts all strands into one group, *. Results have the group's columns, start, end and what is said; other columns go.
``block`` deals a group over tasks by blocks of so many positions (see plans.prefix); without it a group is one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import STRANDS, width
from ..plans.binning import interval_join
from ..plans.prefix import _next, block_for, depth, islands, running

By = tuple[str, ...]


def _keys(by: By) -> list[str]:
    return [*by, "seqnames", "strand"]


def _grouped(df: DataFrame, ignore_strand: bool) -> DataFrame:
    return df.withColumn("strand", F.lit("*")) if ignore_strand else df


def _revmap() -> Column:
    return F.sort_array(F.collect_list("idx")).alias("revmap")


def span(df: DataFrame, ignore_strand: bool = False, revmap: bool = False, by: By = ()) -> DataFrame:
    """The range from the least start to the largest end of each group."""
    return _grouped(df, ignore_strand).groupBy(*_keys(by)).agg(F.min("start").alias("start"), F.max("end").alias("end"), *([_revmap()] if revmap else []))


def merge_ranges(df: DataFrame, min_gap: int = 1, drop_empty: bool = False, ignore_strand: bool = False, revmap: bool = False, by: By = (), block: int | None = None) -> DataFrame:
    """Ranges less than min_gap positions apart run together (1: overlapping and adjacent ones; 0: overlapping ones). An empty
    range joins what it touches and else stays, unless drop_empty. revmap: the idx of the rows that went into each."""
    rows = _grouped(df, ignore_strand)
    if drop_empty:
        rows = rows.where(F.col("end") >= F.col("start"))
    keys = _keys(by)
    found = islands(rows, keys, min_gap, block).groupBy(*keys, "_island")
    return found.agg(F.min("start").alias("start"), F.max("end").alias("end"), *([_revmap()] if revmap else [])).drop("_island")


def gaps(df: DataFrame, seqinfo: DataFrame, start: int = 1, ignore_strand: bool = False, by: By = (), groups: DataFrame | None = None, block: int | None = None) -> DataFrame:
    """What no range of a group covers, from ``start`` to the space's length, for every space and all three strands also
    where there are no ranges (only * with ignore_strand). Without a known length nothing follows the last range. With ``by``,
    ``groups`` lists the elements (default: those that occur)."""
    keys = _keys(by)
    merged = merge_ranges(df, ignore_strand=ignore_strand, drop_empty=True, by=by, block=block)
    strands = ["*"] if ignore_strand else list(STRANDS)
    frame = seqinfo.select("seqnames", F.explode(F.array(*[F.lit(s) for s in strands])).alias("strand"), F.col("seqlength").alias("_n"))
    if by:
        elements = (df if groups is None else groups).select(*by).distinct()
        frame = elements.crossJoin(F.broadcast(frame))  # one row per element, space and strand: the result has them all
    inside = merged.where(F.col("end") >= start).select(*keys, "start", "end")
    lead = frame.select(*keys, F.lit(start - 1).alias("start"), F.lit(start - 1).alias("end"))
    tail = frame.where("_n IS NOT NULL").select(*keys, (F.col("_n") + 1).alias("start"), (F.col("_n") + 1).alias("end"))
    rows = inside.unionByName(lead).unionByName(tail)
    ahead = running(rows, keys, "start", ["start", "end"], {"_reach": ("max", F.col("end").cast("bigint"))}, block=block)
    out = ahead.where(F.col("_reach").isNotNull() & (F.col("start") > F.col("_reach") + 1))
    bounds = out.join(frame.select("seqnames", F.col("_n").alias("_most")).distinct(), "seqnames")
    clipped = bounds.withColumns({"end": F.least(F.col("start") - 1, F.col("_most")), "start": (F.col("_reach") + 1).cast("int")})
    return clipped.where(F.col("end") >= F.col("start")).select(*keys, "start", F.col("end").cast("int").alias("end"))


def disjoin(df: DataFrame, ignore_strand: bool = False, revmap: bool = False, by: By = (), block: int | None = None) -> DataFrame:
    """The pieces that all starts and ends cut the covered positions into; empty ranges cut, too, where something covers them. revmap: the idx of the rows that cover each piece."""
    keys = _keys(by)
    rows = _grouped(df, ignore_strand)
    events = rows.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("end") + 1).alias("pos"), F.lit(-1).alias("d")))).alias("e"))
    summed = events.groupBy(*keys, "e.pos").agg(F.sum("e.d").cast("bigint").alias("d"))
    sums = _next(running(summed, keys, "pos", ["pos"], {"n": ("sum", F.col("d"))}, inclusive=True, block=block), keys, block)
    pieces = sums.where((F.col("n") > 0) & F.col("_next").isNotNull()).select(*keys, F.col("pos").cast("int").alias("start"), (F.col("_next") - 1).cast("int").alias("end"))
    if not revmap:
        return pieces
    hits = interval_join(pieces, rows.where(F.col("end") >= F.col("start")), (F.col("s_start") <= F.col("q_start")) & (F.col("s_end") >= F.col("q_end")), on=tuple(keys))
    return hits.groupBy(*[F.col(f"q_{k}").alias(k) for k in (*keys, "start", "end")]).agg(F.sort_array(F.collect_list("s_idx")).alias("revmap"))


def is_disjoint(df: DataFrame, ignore_strand: bool = False, by: By = (), block: int | None = None) -> DataFrame:
    """One row (one per element with ``by``), is_disjoint: whether no two ranges of a group share a position."""
    rows = _grouped(df, ignore_strand).where(F.col("end") >= F.col("start"))
    ahead = running(rows, _keys(by), "start", ["start", "end"], {"_reach": ("max", F.col("end").cast("bigint"))}, block=block)
    clash = F.max((F.col("start") <= F.col("_reach")).cast("int"))
    return (ahead.groupBy(*by) if by else ahead).agg((F.coalesce(clash, F.lit(0)) == 0).alias("is_disjoint"))


def disjoint_bins(df: DataFrame, ignore_strand: bool = False, by: By = (), block: int | None = None) -> DataFrame:
    """df with ``bin``: rows in order of start and end get the lowest bin (1 ..) whose last range ends before them, so ranges of one bin are disjoint.

    Greedy colouring is sequential, but only within a run of ranges that overlap: runs are found in parallel and coloured apart.
    """
    import pandas as pd

    from pyspark.sql import types as T

    rows = _grouped(df, ignore_strand)
    keys = _keys(by)
    cut = islands(rows, keys, 0, block)
    need = [*keys, "_island", "idx", "start", "end"]

    def colour(part: pd.DataFrame) -> pd.DataFrame:
        import heapq

        part = part.sort_values(["start", "end", "idx"], kind="stable")
        busy: list[tuple[int, int]] = []  # (end, bin)
        free: list[int] = []
        out, used = [], 0
        for s, e in zip(part["start"].tolist(), part["end"].tolist(), strict=True):
            while busy and busy[0][0] < s:
                heapq.heappush(free, heapq.heappop(busy)[1])
            if free:
                b = heapq.heappop(free)
            else:
                used += 1
                b = used
            heapq.heappush(busy, (e, b))
            out.append(b)
        return pd.DataFrame({"idx": part["idx"], "bin": out})

    schema = T.StructType([df.schema["idx"], T.StructField("bin", T.IntegerType())])
    bins = cut.select(*need).groupBy(*keys, "_island").applyInPandas(colour, schema)
    return df.join(bins, "idx")


def coverage(df: DataFrame, seqinfo: DataFrame | None = None, shift: int | str | dict[str, int] = 0, width: int | dict[str, int] | None = None, weight: float | str | dict[str, float] = 1, by: By = (), block: int | None = None) -> DataFrame:
    """Weighted depth of each space, strands together, as the longest runs of one value on [1, L]: seqnames, start, end, value.

    L is the width given, else the space's length, else the largest end. shift and weight: a number, a column or one per space.
    Positions outside are cut off; on a circular space of known length they wrap around. Events are summed by position
    before the shuffle, so many ranges alike are no hot spot.
    """
    per = lambda x: F.expr("CASE seqnames " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in x.items()) + " END") if isinstance(x, dict) else F.col(x) if isinstance(x, str) else F.lit(x)
    keys = [*by, "seqnames"]
    block = block_for(df, block) or 0  # of the ranges: the planner takes their join with spaces for a product
    shifted = df.select(*keys, (F.col("start") + F.coalesce(per(shift), F.lit(0))).cast("bigint").alias("s"), (F.col("end") + F.coalesce(per(shift), F.lit(0))).cast("bigint").alias("e"), F.coalesce(per(weight), F.lit(1)).alias("w"))
    whole = shifted.schema["w"].dataType.typeName() in ("integer", "long", "short", "byte")
    shifted = shifted.withColumn("w", F.col("w").cast("bigint" if whole else "decimal(38,10)"))
    info = None if seqinfo is None else seqinfo.select("seqnames", F.col("seqlength").cast("bigint").alias("_n"), F.coalesce("is_circular", F.lit(False)).alias("_circular"))
    if info is not None:
        shifted = shifted.join(info, "seqnames", "left")
    else:
        shifted = shifted.withColumns({"_n": F.lit(None).cast("bigint"), "_circular": F.lit(False)})
    wraps = F.coalesce(F.col("_circular"), F.lit(False)) & F.col("_n").isNotNull()
    circles = F.when(wraps, F.sequence(F.floor((F.col("s") - 1) / F.col("_n")), F.floor((F.greatest("e", "s") - 1) / F.col("_n")))).otherwise(F.array(F.lit(0).cast("bigint")))
    placed = shifted.where(F.col("e") >= F.col("s")).withColumn("_k", F.explode(circles))
    off = F.when(wraps, F.col("_k") * F.col("_n")).otherwise(F.lit(0))
    placed = placed.select(*keys, (F.col("s") - off).alias("s"), (F.col("e") - off).alias("e"), "w")
    ends = placed.groupBy(*keys).agg(F.max("e").alias("_most"))
    limit = F.coalesce(per(width).cast("bigint") if width is not None else F.lit(None).cast("bigint"), F.col("_n"), F.col("_most"))
    if info is not None:
        spaces = info if not by else info.crossJoin(F.broadcast(df.select(*by).distinct()))
        limits = spaces.join(ends, keys, "full").select(*keys, limit.alias("_l"))
    else:
        limits = ends.withColumn("_n", F.lit(None).cast("bigint")).select(*keys, limit.alias("_l"))
    limits = limits.where("_l >= 1")
    inside = placed.join(limits, keys).select(*keys, F.greatest("s", F.lit(1)).alias("s"), F.least("e", "_l").alias("e"), "w").where("s <= e")
    change = lambda pos, value, frame: F.struct(pos.alias("pos"), value.alias("value"), F.lit(frame).alias("frame"))
    changes = inside.select(*keys, F.explode(F.array(change(F.col("s"), F.col("w"), 0), change(F.col("e") + 1, (-F.col("w")).cast(shifted.schema["w"].dataType), 0))).alias("c"))
    nothing = F.lit(0).cast(shifted.schema["w"].dataType)
    frame = limits.select(*keys, F.explode(F.array(change(F.lit(1).cast("bigint"), nothing, 1), change(F.col("_l") + 1, nothing, 1))).alias("c"))
    events = changes.unionByName(frame).select(*keys, "c.*").groupBy(*keys, "pos").agg(F.sum("value").alias("value"), F.max("frame").alias("frame")).where("value <> 0 OR frame = 1")
    sums = _next(running(events, keys, "pos", ["pos"], {"v": ("sum", F.col("value"))}, inclusive=True, block=block), keys, block)
    value = F.col("v") if whole else F.col("v").cast("double")
    return sums.where("_next IS NOT NULL").select(*keys, F.col("pos").cast("int").alias("start"), (F.col("_next") - 1).cast("int").alias("end"), value.alias("value"))


def local_indices(df: DataFrame, by: By = ("group",)) -> DataFrame:
    """df with idx numbered anew within each element (1 ..): a revmap made from it names places within the element."""
    return df.withColumn("idx", F.row_number().over(Window.partitionBy(*by).orderBy("idx")))


def peaks(cover: DataFrame, lower: float, block: int | None = None) -> DataFrame:
    """Maximal stretches of a coverage with values of at least ``lower``: seqnames, start, end, and area (sum of values) and top."""
    high = cover.where(F.col("value") >= lower)
    runs = islands(high, ["seqnames"], 1, block)
    return runs.groupBy("seqnames", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum(F.col("value") * width()).alias("area"), F.max("value").alias("top")).drop("_island")


def stitch(df: DataFrame, by: By = ()) -> DataFrame:
    """Rows that follow each other by idx and are exactly adjacent on one space and strand run together: seqnames, strand, start, end, idx of the first. The total width stays."""
    w = Window.partitionBy(*by).orderBy("idx")  # the order of all rows is what counts here
    before = lambda c: F.lag(c).over(w)
    joins = (before("seqnames") == F.col("seqnames")) & (before("strand") == F.col("strand")) & (before("end") + 1 == F.col("start"))
    flagged = df.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    runs = flagged.withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy(*by, "_run").agg(F.min("idx").alias("idx"), F.first("seqnames").alias("seqnames"), F.first("strand").alias("strand"), F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def table_of(df: DataFrame, by: By = ()) -> DataFrame:
    """How often each range occurs: n."""
    return df.groupBy(*_keys(by), "start", "end").agg(F.count(F.lit(1)).alias("n"))


def phi_coefficient(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row, phi: the association of two boolean columns, (ad - bc) over the root of the product of the margins; rows with a null are left out."""
    n = lambda p, q: F.sum(F.when((F.col(x) == p) & (F.col(y) == q), 1).otherwise(0)).cast("double")
    counts = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(n(True, True).alias("a"), n(True, False).alias("b"), n(False, True).alias("c"), n(False, False).alias("d"))
    return counts.select(phi_of(*[F.col(k) for k in "abcd"]).alias("phi"))


def phi_of(a: Column, b: Column, c: Column, d: Column) -> Column:
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    return F.when(margins > 0, (a * d - b * c) / F.sqrt(margins))
