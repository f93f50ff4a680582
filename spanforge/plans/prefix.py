"""Running sums and maxima along the coordinate, within groups.

A plain window puts a whole group into one task. With ``block`` set, or unset (None) for a table that the planner takes to
be larger than LARGE_BYTES, groups are cut into blocks of so many positions:
windows run within blocks, block totals are carried over by a window over one row per block, and joined back. So one
space of any size is dealt over all tasks; what meets in one task is a block's rows, or a group's blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Parts = dict[str, tuple[str, Column]]
#: From this estimated size on, and in blocks of so many positions, groups are cut unless told otherwise (0: never).
LARGE_BYTES, BLOCK = 4 << 30, 1 << 20


def block_for(df: DataFrame, block: int | None) -> int | None:
    """The block to use: as told, or by the planner's estimate of df's size, which reads no data."""
    if block is not None:
        return block or None
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return BLOCK if int(str(size)) > LARGE_BYTES else None


def _neutral(how: str) -> Column:
    return F.lit(0).cast("bigint") if how == "sum" else F.lit(None).cast("bigint")


def running(df: DataFrame, keys: list[str], position: str, order: list[str], parts: Parts, inclusive: bool = False, block: int | None = None) -> DataFrame:
    """df with a column per part: name: ("sum" or "max", value), over the rows of the group before each (and itself, if inclusive); sums start from 0, maxima from null."""
    last = 0 if inclusive else -1
    over = lambda how: F.sum if how == "sum" else F.max
    block = block_for(df, block)
    if block is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
        return df.withColumns({n: F.coalesce(over(how)(v).over(w), _neutral(how)) for n, (how, v) in parts.items()})
    cut = df.withColumn("_block", F.floor(F.col(position) / block))
    by_block = cut.groupBy(*keys, "_block").agg(*[over(how)(v).alias(f"_{n}") for n, (how, v) in parts.items()])
    carry = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = by_block.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_kb"), *[over(how)(f"_{n}").over(carry).alias(f"_c{n}") for n, (how, _) in parts.items()])
    same = F.col("_block") == F.col("_kb")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    w = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    joined = cut.join(carried, same)
    both = {}
    for n, (how, v) in parts.items():
        here, before = over(how)(v).over(w), F.col(f"_c{n}")
        both[n] = F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0)) if how == "sum" else F.greatest(here, before)
    return joined.withColumns(both).select(*df.columns, *parts)


def islands(df: DataFrame, keys: list[str], gap: int = 1, block: int | None = None) -> DataFrame:
    """df with ``_island``, the number within its group of the run of ranges that each belongs to: a range starts a new one if it
    starts more than ``gap`` positions after the largest end before it (1: overlapping and adjacent ranges run together)."""
    order = ["start", "end"]
    ahead = running(df, keys, "start", order, {"_reach": ("max", F.col("end").cast("bigint"))}, block=block)
    new = F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + gap), 1).otherwise(0)
    flagged = ahead.withColumn("_new", new.cast("bigint"))
    # rows alike in start and end must not be told apart: only the first of them can be new, and all get its number
    return running(flagged, keys, "start", [*order, F.col("_new").desc()], {"_island": ("sum", F.col("_new"))}, inclusive=True, block=block).drop("_reach", "_new")


def depth(events: DataFrame, keys: list[str], counters: list[str], block: int | None = None) -> DataFrame:
    """From events (keys, pos, counters: change at pos) runs of constant counters: keys, start, end (before the next event), counters.

    Changes at one position are summed first (combined before the shuffle) and positions where nothing changes are
    dropped, so runs are as long as can be. The run after a group's last event is left out.
    """
    summed = events.groupBy(*keys, "pos").agg(*[F.sum(x).alias(x) for x in counters])
    changed = summed.where(" OR ".join(f"`{x}` <> 0" for x in counters))
    sums = running(changed, keys, "pos", ["pos"], {f"_{x}": ("sum", F.col(x)) for x in counters}, inclusive=True, block=block)
    following = _next(sums, keys, block)
    return following.where(F.col("_next").isNotNull()).select(*keys, F.col("pos").alias("start"), (F.col("_next") - 1).alias("end"), *[F.col(f"_{x}").alias(x) for x in counters])


def _next(df: DataFrame, keys: list[str], block: int | None) -> DataFrame:
    """df with ``_next``: the following position of the group, null for the last."""
    block = block_for(df, block)
    if block is None:
        return df.withColumn("_next", F.lead("pos").over(Window.partitionBy(*keys).orderBy("pos")))
    cut = df.withColumn("_block", F.floor(F.col("pos") / block))
    first = cut.groupBy(*keys, "_block").agg(F.min("pos").alias("_first"))
    after = first.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_kb"), F.lead("_first").over(Window.partitionBy(*keys).orderBy("_block")).alias("_after"))
    same = F.col("_block") == F.col("_kb")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    here = F.lead("pos").over(Window.partitionBy(*keys, "_block").orderBy("pos"))
    return cut.join(after, same).withColumn("_next", F.coalesce(here, "_after")).select(*df.columns, "_next")
