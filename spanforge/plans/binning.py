"""Interval joins as equi-joins on bins of the coordinate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranges import width

#: Bins a row may be put into, so that few very long ranges do not blow up the table; longer rows use a coarser level.
MOST_BINS = 64


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(f"`{x}`").alias(prefix + x) for x in df.columns])


def bin_width(*sides: DataFrame) -> int:
    """Twice the larger 90th percentile of the sides' widths, from one aggregate. It only sets how fast a join is; give ``bins`` to spare the scan."""
    tagged = reduce(DataFrame.union, [s.select(F.lit(k).alias("k"), width().alias("w")) for k, s in enumerate(sides)])
    found = [r[1] for r in tagged.groupBy("k").agg(F.percentile_approx("w", 0.9, 1000)).collect()]
    return max(16, 2 * max(found, default=0))


def interval_join(query: DataFrame, subject: DataFrame, test: Column, pad: int = 0, on: tuple[str, ...] = ("seqnames",), bins: int | None = None) -> DataFrame:
    """Pairs of rows, columns prefixed q_ and s_, that agree in ``on``, lie at most ``pad`` positions apart and pass ``test``.

    Each side is put into the bins it reaches (the query widened by pad), bins are joined, and a pair is kept only in the
    first bin both reach: no pair comes twice and no distinct is needed. Ranges of more than MOST_BINS bins use coarser
    ones: two narrow rows meet at level 0, a wide query meets all subjects at level 1, a narrow query meets wide subjects
    at level 2.
    """
    bins = bins or bin_width(query, subject)
    coarse = bins * MOST_BINS
    q, s = prefixed(query, "q_"), prefixed(subject, "s_")
    lo_q, hi_q, lo_s, hi_s = F.col("q_start") - pad, F.col("q_end") + pad, F.col("s_start"), F.col("s_end")

    def cells(lo: Column, hi: Column, step: int, *levels: int) -> Column:
        found = F.sequence(F.floor(lo / step), F.floor(hi / step))
        on = lambda n: F.transform(found, lambda b: F.struct(F.lit(n).alias("level"), b.alias("bin")))
        return F.concat(*[on(n) for n in levels])

    def placed(lo: Column, hi: Column, narrow: int, wide: tuple[int, ...]) -> Column:
        one = F.concat(cells(lo, hi, bins, 0), cells(lo, hi, coarse, narrow))
        return F.explode(F.when(hi - lo + 1 > coarse, cells(lo, hi, coarse, *wide)).otherwise(one))

    q = q.withColumn("_q", placed(lo_q, hi_q, 2, (1,)))
    s = s.withColumn("_s", placed(lo_s, hi_s, 1, (1, 2)))
    same = (F.col("_q.level") == F.col("_s.level")) & (F.col("_q.bin") == F.col("_s.bin"))
    for k in on:
        same &= F.col(f"q_{k}") == F.col(f"s_{k}")
    step = F.when(F.col("_q.level") == 0, F.lit(bins)).otherwise(F.lit(coarse))
    first = F.col("_q.bin") == F.floor(F.greatest(lo_q, lo_s) / step)
    # the planner takes exploded rows for no more than the table had: what it would broadcast may not fit the driver
    return q.join(s.hint("merge"), same & first & test).drop("_q", "_s")
