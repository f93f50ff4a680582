"""Mixing of sources to target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, small, written

_KEY = ["_null", "_src"]


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets from one row per source (_null, _src, source_size): sources by code point, null last, take the weights in turn.

    ``share`` of all sizes is dealt by weight; a target stops at ``most`` times its source's size and the excess goes to
    the others by weight, until none is above. Solved at once: with sources by size over weight, the first k are full
    for the least k at which the next one is not. ``share`` must not be above ``most``. This table has a row per source.
    """
    if share > most:
        raise ValueError("share must not be above most")
    order = Window.orderBy("_null", "_src")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    weighted = sizes.select("*", turn.alias("_w")).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    by_fill = Window.orderBy(F.col("_cap") / F.col("_w"), "_null", "_src").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(by_fill), F.lit(0.0))
    rate = left / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(by_fill), F.lit(0.0)))
    level = weighted.withColumn("_rate", rate).withColumn("_fits", F.when(F.col("_rate") * F.col("_w") <= F.col("_cap"), F.col("_rate")))
    # the first that fits gives the level; later rates are for fills that never happen
    first = F.min(F.when(F.col("_fits").isNotNull(), F.struct((F.col("_cap") / F.col("_w")).alias("o"), "_null", "_src", "_fits"))).over(everything)
    return level.withColumn("_level", first["_fits"]).withColumn("target", F.coalesce(F.least("_cap", F.col("_level") * F.col("_w")), "_cap")).select(*_KEY, "source_size", "target")


def _sized(docs: DataFrame, seed: int, doc_id: str, text: str, source: str, *more) -> DataFrame:
    size = F.coalesce(n_words(F.col(text)), F.lit(0)).cast("bigint")
    keyed = docs.select(
        *more,
        F.col(doc_id).alias("_id"),
        size.alias("size"),
        F.col(source).isNull().alias("_null"),
        F.coalesce(F.col(source), F.lit("")).alias("_src"),
        F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_t"),
    )
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("_id").cast("string"), "_t").cast("binary")), 1, 15)
    return keyed.withColumn("_key", F.conv(digits, 16, 10).cast("bigint"))


def _mixed(rows: DataFrame, light: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    sizes = written(light.groupBy(*_KEY).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows")), "mix-sizes")
    cut = F.ceil(F.sqrt("_rows")).cast("bigint")
    plan = source_targets(sizes.drop("_rows"), weights, share, most).join(sizes.select(*_KEY, cut.alias("_cut")), _KEY)
    full = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("bigint")
    plan = plan.withColumn("_full", full).withColumn("_budget", F.col("target") - F.col("_full") * F.col("source_size"))
    plan = small(written(plan, "mix-plan"))
    unit = F.shiftright("_key", 12).cast("double") / F.lit(float(1 << 48))
    bucket = F.least(F.floor(unit * F.col("_cut")), F.col("_cut") - 1)
    sums = light.join(plan.select(*_KEY, "_cut"), _KEY).groupBy(*_KEY, bucket.alias("_bucket")).agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy(*_KEY).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*_KEY, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    offsets = small(written(offsets, "mix-offsets"))
    inner = Window.partitionBy(*_KEY, "_bucket").orderBy("_key", "_id", "size", "_t").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("_before") + F.coalesce(F.sum("size").over(inner), F.lit(0)) + F.col("size") / 2.0
    more = (F.col("_full") < int(most)) & (middle <= F.col("_budget"))
    dealt = rows.join(plan, _KEY).withColumn("_bucket", bucket).join(offsets, [*_KEY, "_bucket"])
    return dealt.withColumn("copies", F.col("_full") + more.cast("bigint")).withColumn("taken", F.col("copies") * F.col("size"))


NEW = ["size", "source_size", "target", "copies", "taken"]


def mix_decisions(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 11, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How often the mix takes each row of docs: doc_id, source, size, source_size, target, copies, taken.

    size: words of the text (null: 0). Every row is taken floor(target / source_size) times; then rows in hash-random
    order once more, up to the budget that is left: a row is in if the sum up to its middle is within the budget, so a
    source misses its target by half a document at most. copies never exceed ``most`` (a whole number).

    Rows get hash-random keys of 60 bits from seed, id and text; key ranges of equal width cut a source with n rows into about
    sqrt(n) buckets. Bucket sums are prefix-summed per source, rows within their bucket: no window holds more than about
    sqrt(n) rows, however large one source is. Keys depend on rows alone, so reruns agree; rows alike in all of these are
    interchangeable. A null source is a source of its own, last in order. Rows of size 0 take part. Repeated and null ids
    are rows like others, and further columns are ignored. An empty table gives no rows.
    """
    light = written(_sized(docs, seed, doc_id, text, source), "mix-rows")
    out = _mixed(light, light, weights, share, most)
    return out.select(F.col("_id").alias(doc_id), F.when(~F.col("_null"), F.col("_src")).alias(source), *NEW)


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 11, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: rows of docs, all columns, each as often as ``mix_decisions`` takes it."""
    light = written(_sized(docs, seed, doc_id, text, source), "mix-rows")
    rows = _mixed(_sized(docs, seed, doc_id, text, source, F.struct("*").alias("_in")), light, weights, share, most)
    return rows.where(F.col("copies") > 0).select("_in", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_in.*")


def op9_query(docs: DataFrame) -> DataFrame:
    return mix_decisions(docs).select("doc_id", *NEW)


#: The same by one window over each source.
OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS nul, coalesce(source, '') AS src,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         substr(md5(concat_ws(':', '11', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 15) AS k
  FROM documents),
s AS (SELECT nul, src, CAST(sum(size) AS BIGINT) AS source_size, sum(size) * 2.0::DOUBLE AS cap FROM d GROUP BY nul, src),
w AS (SELECT *, list_value(3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE)[(row_number() OVER (ORDER BY nul, src) - 1) % 3 + 1] AS w FROM s),
r AS (
  SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(cap) OVER fuller, 0)) / ((SELECT sum(w) FROM w) - coalesce(sum(w) OVER fuller, 0)) AS rate
  FROM w WINDOW fuller AS (ORDER BY cap / w, nul, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT nul, src, source_size, least(cap, w * (SELECT rate FROM r WHERE rate * w <= cap ORDER BY cap / w, nul, src LIMIT 1)) AS target FROM r),
m AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS whole,
         coalesce(sum(size) OVER (PARTITION BY nul, src ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0::DOUBLE AS middle
  FROM d JOIN t USING (nul, src))
SELECT doc_id, size, source_size, target, CAST(copies AS BIGINT) AS copies, CAST(copies * size AS BIGINT) AS taken
FROM (SELECT *, whole + CAST(whole < 2 AND middle <= target - whole * source_size AS INTEGER) AS copies FROM m)
"""
