"""Removal of lines that many documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, ascii_lower, small, written


def line_keys(text: Column) -> Column:
    """The keys of a text's lines, in order: A-Z lower-cased, white space stripped at both ends."""
    return F.transform(F.split(ascii_lower(text), "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("_h1"), F.xxhash64(F.lit("line"), key).alias("_h2")]


def frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text") -> DataFrame:
    """128-bit hashes of the keys found in at least ``min_docs`` rows of docs. Rows count a key once; counts are combined before the shuffle, so a line in every document is no hot spot."""
    per_row = docs.select(F.explode(F.array_distinct(line_keys(F.coalesce(F.col(text), F.lit(""))))).alias("_key"))
    counts = per_row.where(F.length("_key") >= min_chars).groupBy(*_hashes(F.col("_key"))).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") >= min_docs).select("_h1", "_h2")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Drop every line whose key is found in at least ``min_docs`` documents; other lines stay, joined by \\n.

    Returns one row per input row: doc_id, text (what stays), n_lines (before dropping), n_dropped.
    A null or empty text is one empty line and is never dropped (with min_chars of 1 or more).
    A text of which every line goes becomes ''. Each row counts as one document, also where ids repeat or are null.
    Further columns of docs are ignored. An empty table gives no rows.

    Lines are exploded with their position, joined to the frequent keys by hash (broadcast only up to a checked size,
    else a shuffled join that AQE splits where a line is hot) and put together again by position.
    """
    frequent = small(written(frequent_lines(docs, min_docs, min_chars, text), "lines")).withColumn("_bad", F.lit(1))
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    lines = rows.select("_row", "_id", F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))
    key = F.btrim(ascii_lower(F.col("_line")), F.lit(WS_CHARS))
    # lines too short to be dropped match nothing, and are dealt by their place rather than all as one null key
    long, (h1, h2) = F.length(key) >= min_chars, _hashes(key)
    keyed = lines.select("*", F.when(long, h1).otherwise(F.xxhash64("_row", "_pos")).alias("_h1"), F.when(long, h2).alias("_h2"))
    flagged = keyed.join(frequent, ["_h1", "_h2"], "left")
    out = flagged.groupBy("_row").agg(
        F.first("_id").alias(doc_id),
        F.count(F.lit(1)).alias("n_lines"),
        F.count("_bad").alias("n_dropped"),
        F.collect_list(F.when(F.col("_bad").isNull(), F.struct("_pos", "_line"))).alias("_kept"),
    )
    joined = F.array_join(F.transform(F.sort_array("_kept"), lambda x: x["_line"]), "\n")
    return out.select(doc_id, joined.alias(text), "n_lines", "n_dropped")


def op4_query(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
bad AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(bad.k) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN bad.k IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM keyed LEFT JOIN bad USING (k) GROUP BY doc_id
"""
