"""Overlap joins. A query and a subject are tables with idx, seqnames, start, end and strand; results are hits, (query_idx, subject_idx).

Ranges must share the space and have compatible strands (equal, or one is *). See ``functions.ranges.pair_matches`` for the kinds of overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ranges as R
from ..plans.binning import interval_join

CORE = ["idx", "seqnames", "start", "end", "strand"]


def _shifted_copies(df: DataFrame, seqinfo: DataFrame) -> DataFrame:
    """Ranges on circular spaces moved to start within the first circle, with copies as many circles back as they reach."""
    info = seqinfo.select("seqnames", F.when(F.col("is_circular"), F.col("seqlength")).alias("_n"))
    joined = df.join(info, "seqnames", "left")
    n = F.col("_n")
    home = F.floor((F.col("start") - 1) / n) * n
    back = F.sequence(F.lit(0).cast("bigint"), 1 + F.floor((F.col("end") - F.col("start") + 1) / n))
    copies = joined.withColumn("_k", F.explode(F.when(n.isNotNull(), back).otherwise(F.array(F.lit(0).cast("bigint")))))
    off = F.coalesce(home + F.col("_k") * n, F.lit(0))
    kinds = {f.name: f.dataType for f in df.schema}
    return copies.withColumns({"start": (F.col("start") - off).cast(kinds["start"]), "end": (F.col("end") - off).cast(kinds["end"])}).select(*df.columns)


def overlap_pairs(query: DataFrame, subject: DataFrame, kind: str = "any", maxgap: int = -1, minoverlap: int = 0, ignore_strand: bool = False, bins: int | None = None, on: tuple[str, ...] = ("seqnames",)) -> DataFrame:
    """Overlapping rows side by side, all columns, prefixed q_ and s_."""
    test = R.pair_matches(kind, maxgap, minoverlap)
    if not ignore_strand:
        test &= R.compatible(F.col("q_strand"), F.col("s_strand"))
    pad = maxgap + 1 if kind == "any" else max(maxgap, 0) + 1
    return interval_join(query, subject, test, pad, on, bins)


def find_overlaps(query: DataFrame, subject: DataFrame, kind: str = "any", maxgap: int = -1, minoverlap: int = 0, ignore_strand: bool = False, seqinfo: DataFrame | None = None, bins: int | None = None) -> DataFrame:
    """All hits. With seqinfo, ranges on its circular spaces also overlap across the origin."""
    q, s = query.select(*CORE), subject.select(*CORE)
    if seqinfo is not None:
        q, s = _shifted_copies(q, seqinfo), _shifted_copies(s, seqinfo)
    hits = overlap_pairs(q, s, kind, maxgap, minoverlap, ignore_strand, bins).select(F.col("q_idx").alias("query_idx"), F.col("s_idx").alias("subject_idx"))
    return hits if seqinfo is None else hits.distinct()


def select_hits(query: DataFrame, hits: DataFrame, select: str = "first") -> DataFrame:
    """One row per query: query_idx and subject_idx (first: least; last, arbitrary: largest; null without a hit) or, for count, n."""
    if select == "count":
        found = hits.groupBy("query_idx").agg(F.count(F.lit(1)).alias("n"))
        return query.select(F.col("idx").alias("query_idx")).join(found, "query_idx", "left").select("query_idx", F.coalesce("n", F.lit(0)).alias("n"))
    pick = {"first": F.min, "last": F.max, "arbitrary": F.max}[select]
    found = hits.groupBy("query_idx").agg(pick("subject_idx").alias("subject_idx"))
    return query.select(F.col("idx").alias("query_idx")).join(found, "query_idx", "left")


def count_overlaps(query: DataFrame, subject: DataFrame, **how) -> DataFrame:
    """query_idx and n for every query."""
    return select_hits(query, find_overlaps(query, subject, **how), "count")


def subset_by_overlaps(query: DataFrame, subject: DataFrame, invert: bool = False, **how) -> DataFrame:
    """Queries with a hit (without one, if invert), all columns."""
    hits = find_overlaps(query, subject, **how)
    return query.join(hits, query["idx"] == hits["query_idx"], "left_anti" if invert else "left_semi")


def overlaps_any(query: DataFrame, subject: DataFrame, **how) -> DataFrame:
    """query_idx and overlaps (boolean) for every query."""
    counted = count_overlaps(query, subject, **how)
    return counted.select("query_idx", (F.col("n") > 0).alias("overlaps"))


def parallel_overlaps(x: DataFrame, y: DataFrame, kind: str = "any", maxgap: int = 0, minoverlap: int = 1, ignore_strand: bool = False) -> DataFrame:
    """Rows of x and y with equal idx compared: idx and overlaps."""
    pairs = side_by_side(x, y)
    test = R.pair_matches(kind, maxgap - 1 if kind == "any" else maxgap, minoverlap) & (F.col("q_seqnames") == F.col("s_seqnames"))
    if not ignore_strand:
        test &= R.compatible(F.col("q_strand"), F.col("s_strand"))
    return pairs.select(F.col("q_idx").alias("idx"), test.alias("overlaps"))


def side_by_side(x: DataFrame, y: DataFrame) -> DataFrame:
    """Rows with equal idx, columns prefixed q_ and s_."""
    from ..plans.binning import prefixed

    q, s = prefixed(x, "q_"), prefixed(y, "s_")
    return q.join(s, q["q_idx"] == s["s_idx"])


def find_overlaps_lists(query: DataFrame, subject: DataFrame, kind: str = "any", maxgap: int = -1, minoverlap: int = 0, ignore_strand: bool = False, bins: int | None = None, query_flat: bool = False, subject_flat: bool = False) -> DataFrame:
    """Hits between list elements: (query_idx, subject_idx) of groups (column ``group``), or of rows on a flat side.

    any: some of their ranges overlap. minoverlap: of the shared positions of all pairs of ranges together. start, end: between
    two lists, only the subject's first (last) range in order of idx counts, against any of the query's. within: every range of
    the query has a hit in the subject (in one and the same range, if the subject is flat; for a flat query any one range does).
    equal: the same, and every range of the subject has one.
    """
    q = query.withColumn("_g", F.col("idx" if query_flat else "group"))
    s = subject.withColumn("_g", F.col("idx" if subject_flat else "group"))
    sizes_q, sizes_s = (t.groupBy("_g").agg(F.count(F.lit(1)).alias("_size")) for t in (q, s))
    both_lists = not query_flat and not subject_flat
    if both_lists and kind in ("start", "end"):
        from pyspark.sql import Window

        order = F.col("idx") if kind == "start" else F.col("idx").desc()
        s = s.withColumn("_r", F.row_number().over(Window.partitionBy("_g").orderBy(order))).where("_r = 1").drop("_r")
    cols = ["_g", *CORE]
    pairs = overlap_pairs(q.select(*cols), s.select(*cols), kind, maxgap, 0, ignore_strand, bins)
    wanted = {}  # only what the kind asks for: distinct counts make a wide aggregate
    if minoverlap > 0:
        wanted["_shared"] = F.sum(R.shared_width("q_", "s_"))
    if kind in ("within", "equal") and not query_flat:
        wanted["_nq"] = F.countDistinct("q_idx")
    if kind == "equal" and not subject_flat:
        wanted["_ns"] = F.countDistinct("s_idx")
    hits = pairs.groupBy(F.col("q__g").alias("query_idx"), F.col("s__g").alias("subject_idx"))
    found = hits.agg(*[c.alias(k) for k, c in wanted.items()]) if wanted else hits.agg(F.lit(1).alias("_one"))
    if minoverlap > 0:
        found = found.where(F.col("_shared") >= minoverlap)
    if kind in ("within", "equal") and not query_flat:
        found = found.join(sizes_q.select(F.col("_g").alias("query_idx"), F.col("_size").alias("_q")), "query_idx").where("_nq = _q")
    if kind == "equal" and not subject_flat:
        found = found.join(sizes_s.select(F.col("_g").alias("subject_idx"), F.col("_size").alias("_s")), "subject_idx").where("_ns = _s")
    return found.select("query_idx", "subject_idx")
