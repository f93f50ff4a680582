"""Set operations: on the positions that tables cover (per space and strand, and per element with ``by``), and row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranges as R
from ..plans.binning import prefixed
from ..plans.prefix import depth
from .inter import By, _keys, merge_ranges
from .overlaps import CORE, overlap_pairs, side_by_side


def _ranges_only(*tables: DataFrame) -> None:
    for t in tables:
        lacking = {"seqnames", "start", "end", "strand"} - set(t.columns)
        if lacking:
            raise TypeError(f"not a table of ranges: no {', '.join(sorted(lacking))}")


def union_ranges(x: DataFrame, y: DataFrame, ignore_strand: bool = False, by: By = (), block: int | None = None) -> DataFrame:
    """Positions in x or y."""
    _ranges_only(x, y)
    cols = [*_keys(by), "start", "end"]
    return merge_ranges(x.select(*cols).unionByName(y.select(*cols)), drop_empty=True, ignore_strand=ignore_strand, by=by, block=block)


def _swept(x: DataFrame, y: DataFrame, keep: Column, ignore_strand: bool, by: By, block: int | None) -> DataFrame:
    """Positions from 1 on where counts ``x`` and ``y`` of the ranges there pass keep."""
    _ranges_only(x, y)
    keys = _keys(by)

    def events(df: DataFrame, n: str) -> DataFrame:
        rows = df.withColumn("strand", F.lit("*")) if ignore_strand else df
        rows = rows.select(*keys, F.greatest("start", F.lit(1)).alias("start"), "end").where("start <= end")
        ends = F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("end") + 1).alias("pos"), F.lit(-1).alias("d")))
        exploded = rows.select(*keys, F.explode(ends).alias("e"))
        one, other = F.col("e.d").alias(n), F.lit(0).alias("y" if n == "x" else "x")
        return exploded.select(*keys, "e.pos", *([one, other] if n == "x" else [other, one]))

    runs = depth(events(x, "x").unionByName(events(y, "y")), keys, ["x", "y"], block).where(keep)
    pieces = runs.select(*keys, F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    return merge_ranges(pieces, by=by, block=block)


def intersect_ranges(x: DataFrame, y: DataFrame, ignore_strand: bool = False, by: By = (), block: int | None = None) -> DataFrame:
    """Positions in x and y."""
    return _swept(x, y, (F.col("x") > 0) & (F.col("y") > 0), ignore_strand, by, block)


def setdiff_ranges(x: DataFrame, y: DataFrame, ignore_strand: bool = False, by: By = (), block: int | None = None) -> DataFrame:
    """Positions in x and not in y."""
    return _swept(x, y, (F.col("x") > 0) & (F.col("y") == 0), ignore_strand, by, block)


def _pairs(x: DataFrame, y: DataFrame, ignore_strand: bool) -> tuple[DataFrame, Column, Column]:
    """Rows with equal idx side by side, whether they are comparable, and the strand of what both give."""
    pairs = side_by_side(x, y)
    same = F.col("q_seqnames") == F.col("s_seqnames")
    if not ignore_strand:
        same &= R.compatible(F.col("q_strand"), F.col("s_strand"))
    strand = F.col("q_strand") if ignore_strand else F.when(F.col("q_strand") == "*", F.col("s_strand")).otherwise(F.col("q_strand"))
    return pairs, same, strand


def _result(pairs: DataFrame, start: Column, end: Column, strand: Column, *more: Column) -> DataFrame:
    return pairs.select(F.col("q_idx").alias("idx"), F.col("q_seqnames").alias("seqnames"), start.cast("int").alias("start"), end.cast("int").alias("end"), strand.alias("strand"), *more)


def _must(test: Column, value: Column, what: str) -> Column:
    return F.when(test, value).otherwise(F.raise_error(F.lit(what)))


def parallel_union(x: DataFrame, y: DataFrame, fill_gap: bool = False, ignore_strand: bool = False) -> DataFrame:
    """The hull of each two rows with equal idx; an error if they are not comparable, or are apart without fill_gap."""
    pairs, same, strand = _pairs(x, y, ignore_strand)
    lo, hi = F.least("q_start", "s_start"), F.greatest("q_end", "s_end")
    start = _must(same, lo, "parallel_union: other space or strand")
    if not fill_gap:
        start = _must(R.gap_width("q_", "s_") == 0, start, "parallel_union: a gap between the ranges")
    return _result(pairs, start, hi, strand)


def parallel_intersect(x: DataFrame, y: DataFrame, drop_nohit: bool = False, ignore_strand: bool = False, strict_strand: bool = False) -> DataFrame:
    """The shared part of each two rows with equal idx and ``hit``: whether they touch on one space and strand (* goes with any, unless strict). Others become empty at x's start, or go with drop_nohit."""
    pairs, same, strand = _pairs(x, y, ignore_strand)
    if strict_strand and not ignore_strand:
        same, strand = (F.col("q_seqnames") == F.col("s_seqnames")) & (F.col("q_strand") == F.col("s_strand")), F.col("q_strand")
    lo, hi = F.greatest("q_start", "s_start"), F.least("q_end", "s_end")
    hit = same & (hi >= lo - 1)
    if drop_nohit:
        return _result(pairs.where(hit), lo, hi, strand)
    return _result(pairs, F.when(hit, lo).otherwise(F.col("q_start")), F.when(hit, hi).otherwise(F.col("q_start") - 1), F.when(hit, strand).otherwise(F.col("q_strand")), hit.alias("hit"))


def parallel_setdiff(x: DataFrame, y: DataFrame, ignore_strand: bool = False) -> DataFrame:
    """What of each row of x is not in the row of y with equal idx; x as it is if they are not comparable; an error where y would cut x in two."""
    pairs, same, strand = _pairs(x, y, ignore_strand)
    q1, q2, s1, s2 = (F.col(k) for k in ("q_start", "q_end", "s_start", "s_end"))
    meets = same & (s1 <= q2) & (s2 >= q1) & (s2 >= s1)
    splits = meets & (s1 > q1) & (s2 < q2)
    start = F.when(~meets, q1).when(splits, F.raise_error(F.lit("parallel_setdiff: the range would fall into two")).cast("int")).when(s1 > q1, q1).otherwise(F.least(s2 + 1, F.when(s2 >= q2, q1).otherwise(s2 + 1)))
    end = F.when(~meets, q2).when(s1 > q1, s1 - 1).when(s2 >= q2, q1 - 1).otherwise(q2)
    return _result(pairs, start, end, F.when(same, strand).otherwise(F.col("q_strand")))


def parallel_gap(x: DataFrame, y: DataFrame, ignore_strand: bool = False) -> DataFrame:
    """What lies between each two rows with equal idx, empty if they touch or overlap; an error if they are not comparable."""
    pairs, same, strand = _pairs(x, y, ignore_strand)
    lo, hi = F.least("q_end", "s_end") + 1, F.greatest("q_start", "s_start") - 1
    start = _must(same, F.when(hi < lo - 1, F.greatest("q_start", "s_start")).otherwise(lo), "parallel_gap: other space or strand")
    return _result(pairs, start, F.when(hi < lo - 1, F.greatest("q_start", "s_start") - 1).otherwise(hi), strand)


def subtract(x: DataFrame, y: DataFrame, minoverlap: int = 1, ignore_strand: bool = False, bins: int | None = None, block: int | None = None) -> DataFrame:
    """What is left of each row of x without the ranges of y (merged first) that share ``minoverlap`` positions with it at least: idx of x,
    seqnames, start, end, strand, and piece (1 ..). Rows of which nothing is left have no row."""
    cut = merge_ranges(y, drop_empty=True, ignore_strand=ignore_strand, block=block).withColumn("idx", F.lit(0))
    return _without(x, overlap_pairs(x.select(*CORE), cut, minoverlap=max(minoverlap, 1), ignore_strand=ignore_strand, bins=bins))


def _without(x: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of x without the ranges paired with them (q_ columns: x's; s_start, s_end: the cut). A row's cuts are sorted, and a piece ends before each of them, and at the row's end."""
    cuts = pairs.select(*[F.col(f"q_{c}").alias(c) for c in CORE], F.col("s_start").cast("int").alias("_s"), F.col("s_end").cast("int").alias("_e"))
    ends = x.select(*CORE, (F.col("end") + 1).cast("int").alias("_s"), F.lit(None).cast("int").alias("_e"))
    row = Window.partitionBy("idx").orderBy("_s", F.col("_e").asc_nulls_last())
    before = F.max("_e").over(row.rowsBetween(Window.unboundedPreceding, -1))
    lo, hi = F.greatest(F.col("start"), before + 1), F.col("_s") - 1
    pieces = cuts.unionByName(ends).withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi OR start > end")
    return pieces.select("idx", "seqnames", F.col("_lo").alias("start"), F.col("_hi").alias("end"), "strand", F.row_number().over(row).alias("piece"))


def parallel_setdiff_list(x: DataFrame, y: DataFrame, ignore_strand: bool = False) -> DataFrame:
    """What of each row of x is in no range of the list element y (column ``group``) with its idx: like ``subtract``, element by element."""
    merged = merge_ranges(y.where("end >= start"), ignore_strand=ignore_strand, by=("group",))
    q, s = prefixed(x, "q_"), prefixed(merged, "s_")
    test = (q["q_idx"] == s["s_group"]) & (q["q_seqnames"] == s["s_seqnames"]) & (F.col("s_start") <= F.col("q_end")) & (F.col("s_end") >= F.col("q_start"))
    if not ignore_strand:
        test &= R.compatible(F.col("q_strand"), F.col("s_strand"))
    return _without(x, q.join(s, test))


def parallel_intersect_list(x: DataFrame, y: DataFrame, ignore_strand: bool = False) -> DataFrame:
    """Each range of the list x (column ``group``) cut to the row of y whose idx is its group: x's columns and hit; what does not touch becomes empty at its start."""
    s = prefixed(y.select("idx", "seqnames", "start", "end", "strand"), "_s_")
    rows = x.join(s, F.col("group") == F.col("_s_idx"))
    same = F.col("seqnames") == F.col("_s_seqnames")
    if not ignore_strand:
        same &= R.compatible(F.col("strand"), F.col("_s_strand"))
    lo, hi = F.greatest("start", "_s_start"), F.least("end", "_s_end")
    hit = same & (hi >= lo - 1)
    return rows.withColumn("hit", hit).withColumns({"end": F.when(hit, hi).otherwise(F.col("start") - 1), "start": F.when(hit, lo).otherwise(F.col("start"))}).select(*x.columns, "hit")


def all_comparable(x: DataFrame, y: DataFrame) -> DataFrame:
    """One row, comparable: whether all rows with equal idx lie on one space and compatible strands."""
    pairs, same, _ = _pairs(x, y, False)
    return pairs.agg((F.coalesce(F.min(same.cast("int")), F.lit(1)) == 1).alias("comparable"))
