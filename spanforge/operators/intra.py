"""Row-wise transforms. All keep every other column and row order does not matter; none shuffles.

A numeric argument is a number, or the name of a column, or a Column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranges as R

Number = int | str | Column


def _value(x: Number | None) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def _put(df: DataFrame, start: Column, end: Column) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema}
    return df.withColumns({"start": start.cast(kinds["start"]), "end": end.cast(kinds["end"])})


def _minus(ignore_strand: bool) -> Column:
    return F.lit(False) if ignore_strand else F.col("strand") == "-"


def shift(df: DataFrame, by: Number) -> DataFrame:
    return _put(df, F.col("start") + _value(by), F.col("end") + _value(by))


def narrow(df: DataFrame, start: int | None = None, end: int | None = None, width: int | None = None) -> DataFrame:
    """The part of each range from position ``start`` to ``end`` within it, 1 the first and -1 the last; two of the three say it. An error where the part is not within the range."""
    at = lambda x: F.col("start") + x - 1 if x > 0 else F.col("end") + x + 1
    if start is not None and end is not None and width is not None:
        raise ValueError("give two of start, end and width")
    if start is None and end is None and width is not None:
        raise ValueError("width needs start or end")
    lo = at(start) if start is not None else None
    hi = at(end) if end is not None else None
    if lo is None:
        lo = hi - width + 1 if width is not None else F.col("start")
    if hi is None:
        hi = lo + width - 1 if width is not None else F.col("end")
    fits = (lo >= F.col("start")) & (hi <= F.col("end")) & (hi >= lo - 1)
    return _put(df, F.when(fits, lo).otherwise(F.raise_error(F.lit("narrow: not within the range"))), hi)


def resize(df: DataFrame, width: Number, fix: str = "start", ignore_strand: bool = False) -> DataFrame:
    """Ranges of the given width with ``fix`` kept: start, end (each other on -) or center (rounded down), or the name of a column of these."""
    w, minus = _value(width), _minus(ignore_strand)
    anchor = F.lit(fix) if fix in ("start", "end", "center") else F.col(fix)
    keep_end = (anchor == "end") != minus
    lo = (
        F.when(anchor == "center", F.col("start") + F.floor((R.width() - w) / 2))
        .when(keep_end, F.col("end") - w + 1)
        .otherwise(F.col("start"))
    )
    return _put(df, lo, lo + w - 1)


def flank(df: DataFrame, width: Number, start: bool = True, both: bool = False, ignore_strand: bool = False) -> DataFrame:
    """The ``width`` positions before each range (after it, if not start; the other way on -), or that many on both sides of that end."""
    w = _value(width)
    before = F.lit(start) != _minus(ignore_strand)
    s, e = F.col("start"), F.col("end")
    if both:
        return _put(df, F.when(before, s - w).otherwise(e - w + 1), F.when(before, s + w - 1).otherwise(e + w))
    return _put(df, F.when(before, s - w).otherwise(e + 1), F.when(before, s - 1).otherwise(e + w))


def _checked(*xs: Number) -> None:
    if any(isinstance(x, int) and x < 0 for x in xs):
        raise ValueError("upstream and downstream must not be negative")


def promoters(df: DataFrame, upstream: Number = 2000, downstream: Number = 200) -> DataFrame:
    """Around the start in reading direction: ``upstream`` positions before it and ``downstream`` from it on."""
    _checked(upstream, downstream)
    up, down, minus = _value(upstream), _value(downstream), _minus(False)
    return _put(df, F.when(minus, F.col("end") - down + 1).otherwise(F.col("start") - up), F.when(minus, F.col("end") + up).otherwise(F.col("start") + down - 1))


def terminators(df: DataFrame, upstream: Number = 2000, downstream: Number = 200) -> DataFrame:
    """The same around the end in reading direction."""
    _checked(upstream, downstream)
    up, down, minus = _value(upstream), _value(downstream), _minus(False)
    return _put(df, F.when(minus, F.col("start") - down + 1).otherwise(F.col("end") - up), F.when(minus, F.col("start") + up).otherwise(F.col("end") + down - 1))


def restrict(df: DataFrame, start: Number | dict[str, int] | None = None, end: Number | dict[str, int] | None = None, keep_all: bool = False) -> DataFrame:
    """Ranges clipped to start and end, each a number, a column or one per space (spaces not named are not clipped). Ranges that lie
    outside with a gap go, unless keep_all, which leaves them empty at the bound; those that touch the bound become empty."""

    def bound(x):
        if isinstance(x, dict):
            out = F.lit(None).cast("int")
            for k, v in x.items():
                out = F.when(F.col("seqnames") == k, v).otherwise(out)
            return out
        return _value(x).cast("int") if x is None else _value(x)

    lo, hi = bound(start), bound(end)
    out = df if keep_all else df.where(F.coalesce(F.col("end") >= lo - 1, F.lit(True)) & F.coalesce(F.col("start") <= hi + 1, F.lit(True)))
    # a range beyond a bound is put at it, empty
    s = F.least(F.greatest(F.col("start"), lo), F.coalesce(hi + 1, F.greatest(F.col("start"), lo)))
    e = F.greatest(F.least(F.col("end"), hi), F.coalesce(lo - 1, F.least(F.col("end"), hi)))
    return _put(out, s, e)


def out_of_bounds(df: DataFrame, seqinfo: DataFrame) -> DataFrame:
    """Rows that reach beyond a space of known length that is not circular."""
    info = seqinfo.select("seqnames", F.col("seqlength").alias("_n"), F.coalesce("is_circular", F.lit(False)).alias("_circular"))
    return df.join(info, "seqnames").where(~F.col("_circular") & ((F.col("start") < 1) | (F.col("end") > F.col("_n")))).select(*df.columns)


def trim(df: DataFrame, seqinfo: DataFrame) -> DataFrame:
    """Ranges clipped to their space, where its length is known and it is not circular; all rows stay."""
    info = seqinfo.where("seqlength IS NOT NULL AND NOT coalesce(is_circular, false)").select("seqnames", F.col("seqlength").alias("_n"))
    joined = df.join(info, "seqnames", "left")
    out = F.col("_n").isNotNull() & ((F.col("start") < 1) | (F.col("end") > F.col("_n")))
    s = F.when(out, F.least(F.greatest(F.col("start"), F.lit(1)), F.col("_n") + 1)).otherwise(F.col("start"))
    e = F.when(out, F.greatest(F.least(F.col("end"), F.col("_n")), F.lit(0))).otherwise(F.col("end"))
    return _put(joined, s, e).select(*df.columns)


def invert_strand(df: DataFrame) -> DataFrame:
    return df.withColumn("strand", R.invert(F.col("strand")))


def unstrand(df: DataFrame) -> DataFrame:
    return df.withColumn("strand", F.lit("*"))


def set_strand(df: DataFrame, value: Column, kind: str = "string") -> DataFrame:
    return df.withColumn("strand", R.to_strand(value, kind))


def set_start(df: DataFrame, value: Number) -> DataFrame:
    """Moves starts; ends stay."""
    return _put(df, _value(value), F.col("end"))


def set_end(df: DataFrame, value: Number) -> DataFrame:
    """Moves ends; starts stay."""
    return _put(df, F.col("start"), _value(value))


def set_width(df: DataFrame, value: Number) -> DataFrame:
    """Starts stay."""
    return _put(df, F.col("start"), F.col("start") + _value(value) - 1)


def tile(df: DataFrame, n: int | None = None, width: int | None = None) -> DataFrame:
    """Each row cut into n tiles, or into the fewest tiles of ``width`` at most: the columns, with the tile's start and end, and ``tile`` (1 ..).
    Tile k ends floor(W k / n) positions in. An empty range is one tile; n above a range's width is an error."""
    if (n is None) == (width is None):
        raise ValueError("give n or width")
    w = R.width()
    count = F.lit(n) if n is not None else F.greatest(F.ceil(w / width).cast("int"), F.lit(1))
    valid = F.when(count > F.greatest(w, F.lit(1)), F.raise_error(F.lit("tile: n is above the width")).cast("int")).otherwise(count)
    cut = df.withColumn("_n", valid).withColumn("tile", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    edge = lambda k: F.col("start") + F.floor(w.cast("bigint") * k / F.col("_n"))
    return _put(cut, edge(F.col("tile") - 1), edge(F.col("tile")) - 1).drop("_n")


def sliding_windows(df: DataFrame, width: int, step: int = 1) -> DataFrame:
    """Windows of ``width`` within each row, ``step`` apart, the last one cut off: the columns, with the window's start and end, and ``window`` (1 ..). A row that is not wider is one window."""
    w = R.width()
    count = F.when(w > width, F.ceil((w - width) / step) + 1).otherwise(1).cast("int")
    cut = df.withColumn("window", F.explode(F.sequence(F.lit(1), count)))
    lo = F.col("start") + (F.col("window") - 1) * step
    return _put(cut, lo, F.least(lo + width - 1, F.col("end")))


def absolute(df: DataFrame, seqinfo: DataFrame) -> DataFrame:
    """Ranges on one axis of all spaces end to end (seqnames ``genome``, strand *). An error for ranges out of bounds, unknown lengths and a total above 2^31 - 1 (see ``is_small``)."""
    info = _offsets(seqinfo)
    joined = df.join(info, "seqnames", "left")
    bad = F.col("_n").isNull() | (F.col("start") < 1) | (F.col("end") > F.col("_n")) | (F.col("_total") > (1 << 31) - 1)
    s = F.when(bad, F.raise_error(F.lit("absolute: out of bounds, unknown length or too long"))).otherwise(F.col("start") + F.col("_offset"))
    return joined.withColumns({"start": s.cast("int"), "end": (F.col("end") + F.col("_offset")).cast("int"), "seqnames": F.lit("genome"), "strand": F.lit("*")}).select(*df.columns)


def relative(df: DataFrame, seqinfo: DataFrame) -> DataFrame:
    """Back from one axis to spaces; an error for ranges beyond it or across two spaces."""
    info = _offsets(seqinfo).select(F.col("seqnames").alias("_name"), "_n", "_offset")
    # the space of a position is found with a join on the one row per space whose stretch holds the start
    held = (F.col("start") > F.col("_offset")) & (F.col("start") <= F.col("_offset") + F.col("_n"))
    joined = df.join(info, held, "left")
    e = F.when(F.col("_n").isNull() | (F.col("end") > F.col("_offset") + F.col("_n")), F.raise_error(F.lit("relative: not within one space"))).otherwise(F.col("end") - F.col("_offset"))
    return joined.withColumns({"end": e.cast("int"), "start": (F.col("start") - F.col("_offset")).cast("int"), "seqnames": F.col("_name")}).select(*df.columns)


def _offsets(seqinfo: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    before = Window.orderBy("seqid").rowsBetween(Window.unboundedPreceding, -1)  # one row per space
    n = F.col("seqlength").cast("bigint")
    return seqinfo.select("seqnames", n.alias("_n"), F.coalesce(F.sum(n).over(before), F.lit(0)).alias("_offset"), F.sum(n).over(Window.partitionBy()).alias("_total"))


def is_small(seqinfo: DataFrame) -> DataFrame:
    """One row, ``is_small``: whether all lengths sum to 2^31 - 1 at most; null if unknown lengths leave it open."""
    total = F.coalesce(F.sum(F.col("seqlength").cast("bigint")), F.lit(0))
    unknown = F.coalesce(F.max(F.col("seqlength").isNull().cast("int")), F.lit(0)) == 1
    return seqinfo.agg(F.when(total > (1 << 31) - 1, False).when(unknown, F.lit(None)).otherwise(True).alias("is_small"))
