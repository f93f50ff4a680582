"""Rows and elements by place: replacement, slices of a variable by ranges, setters that check the shape, rows that are equal.

Nothing here needs all rows of a space in one task. Errors of shape are raised when the result is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import width
from .tiling import views


def _fail(test: Column, what: str, value: Column) -> Column:
    return F.when(test, F.raise_error(F.lit(what))).otherwise(value)


def _like(df: DataFrame, model: DataFrame) -> list[Column]:
    """The columns of model from df, in the types of model; null where df lacks one."""
    return [(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in model.schema]


def runs_as_ranges(variable: DataFrame, seqinfo: DataFrame) -> DataFrame:
    """The runs of a variable as ranges without a strand, the value as ``score``. idx is the start on the axis of all spaces, so
    it is unique and in order without sorting the runs. All spaces before a run's own must have a length; runs on others go."""
    before = F.sum("seqlength").over(Window.orderBy("seqid").rowsBetween(Window.unboundedPreceding, -1))  # one row per space
    offsets = seqinfo.select("seqnames", F.coalesce(before, F.lit(0)).alias("_offset"))
    idx = (F.col("_offset") + F.col("start")).alias("idx")
    return variable.join(offsets, "seqnames").select(idx, "seqnames", "start", "end", F.lit("*").alias("strand"), F.col("value").alias("score"))


def grouping_of(ranges: DataFrame) -> DataFrame:
    """idx, group (the least idx with the same space, start, end and strand) and size (rows of that group)."""
    coords = ["seqnames", "start", "end", "strand"]
    groups = ranges.groupBy(*coords).agg(F.min("idx").alias("group"), F.count(F.lit(1)).alias("size"))
    return ranges.select("idx", *coords).join(groups, coords).select("idx", "group", "size")


def replace_rows(ranges: DataFrame, new: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """ranges with the rows of new in place of those with their idx: whole rows (attributes that new lacks become null, those
    that ranges lacks are left out) or only ``columns``. An idx of new that ranges lacks is an error. For the spaces of the
    result see ``plans.seqinfo.merge_seqinfo``."""
    fields = [c for c in ranges.columns if c != "idx"]
    unknown = set(columns or ()) - set(fields) | set(columns or ()) - set(new.columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    x = ranges.select("idx", F.struct(*[f"`{c}`" for c in fields]).alias("_x"))
    y = new.select("idx", F.struct(*_like(new, ranges.select(*[f"`{c}`" for c in fields]))).alias("_y"))
    both = x.join(y, "idx", "full")
    out = []
    for c in ranges.columns:
        if c == "idx":
            out.append(_fail(F.col("_x").isNull(), "replace_rows: no such idx", F.col("idx")).alias("idx"))
        elif columns is None or c in columns:
            out.append(F.when(F.col("_y").isNotNull(), F.col("_y")[c]).otherwise(F.col("_x")[c]).alias(c))
        else:
            out.append(F.col("_x")[c].alias(c))
    return both.select(*out)


def take_elements(ranges: DataFrame, groups: DataFrame, chosen: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The ranges and groups of the elements that chosen (group) names. columns: the attributes to keep, either all of the
    ranges or all of the groups; a mixture or an unknown one is a ValueError, and the other table keeps its own."""
    core = ["idx", "group", "group_name", "seqnames", "start", "end", "strand"]
    inner, outer = ranges.select(*[f"`{c}`" for c in ranges.columns]), groups
    if columns is not None:
        wanted = set(columns)
        own, theirs = set(ranges.columns) - set(core), set(groups.columns) - {"group", "group_name"}
        if wanted <= theirs:
            outer = groups.select(*[f"`{c}`" for c in groups.columns if c in wanted or c in ("group", "group_name")])
        elif wanted <= own:
            inner = ranges.select(*[f"`{c}`" for c in ranges.columns if c in wanted or c in core])
        else:
            raise ValueError(f"not all columns of the ranges, nor all of the groups: {sorted(wanted)}")
    names = chosen.select("group").distinct()
    return inner.join(names, "group", "left_semi").select(*[f"`{c}`" for c in inner.columns]), outer.join(names, "group", "left_semi").select(*[f"`{c}`" for c in outer.columns])


def replace_elements(ranges: DataFrame, new: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """The list with the elements in ``groups`` (default: those of new) taken from new; one without ranges there becomes empty.
    Ranges of new in other elements are left out. An idx of new must not occur in the elements that stay."""
    names = (new if groups is None else groups).select("group").distinct()
    stay = ranges.join(names, "group", "left_anti").select(*[f"`{c}`" for c in ranges.columns])
    return stay.unionByName(new.join(names, "group", "left_semi").select(*_like(new, ranges)))


def slice_variable(variable: DataFrame, ranges: DataFrame, bin_size: int | None = None) -> DataFrame:
    """A variable along the spaces, cut by ranges: for each range idx, seqnames and runs, an array of (start, length, value) in
    order, of the range's width in all (none for an empty range). A range that reaches where the variable has no run is an error."""
    pieces = views(ranges, variable, bin_size).where("start <= end")
    run = F.struct("start", (F.col("end") - F.col("start") + 1).alias("length"), "value")
    found = pieces.groupBy(F.col("view_idx").alias("idx")).agg(F.sort_array(F.collect_list(run)).alias("runs"), F.sum(F.col("end") - F.col("start") + 1).alias("_n"))
    kind = found.schema["runs"].dataType
    joined = ranges.select("idx", "seqnames", width().alias("_width")).join(found, "idx", "left")
    runs = F.coalesce("runs", F.array().cast(kind))
    return joined.select("idx", "seqnames", _fail(F.coalesce("_n", F.lit(0)) != F.col("_width"), "slice_variable: range outside the variable", runs).alias("runs"))


def local_idx(ranges: DataFrame) -> DataFrame:
    """A list whose idx is the place (1 ..) in the element, in order of idx: with it a revmap holds places within elements."""
    return ranges.withColumn("idx", F.row_number().over(Window.partitionBy("group").orderBy("idx")).cast(ranges.schema["idx"].dataType))


def set_column(ranges: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """A list with a column set from values (group, place, value; place 1 .. in order of idx). Both must have the same shape, else
    an error. A column that exists keeps its type."""
    placed = ranges.select("group", F.row_number().over(Window.partitionBy("group").orderBy("idx")).alias("_place"), F.struct(*[f"`{c}`" for c in ranges.columns]).alias("_x"))
    given = values.select("group", F.col("place").alias("_place"), F.struct("value").alias("_v"))
    both = placed.join(given, ["group", "_place"], "full")
    value = F.col("_v")["value"]
    if column in ranges.columns:
        value = value.cast(ranges.schema[column].dataType)
    value = _fail(F.col("_x").isNull() | F.col("_v").isNull(), "set_column: shapes differ", value).alias(column)
    kept = [value if c == column else F.col("_x")[c].alias(c) for c in ranges.columns]
    return both.select(*kept, *([] if column in ranges.columns else [value]))
