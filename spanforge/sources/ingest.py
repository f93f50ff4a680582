"""Building tables of ranges from other forms, and writing them out again."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranges import to_strand, width

#: Column names, in lower case, that data frames use (fixed values).
START_NAMES = ["start"]
END_NAMES = ["end", "stop"]
SEQNAMES_NAMES = ["seqnames", "seqname", "chromosome", "chrom", "chr", "chromosome_name", "seqid"]
STRAND_NAMES = ["strand"]


def ranges(spark: SparkSession, seqnames, start, end=None, width=None, strand="*", **attributes) -> DataFrame:
    """A table from lists, numbered by idx from 1; single values are repeated. Two of start, end and width say where."""
    given = {"seqnames": seqnames, "start": start, "end": end, "width": width, "strand": strand, **attributes}
    lists = {k: list(v) for k, v in given.items() if isinstance(v, (list, tuple, range))}
    n = max(map(len, lists.values()), default=1)
    if any(len(v) not in (1, n) for v in lists.values()):
        raise ValueError("columns must have one value or equally many")
    at = lambda k, i: given[k] if k not in lists else lists[k][i if len(lists[k]) > 1 else 0]
    rows = []
    for i in range(n):
        s, e, w = at("start", i), at("end", i), at("width", i)
        if sum(x is None for x in (s, e, w)) > 1:
            raise ValueError("give two of start, end and width")
        s = e - w + 1 if s is None else s
        e = s + w - 1 if e is None else e
        if e < s - 1 or at("seqnames", i) is None or at("strand", i) not in ("+", "-", "*"):
            raise ValueError(f"row {i + 1} is not a range")
        rows.append((i + 1, at("seqnames", i), s, e, at("strand", i), *[at(k, i) for k in attributes]))
    frame = spark.createDataFrame(rows, ["idx", "seqnames", "start", "end", "strand", *attributes]) if rows else spark.createDataFrame([], "idx bigint, seqnames string, start int, end int, strand string")
    return frame.withColumns({"start": F.col("start").cast("int"), "end": F.col("end").cast("int")})


def checked(df: DataFrame) -> DataFrame:
    """df, failing when read on a row that is not a range: null coordinates, space or strand, an unknown strand or a width below 0."""
    ok = F.col("seqnames").isNotNull() & F.coalesce(F.col("end") >= F.col("start") - 1, F.lit(False)) & F.coalesce(F.col("strand").isin("+", "-", "*"), F.lit(False))
    return df.withColumn("seqnames", F.when(ok, F.col("seqnames")).otherwise(F.raise_error(F.lit("not a range"))))


def positions(df: DataFrame) -> DataFrame:
    """One row of each position of each range (idx of the range, seqnames, pos, strand and its other columns)."""
    others = [c for c in df.columns if c not in ("start", "end")]
    return df.where("end >= start").select(*others, F.explode(F.sequence("start", "end")).alias("pos"))


def from_positions(df: DataFrame) -> DataFrame:
    others = [c for c in df.columns if c != "pos"]
    return df.select(*others, F.col("pos").alias("start"), F.col("pos").alias("end"))


def as_positions(df: DataFrame) -> DataFrame:
    """Ranges of width 1 as positions; an error for others."""
    others = [c for c in df.columns if c not in ("start", "end")]
    return df.select(*others, F.when(width() == 1, F.col("start")).otherwise(F.raise_error(F.lit("a range is not one position"))).alias("pos"))


def resolve_columns(columns: list[str], seqnames: list[str] | None = None, start: list[str] | None = None, end: list[str] | None = None, strand: list[str] | None = None, ignore_strand: bool = False) -> dict[str, str | None]:
    """Which columns hold seqnames, start, end, width and strand, whatever their case.

    One column for start and one for end must match; if none of either does, a common prefix may make them match (txStart,
    txEnd). seqnames, strand and width are looked for with that prefix first. Several matches are an error (not for width).
    """
    lower = [c.lower() for c in columns]
    starts, ends, names, strands = ([x.lower() for x in (given or usual)] for given, usual in ((start, START_NAMES), (end, END_NAMES), (seqnames, SEQNAMES_NAMES), (strand, STRAND_NAMES)))
    at = lambda wanted: [i for i, c in enumerate(lower) if c in wanted]
    s, e, prefix = at(starts), at(ends), ""
    if not s and not e:
        heads = lambda wanted: {c[: -len(w)] for c in lower for w in wanted if c.endswith(w)}
        common = heads(starts) & heads(ends)
        if len(common) == 1:
            prefix = common.pop()
            s, e = at([prefix + x for x in starts]), at([prefix + x for x in ends])
    if len(s) != 1 or len(e) != 1:
        raise ValueError("cannot tell which columns hold start and end")

    def other(wanted: list[str], what: str, needed: bool) -> str | None:
        for p in dict.fromkeys([prefix, ""]):
            found = at([p + x for x in wanted])
            if len(found) == 1:
                return columns[found[0]]
            if len(found) > 1 and what != "width":
                raise ValueError(f"cannot tell which column holds {what}")
        if needed:
            raise ValueError(f"no column holds {what}")
        return None

    return {
        "seqnames": other(names, "seqnames", True), "start": columns[s[0]], "end": columns[e[0]],
        "width": other(["width"], "width", False), "strand": None if ignore_strand else other(strands, "strand", False),
    }


def from_frame(df: DataFrame, keep_extra: bool = False, ignore_strand: bool = False, zero_based_starts: bool = False, na_rm: bool = False, idx: str | None = None, **fields: list[str]) -> DataFrame:
    """Ranges from any table; columns are found by ``resolve_columns`` (fields: its seqnames, start, end and strand). Starts can be 0-based.
    Rows without coordinates are an error, or go with na_rm. idx: a unique column to keep as such."""
    found = resolve_columns(df.columns, ignore_strand=ignore_strand, **fields)
    start = F.col(f"`{found['start']}`").cast("int") + int(zero_based_starts)
    end = F.col(f"`{found['end']}`").cast("int")
    strand = F.lit("*") if found["strand"] is None else to_strand(F.col(f"`{found['strand']}`").cast("string"))
    used = {v for v in found.values() if v} | ({idx} if idx else set())
    extra = [F.col(f"`{c}`") for c in df.columns if c not in used] if keep_extra else []
    out = df.select(*([F.col(f"`{idx}`").alias("idx")] if idx else []), F.col(f"`{found['seqnames']}`").cast("string").alias("seqnames"), start.alias("start"), end.alias("end"), strand.alias("strand"), *extra)
    if na_rm:
        return out.where("start IS NOT NULL AND end IS NOT NULL")
    return out.withColumn("start", F.when(F.col("start").isNotNull() & F.col("end").isNotNull(), F.col("start")).otherwise(F.raise_error(F.lit("a row has no start or end"))))


def list_from_frame(df: DataFrame, split: str, names: str | None = None, **how) -> DataFrame:
    """A list of ranges (group, group_name) by the values of a column; names: a column that becomes ``name``."""
    from ..operators.lists import split_by

    return split_by(from_frame(df.withColumn("__split", F.col(split)), keep_extra=True, **how), "__split").drop("__split", split).withColumnsRenamed({names: "name"} if names else {})


#: space : start - end, or .. between, or one position; then : and a strand. White space around numbers, signs and exponents are fine.
_NUMBER = r"\s*([+-]?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?)\s*"
_RANGE = rf"^\s*(.+?)\s*:{_NUMBER}(?:(?:-|\.\.){_NUMBER})?(?::\s*([+*-]?)\s*)?$"


def parse(df: DataFrame, text: str) -> DataFrame:
    """df with seqnames, start, end and strand read from a column of strings; numbers with a fraction are cut; no strand is *; an error for other strings."""
    part = lambda i: F.regexp_extract(F.col(text), _RANGE, i)
    number = lambda c: F.floor(c.cast("double")).cast("int")
    start = number(F.when(F.col(text).rlike(_RANGE), part(2)).otherwise(F.raise_error(F.concat(F.lit("not a range: "), F.coalesce(F.col(text), F.lit("null"))))))
    end = F.when(part(3) == "", start).otherwise(number(F.when(part(3) != "", part(3))))
    strand = F.when(part(4) == "", "*").otherwise(part(4))
    good = F.when(end >= start - 1, end).otherwise(F.raise_error(F.concat(F.lit("not a range: "), F.col(text))).cast("int"))
    return df.withColumns({"seqnames": part(1), "start": start, "end": good, "strand": strand})


def formatted(df: DataFrame, ignore_strand: bool = False, name: str = "text") -> DataFrame:
    """df with its ranges as strings: space:start-end:strand (space:start for one position); without strands if all are *."""
    where = F.when(width() == 1, F.col("start").cast("string")).otherwise(F.concat("start", F.lit("-"), "end"))
    bare = F.concat("seqnames", F.lit(":"), where)
    if ignore_strand:
        return df.withColumn(name, bare)
    stranded = df.agg(F.coalesce(F.max((F.col("strand") != "*").cast("int")), F.lit(0)).alias("_any"))
    return df.crossJoin(F.broadcast(stranded)).withColumn(name, F.when(F.col("_any") == 1, F.concat(bare, F.lit(":"), "strand")).otherwise(bare)).drop("_any")  # one row on the other side


def as_frame(df: DataFrame) -> DataFrame:
    """seqnames, start, end, width, strand, then the other columns."""
    core = ["seqnames", "start", "end", "strand"]
    return df.select("seqnames", "start", "end", width().alias("width"), "strand", *[c for c in df.columns if c not in core])


def coordinates(df: DataFrame, attributes: bool = False) -> DataFrame:
    """Coordinates alone, or with attributes."""
    return df if attributes else df.select(*[c for c in ("group", "group_name", "idx", "seqnames", "start", "end", "strand") if c in df.columns])


def from_fragments(df: DataFrame, starts: str, ends: str | None = None, widths: str | None = None, sep: str = ",", offset: Column | int = 0) -> DataFrame:
    """One row per fragment of features whose starts and ends (or widths) are strings of numbers: df's other columns, part (1 ..), start, end. A separator at the end is fine; numbers of fragments must agree."""
    numbers = lambda c: F.transform(F.filter(F.split(F.trim(F.col(c).cast("string")), re.escape(sep)), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("int"))
    second = ends or widths
    if second is None or (ends and widths):
        raise ValueError("give ends or widths")
    a, b = numbers(starts), numbers(second)
    same = F.when(F.size(a) == F.size(b), a).otherwise(F.raise_error(F.lit("as many starts as ends are needed")))
    cut = df.withColumn("_f", F.arrays_zip(same.alias("a"), b.alias("b"))).select(*[c for c in df.columns if c not in (starts, second)], F.posexplode("_f").alias("_k", "_x"))
    lo = F.col("_x")["0"] if "0" in cut.schema["_x"].dataType.names else F.col("_x.a")
    hi = F.col("_x")["1"] if "1" in cut.schema["_x"].dataType.names else F.col("_x.b")
    first = lo + offset
    last = first + hi - 1 if widths else hi + offset
    return cut.withColumns({"part": F.col("_k") + 1, "start": first, "end": last}).drop("_k", "_x")


def whole_spaces(seqinfo: DataFrame) -> DataFrame:
    """One range from 1 to the length of each space; an error for an unknown length."""
    end = F.when(F.col("seqlength").isNotNull(), F.col("seqlength")).otherwise(F.raise_error(F.concat(F.lit("unknown length of "), F.col("seqnames"))))
    return seqinfo.select(F.col("seqid").cast("bigint").alias("idx"), "seqnames", F.lit(1).alias("start"), end.alias("end"), F.lit("*").alias("strand"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Ranges from a BED file (tab-separated, 0-based starts): seqnames, start, end, and name, score and strand, null (*) where missing."""
    raw = spark.read.text(path).where("NOT value RLIKE '^(#|track|browser)' AND trim(value) <> ''").select(F.split("value", "\t").alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    return raw.select(at(0).alias("seqnames"), (at(1).cast("int") + 1).alias("start"), at(2).cast("int").alias("end"), to_strand(at(5)).alias("strand"), at(3).alias("name"), at(4).try_cast("double").alias("score"))


def write_bed(df: DataFrame, path: str) -> None:
    """One line per range: space, 0-based start, end, name, score and strand; . for what is missing."""
    has = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(".")) if c in df.columns else F.lit(".")
    strand = F.when(F.col("strand") == "*", ".").otherwise(F.col("strand"))
    df.select(F.concat_ws("\t", "seqnames", F.col("start") - 1, "end", has("name"), has("score"), strand).alias("value")).write.text(path)
