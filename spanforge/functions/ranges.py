"""Column expressions over ranges: closed intervals [start, end] of whole numbers, end = start - 1 for width 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strands in their order.
STRANDS = ("+", "-", "*")


def c(name: str, of: str = "") -> Column:
    """The column ``name``, with ``of`` as a prefix (such as ``q_``)."""
    return F.col(f"`{of}{name}`")


def width(of: str = "") -> Column:
    return c("end", of) - c("start", of) + 1


def strand_id(strand: Column) -> Column:
    """1, 2, 3 for +, -, *."""
    return F.when(strand == "+", 1).when(strand == "-", 2).otherwise(3)


def to_strand(value: Column, kind: str = "string") -> Column:
    """Strand of a string (., empty and null count as *), of 1 / -1 / null (kind number) or of false / true / null (kind boolean); anything else is an error."""
    if kind == "number":
        known = F.when(value.isNull(), "*").when(value == 1, "+").when(value == -1, "-")
    elif kind == "boolean":
        known = F.when(value.isNull(), "*").when(~value, "+").when(value, "-")
    else:
        known = F.when(value.isNull() | value.isin("*", ".", ""), "*").when(value.isin("+", "-"), value)
    return F.coalesce(known, F.raise_error(F.concat(F.lit("not a strand: "), value.cast("string"))))


def invert(strand: Column) -> Column:
    return F.when(strand == "+", "-").when(strand == "-", "+").otherwise(strand)


def compatible(a: Column, b: Column) -> Column:
    """Equal strands, or * on either side."""
    return (a == b) | (a == "*") | (b == "*")


def shared_width(a: str, b: str) -> Column:
    """Positions in both ranges."""
    return F.greatest(F.lit(0), F.least(c("end", a), c("end", b)) - F.greatest(c("start", a), c("start", b)) + 1)


def gap_width(a: str, b: str) -> Column:
    """Positions between two ranges, 0 if they touch or overlap."""
    return F.greatest(F.lit(0), F.greatest(c("start", a), c("start", b)) - F.least(c("end", a), c("end", b)) - 1)


def pair_matches(kind: str, maxgap: int, minoverlap: int, q: str = "q_", s: str = "s_") -> Column:
    """Whether two ranges on one space overlap in the sense of ``kind``.

    any: share a position, or lie at most maxgap positions apart (maxgap 0: adjacent; default -1: a range of width 0 only hits
    where it lies strictly inside). start, end: these ends differ by maxgap at most. within: the query lies in the subject;
    with maxgap 0 or more, widths differ by maxgap at most. equal: start and end. All need ``minoverlap`` shared positions.
    """
    m = max(maxgap, 0)
    starts, ends = F.abs(c("start", q) - c("start", s)) <= m, F.abs(c("end", q) - c("end", s)) <= m
    if kind == "any":
        g = maxgap + 1
        test = (c("start", s) <= c("end", q) + g) & (c("end", s) >= c("start", q) - g)
        if maxgap < 0:  # an empty range shares no position: it must have one on both sides
            test = (c("start", s) <= c("end", q)) & (c("end", s) >= c("start", q))
    elif kind == "start":
        test = starts
    elif kind == "end":
        test = ends
    elif kind == "within":
        test = (c("start", s) <= c("start", q)) & (c("end", q) <= c("end", s))
        if maxgap >= 0:
            test &= width(s) - width(q) <= maxgap
    elif kind == "equal":
        test = starts & ends
    else:
        raise ValueError(f"unknown kind of overlap: {kind}")
    return test & (shared_width(q, s) >= minoverlap) if minoverlap > 0 else test


def compare_code(a: str, b: str) -> Column:
    """How range a lies to range b: -6 before with a gap, -5 adjacent before, -4 overlapping its start, -3 same end from
    before, -2 around it, -1 same start and shorter, 0 equal, and mirrored from 1 (same start, longer) to 6 (after with a gap)."""
    a1, a2, b1, b2 = c("start", a), c("end", a), c("start", b), c("end", b)
    return (
        F.when((a1 == b1) & (a2 == b2), 0)
        .when(a2 < b1 - 1, -6)
        .when((a2 == b1 - 1) & (a1 < b1), -5)
        .when(a1 > b2 + 1, 6)
        .when((a1 == b2 + 1) & (a1 > b1), 5)
        .when((a1 < b1) & (a2 < b2), -4)
        .when((a1 < b1) & (a2 == b2), -3)
        .when((a1 < b1) & (a2 > b2), -2)
        .when((a1 == b1) & (a2 < b2), -1)
        .when(a1 == b1, 1)
        .when((a1 > b1) & (a2 < b2), 2)
        .when((a1 > b1) & (a2 == b2), 3)
        .otherwise(4)
    )
