"""Named checks of tables, from general to special; the first that fails is reported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name: (name of the constraint that it refines or None, columns it needs, condition that every row must meet)
_CONSTRAINTS: dict[str, tuple[str | None, list[str], Callable[[], Column]]] = {}


def define(name: str, needs: list[str], holds: Callable[[], Column], refines: str | None = None) -> None:
    if refines is not None and refines not in _CONSTRAINTS:
        raise ValueError(f"unknown constraint: {refines}")
    _CONSTRAINTS[name] = (refines, needs, holds)


def chain(name: str) -> list[str]:
    """The constraint after all that it refines."""
    out: list[str] = []
    at: str | None = name
    while at is not None:
        out.insert(0, at)
        at = _CONSTRAINTS[at][0]
    return out


def violations(df: DataFrame, name: str) -> DataFrame:
    """One row, failed: the first constraint of the chain that a column or a row fails, null if none does. One aggregate over the table."""
    missing = next((k for k in chain(name) if not set(_CONSTRAINTS[k][1]) <= set(df.columns)), None)
    usable = chain(name)[: chain(name).index(missing)] if missing else chain(name)
    bad = [F.coalesce(F.max((~F.coalesce(_CONSTRAINTS[k][2](), F.lit(False))).cast("int")), F.lit(0)).alias(k) for k in usable]
    counted = df.agg(*bad) if bad else df.sparkSession.range(1)
    failed = F.coalesce(*[F.when(F.col(f"`{k}`") == 1, k) for k in usable], F.lit(missing).cast("string"))
    return counted.select(failed.alias("failed"))


define("ranges", ["seqnames", "start", "end", "strand"], lambda: F.col("seqnames").isNotNull() & (F.col("end") >= F.col("start") - 1) & F.col("strand").isin("+", "-", "*"))
define("stranded", ["strand"], lambda: F.col("strand") != "*", refines="ranges")
define("positions", ["start", "end"], lambda: F.col("start") == F.col("end"), refines="ranges")
