"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that ends a word, as Java regex class content and as plain characters.
WS_CLASS = r"\x20\x09-\x0D"
WS_CHARS = " \t\n\x0b\f\r"

#: Rows that a key table may have to be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only on a local master without it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    at = spark.conf.get("spanforge.local.shared.dir", None)
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="spanforge-shared-")
        spark.conf.set("spanforge.local.shared.dir", at)
    return at


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/spanforge/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: computed once, and lost executors cost no recomputation of what lies before."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most ``rows`` rows (it should be cheap to count); else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: A key with more than one in SHARES of all rows, and with FEW at least, is joined apart from the others.
SHARES, FEW = 2000, 1000


def spread_join(rows: DataFrame, keyed: DataFrame, on: list[str], n: str) -> DataFrame:
    """The inner join of rows with keyed, which has one row per key and in column ``n`` how many rows have it.

    Keys with a large share of the rows would each be one task; there are at most SHARES of these, so they are broadcast
    and their rows stay where they are. keyed should be cheap to read again (written).
    """
    most = max((keyed.agg(F.sum(n)).first()[0] or 0) // SHARES, FEW)
    hot = keyed.where(F.col(n) > most)
    if hot.isEmpty():
        return rows.join(keyed, on)
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keyed.where(F.col(n) <= most), on)
    return rows.join(F.broadcast(hot), on).union(cold)


def whole_ids(docs: DataFrame, doc_id: str) -> None:
    """Refuse ids that are not whole numbers: they are ordered and linked as such."""
    kind = docs.schema[doc_id].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{doc_id} must be a whole number, not {kind}")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def words(text: Column) -> Column:
    """The runs of characters other than WS_CLASS."""
    inner = F.btrim(text, F.lit(WS_CHARS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{WS_CLASS}]+"))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{WS_CLASS}]+"))


def running(lengths: Column) -> Column:
    """Sums of the array before each element. Two levels, so that appending stays cheap for long arrays."""
    step = 256
    zero = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("bigint").alias("sum"))

    def before(xs: Column) -> Column:
        return F.aggregate(
            xs,
            zero,
            lambda a, x: F.struct(F.concat(a["out"], F.array(a["sum"])).alias("out"), (a["sum"] + x).alias("sum")),
        )

    def chunked(xs: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / step).cast("int")), lambda c: before(F.slice(xs, c * step + 1, F.lit(step))))
        return let(
            parts,
            lambda ps: let(
                before(F.transform(ps, lambda p: p["sum"]))["out"],
                lambda base: F.flatten(F.transform(ps, lambda p, i: F.transform(p["out"], lambda x: x + F.get(base, i)))),
            ),
        )

    return let(lengths, lambda xs: F.when(F.size(xs) == 0, F.array().cast("array<bigint>")).otherwise(chunked(xs)))


def bare(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The wanted columns (new name: column of df) and nothing else, so that other columns cannot clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in wanted.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return freed memory of this Python worker to the system, where the C library can: workers live on between tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
