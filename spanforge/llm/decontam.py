"""Removal of benchmark passages from documents."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, written
from .fm_index import FMIndex

#: A-Z to lower case; what is no word byte (0-9, a-z, all of 0x80 and above) to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Characters of benchmark text in a block, indexed symbols in a shard, and text bytes read at once.
BLOCK_CHARS, SHARD_SYMBOLS, READ_BYTES = 16 << 20, 1 << 20, 4 << 20
#: Blocks searched before the documents are written in between.
CHAIN = 8


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Phrases:
    """Windows of ``window`` words of a block of items; an item of fewer words is one window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.item_ids = [i for i, _ in items]
        found: dict[tuple[int, ...], set[int]] = {}
        for k, (_, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            for at in range(max(len(ids) - window + 1, 1) if ids else 0):
                found.setdefault(tuple(ids[at : at + window]), set()).add(k)
        self.shortest = min(map(len, found), default=0)
        self.by_length: list[tuple[np.ndarray, list[np.ndarray]]] = []
        for n in sorted({len(p) for p in found}):
            here = [p for p in found if len(p) == n]
            self.by_length.append((np.array(here, np.int64), [np.array(sorted(found[p])) for p in here]))


def _marked(ids: np.ndarray, sizes: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, list[set[int]]]:
    """Which words of the texts are hit (ids: symbols of all words, 0 for those outside the vocabulary), and the items of each text."""
    n, hit, items = len(ids), np.zeros(len(ids) + 1, np.int64), [set() for _ in sizes]
    ends = np.cumsum(sizes)
    known = ids > 0
    # runs of known words within a text; those too short for any phrase cannot hold one
    breaks = np.zeros(n + 1, bool)
    breaks[np.concatenate([[0], ends])] = True
    first = known & (breaks[:n] | ~np.concatenate([[False], known[:-1]]))
    begin = np.flatnonzero(first)
    last = known & (breaks[1:] | ~np.concatenate([known[1:], [False]]))
    end = np.flatnonzero(last) + 1
    long = end - begin >= phrases.shortest
    begin, end = begin[long], end[long]
    shard = 0
    while shard < len(begin):
        more = int(np.searchsorted(np.cumsum(end[shard:] - begin[shard:]), SHARD_SYMBOLS, side="right"))
        b, e = begin[shard : shard + max(more, 1)], end[shard : shard + max(more, 1)]
        shard += len(b)
        length = e - b
        ends_in = np.cumsum(length + 1)
        text = np.zeros(int(ends_in[-1]), np.int64)
        origin = np.full(len(text), -1, np.int64)
        place = np.repeat(ends_in - length - 1 - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        source = np.repeat(b - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        text[place], origin[place] = ids[source], source
        index = FMIndex(text, len(phrases.vocabulary) + 1)
        for rows, owners in phrases.by_length:
            low, high = index.search(rows)
            which = np.flatnonzero(high > low)
            count = (high - low)[which]
            at = np.repeat(low[which] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            where = origin[index.locate(at)]
            np.add.at(hit, where, 1)
            np.add.at(hit, where + rows.shape[1], -1)
            doc = np.searchsorted(ends, where, side="right")
            for d, p in set(zip(doc.tolist(), np.repeat(which, count).tolist(), strict=True)):
                items[d].update(owners[p].tolist())
    return np.cumsum(hit[:n]) > 0, items


def _spans(hit: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edge.reshape(-1, 2).tolist()


def _blocks(benchmark: DataFrame, window: int, item_id: str, text: str) -> list[Broadcast]:
    """The benchmark as broadcast blocks of about BLOCK_CHARS characters. Blocks are read one by one, by hash of the text."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.col(text).cast("binary").alias("t")).where(F.col("t").isNotNull())
    total = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    n = total // BLOCK_CHARS + 1
    out = []
    for k in range(n):
        items = sorted((r["i"], bytes(r["t"])) for r in rows.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k).collect())
        out.append(spark.sparkContext.broadcast(Phrases(items, window)))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: Column | None = None, cut: bool = False) -> DataFrame:
    """Words of benchmark windows in each row's whole text: id, n_words, n_hit, spans (word from, to), items (their ids, sorted as strings), and ``keep`` (any column; default null).

    Words are runs of bytes that are digits, letters or outside ASCII, A-Z lower-cased. A window is ``window`` words in a
    row of an item; an item of fewer is one window; a null or wordless one has none. An item with a null id goes by the
    name null; items with the same id count once. A null or empty text has no words. Rows count for themselves where
    ids repeat or are null; further columns are ignored. Empty tables give no rows, or no hits.

    Each shard of the rows read together gets an FM-index of its words, in symbols of the block's vocabulary. Words outside
    it end a fragment, and fragments shorter than the shortest window are left out: neither can be part of an occurrence.
    All windows are searched backward at once by wavelet-tree ranks, occurrences located by sampled suffix positions
    and merged as spans. The benchmark is dealt with in blocks of bounded size, each broadcast; documents are not shuffled.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    payload = F.lit(None).cast("boolean") if keep is None else keep
    state = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), payload.alias("keep"))
    state = state.select("*", F.lit(0).cast("bigint").alias("n_words"), F.array().cast("array<bigint>").alias("hits"), F.array().cast("array<string>").alias("items"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema)

    blocks = _blocks(benchmark, window, item_id, item_text)
    for k, block in enumerate(blocks):

        def run(batches: Iterator[pa.RecordBatch], block: Broadcast = block, cut: bool = cut and k == len(blocks) - 1) -> Iterator[pa.RecordBatch]:
            phrases = block.value
            for batch in batches:
                size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
                lo = 0
                while lo < batch.num_rows:
                    hi = max(int(np.searchsorted(size, (size[lo - 1] if lo else 0) + READ_BYTES, side="right")), lo + 1)
                    yield _searched(batch.slice(lo, hi - lo), phrases, cut)
                    lo = hi
                give_back()

        state = state.mapInArrow(run, schema)
        if k % CHAIN == CHAIN - 1:  # a plan of very many passes could not be run
            state = written(state, "decontaminated")

    return state.select(
        "id",
        "n_words",
        F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, x: a + (x % (1 << 31)) - F.shiftright(x, 31)).alias("n_hit"),
        F.transform("hits", lambda x: F.struct(F.shiftright(x, 31).alias("start"), (x % (1 << 31)).alias("end"))).alias("spans"),
        F.array_sort(F.array_distinct("items")).alias("items"),
        "keep",
        "text",
    )


def _searched(batch, phrases: Phrases, cut: bool):
    """The batch with this block's spans (start and end packed into one number) and items added, and cut out of the text if told."""
    import pyarrow as pa

    texts = batch.column(1).cast(pa.binary()).to_pylist()
    found = [np.fromiter(map(phrases.vocabulary.get, w := words(t), repeat(0)), np.int32, len(w)) for t in texts]
    sizes = np.array([len(f) for f in found], np.int64)
    hit, items = _marked(np.concatenate(found).astype(np.int64), sizes, phrases)
    spans, names = batch.column(4).to_pylist(), batch.column(5).to_pylist()
    for k, (e, n) in enumerate(zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True)):
        if not items[k]:
            continue
        mine = hit[e - n : e]
        for x in spans[k]:
            mine[x >> 31 : x & 0x7FFFFFFF] = True
        spans[k] = [a << 31 | b for a, b in _spans(mine)]
        names[k] = sorted({*names[k], *(phrases.item_ids[i] for i in items[k])})
    new_text = batch.column(1)
    if cut:
        new_text = pa.array([_without(t, s).encode() if s else t for t, s in zip(texts, spans, strict=True)], pa.binary()).cast(pa.string())
    columns = [batch.column(0), new_text, batch.column(2), pa.array(sizes), pa.array(spans, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, batch.schema.names)


def drop_passages(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without benchmark passages: each span of hit words goes, with what stands between them, and the rest is joined by a space; all columns, other texts as they are."""
    others = [c for c in docs.columns if c != text]
    keep = F.struct(F.col(text).isNull().alias("__null"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    out = contamination(docs.withColumn("__id", F.lit(0)), benchmark, window, "__id", text, item_id, item_text, keep, cut=True)
    back = {c: F.col(f"keep.c{i}") for i, c in enumerate(others)} | {text: F.when(~F.col("keep.__null"), F.col("text"))}
    return out.select(*[back[c].alias(c) for c in docs.columns])


def _without(data: bytes, spans: list[int]) -> str:
    """The text without words start to end of each span (packed as above)."""
    word = np.frombuffer(data.translate(_FOLD), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], word.astype(np.int8), [0]]))).reshape(-1, 2)
    parts, at = [], 0
    for x in spans:
        parts.append(data[at : edge[x >> 31, 0]])
        at = int(edge[(x & 0x7FFFFFFF) - 1, 1])
    parts.append(data[at:])
    kept = [p.decode() for p in parts]
    return " ".join(k.strip() for k in kept if k.strip())


def op8_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    names = F.array_join("items", ",")
    return contamination(docs, benchmark).select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_SQL_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, k, k + 9), ' ') AS phrase FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(k) WHERE len(w) > 0),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d),
g AS (SELECT doc_id, k, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS phrase FROM places, (SELECT DISTINCT n FROM p) WHERE k + n - 1 <= len(w)),
h AS (SELECT doc_id, k, g.n, item FROM g JOIN p ON g.n = p.n AND g.phrase = p.phrase),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS pos FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
