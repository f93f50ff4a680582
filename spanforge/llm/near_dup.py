"""Near duplicates by Order MinHash and banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sketch
from .align import similar
from .common import give_back, small, spread_join, whole_ids, written
from .components import components

#: Text bytes that are sketched at once.
READ_BYTES = 1 << 20
#: Members of a bucket that one task compares to as many others, and counters of a bag of words.
BLOCK, COUNTERS = 2048, 1024


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")), lo + 1)
        yield lo, hi
        lo = hi


def _with_text(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("bigint").alias("id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, h1 and h2 (of the word sequence), n (words) and keys (of bands) of each row; n is 0 and keys empty without words."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _slices(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), READ_BYTES):
                part = batch.slice(lo, hi - lo)
                words, n = sketch.word_hashes(part.column(1).cast(pa.binary()).to_pylist())
                h1, h2 = sketch.text_hashes(words, n)
                keys = sketch.band_keys(*sketch.shingles(words, n))
                flat = pa.array(keys.view(np.int64).ravel())
                ends = np.concatenate([[0], np.cumsum((n > 0) * keys.shape[1])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(n), lists], ["id", "h1", "h2", "n", "keys"])
            give_back()

    return _with_text(docs, doc_id, text).mapInArrow(run, "id bigint, h1 bigint, h2 bigint, n bigint, keys array<bigint>")


def _word_table(texts: DataFrame) -> DataFrame:
    """id and words (32-bit hashes, packed) of each row of (id, text)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _slices(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), READ_BYTES):
                part = batch.slice(lo, hi - lo)
                words, n = sketch.word_hashes(part.column(1).cast(pa.binary()).to_pylist())
                data, ends = words.astype("<u4").tobytes(), np.cumsum(n) * 4
                runs = [data[a:b] for a, b in zip((ends - n * 4).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(runs, pa.binary())], ["id", "words"])
            give_back()

    return texts.mapInArrow(run, "id bigint, words binary")


def verified(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose word sequences have an edit similarity of ``least`` or more."""
    import pyarrow as pa

    left, right = words.select(F.col("id").alias("a"), F.col("words").alias("wa")), words.select(F.col("id").alias("b"), F.col("words").alias("wb"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [similar(np.frombuffer(x.as_py(), "<u4"), np.frombuffer(y.as_py(), "<u4"), least) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            mask = pa.array(same, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The class of each row: doc_id, class_id (the least doc_id in it), n_words, class_size (rows in the class).

    Two texts are linked if their word sequences (lower-cased runs of digits, letters and characters outside ASCII) have
    an edit similarity, 1 - edit distance / longer length, of ``similarity`` or more; a class is a connected component
    of links. Equal word sequences are one class at once (combined before the shuffle) and then one text. Candidates
    share a band of Order MinHash over occurrence-labelled five-word shingles (see ``sketch``), and only what a banded
    alignment of whole texts confirms is linked.

    Within a band's bucket members are compared to a leader, the least id, first, at about g comparisons for a bucket of g
    texts. That unites large classes, as each of their texts meets leaders in all bands. Then all pairs of a bucket that
    are still in different classes are compared: those whose lengths or bags of words (an exact bound of the edit distance)
    do not rule it out, by alignment. So whatever leads a bucket, no two of its texts that are alike stay apart. A bucket
    that holds many classes costs the square of its members in bounds, in blocks of equal size.

    Ids are whole numbers (else TypeError). A null or wordless text is a class of its own (class_id: its doc_id). Rows
    that share a doc_id share a class. A null doc_id has no class (null). Further columns are ignored. An empty table
    gives no rows.
    """
    return _classed(docs, similarity, doc_id, text)[0]


def _classed(docs: DataFrame, similarity: float, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    whole_ids(docs, doc_id)
    rows = written(sketches(docs, doc_id, text), "sketches")
    classed = F.col("id").isNotNull() & (F.col("n") > 0)
    best = F.min(F.struct("id", "n", "keys"))
    texts = rows.where(classed).groupBy("h1", "h2").agg(best.alias("x"), F.count(F.lit(1)).alias("copies"))
    texts = written(texts.select("h1", "h2", "x.id", "x.n", "x.keys", "copies"), "texts")

    entries = texts.select("id", "n", F.explode("keys").alias("key"))
    leaders = entries.groupBy("key").agg(F.min(F.struct("id", "n")).alias("x"), F.count(F.lit(1)).alias("size")).where("size > 1")
    leaders = written(leaders.select("key", F.col("x.id").alias("leader"), F.col("x.n").alias("leader_n"), "size"), "leaders")
    members = written(spread_join(entries, leaders, ["key"], "size").where(F.col("id") != F.col("leader")), "members")

    near = F.least("n", "leader_n") >= F.greatest("n", "leader_n") * similarity
    pairs = members.where(near).select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    pairs = written(pairs, "pairs")
    needed = members.select("id").union(leaders.select("leader")).distinct()
    words = written(_word_table(_with_text(docs, doc_id, text).join(small(written(needed, "needed")), "id", "left_semi")), "words")

    same_id = _ids_of_many_texts(rows)
    links = written(verified(pairs, words, similarity).union(same_id), "verified")
    roots = components(links)
    apart = written(_apart(texts, members, leaders, roots, words, similarity).join(pairs, ["a", "b"], "left_anti"), "pairs")
    more = written(verified(apart, words, similarity), "verified")
    roots = components(more.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))

    classes = written(texts.join(roots, texts.id == roots.node, "left").select("h1", "h2", F.coalesce("root", "id").alias("class_id"), "copies"), "classes")
    sizes = written(classes.groupBy("class_id").agg(F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("texts")), "sizes")
    classes = written(spread_join(classes, sizes, ["class_id"], "texts").select("h1", "h2", "class_id", "class_size", "copies"), "classes")
    out = spread_join(rows.where(classed), classes, ["h1", "h2"], "copies").select("id", "class_id", "n", "class_size")
    one = F.when(F.col("id").isNotNull(), F.lit(1).cast("bigint"))
    out = out.union(rows.where(~classed).select("id", F.col("id").alias("class_id"), "n", one.alias("class_size")))
    return out.select(F.col("id").alias(doc_id), "class_id", F.col("n").alias("n_words"), "class_size"), rows


def _ids_of_many_texts(rows: DataFrame) -> DataFrame:
    """Links between the texts of rows that share an id."""
    held = rows.where(F.col("id").isNotNull() & (F.col("n") > 0)).select("id", "h1", "h2").distinct()
    shared = held.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("id")
    least = held.groupBy("h1", "h2").agg(F.min("id").alias("a"))
    return held.join(shared, "id", "left_semi").join(least, ["h1", "h2"]).select("a", F.col("id").alias("b"))


def _apart(texts: DataFrame, members: DataFrame, leaders: DataFrame, roots: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of a bucket that are in different classes and that lengths and bags of words leave possible.

    A pair that shares several buckets comes from the one with the least key. That bucket is compared, as the least key
    stands for all buckets with its members.
    """
    heads = leaders.select("key", F.col("leader").alias("id"), F.col("leader_n").alias("n"))
    placed = members.select("key", "id", "n").union(heads).join(roots.withColumnRenamed("node", "id"), "id", "left")
    placed = written(placed.select("key", "id", "n", F.coalesce("root", "id").alias("root")), "placed")
    # buckets of the same members are one
    same = [F.sum(F.xxhash64("id", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in (1, 2)]
    open_ = placed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi"), *same).where("lo < hi")
    open_ = open_.groupBy("size", "s1", "s2").agg(F.min("key").alias("key"))
    open_ = written(open_.select("key", "size", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "open")
    rows = spread_join(placed, open_, ["key"], "size").withColumn("block", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "n", "root")
    rows = rows.join(_bags(words).join(texts.select("id", "keys"), "id"), "id").select("key", "i", "j", "block", "id", "n", "root", "bag", "keys")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "n")
    return rows.mapInArrow(lambda batches: _possible(batches, least), "a bigint, b bigint").distinct()


def _bags(words: DataFrame) -> DataFrame:
    """id and bag of each text: how many words fall on each counter, up to 255."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [np.bincount(np.frombuffer(x.as_py(), "<u4") % COUNTERS, minlength=COUNTERS) for x in batch.column(1)]
            bags = [np.minimum(c, 255).astype(np.uint8).tobytes() for c in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bags, pa.binary())], ["id", "bag"])

    return words.mapInArrow(run, "id bigint, bag binary")


def _possible(batches: Iterator, least: float) -> Iterator:
    """Pairs of each run of rows (key, i, j, block, id, n, root, bag, keys; by rising n) with equal key, i and j."""
    import pyarrow as pa

    held: list[pa.RecordBatch] = []

    def pairs(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        key, i, j, block, ids, n, root = (table.column(k).to_numpy() for k in range(7))
        bags = np.frombuffer(b"".join(table.column(7).to_pylist()), np.uint8).reshape(-1, COUNTERS)
        keys = np.concatenate([c.flatten().to_numpy() for c in table.column(8).chunks]).reshape(len(key), -1)
        new = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        a, b = [], []
        for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(key)], strict=True):
            x, y = possible(ids[lo:hi], n[lo:hi], root[lo:hi], bags[lo:hi], block[lo:hi] if i[lo] != j[lo] else None, least, (int(key[lo]), keys[lo:hi]))
            a.append(x)
            b.append(y)
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(k).to_numpy() for k in range(3)]
        cut = int(np.flatnonzero(np.logical_or.reduce([x != x[-1] for x in last]))[-1]) + 1 if any((x != x[-1]).any() for x in last) else 0
        if cut or (held and any(held[-1].column(k)[-1].as_py() != last[k][-1] for k in range(3))):
            yield pairs([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pairs(held)


def possible(ids: np.ndarray, n: np.ndarray, root: np.ndarray, bags: np.ndarray, block: np.ndarray | None, least: float, bucket: tuple[int, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of texts by rising n, of different roots (and blocks), whose edit similarity may be ``least``: words of the longer one that the shorter one lacks are edits.

    bucket: a key and the texts' keys by band; only pairs are given whose least common key it is.
    """
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    most = ((1 - least) * n + 1e-9).astype(np.int64)
    shortest = n - most
    size = bags.sum(1, dtype=np.int64)
    for k in range(len(ids) - 1):
        # shortest rises with n, so the longer texts that are near in length are the next ones
        end = int(np.searchsorted(shortest, n[k], side="right"))
        ok = root[k + 1 : end] != root[k]
        if block is not None:
            ok &= block[k + 1 : end] != block[k]
        at = np.flatnonzero(ok) + k + 1
        if len(at) and bucket is not None:
            keys = bucket[1][at]
            at = at[np.where(keys == bucket[1][k], keys, np.iinfo(np.int64).max).min(1) == bucket[0]]
        if len(at):
            at = at[size[at] - np.minimum(bags[at], bags[k]).sum(1, dtype=np.uint32) <= most[at]]
            a.append(np.full(len(at), ids[k]))
            b.append(ids[at])
    return np.concatenate(a), np.concatenate(b)


def keep_one(docs: DataFrame, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class of ``near_duplicates``: that with the least doc_id. Rows without a doc_id stay; of rows that share one, that with the least hash of its columns stays."""
    classes, rows = _classed(docs, similarity, doc_id, text)
    classes = written(classes, "class-rows")
    dropped = classes.where(F.col(doc_id) != F.col("class_id")).select(doc_id).distinct()
    kept = docs.join(small(written(dropped, "dropped")), doc_id, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    if rows.where(F.col("id").isNotNull()).groupBy("id").count().where("count > 1").isEmpty():
        return kept
    first = Window.partitionBy("__key").orderBy("__hash")
    keyed = kept.select(F.struct("*").alias("__in"), F.coalesce(F.col(doc_id).cast("string"), F.uuid()).alias("__key"), F.xxhash64(*[F.col(f"`{c}`") for c in kept.columns]).alias("__hash"))
    return keyed.withColumn("__n", F.row_number().over(first)).where("__n = 1").select("__in.*")


def op1_query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
