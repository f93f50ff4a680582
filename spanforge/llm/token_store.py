"""Texts as token ids in compressed files, in order of their ids."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, shared_path, whole_ids, written
from .huffman import Code, code_lengths
from .sketch import mix, run_hashes

#: Compressed bytes that a shard file aims at, and shards at most.
SHARD_BYTES, MOST_SHARDS = 64 << 20, 1 << 16
#: Text bytes that are encoded, and ids that are coded, at once; working arrays take about a hundred times as much.
READ_BYTES, CODE_IDS = 1 << 20, 1 << 18
_encoders: dict[str, Encoder] = {}


class WordTable:
    """Numbers of words known by a 64-bit hash, their length and their first eight bytes; open addressing in numpy arrays, at most half full."""

    def __init__(self, bits: int = 16):
        self.n = 0
        self._empty(bits)

    def _empty(self, bits: int) -> None:
        self.mask = (1 << bits) - 1
        self.hash = np.zeros(1 << bits, np.uint64)
        self.check = np.zeros(1 << bits, np.uint64)
        self.number = np.full(1 << bits, -1, np.int32)

    def find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for those not there."""
        out = np.full(len(h), -1, np.int32)
        todo = np.arange(len(h))
        slot = (h & np.uint64(self.mask)).astype(np.int64)
        while len(todo):
            number = self.number[slot]
            same = (self.hash[slot] == h[todo]) & (self.check[slot] == check[todo]) & (number >= 0)
            out[todo[same]] = number[same]
            on = ~same & (number >= 0)
            todo, slot = todo[on], (slot[on] + 1) & self.mask
        return out

    def add(self, h: np.ndarray, check: np.ndarray, number: np.ndarray) -> None:
        """Words that are not there, each once."""
        self.n += len(h)
        if 2 * self.n > self.mask:
            there = np.flatnonzero(self.number >= 0)
            h, check, number = (np.concatenate([old[there], new]) for old, new in ((self.hash, h), (self.check, check), (self.number, number)))
            self._empty((2 * self.n).bit_length() + 1)
        todo = np.arange(len(h))
        slot = (h & np.uint64(self.mask)).astype(np.int64)
        while len(todo):
            free = self.number[slot] < 0
            at, first = np.unique(np.where(free, slot, -1), return_index=True)
            first = first[at >= 0]
            put, where = todo[first], slot[first]
            self.hash[where], self.check[where], self.number[where] = h[put], check[put], number[put]
            left = np.ones(len(todo), bool)
            left[first] = False
            todo, slot = todo[left], (slot[left] + 1) & self.mask


class Encoder:
    """The ids a tokenizers file gives, remembered by word where the file drops white space and case.

    If its pre-tokenizer keeps only runs of letters, digits and other characters, a text's ids are those of its words one
    after the other, and a word may be cut between an ASCII letter and a mark of punctuation. A-Z are lower-cased first,
    unless the text holds combining accents (which join upper-case letters otherwise) or what may be a special token.
    Words not seen before are encoded together, with a separator between them that is one token of its own. Words are
    told apart by 128 bits (a hash; length and first eight bytes). The memory is emptied at ``most`` words; it grows
    beyond where one batch has more.
    """

    SEPARATORS = "~^`|§¤"
    LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b in b"\t\n\r" else b for b in range(256))
    SPACE = bytes(32 if b in b"\t\n\r" else b for b in range(256))
    MARKS = np.isin(np.arange(256), np.frombuffer(b",.!?;:#*$%&|", np.uint8))
    SPECIAL = (b"<|", b"\xcc", b"\xcd")

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.n_ids = self.tokenizer.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as f:
            self.by_word = _drops_white_space(json.load(f))
        single = [(c, ids[0]) for c in self.SEPARATORS if len(ids := self.tokenizer.encode(c, add_special_tokens=False).ids) == 1]
        self.separator = single[0] if single else None
        self._forget()
        give_back()

    def _forget(self) -> None:
        self.table, self.n_words = WordTable(), 0
        self.size = np.zeros(1 << 16, np.int64)
        self.start = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.n_flat = 0

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, words: list[str]) -> list[np.ndarray]:
        sep = self.separator
        joined = [i for i, w in enumerate(words) if sep and sep[0] not in w]
        alone = [i for i, w in enumerate(words) if not sep or sep[0] in w]
        parts: list = [None] * len(words)
        for lo in range(0, len(joined), 20_000):
            here = joined[lo : lo + 20_000]
            ids = np.array(self._plain([f" {sep[0]} ".join([words[i] for i in here])])[0], np.uint32)
            split = np.split(ids, np.flatnonzero(ids == sep[1]))
            assert len(split) == len(here)
            for k, i in enumerate(here):
                parts[i] = split[k][1:] if k else split[k]  # each part but the first begins with the separator
        for i, ids in zip(alone, self._plain([words[i] for i in alone]) if alone else [], strict=True):
            parts[i] = np.array(ids, np.uint32)
        return parts

    def _learn(self, words: list[str], h: np.ndarray, check: np.ndarray) -> None:
        parts = self._encoded(words)
        base, end = self.n_words, self.n_words + len(parts)
        sizes, flat = np.array([len(p) for p in parts], np.int64), np.concatenate(parts)
        self.size, self.start = _room(self.size, end), _room(self.start, end)
        self.size[base:end] = sizes
        self.start[base:end] = self.n_flat + np.cumsum(sizes) - sizes
        self.flat = _room(self.flat, self.n_flat + len(flat))
        self.flat[self.n_flat : self.n_flat + len(flat)] = flat
        self.n_flat += len(flat)
        self.table.add(h, check, np.arange(base, end, dtype=np.int32))
        self.n_words = end

    def encode(self, texts: list[bytes], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts (UTF-8), each with ``end`` appended, and how many each has."""
        if not self.by_word:
            ids = [x + ([] if end is None else [end]) for x in self._plain([t.decode() for t in texts])]
            return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)
        if self.n_words > self.most:
            self._forget()
        as_is = [any(x in t for x in self.SPECIAL) for t in texts]
        data = b" ".join([t.translate(self.SPACE if keep else self.LOWER) for t, keep in zip(texts, as_is, strict=True)]) + b" " * 9
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        values = np.frombuffer(data, np.uint8)
        cuts = np.flatnonzero(self.MARKS[values[1:]] & (values[:-1] >= 97) & (values[:-1] <= 122)) + 1
        if any(as_is):
            cuts = cuts[~np.array(as_is)[np.searchsorted(text_ends, cuts, side="right")]]
        h, check, begin, stop = _word_keys(values, cuts)
        at = self.table.find(h, check)
        if len(unknown := np.flatnonzero(at < 0)):
            _, first = np.unique(h[unknown], return_index=True)
            new = unknown[first]
            spans = zip(begin[new].tolist(), stop[new].tolist(), strict=True)
            self._learn([data[b:e].decode() for b, e in spans], h[new], check[new])
            at[unknown] = self.table.find(h[unknown], check[unknown])
        ends = np.searchsorted(begin, text_ends)
        size = self.size[at]
        sums = np.concatenate([[0], np.cumsum(size)])
        per_text = np.diff(sums[ends], prepend=0)
        ids = self.flat[np.repeat(self.start[at] - sums[:-1], size) + np.arange(int(sums[-1]))]
        if end is not None:
            ids = np.insert(ids, np.cumsum(per_text), end)
            per_text = per_text + 1
        return ids, per_text


def _word_keys(values: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of other bytes than spaces, cut where told: a hash, a check (its first eight bytes and length) and where it begins and ends."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (values != 32).view(np.int8)])))
    begin, stop = np.sort(np.concatenate([edge[0::2], cuts]), kind="stable"), np.sort(np.concatenate([edge[1::2], cuts]), kind="stable")
    length = (stop - begin).astype(np.uint64)
    h = mix(run_hashes(values.astype(np.uint64), begin, stop) ^ length)
    head = np.lib.stride_tricks.sliding_window_view(values, 8)[begin].copy().view("<u8")[:, 0]
    short = np.minimum(length, np.uint64(8)) * np.uint64(8)
    masked = np.where(length < 8, head & ((np.uint64(1) << (short & np.uint64(63))) - np.uint64(1)), head)
    return h, mix(masked) + length, begin, stop


def _room(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])


def _drops_white_space(spec: dict) -> bool:
    """Whether the pre-tokenizer keeps only runs of letters, single digits and runs of other characters than white space."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    first = steps[0] if steps else {}
    pattern = (first.get("pattern") or {}).get("Regex", "")
    kinds = {"NFC", "Replace", "Lowercase"}
    normal = all(n["type"] in kinds for n in (spec.get("normalizer") or {}).get("normalizers", [{"type": ""}]))
    added = all(not t["lstrip"] and not t["rstrip"] and not set(t["content"]) & set(" \t\r\n") for t in spec.get("added_tokens", []))
    alternatives = set(pattern.split("|")) - {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d", r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"}
    return normal and added and not alternatives and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and all(s["type"] == "ByteLevel" and not s["add_prefix_space"] for s in steps[1:])


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _groups(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` in all, or one row."""
    lo = 0
    while lo < len(sizes):
        hi = max(int(np.searchsorted(np.cumsum(sizes[lo:]), most, side="right")), 1) + lo
        yield lo, hi
        lo = hi


def tokenized(docs: DataFrame, tokenizer: str, end: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, tie (a hash of the text), n_tokens and ids (little-endian unsigned 32-bit, or 16-bit if all fit) of each row's whole text (null: empty)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    text_or_empty = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.xxhash64(text_or_empty).alias("tie"), text_or_empty.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        kind = np.dtype("<u2" if max(enc.n_ids - 1, end or 0) < 1 << 16 else "<u4")
        for batch in batches:
            for lo, hi in _groups(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False), READ_BYTES):
                part = batch.slice(lo, hi - lo)
                ids, sizes = enc.encode(part.column(2).cast(pa.binary()).to_pylist(), end)
                data, ends = ids.astype(kind).tobytes(), np.cumsum(sizes) * kind.itemsize
                runs = [data[a:b] for a, b in zip((ends - sizes * kind.itemsize).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes), pa.array(runs, pa.binary())], ["id", "tie", "n_tokens", "ids"])
            give_back()

    return rows.mapInArrow(run, "id bigint, tie bigint, n_tokens bigint, ids binary")


def _ids(batch, column: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    runs = batch.column(column).to_pylist()
    width = sum(map(len, runs)) // max(int(sizes.sum()), 1)
    return np.frombuffer(b"".join(runs), "<u4" if width == 4 else "<u2"), sizes


def global_counts(ids: DataFrame) -> np.ndarray:
    """How often each id occurs; as many numbers as the vocabulary has."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                here = np.bincount(_ids(part, 1, part.column(0).to_numpy())[0])
                total = _room(total, len(here)) if len(total) else np.zeros(len(here), np.int64)
                total[: len(here)] += here
        give_back()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    found = ids.select("n_tokens", "ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max([r["id"] for r in found], default=-1) + 1, np.int64)
    for r in found:
        out[r["id"]] = r["n"]
    return out


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int | None = None, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write each row's token ids under path, in ascending order of doc_id (null first; rows with the same id in order of a hash of their texts).

    Format: ``path/code`` has the canonical code (one row per id in use: id, length); ``path/rows`` has shard files, each
    a range of ids, numbered in order: id, tie, n_tokens, marks (bit offsets of every 128th token) and bits, the ids in a
    canonical Huffman code of limited length from counts over all rows. A row's bits start on a byte, so rows are
    independent blocks, and decoding can start at any mark of a long one. Files are written by Spark's own writer, so a
    lost executor leaves nothing half-written. Texts are encoded once; only compressed ids are shuffled, dealt by
    quantiles of doc_id; a value that many rows share is dealt on by hash. Ids are whole numbers (else TypeError).
    """
    import pyarrow as pa

    whole_ids(docs, doc_id)
    spark = docs.sparkSession
    ids = written(tokenized(docs, tokenizer, end, doc_id, text), "token-ids")
    counts = global_counts(ids)
    used = int((counts > 0).sum())
    lengths = code_lengths(counts, max(15, (max(used, 2) - 1).bit_length() + 2))
    code = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(code, "id bigint, length int").coalesce(1).write.parquet(f"{path}/code")
    n_shards = int(min(max(-(-int((counts * lengths).sum()) // 8 // SHARD_BYTES), spark.sparkContext.defaultParallelism), MOST_SHARDS))
    at = [k / n_shards for k in range(1, n_shards)]
    cuts = ids.select(F.percentile_approx("id", at, 20_000)).first()[0] if at else None
    bounds, shared_code = np.array(cuts or [], np.int64), spark.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Code(shared_code.value)
        for batch in batches:
            for lo, hi in _groups(batch.column(2).to_numpy(), CODE_IDS):
                part = batch.slice(lo, hi - lo)
                bits, marks = coder.encode(*_ids(part, 3, part.column(2).to_numpy()))
                key, tie = part.column(0).fill_null(-(1 << 63)).to_numpy(), part.column(1).to_numpy()
                low, high = np.searchsorted(bounds, key, "left"), np.searchsorted(bounds, key, "right")
                share = (tie.astype(np.float64) + 2.0**63) / 2.0**64
                shard = np.minimum(low + (share * (high - low + 1)).astype(np.int64), high)
                packed = [m.astype("<u8").tobytes() for m in marks]
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), part.column(0), part.column(1), part.column(2), pa.array(packed, pa.binary()), pa.array(bits, pa.binary())], ["shard", "id", "tie", "n_tokens", "marks", "bits"])
            give_back()

    coded = ids.mapInArrow(run, "shard int, id bigint, tie bigint, n_tokens bigint, marks binary, bits binary")
    coded.repartitionById(n_shards, "shard").sortWithinPartitions("id", "tie").write.parquet(f"{path}/rows")


def decoded(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """shard, id, tie, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and, if asked for, ids, from the files under path."""
    import pyarrow as pa

    code = spark.read.parquet(f"{path}/code").collect()  # as many rows as ids are in use
    lengths = np.zeros(max([r["id"] for r in code], default=0) + 1, np.uint8)
    for r in code:
        lengths[r["id"]] = r["length"]
    shared_code = spark.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        coder = Code(shared_code.value)
        for batch in batches:
            for lo, hi in _groups(batch.column(3).to_numpy(), CODE_IDS):
                part = batch.slice(lo, hi - lo)
                sizes = part.column(3).to_numpy()
                marks = [np.frombuffer(m, "<u8") for m in part.column(4).to_pylist()]
                data = memoryview(coder.decode(part.column(5).to_pylist(), marks, sizes).astype("<u4").tobytes())
                ends = np.cumsum(sizes) * 4
                runs = [data[a:b] for a, b in zip((ends - sizes * 4).tolist(), ends.tolist(), strict=True)]
                cols = [*part.columns[:4], pa.array([zlib.crc32(x) for x in runs], pa.int64())]
                if with_ids:
                    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                    cols.append(pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(data, "<u4").astype(np.int64))))
                names = ["shard", "id", "tie", "n_tokens", "ids_crc32", "ids"][: len(cols)]
                yield pa.RecordBatch.from_arrays(cols, names)
            give_back()

    more = ", ids array<bigint>" if with_ids else ""
    return spark.read.parquet(f"{path}/rows").mapInArrow(run, f"shard int, id bigint, tie bigint, n_tokens bigint, ids_crc32 bigint{more}")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True, doc_id: str = "doc_id") -> DataFrame:
    """The rows written under path: doc_id, start (tokens of all rows before it), n_tokens, ids_crc32 and, if asked for, ids.

    Shards' sums are prefix-summed (at most MOST_SHARDS rows), and rows within their shard.
    """
    sums = spark.read.parquet(f"{path}/rows").groupBy("shard").agg(F.sum("n_tokens").alias("sum"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("shard", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("base"))
    inner = Window.partitionBy("shard").orderBy("id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = decoded(spark, path, with_ids).join(F.broadcast(bases), "shard")
    start = F.col("base") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))
    return rows.select(F.col("id").alias(doc_id), start.alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def op10_query(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row, read back from the files that hold it.

    A null text is empty and has the end id alone. Rows with the same id or a null one are rows of their own, in order of
    a hash of their texts (rows alike in both are interchangeable). Further columns are ignored. An empty table gives
    files without rows and no rows.
    """
    import public_tokenizers

    path = shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), end=1, doc_id=doc_id)
    return read_tokens(docs.sparkSession, path, with_ids=False, doc_id=doc_id)
