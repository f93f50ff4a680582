"""Token counts of whole texts, huge ones in overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What sentencepiece writes for a space.
MARK = "▁"
_models: dict[str, Counter] = {}


class Counter:
    """Counts a sentencepiece model's tokens of any text exactly, without encoding a huge text at once.

    A huge text is encoded in overlapping chunks, with the offsets of their tokens. Two neighbours are spliced at a
    position in their overlap where both start a token and where the vocabulary proves that no token can reach across:
    a single space after another character, as long as no piece of the vocabulary has a space mark after anything
    else. What lies before comes from the left chunk and what follows from the right one, so a chunk's cut ends never
    count. If the overlap has no such position, it is doubled; if it would pass the left chunk's start, the left chunk
    grows instead, at last to the whole text.
    """

    def __init__(self, path: str, chunk: int = 1 << 15, overlap: int = 1 << 9):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        # an extra word in front shows whether the model drops, adds or joins anything at a cut
        same = self.model.encode("a b") == self.model.encode("a") + self.model.encode("b")
        self.proven = same and not any(MARK in p.lstrip(MARK) for p in pieces)

    def counts(self, texts: list[str]) -> list[int]:
        """Numbers of tokens."""
        out = [0] * len(texts)
        short = [i for i, t in enumerate(texts) if len(t) <= self.chunk]
        for i, ids in zip(short, self.model.encode([texts[i] for i in short], num_threads=1), strict=True):
            out[i] = len(ids)
        for i, t in enumerate(texts):
            if len(t) > self.chunk:
                out[i] = self.huge(t)
        return out

    def _encoded(self, data: bytes, begin: int, end: int) -> list[int]:
        """Where the tokens of data[begin:end] start, in data. Tokens after the first of a character split into bytes start where it does or ends."""
        proto = self.model.encode(data[begin:end].decode("utf-8"), return_type="proto")
        return [begin + p.begin for p in proto.pieces]

    def huge(self, text: str) -> int:
        if not self.proven:
            return len(self.model.encode(text))
        data = text.encode("utf-8")
        n, begin, size, total = len(data), 0, self.chunk, 0
        end = _whole(data, min(size, n))
        starts, first = self._encoded(data, begin, end), 0
        while end < n:
            overlap, spliced = self.overlap, False
            while not spliced and end - overlap > begin:
                b = _whole(data, end - overlap)
                e = _whole(data, min(b + max(size, 2 * overlap), n))
                right = self._encoded(data, b, e)
                if at := self._common(data, starts, first, right, b, end):
                    p, i, j = at
                    total += i - first
                    begin, end, starts, first, spliced = p, e, right, j, True
                overlap *= 2
            if not spliced:  # nowhere to splice yet
                size *= 2
                end = _whole(data, min(begin + size, n))
                at = begin + 1 if begin else 0  # begin is a space: the model writes one in front of each text
                starts, first = self._encoded(data, at, end), 0
            else:
                size = self.chunk
        return total + len(starts) - first

    @staticmethod
    def _common(data: bytes, left: list[int], first: int, right: list[int], low: int, high: int) -> tuple[int, int, int] | None:
        """The last stable position within the overlap where both sides start a token: it, and the token's index on either side."""
        at = {p: j for j, p in reversed(list(enumerate(right))) if low < p < high}
        for i in range(len(left) - 1, first, -1):
            p = left[i]
            if p <= low:
                return None
            if p in at and data[p] == 32 and data[p - 1] != 32 and data[max(p - 3, 0) : p] != MARK.encode() and left[i - 1] < p and p > 0:
                return p, i, at[p]
        return None


def _whole(data: bytes, at: int) -> int:
    """at, or the start of the character that it would cut."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def counter(path: str) -> Counter:
    if path not in _models:
        _models[path] = Counter(path)
    return _models[path]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens (whole text, no special tokens) and over_limit (n_tokens above limit) of each row.

    model: path of a sentencepiece file, which every executor has. A null text counts as empty, which has no bytes or
    tokens. Rows count for themselves where ids repeat or are null; further columns are ignored; an empty table gives no
    rows. No shuffle: texts are encoded where they are read, a bounded batch at a time.
    """
    import pyarrow as pa
    import pyarrow.compute  # noqa: F401

    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model).counts
        for batch in batches:
            n: list[int] = []
            for lo in range(0, batch.num_rows, 64):  # lists of token ids live for 64 texts only
                n += count(batch.column(1).slice(lo, 64).to_pylist())
            size = pa.compute.binary_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(doc_id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5_query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
