"""Canonical length-limited Huffman codes over numpy arrays of ids."""

from __future__ import annotations

import numpy as np

#: Symbols between two marks: a decoder can start at each mark.
STEP = 128


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of an optimal prefix code with no length above limit (package-merge); 0 for symbols that do not occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    row, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = len(row) // 2
        merged = np.concatenate([leaves, row[0 : 2 * pairs : 2] + row[1 : 2 * pairs : 2]])
        place = np.argsort(merged, kind="stable")
        row = merged[place]
        is_leaf.append(place < n)
    lengths, take = np.zeros(n, np.uint8), 2 * n - 2
    for leaf in reversed(is_leaf):
        k = int(leaf[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    code = last = 0
    for s, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        code <<= n - last
        codes[s], last = code, n
        code += 1
    return codes


class Code:
    """Encoder and table-driven decoder for one set of lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths, self.codes = lengths, canonical(lengths)
        self.most = max(int(lengths.max(initial=0)), 1)
        assert self.most <= 24, "a decoder's window has 32 bits"
        used = np.flatnonzero(lengths)
        order = used[np.argsort(lengths[used], kind="stable")]
        span = 1 << (self.most - lengths[order].astype(np.int64))
        fill = (1 << self.most) - int(span.sum())
        self.symbols = np.concatenate([np.repeat(order, span), np.zeros(fill, np.int64)]).astype(np.uint32)
        self.widths = np.concatenate([np.repeat(lengths[order], span), np.zeros(fill, np.uint8)]).astype(np.int64)

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], list[np.ndarray]]:
        """Bits of each run of ids (sizes: their lengths, together), starting on a byte, and the bit offsets of every STEP-th symbol."""
        width = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        sums = np.concatenate([[0], np.cumsum(width)])
        n_bytes = (sums[ends] - sums[begins] + 7) // 8
        at_byte = np.cumsum(n_bytes) - n_bytes
        offset = sums[:-1] + np.repeat(at_byte * 8 - sums[begins], sizes)
        data = _packed(self.codes[ids], width, offset, int(n_bytes.sum()))
        bits, marks = [], []
        for b, e, at, n in zip(begins.tolist(), ends.tolist(), at_byte.tolist(), n_bytes.tolist(), strict=True):
            bits.append(data[at : at + n])
            marks.append(offset[b:e:STEP] - at * 8)
        return bits, marks

    def decode(self, bits: list[bytes], marks: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
        """The ids of all runs, together. Every mark starts a lane; all lanes advance at once, a symbol a step."""
        lengths = np.array([len(b) for b in bits], np.int64)
        base = (np.cumsum(lengths) - lengths) * 8
        data = np.frombuffer(b"".join(bits) + b"\0" * 8, np.uint8).astype(np.uint32)
        window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        lanes = np.array([len(m) for m in marks], np.int64)
        if not lanes.sum():
            return np.zeros(0, np.uint32)
        pos = np.concatenate(marks).astype(np.int64) + np.repeat(base, lanes)
        in_run = np.arange(len(pos)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        out_at = np.repeat(np.cumsum(sizes) - sizes, lanes) + in_run * STEP
        left = np.minimum(np.repeat(sizes, lanes) - in_run * STEP, STEP)
        order = np.argsort(-left, kind="stable")
        pos, out_at, left = pos[order], out_at[order], left[order]
        out = np.empty(int(sizes.sum()), np.uint32)
        shift, mask = 32 - self.most, (1 << self.most) - 1
        for step in range(int(left[0])):
            k = int(np.searchsorted(-left, -step, side="left"))
            p = pos[:k]
            v = (window[p >> 3] >> (shift - (p & 7)).astype(np.uint32)) & mask
            out[out_at[:k] + step] = self.symbols[v]
            pos[:k] += self.widths[v]
        return out


def _packed(code: np.ndarray, width: np.ndarray, offset: np.ndarray, n_bytes: int) -> bytes:
    """Codes of the given widths at the given bit offsets (ascending), most significant bit first."""
    words = np.zeros(n_bytes // 8 + 2, np.uint64)
    if len(code):
        word, room = offset >> 6, 64 - (offset & 63) - width
        fits = room >= 0
        high = np.where(fits, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        starts = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
        words[word[starts]] = np.bitwise_or.reduceat(high, starts)
        over = np.flatnonzero(~fits)
        words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    return words.byteswap().tobytes()[:n_bytes]
