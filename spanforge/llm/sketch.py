"""Word hashes and Order MinHash keys of many texts at once, with numpy."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
#: Bands of two shingles and bands of one. At Jaccard similarities of 0.2, 0.3 and 0.4 of the shingles (about 0.8, 0.86
#: and 0.9 of the words), 98, 99.97 and all but one in a million pairs share a key.
PAIR_BANDS, SINGLE_BANDS = 56, 8

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BASE, _U = 0x9E3779B97F4A7C15 | 1, np.uint64
_powers: dict[int, np.ndarray] = {}
KEPT_POWERS = 3 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(base: int, n: int) -> np.ndarray:
    """base to the 0 .. n - 1, modulo 2 to the 64. Kept for the next call unless it is long."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(n + n // 16, base, np.uint64)
        have[:1] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= KEPT_POWERS:
            _powers[base] = have
    return have[:n]


def run_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Polynomial hash of values[begin:end] for each run, the last value having weight 1. Weights fall from the start of all values, so a run's hash is scaled by the inverse power of its place."""
    inverse = pow(base, -1, 1 << 64)
    n = len(values)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _power(inverse, n), dtype=np.uint64)])
    return (sums[end] - sums[begin]) * _power(base, n + 1)[end]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and how many each text has. Words are runs of digits, letters and bytes outside ASCII, A-Z lower-cased."""
    data = b" ".join(texts) + b" "
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    values = np.frombuffer(data.translate(_FOLD), np.uint8)
    word = values != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], word.astype(np.int8)])))
    begin, end = edge[0::2], edge[1::2]
    hashes = mix(run_hashes(values.astype(np.uint64), begin, end, _BASE) ^ (end - begin).astype(np.uint64))
    return hashes, np.bincount(np.searchsorted(np.cumsum(sizes), begin, side="right"), minlength=len(texts)).astype(np.int64)


def text_hashes(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's word sequence."""
    ends = np.cumsum(sizes)
    n = sizes.astype(np.uint64)
    return tuple(mix(run_hashes(mix(words ^ _U(seed)), ends - sizes, ends, base) + n) for seed, base in ((1, _BASE), (2, 0xD1342543DE82EF95)))


def shingles(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the occurrence-labelled SHINGLE-word runs of each text in order, and how many; a shorter text is one run."""
    ends = np.cumsum(sizes)
    n = np.where(sizes == 0, 0, np.maximum(sizes - SHINGLE + 1, 1))
    out_ends = np.cumsum(n)
    place = np.repeat(ends - sizes - (out_ends - n), n) + np.arange(int(n.sum()))
    stop = np.minimum(place + SHINGLE, np.repeat(ends, n))
    runs = np.zeros(len(place), np.uint64)
    for k in range(SHINGLE):
        at = place + k
        inside = at < stop
        runs = np.where(inside, mix(runs * _U(_BASE) + words[np.minimum(at, len(words) - 1)] + _U(k + 1)), runs) if len(words) else runs
    text = np.repeat(np.arange(len(sizes)), n)
    key = runs ^ mix(text.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, bool)
    occurrence = np.empty(len(key), np.uint64)
    occurrence[order] = (np.arange(len(key)) - np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))).astype(np.uint64) if len(key) else 0
    return mix(runs + occurrence * _U(0xA0761D6478BD642F)), n


def band_keys(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Order MinHash: for each text with shingles and each band, a hash of the least two shingles (one) under the band's hash function, in the order of the text.

    Returns keys, texts with shingles by bands.
    """
    n_bands = PAIR_BANDS + SINGLE_BANDS
    size = sizes[sizes > 0]
    keys = np.zeros((len(size), n_bands), np.uint64)
    if not len(size):
        return keys
    starts = np.cumsum(size) - size
    place = (np.arange(len(grams)) - np.repeat(starts, size)).astype(np.uint64)
    top = _U(0xFFFFFFFFFFFFFFFF)
    places = _U((1 << max(24, int(size.max()).bit_length())) - 1)
    factors = mix(np.arange(1, n_bands + 1, dtype=np.uint64)) | _U(1)
    value = np.empty_like(grams)
    for band in range(n_bands):
        # grams are scattered already, so the high bits of a product with a band's odd factor order them anew
        np.multiply(grams, factors[band], out=value)
        value &= ~places
        value |= place
        least = np.minimum.reduceat(value, starts)
        one = (least & places).astype(np.int64)
        first = grams[starts + one]
        if band < PAIR_BANDS:
            value[starts + one] = top
            second = np.minimum.reduceat(value, starts)
            two = np.where(second == top, one, (second & places).astype(np.int64))
            other = grams[starts + two]
            swap = two < one
            first, other = np.where(swap, other, first), np.where(swap, first, other)
            keys[:, band] = mix(mix(first * _U(_BASE) + _U(band)) + other)
        else:
            keys[:, band] = mix(first * _U(_BASE) + _U(band))
    return keys
