"""Edit distance of word sequences within a band, with numpy and whole numbers as bit vectors."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

_K = np.uint64(0x9E3779B97F4A7C15)
RUN = 3
#: Words of one side that a bit vector holds, and cells of the largest gap between anchors that is aligned exactly at first.
BITS, GAP_CELLS = 4096, 1 << 24


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether 1 - edit distance / longer length is ``least`` or more. Exact.

    Words and runs of RUN words that one side lacks mostly disprove it (an edit costs at most RUN runs); an alignment
    along runs that occur once on either side, within the band of diagonals that the allowed edits can reach, mostly
    proves it; what is left is decided by the banded alignment. Its time is a step for each word and each BITS words of
    the band, its memory in proportion to the texts: two texts of a million words take minutes where all else fails.
    """
    n = max(len(a), len(b))
    most = int((1 - least) * n + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    a, b = _trimmed(a, b)
    n = max(len(a), len(b))
    if n <= most or not min(len(a), len(b)):
        return n <= most
    if n - _shared(a, b) > most:
        return False
    if n <= BITS // 8:
        return _banded(a, b, most)
    if n - RUN + 1 - _shared(_runs(a), _runs(b)) > RUN * most:
        return False
    return _anchored(a, b, most) <= most or _banded(a, b, most)


def _trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without the words that they begin and end with alike: these cost nothing in some best alignment."""
    for _ in range(2):
        k = min(len(a), len(b))
        other = np.flatnonzero(a[:k] != b[:k])
        k = int(other[0]) if len(other) else k
        a, b = a[k:][::-1], b[k:][::-1]
    return a, b


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Values that both hold, as often as both hold them."""
    if not len(a) or not len(b):
        return 0
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    at = np.minimum(np.searchsorted(ub, ua), len(ub) - 1)
    return int(np.where(ub[at] == ua, np.minimum(ca, cb[at]), 0).sum())


def _runs(x: np.ndarray) -> np.ndarray:
    """Hashes of the runs of RUN words."""
    y = x.astype(np.uint64)
    runs = y[: max(len(y) - RUN + 1, 0)].copy()
    for k in range(1, RUN):
        runs = (runs ^ (runs >> np.uint64(29))) * _K + y[k : max(len(y) - RUN + 1, 0) + k]
    return runs


def _once(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs that occur once, sorted, and where they start."""
    value, at, count = np.unique(_runs(x), return_index=True, return_counts=True)
    return value[count == 1], at[count == 1]


def _anchored(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Cost of the alignment along unique common runs: at least the edit distance."""
    i = j = np.zeros(0, np.int64)
    if min(len(a), len(b)) >= RUN:
        (va, pa), (vb, pb) = _once(a), _once(b)
        _, x, y = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
        i, j = pa[x], pb[y]
        order = np.argsort(i)
        i, j = i[order], j[order]
        in_band = np.abs(i - j) <= most
        i, j = _rising(i[in_band], j[in_band])
    i, j = np.concatenate([[-1], i, [len(a)]]), np.concatenate([[-1], j, [len(b)]])
    cost = 0
    for k in np.flatnonzero((np.diff(i) > 1) | (np.diff(j) > 1)).tolist():
        cost += _gap(a[i[k] + 1 : i[k + 1]], b[j[k] + 1 : j[k + 1]])
        if cost > most:
            break
    return cost


def _rising(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest selection in which j rises too."""
    if not len(j) or (np.diff(j) > 0).all():
        return i, j
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(j)
    for k, v in enumerate(j.tolist()):
        p = bisect_left(tails, v)
        before[k] = at[p - 1] if p else -1
        if p == len(tails):
            tails.append(v)
            at.append(k)
        else:
            tails[p], at[p] = v, k
    k, chosen = at[-1], []
    while k >= 0:
        chosen.append(k)
        k = before[k]
    pick = np.array(chosen[::-1])
    return i[pick], j[pick]


def _gap(x: np.ndarray, y: np.ndarray) -> int:
    """The edit distance of a small gap, an upper bound of that of a large one."""
    x, y = _trimmed(x, y)
    n, m = len(x), len(y)
    if min(n, m) <= 1:
        return max(n, m) - int(min(n, m) == 1 and bool((x == y[0]).any() if m == 1 else (y == x[0]).any()))
    return max(n, m) if n * m > GAP_CELLS else _distance(x, y, max(n, m))


def _banded(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether the edit distance is at most ``most``, over the diagonals it can reach."""
    return _distance(a, b, most) <= most


def _distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The edit distance if it is at most ``most``, else some number above ``most``.

    Bit-parallel dynamic programme: a block of BITS words of ``a`` is one bit vector of differences between neighbours
    in a column, advanced over the columns (words of ``b``) of the band; the differences along its last row go on to the
    next block. Cells outside the band enter as a rise of one for each step from the band's edge, which is never less
    than the truth, so whatever is found to be at most ``most`` is exact.
    """
    n, m = len(a), len(b)
    if not n or not m or abs(n - m) > most:
        return max(n, m) if not n or not m else most + 1
    _, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = codes[:n].tolist(), codes[n:].tolist()
    # of the row above a block: values left of each column from ``first`` on, and the rise at each
    first, above, rises = 0, 0, [1] * min(m, BITS + most)
    for lo in range(0, n, BITS):
        hi = min(lo + BITS, n)
        begin, end = max(lo - most, 0), min(hi + most, m)
        corner = above + sum(rises[: begin - first])
        tops = rises[begin - first :]
        tops += [1] * (end - begin - len(tops))
        first, above, rises = begin, corner + hi - lo, _advance(_masks(x[lo:hi]), y[begin:end], tops, hi - lo)
        if above + min(int(np.cumsum(rises).min(initial=0)), 0) > most:
            return most + 1
    return above + sum(rises)


def _masks(x: list[int]) -> dict[int, int]:
    """For each value the places that hold it, as bits."""
    out: dict[int, int] = {}
    bit = 1
    for v in x:
        out[v] = out.get(v, 0) | bit
        bit <<= 1
    return out


def _advance(masks: dict[int, int], words: list[int], tops: list[int], size: int) -> list[int]:
    """The differences along the last row of a block of ``size`` rows, from those along the row above it; the block's left column rises by one each row."""
    full = (1 << size) - 1
    last = 1 << (size - 1)
    up, down, out = full, 0, []
    for w, top in zip(words, tops, strict=True):
        equal = masks.get(w, 0)
        vertical = equal | down
        if top < 0:
            equal |= 1
        across = (((equal & up) + up) ^ up) | equal
        more = down | (full & ~(across | up))
        less = up & across
        out.append(1 if more & last else -1 if less & last else 0)
        more = (more << 1) | (top > 0)
        less = (less << 1) | (top < 0)
        up = full & (less | ~(vertical | more))
        down = full & more & vertical
    return out
