"""Overlaps of each query found in one place, without a join.

An interval join meets a query in every bin that it reaches, so whatever is asked of all its hits (are there any, how many,
the last, their order) needs the pairs shuffled once more. Here a query lies in one block of positions, the one in which it
starts, and subjects in every block from which a query may reach them. A task reads its blocks in order, keeps one block's
subjects and lets its queries pass by: counts come from two sorted lists, the largest index from a table of running maxima
over starts and ends, and pairs, where they are wanted, a few queries at a time in order of the subject's index. Nothing is
broadcast. What meets in one task is a block's rows, and of these only the subjects are held.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Python workers get this code by value: they need not find the package, which only the driver's process may have on its path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Subjects that a block should have at least, so that there are not very many blocks, and may have on average.
FEWEST, MOST = 512, 200_000
#: Blocks that the widest query and the widest subject may reach; blocks are widened until they do.
QUERY_REACH, SUBJECT_REACH = 8, 64
#: Queries compared with subjects at a time, and entries of a table.
TOGETHER, CELLS = 256, 1 << 21
#: Pairs given back at a time.
ROWS = 1 << 17
#: Ranges that touch nothing.
NOWHERE = "seqnames IS NULL OR start IS NULL OR end IS NULL"


def block_step(query: DataFrame, subject: DataFrame) -> tuple[int, int] | None:
    """Positions in a block and the largest width of a query, from one aggregate; None where blocks would hold too much."""
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if not all(isinstance(x.schema["idx"].dataType, whole) for x in (query, subject)):
        return None
    width = (F.col("end") - F.col("start") + 1).cast("bigint")
    sides = [x.select(F.lit(k).alias("k"), "seqnames", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end")) for k, x in enumerate((query, subject))]
    spaces = sides[0].unionByName(sides[1]).groupBy("k", "seqnames").agg(F.count("start").alias("n"), F.sum(width).alias("w"), F.max(width).alias("most"), (F.max("end") - F.min("start") + 1).alias("extent"))
    found = {r["k"]: r for r in spaces.groupBy("k").agg(*[f(c).alias(c) for c, f in (("n", F.sum), ("w", F.sum), ("most", F.max), ("extent", F.sum))]).collect() if r["n"]}
    if len(found) < 2:
        return 1 << 20, max([r["most"] for k, r in found.items() if k == 0], default=0)
    q, s = found[0], found[1]
    extent = max(s["extent"], 1)
    step = max(16, 2 * q["w"] // q["n"], 2 * s["w"] // s["n"], FEWEST * extent // s["n"], q["most"] // QUERY_REACH + 1, s["most"] // SUBJECT_REACH + 1)
    return (step, q["most"]) if s["n"] * min(step, extent) / extent <= MOST else None


def in_blocks(query: DataFrame, subject: DataFrame, step: int, widest: int, ignore_strand: bool) -> DataFrame:
    """Both sides by block, subjects first and queries by start: lo and hi are what a subject's end must reach and its start may
    reach at most (of adjacent ranges, too), or the subject's start and end."""
    strand = F.col("strand")
    code = F.lit(3) if ignore_strand else F.when(strand == "+", 1).when(strand == "-", 2).when(strand == "*", 3).otherwise(0)  # 0: unknown, goes with 3 only

    def side(df: DataFrame, who: int, lo: Column, hi: Column, block: Column) -> DataFrame:
        return df.where(f"NOT ({NOWHERE})").select("seqnames", block.alias("block"), F.lit(who).alias("who"), lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"), code.cast("int").alias("code"), F.col("idx").cast("bigint").alias("idx"), (strand if who else F.lit(None).cast("string")).alias("strand"))

    start, end = F.col("start").cast("bigint"), F.col("end").cast("bigint")
    reach = F.explode(F.sequence(F.floor((start - widest - 2) / step), F.floor(end / step)))
    both = side(subject, 0, start, end, reach).unionByName(side(query, 1, start - 1, end + 1, F.floor((start - 1) / step)))
    return both.repartition("seqnames", "block").sortWithinPartitions("seqnames", "block", "who", "lo")


def counted(cells: DataFrame, query: DataFrame, itself: bool) -> DataFrame:
    """The columns of a query and n, its number of hits."""
    return _of_queries(cells, query, "n", 0, lambda block, *asked: block.count(*asked) - (not itself))


def last_of(cells: DataFrame, query: DataFrame, subject: DataFrame, itself: bool) -> DataFrame:
    """The columns of a query and subject_idx, the largest of its hits or null."""
    found = _of_queries(cells, query, "subject_idx", _NONE, lambda block, *asked: block.last(*asked, itself))
    none = F.lit(_NONE).cast("bigint")
    return found.withColumn("subject_idx", F.when(F.col("subject_idx") != none, F.col("subject_idx")).cast(subject.schema["idx"].dataType))


def pairs_of(cells: DataFrame, query: DataFrame, subject: DataFrame, itself: bool, least: int = 1, below: int | None = None, most: int | None = None) -> DataFrame:
    """Hits of queries with at least ``least`` and fewer than ``below`` of them: query_idx, subject_idx and rank by subject_idx; of each the first ``most``."""

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def given(rows: list) -> Iterator:
            cols = [np.concatenate(c) for c in zip(*rows, strict=True)]
            for a in range(0, len(cols[0]), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + ROWS]) for c in cols], names=["query_idx", "subject_idx", "rank"])

        kept, held = [], 0
        for _, parts in _passing(batches):
            for block, _, (lo, hi, code, idx) in parts:
                n = block.count(lo, hi, code, idx) - (not itself)
                asked = (n >= least) if below is None else (n >= least) & (n < below)
                for rows in block.pairs(lo[asked], hi[asked], code[asked], idx[asked], itself, most):
                    kept.append(rows)
                    held += len(rows[0])
                    if held >= ROWS:
                        yield from given(kept)
                        kept, held = [], 0
        if held:
            yield from given(kept)

    found = cells.mapInArrow(run, "query_idx bigint, subject_idx bigint, rank int")
    return found.select(F.col("query_idx").cast(query.schema["idx"].dataType), F.col("subject_idx").cast(subject.schema["idx"].dataType), "rank")


def _of_queries(cells: DataFrame, query: DataFrame, name: str, nowhere: int, ask) -> DataFrame:
    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch, parts in _passing(batches):
            found, at = [], []
            for block, rows, asked in parts:
                found.append(ask(block, *asked))
                at.append(rows)
            if at:
                own = batch.take(pa.array(np.concatenate(at)))
                yield pa.RecordBatch.from_arrays([own["idx"], own["seqnames"], own["lo"], own["hi"], own["strand"], pa.array(np.concatenate(found).astype("int64"))], names=["idx", "seqnames", "lo", "hi", "strand", name])

    kind = lambda c: query.schema[c].dataType
    found = cells.mapInArrow(run, f"idx bigint, seqnames string, lo bigint, hi bigint, strand string, {name} bigint")
    found = found.select(F.col("idx").cast(kind("idx")), "seqnames", (F.col("lo") + 1).cast(kind("start")).alias("start"), (F.col("hi") - 1).cast(kind("end")).alias("end"), "strand", name)
    return found.unionByName(query.where(NOWHERE).select("idx", "seqnames", "start", "end", "strand", F.lit(nowhere).cast("bigint").alias(name)))


_NONE = -(1 << 63)


def _passing(batches: Iterable) -> Iterator:
    """Batches, each with its runs of queries of one block: the block, the places of the rows and (lo, hi, code, idx)."""
    import numpy as np
    import pyarrow.compute as pc

    state = {"key": None, "block": None, "subjects": []}

    def runs(batch) -> Iterator:
        n = batch.num_rows
        block, who, *values = (batch[c].to_numpy() for c in ("block", "who", "lo", "hi", "code", "idx"))
        space = batch["seqnames"]
        new = (block[1:] != block[:-1]) | (who[1:] != who[:-1]) | pc.not_equal(space.slice(1), space.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = (space[a].as_py(), int(block[a]))
            if key != state["key"]:
                state.update(key=key, block=None, subjects=[])
            part = [v[a:b] for v in values]
            if who[a] == 0:
                state["subjects"].append(part)
                continue
            if state["block"] is None:
                state["block"] = _Block(state["subjects"])
            yield state["block"], np.arange(a, b), part

    for batch in batches:
        if batch.num_rows:
            yield batch, runs(batch)


class _Block:
    """The subjects of a block, by strand of the query."""

    def __init__(self, parts: list) -> None:
        import numpy as np

        start, end, code, idx = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, "int64"),) * 4
        order = np.argsort(idx, kind="stable")
        self.all, self.views = (start[order], end[order], code[order], idx[order]), {}

    def view(self, code: int) -> dict:
        """Subjects with a strand that goes with the query's, by index, with their starts and ends in order."""
        import numpy as np

        if code not in self.views:
            start, end, strand, idx = self.all
            fits = (strand == 3) | (strand == code) & (code > 0) | (code == 3)
            start, end, idx = start[fits], end[fits], idx[fits]
            self.views[code] = {"start": start, "end": end, "idx": idx, "starts": np.sort(start), "ends": np.sort(end)}
        return self.views[code]

    def count(self, lo, hi, code, idx):
        """Those that start in time less those that end too early: all of these do start in time."""
        import numpy as np

        n = np.zeros(len(lo), "int64")
        for c in np.unique(code).tolist():
            at, v = code == c, self.view(c)
            n[at] = np.searchsorted(v["starts"], hi[at], "right") - np.searchsorted(v["ends"], lo[at], "left")
        return n

    def last(self, lo, hi, code, idx, itself: bool):
        import numpy as np

        found = np.full(len(lo), _NONE)
        for c in np.unique(code).tolist():
            at, v = np.flatnonzero(code == c), self.view(c)
            table = self.table(v) if itself else None
            if table is not None:
                x, y, most = table
                found[at] = most[np.searchsorted(x, hi[at], "right"), np.searchsorted(y, lo[at], "left")]
                continue
            for rows, near, hit in self.compared(v, lo[at], hi[at], idx[at], itself):
                some = hit.any(axis=1)
                where = np.flatnonzero(some)
                found[at[rows][where]] = v["idx"][near][near.size - 1 - hit[where, ::-1].argmax(axis=1)]
        return found

    def table(self, v: dict):
        """Distinct starts and ends, and the largest index of those that start at one of the first so many and end at one of the last so many."""
        import numpy as np

        if "table" not in v:
            x, i = np.unique(v["start"], return_inverse=True)
            y, j = np.unique(v["end"], return_inverse=True)
            v["table"] = None
            if (len(x) + 1) * (len(y) + 1) <= CELLS:
                most = np.full((len(x) + 1, len(y) + 1), _NONE)
                np.maximum.at(most, (i + 1, j), v["idx"])
                np.maximum.accumulate(most, axis=0, out=most)
                most = np.maximum.accumulate(most[:, ::-1], axis=1)[:, ::-1]
                v["table"] = (x, y, most)
        return v["table"]

    def compared(self, v: dict, lo, hi, idx, itself: bool) -> Iterator:
        """Some queries at a time (they come by start): their rows, the subjects near them and who hits whom."""
        import numpy as np

        a = 0
        while a < len(lo):
            b = min(a + TOGETHER, len(lo))
            near = np.flatnonzero((v["start"] <= hi[a:b].max()) & (v["end"] >= lo[a:b].min()))
            b = min(b, a + max(1, CELLS // max(near.size, 1)))
            hit = (v["start"][near] <= hi[a:b, None]) & (v["end"][near] >= lo[a:b, None])
            if not itself:
                hit &= v["idx"][near] != idx[a:b, None]
            if near.size:
                yield slice(a, b), near, hit
            a = b

    def pairs(self, lo, hi, code, idx, itself: bool, most: int | None) -> Iterator:
        import numpy as np

        for c in np.unique(code).tolist():
            at, v = code == c, self.view(c)
            own = idx[at]
            for rows, near, hit in self.compared(v, lo[at], hi[at], own, itself):
                i, j = np.nonzero(hit)
                n = np.bincount(i, minlength=hit.shape[0])
                rank = np.arange(1, len(i) + 1) - np.repeat(np.cumsum(n) - n, n)
                if most is not None:
                    kept = rank <= most
                    i, j, rank = i[kept], j[kept], rank[kept]
                yield own[rows][i], v["idx"][near][j], rank.astype("int32")
