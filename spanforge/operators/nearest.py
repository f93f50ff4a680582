"""Nearest-neighbour joins along the coordinate, strand-aware.

``precede`` gives the subject that a query comes before in reading direction, ``follow`` the one it comes after. On + that is
rightward and leftward, on - the other way, with subjects of the same strand or *. A * query takes both readings: rightward
among + and *, leftward among -, and the nearer of the two where both exist. Neighbours are found as-of: query and subject
endpoints are put in one order per space and strand class, the last subject endpoint before each query is carried forward,
and subjects with that endpoint are joined back. No pair that is not a result is formed. Joins of exploded tables are marked
for a merge, since the planner takes these for smaller than they are and would broadcast them from the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranges as R
from ..plans import blocks
from .overlaps import CORE, find_overlaps, side_by_side


AHEAD, BEHIND = 0, 1


class _Touching:
    """Subjects that a query overlaps or is adjacent to, with ``itself`` false except the one of its own index. By blocks; by a
    join of pairs if ``bins`` are given or blocks would hold too much."""

    def __init__(self, query: DataFrame, subject: DataFrame, ignore_strand: bool, bins: int | None, itself: bool = True) -> None:
        self.q, self.s, self.itself = query.select(*CORE), subject.select(*CORE), itself
        found = None if bins else blocks.block_step(self.q, self.s)
        self.cells = found and blocks.in_blocks(self.q, self.s, *found, ignore_strand)
        if not found:
            over = find_overlaps(self.q, self.s, maxgap=0, ignore_strand=ignore_strand, bins=bins)
            self.over = over if itself else over.where("query_idx <> subject_idx")

    def _with(self, found: Column, name: str) -> DataFrame:
        each = self.over.groupBy(F.col("query_idx").alias("idx")).agg(found.alias(name))
        return self.q.join(each.hint("merge"), "idx", "left")

    def counted(self) -> DataFrame:
        """Queries with n, their number of hits."""
        if self.cells:
            return blocks.counted(self.cells, self.q, self.itself)
        return self._with(F.count(F.lit(1)), "n").withColumn("n", F.coalesce("n", F.lit(0)))

    def last(self) -> DataFrame:
        """Queries with the largest subject_idx, or null."""
        return blocks.last_of(self.cells, self.q, self.s, self.itself) if self.cells else self._with(F.max("subject_idx"), "subject_idx")

    def pairs(self, least: int = 1, below: int | None = None, most: int | None = None) -> DataFrame:
        """Hits of queries with at least ``least`` and fewer than ``below``: query_idx, subject_idx, rank; of each query the first ``most``."""
        if self.cells:
            return blocks.pairs_of(self.cells, self.q, self.s, self.itself, least, below, most)
        w = Window.partitionBy("query_idx")
        ranked = self.over.withColumns({"rank": F.row_number().over(w.orderBy("subject_idx")), "_n": F.count(F.lit(1)).over(w)})
        kept = ranked.where((F.col("_n") >= least) & (F.col("_n") < below if below is not None else F.lit(True)) & (F.col("rank") <= most if most is not None else F.lit(True)))
        return kept.drop("_n")

    def chosen(self, select: str) -> tuple[DataFrame, DataFrame]:
        """Hits (select arbitrary: the last of each query), and queries without one."""
        if select == "arbitrary":
            last = self.last()
            return last.where("subject_idx IS NOT NULL").select(F.col("idx").alias("query_idx"), "subject_idx"), last.where("subject_idx IS NULL").select(*CORE)
        over = self.pairs() if self.cells else self.over
        return over.select("query_idx", "subject_idx"), self.counted().where("n = 0").select(*CORE)


def _neighbours(query: DataFrame, subject: DataFrame, sides: tuple[int, ...], ignore_strand: bool, block: int | None, outermost: bool = False) -> DataFrame:
    """Subjects at the nearest endpoint on each side, for each reading of a query, ties all (outermost: the first and the last of
    them): query_idx, subject_idx, gap, side.

    All sides and readings are one order of events: to look right, the axis is mirrored, so that it is the last subject
    endpoint before each query that counts.
    """
    from ..plans.prefix import running

    q, s = query.select(*CORE), subject.select(*CORE)
    if ignore_strand:
        q, s = q.withColumn("strand", F.lit("+")), s.withColumn("strand", F.lit("+"))
    strand = F.col("strand")
    look = lambda kind, side, right: F.struct(kind.alias("class"), F.lit(side).alias("side"), F.lit(right).alias("right"))
    forward = F.array(*[look(F.when(strand == "+", "+").otherwise("p"), side, side == AHEAD) for side in sides])
    reverse = F.array(*[look(F.when(strand == "-", "-").otherwise("m"), side, side == BEHIND) for side in sides])
    looks = F.when(strand == "+", forward).when(strand == "-", reverse).otherwise(F.concat(forward, reverse))
    # + and -: with *; p: + and *, m: - alone, for queries on *
    classes = F.when(strand == "+", F.array(F.lit("+"), F.lit("p"))).when(strand == "-", F.array(F.lit("-"), F.lit("m"))).otherwise(F.array(F.lit("+"), F.lit("-"), F.lit("p")))
    at = F.when(F.col("right"), -F.col("start")).otherwise(F.col("end")).cast("bigint")
    ways = s.select("seqnames", "start", "end", F.col("idx").alias("subject_idx"), F.explode(classes).alias("class"))
    ways = ways.withColumn("right", F.explode(F.array(F.lit(True), F.lit(False)))).select("seqnames", "class", "right", at.alias("pos"), "subject_idx")
    from_ = F.when(F.col("v.right"), -F.col("end")).otherwise(F.col("start")).cast("bigint")
    asked = q.withColumn("v", F.explode(looks)).select("seqnames", "v.class", "v.right", from_.alias("pos"), F.lit(0).alias("end"), "idx", "v.side")
    none = lambda c: F.lit(None).cast(asked.schema[c].dataType).alias(c)
    ends = ways.groupBy("seqnames", "class", "right", "pos").agg(F.lit(1).alias("end")).withColumns({"idx": none("idx"), "side": none("side")})
    # at one position queries come first, so that only endpoints strictly before count
    group = ["seqnames", "class", "right"]
    carried = running(asked.unionByName(ends), group, "pos", ["pos", "end"], {"last": ("max", F.when(F.col("end") == 1, F.col("pos")))}, block=block)
    found = carried.where("end = 0 AND last IS NOT NULL").select("idx", *group, "last", "side", (F.col("pos") - F.col("last")).alias("gap"))
    ways = ways.withColumnRenamed("pos", "last")
    if outermost:
        ways = ways.groupBy(*group, "last").agg(F.array(F.min("subject_idx"), F.max("subject_idx")).alias("_x")).withColumn("subject_idx", F.explode(F.array_distinct("_x"))).drop("_x")
    return found.join(ways.hint("merge"), [*group, "last"]).select(F.col("idx").alias("query_idx"), "subject_idx", "gap", "side")


def _directed(query: DataFrame, subject: DataFrame, side: int, ignore_strand: bool, block: int | None) -> DataFrame:
    """Candidates of precede (AHEAD) or follow with their distance: query_idx, subject_idx, gap."""
    found = _neighbours(query, subject, (side,), ignore_strand, block)
    return found.withColumn("_m", F.min("gap").over(Window.partitionBy("query_idx"))).where("gap = _m").select("query_idx", "subject_idx", "gap")


def precede(query: DataFrame, subject: DataFrame, ignore_strand: bool = False, block: int | None = None) -> DataFrame:
    """Nearest subjects after each query in reading direction, ties all: query_idx, subject_idx, gap (1 for adjacent ranges)."""
    return _directed(query, subject, AHEAD, ignore_strand, block)


def follow(query: DataFrame, subject: DataFrame, ignore_strand: bool = False, block: int | None = None) -> DataFrame:
    """Nearest subjects before each query in reading direction, ties all."""
    return _directed(query, subject, BEHIND, ignore_strand, block)


def nearest(query: DataFrame, subject: DataFrame, ignore_strand: bool = False, select: str = "all", ties: str = "precede", bins: int | None = None, block: int | None = None) -> DataFrame:
    """Nearest subjects of each query: query_idx, subject_idx, distance. Queries without one have no row.

    Overlapping and adjacent ranges come first, at distance 0 (select arbitrary: the last of them). Otherwise the nearer of precede and
    follow counts; at equal distance select all gives the precede side (ties ``both``: both), arbitrary the least index.
    """
    over, rest = _Touching(query, subject, ignore_strand, bins).chosen(select)
    sides = _neighbours(rest, subject, (AHEAD, BEHIND), ignore_strand, block, select == "arbitrary")
    return over.select("query_idx", "subject_idx", F.lit(0).cast("bigint").alias("distance")).unionByName(_best(sides, select, ties))


def _best(sides: DataFrame, select: str, ties: str) -> DataFrame:
    """The nearer side of each query, as ``nearest`` says."""
    if select == "arbitrary":
        # of each side one subject: the first of those after, the last of those before
        one = sides.groupBy("query_idx", "side", "gap").agg(F.min("subject_idx").alias("lo"), F.max("subject_idx").alias("hi"))
        picked = one.select("query_idx", "gap", F.when(F.col("side") == 0, F.col("lo")).otherwise(F.col("hi")).alias("subject_idx"))
        best = picked.groupBy("query_idx").agg(F.min(F.struct("gap", "subject_idx")).alias("x")).select("query_idx", "x.subject_idx", "x.gap")
    else:
        w = Window.partitionBy("query_idx")
        order = F.struct("gap", "side") if ties == "precede" else F.col("gap")
        best = sides.withColumn("_o", order).withColumn("_m", F.min("_o").over(w)).where("_o = _m").select("query_idx", "subject_idx", "gap")
    return best.select("query_idx", "subject_idx", (F.col("gap") - 1).alias("distance"))


def nearest_in_self(df: DataFrame, ignore_strand: bool = False, select: str = "all", ties: str = "precede", bins: int | None = None, block: int | None = None) -> DataFrame:
    """``nearest`` within one table; a row is not its own neighbour."""
    over, rest = _Touching(df, df, ignore_strand, bins, itself=False).chosen(select)
    # nothing but itself touches such a row, so one position more on either side only keeps it from finding itself
    wider = rest.withColumns({"start": F.col("start") - 1, "end": F.col("end") + 1})
    apart = _best(_neighbours(wider, df, (AHEAD, BEHIND), ignore_strand, block, select == "arbitrary"), select, ties)
    return over.select("query_idx", "subject_idx", F.lit(0).cast("bigint").alias("distance")).unionByName(apart.withColumn("distance", F.col("distance") + 1))


def distance_of(q: str = "q_", s: str = "s_", ignore_strand: bool = False) -> Column:
    """Positions between two ranges, 0 if they touch or overlap; null on other spaces or on opposite strands."""
    same = F.col(f"{q}seqnames") == F.col(f"{s}seqnames")
    if not ignore_strand:
        same &= R.compatible(F.col(f"{q}strand"), F.col(f"{s}strand"))
    return F.when(same, R.gap_width(q, s))


def distance(x: DataFrame, y: DataFrame, ignore_strand: bool = False) -> DataFrame:
    """Rows with equal idx: idx and distance."""
    return side_by_side(x, y).select(F.col("q_idx").alias("idx"), distance_of(ignore_strand=ignore_strand).alias("distance"))


def distance_to_nearest(query: DataFrame, subject: DataFrame, **how) -> DataFrame:
    """``nearest`` with one subject per query unless select says all."""
    return nearest(query, subject, **({"select": "arbitrary"} | how))


def precedes(x: DataFrame, y: DataFrame) -> DataFrame:
    """Rows with equal idx: idx and whether x comes wholly before y in y's reading direction."""
    test = F.when(F.col("s_strand") == "-", F.col("q_start") > F.col("s_end")).otherwise(F.col("q_end") < F.col("s_start"))
    return side_by_side(x, y).select(F.col("q_idx").alias("idx"), ((F.col("q_seqnames") == F.col("s_seqnames")) & test).alias("precedes"))


def follows(x: DataFrame, y: DataFrame) -> DataFrame:
    test = F.when(F.col("s_strand") == "-", F.col("q_end") < F.col("s_start")).otherwise(F.col("q_start") > F.col("s_end"))
    return side_by_side(x, y).select(F.col("q_idx").alias("idx"), ((F.col("q_seqnames") == F.col("s_seqnames")) & test).alias("follows"))


def k_nearest(query: DataFrame, subject: DataFrame, k: int = 1, select: str = "arbitrary", ignore_strand: bool = False, bins: int | None = None, block: int | None = None) -> DataFrame:
    """The k nearest subjects of each query: query_idx, subject_idx, distance (0: overlapping or adjacent; else one more than the
    positions between) and rank. Ties go to subjects after the query, then before, then by idx; select all adds all at the k-th distance.

    Strands must be compatible. A query that touches k subjects or more needs no others. For the rest, in each direction subjects are numbered along the axis; a query finds its place as-of and joins
    the next k numbers (those that tie with the k-th too), so about 2k candidates are formed for each query.
    """
    q, s = query.select(*CORE), subject.select(*CORE)
    if ignore_strand:
        q, s = q.withColumn("strand", F.lit("*")), s.withColumn("strand", F.lit("*"))
    classes = F.when(F.col("strand") == "*", F.array(F.lit("+"), F.lit("-"), F.lit("*"))).otherwise(F.array("strand", F.lit("*")))
    s = s.withColumn("class", F.explode(classes))
    touching, none = _Touching(q, subject, ignore_strand, bins), F.lit(0).cast("bigint").alias("distance")
    enough = touching.pairs(least=k, most=None if select == "all" else k).select("query_idx", "subject_idx", none, "rank")
    over = touching.pairs(below=k).select("query_idx", "subject_idx", none, F.lit(2).alias("side"))
    few = touching.counted().where(F.col("n") < k).select(*CORE, F.col("strand").alias("class"))
    apart = [_next_k(few, s, k, right, block).withColumn("side", F.lit(0 if right else 1)) for right in (True, False)]
    found = apart[0].unionByName(apart[1]).where("distance > 1").unionByName(over)  # adjacent ones are at 0 already
    order = Window.partitionBy("query_idx").orderBy("distance", "side", "subject_idx")
    by_distance = Window.partitionBy("query_idx").orderBy("distance")
    ranked = found.withColumns({"rank": F.row_number().over(order), "_r": F.rank().over(by_distance)})
    kept = ranked.where(F.col("_r") <= k) if select == "all" else ranked.where(F.col("rank") <= k)
    return enough.unionByName(kept.select("query_idx", "subject_idx", "distance", "rank"))


def _next_k(q: DataFrame, s: DataFrame, k: int, right: bool, block: int | None) -> DataFrame:
    """Subjects at the next k distinct endpoints strictly to one side, at most k and what ties with the last: query_idx, subject_idx, distance."""
    from ..plans.prefix import running

    sign, group = -1 if right else 1, ["seqnames", "class"]
    s_at, q_at = (sign * F.col("start"), sign * F.col("end")) if right else (F.col("end"), F.col("start"))
    ends = s.select(*group, s_at.cast("bigint").alias("pos"), F.col("idx").alias("subject_idx"))
    distinct = ends.groupBy(*group, "pos").agg(F.lit(1).alias("side")).withColumn("idx", F.lit(None).cast(q.schema["idx"].dataType))
    asked = q.select(*group, q_at.cast("bigint").alias("pos"), F.lit(0).alias("side"), "idx")
    counted = running(asked.unionByName(distinct), group, "pos", ["pos", "side"], {"last": ("sum", F.col("side").cast("bigint"))}, block=block)
    numbered = counted.where("side = 1").select(*group, "pos", (F.col("last") + 1).alias("n"))
    at = counted.where("side = 0 AND last > 0").select("idx", *group, F.col("pos").alias("at"), F.explode(F.sequence(F.col("last"), F.greatest(F.col("last") - k + 1, F.lit(1)), F.lit(-1).cast("bigint"))).alias("n"))
    hits = at.join(numbered.hint("merge"), [*group, "n"]).join(ends.hint("merge"), [*group, "pos"])
    return hits.select(F.col("idx").alias("query_idx"), "subject_idx", (F.col("at") - F.col("pos")).alias("distance"))
