"""Registered queries of the interval operators over the driver tables, each with SQL to check it against.

Range views of the tables use whole-number arithmetic only, so that they are the same in Spark and in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ranges as R
from .operators import compare, elements, inter, intra, lists, nearest, overlaps, setops, tiling, transcripts
from .plans import constraints
from .plans import seqinfo as info
from .sources import ingest

Query = Callable[[SparkSession, str], DataFrame]
SPACES = [f"chr{i}" for i in range(1, 11)]
LENGTH = 50100


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ranged(df: DataFrame, first: list[Column], space: Column, start: Column, width: Column, strand: Column, *more: Column) -> DataFrame:
    s = start.cast("int")
    return df.select(*first, F.concat(F.lit("chr"), (space % 10 + 1).cast("string")).alias("seqnames"), s.alias("start"), (s + width.cast("int") - 1).alias("end"), strand.alias("strand"), *more)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    strand = F.when(c("o_orderstatus") == "F", "+").when(c("o_orderstatus") == "O", "-").otherwise("*")
    return _ranged(_table(spark, sf_dir, "orders"), [c("o_orderkey").alias("idx")], c("o_custkey"), c("o_orderkey") * 37 % 50021 + 1, c("o_custkey") % 60, strand)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    strand = F.when(c("p_partkey") % 3 == 0, "+").when(c("p_partkey") % 3 == 1, "-").otherwise("*")
    return _ranged(_table(spark, sf_dir, "part"), [c("p_partkey").alias("idx")], c("p_partkey"), c("p_partkey") * 101 % 50021 + 1, c("p_size"), strand)


def part_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a list: four neighbouring keys a group."""
    return parts(spark, sf_dir).withColumn("group", F.floor(F.col("idx") / 4))


def order_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).withColumn("group", F.floor(F.col("idx") / 5))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as a list by order. They have no key of their own, so no idx."""
    c = F.col
    strand = F.when(c("l_returnflag") == "A", "+").when(c("l_returnflag") == "R", "-").otherwise("*")
    return _ranged(_table(spark, sf_dir, "lineitem"), [c("l_orderkey").alias("group")], c("l_suppkey"), c("l_partkey") * 37 % 50021 + 1, F.floor("l_quantity"), strand)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions: minutes since the start of 2024, a space per user."""
    minute = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 60000000)
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("seqnames"), minute.cast("int").alias("pos"), F.lit("*").alias("strand"))


def spaces(spark: SparkSession, circular: tuple[str, ...] = ()) -> DataFrame:
    return info.seqinfo(spark, SPACES, [LENGTH] * 10, [s in circular for s in SPACES], "driver")


_G = """g AS (SELECT o_orderkey AS idx, 'chr' || (o_custkey % 10 + 1) AS seqnames, CAST(o_orderkey * 37 % 50021 + 1 AS INTEGER) AS s,
 CAST(o_orderkey * 37 % 50021 + o_custkey % 60 AS INTEGER) AS e, CASE o_orderstatus WHEN 'F' THEN '+' WHEN 'O' THEN '-' ELSE '*' END AS strand FROM orders)"""
_P = """p AS (SELECT p_partkey AS idx, 'chr' || (p_partkey % 10 + 1) AS seqnames, CAST(p_partkey * 101 % 50021 + 1 AS INTEGER) AS s,
 CAST(p_partkey * 101 % 50021 + p_size AS INTEGER) AS e, CASE p_partkey % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '*' END AS strand FROM part)"""
_L = """l AS (SELECT l_orderkey AS grp, 'chr' || (l_suppkey % 10 + 1) AS seqnames, CAST(l_partkey * 37 % 50021 + 1 AS INTEGER) AS s,
 CAST(l_partkey * 37 % 50021 + floor(l_quantity) AS INTEGER) AS e, CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE '*' END AS strand FROM lineitem)"""
_S = """sp AS (SELECT CAST(i AS INTEGER) AS seqid, 'chr' || i AS seqnames, 50100 AS n FROM range(1, 11) t(i))"""
_W = f"WITH {_G}, {_P}, {_S} "
_OK = "(a.strand = '*' OR b.strand = '*' OR a.strand = b.strand)"
_SID = "CASE strand WHEN '+' THEN 1 WHEN '-' THEN 2 ELSE 3 END"


def _rows(start: str, end: str, strand: str = "strand", where: str = "true", source: str = "g") -> str:
    return f'{_W} SELECT idx, seqnames, CAST({start} AS INTEGER) AS "start", CAST({end} AS INTEGER) AS "end", {strand} AS strand FROM {source} WHERE {where}'


def _covered(keys: str, source: str, name: str, where: str = "true") -> str:
    """Covered positions, each once."""
    return f"{name} AS (SELECT DISTINCT {keys}, unnest(range(s, e + 1)) AS pos FROM {source} WHERE {where})"


def _runs(keys: str, source: str) -> str:
    """Runs of positions of source as ranges."""
    return f'SELECT {keys}, CAST(min(pos) AS INTEGER) AS "start", CAST(max(pos) AS INTEGER) AS "end" FROM (SELECT *, pos - row_number() OVER (PARTITION BY {keys} ORDER BY pos) AS k FROM {source}) GROUP BY {keys}, k'


def _unstranded(df: DataFrame) -> DataFrame:
    return df.select("idx", "seqnames", "start", "end", "strand")


_REGISTRY: dict[str, tuple[Query, str | None]] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    _REGISTRY[name] = (query, sql)


# Row-wise transforms
_MINUS = "strand = '-'"
for _name, _op, _sql in [
    ("i1_shift", lambda d: intra.shift(d, 100), _rows("s + 100", "e + 100")),
    ("i2_narrow", lambda d: intra.narrow(d.where("end >= start"), start=1, end=-1), _rows("s", "e", where="e >= s")),
    ("i2_narrow_tail", lambda d: intra.narrow(d.where("end >= start + 3"), start=-3, width=2), _rows("e - 2", "e - 1", where="e >= s + 3")),
    ("i3_resize_start", lambda d: intra.resize(d, 20), _rows(f"CASE WHEN {_MINUS} THEN e - 19 ELSE s END", f"CASE WHEN {_MINUS} THEN e ELSE s + 19 END")),
    ("i3_resize_end", lambda d: intra.resize(d, 20, "end"), _rows(f"CASE WHEN {_MINUS} THEN s ELSE e - 19 END", f"CASE WHEN {_MINUS} THEN s + 19 ELSE e END")),
    ("i3_resize_center", lambda d: intra.resize(d, 21, "center"), _rows("s + floor((e - s + 1 - 21) / 2.0)", "s + floor((e - s + 1 - 21) / 2.0) + 20")),
    ("i4_flank", lambda d: intra.flank(d, 10), _rows(f"CASE WHEN {_MINUS} THEN e + 1 ELSE s - 10 END", f"CASE WHEN {_MINUS} THEN e + 10 ELSE s - 1 END")),
    ("i4_flank_end", lambda d: intra.flank(d, 10, start=False), _rows(f"CASE WHEN {_MINUS} THEN s - 10 ELSE e + 1 END", f"CASE WHEN {_MINUS} THEN s - 1 ELSE e + 10 END")),
    ("i4_flank_both", lambda d: intra.flank(d, 10, both=True), _rows(f"CASE WHEN {_MINUS} THEN e - 9 ELSE s - 10 END", f"CASE WHEN {_MINUS} THEN e + 10 ELSE s + 9 END")),
    ("i5_promoters", lambda d: intra.promoters(d, 200, 20), _rows(f"CASE WHEN {_MINUS} THEN e - 19 ELSE s - 200 END", f"CASE WHEN {_MINUS} THEN e + 200 ELSE s + 19 END")),
    ("i6_terminators", lambda d: intra.terminators(d, 200, 20), _rows(f"CASE WHEN {_MINUS} THEN s - 19 ELSE e - 200 END", f"CASE WHEN {_MINUS} THEN s + 200 ELSE e + 19 END")),
    ("i7_restrict", lambda d: intra.restrict(d, 1000, 20000), _rows("greatest(s, 1000)", "least(e, 20000)", where="e >= 999 AND s <= 20001")),
    ("i7_restrict_keep_all", lambda d: intra.restrict(d, 1000, 20000, keep_all=True), _rows("least(greatest(s, 1000), 20001)", "greatest(least(e, 20000), 999)")),
    ("i9_invert_strand", intra.invert_strand, _rows("s", "e", "CASE strand WHEN '+' THEN '-' WHEN '-' THEN '+' ELSE '*' END")),
    ("i11_unstrand", intra.unstrand, _rows("s", "e", "'*'")),
    ("i10_set_strand", lambda d: intra.set_strand(d, F.when(F.col("idx") % 3 == 0, 1).when(F.col("idx") % 3 == 1, -1), "number"), _rows("s", "e", "CASE idx % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '*' END")),
    ("p2_set_width", lambda d: intra.set_width(d, 7), _rows("s", "s + 6")),
    ("p11_head", lambda d: compare.head(d, 25), _rows("s", "e", where="idx < 25")),
]:
    _add(_name, lambda spark, sf, op=_op: op(orders(spark, sf)), _sql)

_add("i8_trim", lambda spark, sf: intra.trim(intra.shift(orders(spark, sf), 60), spaces(spark)), _rows("CASE WHEN e + 60 > 50100 THEN least(s + 60, 50101) ELSE s + 60 END", "least(e + 60, 50100)"))
_add("p12_out_of_bounds", lambda spark, sf: intra.out_of_bounds(intra.shift(orders(spark, sf), 60), spaces(spark)), _rows("s + 60", "e + 60", where="e + 60 > 50100"))
_add("i13_absolute", lambda spark, sf: intra.absolute(orders(spark, sf), spaces(spark)), _rows("s + 50100 * (CAST(seqnames[4:] AS INTEGER) - 1)", "e + 50100 * (CAST(seqnames[4:] AS INTEGER) - 1)", "'*'").replace("SELECT idx, seqnames, CAST", "SELECT idx, 'genome' AS seqnames, CAST"))
_add("i14_relative", lambda spark, sf: intra.relative(intra.absolute(orders(spark, sf), spaces(spark)), spaces(spark)), _rows("s", "e", "'*'"))
_add("i15_is_small", lambda spark, sf: intra.is_small(spaces(spark)), "SELECT true AS is_small")
_add("i16_tile", lambda spark, sf: intra.tile(orders(spark, sf), width=7).select("idx", "seqnames", "tile", "start", "end"),
     _W + """, t AS (SELECT *, greatest(ceil((e - s + 1) / 7.0), 1) AS n FROM g), k AS (SELECT *, unnest(range(1, CAST(n AS BIGINT) + 1)) AS tile FROM t)
 SELECT idx, seqnames, CAST(tile AS INTEGER) AS tile, CAST(s + floor((e - s + 1) * (tile - 1) / n) AS INTEGER) AS "start", CAST(s + floor((e - s + 1) * tile / n) - 1 AS INTEGER) AS "end" FROM k""")
_add("i17_sliding_windows", lambda spark, sf: intra.sliding_windows(orders(spark, sf), 20, 5).select("idx", "seqnames", "window", "start", "end"),
     _W + """, k AS (SELECT *, unnest(range(1, CASE WHEN e - s + 1 > 20 THEN CAST(ceil((e - s + 1 - 20) / 5.0) AS BIGINT) + 2 ELSE 2 END)) AS w FROM g)
 SELECT idx, seqnames, CAST(w AS INTEGER) AS "window", CAST(s + (w - 1) * 5 AS INTEGER) AS "start", CAST(least(s + (w - 1) * 5 + 19, e) AS INTEGER) AS "end" FROM k""")

# Sources and projections
_add("s2_positions", lambda spark, sf: ingest.positions(parts(spark, sf)).select("idx", "seqnames", "pos", "strand"), _W + "SELECT idx, seqnames, CAST(unnest(range(s, e + 1)) AS INTEGER) AS pos, strand FROM p")
_add("s4_from_fragments", lambda spark, sf: ingest.from_fragments(_table(spark, sf, "part").select(F.col("p_partkey").alias("idx"), F.concat_ws(",", F.col("p_partkey"), F.col("p_partkey") + 100, F.lit("")).alias("a"), F.concat_ws(",", "p_size", "p_size", F.lit("")).alias("w")), "a", widths="w"),
     """SELECT p_partkey AS idx, CAST(k AS INTEGER) AS part, CAST(p_partkey + 100 * (k - 1) AS INTEGER) AS "start", CAST(p_partkey + 100 * (k - 1) + p_size - 1 AS INTEGER) AS "end" FROM part, range(1, 3) t(k)""")
_add("s5_from_frame", lambda spark, sf: ingest.from_frame(parts(spark, sf).select("idx", F.col("seqnames").alias("Chrom"), (F.col("start") - 1).alias("txStart"), F.col("end").alias("txEnd"), F.when(F.col("strand") == "*", ".").otherwise(F.col("strand")).alias("STRAND")), zero_based_starts=True, idx="idx"), _rows("s", "e", source="p"))
_add("s6_list_from_frame", lambda spark, sf: lists.split_by(parts(spark, sf), "seqnames").select("idx", "group", "group_name", "start", "end"), _W + 'SELECT idx, CAST(seqid AS BIGINT) AS "group", seqnames AS group_name, s AS "start", e AS "end" FROM p JOIN sp USING (seqnames)')
_add("s7_parse", lambda spark, sf: ingest.parse(parts(spark, sf).select("idx", F.concat("seqnames", F.lit(": "), "start", F.lit("-"), "end", F.lit(":"), "strand").alias("text")), "text").select("idx", "seqnames", "start", "end", "strand"), _rows("s", "e", source="p"))
_add("s8_format", lambda spark, sf: ingest.formatted(parts(spark, sf)).select("idx", "text"), _W + "SELECT idx, seqnames || ':' || CASE WHEN s = e THEN CAST(s AS VARCHAR) ELSE s || '-' || e END || ':' || strand AS text FROM p")
_add("s9_as_frame", lambda spark, sf: ingest.as_frame(parts(spark, sf)), _W + 'SELECT seqnames, s AS "start", e AS "end", e - s + 1 AS width, strand, idx FROM p')
_add("s10_event_positions", lambda spark, sf: events(spark, sf), "SELECT event_id AS idx, 'u' || user_id AS seqnames, CAST(floor((epoch_us(ts) - 1704067200000000) / 60000000.0) AS INTEGER) AS pos, '*' AS strand FROM events")
_add("s12_whole_spaces", lambda spark, sf: ingest.whole_spaces(spaces(spark)).select("seqnames", "start", "end"), f'WITH {_S} SELECT seqnames, 1 AS "start", 50100 AS "end" FROM sp')
_add("s13_per_space", lambda spark, sf: lists.per_space(parts(spark, sf)).select("seqnames", F.size("ranges").alias("n"), F.element_at("ranges", 1)["start"].alias("first_start")), _W + "SELECT seqnames, CAST(count(*) AS INTEGER) AS n, arg_min(s, idx) AS first_start FROM p GROUP BY seqnames")
_add("s16_as_positions", lambda spark, sf: ingest.as_positions(intra.resize(parts(spark, sf), 1)).select("idx", "seqnames", "pos", "strand"), _W + f"SELECT idx, seqnames, CASE WHEN {_MINUS} THEN e ELSE s END AS pos, strand FROM p")
_add("s18_factor", lambda spark, sf: lists.unfactor(*lists.factor_of(orders(spark, sf))), _rows("s", "e"))
_add("p8_coarse", lambda spark, sf: lists.keep_spaces(part_groups(spark, sf), spaces(spark).where("seqid <= 8"), "coarse").select("idx", "group"), _W + ', q AS (SELECT *, idx // 4 AS grp FROM p) SELECT idx, grp AS "group" FROM q WHERE grp NOT IN (SELECT grp FROM q WHERE seqnames IN (\'chr9\', \'chr10\'))')
_add("p8_fine", lambda spark, sf: lists.keep_spaces(part_groups(spark, sf), spaces(spark).where("seqid <= 8"), "fine").select("idx", "group"), _W + "SELECT idx, idx // 4 AS \"group\" FROM p WHERE seqnames NOT IN ('chr9', 'chr10')")
_add("p10_element_sizes", lambda spark, sf: lists.element_sizes(lines(spark, sf), orders(spark, sf).select(F.col("idx").alias("group"))), f'WITH {_L} SELECT o_orderkey AS "group", count(grp) AS n FROM orders LEFT JOIN l ON grp = o_orderkey GROUP BY 1')
_add("p10_concat", lambda spark, sf: lists.concat(parts(spark, sf), parts(spark, sf).withColumn("score", F.lit(1))), _W + 'SELECT idx, seqnames, s AS "start", e AS "end", strand, CAST(NULL AS INTEGER) AS score FROM p UNION ALL SELECT idx + (SELECT max(idx) FROM p), seqnames, s, e, strand, 1 FROM p')

# Aggregates within groups
_KEYS = "seqnames, strand"
_ISLANDS = """SELECT {k}, min(s) AS "start", max(e) AS "end" {more} FROM (SELECT *, sum(new) OVER (PARTITION BY {k} ORDER BY s, e, new DESC ROWS UNBOUNDED PRECEDING) AS island FROM
 (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY {k} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} OR row_number() OVER (PARTITION BY {k} ORDER BY s, e) = 1 THEN 1 ELSE 0 END AS new FROM {t})) GROUP BY {k}, island"""
_add("a1_span", lambda spark, sf: inter.span(orders(spark, sf)), _W + f'SELECT {_KEYS}, min(s) AS "start", max(e) AS "end" FROM g GROUP BY {_KEYS}')
_add("a2_merge", lambda spark, sf: inter.merge_ranges(orders(spark, sf)), _W + _ISLANDS.format(k=_KEYS, more="", gap=1, t="g"))
_add("a2_merge_blocks", lambda spark, sf: inter.merge_ranges(orders(spark, sf), block=2000), _W + _ISLANDS.format(k=_KEYS, more="", gap=1, t="g"))
_add("a2_merge_gap_unstranded", lambda spark, sf: inter.merge_ranges(orders(spark, sf), min_gap=5, ignore_strand=True), _W + ", u AS (SELECT seqnames, '*' AS strand, s, e FROM g) " + _ISLANDS.format(k=_KEYS, more="", gap=5, t="u"))
_add("a2_merge_revmap", lambda spark, sf: inter.merge_ranges(orders(spark, sf), revmap=True).select("seqnames", "strand", "start", "end", F.array_join("revmap", ",").alias("revmap")), _W + _ISLANDS.format(k=_KEYS, more=", string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) AS revmap", gap=1, t="g"))
_add("a2_merge_lists", lambda spark, sf: inter.merge_ranges(lines(spark, sf), by=("group",)).withColumnRenamed("group", "grp"), f"WITH {_L} " + _ISLANDS.format(k="grp, seqnames, strand", more="", gap=1, t="l"))
_add("a3_gaps", lambda spark, sf: inter.gaps(orders(spark, sf), spaces(spark)),
     _W + f", {_covered(_KEYS, 'g', 'c')}, f AS (SELECT seqnames, strand, unnest(range(1, 50101)) AS pos FROM sp, (VALUES ('+'), ('-'), ('*')) t(strand)), d AS (SELECT * FROM f EXCEPT SELECT seqnames, strand, pos FROM c) " + _runs(_KEYS, "d"))
_DISJOIN = ", x AS (SELECT {k}, s AS b FROM g UNION SELECT {k}, e + 1 FROM g), y AS (SELECT *, lead(b) OVER (PARTITION BY {k} ORDER BY b) - 1 AS z FROM x), c AS (SELECT DISTINCT {k}, unnest(range(s, e + 1)) AS pos FROM g) "
_add("a4_disjoin", lambda spark, sf: inter.disjoin(orders(spark, sf)), _W + _DISJOIN.format(k=_KEYS) + 'SELECT y.seqnames, y.strand, b AS "start", CAST(z AS INTEGER) AS "end" FROM y JOIN c ON y.seqnames = c.seqnames AND y.strand = c.strand AND b = pos')
_add("a4_disjoin_revmap", lambda spark, sf: inter.disjoin(parts(spark, sf), revmap=True).select("seqnames", "strand", "start", "end", F.array_join("revmap", ",").alias("revmap")),
     _W + ", x AS (SELECT seqnames, strand, s AS b FROM p UNION SELECT seqnames, strand, e + 1 FROM p), y AS (SELECT *, lead(b) OVER (PARTITION BY seqnames, strand ORDER BY b) - 1 AS z FROM x) SELECT y.seqnames, y.strand, b AS \"start\", CAST(z AS INTEGER) AS \"end\", string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) AS revmap FROM y JOIN p ON y.seqnames = p.seqnames AND y.strand = p.strand AND p.s <= b AND p.e >= z GROUP BY 1, 2, 3, 4")
_add("a5_is_disjoint", lambda spark, sf: inter.is_disjoint(orders(spark, sf)), _W + "SELECT count(*) = 0 AS is_disjoint FROM g a JOIN g b ON a.seqnames = b.seqnames AND a.strand = b.strand AND a.idx < b.idx AND a.s <= b.e AND b.s <= a.e AND a.s <= a.e AND b.s <= b.e")
_add("a5_is_disjoint_lists", lambda spark, sf: inter.is_disjoint(part_groups(spark, sf), by=("group",)), _W + ', q AS (SELECT *, idx // 4 AS grp FROM p) SELECT a.grp AS "group", count(b.idx) = 0 AS is_disjoint FROM q a LEFT JOIN q b ON a.grp = b.grp AND a.seqnames = b.seqnames AND a.strand = b.strand AND a.idx < b.idx AND a.s <= b.e AND b.s <= a.e GROUP BY a.grp')
_add("a6_disjoint_bins", lambda spark, sf: inter.disjoint_bins(orders(spark, sf)).select("idx", "bin"),
     _W.replace("WITH", "WITH RECURSIVE") + """, n AS (SELECT *, row_number() OVER (PARTITION BY seqnames, strand ORDER BY s, e, idx) AS n FROM g), t AS (
 SELECT seqnames, strand, n, idx, CAST(1 AS BIGINT) AS bin, [e] AS ends FROM n WHERE n = 1 UNION ALL
 SELECT seqnames, strand, n, idx, bin, CASE WHEN bin > len(ends) THEN list_append(ends, e) ELSE list_concat(list_append(ends[:bin - 1], e), ends[bin + 1:]) END FROM (
  SELECT n.seqnames, n.strand, n.n, n.idx, n.e, t.ends, coalesce(nullif(list_position(list_transform(t.ends, lambda x: x < n.s), true), 0), len(t.ends) + 1) AS bin FROM t JOIN n ON n.seqnames = t.seqnames AND n.strand = t.strand AND n.n = t.n + 1))
 SELECT idx, CAST(bin AS INTEGER) AS bin FROM t""")
_COVER = """, v AS (SELECT seqnames, pos, sum(w) AS v FROM (SELECT seqnames, unnest(range(s, e + 1)) AS pos, w FROM {t}) WHERE pos BETWEEN 1 AND 50100 GROUP BY 1, 2),
 f AS (SELECT sp.seqnames, t.pos, coalesce(v.v, 0) AS v FROM sp CROSS JOIN range(1, 50101) t(pos) LEFT JOIN v ON v.seqnames = sp.seqnames AND v.pos = t.pos),
 r AS (SELECT *, CASE WHEN v = lag(v) OVER w THEN 0 ELSE 1 END AS new FROM f WINDOW w AS (PARTITION BY seqnames ORDER BY pos)), q AS (SELECT *, sum(new) OVER (PARTITION BY seqnames ORDER BY pos) AS run FROM r)
 SELECT seqnames, CAST(min(pos) AS INTEGER) AS "start", CAST(max(pos) AS INTEGER) AS "end", CAST(any_value(v) AS BIGINT) AS value FROM q GROUP BY seqnames, run"""
_add("a7_coverage", lambda spark, sf: inter.coverage(orders(spark, sf), spaces(spark)), _W + ", u AS (SELECT *, 1 AS w FROM g)" + _COVER.format(t="u"))
_add("a7_coverage_blocks", lambda spark, sf: inter.coverage(orders(spark, sf), spaces(spark), block=3000), _W + ", u AS (SELECT *, 1 AS w FROM g)" + _COVER.format(t="u"))
_add("a7_coverage_weighted_shifted", lambda spark, sf: inter.coverage(orders(spark, sf), spaces(spark), shift=25, weight="idx"), _W + ", u AS (SELECT seqnames, s + 25 AS s, e + 25 AS e, idx AS w FROM g)" + _COVER.format(t="u"))
_add("a7_coverage_circular", lambda spark, sf: inter.coverage(orders(spark, sf), spaces(spark, ("chr10",)), shift=60),
     _W + ", u AS (SELECT seqnames, s + 60 AS s, e + 60 AS e, 1 AS w FROM g UNION ALL SELECT seqnames, s + 60 - 50100, e + 60 - 50100, 1 FROM g WHERE seqnames = 'chr10')" + _COVER.format(t="u"))
_add("a9_peaks", lambda spark, sf: inter.peaks(inter.coverage(orders(spark, sf), spaces(spark)), 3).select("seqnames", "start", "end", "area", "top"),
     _W + ", v AS (SELECT seqnames, pos, count(*) AS v FROM (SELECT seqnames, unnest(range(s, e + 1)) AS pos FROM g) WHERE pos <= 50100 GROUP BY 1, 2 HAVING count(*) >= 3) SELECT seqnames, CAST(min(pos) AS INTEGER) AS \"start\", CAST(max(pos) AS INTEGER) AS \"end\", CAST(sum(v) AS BIGINT) AS area, max(v) AS top FROM (SELECT *, pos - row_number() OVER (PARTITION BY seqnames ORDER BY pos) AS k FROM v) GROUP BY seqnames, k")
_add("a12_table", lambda spark, sf: inter.table_of(lines(spark, sf)), f'WITH {_L} SELECT seqnames, strand, s AS "start", e AS "end", count(*) AS n FROM l GROUP BY 1, 2, 3, 4')
_add("a13_phi", lambda spark, sf: inter.phi_coefficient(orders(spark, sf).select((F.col("strand") == "+").alias("x"), (R.width() > 30).alias("y")), "x", "y").select(F.round("phi", 9).alias("phi")), _W + "SELECT round(corr(CAST(strand = '+' AS INTEGER), CAST(e - s + 1 > 30 AS INTEGER)), 9) AS phi FROM g")

# Overlap joins
_JOIN = f"FROM g a JOIN p b ON a.seqnames = b.seqnames AND {_OK} AND "
_ANY = "b.s <= a.e AND b.e >= a.s"
_OV = "greatest(0, least(a.e, b.e) - greatest(a.s, b.s) + 1)"
_HIT = "SELECT a.idx AS query_idx, b.idx AS subject_idx "
for _name, _how, _test in [
    ("any", {}, _ANY),
    ("maxgap", {"maxgap": 4}, "b.s <= a.e + 5 AND b.e >= a.s - 5"),
    ("minoverlap", {"minoverlap": 10}, f"{_ANY} AND {_OV} >= 10"),
    ("start", {"kind": "start", "maxgap": 3}, "abs(a.s - b.s) <= 3"),
    ("end", {"kind": "end", "maxgap": 3}, "abs(a.e - b.e) <= 3"),
    ("within", {"kind": "within"}, "b.s <= a.s AND a.e <= b.e"),
    ("equal", {"kind": "equal", "maxgap": 5}, "abs(a.s - b.s) <= 5 AND abs(a.e - b.e) <= 5"),
]:
    _add(f"j1_overlaps_{_name}", lambda spark, sf, how=_how: overlaps.find_overlaps(orders(spark, sf), parts(spark, sf), **how), _W + _HIT + _JOIN + _test)
_add("j1_overlaps_unstranded", lambda spark, sf: overlaps.find_overlaps(orders(spark, sf), parts(spark, sf), ignore_strand=True), _W + _HIT + _JOIN.replace(_OK, "true") + _ANY)
_add("j1_overlaps_circular", lambda spark, sf: overlaps.find_overlaps(intra.shift(orders(spark, sf), 50000), parts(spark, sf), seqinfo=spaces(spark, ("chr10",))),
     _W + f"{_HIT} FROM g a JOIN p b ON a.seqnames = b.seqnames AND {_OK} AND ((b.s <= a.e + 50000 AND b.e >= a.s + 50000) OR (a.seqnames = 'chr10' AND ((b.s <= a.e - 100 AND b.e >= a.s - 100) OR (b.s + 50100 <= a.e - 100 AND b.e + 50100 >= a.s - 100) OR (b.s <= a.e - 100 + 50100 AND b.e >= a.s - 100 + 50100))))")
for _pick, _agg in (("first", "min"), ("last", "max")):
    _add(f"j3_select_{_pick}", lambda spark, sf, pick=_pick: overlaps.select_hits(orders(spark, sf), overlaps.find_overlaps(orders(spark, sf), parts(spark, sf)), pick), _W + f", h AS ({_HIT} {_JOIN} {_ANY}) SELECT g.idx AS query_idx, {_agg}(subject_idx) AS subject_idx FROM g LEFT JOIN h ON query_idx = idx GROUP BY 1")
_add("j4_count_overlaps", lambda spark, sf: overlaps.count_overlaps(orders(spark, sf), parts(spark, sf)), _W + f", h AS ({_HIT} {_JOIN} {_ANY}) SELECT g.idx AS query_idx, count(subject_idx) AS n FROM g LEFT JOIN h ON query_idx = idx GROUP BY 1")
_add("j4_count_overlaps_by_space", lambda spark, sf: overlaps.count_overlaps(orders(spark, sf), parts(spark, sf)).join(orders(spark, sf).select(F.col("idx").alias("query_idx"), "seqnames"), "query_idx").groupBy("seqnames").agg(F.sum("n").alias("hits"), F.count(F.lit(1)).alias("queries")),
     _W + f", h AS ({_HIT} {_JOIN} {_ANY}), n AS (SELECT g.idx, g.seqnames, count(subject_idx) AS n FROM g LEFT JOIN h ON query_idx = idx GROUP BY 1, 2) SELECT seqnames, CAST(sum(n) AS BIGINT) AS hits, count(*) AS queries FROM n GROUP BY 1")
_add("j5_subset", lambda spark, sf: overlaps.subset_by_overlaps(orders(spark, sf), parts(spark, sf)), _rows("s", "e", where=f"EXISTS (SELECT 1 FROM p b WHERE a.seqnames = b.seqnames AND {_OK} AND {_ANY})", source="g a"))
_add("j5_subset_invert", lambda spark, sf: overlaps.subset_by_overlaps(orders(spark, sf), parts(spark, sf), invert=True), _rows("s", "e", where=f"NOT EXISTS (SELECT 1 FROM p b WHERE a.seqnames = b.seqnames AND {_OK} AND {_ANY})", source="g a"))
_add("j5_overlaps_any", lambda spark, sf: overlaps.overlaps_any(orders(spark, sf), parts(spark, sf)), _W + f"SELECT idx AS query_idx, EXISTS (SELECT 1 FROM p b WHERE a.seqnames = b.seqnames AND {_OK} AND {_ANY}) AS overlaps FROM g a")
_PAIR = f"FROM g a JOIN p b ON a.idx = b.idx"
_add("j6_parallel_overlaps", lambda spark, sf: overlaps.parallel_overlaps(orders(spark, sf), intra.shift(orders(spark, sf), 20)), _W + f"SELECT idx, e - s + 1 - 20 >= 1 AS overlaps FROM g")
_LISTS = ", x AS (SELECT *, idx // 5 AS grp FROM g), y AS (SELECT *, idx // 4 AS grp FROM p), h AS (SELECT a.grp AS qg, b.grp AS sg, a.idx AS qi, b.idx AS si, " + _OV + f" AS ov FROM x a JOIN y b ON a.seqnames = b.seqnames AND {_OK} AND {{test}}) "
_add("j2_lists_any", lambda spark, sf: overlaps.find_overlaps_lists(order_groups(spark, sf), part_groups(spark, sf)), _W + _LISTS.format(test=_ANY) + "SELECT DISTINCT qg AS query_idx, sg AS subject_idx FROM h")
_add("j2_lists_minoverlap", lambda spark, sf: overlaps.find_overlaps_lists(order_groups(spark, sf), part_groups(spark, sf), minoverlap=20), _W + _LISTS.format(test=_ANY) + "SELECT qg AS query_idx, sg AS subject_idx FROM h GROUP BY 1, 2 HAVING sum(ov) >= 20")
_add("j2_lists_start", lambda spark, sf: overlaps.find_overlaps_lists(order_groups(spark, sf), part_groups(spark, sf), kind="start", maxgap=10), _W + _LISTS.format(test="abs(a.s - b.s) <= 10 AND b.idx % 4 = 0") + "SELECT DISTINCT qg AS query_idx, sg AS subject_idx FROM h")
_add("j2_list_flat", lambda spark, sf: overlaps.find_overlaps_lists(order_groups(spark, sf), parts(spark, sf), subject_flat=True), _W + _LISTS.format(test=_ANY) + "SELECT DISTINCT qg AS query_idx, si AS subject_idx FROM h")
_add("j2_flat_list_within", lambda spark, sf: overlaps.find_overlaps_lists(orders(spark, sf), part_groups(spark, sf), kind="within", query_flat=True), _W + _LISTS.format(test="b.s <= a.s AND a.e <= b.e") + "SELECT DISTINCT qi AS query_idx, sg AS subject_idx FROM h")

# Nearest neighbours
_RIGHT = "SELECT a.idx AS q, b.idx AS t, b.s - a.e AS gap FROM g a JOIN p b ON a.seqnames = b.seqnames AND b.s > a.e AND "
_LEFT = "SELECT a.idx AS q, b.idx AS t, a.s - b.e AS gap FROM g a JOIN p b ON a.seqnames = b.seqnames AND b.e < a.s AND "
_FWD, _REV, _SREV = "a.strand <> '-' AND b.strand <> '-'", "a.strand = '-' AND b.strand <> '+'", "a.strand = '*' AND b.strand = '-'"


def _directed_sql(name: str, ahead: str, back: str) -> str:
    return f", {name}_c AS ({ahead}{_FWD} UNION ALL {back}{_REV} UNION ALL {back}{_SREV}), {name} AS (SELECT q, t, gap FROM {name}_c QUALIFY gap = min(gap) OVER (PARTITION BY q))"


_PRE, _FOL = _directed_sql("pre", _RIGHT, _LEFT), _directed_sql("fol", _LEFT, _RIGHT)
_NEAR = f"SELECT CAST(q AS BIGINT) AS query_idx, CAST(t AS BIGINT) AS subject_idx, CAST(gap AS BIGINT) AS gap FROM "
_add("j7_precede", lambda spark, sf: nearest.precede(orders(spark, sf), parts(spark, sf)), _W + _PRE + _NEAR + "pre")
_add("j8_follow", lambda spark, sf: nearest.follow(orders(spark, sf), parts(spark, sf)), _W + _FOL + _NEAR + "fol")
_add("j7_precede_blocks", lambda spark, sf: nearest.precede(orders(spark, sf), parts(spark, sf), block=4000), _W + _PRE + _NEAR + "pre")
_OVER = f", ov AS ({_HIT} {_JOIN} b.s <= a.e + 1 AND b.e >= a.s - 1)"
_SIDES = ", sides AS (SELECT q, t, gap, 0 AS side FROM pre UNION ALL SELECT q, t, gap, 1 FROM fol), rest AS (SELECT * FROM sides WHERE q NOT IN (SELECT query_idx FROM ov))"
_add("j9_nearest_all", lambda spark, sf: nearest.nearest(orders(spark, sf), parts(spark, sf)),
     _W + _PRE + _FOL + _OVER + _SIDES + " SELECT query_idx, subject_idx, CAST(0 AS BIGINT) AS distance FROM ov UNION ALL SELECT DISTINCT q, t, CAST(gap - 1 AS BIGINT) FROM (SELECT * FROM rest QUALIFY rank() OVER (PARTITION BY q ORDER BY gap, side) = 1)")
_add("j11_distance_to_nearest", lambda spark, sf: nearest.distance_to_nearest(orders(spark, sf), parts(spark, sf)),
     _W + _PRE + _FOL + _OVER + _SIDES + ", one AS (SELECT q, side, gap, CASE side WHEN 0 THEN min(t) ELSE max(t) END AS t FROM rest GROUP BY 1, 2, 3) SELECT query_idx, max(subject_idx) AS subject_idx, CAST(0 AS BIGINT) AS distance FROM ov GROUP BY 1 UNION ALL SELECT q, t, CAST(gap - 1 AS BIGINT) FROM (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY q ORDER BY gap, t) = 1)")
_add("j10_distance", lambda spark, sf: nearest.distance(orders(spark, sf), intra.shift(orders(spark, sf), 40)), _W + "SELECT idx, greatest(0, s + 40 - e - 1) AS distance FROM g")
_KNN = f""", c AS (SELECT query_idx AS q, subject_idx AS t, 0 AS d, 2 AS side FROM ov UNION ALL SELECT a.idx, b.idx, b.s - a.e, 0 FROM g a JOIN p b ON a.seqnames = b.seqnames AND {_OK} AND b.s > a.e + 1
 UNION ALL SELECT a.idx, b.idx, a.s - b.e, 1 FROM g a JOIN p b ON a.seqnames = b.seqnames AND {_OK} AND b.e < a.s - 1), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, side, t) AS n, rank() OVER (PARTITION BY q ORDER BY d) AS k FROM c)
 SELECT q AS query_idx, t AS subject_idx, CAST(d AS BIGINT) AS distance, CAST(n AS INTEGER) AS rank FROM r WHERE """
_add("j12_k_nearest", lambda spark, sf: nearest.k_nearest(orders(spark, sf), parts(spark, sf), 3), _W + _OVER + _KNN + "n <= 3")
_add("j12_k_nearest_all", lambda spark, sf: nearest.k_nearest(orders(spark, sf), parts(spark, sf), 3, select="all"), _W + _OVER + _KNN + "k <= 3")
_add("j13_precedes", lambda spark, sf: nearest.precedes(orders(spark, sf), parts(spark, sf)), _W + f"SELECT a.idx, a.seqnames = b.seqnames AND CASE b.strand WHEN '-' THEN a.s > b.e ELSE a.e < b.s END AS precedes {_PAIR}")
_add("j13_follows", lambda spark, sf: nearest.follows(orders(spark, sf), parts(spark, sf)), _W + f"SELECT a.idx, a.seqnames = b.seqnames AND CASE b.strand WHEN '-' THEN a.e < b.s ELSE a.s > b.e END AS follows {_PAIR}")

# Equality, order, rank
_EQ = "a.seqnames = b.seqnames AND a.strand = b.strand AND a.s = b.s AND a.e = b.e"
_odd = lambda spark, sf: intra.resize(orders(spark, sf).withColumn("start", (F.col("start") % 50).cast("int")).withColumn("end", F.col("start")), 5)
_D = f", d AS (SELECT idx, seqnames, CASE WHEN {_MINUS} THEN s % 50 - 4 ELSE s % 50 END AS s, CASE WHEN {_MINUS} THEN s % 50 ELSE s % 50 + 4 END AS e, strand FROM g) "
# Both tables whole: 32 neighbouring keys share a place, so that rows have several matches at every scale and the output stays in proportion
_steps = lambda spark, sf: orders(spark, sf).withColumn("start", (F.floor(F.col("idx") / 32) * 5 + 1).cast("int")).withColumn("end", (F.col("start") + 4).cast("int"))
_next = lambda spark, sf: intra.shift(_steps(spark, sf), 5)
_T = ", x AS (SELECT idx, seqnames, CAST(idx // 32 * 5 + 1 AS INTEGER) AS s, CAST(idx // 32 * 5 + 5 AS INTEGER) AS e, strand FROM g), y AS (SELECT idx, seqnames, s + 5 AS s, e + 5 AS e, strand FROM x) "
_add("j14_match", lambda spark, sf: compare.match(_steps(spark, sf), _next(spark, sf)), _W + _T + f"SELECT a.idx, min(b.idx) AS match_idx FROM x a LEFT JOIN y b ON {_EQ} GROUP BY 1")
_add("j14_is_in", lambda spark, sf: compare.is_in(_steps(spark, sf), _next(spark, sf)).select("idx"), _W + _T + f"SELECT a.idx FROM x a WHERE EXISTS (SELECT 1 FROM y b WHERE {_EQ})")
_add("j15_merge_tables", lambda spark, sf: compare.merge_tables(_steps(spark, sf), _next(spark, sf)), _W + _T + f'SELECT a.seqnames, a.strand, a.s AS "start", a.e AS "end", a.idx AS idx_x, b.idx AS idx_y FROM x a JOIN y b ON {_EQ}')
_CODE = """CASE WHEN a.s = b.s AND a.e = b.e THEN 0 WHEN a.e < b.s - 1 THEN -6 WHEN a.e = b.s - 1 AND a.s < b.s THEN -5 WHEN a.s > b.e + 1 THEN 6 WHEN a.s = b.e + 1 AND a.s > b.s THEN 5 WHEN a.s < b.s AND a.e < b.e THEN -4 WHEN a.s < b.s AND a.e = b.e THEN -3
 WHEN a.s < b.s THEN -2 WHEN a.s = b.s AND a.e < b.e THEN -1 WHEN a.s = b.s THEN 1 WHEN a.e < b.e THEN 2 WHEN a.e = b.e THEN 3 ELSE 4 END"""
_sid = lambda t: _SID.replace("strand", f"{t}.strand")
_qid = lambda t: f"CAST({t}.seqnames[4:] AS INTEGER)"
_add("o1_compare", lambda spark, sf: compare.compare_rows(orders(spark, sf), parts(spark, sf), spaces(spark)), _W + f"SELECT a.idx, CAST({_CODE} + 13 * (sign({_sid('a')} - {_sid('b')}) + 3 * sign({_qid('a')} - {_qid('b')})) AS INTEGER) AS code {_PAIR}")
_add("o2_less", lambda spark, sf: compare.relation(orders(spark, sf), parts(spark, sf), "<", spaces(spark)), _W + f"SELECT a.idx, ({_qid('a')}, {_sid('a')}, a.s, a.e) < ({_qid('b')}, {_sid('b')}, b.s, b.e) AS holds {_PAIR}")
_add("o3_duplicated", lambda spark, sf: compare.duplicated(_odd(spark, sf)).select("idx", "duplicated"), _W + _D + "SELECT idx, row_number() OVER (PARTITION BY seqnames, strand, s, e ORDER BY idx) > 1 AS duplicated FROM d")
_add("o3_unique", lambda spark, sf: compare.unique_ranges(_odd(spark, sf), from_last=True).select("idx"), _W + _D + "SELECT max(idx) AS idx FROM d GROUP BY seqnames, strand, s, e")
_add("o4_self_match", lambda spark, sf: compare.self_match(_odd(spark, sf)), _W + _D + "SELECT idx, min(idx) OVER (PARTITION BY seqnames, strand, s, e) AS match_idx FROM d")
_add("o5_is_unsorted", lambda spark, sf: compare.is_unsorted(orders(spark, sf), spaces(spark)), _W + f"SELECT coalesce(bool_or(lk > k), false) AS is_unsorted FROM (SELECT (sp.seqid, {_SID}, s, e) AS k, lag((sp.seqid, {_SID}, s, e)) OVER (ORDER BY idx) AS lk FROM g JOIN sp USING (seqnames))")
_add("o6_order", lambda spark, sf: compare.order_of(_odd(spark, sf), spaces(spark)), _W + _D + f"SELECT idx, row_number() OVER (ORDER BY seqid, {_SID}, s, e, idx) AS place FROM d JOIN sp USING (seqnames)")
_add("o6_order_decreasing", lambda spark, sf: compare.order_of(_odd(spark, sf), spaces(spark), decreasing=True), _W + _D + f"SELECT idx, row_number() OVER (ORDER BY seqid DESC, {_SID} DESC, s DESC, e DESC, idx) AS place FROM d JOIN sp USING (seqnames)")
for _ties, _expr in (("min", "rank() OVER w"), ("max", "rank() OVER w + count(*) OVER (PARTITION BY seqid, strand, s, e) - 1"), ("first", "row_number() OVER v"), ("average", "rank() OVER w + (count(*) OVER (PARTITION BY seqid, strand, s, e) - 1) / 2.0")):
    _kind = "DOUBLE" if _ties == "average" else "BIGINT"
    _add(f"o8_rank_{_ties}", lambda spark, sf, ties=_ties: compare.rank_of(_odd(spark, sf), spaces(spark), ties), _W + _D + f"SELECT idx, CAST({_expr} AS {_kind}) AS rank FROM d JOIN sp USING (seqnames) WINDOW w AS (ORDER BY seqid, {_SID}, s, e), v AS (ORDER BY seqid, {_SID}, s, e, idx)")

# Set operations
_CG, _CP = _covered(_KEYS, "g", "cg"), _covered(_KEYS, "p", "cp")
for _name, _op, _sets in (("u1_union", setops.union_ranges, "UNION"), ("u2_intersect", setops.intersect_ranges, "INTERSECT"), ("u3_setdiff", setops.setdiff_ranges, "EXCEPT")):
    _sql = _W + f", {_CG}, {_CP}, d AS (SELECT * FROM cg {_sets} SELECT * FROM cp) " + _runs(_KEYS, "d")
    _add(_name, lambda spark, sf, op=_op: op(orders(spark, sf), parts(spark, sf)), _sql)
    _add(f"{_name}_blocks", lambda spark, sf, op=_op: op(orders(spark, sf), parts(spark, sf), block=2500), _sql)
_add("u4_intersect_lists", lambda spark, sf: setops.intersect_ranges(part_groups(spark, sf), intra.shift(part_groups(spark, sf), 3), by=("group",)).withColumnRenamed("group", "grp"),
     _W + ", a AS (SELECT idx // 4 AS grp, * FROM p), b AS (SELECT idx // 4 AS grp, seqnames, strand, s + 3 AS s, e + 3 AS e FROM p), " + _covered("grp, seqnames, strand", "a", "ca") + ", " + _covered("grp, seqnames, strand", "b", "cb") + ", d AS (SELECT * FROM ca INTERSECT SELECT * FROM cb) " + _runs("grp, seqnames, strand", "d"))
_near = lambda spark, sf: intra.shift(orders(spark, sf), 15)
_add("u6_parallel_union", lambda spark, sf: setops.parallel_union(orders(spark, sf), _near(spark, sf), fill_gap=True), _rows("s", "e + 15"))
_add("u7_parallel_intersect", lambda spark, sf: setops.parallel_intersect(orders(spark, sf), _near(spark, sf)), _W + 'SELECT idx, seqnames, CASE WHEN e - s + 1 >= 15 THEN s + 15 ELSE s END AS "start", CASE WHEN e - s + 1 >= 15 THEN e ELSE s - 1 END AS "end", strand, e - s + 1 >= 15 AS hit FROM g')
_add("u8_parallel_setdiff", lambda spark, sf: setops.parallel_setdiff(orders(spark, sf), _near(spark, sf)), _rows("s", "CASE WHEN e >= s + 15 THEN s + 14 ELSE e END"))
_add("u9_parallel_setdiff_list", lambda spark, sf: setops.parallel_setdiff_list(parts(spark, sf), parts(spark, sf).withColumn("start", (F.col("start") + 2).cast("int")).withColumn("end", F.least("end", F.col("start") + 1)).withColumn("group", F.col("idx"))),
     _W + ", x AS (SELECT idx, seqnames, strand, unnest(range(s, e + 1)) AS pos, s, e FROM p), d AS (SELECT * FROM x WHERE NOT (pos BETWEEN s + 2 AND least(e, s + 3))), k AS (SELECT *, pos - row_number() OVER (PARTITION BY idx ORDER BY pos) AS k FROM d), r AS (SELECT idx, seqnames, CAST(min(pos) AS INTEGER) AS \"start\", CAST(max(pos) AS INTEGER) AS \"end\", strand FROM k GROUP BY idx, seqnames, strand, k) SELECT *, CAST(row_number() OVER (PARTITION BY idx ORDER BY \"start\") AS INTEGER) AS piece FROM r")
_add("u10_parallel_gap", lambda spark, sf: setops.parallel_gap(orders(spark, sf), intra.shift(orders(spark, sf), 100)), _rows("e + 1", "s + 99"))
_add("u11_all_comparable", lambda spark, sf: setops.all_comparable(orders(spark, sf), parts(spark, sf)), _W + f"SELECT bool_and(a.seqnames = b.seqnames AND {_OK}) AS comparable {_PAIR}")
_add("j16_subtract", lambda spark, sf: setops.subtract(orders(spark, sf), parts(spark, sf)).select("idx", "seqnames", "start", "end", "strand"),
     _W + ", c AS (SELECT DISTINCT seqnames, strand, unnest(range(s, e + 1)) AS pos FROM p), x AS (SELECT idx, seqnames, strand, unnest(range(s, e + 1)) AS pos FROM g), d AS (SELECT * FROM x a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE a.seqnames = b.seqnames AND a.pos = b.pos AND " + _OK + ")), k AS (SELECT *, pos - row_number() OVER (PARTITION BY idx ORDER BY pos) AS k FROM d) SELECT idx, seqnames, CAST(min(pos) AS INTEGER) AS \"start\", CAST(max(pos) AS INTEGER) AS \"end\", strand FROM k GROUP BY idx, seqnames, strand, k UNION ALL SELECT idx, seqnames, s, e, strand FROM g WHERE e < s AND NOT EXISTS (SELECT 1 FROM p b WHERE false)")

# Tiles and variables
_add("t1_tile_axis", lambda spark, sf: tiling.tile_axis(spaces(spark), n=37),
     f"WITH {_S}, t AS (SELECT k AS tile, ceil(501000.0 * (k - 1) / 37) + 1 AS a, ceil(501000.0 * k / 37) AS b FROM range(1, 38) t(k)) SELECT tile, seqnames, CAST(greatest(a, (seqid - 1) * 50100 + 1) - (seqid - 1) * 50100 AS INTEGER) AS \"start\", CAST(least(b, seqid * 50100) - (seqid - 1) * 50100 AS INTEGER) AS \"end\" FROM t JOIN sp ON a <= seqid * 50100 AND b > (seqid - 1) * 50100")
_add("t2_tile_axis_width", lambda spark, sf: tiling.tile_axis(spaces(spark), tile_width=9999).groupBy("tile").agg(F.sum(R.width()).alias("width")), "SELECT k AS tile, CAST(ceil(501000.0 * k / 51) - ceil(501000.0 * (k - 1) / 51) AS BIGINT) AS width FROM range(1, 52) t(k)")
_add("t3_tile_spaces", lambda spark, sf: tiling.tile_spaces(spaces(spark), 7000), f'WITH {_S} SELECT seqnames, CAST(k * 7000 + 1 AS INTEGER) AS "start", CAST(least((k + 1) * 7000, 50100) AS INTEGER) AS "end" FROM sp, range(0, 8) t(k)')
_merged = lambda d: inter.merge_ranges(d, ignore_strand=True, drop_empty=True).withColumn("value", F.col("start") % 5)
_MERGED = ", {m}_c AS (SELECT DISTINCT seqnames, unnest(range(s, e + 1)) AS pos FROM {t}), {m} AS (SELECT seqnames, min(pos) AS s, max(pos) AS e, CAST(min(pos) % 5 AS INTEGER) AS value FROM (SELECT *, pos - row_number() OVER (PARTITION BY seqnames ORDER BY pos) AS k FROM {m}_c) GROUP BY seqnames, k)"
_add("t4_bind_variables", lambda spark, sf: tiling.bind_variables({"x": _merged(orders(spark, sf)), "y": _merged(parts(spark, sf))}),
     _W + _MERGED.format(m="m1", t="g") + _MERGED.format(m="m2", t="p") + ", b AS (SELECT seqnames, s AS b FROM m1 UNION SELECT seqnames, e + 1 FROM m1 UNION SELECT seqnames, s FROM m2 UNION SELECT seqnames, e + 1 FROM m2), c AS (SELECT *, lead(b) OVER (PARTITION BY seqnames ORDER BY b) - 1 AS z FROM b) SELECT c.seqnames, CAST(b AS INTEGER) AS \"start\", CAST(z AS INTEGER) AS \"end\", m1.value AS x, m2.value AS y FROM c LEFT JOIN m1 ON c.seqnames = m1.seqnames AND b BETWEEN m1.s AND m1.e LEFT JOIN m2 ON c.seqnames = m2.seqnames AND b BETWEEN m2.s AND m2.e WHERE z IS NOT NULL AND (m1.value IS NOT NULL OR m2.value IS NOT NULL)")
_add("t5_column_as_runs", lambda spark, sf: tiling.column_as_runs(_merged(parts(spark, sf)), "value", spaces(spark)),
     _W + _MERGED.format(m="m2", t="p") + ", f AS (SELECT sp.seqnames, t.pos, value FROM sp CROSS JOIN range(1, 50101) t(pos) LEFT JOIN m2 ON m2.seqnames = sp.seqnames AND t.pos BETWEEN m2.s AND m2.e), r AS (SELECT *, CASE WHEN pos > 1 AND value IS NOT DISTINCT FROM lag(value) OVER (PARTITION BY seqnames ORDER BY pos) THEN 0 ELSE 1 END AS new FROM f), q AS (SELECT *, sum(new) OVER (PARTITION BY seqnames ORDER BY pos) AS run FROM r) SELECT seqnames, CAST(min(pos) AS INTEGER) AS \"start\", CAST(max(pos) AS INTEGER) AS \"end\", any_value(value) AS value FROM q GROUP BY seqnames, run")
_add("t6_binned_average", lambda spark, sf: tiling.binned_average(parts(spark, sf), inter.coverage(orders(spark, sf), spaces(spark))).select("idx", F.round("average", 9).alias("average")),
     _W + ", v AS (SELECT seqnames, pos, count(*) AS v FROM (SELECT seqnames, unnest(range(s, e + 1)) AS pos FROM g) WHERE pos <= 50100 GROUP BY 1, 2) SELECT p.idx, round(coalesce(sum(v), 0) / any_value(e - s + 1), 9) AS average FROM p LEFT JOIN v ON p.seqnames = v.seqnames AND pos BETWEEN s AND e GROUP BY p.idx")
_add("s15_views", lambda spark, sf: tiling.views(parts(spark, sf), inter.coverage(orders(spark, sf), spaces(spark))).groupBy("view_idx").agg(F.sum(F.col("value") * R.width()).alias("area")),
     _W + ", v AS (SELECT seqnames, pos, count(*) AS v FROM (SELECT seqnames, unnest(range(s, e + 1)) AS pos FROM g) WHERE pos <= 50100 GROUP BY 1, 2) SELECT p.idx AS view_idx, CAST(coalesce(sum(v), 0) AS BIGINT) AS area FROM p LEFT JOIN v ON p.seqnames = v.seqnames AND pos BETWEEN s AND e WHERE s <= 50100 GROUP BY p.idx")
_add("i20_transcript_widths", lambda spark, sf: transcripts.transcript_widths(part_groups(spark, sf)), _W + 'SELECT idx // 4 AS "group", CAST(sum(e - s + 1) AS BIGINT) AS width FROM p GROUP BY 1')
_add("i20_to_reference", lambda spark, sf: transcripts.to_reference(part_groups(spark, sf).select("group").distinct().withColumn("tloc", F.lit(40)), part_groups(spark, sf)),
     _W + ", x AS (SELECT *, idx // 4 AS grp, sum(e - s + 1) OVER (PARTITION BY idx // 4 ORDER BY idx) AS upto FROM p) SELECT d.grp AS \"group\", 40 AS tloc, CAST(CASE x.strand WHEN '-' THEN x.e - (40 - (upto - (e - s + 1))) + 1 ELSE s + 40 - (upto - (e - s + 1)) - 1 END AS BIGINT) AS ref_pos FROM (SELECT DISTINCT grp FROM x) d LEFT JOIN x ON d.grp = x.grp AND 40 <= upto AND 40 > upto - (e - s + 1)")


# Lists, order of rows and checks
_add("s3_list_of", lambda spark, sf: lists.list_of(parts(spark, sf), intra.shift(parts(spark, sf), 5), names=["a", "b"]).select("group", "group_name", "idx", "start"), _W + 'SELECT CAST(1 AS BIGINT) AS "group", \'a\' AS group_name, idx, s AS "start" FROM p UNION ALL SELECT 2, \'b\', idx, s + 5 FROM p')
_add("p14_seqinfo_of", lambda spark, sf: info.seqinfo_of(orders(spark, sf)).select("seqid", "seqnames"), f"WITH {_S} SELECT seqid, seqnames FROM sp")
_add("o7_order_within", lambda spark, sf: lists.order_within(order_groups(spark, sf), spaces(spark)), _W + f'SELECT idx // 5 AS "group", idx, CAST(row_number() OVER (PARTITION BY idx // 5 ORDER BY seqid, {_SID}, s, e, idx) AS INTEGER) AS place FROM g JOIN sp USING (seqnames)')
_chain = lambda spark, sf: parts(spark, sf).withColumns({"seqnames": F.concat(F.lit("chr"), (F.floor(F.col("idx") / 10) % 10 + 1).cast("string")), "strand": F.lit("+"), "start": (F.col("idx") * 4).cast("int"), "end": (F.col("idx") * 4 + F.when(F.col("idx") % 3 == 0, 2).otherwise(3)).cast("int")})
_add("a8_stitch", lambda spark, sf: inter.stitch(_chain(spark, sf)),
     """WITH x AS (SELECT p_partkey AS idx, 'chr' || (p_partkey // 10 % 10 + 1) AS seqnames, CAST(p_partkey * 4 AS INTEGER) AS s, CAST(p_partkey * 4 + CASE p_partkey % 3 WHEN 0 THEN 2 ELSE 3 END AS INTEGER) AS e FROM part),
 y AS (SELECT *, CASE WHEN lag(seqnames) OVER w = seqnames AND lag(e) OVER w + 1 = s THEN 0 ELSE 1 END AS new FROM x WINDOW w AS (ORDER BY idx)), z AS (SELECT *, sum(new) OVER (ORDER BY idx) AS run FROM y)
 SELECT min(idx) AS idx, any_value(seqnames) AS seqnames, '+' AS strand, min(s) AS "start", max(e) AS "end" FROM z GROUP BY run""")
_add("j2_lists_within", lambda spark, sf: overlaps.find_overlaps_lists(part_groups(spark, sf), intra.resize(part_groups(spark, sf), 60, "center"), kind="within"),
     _W + f", x AS (SELECT *, idx // 4 AS grp FROM p), y AS (SELECT idx, grp, seqnames, strand, s + CAST(floor((e - s + 1 - 60) / 2.0) AS INTEGER) AS s, s + CAST(floor((e - s + 1 - 60) / 2.0) AS INTEGER) + 59 AS e FROM x), h AS (SELECT a.grp AS qg, b.grp AS sg, count(DISTINCT a.idx) AS n FROM x a JOIN y b ON a.seqnames = b.seqnames AND {_OK} AND b.s <= a.s AND a.e <= b.e GROUP BY 1, 2) SELECT qg AS query_idx, sg AS subject_idx FROM h WHERE n = (SELECT count(*) FROM x WHERE grp = qg)")
_add("j2_lists_equal", lambda spark, sf: overlaps.find_overlaps_lists(part_groups(spark, sf), part_groups(spark, sf).withColumn("end", F.when(F.col("group") % 3 == 0, F.col("end") + 1).otherwise(F.col("end")).cast("int")), kind="equal"),
     _W + f", x AS (SELECT *, idx // 4 AS grp FROM p), y AS (SELECT idx, grp, seqnames, strand, s, CASE grp % 3 WHEN 0 THEN e + 1 ELSE e END AS e FROM x), h AS (SELECT a.grp AS qg, b.grp AS sg, count(DISTINCT a.idx) AS n, count(DISTINCT b.idx) AS m FROM x a JOIN y b ON a.seqnames = b.seqnames AND {_OK} AND a.s = b.s AND a.e = b.e GROUP BY 1, 2) SELECT qg AS query_idx, sg AS subject_idx FROM h WHERE n = (SELECT count(*) FROM x WHERE grp = qg) AND m = (SELECT count(*) FROM y WHERE grp = sg)")
_add("u7_intersect_lists", lambda spark, sf: setops.parallel_intersect_list(order_groups(spark, sf), orders(spark, sf)).select("group", "idx", "start", "end", "hit"),
     _W + f', x AS (SELECT a.idx // 5 AS grp, a.idx, a.s AS s0, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e, a.seqnames = b.seqnames AND {_OK} AND least(a.e, b.e) >= greatest(a.s, b.s) - 1 AS hit FROM g a JOIN g b ON a.idx // 5 = b.idx) SELECT grp AS "group", idx, CASE WHEN hit THEN s ELSE s0 END AS "start", CASE WHEN hit THEN e ELSE s0 - 1 END AS "end", hit FROM x')
_add("j9_nearest_in_self", lambda spark, sf: nearest.nearest_in_self(parts(spark, sf), ignore_strand=True, ties="both"),
     _W + ", o AS (SELECT a.idx AS q, b.idx AS t FROM p a JOIN p b ON a.seqnames = b.seqnames AND a.idx <> b.idx AND b.s <= a.e + 1 AND b.e >= a.s - 1), c AS (SELECT a.idx AS q, b.idx AS t, greatest(b.s - a.e, a.s - b.e) - 1 AS d FROM p a JOIN p b ON a.seqnames = b.seqnames AND (b.s > a.e OR b.e < a.s) WHERE a.idx NOT IN (SELECT q FROM o)) SELECT q AS query_idx, t AS subject_idx, CAST(0 AS BIGINT) AS distance FROM o UNION ALL SELECT q, t, CAST(d AS BIGINT) FROM (SELECT * FROM c QUALIFY d = min(d) OVER (PARTITION BY q))")
_add("m_constraints", lambda spark, sf: constraints.violations(orders(spark, sf), "stranded"), _W + "SELECT CASE WHEN count(*) > 0 THEN 'stranded' END AS failed FROM g WHERE strand = '*'")

# Rows and elements by place
_flat = lambda d: d.select("idx", "seqnames", "start", "end", "strand")
_listed = lambda spark, sf: part_groups(spark, sf).select("group", "idx", "seqnames", "start", "end", "strand")
_Q = ", q AS (SELECT idx // 4 AS grp, idx, seqnames, strand, s, e FROM p) "
_LISTED = 'grp AS "group", idx, seqnames, s AS "start", e AS "end", strand'
_add("s1_ranges", lambda spark, sf: ingest.ranges(spark, "chr1", range(1, 2001, 10), width=5, strand="+"), """SELECT i + 1 AS idx, 'chr1' AS seqnames, CAST(1 + 10 * i AS INTEGER) AS "start", CAST(5 + 10 * i AS INTEGER) AS "end", '+' AS strand FROM range(0, 200) t(i)""")
_add("s1_checked", lambda spark, sf: ingest.checked(parts(spark, sf)), _rows("s", "e", source="p"))
_add("s11_list_as_frame", lambda spark, sf: ingest.as_frame(_listed(spark, sf)).select("group", "idx", "seqnames", "start", "end", "width", "strand"), _W + _Q + f"SELECT {_LISTED}, e - s + 1 AS width FROM q")
_add("s17_nested_and_back", lambda spark, sf: lists.flat(lists.nested(_listed(spark, sf))), _W + _Q + f"SELECT {_LISTED} FROM q")
_add("s14_runs_as_ranges", lambda spark, sf: elements.runs_as_ranges(inter.coverage(orders(spark, sf), spaces(spark)), spaces(spark)),
     _W + ", u AS (SELECT *, 1 AS w FROM g)" + _COVER.format(t="u").replace(" SELECT seqnames, CAST(min(pos)", ", o AS (SELECT seqnames, CAST(min(pos)") + ") SELECT CAST(50100 * (CAST(seqnames[4:] AS INTEGER) - 1) + \"start\" AS BIGINT) AS idx, seqnames, \"start\", \"end\", '*' AS strand, value AS score FROM o")
_add("s20_grouping", lambda spark, sf: elements.grouping_of(_odd(spark, sf)), _W + _D + 'SELECT idx, min(idx) OVER w AS "group", count(*) OVER w AS size FROM d WINDOW w AS (PARTITION BY seqnames, strand, s, e)')
_add("p4_replace_rows", lambda spark, sf: _flat(elements.replace_rows(orders(spark, sf), intra.shift(parts(spark, sf), 7).join(orders(spark, sf).select("idx"), "idx", "left_semi"))),
     _W + 'SELECT a.idx, coalesce(b.seqnames, a.seqnames) AS seqnames, coalesce(b.s + 7, a.s) AS "start", coalesce(b.e + 7, a.e) AS "end", coalesce(b.strand, a.strand) AS strand FROM g a LEFT JOIN p b ON a.idx = b.idx')
_add("p4_replace_column", lambda spark, sf: _flat(elements.replace_rows(parts(spark, sf), intra.invert_strand(parts(spark, sf)), ["strand"])), _rows("s", "e", "CASE strand WHEN '+' THEN '-' WHEN '-' THEN '+' ELSE '*' END", source="p"))
_add("p5_replace_elements", lambda spark, sf: elements.replace_elements(_listed(spark, sf), intra.shift(_listed(spark, sf), 9), overlaps.subset_by_overlaps(_listed(spark, sf), orders(spark, sf))),
     _W + _Q + f", h AS (SELECT DISTINCT b.grp FROM q b JOIN g a ON a.seqnames = b.seqnames AND {_OK} AND {_ANY}) SELECT grp AS \"group\", idx, seqnames, CAST(CASE WHEN grp IN (SELECT grp FROM h) THEN s + 9 ELSE s END AS INTEGER) AS \"start\", CAST(CASE WHEN grp IN (SELECT grp FROM h) THEN e + 9 ELSE e END AS INTEGER) AS \"end\", strand FROM q")
_add("p5_take_elements", lambda spark, sf: elements.take_elements(_listed(spark, sf), _listed(spark, sf).select("group").distinct(), _listed(spark, sf).where("strand = '-'"))[0], _W + _Q + f"SELECT {_LISTED} FROM q WHERE grp IN (SELECT grp FROM q WHERE strand = '-')")
_add("p6_slice_variable", lambda spark, sf: elements.slice_variable(inter.coverage(orders(spark, sf), spaces(spark)), parts(spark, sf).where(F.col("end") <= LENGTH)).select("idx", F.size("runs").alias("runs"), F.aggregate("runs", F.lit(0).cast("bigint"), lambda a, r: a + r["length"]).alias("width"), F.aggregate("runs", F.lit(0).cast("bigint"), lambda a, r: a + r["length"] * r["value"]).alias("area")),
     _W + ", u AS (SELECT *, 1 AS w FROM g)" + _COVER.format(t="u").replace(" SELECT seqnames, CAST(min(pos)", ", o AS (SELECT seqnames, CAST(min(pos)") + ") SELECT p.idx, CAST(count(*) AS INTEGER) AS runs, CAST(sum(least(e, \"end\") - greatest(s, \"start\") + 1) AS BIGINT) AS width, CAST(sum((least(e, \"end\") - greatest(s, \"start\") + 1) * value) AS BIGINT) AS area FROM p JOIN o ON p.seqnames = o.seqnames AND o.\"start\" <= e AND o.\"end\" >= s WHERE e <= 50100 GROUP BY p.idx")
_add("p7_set_column", lambda spark, sf: elements.set_column(_listed(spark, sf), lists.order_within(_listed(spark, sf), spaces(spark)).select("group", "place", F.col("place").alias("value")), "score").select("group", "idx", "score"), _W + _Q + 'SELECT grp AS "group", idx, CAST(row_number() OVER (PARTITION BY grp ORDER BY idx) AS INTEGER) AS score FROM q')
_add("i12_compatible_strand", lambda spark, sf: overlaps.side_by_side(orders(spark, sf), parts(spark, sf)).select(F.col("q_idx").alias("idx"), R.compatible(F.col("q_strand"), F.col("s_strand")).alias("compatible")), _W + f"SELECT a.idx, {_OK} AS compatible {_PAIR}")
_add("i18_list_flank", lambda spark, sf: intra.flank(_listed(spark, sf), 10), _W + _Q + f'SELECT grp AS "group", idx, seqnames, CASE WHEN {_MINUS} THEN e + 1 ELSE s - 10 END AS "start", CASE WHEN {_MINUS} THEN e + 10 ELSE s - 1 END AS "end", strand FROM q')
_add("a10_span_lists", lambda spark, sf: inter.span(part_groups(spark, sf), by=("group",)), _W + _Q + 'SELECT grp AS "group", seqnames, strand, min(s) AS "start", max(e) AS "end" FROM q GROUP BY 1, 2, 3')
_tight = lambda spark, sf: elements.local_idx(_listed(spark, sf).withColumn("seqnames", F.lit("chr1")))
_add("a11_local_revmap", lambda spark, sf: inter.span(_tight(spark, sf), ignore_strand=True, revmap=True, by=("group",)).select("group", "start", "end", F.array_join("revmap", ",").alias("revmap")),
     _W + _Q + ', k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY idx) AS n FROM q) SELECT grp AS "group", min(s) AS "start", max(e) AS "end", string_agg(CAST(n AS VARCHAR), \',\' ORDER BY n) AS revmap FROM k GROUP BY 1')


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _REGISTRY.items() if sql is not None}
