"""Queries over whole tables, against their SQL, on a scale at which a fixed subset would show."""

from collections import Counter

import duckdb
import pytest

from spanforge import catalog

DATA = "/root/testdata/sf0.01"


NAMES = ["u9_parallel_setdiff_list", "j14_match", "j14_is_in", "j15_merge_tables", "a6_disjoint_bins", "s1_ranges", "s1_checked", "s11_list_as_frame", "s14_runs_as_ranges", "s17_nested_and_back", "s20_grouping"]
NAMES += ["p4_replace_rows", "p4_replace_column", "p5_replace_elements", "p5_take_elements", "p6_slice_variable", "p7_set_column", "i12_compatible_strand", "i18_list_flank", "a10_span_lists", "a11_local_revmap"]


@pytest.mark.parametrize("name", NAMES)
def test_whole_tables(spark, name):
    con = duckdb.connect()
    for t in ("orders", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cur = con.execute(catalog.oracle_sql()[name])
    columns, want = [c[0] for c in cur.description], Counter(cur.fetchall())
    df = catalog.queries()[name](spark, DATA)
    rows = df.select(*columns).collect()
    assert set(df.columns) == set(columns) and Counter(tuple(r) for r in rows) == want
    if name.startswith("u9"):
        assert sum(r.idx >= 400 for r in rows) > sum(r.idx < 400 for r in rows) > 0
    if name.startswith("j15"):
        assert {r.idx_y % 500 for r in rows} == set(range(500)) and max(Counter(r.idx_x for r in rows).values()) > 1
