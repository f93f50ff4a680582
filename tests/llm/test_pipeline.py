"""The pipeline stage by stage against plain versions, and the contract of the entry module."""

import brute
import numpy as np
import pytest
from conftest import DATA

import corpus_pipeline
from spanforge.llm import decontam, queries, sketch
from spanforge.llm.align import similar


def test_stages(spark, benchmark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [tuple(r) for r in benchmark.collect()]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, DATA)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        docs.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = (before, docs)
        if name != "token_files":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    was, now = (x.collect() for x in seen["quality_rules"])
    kept = {r.doc_id for r in now}
    assert all(not brute.quality_base(r.text)[5] for r in now) and len(kept) < len(was)
    was, now = (x.collect() for x in seen["near_duplicates"])
    words = lambda r: sketch.word_hashes([r.text.lower().encode()])[0].astype(np.uint32)
    left = {r.doc_id: words(r) for r in now}
    for a in was:
        if a.doc_id not in left:
            assert any(similar(words(a), w, 0.7) for w in left.values())
    ids = sorted(left)
    assert not any(similar(left[a], left[b], 0.8) for k, a in enumerate(ids) for b in ids[k + 1 :])
    was, now = (x.collect() for x in seen["decontamination"])
    hit = brute.contaminated([(r.doc_id, r.text) for r in was], items)
    after = {r.doc_id: r for r in now}
    for r in was:
        if hit[r.doc_id][4]:
            assert len(brute.bench_words(after[r.doc_id].text)) == hit[r.doc_id][0] - hit[r.doc_id][1]
        else:
            assert after[r.doc_id] == r
    was, now = (x.collect() for x in seen["source_mix"])
    copies = [sum(x.doc_id == r.doc_id for x in now) for r in was]
    assert max(copies) == 2
    mixed, files = (x.collect() for x in seen["token_files"])
    assert sorted(r.doc_id for r in files) == sorted(r.doc_id for r in mixed)
    run = corpus_pipeline.run(spark, DATA)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, files))


def test_every_operator_is_registered():
    names = queries.queries()
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)
    assert decontam.BLOCK_CHARS > 0 and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", ["op6_url_filter"])
def test_query_runs(spark, name):
    assert queries.queries()[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/pages.parquet").count()
