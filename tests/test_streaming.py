from spanforge.operators import inter
from spanforge.sources.ingest import ranges
from spanforge.streaming import coverage


def test_streamed_coverage_is_that_of_the_whole(spark, tmp_path):
    parts = [ranges(spark, ["A", "B"], [3, 1], width=[4, 2]), ranges(spark, ["A"], [5], width=9)]
    for k, p in enumerate(parts):
        p.write.parquet(f"file://{tmp_path}/in/part{k}")
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    out = f"file://{tmp_path}/out"
    query = coverage.record(stream, out).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(tuple(r) for r in coverage.current(spark, out).select("seqnames", "start", "end", "value").collect())
    whole = inter.coverage(parts[0].unionByName(parts[1])).where("value > 0").select("seqnames", "start", "end", "value")
    assert got == sorted(tuple(r) for r in whole.collect())
