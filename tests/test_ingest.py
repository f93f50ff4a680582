import pytest

from spanforge.sources import ingest


def test_column_resolution():
    ok = lambda cols, **how: ingest.resolve_columns(cols, **how)
    assert ok(["chrom", "Start", "STOP", "Strand"]) == {"seqnames": "chrom", "start": "Start", "end": "STOP", "width": None, "strand": "Strand"}
    assert ok(["txChrom", "chrom", "txStart", "txEnd"])["seqnames"] == "txChrom"
    assert ok(["chrom", "txStart", "txEnd", "strand"])["start"] == "txStart"
    for bad in (["start", "end"], ["chr", "start"], ["chr", "seqid", "start", "end"], ["chr", "start", "end", "stop"], ["chr", "aStart", "aEnd", "bStart", "bEnd"]):
        with pytest.raises(ValueError):
            ok(bad)
    assert ok(["chr", "pos"], start=["pos"], end=["pos"])["end"] == "pos"


def test_from_frame(spark):
    df = spark.createDataFrame([("chr1", 10, 12, ".", 5), ("chr2", None, 3, "-", 6)], "chr string, start int, end int, strand string, x int")
    assert ingest.from_frame(df, na_rm=True, zero_based_starts=True, keep_extra=True).collect() == [("chr1", 11, 12, "*", 5)]
    with pytest.raises(Exception, match="no start"):
        ingest.from_frame(df).collect()


def test_parse(spark):
    texts = ["chrX:21-3.5e+03", "chr1: +21 \t-+30.5:-", "1:-15--3:*", "chr..Y:-21..-3:", "chr1-X: \t 21 ..  \t+30  \t\t:+", "a:7"]
    df = ingest.parse(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    assert [tuple(r)[1:] for r in df.collect()] == [("chrX", 21, 3500, "*"), ("chr1", 21, 30, "-"), ("1", -15, -3, "*"), ("chr..Y", -21, -3, "*"), ("chr1-X", 21, 30, "+"), ("a", 7, 7, "*")]
    for bad in ("chr1", "chr1:5-2", "chr1:a-b", ":1-2x"):
        with pytest.raises(Exception, match="not a range"):
            ingest.parse(spark.createDataFrame([(bad,)], "t string"), "t").collect()


def test_fragments(spark):
    df = spark.createDataFrame([("a", "1,10,", "5,3,"), ("b", "7", "2")], "id string, s string, w string")
    got = [(r.id, r.part, r.start, r.end) for r in ingest.from_fragments(df, "s", widths="w").orderBy("id", "part").collect()]
    assert got == [("a", 1, 1, 5), ("a", 2, 10, 12), ("b", 1, 7, 8)]
    with pytest.raises(Exception, match="as many"):
        ingest.from_fragments(spark.createDataFrame([("1,2", "3")], "s string, w string"), "s", widths="w").collect()


def test_bed_round_trip(spark, tmp_path):
    x = ingest.ranges(spark, ["chr1", "chr2"], [1, 5], end=[10, 7], strand=["+", "*"], name=["a", None])
    ingest.write_bed(x, f"file://{tmp_path}/bed")
    back = ingest.read_bed(spark, f"file://{tmp_path}/bed").orderBy("seqnames").select("seqnames", "start", "end", "strand").collect()
    assert back == [("chr1", 1, 10, "+"), ("chr2", 5, 7, "*")]


def test_constructor_and_format(spark):
    with pytest.raises(ValueError):
        ingest.ranges(spark, ["a", "b", "c"], [1, 2], width=1)
    x = ingest.ranges(spark, "a", [1, 5], width=[3, 1])
    assert [r.text for r in ingest.formatted(x).orderBy("idx").collect()] == ["a:1-3", "a:5"]
    assert [r.pos for r in ingest.positions(x).orderBy("pos").collect()] == [1, 2, 3, 5]
    with pytest.raises(Exception, match="one position"):
        ingest.as_positions(x).collect()
