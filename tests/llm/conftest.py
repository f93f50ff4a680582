import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
DATA = "/root/testdata/sf0.001"

LONG = "lorem ipsum dolor " * 20_000
EDGES = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa", "a"),
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa", "a"),
    (2, None, "b"),
    (3, "", None),
    (None, "no id here, token: abcdef12345", "a"),
    (None, None, None),
    (4, " \n\t\n ", "b"),
    (5, LONG, "b"),
    (6, "é\u0301 😀 ñ Ünï\x00code\x1c \u3000 wide", ""),
    (7, "x" * 50_000, "b"),
    (8, "\n".join(["same line"] * 5), "a"),
]
EXTRA = ["size", "n_words", "n_lines", "key", "_text", "id", "kept", "class_id", "spans", "items", "shard", "start", "host", "target"]


@pytest.fixture
def edges(spark):
    """Rows with everything that may be missing, repeated or large, and columns named like results and helpers."""
    rows = [(*r, *["clash"] * len(EXTRA)) for r in EDGES]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, " + ", ".join(f"`{c}` string" for c in EXTRA))


@pytest.fixture
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture
def benchmark(spark):
    return spark.read.parquet(f"{DATA}/benchmark.parquet")
