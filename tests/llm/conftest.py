"""Small documents with every awkward case."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A function that makes documents of texts (or of (doc_id, text) pairs), scattered over partitions."""

    def make(rows, **columns):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(i, t, "en", columns.get("source", {}).get(i, "src"), len(t or "")) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3, "doc_id")

    return make


@pytest.fixture
def awkward(docs):
    """Nulls, empty and blank texts, one very long text, ties, repeated rows and columns with clashing names."""
    rows = [
        (0, None), (1, ""), (2, " \t\n"), (3, "word " * 30_000), (4, "same text here"), (5, "same  text\nhere"),
        (5, "same  text\nhere"), (None, "same text here"), (None, None), (6, "Ünïcode ſtraße 你好 🙂"), (7, "x"),
    ]
    from pyspark.sql import functions as F

    extra = {c: F.lit("own") for c in ("size", "kept", "shard", "slot", "grp", "rank", "n", "seed", "key", "digest", "word", "node")}
    return docs(rows).withColumns(extra)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}
