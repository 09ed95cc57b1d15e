"""The query over secrets gives the digests of its operator's spans."""

import hashlib

from pyspark.sql import functions as F

from quiverdf.llm import secrets as S
from quiverdf.llm._shared import first_rows

FOLDER = "/root/testdata/sf0.01"


def test_digests(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    rank = S.ranked(S.common_words(spark.read.parquet(f"{FOLDER}/documents.parquet")))
    rows = S.op3_secret_scan(spark, FOLDER).collect()
    assert len(rows) == len(texts) and sum(r["n_assign"] + r["n_access"] + r["n_hex"] for r in rows) > 0
    for r in rows:
        said = [(k, f"{k}:{a}:{b}") for a, b, k, _ in S.find_spans(texts[r["doc_id"]], rank=rank)]
        assert r["spans"] == ",".join(x for _, x in said)
        base = [x for k, x in said if k != "guess"]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == want for k, _ in said) for want in S.KINDS[:3]]


def test_first_rows(spark):
    """Ties go by the next column, fewer rows than asked for are all there, none give none."""
    rows = [(f"w{i:04d}", i * 7919 % 13) for i in range(3000)]
    df = spark.createDataFrame(rows, "word string, n int").repartition(7)
    for most in (0, 1, 50, 3000, 5000):
        got = [tuple(r) for r in first_rows(df, [F.desc("n"), "word"], ["word"], most).collect()]
        assert got == sorted(rows, key=lambda r: (-r[1], r[0]))[:most]
    assert first_rows(df.where("false"), ["word"], ["word"], 5).collect() == []
