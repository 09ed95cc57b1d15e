"""Reading, writing and making tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverdf.sources import fvec, tables

GOLDEN = np.array([[-1.1, 2.1, 0.3, 1.7], [1.2, 3.1, -0.9, 1.8]], np.float32)


def rows(df):
    return [(r["vec_id"], [round(v, 5) for v in r["embedding"]]) for r in df.orderBy("vec_id").collect()]


def test_golden_file(spark, tmp_path):
    (tmp_path / "g.fvec").write_bytes(fvec.to_bytes(GOLDEN))
    want = [(0, [-1.1, 2.1, 0.3, 1.7]), (1, [1.2, 3.1, -0.9, 1.8])]
    read = fvec.read_fvecs(spark, str(tmp_path / "g.fvec"))
    assert rows(read) == want
    assert rows(tables.read_range(read, 0, 0.5)) == want[:1]
    assert rows(tables.read_range(read, 0.5, 1)) == want[1:]


def test_headerless_and_several_files(spark, tmp_path):
    for i in (0, 1):
        (tmp_path / f"{i}.raw").write_bytes(fvec.to_bytes(GOLDEN + i, header=False))
    read = fvec.read_fvecs(spark, *[str(tmp_path / f"{i}.raw") for i in (0, 1)], dim=4)
    assert [i for i, _ in rows(read)] == [0, 1, 2, 3]


def test_bad_files_are_errors():
    with pytest.raises(ValueError):
        fvec.parse(fvec.to_bytes(GOLDEN)[:-4])
    broken = bytearray(fvec.to_bytes(GOLDEN))
    broken[20:24] = (3).to_bytes(4, "little")
    with pytest.raises(ValueError):
        fvec.parse(bytes(broken))
    assert fvec.parse(b"").shape[0] == 0


def test_round_trip_through_the_data_source(spark, tmp_path, vectors):
    x = np.arange(15.0).reshape(5, 3) + 1
    size = fvec.write_fvecs(vectors(x), str(tmp_path / "out"))
    assert size == 5 * 4 * 4
    read = spark.read.format("fvec").option("range", 32).load(str(tmp_path / "out"))
    assert read.rdd.getNumPartitions() >= 3
    assert rows(read) == [(i, row.tolist()) for i, row in enumerate(x)]


def test_concatenated_and_mismatch(vectors):
    a, b = (vectors(np.arange(100.0).reshape(10, 10) + s) for s in (0, 100))
    both = rows(tables.concatenated(a, b))
    assert [v for _, r in both for v in r] == list(np.arange(200.0))
    with pytest.raises(ValueError):
        tables.concatenated(a, vectors([[1.0]]))


def test_generated_tables(spark):
    assert tables.generated(spark, 3, 2, lambda p: p).orderBy("vec_id").first()["embedding"] == [0, 1]
    x = np.array([r["embedding"] for r in tables.low_rank(spark, 200, 32, 4, 0.0).collect()])
    assert np.linalg.matrix_rank(x, tol=1e-3) == 4
    u = np.array([r["embedding"] for r in tables.uniform(spark, 100, 8).collect()])
    assert 0 <= u.min() and u.max() < 1 and len(np.unique(u)) > 700


def test_scan_visits_every_row_once(spark):
    n = tables.scan_partitions(spark.range(0, 15_000, 1, 7), lambda b: b, "id long").agg(F.countDistinct("id"), F.count("id")).first()
    assert tuple(n) == (15_000, 15_000)


def test_results_store(spark, tmp_path):
    path, schema = str(tmp_path / "store"), "a int, b string"
    for i in range(2):
        tables.append_results(spark.createDataFrame([(i, "x")], schema), path)
    assert sorted(r["a"] for r in tables.read_results(spark, path, schema).collect()) == [0, 1]
    configs = spark.createDataFrame([(1, "p"), (2, None)], "k int, how string")
    done = tables.with_config_hash(configs.where("k = 1"), ["k", "how"])
    assert [r["k"] for r in tables.not_yet_run(configs, done, ["k", "how"]).collect()] == [2]
