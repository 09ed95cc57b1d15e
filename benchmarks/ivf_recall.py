"""Recall against the share of the corpus compared, for each way to build an inverted file.

python benchmarks/ivf_recall.py FOLDER [TARGET]: a row for flat k-means, hierarchical k-means, the same with
passes among neighbours, and with second (SOAR) assignments, at six numbers of probes; seconds to build each.
"""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from bench import session  # noqa: E402

from quiverdf.operators import evaluation as E  # noqa: E402
from quiverdf.operators import ivf as I  # noqa: E402
from quiverdf.operators import kmeans as M  # noqa: E402
from quiverdf.operators import knn as K  # noqa: E402
from quiverdf.operators.sampling import reservoir  # noqa: E402

PERCENT = (0.8, 1.6, 2.4, 3.2, 4.0, 4.8)


def main(folder: str, target: int = 512) -> None:
    spark = session()
    docs = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").repartition(int(os.environ.get("BENCH_CPUS", "8"))).cache()
    n = docs.count()
    queries = reservoir(docs, 75).withColumnRenamed("vec_id", "qid").cache()
    exact = K.knn(docs, queries, 10).cache()
    exact.count()

    def report(name: str, seconds: float, c, lists) -> None:
        lists = lists.cache()
        sizes = E.size_moments(E.cluster_sizes(lists, len(c))).first()
        recalls, shares = [], []
        for p in PERCENT:
            found, compared = I.search(lists, queries, c, 10, max(1, round(p * len(c) / 100)))
            r = E.compared(E.recall(exact, found), compared, n).first()
            recalls.append(round(r["recall"], 3))
            shares.append(round(r["percent"] / 100, 4))
        print(f"{name} | {seconds:.1f} s | {len(c)} clusters, {sizes['mean']:.1f} / {sizes['sd']:.1f} | {recalls} | {shares}", flush=True)

    def built(make):
        began = time.perf_counter()
        c, assigned = make()
        assigned = assigned.cache()
        assigned.count()
        return time.perf_counter() - began, c, assigned

    def flat():
        c = M.kmeans_full(docs, M.initial_centres(docs, max(2, n // target)), 8)
        return c, M.assign(docs, c)

    seconds, c, assigned = built(flat)
    report("flat", seconds, c, I.postings(assigned))
    first, c, assigned = built(lambda: M.hierarchical(docs, target))
    report("hierarchical", first, c, I.postings(assigned))
    seconds, c, assigned = built(lambda: M.kmeans_local(docs, c))
    report("local passes", first + seconds, c, I.postings(assigned.drop("spilled")))
    report("local passes + SOAR", first + seconds, c, I.postings(assigned))


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:3]))
