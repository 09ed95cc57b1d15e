"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Executors turn labelled texts into feature numbers; one task then learns from a bounded sample of them (at most
``TRAIN_ROWS`` rows with ``TRAIN_FEATURES`` numbers), in a fixed order, holding two numbers for each feature. The
strengths of L1 that are tried learn side by side in one pass. L1 leaves few weights, which are broadcast (never
more than ``2 ** bits``) to score every whole text.

Defined results: null and empty texts have no features and get the intercept's score; rows without a label
or with a null one are not learnt from; of labels that repeat a document the larger holds, of labelled texts that
repeat an id one is learnt from, that with the least hash; without any toxic row to learn from every score is 0; rows
that repeat an id are scored each; an empty table gives an empty one; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverdf.llm._shared import Scratch, first_rows, prefix_of

#: Labelled rows that are learnt from at most, and feature numbers that they have at most (256 MB); passes over them.
TRAIN_ROWS, TRAIN_FEATURES, BITS, PASSES = 20_000, 64_000_000, 20, 5
ALPHA, BETA, L2 = 2.0, 1.0, 1.0
#: Strengths of L1 that are tried on a part of the sample; the best on the other part is used.
L1_TRIED = (0.5, 1.0, 2.0, 4.0, 8.0)
TRY_PASSES = 2
FOLDS = 5
_WORD = re.compile(r"\w+")
#: Words whose codes a worker remembers at most.
KNOWN = 65_536
_M = np.uint64(0x9E3779B97F4A7C15)


class _Codes(dict):
    """The 8 bytes of words' codes, made when a word is first asked for; at most KNOWN are remembered."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KNOWN:
            self.clear()
        code = self[word] = zlib.crc32(word.encode("utf-8", "replace")).to_bytes(8, "little")
        return code


_known = _Codes()


def word_codes(text: str | None) -> np.ndarray:
    """A 32-bit code for each word, lower-cased."""
    return np.frombuffer(b"".join(map(_known.__getitem__, _WORD.findall(text.lower()) if text else [])), "<u8")


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Distinct numbers of the words, pairs of neighbours and pairs with one word between."""
    w = word_codes(text)
    with np.errstate(over="ignore"):
        grams = [w * _M]
        for gap, salt in ((1, 0x51ED27), (2, 0xA24BAE)):
            grams.append((w[:-gap] * _M + w[gap:] + np.uint64(salt)) * _M)
    found = np.concatenate(grams) >> np.uint64(64 - bits)
    return np.unique(found.astype(np.int32))


class Ftrl:
    """Per-coordinate FTRL-proximal with L1 and L2; coordinate ``2 ** bits`` is the intercept.

    ``l1`` may be several strengths: as many models then learn side by side."""

    def __init__(self, bits: int = BITS, l1=L1_TRIED[0], alpha=ALPHA, beta=BETA, l2=L2):
        self.l1 = np.atleast_1d(np.asarray(l1, float))
        self.z, self.n = np.zeros((2, 2**bits + 1, len(self.l1)))
        self.alpha, self.beta, self.l2 = alpha, beta, l2

    def _weights(self, z: np.ndarray, root: np.ndarray) -> np.ndarray:
        over = np.abs(z) - self.l1
        return np.where(over > 0, -np.copysign(over, z) / ((self.beta + root) / self.alpha + self.l2), 0.0)

    def weights(self, model: int = 0) -> np.ndarray:
        return self._weights(self.z, np.sqrt(self.n))[:, model]

    def learn(self, at: np.ndarray, label: int) -> None:
        """One step over the features of a row, the intercept's number among them."""
        z, n = self.z[at], self.n[at]
        root = np.sqrt(n)
        w = self._weights(z, root)
        g = np.array([squash(x) for x in w.sum(axis=0).tolist()]) - label
        n += g * g
        self.z[at] = z + g - (np.sqrt(n) - root) / self.alpha * w
        self.n[at] = n


def fitted(seen: list[tuple[np.ndarray, int]], bits: int = BITS, passes: int = PASSES) -> Ftrl:
    """The model of rows in their order; every fifth row serves to choose the strength of L1."""

    seen = [(np.append(at, 2**bits), y) for at, y in seen]  # with the intercept

    def fit(rows: list, l1, passes: int) -> Ftrl:
        model = Ftrl(bits, l1)
        for _ in range(passes):
            for at, y in rows:
                model.learn(at, y)
        return model

    tried = fit([x for i, x in enumerate(seen) if i % 5], L1_TRIED, TRY_PASSES)

    def loss(model: int) -> float:
        w = tried.weights(model)
        return -sum(math.log(max(1e-9, p if y else 1 - p)) for at, y in seen[::5] for p in [squash(w[at].sum())])

    return fit(seen, L1_TRIED[min(range(len(L1_TRIED)), key=loss)], passes)


def squash(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-min(35.0, max(-35.0, x))))


def train(rows: DataFrame, bits: int = BITS, passes: int = PASSES, most_features: int = TRAIN_FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero weights (at, value) learnt from rows of (text, label, place), in the order of place, of the first
    rows that have at most ``most_features`` numbers together."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = [features(t, bits).tobytes() for t in b["text"]]
            yield pd.DataFrame({"place": b["place"], "label": b["label"], "at": at})

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = [(np.frombuffer(a, np.int32), y) for b in batches for a, y in zip(b["at"], b["label"], strict=True)]
        w = fitted(seen, bits, passes).weights() if any(y for _, y in seen) else np.zeros(1)
        at = np.flatnonzero(w)
        yield pd.DataFrame({"at": [at.astype(np.int32).tobytes()], "w": [w[at].astype(np.float64).tobytes()]})

    scratch = Scratch(rows.sparkSession)
    encoded = scratch.keep(rows.select("text", "label", "place").mapInPandas(encode, "place long, label int, at binary"))
    sizes = encoded.select("place", (F.octet_length("at") / 4).cast("long").alias("n"))  # a row for each of TRAIN_ROWS
    room = prefix_of(sizes, [], ["place"], "n", "before").where(F.col("before") + F.col("n") <= most_features).select("place")
    encoded = encoded.join(F.broadcast(room), "place", "left_semi")
    got = (
        encoded.repartition(1).sortWithinPartitions("place").mapInPandas(fit, "at binary, w binary").first()
    )  # one row: the weights
    return (np.frombuffer(got["at"], np.int32), np.frombuffer(got["w"], np.float64)) if got else (np.empty(0, np.int32), np.empty(0))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """(text, label, place) of at most ``most`` labelled documents, none of the held-out fold."""
    place = F.xxhash64(F.lit("ftrl"), "doc_id")
    labelled = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0)
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
        .select("doc_id", "label", place.alias("place"))
    )
    chosen = first_rows(labelled, ["place", "doc_id"], ["doc_id"], most)
    met = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # `most` rows
    # A row for each id, combined before the shuffle, however often ids repeat.
    one = met.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t"), F.first("label").alias("label"), F.first("place").alias("place"))
    return one.select(F.col("t.text").alias("text"), "label", "place")


def score_column(spark, model: tuple[np.ndarray, np.ndarray], bits: int = BITS):
    """A function of a text column that gives its score."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, w = sent.value
        dense = np.zeros(2**bits + 1)
        dense[at] = w
        for texts in batches:
            if not len(at):
                yield pd.Series(np.zeros(len(texts)))
                continue
            yield pd.Series([squash(dense[features(t, bits)].sum() + dense[-1]) for t in texts], dtype="float64")

    return score


def toxicity_model(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS):
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(training_rows(docs, labels, most))
    model = train(rows)
    scratch.free(rows)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted."""
    score = score_column(docs.sparkSession, toxicity_model(docs, labels, most))
    return docs.select(
        "doc_id",
        (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0).alias("held_out"),
        score(F.col("text").cast("string")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their own columns."""
    score = score_column(docs.sparkSession, toxicity_model(docs, labels, most))
    own = [F.col(f"`{c}`") for c in docs.columns]
    return docs.where(score(F.col("text").cast("string")) < 0.5).select(*own)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
