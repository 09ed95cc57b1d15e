"""N-gram Jaccard join by MinHash banding.

Documents with the same set of word n-grams stand for each other. Of the rest, those that share a band of
MinHash values meet in that band's bucket; buckets with the same members are visited once, large ones block
by block, and in each every pair that meets there first is verified on the full sets of n-grams: what a pair
shares with one member of the bucket bounds what it shares with each other, so that among many variants of one
text most pairs are settled by their sizes alone. A visit gives one row for each member - links found and the
smallest member of its part - never a row for a pair. Connected components over these rows are the classes.

Defined results: words are runs without white space, in lower case; texts with fewer than ``n`` words are one
n-gram of them all; texts without words (null ones too) equal each other and nothing else; rows that repeat
an id are separate documents; ids may be of any type that strings give back; nulls come last where the smallest id
is taken; empty tables give empty ones; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverdf.llm._shared import Scratch, components, identified, join_counted, rows_of, small, text_of, unused

N, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9999, 96
#: Members that a block of a large bucket has about, and bytes of their n-grams; two blocks are in memory at once.
BLOCK, BLOCK_BYTES = 1_024, 8_000_000
#: Words whose codes a worker remembers at most.
KNOWN = 65_536
_rng = np.random.Generator(np.random.PCG64(20240229))
_ODD = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_MIX = _rng.integers(1, 2**63, (2, 1024), dtype=np.uint64) | np.uint64(1)


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows of each): the most selective rows with which ``most`` hashes still give the recall at the threshold."""
    if threshold >= 1:
        return 1, 1  # equal sets share every hash
    fits = [(math.ceil(math.log(1 - recall) / math.log1p(-(threshold**r))), r) for r in range(1, 33)]
    fits = [(b, r) for b, r in fits if b * r <= most]
    if not fits:
        raise ValueError(f"{most} hashes cannot reach a recall of {recall} at a similarity of {threshold}")
    return max(fits, key=lambda x: x[1])


class _Codes(dict):
    """The 8 bytes of words' codes, made when a word is first asked for; at most KNOWN are remembered."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KNOWN:
            self.clear()
        code = self[word] = xxhash.xxh64_digest(word.encode("utf-8", "replace"))
        return code


_known = _Codes()


def word_codes(text: str) -> np.ndarray:
    return np.frombuffer(b"".join(map(_known.__getitem__, text.lower().split())), "<u8")


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """The sorted set of the 64-bit codes of a text's word n-grams."""
    w = word_codes(text or "")
    if not len(w):
        return w
    n = min(n, len(w))
    total = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        total += w[i : len(w) - n + 1 + i] * _ODD[i]
    total ^= total >> np.uint64(32)
    return np.unique(total * _ODD[63])


def band_codes(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One code for each band of the MinHash signature; none for an empty set."""
    if not len(found):
        return np.empty(0, np.int64)
    low = np.full(bands * rows, 2**32, np.uint64)
    a, b = _MIX[0, : bands * rows, None], _MIX[1, : bands * rows, None]
    for at in range(0, len(found), 4096):
        part = (found[None, at : at + 4096] * a + b) >> np.uint64(32)
        np.minimum(low, part.min(axis=1), out=low)
    return (low.reshape(bands, rows) * _ODD[:rows]).sum(axis=1, dtype=np.uint64).view(np.int64)


def signatures(rows: DataFrame, n: int, bands: int, height: int) -> DataFrame:
    """(__row, doc_id, grams, len, bands) from (__row, doc_id, text): ``grams`` names the set of n-grams."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingles(t, n) for t in b["text"]]
            yield pd.DataFrame({
                "__row": b["__row"], "doc_id": b["doc_id"], "len": [len(s) for s in sets],
                "grams": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                "bands": [band_codes(s, bands, height) for s in sets],
            })

    of_id = rows.schema["doc_id"].dataType
    # As strings, which Python leaves as they are.
    said = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    signed = said.mapInPandas(sign, "__row long, doc_id string, len long, grams binary, bands array<long>")
    return signed.withColumn("doc_id", F.col("doc_id").cast(of_id))


def verify_block(members: pd.DataFrame, band: int, crossed: bool, threshold: float) -> list[tuple[int, int, int]]:
    """(node, copies linked to, node of its part's root) of the members with a link found here.

    ``members``: node, copies, side, grams (bytes of the sorted set), bands. A pair counts in the first band
    that it shares; if ``crossed``, only pairs of the two sides do.
    """
    members = members.sort_values("node", ignore_index=True)
    sets = [np.frombuffer(x, np.uint64) for x in members["grams"]]
    codes, side = np.stack(members["bands"].to_list()), members["side"].to_numpy()
    sizes = np.array([len(s) for s in sets])
    copies, nodes = members["copies"].to_numpy(), members["node"].to_numpy()
    distinct, at = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    marked, links, part = np.zeros(len(distinct), bool), np.zeros(len(sets), np.int64), np.arange(len(sets))

    def shared(i: int, js: np.ndarray) -> np.ndarray:
        """How many n-grams member i has in common with each of ``js``, ascending and behind i."""
        own = at[starts[i] : starts[i] + sizes[i]]
        marked[own] = True
        if 4 * len(js) < len(sets) - i:
            common = np.array([np.count_nonzero(marked[at[starts[j] : starts[j] + sizes[j]]]) for j in js])
        else:
            first = js[0]
            common = np.add.reduceat(marked[at[starts[first] :]].astype(np.int32), starts[first:] - starts[first])[js - first]
        marked[own] = False
        return common

    def alike(common: np.ndarray, i: int, js: np.ndarray) -> np.ndarray:
        return common >= threshold * (sizes[i] + sizes[js] - common) - 1e-9

    # What each shares with the member of middle size, and has besides, bounds what two share with each other.
    middle = int(np.argsort(sizes, kind="stable")[len(sizes) // 2])
    marked[at[starts[middle] : starts[middle] + sizes[middle]]] = True
    inside = np.add.reduceat(marked[at].astype(np.int32), starts)
    marked[:] = False
    outside = sizes - inside
    for i in range(len(sets) - 1):
        fits = codes[i + 1 :, band] == codes[i, band]
        if crossed:
            fits &= side[i + 1 :] != side[i]
        small, large = np.minimum(sizes[i + 1 :], sizes[i]), np.maximum(sizes[i + 1 :], sizes[i])
        fits &= small >= threshold * large - 1e-9
        js = np.flatnonzero(fits) + i + 1
        if len(js) and band:
            js = js[~(codes[js, :band] == codes[i, :band]).any(axis=1)]
        if not len(js):
            continue
        js = js[alike(np.minimum(inside[i], inside[js]) + np.minimum(outside[i], outside[js]), i, js)]
        linked = alike(np.maximum(0, inside[i] + inside[js] - sizes[middle]), i, js)
        if not linked.all():
            open_ = np.flatnonzero(~linked)
            linked[open_] = alike(shared(i, js[open_]), i, js[open_])
        js = js[linked]
        if len(js):
            links[i] += copies[js].sum()
            links[js] += copies[i]
            parts = np.unique(np.append(part[js], part[i]))
            if len(parts) > 1:
                part[np.isin(part, parts[1:])] = parts[0]
    return [(int(nodes[i]), int(links[i]), int(nodes[part[i]])) for i in np.flatnonzero(links)]


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL,
    id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, block: int = BLOCK,
) -> DataFrame:
    """One row for each row of ``docs``: __row, doc_id, class_id (the smallest doc_id of its class), n_links
    (documents at ``threshold`` or more, copies counted), kept (the first of its class)."""
    scratch = Scratch(docs.sparkSession)
    bands, height = choose_bands(threshold, recall)
    rows = rows_of(scratch, docs, row_col, doc_id=F.col(id_col), text=text_of(text_col))
    signed = scratch.keep(signatures(rows, n, bands, height))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")
    sets = scratch.keep(
        signed.groupBy("grams")
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("len").alias("len"))
        .select("grams", "copies", "bands", "len", F.col("first.__row").alias("node"), "first")
    )
    visits = _visits(scratch, sets, block)
    found = scratch.keep(_verified(rows, visits, n, threshold))
    scratch.free(visits)
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(scratch, found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    groups = sets.select("grams", "copies", "node", "first").join(linked, "node", "left").join(labels, "node", "left")
    groups = groups.withColumn("label", F.coalesce("label", "node"))
    firsts = groups.groupBy("label").agg(F.min("first").alias("of_class"))
    groups = scratch.keep(
        groups.join(firsts, "label").select(
            "grams", "copies", F.col("of_class.doc_id").alias("class_id"), F.col("of_class.__row").alias("keeper"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        )
    )
    scratch.free(sets, found)
    out = join_counted(signed.select("__row", "doc_id", "grams"), groups, "grams", "copies", signed.count())
    return out.select("__row", "doc_id", "class_id", "n_links", (F.col("__row") == F.col("keeper")).alias("kept"))


def _visits(scratch: Scratch, sets: DataFrame, block: int) -> DataFrame:
    """(node, copies, bands, visits): where each set goes, an array of (key, band, side, crossed)."""
    each = sets.select("node", "len", F.posexplode("bands").alias("band", "code"))
    buckets = (
        each.groupBy("band", "code")
        .agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("node")).alias("who"), F.min("node").alias("low"), F.sum("len").alias("grams"))
        .where("m > 1")
    )
    # Buckets with the same members: the first band's stands for all.
    buckets = buckets.groupBy("m", "who", "low", "grams").agg(F.min(F.struct("band", "code")).alias("bucket"))
    blocks = F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("grams") * 8 / BLOCK_BYTES))
    buckets = scratch.keep(buckets.select("bucket", "m", blocks.alias("blocks")))
    own = F.pmod(F.xxhash64("node", "band"), F.col("blocks"))
    each = each.select("node", "band", "code", F.struct("band", "code").alias("bucket"))
    going = (
        join_counted(each, buckets, "bucket", "m", buckets.agg(F.sum("m")).first()[0] or 0)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(
            "node",
            F.struct(
                F.xxhash64("band", "code", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "band",
                (F.col("own") > F.col("other")).cast("int").alias("side"), (F.col("own") != F.col("other")).alias("crossed"),
            ).alias("v"),
        )
    )
    return scratch.keep(
        going.groupBy("node").agg(F.collect_list("v").alias("visits")).join(sets.select("node", "copies", "bands"), "node")
    )


def _verified(rows: DataFrame, visits: DataFrame, n: int, threshold: float) -> DataFrame:
    """(node, links, root) from each visit."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                grams = shingles(r.text, n).tobytes()
                out += [(v["key"], v["band"], v["side"], v["crossed"], r.node, r.copies, r.bands, grams) for v in r.visits]
            yield pd.DataFrame(out, columns=["key", "band", "side", "crossed", "node", "copies", "bands", "grams"])

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def settle() -> list:
            group = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            return verify_block(group, int(group["band"].iat[0]), bool(group["crossed"].iat[0]), threshold)

        for b in batches:
            out = []
            for key, part in b.groupby("key", sort=False):
                if held and held[0]["key"].iat[0] != key:
                    out += settle()
                    held = []
                held.append(part)
            yield pd.DataFrame(out, columns=["node", "links", "root"])
        if held:
            yield pd.DataFrame(settle(), columns=["node", "links", "root"])

    texts = rows.select(F.col("__row").alias("node"), "text").join(visits, "node")
    sent = texts.mapInPandas(
        send, "key long, band int, side int, crossed boolean, node long, copies long, bands array<long>, grams binary"
    )
    return sent.repartition("key").sortWithinPartitions("key").mapInPandas(check, "node long, links long, root long")


def without_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The first row of each class, with the columns of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    row = unused(docs, "__row")
    numbered = identified(scratch, docs, row)
    gone = near_duplicates(numbered, row_col=row, **options).where("NOT kept").select(F.col("__row").alias(row))
    return numbered.join(small(scratch.keep(gone)), row, "left_anti").drop(row)


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id", "n_links", "kept")
