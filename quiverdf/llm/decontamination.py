"""Benchmark decontamination by a positional inverted index.

Every ``window`` consecutive words of a test item are a phrase (a shorter item is one phrase). The phrases'
terms are counted over the whole corpus; the two rarest of each phrase get posting lists (term, document,
position), which are stored. The rarest term's list, shifted by the term's offset, gives the places where a
phrase can start; the second's list, shifted likewise, thins them out, a few words' slack allowed. Only documents
with such a place are read again, and only the words around it are compared: all equal is a phrase match; every
term at most ``slop`` words from its place (the rarest in place) is a proximity match.

Defined results: null texts have no words; items without words or with a null text are in no document; a null
item_id marks words as hit but is not listed; rows that repeat an id are separate documents, items that
repeat an id or a text count once by id; of equally rare terms the first in the phrase counts as rarer; empty
tables give no hits; extra columns, whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiverdf.llm._shared import BROADCAST_ROWS, Scratch, identified, join_counted, rows_of, small, text_of, unused, words_of

WINDOW, SLOP = 10, 2
#: What stands in the index for a document's end, at the place after its last word; no word is empty.
DOCUMENT_END = ""


def item_phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, phrase, len): the distinct phrases of each item, words joined by blanks."""
    words = items.select("item_id", words_of(text_of("text")).alias("w")).where(F.size("w") > 0)
    n = F.size("w")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - window))
    return words.select(
        "item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, window))).alias("p")
    ).select("item_id", F.array_join("p", " ").alias("phrase"), F.size("p").alias("len")).distinct()


def term_counts(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): how often each of ``terms`` (a written table) occurs in (__row, text), over the whole corpus."""
    every = rows.select(F.explode(words_of(F.col("text"))).alias("term"))
    if terms.count() <= BROADCAST_ROWS:
        return every.join(F.broadcast(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return every.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(terms, "term", "left_semi")  # combined before the shuffle


def postings(rows: DataFrame, terms: DataFrame, total: int) -> DataFrame:
    """(term, __row, pos): the positional index of ``terms`` (term, n; a written table) and of DOCUMENT_END.

    ``total``: occurrences of all terms; frequent ones are broadcast, however many terms there are."""
    ended = F.concat(words_of(F.col("text")), F.array(F.lit(DOCUMENT_END)))
    every = rows.select("__row", F.posexplode(ended).alias("pos", "term"))
    wanted = terms.select("term", "n").unionByName(rows.sparkSession.range(1).select(F.lit(DOCUMENT_END).alias("term"), F.lit(2**62).alias("n")))
    met = every.join(F.broadcast(wanted), "term") if terms.count() <= BROADCAST_ROWS else join_counted(every, wanted, "term", "n", total)
    return met.select("term", "__row", "pos")


def rarest_terms(phrases: DataFrame, counts: DataFrame, most: int | None) -> DataFrame:
    """(wid, r, off, term) of the ``most`` rarest terms of each phrase (all if None), r from 1 for the rarest;
    phrases of which a term does not occur at all are left out."""
    spread = phrases.select("wid", F.posexplode(F.split("phrase", " ")).alias("off", "term"))
    counted = spread.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = Window.partitionBy("wid").orderBy("n", "off")
    ranked = counted.withColumn("r", F.row_number().over(order)).withColumn("least", F.min("n").over(Window.partitionBy("wid")))
    ranked = ranked.where("least > 0")
    return (ranked if most is None else ranked.where(F.col("r") <= most)).select("wid", "r", "off", "term")


def _phrase_table(scratch: Scratch, listed: DataFrame) -> DataFrame:
    return scratch.keep(listed.select("phrase", "len").distinct().withColumn("wid", F.monotonically_increasing_id()))


def phrase_candidates(scratch: Scratch, rows: DataFrame, phrases: DataFrame, slop: int) -> tuple[DataFrame, DataFrame]:
    """((__row, start, wid) where the two rarest terms of a phrase stand as in the phrase or at most ``slop`` words
    from there, (__row, n_words) of every row)."""
    terms = scratch.keep(phrases.select(F.explode(F.split("phrase", " ")).alias("term")).distinct())
    counts = scratch.keep(term_counts(rows, terms))
    rare = scratch.keep(rarest_terms(phrases, counts, 2))
    wanted = scratch.keep(counts.join(rare.select("term").distinct(), "term", "left_semi"))
    index = scratch.keep(postings(rows, wanted, counts.agg(F.sum("n")).first()[0] or 0))
    lengths = index.where(F.col("term") == DOCUMENT_END).select("__row", F.col("pos").cast("long").alias("n_words"))
    first, second = rare.where("r = 1").drop("r"), rare.where("r = 2").select("wid", F.col("off").alias("off2"), F.col("term").alias("term2"))
    anchors = scratch.keep(first.join(second, "wid", "left"))
    starts = index.join(small(anchors), "term").select(
        "__row", (F.col("pos") - F.col("off")).alias("start"), "wid", "term2", (F.col("pos") - F.col("off") + F.col("off2")).alias("pos2")
    ).where(F.col("start") >= -slop)
    # Places are met in cells of so many words that those within reach lie in one or two.
    wide = 2 * slop + 2
    cell = lambda at: F.floor(at / wide)
    cells = F.array_distinct(F.array(cell(F.col("pos2") - slop), cell(F.col("pos2") + slop)))
    there = index.select("__row", F.col("pos").alias("at2"), F.col("term").alias("term2"), cell(F.col("pos")).alias("cell"))
    both = starts.where("term2 IS NOT NULL").withColumn("cell", F.explode(cells)).join(there, ["__row", "cell", "term2"])
    both = both.where(F.abs(F.col("at2") - F.col("pos2")) <= slop).select("__row", "start", "wid").distinct()
    alone = starts.where("term2 IS NULL")  # phrases of one word
    return both.unionByName(alone.select("__row", "start", "wid")), lengths


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, the value being computed once however often, or in however many lambdas, it is used."""
    return F.transform(F.array(value), use)[0]


def phrase_matches(scratch: Scratch, rows: DataFrame, phrases: DataFrame, slop: int) -> tuple[DataFrame, DataFrame]:
    """((__row, start, len, wid, exact): written, phrase and proximity matches; (__row, n_words))."""
    places, lengths = phrase_candidates(scratch, rows, phrases, slop)
    places = scratch.keep(places.join(small(phrases.select("wid", "len")), "wid"))
    by_doc = places.groupBy("__row").agg(F.collect_list(F.struct("start", "len", "wid")).alias("c"))
    # Few documents have a place: the others' texts are not moved.
    met = scratch.keep(places.select("__row").distinct())
    texts = (rows.join(F.broadcast(met), "__row", "left_semi") if met.count() <= BROADCAST_ROWS else rows).join(by_doc, "__row")

    def around(w: Column) -> Column:
        head = lambda c: F.greatest(F.lit(0), c["start"] - slop)
        return F.transform(
            "c", lambda c: F.struct(
                c["wid"].alias("wid"), c["start"].alias("start"), (c["start"] - head(c)).alias("lead"),
                F.slice(w, head(c) + 1, c["len"] + c["start"] - head(c) + slop).alias("w"),
            ),
        )

    near = texts.select("__row", F.explode(once(words_of(F.col("text")), around)).alias("p")).select("__row", "p.*")
    near = near.join(small(phrases), "wid").withColumn("terms", F.split("phrase", " "))
    exact = (F.col("start") >= 0) & (F.array_join(F.slice("w", F.greatest(F.col("lead"), F.lit(0)) + 1, F.col("len")), " ") == F.col("phrase"))

    def stands(term: Column, i: Column) -> Column:
        first = F.greatest(F.lit(1), F.col("lead") + i + 1 - slop)
        return F.array_contains(F.slice("w", first, F.greatest(F.lit(0), F.col("lead") + i + 2 + slop - first)), term)

    within = F.forall(F.transform("terms", stands), lambda x: x)
    return scratch.keep(near.select("__row", "start", "len", "wid", exact.alias("exact"), within.alias("near")).where("exact OR near").drop("near")), lengths


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
    row_col: str | None = None, slop: int = SLOP,
) -> DataFrame:
    """One row for each row of ``docs``: __row, doc_id, n_words, n_hit (words inside phrase matches), n_items and
    item_ids (sorted, as strings) of the items matched, matches (an array of start, len, wid of phrase matches) and
    n_near (phrases that have proximity matches only)."""
    scratch = Scratch(docs.sparkSession)
    rows = rows_of(scratch, docs, row_col, doc_id=F.col(id_col), text=text_of(text_col))
    listed = scratch.keep(item_phrases(items, window))
    phrases = _phrase_table(scratch, listed)
    found, lengths = phrase_matches(scratch, rows, phrases, slop)
    exact = scratch.keep(
        found.where("exact").groupBy("__row").agg(F.collect_list(F.struct("start", "len", "wid")).alias("matches"))
    )
    hit = F.size(F.array_distinct(F.flatten(F.transform("matches", lambda m: F.sequence(m["start"], m["start"] + m["len"] - 1)))))
    of_phrase = scratch.keep(listed.join(phrases, ["phrase", "len"]).select("wid", F.col("item_id").cast("string").alias("item")))
    of_item = (
        exact.select("__row", F.explode(F.array_distinct(F.transform("matches", lambda m: m["wid"]))).alias("wid"))
        .join(small(of_phrase), "wid")
        .groupBy("__row").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    )
    by_phrase = found.groupBy("__row", "wid").agg(F.max("exact").alias("exact"))
    near = by_phrase.where(~F.col("exact")).groupBy("__row").agg(F.count(F.lit(1)).alias("n_near"))
    out = rows.select("__row", "doc_id").join(lengths, "__row").join(exact, "__row", "left").join(of_item, "__row", "left")
    return out.join(near, "__row", "left").select(
        "__row", "doc_id", "n_words", F.when(F.size("matches") > 0, hit).otherwise(0).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), "matches",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    ).withColumn("n_items", F.size("item_ids").cast("long"))


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = SLOP, window: int = WINDOW) -> DataFrame:
    """(__row, start, phrase, exact): where the rarest term of a phrase stands in its place and every term at most
    ``slop`` words from its own."""
    scratch = Scratch(docs.sparkSession)
    rows = rows_of(scratch, docs, None, text=text_of("text"))
    phrases = _phrase_table(scratch, item_phrases(items, window))
    found, _ = phrase_matches(scratch, rows, phrases, slop)
    return found.join(phrases.select("wid", "phrase"), "wid").select("__row", "start", "phrase", "exact")


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no phrase of an item occurs, with their own columns."""
    scratch = Scratch(docs.sparkSession)
    row = unused(docs, "__row")
    numbered = identified(scratch, docs, row)
    rows = rows_of(scratch, numbered, row, text=text_of("text"))
    found, _ = phrase_matches(scratch, rows, _phrase_table(scratch, scratch.keep(item_phrases(items, window))), 0)
    hit = scratch.keep(found.where("exact").select(F.col("__row").alias(row)).distinct())
    return numbered.join(small(hit), row, "left_anti").drop(row)


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near",
    )


OP5_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), iw AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), p AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, w[i + 1 : i + least(10, len(w))] AS phrase
  FROM iw, unnest(range(greatest(1, len(w) - 9))) t(i) WHERE len(w) > 0
), lens AS (SELECT DISTINCT n FROM p),
g AS (
  SELECT doc_id, i, n, w[i + 1 : i + n] AS phrase
  FROM dw, lens, unnest(range(len(w) - n + 1)) t(i) WHERE len(w) >= n
), m AS (SELECT g.doc_id, g.i, g.n, p.item_id FROM g JOIN p ON g.n = p.n AND g.phrase = p.phrase),
h AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM m, unnest(range(n)) t(k) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id
), dt AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM dw),
pt AS (SELECT phrase, unnest(phrase) AS term, generate_subscripts(phrase, 1) - 1 AS off FROM (SELECT DISTINCT phrase FROM p)),
ct AS (SELECT term, count(*) AS cnt FROM dt WHERE term IN (SELECT term FROM pt) GROUP BY term),
an AS (
  SELECT phrase, term, off FROM pt JOIN ct USING (term)
  QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY cnt, off) = 1 AND count(*) OVER (PARTITION BY phrase) = len(phrase)
), st AS (SELECT dt.doc_id, an.phrase, dt.pos - an.off AS start FROM dt JOIN an USING (term) WHERE dt.pos - an.off >= -2),
nr AS (
  SELECT st.doc_id, st.phrase, st.start FROM st JOIN pt ON pt.phrase = st.phrase
  JOIN dt ON dt.doc_id = st.doc_id AND dt.term = pt.term AND dt.pos - st.start - pt.off BETWEEN -2 AND 2
  GROUP BY ALL HAVING count(DISTINCT pt.off) = len(st.phrase)
), ne AS (
  SELECT doc_id, count(*) AS n_near
  FROM (SELECT DISTINCT doc_id, phrase FROM nr WHERE (doc_id, phrase) NOT IN (SELECT m.doc_id, g.phrase FROM m JOIN g USING (doc_id, i, n))) GROUP BY doc_id
)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(n_near, 0) AS n_near
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN ne USING (doc_id)
"""
