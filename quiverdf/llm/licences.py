"""License scans: sparse TF-IDF cosine to templates, and inheritance from the nearest ancestor directory.

A file is scored in units: the whole of it, its paragraphs, its lines and its sentences, so that licence files meet
whole licences, headers their paragraphs, and a notice within a long line its sentence. Document frequencies are
those of all words over all files. Only files, and of these only units, that can reach the least cosine are scored:
a cosine is at most the length of the template's part over the words that both have; words of little weight, up
to ``SLACK`` of the squared length, are given to all and not looked for. Equal units are scored once, by joins of their words' vectors to those of the templates, and
the template with the largest cosine names the licence. A file that is named as a licence file, or that is little
but units of a licence, licenses its directory; a file without a licence of its own takes that of its nearest
ancestor directory, found by joining the ancestors of each directory with the licensed ones.

Defined results: null and empty texts have no units; null paths have no directory; among equal cosines the first
licence by name holds, among licence files of a directory the one with the largest cosine, then the smallest path;
equal units of a file count once; rows that repeat a path are scanned each; empty tables give empty ones; extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverdf.llm._shared import Scratch, join_counted, rows_of, small, text_of, words_of

#: Cosine from which a unit is of a template's licence; share of a file's words that makes it a licence file.
LEAST_COSINE, FILE_SHARE = 0.6, 0.5
#: Share of a template's squared length that its lightest words may have, which candidates need not have.
SLACK = 0.15
NAMES = r"(?i)^(licen[sc]e|copying|notice|unlicense)([.-].*)?$"
#: Where units end: paragraphs at blank lines, lines, and sentences. Blanks around a unit are not of it.
PARTS = (r"\r?\n[ \t]*\r?\n", r"\r?\n|\r", r"[.;!?]+[ \t\r\n]+|\*+/|/\*+")
BLANKS = " \t\r\n\x0b\x0c"
#: Short notices of common licences: fixed values.
NOTICES = (
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)

#: Whole licences and headers: fixed values.
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
    "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
    "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH '
    "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
    "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the "
    "Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that "
    "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
    "GNU {0}General Public License for more details."
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a '
    "copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
    'under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License '
    "for the specific language governing permissions and limitations under the License."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
    "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)
TEMPLATES = NOTICES + (
    ("AGPL-3.0", _GNU.format("Affero ", 3)),
    ("Apache-2.0", _APACHE),
    ("BSD-2-Clause", _BSD + _BSD_AS_IS),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_AS_IS),
    ("BSD-3-Clause", _BSD_THIRD),
    ("GPL-2.0", _GNU.format("", 2)),
    ("GPL-3.0", _GNU.format("", 3)),
    ("ISC", _ISC),
    ("LGPL-3.0", _GNU.format("Lesser ", 3)),
    ("MIT", _MIT),
    ("MIT", _MIT + _AS_IS),
    ("Unlicense", _UNLICENSE),
)


def units_of(text: Column) -> Column:
    """The distinct units of a text: the whole, paragraphs, lines and sentences, without the blanks around them."""
    parts = F.concat(F.array(text), *[F.split(text, p) for p in PARTS])
    return F.array_distinct(F.transform(parts, lambda x: F.btrim(x, F.lit(BLANKS))))


def unit_rows(rows: DataFrame) -> DataFrame:
    """(__row, n_words, unit) of the distinct units of (__row, text)."""
    # A column beside an exploded one is computed again for each unit; so the words are counted in a row of its own.
    text = F.col("text")
    once = rows.select(F.inline(F.array(F.struct("__row", F.size(words_of(text)).alias("n_words"), units_of(text).alias("units")))))
    return once.select("__row", "n_words", F.explode("units").alias("unit"))


def template_vectors(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(template, licence, term, tf): as many rows as the templates have words."""
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, licence string, text string")
    terms = rows.select("template", "licence", F.explode(words_of(F.col("text"))).alias("term"))
    return terms.groupBy("template", "licence", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(scratch: Scratch, rows: DataFrame, vectors: DataFrame, templates) -> DataFrame:
    """(term, df, idf) of every word of (text): files, and templates, that have it."""
    n = rows.count() + len(templates)
    words = rows.select(F.explode(F.array_distinct(words_of(F.col("text")))).alias("term")).unionByName(vectors.select("term"))
    df = words.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return scratch.keep(df.withColumn("idf", F.log((F.lit(n) + 1.0) / (F.col("df") + 1.0)) + 1.0))


def heavy_terms(of_template: DataFrame, slack: float = SLACK) -> DataFrame:
    """(template, term, share) of each template's words of most weight, until the others' shares of its squared length
    are below ``slack`` together. As many rows as the templates' words at most."""
    rows = of_template.select("template", "term", "tw").collect()
    kept = []
    for t in sorted({r["template"] for r in rows}):
        own = sorted(((r["tw"], r["term"]) for r in rows if r["template"] == t), reverse=True)
        whole = rest = sum(w * w for w, _ in own)
        for w, term in own:
            if rest < slack * whole:
                break
            kept.append((t, term, w * w / whole))
            rest -= w * w
    return of_template.sparkSession.createDataFrame(kept, "template int, term string, share double")


def reaching(words: DataFrame, key: str, heavy: DataFrame, least: float, slack: float = SLACK) -> DataFrame:
    """(key) of all that can have a cosine of ``least`` to some template, from their distinct (key, term)."""
    met = words.join(F.broadcast(heavy), "term").groupBy(key, "template").agg(F.sum("share").alias("share"))
    return met.where(F.col("share") >= least * least - slack - 1e-5).select(key).distinct()  # cosines are rounded


def score_units(scratch: Scratch, terms: DataFrame, df: DataFrame, of_template: DataFrame, total: int) -> DataFrame:
    """(uid, licence, cosine) of the best template of each unit of (uid, term, tf); cosines to 6 places."""
    # Few words are in units: their frequencies are sought among all, and travel to the units.
    known = scratch.keep(df.join(small(scratch.keep(terms.select("term").distinct())), "term", "left_semi"))
    weighted = scratch.keep(
        join_counted(terms, known, "term", "df", total).select("uid", "term", (F.col("tf") * F.col("idf")).alias("w"))
    )
    norms = weighted.groupBy("uid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    lengths = of_template.groupBy("template").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("length"))
    sent = F.broadcast(of_template.join(F.broadcast(lengths), "template"))  # the templates' words, no more
    dots = weighted.join(sent, "term").groupBy("uid", "template", "licence", "length").agg(
        F.sum(F.col("w") * F.col("tw")).alias("dot")
    )
    cosines = dots.join(norms, "uid").select(
        "uid", "licence", F.round(F.col("dot") / F.col("norm") / F.col("length"), 6).alias("cosine")
    )
    best = cosines.groupBy("uid").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b"))
    return best.select("uid", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"))


def scan_licences(files: DataFrame, least: float = LEAST_COSINE, share: float = FILE_SHARE, templates=TEMPLATES) -> DataFrame:
    """One row for each row of (path, text): __row, path, n_notices (units of a licence), own_licence, cosine,
    licence_file, licence (its own or inherited), inherited_from (a path or null)."""
    scratch = Scratch(files.sparkSession)
    rows = rows_of(scratch, files, None, path=F.col("path"), text=text_of("text"))
    vectors = scratch.keep(template_vectors(files.sparkSession, templates))
    df = document_frequencies(scratch, rows, vectors, templates)
    of_template = scratch.keep(  # the templates' words, no more
        df.join(F.broadcast(vectors), "term").select("template", "licence", "term", (F.col("tf") * F.col("idf")).alias("tw"))
    )
    heavy = heavy_terms(of_template)
    words = rows.select("__row", F.explode(F.array_distinct(words_of(F.col("text")))).alias("term"))
    met = rows.join(small(scratch.keep(reaching(words, "__row", heavy, least))), "__row", "left_semi")
    # Units may be as long as texts: they are known by their digests, and their words by a number.
    each = scratch.keep(unit_rows(met).withColumn("digest", F.unhex(F.sha2("unit", 256))))
    total = each.count()
    distinct = each.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.first("unit").alias("unit"))
    distinct = scratch.keep(distinct.withColumn("uid", F.monotonically_increasing_id()))
    terms = scratch.keep(
        distinct.select("uid", F.explode(words_of(F.col("unit"))).alias("term")).groupBy("uid", "term").agg(F.count(F.lit(1)).alias("tf"))
    )
    terms = scratch.keep(terms.join(reaching(terms, "uid", heavy, least), "uid", "left_semi"))
    scored = score_units(scratch, terms, df, of_template, total).where(F.col("cosine") >= least)
    lengths = distinct.select("uid", "digest", "n", F.size(words_of(F.col("unit"))).alias("covered"))
    scored = scratch.keep(lengths.join(small(scratch.keep(scored)), "uid"))
    hits = join_counted(each.select("__row", "n_words", "digest"), scored, "digest", "n", total)
    own = scratch.keep(
        hits.groupBy("__row").agg(
            F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b"), F.count(F.lit(1)).alias("n_notices"),
            (F.max("covered") >= F.first("n_words") * share).alias("mostly"),
        )
    )
    directory = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    found = scratch.keep(
        rows.select("__row", "path").join(small(own), "__row", "left").select(
            "__row", "path", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
            F.col("b.licence").alias("own_licence"), (-F.col("b.c")).alias("cosine"),
            (F.col("b").isNotNull() & (F.col("mostly") | F.element_at(F.split("path", "/"), -1).rlike(NAMES))).alias("licence_file"),
            F.when(F.col("path").isNotNull(), directory).alias("dir"),
        ).withColumn("licence_file", F.coalesce("licence_file", F.lit(False)))
    )
    first = F.min(F.struct((-F.col("cosine")).alias("c"), "path", F.col("own_licence").alias("licence")))
    licensed = scratch.keep(found.where("licence_file AND dir IS NOT NULL").groupBy(F.col("dir").alias("above")).agg(first.alias("l")))
    dirs = scratch.keep(found.where("dir IS NOT NULL").groupBy("dir").agg(F.count(F.lit(1)).alias("n")))
    parts = F.split("dir", "/")
    # A directory's ancestors, itself first, up to the root "".
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("up"), F.array_join(F.slice(parts, 1, F.size(parts) - i), "/").alias("above")))
    inherited = (
        dirs.select("dir", F.explode(above).alias("a")).select("dir", "a.up", "a.above")
        .join(licensed, "above").groupBy("dir").agg(F.min(F.struct("up", "l")).alias("best"))
        .select("dir", F.col("best.l.licence").alias("above_licence"), F.col("best.l.path").alias("above_path"))
    )
    # Every directory has a row, so that files join whatever they inherit; large ones are broadcast.
    inherited = scratch.keep(dirs.join(inherited, "dir", "left"))
    out = join_counted(found, inherited, "dir", "n", found.count())
    none = F.lit(None).cast("string")
    lost = found.where("dir IS NULL").select("*", F.lit(1).cast("long").alias("n"), none.alias("above_licence"), none.alias("above_path"))
    out = out.unionByName(lost)
    takes = F.col("own_licence").isNull()
    return out.select(
        "__row", "path", "n_notices", "own_licence", "cosine", "licence_file",
        F.coalesce("own_licence", "above_licence").alias("licence"), F.when(takes, F.col("above_path")).alias("inherited_from"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: (path, text). A folder for each source, in it one for each language, in that one for each
    hundred ids and in that one for each ten; the first document of each ten lies with its hundred, that of each
    hundred with its language, that of each thousand with its source. Null sources and languages have folders of
    their own."""
    part = lambda c, name: F.coalesce(F.concat(F.lit(f"{name}="), F.col(c).cast("string")), F.lit(name))
    i = F.col("doc_id")
    deep = lambda width: F.when(i % width != 0, F.floor(i / width).cast("string"))
    folders = [part("source", "source"), F.when(i % 1000 != 0, part("lang", "lang")), deep(100), deep(10)]
    folders[2] = F.when(i % 100 != 0, folders[2])
    return docs.select(F.concat_ws("/", *folders, F.coalesce(i.cast("string"), F.lit("none"))).alias("path"), "text")


def op10_licence_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = lambda c: F.element_at(F.split(c, "/"), -1).try_cast("long")
    return scan_licences(document_files(docs)).select(
        last("path").alias("doc_id"), "n_notices", "own_licence", "cosine", "licence_file", "licence",
        last("inherited_from").alias("inherited_from"),
    )


_QUOTED = lambda t: t.replace("'", "''")
_ROWS = ", ".join(f"({i}, '{name}', '{_QUOTED(text)}')" for i, (name, text) in enumerate(TEMPLATES))
_WORDS = (
    "list_filter(string_split_regex(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
)
_SPLITS = " || ".join(f"string_split_regex(text, '{p}')" for p in PARTS)
OP10_SQL = rf"""
WITH t(template, licence, text) AS (VALUES {_ROWS}),
f AS (
  SELECT doc_id, coalesce('source=' || source, 'source') AS s, coalesce('lang=' || lang, 'lang') AS l,
         (doc_id // 100)::VARCHAR AS h, (doc_id // 10)::VARCHAR AS k, coalesce(text, '') AS text
  FROM documents
), g AS (
  SELECT doc_id, text, CASE WHEN doc_id % 1000 = 0 THEN [s] WHEN doc_id % 100 = 0 THEN [s, l] WHEN doc_id % 10 = 0 THEN [s, l, h] ELSE [s, l, h, k] END AS dirs
  FROM f
), p AS (SELECT doc_id, text, dirs, array_to_string(dirs, '/') AS dir, array_to_string(dirs, '/') || '/' || doc_id AS path FROM g),
dw AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM p),
tt AS (SELECT template, licence, term, count(*) AS tf FROM (SELECT template, licence, unnest({_WORDS.format("text")}) AS term FROM t) GROUP BY ALL),
df AS (
  SELECT term, ln(((SELECT count(*) FROM documents) + {len(TEMPLATES)} + 1.0)::DOUBLE / (count(*) + 1.0)::DOUBLE) + 1.0 AS idf
  FROM (SELECT unnest(list_distinct(w)) AS term FROM dw UNION ALL SELECT term FROM tt) GROUP BY term
), un AS (
  SELECT DISTINCT doc_id, trim(unit, chr(32) || chr(9) || chr(13) || chr(10) || chr(11) || chr(12)) AS unit
  FROM (SELECT doc_id, unnest([text] || {_SPLITS}) AS unit FROM p)
), ut AS (SELECT unit, term, count(*) AS tf FROM (SELECT unit, unnest({_WORDS.format("unit")}) AS term FROM (SELECT DISTINCT unit FROM un)) GROUP BY ALL),
uw AS (SELECT unit, term, tf * idf AS w FROM ut JOIN df USING (term)),
tw AS (SELECT template, licence, term, tf * idf AS w FROM tt JOIN df USING (term)),
nn AS (SELECT unit, sqrt(sum(w * w)) AS norm FROM uw GROUP BY unit),
tn AS (SELECT template, sqrt(sum(w * w)) AS norm FROM tw GROUP BY template),
c AS (
  SELECT uw.unit, tw.licence, round(sum(uw.w * tw.w) / any_value(nn.norm) / any_value(tn.norm), 6) AS cosine
  FROM uw JOIN tw USING (term) JOIN nn ON nn.unit = uw.unit JOIN tn ON tn.template = tw.template
  GROUP BY uw.unit, tw.template, tw.licence
), b AS (
  SELECT unit, licence, cosine FROM c WHERE cosine >= {LEAST_COSINE}
  QUALIFY row_number() OVER (PARTITION BY unit ORDER BY cosine DESC, licence) = 1
), o AS (
  SELECT doc_id, min(struct_pack(c := -cosine, l := licence)) AS best, count(*) AS n_notices, max(len({_WORDS.format("unit")})) AS covered
  FROM un JOIN b USING (unit) GROUP BY doc_id
), r AS (
  SELECT p.doc_id, p.path, p.dir, p.dirs, coalesce(n_notices, 0) AS n_notices, o.best.l AS own_licence, -o.best.c AS cosine,
         coalesce(covered >= len(dw.w) * {FILE_SHARE}, false) AS licence_file
  FROM p JOIN dw USING (doc_id) LEFT JOIN o USING (doc_id)
), l AS (
  SELECT dir, arg_min(struct_pack(licence := own_licence, doc_id := doc_id), struct_pack(c := -cosine, p := path)) AS l
  FROM r WHERE licence_file GROUP BY dir
), above AS (
  SELECT r.doc_id, arg_max(l.l, n) AS l
  FROM (SELECT doc_id, dirs, unnest(range(1, len(dirs) + 1)) AS n FROM r) r JOIN l ON l.dir = array_to_string(r.dirs[1 : n], '/')
  GROUP BY r.doc_id
)
SELECT r.doc_id, n_notices, own_licence, cosine, licence_file, coalesce(own_licence, above.l.licence) AS licence,
       CASE WHEN own_licence IS NULL THEN above.l.doc_id END AS inherited_from
FROM r LEFT JOIN above USING (doc_id)
"""
