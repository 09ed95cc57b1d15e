r"""Secret scans: three fixed patterns, and a guess-cost search over values in credential contexts.

The patterns find assignments, access keys and hexadecimal runs. Beyond them, every value that a wider set of
credential words introduces is cut, by dynamic programming, into the segments that a guesser would try -
words, dates, repeats, keyboard walks, alphabetic or numeric sequences, hosts, joints between them, brute-force
spans - so that the whole takes the fewest guesses. A value that still takes ``least_bits`` bits or more is a secret
of kind ``guess``. Words are a fixed list and then the commonest of the corpus, counted once for each document over
all documents, what follows ``:`` and ``=`` left out so that no secret makes itself a word.

Defined results: null and empty texts have no spans; positions count code points, ends are exclusive; added
spans never overlap a pattern's span; bits are counted up to ``MOST_BITS``, where the search for fewer ends; rows
that repeat an id are scanned each, but a text counts its words as often as it is there; an empty table gives an
empty one; extra columns, whatever their names, are left alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverdf.llm._shared import ascii_lower, first_rows, lean_batches, text_of

KINDS = ("assign", "access", "hex", "guess")
#: Guesses, as a power of two, from which a value counts as a secret.
LEAST_BITS = 42.0
#: Bits up to which values are told apart.
MOST_BITS = 256.0
#: Words of the corpus that guessers try (what is broadcast has no more), documents that each is in at least, letters.
DICTIONARY, LEAST_DOCUMENTS, SHORTEST, LONGEST = 20_000, 10, 3, 24
#: The base patterns: fixed values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: What introduces a value to weigh; a text without any of HINTS can hold none.
HINTS = ("pass", "pwd", "secret", "token", "key", "cred", "auth", "bearer", "login")
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|client|auth)[_-]?(?:key|secret|token)"""
    r"""|credentials?|authorization|bearer|login)["']?(\x20*(?:=>|[:=])\x20*|\x20+is\x20+|\x20+)["']?([^\x00-\x20\x7F-\xA0\u1680\u2000-\u200B\u2028\u2029\u202F\u205F\u3000]{8,})""",
    re.I | re.A,
)
QUOTES = "\"'`,;)]}>."
#: What joins the words of prose, addresses and paths.
JOINTS = re.compile(r"[-_./:@'&?#%+~\u2019]+")

#: Words that guessers try first, the commonest first.
WORDS = (
    "password pass admin welcome login master dragon monkey letmein secret qwerty love hello shadow sunshine "
    "princess football baseball superman batman trustno test guest root user changeme default access server "
    "database service system public private token bearer example sample dummy null none true false summer "
    "winter spring autumn monday friday january october december company office internet computer freedom "
    "whatever michael jordan charlie daniel thomas jessica ashley hunter ranger buster killer soccer hockey "
    "george andrew michelle tigger cheese coffee banana orange purple yellow silver golden flower family "
    "money power magic angel heaven jesus the and you for this that with from have your are not"
).split()
RANK = {w: math.log2(i + 2) for i, w in enumerate(WORDS)}
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
#: Keys beside each key: those beside it in its row, and above and below.
BESIDE = {
    a: {
        ROWS[r][c]
        for r in range(max(0, y - 1), min(4, y + 2))
        for c in range(max(0, x - 1), min(len(ROWS[r]), x + 2))
        if (r, c) != (y, x)
    }
    for y, row in enumerate(ROWS)
    for x, a in enumerate(row)
}
DATE = re.compile(
    r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"
    r"|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d"
)
#: A host at the beginning of a value, or behind the @ of an address.
HOST = re.compile(r"(?:[a-z]{2,9}://)?(?:[a-z0-9-]{1,63}\.){1,6}(?:com|org|net|edu|gov|info|io|dev|de|fr|es|uk|eu)(?![a-z0-9.-])(?::\d{2,5})?")
_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("@4301$5!7", "aaeoissit")
#: Bits to open a segment of any kind: the guesser tries kinds and places too.
OPEN = 2.0
_DIGIT, _SMALL, _LARGE, _MARK = (math.log2(n) for n in (10, 26, 26 * 4, 33))


def char_bits(c: str) -> float:
    """Bits of one brute-forced character: the size of its class; a capital takes two more, so that letters of
    random case take a bit more each than letters of one."""
    return _DIGIT if c.isdigit() else _LARGE if c.isupper() else _SMALL if c.isalpha() else _MARK


def ranked(words: list[str]) -> dict[str, float]:
    """Bits of each word to try: the fixed ones first, then ``words`` in their order."""
    return {w: math.log2(i + 2) for i, w in enumerate(dict.fromkeys([*WORDS, *words]))}


RANK = ranked([])


class Segments:
    """The structured segments of a value: ``at(i)``, for i in ascending order, gives (end, bits, kind) of those from
    i. Of each kind of run only the end of the present one is held, however long the value."""

    def __init__(self, value: str, rank: dict[str, float] = RANK):
        self.value, self.rank, self.n = value, rank, len(value)
        self.low = value.translate(_ASCII_LOWER)
        self.plain = self.low.translate(LEET)
        self.ends: dict = {}

    def _end(self, kind, i: int, goes_on) -> int:
        """The first place from i on at which ``goes_on`` does not hold."""
        end = self.ends.get(kind, -1)
        if end < i:
            end = i
            while end < self.n and goes_on(end):
                end += 1
            self.ends[kind] = end
        return end

    def at(self, i: int) -> Iterator[tuple[int, float, str]]:
        value, low, n = self.value, self.low, self.n
        for j in range(i + SHORTEST, min(n, i + LONGEST) + 1):
            for word, extra in ((low[i:j], 0.0), (self.plain[i:j], 1.0)):
                if (bits := self.rank.get(word)) is not None:
                    yield j, bits + extra + (value[i:j] != low[i:j]), "word"
                    break
        if (m := DATE.match(value, i)) is not None:
            yield m.end(), math.log2(200) if m.end() - i == 4 else math.log2(200 * 365 * 4), "date"
        if (i == 0 or value[i - 1] == "@") and (m := HOST.match(low, i)) is not None:
            yield m.end(), 12.0, "host"
        if JOINTS.match(value[i]):
            yield i + 1, 1.0, "joint"
        for unit in (1, 2, 3, 4):
            # How many characters from i on equal those `unit` later.
            same = self._end(unit, i, lambda k, u=unit: k + u < n and value[k] == value[k + u]) - i
            times = 1 + same // unit
            if times >= 2 and times * unit >= 3:
                yield i + times * unit, sum(map(char_bits, value[i : i + unit])) + math.log2(times), "repeat"
        end = 1 + self._end("walk", i, lambda k: k + 1 < n and low[k + 1] in BESIDE.get(low[k], ()))
        if end - i >= 4:
            yield end, math.log2(37) + (end - i - 1), "walk"
        for d in (1, -1):
            end = 1 + self._end(f"step {d}", i, lambda k, d=d: k + 1 < n and low[k + 1].isascii() and low[k + 1].isalnum() and ord(low[k + 1]) - ord(low[k]) == d)
            if end - i >= 3:
                yield end, math.log2(36 * 2) + math.log2(end - i), "sequence"


def guess_bits(value: str, rank: dict[str, float] = RANK, most: float = math.inf, cuts: bool = True) -> tuple[float, list[tuple[int, int, str]]]:
    """The least bits over all ways to cut ``value``, and, if ``cuts``, the cut: (start, end, kind) in order.

    Ends, with ``most``, as soon as no way takes fewer. Places behind are forgotten unless the cut is asked for."""
    low = value.translate(_ASCII_LOWER)
    if low != value and value.upper() == value:  # all in capitals: one more guess, not one for each
        bits, cut = guess_bits(low, rank, most, cuts)
        return min(most, bits + 1.0), cut
    segments = Segments(value, rank)
    # Least bits of a cut up to here that ends with a structured segment, by place; and with a brute-force span.
    ahead: dict[int, float] = {0: 0.0}
    brute = math.inf
    came: dict[tuple[int, int], tuple[int, int, str]] = {}
    for i, c in enumerate(value):
        closed = ahead.pop(i, math.inf)
        at, other = min((closed, 0), (brute, 1))
        if i % 16 == 0 and min(at, *ahead.values(), math.inf) >= most:
            return most, []
        opened, onward = at + OPEN + char_bits(c), brute + char_bits(c)
        if cuts:
            came[i + 1, 1] = (i, 1, "brute") if onward < opened else (i, other, "open")
        brute = min(opened, onward)
        for j, cost, kind in segments.at(i):
            if at + OPEN + cost < ahead.get(j, math.inf):
                ahead[j] = at + OPEN + cost
                if cuts:
                    came[j, 0] = (i, other, kind)
    total, b = min((ahead.get(len(value), math.inf), 0), (brute, 1))
    cut: list[tuple[int, int, str]] = []
    j = len(value)
    while cuts and j:
        i, before, kind = came[j, b]
        if kind == "brute" and cut and cut[-1][2] == "brute*":
            cut[-1] = (i, cut[-1][1], "brute*")
        elif kind in ("brute", "open"):
            end = cut.pop()[1] if cut and cut[-1][2] == "brute*" else j
            cut.append((i, end, "brute*" if kind == "brute" else "brute"))
        else:
            cut.append((i, j, kind))
        j, b = i, before
    return min(most, total), [(i, j, k.rstrip("*")) for i, j, k in reversed(cut)]


def is_prose(value: str) -> bool:
    """Whether a value is words, in small letters or with a capital first, joined as in compounds, addresses and paths."""
    parts = [p for p in JOINTS.split(value) if p]
    return bool(parts) and all(p.isalpha() and (p == p.lower() or p.istitle()) for p in parts)


def find_spans(text: str | None, least_bits: float = LEAST_BITS, rank: dict[str, float] = RANK) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, bits) of a whole text, by start and then kind; keys and runs have 0 bits."""
    if not text:
        return []
    low = text.lower()
    hinted = any(h in low for h in HINTS)
    found = []
    if hinted:
        found += [(m.start(), m.end(), "assign", guess_bits(m[2], rank, MOST_BITS, False)[0]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", 0.0) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex", 0.0) for m in HEX.finditer(text)]
    if hinted:
        taken = sorted((a, b) for a, b, _, _ in found)
        for m in CONTEXT.finditer(text):
            start, value = m.start(2), m[2].rstrip(QUOTES)
            end = start + len(value)
            if len(value) < 8 or any(a < end and start < b for a, b in taken):
                continue
            assigned = m[1].strip(" ") in (":", "=", "=>") or m[0][:6].lower() == "bearer"
            if not assigned and is_prose(value):
                continue  # what goes on after a credential word
            bits, _ = guess_bits(value, rank, MOST_BITS, False)
            if bits >= least_bits:
                found.append((start, end, "guess", bits))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


SPANS = "array<struct<start: long, end: long, kind: string, bits: double>>"


def common_words(docs: DataFrame, text_col: str = "text", most: int = DICTIONARY, least: int = LEAST_DOCUMENTS) -> list[str]:
    """The words of ASCII letters that are in the most documents, ``most`` of them, commonest first; ties by name."""
    prose = F.regexp_replace(text_of(text_col), r"[:=]>?[\x20\"']*[^\x20\x09-\x0D]+", " ")
    words = docs.select(F.explode(F.array_distinct(F.split(ascii_lower(prose), "[^a-z]+"))).alias("word"))
    counted = words.where(F.length("word").between(SHORTEST, LONGEST)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    top = first_rows(counted.where(F.col("n") >= least), [F.desc("n"), "word"], ["word"], most)
    return [r["word"] for r in top.collect()]


def scan_column(spark, least_bits: float = LEAST_BITS, words: list[str] | None = None):
    sent = spark.sparkContext.broadcast(ranked(words or []))  # at most DICTIONARY words and the fixed ones

    @F.pandas_udf(SPANS)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rank = sent.value
        for texts in batches:
            yield pd.Series(
                [[{"start": a, "end": b, "kind": k, "bits": c} for a, b, k, c in find_spans(t, least_bits, rank)] for t in texts]
            )

    return scan


def find_secrets(docs: DataFrame, text_col: str = "text", least_bits: float = LEAST_BITS, words: list[str] | None = None) -> DataFrame:
    """``docs`` with a column ``secret_spans``: all spans of each whole text. ``words``: the corpus's commonest, counted
    here if not given."""
    lean_batches(docs.sparkSession)
    words = common_words(docs, text_col) if words is None else words[:DICTIONARY]
    return docs.withColumn("secret_spans", scan_column(docs.sparkSession, least_bits, words)(F.col(text_col).cast("string")))


def redact(text: str | None, spans: list, mark: str = "[{kind}]") -> str | None:
    """The text with every span replaced; overlapping spans become one."""
    if text is None:
        return None
    out, at = [], 0
    for s in spans:
        if s["end"] > at:
            if s["start"] >= at:
                out += [text[at : s["start"]], mark.format(kind=s["kind"])]
            at = s["end"]
    return "".join([*out, text[at:]])


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secret_spans", lambda s: s["kind"] != KINDS[-1])
    return find_secrets(docs).select(
        "doc_id", *[of(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(said(base), 256).alias("base_sha256"), said(F.col("secret_spans")).alias("spans"),
        of(KINDS[-1]).alias("n_guess"), F.coalesce(F.array_max(F.transform("secret_spans", lambda s: s["bits"])), F.lit(0.0)).alias("most_bits"),
    )
