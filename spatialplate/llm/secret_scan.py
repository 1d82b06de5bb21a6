"""Secret scans: fixed patterns, and the guess cost of values in credential contexts.

The cost of a value is the least number of guesses (as a power of ten) over its
segmentations into words, dates, repeats, keyboard walks and brute-force spans,
found by dynamic programming from left to right. Words are ranked: a short list
of usual passwords first, then the corpus's own words by how often they come up.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_few, slices

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of 16 or more is the same as a run that is at least 16 long.
HEX = re.compile(r"[0-9a-f]{16,}")
#: Wider contexts whose values are judged by their cost; they begin a word, or a part of one as in dbPassword.
HEAD = (
    r"""(?:(?<![A-Za-z])|(?-i:(?<=[a-z])(?=[A-Z])))(?:pwd|pass|pass_?phrase|pass_?code|password|passwd|secret|token|api_?key|auth|credentials?|(?:access|private|client|secret)_?(?:key|secret))"""
    r"""["']?(?:\x20*[:=]\x20*|\x20is\x20)["']?"""
)
CONTEXT, END = re.compile(HEAD, re.I | re.A), re.compile(r"""[\s"'<>,;]""", re.A)
#: Values that cost at least this power of ten are taken for secrets.
COST = 9.0

WORDS = """
password passwd secret token admin root user login welcome letmein master dragon monkey shadow sunshine princess
football baseball hockey soccer superman batman trustno hello freedom whatever qazwsx iloveyou love money summer
winter spring autumn january february march april june july august september october november december monday
tuesday wednesday thursday friday saturday sunday michael jennifer jordan thomas andrew daniel george charlie
computer internet server database system default changeme test testing example sample demo guest public private
access account service client temp temporary pass word house horse battery staple correct red green blue black
white orange purple silver gold apple banana cherry coffee chocolate cookie pepper ginger tiger lion eagle
the and for you your this that with from have here there please enter value none null true false unknown
""".split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
#: Of the corpus's words so many are ranked, from so many documents on, of so many letters: what is broadcast is bounded by these.
RANKED, DOCUMENTS, LETTERS = 30_000, 3, (3, 24)
#: Costs are remembered of values up to this length.
SHORT = 64
LEET = str.maketrans("013457@$!", "oleastasi")
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
NEXT = {a + b for row in ROWS for x in (row, row[::-1]) for a, b in zip(x, x[1:], strict=False)}
DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d|(?:19|20)\d\d")
#: Each further segment multiplies the guesses by this power of ten.
JOIN = 0.5


def _alphabet(text: str) -> int:
    return max(10, sum(n for pattern, n in ((r"[a-z]", 26), (r"[A-Z]", 26), (r"[0-9]", 10), (r"[^A-Za-z0-9]", 33)) if re.search(pattern, text)))


class Dictionary:
    """Words by rank: the usual ones, then `more`, commonest first."""

    def __init__(self, more: Iterable[str] = ()):
        self.rank = dict(RANK)
        for word in more:
            self.rank.setdefault(word, len(self.rank) + 1)
        self.longest = max(map(len, self.rank))
        self.remembered = lru_cache(50_000)(self._cost)

    def cost(self, value: str) -> float:
        """The least log10 of guesses; 0 for an empty value. Linear in the value's length."""
        return self.remembered(value) if len(value) <= SHORT else self._cost(value)

    def _cost(self, value: str) -> float:
        return least_cost(value, self.rank, self.longest)


def least_cost(value: str, ranks: dict[str, int], longest: int) -> float:
    """The dynamic program: the cheapest way to a value's first i characters, for each i."""
    n = len(value)
    small = value.lower()
    plain = small.translate(LEET)
    unit = math.log10(_alphabet(value))
    best = [0.0] + [math.inf] * n
    free = [0.0] + [math.inf] * n  # the same, with a brute-force span last
    dates = {}
    for i in range(n):
        if small[i].isdigit() and (m := DATE.match(small, i)):
            dates.setdefault(m.end(), []).append(i)
    same = walk = 0  # where the current repeat and walk began
    for i in range(1, n + 1):
        c = small[i - 1]
        join = [JOIN * (j > 0) for j in (0, 1)]
        options = [min(best[i - 1] + JOIN * (i > 1), free[i - 1]) + unit]
        free[i] = options[0]
        if i > 1 and c != small[i - 2]:
            same = i - 1
        if i > 1 and small[i - 2] + c not in NEXT:
            walk = i - 1
        if i - same >= 3:
            options.append(best[same] + join[same > 0] + unit + math.log10(i - same))
        if i - walk >= 3:
            options.append(best[walk] + join[walk > 0] + 1.7 + math.log10(i - walk))
        for j in dates.get(i, ()):
            options.append(best[j] + join[j > 0] + 4.6)
        for j in range(max(0, i - longest), i - 2):
            rank, disguise = ranks.get(small[j:i]), 0.0
            if rank is None and (rank := ranks.get(plain[j:i])) is not None:
                disguise = 0.6
            if rank is not None:
                cased = value[j:i]
                disguise += 0.0 if cased == cased.lower() else 0.3 if cased in (cased.upper(), cased.capitalize()) else 1.0
                options.append(best[j] + join[j > 0] + math.log10(rank + 10) + disguise)
        best[i] = min(options)
    return best[n]


USUAL = Dictionary()


def guess_cost(value: str) -> float:
    """The cost by the usual words alone."""
    return USUAL.cost(value)


def find(text: str, words: Dictionary = USUAL) -> list[tuple[int, int, int, float]]:
    """(start, kind's number, end, cost) of every span, by start and then by kind; cost is 0 for access and hex."""
    spans = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 12:
            spans.append((m.start(), 0, m.end(), words.cost(m[2])))
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= 18:
            spans.append((m.start(), 1, m.end(), 0.0))
    spans += [(m.start(), 2, m.end(), 0.0) for m in HEX.finditer(text)]
    held = sorted((a, b) for a, _, b, _ in spans)
    ends = list(accumulate((b for _, b in held), max))  # how far those up to here reach
    at = stop = 0
    while m := CONTEXT.search(text, at):
        start = m.end()
        if start >= stop:  # values inside one run of characters all end where it does
            stop = d.start() if (d := END.search(text, start)) else len(text)
        value = text[start:stop].rstrip(".!?)]}")
        end = start + len(value)
        before = bisect.bisect_left(held, (end, 0))
        # A run that is cheap as a whole holds few contexts, for each costs guesses: the program runs a few times over it at most.
        if len(value) >= 6 and (before == 0 or ends[before - 1] <= start) and (cost := words.cost(value)) >= COST:
            spans.append((start, 3, end, cost))
            at = stop
        else:  # the value may be another context's name, or hold one
            at = max(start, at + 1)
    return sorted(spans)


def ranked(df: DataFrame, text_col: str = "text") -> list[str]:
    """The RANKED words of LETTERS letters that most texts hold outside the values of credential contexts, DOCUMENTS texts at least, ties by name: all that reaches the driver.

    A value that leaks again and again does not become a word by that.
    """
    plain = F.regexp_replace(F.lower(F.regexp_replace(F.col(text_col), rf"(?i){HEAD}[^\s\"'<>,;]*", " ")), r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[a-z0-9+/_.=-]+", " ")
    words = F.array_distinct(F.regexp_extract_all(plain, F.lit(rf"(?<!\p{{L}})\p{{L}}{{{LETTERS[0]},{LETTERS[1]}}}(?!\p{{L}})"), F.lit(0)))
    counts = df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= DOCUMENTS)
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(RANKED).collect()]


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<start, kind, end, cost>>) for each row of df; spans in code points, end exclusive.

    A null or empty text has no spans; repeated rows and null ids give a row
    each; very long texts are scanned whole. Other columns are not carried.
    """
    common = df.sparkSession.sparkContext.broadcast(ranked(df, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("cost", pa.float64())]))
        words = Dictionary(common.value)
        for batch in batches:
            for part in slices(batch, 1, 4_000_000):
                out = [[{"start": a, "kind": KINDS[k], "end": b, "cost": cost} for a, k, b, cost in find(t, words)] if t else [] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, kind)], ["id", "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    return by_few(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, f"id {kind}, spans array<struct<start:long,kind:string,end:long,cost:double>>").withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the hash of the base spans, all spans as text and the greatest cost, from a table of scan()."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("spans", lambda s: s.kind != "guess")
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long")
    return found.select(
        id_col,
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.array_max(F.transform("spans", lambda s: s.cost)).alias("max_cost"),
    )


def base_spans(text: str | None) -> tuple[list[int], str]:
    """Counts and hash by the rule alone, for checks."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text or "") if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text or "") if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 16]
    listed = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return [sum(k == i for _, k, _ in spans) for i in range(3)], hashlib.sha256(listed.encode()).hexdigest()
