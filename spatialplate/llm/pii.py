"""Personal data replaced by keyed surrogates that keep type, gender, script and format.

An entity is a type and an identity (a mail address in lower case, a telephone
number's digits, a name's word), so that all its spellings get one surrogate in
every document. Surrogates come from a keyed hash of the identity; they are
checked against each other and against all identities of the corpus, and those
that collide are drawn again until each entity has one of its own.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_few, row_key, slices, written

SALTS = 16
#: From this attempt on a surrogate may be longer than its entity, for its format has few values left;
#: an address then comes from the block that is never given out (240 and up).
LONGER = 5

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = [
    ("email", re.compile(r"(?<![\w.%+-])[\w.%+-]+@[^\W_](?:[\w-]*\.)+[^\W\d_]{2,}(?![\w-])")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("card", re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])")),
    ("ip", re.compile(rf"(?<![\w.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\w)")),
    ("ip6", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?=[A-Fa-f:]*\d)[0-9A-Fa-f]{4}:(?:[0-9A-Fa-f]{1,4}:){0,5}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.+(-])(?:\+\d{8,15}|\+\d{1,3}(?:[ .-]\d{1,4}){3,6}|0\d(?:[ .]\d\d){4}|0\d{9}|(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4})(?!\w)")),
]
#: Forms of address and the gender that they tell.
TITLES = {
    "f": "Mrs Ms Miss Madam Lady Frau Madame Mme Mlle Mademoiselle Señora Sra Señorita Doña госпожа г-жа κυρία".split(),
    "m": "Mr Mister Sir Lord Herr Monsieur Señor Sr Don господин г-н κύριος".split(),
    "n": "Dr Prof Professor".split(),
}
GENDER = {t: g for g, titles in TITLES.items() for t in titles}
NAMED = re.compile(rf"(?<!\w)({'|'.join(sorted(map(re.escape, GENDER), key=len, reverse=True))})\.? ([^\W\d_][^\W\d_]+(?:[ -][^\W\d_]{{2,}}){{0,2}})")
#: Sounds that names are made of, by script, and endings by gender.
SOUNDS = {
    "latin": ("bcdfghjklmnprstvwz", "aeiou", {"f": "a", "m": "n", "n": "y"}),
    "cyrillic": ("бвгджзклмнпрстфх", "аеиоу", {"f": "а", "m": "н", "n": "й"}),
    "greek": ("βγδζθκλμνπρστφχ", "αειου", {"f": "α", "m": "ς", "n": "ο"}),
}


def script(text: str) -> str:
    """latin, cyrillic, greek, or as Unicode names the first letter's script."""
    c = next((c for c in text if c.isalpha()), "a")
    return "cyrillic" if "Ѐ" <= c <= "ԯ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin" if c < "ɐ" else unicodedata.name(c, "OTHER").split(" ")[0].lower()


@lru_cache(4096)
def siblings(c: str) -> str:
    """Letters of c's script and kind (capital, small or without case) in its block of 256 code points."""
    kind, own = unicodedata.category(c), script(c)
    block = map(chr, range(ord(c) & ~0xFF, (ord(c) & ~0xFF) + 256))
    return "".join(x for x in block if unicodedata.category(x) == kind and script(x) == own) or c


def identity(kind: str, surface: str) -> str:
    """What an entity's spellings have in common."""
    if kind in ("email", "ip6", "name"):
        return surface.lower()
    if kind == "iban":
        return surface.replace(" ", "")
    if kind in ("card", "ssn", "phone"):
        digits = re.sub(r"\D", "", surface)
        return digits[1:] if kind == "phone" and len(digits) == 11 and digits[0] == "1" else digits
    return surface


def titled(text: str) -> list[tuple[str, list[str]]]:
    """Gender and capitalised words of each name that follows a form of address."""
    out = []
    for m in NAMED.finditer(text):
        words = []
        for word in re.findall(r"[^\W\d_]+", m[2]):
            if not word[0].isupper() and word[0].lower() != word[0].upper():
                break
            words.append(word)
        if words:
            out.append((GENDER[m[1]], words))
    return out


def find(text: str, also: Iterable[str] = ()) -> list[tuple[int, int, str, str, str]]:
    """(start, end, type, gender, surface) of each entity, in order and without overlap; earlier types go first.

    Names are the words after a form of address, and those of `also`, which
    come without one; all their mentions in the text count.
    """
    out: list[tuple[int, int, str, str, str]] = []
    taken: list[tuple[int, int]] = []  # in order

    def add(start: int, end: int, kind: str, gender: str = "") -> None:
        at = bisect.bisect(taken, (start, end))
        if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or taken[at][0] >= end):
            taken.insert(at, (start, end))
            out.append((start, end, kind, gender, text[start:end]))

    for kind, pattern in PATTERNS:
        if kind == "email" and "@" not in text:
            continue
        for m in pattern.finditer(text):
            add(m.start(), m.end(), kind)
    names: dict[str, str] = {}
    for gender, words in titled(text):
        for word in words:
            names.setdefault(word, gender)
    for word in also:
        names.setdefault(word, "n")
    if names:  # every mention in the document, with or without a title
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(names, key=len, reverse=True)))})(?!\w)", text):
            add(m.start(), m.end(), "name", names[m[0]])
    return sorted(out)


class Stream:
    """Numbers from a keyed hash of a name."""

    def __init__(self, key: bytes, name: str):
        self.key, self.name, self.block, self.state = key, name.encode(), 0, 0
        self.left = 0

    def below(self, n: int) -> int:
        if self.left < 1 << 40:
            self.state = int.from_bytes(hmac.new(self.key, self.name + b"|%d" % self.block, hashlib.sha256).digest(), "big")
            self.left, self.block = 1 << 256, self.block + 1
        self.state, out = divmod(self.state, n)
        self.left //= n
        return out


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _like(c: str, s: Stream) -> str:
    """A character of the same kind: digit, or letter of its script and case."""
    if c.isdigit():
        return str(s.below(10))
    if not c.isalpha():
        return c
    if script(c) not in SOUNDS:
        return siblings(c)[s.below(len(siblings(c)))]
    consonants, vowels, _ = SOUNDS[script(c)]
    letters = consonants + vowels
    out = letters[s.below(len(letters))]
    return out.upper() if c.isupper() else out


def surrogate(kind: str, entity: str, gender: str, attempt: int, key: bytes) -> str:
    """The identity that replaces an entity at this attempt."""
    s = Stream(key, f"{kind}|{entity}|{attempt}")
    more = max(0, attempt - LONGER + 1)
    if kind == "email":
        local, _, domain = entity.rpartition("@")
        labels = domain.split(".")
        kept = 2 if labels[-2:] in (["example", "com"], ["example", "net"], ["example", "org"]) else 1
        d = Stream(key, f"domain|{domain}")  # a domain's addresses stay together
        host = [re.sub(r"\w", lambda m: _like(m[0], d), x) for x in labels[:-kept]] + labels[-kept:]
        return "".join(_like(c, s) for c in local) + "".join(_like("a", s) for _ in range(more)) + "@" + ".".join(host)
    if kind == "ip":
        octets = list(map(int, entity.split(".")))
        fixed = 1 if octets[0] in (10, 127) else 2 if octets[:2] == [192, 168] or octets[0] == 172 and 16 <= octets[1] < 32 else 0
        first = [*octets[:fixed]]
        if more:
            first = [240 + s.below(15)]
        elif not fixed:
            first = [20 + s.below(104)]  # neither private nor reserved
        return ".".join(map(str, first + [1 + s.below(254) for _ in range(4 - len(first))]))
    if kind == "ip6":
        wide = ":".join(["0" * 4] * 8) if more else entity
        return re.sub(r"[0-9a-f]", lambda m: "0123456789abcdef"[s.below(16)], wide)
    extra = "".join(str(s.below(10)) for _ in range(more))
    if kind == "card":
        valid, entity = luhn(entity), entity[:-1] + extra + entity[-1]
        body = entity[0] + "".join(str(s.below(10)) for _ in entity[1:-1])
        ends = [c for c in "0123456789" if luhn(body + c) == valid]
        return body + ends[s.below(len(ends))]
    if kind == "ssn":
        return "9" + "".join(str(s.below(10)) for _ in entity[1:]) + extra
    if kind == "iban":
        body = "".join(str(s.below(10)) if c.isdigit() else chr(65 + s.below(26)) for c in entity[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in body + entity[:2] + "00")) % 97
        return f"{entity[:2]}{check:02d}{body}"
    if kind == "phone":
        return "".join(c if c == "0" and i == 0 else str(2 + s.below(8)) if i == 0 else str(s.below(10)) for i, c in enumerate(entity)) + extra
    if script(entity) not in SOUNDS:  # no endings by gender are known: letter by letter
        return "".join(_like(c, s) for c in entity) + "".join(_like(entity[-1], s) for _ in range(more))
    consonants, vowels, ends = SOUNDS[script(entity)]
    syllables = max(2, -(-len(entity) // 3)) + more
    return "".join(consonants[s.below(len(consonants))] + vowels[s.below(len(vowels))] for _ in range(syllables)) + ends[gender or "n"]


def render(kind: str, surface: str, new: str) -> str:
    """The surrogate in the format of the surface: its separators, prefix and case."""
    if kind in ("card", "ssn", "phone", "iban"):
        plain = re.sub(r"\W", "", surface)
        new = plain[: max(0, len(plain) - len(new))] + new  # a country's prefix stays
        fresh = iter(new)
        out = "".join(next(fresh) if c.isalnum() else c for c in surface)
        return out + "".join(fresh)
    if kind == "name":
        return new.upper() if surface.isupper() and len(surface) > 1 else new.capitalize() if surface[:1].isupper() else new
    if kind in ("email", "ip6") and surface.upper() == surface:
        return new.upper()
    if kind == "email" and surface[:1].isupper():
        return new[:1].upper() + new[1:]
    return new


#: Two capitalised words in a row, for Spark's regular expressions.
TWO = r"(?<![\p{L}\p{N}_])(?=(\p{Lu}\p{L}+ \p{Lu}\p{L}+)(?![\p{L}\p{N}_]))"


def _found(rows: DataFrame) -> DataFrame:
    """Entities of rows(_id, _key, text, also); `full` entities, at no place, are the pairs of words in a row in titled names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_id", "_key", "start", "end", "type", "gender", "surface", "entity"]
        for batch in batches:
            for part in slices(batch, 2, 2_000_000):
                rows = []
                for i, (t, also) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    if t:
                        rows += [(i, *x, identity(x[2], x[4])) for x in find(t, also or ())]
                        rows += [(i, -1, -1, "full", g, pair, pair) for pair, g in {f"{a} {b}": g for g, words in titled(t) for a, b in zip(words, words[1:], strict=False)}.items()]
                if rows:
                    at, start, end, kind, gender, surface, entity = zip(*rows, strict=True)
                    take = pa.array(at, pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(start, pa.int32()), pa.array(end, pa.int32()), *[pa.array(x, pa.string()) for x in (kind, gender, surface, entity)]], names)

    kind = rows.schema["_id"].dataType.simpleString()
    return by_few(rows).mapInArrow(run, f"_id {kind}, _key long, start int, end int, type string, gender string, surface string, entity string")


def spans(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _key, start, end, type, gender, surface, entity) of every entity found.

    A name of two words or more that has a form of address anywhere in the
    corpus is also found in documents that give it without one; single words of
    names are sought only in documents that hold such a name.
    """
    rows = df.select(F.col(id_col).alias("_id"), row_key(F.col(id_col), F.col(text_col)).alias("_key"), F.col(text_col).cast("string").alias("text"))
    found = written(_found(rows.withColumn("also", F.lit(None).cast("array<string>"))), "spans")
    known = found.where("type = 'full'").groupBy(F.col("entity").alias("pair")).agg(F.count("*").alias("_n"))
    if known.isEmpty():
        return found
    pairs = rows.select("_id", "_key", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TWO), F.lit(1)))).alias("pair"))
    # A name may be in a third of all documents.
    salted = known.select("pair", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    met = pairs.withColumn("_salt", F.pmod("_key", F.lit(SALTS)).cast("int")).hint("merge").join(salted, ["pair", "_salt"])
    also = written(met.groupBy("_id", "_key").agg(F.array_distinct(F.flatten(F.collect_set(F.split("pair", " ")))).alias("also")), "names").withColumnsRenamed({"_id": "_also_id", "_key": "_also_key"})
    same = (F.col("_key") == F.col("_also_key")) & F.col("_id").eqNullSafe(F.col("_also_id"))
    again = _found(rows.hint("merge").join(also, same).select("_id", "_key", "text", "also"))
    return written(found.hint("merge").join(also, same, "left_anti").unionByName(again), "spans")


def assigned(found: DataFrame, key: bytes) -> DataFrame:
    """(type, entity, new): each entity's surrogate, unlike all others and unlike all entities of the corpus.

    An entity's gender is the one most told of its mentions; it is neutral where
    none is told or both are equally often.
    """
    # Sums by entity, not groups by gender: one pass, combined before the shuffle.
    told = lambda g: F.count_if(F.col("gender") == g)
    most = F.when(told("f") > told("m"), "f").when(told("m") > told("f"), "m").otherwise("n")
    entities = written(found.groupBy("type", "entity").agg(most.alias("gender")), "entities")

    @F.pandas_udf("string")
    def draw(kind: pd.Series, entity: pd.Series, gender: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(*x, key) for x in zip(kind, entity, gender, attempt, strict=True)], dtype=object)

    done: DataFrame | None = None
    left, attempt = entities, 0
    while True:
        drawn = left.withColumn("new", draw("type", "entity", "gender", F.lit(attempt)))
        free = drawn.join(entities.select("type", F.col("entity").alias("new")), ["type", "new"], "left_anti")
        if done is not None:
            free = free.join(done.select("type", "new"), ["type", "new"], "left_anti")
        won = written(free.groupBy("type", "new").agg(F.min("entity").alias("entity")), "surrogates").select("type", "entity", "new")
        done = won if done is None else done.unionByName(won)
        left = written(left.join(won.select("type", "entity"), ["type", "entity"], "left_anti"), "left")
        if left.isEmpty():
            return done
        attempt += 1


def replace(df: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with the entities of `text_col` replaced, and _entities: how many were.

    The same key gives the same surrogates for the same corpus. Telephone
    numbers are found with a country's prefix, in pairs from 0, with ten digits
    from 0, or in three groups; seven digits without a prefix are not, and names
    only as spans() says. A null text
    stays null and an empty one empty, with 0 entities; very long texts are
    searched whole; repeated rows and null ids are treated like others. All
    columns and rows stay; an empty table gives an empty one.
    """
    found = spans(df, id_col, text_col).where("type <> 'full'")
    new = assigned(found, key)

    @F.pandas_udf("string")
    def put(kind: pd.Series, surface: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([render(*x) for x in zip(kind, surface, new, strict=True)], dtype=object)

    # One entity may be in a third of all documents: its mentions are dealt out to as many copies of its surrogate.
    salted = new.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mentions = found.withColumn("_salt", F.pmod("_key", F.lit(SALTS)).cast("int")).join(salted, ["type", "entity", "_salt"])
    edits = mentions.select("_id", "_key", F.struct("start", "end", put("type", "surface", "new").alias("new")).alias("e")).groupBy("_id", "_key").agg(F.sort_array(F.collect_set("e")).alias("_edits"))
    edits = written(edits, "edits").withColumnsRenamed({"_id": "_edit_id", "_key": "_edit_key"})
    keyed = df.withColumn("_key", row_key(F.col(id_col), F.col(text_col)))
    # The table of edits grows with the documents: one plan at every size.
    joined = keyed.join(edits.hint("merge"), (F.col("_key") == F.col("_edit_key")) & F.col(id_col).eqNullSafe(F.col("_edit_id")), "left")
    text = F.col(text_col)
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get("_edits", i - 1).end)
    parts = F.transform("_edits", lambda e, i: F.concat(F.substr(text, begin(i) + 1, e.start - begin(i)), e.new))
    out = F.when(F.col("_edits").isNull(), text).otherwise(F.concat(F.array_join(parts, ""), F.substr(text, F.element_at("_edits", -1).end + 1, F.length(text))))
    return joined.select(*[out.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns], F.when(F.col("_edits").isNull(), 0).otherwise(F.size("_edits")).alias("_entities"))
