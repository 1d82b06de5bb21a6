"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built from a bounded sample of its
labelled rows. A text is parsed from left to right into the longest phrases
that occur in that sample; the language whose phrases per letter, times the log
of its sample's length, are fewest wins (Ziv and Merhav 1993). All letters of
the samples are told apart. Texts are parsed whole: many blocks of many texts
step through the automata together, each as if a phrase began there, and then
the phrase that the block before left open is followed until both agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_few, slices

#: Bounds of the sample: rows a language, taken whole, and characters that such a row may have (a language of longer rows only gives its shortest).
ROWS, LONGEST = 24, 8_000
#: Symbols of a block that is parsed beside others.
BLOCK = 256
UNKNOWN = "und"


def automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence of symbols; state 0 is the root."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        now = len(follow)
        follow.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = now
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(follow)
                follow.append(dict(follow[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return follow


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    """Symbols of a lower-cased text: 0 for a run of other characters than letters, 1 for letters in no sample."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
    out = table[points]
    if len(out):
        out = out[np.append(True, (out[1:] != 0) | (out[:-1] != 0))]
    return out


def letters() -> np.ndarray:
    """1 for each code point that is a letter, else 0."""
    table = np.zeros(0x110000, np.int32)
    every = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    table[every[[chr(c).isalpha() for c in every.tolist()]]] = 1
    return table


def laid_out(follow: list[dict[int, int]], first: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of transitions laid over each other: where each state's row begins, and cells of (state << 32 | next state); -1 is a free cell.

    The root has no row. States are numbered from `first`. A state with several
    transitions goes where they are all free near the end, else after it; those
    with one then fill the gaps.
    """
    base = np.zeros(len(follow), np.int64)
    several = [s for s in range(1, len(follow)) if len(follow[s]) > 1]
    used = bytearray(width)
    end = 0
    for s in several:
        row = list(follow[s])
        if len(used) < end + 2 * width:
            used.extend(bytes((1 << 16) + 2 * width))
        at = next((at for at in range(max(0, end - min(width, 64)), end) if not any([used[at + c] for c in row])), end)
        end = max(end, at + max(row) + 1)
        base[s] = at
        for c in row:
            used[at + c] = 1
    single = [s for s in range(1, len(follow)) if len(follow[s]) == 1]
    taken = np.frombuffer(used, np.uint8)
    free = np.flatnonzero(taken == 0)
    free = np.concatenate([free[free >= width], np.arange(max(width, len(taken)), max(width, len(taken)) + len(single))])[: len(single)]
    cells = np.full(max(len(taken), int(free.max(initial=0)) + 1) + width, -1, np.int64)
    for s, at in zip(single, free.tolist(), strict=True):
        (c,) = follow[s]
        base[s] = at - c
    for s in range(1, len(follow)):
        for c, to in follow[s].items():
            cells[base[s] + c] = (first + s) << 32 | first + to
    return base, cells


@dataclass
class Model:
    """languages, the log2 of their samples' lengths, symbols of code points, and all automata in one table.

    roots: each language's first state; begun[language, symbol]: the state after
    a phrase's first symbol, the root where the symbol is not in the sample;
    base and cells: see laid_out().
    """

    languages: list[str]
    logs: np.ndarray
    table: np.ndarray
    roots: np.ndarray
    begun: np.ndarray
    base: np.ndarray
    cells: np.ndarray

    @classmethod
    def fit(cls, samples: dict[str, list[str]]) -> Model:
        """samples: texts of each language; languages without a letter in theirs are not learned."""
        texts = {k: " ".join(dict.fromkeys(v)).lower() for k, v in sorted(samples.items())}
        texts = {k: t for k, t in texts.items() if any(c.isalpha() for c in t)}
        table = letters()
        known = sorted({c for t in texts.values() for c in set(t) if c.isalpha()})
        for i, c in enumerate(known):
            table[ord(c)] = i + 2
        width = len(known) + 2
        roots, begun, bases, cells, logs = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        states = at = 0
        for text in texts.values():
            coded = symbols(text, table)
            follow = automaton(coded.tolist())
            first = np.full(width, states, np.int64)
            for c, s in follow[0].items():
                first[c] = states + s
            base, own = laid_out(follow, states, width)
            roots.append(states)
            begun.append(first)
            bases.append(base + at)
            cells.append(own)
            states, at = states + len(follow), at + len(own)
            logs.append(math.log2(max(2, len(coded))))
        return cls(list(texts), np.array(logs), table, np.array(roots, np.int64), np.array(begun, np.int64).reshape(-1, width), np.concatenate(bases), np.concatenate(cells))

    def _step(self, state: np.ndarray, language: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after one more symbol, and whether a phrase began with it."""
        cell = self.cells[self.base[state] + symbol]
        begins = cell >> 32 != state
        return np.where(begins, self.begun[language, symbol], cell & 0xFFFFFFFF), begins

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text in each language, and its number of symbols."""
        coded = [symbols(t, self.table) for t in texts]
        sizes = np.array([len(c) for c in coded], np.int64)
        stream = np.concatenate(coded)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = np.repeat(np.cumsum(sizes) - sizes, blocks) + inner * BLOCK
        length = np.minimum(BLOCK, np.repeat(sizes, blocks) - inner * BLOCK)
        languages = np.arange(len(self.roots))[:, None]
        began = np.zeros((len(self.roots), len(stream)), bool)
        left = np.repeat(self.roots[:, None], len(owner), axis=1)  # each block's state after it
        order = np.argsort(-length, kind="stable")
        ends = np.searchsorted(-length[order], -np.arange(int(length.max(initial=0))), "left")
        state, from_ = left.copy(), start[order]
        for t, n in enumerate(ends.tolist()):
            at = from_[:n] + t
            state[:, :n], began[:, at] = self._step(state[:, :n], languages, stream[at])
        left[:, order] = state
        alone = left.copy()
        # From the second block of a text on: what the phrase left open before changes, up to a place where both parses begin one.
        change = np.zeros((len(self.roots), len(owner)), np.int64)
        which, block = (x.ravel() for x in np.broadcast_arrays(languages, np.flatnonzero(inner > 0)[None, :]))
        while len(which):
            state, at = left[which, block - 1], start[block]
            change[which, block] = 0
            go = np.arange(len(which))
            late = []
            for t in range(BLOCK):
                over = length[block[go]] <= t
                late.append((go[over], state[over]))
                go, state = go[~over], state[~over]
                if not len(go):
                    break
                where = at[go] + t
                state, begins = self._step(state, which[go], stream[where])
                own = began[which[go], where]
                change[which[go], block[go]] += begins.astype(np.int64) - own
                open_ = ~(begins & own)
                go, state = go[open_], state[open_]
            late.append((go, state))
            go, state = (np.concatenate(x) for x in zip(*late, strict=True))
            after = alone[which, block]
            after[go] = state  # these never met
            # Where a block ends in another state than was thought, the one after it is followed anew.
            new = after != left[which, block]
            left[which, block] = after
            more = new & (block + 1 < len(owner)) & (inner[np.minimum(block + 1, len(owner) - 1)] > 0)
            which, block = which[more], block[more] + 1
        out = np.zeros((len(self.roots), len(texts)))
        some = np.flatnonzero(sizes)
        if len(some):
            out[:, some] = np.add.reduceat(began, (np.cumsum(sizes) - sizes)[some], axis=1, dtype=np.int64)
            for i, row in enumerate(change):
                out[i] += np.bincount(owner, row, len(texts))
        return out, sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and normalised phrases per letter of each text."""
        has = [t if t and any(c.isalpha() for c in t) else "" for t in texts]
        names, scores, rates = [], [], []
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        found, sizes = self.phrases(has)
        rate = found * self.logs[:, None] / np.maximum(sizes, 1)
        best = rate.argmin(axis=0)
        for i, text in enumerate(has):
            if not text:
                names.append(UNKNOWN)
                scores.append(0.0)
                rates.append(0.0)
                continue
            ordered = np.sort(rate[:, i])
            names.append(self.languages[best[i]])
            scores.append(1.0 if len(ordered) == 1 else float(min(1.0, max(0.0, 1 - ordered[0] / ordered[1]))))
            rates.append(float(ordered[0]))
        return names, scores, rates


def sampled(df: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS, longest: int = LONGEST) -> dict[str, list[str]]:
    """`rows` whole texts of each language by a hash, of `longest` characters at most: all that reaches the driver.

    A language's count sets the share of its rows whose hash is looked at, so
    that a few times `rows` of them are sorted; where too few come back, a wider
    share is. A language of which all rows with a letter are longer gives the
    shortest one.
    """
    lettered = df.where(F.col(lang_col).isNotNull() & F.rlike(F.coalesce(text_col, F.lit("")), F.lit(r"\p{L}"))).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.length(text_col).alias("size"), F.xxhash64(F.col(id_col).cast("string"), text_col).alias("mix"))
    short = F.col("size") <= longest
    counts = {r["lang"]: r["short"] for r in lettered.groupBy("lang").agg(F.count_if(short).alias("short")).collect()}
    out: dict[str, list[str]] = {}
    wanted, wide = {k: n for k, n in counts.items() if n}, 4 * rows
    while wanted:
        share = F.create_map(*[F.lit(x) for k, n in wanted.items() for x in (k, math.ceil(min(1.0, wide / n) * (1 << 30)))])
        few = lettered.where(short & (F.pmod("mix", F.lit(1 << 30)) < F.try_element_at(share, F.col("lang"))))
        best = few.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("mix", "text"))).where(F.col("n") <= rows)
        drawn: dict[str, list[str]] = {}
        for r in best.orderBy("lang", "n").collect():
            drawn.setdefault(r["lang"], []).append(r["text"])
        out |= {k: v for k, v in drawn.items() if k in wanted}
        wanted = {k: n for k, n in wanted.items() if len(out.get(k, ())) < min(rows, n)}
        wide *= 8
    long = [k for k, n in counts.items() if not n]
    if long:
        for r in lettered.where(F.col("lang").isin(*long)).groupBy("lang").agg(F.min(F.struct("size", "mix", "text")).alias("r")).collect():
            out[r["lang"]] = [r["r"]["text"]]
    return out


def held_out(id_col: Column) -> Column:
    """Rows whose id is kept from the fit: crc32 of its text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(df: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS, longest: int = LONGEST) -> Model:
    """A model from labelled rows of df that are not held out. Without any, every text is `und`.

    The fit's bounds: `rows` texts a language, taken whole, each of `longest`
    characters at most, so that the model has a size that the driver can hold
    and broadcast. All other rows are only counted.
    """
    return Model.fit(sampled(df.where(~held_out(F.col(id_col))), lang_col, id_col, text_col, rows, longest))


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with lang_pred, lang_score (0 to 1) and lang_rate for each row.

    The prediction depends on the text alone. A null text, an empty one or one
    without a letter is `und` with score 0; ties go to the first language by
    name; repeated rows, nulls elsewhere and all columns stay.
    """
    held = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, 2_000_000):
                names, scores, rates = held.value.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())], [*part.schema.names, "lang_pred", "lang_score", "lang_rate"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", lang_pred string, lang_score double, lang_rate double"
    return by_few(df).mapInArrow(run, schema)
