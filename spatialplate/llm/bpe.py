"""Byte-level BPE by corpus-level merge replay.

Texts are split by the usual byte-level pattern, vectorised over code points.
A task numbers the distinct words it meets by a 64-bit hash and encodes each
only once, all new words of a block together: an inverted index leads from a
token pair's rank to its positions in those words, the ranks are applied in
order, and each merge updates only the pairs that touch it. Texts are then put
together from their words' ids.

Words are independent of each other, so each block of a partition is a corpus
of its own: no shuffle, and memory is bounded by the block and by WORDS.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_few, slices

#: Bytes of text handled at once, and distinct words that a worker remembers.
BLOCK, WORDS = 2_000_000, 400_000
NONE = np.int64(1 << 40)
OTHER, LETTER, NUMBER, SPACE = range(4)
_kept: dict = {}


def char_classes() -> np.ndarray:
    """For each code point whether the pattern sees a letter, a number, white space or none of these."""
    if "classes" not in _kept:
        import regex

        points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
        every = points.astype("<u4").tobytes().decode("utf-32-le")
        table = np.zeros(0x110000, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                table[points[m.start() : m.end()]] = kind
        _kept["classes"] = table
    return _kept["classes"]


def word_starts(points: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Where words start in concatenated texts; docs: where non-empty texts start."""
    n = len(points)
    kind = char_classes()[points]
    first = np.zeros(n + 1, bool)
    first[docs] = True
    first[n] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(start)
    ends = np.append(runs[1:], n)
    of = kind[runs]
    # A run of white space before a word gives its last character up: to the word if it is a blank, else to itself.
    last = ends[(of == SPACE) & ~first[ends]] - 1
    start[last] = True
    start[last[points[last] == 32] + 1] = False
    # 's 't 're 've 'm 'll 'd, where the apostrophe begins a word and stands alone.
    at = runs[(of == OTHER) & (ends - runs == 1) & (points[runs] == 39)]
    at = at[start[at] & ~first[at + 1]]
    if len(at):
        one = points[at + 1]
        two = np.where(first[np.minimum(at + 2, n)], 0, points[np.minimum(at + 2, n - 1)])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        short = np.isin(one, [ord(c) for c in "stmd"])
        hit = at[short | long]
        end = hit + np.where(short[short | long], 2, 3)
        start[hit + 1] = False
        start[end[end < n]] = True
    return np.flatnonzero(start)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each word's characters times odd factors by place, summed and mixed with its length."""
    lengths = np.diff(starts, append=len(points))
    factors = _kept.get("factors")
    if factors is None or len(factors) < lengths.max(initial=0):
        factors = _kept["factors"] = _mixed(np.arange(1, max(4096, 2 * int(lengths.max(initial=0))), dtype=np.uint64)) | np.uint64(1)
    place = np.arange(len(points)) - np.repeat(starts, lengths)
    return _mixed(np.add.reduceat(factors[place] * points, starts) + lengths.astype(np.uint64))


class Replay:
    """Ranks of a .tiktoken file, and the replay of its merges over many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.whole = {t: r for t, r in ranks.items() if len(t) > 1}

    @classmethod
    def of(cls, content: bytes) -> Replay:
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)})

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def one(self, word: bytes) -> list[int]:
        """A single word, for the rare case that a merge makes a pair of lower rank than its own."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], NONE))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one row, and how many each has."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(w) for w in raw], np.int64)
        token = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        n = len(token)
        ends = np.cumsum(sizes)
        after = np.arange(1, n + 1)
        after[ends - 1] = -1
        before = np.arange(-1, n - 1)
        before[ends - sizes] = -1
        pair = np.full(n, NONE)
        left = np.flatnonzero(after >= 0)
        pair[left] = self.rank(token[left], token[after[left]])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            ranks = pair[at]
            at, ranks = at[ranks < NONE], ranks[ranks < NONE]
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, part in zip(ranks[np.append(0, cuts)].tolist() if len(at) else (), np.split(at, cuts), strict=False):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        add(left)
        odd: list[np.ndarray] = []
        while heap:
            r = heapq.heappop(heap)
            parts = index.pop(r)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[pair[at] == r]
            if not len(at):
                continue
            if len(at) > 1 and (chained := after[at[:-1]] == at[1:]).any():  # aaa: each other pair of a chain, from its left
                keep, run = np.ones(len(at), bool), 0
                for i in np.flatnonzero(chained).tolist():
                    run = run + 1 if i and chained[i - 1] else 1
                    keep[i + 1] = run % 2 == 0
                at = at[keep]
            gone = after[at]
            token[at], token[gone] = r, -1
            pair[gone] = NONE
            beyond = after[gone]
            after[at] = beyond
            some = beyond >= 0
            before[beyond[some]] = at[some]
            pair[at[~some]] = NONE
            prior = before[at]
            touched = np.concatenate([at[some], prior[prior >= 0]])
            if len(touched):
                touched = np.unique(touched)
                pair[touched] = new = self.rank(token[touched], token[after[touched]])
                if len(low := touched[new < r]):
                    odd.append(low)
                add(touched)
        alive = token >= 0
        counts = np.add.reduceat(alive, ends - sizes, dtype=np.int64) if n else np.zeros(0, np.int64)
        ids = token[alive].astype(np.int32)
        if odd:
            again = np.unique(np.searchsorted(ends, np.concatenate(odd), "right"))
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i in again.tolist():
                parts[i] = np.array(self.one(raw[i]), np.int32)
            counts = np.array([len(p) for p in parts], np.int64)
            ids = np.concatenate(parts)
        return ids, counts


class Coder:
    """Encodes texts by their distinct words; encode gives the ids of new words and how many each has."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self.forget()

    def forget(self) -> None:
        self.hash, self.at, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        if len(self.hash) > WORDS:
            self.forget()
        points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths)
        if not len(points):
            yield from (np.zeros(0, np.int32) for _ in texts)
            return
        starts = word_starts(points, (ends - lengths)[lengths > 0])
        hashes = word_hashes(points, starts)
        which, words = pd.factorize(hashes)
        where = np.empty(len(words), np.int64)
        where[which[::-1]] = np.arange(len(hashes))[::-1]
        known = np.searchsorted(self.hash, words)
        new = np.flatnonzero(self.hash[np.minimum(known, len(self.hash) - 1)] != words) if len(self.hash) else np.arange(len(words))
        if len(new):
            begin = starts[where[new]]
            end = np.append(starts, len(points))[where[new] + 1]
            flat = points.tobytes()
            ids, count = self.encode([flat[4 * a : 4 * b].decode("utf-32-le") for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
            at = len(self.ids) + np.cumsum(count) - count
            self.ids = np.concatenate([self.ids, ids])
            order = np.argsort(merged := np.concatenate([self.hash, words[new]]), kind="stable")
            self.hash, self.at, self.count = merged[order], np.concatenate([self.at, at])[order], np.concatenate([self.count, count])[order]
            known = np.searchsorted(self.hash, words)
        at, count = self.at[known], self.count[known]
        bounds = np.searchsorted(starts, np.append(0, ends)).tolist()
        for a, b in zip(bounds, bounds[1:], strict=False):
            w = which[a:b]
            c = count[w]
            total = np.cumsum(c)
            yield self.ids[np.repeat(at[w] - total + c, c) + np.arange(total[-1])] if len(w) else np.zeros(0, np.int32)


def coder(content: bytes) -> Coder:
    """The replaying coder of a .tiktoken file's content, one for each worker."""
    key = hashlib.sha256(content).digest()
    if key not in _kept:
        _kept[key] = Coder(Replay.of(content))
    return _kept[key]


def _tokens(content: bytes) -> tuple[list[bytes], list[str]]:
    key = "tokens" + hashlib.sha256(content).hexdigest()
    if key not in _kept:
        known = {int(b): base64.b64decode(a) for a, b in (line.split() for line in content.splitlines() if line)}
        _kept[key] = [known.get(i, b"") for i in range(max(known) + 1)], [str(i) for i in range(max(known) + 1)]
    return _kept[key]


def _vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for each row of df, ids by the ranks in the .tiktoken file at `path`.

    A null text counts as empty and gives an empty array; each repeated row
    gives its row; null ids stay. An empty table gives an empty one. Other
    columns are not carried.
    """
    ranks = _vocabulary(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, BLOCK):
                ids = list(coder(ranks.value)([t or "" for t in part.column(1).to_pylist()]))
                at = np.append(0, np.cumsum([len(x) for x in ids]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(ids)))], ["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return by_few(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary) for each row: the bytes of its ids; a null array gives no bytes, an unknown id fails the job."""
    ranks = _vocabulary(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(ranks.value)[0]
        for batch in batches:
            out = [b"".join(map(tokens.__getitem__, ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return by_few(df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))).mapInArrow(run, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for each row, encoded as encode() and decoded again in the same task."""
    ranks = _vocabulary(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, decimals = _tokens(ranks.value)
        code = coder(ranks.value)
        for batch in batches:
            for part in slices(batch, 1, BLOCK):
                counts, coded, decoded = [], [], []
                for ids in code([t or "" for t in part.column(1).to_pylist()]):
                    ids = ids.tolist()
                    counts.append(len(ids))
                    coded.append(hashlib.sha256(" ".join(map(decimals.__getitem__, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(b"".join(map(tokens.__getitem__, ids))).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return (
        by_few(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
        .mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
        .withColumnRenamed("id", id_col)
    )
