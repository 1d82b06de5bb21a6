"""Best-fit packing of tokenised documents into sequences of fixed capacity.

The histogram of piece lengths (at most one count for each length up to the
capacity) is all that reaches the driver. There a configuration linear program
is solved by multiplicative weights: each length has a weight, a knapsack
dynamic program finds the best configurations for the weights, these are used in
small steps, and weights fall exponentially as lengths are covered. The steps'
sum, scaled until it covers every length, is a solution; the weights give a
lower bound. Phases go on from the last weights with finer steps until the two
are within TOLERANCE. The solution is rounded; a best-fit pass over the histogram
packs the pieces that leaves. Where plain best fit needs fewer sequences, its
packing is taken.
Spark then numbers the pieces of each length and deals the numbers out to the
configurations' places.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import BLOCK, Coder
from .common import by_few, slices, written

#: Weights start a little steeper than the lengths, for long pieces have fewer places to go.
POWER = 1.05
#: How far above its lower bound a solution may be, relatively; rounds at most for many lengths (a coarser solution is as exact in its pieces), of which each PRICED-th prices.
TOLERANCE, ROUNDS, PRICED = 0.02, 2000, 10
#: Of the first phase: steps in which a length is covered, the power of e by which its weight falls in one, and how far below the best a configuration may be.
STEPS, RATE, SLACK = 200, 0.05, 0.05
_kept: dict = {}


class _Marked:
    """A coder that takes a tokenizer file's added tokens out of the texts first, as its library does."""

    def __init__(self, code: Coder, added: dict[str, int]) -> None:
        self.code, self.added = code, added
        self.find = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        cut = {i: self.find.split(t) for i, t in enumerate(texts) if self.find and self.find.search(t)}
        parts = iter(self.code([p for i, t in enumerate(texts) for p in cut.get(i, [t])]))
        for i, t in enumerate(texts):
            ids = next(parts)
            if i in cut:
                for mark, more in zip(self.find.findall(t), islice(parts, len(cut[i]) - 1), strict=True):
                    ids = np.concatenate([ids, np.array([self.added[mark]], ids.dtype), more])
            yield ids


def checked(file: dict) -> dict[str, int]:
    """The added tokens of a tokenizer file's content; a file that words are not cut and mapped by as here is refused."""
    before = file.get("pre_tokenizer") or {}
    if file.get("normalizer") or file["model"]["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        raise ValueError("only byte-level BPE files without a normalizer, a space put in front or a pattern of their own are read here")
    added = file.get("added_tokens") or []
    if any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word")):
        raise ValueError("added tokens that take blanks or stand alone are not read here")
    return {t["content"]: t["id"] for t in added}


def _coder(content: bytes, added: dict[str, int]) -> _Marked:
    """Encodes new words by the library's own model."""
    key = zlib.crc32(content), len(content)
    if key not in _kept:
        from tokenizers import Tokenizer

        model = Tokenizer.from_str(content.decode()).model
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the bytes that the byte-level alphabet shows as they are
        table = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - {*plain}))}

        def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            ids = [[t.id for t in model.tokenize(w.encode().decode("latin-1").translate(table))] for w in words]
            return np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids], np.int64)

        _kept[key] = _Marked(Coder(encode), added)
    return _kept[key]


def pieces(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """The pieces of each document: (id, piece, start, length, ids_crc32), with `ids` if keep_ids.

    A document is its text's ids by the tokenizer file at `path`, then end_id,
    with the file's added tokens wherever their text stands, as its library has it;
    one longer than `capacity` is cut into pieces of that length, of which the
    first may be shorter. A null text counts as empty and is one piece of one
    id. Repeated rows and null ids give pieces like any other row.
    """
    with open(path, "rb") as f:
        content = f.read()
    added = checked(json.loads(content))
    content = df.sparkSession.sparkContext.broadcast(content)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _coder(content.value, added)
        for batch in batches:
            for part in slices(batch, 1, BLOCK):
                row, number, start, length, crc, ids = [], [], [], [], [], []
                for i, x in enumerate(code([t or "" for t in part.column(1).to_pylist()])):
                    x = np.append(x, np.int32(end_id)).astype("<u4")
                    for k, at in enumerate([0, *range((len(x) - 1) % capacity + 1, len(x), capacity)]):
                        end = (len(x) - 1) % capacity + 1 if k == 0 else at + capacity
                        row.append(i)
                        number.append(k)
                        start.append(at)
                        length.append(end - at)
                        crc.append(zlib.crc32(x[at:end].tobytes()))
                        if keep_ids:
                            ids.append(x[at:end].astype(np.int32))
                columns = [part.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * keep_ids, names + ["ids"] * keep_ids)

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return by_few(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def priced(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each room: the greatest weight of a configuration in it, and a length to take then (0: leave a place free)."""
    cap = len(weights)
    some = np.flatnonzero(weights) + 1
    own = weights[some - 1]
    fit = np.searchsorted(some, np.arange(cap + 1), "right").tolist()
    value, choice = np.zeros(cap + 1), np.zeros(cap + 1, np.int64)
    for room in range(1, cap + 1):
        value[room] = value[room - 1]
        if n := fit[room]:
            total = value[room - some[:n]] + own[:n]
            best = int(total.argmax())
            if total[best] > value[room]:
                value[room], choice[room] = total[best], some[best]
    return value, choice


def traced(choice: np.ndarray, room: np.ndarray) -> list[np.ndarray]:
    """The lengths taken one after the other in each of some rooms, 0 once there are none."""
    taken = np.maximum.accumulate(np.where(choice > 0, np.arange(len(choice)), 0))
    out, room = [], taken[room]
    while room.any():
        out.append(choice[room])
        room = taken[room - out[-1]]
    return out


def best_configuration(weights: np.ndarray) -> np.ndarray:
    """How often each length goes into the configuration of greatest weight; weights[l - 1] is that of length l."""
    cap = len(weights)
    lengths = np.concatenate([np.zeros(0, np.int64), *traced(priced(weights)[1], np.array([cap]))])
    return np.bincount(lengths, minlength=cap + 1)[1:]


def covering(demand: np.ndarray, steps: int = STEPS, gap: float = TOLERANCE) -> tuple[dict[tuple[int, ...], float], float]:
    """Configurations, as their lengths in falling order, with how often each is used, fractionally; and a lower bound of the uses.

    The uses cover every length, some more than once over. Pricing adds for each
    length the best configuration that holds it, where that is within the
    phase's slack of the best of all. A round uses every known configuration
    that is, as often as covers one step of some length's pieces and no more of
    any. A length's weight is multiplied by exp(-rate) for each step that it is
    ahead. A phase ends when all lengths are covered once; the next one starts
    from its weights, with finer steps. The best solution of all rounds is
    returned once it is within gap of the bound, or after ROUNDS rounds (more for few lengths).
    """
    cap = len(demand)
    lengths = np.flatnonzero(demand) + 1
    if not len(lengths):
        return {}, 0.0
    need = np.maximum(np.append(0, demand), 1).astype(float)
    price, weight = np.zeros(cap + 1), np.zeros(cap + 1)
    price[lengths] = (lengths / cap) ** POWER
    lower, best, out = float(demand @ np.arange(1, cap + 1)) / cap, np.inf, np.zeros(0)
    rate, slack = RATE, SLACK
    covered, uses = np.zeros(cap + 1), np.zeros(0)
    known: dict[tuple[int, ...], int] = {}
    pieces_, begins = np.zeros(0, np.int64), np.zeros(1, np.int64)  # of all configurations known, one after the other
    for turn in range(ROUNDS * max(1, 200 // len(lengths))):
        weight[lengths] = price[lengths] * np.exp(-rate * steps * (covered[lengths] - covered[lengths].min()))
        if turn % PRICED == 0:
            value, choice = priced(weight[1:])
            lower = max(lower, float(demand @ weight[1:]) / value[cap])
            near = lengths[weight[lengths] + value[cap - lengths] >= (1 - slack) * value[cap]]
            configs = -np.sort(-np.array([near, *traced(choice, cap - near)]), axis=0)
            for config, n in zip(configs.T.tolist(), (configs > 0).sum(axis=0).tolist(), strict=True):
                known.setdefault(tuple(config[:n]), len(known))
            fresh = list(islice(known, len(uses), None))
            pieces_ = np.concatenate([pieces_, *[np.array(c) for c in fresh]])
            begins = np.append(begins, begins[-1] + np.cumsum([len(c) for c in fresh], dtype=np.int64))
            uses = np.append(uses, np.zeros(len(fresh)))
            # Until the next pricing only those come up whose worth is not far from the best.
            active = np.flatnonzero(np.add.reduceat(weight[pieces_], begins[:-1]) >= (1 - 1.5 * slack) * value[cap])
            sizes = np.diff(begins)[active]
            starts = np.cumsum(sizes) - sizes
            flat = pieces_[np.repeat(begins[active] - starts, sizes) + np.arange(sizes.sum())]
            own = np.repeat(np.arange(len(active)), sizes)
            most = np.minimum.reduceat(need[flat], starts)
        worth = np.add.reduceat(weight[flat], starts)
        often = np.where(worth >= (1 - slack) * worth.max(), most, 0.0)
        filled = np.bincount(flat, often[own], cap + 1) / need
        often /= np.maximum(steps * np.maximum.reduceat(filled[flat], starts), 1e-300)
        covered += np.bincount(flat, often[own], cap + 1) / need
        uses[active] += often
        least = float(covered[lengths].min())
        if least > 0 and uses.sum() < best * least:
            best, out = uses.sum() / least, uses / least
            if best <= (1 + gap) * lower:
                break
        if least >= 1:
            price[lengths] = np.maximum(weight[lengths] / weight[lengths].max(), 1e-12)
            steps, rate, slack = 2 * steps, rate / 1.5, slack / 4
            covered, uses = np.zeros(cap + 1), np.zeros(len(known))
    return {c: x for c, x in zip(known, out.tolist(), strict=False) if x > 0}, lower


def relaxed(demand: np.ndarray, steps: int = STEPS) -> dict[tuple[int, ...], float]:
    """The uses of covering(), most used first, without what they hold more than once over: a fractional packing of exactly the demand."""
    left, out = [0.0, *demand.tolist()], {}
    for config, times in sorted(covering(demand, steps)[0].items(), key=lambda x: (-x[1], x[0])):
        while times > 1e-9 and (config := tuple([length for length in config if left[length] > 1e-9])):
            used = Counter(config)
            n = min(times, *[left[length] / k for length, k in used.items()])
            out[config] = out.get(config, 0.0) + n
            for length, k in used.items():
                left[length] -= n * k
            times -= n
    return out


def rounded(found: list[tuple[tuple[int, ...], float]], demand: np.ndarray, least: float) -> tuple[list[tuple[int, dict[int, int]]], np.ndarray]:
    """found, greatest first, rounded down, then once more those of a fraction of at least `least` whose pieces are left; and the pieces left."""
    left, out = [0, *demand.tolist()], []
    for up in (False, True):
        for config, times in found:
            n = int(times + 1e-6)
            if up:
                n = int(times - n >= least)
            elif not n:
                break
            if n and all(left[length] for length in config):
                used = Counter(config)
                if n := min(n, *(left[length] // k for length, k in used.items())):
                    for length, k in used.items():
                        left[length] -= n * k
                    out.append((n, dict(used)))
    return out, np.array(left[1:], np.int64)


def best_fit(left: np.ndarray) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: pieces}) for the pieces that are left: the longest first, each sequence filled with the longest that fit."""
    left, out = left.copy(), []
    while left.any():
        room, used = len(left), {}
        while room > 0 and len(fits := np.flatnonzero(left[:room])):
            length = int(fits[-1]) + 1
            n = int(min(left[length - 1] - used.get(length, 0), room // length))
            if not n:  # all its pieces are in this sequence
                fits = fits[fits + 1 < length]
                fits = fits[[left[i] > used.get(int(i) + 1, 0) for i in fits]] if len(fits) else fits
                if not len(fits):
                    break
                length = int(fits[-1]) + 1
                n = int(min(left[length - 1], room // length))
            used[length] = used.get(length, 0) + n
            room -= n * length
        times = min(int(left[length - 1]) // n for length, n in used.items())
        for length, n in used.items():
            left[length - 1] -= times * n
        out.append((times, used))
    return out


def solved(histogram: dict[int, int], capacity: int, steps: int = STEPS) -> tuple[list[tuple[int, dict[int, int]]], list[tuple[int, dict[int, int]]]]:
    """(times, {length: pieces}) from the program, and from best fit for what its rounding leaves.

    Of three ways to round, up from any fraction, from a half and never, the
    one of fewest sequences is taken, the first of equal ones.
    """
    demand = np.zeros(capacity, np.int64)
    for length, n in histogram.items():
        demand[length - 1] = n
    found = sorted(covering(demand, steps)[0].items(), key=lambda x: (-x[1], x[0]))
    tried = [(out, best_fit(left)) for out, left in (rounded(found, demand, least) for least in (0.0, 0.5, 1.0))]
    return min(tried, key=sequences)


def sequences(parts: tuple[list[tuple[int, dict[int, int]]], ...]) -> int:
    return sum(times for part in parts for times, _ in part)


def configurations(histogram: dict[int, int], capacity: int, steps: int = STEPS) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: pieces}) whose pieces are exactly the histogram's: by the program, or by best fit alone where that takes fewer sequences."""
    demand = np.zeros(capacity, np.int64)
    for length, n in histogram.items():
        demand[length - 1] = n
    program, rest = min(solved(histogram, capacity, steps), ([], best_fit(demand)), key=sequences)
    return program + rest


def places(found: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """Runs of piece numbers by length: where a run starts, its sequences, offset and pieces in each.

    Runs follow from the configurations alone, whose number the solver bounds, not from the documents.
    """
    rows, begun, sequence = [], {}, 0
    for times, config in found:
        offset = 0
        for length, n in config.items():
            at = begun.get(length, 0)
            rows.append((length, at, sequence, offset, n))
            begun[length] = at + times * n
            offset += length * n
        sequence += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return {"key": columns[0] << 44 | columns[1], "start": columns[1], "sequence": columns[2], "offset": columns[3], "n": columns[4]}


def pack(cut: DataFrame, capacity: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """cut, a table from pieces(), with sequence_id and offset, in as few sequences as it can.

    cut is read several times, so write it first. Offsets in a sequence are
    gapless from 0. Ties between pieces of one length are broken by id and
    piece number; an empty table gives an empty one.
    """
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    runs = spark.sparkContext.broadcast(places(configurations(counts, capacity)))
    # A length may hold most pieces: number them in buckets, then add what the buckets before hold.
    buckets = max(64, total // 500_000)
    dealt = cut.withColumn("_bucket", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("length", "_bucket", before.alias("_before"))
    local = F.row_number().over(W.partitionBy("length", "_bucket").orderBy(id_col, "piece")) - 1
    numbered = dealt.withColumn("_local", local).join(sizes, ["length", "_bucket"]).withColumn("_number", F.col("_before") + F.col("_local"))
    keep = cut.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = runs.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("_number").to_numpy()
            at = np.searchsorted(run["key"], length << 44 | number, "right") - 1
            rank = number - run["start"][at]
            sequence = run["sequence"][at] + rank // run["n"][at]
            offset = run["offset"][at] + rank % run["n"][at] * length
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return by_few(numbered.select(*keep, "_number")).mapInArrow(run, schema)


def pack_documents(df: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all rows of df, written once, with their places."""
    return pack(written(pieces(df, path, capacity, 0, id_col, text_col), "pieces"), capacity, id_col)
