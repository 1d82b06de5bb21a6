"""Exact Jaccard join of documents on word shingles: a size-aware heavy-light join.

Equal sets are one class first, and only its smallest document goes on. Tokens
(64-bit shingle hashes) have one global order, rare ones first, so that linked
sets share tokens early in it. Small (light) sets are looked up by all subsets
of two tokens of their prefix, large (heavy) ones by scanning the inverted lists
of single tokens, with the boundary where the two cost least together.

The answer is components, so a long list's members need not all be compared: in
each round they are held against one of them, and later only members of
different components still count. When few such pairs are left, all are tried.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import _mixed
from .common import by_few, removed, slices, written

#: Tokens in the order's table (12 bytes each, broadcast), the count that makes a token frequent, and sizes that may be light.
ORDER, FREQUENT, LIGHT = 500_000, 8, 64
#: Words that a worker remembers; parts that a class's members are dealt to; members of a short list.
WORDS, SALTS, SHORT = 150_000, 16, 24
#: Bits of the filter that spares most texts a second reading: 4 MB.
BITS = 1 << 25
#: For longer lists, rounds of one member against all at most, and pairs left over for each entry at which all are tried.
ROUNDS, PAIRS = 8, 3


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes. Fewer words than `width` are one shingle; no word, no shingle."""
    words = [t.encode().lower().split() if t else [] for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(words)), np.uint64, int(sizes.sum()))
    out, rolled, seed = [], None, np.uint64(0x9E3779B97F4A7C15)
    n = len(flat) - width + 1
    if n > 0:
        rolled = np.full(n, width, np.uint64)
        for k in range(width):
            rolled = _mixed(rolled * seed + flat[k : n + k])
    at = 0
    for size in sizes.tolist():
        if size >= width:
            out.append(np.unique(rolled[at : at + size - width + 1]))
        elif size:
            h = np.full(1, size, np.uint64)
            for k in range(size):
                h = _mixed(h * seed + flat[at + k : at + k + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def prefix_size(n: int, percent: int, k: int) -> int:
    """How many first tokens hold k common ones of any set that is similar enough."""
    return min(n, n - math.ceil(n * percent / 100) + k)


def frequent(docs: DataFrame, width: int) -> DataFrame:
    """(token, n): tokens that come up several times, counted over all documents, within parts of batches and then together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 8_000_000):
                found = [s for few in slices(part, 1, 2_000_000) for s in shingle_sets(few.column(1).to_pylist(), width)]
                tokens, n = np.unique(np.concatenate(found), return_counts=True)
                tokens, n = tokens[n > 1], n[n > 1]
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n)], ["token", "n"])

    return by_few(docs).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)


def order_table(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER most frequent tokens, sorted, with their counts. The order only serves speed: any is right."""
    counts = written(frequent(docs, width), "frequent")
    levels = counts.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("level")).count().orderBy(F.desc("level")).collect()  # a few hundred rows
    held, least = 0, 1 << 30
    for r in levels:
        held += r["count"]
        if held > ORDER:
            break
        least = r["level"]
    table = counts.where(F.floor(F.log2("n") * 8) >= least).toArrow()
    tokens, n = table.column("token").to_numpy().view(np.uint64), table.column("n").to_numpy()
    by = np.argsort(tokens)
    return tokens[by], np.minimum(n[by], 1 << 30).astype(np.int32)


def described(docs: DataFrame, order: Broadcast, width: int, percent: int) -> DataFrame:
    """(id, n, signature, prefix, scan) of each row: set size, hash of the set, first tokens for k = 2, list entries that a scan meets; order from order_table()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = order.value
        for batch in batches:
            for part in slices(batch, 1, 2_000_000):
                sets = shingle_sets(part.column(1).to_pylist(), width)
                prefixes, scans = [], []
                for s in sets:
                    n = len(s)
                    p = prefix_size(n, percent, 2)
                    if len(known) and n:
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        weight = np.where(known[at] == s, counts[at], 1)
                        if weight.max() > 1:
                            by = np.lexsort((s, weight))[:p]
                            prefixes.append(s[by])
                            scans.append(float(weight[by][: prefix_size(n, percent, 1)].sum()))
                            continue
                    prefixes.append(s[:p])
                    scans.append(float(prefix_size(n, percent, 1)))
                ends = np.append(0, np.cumsum([len(p) for p in prefixes]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefixes).view(np.int64))), pa.array(scans, pa.float64())],
                    ["id", "n", "signature", "prefix", "scan"],
                )

    return by_few(docs).mapInArrow(run, "id long, n long, signature binary, prefix array<long>, scan double")


def boundary(sets: DataFrame, percent: int) -> int:
    """The largest light size that costs least: subsets of all light sets, plus list entries that heavy sets and their smaller partners meet."""
    rows = {r["n"]: (r["sets"], r["scan"]) for r in sets.where(F.col("n").between(1, LIGHT)).groupBy("n").agg(F.count("*").alias("sets"), F.sum("scan").alias("scan")).collect()}
    best, cost = 0, math.inf
    for x in range(LIGHT + 1):
        subsets = sum(c * math.comb(max(2, prefix_size(n, percent, 2)), 2) for n, (c, _) in rows.items() if n <= x)
        scans = sum(s for n, (_, s) in rows.items() if n * 100 >= percent * (x + 1))
        if subsets + scans <= cost:
            best, cost = x, subsets + scans
    return best


def entries(reps: DataFrame, light: int, percent: int) -> DataFrame:
    """(key, pos, node, n): subsets of two for light sets, single tokens with their place for heavy ones and for light ones that may link with them."""
    first = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    kind = "array<struct<key:long,pos:int>>"
    placed = F.transform(F.slice("prefix", 1, first), lambda t, i: F.struct(t.alias("key"), (i + 1).alias("pos")))
    single = F.when(F.col("n") * 100 >= percent * (light + 1), placed).otherwise(F.array().cast(kind))
    two = F.flatten(F.transform("prefix", lambda a, i: F.transform(F.slice("prefix", i + 2, F.size("prefix")), lambda b: F.xxhash64(a, b))))
    pairs = F.when(F.col("n") <= light, F.transform(two, lambda t: F.struct(t.alias("key"), F.lit(1).alias("pos")))).otherwise(F.array().cast(kind))
    return reps.select("node", "n", F.inline(F.concat(single, pairs)))


def _alike(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return (n * 100 >= m * percent) & (m * 100 >= n * percent)


def _needed(n: Column, m: Column, percent: int) -> Column:
    """Tokens that the prefixes of similar enough sets have in common: of the one that ends first, all but what the other may lack."""
    most = lambda x: F.ceil(x * percent / 100)
    return F.ceil((n + m) * percent / (100 + percent)) + 1 - F.greatest(most(n), most(m))


def _joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by sorted partitions at every size: what grows with the documents is never broadcast."""
    return left.hint("merge").join(right, on, how)


def _spread(df: DataFrame, by: str) -> DataFrame:
    """Rows dealt to SALTS parts, for keys that may hold a third of them."""
    return df.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def _copied(df: DataFrame) -> DataFrame:
    """A copy of each row for each of the parts."""
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def verified(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b, ...) whose sets are similar enough; tokens(node, tokens)."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    near = _likely(tokens, wanted, "node")
    left = near.select(F.col("node").alias("a"), F.col("tokens").alias("_a"))
    right = near.select(F.col("node").alias("b"), F.col("tokens").alias("_b"))
    both = _joined(_joined(pairs, right, "b"), left, "a")
    common = F.size(F.array_intersect("_a", "_b"))
    return both.where(common * 100 >= (F.size("_a") + F.size("_b") - common) * percent).select(*pairs.columns)


def _looked_up(rows: DataFrame, places: DataFrame, key: str, labels: DataFrame, how: str = "inner") -> DataFrame:
    """rows(key, _salt, ...) with `_to`, the label of key; places(key, _salt) are the parts that hold the key, each of which gets one copy."""
    found = _joined(places, labels.select(F.col("node").alias(key), F.col("component").alias("_to")), key)
    return _joined(rows, found, [key, "_salt"], how)


def _mapped(rows: DataFrame, key: str, by: str, labels: DataFrame) -> DataFrame:
    """rows with key's label in its place, where it has one."""
    spread = _spread(rows, by)
    return _looked_up(spread, spread.select(key, "_salt").distinct(), key, labels, "left").withColumn(key, F.coalesce("_to", key)).select(*rows.columns)


def components(links: DataFrame) -> DataFrame:
    """(node, component): each linked node with the smallest node it reaches; least labels spread, and labels of labels are taken.

    A node may have as many links as there are rows: its links are dealt to
    parts, and each part that holds some gets the node's label.
    """
    edges = written(_spread(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "a"), "edges")
    places = written(edges.select("b", "_salt").distinct(), "places")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = _looked_up(edges, places, "b", labels).groupBy(F.col("a").alias("node")).agg(F.min("_to").alias("_near"))
        new = _joined(labels, near, "node").select("node", F.least("component", "_near").alias("component"), F.col("component").alias("_old"))
        # Most nodes of a large component have one label: it is looked up once for each part.
        new = written(_mapped(new, "component", "node", labels), "labels")
        removed(labels)
        if new.where(F.col("component") != F.col("_old")).isEmpty():
            removed(edges, places)
            return new.select("node", "component")
        labels, folder = new.select("node", "component"), new._folder
        labels._folder = folder


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels(node, component) after links(a, b) between components more: only these are gone through, not the links that made the components."""
    new = components(links)
    if labels is None:
        return new
    both = labels.unionByName(new.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
    return written(_mapped(both, "component", "node", new), "labels")


def _likely(rows: DataFrame, wanted: DataFrame, id_col: str = "id") -> DataFrame:
    """rows whose id may be among wanted's: all that are, and few others while BITS are many against the ids.

    A bitmap of BITS bits at most is broadcast, so texts need not be shuffled.
    """
    place = lambda: F.pmod(F.xxhash64(id_col), F.lit(BITS)) + 1
    bits = wanted.select(place().alias("p")).groupBy(F.bitmap_bucket_number("p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_bits"))
    bit = F.bitmap_bit_position(place())
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    return rows.withColumn("_bucket", F.bitmap_bucket_number(place())).join(F.broadcast(bits), "_bucket").where(byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0).select(*rows.columns)


def _token_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, tokens): the sets of the wanted documents, and of a few others, from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 2_000_000):
                sets = shingle_sets(part.column(1).to_pylist(), width)
                ends = np.append(0, np.cumsum([len(s) for s in sets]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))], ["node", "tokens"])

    return by_few(_likely(docs, wanted)).mapInArrow(run, "node long, tokens array<long>")


def short_list_pairs(short: DataFrame, long: DataFrame, light: int, percent: int) -> DataFrame:
    """Pairs (a, b) that share enough entries of short lists.

    What two nodes may share in long lists counts as shared. Light sets share
    subsets, of which one is enough.
    """
    more = long.groupBy("node").agg(F.count("*").alias("more"))
    held = _joined(short, more, "node", "left").na.fill(0, ["more"])
    x, y = (held.select("key", *[F.col(c).alias(f"{c}_{z}") for c in ("node", "n", "more")]) for z in "ab")
    met = _joined(x, y, "key").where((F.col("node_a") < F.col("node_b")) & _alike(F.col("n_a"), F.col("n_b"), percent))
    counts = met.groupBy("node_a", "node_b").agg(F.count("*").alias("common"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.first(F.least("more_a", "more_b")).alias("more"))
    enough = (F.greatest("n_a", "n_b") <= light) | (F.col("common") + F.col("more") >= _needed(F.col("n_a"), F.col("n_b"), percent))
    return counts.where(enough).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def linked(docs: DataFrame, reps: DataFrame, light: int, width: int, percent: int) -> DataFrame | None:
    """(node, component) of the representatives that links join to others; None if there are no links.

    reps(node, n, prefix); docs(id, text) hold the representatives' texts.
    Lists of up to SHORT members give all their pairs. In a longer list, what
    stands before the first common token counts against a pair on both sides, so
    that one of the two has it in its first part (`low`). In each round the
    members are held against one low member; when the pairs with a low member
    that are in different components still are few, all are tried. Where rounds
    leave many, lists are split. A long list's members are dealt to parts.
    """
    dealt = entries(reps, light, percent)
    keys = dealt.groupBy("key").agg(F.count("*").alias("_m")).where(F.col("_m") > 1)
    shared = written(_joined(dealt, keys, "key"), "shared")
    short, long = (shared.where(c).select("key", "pos", "node", "n") for c in (F.col("_m") <= SHORT, F.col("_m") > SHORT))
    pairs = written(short_list_pairs(short, long, light, percent), "pairs")
    held = shared.groupBy("node").agg(F.count("*").alias("held"))  # how many of its tokens any other set has
    low = (F.col("pos") - 1) * (100 + percent) <= F.col("n") * (100 - percent)
    long = _joined(long, held, "node").withColumn("low", low)
    tokens = written(_token_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(long.select(F.col("node").alias("id"))), width), "tokens")
    links = written(verified(pairs, tokens, percent), "links")
    labels = None if links.isEmpty() else components(links)
    total, before = long.count(), math.inf

    def may_link(x: str, y: str) -> Column:
        n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
        common = F.ceil((n + m) * percent / (100 + percent))
        held = (F.greatest(n, m) <= light) | (F.least(f"{x}.held", f"{y}.held") >= _needed(n, m, percent))
        return held & (F.col(f"{x}.component") != F.col(f"{y}.component")) & _alike(n, m, percent) & (n - F.col(f"{x}.pos") + 1 >= common) & (m - F.col(f"{y}.pos") + 1 >= common)

    for turn in range(ROUNDS + 1 if total else 0):
        now = long.withColumn("component", F.col("node")) if labels is None else _joined(long, labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        now = written(now, "open")
        one = now.groupBy("key", "component").agg(F.count_if("low").cast("double").alias("l"), F.count("*").cast("double").alias("m"))
        tried = lambda l, m: l * m - l * l / 2  # noqa: E731, E741
        open_keys = written(one.groupBy("key").agg((tried(F.sum("l"), F.sum("m")) - F.sum(tried(F.col("l"), F.col("m")))).alias("_left")).where(F.col("_left") > 0), "keys")
        left = open_keys.agg(F.sum("_left")).first()[0] or 0.0
        if not left:
            break
        last = turn == ROUNDS or left <= PAIRS * total or left > before / 4
        before = left
        now_open = _spread(now, "node")
        if last:
            low_ones = _joined(now_open.where("low"), _copied(open_keys.select("key")), ["key", "_salt"]).drop("_salt")
            met = _copied(low_ones).alias("x").hint("merge").join(now_open.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x._salt") == F.col("y._salt"))).where((~F.col("y.low") | (F.col("x.node") < F.col("y.node"))) & may_link("x", "y"))
            ends = [f(f"x.{c}", f"y.{c}").alias(name) for c, names in (("node", "ab"), ("component", ("of_a", "of_b"))) for f, name in zip((F.least, F.greatest), names, strict=True)]
            pairs = met.select(*ends).distinct()
        else:
            # First the member with the least before the token, for it is nearest to what the list has in common; then any.
            rank = F.when(F.lit(turn == 0), F.col("pos")).otherwise(0).alias("rank")
            middle = now.where("low").groupBy("key").agg(F.min(F.struct(rank, F.xxhash64("node", F.lit(turn)).alias("mix"), "node", "n", "pos", "component", "held")).alias("c"))
            middle = _copied(_joined(middle, open_keys.select("key"), "key"))
            pairs = _joined(now_open.alias("x"), middle, ["key", "_salt"]).where(may_link("x", "c")).select(F.col("c.node").alias("a"), F.col("x.node").alias("b"), F.col("c.component").alias("of_a"), F.col("x.component").alias("of_b")).distinct()
        pairs = written(pairs, "pairs")
        found = written(verified(pairs, tokens, percent), "links")
        removed(now, open_keys, pairs)
        if not found.isEmpty():
            labels = merged(labels, found.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
        if last:
            break
    removed(shared, tokens)
    return labels


def cluster(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for each row of df with a whole-number id.

    Two rows link when 100 * common >= percent * union of their sets of shingles
    of `width` words; component_id is the smallest id that links reach. A null
    or empty text, or one of blanks only, has an empty set and links with
    nothing. Rows of equal sets are linked. Rows that repeat an id are one
    document. A row without an id gets its set's component (null if no other
    row has that set). Each row gives one row; an empty table gives an empty
    one. Other columns are not carried.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    order = docs.sparkSession.sparkContext.broadcast(order_table(docs, width))
    sets = written(described(docs, order, width, percent), "sets")
    order.destroy()
    own = sets.where((F.col("n") > 0) & F.col("id").isNotNull())
    best = own.groupBy("signature").agg(F.min(F.struct("id", "n", "prefix")).alias("r"))
    reps = best.select(F.col("r.id").alias("node"), F.col("r.n").alias("n"), F.col("r.prefix").alias("prefix"))
    labels = linked(docs, reps, boundary(sets, percent), width, percent)
    classes = own.groupBy("signature").agg(F.min("id").alias("node"), F.count("*").alias("members"))
    repeated = written(sets.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("signature").alias("a"), F.max("signature").alias("b")).where(F.col("a") != F.col("b")).select("id"), "repeated")
    again = not repeated.isEmpty()
    if again:  # the sets of one document link the classes that they are in
        both = written(_joined(_joined(own.select("id", "signature"), repeated, "id"), classes.select("signature", "node"), "signature").select("id", "node"), "both")
        same = _joined(both, both.groupBy("id").agg(F.min("node").alias("a")), "id").where(F.col("a") != F.col("node")).select("a", F.col("node").alias("b")).distinct()
        if labels is not None:
            same = _mapped(_mapped(same, "b", "a", labels).distinct(), "a", "b", labels).where(F.col("a") != F.col("b"))
        if not same.isEmpty():
            labels = merged(labels, same)
    if labels is None:
        named = classes.where(F.col("members") > 1).select("signature", F.col("node").alias("component"))
    else:
        named = _joined(classes, labels, "node", "left").where((F.col("members") > 1) | F.col("component").isNotNull()).select("signature", F.coalesce("component", "node").alias("component"))
    # A class may hold a third of all rows: its members are dealt out to as many copies of its one row.
    out = _joined(_spread(sets.select("id", "n", "signature"), "id"), _copied(named), ["signature", "_salt"], "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    if again:  # also a row without words belongs to its document
        least = _joined(out, repeated, "id").groupBy("id").agg(F.min("component").alias("_least"))
        out = _joined(_spread(out, "n"), _copied(least), ["id", "_salt"], "left").select("id", "n", F.coalesce("_least", "component").alias("component"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
