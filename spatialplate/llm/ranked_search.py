"""Ranked lexical search by Block-Max MaxScore over shards of documents.

The index is made once, where the texts lie: each task turns its rows into
shards of some MB of text, and in a shard's posting lists, cut into blocks, each
block has its most occurrences and its shortest document. From these follows the
block's bound for any size of the corpus, so that an index stays right when
others join it. Documents are numbered by length in their shard; a block's
documents are thus of about one length, and its bound is tight.

Queries come in tiles to parts of the shards. A task keeps one heap a query over
all its shards, so that a shard begins with the threshold that others have set;
heaps are merged over groups of tasks, and groups of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_few, written

#: What parts terms: all ASCII but digits and letters.
OTHER = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Bytes of text in a shard, postings in a block, queries in a tile, and how many heaps are merged into one.
SHARD, BLOCK, TILE, FAN = 8 << 20, 128, 512, 16
INDEX = "shard long, ids array<long>, lens array<int>, terms array<string>, df array<int>, gap_width binary, tf_width binary, last array<int>, most_tf array<int>, least_len array<int>, gap1 binary, gap2 binary, gap4 binary, tf1 binary, tf2 binary, tf4 binary"
WIDTHS = (1, 2, 4)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms_of(text: Column) -> Column:
    """A text's terms in order, with repeats; none for a null text."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), OTHER, -1), lambda x: x != "")


# The index of a shard.


def _narrow(values: np.ndarray, begins: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, dict[int, bytes]]:
    """Each list's bytes a value, as few as its greatest one needs, and the values of the lists of each width, one list after another."""
    most = np.maximum.reduceat(values, begins) if len(begins) else begins
    width = np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4)).astype(np.uint8)
    each = np.repeat(width, df)
    return width, {w: values[each == w].astype(f"<u{w}").tobytes() for w in WIDTHS}


def _shard(number: int, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """One row of INDEX. A list holds the gaps between its documents' numbers, and their counts."""
    pieces = pc.split_pattern_regex(pc.ascii_lower(texts), OTHER)
    parent, flat = pc.list_parent_indices(pieces), pc.list_flatten(pieces)
    there = pc.not_equal(flat, "")
    flat, parent = pc.filter(flat, there).dictionary_encode(), pc.filter(parent, there).to_numpy()
    lens = np.bincount(parent, minlength=len(ids))
    order = np.lexsort((ids.to_numpy(), lens))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    # Terms by name, so that an index does not depend on the order in which rows came.
    names = flat.dictionary
    by_name = pc.sort_indices(names)
    rank = np.empty(len(names), np.int64)
    rank[by_name.to_numpy()] = np.arange(len(names))
    keys, tf = np.unique(rank[flat.indices.to_numpy()] * len(ids) + place[parent], return_counts=True)
    of, docs = np.divmod(keys, max(len(ids), 1))
    df = np.bincount(of, minlength=len(names))
    begins, lens = np.cumsum(df) - df, lens[order]
    gaps = np.diff(docs, prepend=0)
    gaps[begins] = docs[begins]
    blocks = np.flatnonzero((np.arange(len(docs)) - begins[of]) % BLOCK == 0)
    last = docs[np.append(blocks[1:], len(docs)) - 1] if len(docs) else docs
    most_tf = np.maximum.reduceat(tf, blocks) if len(docs) else tf
    least_len = lens[docs[blocks]]  # numbered by length, so the first is the shortest
    (gap_width, gap), (tf_width, counts) = _narrow(gaps, begins, df), _narrow(tf, begins, df)
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    ints = lambda values: one(pa.array(values.astype(np.int32)))
    columns = [pa.array([number]), one(pa.array(ids.to_numpy()[order])), ints(lens), one(pc.take(names, by_name)), ints(df), pa.array([gap_width.tobytes()]), pa.array([tf_width.tobytes()]), ints(last), ints(most_tf), ints(least_len)]
    columns += [pa.array([x[w]], pa.binary()) for x in (gap, counts) for w in WIDTHS]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in INDEX.split(", ")])


def build(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all documents as a written table, a row for each shard.

    Documents without an id take no part; without a term they are in no list, and count for nothing. Rows that
    repeat an id are documents of their own. A text of any length is one document of one shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, size, number = [], 0, TaskContext.get().partitionId() << 33

        def shard() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            return _shard(number, *(whole.column(i).chunk(0) for i in range(2)))

        for batch in batches:
            begin, sizes = 0, pc.binary_length(batch.column(1)).to_pylist()
            for i, n in enumerate(sizes):
                if size and size + n > SHARD:
                    held.append(batch.slice(begin, i - begin))
                    yield shard()
                    held, size, number, begin = [], 0, number + 1, i
                size += n
            held.append(batch.slice(begin))
        if any(map(len, held)):
            yield shard()

    rows = by_few(documents).where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.make_valid_utf8(F.col(f"`{text_col}`").cast("string")), F.lit("")).alias("text"))
    return written(rows.mapInArrow(run, INDEX), "index")


# Weights.


def totals(index: DataFrame) -> tuple[int, int]:
    """Documents that have a term, and terms of all documents with their repeats."""
    some = F.filter("lens", lambda x: x > 0)
    n, length = index.agg(F.sum(F.size(some)), F.sum(F.aggregate(some, F.lit(0).cast("long"), lambda s, x: s + x))).first()
    return n or 0, length or 0


def weighted(index: DataFrame, items: DataFrame, documents: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, terms, weights): an item's terms that documents hold, once each. Items without an id take no part; rows that repeat one are one item."""
    asked = items.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("item_id"), F.explode(terms_of(F.col(f"`{text_col}`").cast("string"))).alias("term")).distinct()
    counted = index.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.df").alias("n"))
    found = counted.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.ln(F.lit(float(2 * documents + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    pairs = asked.join(found, "term").select("item_id", "term", weight.alias("weight")).where(F.col("weight") > 0)
    listed = F.sort_array(F.collect_list(F.struct("term", "weight")))
    return pairs.groupBy("item_id").agg(listed.alias("l")).select("item_id", F.col("l.term").alias("terms"), F.col("l.weight").alias("weights"))


# Search in a shard.


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class _Lists:
    """A shard's posting lists, read from its row of the index."""

    def __init__(self, row: dict, documents: int, length: int) -> None:
        as_numpy = lambda name: row[name].values.to_numpy()
        self.ids, self.terms, self.df = as_numpy("ids"), row["terms"].values, as_numpy("df").astype(np.int64)
        m = lambda lens: 50 + (50 * lens.astype(np.int64) * documents) // max(length, 1)
        self.m, self.last = m(as_numpy("lens")), as_numpy("last")
        self.bounds = impact(as_numpy("most_tf").astype(np.int64), m(as_numpy("least_len")))
        self.first_block = np.concatenate([[0], np.cumsum(-(-self.df // BLOCK))])
        self.packed = []
        for name in ("gap", "tf"):
            width, begins = np.frombuffer(row[f"{name}_width"].as_py(), np.uint8), np.empty(len(self.df), np.int64)
            for w in WIDTHS:
                n = self.df[width == w]
                begins[width == w] = np.cumsum(n) - n
            self.packed.append((width, begins, {w: np.frombuffer(row[f"{name}{w}"].as_py(), f"<u{w}") for w in WIDTHS}))
        self.read = 0

    def blocks(self, term: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents' numbers and impacts of some blocks, given in order from 0: only these are unpacked."""
        n, first = int(self.df[term]), int(self.first_block[term])
        gaps, counts = (values[width[term]][begins[term] : begins[term] + n] for width, begins, values in self.packed)
        self.read += len(which)
        if len(which) == int(self.first_block[term + 1]) - first:
            docs, tf = np.cumsum(gaps, dtype=np.int64), counts.astype(np.int64)
        else:
            at = which[:, None] * BLOCK + np.arange(BLOCK)
            there = at < n
            at = np.minimum(at, n - 1)
            base = np.where(which > 0, self.last[first + which - 1], 0)
            docs, tf = (base[:, None] + np.cumsum(gaps[at].astype(np.int64) * there, axis=1))[there], counts[at].astype(np.int64)[there]
        return docs, impact(tf, self.m[docs])


def _kth(scores: np.ndarray, best: np.ndarray, k: int) -> int:
    """The k-th highest of what is found so far, 0 if there are fewer: no document below it can come in."""
    both = np.concatenate([scores[scores > 0], best])
    return int(np.partition(both, len(both) - k)[len(both) - k]) if len(both) >= k else 0


def best_of_shard(lists: _Lists, found: list[tuple[int, int]], best: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the shard's documents that may be among the k best, next to the scores `best` of other shards; found: (term, weight).

    Lists come by their bound, highest first. While those not yet read could
    lift an unseen document to the threshold they are essential, and read whole.
    The rest only adds to documents seen; where a document's score with its
    block's bound and the bounds of the lists after stays below the threshold
    the document goes, and blocks without a document left are not unpacked.
    """
    ready = []
    for term, weight in found:
        a, b = int(lists.first_block[term]), int(lists.first_block[term + 1])
        ready.append((weight * int(lists.bounds[a:b].max()), term, weight))
    ready.sort(reverse=True)
    rest = np.cumsum([x[0] for x in reversed(ready)])[::-1].tolist() + [0]
    scores, threshold, i = np.zeros(len(lists.ids), np.int64), _kth(np.empty(0, np.int64), best, k), 0
    while i < len(ready) and rest[i] >= threshold:
        _, term, weight = ready[i]
        docs, f = lists.blocks(term, np.arange(int(lists.first_block[term + 1] - lists.first_block[term])))
        scores[docs] += weight * f
        i += 1
        if i < len(ready):
            threshold = max(threshold, _kth(scores, best, k))
    seen = np.flatnonzero(scores > 0)
    for j in range(i, len(ready)):
        seen = seen[scores[seen] + rest[j] >= threshold]
        if not len(seen):
            break
        _, term, weight = ready[j]
        a, b = int(lists.first_block[term]), int(lists.first_block[term + 1])
        block = np.searchsorted(lists.last[a:b], seen)
        bound = np.where(block < b - a, weight * lists.bounds[np.minimum(a + block, b - 1)], 0)
        keep = scores[seen] + bound + rest[j + 1] >= threshold
        seen, block = seen[keep], block[keep]
        which = np.unique(block[block < b - a])
        if len(which):
            docs, f = lists.blocks(term, which)
            here = np.isin(docs, seen, assume_unique=True)
            scores[docs[here]] += weight * f[here]
        threshold = max(threshold, _kth(scores[seen], best, k))
    seen = seen[scores[seen] >= max(threshold, 1)]
    return lists.ids[seen], scores[seen]


def _merged(heap: tuple[np.ndarray, np.ndarray], ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    ids, scores = np.concatenate([heap[0], ids]), np.concatenate([heap[1], scores])
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search(index: DataFrame, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents of score above 0, ties to the smaller id; all, if there are fewer.

    An item without a term that documents hold has no row; so has every item if
    the index, or the items' table, is empty. Documents that repeat an id each
    have a rank.
    """
    documents, length = totals(index)
    asked = written(weighted(index, items, documents, id_col, text_col), "asked")
    tiles_n, parts = max(1, -(-asked.count() // TILE)), max(1, min(index.count(), int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    tile = F.pmod(F.xxhash64("item_id"), F.lit(tiles_n)).cast("int")
    tiles = asked.groupBy(tile.alias("tile")).agg(F.sort_array(F.collect_list(F.struct("item_id", "terms", "weights"))).alias("asked"))
    # Tiles go to each part of the shards, and shards to each tile: equal shares under every key, and one tile, of bounded size, under each.
    sent = tiles.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    shards = index.withColumn("part", F.pmod(F.xxhash64("shard"), F.lit(parts)).cast("int")).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles_n - 1))))
    pairs = sent.hint("merge").join(shards, ["tile", "part"])
    kind = asked.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heaps, number = None, [], 0

        def out() -> Iterator[pa.RecordBatch]:
            rows = [(item, number, i, s) for item, heap in zip(items_, heaps, strict=True) for i, s in zip(heap[0].tolist(), heap[1].tolist(), strict=True)]
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], item_type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], ["item_id", "part", "doc_id", "score"])

        for batch in batches:
            for i in range(len(batch)):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                if now != (row["tile"].as_py(), row["part"].as_py()):
                    if now is not None:
                        yield from out()
                    now, number = (row["tile"].as_py(), row["part"].as_py()), row["part"].as_py()
                    asked_ = row["asked"].values
                    items_, item_type = asked_.field("item_id").to_pylist(), asked_.field("item_id").type
                    terms, weights = asked_.field("terms"), asked_.field("weights").flatten().to_numpy()
                    of, terms = pc.list_parent_indices(terms).to_numpy(), terms.flatten()
                    heaps = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(items_)
                lists = _Lists(row, documents, length)
                places = pc.index_in(terms, value_set=lists.terms).to_numpy(zero_copy_only=False)
                known = np.flatnonzero(~np.isnan(places.astype(float)))
                borders = np.searchsorted(of[known], np.arange(len(items_) + 1))
                for q in range(len(items_)):
                    mine = known[borders[q] : borders[q + 1]]
                    if len(mine):
                        ids, scores = best_of_shard(lists, list(zip(places[mine].astype(int).tolist(), weights[mine].tolist(), strict=True)), heaps[q][1], k)
                        heaps[q] = _merged(heaps[q], ids, scores, k)
        if now is not None:
            yield from out()

    merged = pairs.select("tile", "part", "asked", *[x.split()[0] for x in INDEX.split(", ")]).mapInArrow(run, f"item_id {kind}, part int, doc_id long, score long")
    best = [F.desc("score"), F.asc("doc_id")]
    while True:
        parts = -(-parts // FAN)
        merged = merged.withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        merged = merged.withColumn("rank", F.row_number().over(W.partitionBy("item_id", "part").orderBy(*best))).where(F.col("rank") <= k)
        if parts == 1:
            return merged.select("item_id", "rank", "doc_id", "score")


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents WHERE doc_id IS NOT NULL
), s AS (SELECT count(*) AS n_all, CAST(sum(len(t)) AS BIGINT) AS l_all FROM d WHERE len(t) > 0),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL
), p AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_all) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
f AS (SELECT row, doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_all) // l_all)) AS f FROM p, s),
r AS (SELECT item_id, row, doc_id, CAST(sum(w * f) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN f USING (term) GROUP BY 1, 2, 3 HAVING sum(w * f) > 0)
SELECT * FROM (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r) WHERE rank <= 50
"""
