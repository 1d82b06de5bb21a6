"""Feature collections of any size, each read by many tasks.

Spark's text reader cuts a file at its closing braces, wherever a split begins.
What a split does to the nesting is summed up for both cases, that it begins
inside a string or not; the splits of a file are then chained, so that each
knows its beginning and the number of its first feature, and the features are
read. One that reaches over a split's end is put together from its parts.

Texts are looked through as arrays of bytes, some MB at a time: quotes, braces
and brackets are found and counted for all fragments together.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..staging import settled

#: Splits of all files, a few dozen bytes each, that one reading chains and broadcasts at most.
SPLITS = 1_000_000
#: Bytes that are looked through at once.
CHUNK = 2_000_000
SPLIT, BEGIN = ["path", "file", "block"], ["source", "place", "inside", "braces", "brackets", "number"]
FOUND = pa.schema([("source", pa.string()), ("ord", pa.int64()), ("place", pa.int64()), ("part", pa.bool_()), ("text", pa.string())])
QUOTE, BACKSLASH, OPEN, CLOSE = b'"\\{}'
_MARK, _BRACE, _BRACKET = (np.zeros(256, t) for t in (bool, np.int8, np.int8))
_MARK[list(b'"\\{}[]')] = True
_BRACE[[OPEN, CLOSE]] = _BRACKET[list(b"[]")] = 1, -1


def _marks(text: np.ndarray, escaped: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places and bytes of the braces, brackets and quotes in text, but for quotes that a backslash escapes; and whether the next byte is escaped. `escaped` tells whether the first one is."""
    at = np.flatnonzero(_MARK[text])
    what = text[at]
    ends = False
    slashes = np.flatnonzero(what == BACKSLASH)
    if escaped or slashes.size:
        places = at[slashes]
        if escaped:
            places = np.concatenate([[-1], places])
        first = np.flatnonzero(np.diff(places, prepend=-9) != 1)
        last = np.append(first[1:], len(places)) - 1
        gone = places[last][(last - first) % 2 == 0] + 1
        ends = bool(gone.size) and bool(gone[-1] == len(text))
        stays = (what != BACKSLASH) & ~((what == QUOTE) & np.isin(at, gone))
        at, what = at[stays], what[stays]
    return at, what, ends


class _Nesting:
    """Braces and brackets open, and whether a string is, while marks go by."""

    def __init__(self, inside: bool, braces: int = 0, brackets: int = 0) -> None:
        self.inside, self.braces, self.brackets = inside, braces, brackets

    def go(self, what: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each mark: whether it is a brace or bracket outside strings, and the braces and brackets open after it."""
        quotes = what == QUOTE
        inside = (np.cumsum(quotes) + self.inside) % 2 == 1
        free = ~(inside | quotes)
        braces = self.braces + np.cumsum(np.where(free, _BRACE[what], 0), dtype=np.int64)
        brackets = self.brackets + np.cumsum(np.where(free, _BRACKET[what], 0), dtype=np.int64)
        if len(what):
            self.inside, self.braces, self.brackets = bool(inside[-1]), int(braces[-1]), int(brackets[-1])
        return free, braces, brackets


def _masked(text: str, inside: bool) -> tuple[str, bool]:
    """ASCII text with its strings blotted out, and whether it ends inside one, as marks tell it; `inside` tells whether it begins so."""
    read = np.frombuffer(text.encode(), np.uint8)
    at, what, _ = _marks(read, False)
    quotes = np.zeros(len(read), np.int64)
    quotes[at[what == QUOTE]] = 1
    after = (np.cumsum(quotes) + inside) % 2 == 1
    return np.where(after | (quotes == 1), ord("x"), read).astype(np.uint8).tobytes().decode(), bool(after[-1]) if len(after) else inside


def _pieces(batches: Iterator[pa.RecordBatch], columns: list[str], same: tuple[str, ...]) -> Iterator[tuple[tuple, np.ndarray]]:
    """(values of the columns, bytes): the text of splits as it stands in their files, in pieces of CHUNK bytes at most.

    `same` are the columns that tell splits apart; a split's rows follow each
    other. After each fragment stands a closing brace, but for a file's last one.
    """
    before = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = [batch.column(c) for c in same]
        new = np.zeros(n, bool)
        for c in keys:
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        begins = [0, *np.flatnonzero(new).tolist(), n]
        for begin, end in zip(begins, begins[1:], strict=False):
            rows = batch.slice(begin, end - begin)
            key, last = tuple(rows.column(c)[0].as_py() for c in same), rows.column("last")[0].as_py()
            values = rows.column("value").cast(pa.large_string())
            _, offsets, data = values.buffers()
            offsets = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
            data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
            text = np.full(len(data) + len(values), CLOSE, np.uint8)
            of_text = np.ones(len(text), bool)
            of_text[offsets[1:] - offsets[0] + np.arange(len(values))] = False
            text[of_text] = data
            if last:
                text = text[:-1] if key != before else np.concatenate([[CLOSE], text[:-1]]).astype(np.uint8)
            before = key
            told = tuple(rows.column(c)[0].as_py() for c in columns)
            for at in range(0, max(len(text), 1), CHUNK):
                yield told, text[at : at + CHUNK]


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split = None

    def told() -> pa.RecordBatch:
        sums = [[n.inside, n.braces, n.brackets, [[*k, v] for k, v in opened.items()]] for n, opened in both]
        return pa.RecordBatch.from_pylist([{**dict(zip(SPLIT, split, strict=True)), "told": json.dumps(sums)}])

    for of, text in _pieces(batches, SPLIT, ("path", "block")):
        if of != split:
            if split is not None:
                yield told()
            split, escaped, both = of, False, [(_Nesting(inside), Counter()) for inside in (False, True)]
        _, what, escaped = _marks(text, escaped)
        for nesting, opened in both:
            free, braces, brackets = nesting.go(what)
            opens = free & (what == OPEN)
            pairs, n = np.unique(np.stack([braces[opens] - 1, brackets[opens]]), axis=1, return_counts=True)
            opened.update(dict(zip(map(tuple, pairs.T.tolist()), n.tolist(), strict=True)))
    if split is not None:
        yield told()


def _chained(splits: pd.DataFrame) -> pd.DataFrame:
    """A file's splits in order: which place each has, and what it begins with."""
    inside, braces, brackets, number, rows = False, 0, 0, 0, []
    for source_, path, _, block, told in splits.sort_values(["file", "block"])[["source", *SPLIT, "told"]].itertuples(index=False):
        rows.append((path, block, source_, len(rows), inside, braces, brackets, number))
        ends, d, b, opened = json.loads(told)[inside]
        number += sum(n for x, y, n in opened if (braces + x, brackets + y) == (1, 1))
        inside, braces, brackets = ends, braces + d, brackets + b
    return pd.DataFrame(rows, columns=["path", "block", *BEGIN])


def _found(source_: str, place: int, ords: np.ndarray, part: bool, sizes: np.ndarray, data: np.ndarray | bytes) -> pa.RecordBatch:
    """Rows of FOUND, whose texts of these sizes follow each other in data."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    n = len(ords)
    texts = pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(data))
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(source_, pa.string()), n), pa.array(ords, pa.int64()), pa.repeat(pa.scalar(place, pa.int64()), n), pa.repeat(pa.scalar(part), n), texts], schema=FOUND)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FOUND: features, and the parts of those that begin or end in another split."""
    split = held = None

    def one(part: bool) -> pa.RecordBatch:
        text = b"".join(held)
        return _found(*split[:2], np.array([number - 1]), part, np.array([len(text)]), text)

    for of, text in _pieces(batches, BEGIN, ("source", "place")):
        if of != split:
            if held is not None:
                yield one(True)
            split, escaped, (*_, inside, braces, brackets, number) = of, False, of
            nesting = _Nesting(inside, braces, brackets)
            held, part = ([], True) if braces > 1 and brackets > 0 else (None, False)
        at, what, escaped = _marks(text, escaped)
        free, braces, brackets = nesting.go(what)
        starts = at[free & (what == OPEN) & (braces == 2) & (brackets == 1)]
        ends = at[free & (what == CLOSE) & (braces == 1)] + 1
        if held is not None:
            held.append(text[: ends[0] if ends.size else None].tobytes())
            if not ends.size:
                continue
            yield one(part)
            held = None
        if starts.size:
            which = np.searchsorted(ends, starts, "right")
            whole = int((which < len(ends)).sum())
            begin, end = starts[:whole], ends[which[:whole]]
            if whole:
                edge = np.zeros(len(text) + 1, np.int8)
                edge[begin] += 1
                edge[end] -= 1
                yield _found(*split[:2], number + np.arange(whole), False, end - begin, text[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)])
            number += len(starts)
            if whole < len(starts):
                held, part = [text[starts[-1] :].tobytes()], False
    if held is not None:
        yield one(True)


def source(path: Column) -> Column:
    """What a file belongs to: the folder slide_id=... that it is a part in, or itself."""
    return F.regexp_replace(path, "(/slide_id=[^/]*)/[^/]*$", "$1")


def slide_of(source_: Column) -> Column:
    """The slide of source(): the folder's value, or the file's stem."""
    name = F.regexp_extract(source_, "([^/]*)$", 1)
    return F.when(name.startswith("slide_id="), F.substring(name, 10, 1 << 30)).otherwise(N.file_stem(name))


def feature_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """FOUND: the features of FeatureCollection files as JSON, numbered from 0 in each source's order.

    The files of a folder slide_id=... are the parts of one, in the order of
    their names. Splits are as large as spark.sql.files.maxPartitionBytes. Features are the
    objects of lists at the top of a file. A file without any has no rows; one
    that breaks off gives what stands whole before, and a last text that is not.
    Rows with `part` are a feature's parts, in the order of their places. The
    files are read again whenever the result is: it is best written at once.
    """
    meta = lambda c: F.col(f"_metadata.{c}")
    last = (meta("file_block_start") + meta("file_block_length") >= meta("file_size")).alias("last")
    raw = spark.read.option("recursiveFileLookup", True).text(paths, lineSep="}").select(meta("file_path").alias("path"), meta("file_name").alias("file"), meta("file_block_start").alias("block"), last, "value")
    told = settled(raw.mapInArrow(_summed, "path string, file string, block long, told string"), "splits")
    if told.count() > SPLITS:
        raise ValueError("read so many or so large files in portions, or in larger splits")
    chained = "path string, block long, source string, place long, inside boolean, braces long, brackets long, number long"
    begins = told.withColumn("source", source(F.col("path"))).groupBy("source").applyInPandas(_chained, chained)
    # A broadcast join leaves a split's fragments in their order.
    ready = raw.join(F.broadcast(settled(begins, "begins")), ["path", "block"]).select(*BEGIN, "last", "value")
    return ready.mapInArrow(_features, "source string, ord long, place long, part boolean, text string")


def joined_parts(parts: DataFrame) -> DataFrame:
    """(source, ord, text): features put together from parts(source, ord, place, text)."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda p: p.text), "")
    return parts.groupBy("source", "ord").agg(text.alias("text"))
