"""Fill-in-the-middle: texts cut into prefix, middle and suffix at token borders, and put together in another order.

The draws are hashes of the id, made by Spark. Cutting is a pipeline of
pyarrow.compute over each Arrow batch: texts are split into lists of units, the
lists flattened with their parents, units numbered within their text, filtered
by the role that their number gives them, gathered into lists again and joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_few, slices

#: Marks of the pieces; a text that holds one of them stays plain. And the name of the draws.
PREFIX, SUFFIX, MIDDLE, SEED = "<P>", "<S>", "<M>", "42"
#: Of a hundred texts, so many are cut; of a hundred that are cut, so many go suffix first.
RATE, SUFFIX_FIRST = 50, 80
#: A unit: blanks and what follows them up to the next blank, or blanks alone. As bytes, for blanks are ASCII.
UNIT = b"[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+"
#: A byte that UTF-8 never has, put behind each unit.
BORDER = b"\xff"
BATCH = 8 << 20


def draws(id_: Column, seed: str = SEED) -> Column:
    """Four whole numbers below 2^32: the first hexadecimal digits of SHA-256 of seed, a colon and the id (nothing, if it is null)."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def _pieces(texts: pa.Array, low: pa.Array, high: pa.Array) -> tuple[pa.Array, list[pa.Array]]:
    """Each text's number of units n, and its first, middle and last part; low and high are taken modulo n + 1 and put in order."""
    marked = pc.replace_substring_regex(texts, pattern=UNIT, replacement=b"\\0" + BORDER)
    lists = pc.split_pattern(marked, pattern=BORDER)  # and an empty piece after the last border
    n = pc.subtract(pc.cast(pc.list_value_length(lists), pa.int64()), 1)
    whole = pc.add(n, 1)
    low, high = (pc.subtract(x, pc.multiply(pc.divide(x, whole), whole)) for x in (low, high))
    first, last = pc.min_element_wise(low, high), pc.max_element_wise(low, high)
    parents = pc.list_parent_indices(lists)
    begins = pc.subtract(pc.cumulative_sum(whole), whole)
    ordinal = pc.subtract(pa.array(range(len(parents)), pa.int64()), pc.take(begins, parents))
    at_first, at_last, units = pc.less(ordinal, pc.take(first, parents)), pc.less(ordinal, pc.take(last, parents)), pc.list_flatten(lists)
    roles = (at_first, pc.and_not(at_last, at_first), pc.invert(at_last))
    sizes = (first, pc.subtract(last, first), pc.subtract(whole, last))
    parts = []
    for role, size in zip(roles, sizes, strict=True):
        offsets = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(size)]).cast(pa.int32())
        parts.append(pc.binary_join(pa.ListArray.from_arrays(offsets, pc.filter(units, role)), b""))
    return n, parts


def _cut(batch: pa.RecordBatch, rate: int, suffix_first: int) -> pa.RecordBatch:
    texts = batch.column("text").cast(pa.binary())
    h = [batch.column(f"h{i}") for i in range(1, 5)]
    n, (prefix, middle, suffix) = _pieces(texts, h[0], h[1])
    hundredth = lambda x: pc.subtract(x, pc.multiply(pc.divide(x, 100), 100))
    plain = pc.greater_equal(hundredth(h[2]), rate)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = pc.or_(plain, pc.match_substring(texts, pattern=mark.encode()))
    plain = pc.or_(plain, pc.equal(pc.binary_length(texts), 0))
    form = pc.if_else(plain, "plain", pc.if_else(pc.less(hundredth(h[3]), suffix_first), "spm", "psm"))
    p, s, m = (pa.scalar(x.encode(), pa.binary()) for x in (PREFIX, SUFFIX, MIDDLE))
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, b"")
    spm = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, b"")
    out = pc.if_else(plain, texts, pc.if_else(pc.equal(form, "spm"), spm, psm)).cast(pa.string())
    chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.cast(pc.utf8_length(x.cast(pa.string())), pa.int64())) for x in (prefix, middle)]
    return pa.RecordBatch.from_arrays([batch.column("r"), n, form, *chars, out], ["r", "n", "form", "prefix_chars", "middle_chars", "output"])


def _run(rate: int, suffix_first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, BATCH):
                yield _cut(part, rate, suffix_first)

    return run


ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


def transformed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: str = SEED, carry: list[str] | None = None) -> DataFrame:
    """df's rows (the columns `carry`, or all) with n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output.

    A null text counts as empty, and an empty one stays plain, with no unit.
    Bytes that are not UTF-8 count as U+FFFD. A null id draws like the empty
    text; rows that repeat an id draw alike. Columns of the added names are
    replaced. A text of any length is one unit list in one batch; rows come out
    once and in their partitions, and an empty table gives an empty one.
    """
    names = [c for c in (df.columns if carry is None else carry) if c not in ADDED]
    held = F.struct(*[F.col(f"`{c}`") for c in names] or [F.lit(0).alias("_")]).alias("r")
    text = F.coalesce(F.make_valid_utf8(F.col(f"`{text_col}`").cast("string")), F.lit("")).alias("text")
    drawn = by_few(df).select(held, text, draws(F.col(f"`{id_col}`"), seed).alias("h"))
    ready = drawn.select("r", "text", *[F.get("h", F.lit(i)).alias(f"h{i + 1}") for i in range(4)])
    schema = T.StructType([ready.schema["r"], *[T.StructField(c, T.StringType() if c in ("form", "output") else T.LongType()) for c in ADDED]])
    cut = ready.mapInArrow(_run(rate, suffix_first), schema)
    return cut.select(*[F.col(f"r.`{c}`").alias(c) for c in names], *ADDED)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No text that was cut holds a mark, and marks don't overlap, so that an output splits into its pieces in one way."""
    piece = lambda i: F.get(F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1), F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(piece(1), piece(3), piece(2))).otherwise(F.concat(piece(2), piece(3), piece(1)))


def digest(df: DataFrame) -> DataFrame:
    """transformed() rows with the output and what it restores to as SHA-256 digests."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = f"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents
), d AS (
  SELECT *, CAST('0x' || substr(s, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(s, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(s, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) AS h4,
    regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u FROM h
), c AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
