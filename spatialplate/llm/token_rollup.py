"""Token counts kept up to date by signed deltas.

A rollup is a folder of versions: the totals by source, language and tokenizer
version, and the names of the batches that are in them. A batch adds up its
signed changes, folds them into the totals of the last version and writes both
to a folder aside, which is then renamed to the next version. That rename is the
commit: it fails if another writer took the number, and then the batch is
folded into the other's totals. A batch whose name is there is never applied
again, and one that failed half way has left nothing that anybody reads.
"""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import removed, written

KEYS = ("source", "lang", "tokenizer")
#: Versions of counting: words between blanks, words with an ASCII letter or digit, and pieces (runs of these, and single other characters).
BLANK = r"\x20\x09-\x0D"
PATTERNS = {"words": rf"[^{BLANK}]+", "solid": rf"[^{BLANK}]*[A-Za-z0-9][^{BLANK}]*", "pieces": r"[A-Za-z0-9]+|[^A-Za-z0-9\x00-\x20]"}


def n_tokens(text: Column, version: str) -> Column:
    """Tokens of a text; 0 where it is null or empty."""
    return F.coalesce(F.regexp_count(text, F.lit(PATTERNS[version])), F.lit(0)).cast("long")


def vocabulary_tokens(docs: DataFrame, path: str, version: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, source, lang, tokenizer, tokens) of each row: its tokens by the .tiktoken file at `path`; a null text has none."""
    rows = docs.select(F.struct(F.col(id_col).alias("id"), "source", "lang").alias("r"), F.col(text_col).alias("text"))
    return bpe.round_trip(rows, path, "r", "text").select(F.col("r.id").alias(id_col), "r.source", "r.lang", F.lit(version).alias("tokenizer"), F.col("n_tokens").alias("tokens"))


class Rollup:
    """Totals of documents and tokens by KEYS in a folder that driver and executors share."""

    TOTALS, APPLIED = "source string, lang string, tokenizer string, n_docs long, n_tokens long", "batch string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs
        self._fs = self._paths.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        top = self._paths.Path(self.path)
        names = [s.getPath().getName() for s in self._fs.listStatus(top)] if self._fs.exists(top) else []
        return sorted(int(n.removeprefix("version-")) for n in names if re.fullmatch(r"version-\d+", n))

    def _read(self, version: int | None, part: str) -> DataFrame:
        schema = self.TOTALS if part == "totals" else self.APPLIED
        return self.spark.createDataFrame([], schema) if version is None else self.spark.read.schema(schema).parquet(f"{self.path}/version-{version}/{part}")

    def committed(self) -> list[str]:
        """Names of the batches in force, as batch=<name>."""
        return sorted(f"batch={r.batch}" for r in self._read(max(self._versions(), default=None), "applied").collect())

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it had been applied before.

        changes(op, source, lang, tokenizer, tokens, old_tokens): `insert` adds
        a document and its tokens, `delete` takes them away, `revise` replaces
        old_tokens by tokens. Null counts are 0, null keys a group of their own,
        repeated rows count again; other columns are ignored; another op fails
        the batch. An empty batch commits nothing but its name.
        """
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
            raise ValueError(f"a batch's name has letters, digits, _ and - only: {batch!r}")
        delta = None
        while True:
            last = max(self._versions(), default=None)
            if not self._read(last, "applied").where(F.col("batch") == batch).isEmpty():
                if delta is not None:
                    removed(delta)
                return False
            if delta is None:
                tokens, old = (F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("tokens", "old_tokens"))
                sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null"))))).cast("long")
                change = F.when(F.col("op") == "revise", tokens - old).otherwise(sign * tokens)
                delta = written(changes.select(*KEYS, sign.alias("n_docs"), change.alias("n_tokens")).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")), "delta")
            aside = f"{self.path}/aside-{uuid.uuid4().hex}"
            totals = self._read(last, "totals").unionByName(delta).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            totals.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0)).write.parquet(f"{aside}/totals")
            self._read(last, "applied").unionByName(self.spark.createDataFrame([(batch,)], self.APPLIED)).write.parquet(f"{aside}/applied")
            number = 0 if last is None else last + 1
            if self._renamed(aside, f"{self.path}/version-{number}"):
                removed(delta)
                for old_version in [v for v in self._versions() if v < number - 1]:  # the one before may still be read
                    self._fs.delete(self._paths.Path(f"{self.path}/version-{old_version}"), True)
                return True
            self._fs.delete(self._paths.Path(aside), True)

    def _renamed(self, old: str, new: str) -> bool:
        """Whether the folder has got its new name, which nobody else had taken."""
        context = self._paths.FileContext.getFileContext(self._paths.Path(self.path).toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(self._paths, "Options$Rename"), 0)
        try:
            context.rename(self._paths.Path(old), self._paths.Path(new), none)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) of the last version; groups whose documents are all gone are left out."""
        return self._read(max(self._versions(), default=None), "totals")


def changes(counted: DataFrame, op: str, tokenizer: str, tokens: str, old: str | None = None) -> DataFrame:
    """A batch's rows from a table of counts."""
    return counted.select(F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(tokens).alias("tokens"), (F.col(old) if old else F.lit(0)).alias("old_tokens"))


def maintained(spark: SparkSession, docs: DataFrame, path: str) -> Rollup:
    """A corpus's life in batches: all documents by two versions, the first revised, later copies of a text deleted, one batch sent twice.

    Of the rows of one text that of the smallest id is kept, and any other row
    before one without an id; null texts are no copies of each other.
    """
    counted = written(docs.select("doc_id", "source", "lang", F.md5("text").alias("same"), F.monotonically_increasing_id().alias("row"), *[n_tokens(F.col("text"), v).alias(v) for v in PATTERNS]), "counts")
    rollup = Rollup(spark, path)
    rollup.commit("1-words", changes(counted, "insert", "words", "words"))
    rollup.commit("2-pieces", changes(counted, "insert", "pieces", "pieces"))
    rollup.commit("3-revised", changes(counted, "revise", "words", "solid", "words"))
    known = counted.where(F.col("same").isNotNull())
    first = known.groupBy("same").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("f")).select("f.row")
    copies = known.hint("merge").join(first, "row", "left_anti")
    rollup.commit("4-copies", changes(copies, "delete", "words", "solid").unionByName(changes(copies, "delete", "pieces", "pieces")))
    rollup.commit("2-pieces", changes(counted, "insert", "pieces", "pieces"))
    removed(counted)
    return rollup


def fresh_path(spark: SparkSession) -> str:
    from .common import shared_dir

    return f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}"


SQL = r"""
WITH counted AS (
  SELECT source, lang, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]*[A-Za-z0-9][^\x20\x09-\x0D]*')), 0) AS solid,
    coalesce(len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\x00-\x20]')), 0) AS pieces,
    text IS NULL OR row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) = 1 AS kept
  FROM documents
)
SELECT source, lang, tokenizer, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(tokens) AS BIGINT) AS n_tokens FROM (
  SELECT source, lang, 'words' AS tokenizer, solid AS tokens FROM counted WHERE kept
  UNION ALL SELECT source, lang, 'pieces', pieces FROM counted WHERE kept
) GROUP BY 1, 2, 3
"""
