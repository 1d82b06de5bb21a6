"""Row numbers within groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Positions that one task numbers.
CHUNK = 100_000


def numbered(df: DataFrame, name: str, keys: tuple[str, ...], order: str = "ord") -> DataFrame:
    """df with `name`: 1, 2, ... within each of the keys' values (nulls are a value), by the whole number `order`.

    Rows are numbered in ranges of `order`, and what the ranges before hold is
    added: no group goes to one task.
    """
    rows = df.withColumn("_range", F.floor(F.col(order) / CHUNK))
    sizes = rows.groupBy(*keys, "_range").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*[F.col(k).alias(f"_of_{k}") for k in (*keys, "_range")], before.alias("_before"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in (*keys, "_range")])
    local = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(order))
    return rows.withColumn("_local", local).join(sizes, same).withColumn(name, (F.col("_before") + F.col("_local")).cast("int")).select(*df.columns, name)
