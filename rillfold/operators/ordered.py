"""Ordered scans of long sequences without one task per sequence.

A sequence is cut into chunks by a bucket of its order column. Windows run within a chunk, and what a
chunk passes on is computed from one row per chunk, so a stream that owns a third of a log is many units of work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def row_numbers(df: DataFrame, keys: list[str], order: list[Column | str], bucket: Column, name: str = "row_number") -> DataFrame:
    """The 1-based place of each row in its sequence. bucket must not fall as the order rises."""
    cut = df.withColumn("__bucket", bucket)
    sizes = cut.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    local = cut.withColumn("__k", F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(*order)))
    return _again(local, before, keys).withColumn(name, (F.col("__before") + F.col("__k")).cast("bigint")).drop("__bucket", "__before", "__k")


def last_known(df: DataFrame, keys: list[str], order: list[Column | str], bucket: Column, value: Column, name: str) -> DataFrame:
    """The last value that isn't null at or before each row in its sequence."""
    cut = df.withColumns({"__bucket": bucket, "__v": value})
    rank = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    lasts = cut.groupBy(*keys, "__bucket").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), rank)).alias("__last"))
    carried = lasts.withColumn("__carry", F.last("__last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("__last")
    local = cut.withColumn("__k", F.last("__v", ignorenulls=True).over(Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return _again(local, carried, keys).withColumn(name, F.coalesce("__k", "__carry")).drop("__bucket", "__v", "__k", "__carry")


def neighbours(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str, before: str, after: str) -> DataFrame:
    """`value`, which is never null, of the row before and after each row in its sequence; null at its ends."""
    cut = df.withColumn("__bucket", bucket)
    rank = F.struct(*order)
    ends = cut.groupBy(*keys, "__bucket").agg(F.min_by(value, rank).alias("__first"), F.max_by(value, rank).alias("__last"))
    w = Window.partitionBy(*keys).orderBy("__bucket")
    ends = ends.select(*keys, "__bucket", F.lag("__last").over(w).alias("__before"), F.lead("__first").over(w).alias("__after"))
    w = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    local = cut.select("*", F.lag(value).over(w).alias("__lag"), F.lead(value).over(w).alias("__lead"))
    out = _again(local, ends, keys)
    return out.withColumns({before: F.coalesce("__lag", "__before"), after: F.coalesce("__lead", "__after")}).drop("__bucket", "__lag", "__lead", "__before", "__after")


def _again(rows: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their chunk's columns; null keys are keys as well."""
    names = [*keys, "__bucket"]
    right = chunks.select(*[F.col(k).alias(f"__r_{k}") for k in names], *[c for c in chunks.columns if c not in names])
    on = [rows[k].eqNullSafe(right[f"__r_{k}"]) for k in names]
    joined = rows.join(right, on)
    return joined.drop(*[f"__r_{k}" for k in names])
