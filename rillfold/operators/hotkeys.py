"""Per-key results where a few keys own most rows.

Two-stage aggregation: rows of heavy keys get a random salt, partial results are made per
(key, salt), and the partials of a key are merged. Heavy keys are found with a mergeable
frequent-items sketch, whose result is bounded by the share asked for, not by the data.

Defined cases: a null key is a key like any other; an empty table gives no rows; repeated rows
count as often as they occur; other columns, whatever their names, aren't touched.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counters a sketch keeps; its error is under n / (0.75 * counters), far below the shares used.
SKETCH_ITEMS = 4096
#: Parts of one key at most.
MOST_PARTS = 1024


@dataclass(frozen=True)
class Mergeable:
    """An aggregate that can be made in parts: `partial` over rows, `merge` over the parts' column."""

    name: str
    partial: Column
    merge: Callable[[Column], Column]


def count_rows(name: str) -> Mergeable:
    return Mergeable(name, F.count(F.lit(1)), F.sum)


def count_of(name: str, c: Column) -> Mergeable:
    return Mergeable(name, F.count(c), F.sum)


def least(name: str, c: Column) -> Mergeable:
    return Mergeable(name, F.min(c), F.min)


def greatest(name: str, c: Column) -> Mergeable:
    return Mergeable(name, F.max(c), F.max)


@dataclass(frozen=True)
class Sketch:
    """The number of rows, and keys (as text, null for a null key) that may hold the share asked for, with estimated counts."""

    n: int
    candidates: list[tuple[str | None, int]]

    def holds(self, text: Column) -> Column:
        """Whether a key's text is one of the candidates'."""
        known = [k for k, _ in self.candidates if k is not None]
        some_null = any(k is None for k, _ in self.candidates)
        return F.coalesce(text.isin(known), F.lit(some_null)) if known else F.lit(some_null) & text.isNull()

    def parts(self, text: Column, target: float) -> Column:
        """Into how many parts of about `target` of all rows a key is to be split: 1 for those that aren't candidates."""
        size = max(1, int(target * self.n))
        each = [F.when(text.isNull() if k is None else text == k, F.lit(max(2, min(MOST_PARTS, -(-c // size))))) for k, c in self.candidates]
        return F.coalesce(*each, F.lit(1))


def sketch(df: DataFrame, key: Column, share: float) -> Sketch:
    """One pass over the key.

    No key that holds `share` of the rows is missed: the sketch's error is added to its estimates. At most 2 / share + 1
    keys come to the driver. Keys are compared as text, so the caller gives a faithful rendering.
    """
    if not 10 / SKETCH_ITEMS <= share <= 1:
        raise ValueError(f"share must lie between {10 / SKETCH_ITEMS:.4f} and 1")
    k = int(2 / share) + 1
    # Null has no place in the sketch; it is set apart by a prefix that every other key lacks.
    text = F.when(key.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), key.cast("string")))
    row = df.select(text.alias("__k")).agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(__k, {k}, {SKETCH_ITEMS})").alias("top")).first()
    n = row["n"]
    slack = n / (0.75 * SKETCH_ITEMS)
    return Sketch(n, [(None if r["item"] == "-" else r["item"][1:], r["count"]) for r in (row["top"] or []) if r["count"] + slack >= share * n])


def heavy_candidates(df: DataFrame, key: Column, share: float) -> list[tuple[str | None, int]]:
    """The candidates of `sketch`."""
    return sketch(df, key, share).candidates


def salted_aggregate(df: DataFrame, keys: dict[str, Column], aggregates: Sequence[Mergeable], *, heavy_key: Column, share: float = 0.01, target: float = 0.002, seed: int = 7, known: Sketch | None = None) -> DataFrame:
    """`aggregates` per key, complete for every key.

    heavy_key is the text by which a key counts as heavy. Keys with at least `share` of the rows
    are spread over so many salts that each salted part holds about `target` of the rows; the
    list of heavy keys is at most 2 / share + 1 long and becomes a literal of the plan. The salt is
    seeded, so a task that runs again after an executor is lost deals the same salts. known: the sketch, where the caller has it.
    """
    known = known or sketch(df, heavy_key, share)
    key_columns = [f"__key_{k}" for k in keys]
    named = df.select(*[c.alias(f"__key_{k}") for k, c in keys.items()], heavy_key.cast("string").alias("__heavy"), "*")
    named = named.withColumn("__salt", F.floor(F.rand(seed) * known.parts(F.col("__heavy"), target)).cast("int") if known.candidates else F.lit(0))
    partial = named.groupBy(*key_columns, "__salt").agg(*[a.partial.alias(f"__part_{a.name}") for a in aggregates])
    merged = partial.groupBy(*key_columns).agg(*[a.merge(F.col(f"__part_{a.name}")).alias(a.name) for a in aggregates])
    return merged.select(*[F.col(f"__key_{k}").alias(k) for k in keys], *[a.name for a in aggregates])


def heavy_keys(df: DataFrame, key: Column, share: float) -> DataFrame:
    """`(key_value string, n bigint)`: the keys that hold at least `share` of the rows, counted exactly.

    The sketch, which also counts the rows, gives the few candidates; the salted aggregation counts just their rows. Two passes over the key.
    """
    seen = sketch(df, key, share)
    rows = df.select(key.cast("string").alias("__k")).where(seen.holds(F.col("__k")))
    counted = salted_aggregate(rows, {"key_value": F.col("__k")}, [count_rows("n")], heavy_key=F.col("__k"), known=seen)
    return counted.where(F.col("n") >= F.lit(share) * F.lit(seen.n))
