"""Collections that aren't frozen: the state of each element, and of the whole from them.

A change of a collection either replaces it, or adds and takes out elements. Each element is a cell of
its own, of which the newest write wins; a replacement deletes what is older than itself. Both are
aggregations over (key, element), which combine before the shuffle, and merge with those of earlier batches.

Input for all: rows with key columns, `ticks, batch_seq_no`, `replace` (boolean: the change overwrites),
`added` (array of elements, or map), `removed` (array of elements or keys) and, where values expire, `until_ms`. Null `added` or `removed` is empty.
Elements come out sorted. A key whose collection ends up empty has no row, as an empty collection is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillfold.functions import timeuuid as tu
from rillfold.sources.log import ordered_type

KINDS = ("set", "map", "list")


def _entries(rows: DataFrame, kind: str) -> Column:
    """What a change does to elements, as an array of `(added, k, v)`; removals of a change come before its additions."""
    of = dict(rows.dtypes)["added"]
    if kind == "set":
        e, v = of[len("array<") : -1], "boolean"
        puts = F.transform(F.array_compact(F.array_distinct("added")), lambda x: F.struct(F.lit(True).alias("added"), x.alias("k"), F.lit(None).cast(v).alias("v")))
    else:
        field = rows.schema["added"].dataType
        e, v = field.keyType.simpleString(), field.valueType.simpleString()
        puts = F.transform(F.map_entries("added"), lambda x: F.struct(x["value"].isNotNull().alias("added"), x["key"].alias("k"), x["value"].alias("v")))
    outs = F.transform(F.array_compact(F.array_distinct("removed")), lambda x: F.struct(F.lit(False).alias("added"), x.alias("k"), F.lit(None).cast(v).alias("v")))
    empty = F.array().cast(f"array<struct<added:boolean,k:{e},v:{v}>>")
    return F.concat(F.coalesce(outs, empty), F.coalesce(puts, empty))


def element_cells(rows: DataFrame, key: list[str], kind: str) -> DataFrame:
    """`(key, element, c)` of every element touched; c is its newest write, `(at(ticks, batch_seq_no, added), v, until_ms)`."""
    until = F.col("until_ms") if "until_ms" in rows.columns else F.lit(None).cast("bigint")
    out = rows.select(*key, "ticks", "batch_seq_no", until.alias("until_ms"), F.explode(_entries(rows, kind)).alias("e"))
    return merged_cells(out.select(*key, F.col("e.k").alias("element"), F.struct(F.struct("ticks", "batch_seq_no", F.col("e.added")).alias("at"), F.col("e.v").alias("v"), "until_ms").alias("c")), key)


def merged_cells(cells: DataFrame, key: list[str]) -> DataFrame:
    """The newest write of each element; of equal ones the greater value, where values have an order."""
    newest = F.max("c") if ordered_type(cells.schema["c"].dataType) else F.max_by("c", "c.at")
    return cells.groupBy(*key, "element").agg(newest.alias("c"))


def replaced(rows: DataFrame, key: list[str]) -> DataFrame:
    """`(key, over)`: the newest replacement of each collection."""
    return rows.where(F.coalesce("replace", F.lit(False))).groupBy(*key).agg(F.max(F.struct("ticks", "batch_seq_no")).alias("over"))


def alive(cells: DataFrame, over: DataFrame, key: list[str], gone: DataFrame | None = None, now_ms: int | None = None) -> DataFrame:
    """Cells added last and not older than the last replacement, whose own elements stay; nor, with `gone`, as old as the deletion `(key, gone)` of their row."""
    at = F.struct(F.col("c.at.ticks"), F.col("c.at.batch_seq_no"))
    kept = cells.where(F.col("c.at.added")).join(over, key, "left").where(F.col("over").isNull() | (at >= F.col("over")))
    if now_ms is not None:
        kept = kept.where(F.col("c.until_ms").isNull() | (F.col("c.until_ms") > now_ms))
    if gone is not None:
        kept = kept.join(gone.select(*key, F.col("gone").cast("struct<ticks:bigint,batch_seq_no:int>").alias("__gone")), key, "left").where(F.col("__gone").isNull() | (at > F.col("__gone")))
    return kept.select(*key, "element", "c")


def assembled(cells: DataFrame, key: list[str], kind: str) -> DataFrame:
    """`(key, value)` of the living cells: a sorted array of a set, entries by key of a map, values in order of time of a list."""
    if kind == "set":
        return cells.groupBy(*key).agg(F.array_sort(F.collect_list("element")).alias("value"))
    entry = F.struct(F.col("element").alias("key"), F.col("c.v").alias("value"))
    if kind == "map":
        # Keys are distinct, so they alone decide the order.
        return cells.groupBy(*key).agg(F.collect_list(entry).alias("value")).withColumn("value", F.array_sort("value", lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
    # A list is logged as a map by time UUID; its order is that of ticks, then of the UUID.
    timed = F.struct(tu.ticks(F.col("element")).alias("t"), F.lower("element").alias("u"), F.col("c.v").alias("v"))
    order = lambda a, b: F.when((a["t"] < b["t"]) | ((a["t"] == b["t"]) & (a["u"] < b["u"])), -1).when((a["t"] == b["t"]) & (a["u"] == b["u"]), 0).otherwise(1)
    return cells.groupBy(*key).agg(F.collect_list(timed).alias("value")).withColumn("value", F.transform(F.array_sort("value", order), lambda e: e["v"]))


def _state(rows: DataFrame, key: list[str], kind: str, name: str) -> DataFrame:
    return assembled(alive(element_cells(rows, key, kind), replaced(rows, key), key), key, kind).withColumnRenamed("value", name)


def set_state(rows: DataFrame, key: list[str]) -> DataFrame:
    """`(key, elements array)`. added and removed are arrays of the same type."""
    return _state(rows, key, "set", "elements")


def map_state(rows: DataFrame, key: list[str]) -> DataFrame:
    """`(key, entries array<struct<key,value>>)`. added is a map, in which a null value takes its key out."""
    return _state(rows, key, "map", "entries")


def list_state(rows: DataFrame, key: list[str]) -> DataFrame:
    """`(key, elements array)`: a list is logged as a map by time UUID; its order is that of ticks, then of the UUID."""
    return _state(rows, key, "list", "elements")


def udt_state(rows: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """`(key, value struct)`: each field is a cell; a null field counts only if its index is in `removed`, and a replacement sets all."""
    at = F.struct("ticks", "batch_seq_no")
    whole = F.coalesce("replace", F.lit(False))
    cells = []
    for i, f in enumerate(fields):
        set_to_null = F.array_contains(F.coalesce("removed", F.array().cast("array<int>")), i)
        cells.append(F.max(F.when(whole | F.col(f"added.{f}").isNotNull() | set_to_null, F.struct(at.alias("at"), F.col(f"added.{f}").alias("v")))).alias(f))
    newest = rows.groupBy(*key).agg(*cells)
    some = F.coalesce(*[F.col(f"{f}.v").cast("string") for f in fields])
    return newest.where(some.isNotNull()).select(*key, F.struct(*[F.col(f"{f}.v").alias(f) for f in fields]).alias("value"))


def add_all(base: Column, added: Column) -> Column:
    return F.array_sort(F.array_union(F.coalesce(base, F.array()), F.coalesce(added, F.array())))


def remove_all(base: Column, removed: Column) -> Column:
    return F.array_except(base, F.coalesce(removed, F.array()))


def put_all(base: Column, added: Column) -> Column:
    """A map with the entries of another put over it."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(added, k)), added)
