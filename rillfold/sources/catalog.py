"""What a reader asks of a catalog before it starts: tables, their logs, and how long changes are kept."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True, order=True)
class TableName:
    keyspace: str
    name: str

    @property
    def log(self) -> str:
        return f"{self.keyspace}.{self.name}_cdc_log"

    @classmethod
    def parse(cls, text: str) -> TableName:
        keyspace, dot, name = text.partition(".")
        if not (dot and keyspace and name):
            raise ValueError(f"not keyspace.table: {text!r}")
        return cls(keyspace, name)


@dataclass(frozen=True)
class TableInfo:
    name: TableName
    cdc_enabled: bool
    ttl_s: str | int | None = None
    uses_tablets: bool = False


def problems(wanted: list[TableName], known: list[TableInfo]) -> list[str]:
    """Why tables can't be read, one line each; none if they can."""
    by = {t.name: t for t in known}
    keyspaces = {t.name.keyspace for t in known}
    out = []
    for t in wanted:
        if t.keyspace not in keyspaces:
            out.append(f"no keyspace {t.keyspace}")
        elif t not in by:
            out.append(f"no table {t.keyspace}.{t.name}")
        elif not by[t].cdc_enabled:
            out.append(f"{t.keyspace}.{t.name} keeps no log")
    if not wanted:
        out.append("no tables")
    return out


def ttl_seconds(info: TableInfo) -> int | None:
    """How long changes are kept; 0 is for ever. Missing or garbled information raises."""
    if info.ttl_s is None:
        raise ValueError(f"no TTL known for {info.name}")
    n = int(info.ttl_s)
    if n < 0:
        raise ValueError(f"TTL of {info.name} is {n}")
    return n or None


def ttl_of(text: Column) -> Column:
    """Seconds that changes are kept, from their text: null for ever (0); missing or garbled text raises."""
    n = text.try_cast("bigint")
    bad = F.raise_error(F.concat(F.lit("not a TTL: "), F.coalesce(text.cast("string"), F.lit("null")))).cast("bigint")
    return F.when(n.isNull() | (n < 0), bad).otherwise(F.nullif(n, F.lit(0)))


def check(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """`(table_name, problem)` of each wanted table, the problem null for one that can be read.

    known: `table_name, cdc_enabled`. The same as `problems`, for catalogs of any size; tables with and without tablets among
    the wanted ones are refused together (`uses_tablets`, where known has it).
    """
    space = F.substring_index("table_name", ".", 1)
    spaces = known.select(space.alias("__space"), F.lit(True).alias("__has_space")).distinct()
    has_tablets = "uses_tablets" in known.columns
    tables = known.groupBy("table_name").agg(F.bool_or("cdc_enabled").alias("__cdc"), *([F.bool_or("uses_tablets").alias("__tablets")] if has_tablets else []))
    asked = wanted.select("table_name").distinct().withColumn("__space", space).join(spaces, "__space", "left").join(tables, "table_name", "left")
    name = F.col("table_name")
    problem = F.when(F.instr("table_name", ".") <= 1, F.concat(F.lit("not keyspace.table: "), name)).when(F.col("__has_space").isNull(), F.concat(F.lit("no keyspace "), F.col("__space"))).when(F.col("__cdc").isNull(), F.concat(F.lit("no table "), name)).when(~F.col("__cdc"), F.concat(name, F.lit(" keeps no log")))
    if has_tablets:
        some, every = asked.agg(F.bool_or("__tablets"), F.bool_and("__tablets")).first()
        problem = F.coalesce(problem, F.when(F.lit(bool(some and not every)) & F.col("__tablets"), F.concat(name, F.lit(" has tablets, others don't"))))
    return asked.select("table_name", problem.alias("problem"))
