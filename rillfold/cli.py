"""`python -m rillfold.cli apply|print`: rebuild a table from its log, or print the log."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillfold.folder import SharedFolder
from rillfold.functions import streamid as si
from rillfold.functions import text as tx
from rillfold.functions import timeuuid as tu
from rillfold.operators import apply, schema
from rillfold.sources.catalog import TableInfo, TableName, problems
from rillfold.sources.log import distinct_rows


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rillfold")
    p.add_argument("command", choices=["apply", "print"])
    p.add_argument("-m", "--mode", default="delta", type=apply.mode)
    p.add_argument("-k", "--keyspace", required=True)
    p.add_argument("-t", "--tables", required=True, type=lambda s: [x for x in s.split(",") if x], help="names, separated by commas")
    p.add_argument("-s", "--source", required=True, help="folder with <keyspace>.<table>.parquet logs")
    p.add_argument("-d", "--destination", help="folder for the tables")
    p.add_argument("--partition-key", default="pk")
    p.add_argument("--clustering-key", default="ck")
    p.add_argument("--schema", type=argparse.FileType(), help="JSON of the base tables, {table: {column: [kind, type]}}, instead of the keys above; it also tells lists from maps")
    return p


def keyed_of(rows: DataFrame, base: dict[str, tuple[str, str]] | None, partition: str, clustering: str) -> apply.Keyed:
    """The columns of a log's base table. Without its schema an array is a set, a map a map, a struct a type with fields."""
    kind = {n: k.upper() for n, (k, _) in (base or {}).items()}
    keys = ([n for n, k in kind.items() if k == "PARTITION_KEY"], [n for n, k in kind.items() if k == "CLUSTERING_KEY"]) if base else (partition.split(","), [x for x in clustering.split(",") if x])
    loose, plain = [], []
    for f in rows.schema:
        if f"deleted_{f.name}" not in rows.columns:
            continue
        if f"deleted_elements_{f.name}" not in rows.columns:
            plain.append(f.name)
        elif base and f.name in base and schema.parse(base[f.name][1]).name == "LIST":
            loose.append((f.name, "list"))
        else:
            loose.append((f.name, {"array": "set", "map": "map"}.get(f.dataType.typeName(), "udt")))
    return apply.Keyed(tuple(keys[0]), tuple(keys[1]), tuple(plain), tuple(loose))


def readable(spark: SparkSession, a: argparse.Namespace) -> None:
    """Refuse tables whose log isn't there, before anything is read."""
    at = SharedFolder(spark, a.source)
    names = {n.removesuffix(".parquet") for n in at.names("")}
    known = [TableInfo(TableName.parse(n), True) for n in names if n.count(".") == 1]
    if bad := problems([TableName(a.keyspace, t) for t in a.tables], known):
        raise SystemExit("\n".join(bad))


def pretty(rows: DataFrame, width: int = 24) -> DataFrame:
    """Each log row as one line of text: stream, time, operation, key and value columns."""
    known = {"stream_id", "ticks", "low", "batch_seq_no", "operation", "end_of_batch", "ttl"}
    kinds = dict(rows.dtypes)
    parts = [
        tx.field(si.hex_id(F.col("stream_id")), width), tx.field(tx.timestamp(tu.millis(F.col("ticks"))), 24), tx.field(F.col("batch_seq_no").cast("string"), 4),
        tx.field(tx.operation_name(F.col("operation")), width), *[F.concat(F.lit(f"{c}="), tx.value(F.col(c), kinds[c])) for c in rows.columns if c not in known],
    ]
    return rows.select(F.concat_ws(" | ", *parts).alias("line"))


def main(argv: list[str] | None = None) -> None:
    a = arguments().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "apply" and not a.destination:
        raise SystemExit("apply needs a destination")
    readable(spark, a)
    base = json.load(a.schema) if a.schema else {}
    for name in a.tables:
        rows = distinct_rows(spark.read.parquet(f"{a.source}/{a.keyspace}.{name}.parquet"))
        out = f"{a.destination}/{a.keyspace}.{name}"
        if a.command == "print":
            pretty(rows.orderBy("ticks", "batch_seq_no")).write.mode("overwrite").text(f"{out}.txt") if a.destination else pretty(rows).show(50, truncate=False)
            continue
        keyed = keyed_of(rows, base.get(name), a.partition_key, a.clustering_key)
        if a.mode == "preimage":
            apply.image_mismatches(rows, keyed).write.mode("overwrite").parquet(f"{out}.mismatches.parquet")
        apply.state(rows, keyed, a.mode).write.mode("overwrite").parquet(f"{out}.parquet")


if __name__ == "__main__":
    main()
