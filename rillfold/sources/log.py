"""The delivered change log as typed columns: one place where raw spelling is undone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillfold.functions import timeuuid as tu

#: The columns that identify a log row, as `identified` names them.
IDENTITY = ["ticks", "low", "batch_seq_no", "stream_id"]


def micros_of(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def _copies(log: DataFrame, *extra: Column) -> DataFrame:
    """`__digits, batch_seq_no, stream_id` of each delivered copy that has an identity, and `extra` columns.

    The digits of the time are its value, so every spelling of one UUID is the same; grouping by them
    spares the arithmetic on ticks for the copies that go.
    """
    d = F.col("__digits")
    known = F.col("`cdc$time`").isNotNull() & F.col("`cdc$stream_id`").isNotNull() & F.col("`cdc$batch_seq_no`").isNotNull()
    # Exploding an array of one keeps the optimizer from copying the digits' expression into every use of it.
    return (
        log.where(known)
        .select("*", F.explode(F.array(tu.bare(F.col("`cdc$time`")))).alias("__digits"))
        .where(tu.is_digits(d))
        .select(d, F.col("`cdc$batch_seq_no`").alias("batch_seq_no"), F.col("`cdc$stream_id`").alias("stream_id"), *extra)
    )


_COPY = ["__digits", "batch_seq_no", "stream_id"]


def _with_time(rows: DataFrame, *columns: str) -> DataFrame:
    """`IDENTITY` and columns of rows that still have digits."""
    d = F.col("__digits")
    return rows.select(tu.ticks_of_digits(d).alias("ticks"), tu.low_word(d).alias("low"), "batch_seq_no", "stream_id", *columns)


def identified(log: DataFrame, *extra: Column) -> DataFrame:
    """`IDENTITY` of each delivered copy, and `extra` columns.

    Rows whose stream, time or sequence number is null or unreadable have no identity and are left out.
    """
    rows = _copies(log, *extra)
    return _with_time(rows, *[c for c in rows.columns if c not in _COPY])


def has_identity() -> Column:
    """Whether a delivered copy has an identity, without computing it; null or false if not."""
    return tu.is_digits(tu.bare(F.col("`cdc$time`"))) & F.col("`cdc$stream_id`").isNotNull() & F.col("`cdc$batch_seq_no`").isNotNull()


def arrivals(log: DataFrame) -> DataFrame:
    """One row for each log row with `arrived_us`, the earliest arrival of its copies.

    Copies are combined before the shuffle, so a log row delivered very often costs its reducer
    one row per map task. A log row none of whose copies has an arrival time has a null one.
    """
    first = _copies(log, micros_of(F.col("received_at")).alias("at")).groupBy(*_COPY).agg(F.min("at").alias("arrived_us"))
    return _with_time(first, "arrived_us")


def distinct_rows(log: DataFrame) -> DataFrame:
    """The log with one row for each log row, under `IDENTITY` and short names.

    Copies agree in what they say, so the greatest of each column is theirs, and any where values have no order (maps);
    a null `end_of_batch` is false.
    Copies are combined before the shuffle. Rows without identity are left out. A base column whose name is
    one of those is called `c_` and its name.
    """
    known = {"operation": "cdc$operation", "end_of_batch": "cdc$end_of_batch", "ttl": "cdc$ttl"}
    delivery = {"delivery_id", "delivery_batch", "received_at", "cdc$stream_id", "cdc$time", "cdc$batch_seq_no"}
    taken = {*IDENTITY, *known}
    rest = {(n if (n := c.replace("cdc$", "")) not in taken else f"c_{n}"): c for c in log.columns if c not in delivery and c not in known.values()}
    columns = {**known, **rest}
    rows = _copies(log, *[F.col(f"`{c}`").alias(n) for n, c in columns.items() if c in log.columns])
    value = lambda n: F.coalesce(F.col(n), F.lit(False)) if n == "end_of_batch" or n.startswith("deleted_") and dict(rows.dtypes)[n] == "boolean" else F.col(n)
    rest = [n for n in rows.columns if n not in _COPY]
    one = lambda n: F.max(value(n)) if ordered_type(rows.schema[n].dataType) else F.any_value(n, F.lit(True))
    return _with_time(rows.groupBy(*_COPY).agg(*[one(n).alias(n) for n in rest]), *rest)


def ordered_type(kind: T.DataType) -> bool:
    """Whether values of a type have an order; those with a map in them have none."""
    if isinstance(kind, T.ArrayType):
        return ordered_type(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(ordered_type(f.dataType) for f in kind)
    return not isinstance(kind, T.MapType)


def window_of(rows: DataFrame, start_ms: int, end_ms: int, strict: bool = False) -> DataFrame:
    """Rows with `[start_ms, end_ms)`. strict also leaves out the smallest UUID of the first millisecond, as a reader by UUID bounds does."""
    first, last = start_ms * 10000 + tu.EPOCH_TICKS, end_ms * 10000 + tu.EPOCH_TICKS
    inside = (F.col("ticks") >= first) & (F.col("ticks") < last)
    if strict:
        inside &= (F.col("ticks") != first) | (F.lower(F.hex("low")) != tu.LOW_START)
    return rows.where(inside)


def after(rows: DataFrame, stream_hex: str, ticks: int) -> DataFrame:
    """Rows after a change, streams first by signed bytes, then time by ticks alone."""
    from rillfold.functions import streamid as si

    hi, lo = si.order_keys(si.hex_id(F.col("stream_id")))
    at_hi, at_lo = si.order_keys(F.lit(stream_hex))
    return rows.where((hi > at_hi) | ((hi == at_hi) & ((lo > at_lo) | ((lo == at_lo) & (F.col("ticks") > ticks)))))


def base_columns(log: DataFrame) -> DataFrame:
    """Without the columns of the log itself."""
    return log.select(*[F.col(f"`{c}`") for c in log.columns if not c.startswith("cdc$")])


def meta_columns(log: DataFrame) -> DataFrame:
    return log.select(*[F.col(f"`{c}`") for c in log.columns if c.startswith("cdc$")])


def column_state(value: Column, deleted: Column) -> Column:
    """`set`, `nulled` or `untouched`."""
    return F.when(value.isNotNull(), "set").when(F.coalesce(deleted, F.lit(False)), "nulled").otherwise("untouched")
