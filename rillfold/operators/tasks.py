"""Tasks, their saved states, and what may be read now.

A task is (generation, vnode, table). A state is the window it reads, `[window_start_ms, window_end_ms)`,
and the last change handed over in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillfold.functions import streamid as si
from rillfold.operators.generations import sorted_streams
from rillfold.plans.ledger import task_parts

TASK = ["table_name", "generation_ms", "vnode"]


def tasks(streams: DataFrame, tables: list[str]) -> DataFrame:
    """Each task with its sorted streams. Streams are grouped once; tables, a short list, are laid over the groups.

    A vnode has a few streams by construction, so a group stays small.
    """
    if not tables:
        raise ValueError("no tables")
    groups = streams.where("stream_id is not null").groupBy(F.col("generation_start_ms").alias("generation_ms"), "vnode").agg(sorted_streams(F.col("stream_id")).alias("streams"))
    return groups.withColumn("table_name", F.explode(F.array(*map(F.lit, sorted(set(tables)))))).select(*TASK, "streams")


def task_key(table: Column, generation: Column, vnode: Column) -> Column:
    """`keyspace.table:generation start ms:vnode`."""
    return F.concat_ws(":", table, generation.cast("string"), vnode.cast("string"))


def encode_state(start: Column, end: Column, stream: Column, time: Column) -> Column:
    """A state as the map that stores keep; the last change is left out where there is none."""
    entries = F.array(
        F.struct(F.lit("window_start").alias("key"), start.cast("string").alias("value")), F.struct(F.lit("window_end").alias("key"), end.cast("string").alias("value")),
        F.struct(F.lit("change_id_stream").alias("key"), F.upper(stream).alias("value")), F.struct(F.lit("change_id_time").alias("key"), F.lower(time).alias("value")),
    )
    whole = stream.isNotNull() & time.isNotNull()
    return F.map_from_entries(F.filter(entries, lambda e: e["key"].startswith("window") | whole))


def decode_state(m: Column) -> dict[str, Column]:
    """The columns of a stored state; null where it lacks or garbles one."""
    at = lambda k: F.try_element_at(m, F.lit(k))
    return {"window_start_ms": at("window_start").try_cast("bigint"), "window_end_ms": at("window_end").try_cast("bigint"), "last_stream": F.lower(at("change_id_stream")), "last_time": F.lower(at("change_id_time"))}


def initial_state(generation: Column, window_ms: int) -> Column:
    return F.struct(generation.alias("window_start_ms"), (generation + window_ms).alias("window_end_ms"))


def with_states(wanted: DataFrame, saved: DataFrame, window_ms: int) -> DataFrame:
    """Each task with its saved state, or the first window of its generation. Tasks no longer wanted drop out."""
    first = initial_state(F.col("generation_ms"), window_ms)
    joined = wanted.join(saved.select(*TASK, F.struct("window_start_ms", "window_end_ms").alias("__saved"), "last_stream", "last_time"), TASK, "left")
    return joined.withColumn("__s", F.coalesce("__saved", first)).select(*TASK, "__s.window_start_ms", "__s.window_end_ms", "last_stream", "last_time")


def trimmed(states: DataFrame, least_ms: Column | int, window_ms: int) -> DataFrame:
    """States moved up to what TTL still shows: a window that ended before `least_ms` begins there instead, without last change.

    A window that straddles it stays.
    """
    least = F.lit(least_ms) if isinstance(least_ms, int) else least_ms
    gone = F.coalesce(F.col("window_end_ms") < least, F.lit(False))
    return states.withColumns({"window_start_ms": F.when(gone, least).otherwise(F.col("window_start_ms")), "window_end_ms": F.when(gone, least + window_ms).otherwise(F.col("window_end_ms")), "last_stream": F.when(~gone, F.col("last_stream")), "last_time": F.when(~gone, F.col("last_time"))})


def readable(states: DataFrame, now_ms: int, confidence_ms: int) -> DataFrame:
    """Windows that ended at least `confidence_ms` ago."""
    return states.where(F.col("window_end_ms") + confidence_ms <= now_ms)


def moved(states: DataFrame, window_ms: int) -> DataFrame:
    """States after their windows were read: the next window of each."""
    return states.withColumns({"window_start_ms": F.col("window_end_ms"), "window_end_ms": F.col("window_end_ms") + window_ms, "last_stream": F.lit(None).cast("string"), "last_time": F.lit(None).cast("string")})


def all_consumed(wanted: DataFrame, states: DataFrame, until_ms: Column | int) -> DataFrame:
    """`(generation_ms, done)`: whether every task of a generation has moved past `until_ms`; one without state hasn't."""
    until = F.lit(until_ms) if isinstance(until_ms, int) else until_ms
    return wanted.join(states.select(*TASK, "window_start_ms"), TASK, "left").groupBy("generation_ms").agg(F.bool_and(F.coalesce(F.col("window_start_ms") > until, F.lit(False))).alias("done"))


def obsolete(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tasks of `old` that `new` no longer has."""
    return old.join(new.select(*TASK), TASK, "left_anti")


def active_only(rows: DataFrame, active: DataFrame) -> DataFrame:
    """Rows of tasks that are still active; a stale task's are refused."""
    return rows.join(active.select(*TASK).distinct(), TASK, "left_semi")


def checkpoints(changes: DataFrame) -> DataFrame:
    """The last change of each task at which a batch of changes ended, in stream order; needs `TASK`, `stream_id, ticks, low, end_of_batch`."""
    hi, lo = si.order_keys(si.hex_id(F.col("stream_id")))
    last = F.max(F.when(F.coalesce("end_of_batch", F.lit(False)), F.struct(hi.alias("hi"), lo.alias("lo"), "ticks", "low", si.hex_id(F.col("stream_id")).alias("stream"))))
    return changes.groupBy(*TASK).agg(last.alias("c")).where("c is not null").select(*TASK, F.col("c.stream").alias("last_stream"), F.col("c.ticks").alias("last_ticks"), F.col("c.low").alias("last_low"))


def from_key(rows: DataFrame, key: str = "task_id") -> DataFrame:
    """Rows with the parts of their task key as columns; rows whose key isn't one are left out."""
    table, generation, vnode = task_parts(F.col(key))
    return rows.withColumns({"table_name": table, "generation_ms": generation, "vnode": vnode}).where("table_name is not null and generation_ms is not null and vnode is not null")
