"""Streams over the log: counts by window, paired range bounds, callbacks and a state table kept up to date."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from rillfold.folder import SharedFolder
from rillfold.functions import streamid as si
from rillfold.functions import timeuuid as tu
from rillfold.functions.text import OPERATIONS
from rillfold.operators import apply, collections
from rillfold.sources.log import identified, micros_of
from rillfold.streaming.dedup import LAST, STATE_STORE, _pattern, settings


def stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The delivered log at a path as a stream."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(_pattern(path))


def finish(query: StreamingQuery) -> StreamingQuery:
    query.awaitTermination()
    return query


def to_folder(df: DataFrame, folder: str, mode: str) -> DataFrame:
    """Run a stream over all that is there; each micro-batch writes a folder of its own, so a replay replaces it.

    Returns what was written, with `batch`.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    finish(df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(save).trigger(availableNow=True).start())
    spark = df.sparkSession
    schema = T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).parquet(f"{folder}/out")


def run_by_arrival(spark: SparkSession, path: str, folder: str, make: Callable[[DataFrame], DataFrame], mode: str, period_s: int) -> tuple[DataFrame, int]:
    """Run a stream over the log at `path`, a micro-batch for each period of arrival, in order; a run that broke off goes on where it stopped.

    The log is laid out by period first, in one pass without a shuffle; rows without arrival time come last. Returns what was written, with `batch`, and how many rows the watermark dropped.
    """
    at = SharedFolder(spark, folder)
    at.make("feed")
    log = spark.read.parquet(path)
    if at.text("laid-out") is None:
        period = F.coalesce(tu.int_div(micros_of(F.col("received_at")), period_s * 1_000_000), F.lit(LAST))
        log.withColumn("rillfold_period", period).write.mode("overwrite").partitionBy("rillfold_period").parquet(f"{folder}/arrived")
        at.publish("laid-out", "")
    counted = make(spark.readStream.schema(log.schema).parquet(f"{folder}/feed/*"))

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    with settings(spark, **{"spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.streaming.numRecentProgressUpdates": "100000", "spark.sql.streaming.stateStore.providerClass": STATE_STORE}):
        query = counted.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(save).start()
        try:
            query.processAllAvailable()
            for p in sorted(at.names("arrived"), key=lambda x: int(x.split("=")[1])):
                at.move(f"arrived/{p}", f"feed/{p.split('=')[1]}")
                query.processAllAvailable()
        finally:
            query.stop()
    if query.exception():
        raise query.exception()
    lost = sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
    schema = T.StructType([*counted.schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).parquet(f"{folder}/out") if at.names("out") else spark.createDataFrame([], schema), lost


def window_counts(log: DataFrame, size_ms: int, delay_s: int = 30) -> DataFrame:
    """Delivered copies per operation and tumbling window of event time, in parts: `(window_start_ms, operation, part_ms, n)`.

    A copy counts at its event, but not earlier than `delay_s` before it arrived: a later one goes to a part of its own, so the watermark drops none
    as long as batches come in order of arrival, and each part's state ends behind it. `totals` adds up the parts of a window.
    Copies without arrival time have no place in that order; `unarrived_counts` counts them.
    """
    event = tu.micros(F.col("ticks"))
    rows = _by_window(log.where("received_at is not null"), size_ms)
    horizon = F.least(F.greatest(event, F.col("arrived") - F.lit(delay_s * 1_000_000)), F.col("arrived"))
    timed = rows.withColumn("at", F.timestamp_micros(horizon)).withWatermark("at", f"{delay_s + 1} seconds")
    counted = timed.groupBy(F.window("at", f"{size_ms} milliseconds").alias("w"), "window_start_ms", "operation").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("window_start_ms", "operation", F.unix_millis("w.start").alias("part_ms"), "n")


def _by_window(log: DataFrame, size_ms: int) -> DataFrame:
    rows = identified(log, F.col("`cdc$operation`").cast("int").alias("operation"), micros_of(F.col("received_at")).alias("arrived"))
    return rows.withColumn("window_start_ms", F.floor(tu.millis(F.col("ticks")) / F.lit(size_ms)).cast("bigint") * F.lit(size_ms))


def unarrived_counts(log: DataFrame, size_ms: int) -> DataFrame:
    """The same of a log at rest, for the copies without arrival time, in parts of their own."""
    rows = _by_window(log.where("received_at is null"), size_ms)
    return rows.groupBy("window_start_ms", "operation").agg(F.count(F.lit(1)).alias("n")).select("window_start_ms", "operation", F.lit(None).cast("bigint").alias("part_ms"), "n", F.lit(0).cast("bigint").alias("batch"))


def totals(updates: DataFrame) -> DataFrame:
    """`(window_start_ms, operation, n)` from all updates of `window_counts`: the last of each part, added up."""
    return latest(updates, ["window_start_ms", "operation", "part_ms"], "n").groupBy("window_start_ms", "operation").agg(F.sum("n").alias("n"))


def latest(updates: DataFrame, key: list[str], value: str) -> DataFrame:
    """The last update of each key of a stream in update mode."""
    return updates.groupBy(*key).agg(F.max_by(value, "batch").alias(value))


def range_pairs(log: DataFrame, delay: str | None = None) -> DataFrame:
    """Range deletions as soon as both bounds have arrived, in any order and in any number of copies.

    The state is keyed by stream, time and sequence, so a stream with very many changes isn't one unit. Without `delay` a bound waits for its
    partner for good, as it may come in any later batch; with one, the state expires behind the watermark, and what comes later is dropped.
    """
    op = F.col("`cdc$operation`").cast("int")
    rows = identified(log.where(op.between(5, 8)), op.alias("op"), F.col("pk").alias("pk"), F.col("ck").cast("bigint").alias("ck"))
    left = F.col("op") <= 6
    start = F.when(left, F.col("batch_seq_no")).otherwise(F.col("batch_seq_no") - 1)
    keyed = rows.withColumns({"start_seq": start, "at": F.timestamp_micros(tu.micros(F.col("ticks")))})
    keyed = keyed.withWatermark("at", delay) if delay else keyed
    both = keyed.groupBy("stream_id", "ticks", "low", "start_seq", "pk", "at").agg(F.max(F.when(left, F.col("op"))).alias("l_op"), F.max(F.when(~left, F.col("op"))).alias("r_op"), F.max(F.when(left, F.col("ck"))).alias("lo"), F.max(F.when(~left, F.col("ck"))).alias("hi"))
    return both.where("l_op is not null and r_op is not null").select("stream_id", "ticks", "low", "start_seq", "pk", "lo", "hi", "l_op", "r_op")


def _start(writer: DataStreamWriter, every: str | None) -> StreamingQuery:
    """Take all that is there and end; or go on, a batch each `every` at most ("30 seconds"), until `stop`."""
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def consume(changes: DataFrame, handle: Callable[[Row], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Hand each change to a callback, on the executors; a failure fails the batch, which is then handed over again."""
    return _start(changes.writeStream.option("checkpointLocation", checkpoint).foreach(handle), every)


def consume_by_task(changes: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, parts: int = 1) -> StreamingQuery:
    """Hand each micro-batch to a callback, its rows in order of stream (signed bytes) and time within partitions of whole streams.

    parts: into how many partitions the streams of one task may be dealt, so that a hot task is several units of work.
    """

    def run(batch: DataFrame, number: int) -> None:
        hi, lo = si.order_keys(si.hex_id(F.col("stream_id")))
        placed = batch.withColumns({"__part": F.pmod(F.xxhash64("stream_id"), F.lit(parts)), "__hi": hi, "__lo": lo})
        ordered = placed.repartition("generation_ms", "vnode", "__part").sortWithinPartitions("generation_ms", "vnode", "__part", "__hi", "__lo", "ticks", "batch_seq_no")
        handle(ordered.drop("__part", "__hi", "__lo"), number)

    return _start(changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run), every)


def consume_by_operation(changes: DataFrame, handlers: Mapping[int, Callable[[DataFrame, int], None]], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Hand the rows of each operation of a micro-batch to the handler for it, in the order of the operations' codes.

    Operations without a handler are passed over, as in a mode that ignores them; an unknown code fails the batch.
    """
    if unknown := set(handlers) - set(range(len(OPERATIONS))):
        raise ValueError(f"unknown operations {sorted(unknown)}")

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            known = {r[0] for r in batch.select(F.col("operation").cast("int")).distinct().limit(257).collect()}  # a byte's values at most
            if bad := {x for x in known if x is not None} - set(range(len(OPERATIONS))):
                raise ValueError(f"unknown operations {sorted(bad)}")
            for op in sorted(known & set(handlers)):
                handlers[op](batch.where(F.col("operation") == op), number)
        finally:
            batch.unpersist()

    return _start(changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run), every)


def stop(query: StreamingQuery, timeout_s: int = 60) -> bool:
    """End a query after the batch at hand is committed or given up; whether it ended in time. Its checkpoint says where to go on."""
    query.stop()
    return query.awaitTermination(timeout_s)


class StateTable:
    """Current cells of a table in the shared folder, and the deletions of partitions and ranges, one version per micro-batch.

    A version is named by its batch, so a replayed batch folds into the version before it again and
    replaces its own; the fold is idempotent besides. Two versions are kept. Deletions stay in the state for good, since
    an older write may come in any later batch, and the two bounds of a range in different ones.
    """

    def __init__(self, spark: SparkSession, folder: str, keyed: apply.Keyed) -> None:
        self.spark, self.folder, self.keyed = spark, folder, keyed
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(folder))

    def _versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        if any(self._fs.exists(self._path(f"{self.folder}/{x}/_SUCCESS")) for x in names):
            raise ValueError(f"{self.folder} holds a state without deletions of partitions and ranges; build it anew from the log")
        done = [int(x[1:]) for x in names if x.startswith("v") and self._fs.exists(self._path(f"{self.folder}/{x}/cells/_SUCCESS"))]
        return sorted(done)

    def _part(self, version: int, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/v{version}/{part}")

    def fold(self, rows: DataFrame, number: int) -> None:
        """For foreachBatch: rows as `apply.state` takes them."""
        before = [v for v in self._versions() if v < number]
        new, dead, ends = apply.cells(rows, self.keyed), apply.partitions_gone(rows, self.keyed), apply.bounds(rows, self.keyed)
        if before:
            new = apply.merge(self._part(before[-1], "cells"), rows, self.keyed)
            dead = self._part(before[-1], "dead").unionByName(dead).groupBy(*self.keyed.partition).agg(F.max("d_all").alias("d_all"))
            ends = self._part(before[-1], "ends").unionByName(ends).distinct()
        parts = {f"elements_{c}": apply.elements(rows, self.keyed, c, kind) for c, kind in self._loose()}
        if before:
            parts = {n: collections.merged_cells(self._part(before[-1], n).unionByName(df), self.keyed.key) for n, df in parts.items()}
        # The cells come last: a version counts once they are there.
        self._fs.delete(self._path(f"{self.folder}/v{number}"), True)
        for part, df in (("dead", dead), ("ends", ends), *parts.items(), ("cells", new)):
            df.write.parquet(f"{self.folder}/v{number}/{part}")
        for v in before[:-1]:
            self._fs.delete(self._path(f"{self.folder}/v{v}"), True)

    def read(self) -> DataFrame | None:
        """The rows that exist; none if no batch has come yet."""
        done = self._versions()
        if not done:
            return None
        parts = {c: self._part(done[-1], f"elements_{c}") for c, _ in self._loose()}
        return apply.visible(self._part(done[-1], "cells"), self.keyed, self._part(done[-1], "dead"), self._part(done[-1], "ends"), parts)

    def _loose(self) -> list[tuple[str, str]]:
        """Collections, whose elements are cells of their own."""
        return [(c, kind) for c, kind in self.keyed.collections if kind != "udt"]


def supervise(start: Callable[[], StreamingQuery], attempts: int | None, sleep: Callable[[int], None], stopped: Callable[[], bool] = lambda: False) -> StreamingQuery:
    """Run a query to its end, starting it again after failures, with a pause before each new attempt; without a number of attempts until it is stopped."""
    n = 0
    while attempts is None or n < attempts:
        query = start()
        try:
            query.awaitTermination()
            return query
        except Exception:
            n += 1
            if n == attempts or stopped():
                raise
            sleep(n - 1)
    raise ValueError("no attempts")
