"""Exactly one copy of each log row out of an at-least-once delivery.

A streaming aggregation keeps, for each identifier it has seen, the best copy so far: the one with
the earliest arrival, of equal ones the lowest delivery id. Its state lives in a keyed state store
(RocksDB, so it isn't bound by the executors' heap), expires behind an event-time watermark, and is
committed with the same micro-batch that wrote the output (a replayed batch overwrites its own folder). Copies are
combined before the shuffle, so an identifier delivered very often costs a map task one row.

A run has three steps, each restartable:

1. New files of the log are decoded and laid out by period of arrival (a stream without state, so each file is read once).
2. The periods go to the stateful stream one after another, a micro-batch each, so batches come in order of arrival and
   state expires while they do. Each micro-batch appends to a ledger the identifiers it touched, with their best copy.
3. The copies of this run that the ledger doesn't name are dropped. A copy that arrives more than `delay_s` after its
   event can't count on finding state: it has an event time of its own, so that the watermark never drops
   it, is marked late, and is looked up in the ledger; so is one that arrived before the end of an earlier run.

Only step 3's lookups read what earlier runs wrote, and only within the ticks of the identifiers looked up. Should the
watermark drop rows all the same, or a run break off, the copies of that run that may have been dropped are looked up as well.

Defined cases: a copy without identity (null or unreadable stream, time or sequence number) has no
duplicate and stays; a null arrival is later than any other, a null delivery id larger than any other;
copies with a null delivery id can't be named as dropped, but `deduplicated` leaves them out; an empty log gives no rows.
"""

from __future__ import annotations

import contextlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillfold.folder import SharedFolder
from rillfold.functions import timeuuid as tu
from rillfold.session import shared_dir
from rillfold.sources.log import IDENTITY, has_identity, identified, micros_of

#: Up to so many identifiers to look up (about 60 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000
LAST = (1 << 63) - 1
#: A copy that arrives later than so long after its event is looked up; arrivals of as long make a micro-batch.
DELAY_S = 3 * 86400
RUNS = "run int, batch bigint, arrived bigint, mark bigint"
COPY = "ticks bigint, low binary, batch_seq_no int, stream_id binary, arrived bigint, delivery_id bigint"
LEDGER = "ticks bigint, low binary, batch_seq_no int, stream_id binary, late boolean, arrived bigint, delivery_id bigint, batch bigint"
DROPPED = "delivery_id bigint, run int"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class DedupRun:
    """What is known after a run: its folder and number (-1 if there never was anything to do), and the micro-batches, lost rows and lookups of this run."""

    folder: str
    run: int
    batches: int
    lost: int
    looked_up: int


@contextlib.contextmanager
def settings(spark: SparkSession, **pairs: str):
    """Session settings for the length of a streaming run."""
    old = {k: spark.conf.get(k, None) for k in pairs}
    for k, v in pairs.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _pattern(path: str) -> str:
    """A pattern that only `path` matches: a stream reads a pattern, unlike a path, also if it is one file."""
    return f"{path[:-1]}[{path[-1]}]"


def keyed_copies(log: DataFrame) -> DataFrame:
    """`COPY` of each copy with an identity."""
    return identified(log, F.coalesce(micros_of(F.col("received_at")), F.lit(LAST)).alias("arrived"), F.coalesce(F.col("delivery_id"), F.lit(LAST)).alias("delivery_id"))


def _expiry(delay_s: int) -> Column:
    """The event-time column of a copy: not the time of the event for a late one."""
    event = tu.micros(F.col("ticks"))
    horizon = F.col("arrived") - F.lit(delay_s * 1_000_000)
    late = (F.col("arrived") != LAST) & (horizon > event)
    return F.timestamp_micros(F.when(late, horizon).otherwise(event))


def _lay_out(spark: SparkSession, path: str, at: SharedFolder, period_s: int, max_files: int | None) -> None:
    """Step 1: new files of the log, decoded, in `arrived/<n>/period=<p>`."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    copies = keyed_copies((reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(_pattern(path)))
    period = F.when(F.col("arrived") != LAST, tu.int_div(F.col("arrived"), period_s * 1_000_000)).otherwise(F.lit(LAST))

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("period", period).write.mode("overwrite").option("compression", "zstd").partitionBy("period").parquet(f"{at.folder}/arrived/{number:09d}")

    copies.writeStream.option("checkpointLocation", f"{at.folder}/laid-out").foreachBatch(save).trigger(availableNow=True).start().awaitTermination()


def _feed(spark: SparkSession, at: SharedFolder, delay_s: int) -> tuple[int, int, int]:
    """Step 2: one micro-batch for each period. Rows that the watermark dropped, the last watermark in ms, and the number of micro-batches."""
    rows = spark.readStream.schema(COPY).parquet(f"{at.folder}/feed/*").withColumn("expires_at", _expiry(delay_s))
    seen = rows.withWatermark("expires_at", f"{delay_s + 1} seconds").groupBy(*IDENTITY, "expires_at").agg(F.min(F.struct("arrived", "delivery_id")).alias("copy"))

    def save(batch: DataFrame, number: int) -> None:
        batch.select(*IDENTITY, (F.unix_micros("expires_at") != tu.micros(F.col("ticks"))).alias("late"), "copy.arrived", "copy.delivery_id").write.mode("overwrite").option("compression", "zstd").parquet(f"{at.folder}/ledger/batch={number}")

    query = seen.writeStream.outputMode("update").option("checkpointLocation", f"{at.folder}/checkpoint").foreachBatch(save).start()
    try:
        query.processAllAvailable()  # what a run that broke off had left
        for n in at.names("arrived"):
            for p in sorted(at.names(f"arrived/{n}"), key=lambda x: int(x.removeprefix("period="))):
                at.move(f"arrived/{n}/{p}", f"feed/{n}-{p.removeprefix('period=')}")
                query.processAllAvailable()
            at.delete(f"arrived/{n}")
    finally:
        query.stop()
    if query.exception():
        raise query.exception()
    done = [p for p in query.recentProgress if p["numInputRows"]]
    marks = [p["eventTime"]["watermark"] for p in done if "watermark" in (p["eventTime"] or {})]
    mark = spark.sql(f"select unix_millis(timestamp'{max(marks)}')").first()[0] if marks else 0
    return sum(s["numRowsDroppedByWatermark"] for p in done for s in p["stateOperators"]), mark, len(done)


def run_dedup(spark: SparkSession, path: str, *, folder: str | None = None, delay_s: int = DELAY_S, period_s: int | None = None, max_files: int | None = None) -> DedupRun:
    """Take everything that the log at `path` holds and no earlier run with this `folder` has taken; its dropped copies are in `dropped/run=<n>`."""
    at = SharedFolder(spark, folder or shared_dir(spark, "dedup"))
    for name in ("feed", "arrived"):
        at.make(name)
    last = at.table("runs", RUNS).orderBy(F.col("run").desc()).first()
    broken = bool(at.names("feed"))
    conf = {"spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.streaming.numRecentProgressUpdates": "100000", "spark.sql.streaming.stateStore.providerClass": STATE_STORE, "spark.sql.streaming.minBatchesToRetain": "2", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    with settings(spark, **conf):
        _lay_out(spark, path, at, period_s or delay_s, max_files)
        if not (broken or at.names("arrived")):
            return DedupRun(at.folder, last["run"] if last else -1, 0, 0, 0)
        lost, mark, batches = _feed(spark, at, delay_s)
    number = last["run"] + 1 if last else 0
    fed = [f"{at.folder}/feed/{x}" for x in at.names("feed")]
    copies = spark.read.schema(COPY).parquet(*fed) if fed else spark.createDataFrame([], COPY)
    ledger = at.table("ledger", LEDGER)
    mine = ledger.where(F.col("batch") > F.lit(last["batch"] if last else -1))
    straggling = None
    if lost or broken:  # compared exactly: whatever the watermark may have dropped
        maybe = F.lit(True) if broken else _expiry(delay_s) <= F.timestamp_millis(F.lit(mark))
        straggling = copies.where(maybe).select(*IDENTITY, F.lit(True).alias("late"), "arrived", "delivery_id")
    entries = mine.drop("batch") if straggling is None else mine.drop("batch").unionByName(straggling)
    unnamed = copies.where(F.col("delivery_id") != LAST).select("delivery_id").join(entries.select("delivery_id"), "delivery_id", "left_anti")
    beaten, looked_up = _beaten(entries, ledger.where(F.col("batch") <= F.lit(last["batch"])) if last else None, last["arrived"] if last else None)
    unnamed.unionByName(beaten).write.mode("overwrite").parquet(f"{at.folder}/dropped/run={number}")
    ends = copies.agg(F.max("arrived")).first()[0]
    top = ledger.agg(F.max("batch")).first()[0]
    done = (number, top if top is not None else -1, max(x for x in (ends, last["arrived"] if last else None, -LAST) if x is not None), mark)
    spark.createDataFrame([done], RUNS).coalesce(1).write.mode("append").parquet(f"{at.folder}/runs")
    for name in at.names("feed"):
        at.delete(f"feed/{name}")
    if folder is None:  # no other run will go on from here
        for name in ("checkpoint", "laid-out"):
            at.delete(name)
    return DedupRun(at.folder, number, batches, lost, looked_up)


def _beaten(entries: DataFrame, earlier: DataFrame | None, since: int | None) -> tuple[DataFrame, int]:
    """`delivery_id` of entries, of this run or earlier ones, that another entry of the same identifier beats, and how many identifiers were looked up.

    Only those are looked up that are late, or whose best copy arrived before the end of an earlier run (`since`): all others have one
    entry, or several in order of arrival that say the same.
    """
    doubtful = F.col("late") if since is None else F.col("late") | (F.col("arrived") <= since)
    some = entries.where(doubtful).select(*IDENTITY).distinct()
    size = some.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.min("ticks"), F.max("ticks")).first()
    if size[0] == 0:
        return entries.select("delivery_id").limit(0), 0
    few = size[0] <= BROADCAST_ROWS
    known = entries.drop("late")
    if earlier is not None:
        known = known.unionByName((earlier.where(F.col("ticks").between(size[1], size[2])) if few else earlier).drop("late", "batch"))
    contested = known.join(F.broadcast(some) if few else some, IDENTITY, "left_semi").select(*IDENTITY, F.struct("arrived", "delivery_id").alias("copy")).distinct()
    best = contested.groupBy(*IDENTITY).agg(F.min("copy").alias("best"), F.max("copy").alias("worst")).where(F.col("best.delivery_id") != F.col("worst.delivery_id"))
    beaten = contested.join(best, IDENTITY).where((F.col("copy.delivery_id") != F.col("best.delivery_id")) & (F.col("copy.delivery_id") != LAST))
    return beaten.select("copy.delivery_id").distinct(), size[0]


def read_ledger(spark: SparkSession, run: DedupRun) -> DataFrame:
    return SharedFolder(spark, run.folder).table("ledger", LEDGER)


def dropped_of(spark: SparkSession, run: DedupRun, only: int | None = None) -> DataFrame:
    """`(delivery_id bigint)` of the copies that the runs of a folder dropped, or that run `only` did."""
    rows = SharedFolder(spark, run.folder).table("dropped", DROPPED)
    # A later run can name again what an earlier one has dropped.
    if only is not None:
        return rows.where(F.col("run") == only).select("delivery_id").join(rows.where(F.col("run") < only).select("delivery_id"), "delivery_id", "left_anti")
    return rows.select("delivery_id").distinct() if run.run > 0 else rows.select("delivery_id")


def dropped_copies(spark: SparkSession, path: str, **options) -> DataFrame:
    """`(delivery_id bigint)` of the copies to be dropped from the log at `path`."""
    return dropped_of(spark, run_dedup(spark, path, **options))


def deduplicated(spark: SparkSession, path: str, **options) -> DataFrame:
    """The log with exactly one copy of each log row, and all rows without identity."""
    run = run_dedup(spark, path, **options)
    log = spark.read.parquet(path)
    columns = [F.col(f"`{c}`") for c in log.columns]
    named = log.join(dropped_of(spark, run), "delivery_id", "left_anti").select(*columns)
    nameless = F.col("delivery_id").isNull() & F.coalesce(has_identity(), F.lit(False))
    if log.where(nameless).limit(1).count() == 0:
        return named
    # Copies without delivery id can only be told by identity: one stays where no copy has an id.
    best = read_ledger(spark, run).groupBy(*IDENTITY).agg(F.min("delivery_id").alias("__id"))
    whole = identified(log.where(nameless), F.coalesce(micros_of(F.col("received_at")), F.lit(LAST)).alias("__arrived"), F.struct(*columns).alias("__row"))
    one = whole.groupBy(*IDENTITY).agg(F.min_by("__row", "__arrived").alias("__row")).join(best, IDENTITY).where(F.col("__id") == LAST)
    return named.where(~nameless).unionByName(one.select(*[F.col(f"__row.`{c}`").alias(c) for c in log.columns]))
