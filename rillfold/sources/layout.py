"""The log laid out for reading: decoded and de-duplicated once, sorted so that filters on time and stream prune.

`write` makes a folder for each generation and vnode, which a reader by task opens alone. `ingested` keeps
one table for all queries of an application: rows are ranged by hour, stream and time, so a window of time
is a few files, a task's window a few row groups of them, and a stream with a third of the log many files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillfold.functions import streamid as si
from rillfold.functions import timeuuid as tu
from rillfold.session import shared_dir, written
from rillfold.sources.log import distinct_rows

#: Rows within so many ticks (an hour) lie together.
BUCKET_TICKS = 36_000_000_000
#: Bytes of the delivered log that go to one file.
FILE_BYTES = 128 << 20

_KEPT: dict[tuple, str] = {}


def write(changes: DataFrame, path: str, files_per_task: int = 1) -> None:
    """Write changes with `generation_ms, vnode, stream_id, ticks, low, batch_seq_no` and any other columns.

    A task's rows go to `files_per_task` files, dealt by time, so a hot task is several units of work. Rows
    without a task are written under the default partition name and found by no task.
    """
    hi, lo = si.order_keys(si.hex_id(F.col("stream_id")))
    part = F.pmod(F.xxhash64("ticks", "low"), F.lit(files_per_task))
    sorted_rows = changes.withColumns({"__hi": hi, "__lo": lo, "__part": part}).repartition("generation_ms", "vnode", "__part").sortWithinPartitions("generation_ms", "vnode", "__part", "__hi", "__lo", "ticks", "batch_seq_no")
    sorted_rows.drop("__hi", "__lo", "__part").write.partitionBy("generation_ms", "vnode").parquet(path)


def table_state(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Time, bytes and number of files of a table, by which a change shows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    summary = fs.getContentSummary(p)
    return fs.getFileStatus(p).getModificationTime(), summary.getLength(), summary.getFileCount()


def ingested(spark: SparkSession, log_path: str, streams_path: str) -> DataFrame:
    """Each log row once, as `distinct_rows` gives it, with `ms, hi, lo` (order of its stream), `generation_ms` and `vnode` of its task.

    Made once per application and state of the two tables, then read like any table: filters on `ticks`,
    `operation` and others reach the scan. An empty log gives no rows; rows without a task have a null one.
    """
    from rillfold.plans.ledger import with_task

    state = table_state(spark, log_path)
    key = (spark.sparkContext.applicationId, log_path, state, streams_path, table_state(spark, streams_path))
    if not written(spark, _KEPT.get(key)):
        hi, lo = si.order_keys(si.hex_id(F.col("stream_id")))
        rows = distinct_rows(spark.read.parquet(log_path)).withColumns({"ms": tu.millis(F.col("ticks")), "hi": hi, "lo": lo})
        tasked = with_task(rows, spark.read.parquet(streams_path)).withColumn("bucket", tu.int_div(F.col("ticks"), BUCKET_TICKS))
        order = ["bucket", "hi", "lo", "ticks", "batch_seq_no"]
        files = max(spark.sparkContext.defaultParallelism, -(-state[1] // FILE_BYTES))
        where = shared_dir(spark, "ingested")
        tasked.repartitionByRange(files, *order).sortWithinPartitions(*order).drop("bucket").write.parquet(where)
        _KEPT[key] = where
    return spark.read.parquet(_KEPT[key])
