"""The current rows of a table from its change log: ordered replay, one state machine per row key.

Changes are partitioned by partition key, sorted by row key and sequence within each partition, and
replayed one after another. Each row of the log carries its sequence (tick count, batch number); a
sequence that was already applied, that is, another copy of a change, is skipped. Deletions of a
partition or of a range of rows travel with the rows: sorted by where they begin, they are kept in a
heap while the sweep over the clustering keys is inside them, and the newest one that covers a row masks
what was written before it.

A partition key with more rows than a unit of work should hold (`UNIT_ROWS`) is split into ranges of clustering
keys, up to 4096. A deletion of many rows goes to the ranges where it begins and ends; of those that cover a range
whole just the newest counts, so they are combined before the shuffle. A single row with so many changes is first reduced
to its newest write, insert and deletion, which is what its replay would keep.

Defined cases: a change without partition key, a row change without clustering key, an unknown operation
or a row without identity changes nothing; pre- and post-images change nothing; a range bound without its
partner changes nothing; a left bound above its right bound covers nothing; of changes with equal sequence
a deletion comes last, of writes one with a value wins over null, and the greater value over the lesser (as in `apply`);
an empty log gives no rows; columns beyond those named are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillfold.session import kept
from rillfold.sources.log import identified

LEAST, MOST = -(1 << 31), (1 << 31) - 1
#: Rows that one unit of work should hold at most, however large the log; in a smaller log a quarter of a task's share, but not less than LEAST_ROWS.
UNIT_ROWS, LEAST_ROWS = 2_000_000, 1000
#: Range ends of hot keys that are broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_BOUNDS = 4_000_000

# Bits of `what`.
WRITE, VALUE, INSERT, DELETE, COVER, IMAGE = 1, 2, 4, 8, 16, 32

SUMMARY = "pk int, ck int, w_ticks bigint, w_seq int, v int, i_ticks bigint, i_seq int, d_ticks bigint, d_seq int"


def row_changes(log: DataFrame) -> DataFrame:
    """`(pk, at, what, v, ticks, seq, low)` of each delivered insert, update and row deletion."""
    op = F.col("`cdc$operation`").cast("int")
    value = F.col("v").isNotNull()
    writes = value | F.coalesce(F.col("`cdc$deleted_v`"), F.lit(False))
    what = F.when(op == 3, F.lit(DELETE)).otherwise(F.when(writes, F.lit(WRITE)).otherwise(F.lit(0)) + F.when(value, F.lit(VALUE)).otherwise(F.lit(0)) + F.when(op == 2, F.lit(INSERT)).otherwise(F.lit(0)))
    rows = identified(log.where(op.isin(1, 2, 3) & F.col("pk").isNotNull() & F.col("ck").isNotNull()), F.col("pk").cast("int").alias("pk"), F.col("ck").cast("bigint").alias("at"), what.alias("what"), F.col("v").cast("int").alias("v"))
    return rows.where("what <> 0").select("pk", "at", F.lit(None).cast("bigint").alias("until"), "what", "v", "ticks", F.col("batch_seq_no").alias("seq"), "low")


def covers(log: DataFrame) -> DataFrame:
    """Deletions of many rows in the same form: they begin at `at` and end with `until`, both included.

    The bounds of a range are paired by stream, time and sequence number: the right bound's is the left's
    plus one. It is an aggregation, so copies of the bounds are combined before the shuffle.
    """
    op = F.col("`cdc$operation`").cast("int")
    bounds = identified(log.where(op.between(5, 8) & F.col("pk").isNotNull()), F.col("pk").cast("int").alias("pk"), op.alias("op"), F.col("ck").cast("bigint").alias("ck"))
    left = F.col("op") <= 6
    first = F.when(left, F.coalesce(F.col("ck") + F.when(F.col("op") == 6, 1).otherwise(0), F.lit(LEAST)))
    last = F.when(~left, F.coalesce(F.col("ck") - F.when(F.col("op") == 8, 1).otherwise(0), F.lit(MOST)))
    ranges = (
        bounds.groupBy("pk", "stream_id", "ticks", "low", F.when(left, F.col("batch_seq_no")).otherwise(F.col("batch_seq_no") - 1).alias("start"))
        .agg(F.max(first.cast("bigint")).alias("at"), F.max(last.cast("bigint")).alias("until"))
        .where(F.col("at") <= F.col("until"))
        .select("pk", "at", "until", (F.col("start") + 1).alias("seq"), "ticks", "low")
    )
    whole = identified(log.where((op == 4) & F.col("pk").isNotNull()), F.col("pk").cast("int").alias("pk")).select("pk", F.lit(LEAST).cast("bigint").alias("at"), F.lit(MOST).cast("bigint").alias("until"), F.col("batch_seq_no").alias("seq"), "ticks", "low")
    return ranges.unionByName(whole).select("pk", "at", "until", F.lit(COVER).alias("what"), F.lit(None).cast("int").alias("v"), "ticks", "seq", "low")


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state machine, over rows sorted by partition key, chunk, position, deletions of many rows first, and sequence."""
    schema = pa.schema([("pk", pa.int32()), ("ck", pa.int32()), ("w_ticks", pa.int64()), ("w_seq", pa.int32()), ("v", pa.int32()), ("i_ticks", pa.int64()), ("i_seq", pa.int32()), ("d_ticks", pa.int64()), ("d_seq", pa.int32())])
    out: list[tuple] = []
    group = key = None
    active: list[tuple] = []
    write = insert = delete = applied = value = None

    def close() -> None:
        """The row at `key` is complete: the newest deletion that covers it masks its writes."""
        nonlocal delete
        while active and active[0][2] < key:
            heapq.heappop(active)
        if active and (delete is None or (-active[0][0], -active[0][1]) > delete):
            delete = (-active[0][0], -active[0][1])
        w, i = write, insert
        if delete is not None:
            w = w if w is not None and w > delete else None
            i = i if i is not None and i > delete else None
        out.append((group[0], key, *(w or (None, None)), value if w else None, *(i or (None, None)), *(delete or (None, None))))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * len(schema)
        batch = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
        out.clear()
        return batch

    for batch in batches:
        columns = [batch.column(i).to_pylist() if batch.column(i).null_count or not pa.types.is_integer(batch.column(i).type) else batch.column(i).to_numpy().tolist() for i in range(batch.num_columns)]
        for pk, chunk, at, until, what, v, ticks, seq, low in zip(*columns):
            if (pk, chunk) != group:
                if key is not None:
                    close()
                group, key, active = (pk, chunk), None, []
            if what == COVER:
                if key is not None and at > key:
                    close()
                    key = None
                # Ended deletions leave only from the top; those below a newer one never matter while it lasts.
                heapq.heappush(active, (-ticks, -seq, until))
                continue
            if at != key:
                if key is not None:
                    close()
                key, write, insert, delete, applied, value = at, None, None, None, None, None
            if (ticks, seq, low, what) == applied:
                continue
            applied = (ticks, seq, low, what)
            if what == DELETE:
                delete, write, insert, value = (ticks, seq), None, None, None
                continue
            if what & INSERT:
                insert = (ticks, seq)
            if what & WRITE:
                write, value = (ticks, seq), v if what & VALUE else None
        if len(out) >= 20000:
            yield flush()
    if key is not None:
        close()
    yield flush()


@dataclass(frozen=True)
class _Hot:
    """Partition keys with more rows than a unit of work should hold: ends of ranges of their clustering keys, and single rows with so many changes."""

    bounds: DataFrame
    levels: int
    rows: DataFrame | None

    def with_bounds(self, df: DataFrame) -> DataFrame:
        return df.join(self.bounds, "pk", "left")

    def chunk(self, c: str) -> Column:
        return F.when(F.col("bounds").isNull(), F.lit(0)).otherwise(_bucket(F.col("bounds"), F.col(c), self.levels)).cast("int")


def _hot(log: DataFrame) -> _Hot | None:
    """One pass over the partition keys, and one over the clustering keys of the hot ones; sizes may be those of delivered copies."""
    parallel = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    unit = max(LEAST_ROWS, min(UNIT_ROWS, log.count() // (4 * parallel)))
    keys = log.where("pk is not null").select(F.col("pk").cast("int").alias("pk"), F.col("ck").cast("bigint").alias("at"))
    hot = kept(keys.groupBy("pk").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > unit), "replay")
    n, most = hot.agg(F.count(F.lit(1)), F.max("n")).first()
    if n == 0:
        return None
    levels = next((i for i in (1, 2) if 16**i >= most / unit), 3)
    few = n * 16**levels <= BROADCAST_BOUNDS
    fractions = [k / 16**levels for k in range(1, 16**levels)]
    own = keys.where("at is not null").join(F.broadcast(hot.select("pk")) if few else hot.select("pk"), "pk", "left_semi")
    bounds = kept(own.groupBy("pk").agg(F.percentile_approx("at", fractions, 4 * 16**levels).alias("bounds")), "replay")
    # A row with more changes than a range should hold is the end of several ranges.
    rows = kept(bounds.select("pk", F.explode("bounds").alias("at")).groupBy("pk", "at").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("pk", "at"), "replay")
    some = rows.count()
    return _Hot(F.broadcast(bounds) if few else bounds, levels, (F.broadcast(rows) if some <= BROADCAST_BOUNDS else rows) if some else None)


def _bucket(bounds: Column, at: Column, levels: int) -> Column:
    """The number of bounds below `at`, found digit by digit to base 16."""

    def below(base: Column, stride: int) -> Column:
        return F.size(F.filter(F.sequence(F.lit(1), F.lit(15)), lambda k: F.element_at(bounds, base + k * stride) < at))

    return reduce(lambda base, level: base + below(base, 16**level) * 16**level, reversed(range(levels)), F.lit(0))


def _chunked(hot: _Hot | None, rows: DataFrame, tombs: DataFrame, newest_only: bool) -> tuple[DataFrame, DataFrame]:
    """Rows and deletions of many rows with `chunk`, a range of clustering keys of a hot partition key.

    Chunks end at quantiles of the key's changes. A deletion goes to the chunks where it begins and ends; of those
    that cover a chunk whole just the newest matters for the last state (newest_only), and they are combined before the shuffle.
    """
    if hot is None:
        return rows.withColumn("chunk", F.lit(0)), tombs.withColumn("chunk", F.lit(0))
    rows = hot.with_bounds(rows).withColumn("chunk", hot.chunk("at")).drop("bounds")
    ends = hot.with_bounds(tombs).withColumns({"first": hot.chunk("at"), "last": hot.chunk("until")}).drop("bounds")
    if not newest_only:
        return rows, ends.withColumn("chunk", F.explode(F.sequence("first", "last"))).drop("first", "last")
    partly = ends.withColumn("chunk", F.explode(F.array_distinct(F.array("first", "last"))))
    across = ends.where(F.col("last") > F.col("first") + 1).withColumn("chunk", F.explode(F.sequence(F.col("first") + 1, F.col("last") - 1)))
    newest = across.groupBy("pk", "chunk").agg(F.max(F.struct("ticks", "seq", "low")).alias("d"))
    whole = newest.select("pk", F.lit(LEAST).cast("bigint").alias("at"), F.lit(MOST).cast("bigint").alias("until"), F.lit(COVER).alias("what"), F.lit(None).cast("int").alias("v"), "d.ticks", "d.seq", "d.low", "chunk")
    return rows, partly.drop("first", "last").unionByName(whole)


def _without_hot_rows(hot: _Hot | None, rows: DataFrame) -> DataFrame:
    """Changes with those of any single hot row reduced, before the shuffle, to its newest write, insert and deletion."""
    if hot is None or hot.rows is None:
        return rows
    what = F.col("what")
    place = F.struct("ticks", "seq", what.bitwiseAND(F.lit(VALUE)).alias("has"), "v", "low", "what")
    bit = lambda b: F.max(F.when(what.bitwiseAND(F.lit(b)) != 0, place))
    one = rows.join(hot.rows, ["pk", "at"], "left_semi").groupBy("pk", "at").agg(F.array_distinct(F.array_compact(F.array(bit(WRITE), bit(INSERT), bit(DELETE)))).alias("c"))
    one = one.select("pk", "at", F.lit(None).cast("bigint").alias("until"), F.explode("c").alias("c")).select("pk", "at", "until", "c.what", "c.v", "c.ticks", "c.seq", "c.low")
    return rows.join(hot.rows, ["pk", "at"], "left_anti").unionByName(one)


def _in_order(rows: DataFrame, tombs: DataFrame) -> DataFrame:
    """Partitioned by partition key and chunk, sorted by row key and sequence."""
    columns = ["pk", "chunk", "at", "until", "what", "v", "ticks", "seq", "low"]
    changes = rows.select(*columns).unionByName(tombs.select(*columns))
    return changes.repartition("pk", "chunk").sortWithinPartitions("pk", "chunk", "at", F.col("what") != COVER, "ticks", "seq", F.col("what") == DELETE, F.col("what").bitwiseAND(F.lit(VALUE)), "v", "low")


def replay(log: DataFrame) -> DataFrame:
    """`(pk int, ck int, v int)`: the rows that exist after all changes, `v` null for a row without value."""
    hot = _hot(log)
    rows, tombs = _chunked(hot, _without_hot_rows(hot, row_changes(log)), covers(log), newest_only=True)
    parts = _in_order(rows, tombs).mapInArrow(_replayed, SUMMARY)
    return parts.where(F.col("v").isNotNull() | F.col("i_ticks").isNotNull()).select("pk", "ck", "v")


MISMATCH = "pk int, ck int, ticks bigint, seq int, low binary, expected int, actual int, found boolean"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state machine again, for images: each is compared with the row as it was just before."""
    schema = pa.schema([("pk", pa.int32()), ("ck", pa.int32()), ("ticks", pa.int64()), ("seq", pa.int32()), ("low", pa.binary()), ("expected", pa.int32()), ("actual", pa.int32()), ("found", pa.bool_())])
    out: list[tuple] = []
    group = key = None
    active: list[tuple] = []
    write = insert = applied = value = None

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * len(schema)
        batch = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
        out.clear()
        return batch

    for batch in batches:
        for pk, chunk, at, until, what, v, ticks, seq, low in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            if (pk, chunk) != group:
                group, key, active = (pk, chunk), None, []
            if what == COVER:
                insort(active, (ticks, seq, until))
                continue
            if at != key:
                key, write, insert, applied, value = at, None, None, None, None
            if (ticks, seq, low, what) == applied:
                continue
            applied = (ticks, seq, low, what)
            if what & IMAGE:
                k = bisect_left(active, (ticks, seq)) - 1
                while k >= 0 and active[k][2] < key:  # ended before this row: met once, then out of the way
                    del active[k]
                    k -= 1
                gone = active[k][:2] if k >= 0 else None
                w = write if gone is None or (write is not None and write > gone) else None
                i = insert if gone is None or (insert is not None and insert > gone) else None
                actual = value if w is not None else None
                if actual != v:
                    out.append((pk, key, ticks, seq, low, v, actual, i is not None or actual is not None))
                continue
            if what == DELETE:
                write, insert, value = None, None, None
                continue
            if what & INSERT:
                insert = (ticks, seq)
            if what & WRITE:
                write, value = (ticks, seq), v if what & VALUE else None
        if len(out) >= 20000:
            yield flush()
    yield flush()


def image_mismatches(log: DataFrame) -> DataFrame:
    """`MISMATCH`: pre-images whose value isn't that of the row before them. `found` tells whether the row existed.

    The same partitioning and order as `replay`; since an image sees the past, every deletion goes to each chunk that it touches.
    The changes of one row are compared in one task: its images and what they see are one sequence.
    """
    op = F.col("`cdc$operation`").cast("int")
    images = identified(log.where((op == 0) & F.col("pk").isNotNull() & F.col("ck").isNotNull()), F.col("pk").cast("int").alias("pk"), F.col("ck").cast("bigint").alias("at"), F.col("v").cast("int").alias("v"))
    probes = images.select("pk", "at", F.lit(None).cast("bigint").alias("until"), F.lit(IMAGE).alias("what"), "v", "ticks", F.col("batch_seq_no").alias("seq"), "low")
    rows, tombs = _chunked(_hot(log), row_changes(log).unionByName(probes), covers(log), newest_only=False)
    return _in_order(rows, tombs).mapInArrow(_compared, MISMATCH)
