"""Incremental processing: a ledger of work items, and the changes that no run has taken.

A work item is a window of a task. It is *pending*, *leased* by a worker until a time, or *done*. Each
lease carries a fencing token, one higher than any earlier token of the item; only the holder of the
current token may finish it or hand over part of it. Expired leases return to pending. Output goes to a path made from item and
token, so a retry replaces its own output and a stale writer can't touch another's.

`WorkLedger` keeps such a ledger in the shared folder, and with each state what was handed over under which token;
`WorkLedger.take_over` puts a history of attempts into it, and `untaken` gives the log rows that, by the ledger, no attempt has taken.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillfold.folder import SharedFolder
from rillfold.functions import streamid as si
from rillfold.functions import timeuuid as tu
from rillfold.operators.hotkeys import sketch
from rillfold.sources.log import IDENTITY, arrivals, micros_of

#: A stream table of up to so many rows (about 64 bytes each) is broadcast; a larger one is joined by shuffle, hot streams with salt.
BROADCAST_ROWS = 500_000
#: A stream with at least this share of the changes gets salts.
HEAVY = 0.005
#: Versions of the ledger that stay readable after a newer one is published.
READABLE = 4

KEY = ["task_id", "window_start_ms", "window_end_ms"]
ITEM = "task_id string, window_start_ms bigint, window_end_ms bigint"
LEDGER = f"{ITEM}, state string, owner string, token bigint, lease_until_ms bigint, output string"
#: What a token handed over: all changes of its window that had arrived by `read_us`, or, where there is a last change, those up to it.
HANDED = f"{ITEM}, token bigint, read_us bigint, last_hi bigint, last_lo bigint, last_ticks bigint"


class StaleLease(RuntimeError):
    """The writer's fencing token isn't the current one of the item, or its lease has expired."""


@dataclass(frozen=True)
class Lease:
    task_id: str
    window_start_ms: int
    window_end_ms: int
    token: int
    output: str

    @property
    def key(self) -> tuple[str, int, int]:
        return self.task_id, self.window_start_ms, self.window_end_ms


class WorkLedger:
    """The ledger as versions, each a small file that names its parts: tables of items, the newer row of an item being its state, and tables of what was handed over.

    A change reads the newest version, writes the rows it changes as parts of their own, and publishes the next
    version by renaming its file into place, which fails if another writer was first; the change is then made
    again upon what that writer left. A crash at any step before the rename leaves the former version in force. Small
    parts are merged into larger ones as they come, so that n changes cost about n log n rows; parts that no version in use names are deleted.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self._at = spark, SharedFolder(spark, folder)
        self.folder = self._at.folder
        self._at.make("versions")

    def _version(self) -> tuple[int, dict]:
        n = max((int(x) for x in self._at.names("versions") if x.isdigit()), default=-1)
        return n, json.loads(self._at.text(f"versions/{n}")) if n >= 0 else {"items": [], "handed": []}

    def _items(self, parts: list) -> DataFrame:
        """The newest row of each item. Parts are numbered by the version that wrote them."""
        if not parts:
            return self.spark.createDataFrame([], LEDGER)
        all_parts = [self.spark.read.schema(LEDGER).parquet(f"{self.folder}/{p['path']}").withColumn("__v", F.lit(p["version"])) for p in parts]
        if len(parts) == 1:
            return all_parts[0].drop("__v")
        rows = all_parts[0]
        for p in all_parts[1:]:
            rows = rows.unionByName(p)
        rest = [c for c in rows.columns if c not in (*KEY, "__v")]
        return rows.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "__v").alias("r")).select(*KEY, "r.*")

    def read(self) -> DataFrame:
        return self._items(self._version()[1]["items"])

    def handed(self) -> DataFrame:
        """`HANDED` of all tokens."""
        parts = self._version()[1]["handed"]
        return self.spark.read.schema(HANDED).parquet(*[f"{self.folder}/{p['path']}" for p in parts]) if parts else self.spark.createDataFrame([], HANDED)

    def _write(self, rows: DataFrame, version: int) -> dict:
        path = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{path}")
        return {"path": path, "version": version, "rows": self.spark.read.parquet(f"{self.folder}/{path}").count()}

    def _merged(self, kind: str, parts: list, version: int) -> list:
        """Parts with the last few made one where those before aren't much larger, so there are about log n of them."""
        k, total = len(parts), 0
        while k and parts[k - 1]["rows"] <= 2 * max(total, 8):
            total += parts[k - 1]["rows"]
            k -= 1
        if len(parts) - k < 4:
            return parts
        tail = parts[k:]
        rows = self._items(tail) if kind == "items" else self.spark.read.schema(HANDED).parquet(*[f"{self.folder}/{p['path']}" for p in tail])
        return [*parts[:k], self._write(rows.coalesce(max(1, total // 1_000_000)), version)]

    def _change(self, change: Callable[[DataFrame], tuple[DataFrame | None, DataFrame | None]], attempts: int = 20) -> None:
        """Publish the rows of items, and of what was handed over, that `change` makes of the present items."""
        for _ in range(attempts):
            n, now = self._version()
            new = dict(zip(("items", "handed"), change(self._items(now["items"]))))
            if all(v is None for v in new.values()):
                return
            after = {k: self._merged(k, [*now[k], self._write(v, n + 1)], n + 1) if v is not None else now[k] for k, v in new.items()}
            if self._at.publish(f"versions/{n + 1}", json.dumps(after)):
                self._clean(n + 1)
                return
            for k, parts in after.items():  # what was written upon the version that lost
                for p in parts:
                    if p not in now[k]:
                        self._at.delete(p["path"])
        raise RuntimeError("the ledger is too contended")

    def _clean(self, newest: int) -> None:
        """Delete versions that are out of use, and the parts that only they name."""
        old = [v for v in self._at.names("versions") if v.isdigit() and int(v) <= newest - READABLE]
        if not old:
            return
        paths = lambda v: {p["path"] for parts in json.loads(self._at.text(f"versions/{v}") or "{}").values() for p in parts}
        gone = set().union(*map(paths, old))
        used = set().union(*(paths(v) for v in self._at.names("versions") if v.isdigit() and int(v) > newest - READABLE))
        for p in gone - used:
            self._at.delete(p)
        for v in old:
            self._at.delete(f"versions/{v}")

    def _rows(self, rows: Iterable[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(list(rows), schema).coalesce(1)

    def add(self, items: DataFrame) -> None:
        """Items not yet known become pending; known ones stay as they are."""

        def change(now: DataFrame):
            new = items.select(*KEY).distinct().join(now, KEY, "left_anti")
            return new.select(*KEY, F.lit("pending").alias("state"), F.lit(None).cast("string").alias("owner"), F.lit(0).cast("bigint").alias("token"), F.lit(None).cast("bigint").alias("lease_until_ms"), F.lit(None).cast("string").alias("output")), None

        self._change(change)

    def take_over(self, task_runs: DataFrame, now_ms: int, lease_ms: int) -> None:
        """Put a history of attempts in place of what the ledger holds: the items by `from_attempts`, and what each token handed over.

        An attempt whose end is recorded was the holder of its token then. A succeeded one handed over its window, a failed
        one the changes up to its last; others nothing. Attempts of one item are numbered in the order in which they read.
        """
        runs = attempts(task_runs).where(F.col("window_start_ms") < F.col("window_end_ms"))
        items = from_attempts(task_runs, now_ms, lease_ms)
        states = items.select(*KEY, "state", F.lit(None).cast("string").alias("owner"), "token", F.when(F.col("state") == "leased", F.lit(now_ms + lease_ms)).alias("lease_until_ms"), F.lit(None).cast("string").alias("output"))
        whole = F.col("status") == "succeeded"
        part = (F.col("status") == "failed") & F.col("last_ticks").isNotNull() & F.col("last_hi").isNotNull()
        last = [F.when(~whole, F.col(c)).alias(c) for c in ("last_hi", "last_lo", "last_ticks")]
        # Of attempts that handed over up to the same change, the latest reader's covers the others'.
        handed = runs.where(whole | part).select(*KEY, F.col("run_id").alias("token"), "read_us", *last).groupBy(*KEY, "last_hi", "last_lo", "last_ticks").agg(F.max("token").alias("token"), F.max("read_us").alias("read_us"))
        n, _ = self._version()
        after = {"items": [self._write(states, n + 1)], "handed": [self._write(handed.select("task_id", "window_start_ms", "window_end_ms", "token", "read_us", "last_hi", "last_lo", "last_ticks"), n + 1)]}
        if not self._at.publish(f"versions/{n + 1}", json.dumps(after)):
            raise RuntimeError("another writer changed the ledger meanwhile")

    def claim(self, owner: str, n: int, now_ms: int, lease_ms: int) -> list[Lease]:
        """Lease the `n` earliest items that are pending or whose lease has expired."""
        free = (F.col("state") == "pending") | ((F.col("state") == "leased") & (F.col("lease_until_ms") <= now_ms))
        mine: list[Lease] = []

        def change(now: DataFrame):
            chosen = now.where(free).orderBy("window_start_ms", "task_id", "window_end_ms").limit(n).select(*KEY, "token").collect()
            mine[:] = [Lease(r.task_id, r.window_start_ms, r.window_end_ms, r.token + 1, f"{self.folder}/output/{''.join(c if c.isalnum() or c in '._-' else '_' for c in r.task_id)}/{r.window_start_ms}-{r.window_end_ms}-{r.token + 1}") for r in chosen]
            return self._rows([(*x.key, "leased", owner, x.token, now_ms + lease_ms, x.output) for x in mine], LEDGER) if mine else None, None

        self._change(change)
        return sorted(mine, key=lambda x: (x.window_start_ms, x.task_id))

    def _end(self, lease: Lease, now_ms: int, state: str, handed: tuple | None) -> None:
        this = (F.col("task_id") == lease.task_id) & (F.col("window_start_ms") == lease.window_start_ms) & (F.col("window_end_ms") == lease.window_end_ms)

        def change(now: DataFrame):
            row = now.where(this).first()
            current = row is not None and row.token == lease.token
            if current and row.state == "done" and state == "done":
                return None, None
            if not current or row.state != "leased" or row.lease_until_ms <= now_ms:
                raise StaleLease(f"{lease.task_id} {lease.window_start_ms} token {lease.token}")
            item = self._rows([(*lease.key, state, row.owner, lease.token, row.lease_until_ms if state == "done" else None, lease.output)], LEDGER)
            return item, self._rows([(*lease.key, lease.token, *handed)], HANDED) if handed else None

        self._change(change)

    def finish(self, lease: Lease, now_ms: int, read_us: int | None = None) -> None:
        """Mark the item done; all changes of its window that had arrived by `read_us` (now, by default) are handed over.

        Repeating a finish with the same token changes nothing; another token, or an expired lease, is refused.
        """
        self._end(lease, now_ms, "done", (now_ms * 1000 if read_us is None else read_us, None, None, None))

    def fail(self, lease: Lease, now_ms: int, read_us: int, last_stream: bytes | None = None, last_ticks: int | None = None) -> None:
        """Give the item back; the changes up to the last one named are handed over. A stale holder is refused."""
        words = [int.from_bytes(last_stream[k : k + 8], "big", signed=True) ^ si.SIGN_FLIP for k in (0, 8)] if last_stream else None
        self._end(lease, now_ms, "pending", (read_us, *words, last_ticks) if words and last_ticks is not None else None)

    def reopen(self, items: DataFrame) -> None:
        """Done items for which changes arrived after they were read are pending again; others stay as they are."""

        def change(now: DataFrame):
            late = now.where("state = 'done'").join(items.select(*KEY).distinct(), KEY, "left_semi")
            return late.withColumns({"state": F.lit("pending"), "lease_until_ms": F.lit(None).cast("bigint")}), None

        self._change(change)

    def expire(self, now_ms: int) -> None:
        """Leases that ended by `now_ms` return to pending; their tokens stay used."""
        self._change(lambda now: (now.where((F.col("state") == "leased") & (F.col("lease_until_ms") <= now_ms)).withColumn("state", F.lit("pending")), None))


def task_parts(task_id: Column) -> tuple[Column, Column, Column]:
    """Table name, generation start and vnode of `keyspace.table:generation start ms:vnode`; null where it isn't one."""
    part = lambda i: F.regexp_extract(task_id, r"^([^:]+):(\d+):(\d+)$", i)
    return F.nullif(part(1), F.lit("")), F.nullif(part(2), F.lit("")).try_cast("bigint"), F.nullif(part(3), F.lit("")).try_cast("int")


def attempts(task_runs: DataFrame) -> DataFrame:
    """Distinct attempts. Rows without task, window or read time say nothing and are left out."""
    name, generation, vnode = task_parts(F.col("task_id"))
    last = F.lower(F.hex("last_change_stream_id"))
    hi, lo = si.order_keys(last)
    return (
        task_runs.where("window_start_ms is not null and window_end_ms is not null and read_at is not null")
        .select("run_id", "task_id", name.alias("table_name"), generation.alias("generation_ms"), vnode.alias("vnode"), "window_start_ms", "window_end_ms", micros_of(F.col("read_at")).alias("read_us"), F.lower("status").alias("status"), hi.alias("last_hi"), lo.alias("last_lo"), tu.ticks(F.col("last_change_time")).alias("last_ticks"))
        .where("generation_ms is not null and vnode is not null")
        .distinct()
    )


def from_attempts(task_runs: DataFrame, now_ms: int, lease_ms: int) -> DataFrame:
    """The ledger that a history of attempts amounts to: one row for each work item.

    An item is done if an attempt succeeded, leased while an attempt runs that began less than
    `lease_ms` before `now_ms`, and else pending. Its token is the number of distinct attempts.
    `resume_run_id` is the last failed attempt that had handed over a change, from which a pending item goes on.
    """
    runs = attempts(task_runs)
    live = (F.col("status") == "running") & (F.col("read_us") + lease_ms * 1000 > now_ms * 1000)
    partial = (F.col("status") == "failed") & F.col("last_ticks").isNotNull()
    return (
        runs.groupBy("task_id", "window_start_ms", "window_end_ms")
        .agg(F.count_distinct("run_id").alias("token"), F.max((F.col("status") == "succeeded").cast("int")).alias("won"), F.max(live.cast("int")).alias("live"), F.max(F.when(partial, F.col("run_id"))).alias("resume_run_id"))
        .select("task_id", "window_start_ms", "window_end_ms", F.when(F.col("won") == 1, "done").when(F.col("live") == 1, "leased").otherwise("pending").alias("state"), "token", "resume_run_id")
    )


def with_task(changes: DataFrame, streams: DataFrame) -> DataFrame:
    """`generation_ms` and `vnode` of each change's task; null where no generation holds its stream at its time."""
    known = streams.where("stream_id is not null").select("stream_id", F.col("generation_start_ms").alias("generation_ms"), F.col("generation_end_ms").alias("until_ms"), "vnode").distinct()
    within = lambda a, b: (a["ms"] >= b["generation_ms"]) & (F.col("until_ms").isNull() | (a["ms"] < F.col("until_ms")))
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        right = F.broadcast(known.withColumnRenamed("stream_id", "__stream"))
        return changes.join(right, (changes["stream_id"] == right["__stream"]) & within(changes, right), "left").drop("__stream", "until_ms")
    # Beyond that, the changes of a heavy stream are spread over as many salts as keep each part near HEAVY of all.
    text = F.hex("stream_id")
    salts = sketch(changes.select("stream_id"), text, HEAVY).parts(text, HEAVY)
    left = changes.withColumn("__salt", F.pmod(F.xxhash64("ticks", "low", "batch_seq_no"), salts).cast("int"))
    right = known.withColumn("__salt2", F.explode(F.sequence(F.lit(0), salts - 1))).withColumnRenamed("stream_id", "__stream")
    return left.join(right, (left["stream_id"] == right["__stream"]) & (left["__salt"] == right["__salt2"]) & within(left, right), "left").drop("__stream", "__salt", "__salt2", "until_ms")


def untaken(log: DataFrame, streams: DataFrame, ledger: WorkLedger, table_name: str) -> DataFrame:
    """Identity of the log rows that, by the ledger, no attempt has taken: what the next run must process.

    That is all changes of items that are pending but for what their tokens handed over, changes of done items that
    arrived after the last read, and changes of no item. Copies of a log row count as one, arrived when the first did. Windows
    are cut at a grid as wide as the average window, which at most doubles their number, so the join is an equi-join on task
    and grid cell with the rest as its condition, not a comparison of each change with each hand-over of its task.
    It is an anti-join that keeps the changes' side, so adaptive execution can split a hot cell.

    Defined cases: a row whose stream no generation holds, or without arrival time, was taken by none;
    rows without identity aren't log rows; an item with an empty window takes nothing.
    """
    name, generation, vnode = task_parts(F.col("task_id"))
    taken = ledger.handed().where((name == table_name) & (F.col("window_start_ms") < F.col("window_end_ms")))
    width = taken.agg(F.avg(F.col("window_end_ms") - F.col("window_start_ms"))).first()[0]
    grid = F.lit(max(1, int(width or 1))).cast("bigint")
    cell = lambda c: F.call_function("div", c, grid)
    cells = taken.select(generation.alias("generation_ms"), vnode.alias("vnode"), F.explode(F.sequence(cell(F.col("window_start_ms")), cell(F.col("window_end_ms") - 1))).alias("cell"), *[F.col(c).alias(f"r_{c}") for c in ("window_start_ms", "window_end_ms", "read_us", "last_hi", "last_lo", "last_ticks")])
    seen = arrivals(log).withColumn("ms", tu.millis(F.col("ticks")))
    hi, lo = si.order_keys(si.hex_id(F.col("stream_id")))
    changes = with_task(seen, streams).withColumns({"cell": cell(F.col("ms")), "hi": hi, "lo": lo})
    before_last = (F.col("hi") < F.col("r_last_hi")) | ((F.col("hi") == F.col("r_last_hi")) & ((F.col("lo") < F.col("r_last_lo")) | ((F.col("lo") == F.col("r_last_lo")) & (F.col("ticks") <= F.col("r_last_ticks")))))
    covers = (
        (changes["generation_ms"] == cells["generation_ms"]) & (changes["vnode"] == cells["vnode"]) & (changes["cell"] == cells["cell"])
        & (F.col("ms") >= F.col("r_window_start_ms")) & (F.col("ms") < F.col("r_window_end_ms")) & (F.col("arrived_us") <= F.col("r_read_us"))
        & (F.col("r_last_ticks").isNull() | before_last)
    )
    return changes.join(cells, covers, "left_anti").select(*IDENTITY)
