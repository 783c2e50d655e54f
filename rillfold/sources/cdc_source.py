"""A data source over a log laid out by task, for batch and streaming reads.

    spark.dataSource.register(LogSource)
    spark.readStream.format("rillfold_log").option("path", folder).option("windowMs", 30000).load()

An offset is a time: everything before it has been read. The latest offset is the end of the last window
that ended at least `confidenceMs` ago by the clock. Windows are counted from the start of each generation, and its last one ends
with it; so a window is read once it is safe to, and later arrivals in it are missed, as is the contract
of such a reader. Each task (generation, vnode) is a partition. Delivery is at least once per task retry;
offsets make it exactly once for a sink that commits with the batch.

Options: path, on any file system that pyarrow knows (local, hdfs://, s3://); startMs, endMs (batch); windowMs 30000, confidenceMs 30000, nowMs (instead of the clock),
maxWindows (per trigger, all by default), minWaitMs (between two steps, 0 by default). A folder without generations gives no rows.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

EPOCH_TICKS = 122192928000000000


@dataclass
class TaskWindow(InputPartition):
    """The rows of one task within `[start_ms, end_ms)`. folder: the log's path and the task's folder on its file system."""

    folder: str
    generation_ms: int
    vnode: int
    start_ms: int
    end_ms: int


def _open(path: str):
    """The file system of a path, and the path within it."""
    from pyarrow import fs

    uri = path.replace("s3a://", "s3://", 1).replace("file:///", "/", 1).removeprefix("file:")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _tasks(path: str) -> list[tuple[int, int, str]]:
    """Generation, vnode and folder of each task."""
    from pyarrow import fs

    system, root = _open(path)
    folders = lambda at: sorted((f.base_name, f.path) for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.type == fs.FileType.Directory)
    out = []
    for g, at in folders(root):
        if g.startswith("generation_ms=") and g[14:].lstrip("-").isdigit():
            out += [(int(g[14:]), int(v[6:]), where) for v, where in folders(at) if v.startswith("vnode=") and v[6:].isdigit()]
    return out


def _next_end(starts: list[int], at: int, window: int) -> int:
    """The end of the window of its generation that begins at or holds `at`."""
    g = max((s for s in starts if s <= at), default=starts[0])
    after = min((s for s in starts if s > g), default=1 << 62)
    return min(after, g + ((max(at, g) - g) // window + 1) * window)


def _safe_end(starts: list[int], safe: int, window: int) -> int:
    """The end of the last window that ended by `safe`; the first start if none has."""
    g = max((s for s in starts if s <= safe), default=None)
    return starts[0] if g is None else g + (safe - g) // window * window


def _windows(path: str, start_ms: int, end_ms: int) -> list[TaskWindow]:
    """Tasks whose generation overlaps the time; a generation ends where the next begins."""
    tasks = _tasks(path)
    starts = sorted({g for g, _, _ in tasks})
    ends = dict(zip(starts, [*starts[1:], 1 << 62]))
    return [TaskWindow(path + "|" + folder, g, v, max(start_ms, g), min(end_ms, ends[g])) for g, v, folder in tasks if max(start_ms, g) < min(end_ms, ends[g])]


def _rows(p: TaskWindow) -> Iterator:
    import pyarrow.dataset as ds
    import pyarrow.compute as pc

    first, last = p.start_ms * 10000 + EPOCH_TICKS, p.end_ms * 10000 + EPOCH_TICKS
    path, folder = p.folder.split("|", 1)
    files = ds.dataset(folder, format="parquet", filesystem=_open(path)[0])
    yield from files.scanner(filter=(pc.field("ticks") >= first) & (pc.field("ticks") < last)).to_batches()


class _Batch(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.start, self.end = options["path"], int(options.get("startMs", -(1 << 60) // 10000)), int(options.get("endMs", (1 << 60) // 10000))

    def partitions(self):
        return _windows(self.path, self.start, self.end) or [TaskWindow("", 0, 0, 0, 0)]

    def read(self, partition):
        if partition.folder:
            yield from _rows(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.window, self.confidence = int(options.get("windowMs", 30000)), int(options.get("confidenceMs", 30000))
        self.now = int(options["nowMs"]) if "nowMs" in options else None
        self.most = int(options["maxWindows"]) if "maxWindows" in options else None
        self.wait = int(options.get("minWaitMs", 0))
        self.at: int | None = None
        self.stepped: int | None = None

    def initialOffset(self):
        return {"ms": min((g for g, _, _ in _tasks(self.path)), default=0)}

    def latestOffset(self):
        clock = int(time.time() * 1000)
        starts = sorted({g for g, _, _ in _tasks(self.path)})
        if not starts:
            return {"ms": self.at or 0}
        if self.at is not None and self.stepped is not None and clock - self.stepped < self.wait:
            return {"ms": self.at}
        latest = _safe_end(starts, (self.now if self.now is not None else clock) - self.confidence, self.window)
        if self.most is not None:
            end = self.at if self.at is not None else starts[0]
            for _ in range(self.most):
                if end >= latest:
                    break
                end = _next_end(starts, end, self.window)
            latest = min(latest, end)
        if latest > (self.at if self.at is not None else starts[0]):
            self.stepped = clock
        self.at = max(latest, self.at if self.at is not None else latest)
        return {"ms": self.at}

    def partitions(self, start, end):
        return _windows(self.path, start["ms"], end["ms"])

    def read(self, partition):
        yield from _rows(partition)

    def commit(self, end):
        pass


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rillfold_log"

    def schema(self) -> StructType:
        import pyarrow.dataset as ds
        from pyspark.sql.pandas.types import from_arrow_schema

        tasks = _tasks(self.options["path"])
        if not tasks:
            raise ValueError("a log without tasks needs a schema: use .schema(...)")
        return from_arrow_schema(ds.dataset(tasks[0][2], format="parquet", filesystem=_open(self.options["path"])[0]).schema)

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)
