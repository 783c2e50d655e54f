"""Small delivered logs for tests."""

from __future__ import annotations

import datetime as dt
import uuid

EPOCH_TICKS = 122192928000000000
BASE_MS = 1706486400000
SCHEMA = "`cdc$stream_id` binary, `cdc$time` string, `cdc$batch_seq_no` int, `cdc$deleted_v` boolean, `cdc$end_of_batch` boolean, `cdc$operation` tinyint, `cdc$ttl` bigint, ck int, pk int, v int, delivery_id bigint, delivery_batch bigint, received_at timestamp_ntz"


def time_uuid(ms: float, low: int = 0x8080808080808080) -> str:
    t = EPOCH_TICKS + round(ms * 10000)
    return str(uuid.UUID(int=(t & 0xFFFFFFFF) << 96 | (t >> 32 & 0xFFFF) << 80 | 0x1000 << 64 | (t >> 48 & 0x0FFF) << 64 | low))


def stream(n: int) -> bytes:
    return bytes([(n * 37) % 256]) * 8 + (n * 16 + 1).to_bytes(8, "big")


def at(s: float) -> dt.datetime:
    return dt.datetime(2024, 1, 29) + dt.timedelta(seconds=s)


class Log:
    """Rows in the order of delivery."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, op, pk, ck=None, v=None, *, s=0.0, seq=0, deleted=None, stream_no=None, eob=True, ttl=None, arrived=None, low=0x8080808080808080, time=None, delivery=None):
        n = pk or 0 if stream_no is None else stream_no
        self.rows.append((stream(n), time if time is not None else time_uuid(BASE_MS + s * 1000, low), seq, deleted, eob, op, ttl, ck, pk, v, len(self.rows) + 1 if delivery is None else delivery, 1, at(s if arrived is None else arrived)))
        return self

    def again(self, i: int, **changes):
        r = list(self.rows[i])
        r[10] = len(self.rows) + 1
        names = ["stream", "time", "seq", "deleted", "eob", "op", "ttl", "ck", "pk", "v", "delivery", "batch", "received"]
        for k, v in changes.items():
            r[names.index(k)] = v
        self.rows.append(tuple(r))
        return self

    def df(self, spark):
        return spark.createDataFrame(self.rows, SCHEMA)
