import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from rillfold.functions import streamid as si
from rillfold.functions import text as tx
from rillfold.functions import timeuuid as tu


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_time_uuids(spark):
    texts = [str(uuid.uuid1()) for _ in range(50)] + ["C4BA1A2E-BE4C-11EE-9D5F-D78B25D6D997", "{1cfa7e6a-be4c-11ee-9d5f-d78b25d6d997}", "1cfa7e6abe4c11ee9d5fd78b25d6d997", " 1cfa7e6a-be4c-11ee-9d5f-d78b25d6d997"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", tu.ticks(F.col("t")).alias("k"), tu.canonical(F.col("t")).alias("c"), tu.from_parts(tu.ticks(F.col("t")), tu.low_word(tu.digits(F.col("t")))).alias("b")).collect():
        u = uuid.UUID(r.t.strip())
        assert (r.k, r.c, r.b) == (u.time, str(u), str(u))
    for bad in (None, "", "x" * 36, "1cfa7e6a-be4c-11ee-9d5f-d78b25d6d9", "1cfa7e6a-be4c-11ee-9d5f-d78b25d6d99z", "1cfa7e6a_be4c_11ee_9d5f_d78b25d6d997"):
        assert one(spark, tu.ticks(F.lit(bad).cast("string")))[0] is None


def test_bounds_hold_a_millisecond(spark):
    ms = 1706486400123
    first, last, middle, nxt = one(spark, *[f(F.lit(x).cast("bigint")) for f, x in ((tu.start_of, ms), (tu.end_of, ms), (tu.middle_of, ms), (tu.start_of, ms + 1))])
    ticks = [uuid.UUID(x).time for x in (first, middle, last, nxt)]
    assert ticks[0] < ticks[1] < ticks[2] == ticks[3] - 1 and ticks[3] - ticks[0] == 10000
    assert first.endswith("8080-808080808080") and last.endswith("7f7f-7f7f7f7f7f7f") and middle.endswith("0000-000000000000")
    assert one(spark, tu.millis(tu.ticks(F.lit(first))), tu.micros(tu.ticks(F.lit(middle)))) == (ms, ms * 1000 + 500)
    assert one(spark, tu.micros(F.lit(tu.EPOCH_TICKS - 15).cast("bigint")))[0] == -1


def test_stream_order_is_by_signed_bytes(spark):
    ids = [bytes([b] * 16) for b in (0, 1, 127, 128, 200, 255)] + [bytes([0] * 15 + [b]) for b in (1, 128)]
    hi, lo = si.order_keys(si.hex_id(F.col("s")))
    got = [bytes(r.s) for r in spark.createDataFrame([(i,) for i in ids], "s binary").orderBy(hi, lo).collect()]
    assert got == sorted(ids, key=lambda x: [b - 256 if b > 127 else b for b in x])
    assert one(spark, si.vnode(F.lit("00000000000000000000000000000421")), si.vnode(F.lit("0" * 24 + "ffffffff"))) == (66, (0x3FFFFF0) >> 4)


def test_texts(spark):
    d = lambda m, k, n: tx.duration(F.lit(m), F.lit(k), F.lit(n).cast("bigint"))
    assert one(spark, d(14, 3, 4 * 3600 * 10**9 + 5 * 60 * 10**9 + 6 * 10**9 + 7 * 10**6 + 8000 + 9), d(0, 0, 0), d(-1, -2, -3), d(12, 0, 1000)) == ("1y2mo3d4h5m6s7ms8us9ns", "", "-1mo2d3ns", "1y1us")
    assert one(spark, tx.timestamp(F.lit(1706486400123).cast("bigint")), tx.date(F.lit(dt.date(2024, 2, 3))), tx.field(F.lit("abcdef"), 4), tx.field(F.lit("ab"), 4)) == ("29/01/2024, 00:00:00.123", "2024-02-03", "abcd", "  ab")
    assert one(spark, tx.value(F.lit(bytearray(b"\x12\xff")), "binary"), tx.value(F.lit(bytearray()), "binary"), tx.value(F.lit(None).cast("int"), "int")) == ("0x12ff", "0x", "null")
    assert one(spark, *[tx.backoff_ms(F.lit(n), 50, 30000) for n in (0, 3, 20)]) == (50, 400, 30000)
    assert 300 <= one(spark, tx.jittered_ms(F.lit(1000), 0.9, 700, 1))[0] <= 1000
    assert one(spark, tx.operation_name(F.lit(2)), tx.operation_name(F.lit(None).cast("int"))) == ("ROW_INSERT", None)
    with pytest.raises(Exception, match="unknown operation 10"):
        one(spark, tx.operation_name(F.lit(10)))


def test_moments_and_bytes(spark):
    df = spark.createDataFrame([(1000, 3, -2, "ä", bytes([255]), True, "00000000-0000-1000-8080-808080808080"), (None,) * 7], "ms bigint, n int, i int, s string, b binary, f boolean, u string")
    r = df.select(tu.plus(F.col("ms"), F.col("n"), "minutes"), tu.plus(F.col("ms"), -1, "days")).collect()
    assert [tuple(x) for x in r] == [(181_000, 1000 - 86_400_000), (None, None)]
    with pytest.raises(ValueError):
        tu.plus(F.col("ms"), 1, "weeks")
    kinds = {"ms": "bigint", "i": "int", "s": "string", "b": "binary", "f": "boolean", "u": "uuid"}
    got = df.select(*[F.hex(tx.raw(F.col(c), k)) for c, k in kinds.items()]).collect()
    assert tuple(got[0]) == ("00000000000003E8", "FFFFFFFE", "C3A4", "FF", "01", "00000000000010008080808080808080") and set(got[1]) == {None}
    with pytest.raises(ValueError):
        tx.raw(F.col("b"), "duration")
