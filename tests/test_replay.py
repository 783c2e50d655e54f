import random

import pytest
from pyspark.sql import functions as F

from rillfold.operators import apply, replay
from rillfold.sources.log import distinct_rows
from tests.logs import Log

KEYED = apply.Keyed(("pk",), ("ck",), ("v",))


def brute(rows):
    """Changes one after another, per partition key."""
    seen, out = set(), {}
    changes = []
    for r in rows:
        if r[8] is None or r[1] is None or (r[0], r[1], r[2]) in seen:
            continue
        seen.add((r[0], r[1], r[2]))
        changes.append(r)
    by_id = {(r[0], r[1], r[2]): r for r in changes}
    changes.sort(key=lambda r: (r[1][14:18], r[1][9:13], r[1][:8], r[2], r[5] in (3, 4, 7, 8), r[9] is not None, r[9] or 0))
    for r in changes:
        op, ck, pk, v = r[5], r[7], r[8], r[9]
        mine = out.setdefault(pk, {})
        if op in (1, 2) and ck is not None:
            row = mine.setdefault(ck, [False, None])
            row[0] |= op == 2
            if v is not None or r[3]:
                row[1] = v
        elif op == 3:
            mine.pop(ck, None)
        elif op == 4:
            mine.clear()
        elif op in (7, 8):
            left = by_id.get((r[0], r[1], r[2] - 1))
            if left and left[5] in (5, 6) and left[8] == pk:
                for k in list(mine):
                    if (left[7] is None or k > left[7] or (k == left[7] and left[5] == 5)) and (ck is None or k < ck or (k == ck and op == 7)):
                        del mine[k]
    return {(pk, ck, row[1]) for pk, rows in out.items() for ck, row in rows.items() if row[0] or row[1] is not None}


def mess(seed, n=600, pks=6, hot_row=False):
    rng, log = random.Random(seed), Log()
    for i in range(n):
        pk = 0 if rng.random() < 0.4 else rng.randint(0, pks)
        ck = 3 if hot_row and pk == 0 and rng.random() < 0.8 else rng.randint(-3, 8)
        op = rng.choices([1, 2, 3, 4, 5], [8, 5, 2, 0.3, 1.5])[0]
        if op == 5:
            lo, hi = sorted([rng.randint(-3, 8), rng.randint(-3, 8)])
            log.add(rng.choice([5, 6]), pk, rng.choice([lo, lo, None]), s=i, seq=0, eob=False)
            log.add(rng.choice([7, 8]), pk, rng.choice([hi, hi, None]), s=i, seq=1)
        else:
            null = rng.random() < 0.3
            log.add(op, pk, None if op == 4 else ck, None if op > 2 or null else i, s=i, deleted=rng.choice([True, False, None]) if op < 3 and null else None)
        if rng.random() < 0.3:
            log.again(rng.randrange(len(log.rows)))
    log.add(9, 0, 1, 999, s=n + 1).add(0, 0, 1, 998, s=n + 2).add(2, None, 1, 1, s=n + 3).add(2, 1, None, 1, s=n + 4).add(5, 1, 0, s=n + 5).add(8, 1, 8, s=n + 6, seq=4)
    log.again(0, time=None)
    rng.shuffle(log.rows)
    return log


@pytest.mark.parametrize("seed,hot_row,unit", [(1, False, 1000), (2, False, 20), (3, True, 20), (4, True, 1), (6, False, 1)])
def test_against_one_after_another(spark, monkeypatch, seed, hot_row, unit):
    """unit: rows that a unit of work holds; few make many chunks, and reduce hot rows first."""
    monkeypatch.setattr(replay, "LEAST_ROWS", unit)
    monkeypatch.setattr(replay, "UNIT_ROWS", unit)
    log = mess(seed, hot_row=hot_row)
    want = brute(log.rows)
    df = log.df(spark).withColumn("chunk", F.lit("clash")).withColumn("ticks", F.lit("clash"))
    assert {tuple(r) for r in replay.replay(df).collect()} == want
    assert {tuple(r) for r in apply.state(distinct_rows(log.df(spark)), KEYED).collect()} == want


def test_without_hot_keys(spark):
    log = mess(5, pks=40)
    assert {tuple(r) for r in replay.replay(log.df(spark)).collect()} == brute(log.rows)


@pytest.mark.parametrize("times", [1, 10])
def test_a_unit_of_work_stays_bounded(spark, monkeypatch, times):
    """One key holds nearly all rows and is deleted from in wide ranges; ten times the rows don't make a chunk larger."""
    monkeypatch.setattr(replay, "LEAST_ROWS", 100)
    monkeypatch.setattr(replay, "UNIT_ROWS", 100)
    n = 600 * times
    rows = spark.range(n).select(F.lit(1).alias("pk"), (F.col("id") % (n // 2)).alias("at"), F.lit(None).cast("bigint").alias("until"), F.lit(replay.WRITE | replay.VALUE).alias("what"), F.col("id").cast("int").alias("v"), F.col("id").alias("ticks"), F.lit(0).alias("seq"), F.lit(b"").alias("low"))
    wide = spark.range(n // 20).select(F.lit(1).alias("pk"), F.col("id").alias("at"), (n - F.col("id")).alias("until"), F.lit(replay.COVER).alias("what"), F.lit(None).cast("int").alias("v"), F.col("id").alias("ticks"), F.lit(1).alias("seq"), F.lit(b"").alias("low"))
    log = rows.unionByName(wide).select("pk", F.col("at").alias("ck"))
    r, t = replay._chunked(replay._hot(log), rows, wide, newest_only=True)
    sizes = r.groupBy("pk", "chunk").count().agg(F.max("count")).first()[0]
    assert sizes <= 200
    assert t.count() <= 2 * (n // 20) + 4096  # not one for each deletion and chunk


def test_buckets(spark):
    bounds = list(range(10, 2560, 10))
    df = spark.range(0, 2600, 7).select("id", F.array(*map(F.lit, bounds)).cast("array<bigint>").alias("b"))
    assert all(r.k == sum(x < r.id for x in bounds) for r in df.select("id", replay._bucket(F.col("b"), F.col("id"), 2).alias("k")).collect())


def test_existence(spark):
    log = Log().add(1, 1, 1, None, s=1, deleted=True).add(2, 1, 2, None, s=2).add(1, 1, 3, 5, s=3).add(1, 1, 3, None, s=4, deleted=True).add(2, 1, 4, 7, s=5).add(1, 1, 4, None, s=6).add(2, 2, 1, 1, s=7).add(4, 2, s=8).add(1, 2, 1, 9, s=9)
    assert {tuple(r) for r in replay.replay(log.df(spark)).collect()} == {(1, 2, None), (1, 4, 7), (2, 1, 9)}
    assert replay.replay(Log().df(spark)).count() == 0 and replay.image_mismatches(Log().df(spark)).count() == 0


def test_equal_ticks(spark):
    low = 0x8080808080808081
    log = Log().add(2, 1, 1, 5, s=1, seq=0).add(1, 1, 1, 6, s=1, seq=0, low=low).add(2, 1, 2, 5, s=1, seq=1).add(3, 1, 2, s=1, seq=1, low=low)
    assert {tuple(r) for r in replay.replay(log.df(spark)).collect()} == {(1, 1, 6)}


def test_images(spark):
    log = Log().add(0, 1, 1, None, s=0).add(2, 1, 1, 5, s=1).add(0, 1, 1, 5, s=2).add(3, 1, 1, s=3).add(0, 1, 1, 5, s=4).again(4).add(2, 1, 1, 6, s=5).add(5, 1, 0, s=6).add(7, 1, 9, s=6, seq=1).add(0, 1, 1, 6, s=7)
    got = {(r.expected, r.actual, r.found) for r in replay.image_mismatches(log.df(spark)).collect()}
    assert got == {(5, None, False), (6, None, False)}
    assert replay.image_mismatches(log.df(spark)).count() == 2


def test_modes_ttl_and_wider_keys(spark):
    assert [apply.mode(x) for x in ("delta", "PRE_IMAGE", "preimage", "post_image")] == ["delta", "preimage", "preimage", "postimage"]
    with pytest.raises(ValueError):
        apply.mode("other")
    log = Log().add(2, 1, 1, 5, s=1, ttl=10).add(9, 1, 1, 5, s=1, seq=1).add(1, 1, 1, None, s=2, deleted=True).add(9, 1, 1, None, s=2, seq=1).add(9, 7, 1, 3, s=3, stream_no=50)
    rows = distinct_rows(log.df(spark))
    assert [tuple(r) for r in apply.state(rows, KEYED).collect()] == [(1, 1, None)]
    assert [tuple(r) for r in apply.state(rows, KEYED, now_ms=1706486400000 + 20000).collect()] == []
    assert [tuple(r) for r in apply.state(rows, KEYED, "postimage").collect()] == [(1, 1, None)]  # an insert made the row, an update took its value
    assert apply.orphan_images(rows).count() == 1
    # Two clustering keys: a grid, and range deletions by prefix.
    grid = [(2, "a", i, j, i * 10 + j, t) for t, (i, j) in enumerate((i, j) for i in range(1, 5) for j in range(1, 5))]
    ranges = [(6, "a", 3, None, None, 100), (7, "a", None, None, None, 100), (5, "a", None, None, None, 101), (7, "a", 1, None, None, 101), (6, "a", 2, 1, None, 102), (8, "a", 2, 4, None, 102)]
    data = [(bytes(16), 10 * t, b"l", 0 if op in (2, 5, 6) else 1, op, None, pk, c1, c2, v, False) for op, pk, c1, c2, v, t in grid + ranges]
    wide = spark.createDataFrame(data, "stream_id binary, ticks bigint, low binary, batch_seq_no int, operation int, ttl bigint, pk string, ck1 int, ck2 int, v int, deleted_v boolean")
    got = {(r.ck1, r.ck2) for r in apply.state(wide, apply.Keyed(("pk",), ("ck1", "ck2"), ("v",))).collect()}
    assert got == {(2, 1), (2, 4)} | {(3, j) for j in range(1, 5)}
