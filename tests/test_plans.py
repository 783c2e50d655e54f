import uuid

import pytest
from pyspark.sql import functions as F

from rillfold.functions import streamid as si
from rillfold.operators import generations as g
from rillfold.operators import ordered, tasks
from rillfold.plans import ledger
from rillfold.plans import store as st
from rillfold.plans.ledger import StaleLease, WorkLedger
from rillfold.sources import catalog
from tests.logs import BASE_MS, Log, at, stream, time_uuid

RUNS = "run_id bigint, task_id string, window_start_ms bigint, window_end_ms bigint, read_at timestamp_ntz, finished_at timestamp_ntz, status string, last_change_stream_id binary, last_change_time string"
STREAMS = "generation_start_ms bigint, generation_end_ms bigint, stream_id binary, vnode int"
W = 60_000


def streams(spark, *numbers):
    return spark.createDataFrame([(BASE_MS, BASE_MS + 100 * W, stream(n), n) for n in numbers], STREAMS)


def run(n, vnode, k, read_s, status="succeeded", last=None, width=1):
    return (n, f"ks.a:{BASE_MS}:{vnode}", BASE_MS + k * W, BASE_MS + (k + width) * W, at(read_s), None, status, *(last or (None, None)))


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_untaken(spark, monkeypatch, tmp_path, broadcast_rows):
    monkeypatch.setattr(ledger, "BROADCAST_ROWS", broadcast_rows)
    log = Log()
    names = {}
    for key, kw in {
        "taken": dict(s=10), "late": dict(s=20, arrived=500), "border_in": dict(s=0), "next_window": dict(s=60), "read_late": dict(s=70, arrived=500.0),
        "failed_before": dict(s=130), "failed_same_tick": dict(s=131, low=5), "failed_after": dict(s=132), "nothing_handed": dict(s=190), "running": dict(s=250), "no_run": dict(s=1000), "after_generation": dict(s=101 * 60 + 1),
    }.items():
        log.add(2, 1, 1, 1, **kw)
        names[key] = len(log.rows)
    log.add(2, 9, 1, 1, s=10)  # no generation has its stream
    log.again(0, received=at(9000)).add(2, 1, 1, 1, s=5, arrived=0, time="?")
    runs = [run(1, 1, 0, 100), run(1, 1, 0, 100), run(2, 1, 1, 100), run(3, 1, 2, 300, "failed", (stream(1), time_uuid(BASE_MS + 131_000))), run(4, 1, 3, 300, "failed"), run(5, 1, 4, 400, "running"), run(6, 2, 0, 9000, width=50), (7, "garbage", 0, 1, at(0), None, "succeeded", None, None), (8, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(runs, RUNS)
    rest = ledger.untaken(log.df(spark).withColumn("ms", F.lit("clash")).withColumn("cell", F.lit(1)), streams(spark, 1, 2), book(spark, tmp_path, df), "ks.a")
    left = {(r.ticks, bytes(r.stream_id)) for r in rest.collect()}
    by_row = {(tuple_ticks(log.rows[i - 1][1]), log.rows[i - 1][0]): key for key, i in names.items()}
    assert {by_row.get(x, "no stream") for x in left} == {"late", "read_late", "failed_after", "nothing_handed", "running", "no_run", "after_generation", "no stream"}
    every = ledger.arrivals(log.df(spark)).count()
    assert ledger.untaken(log.df(spark), streams(spark, 1), book(spark, tmp_path, df.limit(0)), "ks.a").count() == every
    assert ledger.untaken(log.df(spark), streams(spark, 1).limit(0), book(spark, tmp_path, df), "ks.a").count() == every
    assert ledger.untaken(log.df(spark).limit(0), streams(spark, 1), book(spark, tmp_path, df), "ks.a").count() == 0


def book(spark, tmp_path, runs):
    b = WorkLedger(spark, str(tmp_path / f"book-{uuid.uuid4().hex}"))
    b.take_over(runs, BASE_MS + 10_000_000, 1000)
    return b


def tuple_ticks(text):
    return uuid.UUID(text).time


def test_states_from_attempts(spark):
    runs = [run(1, 1, 0, 10, "failed"), run(2, 1, 0, 20), run(3, 1, 1, 10, "running"), run(4, 1, 2, 90, "running"), run(5, 1, 3, 10, "failed", (stream(1), time_uuid(BASE_MS))), run(5, 1, 3, 10, "failed", (stream(1), time_uuid(BASE_MS)))]
    out = {r.window_start_ms: (r.state, r.token, r.resume_run_id) for r in ledger.from_attempts(spark.createDataFrame(runs, RUNS), BASE_MS + 100_000, 30_000).collect()}
    assert list(out.values()).__len__() == 4
    assert [out[BASE_MS + k * W] for k in range(4)] == [("done", 2, None), ("pending", 1, None), ("leased", 1, None), ("pending", 1, 5)]


def test_work_ledger(spark, tmp_path):
    book = WorkLedger(spark, str(tmp_path / "ledger"))
    assert book.read().count() == 0 and book.claim("nobody", 3, 0, 10) == []
    items = spark.createDataFrame([("t:1:1", k * W, (k + 1) * W) for k in (2, 0, 1)], ledger.ITEM)
    book.add(items)
    book.add(items)
    assert {r.state for r in book.read().collect()} == {"pending"} and book.read().count() == 3
    a, b = book.claim("a", 2, 1000, 100)
    assert (a.window_start_ms, b.window_start_ms, a.token) == (0, W, 1)
    (c,) = book.claim("b", 5, 1050, 100)
    assert c.window_start_ms == 2 * W
    book.finish(a, 1060)
    book.finish(a, 1061)  # a retry of the same finish
    assert book.claim("b", 5, 1060, 100) == []
    (b2,) = book.claim("b", 5, 1100, 100)  # a's other lease has expired, b's not
    assert (b2.window_start_ms, b2.token) == (W, 2) and b2.output != b.output
    with pytest.raises(StaleLease):
        book.finish(b, 1105)
    book.finish(b2, 1110)
    with pytest.raises(StaleLease):
        book.finish(c, 1150)  # expired, though nobody took it over
    book.expire(1150)
    assert sorted((r.window_start_ms // W, r.state, r.token) for r in book.read().collect()) == [(0, "done", 1), (1, "done", 2), (2, "pending", 1)]
    # A writer that lost the race for a version works on what the winner left.
    other = WorkLedger(spark, book.folder)
    real = other._version
    calls = []

    def stale():
        v = real()
        if not calls:
            calls.append(1)
            book.claim("c", 1, 2000, 100)
        return v

    other._version = stale
    assert other.claim("d", 1, 2000, 100) == []
    assert {r.owner for r in book.read().where("state = 'leased'").collect()} == {"c"}


def test_what_leases_hand_over_is_taken(spark, tmp_path):
    """The same history, once lived through leases, once taken over from a table of attempts."""
    log = Log()
    for s in range(0, 240, 5):
        log.add(2, 1, 1, 1, s=s, arrived=s + 1)
    log.add(2, 1, 1, 1, s=7, arrived=1000)
    key = lambda k: (f"ks.a:{BASE_MS}:1", BASE_MS + k * W, BASE_MS + (k + 1) * W)
    lived = WorkLedger(spark, str(tmp_path / "lived"))
    lived.add(spark.createDataFrame([key(k) for k in range(4)], ledger.ITEM))
    us = lambda s: (BASE_MS + s * 1000) * 1000
    a, b = lived.claim("a", 2, 0, 100)
    lived.finish(a, 50, us(300))
    last = (stream(1), time_uuid(BASE_MS + 80_000))
    lived.fail(b, 60, us(300), last[0], tuple_ticks(last[1]))
    c, d = lived.claim("c", 2, 70, 100)
    assert (c.window_start_ms, c.token, d.token) == (b.window_start_ms, 2, 1)
    with pytest.raises(StaleLease):
        lived.fail(b, 80, us(900), last[0], tuple_ticks(last[1]))  # its fence is old: nothing is handed over
    with pytest.raises(StaleLease):
        lived.finish(d, 170)  # expired
    lived.expire(170)
    assert {(r.window_start_ms, r.state) for r in lived.read().collect()} == {(key(0)[1], "done"), (key(1)[1], "pending"), (key(2)[1], "pending"), (key(3)[1], "pending")}
    runs = [run(1, 1, 0, 300), run(2, 1, 1, 300, "failed", last), run(3, 1, 1, 400, "running"), run(4, 1, 2, 300, "running")]
    told = book(spark, tmp_path, spark.createDataFrame(runs, RUNS))
    rest = [sorted(r.ticks for r in ledger.untaken(log.df(spark), streams(spark, 1), x, "ks.a").collect()) for x in (lived, told)]
    assert rest[0] == rest[1] and len(rest[0]) == 1 + 7 + 24  # the late one, the window's rest, two windows
    lived.reopen(spark.createDataFrame([key(0)], ledger.ITEM))
    (again,) = lived.claim("e", 1, 200, 100)
    assert (again.window_start_ms, again.token) == (key(0)[1], 2)
    lived.finish(again, 250, us(2000))
    assert ledger.untaken(log.df(spark), streams(spark, 1), lived, "ks.a").count() == 31


@pytest.mark.parametrize("step", ["data", "version"])
def test_a_crash_leaves_the_version_before(spark, tmp_path, monkeypatch, step):
    b = WorkLedger(spark, str(tmp_path / "ledger"))
    b.add(spark.createDataFrame([("t:1:1", 0, 1)], ledger.ITEM))

    def crash(*a, **k):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(*((WorkLedger, "_write") if step == "data" else (b._at._context.__class__, "__getattr__")), crash)
        with pytest.raises(OSError):
            b.claim("a", 1, 0, 10)
    after = WorkLedger(spark, b.folder)
    assert [(r.state, r.token) for r in after.read().collect()] == [("pending", 0)]
    assert after.claim("b", 1, 0, 10)[0].token == 1


def test_many_changes_leave_few_parts(spark, tmp_path):
    b = WorkLedger(spark, str(tmp_path / "ledger"))
    b.add(spark.createDataFrame([("t:1:1", k, k + 1) for k in range(6)], ledger.ITEM))
    for k in range(6):
        (lease,) = b.claim("a", 1, k, 1000)
        b.finish(lease, k)
    assert {(r.window_start_ms, r.state, r.token) for r in b.read().collect()} == {(k, "done", 1) for k in range(6)} and b.handed().count() == 6
    n, parts = b._version()
    assert n == 12 and len(parts["items"]) < 6 and len(b._at.names("versions")) <= ledger.READABLE
    assert len(b._at.names("data")) < 16


def test_generations(spark):
    starts = spark.createDataFrame([(5,), (30,), (10,), (10,), (None,)], "generation_start_ms bigint")
    b = g.bounds(starts)
    assert sorted(tuple(r) for r in b.collect()) == [(5, 10), (10, 30), (30, None)]
    assert g.first_after(starts, 5).first()[0] == 10 and g.first_after(starts, None).first()[0] == 5
    assert [tuple(r) for r in g.expired(b, 11).collect()] == [(5, 10)] and g.expired(b, 10).count() == 0
    assert tuple(g.next_to_read(b, 0, 11).first()) == (10, 30) and g.next_to_read(b, 30, 0).count() == 0
    assert g.last_visible_ms(935_000, [146]) == 789_000 and g.last_visible_ms(5000, [1, None]) == 0
    assert g.pick_form({"cdc_streams_descriptions_v2"}, False) == "v2" and g.pick_form({"cdc_streams_descriptions_v2", "cdc_streams_descriptions"}, False) == "v1"
    with pytest.raises(ValueError):
        g.pick_form(set(), True)
    assert g.same_mode({"a": True, "b": True}) and not g.same_mode({})
    with pytest.raises(ValueError):
        g.same_mode({"a": True, "b": False})
    nested = spark.createDataFrame([(5, [b"a", b"b"]), (5, [b"b"])], "generation_start_ms bigint, streams array<binary>")
    assert g.streams_of(nested).count() == 2
    tablets = spark.createDataFrame([("t", 5, b"a", 0), ("t", 5, b"b", 1), ("t", 5, b"c", 2)], "table_name string, generation_start_ms bigint, stream_id binary, stream_state int")
    assert [bytes(r.stream_id) for r in g.streams_of(tablets, "tablets").collect()] == [b"a"]


def test_generations_of_several_tables(spark):
    rows = spark.createDataFrame([("a", 5), ("a", 30), ("b", 10), ("b", 20), ("b", None), ("b", 20)], "table_name string, generation_start_ms bigint")
    by = ["table_name"]
    b = g.bounds(g.timestamps(rows, "tablets", by), by)
    assert sorted(tuple(r) for r in b.collect()) == [("a", 5, 30), ("a", 30, None), ("b", 10, 20), ("b", 20, None)]
    assert {tuple(r) for r in g.next_to_read(b, 5, 0, by).collect()} == {("a", 30, None), ("b", 10, 20)}
    done = spark.createDataFrame([("a", 5, True), ("b", 10, False), ("b", 20, True)], "table_name string, generation_start_ms bigint, done boolean")
    assert {tuple(r) for r in g.current(b, done, 0, by).collect()} == {("a", 30, None), ("b", 10, 20)}
    assert {tuple(r) for r in g.current(b, done, 25, by).collect()} == {("a", 30, None), ("b", 20, None)}  # b's first has expired, its last is open
    assert g.current(b.limit(0), done, 0, by).count() == 0
    with pytest.raises(ValueError):
        g.timestamps(rows, "v3")
    v1 = spark.createDataFrame([(5, [b"a"]), (6, None), (None, [b"a"])], "generation_start_ms bigint, streams array<binary>")
    assert [r[0] for r in g.timestamps(v1, "v1").collect()] == [5] and sorted(r[0] for r in g.timestamps(v1).collect()) == [5, 6]


def test_catalogs(spark):
    wanted = spark.createDataFrame([("ks.a",), ("ks.b",), ("ks.c",), ("x.a",), ("nodot",), ("ks.a",), ("ks.t",)], "table_name string")
    known = spark.createDataFrame([("ks.a", True, False), ("ks.b", False, False), ("ks.t", True, True)], "table_name string, cdc_enabled boolean, uses_tablets boolean")
    said = {r.table_name: r.problem for r in catalog.check(wanted, known.drop("uses_tablets")).collect()}
    assert said == {"ks.a": None, "ks.b": "ks.b keeps no log", "ks.c": "no table ks.c", "x.a": "no keyspace x", "nodot": "not keyspace.table: nodot", "ks.t": None}
    assert {r.table_name: r.problem for r in catalog.check(wanted, known).collect()}["ks.t"] == "ks.t has tablets, others don't"
    assert catalog.check(wanted.limit(0), known).count() == 0
    ttl = lambda x: spark.createDataFrame([(x,)], "t string").select(catalog.ttl_of(F.col("t"))).first()[0]
    assert (ttl("0"), ttl("86400")) == (None, 86400)
    for bad in (None, "x", "-1"):
        with pytest.raises(Exception, match="not a TTL"):
            ttl(bad)


def test_neighbours_across_pieces(spark):
    rows = [("a", t, t * 10) for t in (1, 2, 11, 12, 35)] + [("b", 3, 7), (None, 1, 1), (None, 20, 2)]
    df = spark.createDataFrame(rows, "k string, t int, v int")
    got = {(r.k, r.t): (r.p, r.n) for r in ordered.neighbours(df, ["k"], ["t"], F.floor(F.col("t") / 10).cast("int"), "v", "p", "n").collect()}
    assert got == {("a", 1): (None, 20), ("a", 2): (10, 110), ("a", 11): (20, 120), ("a", 12): (110, 350), ("a", 35): (120, None), ("b", 3): (None, None), (None, 1): (None, 2), (None, 20): (1, None)}


def test_tasks(spark):
    all_streams = spark.createDataFrame([(5, 10, stream(n), n % 2) for n in (7, 1, 3, 2)] + [(5, 10, stream(1), 1), (5, 10, None, 1)], STREAMS)
    t = tasks.tasks(all_streams, ["ks.b", "ks.a", "ks.a"])
    rows = {(r.table_name, r.vnode): r.streams for r in t.collect()}
    assert set(rows) == {(x, v) for x in ("ks.a", "ks.b") for v in (0, 1)} and rows[("ks.a", 1)] == rows[("ks.b", 1)]
    signed = lambda h: [x - 256 if x > 127 else x for x in bytes.fromhex(h)]
    assert rows[("ks.a", 1)] == sorted({stream(n).hex() for n in (7, 1, 3)}, key=signed)
    saved = spark.createDataFrame([("ks.a", 5, 1, 100, 130, "ab", "t"), ("ks.gone", 5, 1, 1, 2, None, None)], "table_name string, generation_ms bigint, vnode int, window_start_ms bigint, window_end_ms bigint, last_stream string, last_time string")
    s = tasks.with_states(t, saved, 30)
    got = {(r.table_name, r.vnode): (r.window_start_ms, r.window_end_ms, r.last_stream) for r in s.collect()}
    assert got[("ks.a", 1)] == (100, 130, "ab") and got[("ks.b", 0)] == (5, 35, None) and len(got) == 4
    trim = lambda ms: {(r.window_start_ms, r.window_end_ms, r.last_stream) for r in tasks.trimmed(saved.where("table_name = 'ks.a'"), ms, 30).collect()}
    assert trim(130) == {(100, 130, "ab")} and trim(131) == {(131, 161, None)} and trim(110) == {(100, 130, "ab")}
    assert tasks.readable(saved, 160, 30).count() == 2 and tasks.readable(saved, 159, 30).count() == 1
    assert {r.done for r in tasks.all_consumed(t, s, 4).collect()} == {True} and {r.done for r in tasks.all_consumed(t, s, 5).collect()} == {False}
    assert tasks.obsolete(saved, t).count() == 1 and tasks.active_only(saved, t).count() == 1
    assert tasks.moved(saved.limit(1), 30).first().window_start_ms == 130


def test_state_codec(spark):
    df = spark.createDataFrame([(1, 2, "AB01", "T-1"), (1, 2, None, None), (1, 2, "ab", None)], "s bigint, e bigint, stream string, time string")
    coded = df.select(tasks.encode_state(F.col("s"), F.col("e"), F.col("stream"), F.col("time")).alias("m"))
    assert [set(r.m) for r in coded.collect()] == [{"window_start", "window_end", "change_id_stream", "change_id_time"}] + [{"window_start", "window_end"}] * 2
    back = coded.select(*[c.alias(n) for n, c in tasks.decode_state(F.col("m")).items()]).collect()
    assert tuple(back[0]) == (1, 2, "ab01", "t-1") and tuple(back[1]) == (1, 2, None, None)
    keys = spark.createDataFrame([("my_ks.my_table:1700000000000:42",), ("bad",), (None,)], "task_id string")
    assert [tuple(r)[1:] for r in tasks.from_key(keys).collect()] == [("my_ks.my_table", 1700000000000, 42)]


def test_stores(spark, tmp_path):
    for s in (st.MemoryStore(), st.FolderStore(spark, str(tmp_path / "store"))):
        back = st.Backend(s)
        assert s.generation() is None and s.load(["x"]) == {} and not back.all_past(0)
        assert back.configure(5, ["a:5:1", "a:5:2"]) == {}
        back.set_state("a:5:1", {"window_start": "10", "window_end": "20", "other": "x"})
        assert not back.all_past(9)
        back.set_state("a:5:2", {"window_start": "11", "window_end": "20"})
        assert back.all_past(9) and not back.all_past(10)
        back.set_state("a:5:2", {"window_start": "12", "window_end": "22"})
        with pytest.raises(LookupError):
            back.set_state("b:5:1", {"window_start": "1", "window_end": "2"})
        assert back.configure(6, ["a:5:2", "c:6:1"]) == {"a:5:2": {"window_start": "12", "window_end": "22"}}
        assert s.load(["a:5:1"]) == {} and s.generation() == 6
        with pytest.raises(LookupError):
            back.set_state("a:5:1", {"window_start": "1", "window_end": "2"})


def test_ordered_scans(spark):
    rows = [(k, i * 3 % 50, v) for k in ("a", "b", None) for i, v in enumerate([1, None, None, 2, None] * 10)]
    df = spark.createDataFrame(rows, "k string, t int, v int")
    want, last = {}, {}
    for k, t, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        n = want.get((k, "n"), 0) + 1
        want[(k, "n")] = want[(k, t)] = n
        want[(k, "v")] = v if v is not None else want.get((k, "v"))
        last[(k, t)] = want[(k, "v")]
    got = ordered.row_numbers(df, ["k"], ["t"], F.floor(F.col("t") / 7), "place").collect()
    assert len(got) == len(rows) and all(want[(r.k, r.t)] == r.place for r in got)
    got = ordered.last_known(df, ["k"], ["t"], F.floor(F.col("t") / 7), F.col("v"), "known").collect()
    assert len(got) == len(rows) and all(last[(r.k, r.t)] == r.known for r in got)


def test_checkpoint_is_the_last_batch_end_in_stream_order(spark):
    rows = [(stream(n), t, b"l", e) for n, t, e in ((1, 5, True), (7, 3, True), (7, 9, False), (1, 8, None))]
    df = spark.createDataFrame(rows, "stream_id binary, ticks bigint, low binary, end_of_batch boolean").select("*", F.lit("ks.a").alias("table_name"), F.lit(1).cast("bigint").alias("generation_ms"), F.lit(0).alias("vnode"))
    c = tasks.checkpoints(df).first()
    first = df.where("end_of_batch").orderBy(*[x.desc() for x in si.order_keys(si.hex_id(F.col("stream_id")))], F.col("ticks").desc()).first()
    assert (bytes.fromhex(c.last_stream), c.last_ticks) == (bytes(first.stream_id), first.ticks)
    assert tasks.checkpoints(df.where("not end_of_batch")).count() == 0
