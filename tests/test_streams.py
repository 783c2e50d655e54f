import pytest
from pyspark.sql import functions as F

from rillfold import cli
from rillfold.functions import timeuuid as tu
from rillfold.operators import apply
from rillfold.plans import ledger
from rillfold.sources import layout
from rillfold.sources.cdc_source import LogSource
from rillfold.sources.log import after, base_columns, distinct_rows, meta_columns, window_of
from rillfold.streaming import feed
from tests.logs import BASE_MS, Log, at, stream
from tests.test_replay import KEYED, brute, mess

STREAMS = "generation_start_ms bigint, generation_end_ms bigint, stream_id binary, vnode int"


def small():
    log = Log()
    for i in range(40):
        log.add(2, i % 3, i, i, s=i * 10)
    return log


@pytest.fixture(scope="module")
def laid_out(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("layout") / "log")
    g = spark.createDataFrame([(BASE_MS, BASE_MS + 200_000, stream(n), n) for n in range(3)] + [(BASE_MS + 200_000, None, stream(n), n) for n in range(3)], STREAMS)
    rows = distinct_rows(small().df(spark)).withColumn("ms", tu.millis(F.col("ticks")))
    layout.write(ledger.with_task(rows, g), path, files_per_task=2)
    spark.dataSource.register(LogSource)
    return path


def test_batch_source(spark, laid_out):
    df = spark.read.format("rillfold_log").option("path", laid_out).option("startMs", BASE_MS + 50_000).option("endMs", BASE_MS + 250_000).load()
    assert sorted(r.v for r in df.collect()) == list(range(5, 25))
    assert spark.read.format("rillfold_log").option("path", laid_out).load().count() == 40
    assert spark.read.format("rillfold_log").option("path", laid_out).option("endMs", BASE_MS).load().count() == 0


def test_stream_source_reads_safe_windows_and_goes_on(spark, laid_out, tmp_path):
    def take(now_s):
        df = spark.readStream.format("rillfold_log").option("path", laid_out).option("nowMs", BASE_MS + now_s * 1000).option("windowMs", 30000).option("confidenceMs", 30000).load()
        got = []
        q = df.writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, n: got.extend(r.v for r in b.collect())).start()
        q.processAllAvailable()
        q.stop()
        return sorted(got)

    assert take(89) == [0, 1, 2]  # of the windows that ended, only the first is 30 s old
    assert take(89) == []
    assert take(130) == list(range(3, 9))
    assert take(10_000) == list(range(9, 40))


def test_stream_equals_batch(spark, tmp_path):
    path, log = str(tmp_path / "log.parquet"), mess(7, 300)
    for k in range(3):
        part = Log()
        part.rows = log.rows[k::3]
        part.df(spark).coalesce(1).write.mode("append").parquet(path)
    out = feed.to_folder(feed.range_pairs(feed.stream(spark, path, 1)), str(tmp_path / "pairs"), "update").drop("batch", "low").distinct()
    want = apply.paired(distinct_rows(log.df(spark)), KEYED)
    assert {(r.ticks, r.start_seq, r.pk, r.lo, r.hi) for r in out.collect()} == {(r.ticks, r.start_seq, r.pk, r.l_ck, r.r_ck) for r in want.collect()}
    want = sum(r[1] is not None for r in log.rows)
    counts = feed.to_folder(feed.window_counts(feed.stream(spark, path, 1), 60_000, 86400), str(tmp_path / "counts"), "update")
    assert sum(r.n for r in feed.totals(counts).collect()) == want


def test_windows_lose_no_late_copy(spark, tmp_path):
    """Copies that arrive long after the watermark has passed their window count in it all the same."""
    log, path = Log(), str(tmp_path / "log.parquet")
    for i in range(60):
        log.add(2, 1, i, i, s=i * 60.0, arrived=i * 60.0 + 1)
        log.again(len(log.rows) - 1, received=at(i * 60.0 + (5000 if i % 3 else 20)))
    log.again(0, received=None)
    log.df(spark).coalesce(1).write.parquet(path)
    out, lost = feed.run_by_arrival(spark, path, str(tmp_path / "run"), lambda df: feed.window_counts(df, 600_000, 30), "update", 1200)
    assert lost == 0 and out.select("batch").distinct().count() > 4
    got = {(r.window_start_ms, r.n) for r in feed.totals(out).collect()}
    assert got == {(BASE_MS + k * 600_000, 20) for k in range(6)}
    whole = feed.totals(out.unionByName(feed.unarrived_counts(spark.read.parquet(path), 600_000)))
    assert {(r.window_start_ms, r.n) for r in whole.collect()} == {(BASE_MS + k * 600_000, 20 + (k == 0)) for k in range(6)}
    again, _ = feed.run_by_arrival(spark, path, str(tmp_path / "run"), lambda df: feed.window_counts(df, 600_000, 30), "update", 1200)
    assert {(r.window_start_ms, r.n) for r in feed.totals(again).collect()} == got


def test_windows_begin_with_their_generation(spark, laid_out):
    from rillfold.sources import cdc_source as cs

    starts = [0, 100, 250]
    ends = [0]
    while ends[-1] < 320:
        ends.append(cs._next_end(starts, ends[-1], 30))
    assert ends == [0, 30, 60, 90, 100, 130, 160, 190, 220, 250, 280, 310, 340]
    assert [cs._safe_end(starts, x, 30) for x in (-5, 29, 30, 99, 100, 129, 131, 249, 250, 1000)] == [0, 0, 30, 90, 100, 100, 130, 220, 250, 1000]
    s = cs._Stream({"path": laid_out, "nowMs": str(BASE_MS + 10**6), "maxWindows": "2", "minWaitMs": "60000"})
    assert [s.latestOffset()["ms"] - BASE_MS for _ in range(3)] == [60_000] * 3  # no second step within the minute
    s = cs._Stream({"path": "file://" + laid_out, "nowMs": str(BASE_MS + 10**6), "maxWindows": "2"})
    assert [s.latestOffset()["ms"] - BASE_MS for _ in range(4)] == [60_000, 120_000, 180_000, 230_000]  # the second generation begins at 200 s


def test_handlers_by_operation_and_stop(spark, tmp_path):
    path = str(tmp_path / "log.parquet")
    Log().add(2, 1, 1, 5, s=1).add(1, 1, 1, 6, s=2).add(3, 1, 1, s=3).add(9, 1, 1, 7, s=4).df(spark).coalesce(1).write.parquet(path)
    rows = lambda: feed.stream(spark, path).selectExpr("`cdc$operation` as operation", "v")
    seen = {}
    feed.finish(feed.consume_by_operation(rows(), {op: lambda b, n, op=op: seen.setdefault(op, [r.v for r in b.collect()]) for op in (1, 2, 9, 4)}, str(tmp_path / "cp")))
    assert seen == {1: [6], 2: [5], 9: [7]}
    with pytest.raises(ValueError):
        feed.consume_by_operation(rows(), {77: print}, str(tmp_path / "cp2"))
    with pytest.raises(Exception, match="unknown operations"):
        feed.finish(feed.consume_by_operation(rows().selectExpr("operation + 50 as operation", "v"), {1: print}, str(tmp_path / "cp3")))
    going = feed.consume_by_operation(rows(), {}, str(tmp_path / "cp4"), every="1 second")
    assert going.isActive and feed.stop(going) and not going.isActive
    asked = []

    def fail():
        asked.append(1)
        return feed.consume_by_operation(rows(), {2: lambda b, n: 1 / 0}, str(tmp_path / f"cp5-{len(asked)}"))

    with pytest.raises(Exception, match="ZeroDivisionError"):
        feed.supervise(fail, None, lambda n: None, stopped=lambda: len(asked) == 3)
    assert len(asked) == 3


def test_state_table_is_idempotent(spark, tmp_path):
    log = Log()
    log.rows = [r for r in mess(8, 200).rows if r[5] in (1, 2, 3) and r[7] is not None and r[8] is not None and r[1] is not None]
    rows = [distinct_rows(_part(log, k, 3).df(spark)) for k in range(3)]
    state = feed.StateTable(spark, str(tmp_path / "state"), KEYED)
    assert state.read() is None
    for n, k in enumerate([2, 0, 1]):
        state.fold(rows[k], n)
        state.fold(rows[k], n)  # the batch is replayed
    assert {tuple(r) for r in state.read().collect()} == brute(log.rows)


@pytest.mark.parametrize("order", [[0, 1, 2], [2, 0, 1]])
def test_state_table_applies_all_deletions(spark, tmp_path, order):
    log = mess(8, 300)
    rows = [distinct_rows(_part(log, k, 3).df(spark)) for k in range(3)]  # the bounds of a range are in different batches
    state = feed.StateTable(spark, str(tmp_path / "state"), KEYED)
    for n, k in enumerate(order):
        state.fold(rows[k], n)
        state.fold(rows[k], n)
    got = {tuple(r) for r in state.read().collect()}
    assert got == brute(log.rows) == {tuple(r) for r in apply.state(distinct_rows(log.df(spark)), KEYED).collect()}
    (tmp_path / "old" / "v0").mkdir(parents=True)
    (tmp_path / "old" / "v0" / "_SUCCESS").touch()
    with pytest.raises(ValueError, match="without deletions"):
        feed.StateTable(spark, str(tmp_path / "old"), KEYED).read()


def test_state_table_partition_and_range(spark, tmp_path):
    state = feed.StateTable(spark, str(tmp_path / "state"), KEYED)
    for n, log in enumerate([Log().add(2, 1, 1, 10, s=1).add(2, 2, 1, 20, s=1).add(2, 2, 5, 25, s=1).add(5, 2, 0, s=2, seq=0, eob=False), Log().add(4, 1, None, s=3), Log().add(7, 2, 3, s=2, seq=1).add(2, 1, 2, 30, s=0)]):
        state.fold(distinct_rows(log.df(spark)), n)
    assert {tuple(r) for r in state.read().collect()} == {(2, 5, 25)}


def _part(log, k, n):
    part = Log()
    part.rows = log.rows[k::n]
    return part


def test_consumers_and_restart(spark, tmp_path, laid_out):
    def source():
        return spark.readStream.format("rillfold_log").option("path", laid_out).option("nowMs", BASE_MS + 10**7).load()

    seen, tries = [], []

    def start():
        def handle(batch, n):
            if not tries:
                tries.append(1)
                raise RuntimeError("injected")
            seen.append([(r.generation_ms, r.vnode, r.v) for r in batch.collect()])

        df = source().withColumns({"generation_ms": F.lit(1), "vnode": F.col("pk")})
        return feed.consume_by_task(df, handle, str(tmp_path / "cp"))

    naps = []
    feed.supervise(start, 3, naps.append)
    assert naps == [0] and sorted(x[2] for b in seen for x in b) == list(range(40))
    marks = tmp_path / "rows"
    marks.mkdir()
    folder = str(marks)

    def one(row):
        open(f"{folder}/{row.v}", "w").close()

    feed.finish(feed.consume(source(), one, str(tmp_path / "cp2")))
    assert len(list(marks.iterdir())) == 40
    with pytest.raises(Exception, match="injected"):
        feed.supervise(lambda: feed.consume_by_task(source().withColumns({"generation_ms": F.lit(1), "vnode": F.col("pk")}), lambda b, n: (_ for _ in ()).throw(RuntimeError("injected")), str(tmp_path / "cp3")), 2, lambda n: None)


def test_reading(spark):
    log = Log().add(2, 1, 1, 1, s=0).add(2, 1, 1, 2, s=0.001).add(2, 1, 1, 3, s=30).add(2, 2, 1, 4, s=5, eob=None).again(0)
    rows = distinct_rows(log.df(spark))
    assert rows.count() == 4 and {r.end_of_batch for r in rows.where("v = 4").collect()} == {False}
    assert sorted(r.v for r in window_of(rows, BASE_MS, BASE_MS + 30_000).collect()) == [1, 2, 4]
    assert sorted(r.v for r in window_of(rows, BASE_MS, BASE_MS + 30_000, strict=True).collect()) == [2, 4]
    rest = after(rows, stream(1).hex(), rows.where("v = 2").first().ticks)
    assert {r.v for r in rest.collect()} == {3, 4}
    df = log.df(spark)
    assert len(base_columns(df).columns) + len(meta_columns(df).columns) == len(df.columns)
    assert distinct_rows(df.limit(0)).count() == 0
    clash = distinct_rows(df.withColumns({"ticks": F.lit("x"), "operation": F.lit("y")}))
    assert {(r.c_ticks, r.c_operation, r.operation) for r in clash.collect()} == {("x", "y", 2)} and clash.count() == 4


def test_windows_of_the_ingested_log_prune(spark, tmp_path):
    log = Log()
    for h in range(30):
        log.add(2, 1, h, h, s=h * 3600.0 + 5).again(len(log.rows) - 1)
    log.df(spark).write.parquet(str(tmp_path / "log.parquet"))
    spark.createDataFrame([(BASE_MS, BASE_MS + 10**9, stream(1), 1)], STREAMS).write.parquet(str(tmp_path / "streams.parquet"))
    rows = layout.ingested(spark, str(tmp_path / "log.parquet"), str(tmp_path / "streams.parquet"))
    hour = window_of(rows, BASE_MS + 3 * 3_600_000, BASE_MS + 4 * 3_600_000)
    plan = hour._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ticks" in plan and "LessThan(ticks" in plan
    assert [(r.v, r.generation_ms, r.vnode) for r in hour.collect()] == [(3, BASE_MS, 1)] and rows.count() == 30
    assert layout.ingested(spark, str(tmp_path / "log.parquet"), str(tmp_path / "streams.parquet")).inputFiles() == rows.inputFiles()
    Log().add(2, 1, 99, 99, s=9).df(spark).write.mode("append").parquet(str(tmp_path / "log.parquet"))
    assert layout.ingested(spark, str(tmp_path / "log.parquet"), str(tmp_path / "streams.parquet")).count() == 31  # a changed log is ingested anew


def test_command_line(spark, tmp_path):
    log = mess(9, 80)
    log.df(spark).write.parquet(str(tmp_path / "in" / "ks.a.parquet"))
    cli.main(["apply", "-m", "delta", "-k", "ks", "-t", "a", "-s", str(tmp_path / "in"), "-d", str(tmp_path / "out")])
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / "ks.a.parquet")).collect()} == brute(log.rows)
    cli.main(["print", "-k", "ks", "-t", "a", "-s", str(tmp_path / "in"), "-d", str(tmp_path / "out")])
    assert spark.read.text(str(tmp_path / "out" / "ks.a.txt")).count() == distinct_rows(log.df(spark)).count()
    with pytest.raises(SystemExit, match="no table ks.b"):
        cli.main(["apply", "-k", "ks", "-t", "a,b", "-s", str(tmp_path / "in"), "-d", str(tmp_path / "out")])
    (tmp_path / "schema.json").write_text('{"a": {"pk": ["PARTITION_KEY", "INT"], "ck": ["CLUSTERING_KEY", "INT"], "v": ["REGULAR", "INT"]}}')
    cli.main(["apply", "-m", "preimage", "-k", "ks", "-t", "a", "-s", str(tmp_path / "in"), "-d", str(tmp_path / "out"), "--schema", str(tmp_path / "schema.json")])
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / "ks.a.parquet")).collect()} == brute(log.rows)
    assert {r.expected_v for r in spark.read.parquet(str(tmp_path / "out" / "ks.a.mismatches.parquet")).collect()} == {998}
    with pytest.raises(SystemExit):
        cli.main(["apply", "-m", "nope", "-k", "ks", "-t", "a", "-s", "x"])
