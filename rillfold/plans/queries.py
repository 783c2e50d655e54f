"""Queries for the operators on logs, generations, tasks and states, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillfold.cli import pretty
from rillfold.functions import streamid as si
from rillfold.functions import text as tx
from rillfold.functions import timeuuid as tu
from rillfold.operators import apply, collections, drift, generations, ordered, replay, schema, tasks
from rillfold.plans import ledger
from rillfold.session import shared_dir, table
from rillfold.sources import catalog, layout
from rillfold.sources import log as logs
from rillfold.sources.cdc_source import LogSource
from rillfold.sources.log import IDENTITY
from rillfold.streaming import feed

LOG = "simple_scylla_cdc_log"
SIMPLE = apply.Keyed(("pk",), ("ck",), ("v",))
TABLE = "ks.simple"
WINDOW_MS = 30_000
CONFIDENCE_MS = 30_000
#: The moment at which the queries about time look at the tables, and how long changes are kept.
NOW_MS = 1707000000000
TTL_S = 5 * 86400
AN_HOUR = apply.CHUNK_TICKS

#: Name to query, and name to SQL; filled by `_query`.
QUERIES: dict = {}
SQL: dict[str, str] = {}

_UUID = "replace(replace(replace(lower(\"cdc$time\"), '-', ''), '{', ''), '}', '')"
_TICKS = f"(('0x' || substr({_UUID}, 14, 3) || substr({_UUID}, 9, 4) || substr({_UUID}, 1, 8))::bigint)"
_SIGNED = "list_transform(range(16), lambda i: (('0x' || substr({}, (2 * i + 1)::int, 2))::int + 128) % 256)"
_L = f"""l as (select lower(hex("cdc$stream_id")) as s, {_UUID} as u, {_TICKS} as ticks, "cdc$batch_seq_no" as q, max("cdc$operation")::int as op,
    bool_or(coalesce("cdc$end_of_batch", false)) as eob, max("cdc$ttl") as ttl, max(pk) as pk, max(ck) as ck, max(v) as v, bool_or(coalesce("cdc$deleted_v", false)) as dv from simple_scylla_cdc_log group by all)"""
_MS = "((ticks - 122192928000000000) // 10000)"
_TEXT = "substr(u, 1, 8) || '-' || substr(u, 9, 4) || '-' || substr(u, 13, 4) || '-' || substr(u, 17, 4) || '-' || substr(u, 21)"
_TASKED = f"t as (select l.*, {_MS} as ms, generation_start_ms as gen, vnode from l left join (select distinct * from cdc_streams) c on lower(hex(c.stream_id)) = s and {_MS} >= generation_start_ms and {_MS} < generation_end_ms)"
_OPS = "['" + "', '".join(tx.OPERATIONS) + "']"
_PARTS = "split_part(task_id, ':', 1) as table_name, split_part(task_id, ':', 2)::bigint as generation_ms, split_part(task_id, ':', 3)::int as vnode"


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _tasked(spark: SparkSession, d: str) -> DataFrame:
    """The log as it is kept for reading, with the task of each row."""
    return layout.ingested(spark, f"{d}/{LOG}.parquet", f"{d}/cdc_streams.parquet")


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return _tasked(spark, d).drop("ms", "hi", "lo", "generation_ms", "vnode")


def _hex(name: str = "stream_id"):
    return si.hex_id(F.col(name)).alias("stream_id")


def _time():
    return tu.from_parts(F.col("ticks"), F.col("low")).alias("cdc_time")


# Rows of the log.


@_query(f"with {_L} select op as operation, {_OPS}[op + 1] as name, count(*) as n from l group by 1, 2")
def op_counts(spark, d):
    """Log rows by operation."""
    return _rows(spark, d).groupBy(F.col("operation").cast("int").alias("operation")).agg(F.count(F.lit(1)).alias("n")).select("operation", tx.operation_name(F.col("operation")).alias("name"), "n")


@_query(f"with {_L}, {_TASKED} select gen as generation_ms, gen + (ms - gen) // 30000 * 30000 as window_start_ms, count(*) as n from t where gen is not null group by 1, 2")
def window_counts(spark, d):
    """Log rows by reading window, counted from the start of the generation."""
    rows = _tasked(spark, d).where("generation_ms is not null")
    start = F.col("generation_ms") + tu.int_div(F.col("ms") - F.col("generation_ms"), WINDOW_MS) * WINDOW_MS
    return rows.groupBy("generation_ms", start.alias("window_start_ms")).agg(F.count(F.lit(1)).alias("n"))


@_query(f"with {_L} select s as stream_id, {_TEXT} as cdc_time, q as batch_seq_no, ticks, (ticks - 122192928000000000) // 10 as micros, {_MS} as millis, strftime(make_timestamp({_MS} * 1000), '%d/%m/%Y, %H:%M:%S.%g') as text from l")
def timeuuid_decode(spark, d):
    """Ticks, microseconds, milliseconds and text of each change's time."""
    t = F.col("ticks")
    return _rows(spark, d).select(_hex(), _time(), "batch_seq_no", "ticks", tu.micros(t).alias("micros"), tu.millis(t).alias("millis"), tx.timestamp(tu.millis(t)).alias("text"))


def _sql_uuid(ticks: str, low: str) -> str:
    h = f"lpad(to_hex({ticks})::varchar, 15, '0')"
    return f"lower(substr({h}, 8, 8) || '-' || substr({h}, 4, 4) || '-1' || substr({h}, 1, 3)) || '-{low[:4]}-{low[4:]}'"


@_query(f"""select distinct window_start_ms, window_end_ms, {_sql_uuid('window_start_ms * 10000 + 122192928000000000', tu.LOW_START)} as first, {_sql_uuid('window_end_ms * 10000 + 122192928000000000 - 1', tu.LOW_END)} as last,
    {_sql_uuid('window_start_ms * 10000 + 122192928000000000 + 5000', tu.LOW_MIDDLE)} as middle from task_runs""")
def timeuuid_bounds(spark, d):
    """The time UUIDs between which a window's changes lie."""
    s, e = F.col("window_start_ms"), F.col("window_end_ms")
    return table(spark, d, "task_runs").select("window_start_ms", "window_end_ms").distinct().select("*", tu.start_of(s).alias("first"), tu.end_of(e - 1).alias("last"), tu.middle_of(s).alias("middle"))


@_query(f"with {_L} select s as stream_id, {_TEXT} as cdc_time, q as batch_seq_no, row_number() over (partition by s order by ticks, q, u) as place from l")
def stream_order(spark, d):
    """The place of each change in its stream."""
    rows = _rows(spark, d).select(*IDENTITY)
    placed = ordered.row_numbers(rows, ["stream_id"], ["ticks", "batch_seq_no", "low"], tu.int_div(F.col("ticks"), AN_HOUR), "place")
    return placed.select(_hex(), _time(), "batch_seq_no", "place")


@_query(f"with k as (select distinct lower(hex(stream_id)) as s from cdc_streams) select s as stream_id, row_number() over (order by {_SIGNED.format('s')}) as place from k")
def stream_rank(spark, d):
    """The order of streams, by signed bytes. One row per stream is ranked through ranges of its leading word."""
    hi, lo = si.order_keys(si.hex_id(F.col("stream_id")))
    rows = table(spark, d, "cdc_streams").select("stream_id").distinct().withColumns({"hi": hi, "lo": lo, "all": F.lit(1)})
    return ordered.row_numbers(rows, ["all"], ["hi", "lo"], F.shiftright("hi", 54), "place").select(_hex(), "place")


@_query(f"with {_L} select op as operation, case when v is not null then 'set' when dv then 'nulled' else 'untouched' end as state, count(*) as n, count(*) filter (eob) as n_end_of_batch from l group by 1, 2")
def column_state(spark, d):
    """What changes do to `v`: set it, set it to null, or leave it."""
    rows = _rows(spark, d)
    return rows.groupBy(F.col("operation").cast("int").alias("operation"), logs.column_state(F.col("v"), F.col("deleted_v")).alias("state")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("end_of_batch"), 1)).alias("n_end_of_batch"))


@_query(f"with {_L} select lower(hex(\"cdc$stream_id\")) as stream_id, n from (select s, count(*) as n from l where {_MS} >= 1706540400000 and {_MS} < 1706544000000 group by 1) k join (select distinct \"cdc$stream_id\" from simple_scylla_cdc_log) on lower(hex(\"cdc$stream_id\")) = s")
def log_window(spark, d):
    """Log rows of an hour, by stream."""
    return logs.window_of(_rows(spark, d), 1706540400000, 1706544000000).groupBy("stream_id").agg(F.count(F.lit(1)).alias("n")).select(_hex(), "n")


@_query(f"""with {_L}, r as (select distinct run_id, split_part(task_id, ':', 2)::bigint as gen, split_part(task_id, ':', 3)::int as vnode, window_start_ms as ws, window_end_ms as we, lower(hex(last_change_stream_id)) as ls,
    ('0x' || substr(replace(last_change_time, '-', ''), 14, 3) || substr(replace(last_change_time, '-', ''), 9, 4) || substr(replace(last_change_time, '-', ''), 1, 8))::bigint as lt from task_runs where status = 'failed' and last_change_time is not null and last_change_stream_id is not null), {_TASKED}
    select run_id, count(*) as n from t join r on t.gen = r.gen and t.vnode = r.vnode and ms >= ws and ms < we where {_SIGNED.format('s')} > {_SIGNED.format('ls')} or s = ls and ticks > lt group by 1""")
def resume_after_checkpoint(spark, d):
    """For each failed attempt, the changes of its window after the last it handed over."""
    runs = ledger.attempts(table(spark, d, "task_runs")).where("status = 'failed' and last_ticks is not null and last_hi is not null").drop("table_name", "task_id")
    width = max(1, int(runs.agg(F.avg(F.col("window_end_ms") - F.col("window_start_ms"))).first()[0] or 1))
    cell = lambda c: tu.int_div(c, width)
    cells = runs.withColumn("cell", F.explode(F.sequence(cell(F.col("window_start_ms")), cell(F.col("window_end_ms") - 1))))
    rows = _tasked(spark, d).select("generation_ms", "vnode", "ms", "hi", "lo", "ticks", cell(F.col("ms")).alias("cell"))
    met = rows.join(cells, ["generation_ms", "vnode", "cell"]).where("ms >= window_start_ms and ms < window_end_ms")
    rest = met.where("hi > last_hi or (hi = last_hi and (lo > last_lo or (lo = last_lo and ticks > last_ticks)))")
    return rest.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@_query(f"with {_L}, {_TASKED} select gen as generation_ms, count(*) as n, min(ms) as first_ms, max(ms) as last_ms from t group by 1")
def changes_by_generation(spark, d):
    """Changes by the generation that holds their stream at their time."""
    return _tasked(spark, d).groupBy("generation_ms").agg(F.count(F.lit(1)).alias("n"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))


@_query(f"""with {_L} select s as stream_id, {_TEXT} as cdc_time, q as batch_seq_no, {_MS} + ttl * 1000 as expires_ms, {_MS} + ttl * 1000 <= 1707000000000 as expired from l where ttl is not null""")
def ttl_expiry(spark, d):
    """When written values expire."""
    at = tu.millis(F.col("ticks")) + F.col("ttl") * 1000
    return _rows(spark, d).where("ttl is not null").select(_hex(), _time(), "batch_seq_no", at.alias("expires_ms"), (at <= NOW_MS).alias("expired"))


@_query(f"""with {_L} select lpad(substr(s, 1, 24), 24, ' ') || ' | ' || strftime(make_timestamp({_MS} * 1000), '%d/%m/%Y, %H:%M:%S.%g') || ' | ' || lpad(q::varchar, 4, ' ') || ' | ' || lpad(substr({_OPS}[op + 1], 1, 24), 24, ' ')
    || ' | ck=' || coalesce(ck::varchar, 'null') || ' | deleted_v=' || dv::varchar || ' | pk=' || coalesce(pk::varchar, 'null') || ' | v=' || coalesce(v::varchar, 'null') as line from l""")
def pretty_rows(spark, d):
    """Each log row as a line of text."""
    rows = _rows(spark, d)
    known = [c for c in rows.columns if c not in ("ck", "deleted_v", "pk", "v")]
    return pretty(rows.select(*known, "ck", "deleted_v", "pk", "v"))


@_query("select count(*) as n, count(distinct delivery_id) as n_deliveries, count(v) as n_values from simple_scylla_cdc_log")
def base_columns(spark, d):
    """Counts over the columns that aren't the log's own."""
    return logs.base_columns(table(spark, d, LOG)).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("delivery_id").alias("n_deliveries"), F.count("v").alias("n_values"))


@_query("select delivery_id, delivery_batch, received_at, pk, ck, v from simple_scylla_cdc_log")
def base_rows(spark, d):
    """Each delivered copy without the log's own columns."""
    return logs.base_columns(table(spark, d, LOG)).select("delivery_id", "delivery_batch", "received_at", "pk", "ck", "v")


@_query("""select lower(hex("cdc$stream_id")) as stream_id, "cdc$time" as time, "cdc$batch_seq_no" as batch_seq_no, ("cdc$operation")::int as operation, "cdc$end_of_batch" as end_of_batch, "cdc$ttl" as ttl, "cdc$deleted_v" as deleted_v from simple_scylla_cdc_log""")
def meta_rows(spark, d):
    """The log's own columns of each delivered copy."""
    own = logs.meta_columns(table(spark, d, LOG)).withColumnsRenamed({f"cdc${c}": c for c in ("stream_id", "time", "batch_seq_no", "operation", "end_of_batch", "ttl", "deleted_v")})
    return own.select(_hex(), "time", "batch_seq_no", F.col("operation").cast("int").alias("operation"), "end_of_batch", "ttl", "deleted_v")


@_query(f"with {_L} select s as stream_id, count(*) as n from l group by 1")
def dedup_replay(spark, d):
    """The log delivered twice over still has each log row once."""
    log = table(spark, d, LOG)
    return logs.distinct_rows(log.unionByName(log)).groupBy("stream_id").agg(F.count(F.lit(1)).alias("n")).select(_hex(), "n")


@_query("""select 'events' as source, strftime(ts, '%Y-%m-%d') as day, count(*) as n from events group by all union all
    select 'orders', strftime(o_orderdate, '%Y-%m-%d'), count(*) from orders group by all union all
    select 'log', strftime(received_at, '%Y-%m-%d'), count(*) from simple_scylla_cdc_log group by all""")
def multi_table_feed(spark, d):
    """Several tables as one feed, counted by day."""
    feeds = [table(spark, d, t).select(F.lit(n).alias("source"), tx.date(F.col(c)).alias("day")) for n, t, c in (("events", "events", "ts"), ("orders", "orders", "o_orderdate"), ("log", LOG, "received_at"))]
    return feeds[0].unionByName(feeds[1]).unionByName(feeds[2]).groupBy("source", "day").agg(F.count(F.lit(1)).alias("n"))


# Deletions, images and table states.

_D = """d as (select pk, null::bigint as lo, null::bigint as hi, ticks, q from l where op = 4 union all select pk, ck, ck, ticks, q from l where op = 3
    union all select a.pk, a.ck::bigint + (a.op = 6)::int, b.ck::bigint - (b.op = 8)::int, b.ticks, b.q from l a join l b on a.pk = b.pk and a.s = b.s and a.u = b.u and b.q = a.q + 1 where a.op in (5, 6) and b.op in (7, 8))"""
_G = "g as (select k.pk, k.ck, max(struct_pack(t := d.ticks, q := d.q)) filter (d.ticks is not null) as gone from k left join d on d.pk = k.pk and coalesce(k.ck >= lo, true) and coalesce(k.ck <= hi, true) group by all)"


@_query(f"""with {_L} select a.s as stream_id, substr(a.u, 1, 8) || '-' || substr(a.u, 9, 4) || '-' || substr(a.u, 13, 4) || '-' || substr(a.u, 17, 4) || '-' || substr(a.u, 21) as cdc_time, a.q as start_seq, a.pk, a.ck as lo, b.ck as hi, a.op = 5 as lo_incl, b.op = 7 as hi_incl
    from l a join l b on a.pk = b.pk and a.s = b.s and a.u = b.u and b.q = a.q + 1 where a.op in (5, 6) and b.op in (7, 8)""")
def range_delete_pairs(spark, d):
    """Range deletions, their bounds paired."""
    return apply.paired(_rows(spark, d), SIMPLE).select(_hex(), _time(), "start_seq", "pk", F.col("l_ck").alias("lo"), F.col("r_ck").alias("hi"), F.col("l_incl").alias("lo_incl"), F.col("r_incl").alias("hi_incl"))


@_query(f"""with {_L} select s as stream_id, {_TEXT} as cdc_time, q as batch_seq_no from l a where op in (5, 6) and not exists (select 1 from l b where b.pk = a.pk and b.s = a.s and b.u = a.u and b.q = a.q + 1 and b.op in (7, 8))
    union all select s, {_TEXT}, q from l a where op in (7, 8) and not exists (select 1 from l b where b.pk = a.pk and b.s = a.s and b.u = a.u and b.q = a.q - 1 and b.op in (5, 6))""")
def unpaired_bounds(spark, d):
    """Range bounds without their partner."""
    return apply.unpaired(_rows(spark, d), SIMPLE).select(_hex(), _time(), F.when(F.col("no_left"), F.col("start_seq") + 1).otherwise(F.col("start_seq")).alias("batch_seq_no"))


@_query(f"""with {_L}, {_D}, k as (select distinct pk, ck from l where op in (1, 2)), {_G},
    w as (select l.pk, l.ck, max(struct_pack(t := ticks, q := q, has := v is not null, v := v)) filter (v is not null or dv) as w, bool_or(op = 2) as i from l join g on g.pk = l.pk and g.ck = l.ck where op in (1, 2) and (gone is null or struct_pack(t := ticks, q := q) > gone) group by 1, 2)
    select pk, ck, w.v as v from w where i or w.v is not null""")
def table_state_delta(spark, d):
    """The table from inserts, updates and deletions."""
    return apply.state(_rows(spark, d), SIMPLE, "delta")


@_query(f"""with {_L}, {_D}, k as (select distinct pk, ck from l where op = 9), {_G},
    p as (select *, last_value(case when op in (1, 2) then op end ignore nulls) over (partition by s order by ticks, q, u rows unbounded preceding) as kind from l where op in (1, 2, 9)),
    w as (select p.pk, p.ck, max(struct_pack(t := ticks, q := q, has := v is not null, v := v)) as w, bool_or(kind = 2) as i from p join g on g.pk = p.pk and g.ck = p.ck where op = 9 and kind is not null and (gone is null or struct_pack(t := ticks, q := q) > gone) group by 1, 2)
    select pk, ck, w.v as v from w where i or w.v is not null""")
def table_state_postimage(spark, d):
    """The table from post-images and deletions."""
    return apply.state(_rows(spark, d), SIMPLE, "postimage")


@_query(f"""with {_L}, {_D}, k as (select distinct pk, ck from l where op in (1, 2)), {_G},
    w as (select l.pk, l.ck, max(struct_pack(t := ticks, q := q, has := v is not null, v := v, e := {_MS} + ttl * 1000)) filter (v is not null or dv) as w, bool_or(op = 2 and (ttl is null or {_MS} + ttl * 1000 > 1707000000000) and t = ticks and r = q) as i
        from (select *, max(ticks) filter (op = 2) over w2 as t, last_value(case when op = 2 then q end ignore nulls) over (partition by pk, ck order by ticks, q rows between unbounded preceding and unbounded following) as r from l where op in (1, 2) window w2 as (partition by pk, ck)) l join g on g.pk = l.pk and g.ck = l.ck
        where op in (1, 2) and (gone is null or struct_pack(t := ticks, q := q) > gone) group by 1, 2)
    select pk, ck, case when w.e is null or w.e > 1707000000000 then w.v end as v from w where i or (w.v is not null and (w.e is null or w.e > 1707000000000))""")
def table_state_ttl(spark, d):
    """The table at a moment, without values whose TTL has passed."""
    return apply.state(_rows(spark, d), SIMPLE, "delta", now_ms=NOW_MS)


@_query(f"""with {_L}, {_D}, p as (select * from l where op = 0), k as (select p.pk, p.ck, p.ticks as pt, p.q as aq, p.u as au, p.v as expected, max(struct_pack(t := d.ticks, q := d.q)) filter (d.ticks is not null) as gone from p left join d on d.pk = p.pk and coalesce(p.ck >= lo, true) and coalesce(p.ck <= hi, true) and struct_pack(t := d.ticks, q := d.q) < struct_pack(t := p.ticks, q := p.q) group by all),
    w as (select k.pk, k.ck, pt, aq, au, expected, max(struct_pack(t := ticks, q := q, v := v)) filter (v is not null or dv) as w, coalesce(bool_or(op = 2), false) as i from k left join l on l.pk = k.pk and l.ck = k.ck and op in (1, 2) and struct_pack(t := ticks, q := q) < struct_pack(t := pt, q := aq) and (gone is null or struct_pack(t := ticks, q := q) > gone) group by all)
    select pk, ck, pt as ticks, aq as seq, expected, w.v as actual, i or w.v is not null as found from w where w.v is distinct from expected""")
def preimage_mismatches(spark, d):
    """Pre-images that differ from the row as it was before them."""
    return replay.image_mismatches(table(spark, d, LOG)).drop("low")


# Generations and tasks.


@_query("select generation_start_ms, lead(generation_start_ms) over (order by generation_start_ms) as generation_end_ms from (select distinct epoch_ms(date_trunc('day', ts)) as generation_start_ms from events)")
def generation_bounds(spark, d):
    """Daily generations over the events: each ends where the next begins."""
    return generations.bounds(_days(spark, d))


def _days(spark, d):
    return table(spark, d, "events").select(F.unix_millis(F.date_trunc("day", F.col("ts")).cast("timestamp")).alias("generation_start_ms")).distinct()


_DAYS = "g as (select generation_start_ms, lead(generation_start_ms) over (order by generation_start_ms) as generation_end_ms from (select distinct epoch_ms(date_trunc('day', ts)) as generation_start_ms from events))"


@_query("select min(generation_start_ms) as generation_start_ms from (select distinct epoch_ms(date_trunc('day', ts)) as generation_start_ms from events) where generation_start_ms > 1704844800000")
def generation_after(spark, d):
    """The first generation after a time."""
    return generations.first_after(_days(spark, d), 1704844800000)


@_query(f"with {_DAYS} select generation_start_ms, generation_end_ms from g where generation_end_ms < 1706745600000 - 864000000")
def generation_ttl_skip(spark, d):
    """Generations whose changes have passed the longest TTL of two tables."""
    seen = generations.last_visible_ms(1706745600000, [864000, 86400])
    return generations.expired(generations.bounds(_days(spark, d)), seen)


@_query(f"with {_DAYS} select generation_start_ms, generation_end_ms from g where generation_start_ms > 1704153600000 and (generation_end_ms is null or generation_end_ms >= 1706745600000 - 864000000) order by 1 limit 1")
def generation_next(spark, d):
    """The generation to read next, expired ones being skipped."""
    return generations.next_to_read(generations.bounds(_days(spark, d)), 1704153600000, generations.last_visible_ms(1706745600000, [864000, 86400]))


@_query(f"""select generation_start_ms as generation_ms, vnode, string_agg(s, ',' order by {_SIGNED.format('s')}) as streams, count(*) as n from (select distinct generation_start_ms, vnode, lower(hex(stream_id)) as s from cdc_streams) group by 1, 2""")
def vnode_tasks(spark, d):
    """Tasks with their streams in order."""
    return tasks.tasks(table(spark, d, "cdc_streams"), [TABLE]).select("generation_ms", "vnode", F.array_join("streams", ",").alias("streams"), F.size("streams").cast("bigint").alias("n"))


@_query("select lower(hex(stream_id)) as stream_id, vnode, (('0x' || substr(lower(hex(stream_id)), 25, 8))::bigint & 67108848) >> 4 = vnode as same from cdc_streams")
def vnode_decode(spark, d):
    """The vnode that a stream id says, against the one stored."""
    return table(spark, d, "cdc_streams").select(_hex(), "vnode", (si.vnode(si.hex_id(F.col("stream_id"))) == F.col("vnode")).alias("same"))


@_query("select t || ':' || generation_start_ms || ':' || vnode as task_id, count(distinct stream_id) as n from cdc_streams, (values ('ks.simple'), ('ks.t')) v(t) group by 1")
def tasks_cross_tables(spark, d):
    """Tasks of several tables over the same streams."""
    return tasks.tasks(table(spark, d, "cdc_streams"), [TABLE, "ks.t"]).select(tasks.task_key(F.col("table_name"), F.col("generation_ms"), F.col("vnode")).alias("task_id"), F.size("streams").cast("bigint").alias("n"))


# Metadata of generations, in the forms in which it is kept.


def _as_v2(spark, d) -> DataFrame:
    """Several rows per generation, one for each vnode with its streams."""
    return table(spark, d, "cdc_streams").groupBy("generation_start_ms", "vnode").agg(F.collect_set("stream_id").alias("streams")).drop("vnode")


def _as_tablets(spark, d) -> DataFrame:
    """A row per table, generation and stream, with its state: current, closed or opened."""
    tables = F.explode(F.array(F.lit(TABLE), F.lit("ks.t"))).alias("table_name")
    return table(spark, d, "cdc_streams").select(tables, "generation_start_ms", "stream_id", F.col("vnode")).withColumn("stream_state", F.when(F.col("table_name") == TABLE, F.col("vnode") % 3).otherwise(0)).drop("vnode")


@_query("select distinct generation_start_ms, lower(hex(stream_id)) as stream_id from cdc_streams")
def streams_v2(spark, d):
    """Streams of each generation from rows with sets of them."""
    return generations.streams_of(_as_v2(spark, d), generations.pick_form({"cdc_streams_descriptions_v2", "cdc_streams_descriptions"}, True)).select("generation_start_ms", _hex())


@_query("select distinct generation_start_ms, lower(hex(stream_id)) as stream_id from cdc_streams")
def streams_v1(spark, d):
    """The same from the older form, a row per generation. Its streams are as many as the cluster has vnodes and shards."""
    rows = table(spark, d, "cdc_streams").groupBy("generation_start_ms").agg(F.collect_set("stream_id").alias("streams"))
    return generations.streams_of(rows, generations.pick_form({"cdc_streams_descriptions"}, False)).select("generation_start_ms", _hex())


@_query("select 'ks.simple' as table_name, generation_start_ms, lower(hex(stream_id)) as stream_id from cdc_streams where vnode % 3 = 0 union select 'ks.t', generation_start_ms, lower(hex(stream_id)) from cdc_streams")
def streams_of_tablets(spark, d):
    """Current streams of each table that keeps its own."""
    return generations.streams_of(_as_tablets(spark, d), "tablets").select("table_name", "generation_start_ms", _hex())


@_query("select distinct 'v1' as form, generation_start_ms from cdc_streams union all select distinct 'v2', generation_start_ms from cdc_streams")
def generation_timestamps(spark, d):
    """The times of generations from both forms of metadata."""
    v1 = table(spark, d, "cdc_streams").groupBy("generation_start_ms").agg(F.collect_set("stream_id").alias("streams"))
    return generations.timestamps(v1, "v1").select(F.lit("v1").alias("form"), "generation_start_ms").unionByName(generations.timestamps(_as_v2(spark, d)).select(F.lit("v2").alias("form"), "generation_start_ms"))


_TABLES = "(select 'ks.simple' as table_name, epoch_ms(date_trunc('day', ts)) as generation_start_ms from events union select 'ks.t', epoch_ms(date_trunc('week', ts)) from events)"


def _per_table(spark, d) -> DataFrame:
    """Generations of two tables, daily and weekly over the events."""
    ts = lambda unit: F.unix_millis(F.date_trunc(unit, F.col("ts")).cast("timestamp")).alias("generation_start_ms")
    e = table(spark, d, "events")
    return e.select(F.lit(TABLE).alias("table_name"), ts("day")).unionByName(e.select(F.lit("ks.t").alias("table_name"), ts("week"))).distinct()


@_query(f"select table_name, min(generation_start_ms) as generation_start_ms from {_TABLES} where generation_start_ms > 1704844800000 group by 1")
def table_generation_after(spark, d):
    """For each table the first of its generations after a time."""
    return generations.first_after(generations.timestamps(_per_table(spark, d), "tablets", ["table_name"]), 1704844800000, ["table_name"])


@_query(f"""with g as (select *, lead(generation_start_ms) over (partition by table_name order by generation_start_ms) as generation_end_ms from {_TABLES})
    select table_name, min(generation_start_ms) as generation_start_ms, arg_min(generation_end_ms, generation_start_ms) as generation_end_ms from g where generation_start_ms > 1704153600000 and (generation_end_ms is null or generation_end_ms >= 1706745600000 - 1728000000) group by 1""")
def table_generation_next(spark, d):
    """For each table the generation to read next."""
    return generations.next_to_read(generations.bounds(_per_table(spark, d), ["table_name"]), 1704153600000, generations.last_visible_ms(1706745600000, [1728000]), ["table_name"])


@_query(f"""with {_DAYS}, done as (select epoch_ms(date_trunc('day', ts)) as generation_start_ms, bool_and(event_id is not null) as done from events where ts < '2024-01-12' group by 1)
    select generation_start_ms, generation_end_ms from g left join done using (generation_start_ms) where generation_end_ms is null or not coalesce(done, false) and generation_end_ms >= 1706745600000 - 2592000000 order by 1 limit 1""")
def generation_current(spark, d):
    """Where the steps from one finished generation to the next have come."""
    day = F.unix_millis(F.date_trunc("day", F.col("ts")).cast("timestamp"))
    done = table(spark, d, "events").where("ts < '2024-01-12'").groupBy(day.alias("generation_start_ms")).agg(F.bool_and(F.col("event_id").isNotNull()).alias("done"))
    return generations.current(generations.bounds(_days(spark, d)), done, generations.last_visible_ms(1706745600000, [2592000]))


@_query("""with a as (select distinct table_name from change_schema union select 'zz.' || split_part(table_name, '.', 2) from change_schema union select table_name || '_x' from change_schema),
      k as (select table_name, count(distinct file_id) % 5 <> 0 as cdc from change_schema group by 1)
    select a.table_name, case when starts_with(a.table_name, 'zz.') then 'no keyspace zz' when k.cdc is null then 'no table ' || a.table_name when not k.cdc then a.table_name || ' keeps no log' end as problem from a left join k using (table_name)""")
def catalog_check(spark, d):
    """Which of the tables asked for can be read, and why not the others."""
    h = table(spark, d, "change_schema").where("table_name is not null")
    known = h.groupBy("table_name").agg((F.count_distinct("file_id") % 5 != 0).alias("cdc_enabled"))
    names = F.explode(F.array(F.col("table_name"), F.concat(F.lit("zz."), F.substring_index("table_name", ".", -1)), F.concat("table_name", F.lit("_x"))))
    return catalog.check(h.select("table_name").distinct().select(names.alias("table_name")), known)


@_query("select distinct run_id, nullif((run_id % 7) * 3600, 0) as ttl_s from task_runs")
def table_ttl(spark, d):
    """How long changes are kept, from its text; 0 is for ever."""
    return table(spark, d, "task_runs").select("run_id").distinct().select("run_id", catalog.ttl_of((F.col("run_id") % 7 * 3600).cast("string")).alias("ttl_s"))


@_query("select distinct window_start_ms, window_start_ms + 90000 as seconds, window_start_ms + (window_start_ms // 1000 % 7) * 3600000 as hours, window_end_ms - 2 * 86400000 as days from task_runs")
def timestamp_plus(spark, d):
    """Moments moved by amounts of a unit."""
    s = F.col("window_start_ms")
    return table(spark, d, "task_runs").select("window_start_ms", tu.plus(s, 90, "seconds").alias("seconds"), tu.plus(s, tu.int_div(s, 1000) % 7, "hours").alias("hours"), tu.plus(F.col("window_end_ms"), -2, "days").alias("days")).distinct()


@_query(f"""with {_L} select s as stream_id, {_TEXT} as cdc_time, q as batch_seq_no, lower(lpad(to_hex((pk::bigint + 4294967296) % 4294967296), 8, '0')) as pk, lower(lpad(to_hex((v::bigint + 4294967296) % 4294967296), 8, '0')) as v, lower(lpad(to_hex(ttl), 16, '0')) as ttl, u as time, lower(hex(encode({_OPS}[op + 1]))) as name, case when dv then '01' else '00' end as deleted from l""")
def raw_bytes(spark, d):
    """The bytes of a row's values."""
    hexed = lambda c, kind: F.lower(F.hex(tx.raw(c, kind)))
    return _rows(spark, d).select(_hex(), _time(), "batch_seq_no", hexed(F.col("pk"), "int").alias("pk"), hexed(F.col("v"), "int").alias("v"), hexed(F.col("ttl"), "bigint").alias("ttl"), hexed(tu.from_parts(F.col("ticks"), F.col("low")), "uuid").alias("time"), hexed(tx.operation_name(F.col("operation")), "string").alias("name"), hexed(F.col("deleted_v"), "boolean").alias("deleted"))


_SAVED = f"saved as (select {_PARTS}, max(window_end_ms) as ws, max(window_end_ms) + 30000 as we from task_runs where status = 'succeeded' group by 1, 2, 3)"
_WANTED = "wanted as (select distinct 'ks.simple' as table_name, generation_start_ms as generation_ms, vnode from cdc_streams)"


def _saved(spark, d) -> DataFrame:
    """The state that succeeded attempts left: the window after the last one read."""
    done = tasks.from_key(table(spark, d, "task_runs").where("status = 'succeeded'"))
    last = done.groupBy(*tasks.TASK).agg(F.max("window_end_ms").alias("window_start_ms"))
    return last.select(*tasks.TASK, "window_start_ms", (F.col("window_start_ms") + WINDOW_MS).alias("window_end_ms"), F.lit(None).cast("string").alias("last_stream"), F.lit(None).cast("string").alias("last_time"))


@_query(f"with {_SAVED}, {_WANTED} select table_name, generation_ms, vnode, coalesce(ws, generation_ms) as window_start_ms, coalesce(we, generation_ms + 30000) as window_end_ms from wanted left join saved using (table_name, generation_ms, vnode)")
def task_states(spark, d):
    """Every task with its saved state, or the first window of its generation."""
    return tasks.with_states(tasks.tasks(table(spark, d, "cdc_streams"), [TABLE]), _saved(spark, d), WINDOW_MS).drop("last_stream", "last_time")


@_query(f"with {_SAVED}, {_WANTED}, s as (select table_name, generation_ms, vnode, coalesce(ws, generation_ms) as ws, coalesce(we, generation_ms + 30000) as we from wanted left join saved using (table_name, generation_ms, vnode)) select table_name, generation_ms, vnode, case when we < 1706940000000 then 1706940000000 else ws end as window_start_ms, case when we < 1706940000000 then 1706940030000 else we end as window_end_ms from s")
def ttl_trim(spark, d):
    """States moved up to what TTL still shows."""
    states = tasks.with_states(tasks.tasks(table(spark, d, "cdc_streams"), [TABLE]), _saved(spark, d), WINDOW_MS)
    return tasks.trimmed(states, 1706940000000, WINDOW_MS).drop("last_stream", "last_time")


@_query(f"with {_SAVED} select table_name, generation_ms, vnode, ws as window_start_ms, we as window_end_ms from saved where we + 30000 <= 1707000000000")
def readable_windows(spark, d):
    """Windows that are safe to read."""
    return tasks.readable(_saved(spark, d), NOW_MS, CONFIDENCE_MS).drop("last_stream", "last_time")


@_query(f"with {_SAVED} select table_name, generation_ms, vnode, we as window_start_ms, we + 30000 as window_end_ms from saved")
def moved_windows(spark, d):
    """States after their windows were read."""
    return tasks.moved(_saved(spark, d), WINDOW_MS).drop("last_stream", "last_time")


@_query(f"with {_SAVED}, {_WANTED} select generation_ms, bool_and(coalesce(ws > 1707000000000, false)) as done from wanted left join saved using (table_name, generation_ms, vnode) group by 1")
def generation_done(spark, d):
    """Whether all tasks of a generation have moved past a time."""
    return tasks.all_consumed(tasks.tasks(table(spark, d, "cdc_streams"), [TABLE]), _saved(spark, d), NOW_MS)


@_query("select 'ks.t' as table_name, generation_start_ms as generation_ms, vnode from cdc_streams group by all")
def obsolete_tasks(spark, d):
    """Tasks of a configuration of two tables that one without `ks.t` no longer has."""
    streams = table(spark, d, "cdc_streams")
    return tasks.obsolete(tasks.tasks(streams, [TABLE, "ks.t"]), tasks.tasks(streams, [TABLE])).select(*tasks.TASK)


@_query(f"""with {_SAVED}, a as (select * from saved where ws <= 1707000000000), r as (select distinct *, {_PARTS} from task_runs) select run_id, task_id, status from r semi join a using (table_name, generation_ms, vnode)""")
def active_task_guard(spark, d):
    """Attempts of tasks that are still active: those that have not yet reached a time."""
    runs = tasks.from_key(table(spark, d, "task_runs").distinct())
    return tasks.active_only(runs, _saved(spark, d).where(F.col("window_start_ms") <= NOW_MS)).select("run_id", "task_id", "status")


@_query(f"""with {_L}, {_TASKED}, k as (select gen, vnode, s, ticks, u, row_number() over (partition by gen, vnode order by {_SIGNED.format('s')} desc, ticks desc, u desc) as k from t where eob and gen is not null)
    select 'ks.simple' as table_name, gen as generation_ms, vnode, s as last_stream, {_TEXT} as last_time from k where k = 1""")
def checkpoint_per_task(spark, d):
    """The last change of each task at which a batch ended."""
    rows = _tasked(spark, d).where("generation_ms is not null").withColumn("table_name", F.lit(TABLE))
    return tasks.checkpoints(rows).select(*tasks.TASK, "last_stream", tu.from_parts(F.col("last_ticks"), F.col("last_low")).alias("last_time"))


@_query("""select task_id, row_number() over (order by split_part(task_id, ':', 2)::bigint, split_part(task_id, ':', 3)::int, split_part(task_id, ':', 1)) as place from (select distinct task_id from task_runs)""")
def task_order(spark, d):
    """Tasks in their order: generation, vnode, table."""
    named = tasks.from_key(table(spark, d, "task_runs").select("task_id").distinct()).withColumn("all", F.lit(1))
    return ordered.row_numbers(named, ["all"], ["generation_ms", "vnode", "table_name"], F.struct("generation_ms", F.shiftright("vnode", 10)), "place").select("task_id", "place")


@_query("""select distinct task_id, window_start_ms, window_end_ms, case when last_change_time is not null then lower(hex(last_change_stream_id)) end as last_stream, case when last_change_stream_id is not null then lower(last_change_time) end as last_time,
    '{window_start=' || window_start_ms || ', window_end=' || window_end_ms || coalesce(', change_id_stream=' || hex(last_change_stream_id) || ', change_id_time=' || lower(last_change_time), '') || '}' as text from task_runs""")
def state_codec_roundtrip(spark, d):
    """States written as text maps and read again."""
    runs = tasks.from_key(table(spark, d, "task_runs"))
    key = tasks.task_key(F.col("table_name"), F.col("generation_ms"), F.col("vnode"))
    coded = runs.select(key.alias("task_id"), tasks.encode_state(F.col("window_start_ms"), F.col("window_end_ms"), F.hex("last_change_stream_id"), F.col("last_change_time")).alias("m"))
    text = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"])), ", "), F.lit("}"))
    return coded.select("task_id", *[c.alias(n) for n, c in tasks.decode_state(F.col("m")).items()], text.alias("text")).distinct()


@_query("""select run_id, attempt, least(30000.0, 50 * power(2.0, attempt))::bigint as delay_ms from (select distinct run_id, run_id % 14 as attempt from task_runs where status = 'failed')""")
def backoff_delays(spark, d):
    """Delays before retries, without jitter."""
    failed = table(spark, d, "task_runs").where("status = 'failed'").select("run_id", (F.col("run_id") % 14).alias("attempt")).distinct()
    return failed.select("run_id", "attempt", tx.backoff_ms(F.col("attempt"), 50, 30000).alias("delay_ms"))


# Types, schemas and collections.


@_query("""select distinct cdc_log_data_type as spelling, replace(replace(upper(cdc_log_data_type), ' ', ''), ',', ', ') as text from change_schema where cdc_log_data_type is not null""")
def type_text(spark, d):
    """Types as they are spelled, read and written again."""
    return schema.type_texts(table(spark, d, "change_schema").where("cdc_log_data_type is not null").select("cdc_log_data_type").distinct())


@_query("""with h as (select distinct table_name, file_id, column_index, lower(trim(column_name, '" ')) as name, replace(replace(upper(cdc_log_data_type), ' ', ''), ',', ', ') as type, replace(replace(upper(base_table_data_type), ' ', ''), ',', ', ') as base, case when upper(trim(base_table_column_kind)) in ('PARTITION_KEY', 'CLUSTERING_KEY', 'REGULAR') then upper(trim(base_table_column_kind)) end as kind from change_schema)
    select h.table_name, h.file_id, h.column_index, h.name as column_name, h.type as log_type, case when not starts_with(h.name, 'cdc$') then case when y.name is not null then h.base else h.type end end as base_type, y.column_index as deleted_elements,
      case when not starts_with(h.name, 'cdc$') then coalesce(case when h.kind in ('PARTITION_KEY', 'CLUSTERING_KEY') then h.kind end, 'REGULAR') end as kind, x.column_index as deleted from h left join h x on x.file_id = h.file_id and x.table_name = h.table_name and x.name = 'cdc$deleted_' || h.name left join h y on y.file_id = h.file_id and y.table_name = h.table_name and y.name = 'cdc$deleted_elements_' || h.name""")
def schema_inferred(spark, d):
    """The schema of each log file, inferred from its header: kinds, base types, and the places of the columns that say what was set to null or taken out."""
    return schema.inferred(table(spark, d, "change_schema")).where("problem is null").select("table_name", "file_id", "column_index", "column_name", "log_type", "base_type", "kind", "deleted", "deleted_elements")


@_query("""with h as (select distinct table_name, file_id, lower(trim(column_name, '" ')) as name, replace(replace(upper(base_table_data_type), ' ', ''), ',', ', ') as type from change_schema where base_table_data_type is not null),
      f as (select *, regexp_matches(type, '^(FROZEN<)?(LIST|SET|MAP)<') as loose, case when starts_with(type, 'FROZEN<') then substr(type, 8, length(type) - 8) else type end as bare from h)
    select table_name, file_id, name as column_name, bare as base_type, case when not loose then type when starts_with(bare, 'LIST<') then 'FROZEN<MAP<TIMEUUID, ' || substr(bare, 6) || '>' else 'FROZEN<' || bare || '>' end as log_type,
      case when not loose then null when starts_with(bare, 'LIST<') then 'FROZEN<SET<TIMEUUID>>' when starts_with(bare, 'SET<') then 'FROZEN<' || bare || '>' when starts_with(bare, 'MAP<') then 'FROZEN<SET<' || split_part(substr(bare, 5), ',', 1) || '>>' else 'FROZEN<SET<SMALLINT>>' end as deleted_elements from f where not starts_with(bare, 'TUPLE')""")
def schema_of_loose_tables(spark, d):
    """Were all types of these base tables not frozen: the columns of their logs, and the base types inferred back from those."""
    h = table(spark, d, "change_schema").where("base_table_data_type is not null and column_name is not null")
    rows = h.select("table_name", "file_id", drift.norm_name(F.col("column_name")).alias("name"), F.regexp_replace(F.upper("base_table_data_type"), r"\s", "").alias("type")).where("type not like 'FROZEN<TUPLE%'").distinct()

    def run(group):
        import pandas as pd

        bare = {n: schema.Type(t.name, t.args) for n, t in ((n, schema.parse(x)) for n, x in zip(group["name"], group["type"]))}
        logged = schema.log_columns([(n, "REGULAR", t.text()) for n, t in sorted(bare.items())])
        found = schema.infer(logged, {n: ("REGULAR", t.text()) for n, t in bare.items()})
        types = dict(logged)
        out = [(group["table_name"].iloc[0], group["file_id"].iloc[0], c.name, c.base_type.text(), c.log_type.text(), types.get(f"cdc$deleted_elements_{c.name}")) for c in found.base()]
        return pd.DataFrame(out, columns=["table_name", "file_id", "column_name", "base_type", "log_type", "deleted_elements"])

    return rows.groupBy("table_name", "file_id").applyInPandas(run, "table_name string, file_id bigint, column_name string, base_type string, log_type string, deleted_elements string")


@_query("""select table_name, count(distinct lower(trim(column_name, '" '))) filter (not starts_with(lower(trim(column_name, '" ')), 'cdc$')) as n_base, count(distinct lower(trim(column_name, '" '))) filter (starts_with(lower(trim(column_name, '" ')), 'cdc$')) as n_meta from change_schema group by 1""")
def schema_columns(spark, d):
    """Columns of each table's log, its own and the base table's."""
    name = drift.norm_name(F.col("column_name"))
    return table(spark, d, "change_schema").groupBy("table_name").agg(F.count_distinct(F.when(~name.startswith("cdc$"), name)).alias("n_base"), F.count_distinct(F.when(name.startswith("cdc$"), name)).alias("n_meta"))


@_query("""select event_id, case when m < 0 or dd < 0 or n < 0 then '-' else '' end || case when abs(m) >= 12 then (abs(m) // 12) || 'y' else '' end || case when abs(m) % 12 > 0 then (abs(m) % 12) || 'mo' else '' end || case when abs(dd) > 0 then abs(dd) || 'd' else '' end
    || case when h > 0 then h || 'h' else '' end || case when mi > 0 then mi || 'm' else '' end || case when s > 0 then s || 's' else '' end || case when ms > 0 then ms || 'ms' else '' end || case when us > 0 then us || 'us' else '' end || case when ns > 0 then ns || 'ns' else '' end as text
    from (select event_id, sign * (event_id % 29) as m, sign * (event_id % 5) as dd, sign * (x % 5) * x as n, abs((x % 5) * x) // 3600000000000 as h, abs((x % 5) * x) // 60000000000 % 60 as mi, abs((x % 5) * x) // 1000000000 % 60 as s, abs((x % 5) * x) // 1000000 % 1000 as ms, abs((x % 5) * x) // 1000 % 1000 as us, abs((x % 5) * x) % 1000 as ns
        from (select event_id, case when event_id % 3 = 0 then -1 else 1 end as sign, epoch_us(ts) % 86400000000 * 7 as x from events))""")
def duration_text(spark, d):
    """Durations as text."""
    sign = F.when(F.col("event_id") % 3 == 0, -1).otherwise(1)
    x = (F.unix_micros(F.col("ts").cast("timestamp")) % 86400000000) * 7
    return table(spark, d, "events").select("event_id", tx.duration(sign * (F.col("event_id") % 29), sign * (F.col("event_id") % 5), sign * (x % 5) * x).alias("text"))


def _elements(spark, d) -> DataFrame:
    """Events as changes of a collection per user: views and clicks add their element, errors take it out, signups replace all."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, d, "events").where("user_id is not null")
    return e.select("user_id", tu.ticks_of_micros(F.unix_micros(F.col("ts").cast("timestamp"))).alias("ticks"), F.lit(0).alias("batch_seq_no"), (F.col("event_type") == "signup").alias("replace"), "event_type", k.alias("k"), F.col("event_id"))


_E = "e as (select user_id, event_type, (props->>'$.k')::int as k, epoch_us(ts) * 10 + 122192928000000000 as ticks, event_id from events where user_id is not null)"
_ALIVE = "c as (select user_id, k, max(struct_pack(t := ticks, a := event_type <> 'error', v := event_id)) as c from e where k is not null group by 1, 2), o as (select user_id, max(ticks) as over from e where event_type = 'signup' group by 1), a as (select c.* from c left join o using (user_id) where c.c.a and (over is null or c.c.t >= over))"


@_query(f"with {_E}, {_ALIVE} select user_id, string_agg(k::varchar, ',' order by k) as elements from a group by 1")
def collection_set_apply(spark, d):
    """A set that changes add to, take from and replace."""
    e = _elements(spark, d)
    gone = F.col("event_type") == "error"
    rows = e.select("user_id", "ticks", "batch_seq_no", "replace", F.when(~gone, F.array("k")).alias("added"), F.when(gone, F.array("k")).alias("removed"))
    return collections.set_state(rows, ["user_id"]).select("user_id", F.array_join(F.transform("elements", lambda x: x.cast("string")), ",").alias("elements"))


@_query(f"with {_E}, {_ALIVE} select user_id, string_agg(k || '=' || c.v, ',' order by k) as entries from a group by 1")
def collection_map_apply(spark, d):
    """A map that changes put to, take from and replace."""
    e = _elements(spark, d).where("k is not null")
    gone = F.col("event_type") == "error"
    rows = e.select("user_id", "ticks", "batch_seq_no", "replace", F.when(~gone, F.create_map("k", "event_id")).alias("added"), F.when(gone, F.array("k")).alias("removed"))
    return collections.map_state(rows, ["user_id"]).select("user_id", F.array_join(F.transform("entries", lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("entries"))


@_query(f"with {_E} select user_id, string_agg(event_id::varchar, ',' order by ticks) as elements from e where k is not null and event_type <> 'error' and not exists (select 1 from e x where x.user_id = e.user_id and x.event_type = 'signup' and x.ticks > e.ticks) group by 1")
def list_reassembly(spark, d):
    """A list logged as a map by time UUID, put in order again."""
    e = _elements(spark, d).where("k is not null and event_type <> 'error'").select("user_id", "ticks", "batch_seq_no", "replace", F.create_map(tu.from_parts(F.col("ticks"), F.unhex(F.lit(tu.LOW_START))), F.col("event_id")).alias("added"), F.lit(None).cast("array<string>").alias("removed"))
    over = _elements(spark, d).where("k is null and event_type = 'signup'").select("user_id", "ticks", "batch_seq_no", "replace", F.lit(None).cast("map<string,bigint>").alias("added"), F.lit(None).cast("array<string>").alias("removed"))
    return collections.list_state(e.unionByName(over), ["user_id"]).select("user_id", F.array_join(F.transform("elements", lambda x: x.cast("string")), ",").alias("elements"))


#: A base table with every kind of column that isn't frozen: its log is made of the events, a row for each user and day.
MIXED = apply.Keyed(("user_id",), ("day",), ("last_event",), (("tags", "set"), ("counts", "map"), ("items", "list"), ("profile", "udt")))


def _mixed_log(spark, d) -> DataFrame:
    """Events as the log of `MIXED`: views and clicks update a row, signups insert it anew, errors take elements out, purchases delete a row, its day before, or all of its partition."""
    k = F.get_json_object("props", "$.k").cast("int")
    tick = tu.ticks_of_micros(F.unix_micros(F.col("ts").cast("timestamp")))
    kind = F.col("event_type")
    e = table(spark, d, "events").where("user_id is not null").select("event_id", "user_id", F.dayofmonth("ts").alias("day"), kind.alias("kind"), k.alias("k"), tick.alias("ticks"))
    deleted = (F.col("kind") == "purchase")
    gone, over, k = F.col("kind") == "error", F.col("kind") == "signup", F.col("k")
    adds = ~gone & ~deleted & k.isNotNull()
    uuid_of = tu.from_parts(F.col("ticks"), F.unhex(F.lit(tu.LOW_START)))
    fields = F.struct(F.when(k < 5, F.col("event_id")).alias("seen"), F.when(k >= 3, F.concat(F.lit("k"), k.cast("string"))).alias("name"))
    flag = F.when(over, F.lit(True))
    return e.select(
        F.unhex(F.lpad(F.hex("user_id"), 32, "0")).alias("stream_id"), "ticks", F.unhex(F.lit(tu.LOW_START)).alias("low"), F.lit(0).alias("batch_seq_no"), F.lit(None).cast("bigint").alias("ttl"), "user_id",
        F.when(~deleted | (k != 9), F.col("day")).alias("day"), F.when(deleted, F.when(k == 9, F.lit(4)).otherwise(F.lit(3))).when(over, F.lit(2)).otherwise(F.lit(1)).alias("operation"),
        F.when(~deleted, F.col("event_id")).alias("last_event"), F.lit(None).cast("boolean").alias("deleted_last_event"),
        F.when(adds, F.array(k, k + 10)).alias("tags"), flag.alias("deleted_tags"), F.when(gone, F.array(k)).alias("deleted_elements_tags"),
        F.when(adds, F.create_map(k, F.col("event_id"))).alias("counts"), flag.alias("deleted_counts"), F.when(gone, F.array(k)).alias("deleted_elements_counts"),
        F.when(adds, F.create_map(uuid_of, F.col("event_id"))).alias("items"), flag.alias("deleted_items"), F.lit(None).cast("array<string>").alias("deleted_elements_items"),
        F.when(~deleted & ~gone, fields).alias("profile"), flag.alias("deleted_profile"), F.when(gone, F.array((k % 2).cast("smallint"))).alias("deleted_elements_profile"),
    )


_MIXED = """e as (select event_id, user_id, dayofmonth(ts) as day, event_type as kind, (props->>'$.k')::int as k, epoch_us(ts) * 10 + 122192928000000000 as t from events where user_id is not null),
    gone as (select c.user_id, c.day, max(d.t) as gone from (select distinct user_id, day from e) c join e d on d.user_id = c.user_id and d.kind = 'purchase' and coalesce(d.k = 9, false) or d.user_id = c.user_id and d.kind = 'purchase' and d.k is not null and d.day = c.day group by 1, 2),
    w as (select e.* from e left join gone using (user_id, day) where kind <> 'purchase' and (gone is null or t > gone)),
    o as (select user_id, day, max(t) as over from w where kind = 'signup' group by 1, 2)"""


def _mixed_rows(rows: DataFrame) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return rows.select("user_id", "day", "last_event", text("tags").alias("tags"), F.array_join(F.transform("counts", lambda x: F.concat_ws("=", x["key"].cast("string"), x["value"].cast("string"))), ",").alias("counts"), text("items").alias("items"), F.col("profile.seen").alias("seen"), F.col("profile.name").alias("name"))


_MIXED_SQL = f"""with {_MIXED},
    last as (select user_id, day, arg_max(event_id, t) as last_event, bool_or(kind = 'signup') as i from w group by 1, 2),
    el as (select user_id, day, t, kind <> 'error' as a, event_id, unnest(case when kind = 'error' then [k] else [k, k + 10] end) as el from w where k is not null),
    tags as (select user_id, day, string_agg(el::varchar, ',' order by el) as tags from (select user_id, day, el, max(struct_pack(t := t, a := a)) as c from el group by 1, 2, 3) x left join o using (user_id, day) where c.a and (over is null or c.t >= over) group by 1, 2),
    counts as (select user_id, day, string_agg(k || '=' || c.v, ',' order by k) as counts from (select user_id, day, k, max(struct_pack(t := t, a := kind <> 'error', v := event_id)) as c from w where k is not null group by 1, 2, 3) x left join o using (user_id, day) where c.a and (over is null or c.t >= over) group by 1, 2),
    items as (select user_id, day, string_agg(event_id::varchar, ',' order by t) as items from w left join o using (user_id, day) where k is not null and kind <> 'error' and (over is null or t >= over) group by 1, 2),
    prof as (select user_id, day, arg_max(case when kind <> 'error' and k < 5 then struct_pack(v := event_id) else struct_pack(v := null::bigint) end, t) filter (kind = 'signup' or kind <> 'error' and k < 5 or kind = 'error' and k % 2 = 0) as seen,
        arg_max(case when kind <> 'error' and k >= 3 then struct_pack(v := 'k' || k) else struct_pack(v := null::varchar) end, t) filter (kind = 'signup' or kind <> 'error' and k >= 3 or kind = 'error' and k % 2 = 1) as name from w group by 1, 2)
    select user_id, day, last_event, tags, counts, items, seen.v as seen, name.v as name from last left join tags using (user_id, day) left join counts using (user_id, day) left join items using (user_id, day) left join prof using (user_id, day)"""


@_query(_MIXED_SQL)
def collection_replay(spark, d):
    """A table with a set, a map, a list and a type with fields, none frozen, from its log: elements added and taken out, wholes replaced, rows and partitions deleted."""
    return _mixed_rows(apply.state(_mixed_log(spark, d), MIXED))


@_query(_MIXED_SQL)
def state_table_incremental(spark, d):
    """The same, kept up to date over batches, the newest changes coming first."""
    log = _mixed_log(spark, d)
    state = feed.StateTable(spark, shared_dir(spark, "state"), MIXED)
    third = tu.int_div(F.col("ticks") - tu.EPOCH_TICKS, 10 * 86400 * 10_000_000) % 3
    for number, part in enumerate((2, 0, 1)):
        state.fold(log.where(third == part), number)
    return _mixed_rows(state.read())


@_query(f"""with {_L}, p as (select * from l where op = 0 and ck is not null and pk is not null), {_D},
    k as (select p.pk, p.ck, p.ticks as pt, p.q as aq, case when p.ck % 3 = 0 then coalesce(p.v, 0) + 1 else p.v end as expected, max(struct_pack(t := d.ticks, q := d.q)) filter (d.ticks is not null) as gone from p left join d on d.pk = p.pk and coalesce(p.ck >= lo, true) and coalesce(p.ck <= hi, true) and struct_pack(t := d.ticks, q := d.q) < struct_pack(t := p.ticks, q := p.q) group by all),
    w as (select k.pk, k.ck, pt, aq, expected, max(struct_pack(t := ticks, q := q, v := v)) filter (v is not null or dv) as w from k left join l on l.pk = k.pk and l.ck = k.ck and op in (1, 2) and struct_pack(t := ticks, q := q) < struct_pack(t := pt, q := aq) and (gone is null or struct_pack(t := ticks, q := q) > gone) group by all)
    select pk, ck, pt as ticks, aq as batch_seq_no, expected as expected_v, w.v as actual_v from w where w.v is distinct from expected""")
def preimage_check(spark, d):
    """The comparison of a replicator in pre-image mode, for a log whose pre-images of every third clustering key say too much."""
    wrong = (F.col("operation") == 0) & (F.col("ck") % 3 == 0)
    return apply.image_mismatches(_rows(spark, d).withColumn("v", F.when(wrong, F.coalesce("v", F.lit(0)) + 1).otherwise(F.col("v"))), SIMPLE)


@_query(f"""with {_L}, x as (select * from l where not (op in (7, 8) and ticks % 2 = 0)) select s as stream_id, {_TEXT} as cdc_time, q as batch_seq_no from x a where op in (5, 6) and not exists (select 1 from x b where b.pk = a.pk and b.s = a.s and b.u = a.u and b.q = a.q + 1 and b.op in (7, 8))
    union all select s, {_TEXT}, q from x a where op in (7, 8) and not exists (select 1 from x b where b.pk = a.pk and b.s = a.s and b.u = a.u and b.q = a.q - 1 and b.op in (5, 6))""")
def lost_bounds(spark, d):
    """Range bounds without their partner in a log that lost the right bounds of even ticks."""
    rows = _rows(spark, d).where(~(F.col("operation").isin(7, 8) & (F.col("ticks") % 2 == 0)))
    return apply.unpaired(rows, SIMPLE).select(_hex(), _time(), F.when(F.col("no_left"), F.col("start_seq") + 1).otherwise(F.col("start_seq")).alias("batch_seq_no"))


@_query(f"""with {_L}, p as (select *, last_value(case when op in (1, 2) then op end ignore nulls) over (partition by s order by ticks, q, u rows unbounded preceding) as kind from l where op in (1, 2, 9) and not (op in (1, 2) and ck % 2 = 0))
    select s as stream_id, {_TEXT} as cdc_time, q as batch_seq_no from p where op = 9 and kind is null""")
def orphan_images(spark, d):
    """Post-images that no insert or update of their stream comes before, in a log that lost the writes of even clustering keys."""
    rows = _rows(spark, d).where(~F.coalesce(F.col("operation").isin(1, 2) & (F.col("ck") % 2 == 0), F.lit(False)))
    return apply.orphan_images(rows).select(_hex(), _time(), "batch_seq_no")


# Streams.


@_query(f"with {_L}, {_TASKED} select gen as generation_ms, vnode, s as stream_id, count(*) as n, min({_MS}) as first_ms, max({_MS}) as last_ms from t where gen is not null group by 1, 2, 3")
def consumed_by_task(spark, d):
    """The log laid out by task, read window by window as the source gives it, each micro-batch handed to a consumer in order of stream and time."""
    where = shared_dir(spark, "by-task")
    layout.write(_tasked(spark, d).where("generation_ms is not null"), f"{where}/log")
    spark.dataSource.register(LogSource)
    source = spark.readStream.format("rillfold_log").option("path", f"{where}/log").option("windowMs", 86_400_000).option("confidenceMs", CONFIDENCE_MS).option("nowMs", NOW_MS + 30 * 86_400_000).load()

    def consume(batch: DataFrame, number: int) -> None:
        batch.groupBy("generation_ms", "vnode", "stream_id").agg(F.count(F.lit(1)).alias("n"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms")).write.mode("overwrite").parquet(f"{where}/seen/batch={number}")

    tasked = ledger.with_task(source, table(spark, d, "cdc_streams"))
    feed.finish(feed.consume_by_task(tasked, consume, f"{where}/checkpoint"))
    seen = spark.read.parquet(f"{where}/seen").groupBy("generation_ms", "vnode", "stream_id").agg(F.sum("n").alias("n"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"))
    return seen.select("generation_ms", "vnode", _hex(), "n", "first_ms", "last_ms")


@_query("""with k as (select ("cdc$operation")::int as operation, ((('0x' || substr(replace(replace(replace(lower("cdc$time"), '-', ''), '{', ''), '}', ''), 14, 3) || substr(replace(replace(replace(lower("cdc$time"), '-', ''), '{', ''), '}', ''), 9, 4) || substr(replace(replace(replace(lower("cdc$time"), '-', ''), '{', ''), '}', ''), 1, 8))::bigint - 122192928000000000) // 10000) as ms from simple_scylla_cdc_log)
    select ms // 3600000 * 3600000 as window_start_ms, operation, count(*) as n from k group by 1, 2""")
def stream_window_counts(spark, d):
    """A stream of delivered copies, counted by hour and operation, two days of arrivals to a micro-batch; late copies count as well."""
    out, _ = feed.run_by_arrival(spark, f"{d}/{LOG}.parquet", shared_dir(spark, "window-counts"), lambda log: feed.window_counts(log, 3_600_000), "update", 2 * 86400)
    return feed.totals(out.unionByName(feed.unarrived_counts(table(spark, d, LOG), 3_600_000)))


@_query(f"""with {_L} select a.s as stream_id, a.ticks, a.q as start_seq, a.pk, a.ck::bigint as lo, b.ck::bigint as hi, a.op as l_op, b.op as r_op
    from l a join l b on a.pk = b.pk and a.s = b.s and a.u = b.u and b.q = a.q + 1 where a.op in (5, 6) and b.op in (7, 8)""")
def stream_range_pairs(spark, d):
    """A stream of range bounds, paired as they arrive, two days of arrivals to a micro-batch."""
    out, _ = feed.run_by_arrival(spark, f"{d}/{LOG}.parquet", shared_dir(spark, "range-pairs"), feed.range_pairs, "update", 2 * 86400)
    return out.select(_hex(), "ticks", "start_seq", "pk", "lo", "hi", "l_op", "r_op").distinct()
