"""The queries of the core's data problems, and the SQL they are checked with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillfold.functions import streamid as si
from rillfold.functions import timeuuid as tu
from rillfold.operators import drift, hotkeys
from rillfold.operators import replay as replaying
from rillfold.plans import ledger
from rillfold.session import shared_dir, table
from rillfold.sources.log import identified, micros_of
from rillfold.streaming import dedup

LOG = "simple_scylla_cdc_log"
HEAVY_SHARE = 0.05


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for name, key in ((LOG, si.hex_id(F.col("`cdc$stream_id`"))), ("t", F.col("pk").cast("string"))):
        rows = table(spark, d, name)
        parts.append(hotkeys.heavy_keys(rows, key, HEAVY_SHARE).where("key_value is not null").select(F.lit(name).alias("table_name"), "key_value"))
    return parts[0].unionByName(parts[1])


def p1_stream_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per stream: delivered copies, deleting changes, first and last tick, last arrival."""
    log = table(spark, d, LOG)
    tick = tu.ticks(F.col("`cdc$time`"))
    h = si.hex_id(F.col("`cdc$stream_id`"))
    return hotkeys.salted_aggregate(
        log, {"stream_id": h},
        [hotkeys.count_rows("n"), hotkeys.count_of("n_deletes", F.when(F.col("`cdc$operation`").between(3, 8), 1)), hotkeys.least("first_ticks", tick), hotkeys.greatest("last_ticks", tick), hotkeys.greatest("last_received_us", micros_of(F.col("received_at")))],
        heavy_key=h,
    )


def p1_pk_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per partition key of `t`: rows, rows with a value, first and last write, and the value of the last write (the greatest of equal ones)."""
    t = table(spark, d, "t")
    last = F.max(F.when(F.col("writetime_us").isNotNull() & F.col("v").isNotNull(), F.struct("writetime_us", "v")))
    rows = hotkeys.salted_aggregate(
        t, {"pk": F.col("pk")},
        [hotkeys.count_rows("n"), hotkeys.count_of("n_values", F.col("v")), hotkeys.least("first_us", F.col("writetime_us")), hotkeys.greatest("last_us", F.col("writetime_us")), hotkeys.Mergeable("last", last, F.max)],
        heavy_key=F.col("pk").cast("string"),
    )
    return rows.select("pk", "n", "n_values", "first_us", "last_us", F.col("last.v").alias("last_v"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return dedup.dropped_copies(spark, f"{d}/{LOG}.parquet")


def p2_kept(spark: SparkSession, d: str) -> DataFrame:
    """The delivery id of the one copy of each log row that stays."""
    return dedup.deduplicated(spark, f"{d}/{LOG}.parquet").select("delivery_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "change_schema"), table(spark, d, "raw_records")).select("table_name", "file_id", "change_kind", "column_name")


def p3_union_schema(spark: SparkSession, d: str) -> DataFrame:
    return drift.union_schema(table(spark, d, "change_schema"))


def p3_changelog(spark: SparkSession, d: str) -> DataFrame:
    return drift.changelog(table(spark, d, "change_schema"), table(spark, d, "raw_records"))


def p3_unified(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified_values(table(spark, d, "change_schema"), table(spark, d, "raw_records"))


def p3_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every record with all columns of its table, as text."""
    rows = drift.unified_rows(table(spark, d, "change_schema"), table(spark, d, "raw_records"))
    text = F.array_join(F.transform("columns", lambda c: F.concat(c["name"], F.lit(":"), c["type"], F.lit("="), F.coalesce(c["value"], F.lit("null")))), ", ")
    return rows.select("table_name", "file_id", "record_no", "row_key", text.alias("row"))


def typed_values(spark: SparkSession, d: str) -> DataFrame:
    """Values of records as Spark values of their promoted types: whole numbers, reals, moments, bytes, and the size of collections."""
    v = drift.unified_values(table(spark, d, "change_schema"), table(spark, d, "raw_records")).where("not refused")
    kind, text = F.col("type"), F.col("value")
    typed = v.select(
        "table_name", "file_id", "row_key", "column_name", "type",
        F.when(kind.isin("TINYINT", "SMALLINT", "INT", "BIGINT"), text.try_cast("bigint")).alias("as_long"),
        F.when(kind.isin("FLOAT", "DOUBLE", "DECIMAL"), text.try_cast("double")).alias("as_double"),
        F.when(kind.isin("DATE", "TIMESTAMP"), F.unix_micros(text.try_cast("timestamp"))).alias("as_micros"),
        F.when((kind == "BLOB") & text.rlike("^0x([0-9a-fA-F]{2})*$"), F.length(F.unhex(F.substring(text, 3, 1 << 30)))).alias("n_bytes"),
        F.when(kind.rlike("LIST<|SET<|TUPLE<"), F.json_array_length(text)).alias("n_elements"),
    )
    return typed.groupBy("table_name", "column_name", "type").agg(F.count(F.lit(1)).alias("n"), F.sum("as_long").alias("sum_long"), F.round(F.max("as_double"), 6).alias("max_double"), F.min("as_micros").alias("min_micros"), F.sum("n_bytes").cast("bigint").alias("n_bytes"), F.sum("n_elements").cast("bigint").alias("n_elements"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return replaying.replay(table(spark, d, LOG)).select("pk", "ck", F.coalesce(F.col("v").cast("string"), F.lit("null")).alias("v"))


#: The moment at which the ledger looks at the attempts, and how long a lease holds.
LEDGER_NOW_MS = 1707350400000
LEASE_MS = 6 * 3600 * 1000


def _book(spark: SparkSession, d: str) -> ledger.WorkLedger:
    """The ledger with the history of attempts."""
    book = ledger.WorkLedger(spark, shared_dir(spark, "work"))
    book.take_over(table(spark, d, "task_runs"), LEDGER_NOW_MS, LEASE_MS)
    return book


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rest = ledger.untaken(table(spark, d, LOG), table(spark, d, "cdc_streams"), _book(spark, d), "ks.simple")
    return rest.select(si.hex_id(F.col("stream_id")).alias("stream_id"), tu.from_parts(F.col("ticks"), F.col("low")).alias("cdc_time"), "batch_seq_no")


def p5_ledger(spark: SparkSession, d: str) -> DataFrame:
    return ledger.from_attempts(table(spark, d, "task_runs"), LEDGER_NOW_MS, LEASE_MS)


QUERIES = {f.__name__: f for f in (p1_found, p1_stream_profile, p1_pk_profile, p2_found, p2_kept, p3_found, p3_union_schema, p3_changelog, p3_unified, p3_rows, typed_values, p4_found, p5_found, p5_ledger)}

_UUID = 'replace(replace(replace(lower("cdc$time"), \'-\', \'\'), \'{\', \'\'), \'}\', \'\')'
_TICKS = f"(('0x' || substr({_UUID}, 14, 3) || substr({_UUID}, 9, 4) || substr({_UUID}, 1, 8))::bigint)"

_DRIFT = """
        with h as (select distinct table_name, file_id, effective_at, lower(trim(column_name, '" ')) as name, replace(replace(upper(cdc_log_data_type), ' ', ''), 'VARCHAR', 'TEXT') as type, upper(base_table_column_kind) as kind from change_schema),
          f as (select table_name, file_id, effective_at, lag(file_id) over w as before, lead(file_id) over w as after from (select distinct table_name, file_id, effective_at from h) window w as (partition by table_name order by effective_at)),
          c as (select h.table_name, h.file_id, name, type, last_value(kind ignore nulls) over (partition by h.table_name, name order by h.effective_at) as kind, before, after from h join f using (file_id) where not starts_with(name, 'cdc$')),
          d as (select coalesce(a.table_name, b.table_name) as table_name, coalesce(a.file_id, b.after) as file, coalesce(a.before, b.file_id) as before, coalesce(a.name, b.name) as name, a.name is null as gone, b.name is null as fresh, a.type as nt, b.type as ot, a.kind as nk, b.kind as ok
            from (select * from c where before is not null) a full join (select * from c where after is not null) b on a.before = b.file_id and a.name = b.name),
          b as (select file_id, row_key, min(record_no) as record_no from raw_records where json_valid(body) group by all),
          v as (select file_id, row_key, lower(trim(k, '" ')) as name, json_extract_string(body, '$."' || replace(replace(k, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"') as v
            from (select file_id, row_key, body, unnest(json_keys(body)) as k from b join raw_records using (file_id, row_key, record_no))),
          p as (select g.table_name, g.file, g.before, g.name as o, n.name as n from d g join d n on g.table_name = n.table_name and g.file = n.file where g.gone and n.fresh and g.ok = n.nk),
          m as (select p.table_name, p.file, o, n from p join v x on x.file_id = p.before and x.name = o join v y on y.file_id = p.file and y.name = n and y.row_key = x.row_key where x.v is not null and y.v is not null group by all having avg((x.v = y.v)::int) > 0.5),
          report as (select table_name, file as file_id, unnest(case when fresh then ['added'] when gone then ['removed'] else list_filter([case when ot <> nt then 'retyped' end, case when ok <> nk then 'rekinded' end], lambda x: x is not null) end) as change_kind, name as column_name
              from d where (file, name) not in (select file, o from m) and (file, name) not in (select file, n from m)
            union all select table_name, file, 'renamed', n from m)"""

_PROMOTED = """case when len(ts) = 1 then ts[1] when list_has_all(w, ts) then w[list_max(list_transform(ts, lambda t: list_position(w, t)))] when list_has_all(r, ts) then r[list_max(list_transform(ts, lambda t: list_position(r, t)))]
          when list_has_all(w || r, ts) then case when list_has_any(ts, ['BIGINT', 'VARINT', 'DECIMAL']) then 'DECIMAL' when list_has_any(ts, ['INT', 'DOUBLE']) then 'DOUBLE' else 'FLOAT' end
          when list_has_all(['DATE', 'TIMESTAMP'], ts) then 'TIMESTAMP' when list_has_all(['UUID', 'TIMEUUID'], ts) then 'UUID' else 'TEXT' end"""

_HELD = """case when type in ('TINYINT', 'SMALLINT', 'INT', 'BIGINT') then case when regexp_full_match(trim(v), '[+-]?[0-9]+') then case type when 'TINYINT' then try_cast(trim(v) as tinyint)::varchar when 'SMALLINT' then try_cast(trim(v) as smallint)::varchar when 'INT' then try_cast(trim(v) as int)::varchar else try_cast(trim(v) as bigint)::varchar end end
          when type = 'BOOLEAN' then try_cast(trim(v) as boolean)::varchar when type = 'DATE' then try_cast(trim(v) as date)::varchar when type = 'TIMESTAMP' then try_cast(trim(v) as timestamp)::varchar
          when type = 'VARINT' then case when regexp_full_match(trim(v), '[+-]?[0-9]+') then trim(v) end
          when type in ('FLOAT', 'DOUBLE', 'DECIMAL') then case when regexp_full_match(trim(v), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') then trim(v) end else v end"""

# Columns followed from file to file, under the same name or a new one, from where they begin.
_UNIFIED = f"""{_DRIFT.replace("with h as", "with recursive h as", 1)},
          n as (select c.*, f.effective_at as ef from c join f using (table_name, file_id)),
          s as (select x.file_id as a, x.name as an, y.file_id as b, y.name as bn from n x join n y on y.table_name = x.table_name and y.file_id = x.after and y.name = x.name union all select f.before, o, m.file, n from m join f on f.file_id = m.file),
          q as (select n.table_name, n.file_id as rf, n.name as rn, n.file_id, n.name from n where not exists (select 1 from s where s.b = n.file_id and s.bn = n.name)
            union all select q.table_name, q.rf, q.rn, s.b, s.bn from q join s on s.a = q.file_id and s.an = q.name),
          ends as (select q.table_name, rf, rn, arg_max(q.name, n.ef) as ln, min(n.ef) as b, max(n.ef) as e from q join n using (file_id, name) group by all),
          roots as (select *, case when max(e) over (partition by table_name, ln order by b, rn, rf rows between unbounded preceding and 1 preceding) >= b then ln || '@' || rf else ln end as column_name from ends),
          named as (select n.table_name, n.file_id, n.name, n.type, column_name from q join n using (file_id, name) join roots on roots.rf = q.rf and roots.rn = q.rn),
          types as (select table_name, column_name, {_PROMOTED} as type from (select table_name, column_name, list(distinct case when type = 'COUNTER' then 'BIGINT' else type end) as ts, ['TINYINT', 'SMALLINT', 'INT', 'BIGINT', 'VARINT'] as w, ['FLOAT', 'DOUBLE', 'DECIMAL'] as r from named where type is not null group by 1, 2)),
          vv as (select file_id, record_no, row_key, lower(trim(k, '" ')) as name, case json_type(body, path) when 'DOUBLE' then regexp_replace(json_extract_string(body, path), '[.]0$', '')
              when 'OBJECT' then '{{' || array_to_string(list_transform(list_sort(json_keys(body, path)), lambda o: to_json(o)::varchar || ':' || json_extract(json_extract(body, path), '$."' || o || '"')::varchar), ',') || '}}' else json_extract_string(body, path) end as v
            from (select file_id, record_no, row_key, body, k, '$."' || replace(replace(k, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"' as path from (select file_id, record_no, row_key, body, unnest(json_keys(body)) as k from b join raw_records using (file_id, row_key, record_no)))),
          vals as (select table_name, v.file_id, v.record_no, v.row_key, column_name, type, {_HELD} as value from vv v join (select table_name, file_id, name, column_name from named) k using (file_id, name) join types using (table_name, column_name) where v.v is not null)"""

SQL = {
    "p1_found": """
        select 'simple_scylla_cdc_log' as table_name, lower(hex("cdc$stream_id")) as key_value from simple_scylla_cdc_log
        where "cdc$stream_id" is not null group by "cdc$stream_id" having count(*) >= 0.05 * (select count(*) from simple_scylla_cdc_log)
        union all
        select 't', pk::varchar from t where pk is not null group by pk having count(*) >= 0.05 * (select count(*) from t)""",
    "p1_stream_profile": f"""
        select lower(hex("cdc$stream_id")) as stream_id, count(*) as n, count(*) filter ("cdc$operation" between 3 and 8) as n_deletes,
          min({_TICKS}) as first_ticks, max({_TICKS}) as last_ticks, max(epoch_us(received_at)) as last_received_us
        from simple_scylla_cdc_log group by "cdc$stream_id\"""",
    "p1_pk_profile": """
        select pk, count(*) as n, count(v) as n_values, min(writetime_us) as first_us, max(writetime_us) as last_us,
          (max(struct_pack(a := writetime_us, b := v)) filter (writetime_us is not null and v is not null)).b as last_v
        from t group by pk""",
    "p2_found": f"""
        select delivery_id from (select delivery_id, row_number() over (partition by "cdc$stream_id", {_UUID}, "cdc$batch_seq_no" order by received_at, delivery_id) as k
        from simple_scylla_cdc_log) where k > 1""",
    "p2_kept": f"""
        select delivery_id from (select delivery_id, row_number() over (partition by "cdc$stream_id", {_UUID}, "cdc$batch_seq_no" order by received_at, delivery_id) as k
        from simple_scylla_cdc_log) where k = 1""",
    "p3_found": f"""{_DRIFT}
        select table_name, file_id, change_kind, column_name from report""",
    "p3_union_schema": """
        with h as (select distinct table_name, lower(trim(column_name, '" ')) as column_name, replace(replace(replace(upper(cdc_log_data_type), ' ', ''), 'VARCHAR', 'TEXT'), 'COUNTER', 'BIGINT') as type from change_schema),
          g as (select table_name, column_name, list(type) as ts, ['TINYINT', 'SMALLINT', 'INT', 'BIGINT', 'VARINT'] as w, ['FLOAT', 'DOUBLE', 'DECIMAL'] as r from h where type is not null and not starts_with(column_name, 'cdc$') group by 1, 2)
        select table_name, column_name, case when len(ts) = 1 then ts[1] when list_has_all(w, ts) then w[list_max(list_transform(ts, lambda t: list_position(w, t)))] when list_has_all(r, ts) then r[list_max(list_transform(ts, lambda t: list_position(r, t)))]
          when list_has_all(w || r, ts) then case when list_has_any(ts, ['BIGINT', 'VARINT', 'DECIMAL']) then 'DECIMAL' when list_has_any(ts, ['INT', 'DOUBLE']) then 'DOUBLE' else 'FLOAT' end
          when list_has_all(['DATE', 'TIMESTAMP'], ts) then 'TIMESTAMP' when list_has_all(['UUID', 'TIMEUUID'], ts) then 'UUID' else 'TEXT' end as type from g""",
    "p3_changelog": f"""{_DRIFT}
        select r.table_name, file_id, column_name, change_kind, ot as old_type, nt as new_type, ok as old_kind, nk as new_kind, effective_at
        from report r join d on d.table_name = r.table_name and d.file = r.file_id and d.name = r.column_name join f using (file_id)""",
    "p3_unified": f"""{_UNIFIED}
        select table_name, file_id, record_no, row_key, column_name, type, value, value is null as refused from vals""",
    "p3_rows": f"""{_UNIFIED},
          one as (select file_id, row_key, coalesce(min(record_no) filter (json_valid(body)), min(record_no)) as record_no from raw_records group by 1, 2)
        select types.table_name, one.file_id, one.record_no, one.row_key, string_agg(types.column_name || ':' || types.type || '=' || coalesce(value, 'null'), ', ' order by types.column_name) as row
        from one join (select distinct table_name, file_id from named) k using (file_id) join types using (table_name) left join vals on vals.file_id = one.file_id and vals.row_key = one.row_key and vals.column_name = types.column_name group by all""",
    "typed_values": f"""{_UNIFIED}
        select table_name, column_name, type, count(*) as n, sum(case when type in ('TINYINT', 'SMALLINT', 'INT', 'BIGINT') then try_cast(value as bigint) end)::bigint as sum_long, round(max(case when type in ('FLOAT', 'DOUBLE', 'DECIMAL') then try_cast(value as double) end), 6) as max_double,
          min(case when type in ('DATE', 'TIMESTAMP') then epoch_us(try_cast(value as timestamp)) end) as min_micros, sum(case when type = 'BLOB' and regexp_full_match(value, '0x([0-9a-fA-F]{{2}})*') then (length(value) - 2) // 2 end)::bigint as n_bytes,
          sum(case when regexp_matches(type, 'LIST<|SET<|TUPLE<') and json_valid(value) and json_type(value) = 'ARRAY' then json_array_length(value) end)::bigint as n_elements from vals where value is not null group by 1, 2, 3""",
    "p4_found": f"""
        with l as (select distinct pk, ck, v, "cdc$deleted_v" as dv, "cdc$operation" as op, "cdc$stream_id" as s, {_UUID} as u, {_TICKS} as ticks, "cdc$batch_seq_no" as q from simple_scylla_cdc_log),
          d as (select pk, null::bigint as lo, null::bigint as hi, ticks, q from l where op = 4
            union all select pk, ck, ck, ticks, q from l where op = 3
            union all select a.pk, a.ck::bigint + (a.op = 6)::int, b.ck::bigint - (b.op = 8)::int, b.ticks, b.q from l a join l b on a.pk = b.pk and a.s = b.s and a.u = b.u and b.q = a.q + 1 where a.op in (5, 6) and b.op in (7, 8)),
          k as (select distinct pk, ck from l where op in (1, 2)),
          g as (select k.pk, k.ck, max(struct_pack(t := d.ticks, q := d.q)) filter (d.ticks is not null) as gone from k left join d on d.pk = k.pk and coalesce(k.ck >= lo, true) and coalesce(k.ck <= hi, true) group by all),
          w as (select l.pk, l.ck, max(struct_pack(t := ticks, q := q, v := v)) filter (v is not null or dv) as w, bool_or(op = 2) as i
            from l join g on g.pk = l.pk and g.ck = l.ck where op in (1, 2) and (gone is null or struct_pack(t := ticks, q := q) > gone) group by 1, 2)
        select pk, ck, coalesce((w.v)::varchar, 'null') as v from w where i or w.v is not null""",
    "p5_found": f"""
        with l as (select lower(hex("cdc$stream_id")) as s, {_UUID} as u, {_TICKS} as ticks, "cdc$batch_seq_no" as q, min(received_at) as arr
            from simple_scylla_cdc_log group by all),
          m as (select *, (ticks - 122192928000000000) // 10000 as ms from l),
          k as (select m.*, 'ks.simple:' || g.generation_start_ms || ':' || g.vnode as task from m
            left join (select distinct * from cdc_streams) g on lower(hex(g.stream_id)) = s and ms >= generation_start_ms and ms < generation_end_ms),
          r as (select distinct *, lower(hex(last_change_stream_id)) as ls,
            ('0x' || substr(replace(last_change_time, '-', ''), 14, 3) || substr(replace(last_change_time, '-', ''), 9, 4) || substr(replace(last_change_time, '-', ''), 1, 8))::bigint as lt from task_runs)
        select s as stream_id, substr(u, 1, 8) || '-' || substr(u, 9, 4) || '-' || substr(u, 13, 4) || '-' || substr(u, 17, 4) || '-' || substr(u, 21) as cdc_time, q as batch_seq_no
        from k where not exists (select 1 from r where r.task_id = k.task and ms >= window_start_ms and ms < window_end_ms and arr <= read_at
          and (status = 'succeeded' or status = 'failed' and ls is not null and (
            list_transform(range(16), lambda i: (('0x' || substr(s, (2 * i + 1)::int, 2))::int + 128) % 256) < list_transform(range(16), lambda i: (('0x' || substr(ls, (2 * i + 1)::int, 2))::int + 128) % 256)
            or s = ls and ticks <= lt)))""",
    "p5_ledger": """
        select task_id, window_start_ms, window_end_ms,
          case when bool_or(status = 'succeeded') then 'done' when bool_or(status = 'running' and epoch_us(read_at) + 21600000000 > 1707350400000000) then 'leased' else 'pending' end as state,
          count(distinct run_id) as token, max(case when status = 'failed' and last_change_time is not null then run_id end) as resume_run_id
        from (select distinct * from task_runs) group by 1, 2, 3""",
}
