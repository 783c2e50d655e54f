"""Generations of streams: where they begin and end, which comes next, which may be skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillfold.functions import streamid as si


def bounds(starts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """`generation_start_ms, generation_end_ms`: each ends where the next begins, the last is open.

    by: columns with a sequence of generations each (one per table, where streams are kept per table). One
    row per generation: a few per day at most, however large the log.
    """
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("generation_start_ms")
    return starts.where("generation_start_ms is not null").select(*(by or []), "generation_start_ms").distinct().withColumn("generation_end_ms", F.lead("generation_start_ms").over(w))


def first_after(starts: DataFrame, t_ms: int | None, by: list[str] | None = None) -> DataFrame:
    """The earliest generation that begins after `t_ms`, or of all if that is None."""
    later = starts if t_ms is None else starts.where(F.col("generation_start_ms") > t_ms)
    return later.groupBy(*(by or [])).agg(F.min("generation_start_ms").alias("generation_start_ms"))


def timestamps(rows: DataFrame, form: str = "v2", by: list[str] | None = None) -> DataFrame:
    """`generation_start_ms` of each generation in metadata of one of its forms.

    v1: a row per generation with its streams; v2: a table of times alone, of which rows without streams count as
    well; tablets: a row per table (`by`), generation and stream.
    """
    if form not in ("v1", "v2", "tablets"):
        raise ValueError(form)
    if form == "v1":
        rows = rows.where("streams is not null")
    return rows.where("generation_start_ms is not null").select(*(by or []), "generation_start_ms").distinct()


def current(generations: DataFrame, done: DataFrame, visible_ms: int, by: list[str] | None = None) -> DataFrame:
    """The generation to read now: the earliest that is neither expired nor, being closed, `done` (`generation_start_ms, done`).

    That is where the steps from generation to generation end, taken at once. by: one for each table.
    """
    key = [*(by or []), "generation_start_ms"]
    known = generations.join(done.select(*key, F.col("done").alias("__done")), key, "left")
    passed = F.col("generation_end_ms").isNotNull() & (F.coalesce("__done", F.lit(False)) | (F.col("generation_end_ms") < visible_ms))
    return known.where(~passed).groupBy(*(by or [])).agg(F.min_by(F.struct("generation_start_ms", "generation_end_ms"), "generation_start_ms").alias("g")).where("g is not null").select(*(by or []), "g.*")


def streams_of(rows: DataFrame, form: str = "v2") -> DataFrame:
    """One row per stream of metadata in one of its forms.

    v1: a row per generation with all streams in an array; v2: several rows per generation with an
    array each; tablets: a row per stream with `stream_state`, of which 0 (current) counts.
    """
    if form == "tablets":
        return rows.where("stream_state = 0").drop("stream_state").distinct()
    if form not in ("v1", "v2"):
        raise ValueError(form)
    return rows.withColumn("stream_id", F.explode("streams")).drop("streams").distinct()


def pick_form(tables: set[str], rewritten: bool) -> str:
    """The metadata to read: the newer form if it exists and the older was copied into it, or doesn't exist."""
    newer, older = "cdc_streams_descriptions_v2" in tables, "cdc_streams_descriptions" in tables
    if newer and (rewritten or not older):
        return "v2"
    if older:
        return "v1"
    raise ValueError("no stream metadata")


def last_visible_ms(now_ms: int, ttls: list[int | None]) -> int:
    """Before this, no table of several still shows changes; a table without TTL shows all."""
    return min((now_ms - t * 1000 if t else 0) for t in ttls) if ttls else 0


def expired(generations: DataFrame, visible_ms: int) -> DataFrame:
    """Closed generations whose changes have all passed their TTL."""
    return generations.where(F.col("generation_end_ms").isNotNull() & (F.col("generation_end_ms") < visible_ms))


def next_to_read(generations: DataFrame, after_ms: Column | int, visible_ms: int, by: list[str] | None = None) -> DataFrame:
    """The generation to read after `after_ms`: the first that isn't expired. by: one for each table."""
    rest = generations.where((F.col("generation_start_ms") > after_ms) & (F.col("generation_end_ms").isNull() | (F.col("generation_end_ms") >= visible_ms)))
    return rest.groupBy(*(by or [])).agg(F.min_by(F.struct("generation_start_ms", "generation_end_ms"), "generation_start_ms").alias("g")).where("g is not null").select(*(by or []), "g.*")


def same_mode(uses_tablets: dict[str, bool]) -> bool:
    """Whether all tables keep streams per table; a mixture is refused."""
    modes = set(uses_tablets.values())
    if len(modes) > 1:
        raise ValueError(f"tables with and without tablets can't be read together: {sorted(uses_tablets)}")
    return bool(modes and modes.pop())


def sorted_streams(stream: Column) -> Column:
    """The set of streams of a group, ordered by signed bytes, as hex."""
    hi, lo = si.order_keys(si.hex_id(stream))
    return F.transform(F.array_sort(F.collect_set(F.struct(hi.alias("hi"), lo.alias("lo"), si.hex_id(stream).alias("s")))), lambda x: x["s"])
