"""The state of any base table from its log, in each mode of a replicator.

For every row key one aggregation keeps the newest write of each column, the newest insert and the newest
row deletion; it combines before the shuffle, so keys with very many changes cost each map task one row.
Deletions of partitions are summed up per partition key; those of ranges are met in a sweep along the clustering key,
which splits hot partition keys. Both mask what is older.

Input: rows with `ticks, low, batch_seq_no, stream_id, operation, ttl`, the key columns, for
every regular column `c` the columns `c` and `deleted_c`, and for one that is a collection or a type with fields, and isn't frozen,
`deleted_elements_c` too: there a true `deleted_c` means that `c` replaces the whole, else its elements or fields are added to it,
and the deleted ones (elements of a set, keys of a map, time UUIDs of a list, numbers of fields) taken out.

Defined cases: of changes at the same tick and sequence a deletion wins over a write, and the greater value over the
lesser; a null `deleted_c` is false; a row without partition key is ignored, and one without clustering key too
if it writes a row; repeated rows change nothing; a right bound without its left one is reported by `unpaired`.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillfold.functions import timeuuid as tu
from rillfold.operators import collections
from rillfold.operators.hotkeys import sketch
from rillfold.operators.ordered import last_known
from rillfold.session import kept

MODES = {"delta": "delta", "preimage": "preimage", "pre_image": "preimage", "postimage": "postimage", "post_image": "postimage"}


def mode(text: str) -> str:
    """A mode by any of its spellings."""
    try:
        return MODES[text.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown mode {text!r}") from None


@dataclass(frozen=True)
class Keyed:
    """Columns of a base table. collections: `(name, kind)` of those that aren't frozen, kind being set, map, list or udt."""

    partition: tuple[str, ...]
    clustering: tuple[str, ...]
    regular: tuple[str, ...]
    collections: tuple[tuple[str, str], ...] = ()

    @property
    def key(self) -> list[str]:
        return [*self.partition, *self.clustering]


AT = ["ticks", "batch_seq_no"]


def pairs(rows: DataFrame, keyed: Keyed) -> DataFrame:
    """Range deletions: the partition key, `l_*` and `r_*` of each clustering key, whether bounds are included, and the place of the right bound."""
    bounds = rows.where(F.col("operation").between(5, 8))
    left = F.col("operation") <= 6
    side = lambda is_left: F.max(F.when(left if is_left else ~left, F.struct("operation", *keyed.clustering)))
    start = F.when(left, F.col("batch_seq_no")).otherwise(F.col("batch_seq_no") - 1).alias("start_seq")
    both = bounds.groupBy(*keyed.partition, "stream_id", "ticks", "low", start).agg(side(True).alias("l"), side(False).alias("r"))
    return both.select(*keyed.partition, "stream_id", "ticks", "low", "start_seq", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "lr" for c in keyed.clustering], (F.col("l.operation") == 5).alias("l_incl"), (F.col("r.operation") == 7).alias("r_incl"), F.col("l").isNull().alias("no_left"), F.col("r").isNull().alias("no_right"))


def paired(rows: DataFrame, keyed: Keyed) -> DataFrame:
    return pairs(rows, keyed).where("not no_left and not no_right").drop("no_left", "no_right")


def unpaired(rows: DataFrame, keyed: Keyed) -> DataFrame:
    """Bounds without their partner."""
    return pairs(rows, keyed).where("no_left or no_right")


#: A partition key with at least HOT of the rows is split into chunks that hold about TARGET of them, or UNIT_ROWS if that is less.
HOT, TARGET, UNIT_ROWS = 0.02, 0.005, 2_000_000
ROW, BEGIN, END = 0, 1, 2


def covered(keys: DataFrame, ranges: DataFrame, keyed: Keyed, timed: bool = False) -> DataFrame:
    """The key columns and `d_range`, the newest range deletion that covers a row, for the rows that one covers.

    A sweep instead of a join: rows and both ends of each range are sorted along the clustering key, Spark comparing the
    values, and the ranges open at a row are held in order. An end names a prefix of the clustering key and comes
    before or after all rows with it; where it names nothing, its side is open. Hot partition keys are split into chunks
    by clustering key, and their ranges go to each. timed: keys have `ticks, batch_seq_no`, and only deletions before those count.
    """
    text = F.to_json(F.struct(*[F.col(c) for c in keyed.partition]))
    seen = sketch(keys, text, HOT)
    chunks = seen.parts(text, min(TARGET, UNIT_ROWS / max(1, seen.n)))
    n = range(len(keyed.clustering))

    def end(side: str) -> Column:
        """Place of a bound: rank and value of each component, and a rank against a row with the same key."""
        before = F.col(f"{side}_incl") if side == "l" else ~F.col(f"{side}_incl")
        rank = F.when(before, F.lit(-1)).otherwise(F.lit(1))
        none = F.col(f"{side}_{keyed.clustering[0]}").isNull()
        open_rank = F.when(none, F.lit(-1 if side == "l" else 1)).otherwise(rank)
        parts = [x for i in n for c in [F.col(f"{side}_{keyed.clustering[i]}")] for x in (F.when(c.isNull(), open_rank).otherwise(0).alias(f"rank_{i}"), c.alias(f"value_{i}"))]
        return F.struct(F.lit(BEGIN if side == "l" else END).alias("what"), *parts, rank.alias("tie"))

    own = [F.col(c).alias(f"p_{i}") for i, c in enumerate(keyed.partition)]
    # Of ranges with the same bounds only the newest matters.
    same = [f"{s}_{c}" for s in "lr" for c in (*keyed.clustering, "incl")]
    ranges = ranges if timed else ranges.groupBy(*keyed.partition, *same).agg(F.max(F.struct("ticks", "start_seq", "low")).alias("d")).select(*keyed.partition, *same, "d.ticks", "d.start_seq", "d.low")
    ends = ranges.select(*own, chunks.alias("chunks"), "ticks", (F.col("start_seq") + 1).alias("seq"), "low", F.array(end("l"), end("r")).alias("ends"))
    ends = ends.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("e", F.explode("ends"))
    names = [*[f"p_{i}" for i in range(len(keyed.partition))], "chunk", "what", *[x for i in n for x in (f"rank_{i}", f"value_{i}")], "tie", "ticks", "seq", "low"]
    ends = ends.select(*[F.col(f"e.{c}").alias(c) if c == "what" or c == "tie" or c.startswith(("rank_", "value_")) else F.col(c) for c in names])
    at = keys.select(*own, F.pmod(F.xxhash64(*keyed.clustering), chunks).cast("int").alias("chunk"), F.lit(ROW).alias("what"), *[x for i in n for x in (F.lit(0).alias(f"rank_{i}"), F.col(keyed.clustering[i]).alias(f"value_{i}"))], F.lit(0).alias("tie"), *[(F.col(c) if timed else F.lit(None)).cast(t).alias(n) for c, t, n in (("ticks", "bigint", "ticks"), ("batch_seq_no", "int", "seq"))], F.lit(None).cast("binary").alias("low"))
    group = names[: len(keyed.partition) + 1]
    ordered = at.select(*names).unionByName(ends).repartition(*group).sortWithinPartitions(*group, *[x for i in n for x in (f"rank_{i}", f"value_{i}")], "tie", "what")
    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema}
    out = ", ".join([*[f"p_{i} {kinds[f'p_{i}']}" for i in range(len(keyed.partition))], *[f"value_{i} {kinds[f'value_{i}']}" for i in n], "ticks bigint, seq int, d_ticks bigint, d_seq int"])
    found = ordered.mapInArrow(_swept(len(keyed.partition), len(keyed.clustering), timed), out)
    own = [F.col(f"p_{i}").alias(c) for i, c in enumerate(keyed.partition)] + [F.col(f"value_{i}").alias(c) for i, c in enumerate(keyed.clustering)]
    return found.select(*own, *([F.col("ticks"), F.col("seq").alias("batch_seq_no")] if timed else []), F.struct(F.col("d_ticks").alias("ticks"), F.col("d_seq").alias("batch_seq_no")).alias("d_range"))


def _swept(n_partition: int, n_clustering: int, timed: bool):
    names = [f"p_{i}" for i in range(n_partition)] + [f"value_{i}" for i in range(n_clustering)] + ["ticks", "seq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, active, ended = None, [], set()
        for batch in batches:
            groups = zip(*(batch.column(i).to_pylist() for i in range(n_partition + 1)))
            rest = (batch.column(name).to_pylist() for name in ("what", "ticks", "seq", "low"))
            rows, ticks, seqs = [], [], []
            for k, (g, what, t, s, low) in enumerate(zip(groups, *rest)):
                if g != group:
                    group, active, ended = g, [], set()
                if what == BEGIN:
                    if (t, s, low) not in ended:
                        insort(active, (t, s, low))
                elif what == END:
                    ended.add((t, s, low))
                else:
                    # From the newest one, or the newest before this row's time; those that ended are met once.
                    at = (bisect_left(active, (t, s)) if timed else len(active)) - 1
                    while at >= 0 and active[at] in ended:
                        del active[at]
                        at -= 1
                    if at >= 0:
                        rows.append(k)
                        ticks.append(active[at][0])
                        seqs.append(active[at][1])
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(taken.column(n) for n in names), pa.array(ticks, pa.int64()), pa.array(seqs, pa.int32())], names=[*names, "d_ticks", "d_seq"])

    return run


def _later(a: Column, b: Column) -> Column:
    return F.when(b.isNull(), True).when(a.isNull(), False).otherwise(a > b)


def _cells_of(rows: DataFrame, keyed: Keyed, whole: bool) -> tuple[DataFrame, dict[str, Column]]:
    """Rows with a column for each field of a UDT (`c__f`), and for every atomic column and field whether a change writes it.

    whole: a change writes all columns, as post-images do.
    """
    written = {c: F.lit(True) if whole else F.col(c).isNotNull() | F.coalesce(F.col(f"deleted_{c}"), F.lit(False)) for c in keyed.regular}
    for c, kind in keyed.collections:
        if kind != "udt":
            continue
        for i, f in enumerate(rows.schema[c].dataType.names):
            rows = rows.withColumn(f"{c}__{f}", F.col(c)[f])
            nulled = F.coalesce(F.array_contains(F.transform(F.col(f"deleted_elements_{c}"), lambda x: x.cast("int")), i), F.lit(False))
            written[f"{c}__{f}"] = F.lit(True) if whole else F.col(f"{c}__{f}").isNotNull() | nulled | F.coalesce(F.col(f"deleted_{c}"), F.lit(False))
    return rows, written


def _of_collection(writes: DataFrame, keyed: Keyed, c: str, whole: bool) -> DataFrame:
    """The changes of one collection, as `collections` takes them."""
    removed = F.lit(None).cast(writes.schema[f"deleted_elements_{c}"].dataType) if whole else F.col(f"deleted_elements_{c}")
    replace = F.lit(True) if whole else F.coalesce(F.col(f"deleted_{c}"), F.lit(False))
    return writes.select(*keyed.key, *AT, _until().alias("until_ms"), replace.alias("replace"), F.col(c).alias("added"), removed.alias("removed"))


def _until() -> Column:
    """When what a change writes expires; null for never."""
    return F.when(F.col("ttl").isNotNull(), tu.millis(F.col("ticks")) + F.col("ttl") * 1000)


def _shown(masked: DataFrame, keyed: Keyed, values: dict[str, Column], inserted: Column) -> DataFrame:
    """Rows that exist, fields of a UDT put together again: those inserted, or with any value."""
    out, some = [], [inserted]
    collections = dict(keyed.collections)
    for c in keyed.regular:
        out.append(values[c].alias(c))
        some.append(values[c].isNotNull())
    for c, kind in collections.items():
        if kind == "udt":
            fields = {n.removeprefix(f"{c}__"): v for n, v in values.items() if n.startswith(f"{c}__")}
            any_field = reduce(lambda a, b: a | b, [v.isNotNull() for v in fields.values()])
            out.append(F.when(any_field, F.struct(*[v.alias(f) for f, v in fields.items()])).alias(c))
            some.append(any_field)
        else:
            out.append(F.col(f"__c_{c}").alias(c))
            some.append(F.col(f"__c_{c}").isNotNull())
    return masked.where(reduce(lambda a, b: a | b, some)).select(*keyed.key, *out)


GONE = "struct<ticks:bigint,batch_seq_no:int>"


def state(rows: DataFrame, keyed: Keyed, how: str = "delta", now_ms: int | None = None) -> DataFrame:
    """The rows that exist: key, regular columns and collections. now_ms: where given, values whose TTL has passed by then are gone.

    delta: inserts and updates write the columns they touch. preimage: the same; images are only compared
    (`image_mismatches`). postimage: a post-image writes all columns, nulls too, as the kind of the last insert or update of its stream.
    A set is a sorted array, a map an array of entries sorted by key, a list an array, a UDT a struct.
    """
    how = mode(how)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keyed.partition])
    rows = rows.where(known)
    complete = how == "postimage"
    writes = _postimages(rows) if complete else rows.where(F.col("operation").isin(1, 2)).withColumn("kind", F.col("operation"))
    writes, touched = _cells_of(writes, keyed, complete)
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keyed.clustering], F.lit(True))
    writes = writes.where(whole)
    columns = [*keyed.key, *AT, "kind", _until().alias("until_ms"), *[F.when(t, F.struct(F.col(c).isNotNull().alias("has"), F.col(c).alias("v"))).alias(f"w_{c}") for c, t in touched.items()]]
    gone = rows.where((F.col("operation") == 3) & whole).select(*keyed.key, *AT, F.lit(3).alias("kind"))
    events = writes.select(*columns).unionByName(gone, allowMissingColumns=True)
    at = F.struct(*AT)
    newest = events.groupBy(*keyed.key).agg(
        *[F.max(F.when(F.col(f"w_{c}").isNotNull(), F.struct(at.alias("at"), F.col(f"w_{c}.has").alias("has"), F.col(f"w_{c}.v").alias("v"), "until_ms"))).alias(f"w_{c}") for c in touched],
        F.max(F.when(F.col("kind") == 2, F.struct(at.alias("at"), "until_ms"))).alias("i"),
        F.max(F.when(F.col("kind") == 3, at)).alias("d_row"),
    )
    dead = rows.where(F.col("operation") == 4).groupBy(*keyed.partition).agg(F.max(at).alias("d_all"))
    if keyed.clustering:
        newest = kept(newest, "apply")  # read three times below: to find hot keys, to sweep, and to mask
    masked = newest.join(dead, list(keyed.partition), "left")
    if keyed.clustering:
        masked = masked.join(covered(newest.select(*keyed.key), paired(rows, keyed), keyed), keyed.key, "left")
    masked = masked.withColumn("gone", F.array_max(F.array_compact(F.array(*[F.col(c).cast(GONE) for c in ("d_row", "d_all", "d_range") if c in masked.columns]))))
    loose = [(c, kind) for c, kind in keyed.collections if kind != "udt"]
    if loose:
        masked = kept(masked, "apply")
        deleted = masked.where("gone is not null").select(*keyed.key, "gone")
    for c, kind in loose:
        mine = _of_collection(writes, keyed, c, complete)
        cells = collections.alive(collections.element_cells(mine, keyed.key, kind), collections.replaced(mine, keyed.key), keyed.key, deleted, now_ms)
        masked = masked.join(collections.assembled(cells, keyed.key, kind).withColumnRenamed("value", f"__c_{c}"), keyed.key, "left")
    alive = lambda c: F.col(c).isNotNull() & _later(F.col(f"{c}.at"), F.col("gone")) & (F.lit(now_ms is None) | F.col(f"{c}.until_ms").isNull() | (F.col(f"{c}.until_ms") > F.lit(now_ms or 0)))
    return _shown(masked, keyed, {c: F.when(alive(f"w_{c}"), F.col(f"w_{c}.v")) for c in touched}, alive("i"))


#: Rows of a stream within so many ticks (an hour) are one unit of an ordered scan.
CHUNK_TICKS = 36_000_000_000


def _postimages(rows: DataFrame) -> DataFrame:
    """Post-images with `kind`, the last insert or update of their stream; those that follow none are errors and left out (`orphan_images`)."""
    return _with_kind(rows).where("kind is not null")


def orphan_images(rows: DataFrame) -> DataFrame:
    """Post-images that no insert or update of their stream comes before."""
    return _with_kind(rows).where("kind is null")


def _with_kind(rows: DataFrame) -> DataFrame:
    op = F.col("operation")
    some = rows.where(op.isin(1, 2, 9))
    seen = last_known(some, ["stream_id"], ["ticks", "batch_seq_no", "low"], tu.int_div(F.col("ticks"), CHUNK_TICKS), F.when(op.isin(1, 2), op), "kind")
    return seen.where(op == 9)


def merge(old: DataFrame, rows: DataFrame, keyed: Keyed) -> DataFrame:
    """Cells of a state kept between batches, with a further batch folded in.

    old and the result hold, per row key, what `cells` gives; the fold takes the newest of
    each, so folding a batch twice, or batches in another order, gives the same.
    """
    both = old.unionByName(cells(rows, keyed))
    return both.groupBy(*keyed.key).agg(*[F.max(c).alias(c) for c in both.columns if c not in keyed.key])


def cells(rows: DataFrame, keyed: Keyed) -> DataFrame:
    """The newest write of each column and field, replacement of each collection (`o_c`), insert and row deletion of one batch."""
    at = F.struct(*AT)
    op = F.col("operation")
    rows, written = _cells_of(rows, keyed, False)
    over = [F.max(F.when(op.isin(1, 2) & F.coalesce(F.col(f"deleted_{c}"), F.lit(False)), at)).alias(f"o_{c}") for c, kind in keyed.collections if kind != "udt"]
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keyed.key])
    return rows.where(op.isin(1, 2, 3) & whole).groupBy(*keyed.key).agg(
        *[F.max(F.when(op.isin(1, 2) & t, F.struct(at.alias("at"), F.col(c).isNotNull().alias("has"), F.col(c).alias("v")))).alias(f"w_{c}") for c, t in written.items()],
        F.max(F.when(op == 2, at)).alias("i"), F.max(F.when(op == 3, at)).alias("d_row"), *over,
    )


def elements(rows: DataFrame, keyed: Keyed, c: str, kind: str) -> DataFrame:
    """The newest write of each element of a collection of one batch."""
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keyed.key])
    return collections.element_cells(_of_collection(rows.where(F.col("operation").isin(1, 2) & whole), keyed, c, False), keyed.key, kind)


def partitions_gone(rows: DataFrame, keyed: Keyed) -> DataFrame:
    """The newest deletion of each partition of one batch."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keyed.partition])
    return rows.where((F.col("operation") == 4) & known).groupBy(*keyed.partition).agg(F.max(F.struct(*AT)).alias("d_all"))


def bounds(rows: DataFrame, keyed: Keyed) -> DataFrame:
    """The bounds of range deletions of one batch, as rows that `paired` takes; those of one range may come in different batches."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keyed.partition])
    return rows.where(F.col("operation").between(5, 8) & known).select(*keyed.key, "stream_id", *AT, "low", "operation").distinct()


def visible(state: DataFrame, keyed: Keyed, dead: DataFrame, ends: DataFrame, parts: dict[str, DataFrame] | None = None) -> DataFrame:
    """The rows that a kept state of cells amounts to, under kept deletions of partitions (`partitions_gone`) and bounds of ranges (`bounds`). parts: the kept `elements` of each collection."""
    masked = state.join(dead, list(keyed.partition), "left")
    if keyed.clustering:
        masked = masked.join(covered(state.select(*keyed.key), paired(ends, keyed), keyed), keyed.key, "left")
    gone = [F.col(c).cast(GONE) for c in ("d_row", "d_all", "d_range") if c in masked.columns]
    masked = masked.withColumn("gone", F.array_max(F.array_compact(F.array(*gone))))
    loose = [(c, kind) for c, kind in keyed.collections if kind != "udt"]
    if loose:
        masked = kept(masked, "apply")
        deleted = masked.where("gone is not null").select(*keyed.key, "gone")
    for c, kind in loose:
        over = masked.where(F.col(f"o_{c}").isNotNull()).select(*keyed.key, F.col(f"o_{c}").alias("over"))
        living = collections.alive(parts[c], over, keyed.key, deleted)
        masked = masked.join(collections.assembled(living, keyed.key, kind).withColumnRenamed("value", f"__c_{c}"), keyed.key, "left")
    values = {c[2:]: F.when(_later(F.col(f"{c}.at"), F.col("gone")) & F.col(c).isNotNull(), F.col(f"{c}.v")) for c in state.columns if c.startswith("w_")}
    return _shown(masked, keyed, values, F.col("i").isNotNull() & _later(F.col("i"), F.col("gone")))


def image_mismatches(rows: DataFrame, keyed: Keyed) -> DataFrame:
    """Pre-images whose atomic columns aren't those of the row before them: key, `ticks, batch_seq_no`, and per column `expected_c, actual_c`.

    For any keys and types. Each image is given the newest write of each column and the newest deletion of its row before it, by ordered
    scans in pieces, so a row with very many changes is many units of work; deletions of partitions and ranges before it come from the sweep.
    """
    op = F.col("operation")
    lone = not keyed.clustering
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keyed.key])
    mine = rows.where(op.isin(0, 1, 2, 3, *([4] if lone else [])) & whole)
    mine, written = _cells_of(mine, keyed, False)
    at = F.struct(*AT)
    mine = mine.select(*keyed.key, *AT, "operation", *written, *[F.when(op.isin(1, 2) & t, F.struct(at.alias("at"), F.col(c).alias("v"))).alias(f"__t_{c}") for c, t in written.items()], F.when(op != 0, F.lit(1)).otherwise(0).alias("__after"))
    for c in written:
        mine = last_known(mine, keyed.key, ["ticks", "batch_seq_no", "__after"], tu.int_div(F.col("ticks"), CHUNK_TICKS), F.col(f"__t_{c}"), f"__w_{c}")
    mine = last_known(mine, keyed.key, ["ticks", "batch_seq_no", "__after"], tu.int_div(F.col("ticks"), CHUNK_TICKS), F.when(op.isin(3, 4), at), "__d")
    images = mine.where(op == 0).select(*keyed.key, *AT, *written, *[f"__w_{c}" for c in written], "__d").distinct()
    if not lone:
        images = kept(images, "images")
        open_ends = [F.lit(None).cast(images.schema[c].dataType).alias(f"{s}_{c}") for s in "lr" for c in keyed.clustering]
        everything = rows.where((op == 4) & reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keyed.partition])).select(*keyed.partition, *open_ends, F.lit(True).alias("l_incl"), F.lit(True).alias("r_incl"), "ticks", (F.col("batch_seq_no") - 1).alias("start_seq"), "low")
        spans = paired(rows, keyed).select(*everything.columns).unionByName(everything).distinct()
        images = images.join(covered(images.select(*keyed.key, *AT).distinct(), spans, keyed, timed=True), [*keyed.key, *AT], "left")
    masked = images.withColumn("gone", F.array_max(F.array_compact(F.array(*[F.col(c).cast(GONE) for c in ("__d", "d_range") if c in images.columns]))))
    actual = {c: F.when(F.col(f"__w_{c}").isNotNull() & _later(F.col(f"__w_{c}.at"), F.col("gone")), F.col(f"__w_{c}.v")) for c in written}
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(v) for c, v in actual.items()])
    return masked.where(differs).select(*keyed.key, *AT, *[x for c, v in actual.items() for x in (F.col(c).alias(f"expected_{c}"), v.alias(f"actual_{c}"))])
