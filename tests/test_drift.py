import datetime as dt
import itertools
import json

import pytest
from pyspark.sql import functions as F

from rillfold.operators import drift

HEAD = "file_id bigint, table_name string, effective_at timestamp_ntz, column_name string, column_index int, cdc_log_data_type string, base_table_data_type string, base_table_column_kind string"
BODY = "file_id bigint, record_no int, row_key bigint, body string"


def heads(spark, files):
    """files: (file_id, table, hour, [(name, type, kind)])."""
    rows = [(f, t, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), n, i, k, k, kind) for f, t, h, cols in files for i, (n, k, kind) in enumerate(cols)]
    return spark.createDataFrame(rows, HEAD)


def test_changes(spark):
    pk = ("pk", "INT", "PARTITION_KEY")
    files = [
        (3, "a", 2, [('"PK"', "int", None), ("b ", "varchar", "regular"), ("new1", "TEXT", "REGULAR"), ("cdc$x", "INT", None)]),
        (1, "a", 1, [pk, ("b", "TEXT", "REGULAR"), ("old1", "TEXT", "REGULAR"), ("old2", "INT", "REGULAR"), ("cdc$y", "INT", None)]),
        (1, "a", 1, [("pk", "INT", "PARTITION_KEY")]),  # a repeated header row
        (2, "a", 3, [pk, ("b", "BLOB", "CLUSTERING_KEY"), ("new2", "TEXT", "REGULAR")]),
        (4, "a", 4, [pk, ("b", "BLOB", "CLUSTERING_KEY"), ("new2", "TEXT", "REGULAR"), ("old2", "frozen <list <int>>", "REGULAR")]),
        (9, "z", 1, [pk]), (None, "a", 1, [pk]), (8, None, 1, [pk]), (7, "a", 0, [(None, "INT", "REGULAR"), pk, ("b", "TEXT", "REGULAR"), ("old1", "TEXT", "REGULAR"), ("old2", "INT", "REGULAR")]),
    ]
    recs = []
    for f, name in ((1, "old1"), (3, "new1")):
        recs += [(f, i, i, json.dumps({"pk": i, name: f"v{i}", "old2": i})) for i in range(5)]
    # In file 2 most of what was new1 has other values; a record is repeated, one body is broken, some are null.
    recs += [(2, i, i, json.dumps({"new2": f"v{i}" if i < 2 else f"w{i}"})) for i in range(5)] + [(3, 9, 1, json.dumps({"new1": "other"})), (3, 10, 7, '{"new1": "v'), (3, 11, None, "{}"), (3, 12, 8, None), (3, 13, 8, "[1]")]
    h, r = heads(spark, files).withColumn("name", F.lit("clash")), spark.createDataFrame(recs, BODY).withColumn("kind", F.lit("clash"))
    got = {tuple(x) for x in drift.changes(h, r).collect()}
    assert got == {("a", 3, "renamed", "new1"), ("a", 3, "removed", "old2"), ("a", 2, "removed", "new1"), ("a", 2, "added", "new2"), ("a", 2, "retyped", "b"), ("a", 2, "rekinded", "b"), ("a", 4, "added", "old2")}
    report = {(x.file_id, x.column_name): (x.old_type, x.new_type) for x in drift.changelog(h, r).collect()}
    assert report[(2, "b")] == ("TEXT", "BLOB") and report[(4, "old2")] == (None, "FROZEN<LIST<INT>>")
    for a, b in ((h.limit(0), r), (h, r.limit(0)), (h.limit(0), r.limit(0))):
        drift.changes(a, b).collect()
    assert drift.changes(h.limit(0), r).count() == 0
    without = {tuple(x) for x in drift.changes(h, r.limit(0)).collect()}
    assert ("a", 3, "added", "new1") in without and ("a", 3, "removed", "old1") in without


TYPES = [*drift.WHOLE, *drift.REAL, "COUNTER", "TEXT", "BLOB", "DATE", "TIMESTAMP", "UUID", "TIMEUUID", "BOOLEAN"]


def test_promotion_is_a_join():
    for a, b in itertools.product(TYPES, TYPES):
        ab = drift.promote(a, b)
        assert ab == drift.promote(b, a)
        assert drift.promote(ab, a) == drift.promote(ab, ab) or a == "COUNTER"
    for a, b, c in itertools.product(TYPES, TYPES, TYPES):
        assert drift.promote(drift.promote(a, b), c) == drift.promote(a, drift.promote(b, c)), (a, b, c)


def test_promotion_as_expression(spark):
    pairs = [sorted({a, b}) for a, b in itertools.combinations_with_replacement(TYPES, 2)]
    out = spark.createDataFrame([(p,) for p in pairs], "p array<string>").select("p", drift.promoted(F.col("p")).alias("t")).collect()
    for r in out:
        want = drift.promote(r.p[0], r.p[-1])
        assert r.t == ("BIGINT" if want == "COUNTER" else want), r


def test_unified(spark):
    files = [(1, "a", 1, [("pk", "INT", "PARTITION_KEY"), ("n", "INT", "REGULAR"), ("was", "TEXT", "REGULAR")]), (2, "a", 2, [('"PK"', "BIGINT", "PARTITION_KEY"), ("n", "DOUBLE", "REGULAR"), ("now", "TEXT", "REGULAR")])]
    recs = [(1, 1, 1, '{"pk": 1, "n": 2, "was": "x", "unknown": 1}'), (2, 1, 1, '{"\\"PK\\"": 5000000000, "n": 2.5, "now": "x"}'), (2, 2, 2, '{"pk": "no number", "n": null}'), (2, 3, 3, "broken"), (2, 4, 3, '{"n": 9}'), (2, 5, 1, '{"n": 3}'), (2, 6, 4, None), (5, 1, 1, "{}")]
    h, r = heads(spark, files), spark.createDataFrame(recs, BODY)
    got = {(x.file_id, x.row_key, x.column_name, x.type, x.value, x.refused) for x in drift.unified_values(h, r).collect()}
    assert got == {(1, 1, "pk", "BIGINT", "1", False), (1, 1, "n", "DOUBLE", "2", False), (1, 1, "now", "TEXT", "x", False), (2, 1, "pk", "BIGINT", "5000000000", False), (2, 1, "n", "DOUBLE", "2.5", False), (2, 1, "now", "TEXT", "x", False), (2, 2, "pk", "BIGINT", None, True), (2, 3, "n", "DOUBLE", "9", False)}
    rows = {(x.file_id, x.row_key): [(c.name, c.type, c.value) for c in x.columns] for x in drift.unified_rows(h, r).collect()}
    assert set(rows) == {(1, 1), (2, 1), (2, 2), (2, 3), (2, 4)} and rows[(2, 4)] == [("n", "DOUBLE", None), ("now", "TEXT", None), ("pk", "BIGINT", None)]
    wide = drift.unified(h, r, "a")
    assert dict(wide.dtypes)["c_n"] == "double" and dict(wide.dtypes)["c_pk"] == "bigint" and wide.count() == 5
    assert {(x.type) for x in drift.union_schema(h).where("column_name = 'pk'").collect()} == {"BIGINT"}


def test_no_value_is_lost_in_promotion(spark):
    files = [(1, "a", 1, [("pk", "INT", "PARTITION_KEY"), ("n", "DOUBLE", "REGULAR"), ("m", "INT", "REGULAR")]), (2, "a", 2, [("pk", "INT", "PARTITION_KEY"), ("n", "BIGINT", "REGULAR"), ("m", "VARINT", "REGULAR")])]
    recs = [(1, 1, 1, '{"n": "1.5e300"}'), (1, 2, 2, '{"n": 1e-15}'), (2, 1, 1, '{"n": 9007199254740993, "m": "123456789012345678901234567890123456789012"}'), (2, 2, 2, '{"n": "x"}')]
    got = {(x.file_id, x.row_key, x.column_name): (x.type, x.value, x.refused) for x in drift.unified_values(heads(spark, files), spark.createDataFrame(recs, BODY)).collect()}
    assert got[(1, 1, "n")] == ("DECIMAL", "1.5e300", False) and float(got[(1, 2, "n")][1]) == 1e-15 and got[(2, 1, "n")][1] == "9007199254740993"
    assert got[(2, 1, "m")] == ("VARINT", "123456789012345678901234567890123456789012", False) and got[(2, 2, "n")] == ("DECIMAL", None, True)


def test_wide_table_follows_renames(spark):
    files = [(1, "a", 1, [("pk", "INT", "PARTITION_KEY"), ("was", "INT", "REGULAR")]), (2, "a", 2, [("pk", "INT", "PARTITION_KEY"), ("now", "BIGINT", "REGULAR")])]
    recs = [(1, 1, 1, '{"pk": 1, "was": 7}'), (1, 2, 2, None), (2, 1, 1, '{"PK": 1, "now": 7}'), (2, 2, 2, '{"now": null}'), (2, 3, 3, "broken")]
    wide = drift.unified(heads(spark, files), spark.createDataFrame(recs, BODY), "a")
    assert wide.columns == ["file_id", "record_no", "row_key", "c_now", "c_pk"] and dict(wide.dtypes)["c_now"] == "bigint"
    assert {tuple(r) for r in wide.collect()} == {(1, 1, 1, 7, 1), (1, 2, 2, None, None), (2, 1, 1, 7, 1), (2, 2, 2, None, None), (2, 3, 3, None, None)}


@pytest.mark.parametrize("n", [0, 1])
def test_few_files(spark, n):
    h = heads(spark, [(1, "a", 1, [("pk", "INT", "PARTITION_KEY")])]).limit(n)
    assert drift.changes(h, spark.createDataFrame([], BODY)).count() == 0


def test_chains_of_renames_and_names_taken_over(spark):
    names = [["a", "x"], ["b", "x"], ["c", "x"], ["d"], ["d", "a"], ["x", "a"], ["x", "a", "y"]]
    # a -> b -> c -> d -> x is one column; the first x is removed before it takes the name, the later a is another.
    values = [["p", "q"], ["p", "q"], ["p", "q"], ["p"], ["p", "r"], ["p", "r"], ["p", "r", "s"]]
    files = [(k + 1, "t", k, [(n, "TEXT", "REGULAR") for n in cols]) for k, cols in enumerate(names)]
    recs = [(k + 1, i, i, json.dumps({n: f"{v}{i}" for n, v in zip(names[k], values[k])})) for k in range(len(names)) for i in range(3)]
    h, r = heads(spark, files), spark.createDataFrame(recs, BODY)
    got = {(x.file_id, x.name): x.column_name for x in drift.canonical_names(h, r).collect()}
    first = {got[k] for k in ((1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "d"), (6, "x"), (7, "x"))}
    other = {got[(k, "x")] for k in (1, 2, 3)}
    assert len(first) == 1 and len(other) == 1 and first != other and {*first, *other} <= {"x", "x@1"}
    assert got[(5, "a")] == got[(7, "a")] == "a" and got[(7, "y")] == "y"
    per_row = drift.unified_values(h, r).groupBy("file_id", "record_no", "column_name").count()
    assert per_row.where("count > 1").count() == 0
    back = heads(spark, [(1, "t", 1, [("a", "INT", "REGULAR")]), (2, "t", 2, [("b", "INT", "REGULAR")]), (3, "t", 3, [("a", "BIGINT", "REGULAR")])])
    assert {x.column_name for x in drift.canonical_names(back, r.limit(0)).where("name = 'a'").collect()} == {"a"}
