from pyspark.sql import functions as F

from rillfold.operators import collections as co
from tests.logs import time_uuid

HEAD = "pk int, ticks bigint, batch_seq_no int, replace boolean"


def test_sets(spark):
    rows = [
        (1, 1, 0, True, [1, 2, 3, 4], None), (1, 2, 0, False, [5, 6, 6], None), (2, 1, 0, True, None, None), (2, 2, 0, None, [5, 6], None),
        (3, 1, 0, True, [1, 2, 3, 4], None), (3, 2, 0, False, None, [1, 3, None]), (4, 1, 0, False, None, [1138]), (5, 1, 0, True, [1], None), (5, 2, 0, True, None, None), (6, 2, 0, True, [9], None), (6, 1, 0, False, [1], None), (6, 2, 0, False, [None], [9]),
    ]
    df = spark.createDataFrame(rows * 2, f"{HEAD}, added array<int>, removed array<int>").repartition(5)
    assert {r.pk: r.elements for r in co.set_state(df, ["pk"]).collect()} == {1: [1, 2, 3, 4, 5, 6], 2: [5, 6], 3: [2, 4], 6: [9]}
    assert co.set_state(df.limit(0), ["pk"]).count() == 0


def test_maps(spark):
    rows = [(1, 1, 0, True, {1: 2, 3: 4, 5: 6}, None), (1, 2, 0, False, {1: 42}, None), (1, 3, 0, False, {3: None}, None), (1, 4, 0, False, {3: 123}, None), (2, 1, 0, False, {5: 321}, None), (3, 1, 0, True, {1: 1}, None), (3, 2, 0, False, None, [1])]
    df = spark.createDataFrame(rows, f"{HEAD}, added map<int,int>, removed array<int>")
    got = {r.pk: {e["key"]: e["value"] for e in r.entries} for r in co.map_state(df, ["pk"]).collect()}
    assert got == {1: {1: 42, 3: 123, 5: 6}, 2: {5: 321}}


def test_lists(spark):
    # The order is by time, not by the text of the UUID.
    a, b, c = time_uuid(1706486400000), time_uuid(1706486400000 + 500_000), time_uuid(1706486400000 + 430_000_000)
    rows = [(1, 1, 0, True, {c: 3, a: 1}, None), (1, 2, 0, False, {b: 2}, None), (2, 1, 0, True, {a: 1, b: 2}, None), (2, 2, 0, False, None, [a])]
    df = spark.createDataFrame(rows, f"{HEAD}, added map<string,int>, removed array<string>")
    assert {r.pk: r.elements for r in co.list_state(df, ["pk"]).collect()} == {1: [1, 2, 3], 2: [2]}


def test_udts(spark):
    rows = [(1, 1, 0, True, (1, 2, "x"), None), (1, 2, 0, False, (None, 7, None), None), (1, 3, 0, False, (None, None, None), [2]), (2, 1, 0, True, (1, None, None), None), (2, 2, 0, True, (None, None, None), None)]
    df = spark.createDataFrame(rows, f"{HEAD}, added struct<a:int,b:int,c:string>, removed array<int>")
    assert {r.pk: tuple(r.value) for r in co.udt_state(df, ["pk"], ["a", "b", "c"]).collect()} == {1: (1, 7, None)}


def test_values(spark):
    df = spark.createDataFrame([([1, 2], [3, 2], {1: "a"}, {1: "b", 2: "c"})], "a array<int>, b array<int>, m map<int,string>, n map<int,string>")
    r = df.select(co.add_all(F.col("a"), F.col("b")).alias("u"), co.remove_all(F.col("a"), F.col("b")).alias("r"), co.put_all(F.col("m"), F.col("n")).alias("p"), co.add_all(F.lit(None).cast("array<int>"), F.col("b")).alias("z")).first()
    assert (r.u, r.r, r.p, r.z) == ([1, 2, 3], [1], {1: "b", 2: "c"}, [2, 3])


def test_loose_columns_in_a_log(spark, tmp_path):
    """A set, a map, a list and a UDT from raw log rows, delivered twice, in one go and batch by batch."""
    from rillfold.operators import apply
    from rillfold.sources.log import distinct_rows
    from rillfold.streaming import feed
    from tests.logs import BASE_MS, stream

    a, b = time_uuid(BASE_MS), time_uuid(BASE_MS + 500_000)
    raw = "`cdc$stream_id` binary, `cdc$time` string, `cdc$batch_seq_no` int, `cdc$operation` tinyint, `cdc$end_of_batch` boolean, `cdc$ttl` bigint, pk int, ck int, s array<int>, `cdc$deleted_s` boolean, `cdc$deleted_elements_s` array<int>, m map<string,int>, `cdc$deleted_m` boolean, `cdc$deleted_elements_m` array<string>, l map<string,string>, `cdc$deleted_l` boolean, `cdc$deleted_elements_l` array<string>, u struct<x:int,y:string>, `cdc$deleted_u` boolean, `cdc$deleted_elements_u` array<smallint>"

    def row(t, op, pk, ck, s=(None, None, None), m=(None, None, None), l=(None, None, None), u=(None, None, None), ttl=None):  # noqa: E741
        return (stream(pk), time_uuid(BASE_MS + t * 1000), 0, op, True, ttl, pk, ck, *s, *m, *l, *u)

    rows = [
        row(1, 2, 1, 1, ([1, 2], True, None), ({"a": 1, "b": 2}, True, None), ({a: "x"}, True, None), ((1, "p"), True, None)),
        row(2, 1, 1, 1, ([5], None, None), ({"c": 3, "a": 9}, None, None), ({b: "y"}, None, None), ((None, "q"), None, None)),
        row(3, 1, 1, 1, (None, None, [2]), (None, None, ["b"]), (None, None, [a]), (None, None, [0])),
        row(1, 1, 2, 1, ([7], None, None)), row(2, 3, 2, 1), row(3, 1, 2, 1, ([8], None, None)),  # what a deletion of the row leaves
        row(1, 1, 3, 1, ([7], None, None)), row(2, 1, 3, 1, (None, True, None)),  # a set set to null
        row(4, 1, 4, 1, ([1], None, None)), row(1, 1, 4, 1, ([2], True, None)),
    ]
    df = spark.createDataFrame(rows * 2, raw)
    keyed = apply.Keyed(("pk",), ("ck",), (), (("s", "set"), ("m", "map"), ("l", "list"), ("u", "udt")))
    want = {1: ([1, 5], {"a": 9, "c": 3}, ["y"], (None, "q")), 2: ([8], None, None, None), 4: ([1, 2], None, None, None)}
    read = lambda t: {r.pk: (r.s, {e["key"]: e["value"] for e in r.m} if r.m else None, r.l, tuple(r.u) if r.u else None) for r in t.collect()}
    assert read(apply.state(distinct_rows(df), keyed)) == want
    book = feed.StateTable(spark, str(tmp_path / "state"), keyed)
    for n, k in enumerate((2, 0, 1)):
        part = distinct_rows(spark.createDataFrame(rows[k::3], raw))
        book.fold(part, n)
        book.fold(part, n)
    assert read(book.read()) == want
    dying = [row(1, 1, 1, 1, ([7], None, None), ttl=10), row(2, 1, 1, 1, ([8], None, None))]
    assert read(apply.state(distinct_rows(spark.createDataFrame(dying, raw)), keyed, now_ms=BASE_MS + 60_000)) == {1: ([8], None, None, None)}
    images = [row(1, 2, 1, 1), row(2, 9, 1, 1, ([1], None, None)), row(3, 9, 1, 1, ([2], None, None))]
    assert read(apply.state(distinct_rows(spark.createDataFrame(images, raw)), keyed, "postimage")) == {1: ([2], None, None, None)}
