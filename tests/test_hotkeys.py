from collections import Counter

from pyspark.sql import functions as F

from rillfold.operators import hotkeys as hk


def test_heavy_keys_and_complete_results(spark):
    rows = [("hot", i, "x") for i in range(5000)] + [(None, i, "y") for i in range(2000)] + [(f"k{i % 900}", i, "z") for i in range(3000)] + [("", 1, "e")] * 3
    df = spark.createDataFrame(rows, "k string, n int, salt string").repartition(7)
    found = {(r.key_value, r.n) for r in hk.heavy_keys(df, F.col("k"), 0.05).collect()}
    assert found == {("hot", 5000), (None, 2000)}
    out = hk.salted_aggregate(df, {"k": F.col("k")}, [hk.count_rows("n"), hk.least("low", F.col("n")), hk.greatest("high", F.col("n")), hk.count_of("some", F.when(F.col("n") > 10, 1))], heavy_key=F.col("k")).collect()
    counts = Counter(k for k, _, _ in rows)
    assert {r.k: r.n for r in out} == dict(counts) and len(out) == len(counts)
    hot = next(r for r in out if r.k == "hot")
    assert (hot.low, hot.high, hot.some) == (0, 4999, 4989)


def test_salts_split_a_hot_key(spark):
    df = spark.range(20000).select(F.lit("one").alias("k"))
    plan = hk.salted_aggregate(df, {"k": F.col("k")}, [hk.count_rows("n")], heavy_key=F.col("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert "__salt" in plan and "rand(" in plan
    assert hk.salted_aggregate(df, {"k": F.col("k")}, [hk.count_rows("n")], heavy_key=F.col("k")).first().n == 20000


def test_empty_and_null(spark):
    none = spark.createDataFrame([], "k string")
    assert hk.heavy_keys(none, F.col("k"), 0.05).count() == 0
    assert hk.salted_aggregate(none, {"k": F.col("k")}, [hk.count_rows("n")], heavy_key=F.col("k")).count() == 0
    nulls = spark.createDataFrame([(None,)] * 4, "k string")
    assert [tuple(r) for r in hk.heavy_keys(nulls, F.col("k"), 0.05).collect()] == [(None, 4)]
    # At the border: exactly 5 %.
    border = spark.createDataFrame([("a",)] * 5 + [(f"b{i}",) for i in range(95)], "k string")
    assert [tuple(r) for r in hk.heavy_keys(border, F.col("k"), 0.05).collect()] == [("a", 5)]
