import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import rows
from epistrand.operators import skew


def test_salted_join_gives_the_same_rows(spark):
    # One key has a third of the rows, and most of those are equal; some keys are unknown or NULL.
    big = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 2000).cast("string"))).alias("key"),
        F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id")).alias("x"),
    )
    names = spark.range(1500).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.col("id").alias("y"))
    lookup = names.union(spark.createDataFrame([("hot", -1), ("other", -2)], "key string, y long"))
    assert [tuple(r) for r in skew.hot_keys(big, "key", 100).collect()] == [("hot", 30)]
    for how in ("inner", "left"):
        salted = skew.salted_join(big, lookup, "key", how, task_rows=100)
        plain = big.join(lookup, "key", how).select(salted.columns)
        assert salted.exceptAll(plain).count() == plain.exceptAll(salted).count() == 0
        small = skew.lookup_join(big, lookup, "key", how).select(salted.columns)
        large = skew.lookup_join(big, lookup, "key", how, max_bytes=10).select(salted.columns)
        assert small.exceptAll(plain).count() == large.exceptAll(small).count() == 0


def test_hot_and_null_rows_are_spread_over_tasks(spark):
    """A third of the rows has one key, and half of the others none."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id").cast("string")))
        big = spark.range(0, 24_000, 1, 4).select(key.alias("key"), (F.col("id") % 1000).alias("x"))
        lookup = spark.createDataFrame([("hot", 1)], "key string, y long").hint("merge")
        joined = skew.salted_join(big, lookup, "key", "left", task_rows=100)
        sizes = [r.n for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 24_000 and max(sizes) < 2 * sum(sizes) / len(sizes)
        assert joined.filter("y = 1").count() == 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_fits_in_broadcast(spark, tmp_path):
    """By file sizes, without running a job."""
    spark.range(10_000).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    assert skew.fits_in_broadcast(table, 1_000_000) and skew.fits_in_broadcast(table.groupBy("id").count(), 1_000_000)
    assert not skew.fits_in_broadcast(table, 1000)
    assert set(tracker.getJobIdsForGroup(None)) == before


def test_null_safe_join(spark):
    left = spark.createDataFrame([(None, 1, "a"), (None, None, "b"), (2, 1, "c")], "k int, l int, x string")
    right = spark.createDataFrame([(None, 1, 7), (None, None, 8), (2, None, 9)], "k int, l int, y int")
    assert rows(skew.null_safe_join(left, right, ["k", "l"]).select("x", "y")) == [("a", 7), ("b", 8)]


def test_rows_are_numbered_by_ranges_of_the_data(spark):
    """Keys that share long prefixes, and NULL groups."""
    tokens = [(None if i % 3 == 0 else "g", f"DX:ICD10CM:LONGPREFIX{i:05d}") for i in range(900)]
    df = spark.createDataFrame(tokens, "g string, token string").repartition(5)
    got = {(r.g, r.token): r.n for r in skew.number_rows(df, ["g"], ["token"], "n").collect()}
    for g in (None, "g"):
        assert [got[g, t] for t in sorted(t for x, t in tokens if x == g)] == list(range(sum(x == g for x, _ in tokens)))
    assert skew.number_rows(df.limit(0), [], ["token"], "n").count() == 0


def test_running_before_equals_a_window(spark):
    rng = random.Random(3)
    data = [(rng.choice("gh"), rng.randrange(4), rng.randrange(3), i, rng.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(data, "g string, a int, b int, o int, v int")
    window = Window.partitionBy("g").orderBy("a", "b", "o").rowsBetween(Window.unboundedPreceding, -1)
    expected = df.withColumn("t", F.coalesce(F.sum("v").over(window), F.lit(0)))
    got = skew.running_before(df, ["g"], ["a", "b"], [F.col("o")], F.col("v"), "t").select(expected.columns)
    assert rows(got) == rows(expected)
    whole = Window.orderBy("a", "o").rowsBetween(Window.unboundedPreceding, -1)
    expected = df.withColumn("t", F.coalesce(F.sum("v").over(whole), F.lit(0)))
    got = skew.running_before(df, [], ["a"], [F.col("o")], F.col("v"), "t").select(expected.columns)
    assert rows(got) == rows(expected)


def test_running_before_keeps_null_groups(spark):
    df = spark.createDataFrame([(None, None, 1, 5), (None, 2, 2, 6), ("g", None, 3, 7), ("g", None, 4, 8)], "g string, a int, o int, v int")
    got = skew.running_before(df, ["g"], ["a"], [F.col("o")], F.col("v"), "t").select("o", "t")
    assert rows(got) == [(1, 0), (2, 5), (3, 0), (4, 7)]


def test_heavy_keys_are_found_with_few_counters(spark, monkeypatch):
    """Every key above the share is found though each task keeps only some counters, and no count is too high."""
    monkeypatch.setattr(skew, "COUNTERS", 40)
    monkeypatch.setattr(skew, "MAX_HOT", 10)
    rng = random.Random(1)
    keys = ["hot"] * 6000 + ["warm"] * 2500 + [f"k{rng.randrange(8000)}" for _ in range(11_000)] + [None] * 3000
    rng.shuffle(keys)
    df = spark.createDataFrame([(k,) for k in keys], "key string").repartition(5)
    hot = {r.key: r._2 if hasattr(r, "_2") else r[1] for r in skew.hot_keys(df, "key", 1000).collect()}
    # The share is a tenth of 19,500 rows; a count may be too low by a fortieth of them.
    assert set(hot) == {"hot", "warm"}
    assert 3 <= hot["hot"] <= 4 and hot["warm"] == 2
    numbers = spark.range(1000).select(F.when(F.col("id") < 600, 7).otherwise(F.col("id")).alias("key"))
    assert [tuple(r) for r in skew.hot_keys(numbers, "key", 100).collect()] == [(7, 7)]
    assert skew.hot_keys(df.filter("false"), "key", 10).count() == 0


def test_one_narrow_scan_for_hot_keys(spark, tmp_path):
    """The summaries read the key alone, and no plan groups all rows by it."""
    spark.range(1000).select((F.col("id") % 10).alias("key"), F.lit("wide").alias("x")).write.parquet(str(tmp_path / "t"))
    narrow = spark.read.parquet(str(tmp_path / "t")).filter("key is not null").select(F.col("key").alias("_key"))
    plan = narrow.mapInArrow(skew._summarize, "_key long, _n long")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<key:bigint>" in plan and "Exchange" not in plan


def test_small_lookup_from_a_large_table_is_broadcast(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    bound = spark.range(10**6).select((F.col("id") % 5).alias("k"), F.lit(1).alias("v"))
    lookup = bound.groupBy("k").agg(F.sum("v").alias("v"))
    joined = skew.lookup_join(rows, lookup, "k", "left", max_bytes=1_000_000, bound=bound)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    counted = lambda df: {tuple(r) for r in df.groupBy("k", "v").count().collect()}
    assert counted(joined) == counted(rows.join(lookup, "k", "left"))
