"""Distinct counts: exact, and from sketches of parts."""

from pyspark.sql import functions as F

from epistrand.operators import distinct as D
from helpers import rows


def test_sketches_of_parts_add_up(spark):
    df = spark.range(60_000).select(
        (F.col("id") % 3).alias("g"), (F.col("id") % 50).alias("part"), (F.col("id") % 20_000).cast("string").alias("x")
    )
    df = df.unionByName(df.limit(5000)).unionByName(spark.createDataFrame([(7, 1, None), (None, 2, "a")], "g long, part long, x string"))
    exact = {r.g: r.n for r in D.count_distinct(df, ["g"], "x").collect()}
    assert exact == {r.g: r.n for r in df.groupBy("g").agg(F.countDistinct("x").alias("n")).collect()}
    assert exact[7] == 0 and exact[None] == 1
    for lg in (10, 12, 14):
        sketches = D.sketch_distinct(df, ["g", "part"], "x", lg)
        found = {r.g: r.estimate for r in D.estimate_distinct(sketches, ["g"]).collect()}
        assert found.keys() == exact.keys()
        for g, n in exact.items():
            assert abs(found[g] - n) <= D.error_bound(lg) * n
    # In two steps, and with a part added later, as in one.
    sketches = D.sketch_distinct(df, ["g", "part"], "x")
    halves = D.merge_sketches(sketches.filter("part < 20"), ["g"]).unionByName(D.merge_sketches(sketches.filter("part >= 20"), ["g"]))
    whole = D.sketch_distinct(df, ["g"], "x").select("g", F.hll_sketch_estimate("sketch").alias("estimate"))
    assert rows(D.estimate_distinct(halves, ["g"])) == rows(D.estimate_distinct(sketches, ["g"]))
    assert all(abs(a[1] - b[1]) <= 1 + 0.01 * b[1] for a, b in zip(rows(D.estimate_distinct(sketches, ["g"])), rows(whole)))


def test_no_rows(spark):
    none = spark.createDataFrame([], "g int, x string")
    assert D.count_distinct(none, ["g"], "x").count() == 0
    assert D.estimate_distinct(D.sketch_distinct(none, ["g"], "x"), ["g"]).count() == 0
