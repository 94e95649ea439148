"""Stored tables, manifests, rejected rows, filters of ids and scopes of intermediate tables."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from epistrand import sources
from epistrand.operators import bloom, cohort
from epistrand.operators import sequences as S
from epistrand.plans import store_sequences
from epistrand.sources import manifest, store
from helpers import rows, shuffle_files


def nodes(df):
    """The executed plan's exchanges, and the scans below each."""
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def runs(spark):
    days = [(f"p{i}", d, "abc"[(i * d) % 3], str(40 + d), 1 + (i + d) % 4) for i in range(30) for d in range(1 + i % 7)]
    counts = spark.createDataFrame(days, "PATIENT_ID string, day int, CODE string, AGE string, n long")
    per_day = counts.groupBy("PATIENT_ID", "day").agg(F.sum("n").alias("n_day"), F.min("AGE").alias("sep_age"))
    return S.place(counts, S.lay_out(per_day, ["PATIENT_ID"]), ["PATIENT_ID"])


def test_splits_leave_stored_sequences_where_they_are(spark, runs, tmp_path):
    plain = S.collect_runs(runs, ["PATIENT_ID"]).withColumnRenamed("PATIENT_ID", "patid")
    split = spark.range(40).select(F.concat(F.lit("p"), F.col("id")).alias("patid"), (F.col("id") % 2).alias("label"),
                                   F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"))
    want = rows(plain.join(split, "patid").select("patid", "code", "label", "split"))
    stored = store_sequences(runs, 5)
    assert rows(stored) == rows(plain)
    files = [os.path.basename(f) for f in stored.inputFiles()]
    assert len(files) == len({f.split("_")[1] for f in files}) <= 5  # one file per bucket
    # A split that is not known to be small: only its side is shuffled.
    wide = split.hint("merge").join(spark.range(10**9).select(F.lit(1).alias("one")).limit(1), how="cross").drop("one")
    joined = cohort.split_sequences(stored, wide)
    assert rows(joined.select("patid", "code", "label", "split")) == want
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = stored.join(split, "patid")
        plan = nodes(joined)
        assert plan.count("Exchange hashpartitioning(patid") == 1 and "SortMergeJoin" in plan
        array_side = plan[: plan.index("Exchange hashpartitioning(patid")]
        assert "FileScan parquet" in array_side and "Bucketed: true" in array_side
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # A small split is broadcast, and nothing is shuffled at all.
    plan = nodes(cohort.split_sequences(stored, split))
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    path = str(tmp_path / "splits")
    cohort.write_splits(stored, split, path)
    assert rows(spark.read.parquet(path).select("patid", "code", "label", "split")) == want
    sources.drop_stored(stored)
    assert not os.path.exists(stored.inputFiles()[0].removeprefix("file:")) if stored.inputFiles() else True


def test_only_changed_partitions_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(k, i, None if i % 5 == 0 else f"x{i}") for i in range(60) for k in [("a", "b c=d", None)[i % 3]]], "k string, n long, x string")
    written = lambda: {os.path.join(r, f): os.path.getmtime(os.path.join(r, f)) for r, _, fs in os.walk(path) for f in fs if f.startswith("part") and "_manifest" not in r}  # noqa: E731, E501
    change = lambda d, **k: sorted(map(tuple, manifest.rebuild_changed(d, path, "k", **k).collect()), key=str)
    assert change(df) == sorted([("a", "new"), ("b c=d", "new"), (None, "new")], key=str)
    assert rows(spark.read.parquet(path).select("k", "n", "x")) == rows(df)
    first = written()
    assert change(df.repartition(7)) == [] and written() == first  # another order is no change
    other = df.withColumn("x", F.when(F.col("k").isNull() & (F.col("n") == 2), "new").otherwise(F.col("x")))
    assert change(other) == [(None, "changed")]
    assert rows(spark.read.parquet(path).select("k", "n", "x")) == rows(other)
    assert len(set(written()) & set(first)) >= 2
    assert change(other.filter("k is null or k <> 'a'")) == [("a", "gone")]
    assert rows(spark.read.parquet(path).select("n")) == rows(other.filter("k is null or k <> 'a'").select("n"))
    # A NULL and an empty text, or values that swap places, are changes; ignored columns are none.
    assert change(other.filter("k is null or k <> 'a'").withColumn("x", F.coalesce("x", F.lit("")))) == sorted([("b c=d", "changed"), (None, "changed")], key=str)
    assert change(other.filter("k is null or k <> 'a'").withColumn("x", F.lit("?")), content=["n"]) != []
    assert change(other.filter("k is null or k <> 'a'").withColumn("x", F.lit("!")), content=["n"]) == []


def test_rebuild_that_broke_off_is_made_up_for(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(0, "a"), (1, "b")], "bucket int, x string")
    manifest.rebuild_changed(df, path)
    # A manifest without its mark of success does not count, and a lost folder is rebuilt.
    os.makedirs(f"{path}/_manifest/v9")
    import shutil

    shutil.move(f"{path}/bucket=1", str(tmp_path / "away"))
    assert [tuple(r) for r in manifest.rebuild_changed(df, path).collect()] == [(1, "new")]
    assert rows(spark.read.parquet(path).select("bucket", "x")) == [(0, "a"), (1, "b")]


def test_rejected_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id,name,v\n1,x,2.5\n2,y\n3,z,oops\n,w,\nfour,u,n/a\n")
    (tmp_path / "in" / "b.csv").write_text("id,name,v\n5,a,b,7\n6,q,1\n")
    schema = StructType([StructField("v", DoubleType()), StructField("id", LongType()), StructField("name", StringType())])
    good, rejects = sources.read_csv_checked(spark, str(tmp_path / "in"), schema)
    assert rows(good) == rows(sources.read_csv_lenient(spark, str(tmp_path / "in"), schema))
    assert rows(good) == [(None, None, "w"), (1.0, 6, "q"), (2.5, 1, "x")]
    got = sorted((os.path.basename(r.file), r.record, r.reasons) for r in rejects.collect())
    assert got == [
        ("a.csv", "2,y", ["number of values"]),
        ("a.csv", "3,z,oops", ["v: not double"]),
        ("a.csv", "four,u,n/a", ["v: not double", "id: not bigint"]),
        ("b.csv", "5,a,b,7", ["number of values"]),
    ]
    counts = {(os.path.basename(r.file), r.reason): r.n for r in sources.reject_counts(rejects).collect()}
    assert counts[("a.csv", "v: not double")] == 2 and sum(counts.values()) == 5


def test_filter_of_ids(spark):
    """Nothing is lost, and what is kept without need is under five in a hundred of the matches."""
    events = spark.range(100_000).select((F.col("id") % 20_000).cast("string").alias("PATIENT_ID"), "id")
    events = events.unionByName(spark.createDataFrame([(None, -1)], "PATIENT_ID string, id long"))
    ids = spark.range(0, 20_000, 4).select(F.col("id").cast("string").alias("patid"))
    ids = ids.unionByName(ids).unionByName(spark.createDataFrame([(None,), ("other",)], "patid string"))
    kept = bloom.prefilter(events, "PATIENT_ID", ids, "patid")
    matches = events.join(ids.distinct(), F.col("PATIENT_ID") == F.col("patid"), "left_semi")
    assert matches.exceptAll(kept).count() == 0
    assert 25_000 <= kept.count() <= 1.05 * 25_000
    assert rows(cohort.restrict_to(events, ids, max_bytes=-1)) == rows(matches)
    plan = nodes(cohort.restrict_to(events, ids, max_bytes=-1))
    assert "Filter" in plan and "scalar-subquery" in plan.lower() or "Subquery" in plan
    assert bloom.prefilter(events, "PATIENT_ID", ids.filter("false"), "patid").count() == 0
    with pytest.MonkeyPatch.context() as m:
        m.setattr(bloom, "MAX_WORDS", 20)  # far too small: more rows stay, none is lost
        assert matches.exceptAll(bloom.prefilter(events, "PATIENT_ID", ids, "patid")).count() == 0


def test_scopes_release_their_tables(spark):
    where = lambda t: t.inputFiles()[0].removeprefix("file:")
    outside = sources.materialize(spark.range(3))
    with sources.scoped_tables() as held:
        a = where(sources.materialize(spark.range(3)))
        with sources.scoped_tables():
            b = where(sources.materialize(spark.range(3)))
        assert os.path.exists(a) and not os.path.exists(b)
        kept = sources.materialize(spark.range(5))
        held.remove(next(t for t in held if t is kept))
    assert not os.path.exists(a) and kept.count() == 5 and outside.count() == 3
    with pytest.raises(ZeroDivisionError):
        with sources.scoped_tables():
            c = where(sources.materialize(spark.range(3)))
            1 / 0
    assert not os.path.exists(c)


def test_files_of_intermediate_tables_end_after_some_rows(spark, monkeypatch):
    """Else a split of a narrow table holds more rows than a task can group in memory."""
    monkeypatch.setattr(store, "FILE_ROWS", 10)
    table = sources.materialize(spark.range(95).coalesce(1))
    assert len(table.inputFiles()) == 10
    assert rows(table) == rows(spark.range(95))
    sources.release(table)


def test_few_buckets_do_not_make_few_tasks(spark, runs):
    plain = rows(S.collect_runs(runs, ["PATIENT_ID"]).withColumnRenamed("PATIENT_ID", "patid"))
    stored = store_sequences(runs, 2)  # the session has eight shuffle partitions
    files = [os.path.basename(f) for f in stored.inputFiles()]
    assert len({f.split("-")[1] for f in files}) > 2 and len({f.split("_")[1][:5] for f in files}) == 2
    assert rows(stored) == plain
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        ids = stored.select("patid").withColumn("n", F.lit(1))
        assert rows(stored.join(ids, "patid").drop("n")) == plain  # Spark relies on the buckets here
        grouped = stored.groupBy("patid").count()
        assert "Exchange" not in nodes(grouped) and grouped.filter("count = 1").count() == len(plain)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    sources.drop_stored(stored)


def test_wide_rows_are_not_sorted_for_a_large_split(spark, runs, monkeypatch):
    sequences = S.collect_runs(runs, ["PATIENT_ID"]).withColumnRenamed("PATIENT_ID", "patid")
    split = spark.range(40).select(F.concat(F.lit("p"), F.col("id")).alias("patid"), F.lit(0).alias("label"), F.lit("train").alias("split"))
    want = rows(cohort.split_sequences(sequences, split))
    monkeypatch.setattr(cohort, "fits_in_broadcast", lambda narrow: False)
    joined = cohort.split_sequences(sequences, split)
    assert "ShuffledHashJoin [patid" in nodes(joined) and "SortMergeJoin [patid" not in nodes(joined)
    assert rows(joined) == want


def test_stored_tables_leave_no_shuffle_files(spark):
    """Neither when the work ends nor when it fails, and the session's settings are as before."""
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, held = spark.conf.get(name), shuffle_files(spark)
    table = store.materialize(counts)
    assert not shuffle_files(spark) - held
    failing = counts.repartition(3, "n").select(F.when(F.col("k") >= 0, F.raise_error(F.lit("no"))).cast("int").alias("k"))
    with pytest.raises(Exception, match="no"):
        store.materialize(failing)
    assert not shuffle_files(spark) - held
    assert spark.conf.get(name) == setting
    # What is asked of the same plan afterwards is computed again.
    assert rows(counts) == rows(table)
