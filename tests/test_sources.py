import datetime

import pytest

from helpers import rows
from epistrand import schemas, sources

CSV = """EXTRA,PATIENT_ID,Shifted_date,LAB_NAME,RESULT
z,1,2020-01-02,INR,<5
z,2,not a date,INR,7
z,3,2020-01-03,"A, B",
z,4,2020-01-03
z,5,2020-01-03,INR,1,more
"""


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "labs.csv"
    path.write_text(CSV)
    return str(path)


def test_lenient_csv_drops_bad_rows_whatever_is_selected(spark, csv):
    df = sources.read_csv_lenient(spark, csv, schemas.LABS)
    assert rows(df) == [("1", datetime.date(2020, 1, 2), "INR", "<5"), ("3", datetime.date(2020, 1, 3), "A, B", None)]
    assert rows(df.select("RESULT")) == [(None,), ("<5",)]
    assert df.count() == 2


def test_strict_csv_fails_on_bad_rows_and_missing_columns(spark, csv):
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        sources.read_csv_strict(spark, csv, schemas.LABS).collect()
    with pytest.raises(ValueError, match="VITAL_CODE"):
        sources.read_csv_strict(spark, csv, schemas.VITALS)


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "dem")
    df = spark.createDataFrame([("1", 60), ("2", None)], schemas.DEMOGRAPHICS)
    sources.write_csv(df, path)
    assert rows(sources.read_csv_strict(spark, path, schemas.DEMOGRAPHICS)) == rows(df)
    assert rows(sources.read_csv_strings(spark, path)) == [("1", "60"), ("2", None)]


def test_tsv_drops_every_line_like_the_header(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text('a\tb\n1\t"x\na\tb\n2\ty\na\tz\n')
    assert rows(sources.read_tsv(spark, str(path))) == [("1", '"x'), ("2", "y"), ("a", "z")]


def test_parquet_round_trip_and_globs(spark, tmp_path):
    long = ["t"] * 50000
    one = spark.createDataFrame([("1", long)], "patid string, code array<string>")
    two = spark.createDataFrame([("2", ["u"])], "patid string, code array<string>")
    sources.write_parquet(one, str(tmp_path / "bucket_0.parquet"))
    sources.write_parquet(two, str(tmp_path / "bucket_1.parquet"))
    assert rows(sources.read_events(spark, str(tmp_path / "bucket_*.parquet"))) == [("1", long), ("2", ["u"])]


def test_buckets_keep_patients_together(spark, tmp_path):
    path = str(tmp_path / "events")
    df = spark.range(1000).selectExpr("cast(id % 97 as string) as PATIENT_ID", "id as x")
    sources.write_bucketed(df, path, "PATIENT_ID", 5)
    back = spark.read.parquet(path)
    assert rows(back.select("PATIENT_ID", "x")) == rows(df)
    per_patient = back.groupBy("PATIENT_ID").agg({"bucket": "min", "*": "count"})
    spread = back.select("PATIENT_ID", "bucket").distinct().count()
    assert spread == per_patient.count() == 97
    assert sorted(r.bucket for r in back.select("bucket").distinct().collect()) == [0, 1, 2, 3, 4]


def test_rebuilding_partitions(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(0, "a"), (1, "b")], "bucket int, x string")
    sources.rebuild_partitions(df.filter("bucket = 0"), path)
    changed = spark.createDataFrame([(0, "A"), (1, "B"), (2, "C")], "bucket int, x string")
    sources.rebuild_partitions(changed, path)
    assert rows(spark.read.parquet(path).select("bucket", "x")) == [(0, "a"), (1, "B"), (2, "C")]
    sources.rebuild_partitions(changed.filter("bucket < 2"), path, skip_present=False)
    assert rows(spark.read.parquet(path).select("bucket", "x")) == [(0, "A"), (1, "B"), (2, "C")]
    sources.rebuild_partitions(changed, path)
    assert spark.read.parquet(path).count() == 3


def test_logs_grow(spark, tmp_path):
    path = str(tmp_path / "log")
    first = spark.createDataFrame([(0, 1, 1, 0.5, 0.25, 1.5)], schemas.STEP_LOG)
    second = spark.createDataFrame([(0, 201, 201, 0.25, 0.5, 2.5)], schemas.STEP_LOG)
    sources.append_log(first, path)
    sources.append_log(second, path)
    assert rows(sources.read_log(spark, path)) == rows(first.union(second))


def test_binary_as_string(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = str(tmp_path / "b.parquet")
    pq.write_table(pa.table({"x": pa.array([b"abc"], pa.binary())}), path)
    before = spark.conf.get("spark.sql.parquet.binaryAsString")
    try:
        sources.use_binary_as_string(spark)
        assert rows(spark.read.parquet(path)) == [("abc",)]
    finally:
        spark.conf.set("spark.sql.parquet.binaryAsString", before)


def test_named_and_materialized_relations(spark):
    df = sources.name_relation(spark.range(3), "three_rows")
    assert spark.sql("SELECT count(*) FROM three_rows").first()[0] == 3
    kept = sources.materialize(df)
    assert kept.count() == 3 and spark.sparkContext.getCheckpointDir() is not None


@pytest.mark.parametrize("read", [sources.read_csv_strict, sources.read_csv_lenient])
def test_files_with_columns_in_another_order_fail(spark, tmp_path, read):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("PATIENT_ID,AGE_AT_END\n1,60\n")
    (tmp_path / "in" / "b.csv").write_text("AGE_AT_END,PATIENT_ID\n70,2\n")
    with pytest.raises(Exception, match="header"):
        read(spark, str(tmp_path / "in"), schemas.DEMOGRAPHICS).collect()


def test_rebuild_lists_partitions_of_any_value(spark, tmp_path):
    path = str(tmp_path / "out")
    data = [(1, "a b/c=d"), (2, None), (3, "x%y")]
    old = spark.createDataFrame([(n, k, "old") for n, k in data], "n int, k string, run string")
    sources.rebuild_partitions(old, path, "k")
    new = spark.createDataFrame([(n, k, "new") for n, k in [*data, (4, "more")]], "n int, k string, run string")
    sources.rebuild_partitions(new, path, "k")
    assert rows(spark.read.parquet(path).select("n", "run")) == [(1, "old"), (2, "old"), (3, "old"), (4, "new")]


def test_materialized_tables_need_a_folder_and_can_be_removed(spark):
    table = sources.materialize(spark.range(5))
    assert table.count() == 5
    sources.release(table)
    with pytest.raises(Exception):
        spark.read.parquet(table.inputFiles()[0])
