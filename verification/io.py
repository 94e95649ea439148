"""Queries that write a given table with the sinks of the library and read it again."""

import functools
import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from epistrand import sources
from epistrand.operators import cohort
from epistrand.operators.skew import number_rows
from epistrand.sources import manifest
from epistrand.functions.scalars import bucket_of
from epistrand.sources.store import checkpoint_folder

BUCKETS = 8


def _folder(spark):
    return f"{checkpoint_folder(spark)}/io-{uuid.uuid4()}"


def _schema(**columns):
    return StructType([StructField(n, t) for n, t in columns.items()])


def csv_lenient(views):
    """Balances of some customers are no numbers, and some keys are missing; the former rows drop out."""
    path, spark = _folder(views.spark), views.spark
    balance = F.when(F.col("c_custkey") % 7 == 0, F.lit("n/a")).otherwise(F.col("c_acctbal").cast("string"))
    key = F.when(F.col("c_custkey") % 11 != 0, F.col("c_custkey"))
    sources.write_csv(views.table("customer").select("c_name", balance.alias("balance"), key.alias("key")), path)
    return sources.read_csv_lenient(spark, path, _schema(key=LongType(), balance=DoubleType()))


def csv_strict(views):
    path = _folder(views.spark)
    sources.write_csv(views.table("nation").select("n_name", "n_nationkey", "n_regionkey"), path)
    return sources.read_csv_strict(views.spark, path, _schema(n_nationkey=IntegerType(), n_name=StringType()))


def csv_strings(views):
    path = _folder(views.spark)
    sources.write_csv(views.table("customer").select("c_custkey", "c_mktsegment"), path)
    return sources.read_csv_strings(views.spark, path)


def tsv(views):
    """A row in the middle repeats the header."""
    path, spark = _folder(views.spark), views.spark
    rows = views.table("customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("name"))
    head = rows.limit(1).select(F.lit("key").alias("key"), F.lit("name").alias("name"))
    rows.unionByName(head).write.option("sep", "\t").option("header", True).csv(path)
    return sources.read_tsv(spark, path)


def parquet_glob(views):
    folder = _folder(views.spark)
    rows = views.table("customer").select("c_custkey", "c_nationkey")
    for odd in (0, 1):
        sources.write_parquet(rows.filter(F.col("c_custkey") % 2 == odd), f"{folder}/part_{odd}.parquet")
    return sources.read_events(views.spark, f"{folder}/part_*.parquet")


def bucketed(views):
    """Each key is in one bucket, and all of them are there."""
    path = _folder(views.spark)
    sources.write_bucketed(views.table("orders").select("o_custkey", "o_orderkey"), path, "o_custkey", BUCKETS)
    rows = sources.read_events(views.spark, path).filter(F.col("bucket") == bucket_of(F.col("o_custkey"), BUCKETS))
    return rows.groupBy("o_custkey").agg(F.count("*").alias("n"), F.countDistinct("bucket").alias("n_buckets"))


def rebuilt_partitions(views):
    """Two buckets are there already; a second run adds the others and leaves those alone."""
    path = _folder(views.spark)
    rows = views.table("orders").select("o_orderkey", (F.col("o_orderkey") % BUCKETS).cast("int").alias("bucket"))
    old = rows.filter("bucket < 2").withColumn("run", F.lit(1))
    sources.rebuild_partitions(old, path)
    sources.rebuild_partitions(rows.withColumn("run", F.lit(2)), path)
    return sources.read_events(views.spark, path).select("o_orderkey", "bucket", "run")


def log(views):
    path = _folder(views.spark)
    rows = views.training_log.select(
        F.col("run_id").cast("int").alias("epoch"), F.col("cnt").cast("int").alias("cnt"),
        F.col("cnt").alias("global_step"), "loss", F.lit(0.5).alias("precision"), F.lit(1.0).alias("time"),
    )
    for odd in (0, 1):
        sources.append_log(rows.filter(F.col("cnt") % 2 == odd), path)
    return sources.read_log(views.spark, path).select("epoch", "cnt", "global_step", "loss")


def csv_rejects(views):
    """The rows that csv_lenient leaves out, and others whose key is no number, with the reasons."""
    path, spark = _folder(views.spark), views.spark
    balance = F.when(F.col("c_custkey") % 7 == 0, F.lit("n/a")).otherwise(F.col("c_acctbal").cast("string"))
    key = F.when(F.col("c_custkey") % 5 == 0, F.lit("none")).otherwise(F.col("c_custkey").cast("string"))
    sources.write_csv(views.table("customer").select("c_name", balance.alias("balance"), key.alias("key")), path)
    good, rejects = sources.read_csv_checked(spark, path, _schema(key=LongType(), balance=DoubleType()))
    rejects = rejects.filter(F.col("file").contains(path.rsplit("/", 1)[1]))
    bad = rejects.select("record", F.array_join("reasons", "; ").alias("reasons"))
    return bad.unionByName(good.select(F.col("key").cast("string").alias("record"), F.lit("").alias("reasons")))


def changed_partitions(views):
    """Of eight partitions one changes, one goes, and a third run finds nothing to do."""
    path = _folder(views.spark)
    bucket = (F.col("o_orderkey") % BUCKETS).cast("int")
    rows = views.table("orders").select("o_orderkey", F.col("o_custkey").alias("o_custkey"), bucket.alias("bucket"))
    content = ["o_orderkey", "o_custkey"]
    manifest.rebuild_changed(rows.withColumn("run", F.lit(1)), path, content=content)
    changed = F.when(F.col("bucket") == 3, -F.col("o_custkey")).otherwise(F.col("o_custkey"))
    rows = rows.filter("bucket <> 5").withColumn("o_custkey", changed)
    for run in (2, 3):
        manifest.rebuild_changed(rows.withColumn("run", F.lit(run)), path, content=content)
    return sources.read_events(views.spark, path).select("o_orderkey", "o_custkey", "bucket", "run")


def _foreign_files(batches, folder):
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSystem
    from pyspark import TaskContext

    system, where = FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
    system.create_dir(where)
    name = f"{where}/part-{TaskContext.get().partitionId()}.parquet"
    held = list(batches)
    if held:
        pq.write_table(pa.Table.from_batches(held), name, filesystem=system)
    yield pa.RecordBatch.from_pydict({"file": [name]})


def binary_as_string(views):
    """Text stored as Parquet binary without an annotation."""
    path, spark = _folder(views.spark), views.spark
    rows = views.table("customer").select("c_custkey", F.col("c_name").cast("binary").alias("name"))
    # Spark's own files name its types; these come from another writer, one file per task.
    rows.mapInArrow(functools.partial(_foreign_files, folder=path), "file string").count()
    before = spark.conf.get(BINARY)
    try:
        sources.use_binary_as_string(spark)
        return sources.materialize(sources.read_events(spark, path))
    finally:
        spark.conf.set(BINARY, before)


BINARY = "spark.sql.parquet.binaryAsString"


def scoped_tables(views):
    """Ranks of customers by way of intermediate tables, and how many of those are left."""
    path, spark = _folder(views.spark), views.spark
    with sources.scoped_tables() as held:
        ranked = number_rows(views.table("customer").select("c_custkey", "c_nationkey"), ["c_nationkey"], ["c_custkey"], "place")
        sources.write_parquet(ranked, path)
        folders = [t.inputFiles()[0].rsplit("/", 1)[0] for t in held]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in folders]
    left = sum(p.getFileSystem(conf).exists(p) for p in paths)
    return sources.read_events(spark, path).withColumns({"n_made": F.lit(len(folders)), "n_left": F.lit(left)})


def written_splits(seqs, split):
    path = _folder(seqs.sparkSession)
    cohort.write_splits(seqs, split, path)
    return sources.read_events(seqs.sparkSession, path)


QUERIES = {
    f"source_{f.__name__}": f for f in (
        csv_lenient, csv_strict, csv_strings, csv_rejects, tsv, parquet_glob, bucketed, rebuilt_partitions,
        changed_partitions, binary_as_string, scoped_tables, log,
    )
}

SQL = {
    "source_csv_rejects": """
SELECT concat(c_name, ',', CASE WHEN c_custkey % 7 = 0 THEN 'n/a' ELSE CAST(c_acctbal AS VARCHAR) END, ',',
    CASE WHEN c_custkey % 5 = 0 THEN 'none' ELSE CAST(c_custkey AS VARCHAR) END) AS record,
  concat_ws('; ', CASE WHEN c_custkey % 5 = 0 THEN 'key: not bigint' END, CASE WHEN c_custkey % 7 = 0 THEN 'balance: not double' END) AS reasons
FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 7 = 0
UNION ALL SELECT CAST(c_custkey AS VARCHAR), '' FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0""",
    "source_changed_partitions": f"""
SELECT o_orderkey, CASE WHEN o_orderkey % {BUCKETS} = 3 THEN -o_custkey ELSE o_custkey END AS o_custkey,
  CAST(o_orderkey % {BUCKETS} AS INT) AS bucket, CAST(CASE WHEN o_orderkey % {BUCKETS} = 3 THEN 2 ELSE 1 END AS INT) AS run
FROM orders WHERE o_orderkey % {BUCKETS} <> 5""",
    "source_binary_as_string": "SELECT c_custkey, c_name AS name FROM customer",
    "source_scoped_tables": """
SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS place, CAST(1 AS INT) AS n_made, CAST(0 AS INT) AS n_left
FROM customer""",
    "source_csv_lenient": """
SELECT CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_custkey AS BIGINT) END AS key, CAST(c_acctbal AS DOUBLE) AS balance
FROM customer WHERE c_custkey % 7 <> 0""",
    "source_csv_strict": "SELECT CAST(n_nationkey AS INT) AS n_nationkey, n_name FROM nation",
    "source_csv_strings": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_mktsegment FROM customer",
    "source_tsv": "SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name FROM customer",
    "source_parquet_glob": "SELECT c_custkey, c_nationkey FROM customer",
    "source_bucketed": "SELECT o_custkey, count(*) AS n, CAST(1 AS BIGINT) AS n_buckets FROM orders GROUP BY o_custkey",
    "source_rebuilt_partitions": f"""
SELECT o_orderkey, CAST(o_orderkey % {BUCKETS} AS INT) AS bucket, CAST(CASE WHEN o_orderkey % {BUCKETS} < 2 THEN 1 ELSE 2 END AS INT) AS run
FROM orders""",
    "source_log": "SELECT CAST(run_id AS INT) AS epoch, CAST(cnt AS INT) AS cnt, cnt AS global_step, loss FROM training_log",
}
