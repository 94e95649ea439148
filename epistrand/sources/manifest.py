"""Partitioned tables that are rebuilt only where their input changed."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistrand.operators.skew import null_safe_join
from epistrand.sources.files import partition_folders
from epistrand.sources.store import materialize, release

_FOLDER = "_manifest"
_PRINT = ["rows", "mixed", "added"]


def fingerprints(df: DataFrame, by: str, content: list[str] | None = None) -> DataFrame:
    """For each value of ``by``: the number of rows and two sums of their hashes, whatever their order.

    ``content`` names the columns that count, all by default. Sums are made map-side, so a
    partition may have any share of the rows.
    """
    columns = [c for c in (content or df.columns) if c != by]
    # NULL is told apart from other values by the second hash.
    nulls = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in columns]) if columns else F.lit("")
    rows = df.select(F.col(by), F.xxhash64(*columns, nulls).alias("_hash"))
    return rows.groupBy(by).agg(
        F.count("*").alias("rows"),
        F.bit_xor("_hash").alias("mixed"),
        F.sum(F.col("_hash").cast("decimal(38,0)")).cast("string").alias("added"),
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The fingerprints of the last rebuild that ended, or None."""
    versions = _versions(spark, path)
    return spark.read.parquet(f"{path}/{_FOLDER}/v{max(versions)}") if versions else None


def rebuild_changed(df: DataFrame, path: str, by: str = "bucket", content: list[str] | None = None) -> DataFrame:
    """Make the table at ``path`` hold ``df``, partitioned by ``by``, writing only partitions that changed.

    A partition is written if its fingerprint differs from the manifest's or its folder is
    missing, and removed if ``df`` has none of its rows. The manifest of a rebuild is written
    last and counts only when it is whole, so a rebuild that broke off is made up for by the
    next one. Returns ``by, change``: ``new``, ``changed`` or ``gone`` for what was done.
    """
    spark = df.sparkSession
    now = materialize(fingerprints(df, by, content))
    before = read_manifest(spark, path)
    before = now.filter("false") if before is None else before
    folders = partition_folders(spark, path, by)
    here = F.coalesce(F.col(by).cast("string"), F.lit(None)).isin(list(folders)) | (F.col(by).isNull() & F.lit(None in folders))
    old = before.select(by, F.struct(*_PRINT).alias("_old")).filter(F.coalesce(here, F.lit(False)))
    both = null_safe_join(now.select(by, F.struct(*_PRINT).alias("_new")), old, [by], "left")
    stale = both.filter(F.col("_old").isNull() | (F.col("_old") != F.col("_new")))
    stale = materialize(stale.select(by, F.when(F.col("_old").isNull(), "new").otherwise("changed").alias("change")))
    present = {None if v is None else str(v) for (v,) in now.select(by).collect()}
    gone = [value for value in folders if value not in present]
    if not stale.isEmpty():
        # There are as many rows as folders.
        todo = F.broadcast(stale.select(by))
        rows = null_safe_join(df, todo, [by])
        writer = rows.select(*df.columns).hint("rebalance", by).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for value in gone:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{folders[value]}")
        folder.getFileSystem(conf).delete(folder, True)
    now.coalesce(1).write.parquet(f"{path}/{_FOLDER}/v{max(_versions(spark, path, whole=False), default=0) + 1}")
    release(now)
    kind = df.schema[by].dataType
    left = spark.createDataFrame([(v,) for v in gone], "_value string").select(F.col("_value").cast(kind).alias(by), F.lit("gone").alias("change"))
    return stale.unionByName(left)


def _versions(spark, path, whole=True):
    """Numbers of the manifests, by default of those that were written to their end."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{_FOLDER}")
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    found = [s.getPath() for s in system.listStatus(folder)]
    done = [p for p in found if not whole or system.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return [int(p.getName()[1:]) for p in done]
