"""CSV, TSV and Parquet readers and writers."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from epistrand.functions.scalars import bucket_of


def _csv_columns(spark, path, schema, sep):
    """Names of all columns, from the first line of the first file."""
    header = spark.read.option("header", True).option("sep", sep).csv(path).columns
    missing = [name for name in schema.names if name not in header]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    return header


def _read_csv(spark, path, fields, mode, sep):
    # With enforceSchema off, a file whose header has other names or another order fails the job.
    reader = spark.read.schema(StructType(fields)).option("header", True).option("sep", sep).option("enforceSchema", False)
    # A row with too few or too many values is bad, whichever columns a query uses.
    return reader.option("mode", mode).option("columnPruning", False).csv(path)


def read_csv_lenient(spark: SparkSession, path: str, schema: StructType, sep: str = ",") -> DataFrame:
    """CSV with a header; rows that do not fit the schema are left out.

    Columns are found by name; further columns are ignored. All files must have the same
    columns in the same order, else the job fails. Values are read as text and converted
    here, since the reader itself looks only at the columns in use.
    """
    header = _csv_columns(spark, path, schema, sep)
    table = _read_csv(spark, path, [StructField(name, StringType()) for name in header], "DROPMALFORMED", sep)
    good = F.lit(True)
    columns = []
    for field in schema.fields:
        value = F.col(f"`{field.name}`").try_cast(field.dataType)
        columns.append(value.alias(field.name))
        if field.dataType != StringType():
            good = good & (F.col(f"`{field.name}`").isNull() | value.isNotNull())
    return table.filter(good).select(*columns)


def read_csv_checked(spark: SparkSession, path: str, schema: StructType, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """CSV with a header as two tables: rows that fit the schema, and those that do not.

    The first is what :func:`read_csv_lenient` gives. The second has ``file``, ``record`` (the
    line, or the values of a line whose number of values is right) and ``reasons``: ``number of
    values``, or ``<column>: not <type>`` for each value that does not fit.
    """
    header = _csv_columns(spark, path, schema, sep)
    fields = StructType([StructField(name, StringType()) for name in [*header, _BAD_LINE]])
    reader = spark.read.schema(fields).option("header", True).option("sep", sep).option("enforceSchema", False)
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BAD_LINE).option("columnPruning", False)
    table = reader.csv(path).select("*", F.col("_metadata.file_path").alias("_file"))
    values = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in schema.fields}
    misfits = [
        F.when(F.col(f"`{f.name}`").isNotNull() & values[f.name].isNull(), F.lit(f"{f.name}: not {f.dataType.simpleString()}"))
        for f in schema.fields
        if f.dataType != StringType()
    ]
    several = F.filter(F.array(*misfits).cast("array<string>"), lambda m: m.isNotNull())
    reasons = F.when(F.col(_BAD_LINE).isNotNull(), F.array(F.lit("number of values"))).otherwise(several)
    judged = table.withColumn("_reasons", reasons)
    good = judged.filter(F.size("_reasons") == 0).select(*[values[f.name].alias(f.name) for f in schema.fields])
    line = F.to_csv(F.struct(*[F.col(f"`{name}`") for name in header]), {"sep": sep})
    rejects = judged.filter(F.size("_reasons") > 0).select(
        F.col("_file").alias("file"), F.coalesce(F.col(_BAD_LINE), line).alias("record"), F.col("_reasons").alias("reasons")
    )
    return good, rejects


_BAD_LINE = "_bad_line"


def reject_counts(rejects: DataFrame) -> DataFrame:
    """``file, reason, n``: how often each reason kept a row of a file out."""
    return rejects.select("file", F.explode("reasons").alias("reason")).groupBy("file", "reason").agg(F.count("*").alias("n"))


def read_csv_strict(spark: SparkSession, path: str, schema: StructType, sep: str = ",") -> DataFrame:
    """CSV with a header; a row that does not fit the schema fails the job."""
    declared = {f.name: f for f in schema.fields}
    fields = [declared.get(n, StructField(n, StringType())) for n in _csv_columns(spark, path, schema, sep)]
    return _read_csv(spark, path, fields, "FAILFAST", sep).select(*[f"`{n}`" for n in declared])


def read_csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column as text."""
    return spark.read.csv(path, header=True)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated text, every column as text. Lines equal to the header are dropped wherever they stand."""
    table = spark.read.csv(path, sep="\t", header=True, quote="")
    is_header = F.lit(True)
    for name in table.columns:
        is_header = is_header & F.coalesce(F.col(f"`{name}`") == F.lit(name), F.lit(False))
    return table.filter(~is_header)


def read_events(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files, directories or globs as one table."""
    return spark.read.parquet(*paths)


def use_binary_as_string(spark: SparkSession) -> None:
    """Read Parquet binary columns without an annotation as text, for this session."""
    spark.conf.set("spark.sql.parquet.binaryAsString", "true")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def with_bucket(df: DataFrame, key: str, n: int = 20) -> DataFrame:
    """Add ``bucket``: rows of one key share a bucket in [0, n)."""
    return df.withColumn("bucket", bucket_of(F.col(key), n))


def write_bucketed(df: DataFrame, path: str, key: str, n: int = 20, mode: str = "errorifexists") -> None:
    """Parquet, one directory per hash bucket of ``key``.

    The rebalance hint lets Spark cut a bucket that holds far more rows than the
    others into several tasks and files, and join small ones.
    """
    rows = with_bucket(df, key, n).hint("rebalance", "bucket")
    rows.write.mode(mode).partitionBy("bucket").parquet(path)


def rebuild_partitions(df: DataFrame, path: str, by: str = "bucket", skip_present: bool = True) -> None:
    """Write ``df`` partitioned by ``by``, so that running it again is harmless.

    With ``skip_present`` only the partitions that ``path`` lacks are written;
    otherwise the partitions in ``df`` are replaced and all others left alone.
    Directories appear at the final commit of the job, so one that is present is whole.
    """
    if skip_present:
        present = _present(df.sparkSession, path, by)
        df = df.filter(~F.coalesce(F.col(by).cast("string"), F.lit(_NULL_PARTITION)).isin(present)) if present else df
    (
        df.hint("rebalance", by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(by)
        .parquet(path)
    )


# The directory of the rows whose partition value is NULL.
_NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def _present(spark, path, by):
    """The values of ``by`` that have a directory under ``path``."""
    return [_NULL_PARTITION if v is None else v for v in partition_folders(spark, path, by)]


def partition_folders(spark: SparkSession, path: str, by: str) -> dict[str | None, str]:
    """The values of ``by`` as text, with the name of the directory of each under ``path``; listed, not read."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where):
        return {}
    names = [s.getPath().getName() for s in system.listStatus(where) if s.isDirectory()]
    unescape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    values = {n: unescape(n.split("=", 1)[1]) for n in names if n.startswith(f"{by}=")}
    return {None if v == _NULL_PARTITION else v: n for n, v in values.items()}
