"""Intermediate tables that several later steps read."""

import contextlib
import contextvars
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


FILE_ROWS = 1 << 17


def local_table(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    """A few fixed rows as part of the plan itself."""
    return spark.createDataFrame(pa.table(columns))


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once: write it as Parquet to the checkpoint folder and read it back.

    Later steps read only the columns they need, and lose nothing when an executor is lost.
    The folder is the one named by ``spark.checkpoint.dir``, which executors must share;
    without it this is an error. :func:`release` removes the table.

    Narrow rows may take a few bytes each, so that a split of the usual size would hold tens of
    millions of them and a task that groups them more than its memory. Files end after
    ``FILE_ROWS``, and as Spark counts each file it opens as some megabytes more, a split then
    holds a few million at most, whatever the size of the table.

    Spark keeps the shuffle files of a job until the driver happens to collect its garbage, which
    it need not do while disks fill. The table is all that is left of this job, so they go with it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{_TABLE}-{uuid.uuid4()}.parquet"
    with _shuffles_removed(spark):
        df.write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    if (held := _HELD.get()) is not None:
        held.append(table)
    return table


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Remove the shuffle files of each write inside as soon as it ends or fails."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_TABLE = "materialized"
# The tables of the innermost scope, if there is one.
_HELD: contextvars.ContextVar[list | None] = contextvars.ContextVar("held", default=None)


@contextlib.contextmanager
def scoped_tables() -> Iterator[list[DataFrame]]:
    """Release all tables that are materialized inside, also when the work inside fails.

    Results that still depend on them must be written before the scope ends. Scopes may be
    nested; a table belongs to the innermost one. Yields the list of tables; one that is taken
    off the list stays.
    """
    held: list[DataFrame] = []
    token = _HELD.set(held)
    try:
        yield held
    finally:
        _HELD.reset(token)
        for table in held:
            release(table)


def release(df: DataFrame) -> None:
    """Remove the table that ``materialize`` returned. Plans that still read it fail afterwards."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if folder.rsplit("/", 1)[1].startswith(f"{_TABLE}-"):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one named by ``spark.checkpoint.dir``."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return folder


def name_relation(df: DataFrame, name: str) -> DataFrame:
    """Make ``df`` known to SQL under ``name`` and return it."""
    df.createOrReplaceTempView(name)
    return df
