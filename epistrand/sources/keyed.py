"""Tables stored by key, so that joins on the key leave the wide side where it is."""

import uuid

from pyspark.sql import DataFrame

from epistrand.sources.store import checkpoint_folder

BUCKETS = 200


def store_by_key(df: DataFrame, key: str, buckets: int = BUCKETS, dealt: bool = False) -> DataFrame:
    """Write ``df`` as a table in ``buckets`` hash buckets of ``key``, each sorted by it, and read it back.

    A join or grouping by the key then shuffles only the other side. ``dealt`` says that the
    rows are already hash partitioned by the key into as many partitions or a multiple of
    that, and are not shuffled for storing either; a bucket has a file for each of its partitions. The table lies in the checkpoint folder under a name of its
    own; :func:`drop_stored` removes it.
    """
    spark = df.sparkSession
    name = f"keyed_{uuid.uuid4().hex}"
    rows = df if dealt else df.repartition(buckets, key)
    writer = rows.write.format("parquet").bucketBy(buckets, key).sortBy(key)
    writer.option("path", f"{checkpoint_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def drop_stored(df: DataFrame) -> None:
    """Remove a table that :func:`store_by_key` returned, and its files."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        name = folder.rsplit("/", 1)[1]
        if name.startswith("keyed_"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
