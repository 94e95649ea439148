"""What several test modules use."""


def rows(df):
    """All rows as sorted tuples; NULL sorts first."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is not None, str(v)) for v in r))


def shuffle_files(spark):
    """The names of the shuffle files that lie on this machine's disk."""
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (held.apply(i).getName() for i in range(held.size())) if name.startswith("shuffle_")}
