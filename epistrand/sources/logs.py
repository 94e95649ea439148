"""Training logs: tab-separated text that only grows."""

from pyspark.sql import DataFrame, SparkSession

from epistrand.schemas import STEP_LOG


def append_log(df: DataFrame, path: str) -> None:
    """Add rows to a log."""
    df.select(*STEP_LOG.names).write.mode("append").option("sep", "\t").option("header", True).csv(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STEP_LOG).option("sep", "\t").option("header", True).csv(path)
