"""Token and age vocabularies as tables ``token, idx``."""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from epistrand.operators.skew import number_rows
from epistrand.schemas import PAD, SPECIAL_TOKENS, UNK
from epistrand.sources.store import local_table


def _symbols(spark, symbols):
    return local_table(
        spark, token=pa.array(symbols, pa.string()), idx=pa.array(range(len(symbols)), pa.int32())
    )


def build_vocab(rows: DataFrame, column: str = "code") -> DataFrame:
    """Vocabulary of a column of tokens or of token arrays.

    PAD, UNK, CLS, SEP, MASK are 0 to 4, then come all others in alphabetical order. Tokens
    are made distinct map-side and numbered by ranges that come from the data.
    """
    is_array = isinstance(rows.schema[column].dataType, ArrayType)
    tokens = rows.select((F.explode(column) if is_array else F.col(column)).alias("token")).distinct()
    others = tokens.filter(F.col("token").isNotNull() & ~F.col("token").isin(SPECIAL_TOKENS))
    numbered = number_rows(others, [], ["token"], "_before")
    ids = numbered.select("token", (F.col("_before") + len(SPECIAL_TOKENS)).cast("int").alias("idx"))
    return _symbols(rows.sparkSession, SPECIAL_TOKENS).unionByName(ids)


def invert_vocab(vocab: DataFrame) -> DataFrame:
    """``idx, token``."""
    return vocab.select("idx", "token")


def age_vocab(spark: SparkSession, max_age: int, mon: int = 1, symbol: list | None = None) -> DataFrame:
    """Age vocabulary: the symbols, then ``'0', '1', ...``.

    ``mon=12`` counts years below ``max_age``, ``mon=1`` months below ``max_age * 12``.
    """
    symbols = [PAD, UNK] if symbol is None else [str(s) for s in symbol]
    if mon not in (1, 12):
        raise ValueError("mon must be 1 or 12")
    count = max_age if mon == 12 else max_age * 12
    numbers = spark.range(count).select(
        F.col("id").cast("string").alias("token"), (F.col("id") + len(symbols)).cast("int").alias("idx")
    )
    return _symbols(spark, symbols).unionByName(numbers)
