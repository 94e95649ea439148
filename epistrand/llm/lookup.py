"""Joins of many rows to one row per key, where a key may have a third of the rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A table is broadcast only if it has been measured to be smaller.
BROADCAST_BYTES = 8_000_000
SALTS = 64


def measured_bytes(table: DataFrame) -> int:
    """About how many bytes the rows of a table take, from its text and binary columns and 16 per other column."""
    sizes = [
        F.coalesce(F.octet_length(c), F.lit(0)) + 32 if t in ("string", "binary") else F.lit(16)
        for c, t in table.dtypes
    ]
    return table.agg(F.coalesce(F.sum(sum(sizes[1:], sizes[0])), F.lit(0))).first()[0]


def join_per_key(
    rows: DataFrame, table: DataFrame, key: str, salt: str | None = None, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Inner join in which NULL keys match. ``table`` has one row per key and is stored, so measuring it is cheap.

    Beyond ``max_bytes`` it is not broadcast. If a column ``salt`` is given, the rows of every
    key are then spread over salts drawn from it, and each row of the table is repeated per salt.
    """
    filled = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("null"))
    left, right = rows.withColumn("_key", filled), table.withColumn("_key", filled).drop(key)
    if measured_bytes(table) <= max_bytes:
        return left.join(F.broadcast(right), "_key").drop("_key")
    if salt is None:
        return left.join(right, "_key").drop("_key")
    left = left.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, ["_key", "_salt"]).drop("_key", "_salt")
