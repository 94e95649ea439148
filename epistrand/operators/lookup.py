"""Small tables as one value of the plan, so that tokens in arrays are looked up where they are.

A join would have to explode the arrays, and collect them again by a shuffle. A table that is
small enough to be broadcast is instead computed once, by a scalar subquery, as an array of
buckets; a token's hash gives its bucket, which holds about one key.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epistrand.functions.arrays import bind
from epistrand.functions.scalars import bucket_of


def lookup_value(table: DataFrame, key: str = "token", value: str = "idx") -> Column:
    """A table with distinct keys as a scalar: an array of maps, as long as the table. Rows with a NULL key are left out.

    Lambdas cannot hold a subquery: select it as a column, and name that column once, in the
    next projection, by ``bind``. Spark then merges the two, and no row carries the table.
    """
    count = table.agg(F.greatest(F.count("*"), F.lit(1)).cast("int").alias("_n"))
    entry = F.struct(F.col(key).alias("k"), F.col(value).alias("v"))
    held = table.filter(F.col(key).isNotNull()).select(bucket_of(F.col(key), count.scalar()).alias("_bucket"), entry.alias("_entry"))
    held = held.groupBy("_bucket").agg(F.collect_list("_entry").alias("_entries"))
    every = count.select(F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_bucket"))
    dense = every.join(held, "_bucket", "left").agg(F.sort_array(F.collect_list(F.struct("_bucket", "_entries"))).alias("_all"))
    empty = F.array().cast(held.schema["_entries"].dataType)
    maps = F.transform("_all", lambda b: F.map_from_entries(F.coalesce(b["_entries"], empty)))
    return dense.select(maps.alias("_table")).scalar()


def find(table: Column, key: Column) -> Column:
    """The value of a key, or NULL. ``table`` is a bound :func:`lookup_value`."""
    return F.try_element_at(F.get(table, bucket_of(key, F.size(table))), key)


def look_up_all(rows: DataFrame, column: str, table: DataFrame, out: str, settle=None) -> DataFrame:
    """Add ``out``: the ids of an array of tokens, NULL for those that the table does not have.

    ``settle(token, id)``, if given, says what becomes of each.
    """
    settle = settle or (lambda token, idx: idx)
    ids = bind(F.col("_held"), lambda held: F.transform(column, lambda t: settle(t, find(held, t))))
    others = [c for c in rows.columns if c != out]
    found = rows.select("*", lookup_value(table).alias("_held")).select(*others, ids.alias(out))
    return found.select(*rows.columns) if out in rows.columns else found
