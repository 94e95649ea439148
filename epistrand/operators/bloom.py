"""A Bloom filter of ids as one value of the plan, to leave rows out before they are shuffled.

Bits are set per task and merged by OR, so an id may repeat and no task sees all ids. The
filter is a scalar subquery: an array of 64-bit words, twelve bits per id and at most
``MAX_WORDS`` words. It never loses a row; those it keeps without need go with the exact join
that follows. With more ids than fit, it keeps more of them.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epistrand.functions.arrays import bind

MAX_WORDS = 1_000_000
BITS_PER_ID = 12
HASHES = 6


def _places(key: Column, words: Column) -> list[Column]:
    """The bits of a key in a filter of some words."""
    bits = words.cast("long") * 64
    return [F.pmod(F.xxhash64(key, F.lit(n)), bits) for n in range(HASHES)]


def id_filter(ids: DataFrame, key: str) -> Column:
    """The filter of the ids in a column, as a scalar; NULL ids are left out. No ids give a filter that keeps nothing."""
    known = ids.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"))
    wanted = F.ceil(F.count("*") * BITS_PER_ID / 64)
    size = known.agg(F.greatest(F.least(wanted, F.lit(MAX_WORDS)), F.lit(1)).cast("int").alias("_words"))
    place = F.explode(F.array(*_places(F.col("_key"), size.scalar())))
    bits = known.select(place.alias("_bit")).select(
        F.floor(F.col("_bit") / 64).cast("int").alias("_word"),
        F.expr("shiftleft(1L, cast(_bit % 64 as int))").alias("_set"),
    )
    merged = bits.groupBy("_word").agg(F.bit_or("_set").alias("_set"))
    every = size.select(F.explode(F.sequence(F.lit(0), F.col("_words") - 1)).alias("_word"))
    dense = every.join(merged, "_word", "left").select("_word", F.coalesce("_set", F.lit(0).cast("long")).alias("_set"))
    words = dense.agg(F.sort_array(F.collect_list(F.struct("_word", "_set"))).alias("_all"))
    return words.select(F.col("_all._set").alias("_filter")).scalar()


def prefilter(rows: DataFrame, key: str, ids: DataFrame, id_column: str) -> DataFrame:
    """The rows whose key may be among the ids: all that are, and less than one in a hundred of the others."""

    def kept(words):
        set_ = [
            F.get(words, F.floor(p / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(p, F.lit(64)).cast("int"))) != 0
            for p in _places(F.col(key), F.size(words))
        ]
        found = set_[0]
        for s in set_[1:]:
            found = found & s
        return found

    # Named once, so that Spark merges the projection and no row carries the filter.
    held = rows.filter(F.col(key).isNotNull()).select("*", id_filter(ids, id_column).alias("_filter"))
    return held.filter(bind(F.col("_filter"), kept)).select(*rows.columns)
