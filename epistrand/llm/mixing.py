"""Mixing sources to target weights."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epistrand.functions.scalars import hashed_uniform
from epistrand.llm.lookup import join_per_key
from epistrand.sources import materialize

SPACE = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of characters that are not ASCII white space; 0 for NULL."""
    return F.coalesce(F.size(F.filter(F.split(text, SPACE), lambda w: w != "")), F.lit(0)).cast("long")


def source_rates(
    sizes: DataFrame, share: float = 1.5, weights: Sequence[float] = (5, 2, 1), most: float = 2.0
) -> DataFrame:
    """The tokens wanted from each source, and how often a document of it is repeated.

    ``sizes`` has ``source`` and ``size``, one row per document. Sources in the order of their
    code points, NULL last, take the weights in turn. Together they get ``share`` times all
    sizes, but none more than ``most`` times its own; what is above that goes to the others
    by weight, until none is above.

    The source that reaches its bound first has the smallest bound per weight. So with sources
    in that order, the common tokens per weight are those of the first source that stays below
    its bound when all before it are at theirs. A source without tokens gets rate 0.
    Windows here are over sources, not documents.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    totals = totals.withColumn("_at", place).withColumn(
        "_weight", F.element_at(cycle, (F.pmod("_at", F.lit(len(weights))) + 1).cast("int"))
    )
    every = Window.partitionBy(F.lit(0))
    by_bound = every.orderBy(F.lit(most) * F.col("source_size") / F.col("_weight"), "_at")
    before = F.coalesce(F.sum("source_size").over(by_bound.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("_weight").over(by_bound.rowsBetween(0, Window.unboundedFollowing))
    level = (F.lit(share) * F.sum("source_size").over(every) - F.lit(most) * before) / after
    below = F.col("_level") * F.col("_weight") <= F.lit(most) * F.col("source_size")
    bound = F.lit(most) * F.col("source_size")
    target = F.least(F.col("_common") * F.col("_weight"), bound)
    return (
        totals.withColumn("_level", level)
        .withColumn("_rank", F.row_number().over(by_bound))
        .withColumn("_common", F.min(F.when(below, F.struct("_rank", "_level"))).over(every)["_level"])
        .withColumn("target", F.coalesce(target, bound).cast("double"))
        .withColumn("rate", F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)))
        .select("source", "source_size", "target", "rate")
    )


def copies(rate: Column, key: Column, seed: int) -> Column:
    """The whole part of the rate, and one more where the draw of the key is below its fraction."""
    whole = F.floor(rate)
    draw = hashed_uniform(F.lit(f"mix{seed}"), F.coalesce(key.cast("string"), F.lit("null")))
    return whole + (draw < rate - whole).cast("long")


def mix_counts(docs: DataFrame, seed: int = 1, **options) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies, taken.

    One row per row of ``docs``, which needs doc_id, text and source. NULL and empty texts
    have size 0; a NULL source is a source of its own. Rows of one doc_id get the same draw,
    also in another run.
    """
    sizes = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    rates = materialize(source_rates(sizes, **options))
    return (
        join_per_key(sizes, rates, "source", salt="doc_id")
        .withColumn("copies", copies(F.col("rate"), F.col("doc_id"), seed))
        .withColumn("taken", F.col("size") * F.col("copies"))
    )


def mix_documents(docs: DataFrame, seed: int = 1, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns."""
    sizes = docs.select("source", word_count(F.col("text")).alias("size"))
    rates = materialize(source_rates(sizes, **options)).select("source", "rate")
    held = docs.select("doc_id", "source", F.struct("*").alias("doc"))
    counted = join_per_key(held, rates, "source", salt="doc_id").withColumn(
        "copies", copies(F.col("rate"), F.col("doc_id"), seed)
    )
    return (
        counted.filter(F.col("copies") > 0)
        .select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
        .select("doc.*")
    )
