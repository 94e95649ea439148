"""Joins and running totals that hold up when one key has a large share of the rows."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epistrand.sources.store import materialize

# A lookup table is broadcast only if Spark's statistics say that it has at most this many bytes.
BROADCAST_BYTES = 8_000_000

# Rows of one key that may go to one task. Keys with more are spread over as many salts as
# they have such shares; the share grows with the table, so that there are at most MAX_HOT.
TASK_ROWS = 1_000_000
MAX_HOT = 10_000
# Keys in the summary of a task, and what a count may be too low by as a part of all rows.
COUNTERS = 4 * MAX_HOT


def fits_in_broadcast(lookup: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the table is small by the statistics of its plan, which start from file sizes. Runs nothing.

    A table made by joins is taken to be large; ``materialize`` it first if it is small.
    """
    return int(lookup._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= max_bytes


def hot_keys(rows: DataFrame, key: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """The keys with more rows than a task should get, and the salts to spread each over: ``key, _salts``.

    One scan of the key column, without grouping by it: every task keeps a summary of at most
    ``COUNTERS`` keys (Misra and Gries), and summaries add up. No count is too high, and none
    is too low by more than a ``COUNTERS``-th of all rows, which is at most a quarter of the
    share of a task. So every key above the share is found; a key just below it may be, too.
    """
    narrow = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"))
    found = narrow.mapInArrow(_summarize, f"_key {narrow.schema['_key'].dataType.simpleString()}, _n long")
    # The row without a key has the number of rows of a task.
    summed = materialize(found.groupBy("_key").agg(F.sum("_n").alias("_n")))
    total = F.coalesce(summed.filter(F.col("_key").isNull()).agg(F.max("_n")).scalar(), F.lit(0))
    counts = summed.filter(F.col("_key").isNotNull()).withColumn("_all", total)
    share = F.greatest(F.col("_all") / F.lit(MAX_HOT), F.lit(float(task_rows)))
    most = F.col("_n") + F.floor(F.col("_all") / F.lit(COUNTERS))
    hot = counts.filter(most > share).select(F.col("_key").alias(key), F.ceil(most / share).cast("int").alias("_salts"))
    return materialize(hot)


def _summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of at most ``COUNTERS`` keys of a task, and under NULL the number of its rows."""
    held, total, kind = None, 0, None
    for batch in batches:
        column = batch["_key"]
        total, kind = total + len(column), column.type
        counted = column.value_counts()
        held = pa.concat_tables([held, _counts(counted)]) if held is not None else _counts(counted)
        if len(held) > 4 * COUNTERS:
            held = _most(held)
    if held is not None:
        held = _most(held)
        yield from held.select(["_key", "_n"]).to_batches()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.array([total], pa.int64())], ["_key", "_n"])


def _counts(counted):
    return pa.table({"_key": counted.field("values"), "_n": counted.field("counts").cast(pa.int64())})


def _most(held):
    """Add up equal keys; if there are too many, take from all what the first one too many has."""
    summed = held.group_by("_key").aggregate([("_n", "sum")]).rename_columns(["_key", "_n"])
    if len(summed) <= COUNTERS:
        return summed
    less = int(np.partition(summed["_n"].to_numpy(), len(summed) - COUNTERS - 1)[len(summed) - COUNTERS - 1])
    left = summed.set_column(1, "_n", pc.subtract(summed["_n"], less))
    return left.filter(pc.greater(left["_n"], 0))


def salted_join(rows: DataFrame, lookup: DataFrame, key: str, how: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """Shuffle join in which the rows of a hot key are spread over several tasks.

    The lookup row of a hot key is repeated once per salt, so each row still meets it
    exactly once. Only the list of hot keys is broadcast, of which there are at most
    ``MAX_HOT``. Rows without a key match nothing and are not shuffled.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    hot = F.broadcast(hot_keys(rows, key, task_rows))
    # Equal rows from different input partitions get different salts, the same ones when a lost task is run again.
    spread = F.pmod(F.xxhash64(*rows.columns, F.spark_partition_id()), F.col("_salts"))
    keyed = rows.filter(F.col(key).isNotNull()).join(hot, key, "left")
    left = keyed.withColumn("_salt", F.coalesce(spread, F.lit(0)).cast("int")).drop("_salts")
    salts = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    right = lookup.join(hot, key, "left").withColumn("_salt", F.explode(salts)).drop("_salts")
    joined = left.join(right, [key, "_salt"], how).drop("_salt")
    if how == "inner":
        return joined
    return joined.unionByName(rows.filter(F.col(key).isNull()), allowMissingColumns=True)


def lookup_join(
    rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner", max_bytes: int = BROADCAST_BYTES,
    bound: DataFrame | None = None,
) -> DataFrame:
    """Join many rows to a table that is unique on ``key``.

    A small lookup table is broadcast, so that ``rows`` are not shuffled at all; a larger
    one goes through :func:`salted_join`. ``bound`` is a table with at least as many bytes
    whose size is known, such as the stored one that ``lookup`` is made from. If that is large,
    ``lookup`` may still be small: it is stored, and its own size decides.
    """
    small = fits_in_broadcast(lookup if bound is None else bound, max_bytes)
    if not small and bound is not None:
        lookup = materialize(lookup)
        small = fits_in_broadcast(lookup, max_bytes)
    if small:
        return rows.join(F.broadcast(lookup), key, how)
    return salted_join(rows, lookup, key, how)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which NULL keys match each other; the keys come out once."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    match = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, match, how).drop(*[f"_right_{k}" for k in keys])


def running_before(
    df: DataFrame, group: list[str], levels: list[str], order: list[Column], value: Column, out: str
) -> DataFrame:
    """Add to each row the sum of ``value`` over the rows before it in its group.

    The order is by ``levels`` first and then by ``order``, and must be total. A window
    over a whole group would run in one task; here each window covers one combination
    of the levels, and totals per level say what came before it. NULL is a value like
    any other in groups and levels.
    """
    rows = df.withColumn("_v", value)
    totals = rows.groupBy(*group, *levels).agg(F.sum("_v").alias("_v"))
    bases = totals
    for depth in range(len(levels), 0, -1):
        at = group + levels[:depth]
        here = totals.groupBy(*at).agg(F.sum("_v").alias("_t")) if depth < len(levels) else (
            totals.withColumnRenamed("_v", "_t")
        )
        window = (
            Window.partitionBy(*group, *levels[: depth - 1])
            .orderBy(levels[depth - 1])
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        before = here.select(*at, F.coalesce(F.sum("_t").over(window), F.lit(0)).alias(f"_b{depth}"))
        bases = before if depth == len(levels) else null_safe_join(bases, before, at)
    base = sum((F.col(f"_b{d}") for d in range(1, len(levels) + 1)), F.lit(0))
    bases = bases.select(*group, *levels, base.alias("_base"))
    window = (
        Window.partitionBy(*group, *levels).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = F.coalesce(F.sum("_v").over(window), F.lit(0))
    return (
        null_safe_join(rows.withColumn("_inside", inside), bases, group + levels)
        .withColumn(out, F.col("_base") + F.col("_inside"))
        .drop("_v", "_base", "_inside")
    )


def number_rows(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Number the rows of each group from 0 in the order of columns that identify a row.

    The ranges that the rows are cut into come from the data: they are sorted across all
    tasks and stored, and each task's rows are numbered after those of the tasks before it.
    """
    dealt = materialize(df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()))
    return running_before(dealt, group, ["_range"], [F.col(c) for c in order], F.lit(1), out).drop("_range")
