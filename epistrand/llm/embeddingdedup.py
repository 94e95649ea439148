"""Embedding near-deduplication with an index of pivot permutations.

Each vector is described by the reference vectors (pivots) nearest to it, in order. Vectors
near each other name mostly the same. An inverted list per pivot holds the vectors that name
it; two vectors of a list are candidates if they share enough pivots or have the nearest one
in common, and are verified by their cosine.

No two pivots lie near each other, so a dense group holds few of them: its members have the
same nearest pivot and are candidates whatever order noise gives to the others.
"""

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from epistrand.llm.components import components
from epistrand.llm.vectors import dimension, matrix, stored_vectors, unit
from epistrand.sources import materialize

LEAST = 0.9
NEAREST = 16  # pivots that describe a vector
SHARED = 2  # pivots that candidates have in common
APART = 0.7  # cosine that two pivots stay below
MAX_PIVOTS = 16_384
BLOCK_ROWS = 4096
TILE = 1 << 20  # cosines held at a time


def spread(pivots: np.ndarray, apart: float) -> np.ndarray:
    """The pivots without those whose cosine with an earlier one reaches ``apart``."""
    free = np.ones(len(pivots), bool)
    for i in range(len(pivots)):
        if free[i]:
            free[i + 1 :] &= pivots[i + 1 :] @ pivots[i] < apart
    return pivots[free]


def _describe(batches: Iterator[pa.RecordBatch], pivots, dim: int, nearest: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Each vector with the numbers of its nearest pivots, nearest first, as a list and as 16-bit numbers."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = unit(matrix(batch["vec"], dim))
        order = []
        for part in range(0, len(x), 1000):
            order.append(np.argsort(-(x[part : part + 1000] @ pivots.value.T), axis=1, kind="stable")[:, :nearest])
        named = np.concatenate(order).astype("<u2")
        vecs = [np.frombuffer(v, "<f8").astype(kind).tobytes() for v in batch["vec"].to_pylist()]
        columns = {
            "vec": pa.array(vecs, pa.binary()),
            "rep": batch["rep"],
            "n": batch["n"],
            "pivots": pa.array(named.tolist(), pa.list_(pa.int32())),
            "named": pa.array([row.tobytes() for row in named], pa.binary()),
        }
        yield pa.RecordBatch.from_pydict(columns)


LINKS = "a long, b long, n long"


def _candidates(named: np.ndarray, right: np.ndarray, pivot: int, shared: int):
    """For a row, which rows of ``right`` this pivot's list holds as its candidates.

    Pairs that also meet in the list of a smaller pivot are left to that list.
    """
    nearest = named[right, 0]
    kinds, places = np.unique(named, return_inverse=True)
    places = np.sort(places.reshape(named.shape), axis=1)
    smaller = (places < np.searchsorted(kinds, pivot)).sum(axis=1)
    holds = np.zeros((len(kinds), len(right)), np.uint8)
    holds[places[right], np.arange(len(right))[:, None]] = 1

    def of(row: int) -> np.ndarray:
        both = holds[places[row]]
        found = (both.sum(axis=0, dtype=np.uint8) >= shared) | (nearest == named[row, 0])
        return found & ~both[: smaller[row]].any(axis=0)

    return of


def _links(rows: pd.DataFrame, dim: int, least: float, shared: int, kind: str) -> pd.DataFrame:
    """Links between two blocks of a pivot's list, or within one.

    Rows without ``b`` say how many vectors ``a`` is linked with; the others join all that
    are linked, at most one per vector.
    """
    pivot, low, high = (int(rows[c].iloc[0]) for c in ("pivot", "low", "high"))
    # Equal vectors in the order of their ids, so that links lead to the smallest.
    rows = rows.sort_values("rep")
    block = rows["block"].to_numpy()
    x = unit(matrix(rows["vec"], dim, kind))
    named = np.frombuffer(b"".join(rows["named"]), "<u2").reshape(len(rows), -1)
    weight, ids = rows["n"].to_numpy(), rows["rep"].to_numpy()
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    there = np.ascontiguousarray(x[right].T)
    candidates = _candidates(named, right, pivot, shared)
    count = np.zeros(len(rows))  # whole numbers far below 2 ** 53
    label = np.arange(len(rows))
    step = max(1, TILE // max(1, len(right)))
    for part in range(0, len(left), step):
        at = left[part : part + step]
        if not len(right):
            break
        near = np.array([candidates(row) for row in at])
        if low == high:
            near &= at[:, None] < right[None, :]
        if not near.any():
            continue
        near &= x[at] @ there >= least
        if not near.any():
            continue
        linked = near.astype(np.float64)
        count[at] += linked @ weight[right]
        count[right] += weight[at] @ linked
        i, j = np.nonzero(near & (label[at][:, None] != label[right][None, :]))
        i, j = at[i], right[j]
        while len(i):
            # Labels are roots here: the larger root goes under the smallest that it meets.
            one, two = label[i], label[j]
            np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
            while (label != label[label]).any():
                label = label[label]
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
    linked = np.flatnonzero(count)
    joined = np.flatnonzero(label != np.arange(len(rows)))
    return pd.DataFrame(
        {
            "a": np.concatenate((ids[linked], ids[joined])),
            "b": pd.array([None] * len(linked) + ids[label[joined]].tolist(), dtype="Int64"),
            "n": np.concatenate((count[linked].astype(np.int64), np.zeros(len(joined), np.int64))),
        }
    )


def pivot_sample(vectors: DataFrame, n: int, dim: int) -> np.ndarray:
    """At most ``n`` vectors, those with the smallest md5 of their id."""
    rows = vectors.orderBy(F.md5(F.col("rep").cast("string")), "rep").limit(n).select("vec").toArrow()
    return unit(matrix(rows["vec"], dim))


def near_duplicates(
    embeddings: DataFrame, least: float = LEAST, nearest: int = NEAREST, shared: int = SHARED, apart: float = APART
) -> DataFrame:
    """Links by cosine: vec_id, n_links, component_id, kept; one row per row of ``embeddings``.

    n_links is the number of other vectors found with a cosine of at least ``least``,
    component_id the smallest vec_id reached by links, and ``kept`` marks the vector with this
    id. Vectors that cannot be compared (see :func:`vectors.stored_vectors`) have no links. ids
    should be unique; a row with a NULL vec_id has no links and is kept.

    Equal vectors go through the index as one with their number. The pivots are a sample of
    the vectors, 4 for each root of their number and at most ``MAX_PIVOTS``, without those
    that are not ``apart``; every vector is indexed. Of two vectors at a cosine of 0.9 in 64
    dimensions, fewer than 1 pair in 1,000 shares fewer than 2 of the 16 pivots. A pivot's
    list is dealt into blocks of bounded size, and all pairs of its blocks are compared.
    """
    kind = "<f4" if isinstance(embeddings.schema["embedding"].dataType.elementType, FloatType) else "<f8"
    vectors = materialize(stored_vectors(embeddings))
    dim = dimension(vectors)
    classes = materialize(vectors.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    distinct = classes.count()
    sample = spread(pivot_sample(classes, max(32, min(MAX_PIVOTS, int(4 * distinct**0.5))), dim), apart)
    pivots = vectors.sparkSession.sparkContext.broadcast(sample)
    run = functools.partial(_describe, pivots=pivots, dim=dim, nearest=nearest, kind=kind)
    described = materialize(classes.mapInArrow(run, "vec binary, rep long, n long, pivots array<int>, named binary"))
    listed = described.select("rep", "n", "vec", "named", F.explode("pivots").alias("pivot"))
    # One row per pivot, of which there are at most MAX_PIVOTS.
    blocks = F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("_blocks")
    sizes = described.select(F.explode("pivots").alias("pivot")).groupBy("pivot").agg(blocks)
    own = F.pmod(F.xxhash64("rep"), F.col("_blocks")).cast("int")
    dealt = listed.join(F.broadcast(sizes), "pivot").withColumn("block", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    low, high = F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    dealt = dealt.select("pivot", low, high, "block", "rep", "n", "vec", "named")
    run = functools.partial(_links, dim=dim, least=least, shared=min(shared, max(len(sample), 1)), kind=kind)
    found = materialize(dealt.groupBy("pivot", "low", "high").applyInPandas(lambda rows: run(rows), LINKS))
    counts = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("_links"))
    members = vectors.join(classes, "vec").select("vec_id", "rep", "n")
    joined = components(found.filter("b is not null").select("a", "b"))
    result = (
        members.join(counts, "rep", "left")
        .join(joined, F.col("rep") == F.col("node"), "left")
        .select(
            F.col("vec_id").alias("_id"),
            (F.col("n") - 1 + F.coalesce("_links", F.lit(0))).alias("_n"),
            F.coalesce("component", "rep").alias("_component"),
        )
    )
    every = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"))
    return (
        every.join(result, F.col("vec_id") == F.col("_id"), "left")
        .select(
            "vec_id",
            F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("_component", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
