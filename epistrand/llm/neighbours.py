"""Approximate nearest neighbours by cross-polytope hashing."""

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epistrand.llm.vectors import dimension, matrix, stored_vectors, unit
from epistrand.sources import materialize

TABLES = 16
PROBES = 256
LEADING = 32  # axes of each of the two hashes that probes combine
BLOCK_ROWS = 50_000
SEED = 20240601


def rotations(dim: int, tables: int = TABLES, seed: int = SEED) -> np.ndarray:
    """Random signs for three rounds of each of the two pseudo-rotations of every table."""
    size = 1 << max(0, dim - 1).bit_length()
    return np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 2, 3, size))


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of random signs and a Walsh-Hadamard transform, which takes n log n steps."""
    size = signs.shape[-1]
    y = np.zeros((len(x), size))
    y[:, : x.shape[1]] = x
    for sign in signs:
        y *= sign
        half = 1
        while half < size:
            pair = y.reshape(len(x), -1, 2, half)
            a, b = pair[:, :, 0].copy(), pair[:, :, 1].copy()
            pair[:, :, 0], pair[:, :, 1] = a + b, a - b
            half *= 2
        y /= np.sqrt(size)
    return y


def _sides(y: np.ndarray) -> np.ndarray:
    """The coordinates along all signed axes."""
    return np.concatenate((y, -y), axis=1)


def probes(first: np.ndarray, second: np.ndarray, n: int = PROBES, leading: int = LEADING) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query, the pairs of signed axes with the largest sums of its coordinates along them."""
    leading = min(leading, first.shape[1])
    a = np.argsort(-first, axis=1, kind="stable")[:, :leading]
    b = np.argsort(-second, axis=1, kind="stable")[:, :leading]
    sums = np.take_along_axis(first, a, 1)[:, :, None] + np.take_along_axis(second, b, 1)[:, None, :]
    best = np.argsort(-sums.reshape(len(first), -1), axis=1, kind="stable")[:, :n]
    return [(a[i, k // leading], b[i, k % leading]) for i, k in enumerate(best)]


def _index(batches: Iterator[pa.RecordBatch], signs, dim, with_vectors) -> Iterator[pa.RecordBatch]:
    """The bucket of each vector in each table: the nearest signed axis of two rotations."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = unit(matrix(batch["vec"], dim))
        for t, (one, two) in enumerate(signs):
            a, b = (_sides(rotate(x, s)).argmax(1) for s in (one, two))
            columns = [pa.array(np.full(len(x), t, np.int32)), pa.array(a.astype(np.int32))]
            names = ["table", "axis"]
            if with_vectors:
                columns += [pa.array(b.astype(np.int32)), batch["vec_id"], batch["vec"]]
                names += ["second", "vec_id", "vec"]
            yield pa.RecordBatch.from_arrays(columns, names)


def _ask(batches: Iterator[pa.RecordBatch], signs, dim, n) -> Iterator[pa.RecordBatch]:
    """The buckets that each query looks into, by their first axis."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = unit(matrix(batch["vec"], dim))
        for t, (one, two) in enumerate(signs):
            found = probes(_sides(rotate(x, one)), _sides(rotate(x, two)), n)
            rows = [(i, a, bs[as_ == a]) for i, (as_, bs) in enumerate(found) for a in np.unique(as_)]
            at = pa.array([r[0] for r in rows])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(rows), t, np.int32)),
                    pa.array([int(r[1]) for r in rows], pa.int32()),
                    pa.array([r[2].astype("<i4").tobytes() for r in rows], pa.binary()),
                    batch["vec_id"].take(at),
                    batch["vec"].take(at),
                ],
                ["table", "axis", "seconds", "query_id", "vec"],
            )


FOUND = "query_id long, vec_id long, score double"


def _nearest(queries: pd.DataFrame, rows: pd.DataFrame, dim: int, k: int, axes: int) -> pd.DataFrame:
    """The k best candidates of each query in one part of the index, reranked by the exact cosine."""
    out: list[tuple] = []
    if len(queries) and len(rows):
        ids, x = rows["vec_id"].to_numpy(), unit(matrix(rows["vec"], dim))
        second = rows["second"].to_numpy() if axes else None
        for query, data, seconds in zip(queries["query_id"], unit(matrix(queries["vec"], dim)), queries.get("seconds", queries["vec"])):
            fits = ids != query
            if axes:
                wanted = np.zeros(axes, bool)
                wanted[np.frombuffer(seconds, "<i4")] = True
                fits &= wanted[second]
            at = np.flatnonzero(fits)
            # Sums of products row by row, so that equal vectors get equal scores everywhere.
            score = (x[at] * data).sum(axis=1)
            if len(at) > 4 * k:
                near = score >= np.partition(score, len(at) - k)[len(at) - k]
                at, score = at[near], score[near]
            best = np.lexsort((ids[at], -score))[:k]
            out += zip([query] * len(best), ids[at[best]].tolist(), score[best].tolist())
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype(
        {"query_id": "int64", "vec_id": "int64", "score": "float64"}
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    distinct = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = distinct.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, tables: int = TABLES, n_probes: int = PROBES) -> DataFrame:
    """The k vectors with the largest cosine that the index finds: query_id, rank, vec_id, score.

    Both tables have vec_id and vec as :func:`vectors.stored_vectors` makes them; ids should be unique,
    and a query's own id is no candidate. Each table of the index has two pseudo-rotations;
    a vector's bucket is the pair of signed axes nearest to it. A query looks into the
    ``n_probes`` buckets per table for which the sum of its own coordinates is largest.
    Candidates are reranked by the exact cosine; ties go to the smaller vec_id. An index
    part with more than ``BLOCK_ROWS`` rows is dealt over several tasks. A query that finds
    fewer than k candidates, as in a small table, is compared with all vectors in blocks.
    """
    dim = dimension(vectors)
    signs = rotations(dim, tables)
    axes = 2 * signs.shape[-1]
    parts = vectors.mapInArrow(functools.partial(_index, signs=signs, dim=dim, with_vectors=False), "table int, axis int")
    blocks = F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int")
    # One row per table and axis, however many vectors there are.
    sizes = materialize(parts.groupBy("table", "axis").agg(blocks.alias("parts")))
    schema = "table int, axis int, second int, vec_id long, vec binary"
    rows = vectors.mapInArrow(functools.partial(_index, signs=signs, dim=dim, with_vectors=True), schema)
    rows = rows.join(F.broadcast(sizes), ["table", "axis"])
    rows = rows.select(
        "table", "axis", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("block"), "second", "vec_id", "vec"
    )
    schema = "table int, axis int, seconds binary, query_id long, vec binary"
    asked = queries.mapInArrow(functools.partial(_ask, signs=signs, dim=dim, n=n_probes), schema)
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block")
    asked = asked.join(F.broadcast(sizes), ["table", "axis"]).select("table", "axis", each, "seconds", "query_id", "vec")
    keys = ["table", "axis", "block"]
    run = functools.partial(_nearest, dim=dim, k=k, axes=axes)
    found = asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(lambda q, r: run(q, r), FOUND)
    best = materialize(_best(found, k))
    full = best.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = materialize(queries.join(full, "vec_id", "left_anti"))
    if short.isEmpty():
        return best
    n = max(1, -(-vectors.count() // BLOCK_ROWS))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
    asked = short.select(F.col("vec_id").alias("query_id"), "vec", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"))
    run_all = functools.partial(_nearest, dim=dim, k=k, axes=0)
    rest = asked.groupBy("block").cogroup(dealt.groupBy("block")).applyInPandas(lambda q, r: run_all(q, r), FOUND)
    others = best.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti")
    return others.unionByName(_best(rest, k))


def nearest(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """Search with the vectors whose vec_id is divisible by ``every``, against all others.

    Vectors that cannot be compared (see :func:`vectors.stored_vectors`) take no part.
    """
    vectors = materialize(stored_vectors(embeddings))
    return search(vectors, vectors.filter(F.col("vec_id") % every == 0), k)
