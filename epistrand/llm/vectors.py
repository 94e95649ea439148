"""Embedding columns as arrays."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stored_vectors(embeddings: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Rows whose vector can be compared: vec_id, vec (the components as bytes of 64-bit numbers).

    Left out are NULL ids, NULL vectors, vectors of length zero, and those with NULL or
    non-finite components. Shorter vectors count as if zeros followed.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vecs = [], []
            for i, v in zip(batch["vec_id"].to_pylist(), batch["vec"]):
                if i is None or not v.is_valid or v.values.null_count or not len(v.values):
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype("<f8")
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    vecs.append(np.trim_zeros(x, "b").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.binary())], ["vec_id", "vec"])

    rows = embeddings.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).alias("vec"))
    return rows.mapInArrow(pack, "vec_id long, vec binary")


def dimension(vectors: DataFrame) -> int:
    """The length of the longest vector."""
    return (vectors.agg(F.max(F.octet_length("vec"))).first()[0] or 8) // 8


def matrix(column, dim: int, kind: str = "<f8") -> np.ndarray:
    """Vectors, stored as bytes of numbers of that kind, as the rows of a matrix."""
    parts = column.to_pylist() if hasattr(column, "to_pylist") else list(column)
    out = np.zeros((len(parts), dim))
    for row, data in zip(out, parts):
        numbers = np.frombuffer(data, kind)
        row[: len(numbers)] = numbers
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one. Scaling by the largest component first keeps squares finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
