"""Rows with list columns of millions of elements: put together from segments, and written.

A group that collects a sequence holds its pieces as objects, sorts them and copies them
into one array. Here segments are sorted by a shuffle that spills, stream through the task
in order, and are appended in Arrow buffers, so a task holds one sequence as flat columns
and one batch of segments, however many sequences it puts together.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

ROW_GROUP_BYTES = 64 << 20
BATCH_ELEMENTS = 1 << 20  # finished sequences are given out in batches of about so many elements


def join_segments(segments: DataFrame, keys: list[str] = ("patid",), order: str = "start") -> DataFrame:
    """One row per sequence, its list columns those of its segments one after the other.

    ``keys`` name the sequence (NULL is a value like any other) and ``order`` the position of
    a segment in it. Other columns, ``visit`` included, are those of the first segment, and
    ``order`` is left out. A NULL list counts as an empty one; segments with equal ``order``
    follow each other in any order. An empty table gives an empty one. A list of strings may hold 2 GB
    of text, the most of a row in Spark too. A task receives
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` segments at a time.
    """
    keys = list(keys)
    fields = [f for f in segments.schema.fields if f.name != order]
    lists = [f.name for f in fields if isinstance(f.dataType, ArrayType)]
    sorted_ = segments.repartition(*keys).sortWithinPartitions(*keys, order)
    empty = {c: F.coalesce(F.col(c), F.array().cast(segments.schema[c].dataType)) for c in lists}
    rows = sorted_.withColumns(empty).select(*[f.name for f in fields]) if lists else sorted_.select(*[f.name for f in fields])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, held, elements = [], [], 0  # slices of whole sequences, and of the one that may go on
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            first = _firsts(batch, keys, last)
            last = _key(batch, keys, batch.num_rows - 1)
            if not first:
                held.append(batch)
                continue
            for piece in [*held, batch.slice(0, first[-1])]:
                if piece.num_rows:
                    done.append(piece)
                    elements += sum(len(piece[c].flatten()) for c in lists)
            held = [batch.slice(first[-1])]
            if elements >= BATCH_ELEMENTS:
                yield _joined(done, keys, lists, names)
                done, elements = [], 0
        if done or held:
            yield _joined([*done, *held], keys, lists, names)

    return rows.mapInArrow(run, StructType(fields))


def _key(batch, keys, row):
    return tuple(batch[k][row].as_py() for k in keys)


def _firsts(batch, keys, last):
    """The rows at which another sequence begins."""
    found = []
    for row, key in enumerate(zip(*[batch[k].to_pylist() for k in keys])):
        if key != last:
            found.append(row)
            last = key
    return found


def _joined(pieces, keys, lists, names):
    """One row per sequence from slices that hold whole sequences in order."""
    firsts, offsets, last, at = [], {c: [0] for c in lists}, None, 0
    for piece in pieces:
        begins = _firsts(piece, keys, last)
        last = _key(piece, keys, piece.num_rows - 1)
        firsts += [at + row for row in begins]
        at += piece.num_rows
    columns = {}
    for c in names:
        parts = [piece[c] for piece in pieces]
        if c not in lists:
            columns[c] = pa.concat_arrays(parts).take(pa.array(firsts, pa.int64()))
            continue
        ends, total = [0], 0
        for part in parts:
            for n in part.value_lengths().to_pylist():
                total += n
                ends.append(total)
        offsets = pa.array([ends[row] for row in firsts] + [total], pa.int32())
        columns[c] = pa.ListArray.from_arrays(offsets, pa.concat_arrays([part.flatten() for part in parts]))
    return pa.RecordBatch.from_pydict(columns)


def write_long_rows(df: DataFrame, path: str, row_group_bytes: int = ROW_GROUP_BYTES, mode: str = "errorifexists") -> None:
    """Write Parquet whose row groups end after about ``row_group_bytes``, however long the rows.

    By default a writer looks at what it holds after a hundred rows only, which are tens of
    gigabytes if each has millions of elements. Here it looks after each row, so it holds a
    row group and at most one row beyond it.
    """
    writer = df.write.mode(mode).option("parquet.block.size", row_group_bytes)
    writer.option("parquet.page.size.row.check.min", 1).option("parquet.page.size.row.check.max", 1).parquet(path)
