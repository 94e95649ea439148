"""Sequences put together from segments, and row groups of long rows."""

import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from epistrand.sources import join_segments, longrows, write_long_rows
from helpers import rows

SCHEMA = "patid string, start long, visit long, n_tokens long, code array<string>, age array<int>, elements int"


def cut(n, size, patid, rng):
    code = [rng.choice(["a", "bb", "é", None, "SEP"]) for _ in range(n)]
    age = [rng.choice([40, 41, None]) for _ in range(n)]
    return (patid, code, age), [(patid, at, at // size, n, code[at : at + size], age[at : at + size], at) for at in range(0, max(n, 1), size)]


@pytest.mark.parametrize("batch,elements", [(10_000, 1 << 20), (3, 10), (1, 1)])
def test_segments_become_rows(spark, monkeypatch, batch, elements):
    monkeypatch.setattr(longrows, "BATCH_ELEMENTS", elements)
    rng = random.Random(2)
    want, segments = [], []
    for i in range(40):
        whole, parts = cut(rng.choice([0, 1, 4, 5, 17, 300]), 5, f"p{i % 39}" if i < 39 else None, rng)
        want.append(whole)
        segments += parts
    rng.shuffle(segments)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        joined = join_segments(spark.createDataFrame(segments, SCHEMA).repartition(7))
        assert joined.columns == ["patid", "visit", "n_tokens", "code", "age", "elements"]
        assert rows(joined.select("patid", "code", "age")) == sorted(want, key=lambda r: tuple((v is not None, str(v)) for v in r))
        # Other columns are those of the first segment.
        assert joined.filter("visit != 0 or elements != 0 or n_tokens != size(code)").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_odd_segments(spark):
    assert join_segments(spark.createDataFrame([], SCHEMA)).count() == 0
    data = [("p", 0, 0, 3, None, [1], 0), ("p", 1, 0, 3, ["x"], None, 1), ("p", 1, 0, 3, ["x"], [2], 1), ("q", 0, 0, 0, [], [], 0)]
    got = rows(join_segments(spark.createDataFrame(data, SCHEMA)).select("patid", "code", "age"))
    assert got == [("p", ["x", "x"], [1, 2]), ("q", [], [])]
    two = spark.createDataFrame([(1, "a", 0, [1.5]), (1, "b", 0, [2.5]), (1, "a", 9, [3.5])], "k long, l string, at int, v array<double>")
    assert rows(join_segments(two, ["k", "l"], "at")) == [(1, "a", [1.5, 3.5]), (1, "b", [2.5])]


def test_row_groups_end_by_size(spark, tmp_path):
    wide = spark.range(0, 60, 1, 1).select("id", F.transform(F.sequence(F.lit(1), F.lit(50_000)), lambda x: F.xxhash64("id", x)).alias("v"))
    path = str(tmp_path / "rows")
    write_long_rows(wide, path, row_group_bytes=2 << 20)
    files = [f for f in os.listdir(path) if f.endswith(".parquet")]
    groups = [pq.ParquetFile(f"{path}/{f}").metadata for f in files]
    sizes = [m.row_group(k).total_byte_size for m in groups for k in range(m.num_row_groups)]
    assert len(sizes) >= 10 and max(sizes) < 4 << 20
    assert rows(spark.read.parquet(path)) == rows(wide)


def test_one_sequence_of_many_segments(spark, tmp_path):
    """A sequence that is most of the table is one row, in order."""
    n, size = 400_000, 500
    at = F.col("id") * size
    parts = spark.range(n // size).select(
        F.lit("hot").alias("patid"), at.alias("start"), F.transform(F.sequence(at, at + size - 1), lambda x: x).alias("v")
    )
    small = spark.range(50).select(F.concat(F.lit("p"), F.col("id")).alias("patid"), F.lit(0).cast("long").alias("start"), F.array("id").alias("v"))
    path = str(tmp_path / "rows")
    write_long_rows(join_segments(parts.union(small).repartition(9)), path)
    found = {r.patid: r.v for r in spark.read.parquet(path).collect()}
    assert len(found) == 51 and found.pop("hot") == list(range(n))
    assert all(v == [int(p[1:])] for p, v in found.items())
