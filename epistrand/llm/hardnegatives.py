"""Hard negatives by angular triangle filtering.

Components become whole numbers, floor(scale * x), and a score is an exact inner product. Each
vector is stored with its angles to a few reference directions. For two vectors the triangle
inequality puts their angle between the largest difference and the least sum of those angles,
which makes an interval of cosines and, times both norms, bounds of the score, widened beyond
any rounding. Only pairs whose interval overlaps the window of scores that is asked for are
scored. The window of an anchor's positives is open above a threshold that grows; the windows
of its negatives follow from the scores of the positives.

Vectors lie in cells around the nearest reference, cut into blocks of a bounded size, so a group
of equal vectors may be of any size. An anchor visits only cells whose angles allow a score in
its window. Vectors in random directions are hardly told apart by angles; then each anchor
meets each block, and the work is anchors times vectors, as the exact result demands.
"""

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epistrand.sources import materialize

SCALE = 256
REFERENCES = 16
# References are chosen among so many vectors, taken by a hash of their ids.
SAMPLE = 512
BLOCK_BYTES = 8_000_000
PART_ANCHORS = 2048
# A vector takes part if its squared norm, and so every score, fits in 64 bits.
MAX_SQUARE = 2.0**62
_PAIRS = 1_000_000

ROW = "vec_id long, label long, vec binary, norm double, angles binary, cell int"


def _whole(column: pa.Array, scale: int) -> list[np.ndarray | None]:
    """Vectors as whole numbers; None for those that take no part."""
    out: list[np.ndarray | None] = []
    for v in column:
        x = None
        if v.is_valid and not v.values.null_count:
            y = v.values.to_numpy(zero_copy_only=False).astype(float)
            if np.isfinite(y).all():
                with np.errstate(over="ignore"):
                    y = np.floor(y * scale)
                    x = np.trim_zeros(y.astype(np.int64), "b") if float((y * y).sum()) < MAX_SQUARE else None
        out.append(x)
    return out


def _matrix(parts: list[np.ndarray], dim: int) -> np.ndarray:
    out = np.zeros((len(parts), dim), np.int64)
    for row, x in zip(out, parts):
        row[: len(x)] = x
    return out


def _norms(x: np.ndarray) -> np.ndarray:
    y = x.astype(float)
    return np.sqrt((y * y).sum(axis=1))


def _angles(x: np.ndarray, norms: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles to each reference; a vector of zeros has some angle, which its norm makes harmless."""
    unit = x / np.where(norms > 0, norms, 1)[:, None]
    return np.arccos(np.clip(unit @ references.T, -1, 1))


def choose_references(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n directions of the sample that are far apart, as unit vectors: each next one is farthest from those before."""
    norms = _norms(sample)
    unit = np.unique(sample[norms > 0] / norms[norms > 0, None], axis=0)
    if not len(unit):
        return np.eye(1, max(sample.shape[1], 1))
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < min(n, len(unit)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return unit[chosen]


def score_bounds(a_angles, a_norms, x_angles, x_norms) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each anchor and each vector, beyond any rounding.

    An error of the cosine of 1e-15 is one of 5e-8 in an angle near zero; a millionth of
    the product of the norms, and one, is more than all errors together.
    """
    least = np.zeros((len(a_norms), len(x_norms)))
    most = np.full_like(least, np.pi)
    for a, x in zip(a_angles.T, x_angles.T):
        np.maximum(least, np.abs(a[:, None] - x), out=least)
        total = a[:, None] + x
        np.minimum(most, np.minimum(total, 2 * np.pi - total), out=most)
    size = a_norms[:, None] * x_norms
    slack = size * 1e-6 + 1
    return np.cos(np.maximum(most, least)) * size - slack, np.cos(least) * size + slack


def _scores(x: np.ndarray, exact: np.ndarray | None, a: np.ndarray) -> np.ndarray:
    """Inner products; in doubles where all sums are exact there."""
    return x @ a if exact is None else (exact @ a.astype(float)).astype(np.int64)


class _Block:
    """The vectors of one block, each row once."""

    def __init__(self, table: pa.Table, dim: int):
        vecs = table["vec"].to_pylist()
        ids, labels = table["vec_id"].to_numpy(), table["label"].to_numpy()
        keep = np.arange(len(ids))
        if len(np.unique(ids)) < len(ids):
            first = {}
            for i, row in enumerate(zip(ids.tolist(), labels.tolist(), vecs)):
                first.setdefault(row, i)
            keep = np.array(list(first.values()))
        keep = keep[np.argsort(labels[keep], kind="stable")]
        self.ids, self.labels = ids[keep], labels[keep]
        self.x = _matrix([np.frombuffer(vecs[i], "<i8") for i in keep], dim)
        self.norms = table["norm"].to_numpy()[keep]
        angles = table["angles"].to_pylist()
        self.angles = np.array([np.frombuffer(angles[i], "<f8") for i in keep])
        self.doubles = self.x.astype(float)

    def exact(self, norm: float) -> np.ndarray | None:
        """The vectors as doubles if inner products with a vector of this norm are exact."""
        return self.doubles if norm * float(self.norms.max()) < 2.0**52 else None

    def slices(self, anchors: "_Anchors"):
        """Some anchors at a time, with bounds of their scores."""
        step = max(1, _PAIRS // len(self.ids))
        for a in range(0, len(anchors.ids), step):
            here = slice(a, a + step)
            bounds = score_bounds(anchors.angles[here], anchors.norms[here], self.angles, self.norms)
            yield range(a, min(a + step, len(anchors.ids))), *bounds


class _Anchors:
    def __init__(self, table: pa.Table, dim: int):
        self.ids, self.labels = table["vec_id"].to_numpy(), table["label"].to_numpy()
        self.x = _matrix([np.frombuffer(v, "<i8") for v in table["vec"].to_pylist()], dim)
        self.norms = table["norm"].to_numpy()
        self.angles = np.array([np.frombuffer(v, "<f8") for v in table["angles"].to_pylist()])


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores; of equal ones those with smaller ids, equal ids once."""
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)][:k]


FOUND = pa.schema([("anchor_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
MINED = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("negative_id", pa.int64()),
                   ("positive_score", pa.int64()), ("negative_score", pa.int64())])


def _positives(anchor_table: pa.Table, vector_table: pa.Table, dim: int, k: int) -> pa.Table:
    """The best of one block for each anchor that visits it."""
    out: list[tuple] = []
    if anchor_table.num_rows and vector_table.num_rows:
        anchors, block = _Anchors(anchor_table, dim), _Block(vector_table, dim)
        threshold = anchor_table["threshold"].to_numpy()
        for rows, least, most in block.slices(anchors):
            for n, i in enumerate(rows):
                same = (block.labels == anchors.labels[i]) & (block.ids != anchors.ids[i])
                low = least[n][same]
                bound = max(threshold[i], np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf)
                at = np.flatnonzero(same & (most[n] >= bound))
                scores = _scores(block.x[at], e[at] if (e := block.exact(anchors.norms[i])) is not None else None, anchors.x[i])
                best = _best(block.ids[at], scores, k)
                out += zip([int(anchors.ids[i])] * len(best), block.ids[at][best].tolist(), scores[best].tolist())
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] or [pa.array([], pa.int64())] * 3, schema=FOUND)


def _negatives(anchor_table: pa.Table, vector_table: pa.Table, dim: int, k: int, low: int, high: int) -> pa.Table:
    """The best of one block in each window of each anchor that visits it."""
    out: list[tuple] = []
    if anchor_table.num_rows and vector_table.num_rows:
        anchors, block = _Anchors(anchor_table, dim), _Block(vector_table, dim)
        wanted = anchor_table["positives"].to_pylist()
        for rows, least, most in block.slices(anchors):
            for n, i in enumerate(rows):
                windows = [(p["vec_id"], p["score"], *_window(p["score"], low, high)) for p in wanted[i]]
                inside = np.zeros(len(block.ids), bool)
                for *_, a, z in windows:
                    inside |= (most[n] >= a) & (least[n] <= z)
                at = np.flatnonzero(inside & (block.labels != anchors.labels[i]) & (block.ids != anchors.ids[i]))
                if not len(at):
                    continue
                scores = _scores(block.x[at], e[at] if (e := block.exact(anchors.norms[i])) is not None else None, anchors.x[i])
                for positive, score, a, z in windows:
                    fits = np.flatnonzero((scores >= a) & (scores <= z))
                    best = fits[_best(block.ids[at][fits], scores[fits], k)]
                    for b in best:
                        out.append((int(anchors.ids[i]), positive, int(block.ids[at[b]]), score, int(scores[b])))
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] or [pa.array([], pa.int64())] * 5, schema=MINED)


def _window(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and the greatest negative score with low * score <= 100 * it <= high * score."""
    return -(-low * score // 100), high * score // 100


def mine(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = SCALE
) -> DataFrame:
    """Negatives of each anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, label and embedding; ``anchors`` is a condition on vec_id. An anchor's
    positives are the ``positives`` other rows of its label with the highest scores, and for each
    of them its negatives are the first ``negatives`` rows of other labels whose score lies
    between ``low`` and ``high`` percent of the positive's; ties go to the smaller vec_id.

    Rows with a NULL id or label, a NULL vector, or a NULL or non-finite component take no part,
    nor do vectors whose scores would not fit in 64 bits. Vectors of zeros do, with score 0;
    shorter vectors count as if zeros followed. Equal rows count once. If an id has several
    vectors, each is a candidate, the best one counts, and the least one by label and bytes is
    the anchor. Without anchors, positives or negatives there are no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").alias("vec"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull())
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec").toArrow()["vec"].combine_chunks()
    sample = [x for x in _whole(chosen, scale) if x is not None]
    dim = rows.agg(F.max(F.size("vec"))).first()[0] or 1
    references = choose_references(_matrix(sample, dim), REFERENCES)
    place = functools.partial(_place, scale=scale, dim=dim, references=references)
    stored = materialize(rows.mapInArrow(place, ROW))
    cells = _cells(stored, len(references))
    block_rows = max(256, BLOCK_BYTES // (8 * dim))
    blocks = F.create_map(*[F.lit(x) for c, s in cells.items() for x in (c, -(-s["n"] // block_rows))]) if cells else None
    if blocks is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")

    def block(cell):
        return F.pmod(F.xxhash64("vec_id"), F.element_at(blocks, cell)).cast("int")

    asked = stored.filter(anchors).groupBy("vec_id")
    asked = asked.agg(F.min(F.struct("label", "vec", "norm", "angles", "cell")).alias("_r")).select("vec_id", "_r.*")
    asked = materialize(asked)
    parts = max(1, -(-asked.count() // PART_ANCHORS))
    part = F.pmod(F.xxhash64("vec_id", F.lit("part")), F.lit(parts)).cast("int")
    dealt = stored.withColumns({"block": block(F.col("cell")), "part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})

    def visit(visitors, run, schema):
        """Each anchor in the cells of its column ``cells``, block by block."""
        to = visitors.withColumn("part", part).withColumn("cell", F.explode("cells")).drop("cells")
        to = to.withColumn("block", F.explode(F.sequence(F.lit(0), F.element_at(blocks, F.col("cell")).cast("int") - 1)))
        keys = ["cell", "block", "part"]
        return to.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(run, schema)

    found_schema = "anchor_id long, vec_id long, score long"
    nearest = functools.partial(_positives, dim=dim, k=positives)
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")

    def top(found):
        distinct = found.groupBy("anchor_id", "vec_id").agg(F.max("score").alias("score"))
        return distinct.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives)

    own = asked.withColumns({"threshold": F.lit(float("-inf")), "cells": F.array("cell")}).drop("cell")
    first = materialize(top(visit(own, nearest, found_schema)))
    reached = first.filter(F.col("place") == positives).select(F.col("anchor_id").alias("vec_id"), F.col("score").cast("double").alias("threshold"))
    others = asked.join(reached, "vec_id", "left").withColumn("threshold", F.coalesce("threshold", F.lit(float("-inf"))))
    others = _choose_cells(others.withColumn("windows", F.array(F.struct(F.col("threshold").alias("least"), F.lit(float("inf")).alias("most")))), cells, True)
    rest = visit(others.drop("windows", "cell"), nearest, found_schema)
    pairs = first.drop("place").unionByName(rest)
    pairs = top(pairs).groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("positives"))
    with_pairs = asked.join(pairs.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    score = lambda p, share: p["score"].cast("double") * F.lit(share / 100)
    slack = F.lit(1.0)
    windows = F.transform("positives", lambda p: F.struct((score(p, low) - slack).alias("least"), (score(p, high) + slack).alias("most")))
    visitors = _choose_cells(with_pairs.withColumn("windows", windows), cells, False).drop("windows", "cell")
    run = functools.partial(_negatives, dim=dim, k=negatives, low=low, high=high)
    mined = visit(visitors, run, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    keys = ["anchor_id", "positive_id", "positive_score"]
    mined = mined.groupBy(*keys, "negative_id").agg(F.max("negative_score").alias("negative_score"))
    order = Window.partitionBy(*keys).orderBy(F.desc("negative_score"), "negative_id")
    ranked = mined.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _place(batches: Iterator[pa.RecordBatch], scale, dim, references) -> Iterator[pa.RecordBatch]:
    """Whole numbers, norms, angles and the nearest reference of each vector."""
    for batch in batches:
        whole = _whole(batch["vec"], scale)
        at = [i for i, x in enumerate(whole) if x is not None]
        x = _matrix([whole[i] for i in at], dim)
        norms = _norms(x)
        angles = _angles(x, norms, references)
        take = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                batch["vec_id"].take(take),
                batch["label"].take(take),
                pa.array([whole[i].astype("<i8").tobytes() for i in at], pa.binary()),
                pa.array(norms, pa.float64()),
                pa.array([a.astype("<f8").tobytes() for a in angles], pa.binary()),
                pa.array(angles.argmin(axis=1) if len(at) else [], pa.int32()),
            ],
            ["vec_id", "label", "vec", "norm", "angles", "cell"],
        )


def _cells(stored: DataFrame, n: int) -> dict[int, dict]:
    """For each cell, at most as many as references: rows, the range of norms and that of angles to each reference."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, norm = batch["cell"].to_numpy(), batch["norm"].to_numpy()
            angles = np.array([np.frombuffer(a, "<f8") for a in batch["angles"].to_pylist()]).reshape(-1, n)
            found = []
            for c in np.unique(cell):
                at = cell == c
                low, high = angles[at].min(axis=0), angles[at].max(axis=0)
                found += [(int(c), r, int(at.sum()), norm[at].min(), norm[at].max(), low[r], high[r]) for r in range(n)]
            names = ["cell", "reference", "n", "norm_low", "norm_high", "low", "high"]
            kinds = [pa.int32(), pa.int32(), pa.int64()] + [pa.float64()] * 4
            columns = list(zip(*found)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    schema = "cell int, reference int, n long, norm_low double, norm_high double, low double, high double"
    summed = stored.select("cell", "norm", "angles").mapInArrow(ranges, schema).groupBy("cell", "reference")
    least, most = [F.min(c).alias(c) for c in ("norm_low", "low")], [F.max(c).alias(c) for c in ("norm_high", "high")]
    out: dict[int, dict] = {}
    for r in summed.agg(F.sum("n").alias("n"), *least, *most).collect():
        c = out.setdefault(r.cell, {"n": r.n, "norms": (r.norm_low, r.norm_high), "low": np.zeros(n), "high": np.zeros(n)})
        c["low"][r.reference], c["high"][r.reference] = r.low, r.high
    return out


def _choose_cells(anchors: DataFrame, cells: dict[int, dict], skip_own: bool) -> DataFrame:
    """Add ``cells``: those that can hold a score in one of the anchor's ``windows``."""
    names = sorted(cells)
    low, high = np.array([cells[c]["low"] for c in names]), np.array([cells[c]["high"] for c in names])
    norms = np.array([cells[c]["norms"] for c in names])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, norm, own, windows in zip(*(batch[c].to_pylist() for c in ("angles", "norm", "cell", "windows"))):
                angle = np.frombuffer(a, "<f8")
                near = np.maximum(np.maximum(angle - high, low - angle), 0).max(axis=1)
                far = np.minimum(np.minimum(angle + high, 2 * np.pi - angle - low), np.pi).min(axis=1)
                ends = np.cos(np.stack([near, np.maximum(far, near)], axis=1))[:, :, None] * norms[:, None, :] * norm
                slack = norm * norms[:, 1] * 1e-6 + 1
                least, most = ends.min(axis=(1, 2)) - slack, ends.max(axis=(1, 2)) + slack
                fits = [any(z["most"] >= s and z["least"] <= m for z in windows) for s, m in zip(least, most)]
                out.append([c for c, f in zip(names, fits) if f and not (skip_own and c == own)])
            columns = {c: batch[c] for c in batch.schema.names} | {"cells": pa.array(out, pa.list_(pa.int32()))}
            yield pa.RecordBatch.from_pydict(columns)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in anchors.schema.fields)
    return anchors.mapInArrow(choose, f"{kinds}, cells array<int>")
