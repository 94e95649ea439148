"""Toxicity by class-conditional Kneser-Ney models of words.

Each class, toxic and ordinary, is a context for words. Its count of a word is discounted,
and what the discounts free is spread over all words by the backoff distribution, which is
shared: a word's backoff count is the number of contexts it has been seen in, so the models
agree with the corpus in sum and differ only where a class has real evidence. Words that
are rare in both classes get the same probability from both but for the classes' weights.

Toxic texts are ordinary for the most part. So the toxic likelihood of a text takes each
word from the toxic model with probability ``MIXED``, and from the ordinary one otherwise. The
logarithm of its ratio to the ordinary likelihood, per word of the whole text, is what a
logistic curve turns into the score.
"""

import functools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from epistrand.llm.lookup import join_per_key
from epistrand.llm.words import LETTERS, U64, Words, as_bytes, chunks, tally
from epistrand.sources import materialize

DISCOUNT = 1.0
MIXED = 0.05
UNIT = 1 << 30  # ratios are whole multiples of 1 / UNIT, so their sums depend on no order
MOST_WORDS = 4_000_000  # with a ratio, that scoring broadcasts: 64 MB; more are joined by shuffle
PADDING = 16  # words of ratio 0 that every text is taken to have besides its own
THRESHOLD = 0.3
BINS = 4000
HOLD = 1_000_000


def _fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4))


def learnable(doc_id: Column) -> Column:
    """Whether a label may be learned from; the other quarter of the documents is held out."""
    return _fold(doc_id) != 2


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of labelled texts by kind, summed within the task."""

    def out(held):
        columns = [(kind, *tally(keys, counts)) for kind, (keys, counts) in held.items()]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([w for _, w, _ in columns] or [np.zeros(0, U64)]).astype(np.int64)),
                pa.array(np.concatenate([np.full(len(w), k) for k, w, _ in columns] or [[]]).astype(np.int32)),
                pa.array(np.concatenate([n for _, _, n in columns] or [[]]).astype(np.int64)),
            ],
            ["word", "kind", "n"],
        )

    held: dict[int, tuple[list, list]] = {}
    for batch in batches:
        kinds = batch["kind"].to_numpy()
        for first, texts in chunks(as_bytes(batch["text"])):
            words = Words(texts, LETTERS)
            kind = np.repeat(kinds[first : first + len(texts)], words.counts)
            for k in np.unique(kind).tolist():
                found, n = np.unique(words.hashes[kind == k], return_counts=True)
                keys, counts = held.setdefault(k, ([], []))
                keys.append(found)
                counts.append(n)
            if sum(len(x) for keys, _ in held.values() for x in keys) > HOLD:
                yield out(held)
                held = {}
    yield out(held)


def count_words(labelled: DataFrame) -> DataFrame:
    """How often each word occurs: word (a hash), and t0, o0, t1, o1 in toxic and ordinary texts of parts 0 and 1.

    ``labelled`` has text, toxic (0 or 1) and part (0 or 1).
    """
    kinds = labelled.select("text", (F.col("toxic") + 2 * F.col("part")).cast("int").alias("kind"))
    rows = kinds.mapInArrow(_count, "word long, kind int, n long")
    sums = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(c) for k, c in enumerate(("o0", "t0", "o1", "t1"))]
    return rows.groupBy("word").agg(*sums)


def log_ratios(counts: DataFrame, t: Column, o: Column) -> tuple[DataFrame, float]:
    """The log ratio of each word that either class has evidence for, and that of all other words.

    ``counts`` has one row per word, with its counts ``t`` and ``o`` in the classes.
    """
    rows = counts.select("word", t.cast("double").alias("t"), o.cast("double").alias("o"))
    freed = {c: F.least(F.col(c), F.lit(DISCOUNT)) for c in "to"}
    total = rows.agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in "to"],
        *[F.coalesce(F.sum(freed[c]), F.lit(0.0)).alias(f"f{c}") for c in "to"],
    ).first()
    if not total["t"] or not total["o"]:
        return rows.select("word", F.lit(0.0).alias("ratio"), F.lit(0.0).alias("n")).limit(0), 0.0
    weight = {c: total[f"f{c}"] / total[c] for c in "to"}
    shared = (freed["t"] + freed["o"]) / F.lit(total["ft"] + total["fo"])
    p = {c: (F.col(c) - freed[c]) / F.lit(total[c]) + F.lit(weight[c]) * shared for c in "to"}
    mixed = F.log(F.lit(1 - MIXED) + F.lit(MIXED) * p["t"] / p["o"])
    known = rows.filter((F.col("t") > DISCOUNT) | (F.col("o") > DISCOUNT))
    other = math.log(1 - MIXED + MIXED * weight["t"] / weight["o"])
    return known.select("word", mixed.alias("ratio"), (F.col("t") + F.col("o")).alias("n")), other


def _means(words: Words, known: np.ndarray, ratios: np.ndarray, other: int) -> np.ndarray:
    """The mean ratio of each text, from the sorted words that have one of their own and their ratios."""
    found, at = np.unique(words.hashes, return_inverse=True)
    value = np.full(len(found), other, np.int64)
    if len(known):
        place = np.minimum(np.searchsorted(known, found), len(known) - 1)
        hit = known[place] == found
        value[hit] = ratios[place[hit]]
    sums = np.concatenate(([0], np.cumsum(value[at])))
    return (sums[words.begin[1:]] - sums[words.begin[:-1]]) / UNIT / (words.counts + PADDING)


def _sorted(words, ratios) -> tuple[np.ndarray, np.ndarray]:
    words = words.to_numpy().astype(np.int64).view(U64)
    order = np.argsort(words)
    return words[order], ratios.to_numpy()[order].astype(np.int64)


def _with_means(rows, texts: list, kept: list[str], known: np.ndarray, ratios: np.ndarray, other: int) -> pa.RecordBatch:
    means = _means(Words(texts, LETTERS), known, ratios, other)
    return pa.RecordBatch.from_arrays([*[rows[c] for c in kept], pa.array(means)], [*kept, "mean_ratio"])


def _ratio(batches: Iterator[pa.RecordBatch], table, other: int, kept) -> Iterator[pa.RecordBatch]:
    known, ratios = table.value
    for batch in batches:
        for first, texts in chunks(as_bytes(batch["text"])):
            yield _with_means(batch.slice(first, len(texts)), texts, kept, known, ratios, other)


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in chunks, each as one value, with the distinct words of their texts."""
    for batch in batches:
        for first, texts in chunks(as_bytes(batch["text"])):
            rows = batch.slice(first, len(texts))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_batch(rows)
            words = np.unique(Words(texts, LETTERS).hashes).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([str(uuid.uuid4())]),
                    pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                    pa.array([words], pa.list_(pa.int64())),
                ],
                ["chunk", "rows", "words"],
            )


def _unbundle(batches: Iterator[pa.RecordBatch], other: int, kept) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data, known in zip(batch["rows"], batch["known"]):
            pairs = known.values if known.is_valid else pa.array([], batch["known"].type.value_type)
            table = _sorted(pairs.field("word"), pairs.field("ratio"))
            for rows in pa.ipc.open_stream(data.as_buffer()):
                yield _with_means(rows, as_bytes(rows["text"]), kept, *table, other)


class ToxicityModel:
    """Word ratios, and the logistic curve from a text's mean ratio to its score.

    ``ratios`` has one row per word that has a ratio of its own (see :func:`log_ratios`); all
    other words have the ratio ``other``. Up to ``MOST_WORDS`` are broadcast. Beyond, the
    distinct words of each chunk of texts are joined to them. Scores are the same either way.
    """

    def __init__(self, ratios: DataFrame, other: float = 0.0, slope: float = 1.0, offset: float = 0.0):
        self.ratios = materialize(ratios.select("word", F.round(F.col("ratio") * UNIT).cast("long").alias("ratio")))
        self.other = round(other * UNIT)
        self.slope, self.offset = slope, offset
        self.table = None
        if self.ratios.count() <= MOST_WORDS:
            rows = self.ratios.toArrow()
            self.table = ratios.sparkSession.sparkContext.broadcast(_sorted(rows["word"], rows["ratio"]))

    def mean_ratio(self, docs: DataFrame, keep_text: bool = False) -> DataFrame:
        """The columns of ``docs``, text only if wanted, and ``mean_ratio``: the log ratio per word of the whole text.

        A column of that name in ``docs`` is replaced, as are ``score``, ``predicted`` and
        ``held_out`` by the functions that return them.
        """
        docs = docs.drop("mean_ratio")
        schema = StructType([f for f in docs.schema if keep_text or f.name != "text"])
        kept = schema.names[:]
        schema = StructType(schema.fields[:]).add("mean_ratio", "double")
        if self.table:
            return docs.mapInArrow(functools.partial(_ratio, table=self.table, other=self.other, kept=kept), schema)
        stored = materialize(docs.mapInArrow(_bundle, "chunk string, rows binary, words array<long>"))
        asked = stored.select("chunk", F.explode("words").alias("word"))
        told = asked.join(self.ratios, "word").groupBy("chunk").agg(F.collect_list(F.struct("word", "ratio")).alias("known"))
        answered = stored.select("chunk", "rows").join(told, "chunk", "left").select("rows", "known")
        return answered.mapInArrow(functools.partial(_unbundle, other=self.other, kept=kept), schema)

    def score(self, docs: DataFrame, keep_text: bool = False) -> DataFrame:
        """One row per row of ``docs``: its columns, text only if wanted, and score and predicted.

        NULL and empty texts have ratio 0.
        """
        score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(self.slope) * F.col("mean_ratio") + F.lit(self.offset))))
        scored = self.mean_ratio(docs, keep_text).withColumn("score", score).drop("mean_ratio")
        return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def _logistic(values: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through counts of both labels, slightly regularised."""
    n = positive + negative
    scale = float(np.sqrt(np.average(values**2, weights=n))) or 1.0
    x = np.column_stack((values / scale, np.ones(len(values))))
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (positive - n * p) - 0.01 * w
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2), gradient)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn from the labelled documents that are not held out.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic (values other than 0 and 1 do
    not count; a document with both is toxic). Counts cover all of them. The curve comes
    from a third of them, scored by models of the other two thirds; their ratios go to the
    driver as counts in at most ``BINS`` bins. Without labels of both kinds every score is
    the share of toxic labels, or 0.5 if there are none.
    """
    usable = labels.filter(F.col("toxic").isin(0, 1) & learnable(F.col("doc_id")))
    known = materialize(usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    shares = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    if not 0 < shares["t"] < shares["n"]:
        share = (shares["t"] + 0.5) / (shares["n"] + 1)
        none = docs.sparkSession.createDataFrame([], "word long, ratio double")
        return ToxicityModel(none, 0.0, 0.0, math.log(share / (1 - share)))
    labelled = join_per_key(docs.select("doc_id", "text"), known, "doc_id")
    labelled = labelled.withColumn("part", (_fold(F.col("doc_id")) == 3).cast("int"))
    counts = materialize(count_words(labelled))
    trial = ToxicityModel(*log_ratios(counts, F.col("t0"), F.col("o0")))
    scored = trial.mean_ratio(labelled.filter("part = 1").select("toxic", "text"))
    width = 4.0 / BINS
    place = F.round(F.greatest(F.least(F.col("mean_ratio"), F.lit(2.0)), F.lit(-2.0)) / F.lit(width)) * F.lit(width)
    bins = scored.groupBy(place.alias("x")).agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).collect()
    x, t, n = np.array([tuple(r) for r in bins] or [(0.0, 0, 0)], float).T
    slope, offset = _logistic(x, t + 1e-6, n - t + 1e-6)
    return ToxicityModel(*log_ratios(counts, F.col("t0") + F.col("t1"), F.col("o0") + F.col("o1")), slope, offset)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labels and score every row of ``docs``: its columns but text, held_out, score, predicted.

    Labels, language, source and doc_id are no inputs of a score. A row without a doc_id is
    scored and counts as not held out.
    """
    scored = fit(docs, labels).score(docs)
    return scored.withColumn("held_out", ~F.coalesce(learnable(F.col("doc_id")), F.lit(True)))
