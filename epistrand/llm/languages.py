"""Language identification as inference of a mixture of languages.

Each language has a distribution over byte trigrams, and a document is a mixture: each of
its trigrams comes from one of the languages, in unknown proportions. Expectation
maximisation estimates the proportions that make the document likeliest. Every further
language makes it likelier, so the set of languages is chosen by the likelihood less a
penalty per language (the Bayesian information criterion).
"""

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from epistrand.llm.grams import Grams
from epistrand.llm.words import LETTERS, U64, as_bytes, chunks
from epistrand.sources import materialize

ORDER = 3
PLACES = 65_521  # trigrams share places modulo this prime
MAX_LANGUAGES = 1000  # columns of the broadcast table: at most 262 MB
ALWAYS = 4  # sets of so many languages are tried for every document, larger ones while they pay
PRIOR = 0.5
PENALTY = 1.5  # the usual half per language, times three, as each byte is in three trigrams
STEPS = 40
TOLERANCE = 1e-3
UNKNOWN = "und"


def learnable(doc_id: Column) -> Column:
    """Whether a language may be learned from; the other third of the documents is held out."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) != 1


def _places(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The text and place of each trigram that is not all spaces."""
    grams = Grams(texts, ORDER, LETTERS)
    written = grams.codes != U64(0x202020)
    return grams.owner[written], (grams.codes[written] % U64(PLACES)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch["lang"].to_pylist()
        for first, texts in chunks(as_bytes(batch["text"])):
            owner, place = _places(texts)
            mine = langs[first : first + len(texts)]
            names = sorted(set(mine))
            at = np.array([names.index(x) for x in mine])
            found = np.bincount(at[owner] * PLACES + place, minlength=len(names) * PLACES).reshape(-1, PLACES)
            for name, row in zip(names, found):
                held[name] = held[name] + row if name in held else row
    for name, row in held.items():
        place = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(place), pa.string()), pa.array(place.astype(np.int32)), pa.array(row[place].astype(np.int64))],
            ["lang", "place", "n"],
        )


def count_grams(docs: DataFrame) -> DataFrame:
    """Trigrams of each language: lang, place, n. ``docs`` has text and a non-NULL lang."""
    rows = docs.select("lang", "text").mapInArrow(_count, "lang string, place int, n long")
    return rows.groupBy("lang", "place").agg(F.sum("n").alias("n"))


def proportions(owner: np.ndarray, weight: np.ndarray, likely: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood proportions of languages in each document, and the log-likelihood.

    Row i is a trigram of document ``owner[i]`` (sorted, every document has one) that occurs
    ``weight[i]`` times and has probabilities ``likely[i]``. Languages with proportion 0 in
    ``start`` stay out. A document is done when no proportion moves by the tolerance.
    """
    share = start.copy()
    begin = np.searchsorted(owner, np.arange(len(start)))
    total = np.add.reduceat(weight, begin)
    active = np.arange(len(start))
    rows, local = np.arange(len(owner)), owner
    for _ in range(STEPS):
        part = likely[rows] * share[active][local]
        part *= (weight[rows] / part.sum(1))[:, None]
        new = np.add.reduceat(part, np.searchsorted(local, np.arange(len(active))), axis=0) / total[active][:, None]
        moving = np.abs(new - share[active]).max(1) > TOLERANCE
        share[active] = new
        if not moving.any():
            break
        if moving.mean() < 0.7:
            stays = moving[local]
            rows = rows[stays]
            local = (np.cumsum(moving) - 1)[local[stays]]
            active = active[moving]
    chance = (likely * share[owner]).sum(1)
    return share, np.add.reduceat(weight * np.log(np.maximum(chance, 1e-300)), begin)


def choose(owner: np.ndarray, weight: np.ndarray, likely: np.ndarray, documents: int) -> np.ndarray:
    """Proportions within the language set with the best penalised likelihood.

    Candidate sets are the languages with the largest proportions when all are allowed: the
    first one, two, and so on. Beyond ``ALWAYS`` a document goes on as long as each further
    language makes its set better, however many there are.
    """
    languages = likely.shape[1]
    full, _ = proportions(owner, weight, likely, np.full((documents, languages), 1 / languages))
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
    size = np.add.reduceat(weight, np.searchsorted(owner, np.arange(documents)))
    best, value = full, np.full(documents, -np.inf)
    chosen = np.zeros(documents, int)
    for k in range(1, languages + 1):
        growing = (chosen == k - 1) | (k <= ALWAYS)
        if not growing.any():
            break
        start = np.where(rank < k, 1 / k, 0.0)
        if k > 1:
            start = np.where(rank < k, np.maximum(full, 1e-3), 0.0)
            start /= start.sum(1, keepdims=True)
        share, fit = proportions(owner, weight, likely, start)
        fit = fit - PENALTY * k * np.log(np.maximum(size, 2))
        better = (fit > value) & growing
        chosen[better] = k
        best = np.where(better[:, None], share, best)
        value = np.where(better, fit, value)
    return best


def _predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    names, table = model.value
    for batch in batches:
        letters = pc.fill_null(pc.match_substring_regex(batch["text"], r"\p{L}"), False).to_numpy(zero_copy_only=False)
        for first, texts in chunks(as_bytes(batch["text"])):
            owner, place = _places(texts)
            found, weight = np.unique(owner * PLACES + place, return_counts=True)
            owner, place = found // PLACES, found % PLACES
            some = np.unique(owner)
            lang, score = np.full(len(texts), len(names)), np.zeros(len(texts))
            if len(some) and names:
                share = choose(np.searchsorted(some, owner), weight.astype(float), table[place], len(some))
                lang[some], score[some] = share.argmax(1), share.max(1)
            lang[~letters[first : first + len(texts)]] = len(names)
            score[lang == len(names)] = 0.0
            rows = batch.slice(first, len(texts))
            kept = [c for c in rows.schema.names if c != "text"]
            said = pa.array([*names, UNKNOWN], pa.string()).take(pa.array(lang))
            yield pa.RecordBatch.from_arrays(
                [*[rows[c] for c in kept], said, pa.array(np.clip(score, 0, 1))], [*kept, "lang_pred", "score"]
            )


class LanguageModel:
    """Trigram probabilities of each language."""

    def __init__(self, spark: SparkSession, names: list[str], table: np.ndarray):
        self.names = names
        self.model = spark.sparkContext.broadcast((names, table))

    def predict(self, docs: DataFrame) -> DataFrame:
        """The columns of ``docs`` but text, with lang_pred and score, the proportion of that language.

        Columns of these two names in ``docs`` are replaced.

        Where the text is NULL or has no letter, or nothing was learned, lang_pred is ``und``
        and the score 0. Equal proportions go to the language that is first by name.
        """
        said = StructType([f for f in docs.schema if f.name not in ("text", "lang_pred", "score")])
        rows = docs.select(*said.names, "text")
        return rows.mapInArrow(functools.partial(_predict, model=self.model), said.add("lang_pred", "string").add("score", "double"))


def fit(docs: DataFrame) -> LanguageModel:
    """Learn from the text and non-NULL lang of all documents that are not held out.

    The table has ``PLACES`` rows per language, however large the corpus is.
    """
    spark = docs.sparkSession
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & learnable(F.col("doc_id")))
    counts = materialize(count_grams(usable))
    if counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows = counts.toArrow()
    names = sorted(set(rows["lang"].to_pylist()))
    found = np.zeros((PLACES, len(names)))
    at = np.array([names.index(x) for x in rows["lang"].to_pylist()], int)
    found[rows["place"].to_numpy(), at] = rows["n"].to_numpy()
    used = max(1, int((found.sum(1) > 0).sum()))
    table = (found + PRIOR) / (found.sum(0) + PRIOR * used) if names else found
    return LanguageModel(spark, names, table.astype(np.float32))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from ``docs`` and predict the language of every row: doc_id, held_out, lang_pred, score.

    Language, source and doc_id are no inputs of a prediction. A row without a doc_id is
    not learned from and counts as not held out.
    """
    held_out = ~F.coalesce(learnable(F.col("doc_id")), F.lit(True))
    model = fit(docs.select("doc_id", "text", "lang"))
    return model.predict(docs.select("doc_id", "text", held_out.alias("held_out")))
