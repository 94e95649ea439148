"""Runs of repeated word sequences in texts, found by block convolution.

A run is a stretch of consecutive words with smallest period q that holds at least ``REPEATS``
periods and ``SHORTEST`` words and that neither neighbouring word continues. For each dyadic
scale B, periods from B to 2B - 1 are looked for: a run of such a period holds a block that
starts at a multiple of B and comes again, whole, one period later, in the window of words
from B to 3B after its start. The sums of squared differences between a block and all places
of its window come from one cyclic convolution, exact in integers: words become codes so
small that a sum stays below the prime of the number-theoretic transform. A sum of zero is a
place without mismatch; its distance seeds an extension over the words themselves, which
settles whether it is a run.

Blocks have at most ``BLOCK`` words, and a larger scale has more windows per block, so
transforms never have more than 64 places and are exact products with a matrix of doubles.
The work is proportional to the words times the number of scales, log2 of a quarter of the
words of a text. Texts are worked on in chunks; a long one is a chunk of its own.
"""

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from epistrand.llm.words import BASES, as_bytes, chunks, mix, run_hashes

REPEATS = 4
SHORTEST = 6
BLOCK = 32
# 7 * 2 ** 20 + 1. Sums of 64 products of residues are exact in doubles.
PRIME = 7_340_033
_GENERATOR = 3
# Rows of a transform at once.
_ROWS = 1 << 15


def _residue(x: np.ndarray) -> np.ndarray:
    """Modulo the prime, up to one prime more or less."""
    return x - np.floor(x * (1.0 / PRIME)) * PRIME


class Transform:
    """The number-theoretic transform of n places, a power of two up to 64."""

    def __init__(self, n: int):
        root = pow(_GENERATOR, (PRIME - 1) // n, PRIME)
        powers = [1]
        for _ in range(n - 1):
            powers.append(powers[-1] * root % PRIME)
        at = np.outer(np.arange(n), np.arange(n)) % n
        self.matrix = np.array(powers, float)[at]
        self.inverse = np.array(powers, float)[-at % n] * pow(n, -1, PRIME) % PRIME

    @staticmethod
    @functools.cache
    def of(n: int) -> "Transform":
        return Transform(n)


def mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sums of squared differences of each block of L codes and the L first places of its window of 2 L, exact.

    Codes are whole numbers whose largest square times L is below the prime.
    """
    size = blocks.shape[1]
    t = Transform.of(2 * size)
    front = _residue(blocks[:, ::-1] @ t.matrix[:size])
    both = _residue(_residue(windows @ t.matrix) * front)
    products = _residue(both @ t.inverse)[:, size - 1 : 2 * size - 1]
    sums = np.zeros((len(windows), 2 * size + 1))
    np.cumsum(windows * windows, axis=1, out=sums[:, 1:])
    squares = (blocks * blocks).sum(axis=1)[:, None] + sums[:, size : 2 * size] - sums[:, :size]
    return (squares - 2 * products).astype(np.int64) % PRIME


class _Runs:
    """The runs of one sequence of words, scale by scale."""

    def __init__(self, words: np.ndarray):
        self.words, self.found, self.at = words, [], set()
        self.reach = np.zeros(len(words) + 1, np.int64)  # end of the run that goes on longest, of those that start here or before
        self.starts: dict[int, int] = {}

    def extend(self, places: np.ndarray, distances: np.ndarray) -> None:
        """Take each place whose block comes again at a distance, and keep what is a run."""
        stop: dict[int, int] = {}  # where the last stretch of a distance ended
        for i, d in sorted(zip(places.tolist(), distances.tolist())):
            if i < stop.get(d, -1):
                continue
            start, end = _stretch(self.words, i, d)
            stop[d] = end
            length = end + d - start
            # A stretch that is a run of a smaller period was found before.
            if length >= max(SHORTEST, REPEATS * d) and (start, length) not in self.at:
                self.at.add((start, length))
                self.found.append((start, length, d))
                self.starts[start] = max(self.starts.get(start, 0), start + length)

    def settle(self) -> None:
        """What later scales may take as known."""
        if self.starts:
            at = np.fromiter(self.starts, np.int64, len(self.starts))
            np.maximum.at(self.reach, at, np.fromiter(self.starts.values(), np.int64, len(at)))
            np.maximum.accumulate(self.reach, out=self.reach)
            self.starts.clear()


def _stretch(words: np.ndarray, i: int, d: int) -> tuple[int, int]:
    """The first and one after the last place around i where a word equals that d places later."""
    step, end = 64, i
    while True:
        n = min(step, len(words) - d - end)
        differ = np.flatnonzero(words[end : end + n] != words[end + d : end + d + n])
        if len(differ) or n < step:
            end += int(differ[0]) if len(differ) else max(n, 0)
            break
        end, step = end + n, step * 2
    step, start = 64, i
    while True:
        n = min(step, start)
        differ = np.flatnonzero(words[start - n : start] != words[start - n + d : start + d])
        if len(differ) or n < step:
            start -= n - 1 - int(differ[-1]) if len(differ) else n
            break
        start, step = start - n, step * 2
    return start, end


def find_runs(words: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of texts whose words follow each other, ``counts`` of each.

    ``words`` are non-negative numbers, equal for equal words; places count through all texts.
    """
    # A number that occurs nowhere else between the texts, so that no run crosses a border.
    ends = np.cumsum(counts + 1)
    line = np.full(int(ends[-1]) if len(ends) else 0, -1, np.int64)
    borders = ends - 1
    inside = np.ones(len(line), bool)
    inside[borders] = False
    line[inside] = words
    line[borders] = -1 - np.arange(len(borders))
    text = np.repeat(np.arange(len(counts)), counts + 1)
    spread, most = mix(line.astype(np.uint64)), int(counts.max(initial=0))
    runs = _Runs(line)
    scale = 1
    while REPEATS * scale <= most:
        _scale(runs, line, spread, text, counts, ends, scale)
        runs.settle()
        scale *= 2
    return [(s - int(text[s]), length, period) for s, length, period in sorted(runs.found)]


def _scale(runs, line, spread, text, counts, ends, scale) -> None:
    """Seeds of periods from ``scale`` to twice that."""
    size = min(scale, BLOCK)
    largest = int(((PRIME - 1) / size) ** 0.5)
    codes = np.concatenate((spread % np.uint64(largest + 1), np.zeros(2 * size, np.uint64))).astype(float)
    place = np.arange(0, len(line), scale)
    place = place[counts[text[place]] >= REPEATS * scale]
    for part in range(0, scale, size):  # windows of one block
        from_ = place + scale + part
        near = from_ + size < ends[text[place]]
        here, window = place[near], from_[near]
        for a in range(0, len(here), _ROWS):
            i, w = here[a : a + _ROWS], window[a : a + _ROWS]
            zero = mismatches(codes[i[:, None] + np.arange(size)], codes[w[:, None] + np.arange(2 * size)]) == 0
            row, offset = np.nonzero(zero)
            _seed(runs, line, i[row], w[row] + offset - i[row], scale)


def _seed(runs, line, place, distance, scale) -> None:
    """Drop the seeds that cannot be the first block of a run, and extend the others."""
    # Inside a run of a smaller period, such a distance is a multiple of that period.
    fits = (runs.reach[place] < place + distance + scale) & (place + (REPEATS - 1) * distance <= len(line))
    place, distance = place[fits], distance[fits]
    if not len(place):
        return
    # From the first block of a run, two more periods are the same as the two after the next.
    low, high = int(place.min()), int((place + 3 * distance).max())
    values = mix(line[low:high].astype(np.uint64))
    first, second = place - low, place + distance - low
    span = 2 * distance
    same = run_hashes(values, first, first + span, BASES[0]) == run_hashes(values, second, second + span, BASES[0])
    runs.extend(place[same], distance[same])


def _collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those after the first period of a run."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return b" ".join([words[i] for i in np.flatnonzero(~gone)])


def _rows(batches: Iterator[pa.RecordBatch], schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in chunks(as_bytes(batch["text"])):
            split = [(t or b"").split() for t in texts]
            numbers: dict[bytes, int] = defaultdict()
            numbers.default_factory = numbers.__len__
            line = np.fromiter((numbers[w] for words in split for w in words), np.int64)
            counts = np.array([len(words) for words in split], np.int64)
            begin = np.cumsum(counts) - counts
            per_text: dict[int, list] = defaultdict(list)
            for start, length, period in find_runs(line, counts):
                t = int(np.searchsorted(begin, start, side="right")) - 1
                per_text[t].append((start - int(begin[t]), length, period))
            runs = [[dict(zip(("start", "length", "period"), r)) for r in per_text.get(t, [])] for t in range(len(texts))]
            kept = [_collapse(words, per_text.get(t, [])).decode() for t, words in enumerate(split)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc"].slice(first, len(texts)),
                    pa.array(counts),
                    pa.array(runs, schema.field("runs").type),
                    pa.array(kept, pa.string()),
                ],
                ["doc", "n_words", "runs", "collapsed"],
            )


def collapse_runs(docs: DataFrame) -> DataFrame:
    """All rows of ``docs`` with the runs of their column ``text`` and the text without repeats.

    Returns ``doc``, a struct of the other columns, ``n_words``, ``runs`` (an array of start,
    length and period in words, by start and period) and ``collapsed``: the words that no run
    holds after its first period, joined by one space. Words are what stands between ASCII
    white space. A NULL, empty or blank text has no words and no runs. Rows may repeat; no
    rows give no rows.
    """
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("doc"), "text")
    out = StructType([rows.schema["doc"]]).add("n_words", "long")
    run = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])
    out = out.add("runs", ArrayType(run)).add("collapsed", "string")
    kinds = pa.schema([("runs", pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])))])
    return rows.mapInArrow(functools.partial(_rows, schema=kinds), out)
