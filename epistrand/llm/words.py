"""Words of many texts at once, as arrays of 64-bit hashes.

A word is a maximal run of bytes that are not ASCII white space (space, tab, line feed,
vertical tab, form feed, carriage return), so white space of other kinds belongs to words.
Sequences of words are compared by polynomial hashes: with prefix sums, the hash of any
run of bytes or words costs two look-ups.
"""

from collections.abc import Iterable, Iterator

import numpy as np

U64 = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
CHUNK_BYTES = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTERS = LOWER.copy()  # and all other ASCII characters are spaces
LETTERS[:65] = LETTERS[91:97] = LETTERS[123:128] = 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers; one to one."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64 for i < n."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, 1 << 16)
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, U64(b))
            steps[0] = 1
            pair.append(np.multiply.accumulate(steps))
        _POWERS[base] = (pair[0], pair[1])
    up, down = _POWERS[base]
    return up[:n], down[:n]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of values[start:end] for each pair."""
    up, down = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


class Words:
    """The words of some texts: hashes, and how many each text has.

    ``begin[i]`` to ``begin[i + 1]`` are the words of text i.
    """

    def __init__(self, texts: list[bytes | None], fold: np.ndarray | None = None, base: int = BASES[0]):
        """``fold`` replaces each byte before words are taken."""
        data = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", np.uint8)
        if fold is not None:
            data = fold[data]
        space = _SPACE[data]
        self.starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
        self.ends = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
        self.hashes = run_hashes(data.astype(U64) + U64(1), self.starts, self.ends, base)
        at = np.cumsum([0] + [len(t or b"") + 1 for t in texts])
        self.offsets = at[:-1]
        self.begin = np.searchsorted(self.starts, at)
        self.counts = np.diff(self.begin)

    def grams(self, n: int, base: int = BASES[0]) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the first words of all n-word runs within a text, and their hashes."""
        has = np.maximum(self.counts - (n - 1), 0)
        first = np.repeat(self.begin[:-1] - np.concatenate(([0], np.cumsum(has)[:-1])), has)
        starts = np.arange(len(first)) + first
        return starts, run_hashes(self.hashes, starts, starts + n, base)

    def texts_of(self, positions: np.ndarray) -> np.ndarray:
        """The text that each word position belongs to."""
        return np.searchsorted(self.begin, positions, side="right") - 1


def chunks(texts: Iterable[bytes | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list]]:
    """Consecutive texts of about ``limit`` bytes, with the place of the first; a long text is a chunk of its own."""
    held: list = []
    size = first = 0
    for i, text in enumerate(texts):
        held.append(text)
        size += len(text or b"") + 1
        if size >= limit:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def as_bytes(column) -> list[bytes | None]:
    """An Arrow string column as UTF-8."""
    return column.cast("binary").to_pylist()


def tally(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sum the counts of equal keys."""
    if not keys:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)
