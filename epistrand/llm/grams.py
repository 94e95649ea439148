"""Byte n-grams of many texts at once, as integers."""

import numpy as np


class Grams:
    """The n-grams of some texts, each text with one space before and after it.

    ``codes`` are n bytes each, the first byte highest; ``owner`` is the number of the text.
    """

    def __init__(self, texts: list[bytes | None], n: int, table: np.ndarray):
        data = table[np.frombuffer(b" " + b"".join((t or b"") + b"  " for t in texts), np.uint8)].astype(np.uint64)
        codes = data[: len(data) - n + 1].copy()
        for k in range(1, n):
            codes <<= np.uint64(8)
            codes |= data[k : len(data) - n + 1 + k]
        sizes = np.array([len(t or b"") + 2 for t in texts], np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        fits = np.flatnonzero(inside + n <= np.repeat(sizes, sizes))
        self.codes, self.owner = codes[fits], owner[fits]
        self.counts = np.bincount(self.owner, minlength=len(texts))
