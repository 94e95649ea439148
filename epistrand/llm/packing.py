"""Best-fit packing of tokenised documents into sequences, by exact complements of lengths."""

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epistrand.sources import local_table, materialize

MAX_TOKENS = 1024
END = 2
TOKENIZER = "byte_bpe_50k.json"
# White space of so many characters in a row; some 600,000 are too many for tiktoken.
LONG_RUN = 60_000


@functools.cache
def encoder(name: str):
    """The byte-level vocabulary of a ``tokenizers`` file, encoded by ``tiktoken``.

    Both give the same ids (the tests compare them); this one takes a quarter of the time.
    """
    import json

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        held = json.load(f)
    # Byte-level vocabularies write the bytes that are no printable characters as characters from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(sorted({*range(256)} - {*plain}))}
    special = {x["content"]: x["id"] for x in held["added_tokens"]}
    ranks = {bytes(byte[c] for c in t): i for t, i in held["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@functools.cache
def slow_encoder(name: str):
    """The same vocabulary in its own library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def token_ids(text: str, tokenizer: str = TOKENIZER) -> np.ndarray:
    """The ids of a text. ``tiktoken`` fails on very long runs of white space; such texts go to ``tokenizers``."""
    if len(text) >= LONG_RUN and re.search(rf"\s{{{LONG_RUN}}}", text):
        return np.array(slow_encoder(tokenizer).encode(text, add_special_tokens=False).ids, np.uint32)
    return encoder(tokenizer).encode_to_numpy(text, allowed_special="all")


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n tokens; only the first may be shorter than ``size`` if there are several."""
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


def _pieces(batches: Iterator[pa.RecordBatch], size, end, tokenizer, with_ids) -> Iterator[pa.RecordBatch]:
    import zlib

    for batch in batches:
        rows: list[tuple] = []
        held = 0
        docs = zip(batch["doc_id"].to_pylist(), batch["text"])
        for doc, text in docs:
            ids = np.append(token_ids(text.as_py() or "", tokenizer), np.uint32(end)).astype("<u4")
            for piece, (start, length) in enumerate(cut(len(ids), size)):
                part = ids[start : start + length]
                rows.append((doc, piece, start, length, zlib.crc32(part.tobytes()), part.view("<i4") if with_ids else None))
            held += len(ids)
            if held > 1_000_000:
                yield _batch(rows, with_ids)
                rows, held = [], 0
        if rows:
            yield _batch(rows, with_ids)


def _batch(rows, with_ids):
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 5 + with_ids]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def tokenized_pieces(
    docs: DataFrame, size: int = MAX_TOKENS, end: int = END, tokenizer: str = TOKENIZER, with_ids: bool = True
) -> DataFrame:
    """Pieces of at most ``size`` tokens: doc_id, piece, start, length, ids_crc32 and, if wanted, ids.

    A document is the tokens of its text, NULL being empty, and the token ``end``.
    ``ids_crc32`` is the checksum of the ids as little-endian 32-bit integers.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    run = functools.partial(_pieces, size=size, end=end, tokenizer=tokenizer, with_ids=with_ids)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def plan_sequences(counts: dict[int, int], size: int = MAX_TOKENS) -> list[tuple[tuple[int, ...], int]]:
    """Which lengths share a sequence, and how many such sequences there are.

    From the longest length down, what is missing to ``size`` is looked up among the sums of
    one, two and three lengths that are still there; a match is used as often as the counts
    allow. Where no sum fits exactly, the longest that fits goes in and the look-up goes on
    for what is then missing. Each entry uses up one of its lengths, so their number does
    not depend on the number of pieces.
    """
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan = []
    for longest in range(size, 0, -1):
        while left[longest]:
            chosen = [longest]
            left[longest] -= 1
            gap = size - longest
            while gap:
                exact = _exact(left, gap)
                fits = np.flatnonzero(left[1 : gap + 1])
                more = exact or ([int(fits[-1]) + 1] if len(fits) else [])
                if not more:
                    break
                chosen += more
                for x in more:
                    left[x] -= 1
                gap -= sum(more)
            for x in chosen:
                left[x] += 1
            times = min(int(left[x]) // chosen.count(x) for x in set(chosen))
            for x in chosen:
                left[x] -= times
            plan.append((tuple(chosen), times))
    return plan


def _exact(left: np.ndarray, gap: int) -> list[int]:
    """One, two or three available lengths whose sum is ``gap``, the longest first; empty if there are none."""
    if left[gap]:
        return [gap]
    for first in (int(x) for x in np.flatnonzero(left[:gap])[::-1]):
        rest = gap - first
        if rest <= first and left[rest] > (rest == first):
            return [first, rest]
        if rest > first:
            break
    for first in (int(x) for x in np.flatnonzero(left[:gap])[::-1]):
        rest = gap - first
        if first * 3 < gap:
            break
        left[first] -= 1
        second = np.flatnonzero((left[1:rest] > 0) & (left[rest - 1 : 0 : -1] > 0)) + 1 if rest > 1 else []
        pairs = [int(x) for x in second if rest - x <= x <= first and left[x] > (2 * x == rest)]
        left[first] += 1
        if pairs:
            return [first, pairs[-1], rest - pairs[-1]]
    return []


def slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, list[int]]:
    """For each length, which of its pieces (by number) go to which sequences and offset."""
    used: dict[int, int] = {}
    out: dict[str, list[int]] = {c: [] for c in ("length", "low", "high", "shift", "offset")}
    sequences = 0
    for lengths, times in plan:
        offset = 0
        for length in lengths:
            low = used.get(length, 0)
            for c, v in (("length", length), ("low", low), ("high", low + times), ("shift", sequences - low), ("offset", offset)):
                out[c].append(v)
            used[length] = low + times
            offset += length
        sequences += times
    return out


def pack(pieces: DataFrame, size: int = MAX_TOKENS) -> DataFrame:
    """Add sequence_id and offset to pieces that have doc_id, piece and length (1 to ``size``).

    Only the number of pieces per length, at most ``size`` rows, goes to the driver. Pieces
    are numbered within a length by stored parts, not by a window over the length, so a
    length may have any share of them. Rows may repeat. No pieces give no rows.
    """
    stored = materialize(pieces.withColumn("_part", F.spark_partition_id()))
    per_part = stored.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    counts = {r["length"]: r["n"] for r in stored.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return stored.drop("_part").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    if min(counts) < 1 or max(counts) > size:
        raise ValueError(f"pieces must have 1 to {size} tokens")
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_part").orderBy("doc_id", "piece")
    numbered = (
        stored.withColumn("_nth", F.row_number().over(inside) - 1)
        .join(starts, ["length", "_part"])
        .withColumn("_number", F.col("_before") + F.col("_nth"))
    )
    table = {c: pa.array(v, pa.int64()) for c, v in slots(plan_sequences(counts, size)).items()}
    places = local_table(stored.sparkSession, **table)
    places = places.select(F.col("length").alias("_length"), "low", "high", "shift", F.col("offset").alias("_offset"))
    here = (F.col("length") == F.col("_length")) & (F.col("_number") >= F.col("low")) & (F.col("_number") < F.col("high"))
    return numbered.join(F.broadcast(places), here).select(
        *pieces.columns, (F.col("_number") + F.col("shift")).alias("sequence_id"), F.col("_offset").alias("offset")
    )
