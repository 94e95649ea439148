"""Substring deduplication: passages that already occur earlier in the corpus are removed.

A passage is a window of 20 words. Comparing all windows would shuffle the corpus many
times over, so a count-min sketch first rules out those that occur once:

1. Each window is represented by the 8-word run with the smallest hash in it, its anchor.
   Neighbouring windows mostly share one. Equal windows have equal anchors, so the number of
   an anchor's occurrences is at least that of any of its windows.
2. Each chunk of documents counts its anchors in a count-min sketch: two cells each, counts
   stopping at two. Cells are dealt by range into tiles of a fixed width whose number follows
   the corpus, and a chunk sends each tile the cells it touched with the documents they came
   from, but no hashes. A tile adds the sketches of all chunks; an anchor's smaller cell never
   falls short of its count, so anchors below two in it are out for certain. For the others
   the documents get the cells to consult.
3. A second pass over the reported documents hashes the windows whose anchors fall into
   these cells and groups them exactly, by two independent 64-bit hashes. All but the first occurrence
   of a window cover their words.

Repeats within a chunk are settled there, so that a passage that a third of all documents
share puts one entry per chunk into a shard.
"""

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from epistrand.llm.words import BASES, U64, Words, as_bytes, chunks, mix

WINDOW = 20
ANCHOR = 8
SHARD_BYTES = 4_000_000  # of text per shard, which is also a tile of the sketch
CELL_BITS = 20  # of a cell's place in its row of a tile; two rows

_PLACE_BITS = U64(24)
_PLACE = U64((1 << 24) - 1)


def anchors(words: Words, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window: its first word, the first word of its anchor, and the anchor's hash.

    Ties of the smallest hash go to the leftmost run.
    """
    starts, hashes = words.grams(anchor)
    at = np.full(len(words.hashes) + window, np.iinfo(np.uint64).max, U64)
    at[starts] = hashes
    # The upper 40 bits decide; the place in the lower 24 breaks ties and tells which run it was.
    least = (at & ~_PLACE) | (np.arange(len(at)).astype(U64) & _PLACE)
    span, width = 1, window - anchor + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        shift = width - span
        least = np.minimum(least[:-shift], least[shift:])
    first, _ = words.grams(window)
    place = first + ((least[first] - first.astype(U64)) & _PLACE).astype(np.int64)
    return first, place, at[place]


def _shards(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the upper 32 bits."""
    return ((hashes >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def _split(order_by: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """Ranges of sorted shard numbers."""
    bounds = np.searchsorted(order_by, np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(bounds)):
        yield int(s), slice(bounds[s], bounds[s + 1])


def _rows(columns: dict[str, list], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) for c, t in types.items()], list(types))


def _texts(batches):
    """Chunks of documents with a doc_id: ids and texts."""
    for batch in batches:
        ids = batch["doc_id"].to_numpy(zero_copy_only=False)
        for first, texts in chunks(as_bytes(batch["text"])):
            yield batch, slice(first, first + len(texts)), ids[first : first + len(texts)].astype(np.int64), texts


SKETCH = "shard int, local boolean, cells binary, twice binary, docs binary, base long, width int"
_SKETCH = {
    "shard": pa.int32(),
    "local": pa.bool_(),
    "cells": pa.binary(),
    "twice": pa.binary(),
    "docs": pa.binary(),
    "base": pa.int64(),
    "width": pa.int32(),
}


def cells_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """An anchor's cells in the two rows of its tile, as one number."""
    return mix(hashes ^ U64(BASES[1])) >> U64(64 - 2 * bits)


def _pack(cells: np.ndarray) -> bytes:
    """Numbers of up to 40 bits, as their lower 32 bits and then the others."""
    return cells.astype("<u4").tobytes() + (cells >> U64(32)).astype("u1").tobytes()


def _unpack(packs) -> np.ndarray:
    parts = [np.zeros(0, U64)]
    for data in packs:
        n = len(data) // 5
        parts.append(np.frombuffer(data, "<u4", n).astype(U64) | np.frombuffer(data, "u1", n, 4 * n).astype(U64) << U64(32))
    return np.concatenate(parts)


def _sketch(batches: Iterator[pa.RecordBatch], shards: int, bits: int) -> Iterator[pa.RecordBatch]:
    """The sketch of each chunk, a row per tile.

    ``cells`` are those of anchors that occur once in the chunk, each with its document
    (less ``base``, in ``width`` bytes); ``twice`` are those of anchors that occur more
    often. These are known to be repeated: their documents go on in a ``local`` row, dealt by
    chunk.
    """
    for _, _, ids, texts in _texts(batches):
        words = Words(texts)
        _, place, hashes = anchors(words)
        new = np.ones(len(place), bool)
        new[1:] = place[1:] != place[:-1]
        hashes, owner = hashes[new], words.texts_of(place[new])
        order = np.argsort(hashes, kind="stable")
        hashes, docs = hashes[order], ids[owner[order]]
        out = {c: [] for c in _SKETCH}

        def add(shard, local, cells, twice, docs):
            base = int(docs.min()) if len(docs) else 0
            there = (docs - np.int64(base)).view(U64)
            most = int(there.max()) if len(docs) else 0
            width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w))
            packed = there.astype(f"<u{width}").tobytes()
            for c, v in zip(out, (shard, local, _pack(cells), _pack(twice), packed, base, width)):
                out[c].append(v)

        cells = cells_of(hashes, bits)
        begin = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.zeros(0, int)
        times = np.diff(np.concatenate((begin, [len(hashes)])))
        for s, part in _split(_shards(hashes[begin], shards), shards):
            at, once = begin[part], times[part] == 1
            add(s, False, cells[at[once]], cells[at[~once]], docs[at[once]])
        often = np.repeat(times > 1, times)
        if often.any():
            add(int(mix(hashes[:1])[0] % U64(shards)), True, cells[often], cells[:0], docs[often])
        yield _rows(out, _SKETCH)


def _docs(rows: pd.DataFrame) -> np.ndarray:
    """The documents of all cells of some rows."""
    parts = [np.zeros(0, np.int64)]
    for data, base, width in zip(rows["docs"], rows["base"], rows["width"]):
        parts.append(np.frombuffer(data, f"<u{width}").astype(U64).view(np.int64) + np.int64(base))
    return np.concatenate(parts)


def merge(sketches: Iterator[tuple[np.ndarray, np.ndarray]], bits: int) -> np.ndarray:
    """The sum of the sketches of chunks: two rows of counts, which stop at two.

    A sketch has the cells that an anchor touched once in its chunk, and those that one
    touched more often.
    """
    merged = np.zeros((2, 1 << bits), np.uint8)
    for cells, twice in sketches:
        for row, shift in zip(merged, (0, bits)):
            for numbers, n in ((cells, 1), (twice, 2)):
                at = (numbers >> U64(shift) & U64((1 << bits) - 1)).astype(np.int64)
                # Cells that anchors of one chunk share count once for each of them.
                place, times = np.unique(at, return_counts=True)
                row[place] = np.minimum(row[place] + np.minimum(times * n, 2), 2)
    return merged


def estimates(merged: np.ndarray, cells: np.ndarray, bits: int) -> np.ndarray:
    """At least how often each anchor occurs, or two."""
    low, high = ((cells >> U64(shift) & U64((1 << bits) - 1)).astype(np.int64) for shift in (0, bits))
    return np.minimum(merged[0][low], merged[1][high])


def _estimate(rows: pd.DataFrame, bits: int) -> pd.DataFrame:
    """Merge the sketches of a tile and report the cells of anchors estimated to be repeated."""
    local, dealt = rows[rows["local"]], rows[~rows["local"]]
    merged = merge(((_unpack([c]), _unpack([t])) for c, t in zip(dealt["cells"], dealt["twice"])), bits)
    cells, docs = _unpack(dealt["cells"]), _docs(dealt)
    said = estimates(merged, cells, bits) >= 2
    cells = np.concatenate((cells[said], _unpack(local["cells"])))
    docs = np.concatenate((docs[said], _docs(local)))
    order = np.lexsort((cells, docs))
    return _by_doc(docs[order], cells[order])


def _by_doc(docs: np.ndarray, values: np.ndarray) -> pd.DataFrame:
    """One row per document, its values packed."""
    begin = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1]))) if len(docs) else np.zeros(0, int)
    end = np.concatenate((begin[1:], [len(docs)])).astype(int)
    return pd.DataFrame(
        {"doc_id": docs[begin], "packed": [values[b:e].tobytes() for b, e in zip(begin, end)]}
    ).astype({"doc_id": "int64"})


WINDOWS = "shard int, runs binary, hashes binary, covered binary"
_WINDOWS = {"shard": pa.int32(), "runs": pa.binary(), "hashes": pa.binary(), "covered": pa.binary()}
_RUN = np.dtype([("anchor", "u8"), ("doc", "i8"), ("start", "i8"), ("n", "i4")])


def _windows(batches: Iterator[pa.RecordBatch], shards: int, bits: int) -> Iterator[pa.RecordBatch]:
    """The windows whose anchors fall into reported cells, as runs of windows that share one.

    Of runs that are equal within the chunk only the first goes to its shard; the others
    are covered for certain.
    """
    for batch, at, ids, texts in _texts(b.filter(b["reported"].is_valid()) for b in batches):
        words = Words(texts)
        first, place, hashes = anchors(words)
        owner = words.texts_of(first)
        cells, said = cells_of(hashes, bits), np.zeros(len(first), bool)
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        for i, packs in enumerate(batch["reported"].slice(at.start, len(texts)).to_pylist()):
            part = slice(bounds[i], bounds[i + 1])
            said[part] = np.isin(cells[part], np.frombuffer(b"".join(packs or ()), U64))
        pick = np.flatnonzero(said)
        if not len(pick):
            continue
        _, exact = words.grams(WINDOW, BASES[1])
        exact, first, place, owner, hashes = exact[pick], first[pick], place[pick], owner[pick], hashes[pick]
        new = np.ones(len(pick), bool)
        new[1:] = (place[1:] != place[:-1]) | (first[1:] != first[:-1] + 1)
        begin = np.flatnonzero(new)
        runs = np.zeros(len(begin), _RUN)
        runs["anchor"], runs["doc"] = hashes[begin], ids[owner[begin]]
        runs["start"] = first[begin] - words.begin[owner[begin]]
        runs["n"] = np.diff(np.concatenate((begin, [len(pick)])))
        offset = np.arange(len(pick)) - np.repeat(begin, runs["n"])
        whole = np.add.reduceat(mix(exact + offset.astype(U64) * U64(BASES[0])), begin)
        order = np.lexsort((runs["start"], runs["doc"], runs["n"], whole, runs["anchor"]))
        a = runs[order]
        same = np.zeros(len(a), bool)
        same[1:] = (a["anchor"][1:] == a["anchor"][:-1]) & (whole[order][1:] == whole[order][:-1]) & (a["n"][1:] == a["n"][:-1])
        # Rows of one doc_id at the same place are the same occurrence.
        same[1:] &= ~((a["doc"][1:] == a["doc"][:-1]) & (a["start"][1:] == a["start"][:-1]))
        out = {c: [] for c in _WINDOWS}
        sent = order[~same]
        begins = begin[sent]
        shard = _shards(runs["anchor"][sent], shards)
        for s, part in _split(shard, shards):
            take = np.repeat(begins[part], runs["n"][sent[part]]) + _counted(runs["n"][sent[part]])
            for c, v in zip(out, (s, runs[sent[part]].tobytes(), exact[take].tobytes(), None)):
                out[c].append(v)
        if same.any():
            deal = int(mix(runs["anchor"][:1])[0] % U64(shards))
            for c, v in zip(out, (deal, None, None, a[same].tobytes())):
                out[c].append(v)
        yield _rows(out, _WINDOWS)


def _counted(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _covers(rows: pd.DataFrame) -> pd.DataFrame:
    """Per document, the runs of windows whose words occur earlier: starts and numbers of windows."""
    dealt = rows[rows["runs"].notna()]
    runs = np.frombuffer(b"".join(dealt["runs"]), _RUN)
    exact = np.frombuffer(b"".join(dealt["hashes"]), U64)
    anchor, doc = (np.repeat(runs[c], runs["n"]) for c in ("anchor", "doc"))
    start = np.repeat(runs["start"], runs["n"]) + _counted(runs["n"])
    order = np.lexsort((start, doc, exact, anchor))
    anchor, exact, doc, start = anchor[order], exact[order], doc[order], start[order]
    new = np.ones(len(order), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (exact[1:] != exact[:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    later = (doc != doc[lead]) | (start != start[lead])
    settled = np.frombuffer(b"".join(rows["covered"].dropna()), _RUN)
    docs = np.concatenate((doc[later], settled["doc"]))
    spans = np.zeros((len(docs), 2), np.int64)
    spans[:, 0] = np.concatenate((start[later], settled["start"]))
    spans[:, 1] = np.concatenate((np.ones(int(later.sum()), np.int64), settled["n"]))
    order = np.lexsort((spans[:, 0], docs))
    docs, spans = docs[order], spans[order]
    new = np.ones(len(docs), bool)  # join windows that follow each other
    new[1:] = (docs[1:] != docs[:-1]) | (spans[1:, 0] != spans[:-1, 0] + spans[:-1, 1])
    begin = np.flatnonzero(new)
    if len(begin):
        spans = np.column_stack((spans[begin, 0], np.add.reduceat(spans[:, 1], begin)))
    return _by_doc(docs[begin], spans)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the words that no window covers."""
    for batch in batches:
        total, removed, kept = [], [], []
        for text, packs in zip(as_bytes(batch["text"]), batch["covered"].to_pylist()):
            words = (text or b"").split()
            total.append(len(words))
            if packs:
                spans = np.frombuffer(b"".join(packs), np.int64).reshape(-1, 2)
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, np.minimum(spans[:, 0], len(words)), 1)
                np.add.at(change, np.minimum(spans[:, 0] + spans[:, 1] + WINDOW - 1, len(words)), -1)
                stays = np.cumsum(change[:-1]) == 0
                words = [w for w, s in zip(words, stays.tolist()) if s]
            removed.append(total[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc"],
                pa.array(total, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(kept, pa.binary()).cast(pa.string()),
            ],
            ["doc", "n_words", "n_removed", "kept"],
        )


def remove_repeats(docs: DataFrame, cell_bits: int = CELL_BITS) -> DataFrame:
    """Remove every word that a window covers whose 20 words also start earlier.

    Earlier means in a document with a smaller doc_id, or at an earlier word of the same
    document; windows are judged on the given texts. One row per row of ``docs``:
    n_words, n_removed, ``kept`` (the words that stay, joined by a space), and the other
    columns of ``docs`` in ``doc``. Words are runs without ASCII white space. A NULL, empty
    or shorter text has no window. Rows without a doc_id lose nothing and cause no
    removal. Rows with the same doc_id are the same document: their texts should be equal,
    and each loses what any of them loses. Fewer ``cell_bits`` (at most 20) estimate more
    windows to be repeated and change no result.
    """
    bytes_ = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-bytes_ // SHARD_BYTES))
    rows = docs.select("doc_id", "text")
    sketches = rows.filter("doc_id is not null and text is not null").mapInArrow(functools.partial(_sketch, shards=shards, bits=cell_bits), SKETCH)
    reported = sketches.groupBy("shard").applyInPandas(lambda rows: _estimate(rows, cell_bits), "doc_id long, packed binary")
    reported = reported.groupBy("doc_id").agg(F.collect_list("packed").alias("reported"))
    # The two joins deal out the same rows by the same key, so Spark shuffles the texts once.
    windows = rows.join(reported, "doc_id", "left").mapInArrow(functools.partial(_windows, shards=shards, bits=cell_bits), WINDOWS)
    covered = windows.groupBy("shard").applyInPandas(_covers, "doc_id long, packed binary")
    covered = covered.groupBy("doc_id").agg(F.collect_list("packed").alias("covered"))
    others = F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("doc")
    whole = docs.join(covered.withColumnRenamed("doc_id", "_doc"), docs["doc_id"] == F.col("_doc"), "left")
    whole = whole.select(others, docs["text"], covered["covered"])
    out = StructType([whole.schema["doc"]]).add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return whole.mapInArrow(_remove, out)
