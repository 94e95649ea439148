"""MinHash near-deduplication with an LSH forest."""

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistrand.llm.components import components
from epistrand.llm.words import BASES, LOWER, U64, Words, as_bytes, chunks, mix, run_hashes
from epistrand.sources import materialize

WORDS = 5
PERCENT = 75
TREES, DEPTH = 16, 8
NEIGHBOURS = 8
SHARED = 2  # values at the start of an order that candidates must share
BLOCK_SHINGLES = 2_000_000
MULTIPLIERS = [int(x) | 1 for x in mix(np.arange(1, TREES * DEPTH + 1, dtype=U64) * U64(BASES[1]))]


def shingle_sets(texts: list[bytes | None], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-word runs of each text in ASCII lower case, as sorted hashes: text numbers and hashes.

    A text of fewer words has one run, all of it; a text without words has none.
    """
    words = Words(texts, LOWER)
    starts, hashes = words.grams(n)
    owner = words.texts_of(starts)
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    whole = run_hashes(words.hashes, words.begin[short], words.begin[short] + words.counts[short], BASES[0])
    owner, hashes = np.concatenate((owner, short)), np.concatenate((hashes, whole))
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[new], hashes[new]


SIGNATURE = "doc_id long, n_shingles long, set_hash binary, values binary, bits binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch["doc_id"]
        for first, texts in chunks(as_bytes(batch["text"])):
            owner, hashes = shingle_sets(texts)
            counts = np.bincount(owner, minlength=len(texts))
            full = np.flatnonzero(counts)
            begin = np.concatenate(([0], np.cumsum(counts[full])[:-1])).astype(np.int64)
            digest = np.zeros((len(texts), 2), U64)
            values = np.zeros((len(texts), TREES * DEPTH), ">u2")
            bits = np.zeros((len(texts), TREES * DEPTH), np.uint8)
            if len(full):
                for c in range(2):
                    digest[full, c] = np.add.reduceat(mix(hashes ^ U64(BASES[c])), begin)
                for k, m in enumerate(MULTIPLIERS):
                    least = mix(np.minimum.reduceat(hashes * U64(m), begin))
                    values[full, k] = least & U64(0xFFFF)
                    bits[full, k] = (least >> U64(20)) & U64(1)
            packed = np.packbits(bits, axis=1)
            empty = counts == 0
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(first, len(texts)),
                    pa.array(counts, pa.int64()),
                    *[
                        pa.array([None if e else row.tobytes() for e, row in zip(empty, table)], pa.binary())
                        for table in (digest, values, packed)
                    ],
                ],
                ["doc_id", "n_shingles", "set_hash", "values", "bits"],
            )


def signatures(docs: DataFrame) -> DataFrame:
    """For each row: the number of shingles, a digest of their set and its MinHash signature.

    ``values`` are 16 bits of each of the 128 smallest hashes, ``bits`` one further bit of each.
    """
    return docs.select("doc_id", "text").mapInArrow(_sign, SIGNATURE)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of signature bits: half the bits of unlike shingles agree by chance."""
    differ = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    return 1 - 2 * differ / (TREES * DEPTH)


def _neighbours(batches: Iterator[pa.RecordBatch], least: float, hold: int) -> Iterator[pa.RecordBatch]:
    """Links between rows near each other in a sorted order; see :func:`candidates`."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        if rest.num_rows < hold:
            continue
        yield from _linked(rest, least)
        rest = rest.slice(rest.num_rows - NEIGHBOURS)
    if rest is not None:
        yield from _linked(rest, least)


def _linked(rows: pa.Table, least: float) -> Iterator[pa.RecordBatch]:
    n = rows.num_rows
    ids = rows["doc_id"].to_numpy()
    tree = rows["tree"].to_numpy()
    values = np.frombuffer(b"".join(rows["order"].to_pylist()), np.uint16).reshape(n, DEPTH)
    bits = np.frombuffer(b"".join(rows["bits"].to_pylist()), U64).reshape(n, -1)
    label = np.arange(n)
    near = []
    for s in range(1, min(NEIGHBOURS, n - 1) + 1):
        same = (tree[s:] == tree[:-s]) & (values[s:, :SHARED] == values[:-s, :SHARED]).all(1)
        at = np.flatnonzero(same)
        near.append((at[similarity(bits[at], bits[at + s]) >= least], s))
    while True:  # the first row of each chain of links
        before = label.copy()
        for at, s in near:
            low = np.minimum(label[at], label[at + s])
            label[at + s] = low
            label[at] = low
        label = label[label]
        if (label == before).all():
            break
    held = np.flatnonzero(ids != ids[label])
    if len(held):
        yield pa.RecordBatch.from_arrays([pa.array(ids[held]), pa.array(ids[label[held]])], ["a", "b"])


def candidates(signed: DataFrame, least: float = 0.5, hold: int = 200_000) -> DataFrame:
    """Links between documents that may be near copies: a, b.

    The signature is cut into 16 orders of 8 values. In each order the rows are sorted, so
    that neighbours share the longest prefixes, and each row is compared to the next 8 as
    long as they share two values. So the depth adapts to the region: where many rows are
    alike the neighbours share long prefixes, where few are, two values are enough. Rows
    that agree in too few signature bits are not linked. Only a spanning forest of the links
    comes out, at most one per row and order.
    """
    trees = F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)),
        lambda t: F.struct(t.alias("tree"), F.substring("values", t * (2 * DEPTH) + 1, F.lit(2 * DEPTH)).alias("order")),
    )
    rows = signed.select("doc_id", "bits", F.explode(trees).alias("t")).select(
        "t.tree", "t.order", "doc_id", "bits", F.substring("t.order", 1, 2 * SHARED).alias("region")
    )
    dealt = rows.repartition("tree", "region").sortWithinPartitions("tree", "order", "doc_id")
    run = functools.partial(_neighbours, least=least, hold=hold)
    return dealt.drop("region").mapInArrow(run, "a long, b long").distinct()


class _Block:
    """Documents to be linked by their full sets: all with all, or those of side 1 with those of side 2."""

    def __init__(self):
        self.ids, self.texts, self.bits, self.sides, self.key = [], [], [], [], None

    def links(self, percent: int, least: float) -> list[tuple[int, int]]:
        """Pairs that join all documents that are linked within the block or across its sides.

        A pair is compared exactly if its documents are not joined yet and its signature
        does not rule it out.
        """
        n = len(self.ids)
        side = np.array(self.sides)
        if (side == side[0]).all() and side[0]:
            return []
        owners, parts = [], []
        for first, texts in chunks(self.texts):
            owner, hashes = shingle_sets(texts)
            owners.append(owner + first)
            parts.append(hashes)
        distinct, number = np.unique(np.concatenate(parts), return_inverse=True)
        sizes = np.bincount(np.concatenate(owners), minlength=n)
        begin = np.concatenate(([0], np.cumsum(sizes)))
        bits = np.frombuffer(b"".join(self.bits), U64).reshape(n, -1)
        label, found = np.arange(n), []
        mark = np.zeros(len(distinct), bool)
        for i in range(1, n):
            guess = similarity(bits[:i], bits[i])
            fits = 100 * np.minimum(sizes[:i], sizes[i]) >= percent * np.maximum(sizes[:i], sizes[i])
            met = (side[:i] == 0) | (side[:i] != side[i])
            todo = np.flatnonzero((guess >= least) & fits & met & (sizes[:i] > 0) & (label[:i] != label[i]))
            if not len(todo):
                continue
            todo = todo[np.argsort(-guess[todo], kind="stable")]
            mine = number[begin[i] : begin[i + 1]]
            mark[mine] = True
            while len(todo):
                j, todo = todo[0], todo[1:]
                both = int(np.count_nonzero(mark[number[begin[j] : begin[j + 1]]]))
                if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                    found.append((self.ids[i], self.ids[j]))
                    low, high = sorted((label[i], label[j]))
                    label[label == high] = low
                    todo = todo[label[todo] != label[i]]
            mark[mine] = False
        return found


def _confirm(batches: Iterator[pa.RecordBatch], percent: int, least: float) -> Iterator[pa.RecordBatch]:
    def out(block):
        pairs = block.links(percent, least) if len(block.ids) > 1 else []
        if pairs:
            a, b = zip(*pairs)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    block = _Block()
    for batch in batches:
        keys = zip(batch["cluster"].to_pylist(), batch["block"].to_pylist())
        rows = zip(keys, batch["side"].to_pylist(), batch["doc_id"].to_pylist(), as_bytes(batch["text"]), batch["bits"].to_pylist())
        for key, side, doc, text, bits in rows:
            if key != block.key:
                yield from out(block)
                block = _Block()
                block.key = key
            block.sides.append(side)
            block.ids.append(doc)
            block.texts.append(text)
            block.bits.append(bits)
    yield from out(block)


def confirmed(docs: DataFrame, signed: DataFrame, links: DataFrame, percent: int = PERCENT, least: float = 0.4) -> DataFrame:
    """Links with ``100 * intersection >= percent * union`` of the full shingle sets, enough to join all that are linked.

    The candidates' components are the clusters whose texts are brought together. A cluster
    with more than ``BLOCK_SHINGLES`` shingles in all is cut into bands by the size of the
    sets, so that sets that can be linked are in the same band or in neighbouring ones, and
    the bands into blocks. All pairs of blocks of such bands are compared; a pair of blocks
    has about ``BLOCK_SHINGLES`` shingles.
    """
    clusters = components(links).withColumnRenamed("component", "cluster")
    narrow = signed.select("doc_id", "n_shingles", "bits")
    width = max(math.log(100 / percent), 0.01) * 1.0001  # more than the logarithms of linked sizes can differ by
    band = F.floor(F.log("n_shingles") / F.lit(width)).cast("int").alias("band")
    members = clusters.join(narrow, clusters["node"] == narrow["doc_id"]).select("doc_id", "cluster", "n_shingles", "bits", band)
    sizes = members.groupBy("cluster", "band").agg(F.sum("n_shingles").alias("_sum"), F.count("*").alias("_n"))
    parts = F.least(F.ceil(F.col("_sum") * 2 / F.lit(BLOCK_SHINGLES)), F.col("_n")).cast("int")
    shapes = sizes.groupBy("cluster").agg(
        F.sum("_sum").alias("_all"), F.map_from_entries(F.collect_list(F.struct("band", parts.alias("parts")))).alias("_parts")
    )
    placed = members.join(shapes, "cluster").withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.col("_parts")[F.col("band")]).cast("int"))

    def pair(low_band, low, high_band, high, side):
        names = ("low_band", "low", "high_band", "high")
        key = F.struct(*[c.cast("int").alias(n) for n, c in zip(names, (low_band, low, high_band, high))])
        return F.struct(key.alias("block"), side.cast("int").alias("side"))

    own, part, zero = F.col("band"), F.col("_part"), F.lit(0)
    numbers = lambda b: F.when(F.col("_parts")[b].isNull(), F.array().cast("array<int>")).otherwise(
        F.sequence(F.lit(0), F.greatest(F.coalesce(F.col("_parts")[b], F.lit(1)), F.lit(1)) - 1)
    )
    side = lambda p: F.when(p == part, 0).when(part < p, 1).otherwise(2)
    pairs = F.concat(
        F.transform(numbers(own), lambda p: pair(own, F.least(part, p), own, F.greatest(part, p), side(p))),
        F.transform(numbers(own + 1), lambda p: pair(own, part, own + 1, p, F.lit(1))),
        F.transform(numbers(own - 1), lambda p: pair(own - 1, p, own, part, F.lit(2))),
    )
    whole = F.array(pair(zero, zero, zero, zero, zero))
    dealt = placed.select(
        "doc_id", "cluster", "bits", F.explode(F.when(F.col("_all") <= BLOCK_SHINGLES, whole).otherwise(pairs)).alias("_pair")
    ).select("doc_id", "cluster", "bits", "_pair.block", "_pair.side")
    together = dealt.join(docs.select("doc_id", "text"), "doc_id").repartition("cluster", "block")
    run = functools.partial(_confirm, percent=percent, least=least)
    ordered = together.sortWithinPartitions("cluster", "block", "doc_id")
    return ordered.select("cluster", "block", "side", "doc_id", "text", "bits").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Groups of near copies: doc_id, n_shingles, component_id, kept; one row per row of ``docs``.

    Two documents are linked if their sets of 5-word shingles are alike by ``percent``;
    component_id is the smallest doc_id that a document reaches by links, and ``kept`` marks
    the document that has this doc_id. Documents with equal sets go through the search as
    one. NULL, empty and blank texts have no shingles and are linked with nothing, and so
    are rows without a doc_id, which are kept. Rows with the same doc_id count as one
    document that has the shingles of each of them.
    """
    docs = docs.select("doc_id", "text")
    signed = materialize(signatures(docs))
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    first = full.join(classes.select("set_hash", F.col("rep").alias("doc_id")), ["set_hash", "doc_id"], "left_semi")
    links = confirmed(docs, first.dropDuplicates(["doc_id", "set_hash"]), candidates(first), percent)
    copies = full.join(classes.filter("n > 1").drop("n"), "set_hash").filter("doc_id <> rep")
    joined = components(links.unionByName(copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    return (
        signed.select("doc_id", "n_shingles")
        .join(joined, F.col("doc_id") == F.col("node"), "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
