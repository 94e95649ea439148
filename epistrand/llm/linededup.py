"""Reversible line deduplication: sharded cuckoo filters in front of exact reference counts.

An index is a folder of Parquet tables, each with one part per change (``v=0``, ``v=1``, ...):

* ``postings``: which document holds which line key;
* ``keys``: the reference count of a key and the smallest document that holds it, written
  whenever they change; the row of the latest change counts;
* ``filters``: the cuckoo filter of a shard of the keys, written whenever it changes;
* ``deleted``: documents taken out.

A change looks only those keys up in ``keys`` that the filter of their shard may hold, so
new lines, which are most of them, cost no look-up. A filter can err by holding a key that
is not there (the look-up then finds nothing), never by missing one: every key
with references has put a fingerprint of its own in, also one that the filter seemed to hold.
A document's deletion lowers the counts, takes keys without references out of the filters, and passes a line on to
the next smallest document that holds it.
"""

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from epistrand.llm.words import U64, as_bytes, mix
from epistrand.operators.bloom import prefilter
from epistrand.sources.store import checkpoint_folder

MIN_CHARS = 10
SHARD_KEYS = 250_000
SLOTS = 4
MAX_KICKS = 200
CHANGES = 2


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; full tables are followed by further ones."""

    def __init__(self, tables: list[np.ndarray] | None = None):
        self.tables = tables or []

    @classmethod
    def load(cls, data: bytes | None) -> "CuckooFilter":
        tables = []
        while data:
            size = int.from_bytes(data[:8], "little")
            tables.append(np.frombuffer(data[8 : 8 + size], np.uint16).reshape(-1, SLOTS).copy())
            data = data[8 + size :]
        return cls(tables)

    def dump(self) -> bytes:
        return b"".join(t.nbytes.to_bytes(8, "little") + t.tobytes() for t in self.tables)

    @staticmethod
    def _places(table, hashes):
        """Fingerprints, and the two buckets each may be in; either follows from the other."""
        marks = np.maximum((hashes >> U64(48)).astype(np.uint16), np.uint16(1))
        last = U64(len(table) - 1)
        first = hashes & last
        return marks, first.astype(np.int64), (first ^ (mix(marks.astype(U64)) & last)).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        found = np.zeros(len(hashes), bool)
        for table in self.tables:
            marks, a, b = self._places(table, hashes)
            found |= (table[a] == marks[:, None]).any(1) | (table[b] == marks[:, None]).any(1)
        return found

    def insert(self, hashes: np.ndarray) -> None:
        """Add hashes of keys that are not in it yet. Equal fingerprints are held as often as they are added."""
        rest = hashes
        if self.tables:
            rest = self._insert(self.tables[-1], rest)
        while len(rest):
            buckets = max(16, 1 << int(len(rest) * 2 // SLOTS - 1).bit_length())
            self.tables.append(np.zeros((buckets, SLOTS), np.uint16))
            rest = self._insert(self.tables[-1], rest)

    def _insert(self, table, hashes):
        marks, a, b = self._places(table, hashes)
        waiting = np.arange(len(hashes))
        for at in (a, b):
            for slot in range(SLOTS):
                free = waiting[table[at[waiting], slot] == 0]
                _, first = np.unique(at[free], return_index=True)
                placed = free[first]
                table[at[placed], slot] = marks[placed]
                waiting = np.setdiff1d(waiting, placed, assume_unique=True)
        left = []
        for n, i in enumerate(waiting.tolist()):
            if not self._kick(table, marks[i], int(a[i]), n):
                left.append(i)
        return hashes[left]

    def _kick(self, table, mark, bucket, turn):
        """Move fingerprints on until one finds a free slot; if none does, put all back."""
        last = len(table) - 1
        moves = []
        for step in range(MAX_KICKS):
            free = np.flatnonzero(table[bucket] == 0)
            if len(free):
                table[bucket, free[0]] = mark
                return True
            slot = (turn + step) % SLOTS
            moves.append((bucket, slot, table[bucket, slot]))
            table[bucket, slot], mark = mark, table[bucket, slot]
            bucket ^= int(mix(np.array([mark], U64))[0]) & last
        for bucket, slot, old in reversed(moves):
            table[bucket, slot] = old
        return False

    def delete(self, hashes: np.ndarray) -> None:
        """Take out hashes that are in it.

        The fingerprint taken may be another key's. In the largest table that has one, that
        key shares both buckets, so it does in the smaller table that holds this key's own.
        """
        tables = sorted(self.tables, key=len, reverse=True)
        for value in hashes:
            one = np.array([value], U64)
            for table in tables:
                marks, a, b = self._places(table, one)
                hit = next(((r, s) for r in (a[0], b[0]) for s in range(SLOTS) if table[r, s] == marks[0]), None)
                if hit:
                    table[hit] = 0
                    break


def line_key(line: bytes) -> bytes | None:
    """Digest of the line without ASCII white space at both ends and in ASCII lower case; None if it is short."""
    import hashlib

    key = line.strip().lower()
    if len(key) < MIN_CHARS or len(key.decode()) < MIN_CHARS:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys = [], []
        for doc, text in zip(batch["doc_id"].to_pylist(), as_bytes(batch["text"])):
            if doc is None or text is None:
                continue
            held = dict.fromkeys(map(line_key, text.split(b"\n")))
            held.pop(None, None)
            ids += [doc] * len(held)
            keys += held
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, dropped, kept = [], [], []
        for text, keys in zip(as_bytes(batch["text"]), batch["_keys"].to_pylist()):
            lines = (text or b"").split(b"\n")
            total.append(len(lines))
            if keys:
                keys = set(keys)
                stay = [x for x in lines if line_key(x) not in keys]
                dropped.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay))
            else:
                dropped.append(0)
                kept.append(text or b"")
        yield pa.RecordBatch.from_arrays(
            [
                *[batch[c] for c in batch.schema.names if c not in ("text", "_keys")],
                pa.array(total, pa.int64()),
                pa.array(dropped, pa.int64()),
                pa.array(kept, pa.binary()).cast(pa.string()),
            ],
            [*[c for c in batch.schema.names if c not in ("text", "_keys")], "n_lines", "n_dropped", "kept"],
        )


def _hashes(keys: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(keys), U64)[::2] if len(keys) else np.zeros(0, U64)


def _held(filters: pd.DataFrame) -> CuckooFilter:
    return CuckooFilter.load(filters["filter"].iloc[filters["v"].argmax()] if len(filters) else None)


PROBED = "shard int, key binary, n long, first long, known boolean"


def _probe(batch: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """Which keys of a shard its filter may hold already."""
    if not len(batch):
        return pd.DataFrame({"shard": [], "key": [], "n": [], "first": [], "known": []})
    return batch[["shard", "key", "n", "first"]].assign(known=_held(filters).contains(_hashes(batch["key"])))


def _remember(new: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if not len(new):
        return pd.DataFrame({"shard": [], "filter": []})
    held = _held(filters)
    held.insert(np.sort(_hashes(new["key"])))
    return pd.DataFrame({"shard": [new["shard"].iloc[0]], "filter": [held.dump()]})


def _forget(gone: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if not len(gone):
        return pd.DataFrame({"shard": [], "filter": []})
    held = _held(filters)
    held.delete(_hashes(gone["key"]))
    return pd.DataFrame({"shard": [gone["shard"].iloc[0]], "filter": [held.dump()]})


class LineIndex:
    """The lines of a set of documents that can grow and shrink.

    Documents need ``doc_id`` and ``text``. A document is inserted once; to replace it,
    delete it first. Rows with the same doc_id count as one document. Rows without a doc_id
    hold no lines: nothing is dropped from them or because of them.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, shards: int = 16):
        """Open the index in ``folder``, or make an empty one (by default in the checkpoint folder).

        About ``SHARD_KEYS`` keys per shard keep a shard's task small; ``shards`` is fixed
        when the index is made.
        """
        self.spark = spark
        self.folder = folder or f"{checkpoint_folder(spark)}/lines-{uuid.uuid4()}"
        self.shards = shards
        self.version = 0
        commits = self._read("commits", "shards int, v int")
        if last := commits.orderBy(F.desc("v")).head(1):
            self.shards, self.version = last[0]["shards"], last[0]["v"] + 1

    def _path(self, table):
        return f"{self.folder}/{table}/v={self.version}"

    def _exists(self, path):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def _read(self, table, schema):
        """All committed parts of a table, with the change ``v`` that wrote them."""
        path = f"{self.folder}/{table}"
        if not self._exists(path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(path)
        return rows if table == "commits" else rows.filter(F.col("v") < self.version)

    def _write(self, df, table):
        df.write.mode("overwrite").parquet(self._path(table))

    def _commit(self):
        self._write(self.spark.range(1).select(F.lit(self.shards).alias("shards")), "commits")
        self.version += 1

    postings = property(lambda self: self._read("postings", "doc_id long, key binary, v int"))
    filters = property(lambda self: self._read("filters", "shard int, filter binary, v int"))
    deleted = property(lambda self: self._read("deleted", "doc_id long, v int"))

    def _shard(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int").alias("shard")

    def keys(self, among: DataFrame | None = None) -> DataFrame:
        """The reference count of each key and the smallest document that holds it.

        With ``among``, a table of keys, only those are taken from the log: a Bloom filter of
        them leaves the others out before anything is shuffled.
        """
        log = self._read("keys", "key binary, n long, first long, v int")
        if among is not None:
            log = prefilter(log, "key", among, "key")
        if self.version < 2:
            return log.select("key", "n", "first")
        return log.groupBy("key").agg(F.max_by(F.struct("n", "first"), "v").alias("s")).select("key", "s.n", "s.first")

    def latest_filters(self) -> DataFrame:
        """The last filter of each shard; those before it are not read."""
        last = self.filters.groupBy("shard").agg(F.max("v").alias("v"))
        return self.filters.join(last, ["shard", "v"])

    def live_postings(self) -> DataFrame:
        """Which document holds which key. A document whose rows repeat may have a key more than once."""
        if not self._exists(f"{self.folder}/deleted"):
            return self.postings.select("doc_id", "key")
        gone = self.deleted.groupBy(F.col("doc_id").alias("_doc")).agg(F.max("v").alias("_v"))
        alive = self.postings.join(gone, F.col("doc_id") == F.col("_doc"), "left")
        return alive.filter(F.col("_v").isNull() | (F.col("v") > F.col("_v"))).select("doc_id", "key")

    def insert(self, docs: DataFrame) -> None:
        found = docs.select("doc_id", "text").mapInArrow(_postings, "doc_id long, key binary")
        self._write(found, "postings")
        held = self.spark.read.parquet(self._path("postings")).distinct()
        batch = held.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
        batch = batch.select(self._shard(), "key", "n", "first")
        if self.version:
            probed = batch.groupBy("shard").cogroup(self.latest_filters().groupBy("shard")).applyInPandas(_probe, PROBED)
            self._write(probed, "probed")
            probed = self.spark.read.parquet(self._path("probed"))
            asked = probed.filter("known")
            before = self.keys(asked).filter("n > 0").select("key", F.col("n").alias("_n"), F.col("first").alias("_first"))
            both = asked.join(before, "key", "left").select(
                "shard",
                "key",
                (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"),
                F.least("first", "_first").alias("first"),
                F.col("_n").isNull().alias("new"),
            )
            batch = probed.filter("not known").drop("known").withColumn("new", F.lit(True)).unionByName(both)
        else:
            batch = batch.withColumn("new", F.lit(True))
        self._write(batch, "counted")
        counted = self.spark.read.parquet(self._path("counted"))
        new = counted.filter("new").select("shard", "key").groupBy("shard").cogroup(self.latest_filters().groupBy("shard"))
        self._write(new.applyInPandas(_remember, "shard int, filter binary"), "filters")
        self._write(counted.select("key", "n", "first"), "keys")
        self._commit()

    def delete(self, doc_ids: DataFrame) -> None:
        """Take documents out again; ``doc_ids`` has a column doc_id."""
        ids = doc_ids.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct()
        live = self.live_postings().distinct()
        self._write(live.join(ids, "doc_id", "left_semi").select("key").distinct(), "touched")
        touched = self.spark.read.parquet(self._path("touched"))
        self._write(ids, "deleted")
        gone = self.spark.read.parquet(self._path("deleted"))
        left = live.join(gone, "doc_id", "left_anti").join(touched, "key", "left_semi")
        counts = left.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
        recounted = touched.join(counts, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"), "first")
        self._write(recounted, "keys")
        empty = self.spark.read.parquet(self._path("keys")).filter("n = 0").select(self._shard(), "key")
        forgot = empty.groupBy("shard").cogroup(self.latest_filters().groupBy("shard"))
        self._write(forgot.applyInPandas(_forget, "shard int, filter binary"), "filters")
        self._commit()

    def repeated(self) -> DataFrame:
        """The keys that each document must lose: doc_id, key."""
        shared = self.keys().filter("n > 1").select("key", "first")
        return self.live_postings().join(shared, "key").filter(F.col("doc_id") > F.col("first")).select("doc_id", "key")

    def rewrite(self, docs: DataFrame) -> DataFrame:
        """All rows of ``docs`` with n_lines, n_dropped and ``kept``, the text that stays.

        Lines are what stands between line feeds; a NULL or empty text is one empty line,
        and its kept text is empty. Other columns of ``docs`` come along in ``doc``.
        """
        lost = self.repeated().groupBy("doc_id").agg(F.collect_set("key").alias("_keys"))
        rows = docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("doc"))
        rows = rows.join(lost, "doc_id", "left").select("doc", "text", "_keys")
        out = StructType([rows.schema["doc"]]).add("n_lines", "long").add("n_dropped", "long").add("kept", "string")
        return rows.mapInArrow(_rewrite, out)


def dedup_lines(docs: DataFrame, changes: int = CHANGES) -> DataFrame:
    """Drop every line whose key is also in a document with a smaller doc_id.

    Builds an index of ``docs`` and applies it to them; see :meth:`LineIndex.rewrite`. The
    documents are inserted in several changes, by a hash of their ids: after the first one,
    the filters tell which of the keys to look up. The result does not depend on ``changes``.
    """
    lines = docs.select(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    index = LineIndex(docs.sparkSession, shards=max(1, -(-lines // SHARD_KEYS)))
    turn = F.pmod(F.xxhash64("doc_id", F.lit("change")), F.lit(changes))
    for n in range(changes):
        index.insert(docs.filter(turn == n))
    return index.rewrite(docs)
