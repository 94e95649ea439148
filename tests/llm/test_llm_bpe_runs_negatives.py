"""BPE by higher-order functions, periodic runs and hard negatives against plain versions."""

import base64
import random
import re
import zlib
from fractions import Fraction

import corpus as C
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from epistrand.llm import bpe, hardnegatives, packing, periodic, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoding():
    import public_tokenizers

    with open(public_tokenizers.path(bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(1)
    texts = ["x" * 1000 + " " * 1000 + "y", "\n" * 997, "-" * 333 + "=" * 77, "\u4f60\u597d\u4e16\u754c" * 30, "a\u0085b\u00a0c\u3000d\x1c\x1de\x0b"]
    texts += ["".join(rng.choice("etaoinshr") for _ in range(300)), "<|endoftext|>", "I'm we'll 'S  don't\t\n x", ""]
    # Letters, numbers and blanks of all planes, some of them newer than Java.
    texts += ["".join(chr(c) for c in range(0x20, 0xD800, 7)), "".join(chr(c) for c in range(0x10000, 0x32000, 5))]
    texts += ["".join(rng.choice("abcde fgh '\n12345.,-_!") for _ in range(rng.randrange(200))) for _ in range(60)]
    return texts


def test_bpe_equals_the_library(spark, encoding):
    texts = odd_texts()
    rows = [(i, t, "r", "ids") for i, t in enumerate(texts)] + [(-1, None, None, None), (0, texts[0], "r", "ids")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc string, ids string")
    docs = docs.unionByName(C.documents(spark).select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit("d").alias("doc"), F.lit("i").alias("ids")))
    want = {r.doc_id: encoding.encode_ordinary(r.text or "") for r in docs.collect()}
    data = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for common in (0, 50):
        got = bpe.encode(docs, common=common)
        assert got.columns == ["doc", "ids"] and got.schema["doc"].dataType.names == ["doc_id", "doc", "ids"]
        ids = F.col("ids")
        found = got.select("doc.doc_id", "ids", bpe.decode(ids).alias("data"), bpe.little_endian(ids).alias("le")).collect()
        assert len(found) == len(rows) + C.documents(spark).count()
        for r in found:
            assert r.ids == want[r.doc_id], r.doc_id
            assert bytes(r.data) == data[r.doc_id]
            assert bytes(r.le) == np.array(r.ids, "<u4").tobytes()
    assert bpe.encode(docs.filter("false")).count() == 0


def test_bpe_of_any_ranks(spark):
    """Vocabularies where a later rank can make an earlier one possible: one by one is not all at once."""
    rng = random.Random(5)
    for _ in range(3):
        ranks = {bytes([i]): i for i in range(256)}
        while len(ranks) < 340:
            a, b = (rng.choice([t for t in ranks if set(t) <= set(b"abc")]) for _ in range(2))
            ranks.setdefault(a + b, rng.randrange(256, 10**6))
        ranks = {t: i for i, t in enumerate(sorted(ranks, key=lambda t: (ranks[t], t)))}
        plain = tiktoken.Encoding("own", pat_str=r"\p{L}+", mergeable_ranks=ranks, special_tokens={})
        texts = ["".join(rng.choice("abc") for _ in range(n)) for n in [1, 2, 3, 5, 8, 13, 20, 24, 25, 26, 40, 80] * 5]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = bpe.encode(docs, bpe.Vocabulary(ranks), r"\p{L}+").select("doc.doc_id", "ids").collect()
        assert {r.doc_id: r.ids for r in got} == {i: plain.encode_ordinary(t) for i, t in enumerate(texts)}


def test_texts_are_not_shuffled(spark):
    plan = bpe.encode(C.documents(spark).select("doc_id", "text"), common=0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1 and "Python" not in plan and "Arrow" not in plan  # the one of the fixture


def test_literals_are_not_in_the_text_of_plans(spark):
    """Spark keeps the text of each plan; with megabytes of literals in it the driver ran out of memory."""
    plan = queries.op13_byte_bpe(spark, SF)._jdf.queryExecution()
    assert len(plan.toString()) < 500_000
    # No row carries the literals: only the projection that uses a literal names it.
    assert not re.search("AS _(little_endian|decode|ranks|pairs|single|held)#", plan.optimizedPlan().toString())


def test_bytes_of_any_ids(spark):
    """Bytes that are no UTF-8 stay; ids that are no token, and NULL, stand for nothing."""
    v = bpe.Vocabulary({bytes([255 - i]): i for i in range(256)} | {b"\xff\x00": 300})
    lists = [list(range(256)) + [300], [256, 299, -1, 301, 7], [], None]
    rows = spark.createDataFrame(list(enumerate(lists)), "doc_id int, ids array<int>")
    want = [bytes(range(255, -1, -1)) + b"\xff\x00", bytes([248]), b"", None]
    packed = [np.array(lists[0], "<u4").tobytes(), np.array([256, 299, 7], "<u4").tobytes(), b"", None]
    by_column = rows.select("doc_id", "ids", bpe.little_endian(F.col("ids"), v).alias("little_endian"), bpe.decode(F.col("ids"), v).alias("decode"))
    for got in (by_column, bpe.with_bytes(rows, v)):
        found = {r.doc_id: r for r in got.collect()}
        assert [found[i].ids for i in range(4)] == lists
        assert [found[i].decode for i in range(4)] == want and [found[i].little_endian for i in range(4)] == packed


def plain_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                out.setdefault((s, i + q - s), q)
            i += i == s
    return sorted((s, n, q) for (s, n), q in out.items())


def test_runs(spark):
    rng = random.Random(3)

    def sequence():
        k, w = rng.choice([1, 2, 2, 3, 5, 50]), []
        while len(w) < rng.randrange(1, 400):
            if rng.random() < 0.5:
                w += [rng.randrange(k) for _ in range(rng.randrange(1, 20))]
            else:
                part = [rng.randrange(k) for _ in range(rng.choice([1, 2, 3, 5, 9, 17, 33, 40, 70]))]
                w += (part * 10)[: rng.randrange(1, 9) * len(part) + rng.randrange(len(part))]
        return w

    for _ in range(60):
        texts = [sequence() for _ in range(rng.randrange(1, 6))] + [[]]
        counts = np.array([len(t) for t in texts])
        want = [(s + int(b), n, q) for t, b in zip(texts, np.cumsum(counts) - counts) for s, n, q in plain_runs(t)]
        assert periodic.find_runs(np.array(sum(texts, []), np.int64), counts) == sorted(want)
    for n, p in ((100_000, 1), (100_000, 3), (99_999, 20_000)):
        words = np.tile(np.random.default_rng(0).integers(0, 10**6, p), n // p + 1)[:n]
        assert periodic.find_runs(words, np.array([n])) == [(0, n, p)]


def test_convolution_is_exact():
    rng = np.random.default_rng(2)
    for size in (1, 2, 4, 8, 16, 32):
        most = int(((periodic.PRIME - 1) / size) ** 0.5)
        blocks, windows = rng.choice([0, most], (50, size)).astype(float), rng.integers(0, most + 1, (50, 2 * size)).astype(float)
        windows[:25, :size] = blocks[:25]
        want = [[int(((b - w[o : o + size]) ** 2).sum()) for o in range(size)] for b, w in zip(blocks, windows)]
        assert periodic.mismatches(blocks, windows).tolist() == want


def test_collapse_and_query(spark, monkeypatch):
    docs = C.documents(spark)
    docs = docs.unionAll(docs.filter("doc_id < 9"))
    got = periodic.collapse_runs(docs).select("doc.doc_id", "n_words", "runs", "collapsed").collect()
    texts = {r.doc_id: C.words(r.text) for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        w = texts[r.doc_id]
        runs = plain_runs(w) if len(w) < 5000 else [tuple(x) for x in r.runs]
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert r.n_words == len(w) and [tuple(x) for x in r.runs] == runs
        assert r.collapsed.encode() == b" ".join(x for i, x in enumerate(w) if i not in gone)
    assert any(r.runs for r in got)
    assert periodic.collapse_runs(C.empty(spark)).count() == 0

    rows = {r.doc_id: r for r in queries.op12_periodic_runs(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w = C.words(r.text)
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 3000:
            continue
        runs = plain_runs(w)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        got = rows.pop(r.doc_id)
        assert (got.n_runs, got.start, got.length, got.period) == (len(runs), *(best or (None,) * 3))
        assert got.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert got.runs_sha256 == C.sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode())
        assert got.collapsed_sha256 == C.sha(b" ".join(x for i, x in enumerate(w) if i not in gone))


def plain_negatives(rows, is_anchor, k=5, scale=256):
    held = {}
    for i, label, x in rows:
        if i is None or label is None or x is None or any(v is None or not np.isfinite(v) for v in x):
            continue
        y = np.zeros(8, object)
        y[: len(x)] = [int(np.floor(np.float64(v) * scale)) for v in x]
        if sum(float(v) ** 2 for v in y) < 2.0**62:
            held[i, label, tuple(y)] = y
    out = []
    for i in sorted({i for i, _, _ in held if is_anchor(i)}):
        label, a = min((l, v) for (j, l, v) in held if j == i)[0], None
        a = next(y for (j, l, _), y in held.items() if j == i and l == label)
        best = {}
        for (j, l, _), y in held.items():
            s = int((a * y).sum())
            if j != i:
                best[j, l] = max(best.get((j, l), -(10**30)), s)
        positives = sorted(((-s, j) for (j, l), s in best.items() if l == label))[:k]
        for s, j in positives:
            fits = sorted((-t, m) for (m, l), t in best.items() if l != label and 80 * -s <= 100 * t <= 100 * -s)[:k]
            out += [(i, j, r, m, -s, -t) for r, (t, m) in enumerate(fits, 1)]
    return sorted(out)


def test_hard_negatives(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        x = rng.normal(size=8)
        x = x + 3 * np.eye(8)[i % 3] if i % 2 else np.round(x, 1)
        rows.append((i, int(rng.integers(0, 3)), [float(v) for v in x]))
    rows += [(1000 + i, i % 2, [0.5] * 8) for i in range(150)]  # a third are one vector
    rows += [rows[3], rows[10], rows[10]]  # repeated rows
    rows += [(2000, 1, [0.0] * 8), (2001, 0, []), (2002, 1, [1.0, 2.0]), (2003, None, [1.0] * 8), (2004, 1, None), (None, 1, [1.0] * 8)]
    rows += [(2005, 1, [float("nan")] * 8), (2006, 1, [None, 1.0]), (2007, 1, [float("inf")]), (2008, 1, [1e30] * 8), (2010, 1, [3e4] * 8)]
    table = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "vec_id long, label int, embedding array<double>, score double, cell string")
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    anchors = F.pmod("vec_id", F.lit(10)) == 0
    monkeypatch.setattr(hardnegatives, "BLOCK_BYTES", 8 * 8 * 64)
    for part in (2048, 7):
        monkeypatch.setattr(hardnegatives, "PART_ANCHORS", part)
        assert sorted(map(tuple, hardnegatives.mine(table, anchors).collect())) == want
    assert len(want) > 300
    assert hardnegatives.mine(table, F.lit(False)).count() == hardnegatives.mine(table.filter("false"), anchors).count() == 0


def test_score_bounds_hold():
    rng = np.random.default_rng(6)
    x = np.floor(rng.normal(size=(300, 6)) * np.exp(rng.normal(size=(300, 1)) * 4) * 256).astype(np.int64)
    x[:50] = x[50] // 3  # nearly parallel
    x[5] = 0
    references = hardnegatives.choose_references(x, 7)
    norms = hardnegatives._norms(x)
    angles = hardnegatives._angles(x, norms, references)
    least, most = hardnegatives.score_bounds(angles, norms, angles, norms)
    exact = x @ x.T
    assert (least <= exact).all() and (exact <= most).all()
    assert ((most - least) < norms[:, None] * norms).mean() > 0.5


@pytest.mark.parametrize("text", [" " * 1_000_000 + "x", "\n" * 5_000_000, "x" * 1_000_000])
def test_packing_takes_very_long_runs(spark, text):
    docs = spark.createDataFrame([(1, text), (2, "a b")], "doc_id long, text string")
    pieces = packing.tokenized_pieces(docs, with_ids=False).collect()
    ids = packing.slow_encoder(packing.TOKENIZER).encode(text, add_special_tokens=False).ids
    assert sum(r.length for r in pieces if r.doc_id == 1) == len(ids) + 1
    first_crc = zlib.crc32(np.array([*ids, packing.END], "<u4")[: packing.cut(len(ids) + 1, 1024)[0][1]].tobytes())
    assert [r.ids_crc32 for r in pieces if r.doc_id == 1 and r.piece == 0] == [first_crc]
