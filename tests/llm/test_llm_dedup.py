"""Substring, line and near-duplicate operators against plain versions on a small corpus."""

import itertools
import random

import corpus as C
import numpy as np
import pytest
from pyspark.sql import functions as F

from epistrand.llm import linededup, minhash, substrings
from epistrand.llm.components import components
from epistrand.llm.words import BASES, LOWER, Words, chunks, run_hashes

MAX = np.iinfo(np.uint64).max


def plain_repeats(texts):
    """n_words, n_removed and the kept text of each document, window by window."""
    first, held = {}, {d: C.words(t) for d, t in texts}
    for d in sorted(held):
        for i in range(len(held[d]) - 19):
            first.setdefault(tuple(held[d][i : i + 20]), (d, i))
    out = {}
    for d, ws in held.items():
        gone = {j for i in range(len(ws) - 19) if first[tuple(ws[i : i + 20])] != (d, i) for j in range(i, i + 20)}
        out[d] = (len(ws), len(gone), b" ".join(w for j, w in enumerate(ws) if j not in gone).decode())
    return out


def test_words_are_those_of_the_pattern(spark):
    texts = [r.text for r in C.documents(spark).select("text").collect()]
    found = Words([t.encode() if t is not None else None for t in texts])
    assert found.counts.tolist() == [len(C.words(t)) for t in texts]
    flat = [w for t in texts for w in C.words(t)]
    by_hash = {}
    for w, h in zip(flat, found.hashes.tolist()):
        assert by_hash.setdefault(h, w) == w
    assert len(by_hash) == len(set(flat))


def test_hashes_do_not_depend_on_the_place():
    a, b = Words([b"x one two three"]), Words([None, b"", b"zz yy one  two\nthree four"])
    assert a.grams(3)[1][1] == b.grams(3)[1][2]
    assert Words([b"One TWO"], LOWER).hashes.tolist() == Words([b"one two"]).hashes.tolist()
    v = np.arange(5, dtype=np.uint64)
    assert run_hashes(v, np.array([1]), np.array([1]), BASES[0]) != run_hashes(v, np.array([0]), np.array([1]), BASES[0])


def test_chunks_cover_all_texts():
    texts = [b"a" * n for n in (5, 50, 1, 0, 70, 3)]
    found = list(chunks(texts, 40))
    assert [t for _, part in found for t in part] == texts
    assert [f for f, _ in found] == [0, 2, 5]


def test_equal_windows_have_equal_anchors():
    body = " ".join(f"v{i % 13}" for i in range(60)).encode()
    one, two = Words([body]), Words([b"some other words first " + body])
    f1, _, h1 = substrings.anchors(one)
    f2, _, h2 = substrings.anchors(two)
    assert dict(zip((f2 - 4).tolist(), h2.tolist())).items() >= dict(zip(f1.tolist(), h1.tolist())).items()


@pytest.mark.parametrize("shard_bytes", [200_000, 20_000])
def test_substring_dedup(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(substrings, "SHARD_BYTES", shard_bytes)
    docs = C.documents(spark)
    got = {r.doc.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(docs).collect()}
    assert got == plain_repeats([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r[1] for r in got.values()) > 500


def test_merged_sketch_never_falls_short():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 64, 400, dtype=np.uint64, endpoint=False)
    times = np.concatenate((np.ones(300, int), np.full(100, 2)))
    # Each occurrence goes to one of five chunks; a chunk may hold one twice.
    held = [[] for _ in range(5)]
    for h, n in zip(hashes, times):
        for c in rng.integers(0, 5, n):
            held[c].append(h)
    for bits, wrong in ((20, 0), (8, 50)):
        sketches = []
        for part in held:
            found, n = np.unique(np.array(part, np.uint64), return_counts=True)
            sketches.append((substrings.cells_of(found[n == 1], bits), substrings.cells_of(found[n > 1], bits)))
        guess = substrings.estimates(substrings.merge(sketches, bits), substrings.cells_of(hashes, bits), bits)
        assert (guess >= times).all()
        over = int((guess > times).sum())
        assert over == 0 if wrong == 0 else over >= wrong
    assert substrings._unpack([substrings._pack(substrings.cells_of(hashes, 20))]).tolist() == substrings.cells_of(hashes, 20).tolist()


def test_exact_pass_removes_what_the_sketch_says_wrongly(spark, monkeypatch):
    """A narrow sketch estimates windows to be repeated that are not; the result stays the same."""
    monkeypatch.setattr(substrings, "SHARD_BYTES", 50_000)
    docs = C.documents(spark)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    found = Words([t.encode() if t is not None else None for _, t in texts])
    hashes, times = np.unique(substrings.anchors(found)[2], return_counts=True)
    bits = 4
    cells = substrings.cells_of(hashes, bits)
    merged = substrings.merge([(cells[times == 1], cells[times > 1])], bits)
    assert (substrings.estimates(merged, cells, bits)[times == 1] == 2).mean() > 0.5
    got = {r.doc.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(docs, cell_bits=bits).collect()}
    assert got == plain_repeats(texts)


def test_substring_dedup_odd_rows(spark):
    text = " ".join(str(i) for i in range(25))
    rows = spark.createDataFrame([(None, text), (5, text), (5, text), (9, text), (None, None)], "doc_id long, text string")
    got = substrings.remove_repeats(rows).select("doc.doc_id", "n_words", "n_removed").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 25, 0), (5, 25, 0), (5, 25, 0), (9, 25, 25), (None, 0, 0)], key=str)
    assert substrings.remove_repeats(C.empty(spark)).count() == 0


def plain_lines(texts):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    holders = {}
    for d, t in texts:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders.setdefault(key(x), set()).add(d)
    out = {}
    for d, t in texts:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == d]
        out[d] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return out


def test_line_dedup(spark):
    docs = C.documents(spark)
    got = {r.doc.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in linededup.dedup_lines(docs).collect()}
    assert got == plain_lines([(r.doc_id, r.text) for r in docs.collect()])
    assert linededup.dedup_lines(C.empty(spark)).count() == 0


def test_changes_look_few_keys_up(spark, tmp_path):
    """The filter of the first change decides what the second one asks for; the result is the same."""
    rng = random.Random(9)
    shared = [f"a line that some documents share, number {i}" for i in range(20)]
    texts = [(d, "\n".join([f"line {j} of document {d} alone" for j in range(20)] + rng.sample(shared, 1))) for d in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    index = linededup.LineIndex(spark, str(tmp_path / "index"), shards=4)
    for part in (0, 1):
        index.insert(docs.filter(F.col("doc_id") % 2 == part))
    probed = spark.read.parquet(str(tmp_path / "index" / "probed"))
    asked, every = probed.filter("known").count(), probed.count()
    assert 10 < asked < 40 and every > 2000
    assert index.latest_filters().count() == 4 and index.filters.count() == 8
    want = plain_lines(texts)
    for changes in (1, 2, 3):
        got = linededup.dedup_lines(docs, changes).collect()
        assert {r.doc.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in got} == want


def test_line_index_is_reversible(spark, tmp_path):
    """Insert in parts, delete some documents, and compare with an index of what is left."""
    docs = C.documents(spark).select("doc_id", "text")
    all_ = [(r.doc_id, r.text) for r in docs.collect()]
    index = linededup.LineIndex(spark, str(tmp_path / "index"), shards=3)
    index.insert(docs.filter("doc_id % 2 = 0"))
    index.insert(docs.filter("doc_id % 2 = 1"))
    seen = lambda ix, ids: {
        r.doc.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in ix.rewrite(docs.filter(F.col("doc_id").isin(ids))).collect()
    }
    assert seen(index, [d for d, _ in all_]) == plain_lines(all_)
    holders = sorted(d for d, n in plain_lines(all_).items() if n[1])
    smallest = min(d for d, t in all_ if "many documents have" in (t or ""))
    gone = [smallest, holders[-1]]
    index.delete(spark.createDataFrame([(d,) for d in gone], "doc_id long"))
    left = [(d, t) for d, t in all_ if d not in gone]
    index = linededup.LineIndex(spark, str(tmp_path / "index"))  # as another session opens it
    assert index.shards == 3
    assert seen(index, [d for d, _ in left]) == plain_lines(left)
    index.insert(docs.filter(F.col("doc_id").isin(gone)))
    assert seen(index, [d for d, _ in all_]) == plain_lines(all_)
    exact = {r.key: (r.n, r["first"]) for r in index.keys().filter("n > 0").collect()}
    live = {}
    for r in index.live_postings().distinct().collect():
        live.setdefault(bytes(r.key), []).append(r.doc_id)
    assert {bytes(k): v for k, v in exact.items()} == {k: (len(v), min(v)) for k, v in live.items()}


def test_line_index_with_equal_fingerprints(spark, tmp_path):
    """Two lines that the filter cannot tell apart: insert, insert, delete, insert."""
    table, seen, pair = np.zeros((16, linededup.SLOTS), np.uint16), {}, None
    lines = [f"a line with the number {i}" for i in range(20_000)]
    hashes = linededup._hashes([linededup.line_key(x.encode()) for x in lines])
    for line, *place in zip(lines, *linededup.CuckooFilter._places(table, hashes)):
        place = (int(place[0]), *sorted(map(int, place[1:])))
        pair = pair or (place in seen and (seen[place], line)) or None
        seen[place] = line
    one, two = pair
    docs = [(1, one), (2, two), (3, two + "\nsome other line"), (4, two), (5, one)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    index = linededup.LineIndex(spark, str(tmp_path / "index"), shards=1)
    index.insert(frame.filter("doc_id = 1"))
    index.insert(frame.filter("doc_id in (2, 3)"))
    index.delete(frame.filter("doc_id = 1").select("doc_id"))
    index.insert(frame.filter("doc_id in (4, 5)"))
    got = {r.doc.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in index.rewrite(frame.filter("doc_id > 1")).collect()}
    assert got == plain_lines(docs[1:])
    live = {bytes(r.key): (r.n, r["first"]) for r in index.keys().filter("n > 0").collect()}
    key = lambda x: linededup.line_key(x.encode())
    assert live == {key(two): (3, 2), key("some other line"): (1, 3), key(one): (1, 5)}


def test_cuckoo_filter_never_misses_with_equal_fingerprints():
    """Few fingerprints and buckets, tables of several sizes."""
    rng = np.random.default_rng(6)
    every = np.unique((rng.integers(1, 200, 4000).astype(np.uint64) << np.uint64(48)) | rng.integers(0, 1 << 12, 4000).astype(np.uint64))
    filter_, live = linededup.CuckooFilter(), np.zeros(0, np.uint64)
    for size in (20, 200, 900, 60, 700):
        new = rng.choice(np.setdiff1d(every, live), size, replace=False)
        filter_.insert(new)
        live = np.concatenate((live, new))
        assert filter_.contains(live).all()
        gone = rng.choice(live, len(live) // 3, replace=False)
        filter_.delete(gone)
        live = np.setdiff1d(live, gone)
        assert filter_.contains(live).all()
    assert len({len(t) for t in filter_.tables}) > 1


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    held, other = (np.unique(rng.integers(0, MAX, 20_000, np.uint64, True)) for _ in range(2))
    filter_ = linededup.CuckooFilter()
    filter_.insert(held[:15_000])
    filter_.insert(held[15_000:])
    filter_ = linededup.CuckooFilter.load(filter_.dump())
    assert filter_.contains(held).all()
    assert filter_.contains(other).mean() < 0.002
    filter_.delete(held[:500])
    assert filter_.contains(held[500:]).all()
    assert filter_.contains(held[:500]).mean() < 0.05
    assert not linededup.CuckooFilter.load(None).contains(held).any()


def shingles(text, n=5):
    ws = [w.lower() for w in C.words(text)]
    return {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()


def plain_near(texts):
    sets = {d: shingles(t) for d, t in texts}
    links = [
        (a, b) for a, b in itertools.combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    root = C.roots(sets, links)
    return {d: (len(sets[d]), root[d], root[d] == d) for d in sets}


@pytest.mark.parametrize("block", [2_000_000, 700])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
    docs = C.documents(spark, copies=12)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == plain_near([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(not r[2] for r in got.values()) > 10


def test_near_duplicates_at_the_threshold(spark):
    """Of 100 shingles, 75 in common with a union of 100: linked; 74: not."""
    words = [f"q{i}" for i in range(300)]
    texts = [(1, words[:104]), (2, words[:79]), (3, words[150:254]), (4, words[150:228])]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in texts], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_near_duplicates_of_large_clusters(spark, monkeypatch):
    """Variants that match only their original, and long near copies, each cluster being many blocks."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 1000)
    rng = np.random.default_rng(4)
    original = [f"s{i}" for i in range(400)]
    texts = [(50, original)]
    for k in range(30):
        variant = list(original)
        for at in rng.choice(400, 9, replace=False):
            variant[at] = f"v{k}x{at}"
        texts.append((k, variant))
    texts.append((60, original + [f"tail{i}" for i in range(120)]))  # linked across bands of sizes
    long = [f"l{i}" for i in range(20_000)]
    texts += [(70, long), (71, long[:-900] + [f"m{i}" for i in range(900)]), (72, long[:16_000])]
    texts = [(d, " ".join(w)) for d, w in texts]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == plain_near(texts)
    assert sum(r[1] == 0 for r in got.values()) > 25 and [got[d][1] for d in (70, 71, 72)] == [70] * 3


def test_near_duplicates_odd_rows(spark):
    text = "one two three four five six seven"
    rows = [(None, text), (4, text), (4, text), (2, text.upper()), (7, None), (8, ""), (9, "Hi you"), (10, "hi  YOU")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, 3, None, True), (4, 3, 2, False), (4, 3, 2, False), (2, 3, 2, True), (7, 0, 7, True), (8, 0, 8, True), (9, 1, 9, True), (10, 1, 9, False)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert minhash.near_duplicates(C.empty(spark)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    links += [tuple(map(int, rng.integers(1000, 1200, 2))) for _ in range(90)] + [(5, 4), (4, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == C.roots(nodes, [x for x in links if x[0] != x[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
