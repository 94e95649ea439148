"""Mixing and packing, the pipeline, and queries with SQL."""

import random
import zlib
from collections import Counter

import corpus as C
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from epistrand.llm import linededup, minhash, mixing, packing, queries, toxicity
from verification.compare import compare, connect

SF = "/root/testdata/sf0.01"


def plain_targets(sizes, share=1.5, weights=(5, 2, 1), most=2.0):
    """Share out by weight, take back what is above the bound, and share that again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, rest = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while rest > 1e-9 and open_:
        unit = rest / sum(weight[s] for s in open_)
        for s in open_:
            target[s] += unit * weight[s]
        rest = 0.0
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                rest += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.remove(s)
    return target


def test_source_targets(spark):
    rng = random.Random(2)
    for _ in range(3):
        sizes = {s: rng.choice([0, 1, 7, 50, 1000, 40_000]) for s in ["b", "a", "Z", "ä", "\U0001f600", "", None, "c1", "c10", "c2"]}
        rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.source_rates(rows).collect()}
        assert got == pytest.approx(plain_targets(sizes))


def test_word_counts(spark):
    got = C.documents(spark).select("text", mixing.word_count(F.col("text")).alias("n")).collect()
    assert all(r.n == len(C.words(r.text)) for r in got)


def test_mix(spark):
    docs = C.documents(spark)
    docs = docs.unionAll(docs.filter("doc_id < 12"))
    counts = mixing.mix_counts(docs).collect()
    assert len(counts) == docs.count()
    assert all(r.taken == r.size * r.copies <= 2 * r.size for r in counts)
    emitted = mixing.mix_documents(docs)
    assert emitted.columns == docs.columns
    want = Counter({d: n for d, n in sum((Counter({r.doc_id: r.copies}) for r in counts), Counter()).items() if n})
    assert Counter(r.doc_id for r in emitted.collect()) == want
    assert mixing.mix_counts(C.empty(spark)).count() == mixing.mix_documents(C.empty(spark)).count() == 0


def test_mix_beyond_the_broadcast_bound(spark, monkeypatch):
    docs = C.documents(spark)
    plain = sorted(map(tuple, mixing.mix_counts(docs).collect()), key=str)
    monkeypatch.setattr(mixing.join_per_key, "__defaults__", (None, -1))
    assert sorted(map(tuple, mixing.mix_counts(docs).collect()), key=str) == plain


def test_tokens_are_those_of_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [r.text for r in C.documents(spark).collect() if r.text] + ["<|endoftext|>", " a<|endoftext|> b  ", "'S 'll  ’s\t\t x"]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    hf = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    fast = packing.encoder(packing.TOKENIZER)
    for text, want in zip(texts, hf.encode_batch(texts, add_special_tokens=False)):
        assert fast.encode_to_numpy(text, allowed_special="all").tolist() == want.ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_tokens_of_any_text(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    hf = HF.setdefault(0, None) or HF.update({0: Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))}) or HF[0]
    got = packing.encoder(packing.TOKENIZER).encode_to_numpy(text, allowed_special="all").tolist()
    assert got == hf.encode(text, add_special_tokens=False).ids


HF: dict = {}


def check_packing(rows, size):
    """Places are gapless from 0, and no sequence is too long."""
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(held)


def test_packing(spark):
    docs = C.documents(spark)
    docs = docs.unionAll(docs.filter("doc_id < 12"))
    pieces = packing.tokenized_pieces(docs)
    rows = packing.pack(pieces).collect()
    fast = packing.encoder(packing.TOKENIZER)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got, want = Counter(), Counter()
    for r in rows:
        got[r.doc_id, r.piece, r.start, tuple(r.ids)] += 1
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
    for d in (r.doc_id for r in docs.collect()):
        ids = fast.encode_to_numpy(texts[d] or "", allowed_special="all").tolist() + [2]
        for piece, (start, n) in enumerate(packing.cut(len(ids), 1024)):
            want[d, piece, start, tuple(ids[start : start + n])] += 1
    assert got == want
    total = sum(r.length for r in rows)
    assert check_packing(rows, 1024) <= -(-total // 1024) + 2
    assert packing.pack(packing.tokenized_pieces(C.empty(spark))).count() == 0


def test_cut():
    assert packing.cut(0, 4) == [(0, 0)] and packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 400), max_size=20))
def test_plans_use_all_pieces_once(counts):
    plan = packing.plan_sequences(counts, 32)
    used = Counter()
    for lengths, times in plan:
        assert sum(lengths) <= 32 and times > 0
        for x in lengths:
            used[x] += times
    assert used == counts
    assert len(plan) <= 4 * 32
    slots = packing.slots(plan)
    for length in counts:
        spans = sorted((lo, hi) for n, lo, hi in zip(slots["length"], slots["low"], slots["high"]) if n == length)
        assert [lo for lo, _ in spans] == [0] + [hi for _, hi in spans[:-1]] and spans[-1][1] == counts[length]


def test_plans_find_exact_complements():
    assert dict(packing.plan_sequences({700: 5, 324: 5}, 1024)) == {(700, 324): 5}
    assert dict(packing.plan_sequences({700: 4, 300: 4, 24: 4, 20: 9}, 1024))[(700, 300, 24)] == 4
    assert (600, 300, 100, 24) in dict(packing.plan_sequences({600: 3, 300: 3, 100: 3, 24: 3, 423: 1}, 1024))
    assert dict(packing.plan_sequences({512: 5}, 1024)) == {(512, 512): 2, (512,): 1}


def test_pack_rejects_impossible_lengths(spark):
    rows = spark.createDataFrame([(1, 0, 9)], "doc_id long, piece int, length long")
    with pytest.raises(ValueError):
        packing.pack(rows, 8)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_sql(spark, name, monkeypatch):
    from verification import compare as module

    monkeypatch.setattr(module, "run", lambda n, s, d: queries.QUERIES[n](s, d))
    monkeypatch.setattr(module.oracle, "SELECTS", {name})
    monkeypatch.setattr(module.oracle, "sql", queries.ORACLE.__getitem__)
    assert compare(name, spark, connect(SF), SF) is None


def test_queries_are_registered():
    found = __spark_entry__.queries()
    assert [f"op{n}_" in " ".join(found) for n in range(1, 14)] == [True] * 13 and "pipeline" in found
    assert set(queries.ORACLE) <= set(__spark_entry__.oracle_sql())


def test_stages(spark, tmp_path):
    """Each stage against its operator on the rows that the stage before it left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        left[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = left[name][1]
        assert name == "best_fit_packing" or docs.columns == columns
    ids = lambda rows: sorted(r.doc_id for r in rows.select("doc_id").collect())

    before, after = left["toxicity"]
    scored = toxicity.classify(before.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(after) == ids(scored.filter("predicted = 0"))
    before, after = left["line_dedup"]
    kept = {r.doc.doc_id: r.kept for r in linededup.dedup_lines(before).collect()}
    assert {r.doc_id: r.text for r in after.collect()} == kept
    assert all(r.n_chars == len(r.text) for r in after.collect())
    before, after = left["minhash_near_dedup"]
    assert ids(after) == ids(minhash.near_duplicates(before).filter("kept"))
    before, after = left["source_mixing"]
    assert Counter(ids(after)) == Counter({r.doc_id: r.copies for r in mixing.mix_counts(before).filter("copies > 0").collect()})
    before, after = left["best_fit_packing"]
    assert sum(r.n for r in after.groupBy("doc_id").agg(F.count_if(F.col("piece") == 0).alias("n")).collect()) == before.count()
    rows = after.collect()
    assert check_packing(rows, 1024) <= 1.01 * sum(r.length for r in rows) / 1024 + 1


def test_pipeline_on_odd_documents(spark, tmp_path):
    """The whole pipeline on rows with NULLs, blanks, copies and more columns than it needs."""
    C.documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i == 13)) for i in range(1, 100, 3)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and check_packing(rows, 1024)
    C.empty(spark).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
