import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from epistrand.operators import encode as E
from epistrand.operators import sequences as S
from epistrand.operators import vocab as V

SPECIAL = ["PAD", "UNK", "CLS", "SEP", "MASK"]


def make_sequences():
    rng = random.Random(2)
    out = []
    for p in range(40):
        code, age = [], []
        for v in range(rng.choice([1, 3, 9])):
            tokens = [rng.choice(["a", "b", "c", "MASK", "new"]) for _ in range(rng.choice([0, 1, 4]))] + ["SEP"]
            code += tokens
            age += [str(50 + v)] * len(tokens)
        out.append((f"p{p}", code, age, p % 2))
    out.append(("odd", ["a", "SEP"], ["-1", "x"], 0))
    return out


SEQS = make_sequences()


@pytest.fixture(scope="module")
def seqs(spark):
    return spark.createDataFrame(SEQS, "patid string, code array<string>, age array<string>, label int")


@pytest.fixture(scope="module")
def vocab(spark):
    return V.build_vocab(spark.createDataFrame([(["b", "a", "c", "SEP", "zz", None],)], "code array<string>")).cache()


IDS = {t: i for i, t in enumerate(SPECIAL + ["a", "b", "c", "zz"])}


def by_id(df):
    return {r.patid: tuple(r) for r in df.collect()}


def test_vocab(spark, vocab):
    assert {r.token: r.idx for r in vocab.collect()} == IDS
    assert rows(V.invert_vocab(vocab))[0] == (0, "PAD")
    empty = V.build_vocab(spark.createDataFrame([([],)], "code array<string>"))
    assert {r.token: r.idx for r in empty.collect()} == {t: i for i, t in enumerate(SPECIAL)}


def test_age_vocab(spark):
    ages = {r.token: r.idx for r in V.age_vocab(spark, 110).collect()}
    assert len(ages) == 1322 and ages["PAD"] == 0 and ages["0"] == 2 and ages["1319"] == 1321
    years = {r.token: r.idx for r in V.age_vocab(spark, 110, 12, ["PAD", "UNK", "CLS"]).collect()}
    assert len(years) == 113 and years["0"] == 3
    with pytest.raises(ValueError):
        V.age_vocab(spark, 110, 2)


# What becomes of two sequences by hand. Ids: CLS 2, SEP 3, a 5, b 6, c 7; an age is its number plus 2.
HAND = [
    ("p", 1, ["a", "SEP", "b", "c", "SEP"], ["50", "50", "51", "51", "51"]),
    ("odd", 1, ["new", "SEP"], ["-1", "x"]),
]


@pytest.fixture(scope="module")
def hand(spark):
    return spark.createDataFrame(HAND, "patid string, years int, code array<string>, age array<string>")


UNMASKED = {
    # Three tokens and CLS in front.
    4: {
        "p": ([53, 53, 53, 53], [2, 6, 7, 3], [0, 0, 0, 0], [0, 0, 0, 0], [1, 1, 1, 1]),
        "odd": ([1, 1, 1, 0], [2, 1, 3, 0], [0, 0, 0, 1], [0, 0, 0, 1], [1, 1, 1, 0]),
    },
    # The separator in front gives way to CLS.
    5: {
        "p": ([52, 53, 53, 53, 0], [2, 6, 7, 3, 0], [0, 0, 0, 0, 1], [0, 0, 0, 0, 1], [1, 1, 1, 1, 0]),
        "odd": ([1, 1, 1, 0, 0], [2, 1, 3, 0, 0], [0, 0, 0, 1, 1], [0, 0, 0, 1, 1], [1, 1, 1, 0, 0]),
    },
    8: {
        "p": (
            [52, 52, 52, 53, 53, 53, 0, 0], [2, 5, 3, 6, 7, 3, 0, 0], [0, 0, 0, 1, 1, 1, 2, 2],
            [0, 0, 0, 1, 1, 1, 0, 0], [1, 1, 1, 1, 1, 1, 0, 0],
        ),
        "odd": (
            [1, 1, 1, 0, 0, 0, 0, 0], [2, 1, 3, 0, 0, 0, 0, 0], [0, 0, 0, 1, 1, 1, 1, 1],
            [0, 0, 0, 1, 1, 1, 1, 1], [1, 1, 1, 0, 0, 0, 0, 0],
        ),
    },
}


@pytest.mark.parametrize("n", [4, 5, 8])
def test_mlm_examples(spark, hand, vocab, n):
    """All arrays but the masked ids are known; a masked id has its true id as label."""
    for r in E.encode_mlm(hand, vocab, V.age_vocab(spark, 110), n, seed=7).collect():
        age, code, position, segment, mask = UNMASKED[n][r.patid]
        assert (r.years, r.age, r.position, r.segment, r["mask"]) == (1, age, position, segment, mask)
        assert len(r.code) == len(r.label) == n
        for true, given, label, real in zip(code, r.code, r.label, mask):
            assert label in ((-1, true) if real else (-1,))
            assert given == true or label == true


def test_next_visit_examples(spark, hand, vocab):
    labelled = hand.withColumn("label", F.slice("code", 1, 3))
    labels = V.build_vocab(spark.createDataFrame([(["c", "new"],)], "code array<string>"))
    got = {r.patid: r for r in E.encode_next_visit(labelled, vocab, labels, V.age_vocab(spark, 110), 8).collect()}
    for p, want in UNMASKED[8].items():
        assert (got[p].age, got[p].code, got[p].position, got[p].segment, got[p]["mask"]) == want
    # Of the label vocabulary: SEP 3, c 5, new 6; a and b are unknown.
    assert got["p"].label == [1, 3, 1, -1, -1, -1, -1, -1] and got["odd"].label == [6, 3, -1, -1, -1, -1, -1, -1]


def test_classifier_examples(hand, vocab):
    df = E.encode_classifier(hand, vocab, 4)
    assert df.columns == ["patid", "years", "input_ids", "age_ids", "seg_ids", "attention_mask"]
    assert by_id(df) == {
        "p": ("p", 1, [3, 6, 7, 3], [50, 51, 51, 51], [0, 1, 1, 1], [1, 1, 1, 1]),
        "odd": ("odd", 1, [0, 3, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0], [1, 1, 0, 0]),
    }
    got = by_id(E.encode_classifier(hand.drop("age"), vocab, 8))
    assert got["p"] == ("p", 1, [5, 3, 6, 7, 3, 0, 0, 0], [0] * 8, [0, 0, 1, 1, 1, 0, 0, 0], [1, 1, 1, 1, 1, 0, 0, 0])


def test_several_sequences_of_one_patient(spark, hand, vocab):
    """Keys tell them apart; where tokens are joined, equal keys fail."""
    ages = V.age_vocab(spark, 110)
    twice = hand.unionByName(hand.withColumns({"years": F.lit(5), "code": F.slice("code", 1, 2), "age": F.slice("age", 1, 2)}))
    got = {(r.patid, r.years): r.code for r in E.encode_mlm(twice, vocab, ages, 6, seed=1).collect()}
    assert len(got) == 4 and all(len(c) == 6 for c in got.values())
    values = twice.select("patid", "years", F.array(F.array(F.col("years") * 1.0), F.array(F.lit(2.0), F.lit(0.5))).alias("values"))
    found = E.attributions_by_code(twice.filter("patid = 'p'"), values, 2)
    assert rows(found) == [("p", 1, 0, "c", 1.0), ("p", 1, 1, "SEP", 2.5), ("p", 5, 0, "a", 5.0), ("p", 5, 1, "SEP", 2.5)]
    same = twice.drop("years")
    assert len(E.encode_mlm(same, vocab, ages, 6).collect()) == 4
    for clash in (E.encode_mlm(same, vocab, ages, 6, max_bytes=-1), E.tokens_to_ids(same.drop("age"), vocab, max_bytes=-1)):
        with pytest.raises(Exception, match="several rows with the same patid"):
            clash.collect()


def test_segments_change_no_example(spark, seqs, vocab):
    whole = seqs.withColumns({"n_tokens": F.size("code").cast("long"), "n_visits": F.lit(1)})
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("code") - 1, F.lit(0)), F.lit(3))).alias("start")
    cut = whole.select("*", starts).withColumns({c: F.slice(c, F.col("start") + 1, 3) for c in ("code", "age")})
    ages = V.age_vocab(spark, 110)
    assert rows(E.encode_mlm(cut, vocab, ages, 8)) == rows(E.encode_mlm(whole, vocab, ages, 8))
    assert rows(E.encode_classifier(cut, vocab, 5)) == rows(E.encode_classifier(whole, vocab, 5))
    masked = {}
    for r in sorted(E.mlm_mask(cut.select("patid", "start", "code"), vocab).collect(), key=lambda r: r.start):
        masked[r.patid] = masked.get(r.patid, []) + r.code
    assert masked == {r.patid: r.code for r in E.mlm_mask(whole.select("patid", "code"), vocab).collect()}


def test_masking_rates(spark, vocab):
    tokens = spark.range(300).select(F.col("id").cast("string").alias("patid"), F.array_repeat(F.lit("a"), 100).alias("code"))
    masked = E.mlm_mask(tokens, vocab, seed=1)
    long = masked.select(F.explode(F.arrays_zip("code", "label")).alias("x")).select("x.*")
    chosen_one, token = F.col("label") != -1, F.col("code")
    total, chosen, to_mask, kept, bad = long.agg(
        F.count("*"), F.count_if(chosen_one), F.count_if(chosen_one & (token == 4)),
        F.count_if(chosen_one & (token == IDS["a"])), F.count_if(~chosen_one & (token != IDS["a"])),
    ).first()
    assert total == 30000 and bad == 0
    assert abs(chosen / total - 0.15) < 0.01
    # A ninth of the random ids is MASK, and a ninth the token itself.
    assert abs(to_mask / chosen - (0.8 + 0.1 / 9)) < 0.03 and abs(kept / chosen - (0.1 + 0.1 / 9)) < 0.03


def test_lookups(seqs, vocab):
    got = by_id(E.tokens_to_ids(seqs.select("patid", "code"), vocab, mask_token="a"))
    assert got == {p: (p, [1 if t == "a" else IDS.get(t, 1) for t in c]) for p, c, _, _ in SEQS}
    got = by_id(E.pad_to_ids(seqs.select("patid", "code"), vocab, 5, unknown=False))
    assert got == {p: (p, [IDS.get(t) for t in (c + ["PAD"] * 5)[:5]]) for p, c, _, _ in SEQS}


def test_large_vocabularies_are_joined_by_shuffle(spark, seqs, vocab):
    """Equal results whether tokens are looked up inside the arrays or by a join."""
    ages = V.age_vocab(spark, 110)
    labels = V.build_vocab(spark.createDataFrame([(["a", "b"],)], "code array<string>"))
    plain, tagged = seqs.select("patid", "code"), seqs.withColumn("label", F.slice("code", 1, 2))
    for encode in (
        lambda **m: E.encode_mlm(seqs, vocab, ages, 8, **m),
        lambda **m: E.encode_next_visit(tagged, vocab, labels, ages, 8, **m),
        lambda **m: E.encode_classifier(seqs, vocab, 8, **m),
        lambda **m: E.mlm_mask(plain, vocab, **m),
        lambda **m: E.tokens_to_ids(plain, vocab, out="ids", mask_token="b", unknown=False, **m),
        lambda **m: E.pad_to_ids(plain, vocab, 5, **m),
    ):
        inside, joined = encode(), encode(max_bytes=-1)
        assert inside.columns == joined.columns
        assert by_id(inside) == by_id(joined)
        assert "Exchange" in outside_subqueries(joined)
        assert "Exchange" not in outside_subqueries(inside)


def outside_subqueries(df):
    """The physical plan without the plans of its scalar subqueries."""
    plan = df._jdf.queryExecution().sparkPlan()
    todo, names = [plan], []
    while todo:
        node = todo.pop()
        names.append(node.nodeName())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return "Exchange" if any("Join" in n or "Aggregate" in n or "Exchange" in n for n in names) else " ".join(names)


def test_empty_vocabulary_and_odd_tokens(spark):
    none = V.build_vocab(spark.createDataFrame([], "code array<string>")).filter("false")
    odd = spark.createDataFrame([("p", ["a", None, ""]), ("q", []), ("r", None)], "patid string, code array<string>")
    assert by_id(E.tokens_to_ids(odd, none)) == {"p": ("p", [1, 1, 1]), "q": ("q", []), "r": ("r", None)}
    ids = spark.createDataFrame([("", 7), (None, 8)], "token string, idx int")
    assert by_id(E.tokens_to_ids(odd, ids, unknown=False))["p"] == ("p", [None, None, 7])


def test_tails_encode_as_whole_sequences(spark, vocab):
    """Runs are cut before they are collected; examples stay the same, and no array is longer than one."""
    days = [(f"p{i}", d, f"{'abc'[(i * d) % 3]}", str(40 + d), n) for i in range(6) for d in range(1 + 3 * i) for n in [1 + (i + d) % 4]]
    counts = spark.createDataFrame(days, "PATIENT_ID string, day int, CODE string, AGE string, n long")
    per_day = counts.groupBy("PATIENT_ID", "day").agg(F.sum("n").alias("n_day"), F.min("AGE").alias("sep_age"))
    runs = S.place(counts, S.lay_out(per_day, ["PATIENT_ID"]), ["PATIENT_ID"])
    whole = S.collect_runs(runs, ["PATIENT_ID"]).withColumnRenamed("PATIENT_ID", "patid")
    ages = V.age_vocab(spark, 110)
    for n in (1, 2, 5, 12, 200):
        tails = S.collect_tails(runs, ["PATIENT_ID"], n)
        assert all(len(r.code) == len(r.age) == min(n, r.n_tokens) for r in tails.collect())
        assert rows(E.encode_classifier_tails(runs, ["PATIENT_ID"], vocab, n)) == rows(E.encode_classifier(whole, vocab, n))
        if n > 1:
            assert rows(E.encode_mlm_tails(runs, ["PATIENT_ID"], vocab, ages, n)) == rows(E.encode_mlm(whole, vocab, ages, n))


def test_aligned_tokens_and_attributions(spark, seqs):
    got = by_id(E.aligned_tokens(seqs.select("patid", "code"), 5))
    assert got == {p: (p, (c[-5:] + ["PAD"] * 5)[:5]) for p, c, _, _ in SEQS}
    one = spark.createDataFrame([("p", ["a", "SEP"])], "patid string, code array<string>")
    values = spark.createDataFrame([("p", [[1.0, 2.0], [0.5, -1.0], [0.0, 0.25]])], "patid string, values array<array<double>>")
    assert rows(E.attributions_by_code(one, values, 3)) == [("p", 0, "a", 3.0), ("p", 1, "SEP", -0.5), ("p", 2, "PAD", 0.25)]
