import datetime
import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from epistrand.operators import sequences as Q

START = datetime.date(2020, 1, 1)


def by_hand(data):
    """patid -> (codes, ages)."""
    out = {}
    for patient in sorted({r[0] for r in data}):
        codes, ages = [], []
        days = sorted({r[1] for r in data if r[0] == patient}, key=lambda x: (x is None, x))
        for day in days:
            visit = sorted([r for r in data if r[0] == patient and r[1] == day], key=lambda r: (r[2] is None, r[2] or "", r[3]))
            codes += [r[2] for r in visit] + ["SEP"]
            ages += [r[3] for r in visit] + [min(r[3] for r in visit)]
        out[patient] = (codes, ages)
    return out


def put_together(seqs):
    out = {}
    for r in sorted(seqs.collect(), key=lambda r: getattr(r, "start", 0)):
        codes, ages = out.setdefault(r.patid, ([], []))
        codes += r.code
        ages += r.age
    return out


@pytest.fixture(scope="module")
def data():
    rng = random.Random(1)
    rows_ = []
    for p in range(6):
        for _ in range(rng.choice([1, 5, 40])):
            day = START + datetime.timedelta(days=rng.randrange(4))
            rows_.append((f"p{p}", day, rng.choice(["a", "b", "c", "é", None]), "50"))
    rows_ += [("p1", None, "a", "0"), ("hot", START, "x", "9")]
    # One patient and one day with most of the rows.
    rows_ += [("hot", START, "a", "9")] * 500 + [("hot", START, "b", "9")] * 30
    rows_.append(("twice", START, "a", "8"))
    rows_.append(("twice", START, "a", "7"))
    return rows_


@pytest.fixture(scope="module")
def events(spark, data):
    return spark.createDataFrame(data, "PATIENT_ID string, DATE date, CODE string, AGE string").repartition(5)


def test_sequences_are_one_row_each(events, data):
    seqs = Q.build_sequences(events)
    assert seqs.columns == ["patid", "n_tokens", "n_visits", "code", "age"]
    assert put_together(seqs) == by_hand(data)
    assert seqs.count() == len(by_hand(data))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100, 10**6])
def test_segments_of_any_size(events, data, size):
    seqs = Q.build_sequences(events, size).cache()
    assert put_together(seqs) == by_hand(data)
    expected = by_hand(data)
    for r in seqs.collect():
        codes = expected[r.patid][0]
        assert r.n_tokens == len(codes) and r.n_visits == codes.count("SEP")
        assert r.start % size == 0 and r.visit == codes[: r.start].count("SEP")
        # Every segment but the last one is full.
        assert len(r.code) == len(r.age) == min(size, len(codes) - r.start)


@pytest.mark.parametrize("size", [None, 1, 4, 7, 1000])
@pytest.mark.parametrize("n", [1, 3, 11, 600])
def test_latest_tokens_do_not_depend_on_segments(events, data, size, n):
    got = {r.patid: (r.code, r.age) for r in Q.latest(Q.build_sequences(events, size), n).collect()}
    assert got == {p: (c[-n:], a[-n:]) for p, (c, a) in by_hand(data).items()}


@pytest.mark.parametrize("n", [1, 3, 11, 600])
def test_last_tokens_of_runs(events, data, n):
    counts = Q.count_events(events, "AGE")
    layout = Q.lay_out(Q._days(counts, ["PATIENT_ID"]), ["PATIENT_ID"])
    cut = Q.last_tokens(Q.place(counts, layout, ["PATIENT_ID"]), n)
    got = {r.PATIENT_ID: (r.code, r.age) for r in Q.collect_runs(cut, ["PATIENT_ID"]).collect()}
    assert got == {p: (c[-n:], a[-n:]) for p, (c, a) in by_hand(data).items()}


@pytest.mark.parametrize("size", [None, 2, 5])
def test_visits(events, data, size):
    got = {}
    for r in sorted(Q.build_visits(events, size).collect(), key=lambda r: getattr(r, "start", 0)):
        codes, ages = got.setdefault((r.PATIENT_ID, r.DATE), ([], []))
        codes += r.code
        ages += r.age
    for (patient, day), visit in got.items():
        assert visit == by_hand([r for r in data if r[0] == patient and r[1] == day])[patient]
    assert len(got) == len({(r[0], r[1]) for r in data})


def test_visit_of_one_day(spark):
    day = datetime.date(2020, 1, 1)
    events = spark.createDataFrame([("p", day, "b", "50"), ("p", day, "a", "50")], "PATIENT_ID string, DATE date, CODE string, AGE string")
    (row,) = Q.build_visits(events).collect()
    assert (row.code, row.age) == (["a", "b", "SEP"], ["50", "50", "50"])


def test_result_does_not_depend_on_partitioning(spark, events):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        one = rows(Q.build_sequences(events, 9))
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert rows(Q.build_sequences(events.coalesce(1), 9)) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_filters_and_summaries_with_and_without_segments(events):
    whole, parts = Q.build_sequences(events), Q.build_sequences(events, 7)
    plain = whole.select("patid", "code", "age")
    for n in (2, 6, 20):
        expected = sorted(r.patid for r in plain.collect() if len(r.code) >= n)
        assert sorted(r.patid for r in Q.min_tokens(plain, n).collect()) == expected
        assert sorted({r.patid for r in Q.min_tokens(parts, n).collect()}) == expected
    for n in (1, 3, 4):
        expected = sorted(r.patid for r in plain.collect() if r.code.count("SEP") >= n)
        assert sorted(r.patid for r in Q.min_visits(plain, n).collect()) == expected
        assert sorted({r.patid for r in Q.min_visits(parts, n).collect()}) == expected
    assert rows(Q.sequence_summary(plain)) == rows(Q.sequence_summary(parts)) == rows(Q.sequence_summary(whole))
    assert rows(Q.visit_filter_report(plain, 3)) == rows(Q.visit_filter_report(parts, 3))
    assert rows(Q.longest_sequences(plain, 3)) == rows(Q.longest_sequences(parts, 3))
    assert Q.longest_sequences(plain, 1).first().patid == "hot"


def test_counting_comes_before_the_shuffle(events):
    plan = Q.count_events(events)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan
    assert events.agg(F.count("*")).first()[0] == Q.count_events(events).agg(F.sum("n")).first()[0]
