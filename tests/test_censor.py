import datetime

import pytest
from pyspark.sql import functions as F

from helpers import rows
from epistrand.operators import censor as C
from epistrand.operators.events import add_age
from epistrand.operators.sequences import build_sequences
from epistrand.plans import horizon_test_sets, patient_sequences


def d(text):
    return datetime.date.fromisoformat(text) if text else None


EVENTS = [
    ("case", "2010-05-01", "DX:a"), ("case", "2015-01-01", "DX:b"), ("case", "2015-01-01", "DX:b"),
    ("case", "2018-06-01", "DX:c"), ("case", None, "DX:n"),
    ("control", "2012-03-03", "DX:a"), ("control", "2019-09-09", "DX:z"), ("control", None, "DX:n"),
    ("undated", "2011-01-01", "DX:a"),
    ("nodemo", "2011-01-01", "DX:a"),
]
INDEX = [("case", "E1", "2017-01-01"), ("case", "E2", "2019-01-01"), ("undated", "E1", None), ("absent", "E1", "2000-01-01")]
DEMO = [("case", 50), ("control", 2), ("undated", None)]


@pytest.fixture(scope="module")
def tables(spark):
    events = spark.createDataFrame([(p, d(t), c) for p, t, c in EVENTS], "PATIENT_ID string, DATE date, CODE string")
    index = spark.createDataFrame([(p, x, d(t)) for p, x, t in INDEX], "PATIENT_ID string, DX string, EARLIEST_DX date")
    demo = spark.createDataFrame(DEMO, "PATIENT_ID string, AGE_AT_END int")
    return events, index, demo


def join_by_hand(index_rows):
    kept = []
    for p, t, c in EVENTS:
        mine = [x for q, x in index_rows if q == p] or [None]
        kept += [(p, d(t), c) for x in mine if x is None or (t is not None and t < x)]
    return sorted(kept, key=lambda r: tuple((v is not None, str(v)) for v in r))


def test_earliest_and_any_row(tables):
    events, index, _ = tables
    earliest = [("case", "2017-01-01"), ("undated", None)]
    assert rows(C.censor_at_index(events, index)) == join_by_hand(earliest)
    every = [(p, t) for p, _, t in INDEX]
    assert rows(C.censor_at_index(events, index, mode="any_row")) == join_by_hand(every)
    with pytest.raises(ValueError):
        C.censor_at_index(events, index, mode="last")


def test_reference_dates(spark, tables):
    events, index, _ = tables
    ids = spark.createDataFrame([("case",), ("control",), ("undated",), ("absent",), ("none",)], "patid string")
    assert rows(C.reference_dates(ids, index, events)) == [
        ("absent", 1, d("2000-01-01")), ("case", 1, d("2017-01-01")), ("control", 0, d("2019-09-09")),
        ("none", 0, None), ("undated", 1, None),
    ]


def test_horizons_are_strict_and_nested(spark, tables):
    events, index, _ = tables
    ids = spark.createDataFrame([("case",), ("control",), ("undated",)], "patid string")
    refs = C.reference_dates(ids, index, events)
    got = C.censor_at_horizon(events, refs, [1, 2, 7])
    assert rows(got) == rows(spark.createDataFrame(
        [
            (1, "case", d("2010-05-01"), "DX:a"), (1, "case", d("2015-01-01"), "DX:b"),
            (1, "case", d("2015-01-01"), "DX:b"), (1, "control", d("2012-03-03"), "DX:a"),
            # The two-year cutoff of the case is 2015-01-01, and that day is not before it.
            (2, "case", d("2010-05-01"), "DX:a"), (2, "control", d("2012-03-03"), "DX:a"),
            # The seven-year cutoff of the case is 2010-01-01, of the control 2012-09-09.
            (7, "control", d("2012-03-03"), "DX:a"),
        ],
        got.schema,
    ))


def test_plans_agree_with_the_operators_one_by_one(spark, tables):
    events, index, demo = tables
    censored = C.censor_at_index(events, index)
    stepwise = build_sequences(add_age(censored, demo))
    planned = patient_sequences(events, index, demo)
    assert rows(planned) == rows(stepwise)
    by_id = {r.patid: r for r in planned.collect()}
    # The undated event comes last; its age counts as 0, as does that of a patient of unknown age.
    assert by_id["control"].code == ["DX:a", "SEP", "DX:z", "SEP", "DX:n", "SEP"]
    assert by_id["control"].age == ["0", "0", "2", "2", "0", "0"]
    assert by_id["case"].code == ["DX:a", "SEP", "DX:b", "DX:b", "SEP"]
    assert by_id["case"].age == ["45", "45", "50", "50", "50"]
    assert by_id["undated"].age == ["0", "0"]
    assert "nodemo" not in by_id
    with pytest.raises(Exception, match="several demographic rows of patient case"):
        patient_sequences(events, index, demo.union(demo.filter("PATIENT_ID = 'case'"))).collect()

    test = spark.createDataFrame([("case", 1), ("control", 0), ("undated", 1), ("nodemo", 0)], "patid string, label int")
    sets = horizon_test_sets(censored, demo, index, test, [1, 2])
    refs = C.reference_dates(test, index, censored)
    aged = add_age(censored, demo.filter(F.col("AGE_AT_END").isNotNull()))
    by_hand = build_sequences(C.censor_at_horizon(aged, refs, [1, 2]), by=("years",)).join(test, "patid")
    columns = ["years", "patid", "label", "n_tokens", "n_visits", "code", "age"]
    assert rows(sets.select(columns)) == rows(by_hand.select(columns))
    assert sets.count() == 4
