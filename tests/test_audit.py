import datetime

import pytest

from helpers import rows
from epistrand.operators import audit


@pytest.fixture(scope="module")
def events(spark):
    day = datetime.date
    data = [
        ("a", day(2019, 12, 31), "DX:1"), ("a", day(2020, 1, 1), "DX:1"), ("a", day(2020, 1, 1), "LAB:X_BIN_Y_BIN_2"),
        ("b", day(2020, 1, 1), "DX:2"), ("b", None, "DX:1"),
    ]
    return spark.createDataFrame(data, "PATIENT_ID string, DATE date, CODE string")


def test_profiles(events):
    day = datetime.date
    assert rows(audit.patient_profile(events)) == [
        ("a", 3, 2, day(2019, 12, 31), day(2020, 1, 1), 1), ("b", 2, 1, day(2020, 1, 1), day(2020, 1, 1), 0),
    ]
    assert [tuple(r) for r in audit.patient_profile(events, "a").collect()] == rows(audit.patient_profile(events))[:1]
    assert [tuple(r) for r in audit.top_days(events, "a", 1).collect()] == [("a", day(2020, 1, 1), 2)]
    assert rows(audit.top_codes(events, k=1)) == [("a", "DX:1", 2), ("b", "DX:1", 1)]
    assert [tuple(r) for r in audit.top_codes(events, "b", 1).collect()] == [("b", "DX:1", 1)]


def test_summaries(events):
    assert rows(audit.event_kind_summary(events)) == [("DX", 4), ("LAB/VITAL", 1)]
    # The pattern is greedy; codes without it have an empty name.
    assert [tuple(r) for r in audit.bin_summary(events).collect()] == [("", 4), ("X_BIN_Y", 1)]
    assert audit.patients_with_events(events).first().n_patients == 2


def test_leakage(spark, events):
    assert rows(audit.leakage_audit(events, ["DX:1"])) == [("a", 2), ("b", 1)]
    assert [r.DATE.year for r in audit.audit_examples(events, ["DX:1"]).collect()] == [2019, 2020]
    assert [r.CODE for r in audit.audit_examples(events, ["DX:1", "DX:2"], "b").collect()] == ["DX:1", "DX:2"]
    day = datetime.date
    index = spark.createDataFrame([("a", "E", day(2021, 1, 1)), ("a", "F", day(2020, 6, 1))], "PATIENT_ID string, DX string, EARLIEST_DX date")
    assert rows(audit.leakage_examples(events, index, ["DX:2", "LAB:X_BIN_Y_BIN_2"])) == [
        ("a", day(2020, 1, 1), "LAB:X_BIN_Y_BIN_2", day(2020, 6, 1), 2), ("b", day(2020, 1, 1), "DX:2", None, None),
    ]
