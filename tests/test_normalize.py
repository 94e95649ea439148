import datetime
import math

import pytest

from helpers import rows
from epistrand.operators import normalize as N
from epistrand.schemas import BIN_EDGES

DAY = datetime.date(2020, 1, 1)


def binned(spark, data, thresholds=BIN_EDGES):
    df = spark.createDataFrame([("p", DAY, n, v) for n, v in data], "PATIENT_ID string, DATE date, TEST_NAME string, TEST_VALUE double")
    return sorted((r.TEST_NAME, r.BINNED_VALUE) for r in N.bin_values(df, thresholds).collect())


def test_bins_are_closed_below(spark):
    for value, label in [(6.5, "BIN_3"), (math.nan, "BIN_3"), (1.0, "BIN_1"), (5.7, "BIN_2"), (6.4999, "BIN_2"), (math.inf, "BIN_3")]:
        assert binned(spark, [("HGB A1C", value), ("UNLISTED", value)]) == [("HGB A1C", label)]
    assert binned(spark, [("ALT(SGPT)", 735.0), ("m_Bilirubin.direct", 0.2)]) == [
        ("ALT(SGPT)", "BIN_6"), ("m_Bilirubin.direct", "BIN_1"),
    ]


def test_edges_must_ascend(spark):
    with pytest.raises(ValueError):
        N.threshold_table(spark, {"x": [2, 1]})
    assert N.threshold_table(spark).count() == 34


def test_measurements(spark):
    labs = spark.createDataFrame([("p", DAY, " INR ", "<5"), ("p", DAY, "\tINR", "2")], "PATIENT_ID string, Shifted_date date, LAB_NAME string, RESULT string")
    assert [(r.TEST_NAME, r.TEST_VALUE) for r in N.labs_to_measurements(labs).collect()] == [("INR", None), ("\tINR", 2.0)]
    vitals = spark.createDataFrame([("p", DAY, " VITALS:7 ", "3")], "PATIENT_ID string, Shifted_date date, VITAL_CODE string, MEASUREMENT string")
    assert [(r.TEST_NAME, r.TEST_VALUE) for r in N.vitals_to_measurements(vitals).collect()] == [("VITAL_7_MEAN", 3.0)]


CROSSWALK = [
    ("A", "1"), ("a2", "1"), (" a3\t", "1"),  # a2 and a3 are other names of A
    ("B", "2"), ("B", "3"), ("b2", "2"),  # B has two codes: never canonical, reported
    ("C", "4"), ("c2", "4"), ("c2", "5"),  # c2 has two codes: no synonym, reported
    ("D", "6"), ("E", "6"), ("x", "6"),  # two canonical names share a code
    ("F", None),
]


def test_synonyms(spark):
    crosswalk = spark.createDataFrame(CROSSWALK, "SUNQUEST_NAME string, LOINC_CODE string")
    canonical = ("A", "B", "C", "D", "E", "F", "G")
    assert rows(N.synonym_map(crosswalk, canonical)) == [
        ("D", "E"), ("E", "D"), ("a2", "A"), ("a3", "A"), ("x", "E"),
    ]
    assert rows(N.ambiguous_names(crosswalk, canonical)) == [("B", ["2", "3"]), ("c2", ["4", "5"])]


def test_discretize(spark):
    labs = spark.createDataFrame([("p", DAY, "a2", "6"), ("p", DAY, "A", "nope"), ("p", DAY, "z", "1")], "PATIENT_ID string, Shifted_date date, LAB_NAME string, RESULT string")
    vitals = spark.createDataFrame([("q", DAY, "VITALS:7", "3")], "PATIENT_ID string, Shifted_date date, VITAL_CODE string, MEASUREMENT string")
    crosswalk = spark.createDataFrame(CROSSWALK, "SUNQUEST_NAME string, LOINC_CODE string")
    got = N.discretize(labs, vitals, crosswalk, {"A": [5, 6], "VITAL_7_MEAN": [4]})
    assert rows(got) == [("p", DAY, "LAB:A_BIN_3"), ("q", DAY, "LAB:VITAL_7_MEAN_BIN_1")]
