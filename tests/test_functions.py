import datetime
import math

import pytest
from pyspark.sql import functions as F

from epistrand.functions import arrays as A
from epistrand.functions import scalars as S

DAY = datetime.date


def values(spark, schema, data, column):
    return [r[0] for r in spark.createDataFrame([(d,) for d in data], schema).select(column).collect()]


def test_numbers_are_read_as_written(spark):
    cases = {
        "6.5": 6.5, " 7 ": 7.0, "\t5": 5.0, "+5": 5.0, "5.": 5.0, ".5": 0.5, "1e3": 1000.0, "1_000": 1000.0,
        "inf": math.inf, "-Infinity": -math.inf, "1.5_0": 1.5, "1e400": math.inf,
        "<5": None, "": None, "1.5d": None, "1.5f": None, "0x10": None, "1__0": None, "_1": None, "1_": None,
        "1,000": None, "--5": None, "+ 5": None, "e5": None, ".": None, "POS": None, None: None,
    }
    got = values(spark, "x string", list(cases), S.to_number(F.col("x")))
    assert got == list(cases.values())
    assert all(math.isnan(v) for v in values(spark, "x string", ["nan", "NaN", "-nan"], S.to_number(F.col("x"))))


def test_ages_are_digits_or_zero(spark):
    cases = ["5", "-1", "x", "12.0", "1321", "1322", "99999999999999", "007", "", None]
    assert values(spark, "x string", cases, S.age_number(F.col("x"))) == [5, 0, 0, 0, 1321, 1321, 1321, 7, 0, 0]


def test_dates(spark):
    back = values(spark, "d date", [DAY(2020, 2, 29), DAY(2021, 3, 1)], S.years_before(F.col("d"), 1))
    assert back == [DAY(2019, 2, 28), DAY(2020, 3, 1)]
    df = spark.createDataFrame([(DAY(2019, 12, 31), DAY(2020, 1, 1))], "a date, b date")
    assert df.select(S.calendar_years(F.col("a"), F.col("b"))).first()[0] == 1


def test_sigmoid_and_threshold(spark):
    df = spark.createDataFrame([(0.0,), (3.0,)], "x double").select(S.sigmoid(F.col("x")).alias("p"))
    probs = [r.p for r in df.collect()]
    assert probs == pytest.approx([0.5, 1 / (1 + math.exp(-3))])
    assert [r[0] for r in df.select(S.is_positive(F.col("p"))).collect()] == [0, 1]


def test_strip(spark):
    assert values(spark, "x string", ["\t a b \n"], S.strip_whitespace(F.col("x"))) == ["a b"]
    assert values(spark, "x string", ["DX:a", "LAB:b"], S.event_kind(F.col("x"))) == ["DX", "LAB/VITAL"]


SEQ = ["A", "SEP", "B", "C", "SEP", "D", "PAD"]


def test_positions_and_segments(spark):
    cases = [SEQ, ["SEP", "SEP", "A"], ["A"], ["A", "SEP"], []]
    expected = [[0, 0, 1, 1, 1, 2, 2], [0, 1, 2], [0], [0, 0], []]
    assert values(spark, "x array<string>", cases, A.position_index(F.col("x"))) == expected
    segments = [[p % 2 for p in e] for e in expected]
    assert values(spark, "x array<string>", cases, A.segment_index(F.col("x"))) == segments


def test_tail_pad_and_mask(spark):
    cases = [["a", "b", "c"], ["a"], []]
    assert values(spark, "x array<string>", cases, A.tail(F.col("x"), 2)) == [["b", "c"], ["a"], []]
    assert values(spark, "x array<string>", cases, A.pad_sequence(F.col("x"), 2)) == [["a", "b"], ["a", "PAD"], ["PAD", "PAD"]]
    assert values(spark, "x array<string>", cases, A.attention_mask(F.col("x"), 2)) == [[1, 1], [1, 0], [0, 0]]
    with pytest.raises(ValueError):
        A.tail(F.col("x"), 0)


def test_cls(spark):
    df = spark.createDataFrame(
        [(["B", "SEP"], ["1", "2"]), (["SEP", "B"], ["1", "2"])], "code array<string>, age array<string>"
    )
    got = df.select(A.with_cls(F.col("code")), A.ages_with_cls(F.col("code"), F.col("age"))).collect()
    assert [tuple(r) for r in got] == [(["CLS", "B", "SEP"], ["1", "1", "2"]), (["CLS", "B"], ["1", "2"])]


def test_argmax(spark):
    assert values(spark, "x array<double>", [[0.1, 0.7, 0.7], [-1.0, -2.0]], A.argmax_index(F.col("x"))) == [1, 0]


def test_hashes_do_not_depend_on_partitions(spark):
    ids = spark.range(2000).select(F.col("id").cast("string").alias("id"))
    u = S.hashed_uniform(F.col("id"), F.lit(7)).alias("u")
    one, many = ids.coalesce(1).select("id", u), ids.repartition(16).select("id", u)
    assert one.exceptAll(many).count() == 0
    low, high, mean = one.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= low and high < 1 and abs(mean - 0.5) < 0.03
