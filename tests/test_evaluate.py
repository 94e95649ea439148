import math
import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from epistrand.operators import evaluate as K


def frame(spark, data):
    return spark.createDataFrame(data, "horizon string, label int, prob double")


def auc_by_hand(pairs):
    wins = n = 0
    for l1, p1 in pairs:
        for l0, p0 in pairs:
            if l1 == 1 and l0 == 0:
                n += 1
                wins += 1 if p1 > p0 else 0.5 if p1 == p0 else 0
    return wins / n


def test_auc_with_ties(spark):
    got = K.roc_auc(frame(spark, [("h", 0, 0.1), ("h", 1, 0.5), ("h", 0, 0.5), ("h", 1, 0.9)])).collect()
    assert [tuple(r) for r in got] == [("h", 0.875)]


def test_auc_of_all_sorts_of_scores(spark):
    rng = random.Random(4)
    groups = {
        "uniform": lambda: rng.random(),
        "near zero": lambda: rng.random() * 10 ** -rng.randrange(5, 300),
        "near one": lambda: 1 - rng.randrange(50) * 2.0**-50,
        "signed": lambda: rng.choice([-1, 0, 1]) * rng.choice([0.0, 1.0, 2.0, 3.999999, 0.25 + 2**-40, 0.25, 5e-324]),
        "powers": lambda: 2.0 ** rng.randrange(-20, 1) * rng.choice([1, 1 - 2**-53]),
    }
    data = [(g, rng.randrange(2), make()) for g, make in groups.items() for _ in range(150)]
    got = {r.horizon: r.roc_auc for r in K.roc_auc(frame(spark, data)).collect()}
    for g in groups:
        assert got[g] == pytest.approx(auc_by_hand([(l, p) for h, l, p in data if h == g]), abs=1e-12), g


def test_metrics_and_empty_denominators(spark):
    data = [("mixed", 0, 0.5), ("mixed", 0, 0.6), ("mixed", 1, 0.7), ("mixed", 1, 0.2), ("mixed", 1, 0.9)]
    data += [("no positive", 0, 0.1), ("no negative", 1, 0.9), ("none predicted", 0, 0.1), ("none predicted", 1, 0.1)]
    preds = frame(spark, data)
    assert rows(K.confusion(preds)) == [
        ("mixed", 1, 1, 1, 2), ("no negative", 0, 0, 0, 1), ("no positive", 1, 0, 0, 0), ("none predicted", 1, 0, 1, 0),
    ]
    metrics = {r.horizon: tuple(r)[1:] for r in K.binary_metrics(preds).collect()}
    assert metrics["mixed"] == pytest.approx((2 / 3, 2 / 3, 2 / 3, 1 / 2))
    assert metrics["no positive"] == (0.0, 0.0, 0.0, 1.0)
    assert metrics["no negative"] == (1.0, 1.0, 1.0, None)
    assert metrics["none predicted"] == (0.0, 0.0, 0.0, 1.0)
    assert [r.horizon for r in K.single_class_groups(preds).orderBy("horizon").collect()] == ["no negative", "no positive"]
    table = {r.horizon: r for r in K.metrics_by_horizon(preds).collect()}
    assert sorted(table) == ["mixed", "none predicted"]
    assert table["none predicted"].roc_auc == 0.5 and table["mixed"].n_patients == 5
    assert K.roc_auc(preds).filter("horizon = 'no positive'").first().roc_auc is None


def smooth_by_hand(values, w):
    out, last = [], values[0]
    for v in values:
        last = last * w + (1 - w) * v
        out.append(last)
    return out


@pytest.mark.parametrize("w", [0.9, 0.999, 0.05])
def test_smoothing(spark, w):
    rng = random.Random(5)
    series = {"short": [1.0, 2.0, 3.0], "long": [rng.uniform(-5, 100) for _ in range(4321)], "one": [7.0]}
    data = [(k, 10 + 3 * i, v) for k, values in series.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "run string, step long, loss double").repartition(8)
    got = {}
    for r in sorted(K.smooth(df, "run", "step", "loss", w).collect(), key=lambda r: r.step):
        got.setdefault(r.run, []).append(r.smoothed)
    for k, values in series.items():
        assert got[k] == pytest.approx(smooth_by_hand(values, w), rel=1e-11, abs=1e-11)
    if w == 0.9:
        assert got["short"] == pytest.approx([1, 1.1, 1.29])


def test_smoothing_needs_a_weight_between_0_and_1(spark):
    with pytest.raises(ValueError):
        K.smooth(spark.range(1), "id", "id", "id", 1.0)


def test_masked_precision(spark):
    df = spark.createDataFrame([(1, [0.1, 0.9]), (0, [0.1, 0.9]), (-1, [0.9, 0.1])], "label int, scores array<double>")
    assert K.masked_precision(df).first().precision == 0.5
    assert K.masked_precision(df.withColumn("pred", F.lit(0))).first().precision == 0.5


def test_steps_and_epochs(spark):
    log = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.1), (0, 201, 0.7), (1, 1, 0.9)], "epoch int, cnt int, precision double")
    kept = K.global_steps(log, 250)
    assert rows(kept.select("epoch", "cnt", "global_step")) == [(0, 1, 1), (0, 201, 201), (1, 1, 251)]
    assert rows(K.epoch_precision(kept)) == [(0, 0.6), (1, 0.9)]


def test_attributions(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", -3.0), ("SEP", 9.0), ("PAD", 9.0), ("b", 0.5), ("c", 2.0)], "code string, value double"
    )
    summary = K.attribution_summary(df)
    assert rows(summary) == [("a", -1.0, 2.0, 2), ("b", 0.5, 0.5, 1), ("c", 2.0, 2.0, 1)]
    assert [r.code for r in K.top_attributions(summary, 2).collect()] == ["c", "a"]


def test_scorer_is_loaded_once_per_task(spark):
    df = spark.createDataFrame([(str(i), i % 2, [float(i)]) for i in range(10)], "patid string, label int, x array<double>").repartition(2)

    def scorer():
        return lambda batch: batch["x"].map(lambda v: v[0] - 5)

    got = {r.patid: r for r in K.score(df, scorer, ["patid", "label"]).collect()}
    assert got["5"].pred == 0 and got["6"].pred == 1 and got["6"].label == 0
    assert got["7"].prob == pytest.approx(1 / (1 + math.exp(-2)))


def test_rows_without_score_or_label_count_nowhere(spark):
    data = [(None, 1, 0.9), (None, 0, 0.2), (None, 1, float("nan")), (None, None, 0.7), ("x", 1, None), ("x", 0, 0.4), ("x", 1, 0.3)]
    preds = spark.createDataFrame(data, "horizon string, label int, prob double")
    got = {r.horizon: tuple(r)[1:] for r in K.metrics_by_horizon(preds).collect()}
    assert got == {None: (2, 1, 1, 1.0, 1.0, 1.0, 1.0, 1.0), "x": (2, 1, 1, 0.0, 0.0, 0.0, 0.0, 1.0)}
    assert rows(K.class_counts(preds)) == [(None, 2, 1, 1), ("x", 2, 1, 1)]


@pytest.mark.parametrize("fold", [2, 1000])
def test_smoothing_forgets_nothing(spark, monkeypatch, fold):
    """Gaps in the order, a NULL key, a NaN, an infinity and a huge first value."""
    monkeypatch.setattr(K, "FOLD", fold)
    nan, inf = float("nan"), float("inf")
    series = {None: [1.0, 2.0, 4.0], "nan": [1.0, nan] + [1.0] * 2500, "inf": [inf] + [1.0] * 9000, "big": [1e150] + [1.0] * 3200}
    data = [(k, i * 86_400 + (i > 2) * 10**12, v) for k, values in series.items() for i, v in enumerate(values)]
    got = {}
    for r in K.smooth(spark.createDataFrame(data, "k string, o long, v double"), "k", "o", "v").collect():
        got.setdefault(r.k, []).append((r.o, r.smoothed))
    for k, values in series.items():
        s, want = values[0], []
        for i, x in enumerate(values):
            s = 0.9 * s + (1 - 0.9) * x if i else x
            want.append(s)
        assert [v for _, v in sorted(got[k])] == pytest.approx(want, rel=1e-9, nan_ok=True)
