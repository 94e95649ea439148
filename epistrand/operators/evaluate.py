"""Metrics of predictions, training logs and attributions."""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epistrand.functions.arrays import argmax_index
from epistrand.functions.scalars import is_positive, sigmoid
from epistrand.operators.skew import null_safe_join, number_rows, running_before
from epistrand.schemas import PAD, SEP


def _keys(by):
    return [by] if isinstance(by, str) else list(by)


def _usable(preds):
    """The rows that count: with label 0 or 1, and with the score and the prediction that there is a column for.

    A score that is NULL or NaN says nothing, so its row counts in no metric.
    """
    good = F.col("label").isin(0, 1)
    if "prob" in preds.columns:
        good = good & F.col("prob").isNotNull() & ~F.isnan(F.col("prob").cast("double"))
    if "pred" in preds.columns:
        return preds.filter(good & F.col("pred").isNotNull())
    return preds.filter(good).withColumn("pred", is_positive(F.col("prob")))


def _scored(preds):
    return _usable(preds) if {"prob", "pred"} & set(preds.columns) else preds.filter(F.col("label").isin(0, 1))


def confusion(preds: DataFrame, by="horizon") -> DataFrame:
    """``tn, fp, fn, tp`` per group. ``preds`` has ``label`` and ``prob`` (or ``pred``)."""
    label, pred = F.col("label"), F.col("pred")
    return _usable(preds).groupBy(*_keys(by)).agg(
        F.count_if((label == 0) & (pred == 0)).alias("tn"),
        F.count_if((label == 0) & (pred == 1)).alias("fp"),
        F.count_if((label == 1) & (pred == 0)).alias("fn"),
        F.count_if((label == 1) & (pred == 1)).alias("tp"),
    )


def _ratio(part, whole):
    """0 where the denominator is 0."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def _from_confusion():
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return {
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "specificity": F.try_divide(tn, tn + fp),
    }


def binary_metrics(preds: DataFrame, by="horizon") -> DataFrame:
    """``precision, recall, f1, specificity`` per group.

    With nothing to divide by, the first three are 0 and specificity is NULL.
    """
    return confusion(preds, by).select(*_keys(by), *[v.alias(c) for c, v in _from_confusion().items()])


def _score_levels(scores):
    """Three columns that order numbers as the numbers themselves: sign and exponent, then 12 bits twice."""
    prob = F.col("prob")
    sign = F.signum(prob).cast("int")
    exponent = F.when(prob == 0, F.lit(0)).otherwise(F.floor(F.log2(F.abs(prob)))).cast("int")
    fraction = (F.abs(prob) / F.pow(F.lit(2.0), exponent) - 1) * 4096
    high = F.floor(fraction)
    return scores.withColumns(
        {
            "_exp": sign * (exponent + 1100),
            "_high": sign * high,
            "_low": sign * F.floor((fraction - high) * 4096),
        }
    )


def _totals(preds, keys):
    """Per group: ``_wins`` (twice the ordered pairs of a positive above a negative), ``_pos, _neg, tp, fp``.

    Rows are first counted per distinct score. The number of negatives below each score
    is a running total over ranges of the score, so no task sees a whole group.
    """
    label, pred = F.col("label"), F.col("pred")
    scores = _usable(preds).groupBy(*keys, F.col("prob").cast("double").alias("prob")).agg(
        F.count_if(label == 1).alias("_pos"),
        F.count_if(label == 0).alias("_neg"),
        F.count_if((label == 1) & (pred == 1)).alias("tp"),
        F.count_if((label == 0) & (pred == 1)).alias("fp"),
    )
    ranked = running_before(
        _score_levels(scores), keys, ["_exp", "_high", "_low"], [F.col("prob")], F.col("_neg"), "_below"
    )
    wins = F.col("_pos").cast("decimal(19,0)") * (2 * F.col("_below") + F.col("_neg")).cast("decimal(19,0)")
    return ranked.groupBy(*keys).agg(
        F.sum(wins).cast("double").alias("_wins"), *[F.sum(c).alias(c) for c in ("_pos", "_neg", "tp", "fp")]
    )


def _auc():
    return F.try_divide("_wins", F.col("_pos").cast("double") * F.col("_neg").cast("double") * 2)


def roc_auc(preds: DataFrame, by="horizon") -> DataFrame:
    """``roc_auc`` per group; tied scores count half. NULL if a group has one class only."""
    keys = _keys(by)
    return _totals(preds, keys).select(*keys, _auc().alias("roc_auc"))


def class_counts(preds: DataFrame, by="horizon") -> DataFrame:
    """``n_patients, n_cases, n_controls`` per group."""
    return _scored(preds).groupBy(*_keys(by)).agg(
        F.count("*").alias("n_patients"),
        F.count_if(F.col("label") == 1).alias("n_cases"),
        F.count_if(F.col("label") == 0).alias("n_controls"),
    )


def single_class_groups(preds: DataFrame, by="horizon") -> DataFrame:
    """The groups that :func:`metrics_by_horizon` skips because they have one class only."""
    return class_counts(preds, by).filter((F.col("n_cases") == 0) | (F.col("n_controls") == 0))


def metrics_by_horizon(preds: DataFrame, by="horizon") -> DataFrame:
    """Counts, AUC, F1, precision, recall and specificity per group with both classes, in one pass."""
    keys = _keys(by)
    totals = _totals(preds, keys).filter((F.col("_pos") > 0) & (F.col("_neg") > 0))
    totals = totals.withColumns({"fn": F.col("_pos") - F.col("tp"), "tn": F.col("_neg") - F.col("fp")})
    metrics = _from_confusion()
    return totals.select(
        *keys, (F.col("_pos") + F.col("_neg")).alias("n_patients"), F.col("_pos").alias("n_cases"),
        F.col("_neg").alias("n_controls"), _auc().alias("roc_auc"),
        *[metrics[c].alias(c) for c in ("f1", "precision", "recall", "specificity")],
    )


def masked_precision(preds: DataFrame) -> DataFrame:
    """``precision``: share of positions with a label (not -1) whose best-scored token is the label.

    ``preds`` has ``label`` and either ``pred`` or ``scores``, an array with one score per token.
    """
    pred = F.col("pred") if "pred" in preds.columns else argmax_index(F.col("scores"))
    hit = (pred == F.col("label")).cast("double")
    return preds.filter(F.col("label") != -1).agg(F.avg(hit).alias("precision"))


def global_steps(log: DataFrame, steps_per_epoch: int, every: int = 200) -> DataFrame:
    """Add ``global_step`` and keep the first of every ``every`` steps of an epoch (``cnt`` starts at 1)."""
    step = F.col("epoch").cast("long") * F.lit(steps_per_epoch) + F.col("cnt")
    return log.filter(F.pmod(F.col("cnt") - 1, F.lit(every)) == 0).withColumn("global_step", step)


def epoch_precision(log: DataFrame) -> DataFrame:
    """``epoch, precision``: mean of the logged steps."""
    return log.groupBy("epoch").agg(F.avg("precision").alias("precision"))


FOLD = 1000  # steps of one level that a step of the next level sums up


def smooth(df: DataFrame, key: str, order: str, value: str, w: float = 0.9) -> DataFrame:
    """Add ``smoothed``: ``s0 = x0, s = w * s + (1 - w) * x`` along ``order`` within each ``key``.

    ``order`` is unique within the key, with gaps or not; NULL is a key like any other. A
    series is cut into chunks of equally many points. Within a chunk the recurrence is a
    running sum with weights ``w^-i``. As a whole, a chunk turns the value ``s`` that enters
    it into ``a * s + b``; so do a thousand chunks in a row, and a thousand of those.
    What enters a chunk follows from all steps before it, at three levels. A NaN or an
    infinity stays to the end of the series, as in the recurrence.
    """
    if not 0 < w < 1:
        raise ValueError("w must lie between 0 and 1")
    size = max(1, min(1000, int(230 / -math.log(w))))
    rows = number_rows(df, [key], [order], "_rank").withColumns(
        {
            "_chunk": F.floor(F.col("_rank") / size),
            "_i": F.pmod(F.col("_rank"), F.lit(size)),
            "_x": F.col(value).cast("double"),
        }
    )
    weighted = F.col("_x") * F.pow(F.lit(w), -F.col("_i"))
    chunks = rows.groupBy(key, "_chunk").agg(
        F.count("*").alias("_n"), F.sum(weighted).alias("_sum"), F.min_by("_x", "_rank").alias("_first")
    )
    power, is_first = F.pow(F.lit(w), F.col("_n")), F.col("_chunk") == 0
    own = (1 - w) * power / w * F.col("_sum")
    # The first chunk is entered by the first value, so that it needs nothing before it.
    steps = chunks.select(
        key, F.col("_chunk").alias("at"), "_first",
        F.when(is_first, F.lit(0.0)).otherwise(power).alias("a"),
        F.when(is_first, power * F.col("_first") + own).otherwise(own).alias("b"),
    )
    entering = _entering(steps.drop("_first"), key, 2)
    first = steps.filter("at = 0").select(key, F.col("_first").alias("_enter"), F.lit(0).cast("long").alias("_chunk"))
    entering = entering.select(key, "_enter", F.col("at").alias("_chunk")).filter("_chunk > 0").unionByName(first)
    so_far = Window.partitionBy(key, "_chunk").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    rows = null_safe_join(rows.withColumn("_so_far", F.sum(weighted).over(so_far)), entering, [key, "_chunk"])
    smoothed = F.pow(F.lit(w), F.col("_i")) * (w * F.col("_enter") + (1 - w) * F.col("_so_far"))
    return rows.select(*df.columns, smoothed.alias("smoothed"))


def _step(s, step):
    """``a * s + b``, where an infinity is not lost when ``a`` has become 0."""
    endless = F.abs(s) == F.lit(float("inf"))
    return F.when(endless & (step["a"] == 0), s + step["b"]).otherwise(step["a"] * s + step["b"])


def _entering(steps, key, levels):
    """``key, at, _enter``: the value after all steps before each one. ``steps`` has ``key, at, a, b``."""
    before = lambda *group: F.collect_list(F.struct("a", "b")).over(
        Window.partitionBy(*group).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    )
    if not levels:
        return steps.select(key, "at", F.aggregate(before(key), F.lit(0.0), _step).alias("_enter"))
    steps = steps.withColumn("_up", F.floor(F.col("at") / FOLD))
    listed = steps.groupBy(key, "_up").agg(F.sort_array(F.collect_list(F.struct("at", "a", "b"))).alias("_steps"))
    folded = listed.select(
        key, F.col("_up").alias("at"),
        F.aggregate("_steps", F.lit(1.0), lambda p, x: p * x["a"]).alias("a"),
        F.aggregate("_steps", F.lit(0.0), _step).alias("b"),
    )
    above = _entering(folded, key, levels - 1).select(key, F.col("at").alias("_up"), F.col("_enter").alias("_start"))
    inside = null_safe_join(steps.withColumn("_list", before(key, "_up")), above, [key, "_up"])
    return inside.select(key, "at", F.aggregate("_list", F.col("_start"), _step).alias("_enter"))


def attribution_summary(attributions: DataFrame, by: tuple = ()) -> DataFrame:
    """``code, mean_shap, mean_abs_shap, n_occurrences``; padding and separators are left out."""
    return (
        attributions.filter(~F.col("code").isin(PAD, SEP))
        .groupBy(*by, "code")
        .agg(
            F.avg("value").alias("mean_shap"),
            F.avg(F.abs("value")).alias("mean_abs_shap"),
            F.count("*").alias("n_occurrences"),
        )
    )


def top_attributions(summary: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` codes with the highest mean absolute attribution, lowest first, as a bar chart lists them."""
    top = summary.orderBy(F.desc("mean_abs_shap"), "code").limit(k)
    return top.orderBy("mean_abs_shap", F.desc("code"))


def score(df: DataFrame, scorer, keep: list[str], threshold: float = 0.5) -> DataFrame:
    """Score encoded rows with the caller's model: the ``keep`` columns, ``prob`` and ``pred``.

    ``scorer`` is called once per task, where it may load a model, and returns a function
    from a pandas frame of encoded rows to one raw score per row.
    """
    fields = [f for f in df.schema.fields if f.name in keep]

    def run(batches):
        predict = scorer()
        for batch in batches:
            out = batch[[f.name for f in fields]].copy()
            out["logit"] = predict(batch)
            yield out

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["logit double"])
    scored = df.mapInPandas(run, schema).withColumn("prob", sigmoid(F.col("logit")))
    return scored.select(*keep, "prob", is_positive(F.col("prob"), threshold).alias("pred"))
