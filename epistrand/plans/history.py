"""Raw events to censored patient sequences, with all patient-level joins on narrow day tables.

Censoring and ages depend on the patient and the day only. So instead of joining every
event to its patient's index date and year of birth, these plans do both on a table
with one row per patient and day, and join that back to the counted events. The join is
at the same time the censoring. No table is broadcast by force, and no key is larger
than a patient's number of days.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epistrand.functions.scalars import years_before
from epistrand.operators.censor import earliest_index, reference_dates
from epistrand.operators.cohort import restrict_to
from epistrand.operators.events import age_text, one_row_per_patient
from epistrand.operators.sequences import (
    collect_counts,
    collect_runs,
    count_events,
    day_number,
    lay_out,
    place,
    place_in_order,
    year_of_day,
)
from epistrand.schemas import HORIZON_YEARS
from epistrand.sources.keyed import BUCKETS, store_by_key

_PATIENT = ["PATIENT_ID"]


def _date(day):
    return F.when(year_of_day(day).isNotNull(), F.date_from_unix_date(day))


def _aged_days(days, demographics):
    """Add ``sep_age``, the age on the day, from the year of the last day of the patient."""
    last = F.max(F.when(year_of_day(F.col("day")).isNotNull(), F.col("day"))).over(
        Window.partitionBy("PATIENT_ID")
    )
    known = days.withColumn("_last", last).join(one_row_per_patient(demographics), "PATIENT_ID")
    birth = year_of_day(F.col("_last")) - F.col("AGE_AT_END")
    return known.withColumn("sep_age", age_text(year_of_day(F.col("day")), birth)).drop(
        "_last", "AGE_AT_END"
    )


def _censored_days(counts, dx_dates):
    days = counts.groupBy("PATIENT_ID", "day").agg(F.sum("n").alias("n_day"))
    joined = days.join(earliest_index(dx_dates), "PATIENT_ID", "left")
    index = F.unix_date("Index_Date")
    # A missing date is never before an index date; its day number is above all others.
    return joined.filter(index.isNull() | (F.col("day") < index)).drop("Index_Date")


def patient_sequences(
    events: DataFrame, dx_dates: DataFrame, demographics: DataFrame, segment_tokens: int | None = None
) -> DataFrame:
    """The same as ``censor_at_index``, ``add_age`` and ``build_sequences`` one after the other.

    Whole sequences need no positions: counted events come together with their day, and day and
    code order them. So no layout is made, and only codes, days and ages are shuffled.
    """
    if segment_tokens is not None:
        runs = _runs_in_order(events, dx_dates, demographics)
        return collect_runs(runs, _PATIENT, segment_tokens, together=True).withColumnRenamed("PATIENT_ID", "patid")
    days = _known_days(events, dx_dates, demographics)
    # See sequences.place for the hint.
    dated = count_events(events).join(days.hint("merge"), ["PATIENT_ID", "day"])
    return collect_counts(dated, _PATIENT).withColumnRenamed("PATIENT_ID", "patid")


def _known_days(events, dx_dates, demographics):
    """``PATIENT_ID, day, sep_age`` of the days that are left after censoring, as :func:`_aged_days` has them.

    The days of a patient are one row here, made map-side, so that few rows meet the index dates and ages.
    """
    day = day_number(F.col("DATE"))
    held = events.groupBy("PATIENT_ID").agg(F.collect_set(day).alias("_days"))
    known = held.join(earliest_index(dx_dates), "PATIENT_ID", "left").join(one_row_per_patient(demographics), "PATIENT_ID")
    index = F.unix_date("Index_Date")
    left = known.withColumn("_days", F.filter("_days", lambda d: index.isNull() | (d < index)))
    last = F.array_max(F.filter("_days", lambda d: year_of_day(d).isNotNull()))
    born = left.withColumn("_birth", year_of_day(last) - F.col("AGE_AT_END"))
    rows = born.select("PATIENT_ID", "_birth", F.explode("_days").alias("day"))
    return rows.select("PATIENT_ID", "day", age_text(year_of_day(F.col("day")), F.col("_birth")).alias("sep_age"))


def _runs_in_order(events, dx_dates, demographics):
    """The rows of :func:`patient_runs` with those of a patient in one partition, by one shuffle of the counted events.

    For segments, which take all tokens of a sequence: brought together before they have positions,
    the events are shuffled once more instead of three times, and never as pieces of segments.
    """
    known = count_events(events).join(earliest_index(dx_dates), "PATIENT_ID", "left")
    known = known.join(one_row_per_patient(demographics), "PATIENT_ID")
    index = F.unix_date("Index_Date")
    # A missing date is never before an index date; its day number is above all others.
    left = known.filter(index.isNull() | (F.col("day") < index)).drop("Index_Date")
    last = F.when(year_of_day(F.col("day")).isNotNull(), F.col("day"))
    placed = place_in_order(left, _PATIENT, [("_last", last)])
    birth = year_of_day(F.col("_last")) - F.col("AGE_AT_END")
    age = age_text(year_of_day(F.col("day")), birth)
    return placed.withColumnRenamed("CODE", "code").withColumns({"age": age, "sep_age": age})


def patient_runs(events: DataFrame, dx_dates: DataFrame, demographics: DataFrame) -> DataFrame:
    """The tokens of :func:`patient_sequences` in long form (see ``sequences.place``), keyed by ``PATIENT_ID``.

    With ``sequences.last_tokens`` and ``collect_runs``, training tables need no more than
    the tokens that they use.
    """
    counts = count_events(events)
    days = _aged_days(_censored_days(counts, dx_dates), demographics)
    return place(counts, lay_out(days, _PATIENT), _PATIENT)


def store_sequences(runs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Collect the runs of each patient and store the sequences by ``patid`` (see ``sources.store_by_key``).

    The shuffle that brings a sequence together is also the one that deals it to its bucket. It has
    the multiple of ``buckets`` partitions that comes next below the usual number, or ``buckets``:
    each lies in one bucket, and few buckets do not make tasks that sort and collect a whole one.
    """
    usual = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = buckets * max(1, usual // buckets)
    sequences = collect_runs(runs, _PATIENT, deal=(parts, "PATIENT_ID")).withColumnRenamed("PATIENT_ID", "patid")
    return store_by_key(sequences, "patid", buckets, dealt=True)


def horizon_test_sets(
    events: DataFrame,
    demographics: DataFrame,
    dx_dates: DataFrame,
    test: DataFrame,
    years: list | None = None,
    segment_tokens: int | None = None,
) -> DataFrame:
    """Test sequences cut off N years before the reference date, for all horizons in one pass.

    ``events`` are censored at the index date; ``test`` has ``patid, label``. Ages refer to
    the whole history, so they do not change from horizon to horizon. Returns
    ``years, patid, label, n_tokens, n_visits, code, age``.

    A horizon is a prefix of the history, so a token has the same position in all of them.
    The layout is therefore made once; each day carries the horizons that it is part of and
    their lengths, and its counted events are repeated only when they are collected.
    """
    people = test.select(F.col("patid").alias("PATIENT_ID"), "label").filter(F.col("label").isNotNull())
    counts = count_events(restrict_to(events, test))
    days = counts.groupBy("PATIENT_ID", "day").agg(F.sum("n").alias("n_day"))
    references = reference_dates(test, dx_dates, days.withColumn("DATE", _date(F.col("day"))))
    limits = references.filter(F.col("REF_DATE").isNotNull()).join(people, "PATIENT_ID").drop("is_case")
    aged = _aged_days(days, demographics.filter(F.col("AGE_AT_END").isNotNull()))
    layout = lay_out(aged, _PATIENT).drop("n_tokens", "n_visits").join(limits, "PATIENT_ID")
    layout = _with_horizons(layout, HORIZON_YEARS if years is None else years)
    runs = place(counts, layout, _PATIENT, carry=["label", "_horizons"])
    repeated = runs.withColumn("_h", F.explode("_horizons")).select("*", "_h.*").drop("_h", "_horizons")
    keys = ["years", "PATIENT_ID", "label"]
    sequences = collect_runs(repeated.filter(F.col("n_tokens") >= 2), keys, segment_tokens)
    return sequences.withColumnRenamed("PATIENT_ID", "patid")


def _with_horizons(layout, years):
    """Days that some horizon holds, with ``_horizons``: ``(years, n_tokens, n_visits)`` of each that holds them."""
    whole = Window.partitionBy("PATIENT_ID")
    day = _date(F.col("day"))
    horizons = []
    for n in years:
        inside = F.coalesce(day < years_before(F.col("REF_DATE"), n), F.lit(False))
        tokens = F.max(F.when(inside, F.col("start") + F.col("n_day") + 1)).over(whole)
        visits = F.max(F.when(inside, F.col("visit") + 1)).over(whole)
        found = F.struct(F.lit(n).alias("years"), tokens.alias("n_tokens"), visits.alias("n_visits"))
        horizons.append(F.when(inside, found))
    held = layout.withColumn("_horizons", F.filter(F.array(*horizons), lambda h: h.isNotNull()))
    return held.filter(F.size("_horizons") > 0).drop("REF_DATE")
