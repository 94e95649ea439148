"""Reports on events and cohorts."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epistrand.functions.scalars import calendar_years, event_kind
from epistrand.operators.censor import earliest_index
from epistrand.operators.events import events_with_codes, patient_events
from epistrand.operators.sequences import once_each
from epistrand.operators.skew import lookup_join


def bin_summary(events: DataFrame) -> DataFrame:
    """Binned rows per test, most frequent first: ``TEST_NAME, n``."""
    name = F.regexp_extract("CODE", "LAB:(.*)_BIN", 1)
    counts = events.groupBy(name.alias("TEST_NAME")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "TEST_NAME")


def event_kind_summary(events: DataFrame) -> DataFrame:
    """Events per kind: ``type, n``."""
    return events.groupBy(event_kind(F.col("CODE")).alias("type")).agg(F.count("*").alias("n"))


def patient_profile(events: DataFrame, patid: str | None = None) -> DataFrame:
    """Events, distinct dates, first and last date and years spanned, per patient.

    Rows are counted per day first, so no distinct count has to hold a whole patient.
    """
    chosen = events if patid is None else patient_events(events, patid)
    days = chosen.groupBy("PATIENT_ID", "DATE").agg(F.count("*").alias("n"))
    profile = days.groupBy("PATIENT_ID").agg(
        F.sum("n").alias("total_events"),
        F.count("DATE").alias("unique_dates"),
        F.min("DATE").alias("first_date"),
        F.max("DATE").alias("last_date"),
    )
    return profile.withColumn("years_span", calendar_years(F.col("first_date"), F.col("last_date")))


def top_days(events: DataFrame, patid: str | None = None, k: int = 10) -> DataFrame:
    """The ``k`` days with the most events, of one patient or of each: ``PATIENT_ID, DATE, n_events``."""
    return _top(events, "DATE", "n_events", patid, k)


def top_codes(events: DataFrame, patid: str | None = None, k: int = 15) -> DataFrame:
    """The ``k`` most frequent codes, of one patient or of each: ``PATIENT_ID, CODE, n``."""
    return _top(events, "CODE", "n", patid, k)


def _top(events, column, out, patid, k):
    chosen = events if patid is None else patient_events(events, patid)
    counts = chosen.groupBy("PATIENT_ID", column).agg(F.count("*").alias(out))
    if patid is not None:
        return counts.orderBy(F.desc(out), column).limit(k)
    # Per patient the window holds distinct days or codes, not events.
    window = Window.partitionBy("PATIENT_ID").orderBy(F.desc(out), column)
    return counts.withColumn("_r", F.row_number().over(window)).filter(F.col("_r") <= k).drop("_r")


def leakage_audit(events: DataFrame, codes: list) -> DataFrame:
    """How often each patient has one of the suspicious codes: ``PATIENT_ID, n_suspicious_codes``."""
    flagged = events_with_codes(events, codes)
    return flagged.groupBy("PATIENT_ID").agg(F.count("*").alias("n_suspicious_codes"))


def audit_examples(events: DataFrame, codes: list, patid: str | None = None) -> DataFrame:
    """The suspicious events of one patient by date; by default of the first patient that has any."""
    flagged = events_with_codes(events, codes)
    if patid is None:
        first = flagged.agg(F.min("PATIENT_ID").alias("PATIENT_ID")).scalar()
        chosen = flagged.filter(F.col("PATIENT_ID") == first)
    else:
        chosen = patient_events(flagged, patid)
    return chosen.select("PATIENT_ID", "DATE", "CODE").orderBy("DATE", "CODE")


def leakage_examples(events: DataFrame, dx_dates: DataFrame, codes: list) -> DataFrame:
    """Each suspicious event next to the index date of its patient: ``..., Index_Date, n_index_rows``."""
    index = earliest_index(dx_dates).join(
        dx_dates.groupBy("PATIENT_ID").agg(F.count("*").alias("n_index_rows")), "PATIENT_ID"
    )
    return lookup_join(events_with_codes(events, codes), index, "PATIENT_ID", "left", bound=dx_dates).select(
        "PATIENT_ID", "DATE", "CODE", "Index_Date", "n_index_rows"
    )


def horizon_report(sets: DataFrame, test: DataFrame) -> DataFrame:
    """Per horizon: patients kept, cases, controls and patients dropped."""
    total = test.agg(F.countDistinct("patid").alias("n")).scalar()
    return once_each(sets).groupBy("years").agg(
        F.count("*").alias("n_kept"),
        F.sum("label").alias("n_cases"),
        (F.count("*") - F.sum("label")).alias("n_controls"),
    ).withColumn("n_dropped", total - F.col("n_kept"))


def reference_disagreements(references: DataFrame, test: DataFrame) -> DataFrame:
    """Patients whose label and presence in the index table disagree: ``is_case, label, n``."""
    people = test.select(F.col("patid").alias("PATIENT_ID"), "label")
    joined = references.join(people, "PATIENT_ID").filter(F.col("is_case") != F.col("label"))
    return joined.groupBy("is_case", "label").agg(F.count("*").alias("n"))


def patients_with_events(events: DataFrame) -> DataFrame:
    """``n_patients``: number of distinct patients."""
    return events.agg(F.countDistinct("PATIENT_ID").alias("n_patients"))
