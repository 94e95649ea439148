"""Coded events: building, filtering, and ages."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistrand.operators.skew import lookup_join


def events_from_dx(dx: DataFrame) -> DataFrame:
    """Diagnosis rows as events ``PATIENT_ID, DATE, CODE`` with codes ``DX:<code>``."""
    return dx.select(
        "PATIENT_ID",
        F.col("Shifted_date").cast("date").alias("DATE"),
        F.concat(F.lit("DX:"), F.col("DX").cast("string")).alias("CODE"),
    )


def universal_events(dx_events: DataFrame, lab_events: DataFrame) -> DataFrame:
    """Diagnoses and measurements in one table of events."""
    return dx_events.unionByName(lab_events.withColumn("DATE", F.col("DATE").cast("date")))


def patient_events(events: DataFrame, patid: str) -> DataFrame:
    """The events of one patient."""
    return events.filter(F.col("PATIENT_ID") == F.lit(patid))


def events_with_codes(events: DataFrame, codes: list) -> DataFrame:
    """The events that carry one of the codes."""
    return events.filter(F.col("CODE").isin(list(codes)))


def sort_events(events: DataFrame) -> DataFrame:
    """Global order by patient and date (and code, so that it is the same every time)."""
    return events.orderBy("PATIENT_ID", "DATE", "CODE")


def last_visit(events: DataFrame) -> DataFrame:
    """``PATIENT_ID, LAST_VISIT_DATE``."""
    return events.groupBy("PATIENT_ID").agg(F.max("DATE").alias("LAST_VISIT_DATE"))


def one_row_per_patient(demographics: DataFrame) -> DataFrame:
    """``PATIENT_ID, AGE_AT_END``; fails if a patient is listed twice, since ages would be ambiguous."""
    twice = F.raise_error(F.concat(F.lit("several demographic rows of patient "), F.col("PATIENT_ID")))
    counted = demographics.groupBy("PATIENT_ID").agg(
        F.count("*").alias("_n"), F.max("AGE_AT_END").alias("AGE_AT_END")
    )
    age = F.when(F.col("_n") > 1, twice.cast("int")).otherwise(F.col("AGE_AT_END"))
    return counted.select("PATIENT_ID", age.alias("AGE_AT_END"))


def year_of_birth(events: DataFrame, demographics: DataFrame) -> DataFrame:
    """``PATIENT_ID, YOB``: year of the last visit minus the age then. Patients without demographics drop out."""
    return (
        last_visit(events)
        .join(one_row_per_patient(demographics), "PATIENT_ID")
        .select("PATIENT_ID", (F.year("LAST_VISIT_DATE") - F.col("AGE_AT_END")).alias("YOB"))
    )


def age_text(year, birth):
    """Age in whole calendar years as text, never negative; unknown years count as 0."""
    return F.greatest(year - birth, F.lit(0)).cast("string")


def add_age(events: DataFrame, demographics: DataFrame) -> DataFrame:
    """Events with ``AGE`` as text."""
    births = year_of_birth(events, demographics)
    joined = lookup_join(events, births, "PATIENT_ID", "inner", bound=demographics)
    return joined.select(*events.columns, age_text(F.year("DATE"), F.col("YOB")).alias("AGE"))
