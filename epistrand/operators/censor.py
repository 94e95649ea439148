"""Leaving out events that a prediction must not see."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistrand.functions.scalars import years_before
from epistrand.operators.events import last_visit
from epistrand.operators.skew import lookup_join
from epistrand.schemas import HORIZON_YEARS


def earliest_index(dx_dates: DataFrame) -> DataFrame:
    """``PATIENT_ID, Index_Date``: the first diagnosis date of each listed patient."""
    return dx_dates.groupBy("PATIENT_ID").agg(
        F.min(F.col("EARLIEST_DX").cast("date")).alias("Index_Date")
    )


def censor_at_index(events: DataFrame, dx_dates: DataFrame, mode: str = "earliest") -> DataFrame:
    """Events strictly before the index date; patients without one keep everything.

    ``earliest`` takes the first index date of a patient. ``any_row`` compares with every
    index row: an event comes out once per row that is later than it, as a join with the
    whole table would give. That lets events after the first diagnosis through, so it is
    never the default.
    """
    if mode == "earliest":
        joined = lookup_join(events, earliest_index(dx_dates), "PATIENT_ID", "left", bound=dx_dates)
        kept = joined.filter(F.col("Index_Date").isNull() | (F.col("DATE") < F.col("Index_Date")))
        return kept.select(*events.columns)
    if mode == "any_row":
        joined = lookup_join(events, _index_days(dx_dates), "PATIENT_ID", "left", bound=dx_dates)
        later = F.aggregate(
            "days",
            F.lit(0).cast("long"),
            lambda total, d: total
            + F.when(d["day"].isNull() | (F.col("DATE") < d["day"]), d["n"]).otherwise(F.lit(0)),
        )
        times = F.when(F.col("days").isNull(), F.lit(1)).otherwise(later).cast("int")
        repeated = joined.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), times)))
        return repeated.select(*events.columns)
    raise ValueError("mode must be 'earliest' or 'any_row'")


def _index_days(dx_dates):
    """One row per patient: each index day with its number of rows."""
    day = F.col("EARLIEST_DX").cast("date").alias("day")
    counts = dx_dates.groupBy("PATIENT_ID", day).agg(F.count("*").alias("n"))
    return counts.groupBy("PATIENT_ID").agg(F.collect_list(F.struct("day", "n")).alias("days"))


def reference_dates(ids: DataFrame, dx_dates: DataFrame, events: DataFrame) -> DataFrame:
    """``PATIENT_ID, is_case, REF_DATE`` for each of ``ids`` (column ``patid``).

    The index date of a patient who is listed in ``dx_dates``, even if it is NULL; else
    the last visit.
    """
    people = ids.select(F.col("patid").alias("PATIENT_ID")).distinct()
    cases = earliest_index(dx_dates).withColumn("_listed", F.lit(True))
    joined = people.join(cases, "PATIENT_ID", "left").join(last_visit(events), "PATIENT_ID", "left")
    is_case = F.coalesce("_listed", F.lit(False))
    return joined.select(
        "PATIENT_ID",
        is_case.cast("int").alias("is_case"),
        F.when(is_case, F.col("Index_Date")).otherwise(F.col("LAST_VISIT_DATE")).alias("REF_DATE"),
    )


def cutoffs(references: DataFrame, years: list = HORIZON_YEARS) -> DataFrame:
    """``PATIENT_ID, cutoffs``: one ``(years, cutoff)`` per horizon; patients without a date drop out."""
    each = F.array(
        *[F.struct(F.lit(n).alias("years"), years_before(F.col("REF_DATE"), n).alias("cutoff")) for n in years]
    )
    return references.filter(F.col("REF_DATE").isNotNull()).select("PATIENT_ID", each.alias("cutoffs"))


def censor_at_horizon(events: DataFrame, references: DataFrame, years: list = HORIZON_YEARS) -> DataFrame:
    """Events before the reference date minus N years, for all horizons in one pass: adds ``years``."""
    joined = lookup_join(events, cutoffs(references, years), "PATIENT_ID", "inner")
    return expand_horizons(joined, F.col("DATE")).select("years", *events.columns)


def expand_horizons(rows: DataFrame, day) -> DataFrame:
    """Repeat each row once per horizon whose cutoff is after ``day``."""
    open_ = F.filter("cutoffs", lambda c: day < c["cutoff"])
    return rows.withColumn("years", F.explode(F.transform(open_, lambda c: c["years"]))).drop("cutoffs")
