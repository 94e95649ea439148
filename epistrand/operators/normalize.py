"""Laboratory and vital-sign records to binned events."""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistrand.functions.scalars import strip_whitespace, to_number
from epistrand.operators.skew import lookup_join
from epistrand.schemas import BIN_EDGES
from epistrand.sources.store import local_table


def threshold_table(spark: SparkSession, thresholds: dict = BIN_EDGES) -> DataFrame:
    """One row per test: ``test_name, edges``."""
    for name, edges in thresholds.items():
        if list(edges) != sorted(edges):
            raise ValueError(f"bin edges of {name} must ascend")
    return local_table(
        spark,
        test_name=pa.array(list(thresholds), pa.string()),
        edges=pa.array([[float(e) for e in edges] for edges in thresholds.values()], pa.list_(pa.float64())),
    )


def labs_to_measurements(labs: DataFrame) -> DataFrame:
    """``PATIENT_ID, DATE, TEST_NAME, TEST_VALUE``; a result that is no number gives NULL."""
    return labs.select(
        "PATIENT_ID",
        F.col("Shifted_date").alias("DATE"),
        F.trim("LAB_NAME").alias("TEST_NAME"),
        to_number(F.col("RESULT")).alias("TEST_VALUE"),
    )


def vitals_to_measurements(vitals: DataFrame) -> DataFrame:
    """As :func:`labs_to_measurements`; ``VITALS:x`` is named ``VITAL_x_MEAN``."""
    name = F.concat(F.trim(F.replace("VITAL_CODE", F.lit("VITALS:"), F.lit("VITAL_"))), F.lit("_MEAN"))
    return vitals.select(
        "PATIENT_ID",
        F.col("Shifted_date").alias("DATE"),
        name.alias("TEST_NAME"),
        to_number(F.col("MEASUREMENT")).alias("TEST_VALUE"),
    )


def union_measurements(labs: DataFrame, vitals: DataFrame) -> DataFrame:
    return labs.unionByName(vitals)


def with_value(measurements: DataFrame) -> DataFrame:
    """Keep the rows that have a value."""
    return measurements.filter(F.col("TEST_VALUE").isNotNull())


def _loincs_of_names(crosswalk):
    """``name, loincs``: the set of LOINC codes of each name; names without any code do not count."""
    pairs = crosswalk.select(
        strip_whitespace(F.col("SUNQUEST_NAME")).alias("name"), F.col("LOINC_CODE").alias("loinc")
    ).filter(F.col("name").isNotNull() & F.col("loinc").isNotNull())
    return pairs.groupBy("name").agg(F.collect_set("loinc").alias("loincs"))


def _canonical_codes(names, canonical):
    """``canonical, ord, loinc``: canonical names with exactly one LOINC code."""
    table = local_table(
        names.sparkSession,
        canonical=pa.array(list(canonical), pa.string()),
        ord=pa.array(range(len(canonical)), pa.int32()),
    )
    found = table.join(names, F.col("canonical") == F.col("name"))
    return found.filter(F.size("loincs") == 1).select("canonical", "ord", F.col("loincs")[0].alias("loinc"))


def synonym_map(crosswalk: DataFrame, canonical=tuple(BIN_EDGES)) -> DataFrame:
    """``synonym, canonical``: other names of a canonical name's only LOINC code.

    A name with several LOINC codes is never a synonym. If a synonym belongs to several
    canonical names, the one listed last counts.
    """
    names = _loincs_of_names(crosswalk)
    single = names.filter(F.size("loincs") == 1).select("name", F.col("loincs")[0].alias("loinc"))
    return (
        single.join(_canonical_codes(names, canonical), "loinc")
        .filter(F.col("name") != F.col("canonical"))
        .groupBy(F.col("name").alias("synonym"))
        .agg(F.max_by("canonical", "ord").alias("canonical"))
    )


def ambiguous_names(crosswalk: DataFrame, canonical=tuple(BIN_EDGES)) -> DataFrame:
    """``name, loincs``: canonical names and would-be synonyms with several LOINC codes."""
    names = _loincs_of_names(crosswalk)
    several = names.filter(F.size("loincs") > 1)
    codes = several.select("name", "loincs", F.explode("loincs").alias("loinc"))
    would_be = codes.join(_canonical_codes(names, canonical).select("loinc"), "loinc", "left_semi")
    own = several.filter(F.col("name").isin(list(canonical)))
    both = own.unionByName(would_be.select("name", "loincs"))
    return both.select("name", F.array_sort("loincs").alias("loincs")).distinct()


def normalize_names(measurements: DataFrame, synonyms: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    """Replace each synonym in TEST_NAME by its canonical name.

    ``bound`` may be the crosswalk that ``synonyms`` is made from; see ``lookup_join``.
    """
    lookup = synonyms.select(F.col("synonym").alias("TEST_NAME"), F.col("canonical"))
    joined = lookup_join(measurements, lookup, "TEST_NAME", "left", bound=bound)
    name = F.coalesce("canonical", "TEST_NAME").alias("TEST_NAME")
    return joined.select(*[name if c == "TEST_NAME" else F.col(c) for c in measurements.columns])


def keep_known_tests(measurements: DataFrame, thresholds: dict = BIN_EDGES) -> DataFrame:
    """Keep the rows whose test has bin edges."""
    return measurements.filter(F.col("TEST_NAME").isin(list(thresholds)))


def bin_values(measurements: DataFrame, thresholds: dict = BIN_EDGES) -> DataFrame:
    """Add ``BINNED_VALUE``: ``BIN_1`` below the first edge up to ``BIN_{k+1}``; unknown tests drop out.

    The edges, one column each, come from a broadcast table with one row per entry of
    ``thresholds``, so the bin is plain generated code: one more than the number of
    edges not above the value. NaN is above every edge.
    """
    edges = threshold_table(measurements.sparkSession, thresholds)
    widest = max(len(e) for e in thresholds.values())
    columns = [F.get("edges", i).alias(f"_edge{i}") for i in range(widest)]
    lookup = edges.select(F.col("test_name").alias("TEST_NAME"), *columns)
    joined = measurements.join(F.broadcast(lookup), "TEST_NAME")
    reached = sum(
        (F.coalesce(F.col("TEST_VALUE") >= F.col(f"_edge{i}"), F.lit(False)).cast("int") for i in range(widest)),
        F.lit(1),
    )
    return joined.select(*measurements.columns, F.concat(F.lit("BIN_"), reached.cast("string")).alias("BINNED_VALUE"))


def binned_to_events(binned: DataFrame) -> DataFrame:
    """``PATIENT_ID, DATE, CODE`` with codes ``LAB:<test>_BIN_<n>``, for vital signs too."""
    code = F.concat(F.lit("LAB:"), "TEST_NAME", F.lit("_"), "BINNED_VALUE")
    return binned.filter(F.col("BINNED_VALUE").isNotNull()).select(
        "PATIENT_ID", "DATE", code.alias("CODE")
    )


def discretize(
    labs: DataFrame, vitals: DataFrame, crosswalk: DataFrame, thresholds: dict = BIN_EDGES
) -> DataFrame:
    """All laboratory and vital-sign rows as binned events.

    No shuffle: every lookup table has one row per test or synonym.
    """
    rows = with_value(union_measurements(labs_to_measurements(labs), vitals_to_measurements(vitals)))
    named = normalize_names(rows, synonym_map(crosswalk, tuple(thresholds)), bound=crosswalk)
    return binned_to_events(bin_values(keep_known_tests(named, thresholds), thresholds))
