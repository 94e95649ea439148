"""The raw inputs of the library, derived from the test tables (see FIXTURES.md)."""

import functools
import re

from pyspark.sql import DataFrame, SparkSession

from epistrand.schemas import BIN_EDGES

THRESHOLDS = BIN_EDGES
_TESTS = list(BIN_EDGES)
_VITALS = [n for n in _TESTS if n.startswith("VITAL_")]


def _pick(values, number, between="|"):
    """One of some texts by number."""
    return f"split_part('{between.join(values)}', '{between}', CAST(({number}) % {len(values)} + 1 AS INT))"


def _test(number):
    return _pick(_TESTS, number)


def _vital_codes():
    return [n.replace("VITAL_", "VITALS:").removesuffix("_MEAN") for n in _VITALS]


def _vital(number):
    return _pick(_vital_codes(), number)


def _around(names):
    """Values below, at and above the edges of each test, as many for each."""
    around = [[str(e + d) if d else str(e) for e in BIN_EDGES[n] for d in (-0.5, 0, 0.5)] for n in names]
    most = max(map(len, around))
    return [[v[i % len(v)] for i in range(most)] for v in around]


def _value(names, number, turn):
    """A value below, at or above an edge: ``number`` tells the test and ``turn`` which value."""
    lists = [",".join(v) for v in _around(names)]
    most = len(_around(names)[0])
    return f"split_part({_pick(lists, number)}, ',', CAST(({turn}) % {most} + 1 AS INT))"


# One text serves Spark SQL and DuckDB.
VIEWS = {
    "deid_visit_dx": """
SELECT CAST(o.o_custkey AS STRING) AS PATIENT_ID, CAST(o.o_orderdate AS DATE) AS Shifted_date,
  concat('ICD10CM:', p.p_brand) AS DX,
  CASE WHEN c.c_mktsegment = 'MACHINERY' AND o.o_orderkey % 32 <> 1 THEN '2_Type2' WHEN c.c_mktsegment = 'HOUSEHOLD' THEN '3_Other' ELSE '1_NoD' END AS AIM_GROUP
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey JOIN customer c ON c.c_custkey = o.o_custkey""",
    # Laboratory rows name every test and synonym, and values lie below, at and above every edge.
    "deid_lab_out": f"""
SELECT CAST(o.o_custkey AS STRING) AS PATIENT_ID, CAST(l.l_shipdate AS DATE) AS Shifted_date,
  CASE l.l_linenumber WHEN 1 THEN concat(' ', {_test('l.l_partkey')}, ' ') WHEN 2 THEN concat('SYN ', CAST(l.l_partkey % 97 AS STRING)) WHEN 4 THEN 'UNLISTED' ELSE {_test('l.l_suppkey + l.l_linenumber')} END AS LAB_NAME,
  CASE WHEN l.l_linenumber = 3 AND l.l_orderkey % 3 = 0 THEN '<5' WHEN l.l_orderkey % 101 = 5 THEN '' ELSE {_value(_TESTS, 'l.l_suppkey + l.l_linenumber', 'l.l_orderkey')} END AS RESULT
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey""",
    "deid_vital": f"""
SELECT CAST(o.o_custkey AS STRING) AS PATIENT_ID, CAST(o.o_orderdate AS DATE) AS Shifted_date,
  {_vital('o.o_orderkey')} AS VITAL_CODE, {_value(_VITALS, 'o.o_orderkey', 'o.o_custkey')} AS MEASUREMENT
FROM orders o""",
    "deid_dem": """
SELECT CAST(c_custkey AS STRING) AS PATIENT_ID, CAST(CASE WHEN c_custkey % 97 = 0 THEN 2 ELSE 30 + c_custkey % 60 END AS INT) AS AGE_AT_END
FROM customer WHERE c_custkey % 50 <> 7""",
    "earliest_dx_deid": """
SELECT CAST(o.o_custkey AS STRING) AS PATIENT_ID, o.o_orderpriority AS DX, CAST(MIN(o.o_orderdate) AS DATE) AS EARLIEST_DX
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
WHERE c.c_mktsegment IN ('FURNITURE','MACHINERY') AND o.o_orderpriority IN ('1-URGENT','2-HIGH') GROUP BY o.o_custkey, o.o_orderpriority""",
    # Codes are shared by several tests and synonyms; some names have two codes, some none.
    "dpi_lab_map": f"""
SELECT concat({_test('p.p_partkey')}, ' ') AS SUNQUEST_NAME, CASE WHEN p.p_partkey % 34 = 33 THEN NULL ELSE concat('C', CAST(p.p_partkey % 34 % 20 AS STRING)) END AS LOINC_CODE FROM part p
UNION ALL SELECT concat('SYN ', CAST(p.p_partkey % 97 AS STRING)) AS SUNQUEST_NAME, concat('C', CAST(p.p_partkey % 97 % 23 AS STRING)) AS LOINC_CODE FROM part p
UNION ALL SELECT concat('SYN ', CAST(p.p_partkey % 97 AS STRING)) AS SUNQUEST_NAME, 'C1' AS LOINC_CODE FROM part p WHERE p.p_partkey % 97 % 9 = 4
UNION ALL SELECT {_test('p.p_partkey')} AS SUNQUEST_NAME, 'C2' AS LOINC_CODE FROM part p WHERE p.p_partkey % 34 IN (3, 11, 25)""",
    "predictions": """
SELECT o_orderpriority AS horizon, CAST(o_orderkey AS STRING) AS patid,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, round(o_totalprice / 500000.0, 2) AS prob FROM orders""",
    "gappy_predictions": """
SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS horizon, CAST(o_orderkey AS STRING) AS patid,
  CASE WHEN o_orderkey % 41 = 1 THEN NULL WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
  CASE WHEN o_orderkey % 37 = 1 THEN NULL WHEN o_orderkey % 37 = 2 THEN CAST('NaN' AS DOUBLE) ELSE round(o_totalprice / 500000.0, 2) END AS prob FROM orders""",
    "gappy_log": """
SELECT CASE WHEN user_id % 10 <> 3 THEN user_id % 10 END AS run_id, event_id * 86400 + event_id % 5 * 1000000000 AS cnt,
  CASE WHEN event_id % 8000 = 77 THEN CAST('NaN' AS DOUBLE) ELSE value END AS loss FROM events""",
    "attributions": """
SELECT CAST(l.l_orderkey AS STRING) AS patid, l.l_linenumber AS pos, CASE WHEN l.l_linenumber = 2 THEN 'SEP' ELSE p.p_brand END AS code, l.l_discount - l.l_tax AS value
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey""",
    "training_log": """
SELECT user_id AS run_id, event_id AS cnt, value AS loss FROM events""",
}

_TABLES = ["customer", "part", "orders", "lineitem", "events"]


def _array(values):
    return "array(" + ", ".join(f"'{v}'" if isinstance(v, str) else _array(v) for v in values) + ")"


def _listed(text: str) -> str:
    """The same view with the texts to pick from as arrays that Spark makes once, instead of splitting them for each row."""
    for names in (_TESTS, _VITALS):
        lists, values = [",".join(v) for v in _around(names)], _array(_around(names))
        joined = re.escape("split_part('" + "|".join(lists) + "', '|', ")
        # Of a list in a list: the numbers of both, neither with a comma in it.
        text = re.sub(rf"split_part\({joined}(CAST\([^,]*? AS INT\))\), ',', ", rf"try_element_at(try_element_at({values}, \1), ", text)
    for values in (_TESTS, _vital_codes()):
        text = text.replace("split_part('" + "|".join(values) + "', '|', ", f"try_element_at({_array(values)}, ")
    return text


@functools.cache
def _open(spark, application, path):
    """The table, not its rows: saves reading the schema again for every query."""
    return spark.read.parquet(path)


class Views:
    """The views over one directory of test tables, as DataFrames: ``views.deid_dem`` and so on."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self._dir = sf_dir

    def table(self, name: str) -> DataFrame:
        path = f"{self._dir}/{name}.parquet"
        return _open(self.spark, self.spark.sparkContext.applicationId, path)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        text = _listed(VIEWS[name])
        for table in _TABLES:
            text = text.replace(f"FROM {table} ", "FROM {%s} " % table).replace(
                f"JOIN {table} ", "JOIN {%s} " % table
            )
            if text.endswith(f"FROM {table}"):
                text = text[: -len(table)] + "{%s}" % table
        used = {t: self.table(t) for t in _TABLES if "{%s}" % t in text}
        return self.spark.sql(text, **used)
