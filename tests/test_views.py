"""The views that Spark reads pick texts from arrays; they must give what their shared text gives."""

import re

import pytest

from verification.views import _TABLES, VIEWS, Views


@pytest.fixture
def folder(spark, tmp_path):
    key = lambda i, n, gap: None if i % gap == 0 else i % n
    rows = {
        "orders": ([(key(i, 97, 13), key(i, 11, 17), "2001-02-03", "1-URGENT") for i in range(1, 300)],
                   "o_orderkey long, o_custkey long, o_orderdate string, o_orderpriority string"),
        "lineitem": ([(key(i, 97, 19), key(i, 211, 23), key(i, 31, 29), key(i, 7, 31), "2001-02-04") for i in range(1, 600)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate string"),
        "part": ([(key(i, 500, 37), f"Brand#{i % 5}") for i in range(1, 400)], "p_partkey long, p_brand string"),
        "customer": ([(i, "MACHINERY") for i in range(11)], "c_custkey long, c_mktsegment string"),
    }
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", [n for n, text in VIEWS.items() if "split_part" in text])
def test_picks_from_arrays_give_the_rows_of_the_text(spark, folder, name):
    views = Views(spark, folder)
    text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(_TABLES)})\b", r"\1 {\2}", VIEWS[name])
    used = {t: views.table(t) for t in _TABLES if "{%s}" % t in text}
    want, got = spark.sql(text, **used), getattr(views, name)
    assert got.schema == want.schema
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # No text is split for each row.
    assert "split" not in got._jdf.queryExecution().optimizedPlan().toString()
