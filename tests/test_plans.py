"""What the plans must look like to hold up on large tables."""

import datetime as D
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from epistrand.operators import cohort, encode, evaluate
from epistrand.operators import sequences as Q
from epistrand.plans import patient_runs, patient_sequences
from epistrand.sources import materialize
from helpers import shuffle_files
from verification.queries import QUERIES, Inputs, run

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_join_without_a_key(spark, name):
    plan = physical(run(name, spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_events_are_counted_before_their_first_shuffle(spark):
    plan = physical(run("patient_sequences", spark, SF_DIR))
    first = re.search(r"Exchange hashpartitioning\(PATIENT_ID#\d+, _groupingexpression#\d+, CODE#\d+, \d+\)", plan)
    assert first, plan
    # The rows below that shuffle are partial counts.
    assert re.match(r"[^\n]*\n[^\n]*HashAggregate\([^\n]*partial_count", plan[first.start():])


def test_events_are_never_broadcast(spark):
    plan = physical(run("patient_sequences", spark, SF_DIR))
    join = re.search(r"(\w+) \[PATIENT_ID#\d+, day#\d+\], \[PATIENT_ID#\d+, day#\d+\], Inner", plan)
    assert join and join.group(1) == "SortMergeJoin"


def test_length_reports_read_no_arrays(spark):
    seqs = materialize(Inputs(spark, SF_DIR).seqs)
    for report in (Q.sequence_summary(seqs), Q.visit_filter_report(seqs), Q.longest_sequences(seqs)):
        schemas = re.findall(r"ReadSchema: struct<([^>]*)>", physical(report))
        assert schemas and all("code" not in s and "age" not in s for s in schemas)


def test_filters_reach_the_scan(spark):
    seqs = materialize(Inputs(spark, SF_DIR).seqs)
    plan = physical(Q.latest(Q.min_visits(seqs, 5), 300).select("patid", "code"))
    assert re.search(r"PushedFilters: \[[^\n]*GreaterThanOrEqual\(n_visits,5\)", plan)
    assert "Exchange" not in plan


def test_building_a_plan_starts_no_job_but_storing_tables(spark):
    """Plans over stored inputs, for which nothing needs to be stored or counted."""
    i = Inputs(spark, SF_DIR)
    index, demo = i.index, i.demo
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    seqs = patient_sequences(i.raw_events.limit(10**9), index, demo)
    encode.truncate_with_cls(seqs, 10)
    evaluate.metrics_by_horizon(i.preds)
    cohort.undersample(i.preds.select("patid", "label"))
    assert set(tracker.getJobIdsForGroup(None)) == before


def test_metrics_take_one_pass(spark):
    plan = physical(run("metrics_by_horizon", spark, SF_DIR))
    assert plan.count("FileScan") <= 2 * plan.count("AdaptiveSparkPlan") + 4


def test_horizons_are_laid_out_once(spark):
    """One window over a patient's days for the layout and the horizons, one over a day's codes."""
    plan = physical(run("horizon_test_sets", spark, SF_DIR))
    assert len(re.findall(r"PATIENT_ID#\d+, day#\d+\], \[PATIENT_ID#\d+, day#\d+\]", plan)) == 1
    assert plan.count("Exchange hashpartitioning") <= 17


def test_binning_does_not_shuffle(spark):
    i = Inputs(spark, SF_DIR)
    events = run("universal_events", spark, SF_DIR)
    rows = events.filter(F.col("CODE").startswith("LAB:"))
    # The only shuffles are those of the crosswalk and of nothing else.
    shuffled = re.findall(r"Exchange hashpartitioning\(([^,]*),", physical(rows))
    assert all(s.startswith(("name#", "loinc#", "synonym#")) for s in shuffled), shuffled
    assert i.crosswalk.count() > 100


def odd_history(spark):
    """Events, index dates and ages with copies, missing dates, codes and patients, and patients censored whole."""
    rng = random.Random(3)

    def day():
        return rng.choice([None] + [D.date(2000, 1, 1) + D.timedelta(rng.randrange(900)) for _ in range(6)])

    rows = [(rng.choice([None] + [f"p{i}" for i in range(30)]), day(), rng.choice([None, "SEP", "", *"abc"])) for _ in range(1500)]
    rows += rng.choices(rows, k=800) + [("p1", D.date(1999, 5, 5), "a")] * 200
    index = [(f"p{i}", day()) for i in range(20)] + [(None, day()), ("p3", D.date(1990, 1, 1))]
    ages = [(f"p{i}", None if i % 9 == 0 else 3 + 2 * i) for i in range(1, 35)] + [(None, 3)]
    return (
        spark.createDataFrame(rows, "PATIENT_ID string, DATE date, CODE string"),
        spark.createDataFrame(index, "PATIENT_ID string, EARLIEST_DX date"),
        spark.createDataFrame(ages, "PATIENT_ID string, AGE_AT_END int"),
    )


def test_whole_sequences_need_no_layout(spark):
    """Neither windows nor their shuffles, and the same rows as by way of positions."""
    inputs = [materialize(t) for t in odd_history(spark)]
    found = patient_sequences(*inputs)
    plan = physical(found)
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") <= 7
    placed = Q.collect_runs(patient_runs(*inputs), ["PATIENT_ID"]).withColumnRenamed("PATIENT_ID", "patid")
    assert found.dtypes == placed.dtypes
    assert sorted(map(repr, found.collect())) == sorted(map(repr, placed.collect()))


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_segments_take_two_shuffles_of_events(spark, size):
    """Counted, and brought together by patient; never as pieces of segments. The same rows as by way of a layout."""
    inputs = [materialize(t) for t in odd_history(spark)]
    found = patient_sequences(*inputs, size)
    plan = physical(found)
    # The others are those of the index dates and ages.
    assert plan.count("Exchange hashpartitioning") <= 4
    assert not re.search(r"Exchange hashpartitioning\([^)]*start#", plan)
    placed = Q.collect_runs(patient_runs(*inputs), ["PATIENT_ID"], size).withColumnRenamed("PATIENT_ID", "patid")
    assert found.dtypes == placed.dtypes
    assert sorted(map(repr, found.collect())) == sorted(map(repr, placed.collect()))
    twice = inputs[2].unionByName(inputs[2].filter("PATIENT_ID = 'p5'"))
    with pytest.raises(Exception, match="several demographic rows of patient p5"):
        patient_sequences(*inputs[:2], twice, size).collect()


def test_visits_take_two_shuffles(spark):
    """Counted, and brought together by patient and day; the same rows as by way of positions."""
    events = odd_history(spark)[0]
    ages = F.when(F.pmod(F.xxhash64("DATE", "CODE"), F.lit(4)) > 0, F.pmod(F.xxhash64("CODE", "PATIENT_ID"), F.lit(90)).cast("string"))
    aged = materialize(events.withColumn("AGE", ages))
    found = Q.build_visits(aged)
    plan = physical(found)
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan and "Window" not in plan
    # The rows below the first are partial counts.
    assert re.search(r"Exchange hashpartitioning\(PATIENT_ID#\d+, _groupingexpression#\d+, CODE#\d+, AGE#\d+, \d+\)[^\n]*\n[^\n]*partial_count", plan)
    placed = Q.build_visits(aged, 10**6).drop("start")
    assert found.dtypes == placed.dtypes
    assert sorted(map(repr, found.collect())) == sorted(map(repr, placed.collect()))
    assert found.filter("DATE IS NULL").count() and found.filter(F.exists("code", lambda c: c.isNull())).count()


@pytest.mark.parametrize("name", ["mlm_mask_segments", "encode_mlm_segments"])
def test_shared_tables_leave_no_shuffle_files(spark, name):
    """Events, sequences, segments and vocabulary are stored before the query runs; their shuffles go one by one."""
    Inputs.forget()
    held = shuffle_files(spark)
    found = run(name, spark, SF_DIR)
    assert not shuffle_files(spark) - held
    assert found.count() > 0
