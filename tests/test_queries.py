"""Registered queries: against DuckDB on the smallest tables, and invariants of the flow."""

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks import compare
from phasewise import names as N
from phasewise.functions import lineage, sizing
from phasewise.plans import person_flow
from phasewise.sources import tables, trial

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
# One or two per module; python -m checks.compare runs all of them.
CHECKED = ["cohort", "first_linked_visits", "indicator_pivot_drug", "measurements", "death_flags",
           "during_any_stay", "person_summary", "study_flow", "count_by_shift", "table_one_weighted", "smd", "odds_ratio_weighted"]


@pytest.fixture(scope="module")
def con():
    return compare.duck(FOLDER)


@pytest.mark.parametrize("key", CHECKED)
def test_matches_duckdb(spark, con, key):
    assert compare.differences(entry.queries()[key](spark, FOLDER), con, entry.oracle_sql()[key]) == ""


def test_every_check_has_a_query_and_names_are_allowed():
    keys = entry.queries().keys()
    assert entry.oracle_sql().keys() <= keys
    assert entry.llm or not [k for k in keys if k == "pipeline" or re.match(r"op\d+_", k)]


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    """The flow from written inputs to written outputs."""
    folder = str(tmp_path_factory.mktemp("study"))
    given = trial.study_tables(spark, FOLDER)
    for name in trial.STUDY_VIEWS:
        tables.write_table(getattr(given, name), f"{folder}/in", name)
    shared = lineage.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(shared))
    found = person_flow.write_outputs(tables.read_study(spark, f"{folder}/in"), trial.SETS, trial.WINDOWS, f"{folder}/out")
    assert set(os.listdir(shared)) == before  # no copy is left behind
    return found


def test_one_row_per_person(result):
    for name in ("cohort", "deaths", "linked", "person_summary"):
        assert result[name].count() == result[name].select(N.PERSON).distinct().count()
    assert result["person_summary"].count() == result["cohort"].count() > 0


def test_one_row_per_person_and_day(result):
    facts = result["day_facts"]
    assert facts.count() == facts.select(N.PERSON, N.DATE).distinct().count()
    assert facts.where((F.col(N.PRE) == 1) & (F.col(N.POST) == 1)).count() == 0
    assert facts.where(F.col(N.DATE).isNotNull() & (F.col(N.PRE) + F.col(N.POST) != 1)).count() == 0


def test_cohort_columns_in_order(result):
    assert result["cohort"].columns == N.COHORT_COLUMNS
    assert result["person_summary"].columns[:len(N.COHORT_COLUMNS)] == N.COHORT_COLUMNS


def test_plan_has_no_cross_join_and_prunes_the_scan(spark):
    df = entry.queries()["index_date"](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    for schema in re.findall(r"ReadSchema: struct<(.*?)>", plan):
        assert "o_totalprice" not in schema and "event_id,ts,user_id,event_type,value" not in schema


def test_every_output_is_built_from_written_ones(spark, tmp_path):
    """Each event table is scanned for the day merge once in the whole run."""
    built = []
    original = person_flow.build_day_facts

    def counted(*arguments):
        df = original(*arguments)
        built.append(df)
        return df

    person_flow.build_day_facts = counted
    try:
        found = person_flow.write_outputs(trial.study_tables(spark, FOLDER), trial.SETS, trial.WINDOWS, str(tmp_path))
    finally:
        person_flow.build_day_facts = original
    assert len(built) == 1
    for name, df in found.items():
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.startswith("Relation") and "Join" not in plan, name


def test_flow_without_any_broadcast(spark, con, monkeypatch):
    """The way beyond every size bound: all joins shuffle, and rows are still cut to the cohort before merging."""
    monkeypatch.setattr(sizing, "fits", lambda df, n=0: False)
    monkeypatch.setattr(sizing, "MAX_BROADCAST_BYTES", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        for key in ("day_facts", "person_summary"):
            df = entry.queries()[key](spark, FOLDER)
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Broadcast" not in plan and "coalesce(person_id" not in plan
            # each of the sources that are merged by day meets the cohort first
            logical = df._jdf.queryExecution().optimizedPlan().toString()
            assert logical.count("Join LeftSemi") >= 5
            assert compare.differences(df, con, entry.oracle_sql()[key]) == ""
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
