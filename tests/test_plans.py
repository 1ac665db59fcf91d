import re

import pytest
from conftest import SMALL

import __spark_entry__ as contract
from check import compare, duck
from perilake.operators import cleaning, features
from perilake.plans import PLANS, reports

RELATIONAL = [n for n in PLANS if n[0] in "bcgtu" and not n.startswith("c05")]


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", list(PLANS))
def test_plan_agrees_with_its_check(spark, con, name):
    ok, note, _ = compare(spark, con, SMALL, name, contract.queries()[name], contract.oracle_sql().get(name))
    assert ok, note


def test_entry(spark):
    assert contract.entry(spark).columns == ["TYPE_VEHICLE", "policies", "total_claims_paid"]


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", RELATIONAL)
def test_relational_plans_stay_in_the_jvm(lake, name):
    text = physical(PLANS[name].build(lake))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "ArrowEval" not in text


@pytest.mark.parametrize("name", ["g01_motor_kpis", "g06_driver_kpis", "g11_motor_profile", "g16_null_counts_motor"])
def test_reports_scan_once(lake, name):
    assert len(re.findall(r"FileScan parquet", physical(PLANS[name].build(lake)))) == 1


def test_filters_and_columns_reach_the_scan(lake):
    text = physical(PLANS["g12_make_profile"].build(lake))
    assert re.search(r"PushedFilters: \[[^]]*IsNotNull\(MAKE\)", text)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {f.split(":")[0] for f in schema.split(",")} == {"TYPE_VEHICLE", "MAKE", "PREMIUM", "CLAIM_PAID", "had_claim"}


def test_top_k_is_not_a_global_sort(lake):
    assert "TakeOrderedAndProject" in physical(PLANS["g03_policies_by_make"].build(lake))


def test_dedup_combines_before_its_shuffle(lake):
    text = physical(cleaning.dedup(lake.bronze("motor")))
    assert text.index("HashAggregate") < text.index("Exchange") and text.count("HashAggregate") == 2


@pytest.mark.parametrize("n", [1, 17])
def test_partitioning_does_not_change_results(lake, n):
    bronze = lake.bronze("motor")
    for report in (reports.motor_kpis, reports.motor_profile, reports.make_profile):
        moved = report(features.gold_motor(cleaning.silver_motor(bronze.repartition(n))))
        assert sorted(map(tuple, moved.collect()), key=str) == sorted(map(tuple, report(lake.gold("motor")).collect()), key=str)


def test_names_pair_up():
    assert set(contract.oracle_sql()) <= set(contract.queries())
