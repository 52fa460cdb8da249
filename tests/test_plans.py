"""Physical-plan checks: partial top-1 before the shuffle, pruned scans, one-pass rules."""

from strata.catalog.q_emissions import activity
from strata.operators.dedupe import latest_by_key
from strata.operators.joins import drop_stale
from strata.operators.quality import rule_max, rule_negative, rule_range, run_rules
from strata.plans.steps import plan_shape
from strata.spec import LoadSpec

TDATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_latest_by_key_has_partial_window_group_limit(spark):
    li = spark.read.parquet(f"{TDATA}/lineitem.parquet")
    p = latest_by_key(li, ["l_orderkey", "l_linenumber"], ["l_shipdate desc"])
    text = p._sc._jvm.org.apache.spark.sql.execution.SparkPlan  # noqa: F841 (JVM reachable)
    s = p._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in s and "Partial" in s


def test_projection_prunes_scan(spark):
    li = spark.read.parquet(f"{TDATA}/lineitem.parquet")
    df = li.where("l_shipdate >= '2000-01-01'").select("l_orderkey", "l_quantity")
    s = df._jdf.queryExecution().sparkPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_shipdate" in s
    assert "PushedFilters" in s and "l_shipdate" in s


def test_rules_run_in_one_aggregate(spark):
    a = activity(spark, TDATA)
    df = run_rules(a, [rule_negative("emissions_value"), rule_range("emission_factor"),
                       rule_max("energy_consumption")])
    s = df._jdf.queryExecution().sparkPlan().toString()
    # one scan (pruned to the three rule columns) and one aggregate: partial + final
    assert s.count("FileScan") == 1 and s.count("HashAggregate") == 2
    assert "ReadSchema: struct<l_quantity:double,l_discount:double,l_tax:double>" in s


def test_stale_reduces_target_before_join(spark):
    ev = spark.read.parquet(f"{TDATA}/events.parquet")
    df = drop_stale(ev, ev.where("ts < '2024-01-16'"), ["user_id", "event_type"], "ts")
    s = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [user_id" in s and "max(ts#" in s


def test_plan_shape_per_target():
    assert plan_shape(LoadSpec("a")) == "single"
    assert plan_shape(LoadSpec("a", stale_data_handling=True)) == "single"  # stale needs dedupe
    assert plan_shape(LoadSpec("a", source_deduplication=True)) == "single_dedupe"
    assert plan_shape(LoadSpec("a", source_deduplication=True, stale_data_handling=True),
                      n_targets=3) == "multi_dedupe_stale"
