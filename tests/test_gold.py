"""Gold load properties."""

from pyspark.sql import functions as F

from strata.plans.gold import GoldJob, run_gold

TDATA = "/root/testdata/sf0.001"


def test_gold_step_may_read_its_own_table(spark, scratch):
    orders = spark.read.parquet(f"{TDATA}/orders.parquet")
    gold = scratch("gold_self")
    base = orders.groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n")).withColumns({
            "created_time": F.lit("2024-01-01").cast("timestamp_ntz"), "created_by": F.lit("init"),
            "updated_time": F.lit("2024-01-01").cast("timestamp_ntz"), "updated_by": F.lit("init")})
    base.write.partitionBy("o_orderstatus", "o_orderpriority").parquet(gold)
    before = {(r.o_orderstatus, r.o_orderpriority): r.n for r in spark.read.parquet(gold).collect()}
    # the step doubles the slice's own count, reading the gold table it is about to replace
    spark.read.parquet(gold).createOrReplaceTempView("gold_self_vw")
    job = GoldJob(
        table_name="self", gold_path=gold, slice_values={"o_orderstatus": "F", "o_orderpriority": "2-HIGH"},
        steps=[("gold_final_df", "SELECT o_orderstatus, o_orderpriority, n * 2 AS n FROM gold_self_vw "
                                 "WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'")],
        schema=[("o_orderstatus", "string"), ("o_orderpriority", "string"), ("n", "bigint")],
        load_ts="2024-06-30 12:00:00", job_id="job-g")
    after = {(r.o_orderstatus, r.o_orderpriority): r.n for r in run_gold(spark, {}, job).collect()}
    assert after[("F", "2-HIGH")] == 2 * before[("F", "2-HIGH")]
    assert {k: v for k, v in after.items() if k != ("F", "2-HIGH")} == \
        {k: v for k, v in before.items() if k != ("F", "2-HIGH")}
