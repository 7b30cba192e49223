import collections

from pyspark.sql import functions as F

from tidemark.operators import documents
from tidemark.operators.joins import first_by, hot_keys, lookup_join, salted_join


def _facts(spark):
    # A third of the rows share one key, some have none.
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .when(F.col("id") % 50 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("k"), F.col("id") % 700))
        .alias("k"),
        F.col("id").alias("n"),
    )


def _lookup(spark):
    return spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("k2", 4), ("zz", 5)], "k string, v int")


def _bag(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_every_join_type_agrees_with_a_plain_join(spark):
    facts, lookup = _facts(spark), _lookup(spark)
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = _bag(facts.join(lookup, "k", how))
        assert _bag(lookup_join(facts, lookup, ["k"], how)) == want, how
        assert _bag(salted_join(facts, lookup, ["k"], how, slots=4, buckets=7)) == want, how


def test_hot_keys_are_few_and_found(spark):
    got = [r.k for r in hot_keys(_facts(spark), ["k"], slots=10).collect()]
    assert got == ["hot"]


def test_hot_key_is_spread_over_tasks(spark):
    joined = salted_join(_facts(spark), _lookup(spark), ["k"], "inner", slots=4, buckets=64)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        per_task = joined.where("k = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(per_task) >= 4


def test_building_a_lookup_join_runs_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan-time", "joins are lazy")
    try:
        joined = lookup_join(_facts(spark), _lookup(spark).repartition(3), ["k"])
        assert len(tracker.getJobIdsForGroup("plan-time")) == 0
        joined.count()
        assert len(tracker.getJobIdsForGroup("plan-time")) > 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_adaptive_execution_broadcasts_a_small_lookup(spark):
    joined = lookup_join(_facts(spark), _lookup(spark).repartition(3), ["k"])
    joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan.split("Initial Plan")[0]


def test_first_by_takes_the_earliest(spark):
    df = spark.createDataFrame([("a", 3, "z"), ("a", 1, "x"), ("b", 2, None)], "k string, ord int, v string")
    assert sorted(map(tuple, first_by(df, ["k"], ["ord"]).collect())) == [("a", 1, "x"), ("b", 2, None)]


def test_ordered_lag_equals_a_plain_lag(spark):
    from pyspark.sql import Window

    rows = [("hot" if i % 3 else f"u{i % 5}", f"2025-{1 + i % 12:02d}-{1 + i % 28:02d}T{i % 24:02d}:00:{i % 60:02d}Z", None if i % 11 == 0 else f"h{i % 4}") for i in range(400)]
    df = spark.createDataFrame(rows, "url string, at string, h string").dropDuplicates(["url", "at"])
    plain = df.withColumn("p", F.lag("h").over(Window.partitionBy("url").orderBy("at")))
    split = documents.ordered_lag(df, "url", "at", "h", "p", F.substring("at", 1, 7))
    assert _bag(split.select("url", "at", "h", "p")) == _bag(plain.select("url", "at", "h", "p"))
