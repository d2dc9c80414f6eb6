"""Plans of the key lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from odflow.functions.spread import lookup_join, salt_count


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_large_table_is_not_broadcast_with_its_copies(spark, tmp_path):
    path = str(tmp_path / "zones")
    spark.range(400_000).select(F.concat(F.lit("z"), "id").alias("k"), F.rand(1).alias("v")).write.parquet(path)
    table = spark.read.parquet(path)
    rows = table.select("k", F.lit("0").alias("origin"), F.lit("1").alias("destination"))
    salts, threshold = spark.conf.get("spark.odflow.salts", None), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.odflow.salts", "1024")
        small = plan_of(lookup_join(rows, table, ["k"]))
        assert "BroadcastHashJoin" in small and "Generate explode" not in small
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
        large = plan_of(lookup_join(rows, table, ["k"]))
        assert "Broadcast" not in large and "explode" in large
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.unset("spark.odflow.salts") if salts is None else spark.conf.set("spark.odflow.salts", salts)


def test_lookup_finds_the_same_on_both_paths(spark):
    rows = spark.createDataFrame([("a", "1", "2", 1), ("a", "2", "2", 2), ("b", "1", "1", 3), (None, "1", "1", 4)], "k string, origin string, destination string, x int")
    table = spark.createDataFrame([("a", 10), ("b", 20)], "k string, y int")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    found = []
    try:
        for size in (threshold, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
            found.append(sorted((r.x, r.y) for r in lookup_join(rows, table, ["k"], "left").collect() if r.y) + [lookup_join(rows, table, ["k"]).count()])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert found[0] == found[1] == [(1, 10), (2, 10), (3, 20), 3]
    assert salt_count(spark) >= int(spark.conf.get("spark.sql.shuffle.partitions"))
