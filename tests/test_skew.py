from pyspark.sql import functions as F

from sessionloom.operators import skew


def test_rows_without_key_are_spread_over_tasks(spark):
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        df = spark.range(8_000).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).alias("key"))
        table = spark.range(0, 8_000, 20).select(F.col("id").alias("key"), (F.col("id") * 2).alias("value"))
        found = skew.left_lookup(df, table, "key").withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {(r.id, r.key, r.value) for r in found} == {
        (i, i if i % 10 == 0 else None, 2 * i if i % 20 == 0 else None) for i in range(8_000)
    }
    sizes = [sum(r.task == t for r in found) for t in {r.task for r in found}]
    assert len(sizes) == 4 and max(sizes) < 4_000  # of 8,000 rows 7,200 have no key
