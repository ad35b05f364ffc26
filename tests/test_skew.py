from pyspark.sql import functions as F

from engram.plans import skew


def test_hot_keys_meet_a_broadcast_and_nothing_is_lost(spark, monkeypatch):
    left = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), "id").unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS k, -1L AS id"))
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("none", 3)], "k string, v int")
    counted = left.groupBy("k").agg(F.count("*").alias("n"))
    assert skew.hot_keys(counted, "k", "n", 1001) is None
    monkeypatch.setattr(skew, "HOT_FLOOR", 100)
    hot = skew.hot_keys(counted, "k", "n", 1001)
    assert [r.k for r in hot.collect()] == ["hot"]
    for how in ("left", "inner"):
        plain = sorted(map(tuple, left.join(right, "k", how).select("k", "id", "v").collect()), key=str)
        assert sorted(map(tuple, skew.join_unique(left, right, "k", hot, how).select("k", "id", "v").collect()), key=str) == plain
