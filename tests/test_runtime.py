import pytest
from pyspark.sql import functions as F

from lexloom.plans import runtime
from lexloom.plans.components import components, spread


def test_shared_dir_needs_a_setting_on_a_cluster(spark, monkeypatch):
    assert runtime.single_process("local[8]") and runtime.single_process("local") and not runtime.single_process("local-cluster[3,4,1024]")
    if spark.sparkContext.getConf().get("spark.checkpoint.dir", None):
        return
    monkeypatch.setattr(runtime, "single_process", lambda master: False)
    with pytest.raises(ValueError):
        runtime.shared_dir(spark)


def test_star_is_spread(spark):
    """All edges of a giant star share a node, yet no partition gets more than its share, and the star is still one component."""
    star = spark.range(40_000).select(F.lit(-1).cast("long").alias("a"), F.col("id").alias("b"))
    sizes = [r["count"] for r in spread(star, 40_000, 5_000).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 10_000
    got = components(star.repartition(8), local_edges=1_000, part_edges=5_000)
    assert {r[0] for r in got.select("component").distinct().collect()} == {-1} and got.count() == 40_001


def test_two_stars_through_many_bridges(spark):
    left = spark.range(3_000).select(F.lit(10**6).cast("long").alias("a"), F.col("id").alias("b"))
    right = spark.range(3_000).select(F.col("id").alias("a"), (F.col("id") + 5_000).alias("b"))
    got = components(left.unionByName(right).repartition(5), local_edges=100, part_edges=400)
    assert {r[0] for r in got.select("component").distinct().collect()} == {0} and got.count() == 6_001
