"""Pairs of members of one class, as the found queries need them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a class that one task pairs with all of it.
PART_ROWS = 2_000


def pairs_within(members: DataFrame, keys: list[str], id_col: str, keep: list[str] = (), part_rows: int = PART_ROWS) -> DataFrame:
    """(keys, id_a, id_b, keep_a, keep_b) for every two different ids of a class, the smaller one first. Output grows with the square of a
    class by its nature; classes of more than ``part_rows`` members (at most rows / part_rows) are paired in parts, each with the whole
    class, so no task makes more than part_rows x class pairs."""
    large = members.groupBy(*keys).count().filter(F.col("count") > part_rows).select(*keys, F.ceil(F.col("count") / part_rows).cast("int").alias("_parts"))
    cut = members.join(F.broadcast(large), keys, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    side = lambda c: [F.col(id_col).alias(f"id_{c}"), *(F.col(k).alias(f"{k}_{c}") for k in keep)]
    a = cut.select(*keys, F.pmod(F.xxhash64(id_col), F.col("_parts")).cast("int").alias("_part"), *side("a"))
    b = cut.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), *side("b"))
    return a.join(b, [*keys, "_part"]).filter("id_a < id_b").drop("_part")
