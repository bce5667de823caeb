"""p4: variant spellings in parties.name and llm_party_results.name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.pairing import pairs_within
from lexloom.llm.variants import link_variants
from lexloom.session import table


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["id", "name"]
    return table(spark, sf_dir, "parties").select(*cols).unionByName(table(spark, sf_dir, "llm_party_results").select(*cols))


def p4_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mention with its entity, a number shared by all its spellings; null for names that can't be parsed."""
    m = _mentions(spark, sf_dir)
    return m.join(link_variants(m), "name", "left").select("id", "name", "entity")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = p4_entities(spark, sf_dir).filter("entity is not null")
    return pairs_within(e, ["entity"], "id", ["name"]).filter("name_a <> name_b").select("id_a", "id_b").distinct()


def p4_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with its mentions, and whether all of these are one entity."""
    return p4_entities(spark, sf_dir).filter("name is not null").groupBy("name").agg(F.count("*").alias("mentions"), (F.count_distinct("entity") <= 1).alias("one_entity"))


QUERIES = {"p4_found": p4_found, "p4_entities": p4_entities, "p4_spellings": p4_spellings}
ORACLE = {"p4_spellings": "SELECT name, count(*) AS mentions, true AS one_entity FROM (SELECT name FROM parties UNION ALL SELECT name FROM llm_party_results) WHERE name IS NOT NULL GROUP BY name"}
