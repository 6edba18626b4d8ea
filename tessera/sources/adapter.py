"""The driver's documents as three business sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import clean_text, normalize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str, blank_names: bool = False) -> DataFrame:
    """entity_id, business_name, business_address, country, src (1 to 3) and ord of every document.

    With ``blank_names`` two of each ten documents have no name.
    """
    name = F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 60)
    if blank_names:
        name = F.when(F.col("doc_id") % 10 < 2, F.lit("")).otherwise(name)
    place = F.col("doc_id") % 5
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("D"), F.col("doc_id")).alias("entity_id"), name.alias("business_name"), F.substring("text", 61, 80).alias("business_address"), F.col("lang").alias("country"),
        F.when(place == 0, 1).when(place <= 2, 2).otherwise(3).alias("src"), F.col("doc_id").alias("ord"),
    )


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(entities(spark, sf_dir))


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source 1, sources 2 and 3)."""
    return df.filter("src = 1"), df.filter("src > 1")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s1_id, c_id) of documents with the same cleaned text."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("D"), F.col("doc_id")).alias("id"), (F.col("doc_id") % 5).alias("place"), F.sha2(clean_text(F.col("text")), 256).alias("k"))
    s1 = docs.filter("place = 0").select(F.col("id").alias("s1_id"), "k")
    return s1.join(docs.filter("place > 0").select(F.col("id").alias("c_id"), "k"), "k").select("s1_id", "c_id")
