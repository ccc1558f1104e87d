"""Tables of a folder of Parquet as views for SQL text. Views are lazy: only tables a statement names are scanned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import dialect

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def sql(spark: SparkSession, sf_dir: str, text: str, compat: bool = False) -> DataFrame:
    """Run one SELECT of the dialect with {table} placeholders bound to the folder's Parquet tables."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(dialect.rewrite(text, compat), **used)


def oracle(text: str) -> str:
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text
