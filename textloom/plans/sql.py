"""The tables under their names, for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def register(spark: SparkSession, sf_dir: str, tables: list[str] | None = None) -> None:
    for t in tables or TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.sql(text)
