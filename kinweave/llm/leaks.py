"""Queries of problem 8: test items that leaked into the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import align
from kinweave.plans.runtime import table


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sure = passages(spark, sf_dir).filter((F.col("span") >= align.MIN_SPAN) & (F.col("met") >= align.MIN_MATCHED))
    return sure.select("item_id", "doc_id").distinct()


def leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report: in how many documents each leaked item stands."""
    return found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))


def queries() -> dict:
    return {"p8_found": found, "p8_leaked_items": leaked_items}


def oracle_sql() -> dict[str, str]:
    return {}
