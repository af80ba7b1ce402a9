"""Queries of problem 7: documents put into containers of a fixed number of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import bins
from kinweave.plans.runtime import table


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which container each text, or part of a text longer than a container, goes into."""
    docs = table(spark, sf_dir, "documents")
    return bins.packed(bins.sized_texts(docs))


def fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report: number of containers, tokens, and the share of capacity used."""
    per = containers(spark, sf_dir).groupBy("container").agg(F.sum("tokens").alias("t"))
    return per.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("t").alias("n_tokens"), F.max("t").alias("most_tokens"), (F.sum("t") / F.count(F.lit(1)) / F.lit(bins.CAPACITY[0])).alias("share_used"))


def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of what must hold: every text is packed, nothing is over a limit, and only texts over a limit are split."""
    tokens, segments, loss = bins.CAPACITY
    items = containers(spark, sf_dir)
    per = items.groupBy("container").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("s"), F.sum("loss_tokens").alias("l"))
    over = per.agg(F.count_if((F.col("t") > tokens) | (F.col("s") > segments) | (F.col("l") > loss)).alias("n_over"))
    texts = items.groupBy("doc_id").agg(F.sum("tokens").alias("t"), F.sum("loss_tokens").alias("l"), F.count(F.lit(1)).alias("k"), F.max("n_parts").alias("n"))
    kept = texts.agg(F.count(F.lit(1)).alias("n_texts"), F.count_if((F.col("k") > 1) & (F.col("t") <= tokens) & (F.col("l") <= loss)).alias("n_split_in_vain"), F.count_if(F.col("k") != F.col("n")).alias("n_incomplete"))
    return kept.join(F.broadcast(over))


def queries() -> dict:
    return {"p7_containers": containers, "p7_fill": fill, "p7_limits": limits}


def oracle_sql() -> dict[str, str]:
    return {"p7_limits": "select count(distinct doc_id) as n_texts, 0::bigint as n_split_in_vain, 0::bigint as n_incomplete, 0::bigint as n_over from documents"}
