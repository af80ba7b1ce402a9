"""Queries of problem 2: groups of records linked by pairwise matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.components import connected_groups
from kinweave.plans.runtime import table


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vertex, group; ids carry their table in the lowest bit, so equal numbers of the two tables stay apart."""
    pairs = table(spark, sf_dir, "match_pairs").select("row_idx", F.expr("try_cast(trim(IDNumber) as bigint)").alias("id"))
    pairs = pairs.select((F.col("row_idx") * 2).alias("x"), (F.col("id") * 2 + 1).alias("y"))
    return connected_groups(pairs, "x", "y")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = lambda c: F.shiftright(F.col(c), 1)
    return _linked(spark, sf_dir).select(half("vertex").alias("record_key"), half("group").alias("group_key"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups there are of each size."""
    g = found(spark, sf_dir).groupBy("group_key").agg(F.count(F.lit(1)).alias("n_records"))
    return g.groupBy("n_records").agg(F.count(F.lit(1)).alias("n_groups"))


def queries() -> dict:
    return {"p2_found": found, "p2_group_sizes": sizes}


def oracle_sql() -> dict[str, str]:
    """Everything that every record reaches, by recursion; numbers of the two tables are kept apart by their lowest bit."""
    edges = "select distinct row_idx*2 as a, try_cast(trim(IDNumber) as bigint)*2+1 as b from match_pairs where row_idx is not null and try_cast(trim(IDNumber) as bigint) is not null"
    groups = f"with recursive e0 as ({edges}), e as (select a, b from e0 union all select b, a from e0), reach(v,u) as (select a, a from e union select r.v, e.b from reach r join e on r.u=e.a), g as (select v//2 as record_key, min(u)//2 as group_key from reach group by v)"
    return {
        "p2_found": f"{groups} select record_key, group_key from g",
        "p2_group_sizes": f"{groups} select n_records, count(*) as n_groups from (select group_key, count(*) as n_records from g group by 1) group by 1",
    }
