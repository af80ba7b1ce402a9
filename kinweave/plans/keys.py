"""Queries over skewed keys (problem 3) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators import keychunks as K
from kinweave.plans.runtime import table

KEYS = ["name_and_surname", "birth_year"]
ORDER = ["entered_at", "row_idx", "loaded_at"]
#: Days without an entry after which a new batch of entries of a key begins.
BATCH_DAYS = 3
HEAVY_SHARE = 0.01


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, as stored, that hold at least 1 % of all rows; second deliveries count."""
    df = table(spark, sf_dir, "match_entries").select(*KEYS, *ORDER)
    return K.weighted_keys(df, KEYS, ORDER, HEAVY_SHARE).select(*KEYS)


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every key: rows, records, first and last entry, and the number of batches its entries came in.

    The batch count needs a key's rows in order; it comes from chunk states merged over their boundaries.
    """
    df = table(spark, sf_dir, "match_entries").select(*KEYS, *ORDER)
    gap = F.lit(BATCH_DAYS * 86400)
    at = lambda c: F.unix_micros(c) / F.lit(1_000_000)
    inner = (at(F.col("entered_at")) - at(F.col("prev.entered_at")) > gap).cast("int")
    across = (at(F.col("__head.entered_at")) - at(F.col("prev.entered_at")) > gap).cast("int")
    aggs = [F.min("entered_at").alias("first_entry"), F.max("entered_at").alias("last_entry"), F.count("entered_at").alias("n_dated")]
    states = K.merged_steps(K.chunked_states(df, KEYS, ORDER, aggs, inner), KEYS, across)
    return states.groupBy(*KEYS).agg(
        F.sum("__rows").alias("n_rows"),
        F.sum("n_dated").alias("n_dated"),
        F.min("first_entry").alias("first_entry"),
        F.max("last_entry").alias("last_entry"),
        (F.sum("__steps") + 1).alias("n_batches"),
    )


def queries() -> dict:
    return {"p3_found": found, "p3_key_profile": profile}


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": """
            select name_and_surname, birth_year from match_entries group by all
            having count(*) >= 0.01 * (select count(*) from match_entries)""",
        "p3_key_profile": f"""
            select name_and_surname, birth_year, count(*) as n_rows, count(entered_at) as n_dated, min(entered_at) as first_entry,
              max(entered_at) as last_entry, sum(case when gap > {BATCH_DAYS * 86400} then 1 else 0 end) + 1 as n_batches
            from (select *, epoch(entered_at) - epoch(lag(entered_at) over (partition by name_and_surname, birth_year
                    order by entered_at nulls first, row_idx, loaded_at)) as gap from match_entries)
            group by name_and_surname, birth_year""",
    }
