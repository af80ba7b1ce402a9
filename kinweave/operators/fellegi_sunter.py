"""Probabilistic classification: m and u by expectation maximisation over compressed comparison patterns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators.linkage import Options, best_per_left

FIELDS = ["name", "father", "year", "place"]
UPPER, LOWER, ITERATIONS = 8.0, 2.0, 10
_TINY = 1e-10


def level_counts(o: Options) -> dict[str, int]:
    n = o.levels if o.method else 2
    return {"name": n, "father": o.levels if o.fuzzy_father and o.method else 2, "year": 2, "place": 2}


def estimate(patterns: list[tuple[tuple[int | None, ...], int]], levels: dict[str, int], iterations: int = ITERATIONS) -> tuple[dict, dict, float]:
    """m, u by (field, level), and the share of matches; patterns are level tuples with their number of pairs.

    The number of patterns is bounded by the product of the levels, whatever the number of pairs.  A fixed number of
    iterations, as the results depend on it.  Every (field, level) is one column of an indicator matrix over patterns.
    """
    fields = [f for k, f in enumerate(levels) if any(p[k] is not None for p, _ in patterns)]
    place = {f: k for k, f in enumerate(levels)}
    columns = [(f, v) for f in fields for v in range(levels[f])]
    n = np.array([c for _, c in patterns], float)
    has = np.array([[p[place[f]] == v for f, v in columns] for p, _ in patterns], float).reshape(len(patterns), len(columns))
    # columns of one field, to sum its levels
    same = np.array([[f == g for g, _ in columns] for f, _ in columns], float).reshape(len(columns), len(columns))
    top = np.array([v == levels[f] - 1 for f, v in columns])
    others = np.array([max(1, levels[f] - 1) for f, _ in columns], float)
    m, u = np.where(top, 0.9, 0.1 / others), np.where(top, 0.1, 0.9 / others)
    share = 0.1
    log = lambda x: np.log(np.maximum(x, _TINY))
    for _ in range(iterations if len(n) and n.sum() else 0):
        odds = log(share) + has @ log(m) - log(1 - share) - has @ log(u)
        w = n / (1 + np.exp(np.minimum(700.0, -odds)))
        share = w.sum() / n.sum()
        m, u = ((x @ has + 1e-6) / (same @ (x @ has) + same.sum(1) * 1e-6) for x in (w, n - w))
    return dict(zip(columns, map(float, m), strict=True)), dict(zip(columns, map(float, u), strict=True)), float(share)


def fit(patterns: DataFrame, o: Options, iterations: int = ITERATIONS) -> DataFrame:
    """(field, level, m, u) from pattern counts: at most a few hundred rows reach the driver."""
    cols = [f"lv_{f}" for f in FIELDS]
    rows = patterns.orderBy(*cols).collect()
    m, u, _ = estimate([(tuple(r[c] for c in cols), r["n"]) for r in rows], level_counts(o), iterations)
    return model_frame(patterns.sparkSession, m, u)


def model_frame(spark: SparkSession, m: dict, u: dict) -> DataFrame:
    return spark.createDataFrame([(f, v, float(m[f, v]), float(u[f, v])) for f, v in m], "field string, level int, m double, u double")


def scored(vectors: DataFrame, model: DataFrame) -> DataFrame:
    """vectors + fs: sum over present fields of log2(m / u); the model is a few rows and becomes one map."""
    ratio = F.log2(F.greatest("m", F.lit(_TINY)) / F.greatest("u", F.lit(_TINY)))
    # one row with a map of at most a few dozen entries
    one = model.select(F.concat_ws(":", "field", "level").alias("k"), ratio.alias("w")).agg(F.map_from_entries(F.collect_list(F.struct("k", "w"))).alias("w"))
    total = F.lit(0.0)
    for f in FIELDS:
        total = total + F.when(F.col(f"lv_{f}").isNull(), 0.0).otherwise(F.coalesce(F.try_element_at("w", F.concat(F.lit(f"{f}:"), F.col(f"lv_{f}").cast("string"))), F.lit(0.0)))
    return vectors.join(F.broadcast(one)).withColumn("fs", total).drop("w")


def matches(scores: DataFrame, upper: float = UPPER, keep_all: bool = False) -> DataFrame:
    sure = scores.filter(F.col("fs") >= upper).select("a_id", "b_id", F.col("fs").alias("score"))
    return sure if keep_all else best_per_left(sure, True)


def review(scores: DataFrame, lower: float = LOWER, upper: float = UPPER) -> DataFrame:
    """Pairs between the bounds, also those of left records that matched."""
    return scores.filter((F.col("fs") >= lower) & (F.col("fs") < upper)).select("a_id", "b_id", F.col("fs").alias("score"))


def printed(model: DataFrame) -> DataFrame:
    """Text lines of the model that ``read_estimates`` reads again, four decimals."""
    n = model.groupBy("field").agg((F.max("level") + 1).alias("n"))
    return model.join(n, "field").select(F.format_string("%s level %d/%d: m=%.4f, u=%.4f", "field", "level", "n", "m", "u").alias("value"))
