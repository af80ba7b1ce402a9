"""Set-similarity join by prefix filtering (problem 5).

Tokens are ordered by how rare they are over both sides.  Two sets can only reach Jaccard t if they share a token
among the first n - ceil(t n) + 1 of that order, so only these are joined; sizes and positions cut candidates further
and Jaccard is computed exactly on the rest.  No pair at or above t is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _prefixes(sets: DataFrame, freq: DataFrame, side: str, t: float) -> DataFrame:
    """One row per prefix token: token, id, set, size, position."""
    tokens = sets.select(F.col("id"), F.explode("tokens").alias("tok")).join(freq, "tok")
    ranked = tokens.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "tok"))).alias("o"))
    ranked = ranked.select("id", F.transform("o", lambda x: x["tok"]).alias("toks"), F.size("o").alias("len"))
    keep = (F.col("len") - F.ceil(F.lit(t) * F.col("len") - F.lit(1e-9)) + 1).cast("int")
    rows = ranked.select("id", "toks", "len", F.posexplode(F.slice("toks", F.lit(1), keep)).alias("pos", "tok"))
    return rows.select("tok", F.col("id").alias(f"{side}_id"), F.col("toks").alias(f"{side}_toks"), F.col("len").alias(f"{side}_len"), F.col("pos").alias(f"{side}_pos"))


def similar_sets(left: DataFrame, right: DataFrame, t: float) -> DataFrame:
    """(left_id, right_id, jaccard) of all pairs of sets with Jaccard >= t > 0.

    Both inputs have ``id`` (any type) and ``tokens`` (array of strings; repeats within a set count once).  Null or
    empty sets match nothing.  An id that occurs more than once is taken with the union of its tokens.
    """
    sides = []
    for df in (left, right):
        df = df.select("id", F.explode("tokens").alias("tok")).filter("id is not null and tok is not null").distinct()
        sides.append(df.groupBy("id").agg(F.collect_list("tok").alias("tokens")))
    freq = sides[0].unionByName(sides[1].select(F.col("id"), "tokens")).select(F.explode("tokens").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    a, b = _prefixes(sides[0], freq, "left", t), _prefixes(sides[1], freq, "right", t)
    need = F.lit(t) / F.lit(1 + t) * (F.col("left_len") + F.col("right_len"))
    bound = F.least(F.col("left_len") - F.col("left_pos"), F.col("right_len") - F.col("right_pos"))
    # the first common prefix token of a pair has the most room left, so a pair cut here at one token stays at another
    pairs = a.join(b, "tok").filter((F.col("left_len") >= F.lit(t) * F.col("right_len") - 1e-9) & (F.col("right_len") >= F.lit(t) * F.col("left_len") - 1e-9) & (bound >= need - 1e-9))
    same = F.size(F.array_intersect("left_toks", "right_toks"))
    scored = pairs.select("left_id", "right_id", (same / (F.col("left_len") + F.col("right_len") - same)).alias("jaccard"))
    return scored.filter(F.col("jaccard") >= F.lit(t) - 1e-9).distinct()
