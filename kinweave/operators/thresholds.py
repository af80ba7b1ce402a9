"""Choosing a score threshold from the distribution of scores, and comparing result sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _counts(scores: DataFrame) -> tuple[Column, Column]:
    """How many scores there are and their sum; a column ``n`` tells how often each one counts."""
    if "n" in scores.columns:
        return F.sum("n"), F.sum(F.col("n") * F.col("score"))
    return F.count(F.lit(1)), F.sum("score")


def score_counts(scores: DataFrame) -> DataFrame:
    """score2 (two decimals), n, s (sum of the raw scores)."""
    n, s = _counts(scores)
    return scores.filter("score is not null").groupBy(F.round("score", 2).alias("score2")).agg(n.alias("n"), s.alias("s"))


def distribution(scores: DataFrame) -> DataFrame:
    """score2, n, cumulative count and share from the highest score down.

    The grid of two-decimal scores is small (its size depends on the range of scores), so one ordered window over it
    is bounded.
    """
    c = score_counts(scores)
    w = Window.orderBy(F.desc("score2")).rowsBetween(Window.unboundedPreceding, 0)
    return c.select("score2", "n", F.sum("n").over(w).alias("cum"), (F.sum("n").over(w) * 100.0 / F.sum("n").over(Window.partitionBy())).alias("cum_pct"))


def max_gap(scores: DataFrame) -> DataFrame:
    """The widest gap between neighbouring scores, weighted by the smaller side; the first of equal ones."""
    w = Window.orderBy("score2")
    c = score_counts(scores).select("score2", F.lead("score2").over(w).alias("hi"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("below"), F.sum("n").over(Window.partitionBy()).alias("total"))
    g = c.filter("hi is not null").withColumn("gap", F.col("hi") - F.col("score2"))
    g = g.withColumn("weight", F.col("gap") * F.log1p(F.least("below", F.col("total") - F.col("below"))))
    best = g.agg(F.min_by(F.struct("score2", "hi", "gap"), F.struct(-F.col("weight"), F.col("score2"))).alias("x"))
    return best.select(((F.col("x.score2") + F.col("x.hi")) / 2).alias("threshold"), F.col("x.gap").alias("gap"), F.col("x.score2").alias("lower_score"), F.col("x.hi").alias("upper_score"))


def otsu(scores: DataFrame) -> DataFrame:
    """Largest variance between the two classes over the two-decimal grid; raw scores are compared with it."""
    grid = score_counts(scores).select("score2")
    n, s = _counts(scores)
    raw = scores.filter("score is not null").groupBy(F.ceil(F.col("score") * 100 - 1e-9).alias("up")).agg(n.alias("n"), s.alias("s"))
    w = Window.orderBy("k").rangeBetween(Window.unboundedPreceding, 0)
    # raw scores and grid points on one axis of hundredths: a score counts at every grid point not below it
    marks = raw.select(F.col("up").alias("k"), "n", "s", F.lit(None).cast("double").alias("score2")).unionAll(grid.select(F.round(F.col("score2") * 100).cast("long"), F.lit(0).cast("long"), F.lit(0.0), F.col("score2")))
    c = marks.withColumns({"c": F.sum("n").over(w), "cs": F.sum("s").over(w), "t": F.sum("n").over(Window.partitionBy()), "ts": F.sum("s").over(Window.partitionBy())}).filter("score2 is not null")
    c = c.withColumn("hi", F.lead("score2").over(Window.orderBy("score2"))).filter("hi is not null and c > 0 and c < t")
    var = (F.col("c") / F.col("t")) * (1 - F.col("c") / F.col("t")) * F.pow(F.col("cs") / F.col("c") - (F.col("ts") - F.col("cs")) / (F.col("t") - F.col("c")), 2)
    best = c.withColumn("v", var).agg(F.min_by(F.struct("score2", "hi", "v"), F.struct(-F.col("v"), F.col("score2"))).alias("x"))
    return best.select(((F.col("x.score2") + F.col("x.hi")) / 2).alias("threshold"), F.col("x.v").alias("variance"))


def widest_gap(scores: DataFrame) -> DataFrame:
    """The mid-point of the widest gap between neighbouring scores, sizes of the sides left aside; the score itself, if there is one only."""
    w = Window.orderBy("score2")
    c = score_counts(scores).select("score2", F.lead("score2").over(w).alias("hi"))
    best = c.agg(F.min_by(F.struct("score2", "hi"), F.struct(F.when(F.col("hi").isNull(), 1).otherwise(0), F.col("score2") - F.col("hi"), F.col("score2"))).alias("x"))
    return best.select(F.coalesce((F.col("x.score2") + F.col("x.hi")) / 2, F.col("x.score2")).alias("threshold"))


def kde_valley(scores: DataFrame) -> DataFrame:
    """Mid-point between neighbouring scores with the least Gaussian kernel density; of fewer than three scores the widest gap.

    Densities are summed over raw scores grouped to six decimals, against the mid-points of the two-decimal grid: a stated
    set of points whose number does not grow with the rows.
    """
    raw = scores.filter("score is not null").groupBy(F.round("score", 6).alias("score")).agg(_counts(scores)[0].alias("n"))
    stats = raw.agg(F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("mean"))
    spread = raw.join(F.broadcast(stats)).agg(F.first("total").alias("total"), F.sqrt(F.sum(F.col("n") * F.pow(F.col("score") - F.col("mean"), 2)) / F.first("total")).alias("sd"))
    width = spread.select("total", F.when(F.col("sd") > 0, 1.06 * F.col("sd") * F.pow("total", F.lit(-0.2))).otherwise(1.0).alias("h"))
    mids = score_counts(scores).select(((F.col("score2") + F.lead("score2").over(Window.orderBy("score2"))) / 2).alias("mid")).filter("mid is not null")
    pts = F.broadcast(mids.agg(F.sort_array(F.collect_list("mid")).alias("mids")))  # the grid: a few thousand numbers
    dens = raw.join(pts).join(F.broadcast(width)).select(F.explode("mids").alias("mid"), "n", "score", "h", "total")
    dens = dens.groupBy("mid").agg((F.sum(F.col("n") * F.exp(-0.5 * F.pow((F.col("mid") - F.col("score")) / F.col("h"), 2))) / (F.first("total") * F.first("h") * F.sqrt(F.lit(2.0) * F.pi()))).alias("density"))
    best = dens.agg(F.min_by("mid", F.struct("density", "mid")).alias("mid"), F.min("density").alias("density"), F.count(F.lit(1)).alias("n_mids"))
    both = best.join(F.broadcast(widest_gap(scores).withColumnRenamed("threshold", "gap")))
    many = F.col("n_mids") >= 2
    return both.select(F.when(many, F.col("mid")).otherwise(F.col("gap")).alias("threshold"), F.when(many, F.col("density")).alias("density"))


def chosen(scores: DataFrame, manual: float | None = None) -> DataFrame:
    """The manual threshold, else Otsu's, else the widest gap's."""
    if manual is not None:
        return scores.sparkSession.createDataFrame([(float(manual),)], "threshold double")
    a, b = otsu(scores).select(F.col("threshold").alias("t1")), max_gap(scores).select(F.col("threshold").alias("t2"))
    return a.join(b).select(F.coalesce("t1", "t2").alias("threshold"))


def overlap(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """n_both, n_only_found, n_only_truth, recall, precision of two sets of distinct keys."""
    a, b = found.select(*keys).distinct().withColumn("f", F.lit(1)), truth.select(*keys).distinct().withColumn("t", F.lit(1))
    c = a.join(b, keys, "full").agg(F.count_if(F.expr("f = 1 and t = 1")).alias("n_both"), F.count_if(F.expr("t is null")).alias("n_only_found"), F.count_if(F.expr("f is null")).alias("n_only_truth"))
    both = F.col("n_both")
    return c.select("*", (both / F.nullif(both + F.col("n_only_truth"), F.lit(0))).alias("recall"), (both / F.nullif(both + F.col("n_only_found"), F.lit(0))).alias("precision"))


def applied(scored: DataFrame, threshold: float) -> DataFrame:
    """Pairs at or above a threshold (columns kept)."""
    return scored.filter(F.col("score") >= threshold)


def by_method(scored: DataFrame, exact: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """For each method and its threshold (method, threshold): pairs kept, those exact matching has too, recall and precision."""
    kept = scored.select("score", *keys).join(F.broadcast(thresholds)).filter(F.col("score") >= F.col("threshold")).select("method", *keys).distinct()
    truth = exact.select(*keys).distinct().withColumn("t", F.lit(1))
    total = truth.agg(F.count(F.lit(1)).alias("n_exact"))
    c = kept.join(truth, keys, "left").groupBy("method").agg(F.count(F.lit(1)).alias("n_kept"), F.count("t").alias("n_both"))
    c = thresholds.join(c, "method", "left").na.fill(0, ["n_kept", "n_both"]).join(F.broadcast(total))
    return c.select("method", "threshold", "n_kept", "n_both", "n_exact", (F.col("n_both") / F.nullif("n_exact", F.lit(0))).alias("recall"), (F.col("n_both") / F.nullif("n_kept", F.lit(0))).alias("precision"))


def by_method_counted(counts: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``by_method`` from how many pairs there are of each score, found by exact matching or not (score, exact, n)."""
    kept = F.col("score") >= F.col("threshold")
    total = counts.agg(F.coalesce(F.sum(F.when(F.col("exact"), F.col("n"))), F.lit(0)).alias("n_exact"))
    c = counts.join(F.broadcast(thresholds)).filter(kept).groupBy("method").agg(F.sum("n").alias("n_kept"), F.sum(F.when(F.col("exact"), F.col("n")).otherwise(0)).alias("n_both"))
    c = thresholds.join(c, "method", "left").na.fill(0, ["n_kept", "n_both"]).join(F.broadcast(total))
    return c.select("method", "threshold", "n_kept", "n_both", "n_exact", (F.col("n_both") / F.nullif("n_exact", F.lit(0))).alias("recall"), (F.col("n_both") / F.nullif("n_kept", F.lit(0))).alias("precision"))


def top_gaps(scores: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` widest gaps between neighbouring scores; of equal ones the lower first."""
    c = score_counts(scores).select("score2", F.lead("score2").over(Window.orderBy("score2")).alias("hi")).filter("hi is not null")
    return c.select(F.col("score2").alias("lower_score"), F.col("hi").alias("upper_score"), (F.col("hi") - F.col("score2")).alias("gap")).orderBy(F.desc(F.round("gap", 9)), "lower_score").limit(k)


def nearest(scored: DataFrame, threshold: float, keys: list[str], k: int = 10) -> DataFrame:
    """The ``k`` pairs whose scores lie nearest to the threshold; ties by their keys."""
    return scored.withColumn("distance", F.abs(F.col("score") - F.lit(threshold))).orderBy(F.round("distance", 9), *keys).limit(k)


def score_summary(scores: DataFrame) -> DataFrame:
    """Number, least, greatest and mean score."""
    return scores.filter("score is not null").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"), F.max("score").alias("greatest"), F.avg("score").alias("mean"))


def histogram(scores: DataFrame, bins: int = 50) -> DataFrame:
    """(bin from 1, low, n): equal bins between the least and the greatest score, the last one closed."""
    known = scores.filter("score is not null")
    ends = known.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(F.least(F.floor((F.col("score") - F.col("lo")) / width).cast("int") + 1, F.lit(bins)))
    return known.join(F.broadcast(ends)).groupBy(at.alias("bin"), (F.col("lo") + (at - 1) * width).alias("low")).agg(F.count(F.lit(1)).alias("n"))
