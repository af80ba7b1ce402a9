"""Linking two registries: blocking joins, field checks, best candidates, and the relaxed second pass.

Both sides are frames of standard columns: left ``a_id, full_name, father, byear, place, dyear, source``; right ``b_id,
given, surname, father, byear, place, dyear, dplace, circumstances``, ``b_id`` giving the order that breaks ties.  Missing
values are empty strings.  The plan is an equi-join on computed keys with the checks as a residual filter; skewed blocks
are split by adaptive execution, and name scores are computed once per distinct pair of names.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions import names as N
from kinweave.functions.compare import METHODS, level, passes, similarity
from kinweave.functions.wordlists import LEFT_OUT_PLACES
from kinweave.plans.runtime import cut


@dataclass(frozen=True)
class Options:
    key_father: bool = False
    key_year: bool = False
    key_place: bool = False
    check_father: bool = False
    check_year: bool = False
    check_place: bool = False
    max_year_gap: int | None = 0
    normalise: bool = False
    sort_parts: bool = False
    alternatives: bool = False
    empties: bool = False
    method: str | None = None
    threshold: float | None = None
    fuzzy_father: bool = False
    block_letters: int = 1
    keep_all: bool = False
    levels: int = 3


def without_left_out_places(right: DataFrame) -> DataFrame:
    """Drops right records whose death place contains one of the listed places."""
    low = F.lower("dplace")
    hit = F.lit(False)
    for p in LEFT_OUT_PLACES:
        hit = hit | low.contains(p.lower())
    return right.filter(~hit)


def with_prepared_names(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the common spellings of names and fathers, for any number of runs."""
    right = right.withColumn("full_name", F.concat_ws(" ", "given", "surname"))
    return N.prepared(left, "full_name", "father"), N.prepared(right, "full_name", "father")


def _sides(left: DataFrame, right: DataFrame, o: Options) -> tuple[DataFrame, DataFrame]:
    right = right.withColumn("full_name", F.concat_ws(" ", "given", "surname"))
    if o.normalise and "full_name_std" not in left.columns:
        left, right = with_prepared_names(left, right)
    std = "_std" if o.normalise else ""
    left = left.withColumns({"n_raw": F.col(f"full_name{std}"), "f_raw": F.col(f"father{std}")})
    right = right.withColumns({"n_raw": F.col(f"full_name{std}"), "f_raw": F.col(f"father{std}")})

    def key(c: Column) -> Column:
        if o.method is not None:
            return N.sorted_initials(c, o.block_letters)
        return N.sorted_parts(c) if o.sort_parts else c

    left = left.withColumns({
        "k_name": N.left_clean(key(F.col("n_raw"))), "k_father": N.left_clean(F.col("f_raw")), "k_year": N.left_clean(N.year_part(F.col("byear"))), "k_place": N.left_clean(N.place_part(F.col("place"))),
        "name": N.left_clean(F.col("n_raw")), "year": N.left_year(F.col("byear")), "spot": N.city(N.place_part(F.col("place"))), "low_source": F.lower("source"),
    })
    city = F.when(F.lower("place").startswith("zagreb"), "Zagreb").when(F.lower("place").startswith("beograd"), "Beograd").otherwise(F.col("place"))
    right = right.withColumns({
        "k_name": N.right_clean(key(F.col("n_raw"))), "k_father": N.right_clean(F.col("f_raw")), "k_year": N.right_clean(F.col("byear")), "k_place": N.right_clean(city),
        "name": N.right_clean(F.col("n_raw")), "year": N.right_year(F.col("byear")), "spot": N.city(F.col("place")),
    })
    return left, right


def _keys(o: Options) -> list[str]:
    return ["k_name"] + ["k_father"] * o.key_father + ["k_year"] * o.key_year + ["k_place"] * o.key_place


def blocked(left: DataFrame, right: DataFrame, o: Options) -> DataFrame:
    """Pairs of one block as columns ``l.*`` and ``r.*``, with ``score`` (null without a fuzzy method)."""
    left, right = _sides(left, right, o)
    return _join(left, right, o)


def _join(left: DataFrame, right: DataFrame, o: Options) -> DataFrame:
    keys = _keys(o)
    l, r = left.alias("l"), right.alias("r")
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    if o.method is None:
        return l.join(r, same).withColumn("score", F.lit(None).cast("double"))
    # the score dictionary: one row per distinct pair of names that meets in a block
    ln, rn = left.select("k_name", F.col("name").alias("ln")).distinct(), right.select("k_name", F.col("name").alias("rn")).distinct()
    scored = ln.join(rn, "k_name").select("ln", "rn").distinct().withColumn("score", METHODS[o.method].score(F.col("ln"), F.col("rn")))
    fit = scored.filter(passes(F.col("score"), o.method, o.threshold))
    named = l.join(fit, F.col("l.name") == F.col("ln"))
    return named.join(r, [*same, F.col("r.name") == F.col("rn")]).drop("ln", "rn")


def _source_has(needle: Column) -> Column:
    return F.col("l.low_source").contains(needle)


def checks(o: Options) -> dict[str, Column]:
    """father_ok, year_ok, place_ok and the flags that say the left record's source text decided."""
    lf, rf = F.col("l.k_father"), F.col("r.k_father")
    yes, no = F.lit(True), F.lit(False)
    father_src = (F.length(rf) > 0) & _source_has(rf) if o.alternatives else no
    ly, ry = F.col("l.year"), F.col("r.year")
    source, gap = F.col("l.source"), o.max_year_gap
    direct = source.contains(ry.cast("string")) & (ry > 0)
    near = no
    if gap:
        near = (ry > 0) & F.exists(F.sequence(F.lit(-gap), F.lit(gap)), lambda d: source.contains((ry + d).cast("string")))
    year_src = (direct | near) if o.alternatives else no
    lp, rp = F.col("l.spot"), F.col("r.spot")
    place_src = (F.length(rp) > 0) & _source_has(rp) if o.alternatives else no
    out = {"father_ok": yes, "year_ok": yes, "place_ok": yes, "father_in_source": no, "year_in_source": no, "place_in_source": no}
    if o.check_father:
        ok = (lf == rf) | father_src
        if o.empties:
            ok = ok | (lf == "")
        if o.fuzzy_father and o.method is not None:
            ok = ok | ((lf != "") & (rf != "") & passes(METHODS[o.method].score(lf, rf), o.method, o.threshold))
        out |= {"father_ok": ok, "father_in_source": (lf != rf) & father_src}
    if o.check_year:
        ok = (ly == ry) | year_src
        if o.empties:
            ok = ok | (ly == 0)
        if gap is not None:
            ok = ok | (F.abs(ly - ry) <= gap)
        out |= {"year_ok": ok, "year_in_source": (ly != ry) & year_src}
    if o.check_place:
        ok = (lp == rp) | place_src
        if o.empties:
            ok = ok | F.trim(N.place_part(F.col("l.place"))).isin("", "-", "*")
        out |= {"place_ok": ok, "place_in_source": (lp != rp) & place_src}
    return out


FLAGS = ["father_in_source", "year_in_source", "place_in_source"]


def _candidates(pairs: DataFrame, o: Options) -> DataFrame:
    c = checks(o)
    kept = pairs.filter(c["father_ok"] & c["year_ok"] & c["place_ok"])
    return kept.select(F.col("l.a_id").alias("a_id"), F.col("r.b_id").alias("b_id"), "score", *[c[f].alias(f) for f in FLAGS])


def best_per_left(candidates: DataFrame, higher: bool | None) -> DataFrame:
    """One candidate per left record: the best score, ties and exact matching decided by the right order."""
    first = F.lit(0.0) if higher is None else (-F.col("score") if higher else F.col("score"))
    best = candidates.groupBy("a_id").agg(F.min_by(F.struct(*[c for c in candidates.columns if c != "a_id"]), F.struct(first, F.col("b_id"))).alias("x"))
    return best.select("a_id", "x.*")


def link(left: DataFrame, right: DataFrame, o: Options) -> DataFrame:
    """(a_id, b_id, score, father_in_source, year_in_source, place_in_source) of the matches, relaxed pass included."""
    left, right = _sides(left, right, o)
    higher = METHODS[o.method].higher if o.method else None
    pick = (lambda c: c) if o.keep_all else (lambda c: best_per_left(c, higher))
    first = pick(_candidates(_join(left, right, o), o))
    if not (o.empties and (o.key_father or o.key_year or o.key_place)):
        return first
    empty = F.lit(False)
    for used, col in ((o.key_father, F.col("father")), (o.key_year, N.year_part(F.col("byear"))), (o.key_place, N.place_part(F.col("place")))):
        if used:
            empty = empty | N.is_empty(col, "*", "-")
    again = left.filter(empty).join(first.select("a_id").distinct(), "a_id", "left_anti")
    loose = replace(o, key_father=False, key_year=False, key_place=False, check_father=o.check_father or o.key_father)
    return first.unionByName(pick(_candidates(_join(again, right, loose), loose)))


def _again(df: DataFrame, key: str) -> DataFrame:
    """Adds ``again``: several rows have this key."""
    many = cut(df.groupBy(F.col(key).alias("many")).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"))
    return df.join(many, df[key].eqNullSafe(F.col("many")), "left").withColumn("again", F.col("rows").isNotNull()).drop("many", "rows")


def pair_counts(left: DataFrame, right: DataFrame, o: Options) -> tuple[DataFrame, DataFrame]:
    """(score, n) of all pairs of rows of ``link`` with a year gap, place and ``keep_all``, and (score, exact, n) of their different pairs of keys.

    Rows that are equal in all compared fields are counted, and their numbers multiplied; no pair of rows is formed but of keys that
    several rows have, whose pairs count once, by their best score.  ``exact``: the names are equal; without a score the pair is
    in no block.
    """
    left, right = (_again(df, key) for df, key in zip(_sides(left, right, o), ("a_id", "b_id"), strict=True))
    score, best = METHODS[o.method].score, F.max if METHODS[o.method].higher else F.min
    cols = ["k_name", "name", "year", "spot", "again"]
    l, r = (cut(df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))) for df in (left, right))
    near = l.withColumn("year", F.explode(F.transform(F.sequence(F.lit(-o.max_year_gap), F.lit(o.max_year_gap)), lambda d: F.col("year") + d)))
    lt, rt = near.alias("l"), r.alias("r")
    spot = (F.col("l.year") == F.col("r.year")) & (F.col("l.spot") == F.col("r.spot"))
    told = [F.col("l.name").alias("ln"), F.col("r.name").alias("rn"), (F.col("l.again") | F.col("r.again")).alias("again")]
    counted = lambda met: met.groupBy(*told).agg(F.sum(F.col("l.n") * F.col("r.n")).alias("n"))
    block, same = F.col("l.k_name") == F.col("r.k_name"), F.col("l.name") == F.col("r.name")
    names = counted(lt.join(rt, block & spot)).withColumn("score", score(F.col("ln"), F.col("rn"))).filter(passes(F.col("score"), o.method, o.threshold))
    outside = counted(lt.join(rt, same & ~block & spot)).withColumn("score", F.lit(None).cast("double"))
    met = names.withColumn("blocked", F.lit(True)).unionByName(outside.withColumn("blocked", F.lit(False)))
    met = cut(met.groupBy("score", (F.col("ln") == F.col("rn")).alias("exact"), "again", "blocked").agg(F.sum("n").alias("n")))
    keys = met.filter("not again").select("score", "exact", "n")
    if not met.filter("again").isEmpty():
        sides = ((left.filter("again"), right), (left.filter("not again"), right.filter("again")))
        for one, other in sides:
            ok = (F.abs(F.col("l.year") - F.col("r.year")) <= o.max_year_gap) & (F.col("l.spot") == F.col("r.spot"))
            rows = lambda x: x.filter(ok).select("a_id", "b_id", "score", (F.col("l.name") == F.col("r.name")).alias("exact"))  # noqa: E731, B023
            a, b = one.alias("l"), other.alias("r")
            pairs = rows(_join(one, other, o)).unionAll(rows(a.join(b, same & ~block).withColumn("score", F.lit(None).cast("double"))))
            keys = keys.unionAll(pairs.groupBy("a_id", "b_id").agg(best("score").alias("score"), F.max("exact").alias("exact")).groupBy("score", "exact").agg(F.count(F.lit(1)).alias("n")))
        keys = cut(keys)
    return met.filter("blocked").groupBy("score").agg(F.sum("n").alias("n")), keys


def compared(left: DataFrame, right: DataFrame, o: Options, name_levels: list[int] | None = None) -> DataFrame:
    """a_id, b_id, lv_name, lv_father, lv_year, lv_place of all pairs of a block; null where a field is left out.

    ``name_levels``: keep pairs of these name levels alone, before rows are paired.
    """
    left, right = _sides(left, right, o)
    return _levels(left.withColumnRenamed("a_id", "l_n"), right.withColumnRenamed("b_id", "r_n"), o, name_levels).withColumnsRenamed({"l_n": "a_id", "r_n": "b_id"})


def pattern_counts(left: DataFrame, right: DataFrame, o: Options) -> DataFrame:
    """lv_name, lv_father, lv_year, lv_place, n: how many pairs of a block have each pattern of levels.

    Rows that are equal in all compared fields are paired once, with their numbers multiplied.
    """
    cols = ["k_name", "name", "k_father", "year", "spot"]
    left, right = (df.groupBy(*cols).agg(F.count(F.lit(1)).alias(n)) for df, n in zip(_sides(left, right, o), ("l_n", "r_n"), strict=True))
    levels = _levels(left, right, o)
    return levels.groupBy("lv_name", "lv_father", "lv_year", "lv_place").agg(F.sum(F.col("l_n") * F.col("r_n")).alias("n"))


def _levels(left: DataFrame, right: DataFrame, o: Options, name_levels: list[int] | None = None) -> DataFrame:
    """l_n, r_n and the levels of all pairs of a block.

    Texts are compared once per distinct pair of names and of fathers that meet in a block; row pairs carry hashes only
    and look their levels up.
    """
    graded = o.method is not None
    score = METHODS[o.method].score if graded else None
    side = lambda df, c, new: df.select("k_name", F.col(c).alias(new)).distinct()
    graded_level = lambda a, b: level(similarity(score(F.col(a), F.col(b)), F.col(a), F.col(b), o.method), o.levels) if graded else (F.col(a) == F.col(b)).cast("int")
    names = side(left, "name", "ln").join(side(right, "name", "rn"), "k_name").withColumn("lv_name", graded_level("ln", "rn"))
    if name_levels is not None:
        names = names.filter(F.col("lv_name").isin(name_levels))
    names = cut(names.select(F.xxhash64("k_name", "ln").alias("lh"), F.xxhash64("k_name", "rn").alias("rh"), "lv_name"))

    def slim(df: DataFrame, n: str) -> DataFrame:
        known = ~F.col("spot").isin("", "-", "*") if n == "l" else F.col("spot") != ""
        father = F.when(F.col("k_father") != "", F.xxhash64("k_father"))
        return df.select(f"{n}_n", F.xxhash64("k_name", "name").alias(f"{n}h"), father.alias(f"{n}f"), F.when(F.col("year") > 0, F.col("year")).alias(f"{n}y"), F.when(known, F.xxhash64("spot")).alias(f"{n}p"))

    met = slim(left, "l").join(names, "lh").drop("lh").join(slim(right, "r"), "rh").drop("rh")
    none = F.lit(None).cast("int")
    same = lambda c: (F.col(f"l{c}") == F.col(f"r{c}")).cast("int")
    father = none
    if o.check_father and o.fuzzy_father and graded:
        # one number for two fathers
        both = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.xxhash64(a, b))
        fathers = side(left, "k_father", "lt").join(side(right, "k_father", "rt"), "k_name").select("lt", "rt").distinct().filter("lt <> '' and rt <> ''")
        # written first, so that the planner knows its size and broadcasts it only if it is small
        fathers = cut(fathers.select(both(F.xxhash64("lt"), F.xxhash64("rt")).alias("fh"), graded_level("lt", "rt").alias("lv_father")))
        met = met.withColumn("fh0", both(F.col("lf"), F.col("rf"))).join(fathers, F.col("fh0") == F.col("fh"), "left")
        father = F.col("lv_father")
    elif o.check_father:
        father = same("f")
    near = same("y") if o.max_year_gap is None else (F.abs(F.col("ly") - F.col("ry")) <= o.max_year_gap).cast("int")
    return met.select("l_n", "r_n", "lv_name", father.alias("lv_father"), (near if o.check_year else none).alias("lv_year"), (same("p") if o.check_place else none).alias("lv_place"))
