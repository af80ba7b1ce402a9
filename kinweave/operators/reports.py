"""Reports over matches joined with both records: one pass each, all expressed as conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions import names as N
from kinweave.operators.linkage import FLAGS


def joined(matches: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Matches with columns of both sides prefixed l_ and r_."""
    l = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns])
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    return matches.join(l, F.col("a_id") == F.col("l_a_id")).join(r, F.col("b_id") == F.col("r_b_id"))


def _first(name: Column) -> Column:
    return F.lower(F.substring_index(name, " ", 1))


def _exact(j: DataFrame) -> DataFrame:
    same_name = _first(F.col("l_full_name")) == F.lower("r_given")
    same_surname = F.lower(F.trim(F.regexp_replace("l_full_name", r"^\S+\s*", ""))) == F.lower("r_surname")
    return j.withColumns({"same_name": same_name, "same_surname": same_surname})


def summary(j: DataFrame) -> DataFrame:
    """n, n_same_name, n_same_surname, n_same_both, and how often the source text decided each field."""
    e = _exact(j)
    return e.agg(F.count(F.lit(1)).alias("n"), F.count_if("same_name").alias("n_same_name"), F.count_if("same_surname").alias("n_same_surname"), F.count_if(F.expr("same_name and same_surname")).alias("n_same_both"), *[F.count_if(f).alias(f"n_{f}") for f in FLAGS])


def two_by_two(j: DataFrame) -> DataFrame:
    return _exact(j).groupBy("same_name", "same_surname").agg(F.count(F.lit(1)).alias("n"))


def death_years(j: DataFrame) -> DataFrame:
    """missing, earlier, identical or later death year on the right."""
    l = N.replace_all(F.trim("l_dyear"), "*", "-").try_cast("int")
    r = N.replace_all(F.trim("r_dyear"), "9999", "-").try_cast("int")
    kind = F.when(l.isNull() | r.isNull() | (l == 0) | (r == 0), "missing").when(r < l, "earlier").when(r == l, "identical").otherwise("later")
    return j.groupBy(kind.alias("death_year")).agg(F.count(F.lit(1)).alias("n"))


def empty_fields(j: DataFrame) -> DataFrame:
    """Overlapping counters of empty left fields: each, each with a value on the right, each alone, pairs, all three."""
    e = {"father": N.is_empty(F.col("l_father"), "*", "-"), "year": N.is_empty(N.year_part(F.col("l_byear")), "*", "-"), "place": N.is_empty(N.place_part(F.col("l_place")), "*", "-")}
    right = {"father": "r_father", "year": "r_byear", "place": "r_place"}
    out = []
    for k, c in e.items():
        others = [v for n, v in e.items() if n != k]
        out += [F.count_if(c).alias(k), F.count_if(c & ~N.is_empty(F.col(right[k]), "9999", "-")).alias(f"{k}_filled_right"), F.count_if(c & ~others[0] & ~others[1]).alias(f"only_{k}")]
    for a, b in (("father", "year"), ("father", "place"), ("year", "place")):
        out.append(F.count_if(e[a] & e[b]).alias(f"{a}_and_{b}"))
    return j.agg(*out, F.count_if(e["father"] & e["year"] & e["place"]).alias("all_three"))


def frequencies(j: DataFrame, column: str) -> DataFrame:
    return j.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def year_differences(j: DataFrame) -> DataFrame:
    """|birth year difference| of matches decided by a year in the source, both years known."""
    l, r = N.left_year(F.col("l_byear")), N.right_year(F.col("r_byear"))
    return j.filter(F.col("year_in_source") & (l > 0) & (r > 0)).groupBy(F.abs(l - r).alias("diff")).agg(F.count(F.lit(1)).alias("n"))


def disagreement(j: DataFrame) -> DataFrame:
    """For each of six compared fields: differing pairs with their share of all pairs, and pairs with an empty side."""
    fields = {
        "name": ("l_full_name", F.concat_ws(" ", "r_given", "r_surname")), "father": ("l_father", F.col("r_father")), "birth_year": (N.year_part(F.col("l_byear")), F.col("r_byear")),
        "birth_place": (N.place_part(F.col("l_place")), F.col("r_place")), "death_year": ("l_dyear", F.col("r_dyear")), "death_place": ("l_dplace", F.col("r_dplace")),
    }
    known = {k: (F.col(a) if isinstance(a, str) else a, b) for k, (a, b) in fields.items() if not isinstance(a, str) or a in j.columns}
    rows = [F.struct(F.lit(k).alias("field"), N.comparison_form(F.coalesce(a, F.lit(""))).alias("x"), N.comparison_form(F.coalesce(b, F.lit(""))).alias("y")) for k, (a, b) in known.items()]
    long = j.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    left, right = F.col("x") == "", F.col("y") == ""
    differ = F.count_if(~left & ~right & (F.col("x") != F.col("y")))
    return long.groupBy("field").agg(differ.alias("n_differ"), (100 * differ / F.count(F.lit(1))).alias("pct"), F.count_if(left).alias("n_empty_left"), F.count_if(right).alias("n_empty_right"), F.count(F.lit(1)).alias("n_pairs"))


def frequent(df: DataFrame, column: str, share: float = 0.01, one_more: bool = False) -> DataFrame:
    """(value, n, pct) of values that reach a share of the rows, most frequent first; ``one_more``: and the first that does not."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("total")))
    shares = counts.join(total).select("value", "n", (100 * F.col("n") / F.col("total")).alias("pct"))
    kept = shares.filter(F.col("pct") >= 100 * share)
    if one_more:
        kept = kept.unionAll(shares.filter(F.col("pct") < 100 * share).orderBy(F.desc("n"), "value").limit(1))
    return kept.orderBy(F.desc("n"), "value")


def in_camp(j: DataFrame, circumstances: str = "u logoru") -> DataFrame:
    """Matches whose circumstances are the given ones."""
    return j.filter(F.lower(F.trim("r_circumstances")) == circumstances.lower())


def distinct_values(j: DataFrame, *columns: str) -> DataFrame:
    """One row: the number of distinct values of each column."""
    return j.agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])


def sorted_only(j: DataFrame, normalise: bool = True) -> DataFrame:
    """Number of matches whose names agree only after their words are sorted."""
    named = j.withColumn("r_full_name", F.concat_ws(" ", "r_given", "r_surname"))
    std = ""
    if normalise:
        named, std = N.prepared(named, "l_full_name", "r_full_name"), "_std"
    clean = lambda c: N.replace_all(F.lower(F.col(f"{c}{std}")), "*", "-", "9999")
    a, b = clean("l_full_name"), clean("r_full_name")
    return named.agg(F.count_if((a != b) & (N.sorted_parts(a) == N.sorted_parts(b))).alias("n_sorted_only"), F.count(F.lit(1)).alias("n"))


def full_report(j: DataFrame, sort_parts: bool = False, normalise: bool = True) -> DataFrame:
    """(section, item, n, pct): the whole report over matches; shares are of all matches unless the section says otherwise.

    No matches give no rows.
    """
    total = F.broadcast(j.agg(F.count(F.lit(1)).alias("total")))

    def turned(df: DataFrame, section: str, names: dict[str, str]) -> DataFrame:
        items = F.array(*[F.struct(F.lit(i).alias("item"), F.col(c).cast("long").alias("n")) for c, i in names.items()])
        return df.select(F.lit(section).alias("section"), F.explode(items).alias("x")).select("section", "x.*")

    def of(df: DataFrame, base: DataFrame) -> DataFrame:
        return df.join(base).filter("total > 0").select("section", "item", "n", (100 * F.col("n") / F.col("total")).alias("pct"))

    s = summary(j)
    parts = [turned(s, "names", {"n": "matches", "n_same_name": "same name", "n_same_surname": "same surname", "n_same_both": "same full name"})]
    parts.append(turned(s, "found in source", {f"n_{f}": f.split("_in_")[0] for f in FLAGS}))
    if sort_parts:
        parts.append(turned(sorted_only(j, normalise), "names", {"n_sorted_only": "sorted parts only"}))
    exact = lambda c: F.when(F.col(c), "exact").otherwise("adjusted")
    parts.append(two_by_two(j).select(F.lit("name and surname").alias("section"), F.concat_ws(" / ", exact("same_name"), exact("same_surname")).alias("item"), "n"))
    parts.append(death_years(j).select(F.lit("death year").alias("section"), F.col("death_year").alias("item"), "n"))
    parts.append(turned(empty_fields(j), "empty fields", {c: c for c in empty_fields(j).columns}))
    for column, section in (("r_dplace", "death places"), ("r_circumstances", "circumstances")):
        parts.append(frequencies(j, column).select(F.lit(section).alias("section"), F.coalesce("value", F.lit("")).alias("item"), "n"))
    parts.append(turned(distinct_values(j, "r_dplace", "r_circumstances"), "distinct values", {"n_r_dplace": "death places", "n_r_circumstances": "circumstances"}))
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    out = of(out, total)
    years = year_differences(j).select(F.lit("year differences, of those found in the source").alias("section"), F.col("diff").cast("string").alias("item"), "n")
    camp = in_camp(j)
    places = frequencies(camp, "r_dplace").select(F.lit("death places in a camp, of those in a camp").alias("section"), F.coalesce("value", F.lit("")).alias("item"), "n")
    out = out.unionByName(of(years, F.broadcast(j.agg(F.count_if("year_in_source").alias("total")))))
    return out.unionByName(of(places, F.broadcast(camp.agg(F.count(F.lit(1)).alias("total")))))


def report_lines(report: DataFrame) -> DataFrame:
    """The report as text lines (value), in the order of its sections, most frequent first."""
    line = F.format_string("%s: %s: %d (%.1f%%)", "section", "item", "n", "pct")
    return report.orderBy("section", F.desc("n"), "item").select(line.alias("value"))
