"""Queries of problem 5: freely written places mapped to the reference list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.set_join import similar_sets
from kinweave.llm.spell import plain, sound
from kinweave.plans.runtime import cut, table

#: Jaccard of letter pairs from which an entry is a candidate.
MIN_JACCARD = 0.35
#: Edits allowed per letter of the longer form.
MAX_EDIT_SHARE = 0.28

# Words around a place that are not part of its name (folded to plain letters).
BEFORE = r"^(?:(?:u|kod|blizu|kraj|pokraj|na|iz|selo|sela|mj|mjesto|grad|logor|log|kl|konc|sab|op|opcina|kot)\b[. ]*)+"
AFTER = r"(?:[,(/].*| - .*| kod .*| kraj .*|-logor| (?:logor|selo|grad|mjesto|opcina.*|op\..*))$"
# Adjectives that open place names, their locative and their abbreviation.
OPENERS = {"stara": "st", "nova": "n", "gornja": "g", "donja": "d", "velika": "v", "mala": "m", "sveta": "sv"}
MORE_ABBREVIATIONS = {"gor": "gornja", "don": "donja", "vel": "velika", "nov": "nova", "mal": "mala", "star": "stara"}
MISSING = ["", "-", "*"]


def core(value: Column) -> Column:
    """The name inside a freely written place, plain lower-case letters; a final full stop marks an abbreviation."""
    # capitalised words only: nothing around the name
    bare = value.rlike("^[A-ZČĆĐŠŽ][a-zčćđšž]+(?: [A-ZČĆĐŠŽ][a-zčćđšž]+)?$")
    return F.when(bare, plain(value)).otherwise(_stripped(plain(value)))


def _stripped(v: Column) -> Column:
    v = F.regexp_replace(v, BEFORE, "")
    v = F.regexp_replace(v, f"^([^,]+), *({'|'.join(OPENERS)})$", "$2 $1")
    v = F.regexp_replace(F.regexp_replace(v, AFTER, ""), AFTER, "")
    return F.trim(F.regexp_replace(v, r"[^a-z. ]", ""))


def pairs_of(text: Column) -> Column:
    """Letter pairs of a padded text, each once."""
    padded = F.concat(F.lit("^"), text, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2))))


def _locative(word: Column) -> Column:
    opener = F.lit(None)
    for w in OPENERS:
        opener = F.when(word == w, F.regexp_replace(word, "a$", "oj")).otherwise(opener)
    rest = (
        F.when(word.rlike("ac$"), F.regexp_replace(word, "ac$", "cu")).when(word.rlike("ec$"), F.regexp_replace(word, "ec$", "cu"))
        .when(word.rlike("a$"), F.regexp_replace(word, "a$", "i")).when(word.rlike("[eo]$"), F.regexp_replace(word, "[eo]$", "u"))
        .when(word.rlike("i$"), F.regexp_replace(word, "i$", "ima")).otherwise(F.concat(word, F.lit("u")))
    )
    return F.coalesce(opener, rest)


def reference_forms(refs: DataFrame) -> DataFrame:
    """(form, ref_id, kind): every written form of the entries: name, locative, other names, short forms.

    The list is the reference's; it grows with the number of entries only.
    """
    base = refs.select("ref_id", F.explode(F.array_union(F.array("ref_name"), F.coalesce(F.split("alt_names", r";\s*"), F.array()))).alias("n"))
    base = base.select("ref_id", F.trim(F.regexp_replace(plain(F.col("n")), "[^a-z ]", "")).alias("n")).filter("n <> ''")
    words = F.split("n", " ")
    loc = F.concat_ws(" ", F.transform(words, lambda w: _locative(w)))
    full = base.select("ref_id", F.explode(F.array(F.struct(F.col("n").alias("form"), F.lit(0).alias("k")), F.struct(loc.alias("form"), F.lit(1).alias("k")))).alias("x")).select("ref_id", "x.*")
    short = base.select(
        "ref_id", F.explode(F.transform(F.sequence(F.lit(3), F.greatest(F.lit(3), F.length("n") - 1)), lambda i: F.concat(F.substring(F.col("n"), F.lit(1), i), F.lit(".")))).alias("form"), F.lit(2).alias("k")
    )
    opened = full
    for w, abbr in OPENERS.items():
        stem = w[:-1]
        opened = opened.withColumn("form", F.regexp_replace("form", f"^{stem}(?:a|oj) ", f"{abbr}. "))
    opened = opened.filter("instr(form, '.') > 0")
    out = full.unionByName(short).unionByName(opened.select("ref_id", "form", "k"))
    # a short form that several entries share denotes none of them
    return out.filter("k < 2").unionByName(out.filter("k = 2").groupBy("form").agg(F.min("ref_id").alias("ref_id"), F.min("k").alias("k"), F.countDistinct("ref_id").alias("n")).filter("n = 1").drop("n")).distinct()


def map_values(values: DataFrame, refs: DataFrame) -> DataFrame:
    """(value, ref_id, score) for each distinct value; ref_id 0 and score 0 where no entry is near enough.

    Values are compared in their plain and sound-folded reading.  Ties go to the higher Jaccard, then to the fewer
    edits, then to the smaller ref_id.  Null values are left out; an empty reference maps everything to 0.
    """
    vals = values.select("value").filter("value is not null").distinct()
    vals = vals.withColumn("c", core(F.col("value")))
    vals = vals.withColumn("c", F.regexp_replace("c", r"^(st|n|g|d|v|m|sv|gor|don|vel|nov|mal|star)\. ?(?=[a-z]{4})", "$1. "))
    for a, w in MORE_ABBREVIATIONS.items():
        vals = vals.withColumn("c", F.regexp_replace("c", f"^{a}\\. ", f"{OPENERS[w]}. "))
    dot = lambda c: F.when(F.col(c).rlike(r"[a-z]{3,}\.$"), F.lit(".")).otherwise(F.lit(""))
    vals = cut(vals.withColumn("s", F.concat(sound(F.regexp_replace("c", r"\.$", "")), dot("c"))).filter("value is not null"))
    forms = cut(reference_forms(refs).withColumn("s", F.concat(sound(F.regexp_replace("form", r"\.$", "")), dot("form"))))
    asked = vals.filter(F.length("s") > 1).select("s", "c").distinct()
    near = similar_sets(
        asked.select(F.col("s").alias("id")).distinct().withColumn("tokens", pairs_of(F.col("id"))), forms.select(F.col("s").alias("id"), pairs_of(F.col("s")).alias("tokens")).distinct(), MIN_JACCARD
    )
    # both readings count: folding can double a slip of the pen or undo it
    both = near.join(asked.select(F.col("s").alias("left_id"), "c"), "left_id").join(forms.select(F.col("s").alias("right_id"), "form", "ref_id"), "right_id")
    both = both.withColumn("d", F.least(_edits(F.col("left_id"), F.col("right_id")), _edits(F.col("c"), F.col("form"))))
    size = F.greatest(F.length("left_id"), F.length("right_id"))
    short = F.col("right_id").endswith(".")
    # an abbreviation is only read as the exact beginning it is
    close = both.filter(F.when(short, F.col("d") == 0).otherwise((F.col("d") <= F.lit(MAX_EDIT_SHARE) * size) | (F.col("d") <= 1)))
    best = close.groupBy("c").agg(F.max_by(F.struct("ref_id", "jaccard", "d", "form"), F.struct(F.col("jaccard"), -F.col("d"), -F.col("ref_id"))).alias("b"))
    return vals.join(best, "c", "left").select("value", F.coalesce("b.ref_id", F.lit(0)).cast("long").alias("ref_id"), F.coalesce("b.jaccard", F.lit(0.0)).alias("score"), "c", F.col("b.form").alias("nearest"), F.col("b.d").alias("edits"))


def _edits(a: Column, b: Column) -> Column:
    """Levenshtein distance; texts of the same letters differ by swaps, of which each counts once."""
    d = F.levenshtein(a, b)
    letters = lambda x: F.array_sort(F.split(x, ""))
    return F.when((d > 1) & (d < 5) & (letters(a) == letters(b)), F.ceil(d / 2).cast("int")).otherwise(d)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "export_xlsx").select(
        F.col("row_id").alias("record_key"), F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("value")) for c in ("Death Place:", "Camp:")])).alias("x")
    )
    a = a.select(F.lit("export_xlsx").alias("source_table"), "record_key", "x.*")
    b = table(spark, sf_dir, "export_xlsx_partial").select(
        F.lit("export_xlsx_partial").alias("source_table"), F.expr("try_cast(trim(IDNumber) as bigint)").alias("record_key"), F.lit("DeathPlace").alias("column_name"), F.col("DeathPlace").alias("value")
    )
    cells = a.unionByName(b).filter(F.col("value").isNotNull() & ~F.trim("value").isin(MISSING))
    names = table(spark, sf_dir, "ref_places").select(F.col("ref_name").alias("value"))
    return cells.join(names, "value", "left_anti").distinct()


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    best = map_values(cells, table(spark, sf_dir, "ref_places"))
    return cells.join(best, "value")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(spark, sf_dir).select("source_table", "record_key", "column_name", "ref_id").distinct()


def unmatched_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values no entry is near enough to, with how many records hold them."""
    return mapped(spark, sf_dir).filter("ref_id = 0").groupBy("column_name", "value").agg(F.countDistinct("source_table", "record_key").alias("n_records"))


def queries() -> dict:
    return {"p5_found": found, "p5_unmatched": unmatched_report}


def oracle_sql() -> dict[str, str]:
    return {}
