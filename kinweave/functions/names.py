"""Standardisation of names, places and years as column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.wordlists import LETTER_PAIRS, SPELLING_PAIRS


def replace_all(c: Column, *gone: str) -> Column:
    for g in gone:
        c = F.replace(c, F.lit(g), F.lit(""))
    return c


def plain_letters(c: Column) -> Column:
    """South Slavic and German letters to their base letters."""
    return F.replace(F.translate(c, "čćđšžČĆĐŠŽäöüÄÖÜ", "ccdszCCDSZaouAOU"), F.lit("ß"), F.lit("ss"))


def prepare_name(c: Column) -> Column:
    """Common spelling of a name: ordered replacements (they cascade, so the order is part of the result), then
    letter simplifications, then repeated letters collapsed.  Native nested ``replace`` stays in generated code."""
    out = plain_letters(F.lower(c))
    for a, b in SPELLING_PAIRS + LETTER_PAIRS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, r"(?U)(\w)\1+", "$1")


def prepared(df: DataFrame, *columns: str) -> DataFrame:
    """Adds ``<column>_std`` for each column, computed once per distinct value and joined back."""
    for col in columns:
        words = df.select(F.col(col).alias("raw__")).distinct()
        words = words.withColumn(f"{col}_std", prepare_name(F.col("raw__")))
        df = df.join(words, F.col(col).eqNullSafe(F.col("raw__")), "left").drop("raw__")
    return df


def left_clean(c: Column) -> Column:
    """Lower case without the left registry's marks of missing values."""
    return replace_all(F.lower(c), "*", "-")


def right_clean(c: Column) -> Column:
    """Lower case without the right registry's marks of missing values."""
    return replace_all(F.lower(c), "9999", "-")


def year_part(date: Column) -> Column:
    return F.rtrim(F.substring_index(date, "[", 1))


def place_part(place: Column) -> Column:
    return F.rtrim(F.substring_index(place, ",", 1))


def municipality_part(place: Column) -> Column:
    """What follows the first comma, its leading space kept; empty without a comma."""
    return F.rtrim(F.when(F.instr(place, ",") > 0, F.substring(place, F.instr(place, ",") + 1, F.length(place))).otherwise(""))


def sheet_municipality(place: Column) -> Column:
    """The second comma-separated part, left-trimmed (the sheet's variant of the municipality)."""
    return F.ltrim(F.coalesce(F.get(F.split(place, ","), F.lit(1)), F.lit("")))


def city(place: Column) -> Column:
    """Quarters of the two large cities count as the city."""
    low = F.lower(place)
    return F.when(low.startswith("zagreb"), "zagreb").when(low.startswith("beograd"), "beograd").otherwise(F.trim(low))


def strip(c: Column) -> Column:
    """Without white space at either end, Unicode spaces included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def birth_place_variant(place: Column) -> Column:
    out = strip(F.lower(place))
    for a, b in (("w", "v"), ("agram", "zagreb"), ("belgrade", "beograd")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def words(c: Column) -> Column:
    """Split on any white space, Unicode spaces included; no empty words."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def sorted_initials(c: Column, n: int) -> Column:
    return F.array_join(F.array_sort(F.transform(words(c), lambda w: F.substring(w, 1, n))), "")


def sorted_parts(c: Column) -> Column:
    return F.array_join(F.array_sort(words(c)), " ")


def reversed_words(c: Column) -> Column:
    return F.array_join(F.reverse(words(c)), " ")


def strict_int(c: Column) -> Column:
    """Integer with a leading zero allowed for, empty as 0; what is no number is an error."""
    return F.concat(F.lit("0"), F.trim(c)).cast("int")


def lenient_int(c: Column) -> Column:
    """Integer with a leading zero allowed for; what is no number counts as 0."""
    return F.coalesce(F.concat(F.lit("0"), F.trim(c)).try_cast("int"), F.lit(0))


def left_year(date: Column) -> Column:
    return lenient_int(replace_all(year_part(date), "*", "-"))


def right_year(y: Column) -> Column:
    return lenient_int(replace_all(y, "9999"))


def is_empty(c: Column, *marks: str) -> Column:
    return replace_all(F.trim(c), *marks) == ""


def bounded_year(date: Column, lo: int = 1800, hi: int = 1945) -> Column:
    y = replace_all(year_part(date), "*", "-")
    n = F.trim(y).try_cast("int")
    return F.when(n.between(lo, hi), n)


def years_in(text: Column, lo: int = 1800, hi: int = 1945) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\d{4}"), F.lit(0)), lambda y: y.cast("int"))
    return F.filter(found, lambda y: y.between(lo, hi))


@cache
def _unmarked() -> tuple[str, str]:
    """Lower-case letters that decompose to one plain letter and marks, and that letter (built by rule from Unicode)."""
    out = {}
    for cp in range(0x80, 0x2000):
        c = chr(cp)
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.category(x).startswith("M"))
        if len(base) == 1 and base != c and c == c.lower():
            out[c] = base
    return "".join(out), "".join(out.values())


def comparison_form(c: Column) -> Column:
    """Lower case, no stars and bracketed parts, letters without marks (đ has none and stays)."""
    src, dst = _unmarked()
    bare = F.regexp_replace(replace_all(F.trim(F.lower(c)), "*"), r"\[.*?\]", "")
    return strip(F.regexp_replace(F.translate(bare, src, dst), r"\p{M}", ""))
