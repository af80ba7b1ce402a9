"""One consistent form for text that looks the same but differs in its characters (problem 4).

Text is exploded to positioned code points and joined with a broadcast table of decompositions and look-alikes
(bounded by the Unicode repertoire, a few thousand rows built by rule).  Combining marks are ordered by class,
composed again with their base letters, and the texts rebuilt.

The form: composed letters, compatibility characters spelled out, ordinary spaces, no invisible characters, and plain
Latin letters for characters that only look like them.  A text whose letters are all Cyrillic keeps its letters.
Hangul syllables are left as they are.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Characters of other scripts (and Latin eth) that look like a Latin letter, and that letter.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "І": "I", "Ј": "J", "Ѕ": "S", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "Ԝ": "W", "Ԛ": "Q", "ӏ": "l", "Ӏ": "I",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "α": "a", "υ": "u", "κ": "k", "ϳ": "j",
    "օ": "o", "Օ": "O", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "Տ": "S", "Լ": "L",
    "Ð": "Đ", "ð": "đ", "Ɖ": "Đ", "ı": "i", "ɑ": "a", "ɡ": "g",
}


def _points():
    for cp in range(0x80, sys.maxunicode + 1):
        c = chr(cp)
        if unicodedata.category(c) not in ("Cn", "Cs", "Co") and not 0xAC00 <= cp <= 0xD7A3:
            yield c


def _invisible(c: str) -> bool:
    """Format characters, the grapheme joiner and variation selectors."""
    return unicodedata.category(c) == "Cf" or c == "͏" or 0xFE00 <= ord(c) <= 0xFE0F or 0xE0100 <= ord(c) <= 0xE01EF


def _spelled(c: str) -> str:
    if _invisible(c):
        return ""
    if unicodedata.category(c) == "Zs":
        return " "
    return unicodedata.normalize("NFKD", c)


@cache
def _tables() -> tuple[list[tuple[str, str, str, bool]], dict[str, str], str]:
    """Rows (ch, always, lookalike, has_lookalike) of characters that map; composition pairs; the stable letters."""
    maps, comp, stable = [], {}, []
    for c in _points():
        d = _spelled(c)
        looks = "".join(LOOKALIKES.get(x, x) for x in d)
        # a letter that only composes again needs no work unless a mark follows; it is decomposed for that case
        if d != c or looks != d:
            maps.append((c, d, unicodedata.normalize("NFKD", looks), looks != d))
        two = unicodedata.decomposition(c)
        if two and not two.startswith("<") and " " in two:
            a, b = (chr(int(x, 16)) for x in two.split())
            if unicodedata.normalize("NFC", a + b) == c:
                comp[a + b] = c
        if c.isalpha() and c not in LOOKALIKES and 0x80 <= ord(c) < 0x250 and unicodedata.normalize("NFKC", c) == c:
            stable.append(c)
    return maps, comp, "".join(stable)


def _composition_map() -> Column:
    pairs = [F.lit(x) for kv in _tables()[1].items() for x in kv]
    return F.create_map(*pairs)


def maybe_unstable(value: Column) -> Column:
    """Quick check without false negatives: holds a character beyond ASCII and the composed Latin letters."""
    return value.rlike(f"[^\\x00-\\x7f{_tables()[2]}]")


def written_in_cyrillic(value: Column) -> Column:
    """Some letter is Cyrillic and no letter is of another script."""
    return value.rlike(r"\p{IsCyrillic}") & ~value.rlike(r"[\p{L}&&[^\p{IsCyrillic}]]")


def consistent_forms(values: DataFrame, column: str) -> DataFrame:
    """(value, form) for each distinct value of ``column`` whose consistent form differs from it.

    Nulls and empty values never differ.  Ties cannot occur: the form is a function of the value.  Values of any
    length are handled; a value's code points meet in one task, values spread over all.  Other columns are ignored.
    """
    spark: SparkSession = values.sparkSession
    maps = F.broadcast(spark.createDataFrame(_tables()[0], "ch string, always string, looks string, has boolean").drop("has"))
    odd = values.select(F.col(column).alias("value")).filter(maybe_unstable(F.col("value"))).distinct()
    odd = odd.withColumn("cyr", written_in_cyrillic(F.col("value")))
    points = odd.select("value", "cyr", F.posexplode(F.regexp_extract_all("value", F.lit("(?s)."), F.lit(0))).alias("pos", "ch"))
    mapped = points.join(maps, "ch", "left").select(
        "value", "pos", F.coalesce(F.when(F.col("cyr"), F.col("always")).otherwise(F.col("looks")), F.col("ch")).alias("out")
    )
    parts = mapped.filter("out <> ''").select("value", "pos", F.posexplode(F.regexp_extract_all("out", F.lit("(?s)."), F.lit(0))).alias("sub", "ch"))
    # a value that only held invisible characters has no parts left; its form is empty
    classes = [(c, unicodedata.combining(c)) for c in _points() if unicodedata.combining(c)]
    marks = F.broadcast(spark.createDataFrame(classes, "ch string, ccc int"))
    parts = parts.join(marks, "ch", "left").withColumn("ccc", F.coalesce("ccc", F.lit(0)))
    w = Window.partitionBy("value").orderBy("pos", "sub")
    parts = parts.withColumn("seg", F.sum((F.col("ccc") == 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    segs = parts.groupBy("value", "seg").agg(F.array_sort(F.collect_list(F.struct("ccc", "pos", "sub", "ch"))).alias("xs"))
    comp = _composition_map()
    zero = F.struct(F.lit("").alias("base"), F.lit("").alias("rest"), F.lit(-1).alias("last"))

    def step(acc: Column, x: Column) -> Column:
        made = F.when(acc["last"] < x["ccc"], F.element_at(comp, F.concat(acc["base"], x["ch"])))
        first = F.struct(x["ch"].alias("base"), F.lit("").alias("rest"), F.lit(0).alias("last"))
        joined = F.struct(made.alias("base"), acc["rest"].alias("rest"), acc["last"].alias("last"))
        kept = F.struct(acc["base"].alias("base"), F.concat(acc["rest"], x["ch"]).alias("rest"), x["ccc"].alias("last"))
        return F.when(acc["base"] == "", first).when(made.isNotNull(), joined).otherwise(kept)

    text = F.when(F.size("xs") == 1, F.col("xs")[0]["ch"]).otherwise(F.aggregate("xs", zero, step, lambda a: F.concat(a["base"], a["rest"])))
    built = segs.select("value", "seg", text.alias("t")).groupBy("value").agg(F.array_sort(F.collect_list(F.struct("seg", "t"))).alias("ts"))
    built = built.select(F.col("value").alias("bv"), F.concat_ws("", F.transform("ts", lambda x: x["t"])).alias("form"))
    forms = odd.join(built, F.col("value") == F.col("bv"), "left").select("value", F.coalesce("form", F.lit("")).alias("form"), "cyr")
    return forms.filter("value <> form").select("value", "form", F.col("cyr").alias("cyrillic"))
