"""Linking a registry with lexicon entries and with certificates.

Names meet first, on small columns; page texts are read once per entry and reach only the pairs that are left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions import names as N
from kinweave.functions.compare import METHODS, passes
from kinweave.operators import extract as E


@dataclass(frozen=True)
class EntryRules:
    """What a left record and an entry must agree in; presets below."""

    key_year: bool = False
    check_place: bool = True
    check_year: bool = True
    max_year_gap: int | None = None
    place_in_source: bool = True
    year_in_source: bool = False
    empty_left_place: bool = True
    empty_left_year: bool = False
    empty_left_both: bool = False
    empty_death_place: bool = True
    excluded_places: tuple[str, ...] = ()
    #: words that show survival where the death place is empty; without any no evidence is asked for
    survival_words: tuple[str, ...] = ()
    later_year: bool = True
    father_in_text: bool = False
    method: str | None = None
    threshold: float | None = None
    block_letters: int = 2


# What the programs for the two lexicons ask for.
FIRST_LEXICON = EntryRules(key_year=True, excluded_places=("jasenovac", "gradiška", "logor"), survival_words=("preživio", "preživjela"), father_in_text=True)
SECOND_LEXICON = EntryRules(empty_left_year=True, excluded_places=("jasenovac", "gradiška", "gradi&scaron;ka"))
CERTIFICATES = EntryRules(empty_left_year=True)


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _left_year(c: str) -> Column:
    return F.trim(N.replace_all(N.year_part(_text(c)), "-", "*"))


def _left_keys(left: DataFrame, place) -> DataFrame:
    return left.withColumns({"k": N.left_clean(F.col("full_name")), "y": _left_year("byear"), "p": place(N.place_part(_text("place"))), "s": place(_text("source"))})


def _named(l: DataFrame, r: DataFrame, rules: EntryRules, more: Column | None = None, turn_left: bool = True) -> DataFrame:
    """Pairs of the same name, or of near ones with their best score over both word orders."""
    if rules.method is None:
        same = F.col("l.k") == F.col("r.k")
        return l.alias("l").join(r.alias("r"), same if more is None else same & more).withColumn("score", F.lit(None).cast("double"))
    m = METHODS[rules.method]
    block = lambda c: N.sorted_initials(c, rules.block_letters)
    side = lambda df, n: df.select(F.col("k").alias(n), block(F.col("k")).alias("b")).distinct()
    texts = side(l, "lk").join(side(r, "rk"), "b").select("lk", "rk").distinct()
    a, b = F.col("lk"), F.col("rk")
    turned = [m.score(a, b), m.score(a, N.reversed_words(b)), *([m.score(N.reversed_words(a), b)] if turn_left else [])]
    scored = texts.withColumn("score", F.greatest(*turned) if m.higher else F.least(*turned)).filter(passes(F.col("score"), rules.method, rules.threshold))
    met = l.alias("l").join(scored, F.col("l.k") == F.col("lk"))
    same = F.col("rk") == F.col("r.k")
    return met.join(r.alias("r"), same if more is None else same & more).drop("lk", "rk")


def _year_agrees(rules: EntryRules) -> Column:
    ly, ry = F.col("l.y"), F.col("r.y")
    ok = ly == ry
    if rules.max_year_gap is not None:
        a, b = ly.try_cast("int"), ry.try_cast("int")
        ok = F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) <= rules.max_year_gap).otherwise(ok)
    if rules.year_in_source:
        ok = ok | ((ry != "") & _text("l.source").contains(ry))
    return ok | (ly == "") if rules.empty_left_year else ok


def _fields_agree(pairs: DataFrame, rules: EntryRules, place: Column, named: Column) -> DataFrame:
    if not rules.empty_left_both:
        pairs = pairs.filter("not (l.p = '' and l.y = '')")
    if rules.check_place:
        ok = place | (named if rules.place_in_source else F.lit(False))
        pairs = pairs.filter(ok | (F.col("l.p") == "") if rules.empty_left_place else ok)
    return pairs.filter(_year_agrees(rules)) if rules.check_year else pairs


def _chosen(pairs: DataFrame, rules: EntryRules, key: str) -> DataFrame:
    """All exact pairs; of near ones the best per left record, ties to the first entry."""
    if rules.method is None:
        return pairs.select("a_id", key)
    first = -F.col("score") if METHODS[rules.method].higher else F.col("score")
    return pairs.groupBy("a_id").agg(F.min_by(key, F.struct(first, F.col(key))).alias(key))


def page_texts(entries: DataFrame, html: str = "html") -> DataFrame:
    """(entry_id, whole, body): lower-case text of a page up to its footer, and of the entry itself."""
    page = F.substring_index(html, E.FOOTER, 1)
    first = E.between(page, E.ENTRY_OPEN, "\x00")
    second = F.when(F.instr(page, E.SECOND_OPEN) > 0, F.substring(page, F.instr(page, E.SECOND_OPEN), F.length(page)))
    text = lambda c: F.lower(E.strip_tags(c))
    return entries.select("entry_id", html).distinct().select("entry_id", text(F.coalesce(second, page)).alias("whole"), text(F.coalesce(first, second, page)).alias("body"))


def entry_matches(left: DataFrame, entries: DataFrame, rules: EntryRules) -> DataFrame:
    """(a_id, entry_id) of left records and lexicon entries that are one person by the rules.

    ``left``: a_id, full_name, father, byear, place, dyear, source; ``entries``: entry_id, key_name, birth_place,
    birth_year, death_place, html.  Exact names give one row for each key an entry matched under, near names the best
    entry per left record.
    """
    l = _left_keys(left, lambda c: F.trim(F.lower(c))).select("a_id", "k", "y", "p", "s", "source", F.lower(_text("father")).alias("father"), F.trim(N.replace_all(_text("dyear"), "-", "*")).try_cast("int").alias("died"))
    r = entries.select("entry_id", F.trim(N.replace_all(F.lower("key_name"), "-")).alias("k"), F.trim(_text("birth_year")).alias("y"), F.trim(F.lower(_text("birth_place"))).alias("p"), F.lower(_text("death_place")).alias("dp"))
    for gone in rules.excluded_places:
        r = r.filter(~F.col("dp").contains(gone))
    if not rules.empty_death_place:
        r = r.filter("dp <> ''")
    pairs = _named(l, r, rules, F.col("l.y") == F.col("r.y") if rules.key_year else None)
    pairs = _fields_agree(pairs, rules, F.col("l.p") == F.col("r.p"), (F.col("r.p") != "") & F.col("l.s").contains(F.col("r.p")))
    pairs = pairs.select("a_id", "entry_id", "score", "dp", "died", "father")
    if rules.survival_words or rules.father_in_text:
        pairs = pairs.join(page_texts(entries), "entry_id")
    if rules.survival_words:
        shown = F.lit(False)
        for w in rules.survival_words:
            shown = shown | F.col("whole").contains(w)
        if rules.later_year:
            years = F.transform(F.regexp_extract_all("whole", F.lit(r"\d{4}"), F.lit(0)), lambda y: y.cast("int"))
            shown = shown | F.coalesce(F.exists(years, lambda y: (y < 2000) & (y > F.col("died"))), F.lit(False))
        pairs = pairs.filter((F.col("dp") != "") | shown)
    if rules.father_in_text:
        stem = F.substring("father", F.lit(1), F.greatest(F.length("father") - 2, F.lit(0)))
        told = F.col("body").contains(F.concat(F.lit(" "), stem))
        titled = F.col("body").contains(F.concat(F.lit(" sin "), stem)) | F.col("body").contains(F.concat(F.lit(" kći "), stem))
        pairs = pairs.filter((F.col("father") == "") | F.when(F.length(stem) >= 3, told).otherwise(titled))
    return _chosen(pairs, rules, "entry_id")


def father_context(body: Column, stem: Column, width: int = 40) -> Column:
    """Up to ``width`` characters on either side of the first mention."""
    at = F.locate(stem, body) if isinstance(stem, str) else F.instr(body, stem)
    return F.when(at > 0, F.substring(body, F.greatest(at - width, F.lit(1)), F.length(stem) + 2 * width))


def entry_listing(matches: DataFrame, left: DataFrame, entries: DataFrame) -> DataFrame:
    """(a_id, full_name, byear, entry_id, snippet, context): matches with the entry's beginning and the words around the father's name."""
    texts = page_texts(entries)
    stem = F.concat(F.lit(" "), F.substring(F.lower(_text("father")), F.lit(1), F.greatest(F.length("father") - 2, F.lit(0))))
    j = matches.select("a_id", "entry_id").distinct().join(left.select("a_id", "full_name", "byear", "father"), "a_id").join(texts, "entry_id")
    return j.select("a_id", "full_name", "byear", "entry_id", F.substring("body", 1, 100).alias("snippet"), father_context(F.col("body"), stem).alias("context")).orderBy("full_name", "byear", "entry_id")


def certificate_keys(certificates: DataFrame) -> DataFrame:
    """Each certificate under its name in both orders (once if they are equal), and its year."""
    a, b = F.trim(F.concat_ws(" ", "name", "surname")), F.trim(F.concat_ws(" ", "surname", "name"))
    keys = F.array_distinct(F.transform(F.array(a, b), lambda x: F.trim(N.replace_all(F.lower(x), "-"))))
    return certificates.withColumn("k", F.explode(keys))


def _certificate_side(certificates: DataFrame) -> DataFrame:
    return certificate_keys(certificates).select("c_id", "k", F.trim(_text("birth_year")).alias("y"), N.birth_place_variant(_text("birth_place")).alias("p"), N.birth_place_variant(_text("residence")).alias("q"))


def certificates_in_left(left: DataFrame, certificates: DataFrame, rules: EntryRules = CERTIFICATES) -> DataFrame:
    """(a_id, c_id): name in either order, year, place equal to birth place or residence or named in the source."""
    l = _left_keys(left, N.birth_place_variant).select("a_id", "k", "y", "p", "s", "source")
    pairs = _named(l, _certificate_side(certificates), rules, turn_left=False)
    named = (F.col("r.p") != "") & (F.col("l.s").contains(F.col("r.p")) | ((F.col("r.q") != "") & F.col("l.s").contains(F.col("r.q"))))
    pairs = _fields_agree(pairs, rules, (F.col("l.p") == F.col("r.p")) | (F.col("l.p") == F.col("r.q")), named)
    return _chosen(pairs.select("a_id", "c_id", "score"), rules, "c_id")


def certificates_in_right(certificates: DataFrame, right: DataFrame) -> DataFrame:
    """(c_id, b_id): same name in either order; place and year equal where both sides have one (residence counts)."""
    c = _certificate_side(certificates).alias("c")
    r = right.select("b_id", N.right_clean(F.concat(_text("given"), F.lit(" "), _text("surname"))).alias("k"), F.trim(N.replace_all(_text("byear"), "9999")).alias("y"), N.birth_place_variant(_text("place")).alias("p")).alias("r")
    both = c.join(r, F.col("c.k") == F.col("r.k"))
    both = both.filter("c.p = '' or r.p = '' or c.p = r.p or c.q = r.p").filter("c.y = '' or r.y = '' or c.y = r.y")
    return both.select(F.col("c.c_id").alias("c_id"), F.col("r.b_id").alias("b_id"))


def certificate_listing(matches: DataFrame, left: DataFrame, certificates: DataFrame, separator: str = "|") -> DataFrame:
    """Text lines: the left record, and behind a tab the certificate; sorted."""
    some = lambda *cs: F.concat_ws(separator, *[_text(c) for c in cs])
    j = matches.join(left.select("a_id", some("full_name", "byear", "place").alias("l")), "a_id").join(certificates.select("c_id", some("surname", "name", "birth_year", "birth_place", "residence").alias("c")), "c_id")
    return j.select(F.concat("l", F.lit("\n\t"), "c").alias("value")).orderBy("value")
