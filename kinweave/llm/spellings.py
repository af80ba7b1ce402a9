"""Queries of problem 1: records of one person under differently typed names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from collections.abc import Callable

from kinweave.llm.name_keys import TABS, buckets_of, joined_pairs, keys_from, keys_of, pairs_of
from kinweave.llm.people import TABLES, folded_words, people
from kinweave.llm.trie_join import MIN_LENGTH, OUTWEIGHS, trie_join
from kinweave.plans.runtime import cut, discard, sweep, table

#: Evidence beyond the name that a pair needs.
MIN_EVIDENCE = 2.5
#: Persons recorded under two given names, and share of the uses of the rarer one, from which these are forms of one name.
PERSONS = 2
LEAST_SHARE = 0.01
#: Record pairs of two names from which they are met by time, place or father instead of all with all.
HEAVY = 4096
#: Words, or hashes of keys or records, up to which (counted first) they are sent to every task; beyond it they are joined.
VOCABULARY = 1_000_000
CERTIFICATES = TABLES.index("match_entries")
#: Bits of dates: so many for even years, and for odd ones.
DATES = 14


def bare(w: Column) -> Column:
    return F.when(w.endswith("."), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)


def same_word(x: Column, y: Column) -> Column:
    """Equal, an abbreviation of the other, or within one slip (two in words from seven letters).

    A slip is an edit, or a swap: texts of the same letters may be two edits apart for each slip.
    """
    bx, by = bare(x), bare(y)
    cut_short = x.endswith(".") | y.endswith(".") | (F.length(bx) == 1) | (F.length(by) == 1)
    room = F.when(F.least(F.length(bx), F.length(by)) >= 7, 2).when(F.least(F.length(bx), F.length(by)) >= 4, 1).otherwise(0)
    d = F.levenshtein(bx, by, 4)  # -1 beyond
    letters = lambda w: F.array_sort(F.split(w, ""))
    return (bx == by) | (cut_short & (bx.startswith(by) | by.startswith(bx))) | ((d >= 0) & ((d <= room) | ((d <= 2 * room) & (letters(bx) == letters(by)))))


def near_words(words: DataFrame) -> DataFrame:
    """(a, b): pairs of the different words ``w`` that ``same_word`` takes for one, abbreviations apart.

    One edit, two from seven letters, and words of the same letters, which may be four edits (two swaps) apart.
    """
    return _met_words(words.withColumn("n", F.lit(0)), None).distinct()


def _met_words(words: DataFrame, weight: str | None) -> DataFrame:
    """``near_words`` of w, n, some of them twice; with a ``weight`` only those whose second word weighs more."""
    near = trie_join(words.filter("length(w) <= 7"), "w", 1, weight=weight).unionAll(trie_join(words.filter("length(w) >= 7"), "w", 2, weight=weight)).select("a", "b")
    letters = words.filter(F.length("w") >= MIN_LENGTH).select("w", "n", F.array_join(F.array_sort(F.split("w", "")), "").alias("key"))
    swapped = letters.select(F.col("w").alias("a"), F.col("n").alias("na"), "key").join(letters.select(F.col("w").alias("b"), F.col("n").alias("nb"), "key"), "key")
    swapped = swapped.filter("a <> b" if weight is None else OUTWEIGHS).filter(F.levenshtein("a", "b", 4) >= 0).select("a", "b")
    return near.unionAll(swapped.filter(same_word(F.col("a"), F.col("b"))))


def familiar_forms(forms: DataFrame) -> DataFrame:
    """(s, f, weight): familiar and full given names of a list, sound-folded."""
    folded = folded_words(forms.select(F.col("short_form").alias("s"), F.col("full_form").alias("f")))
    return folded.select("s", "f", F.lit(1 << 40).cast("long").alias("weight")).filter("s <> '' and f <> '' and s <> f").distinct()


def learned_forms(records: DataFrame) -> DataFrame:
    """(s, f, weight): given names that stand for each other in the records themselves, the rarer and the more frequent.

    Two given names count once for each family name, year, father and place under which both are recorded: brothers and
    sisters share all but the year.  They are forms of one name if that happens for PERSONS persons at least and for LEAST_SHARE of
    the uses of the rarer one.  Read from records with split names of two words; all of them are counted.
    """
    two = records.filter("given_n = 1 and size(tokens) = 2 and byear is not null and father is not null and place is not null and tokens[0] not like '%.'")
    seen = two.select(F.xxhash64("byear", "father", "place", F.get("tokens", F.lit(1))).alias("h"), F.get("tokens", F.lit(0)).alias("g"))
    uses = seen.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    groups = seen.groupBy("h").agg(F.collect_set("g").alias("gs")).filter("size(gs) > 1")
    both = groups.select(F.explode("gs").alias("s"), "gs").select("s", F.explode("gs").alias("f")).filter("s <> f").groupBy("s", "f").agg(F.count(F.lit(1)).alias("weight"))
    both = both.filter(F.col("weight") >= PERSONS).join(uses.select(F.col("g").alias("s"), F.col("n").alias("ns")), "s").join(uses.select(F.col("g").alias("f"), F.col("n").alias("nf")), "f")
    return both.filter((F.col("weight") >= LEAST_SHARE * F.col("ns")) & ((F.col("ns") < F.col("nf")) | ((F.col("ns") == F.col("nf")) & (F.col("s") > F.col("f"))))).select("s", "f", "weight")


def date_bits(year: str, date: str) -> Column:
    """The dates that may go with a certificate, as bits that two certificates share if ``dates_agree`` can accept them.

    One for a full date, those of the even or of the odd years for a year, all without; missing is null or 0.
    """
    half = f"coalesce({year}, 0) % 2 * {DATES}"
    return F.expr(f"case when coalesce({year}, 0) = 0 then {(1 << 2 * DATES) - 1} when coalesce({date}, 0) = 0 then shiftleft({(1 << DATES) - 1}, {half}) else shiftleft(1, {half} + pmod(hash({date}), {DATES})) end")


def names_of(records: DataFrame) -> DataFrame:
    """One row per folded name: nid, tokens, n (records), tabs and mixed (bits of the tables that hold it, and
    that hold it under several stored names), years (bits of two-year steps), undated and dates (of its certificates)."""
    code = F.col("rid") % 4
    step = lambda c: F.expr(f"coalesce(shiftleft(1L, shiftright({c} - 1838, 1) % 64), 0L)")
    years = step("byear").bitwiseOR(step("byear2"))
    sides = [x for t in range(len(TABLES)) for x in (F.min(F.when(code == t, F.col("r"))).alias(f"lo{t}"), F.max(F.when(code == t, F.col("r"))).alias(f"hi{t}"))]
    grouped = records.groupBy("tokens").agg(
        F.count(F.lit(1)).alias("n"), F.bit_or(years).alias("years"), F.max(F.col("byear").isNull()).alias("undated"), F.bit_or(F.when(code == CERTIFICATES, date_bits("byear", "bdate"))).alias("dates"), *sides
    )
    flag = lambda cond, t: F.when(cond, F.lit(1 << t)).otherwise(0)
    tabs = sum((flag(F.col(f"lo{t}").isNotNull(), t) for t in range(len(TABLES))), F.lit(0))
    mixed = sum((flag(F.col(f"lo{t}") < F.col(f"hi{t}"), t) for t in range(len(TABLES))), F.lit(0))
    return grouped.select(F.xxhash64("tokens").alias("nid"), "tokens", "n", "years", "undated", F.coalesce("dates", F.lit(0)).alias("dates"), tabs.alias("tabs"), mixed.alias("mixed"))


def named(tokens: Column) -> Column:
    """More than one letter."""
    return (F.size(tokens) > 1) | (F.length(bare(F.get(tokens, F.lit(0)))) > 1)


def worded(names: DataFrame) -> DataFrame:
    """The names with ``ws``, their words; neighbours written together as well, as a stray space splits words.

    Names of a single letter are no names.
    """
    joined = lambda: F.transform(F.sequence(F.lit(1), F.size("tokens") - 1), lambda i: F.concat(F.get("tokens", i - 1), F.get("tokens", i)))
    return names.filter(named(F.col("tokens"))).withColumn("ws", F.when(F.size("tokens") > 2, F.concat("tokens", joined())).otherwise(F.col("tokens")))


def name_words(names: DataFrame) -> DataFrame:
    """(nid, pos, w, n): words of the names (``worded``)."""
    return worded(names).select("nid", "n", F.posexplode("ws").alias("pos", "w"))


def _facts() -> list[Column]:
    """n, tabs (above them the dates) and years of names; all years are set where a record has none."""
    years = F.when(F.col("undated"), F.lit(-1).cast("long")).otherwise(F.col("years"))
    return [F.col("n").cast("int").alias("n"), F.col("tabs").bitwiseOR(F.shiftleft("dates", TABS)).cast("int").alias("tabs"), years.alias("years")]


def _short(w: Column) -> Column:
    """An abbreviation or a letter or two."""
    return w.endswith(".") | (F.length(w) <= 2)


def hubs(words: DataFrame, forms: DataFrame) -> DataFrame:
    """(w, hubs): hashes of the spellings that a word may be a variant of; abbreviations have none.

    These are the word itself, near words that are more frequent (of two as frequent the first in order), and full forms of familiar
    names: two near words always share the more frequent one, however many records hold them.  ``words``: w, n (records).
    """
    full = words.filter(~_short(F.col("w"))).select("w", "n")
    up = _met_words(full, "n").select(F.col("a").alias("w"), F.col("b").alias("hub"))
    all_ = cut(full.select("w", F.col("w").alias("hub")).unionAll(up))
    spelled = all_.join(forms, all_.hub == forms.s).select("w", F.col("f").alias("hub"))
    return all_.unionAll(spelled).groupBy("w").agg(F.collect_set(F.xxhash64("hub")).alias("hubs"))


def spelled_names(names: DataFrame, words: DataFrame, hub_of: DataFrame) -> DataFrame:
    """(nid, n, tabs, years, xs): names with the spellings of each word, for a vocabulary too large to be sent to all tasks.

    A name of abbreviations only is completed in its longest one (of three letters at least) to every word it can be.
    """
    at = words.select("nid", "pos", "w").join(hub_of, "w", "left")
    facts = names.select("nid", *_facts())
    grouped = at.groupBy("nid").agg(F.collect_list(F.struct("w", "hubs")).alias("xs"), F.max(F.when(_short(F.col("w")), F.struct(F.length("w"), "w"))).getField("w").alias("long"), F.max((~_short(F.col("w"))).cast("int")).alias("whole"))
    stem = F.when((F.col("whole") == 0) & (F.length("long") > 3), bare(F.col("long")))
    starts = hub_of.select(F.xxhash64("w").alias("hub"), F.explode(F.transform(F.sequence(F.lit(3), F.greatest(F.lit(3), F.least(F.length("w") - 1, F.lit(9)))), lambda i: F.substring("w", F.lit(1), i))).alias("stem"))
    completed = grouped.select("nid", stem.alias("stem")).filter("stem is not null").join(starts, "stem").groupBy("nid").agg(F.collect_set("hub").alias("completed"))
    filled = F.transform("xs", lambda x: F.struct(x["w"].alias("w"), F.when(x["w"] == F.col("long"), F.col("completed")).otherwise(x["hubs"]).alias("hubs")))
    both = grouped.join(facts, "nid").join(completed, "nid", "left")
    return both.select("nid", "n", "tabs", "years", F.when(F.col("completed").isNotNull(), filled).otherwise(F.col("xs")).alias("xs"))


def name_pairs(names: DataFrame, keys: DataFrame, sides: Callable, itself: Column) -> DataFrame:
    """(x, y, heavy, y_years, sides) of names that share one of ``keys``, x that of fewer records, with the years and dates of y; some of them twice.

    ``sides`` gives the tables in which two names may meet (from arrays of the bits of those that hold them), ``itself``
    those in which a name may meet itself; 0 for none.
    """
    out = cut(pairs_of(keys, sides, HEAVY))
    pairs = out.filter("x is not null").select("x", "y", "heavy", "y_years", "sides")
    joined = joined_pairs(out.filter("x is null").select("key", "kind", "stem", "nid", "n", "tabs", "years"), sides, HEAVY)
    own = names.filter((itself != 0) & named(F.col("tokens"))).select(F.col("nid").alias("x"), F.col("nid").alias("y"), (F.col("n") * F.col("n") > HEAVY).alias("heavy"), F.lit(-1).cast("long").alias("y_years"), itself.bitwiseOR(((1 << 2 * DATES) - 1) << TABS).cast("int").alias("sides"))
    return pairs.unionAll(cut(joined.unionAll(own)))


def near_places(places: DataFrame) -> DataFrame:
    """(place, near): every pair of the different values ``place`` that ``near_place`` takes for one, both ways and with themselves.

    They are at most two letters longer or shorter, or one begins the other; an empty one begins all.
    """
    one = places.select("place").filter("place is not null").distinct()
    other = one.withColumnRenamed("place", "near")
    sized = one.select("place", F.explode(F.sequence(F.length("place") - 2, F.length("place") + 2)).alias("n")).join(other.withColumn("n", F.length("near")), "n").select("place", "near")
    first = lambda c: F.substring(bare(F.col(c)), 1, 1)
    begun = one.withColumn("n", first("place")).join(other.withColumn("n", first("near")), "n").select("place", "near")
    empty = one.filter(bare(F.col("place")) == "").crossJoin(other)
    met = sized.unionAll(begun).unionAll(empty).unionAll(empty.select(F.col("near").alias("place"), F.col("place").alias("near")))
    return met.filter(near_place(F.col("place"), F.col("near"))).distinct()


def meeting_keys(first: bool) -> Column:
    """Hashes under which the records of a heavy name pair meet, of its first or of its second name; ``near``: places near
    that of a record without a year.

    All pairs that the evidence of this problem can accept share one: years at most two apart, or, if one record has none,
    anything for registries; the full date, the year if one has no full date, or near places if one has no year, for certificates.
    """
    one = lambda name, x, cond=F.lit(True): F.when(cond & x.isNotNull(), F.xxhash64(F.lit(name), x.cast("string")))
    step = lambda c, d: F.shiftright(F.col(c), 1) + d
    # under the first name a record that lacks something meets all of the second, under the other all of the first meet it
    mine, other = ("1", "2") if first else ("2", "1")
    either = lambda name, x, lacks: [one(name + mine, x, lacks), one(name + other, x)]
    undated = F.col("byear").isNull()
    registry = F.array(*[one("y", step(c, d)) for c in ("byear", "byear2") for d in ([0] if first else [-1, 0, 1])], *either("a", F.lit(0), undated))
    certificate = F.array(one("d", F.col("bdate")), *either("u", F.col("byear"), F.col("bdate").isNull()), one("p" + other, F.col("place")))
    around = F.transform(F.coalesce("near", F.array().cast("array<string>")), lambda p: one("p" + mine, p))
    return F.array_distinct(F.array_compact(F.when(F.col("rid") % 4 == CERTIFICATES, F.concat(certificate, around)).otherwise(registry)))


ATTRIBUTES = ["byear", "byear2", "bdate", "place", "father", "dyear", "dplace", "sex"]
#: What is known of the attributes in numbers alone.
NUMBERS = ["byear", "byear2", "bdate", "dyear", "sex", "pletters", "fletters", "dletters"]


def record_pairs(pairs: DataFrame, records: DataFrame, forms: DataFrame, fits: Callable, least: float = MIN_EVIDENCE) -> DataFrame:
    """Record pairs a, b (structs of rid, r and attributes) of the name pairs that fit and may reach ``least`` evidence.

    ``fits(tab_a, r_a, tab_b, r_b)`` decides over the tables and stored names of two records.  Heavy name pairs give the pairs
    that others give: their keys are met by all that MIN_EVIDENCE accepts, and with less to reach they are not used.
    """
    full = forms.groupBy("s").agg(F.max_by("f", F.struct("weight", "f")).alias("f"))
    # a familiar form of a father's name may stand for other letters
    any_father = F.when(F.col("s").isNotNull(), F.lit((1 << 26) - 1)).otherwise(F.col("fletters"))
    bounded = lambda df: df.join(full.select("s"), df.father == F.col("s"), "left").withColumn("fletters", any_father)
    rec = F.struct("rid", "r", *_numbers())
    known = bounded(records.select("rid", "r", "nid", "father", *NUMBERS)).select("nid", rec.alias("rec"))
    tab = lambda c: F.col(f"{c}.rid") % 4
    fit = fits(tab("a"), F.col("a.r"), tab("b"), F.col("b.r")) & (F.col("a.rid") != F.col("b.rid"))
    once = ~F.col("own") | (F.col("a.rid") < F.col("b.rid"))
    ids = [F.col("a.rid").alias("i"), F.col("b.rid").alias("j")]
    here = F.col("sides").bitwiseAND(F.expr("shiftleft(1, cast(a.rid % 4 as int))")) != 0
    # a record of x goes on to y only if the two may meet in its table and some year, and date, of y may go with it
    bit = lambda c: F.when(F.col(c) == 0, F.lit(0).cast("long")).otherwise(F.expr(f"shiftleft(1L, shiftright({c} - 1838, 1) % 64)"))
    around = lambda c: c.bitwiseOR(F.shiftleft(c, 1)).bitwiseOR(F.shiftrightunsigned(c, 63)).bitwiseOR(F.shiftrightunsigned(c, 1)).bitwiseOR(F.shiftleft(c, 63))
    fitting = F.when(tab("a") == CERTIFICATES, bit("a.byear")).otherwise(around(bit("a.byear").bitwiseOR(bit("a.byear2"))))
    timely = ((F.col("a.byear") == 0) | (fitting.bitwiseAND(F.col("y_years")) != 0)) & ((tab("a") != CERTIFICATES) | (date_bits("a.byear", "a.bdate").bitwiseAND(F.shiftright("sides", TABS)) != 0))
    keyed = least >= MIN_EVIDENCE
    # once by x, for what is met twice and for the join
    some = (pairs.filter("not heavy") if keyed else pairs).select("x", "y", "y_years", "sides").repartition("x").distinct()
    light = some.join(known.select(F.col("nid").alias("x"), F.col("rec").alias("a")), "x").filter(here & timely).select("y", (F.col("x") == F.col("y")).alias("own"), "a")
    light = light.join(known.select(F.col("nid").alias("y"), F.col("rec").alias("b")), "y").filter(once & fit & may_agree(least)).select(*ids)
    done, dense = [pairs], None
    # the two ways are written one after the other, so that the shuffle files of one are gone before the other
    light = cut(light.distinct())
    if keyed:
        # the few names that many records hold are met by their stored names and further keys, so that no two are paired as a whole
        heavy = cut(pairs.filter("heavy").select("x", "y").distinct())
        some = cut(bounded(records.join(heavy.select(F.explode(F.array("x", "y")).alias("nid")).distinct(), "nid", "left_semi")).select("nid", (F.col("rid") % 4).alias("tab"), "r", rec.alias("rec"), "place", "rid", "byear", "byear2", "bdate", F.when(F.col("byear").isNull(), F.col("place")).alias("alone")))
        classes = some.groupBy("nid", "tab", "r").agg(F.count(F.lit(1)).alias("n"))
        side = lambda n, c, m: classes.select(F.col("nid").alias(n), F.struct("tab", "r").alias(c), F.col("n").alias(m))
        alike = heavy.join(side("x", "ca", "na"), "x").join(side("y", "cb", "nb"), "y").filter(fits(F.col("ca.tab"), F.col("ca.r"), F.col("cb.tab"), F.col("cb.r")) & ((F.col("x") != F.col("y")) | (F.col("ca") < F.col("cb"))))
        alike = cut(alike.withColumn("c", F.xxhash64("x", "y", "ca", "cb")))
        near = cut(near_places(some.filter(F.col("tab") == CERTIFICATES)).groupBy(F.col("place").alias("alone")).agg(F.collect_list("near").alias("near")))
        spread = some.join(near, "alone", "left")
        # of two stored names the one of fewer records is written with its keys; of the other only what meets them goes on
        own = lambda n, c, first: spread.join(alike.select(F.col(n).alias("nid"), f"{c}.tab", f"{c}.r", "c", F.expr("na <= nb" if first else "nb < na").alias("few")), ["nid", "tab", "r"]).select("few", F.lit(first).alias("first"), "rec", "c", F.explode(meeting_keys(first)).alias("k"))
        keyed_rows = own("x", "ca", True).unionAll(own("y", "cb", False)).withColumn("h", F.xxhash64("c", "k"))
        fewer = cut(keyed_rows.filter("few").select("h", F.col("rec").alias("b")))
        more = keyed_rows.filter("not few").select("h", "first", F.col("rec").alias("a"))
        more = more.join(_sent(cut(fewer.select("h").distinct())), "h", "left_semi")
        end = lambda x, y: F.when(F.col("first"), F.col(x)).otherwise(F.col(y))
        dense = more.join(fewer, "h").filter(fit & may_agree(least)).select(end("a.rid", "b.rid").alias("i"), end("b.rid", "a.rid").alias("j"))
        dense = cut(dense.distinct())
        done += [heavy, some, alike, near, fewer]
    few = light if dense is None else light.unionAll(dense).distinct()
    for written in done:
        discard(written)
    sweep(records.sparkSession)
    # texts only of records in pairs; fathers in the full form of their names
    met = cut(few.select(F.explode(F.array("i", "j")).alias("rid")).distinct())
    ends = records.select("rid", "r", "nid", "tokens", *ATTRIBUTES).join(_sent(met), "rid", "left_semi").repartition("rid").distinct()
    ends = ends.join(full, ends.father == full.s, "left").withColumn("father", F.coalesce("f", "father"))
    told = F.struct("rid", "r", "nid", "tokens", *ATTRIBUTES)
    return few.join(ends.select(F.col("rid").alias("i"), told.alias("a")), "i").join(ends.select(F.col("rid").alias("j"), told.alias("b")), "j").select("a", "b")


def _sent(hashes: DataFrame) -> DataFrame:
    """A table of one number a row, to be sent to every task if its rows, counted first, are not more than VOCABULARY."""
    return F.broadcast(hashes) if hashes.count() <= VOCABULARY else hashes


def _numbers() -> list[Column]:
    """NUMBERS without nulls: 0 for no year, date or sex (a hash), -1 for no letters.

    The bound below stays short enough in the JVM's code to be compiled; with tests for null it ran interpreted.
    """
    none = lambda c: -1 if c.endswith("letters") else 0
    value = lambda c: F.when(F.col(c).isNotNull(), F.hash(c)) if c == "sex" else F.col(c)
    return [F.coalesce(value(c), F.lit(none(c))).alias(c) for c in NUMBERS]


def _letters_near(c: str, room: int) -> Column:
    """Words of these letters can be near or one an abbreviation of the other: an edit changes two letters at most."""
    a, b = F.col(f"a.{c}"), F.col(f"b.{c}")
    return (F.bit_count(a.bitwiseXOR(b)) <= 2 * room) | (a.bitwiseAND(b) == a) | (a.bitwiseAND(b) == b)


def may_agree(least: float) -> Column:
    """A bound from numbers alone (``_numbers``): what this leaves out, the evidence would not accept."""
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    lacks = lambda c: a(c).bitwiseOR(b(c)) < 0 if c.endswith("letters") else (a(c) == 0) | (b(c) == 0)
    points = lambda c, agree, plus, minus: F.when(lacks(c), 0).when(agree, plus).otherwise(minus)
    # twice the points of the evidence; a year that is lacking is far from all others
    apart = F.least(F.abs(a("byear") - b("byear")), F.abs(a("byear2") - b("byear")), F.abs(a("byear") - b("byear2")))
    most = points("byear", apart > 2, -8, 6 - 3 * apart) + points("sex", a("sex") == b("sex"), 0, -8) + points("dyear", a("dyear") == b("dyear"), 2, -2)
    most = most + points("fletters", _letters_near("fletters", 4), 4, -6) + points("pletters", _letters_near("pletters", 2), 4, -3) + points("dletters", _letters_near("dletters", 2), 2, -2)
    place = lacks("pletters") | _letters_near("pletters", 2)
    dates = F.when(lacks("bdate"), F.when(lacks("byear"), ~lacks("pletters")).otherwise(a("byear") == b("byear")) & place).otherwise(a("bdate") == b("bdate"))
    return F.when(a("rid") % 4 == CERTIFICATES, dates).otherwise(most >= 2 * least)


def near_place(a: Column, b: Column) -> Column:
    d = F.levenshtein(a, b, 2)  # -1 beyond
    return (a == b) | (bare(a).startswith(bare(b)) | bare(b).startswith(bare(a))) | ((d >= 0) & (d <= F.when(F.least(F.length(a), F.length(b)) >= 6, 2).otherwise(1)))


def _years_apart() -> Column:
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    return F.least(F.abs(a("byear") - b("byear")), F.coalesce(F.abs(a("byear2") - b("byear")), F.lit(99)), F.coalesce(F.abs(a("byear") - b("byear2")), F.lit(99)))


def _year_points() -> Column:
    off = _years_apart()
    known = F.col("a.byear").isNotNull() & F.col("b.byear").isNotNull()
    return F.when(known, F.when(off == 0, 3.0).when(off == 1, 1.5).when(off == 2, 0.0).otherwise(-4.0)).otherwise(0.0)


def _points(cond_both: Column, agree: Column, plus: float, minus: float) -> Column:
    return F.when(cond_both, F.when(agree, F.lit(plus)).otherwise(F.lit(minus))).otherwise(F.lit(0.0))


def evidence() -> Column:
    """Points for and against one person from all attributes but the name; missing values say nothing."""
    return total(attribute_points())


def total(points: dict[str, Column]) -> Column:
    out = F.lit(0.0)
    for p in points.values():
        out = out + p
    return out


def attribute_points() -> dict[str, Column]:
    """Points by attribute of a pair (structs a and b with their tokens)."""
    both = lambda c: F.col(f"a.{c}").isNotNull() & F.col(f"b.{c}").isNotNull()
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    fathers = same_word(a("father"), b("father"))
    return {
        "year": _year_points(),
        "father": _points(both("father"), fathers, 2.0, -3.0),
        "place": _points(both("place"), near_place(a("place"), b("place")), 2.0, -1.5),
        "dyear": _points(both("dyear"), a("dyear") == b("dyear"), 1.0, -1.0),
        "dplace": _points(both("dplace"), near_place(a("dplace"), b("dplace")), 1.0, -1.0),
        "sex": _points(both("sex"), a("sex") == b("sex"), 0.0, -4.0),
        # names without a whole word in common are variants in every word
        "words": F.when(F.arrays_overlap("a.tokens", "b.tokens"), 0.0).otherwise(-1.5),
    }


def dates_agree() -> Column:
    """Certificates: full dates equal; the same year where one is short, and places not different; without a date, near places."""
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    full = a("bdate").isNotNull() & b("bdate").isNotNull()
    dated = a("byear").isNotNull() & b("byear").isNotNull()
    near = near_place(a("place"), b("place"))
    return F.when(full, a("bdate") == b("bdate")).when(dated, (a("byear") == b("byear")) & F.coalesce(near, F.lit(True))).otherwise(F.coalesce(near, F.lit(False)))


def all_forms(spark: SparkSession, sf_dir: str, records: DataFrame) -> DataFrame:
    return cut(familiar_forms(table(spark, sf_dir, "given_name_forms")).unionByName(learned_forms(records)))


def unambiguous(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Certificate pairs without two full dates and without year and place, if nobody else can be meant.

    Such a pair (a, b) rests on its names and on its year alone, or its place alone.  It stays if the names have a whole word in
    common, and if the records of both names with that year or place have one full date at most between them; namesakes
    make it a guess.  Other pairs stay as they are.
    """
    both = lambda c: F.col(f"a.{c}").isNotNull() & F.col(f"b.{c}").isNotNull()
    weak = (F.col("a.rid") % 4 == CERTIFICATES) & ~both("bdate") & ~(both("byear") & both("place"))
    at = lambda y, p: F.when(y, F.xxhash64(F.lit("y"), p.getField("byear"))).otherwise(F.xxhash64(F.lit("p"), p.getField("place")))
    doubtful = cut(pairs.filter(weak & F.arrays_overlap("a.tokens", "b.tokens")))
    keys = F.array_distinct(F.array(*[F.xxhash64(F.col(f"{x}.nid"), at(both("byear"), F.col(x))) for x in "ab"]))
    asked = doubtful.select(F.col("a.rid").alias("i"), F.col("b.rid").alias("j"), F.explode(keys).alias("h"))
    dated = records.filter((F.col("rid") % 4 == CERTIFICATES) & F.col("bdate").isNotNull())
    where = F.array(F.xxhash64("nid", F.xxhash64(F.lit("y"), "byear")), F.when(F.col("place").isNotNull(), F.xxhash64("nid", F.xxhash64(F.lit("p"), "place"))))
    dates = dated.select(F.explode(where).alias("h"), "bdate").join(_sent(cut(asked.select("h").distinct())), "h", "left_semi").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    guessed = asked.join(dates, "h").groupBy("i", "j").agg(F.sum("n").alias("n")).filter("n > 1")
    sure = doubtful.join(guessed, (F.col("a.rid") == F.col("i")) & (F.col("b.rid") == F.col("j")), "left_anti")
    return pairs.filter(~weak).unionByName(sure)


def linked_names(records: DataFrame, forms: DataFrame, sides: Callable, itself: Column) -> DataFrame:
    """Name pairs of the records, by the trie join of their words."""
    spark = records.sparkSession
    names = cut(names_of(records))
    words = name_words(names)
    counts = cut(words.groupBy("w").agg(F.sum("n").alias("n")))
    hub_of = cut(hubs(counts, forms))
    done, sent = [names, counts, hub_of], []
    buckets = buckets_of(spark, names.count())
    if hub_of.count() <= VOCABULARY:
        keys, sent = keys_from(worded(names).select("nid", *_facts(), "ws"), hub_of, VOCABULARY, buckets)
    else:
        done.append(spelled := cut(spelled_names(names, words, hub_of)))
        keys = keys_of(spelled, buckets)
    pairs = name_pairs(names, keys, sides, itself)
    for written in done:
        discard(written)
    for broadcast in sent:
        broadcast.destroy()
    sweep(spark)
    return pairs


def variants(records: DataFrame, forms: DataFrame) -> DataFrame:
    """(source_table, key_a, key_b, evidence) of records of one table and person whose stored names differ.

    ``records`` as ``people`` gives them, ``forms`` (s, f, weight) given names that stand for each other.  Repeated records count once, records
    without a name meet nobody, missing attributes say nothing.  No records, no rows.
    """
    pairs = linked_names(records, forms, lambda t, u: t & u, F.col("mixed"))
    # not ta == tb: that would be a key of the joins, and the records would be exchanged once for each side
    met = record_pairs(pairs, records, forms, lambda ta, ra, tb, rb: (ta - tb == 0) & (ra != rb))
    points = F.when(F.col("a.rid") % 4 == CERTIFICATES, F.when(dates_agree(), F.lit(MIN_EVIDENCE)).otherwise(F.lit(-9.0))).otherwise(evidence())
    sure = unambiguous(cut(met.withColumn("evidence", points).filter(F.col("evidence") >= MIN_EVIDENCE)), records)
    rid = lambda f: f("a.rid", "b.rid")
    code = F.array(*[F.lit(t) for t in TABLES])[F.col("a.rid") % 4]
    return sure.select(code.alias("source_table"), F.shiftright(rid(F.least), 2).alias("key_a"), F.shiftright(rid(F.greatest), 2).alias("key_b"), "evidence").distinct()


def variant_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = cut(people(spark, sf_dir))
    return variants(records, all_forms(spark, sf_dir, records))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_pairs(spark, sf_dir).select("source_table", "key_a", "key_b").distinct()


def queries() -> dict:
    return {"p1_found": found}


def oracle_sql() -> dict[str, str]:
    return {}
