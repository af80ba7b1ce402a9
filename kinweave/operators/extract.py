"""Text extraction: pages, lexicon entries, alternate names, broken lines and record lines, as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTRY_OPEN = '<p class="Normal"><span class="Bold">'
SECOND_OPEN = '<div class="tekst">'
FOOTER = '<footer class="entry-footer">'


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", "")


def between(text: Column, start: str, end: str) -> Column:
    """What stands between the first ``start`` and the next ``end``; null without ``start``."""
    rest = F.when(F.instr(text, start) > 0, F.substring(text, F.instr(text, start) + len(start), F.length(text)))
    return F.substring_index(rest, end, 1)


def _close(text: str, start: str) -> Column:
    """Position of the span's end after the first ``start``."""
    quoted = start.replace("'", "''")
    return F.expr(f"locate('</span>', {text}, instr({text}, '{quoted}') + {len(start)})")


def page_fields(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``name`` (text after the second h1) and ``fields`` (title to content; a repeated title keeps its last)."""
    name = F.trim(F.substring_index(F.get(F.split(F.col(html), "<h1[^>]*>"), F.lit(2)), "<", 1))
    pair = r'detail_title[^>]*>([^<]*)<[\s\S]*?detail_content[^>]*>([^<]*)'
    titles = F.transform(F.regexp_extract_all(html, F.lit(pair), F.lit(1)), lambda x: F.trim(x))
    values = F.transform(F.regexp_extract_all(html, F.lit(pair), F.lit(2)), lambda x: F.trim(x))
    both = F.arrays_zip(titles.alias("t"), values.alias("v"))
    # last of repeated titles: a pair stays if its title does not come again later
    last = F.filter(both, lambda x, i: ~F.exists(F.slice(both, i + 2, F.size(both)), lambda y: y["t"] == x["t"]))
    return pages.withColumns({"name": F.coalesce(name, F.lit("")), "fields": F.map_from_entries(last)})


def given_then_surname(name: Column) -> Column:
    """Words not in capitals first, then those in capitals; brackets dropped, hyphens and commas as spaces."""
    ws = F.filter(F.split(F.regexp_replace(F.regexp_replace(name, r"\([^)]*\)", ""), "[-,]", " "), r"\s+"), lambda w: w != "")
    caps = lambda w: (F.upper(w) == w) & (F.lower(w) != w)
    return F.array_join(F.concat(F.filter(ws, lambda w: ~caps(w)), F.filter(ws, caps)), " ")


def _life(bracket: Column, dash: str) -> dict[str, Column]:
    place = lambda c: F.regexp_replace(F.trim(F.substring_index(c, ",", 1)), r"(?U)[^\w ]", "")
    leading = F.regexp_extract(place(bracket), r"^(?:(?U)\p{Lu}\w*(?: +(?=\p{Lu})|))+", 0)
    after = F.when(F.instr(bracket, dash) > 0, F.substring(bracket, F.instr(bracket, dash) + len(dash), F.length(bracket)))
    return {
        "birth_place": F.when(F.trim(leading) != "", F.trim(leading)).otherwise(place(bracket)), "birth_year": F.regexp_extract(bracket, r"\d{4}", 0),
        "death_place": place(after), "death_year": F.nullif(F.regexp_extract(after, r"\d{4}", 0), F.lit("")),
    }


def lexicon_entries(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds name, birth and death data of entries of the first kind; pages without an entry are dropped."""
    found = pages.filter(F.instr(html, ENTRY_OPEN) > 0).withColumn("raw_name", F.trim(strip_tags(between(F.col(html), ENTRY_OPEN, "</span>"))))
    after = F.substring(F.col(html), _close(html, ENTRY_OPEN), F.lit(100))
    bracket = F.coalesce(F.get(F.filter(F.regexp_extract_all(after, F.lit(r"\(([^)]*)\)"), F.lit(1)), lambda b: b.rlike(r"\d{4}")), F.lit(0)), F.lit(""))
    return found.withColumn("bracket", bracket).withColumns({"name": given_then_surname(F.col("raw_name")), **_life(F.col("bracket"), "–")})


def second_entries(pages: DataFrame, html: str = "html") -> DataFrame:
    """Entries of the second kind: body from its div, headword within 500 characters, data within 200."""
    body = F.when(F.instr(html, '<div class="tekst">') > 0, F.substring(F.col(html), F.instr(html, '<div class="tekst">'), F.length(html)))
    found = pages.withColumn("body", body).filter(F.col("body").isNotNull())
    head = '<span class="natuknica">'
    near = F.substring("body", 1, 500)
    found = found.filter(F.instr(near, head) > 0).withColumn("raw_name", F.trim(strip_tags(between(F.col("body"), head, "</span>"))))
    after = F.substring(F.col("body"), _close("body", head), F.lit(200))
    bracket = F.coalesce(F.get(F.filter(F.regexp_extract_all(after, F.lit(r"\(([^)]*)\)"), F.lit(1)), lambda b: b.rlike(r"\d{4}")), F.lit(0)), F.lit(""))
    one_dash = F.regexp_replace(F.col("bracket"), "&mdash;|&ndash;|–|—|-", "–")
    return found.withColumn("bracket", bracket).withColumns({"name": given_then_surname(F.col("raw_name")), **_life(one_dash, "–")})


def entry_keys(entries: DataFrame) -> DataFrame:
    """One row per name an entry can be found under: its own, and the one its brackets give (``key_name``).

    Brackets with a comma are a full name; a single word replaces the first word with the same initial, unless all
    initials are equal.  Both may give the same key; such rows are kept.
    """
    inside = F.regexp_extract("raw_name", r"\(([^)]*)\)", 1)
    ws = F.filter(F.split(F.regexp_replace(F.regexp_replace("raw_name", r"\([^)]*\)", ""), "[-,]", " "), r"\s+"), lambda w: w != "")
    initials = F.transform(ws, lambda w: F.lower(F.substring(w, 1, 1)))
    at = F.array_position(initials, F.lower(F.substring(F.trim(inside), 1, 1)))
    swapped = F.transform(ws, lambda w, i: F.when(i + 1 == at, F.trim(inside)).otherwise(w))
    full = F.when((F.instr(inside, ",") > 0) & (F.size(F.filter(F.split(F.regexp_replace(inside, ",", " "), r"\s+"), lambda w: w != "")) >= 2), given_then_surname(inside))
    single = F.when((F.instr(inside, ",") == 0) & F.trim(inside).rlike(r"^\S+$") & (F.size(F.array_distinct(initials)) > 1) & (at > 0), given_then_surname(F.array_join(swapped, " ")))
    keys = F.filter(F.array(F.col("name"), F.coalesce(full, single)), lambda k: k.isNotNull())
    return entries.withColumn("key_name", F.explode(keys))


def merged_lines(spans: DataFrame, max_extra: float = 1.5) -> DataFrame:
    """Broken rows of a page put together: (file, page, first_ord, kind, column, text).

    ``spans``: file, page, ord, kind, column, text, font_size, y1.  A data row continues the one before it in the same
    column if the step down is less than the font size of the row's first span plus ``max_extra``.  Pages are read in
    order, each in one task; other kinds of rows stand alone.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows: list[list] = []
        last = None
        for x in pdf.sort_values("ord").itertuples(index=False):
            joins = last is not None and last.kind == x.kind == "data" and last.column == x.column and abs(x.y1 - last.y1) < size + max_extra
            if joins:
                rows[-1][-1].append(x.text)
            else:
                rows.append([x.file, x.page, x.ord, x.kind, x.column, [x.text]])
                size = x.font_size
            last = x
        return pd.DataFrame([[*r[:5], " ".join(t for t in r[5] if t is not None)] for r in rows], columns=["file", "page", "first_ord", "kind", "column", "text"])

    cols = spans.select("file", "page", F.col("ord").cast("long").alias("ord"), "kind", F.col("column").cast("int").alias("column"), "text", F.col("font_size").cast("double").alias("font_size"), F.col("y1").cast("double").alias("y1"))
    kinds = dict(cols.dtypes)
    return cols.groupBy("file", "page").applyInPandas(run, f"file {kinds['file']}, page {kinds['page']}, first_ord bigint, kind string, column int, text string")


# Geometry of the scanned books.
COLUMN_BORDER, MAIN_HEADING, SUBHEADING = 298.0, 10.0, 8.0


def classified_spans(spans: DataFrame) -> DataFrame:
    """Spans of pages (file, page, ord, x0, y1, font_size, text) with kind (main, sub, data) and column (0 left, 1 right).

    Texts are trimmed, empty ones dropped.  The spans themselves come from any reader of the books.
    """
    size = F.col("font_size")
    kind = F.when(size >= MAIN_HEADING, "main").when(size >= SUBHEADING, "sub").otherwise("data")
    return spans.withColumn("text", F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).filter("text <> ''").withColumns({"kind": kind, "column": F.when(F.col("x0") < COLUMN_BORDER, 0).otherwise(1), "font_size": F.round(size, 2)})


def indented_lines(merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, ord, value): lines behind no, one or two tabs for headings, subheadings and data; (file, ord, page, column) of the data lines."""
    order = Window.partitionBy("file").orderBy("page", "first_ord")
    rows = merged.withColumn("ord", F.row_number().over(order).cast("long"))
    tabs = F.when(F.col("kind") == "main", "").when(F.col("kind") == "sub", "\t").otherwise("\t\t")
    side = F.when(F.col("column") == 0, "left").otherwise("right")
    return rows.select("file", "ord", F.concat(tabs, "text").alias("value")), rows.filter("kind = 'data'").select("file", "ord", "page", side.alias("column"))


def _cut(text: str, mark: str, skip: int | None = None) -> tuple[str, str]:
    """Text before the mark and after it (or ``skip`` letters behind its start); a mark that is not there counts as standing at -1."""
    at = text.find(mark)
    return text[:at], text[at + (len(mark) if skip is None else skip) :]


def _inside(text: str) -> tuple[str, str, str]:
    """Before, within and behind the first brackets."""
    before = _cut(text, "(")[0]
    return before, text[text.find("(") + 1 : text.find(")")], text[text.find(")") + 1 :]


_YEAR_FIRST = re.compile(r"(\d*)[. ]*(.*)", re.S)


def record_fields(line: str) -> list[str]:
    """Twelve fields of a record line but for place and municipality; lines off the pattern give what the cuts leave."""
    line = line.replace(",, rođen", ", rođen").replace(",) ", ") ")
    at = line.find(", rođen")
    line = " ".join((line[:at].replace(",", " ") + line[at:]).split())
    who, life = _cut(line, ", rođen")
    surname, father, name = _inside(who)
    born, rest = _YEAR_FIRST.match(re.sub("^[ao]", "", life).lstrip()).groups()
    nationality, rest = _cut(rest, ",")
    rest = rest.lstrip()
    fate, _ = _cut(rest, "19")
    died = rest[rest.find("19") : rest.find("19") + 4]
    circumstances, rest = _cut(_cut(rest, "19", 5)[1].lstrip(), ",")
    place, number, _ = _inside(rest.lstrip())
    return [x.strip() for x in (name, surname, father, born, nationality, died, place, fate, circumstances, number)]


_FIELDS = ["Name", "Surname", "FatherName", "BirthYear", "Nationality", "DeathYear", "DeathPlace", "Fate", "Circumstances", "IDNumber"]


def parsed_records(lines: DataFrame) -> DataFrame:
    """Person records of indented lines (file, ord, value): 0 tabs municipality, 1 tab place, 2 tabs record."""
    depth = F.length(F.regexp_extract("value", r"^\t*", 0))
    w = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("depth", depth).withColumns({
        "Municipality": F.last(F.when(F.col("depth") == 0, F.substring("value", len("Opština ") + 1, 1 << 20)), ignorenulls=True).over(w),
        "Place": F.last(F.when(F.col("depth") == 1, F.regexp_replace("value", r"^\s+|\s+$", "")), ignorenulls=True).over(w),
    }).filter("depth >= 2")

    @F.pandas_udf("array<string>")
    def fields(values: pd.Series) -> pd.Series:
        return values.map(lambda v: record_fields(v.strip("\r\n")))

    split = marked.withColumn("f", fields("value"))
    return split.select("file", "ord", *[F.col("f")[i].alias(f) for i, f in enumerate(_FIELDS)], "Place", "Municipality")


def with_locations(records: DataFrame, locations: DataFrame) -> DataFrame:
    """The n-th record of a file gets its n-th location (file, ord, page, column); missing ones stay null."""
    n = lambda df: df.withColumn("n__", F.row_number().over(Window.partitionBy("file").orderBy("ord")))
    return n(records).join(n(locations).drop("ord"), ["file", "n__"], "left").drop("n__")
