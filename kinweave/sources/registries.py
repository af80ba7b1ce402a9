"""Readers and writers of registry files, match listings and model texts."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEFT_FIELDS = ["name_and_surname", "Sex:", "Father Name:", "Notes:", "Date of Birth:", "Place of Birth:", "Nationality/Ethnicity:", "Killed:", "Year of Death:", "Death Place:", "Camp:", "Source:"]
RIGHT_FIELDS = ["Name", "Surname", "FatherName", "BirthYear", "Place", "Municipality", "Nationality", "DeathYear", "DeathPlace", "Fate", "Circumstances", "IDNumber", "File", "Page", "Column"]
CERTIFICATE_FIELDS = ["surname", "name", "birth_date", "death_date", "birth_place", "residence", "religion"]


def _quoted(fields: list[str]) -> str:
    return ", ".join(f"`{f}` string" for f in fields)


def read_left(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of objects, one per file; missing keys are empty strings.

    Titles that are not among LEFT_FIELDS are kept in the map ``other``.
    """
    known = F.array(*[F.lit(f) for f in LEFT_FIELDS])
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<map<string,string>>")).alias("m"))
    return raw.select(*[F.coalesce(F.try_element_at("m", F.lit(f)), F.lit("")).alias(f) for f in LEFT_FIELDS], F.map_filter("m", lambda k, _: ~F.array_contains(known, k)).alias("other"))


def write_left(df: DataFrame, path: str) -> None:
    """One JSON array per partition, as ``read_left`` reads them; nothing is gathered in one task."""
    cols = [f for f in LEFT_FIELDS if f in df.columns]

    def arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"value": (["["] if first else []) + [("" if first and k == 0 else ",") + v for k, v in enumerate(pdf["value"])]})
                first = False
        yield pd.DataFrame({"value": ["[]" if first else "]"]})

    rows = df.select(F.to_json(F.struct(*[F.coalesce(F.col(f"`{f}`"), F.lit("")).alias(f) for f in cols])).alias("value"))
    rows.mapInPandas(arrays, "value string").write.text(path)


def read_right(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated lines of exactly 15 fields, with their order ``ord`` by all fields; another number is an error."""
    parts = F.split(F.regexp_replace("value", r"[\r\n]+$", ""), "\t", -1)
    lines = spark.read.text(path).select(parts.alias("p"))
    wrong = F.raise_error(F.concat(F.lit("a line has not 15 fields: "), F.size("p").cast("string")))
    lines = lines.select(F.when(F.size("p") == len(RIGHT_FIELDS), F.col("p")).otherwise(wrong.cast("array<string>")).alias("p"))
    return lines.select(*[F.get("p", F.lit(i)).alias(f) for i, f in enumerate(RIGHT_FIELDS)])


def ordered(df: DataFrame, fields: list[str] = RIGHT_FIELDS) -> DataFrame:
    """Adds ``ord`` by code points of all fields, numbered without a single-task window."""
    from kinweave.operators.keychunks import number_rows

    return number_rows(df.withColumn("__all", F.lit(1)), ["__all"], fields).withColumnRenamed("__no", "ord").drop("__all")


def write_right(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws("\t", *[F.coalesce(F.col(f), F.lit("")) for f in RIGHT_FIELDS])).write.text(path)


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _sheet_rows(data: bytes) -> Iterator[list[str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        first = min((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        for _, row in ElementTree.iterparse(io.BytesIO(z.read(first))):
            if row.tag != f"{_NS}row":
                continue
            cells: dict[int, str] = {}
            for k, c in enumerate(row.iter(f"{_NS}c")):
                letters = re.sub(r"\d", "", c.get("r", ""))
                at = k
                if letters:
                    at = 0
                    for ch in letters:
                        at = at * 26 + ord(ch) - 64
                    at -= 1
                v = c.find(f"{_NS}v")
                text = "".join(t.text or "" for t in c.iter(f"{_NS}t")) if v is None else v.text or ""
                cells[at] = shared[int(text)] if c.get("t") == "s" and text else text
            yield [cells.get(i, "").strip() for i in range(max(cells, default=-1) + 1)]
            row.clear()


def read_certificates(spark: SparkSession, path: str) -> DataFrame:
    """First sheet of each workbook from its second row: seven columns and what follows from them; files in parallel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                rows = list(_sheet_rows(data))[1:]
                out = pd.DataFrame([(r + [""] * 7)[:7] for r in rows], columns=CERTIFICATE_FIELDS)
                yield out.assign(file=name, row_idx=range(2, len(out) + 2))

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    df = files.mapInPandas(run, f"{_quoted(CERTIFICATE_FIELDS)}, file string, row_idx bigint")
    year = lambda c: F.when(F.length(c) >= 4, F.substring(c, 1, 4)).otherwise("")
    return df.withColumns({"name_and_surname": F.trim(F.concat_ws(" ", "name", "surname")), "birth_year": year("birth_date"), "death_year": year("death_date")})


def read_pages(spark: SparkSession, folder: str, pattern: str = "*.html") -> DataFrame:
    """(entry_id, html): one row per file, the id from its name (as a number where it is one)."""
    df = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern).select(F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.html)?$", 1).alias("entry_id"), F.col("value").alias("html"))
    return df.withColumn("entry_no", F.col("entry_id").try_cast("bigint"))


def numbered_links(pages: DataFrame, pattern: str) -> DataFrame:
    """(number): the distinct numbers that the pattern's group captures in the pages, in order."""
    return pages.select(F.explode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("n")).select(F.col("n").try_cast("bigint").alias("number")).filter("number is not null").distinct().orderBy("number")


def read_person_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of registry pages as one row each: entry_no, name, fields (title to content), in the order of the numbers."""
    from kinweave.operators.extract import page_fields

    return page_fields(read_pages(spark, folder, "*")).select("entry_no", "name", "fields").orderBy("entry_no")


def read_lines(spark: SparkSession, path: str, fields: list[str], least: int, exact: bool = False) -> DataFrame:
    """Tab-separated lines with at least (or exactly) ``least`` fields, the first ones named; other lines are left out.

    The tolerant readers of the reports: death places need 9 fields, persons 12.
    """
    p = F.split(F.regexp_replace("value", r"[\r\n]+$", ""), "\t", -1)
    fit = F.size("p") == least if exact else F.size("p") >= least
    return spark.read.text(path).select(p.alias("p")).filter(fit).select(*[F.get("p", F.lit(i)).alias(f) for i, f in enumerate(fields)])


def read_death_places(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, RIGHT_FIELDS[:9], 9).select("DeathPlace")


def read_persons(spark: SparkSession, path: str, exact: bool = False) -> DataFrame:
    return read_lines(spark, path, RIGHT_FIELDS[:12], 12, exact)


def links_of(pages: DataFrame, css_class: str) -> DataFrame:
    """Distinct link targets of anchors of a class."""
    return pages.select(F.explode(F.regexp_extract_all("html", F.lit(rf'<a(?=[^>]*class="{css_class}")[^>]*href="([^"]*)"'), F.lit(1))).alias("href")).distinct()


def match_lines(pairs: DataFrame, left: list[str], right: list[str], separator: str = "|", score: str | None = None, source: str | None = None, death: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """Two lines per pair (left, then right behind a tab) as one text value, sorted by both lines.

    ``death``: further left and right columns; ``source``: a column of the left record's source text; ``score``: a column
    that ends the left line with two decimals.
    """
    more = death or ([], [])
    last = [F.format_string("%.2f", F.col(score).cast("double"))] if score else []
    l = F.concat_ws(separator, *[F.coalesce(F.col(c), F.lit("")) for c in [*left, *more[0], *([source] if source else [])]], *last)
    r = F.concat(F.lit("\t"), F.concat_ws(separator, *[F.coalesce(F.col(c), F.lit("")) for c in [*right, *more[1]]]))
    return pairs.select(F.concat(l, F.lit("\n"), r).alias("value")).orderBy("value")


def read_match_lines(spark: SparkSession, path: str) -> DataFrame:
    """Fields of left lines (six at least, a seventh may be the score) and of the right line that follows with a tab.

    Lines are paired within their file; fields are trimmed.
    """
    lines = spark.read.text(path, wholetext=True).select(F.split("value", "\r?\n").alias("ls"))
    # a line and the one behind it, from the same file
    both = lines.select(F.explode(F.arrays_zip(F.col("ls").alias("value"), F.concat(F.slice("ls", F.lit(2), F.size("ls")), F.array(F.lit(""))).alias("next"))).alias("x")).select("x.*").filter(~F.col("value").startswith("\t"))
    fields = lambda c: F.transform(F.split(c, r"\|"), lambda x: F.trim(x))
    f = fields("value")
    return both.filter(F.size(f) >= 6).select(f.alias("left_fields"), F.when(F.col("next").startswith("\t"), fields(F.ltrim(F.regexp_replace("next", "\t", "")))).alias("right_fields"), F.when(F.size(f) >= 7, F.element_at(f, -1).try_cast("double")).alias("score"))


def match_count(spark: SparkSession, path: str) -> int | None:
    """Pairs in a listing of two lines each; None if there is no such file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.text(path).count() // 2


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """The last field of lines that do not begin with a tab, where it is a number."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("\t"))
    return lines.select(F.element_at(F.split("value", r"\|"), -1).try_cast("double").alias("score")).filter("score is not null")


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """Review lines behind a header: nine fields and a numeric score first; others are dropped."""
    f = F.split("value", "\t")
    return spark.read.text(path).filter(F.size(f) >= 9).select(F.get(f, F.lit(0)).try_cast("double").alias("score"), F.slice(f, 2, 8).alias("fields")).filter("score is not null")


def write_review(pairs: DataFrame, fields: list[str], path: str) -> None:
    """A header line, then the highest score first, two decimals; nothing is written for no pairs."""
    if not pairs.isEmpty():
        s2 = F.round("score", 2)
        lines = pairs.select(F.lit(1).alias("part"), s2.alias("s2"), F.concat_ws("\t", F.format_string("%.2f", "score"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]).alias("value"))
        head = pairs.sparkSession.createDataFrame([(0, None, "\t".join(["score", *fields]))], lines.schema)
        head.unionAll(lines).orderBy("part", F.desc("s2"), "value").select("value").write.text(path)


def read_estimates(spark: SparkSession, path: str) -> DataFrame:
    """(field, level, m, u) of lines like ``name level 2/3: m=0.9, u=0.1``; other lines are ignored."""
    rx = r"^(\w+)\s+level\s+(\d+)/(\d+):\s+m=([\d.]+),\s+u=([\d.]+)"
    part = lambda i: F.regexp_extract(F.trim("value"), rx, i)
    return spark.read.text(path).filter(F.trim("value").rlike(rx)).select(part(1).alias("field"), part(2).cast("int").alias("level"), part(4).cast("double").alias("m"), part(5).cast("double").alias("u"))
