"""Queries of problem 9: personal data in documents.text, found and replaced by typed placeholders."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.redact import found_spans
from kinweave.plans.runtime import cut, table

#: Author entries that must begin with a word before it counts as a given name.
MIN_AUTHORS = 2
_SPANS = "doc_id long, pii_type string, start_char int, end_char int, given string, shape string"


def known_given_names(documents: DataFrame) -> DataFrame:
    """(given): words that author fields of the documents begin names with more often than they end them.

    Counted over all documents; lower case.
    """
    fields = documents.select(F.explode(F.regexp_extract_all("text", F.lit(r"\\author(?:\[[^\]]*\])?\{([^}]*)\}"), F.lit(1))).alias("f"))
    names = fields.select(F.explode(F.split("f", r"\\and\b|,| and |\\\\")).alias("n")).select(F.split(F.trim(F.regexp_replace("n", "~", " ")), r"\s+").alias("ws")).filter("size(ws) > 1")
    ends = names.select(F.explode(F.array(F.struct(F.lower(F.get("ws", F.lit(0))).alias("given"), F.lit(1).alias("k")), F.struct(F.lower(F.element_at("ws", -1)).alias("given"), F.lit(-1).alias("k")))).alias("x"))
    counts = ends.select("x.*").groupBy("given").agg(F.sum("k").alias("n"))
    return counts.filter((F.col("n") >= MIN_AUTHORS) & F.col("given").rlike(r"^\p{L}{2,}(?:-\p{L}+)?$")).select("given")


def _spans(documents: DataFrame) -> DataFrame:
    """Everything the detectors find, names still unchecked; one pass over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                source = text.as_py()
                if source:
                    key = doc.as_py()
                    rows += [(key, *span) for span in found_spans(source)]
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in _SPANS.split(", ")])

    return documents.select("doc_id", "text").mapInArrow(run, _SPANS)


def _free_of_overlap(spans: DataFrame) -> DataFrame:
    """Of overlapping names of a document the one that begins first stays."""
    item = F.struct("start_char", "end_char", "pii_type")
    lists = spans.groupBy("doc_id").agg(F.array_sort(F.collect_set(item)).alias("xs"))
    zero = F.struct(F.lit(-1).alias("end"), F.array().cast("array<struct<start_char:int,end_char:int,pii_type:string>>").alias("ys"))

    def step(acc: Column, x: Column) -> Column:
        return F.when(x["start_char"] >= acc["end"], F.struct(x["end_char"].alias("end"), F.concat(acc["ys"], F.array(x)).alias("ys"))).otherwise(acc)

    return lists.select("doc_id", F.explode(F.aggregate("xs", zero, step, lambda a: a["ys"])).alias("x")).select("doc_id", "x.*")


def occurrences(documents: DataFrame) -> DataFrame:
    """(doc_id, pii_type, start_char, end_char) of every occurrence, in characters from 0, end exclusive.

    Null and empty texts hold nothing.  A name needs a given name that author fields of the corpus know, or initials
    with a family name.  A document given twice is reported once.
    """
    spans = cut(_spans(documents))
    names = spans.filter("pii_type = 'name'")
    known = known_given_names(documents)
    sure = names.filter("given <> ''").withColumn("g", F.lower("given")).join(known, F.col("g") == known.given, "left_semi").drop("g")
    initials = names.filter("given = ''")
    kept = sure.unionByName(initials).select("doc_id", "pii_type", "start_char", "end_char")
    rest = spans.filter("pii_type <> 'name'").select("doc_id", "pii_type", "start_char", "end_char").distinct()
    return _free_of_overlap(kept).select("doc_id", "pii_type", "start_char", "end_char").unionByName(rest)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return occurrences(docs).select("doc_id", "pii_type", F.col("start_char").cast("long").alias("start_char"))


def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text with a placeholder such as [EMAIL] for each occurrence; texts without any come out as they are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lists = occurrences(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char", "pii_type"))).alias("xs"))
    both = docs.join(lists, "doc_id", "left")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, F.greatest(F.lit(0), x["start_char"] - acc["at"]))
        put = F.struct(x["end_char"].alias("at"), F.concat(acc["out"], gap, F.lit("["), F.upper(x["pii_type"]), F.lit("]")).alias("out"))
        return F.when(x["start_char"] >= acc["at"], put).otherwise(acc)

    text = F.aggregate("xs", zero, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    return both.select("doc_id", F.when(F.col("xs").isNull(), F.col("text")).otherwise(text).alias("text"), F.coalesce(F.size("xs"), F.lit(0)).alias("n_replaced"))


def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of what must hold: every text comes out, occurrences lie inside their texts, and texts without any stay as they are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = occurrences(docs).groupBy("doc_id").agg(F.max("end_char").alias("last"), F.count_if((F.col("start_char") < 0) | (F.col("end_char") <= F.col("start_char"))).alias("bad"))
    out = redacted(spark, sf_dir).select("doc_id", F.col("text").alias("new"), "n_replaced")
    both = out.join(docs, "doc_id").join(spans, "doc_id", "left")
    outside = (F.col("bad") > 0) | (F.col("last") > F.length("text"))
    return both.agg(F.count(F.lit(1)).alias("n_texts"), F.count_if(outside).alias("n_outside"), F.count_if((F.col("n_replaced") == 0) & ~F.col("new").eqNullSafe(F.col("text"))).alias("n_changed_in_vain"), F.count_if((F.col("n_replaced") > 0) & F.col("new").eqNullSafe(F.col("text"))).alias("n_left"))


def queries() -> dict:
    return {"p9_found": found, "p9_redacted": redacted, "p9_limits": limits}


def oracle_sql() -> dict[str, str]:
    return {"p9_limits": "select count(*) as n_texts, 0::bigint as n_outside, 0::bigint as n_changed_in_vain, 0::bigint as n_left from documents"}
