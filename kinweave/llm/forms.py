"""Queries of problem 4: values that have to change to reach the consistent form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.text_forms import LOOKALIKES, consistent_forms, maybe_unstable
from kinweave.plans.runtime import table


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "export_xlsx").select(F.lit("export_xlsx").alias("source_table"), F.col("row_id").alias("record_key"), F.col("name_and_surname").alias("value"))
    b = table(spark, sf_dir, "export_xlsx_partial").select(F.lit("export_xlsx_partial"), F.expr("try_cast(trim(IDNumber) as bigint)"), F.col("Surname"))
    c = table(spark, sf_dir, "match_entries").select(F.lit("match_entries"), F.col("row_idx"), F.col("birth_place"))
    return a.unionAll(b).unionAll(c)


def changed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record whose value changes, with its new form; values written in Cyrillic throughout are left out."""
    odd = _values(spark, sf_dir).filter(maybe_unstable(F.col("value"))).distinct()
    forms = consistent_forms(odd, "value").filter("not cyrillic").select("value", "form")
    return odd.join(forms, "value").select("source_table", "record_key", "value", "form")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed_values(spark, sf_dir).select("source_table", "record_key").distinct()


def queries() -> dict:
    return {"p4_found": found, "p4_changed_values": changed_values}


def oracle_sql() -> dict[str, str]:
    """Full-width letters, spaces, invisible characters and look-alikes mapped, then composed."""
    wide = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F) if c != 0xFF07} | {"\u3000": " ", "\u00a0": " ", "\u2009": " ", "\u202f": " ", "\u2007": " ", "\u2002": " ", "\u2003": " "} | LOOKALIKES
    mapped = f"translate(regexp_replace(value,'[\\p{{Cf}}\\x{{34f}}\\x{{fe00}}-\\x{{fe0f}}]','','g'),'{''.join(wide)}','{''.join(wide.values())}')"
    for k, v in {"ǆ": "dž", "ǉ": "lj", "ǌ": "nj", "ǅ": "Dž", "ǈ": "Lj", "ǋ": "Nj", "Ǆ": "DŽ", "Ǉ": "LJ", "Ǌ": "NJ", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}.items():
        mapped = f"replace({mapped},'{k}','{v}')"
    values = "select 'export_xlsx' as source_table, row_id as record_key, name_and_surname as value from export_xlsx union all select 'export_xlsx_partial', try_cast(trim(IDNumber) as bigint), Surname from export_xlsx_partial union all select 'match_entries', row_idx, birth_place from match_entries"
    cyrillic = "(regexp_matches(value,'\\p{Cyrillic}') and not regexp_matches(regexp_replace(value,'\\p{Cyrillic}','','g'),'\\p{L}'))"
    found_ = f"with v as (select distinct * from ({values}) where value is not null), f as (select *, nfc_normalize({mapped}) as form from v where not {cyrillic})"
    return {"p4_found": f"{found_} select distinct source_table, record_key from f where form<>value", "p4_changed_values": f"{found_} select source_table, record_key, value, form from f where form<>value"}
