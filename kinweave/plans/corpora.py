"""Queries over pages, lexicon entries and certificates, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.wordlists import PLACE_CATEGORIES
from kinweave.operators import corpora as C
from kinweave.operators import extract as E
from kinweave.plans.registries import WITH, left_registry, right_registry
from kinweave.plans.runtime import table

PAGE_SQL = """concat('<html><p class="Normal"><span class="Bold">', upper(split_part(full_name,' ',2)), ', ', split_part(full_name,' ',1), '</span> (', place, ', 3. V. ', byear,
  ' – Mostar, 1. I. 19', cast(50+a_id%40 as varchar(4)), ') bio je sin ', lower(father), '. <i>Tekst</i> o njemu.<footer class="entry-footer">kraj 1999</footer></html>')"""
VARIED_SQL = """concat('<html><p class="Normal"><span class="Bold">', upper(split_part(full_name,' ',2)), ', ', split_part(full_name,' ',1), case when a_id%6=0 then concat(' (', split_part(full_name,' ',1), 'ko)') else '' end, '</span> (', place, ', 3. V. ', byear,
  case a_id%5 when 0 then '' when 1 then ' – Jasenovac, 1942' when 2 then ' – Stara Gradiška, 1944' when 3 then ' – Mostar, 1. I. 1961' else ' – Zenica, 1943' end, ') bio je sin ', lower(father), '. ',
  case when a_id%7=0 then 'Preživio je rat.' when a_id%7=1 then concat('Pisao je do ', cast(1946+a_id%9 as varchar(4)), '.') else 'Tekst.' end, '<footer class="entry-footer">kraj 1999</footer></html>')"""
SECOND_SQL = """concat('<html><div class="tekst"><span class="natuknica">', upper(split_part(full_name,' ',2)), ', ', split_part(full_name,' ',1), '</span>, liječnik (', place, ', 3. V. ', byear,
  case a_id%4 when 0 then ' &mdash; Mostar, 1. I. 1961' when 1 then ' – Jasenovac, 1942' when 2 then ' &ndash; Zenica, 1943' else ' - Tuzla, 1944' end, '). Tekst.</div></html>')"""
CERTIFICATE_SQL = {
    "name": "case when a_id%4=0 then split_part(full_name,' ',2) else split_part(full_name,' ',1) end", "surname": "case when a_id%4=0 then split_part(full_name,' ',1) else split_part(full_name,' ',2) end",
    "birth_year": "byear", "birth_place": "case a_id%3 when 0 then case when place='Zagreb' then 'Agram' when place='Beograd' then 'Belgrade' else place end when 1 then 'Split' else '' end",
    "residence": "case when a_id%3=1 then place when a_id%5=0 then 'Tuzla' else '' end",
}
LEXICON_FUZZY = C.EntryRules(check_place=True, max_year_gap=1, excluded_places=("jasenovac",), method="nld", threshold=0.85)
LINE_SQL = """concat('\t\t', surname, ' (', father, ') ', given, ', rođen ', byear, '. Gorjan, ubijen ', dyear, '. ', circumstances, ', ', dplace, ' (', cast(b_id as varchar(20)), ')')"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon page for every left record with a birth year and place."""
    return left_registry(spark, sf_dir).filter("byear <> '' and place <> ''").withColumn("html", F.expr(PAGE_SQL)).withColumn("entry_id", F.col("a_id"))


def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = E.lexicon_entries(_pages(spark, sf_dir).select("entry_id", "html"))
    return e.select("entry_id", "name", "birth_place", "birth_year", "death_place", "death_year")


def lexicon_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = E.entry_keys(E.lexicon_entries(_pages(spark, sf_dir).select("entry_id", "html")))
    return C.entry_matches(left_registry(spark, sf_dir), entries, C.FIRST_LEXICON)


def _varied_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with bracketed other names, several death places or none, and signs of survival."""
    left = left_registry(spark, sf_dir).filter("byear <> '' and place <> ''")
    return left.select(F.col("a_id").alias("entry_id"), F.expr(VARIED_SQL).alias("html"))


def lexicon_varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = E.entry_keys(E.lexicon_entries(_varied_pages(spark, sf_dir)))
    return C.entry_matches(left_registry(spark, sf_dir), entries, C.FIRST_LEXICON)


def lexicon_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best entry per record under near names in either word order, years one apart allowed."""
    entries = E.entry_keys(E.lexicon_entries(_pages(spark, sf_dir).select("entry_id", "html")))
    return C.entry_matches(left_registry(spark, sf_dir), entries, LEXICON_FUZZY)


def _second_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = left_registry(spark, sf_dir).filter("byear <> '' and place <> ''")
    return left.select(F.col("a_id").alias("entry_id"), F.expr(SECOND_SQL).alias("html"))


def second_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = E.second_entries(_second_pages(spark, sf_dir))
    return e.select("entry_id", "name", "birth_place", "birth_year", "death_place", "death_year")


def second_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = E.second_entries(_second_pages(spark, sf_dir)).withColumn("key_name", F.col("name"))
    return C.entry_matches(left_registry(spark, sf_dir), entries, C.SECOND_LEXICON)


def line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record lines written from the right registry and parsed again, with place and municipality lines between."""
    r = right_registry(spark, sf_dir)
    recs = r.select(F.col("place").alias("file"), (F.col("b_id") + 10).alias("ord"), F.expr(LINE_SQL).alias("value"))
    heads = r.select(F.col("place").alias("file")).distinct().select("file", F.explode(F.array(F.struct(F.lit(1).cast("long").alias("ord"), F.concat(F.lit("Opština "), F.col("file")).alias("value")), F.struct(F.lit(2).cast("long").alias("ord"), F.concat(F.lit("\t"), F.col("file")).alias("value")))).alias("x")).select("file", "x.*")
    p = E.parsed_records(recs.unionByName(heads))
    return p.drop("file", "ord").withColumn("IDNumber", F.col("IDNumber").try_cast("bigint"))


def _certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "match_entries").select(F.col("row_idx").alias("c_id"), "surname", "name", "birth_year", "birth_place", "residence").distinct()


def residence_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certificates written from the left registry: names turned, old town names, and the place as residence or in the source only."""
    left = left_registry(spark, sf_dir)
    certificates = left.select(F.col("a_id").alias("c_id"), *[F.expr(e).alias(n) for n, e in CERTIFICATE_SQL.items()])
    return C.certificates_in_left(left, certificates)


def reversed_key_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many right records each certificate matches, in either order of its name."""
    right = table(spark, sf_dir, "export_xlsx_partial").select(F.col("IDNumber").alias("b_id"), F.col("Name").alias("given"), F.col("Surname").alias("surname"), F.col("BirthYear").alias("byear"), F.col("Place").alias("place")).distinct()
    return C.certificates_in_right(_certificates(spark, sf_dir), right).groupBy("c_id").agg(F.count_distinct("b_id").alias("n"))


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("dplace")
    label = F.lit(None).cast("string")
    for c in reversed(PLACE_CATEGORIES):
        label = F.when(low.contains(c.lower()), c).otherwise(label)
    return right_registry(spark, sf_dir).groupBy(label.alias("category")).agg(F.count(F.lit(1)).alias("n")).filter("category is not null")


def birth_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("BirthYear").try_cast("int")
    return table(spark, sf_dir, "export_xlsx_partial").filter(y.between(1840, 1945)).groupBy(y.alias("year")).agg(F.count(F.lit(1)).alias("n"), F.first(y % 10).alias("last_digit"))


def alt_year_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of the birth year to the nearest other year in the source text, counted."""
    from kinweave.functions import names as N

    rows = left_registry(spark, sf_dir).select(N.bounded_year(F.col("byear")).alias("y"), N.years_in(F.col("source")).alias("ys")).filter("y is not null and size(ys) > 0")
    return rows.select(F.array_min(F.transform("ys", lambda x: F.abs(x - F.col("y")))).alias("diff")).groupBy("diff").agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict:
    return {f.__name__: f for f in (html_extract, lexicon_match, lexicon_varied, lexicon_fuzzy, second_extract, second_match, line_records, residence_match, reversed_key_match, category_counts, birth_hist, alt_year_diff)}


def oracle_sql() -> dict[str, str]:
    v = lambda e: f"replace(replace(replace(trim(lower({e})),'w','v'),'agram','zagreb'),'belgrade','beograd')"
    keys = "k as (select *, unnest(list_distinct([replace(lower(trim(concat_ws(' ',name,surname))),'-',''), replace(lower(trim(concat_ws(' ',surname,name))),'-','')])) as k0 from (select distinct row_idx as c_id, surname, name, birth_year, birth_place, residence from match_entries)), c as (select *, trim(k0) as k, trim(coalesce(birth_year,'')) as y, " + v("coalesce(birth_place,'')") + " as p, " + v("coalesce(residence,'')") + " as q from k)"
    cat = "case " + " ".join(f"when contains(lower(dplace),'{c.lower()}') then '{c}'" for c in PLACE_CATEGORIES) + " end"
    date = "rtrim(split_part(coalesce(\"Date of Birth:\",''),'[',1))"
    return {
        "html_extract": f"{WITH} select a_id as entry_id, concat(split_part(full_name,' ',1),' ',upper(split_part(full_name,' ',2))) as name, place as birth_place, byear as birth_year, 'Mostar' as death_place, concat('19',cast(50+a_id%40 as varchar)) as death_year from rega where byear<>'' and place<>''",
        "lexicon_match": f"""{WITH} select l.a_id, r.a_id as entry_id from rega l join rega r on lower(l.full_name)=lower(r.full_name) and l.byear=r.byear
          where r.byear<>'' and r.place<>'' and (l.place='' or l.place=r.place or contains(lower(l.source),lower(r.place)))
          and (l.father='' or case when length(l.father)-2>=3 then contains(lower(concat(upper(split_part(r.full_name,' ',2)),', ',split_part(r.full_name,' ',1),' (',r.place,', 3. V. ',r.byear,' – Mostar, 1. I. 19',cast(50+r.a_id%40 as varchar),') bio je sin ',lower(r.father),'. Tekst o njemu.')),concat(' ',substr(lower(l.father),1,length(l.father)-2)))
            else contains(concat(' bio je sin ',lower(r.father),'. '),concat(' sin ',substr(lower(l.father),1,greatest(length(l.father)-2,0)))) end)""",
        "line_records": f"{WITH} select given as \"Name\", surname as \"Surname\", father as \"FatherName\", byear as \"BirthYear\", place as \"Place\", place as \"Municipality\", 'Gorjan' as \"Nationality\", dyear as \"DeathYear\", dplace as \"DeathPlace\", 'ubijen' as \"Fate\", circumstances as \"Circumstances\", b_id as \"IDNumber\" from regb",
        "lexicon_varied": f"""{WITH}, k as (select *, lower(full_name) as k from rega union all select *, concat(lower(split_part(full_name,' ',1)),'ko ',lower(split_part(full_name,' ',2))) from rega where a_id%6=0 and lower(left(split_part(full_name,' ',1),1))<>lower(left(split_part(full_name,' ',2),1)))
          select l.a_id, r.a_id as entry_id from rega l join k r on lower(l.full_name)=r.k and l.byear=r.byear
          where r.byear<>'' and r.place<>'' and (l.place='' or l.place=r.place or contains(lower(l.source),lower(r.place))) and r.a_id%5 not in (1,2)
          and (r.a_id%5<>0 or r.a_id%7=0 or (r.a_id%7=1 and l.dyear<>'' and 1946+r.a_id%9>try_cast(l.dyear as int)))
          and (l.father='' or case when length(l.father)-2>=3 then contains(lower(concat(upper(split_part(r.full_name,' ',2)),', ',split_part(r.full_name,' ',1),case when r.a_id%6=0 then concat(' (',split_part(r.full_name,' ',1),'ko)') else '' end,' (',r.place,') bio je sin ',r.father,'.')),concat(' ',substr(lower(l.father),1,length(l.father)-2)))
            else contains(concat(' bio je sin ',lower(r.father),'. '),concat(' sin ',substr(lower(l.father),1,greatest(length(l.father)-2,0)))) end)""",
        "lexicon_fuzzy": f"""{WITH}, n as (select *, lower(full_name) as n, array_to_string(list_reverse(string_split(lower(full_name),' ')),' ') as t, array_to_string(list_sort(list_transform(string_split(lower(full_name),' '),lambda w: substr(w,1,2))),'') as b from rega),
          s as (select l.a_id, r.a_id as entry_id, greatest({', '.join(f'1-levenshtein({x},{y})/greatest(length({x}),length({y}))' for x, y in (('l.n', 'r.n'), ('l.n', 'r.t'), ('l.t', 'r.n')))}) as score from n l join n r on l.b=r.b
            where r.byear<>'' and r.place<>'' and not (l.place='' and l.byear='') and (l.place='' or l.place=r.place or contains(lower(l.source),lower(r.place))) and l.byear<>'' and abs(l.byear::int-r.byear::int)<=1)
          select a_id, entry_id from (select *, row_number() over (partition by a_id order by score desc, entry_id) as rn from s where score>=0.85) where rn=1""",
        "second_extract": f"{WITH} select a_id as entry_id, concat(split_part(full_name,' ',1),' ',upper(split_part(full_name,' ',2))) as name, place as birth_place, byear as birth_year, case a_id%4 when 0 then 'Mostar' when 1 then 'Jasenovac' when 2 then 'Zenica' else 'Tuzla' end as death_place, case a_id%4 when 0 then '1961' when 1 then '1942' when 2 then '1943' else '1944' end as death_year from rega where byear<>'' and place<>''",
        "second_match": f"""{WITH} select l.a_id, r.a_id as entry_id from rega l join rega r on lower(l.full_name)=lower(r.full_name) where r.byear<>'' and r.place<>'' and r.a_id%4<>1 and not (l.place='' and l.byear='')
          and (l.place='' or l.place=r.place or contains(lower(l.source),lower(r.place))) and (l.byear='' or l.byear=r.byear)""",
        "residence_match": f"""{WITH}, c0 as (select a_id as c_id, {', '.join(f'{e} as {n}' for n, e in CERTIFICATE_SQL.items())} from rega),
          c as (select distinct c_id, unnest([lower(concat(name,' ',surname)), lower(concat(surname,' ',name))]) as k, birth_year as y, {v('birth_place')} as p, {v('residence')} as q from c0), l as (select *, lower(full_name) as k, {v('place')} as p, {v('source')} as s from rega)
          select a_id, c_id from l join c on l.k=c.k where not (l.p='' and l.byear='') and (l.byear='' or l.byear=c.y) and (l.p='' or l.p=c.p or l.p=c.q or (c.p<>'' and (contains(l.s,c.p) or (c.q<>'' and contains(l.s,c.q)))))""",
        "reversed_key_match": f"""with {keys}, r as (select distinct IDNumber as b_id, replace(replace(lower(concat(coalesce(Name,''),' ',coalesce(Surname,''))),'9999',''),'-','') as k, trim(replace(coalesce(BirthYear,''),'9999','')) as y, {v("coalesce(Place,'')")} as p from export_xlsx_partial)
          select c_id, count(distinct b_id) as n from c join r on c.k=r.k where (c.p='' or r.p='' or c.p=r.p or c.q=r.p) and (c.y='' or r.y='' or c.y=r.y) group by c_id""",
        "category_counts": f"{WITH} select {cat} as category, count(*) as n from regb group by 1 having {cat} is not null",
        "birth_hist": "select try_cast(BirthYear as int) as year, count(*) as n, try_cast(BirthYear as int)%10 as last_digit from export_xlsx_partial where try_cast(BirthYear as int) between 1840 and 1945 group by 1, 3",
        "alt_year_diff": f"{WITH} select abs(try_cast(byear as int)-try_cast(regexp_extract(source,'\\d{{4}}') as int)) as diff, count(*) as n from rega where byear<>'' and try_cast(byear as int) between 1800 and 1945 group by 1",
    }
