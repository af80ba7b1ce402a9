"""Report and threshold queries over the linkage results, and their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.wordlists import PLACE_CATEGORIES
from kinweave.operators import exports as X
from kinweave.operators import linkage as L
from kinweave.operators import reports as R
from kinweave.operators import thresholds as T
from kinweave.operators.keychunks import number_rows
from kinweave.plans import linkage as P
from kinweave.plans.registries import left_registry, right_registry
from kinweave.plans.runtime import cut
from kinweave.sources import registries as io

OPTIONS = L.Options(normalise=True, check_father=True, check_year=True, check_place=True, alternatives=True, max_year_gap=1)


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = left_registry(spark, sf_dir), right_registry(spark, sf_dir)
    return R.joined(L.link(left, right, OPTIONS), left, right)


def _report(spark: SparkSession, sf_dir: str, f) -> DataFrame:
    return f(_joined(spark, sf_dir))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name similarity of all pairs of a block that agree on place and nearly on the year."""
    o = L.Options(normalise=True, check_year=True, check_place=True, max_year_gap=1, method="nld", threshold=0.0, block_letters=2, keep_all=True)
    return L.link(left_registry(spark, sf_dir), right_registry(spark, sf_dir), o).select("score")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _threshold(spark: SparkSession, sf_dir: str, f) -> DataFrame:
    return _rounded(f(_scores(spark, sf_dir)))


def crossval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilistic against exact matches: overlap, recall and precision."""
    return _rounded(T.overlap(P.fs_match(spark, sf_dir), P.exact_link(spark, sf_dir), ["a_id"]))


def _numbered(df: DataFrame, key: str) -> DataFrame:
    """Adds ``row``: the row of a record in its sheet, below one line of headings, in the order of its key."""
    numbered = number_rows(df.withColumn("__all", F.lit(1)), ["__all"], [key])
    return numbered.withColumn("row", F.col("__no") + 1).drop("__all", "__no")


def match_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheet of matches with its links to the sheets of records, links joined by spaces."""
    left, right = _numbered(left_registry(spark, sf_dir), "a_id"), _numbered(right_registry(spark, sf_dir), "b_id")
    sheet = X.match_sheet(R.joined(L.link(left, right, OPTIONS), left, right))
    return sheet.select("death_place", "a_id", "b_id", "side", F.array_join("cells", "|").alias("cells"), F.array_join("links", " ").alias("links"))


def match_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lines per match with death data and source, sorted."""
    j = _joined(spark, sf_dir).withColumn("r_full_name", F.concat_ws(" ", "r_given", "r_surname"))
    return io.match_lines(j, ["l_full_name", "l_father", "l_byear", "l_place"], ["r_full_name", "r_father", "r_byear", "r_place"], source="l_source", death=(["l_dyear"], ["r_dyear", "r_dplace"]))


def report_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(R.full_report(_joined(spark, sf_dir)))


def report_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many exact matches need their name parts sorted."""
    left, right = left_registry(spark, sf_dir), right_registry(spark, sf_dir)
    o = L.Options(normalise=True, sort_parts=True, check_father=True, check_year=True, check_place=True)
    return R.sorted_only(R.joined(L.link(left, right, o), left, right))


GROUPS = {"Jasenovac (all variants)": PLACE_CATEGORIES[:2] + ["Jasenovac-logor"], "Stara Gradiška (all variants)": PLACE_CATEGORIES[2:9], "Other localities": PLACE_CATEGORIES[10:]}


def category_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Death places of the right registry, of the left one's turns, and of matches, in three groups of categories."""
    right = right_registry(spark, sf_dir)
    matched = _joined(spark, sf_dir).select(F.col("r_dplace").alias("dplace"))
    out = None
    for source, df in (("right", right.select("dplace")), ("matches", matched)):
        low, label = F.lower("dplace"), F.lit(None).cast("string")
        for c in reversed(PLACE_CATEGORIES):
            label = F.when(low.contains(c.lower()), c).otherwise(label)
        group = F.lit(None).cast("string")
        for g, members in GROUPS.items():
            group = F.when(label.isin(members), g).otherwise(group)
        part = df.groupBy(group.alias("category")).agg(F.count(F.lit(1)).alias("n")).filter("category is not null").select(F.lit(source).alias("source"), "category", "n")
        out = part if out is None else out.unionAll(part)
    return out


def method_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched left records for exact names and Levenshtein distances 1 to 3, at year tolerances 0 to 5; one pass over the pairs.

    A pair counts from the distance that its names and fathers need and from its year difference on.
    """
    o = L.Options(normalise=True, check_father=True, check_year=True, check_place=True, method="ld", threshold=3, block_letters=2, fuzzy_father=True)
    pairs_ = L.blocked(left_registry(spark, sf_dir), right_registry(spark, sf_dir), o)
    lf, rf = F.col("l.k_father"), F.col("r.k_father")
    father = F.when(lf == rf, 0).when((lf != "") & (rf != ""), F.levenshtein(lf, rf)).otherwise(99)
    least = pairs_.filter((F.col("l.spot") == F.col("r.spot")) & (father <= 3) & (F.abs(F.col("l.year") - F.col("r.year")) <= 5))
    least = least.groupBy(F.col("l.a_id"), F.greatest(F.col("score").cast("int"), father).alias("t")).agg(F.min(F.abs(F.col("l.year") - F.col("r.year"))).alias("d"))
    grid = least.select("a_id", F.explode(F.sequence("t", F.lit(3))).alias("distance"), "d").select("a_id", "distance", F.explode(F.sequence("d", F.lit(5))).alias("m")).distinct()
    return grid.groupBy("distance", "m").agg(F.count(F.lit(1)).alias("n"))


def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _threshold(spark, sf_dir, T.score_summary)


def score_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty equal bins, as a chart shows them."""
    return _threshold(spark, sf_dir, T.histogram)


def _scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = L.Options(normalise=True, check_year=True, check_place=True, max_year_gap=1, method="nld", threshold=0.0, block_letters=2, keep_all=True)
    return L.link(left_registry(spark, sf_dir), right_registry(spark, sf_dir), o).select("a_id", "b_id", "score")


def score_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten pairs nearest to a threshold of 0.8."""
    return _rounded(T.nearest(_scored_pairs(spark, sf_dir), 0.8, ["a_id", "b_id"]).select("a_id", "b_id", "score"))


def threshold_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each way of choosing a threshold: pairs kept, and how they stand to exact matches."""
    o = L.Options(normalise=True, check_year=True, check_place=True, max_year_gap=1, method="nld", threshold=0.0, block_letters=2, keep_all=True)
    scores, counts = L.pair_counts(left_registry(spark, sf_dir), right_registry(spark, sf_dir), o)
    ways = {"max_gap": T.max_gap, "otsu": T.otsu, "kde": T.kde_valley}
    thresholds = None
    for name, f in ways.items():
        row = f(scores).select(F.lit(name).alias("method"), "threshold")
        thresholds = row if thresholds is None else thresholds.unionAll(row)
    return _rounded(T.by_method_counted(counts, cut(thresholds)))


def queries() -> dict:
    reports = {
        "report_summary": R.summary, "report_2x2": R.two_by_two, "report_death_year": R.death_years, "report_empty": R.empty_fields, "year_diff_hist": R.year_differences,
        "report_freq_death_place": partial(R.frequencies, column="r_dplace"), "report_freq_circumstances": partial(R.frequencies, column="r_circumstances"), "field_disagree": R.disagreement,
    }
    out = {k: partial(_report, f=f) for k, f in reports.items()}
    out |= {k: partial(_threshold, f=f) for k, f in {"score_dist": T.distribution, "threshold_gap": T.max_gap, "threshold_otsu": T.otsu, "threshold_kde": T.kde_valley}.items()}
    out |= {"report_freq_in_camp": lambda spark, sf_dir: R.frequencies(R.in_camp(_joined(spark, sf_dir)), "r_dplace"), "report_distinct": lambda spark, sf_dir: R.distinct_values(_joined(spark, sf_dir), "r_dplace", "r_circumstances")}
    out |= {"report_frequent": lambda spark, sf_dir: _rounded(R.frequent(right_registry(spark, sf_dir), "place", 0.16, True)), "threshold_top_gaps": lambda spark, sf_dir: _threshold(spark, sf_dir, T.top_gaps)}
    more = (match_sheet, match_listing, report_full, report_sorted, category_groups, method_grid, score_summary, score_bins, score_nearest, threshold_methods)
    return out | {"crossval": crossval} | {f.__name__: f for f in more}


def oracle_sql() -> dict[str, str]:
    base = P.oracle_sql()["source_fallback"]
    cut_at = base.rindex(" select a_id, b_id, father_in_source")
    head, tail = base[:cut_at], base[cut_at:]
    m = f"{head}, m as ({tail}), j as (select m.*, a.full_name, a.father as lf, a.byear as ly, a.place as lp, a.dyear as ld, b.given, b.surname, b.father as rf, b.byear as ry, b.place as rp, b.dyear as rd, b.dplace, b.circumstances from m join rega a using (a_id) join regb b using (b_id))"
    e = m + ", e as (select *, lower(split_part(full_name,' ',1))=lower(given) as same_name, lower(trim(regexp_replace(full_name,'^\\S+\\s*','')))=lower(surname) as same_surname from j)"
    ci = lambda c: f"count(*) filter (where {c})"
    f, y, p = "(lf='')", "(ly='')", "(lp='')"
    fill = lambda c: f"replace(replace({c},'9999',''),'-','')<>''"
    block = lambda t: f"array_to_string(list_sort(list_transform(list_filter(string_split({t},' '),lambda w: w<>''),lambda w: substr(w,1,2))),'')"
    score = "case when greatest(length(l.n),length(r.n))=0 then 1.0 else 1-levenshtein(l.n,r.n)/greatest(length(l.n),length(r.n)) end"
    s = f"{P.WITH}{P.std_ctes()}{P.STD}, s as (select {score} as score from l join r on {block('l.n')}={block('r.n')} where abs(l.y-r.y)<=1 and l.p=r.p), c as (select round(score,2) as score2, count(*) as n from s group by 1)"
    diff = lambda name, a, b: f"select '{name}' as field, {a} as x, {b} as y from j"
    norm = lambda c: f"trim(strip_accents(regexp_replace(replace(trim(lower({c})),'*',''),'\\[.*?\\]','','g')))"
    six = " union all ".join((diff("name", norm("full_name"), norm("concat(given,' ',surname)")), diff("father", norm("lf"), norm("rf")), diff("birth_year", norm("ly"), norm("ry")), diff("birth_place", norm("lp"), norm("rp")), diff("death_year", norm("ld"), norm("rd"))))
    none = chr(39) * 2
    raw = f"{s}, raw as (select round(score,6) as score, count(*) as n from s group by 1)"
    gap = "g as (select score2, lead(score2) over (order by score2) as hi, sum(n) over (order by score2) as below, sum(n) over () as total from c), w as (select *, (hi-score2)*ln(1+least(below,total-below)) as weight from g where hi is not null), t_gap as (select (score2+hi)/2 as threshold, hi-score2 as gap, score2 as lower_score, hi as upper_score from w order by weight desc, score2 limit 1)"
    otsu = """o as (select g2.score2, g2.hi, g2.total, g2.ts, (select sum(n) from (select score, count(*) as n from s group by 1) x where x.score*100-1e-9<=round(g2.score2*100)) as k, (select sum(n*score) from (select score, count(*) as n from s group by 1) x where x.score*100-1e-9<=round(g2.score2*100)) as ks
      from (select score2, lead(score2) over (order by score2) as hi, (select count(*) from s) as total, (select sum(score) from s) as ts from c) g2 where hi is not null),
      ov as (select *, (k/total)*(1-k/total)*pow(ks/k-(ts-ks)/(total-k),2) as v from o where k>0 and k<total), t_otsu as (select (score2+hi)/2 as threshold, v as variance from ov order by v desc, score2 limit 1)"""
    kde = """st as (select sum(n) as total, sum(n*score)/sum(n) as mean from raw), h as (select st.total, 1.06*sqrt((select sum(n*pow(score-mean,2)) from raw, st)/st.total)*pow(st.total,-0.2) as h from st),
      mids as (select (score2+lead(score2) over (order by score2))/2 as mid from c), de as (select mid, sum(n*exp(-0.5*pow((mid-score)/h,2)))/(any_value(total)*any_value(h)*sqrt(2*pi())) as density from mids, raw, h where mid is not null group by mid),
      t_kde as (select mid as threshold, density from de order by density, mid limit 1)"""
    sp = s.replace("select " + score + " as score from l", "select a_id, b_id, " + score + " as score from l")
    spr = f"{sp}, raw as (select round(score,6) as score, count(*) as n from s group by 1)"
    low = lambda e: "case " + " ".join(f"when contains(lower({e}),'{x.lower()}') then '{g}'" for x in PLACE_CATEGORIES for g in [next(k for k, v in GROUPS.items() if x in v)]) + " end"
    blk = lambda t: f"array_to_string(list_sort(list_transform(list_filter(string_split({t},' '),lambda w: w<>''),lambda w: substr(w,1,2))),'')"
    father = "case when l.f=r.f then 0 when l.f<>'' and r.f<>'' then levenshtein(l.f,r.f) else 99 end"
    section = lambda name, item, n, base="t.total": f"select '{name}' as section, {item} as item, {n} as n, 100.0*{n}/{base} as pct from"
    flags = " union all ".join(f"{section('found in source', chr(39) + x + chr(39), ci(x + '_in_source'), 'count(*)')} j" for x in ("father", "year", "place"))
    exact = "case when same_name then 'exact' else 'adjusted' end||' / '||case when same_surname then 'exact' else 'adjusted' end"
    died = "case when try_cast(ld as int) is null or try_cast(rd as int) is null then 'missing' when rd::int<ld::int then 'earlier' when rd::int=ld::int then 'identical' else 'later' end"
    empty = {"father": ci(f), "father_filled_right": ci(f + " and " + fill("rf")), "only_father": ci(f"{f} and not {y} and not {p}"), "year": ci(y), "year_filled_right": ci(y + " and " + fill("ry")), "only_year": ci(f"{y} and not {f} and not {p}"), "place": ci(p), "place_filled_right": ci(p + " and " + fill("rp")), "only_place": ci(f"{p} and not {f} and not {y}"), "father_and_year": ci(f"{f} and {y}"), "father_and_place": ci(f"{f} and {p}"), "year_and_place": ci(f"{y} and {p}"), "all_three": ci(f"{f} and {y} and {p}")}
    parts = [f"{section('names', chr(39) + x + chr(39), n_, 'count(*)')} e" for x, n_ in (("matches", "count(*)"), ("same name", ci("same_name")), ("same surname", ci("same_surname")), ("same full name", ci("same_name and same_surname")))]
    parts += [flags] + [f"{section('empty fields', chr(39) + k + chr(39), v, 'count(*)')} j" for k, v in empty.items()]
    parts += [f"{section('distinct values', chr(39) + k + chr(39), f'count(distinct {v})', 'count(*)')} j" for k, v in (("death places", "dplace"), ("circumstances", "circumstances"))]
    parts += [f"{section(k, v, 'count(*)')} e, t group by all" for k, v in (("name and surname", exact), ("death year", died), ("death places", "dplace"), ("circumstances", "circumstances"))]
    parts = [x.replace("group by all", "group by 2, t.total") for x in parts]
    gapdiff = "abs(coalesce(try_cast('0'||ly as int),0)-coalesce(try_cast('0'||replace(ry,'9999','') as int),0))"
    parts.append(f"select 'year differences, of those found in the source', {gapdiff}::varchar, count(*), 100.0*count(*)/(select {ci('year_in_source')} from j) from j where year_in_source and ly<>'' and ry<>'9999' group by 2")
    parts.append("select 'death places in a camp, of those in a camp', dplace, count(*), 100.0*count(*)/(select count(*) from j where circumstances='u logoru') from j where circumstances='u logoru' group by 2")
    full = f"{e}, t as (select count(*) as total from j) select section, item, n, round(pct,6) as pct from ({' union all '.join(parts)}) order by section, item"
    Q2, Q3 = chr(39) * 2, chr(39)
    at = lambda sheet, letters, row: "||' '||".join(f"{Q3}{Q2}{sheet}{Q2}!{x}{Q3}||{row}" for x in letters)
    rows_l, rows_r = "(select a_id, row_number() over (order by a_id)+1 as l_row from rega)", "(select b_id, row_number() over (order by b_id)+1 as r_row from regb)"
    return {
        "report_summary": f"{e} select count(*) as n, {ci('same_name')} as n_same_name, {ci('same_surname')} as n_same_surname, {ci('same_name and same_surname')} as n_same_both, {ci('father_in_source')} as n_father_in_source, {ci('year_in_source')} as n_year_in_source, {ci('place_in_source')} as n_place_in_source from e",
        "report_2x2": f"{e} select same_name, same_surname, count(*) as n from e group by all",
        "report_death_year": f"{m} select case when try_cast(ld as int) is null or try_cast(rd as int) is null then 'missing' when rd::int<ld::int then 'earlier' when rd::int=ld::int then 'identical' else 'later' end as death_year, count(*) as n from j group by 1",
        "report_empty": f"{m} select {ci(f)} as father, {ci(f + ' and ' + fill('rf'))} as father_filled_right, {ci(f'{f} and not {y} and not {p}')} as only_father, {ci(y)} as year, {ci(y + ' and ' + fill('ry'))} as year_filled_right, {ci(f'{y} and not {f} and not {p}')} as only_year, {ci(p)} as place, {ci(p + ' and ' + fill('rp'))} as place_filled_right, {ci(f'{p} and not {f} and not {y}')} as only_place, {ci(f'{f} and {y}')} as father_and_year, {ci(f'{f} and {p}')} as father_and_place, {ci(f'{y} and {p}')} as year_and_place, {ci(f'{f} and {y} and {p}')} as all_three from j",
        "year_diff_hist": f"{m} select abs(coalesce(try_cast('0'||ly as int),0)-coalesce(try_cast('0'||replace(ry,'9999','') as int),0)) as diff, count(*) as n from j where year_in_source and ly<>'' and ry<>'9999' group by 1",
        "report_freq_death_place": f"{m} select dplace as value, count(*) as n from j group by 1",
        "report_freq_circumstances": f"{m} select circumstances as value, count(*) as n from j group by 1",
        "field_disagree": f"{m} select field, {ci(f'x<>{none} and y<>{none} and x<>y')} as n_differ, round(100.0*{ci(f'x<>{none} and y<>{none} and x<>y')}/count(*),6) as pct, {ci(f'x={none}')} as n_empty_left, {ci(f'y={none}')} as n_empty_right, count(*) as n_pairs from ({six}) group by field",
        "score_dist": f"{s} select score2, n, sum(n) over (order by score2 desc)::bigint as cum, round(sum(n) over (order by score2 desc)*100.0/sum(n) over (),6) as cum_pct from c",
        "threshold_gap": f"{s}, {gap} select round(threshold,6) as threshold, round(gap,6) as gap, lower_score, upper_score from t_gap",
        "threshold_otsu": f"{s}, {otsu} select round(threshold,6) as threshold, round(variance,6) as variance from t_otsu",
        "threshold_kde": f"{raw}, {kde} select round(threshold,6) as threshold, round(density,6) as density from t_kde",
        "threshold_top_gaps": f"{s} select score2 as lower_score, hi as upper_score, round(hi-score2,6) as gap from (select score2, lead(score2) over (order by score2) as hi from c) where hi is not null order by round(hi-score2,9) desc, score2 limit 10",
        "threshold_methods": f"""{spr}, {gap}, {otsu}, {kde}, th as (select 'max_gap' as method, threshold from t_gap union all select 'otsu', threshold from t_otsu union all select 'kde', threshold from t_kde),
          ex as (select distinct a_id, b_id from l join r on l.n=r.n where abs(l.y-r.y)<=1 and l.p=r.p), k as (select method, count(*) as n_kept, count(ex.a_id) as n_both from th join (select distinct a_id, b_id, score from s) x on x.score>=th.threshold left join ex on ex.a_id=x.a_id and ex.b_id=x.b_id group by method)
          select method, round(threshold,6) as threshold, n_kept, n_both, (select count(*) from ex) as n_exact, round(n_both/(select count(*) from ex),6) as recall, round(n_both/n_kept,6) as precision from th join k using (method)""",
        "score_summary": f"{s} select count(*) as n, round(min(score),6) as least, round(max(score),6) as greatest, round(avg(score),6) as mean from s",
        "score_bins": f"{s}, b as (select min(score) as lo, max(score) as hi from s) select bin, round(lo+(bin-1)*(hi-lo)/50,6) as low, count(*) as n from (select least(floor((score-lo)/((hi-lo)/50))::int+1,50) as bin, lo, hi from s, b) group by bin, lo, hi",
        "score_nearest": f"{sp} select a_id, b_id, round(score,6) as score from s order by round(abs(score-0.8),9), a_id, b_id limit 10",
        "crossval": f"{P._fs_sql()}, f as (select distinct a_id from ({P._FS_BEST})), t as (select distinct a_id from l join r on l.n=r.n where l.f=r.f and l.y=r.y and l.p=r.p), b as (select (select count(*) from f join t using (a_id)) as n_both, (select count(*) from f) as nf, (select count(*) from t) as nt) select n_both, nf-n_both as n_only_found, nt-n_both as n_only_truth, round(n_both/nt,6) as recall, round(n_both/nf,6) as precision from b",
        "report_freq_in_camp": f"{m} select dplace as value, count(*) as n from j where circumstances='u logoru' group by 1",
        "report_distinct": f"{m} select count(distinct dplace) as n_r_dplace, count(distinct circumstances) as n_r_circumstances from j",
        "report_frequent": f"{P.WITH}, c as (select place as value, count(*) as n, 100.0*count(*)/(select count(*) from regb) as pct from regb group by 1) select value, n, round(pct,6) as pct from (select *, row_number() over (order by pct<16, n desc, value) as k from c) where pct>=16 or k=1+(select count(*) from c where pct>=16)",
        "report_sorted": f"{P.WITH}{P.std_ctes()}{P.STD}, x as (select a_id, l.n as ln, r.n as rn, row_number() over (partition by a_id order by b_id) as k from l join r on array_to_string(list_sort(string_split(l.n,' ')),' ')=array_to_string(list_sort(string_split(r.n,' ')),' ') where l.f=r.f and l.y=r.y and l.p=r.p) select {ci('ln<>rn')} as n_sorted_only, count(*) as n from x where k=1",
        "report_full": full,
        "category_groups": f"{m} select source, category, count(*) as n from (select 'right' as source, {low('dplace')} as category from regb union all select 'matches', {low('dplace')} from j) where category is not null group by 1, 2",
        "method_grid": f"{P.WITH}{P.std_ctes()}{P.STD}, x as (select a_id, greatest(levenshtein(l.n,r.n),{father}) as t, abs(l.y-r.y) as d from l join r on {blk('l.n')}={blk('r.n')} where l.p=r.p), y as (select a_id, t, min(d) as d from x where t<=3 and d<=5 group by 1, 2), g as (select distinct a_id, distance, m from y join (select unnest(range(0,4)) as distance) on t<=distance join (select unnest(range(0,6)) as m) on d<=m) select distance, m, count(*) as n from g group by 1, 2",
        "match_listing": f"{m.replace('a.dyear as ld,', 'a.dyear as ld, a.source,')} select concat_ws('|',full_name,lf,ly,lp,ld,source)||chr(10)||chr(9)||concat_ws('|',given||' '||surname,rf,ry,rp,rd,dplace) as value from j order by 1",
        "match_sheet": f"""{m} select dplace as death_place, a_id, b_id, side, cells, links from (select j.*, l_row, r_row from j join {rows_l} using (a_id) join {rows_r} using (b_id)) z,
          lateral (select 0 as side, concat_ws('|',full_name,lf,ly,lp,ld) as cells, case when year_in_source then {at('Left', 'ABMCF', 'l_row')} else {at('Left', 'ABECF', 'l_row')} end as links
          union all select 1, concat_ws('|',given||' '||surname,rf,ry,rp,rd,circumstances,dplace), {at('Right', 'ACDEHKI', 'r_row')})""",
    }
