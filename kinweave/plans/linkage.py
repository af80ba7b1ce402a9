"""Linkage queries over the derived registries and their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import names as N
from kinweave.functions.wordlists import LEFT_OUT_PLACES, LETTER_PAIRS, SPELLING_PAIRS
from kinweave.operators import fellegi_sunter as FS
from kinweave.operators import linkage as L
from kinweave.plans.runtime import cut
from kinweave.plans.registries import WITH, left_registry, right_registry

FULL = L.Options(normalise=True, check_father=True, check_year=True, check_place=True)


def _link(spark: SparkSession, sf_dir: str, o: L.Options, filtered: bool = False) -> DataFrame:
    right = right_registry(spark, sf_dir)
    if filtered:
        right = L.without_left_out_places(right)
    return L.link(left_registry(spark, sf_dir), right, o)


def _exact(spark: SparkSession, sf_dir: str, o: L.Options, filtered: bool = False) -> DataFrame:
    return _link(spark, sf_dir, o, filtered).select("a_id", "b_id", *L.FLAGS)


def exact_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact(spark, sf_dir, FULL)


def std_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling of both registries with its cleaned common spelling."""
    a = left_registry(spark, sf_dir).select(F.col("full_name").alias("raw"))
    b = right_registry(spark, sf_dir).select(F.concat_ws(" ", "given", "surname").alias("raw"))
    names = a.unionAll(b).distinct()
    return N.prepared(names, "raw").select("raw", N.right_clean(N.left_clean(F.col("raw_std"))).alias("std"))


def sorted_initials(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = left_registry(spark, sf_dir).select(F.lower("full_name").alias("name")).distinct()
    c = F.col("name")
    return a.select("name", N.sorted_initials(c, 1).alias("i1"), N.sorted_initials(c, 2).alias("i2"), N.sorted_initials(c, 3).alias("i3"), N.sorted_parts(c).alias("parts"), N.reversed_words(c).alias("turned"))


def block_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.without_left_out_places(right_registry(spark, sf_dir)).groupBy("dplace").agg(F.count(F.lit(1)).alias("n"))


def exact_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of matches for each year tolerance from 0 to 5."""
    left, right = left_registry(spark, sf_dir), right_registry(spark, sf_dir)
    pairs_ = L.blocked(left, right, FULL)
    c = L.checks(FULL)
    off = F.abs(F.col("l.year") - F.col("r.year"))
    least = pairs_.filter(c["father_ok"] & c["place_ok"]).groupBy(F.col("l.a_id")).agg(F.min(off).alias("d"))
    # one pass: a record matches at every tolerance from its smallest difference on
    grid = least.filter("d <= 5").select(F.explode(F.sequence(F.col("d"), F.lit(5))).alias("m"))
    return grid.groupBy("m").agg(F.count(F.lit(1)).alias("n"))


def match_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches gained by each step of tolerance."""
    from pyspark.sql import Window

    s = exact_sweep(spark, sf_dir)
    w = Window.orderBy("m")
    return s.select("m", "n", F.when(F.lag("m").over(w) == F.col("m") - 1, F.col("n") - F.lag("n").over(w)).alias("gained"))


FUZZY = {
    "fuzzy_ld": L.Options(normalise=True, check_year=True, check_place=True, max_year_gap=1, method="ld", threshold=2, block_letters=2),
    "fuzzy_nld": L.Options(normalise=True, check_year=True, check_place=True, max_year_gap=1, method="nld", threshold=0.85, block_letters=2),
    "fuzzy_jw": L.Options(normalise=True, check_year=True, check_place=True, max_year_gap=1, method="jwd", block_letters=2),
    "fuzzy_dld": L.Options(normalise=True, check_year=True, check_place=True, max_year_gap=1, method="dld", threshold=2, block_letters=2, fuzzy_father=True, check_father=True),
}


def _fuzzy(spark: SparkSession, sf_dir: str, o: L.Options) -> DataFrame:
    return _link(spark, sf_dir, o).select("a_id", "b_id", F.round("score", 6).alias("score"))


FS_OPTIONS = L.Options(normalise=True, method="nld", threshold=0.0, block_letters=1, check_father=True, check_year=True, check_place=True, fuzzy_father=True, max_year_gap=0)


def _fs_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern counts of all pairs that share the first letters of their names, written once."""
    return cut(L.pattern_counts(left_registry(spark, sf_dir), right_registry(spark, sf_dir), FS_OPTIONS))


def fs_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fs_patterns(spark, sf_dir)


def fs_mu(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = FS.fit(_fs_patterns(spark, sf_dir), FS_OPTIONS)
    return m.select("field", "level", F.round("m", 6).alias("m"), F.round("u", 6).alias("u"))


def fs_pattern_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lv_name, lv_father, lv_year, lv_place, n, fs: the score of every pattern."""
    patterns = _fs_patterns(spark, sf_dir)
    return FS.scored(patterns, FS.fit(patterns, FS_OPTIONS))


def _rounded_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fs_pattern_scores(spark, sf_dir).withColumn("fs", F.round("fs", 6))


def _fs_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns are scored, not pairs; rows are paired only for names whose level stands in a winning pattern."""
    cols = [f"lv_{f}" for f in FS.FIELDS]
    won = fs_pattern_scores(spark, sf_dir).filter(F.col("fs") >= FS.UPPER).select(*cols, "fs").collect()  # at most one row per pattern
    left, right = left_registry(spark, sf_dir), right_registry(spark, sf_dir)
    pairs_ = L.compared(left, right, FS_OPTIONS, sorted({r["lv_name"] for r in won}))
    sure = spark.createDataFrame(won, "lv_name int, lv_father int, lv_year int, lv_place int, fs double")
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"w.{c}")) for c in cols]
    return FS.matches(pairs_.alias("p").join(F.broadcast(sure).alias("w"), same).select("a_id", "b_id", "fs"))


def fs_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fs_matches(spark, sf_dir).select("a_id", "b_id", F.round("score", 4).alias("score"))


def fs_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of pairs to review at each score, from pattern counts alone."""
    s = fs_pattern_scores(spark, sf_dir).filter((F.col("fs") >= FS.LOWER) & (F.col("fs") < FS.UPPER))
    return s.groupBy(F.round("fs", 4).alias("score")).agg(F.sum("n").alias("n"))


def queries() -> dict:
    one = {
        "exact_link": FULL,
        "exact_link_plain": L.Options(check_father=True, check_year=True, check_place=True),
        "exact_link_keys": L.Options(normalise=True, key_father=True, key_year=True, key_place=True),
        "exact_link_all": L.Options(normalise=True, check_father=True, check_year=True, check_place=True, keep_all=True),
        "exact_link_sorted": L.Options(normalise=True, sort_parts=True, check_father=True, check_year=True, check_place=True),
        "exact_link_m2": L.Options(normalise=True, check_father=True, check_year=True, check_place=True, max_year_gap=2),
        "source_fallback": L.Options(normalise=True, check_father=True, check_year=True, check_place=True, alternatives=True, max_year_gap=1),
        "empty_relaxed": L.Options(normalise=True, key_father=True, key_year=True, key_place=True, check_year=True, check_place=True, empties=True),
    }
    out: dict = {k: partial(_exact, o=o) for k, o in one.items()}
    out["exact_link_filtered"] = partial(_exact, o=FULL, filtered=True)
    out |= {k: partial(_fuzzy, o=o) for k, o in FUZZY.items()}
    out |= {"std_names": std_names, "sorted_initials": sorted_initials, "block_filter": block_filter, "exact_sweep": exact_sweep, "match_growth": match_growth}
    out |= {"fs_patterns": fs_patterns, "fs_pattern_scores": _rounded_scores, "fs_mu": fs_mu, "fs_match": fs_match, "fs_review": fs_review}
    return out


# ---- SQL ----------------------------------------------------------------------------------------------------------


def _std(e: str) -> str:
    """The common spelling in SQL: nested replaces, then repeated letters collapsed by a list filter."""
    for a, b in [*zip("čćđšžäöü", "ccdszaou", strict=True), ("ß", "ss")]:
        e = f"replace({e},'{a}','{b}')"
    for a, b in SPELLING_PAIRS + LETTER_PAIRS:
        e = f"replace({e},'{a}','{b}')"
    return e


def _collapse(col: str) -> str:
    return f"array_to_string(list_filter(string_split({col},''),lambda c, i: i=1 or c<>substr({col},(i-1)::int,1) or not regexp_matches(c,'\\w')),'')"


def std_ctes() -> str:
    names = "select full_name as raw from rega union select father from rega union select concat(given,' ',surname) from regb union select father from regb"
    return f", raws as ({names}), long as (select raw, {_std('lower(raw)')} as s from raws), std as (select raw, {_collapse('s')} as std from long)"


def _city(e: str) -> str:
    return f"(case when lower({e}) like 'zagreb%' then 'zagreb' when lower({e}) like 'beograd%' then 'beograd' else trim(lower({e})) end)"


def sides_sql(name_l: str, name_r: str, father_l: str, father_r: str) -> str:
    lc = lambda e: f"replace(replace(lower({e}),'*',''),'-','')"
    rc = lambda e: f"replace(replace(lower({e}),'9999',''),'-','')"
    city = "(case when lower(b.place) like 'zagreb%' then 'Zagreb' when lower(b.place) like 'beograd%' then 'Beograd' else b.place end)"
    return f""", l as (select a.*, {lc(name_l)} as n, {lc(father_l)} as f, {lc('byear')} as ky, {lc('place')} as kp, coalesce(try_cast('0'||byear as int),0) as y, {_city('place')} as p, lower(source) as src
        from rega a join std sn on sn.raw=a.full_name join std sf on sf.raw=a.father),
      r as (select b.*, {rc(name_r)} as n, {rc(father_r)} as f, {rc('byear')} as ky, {rc(city)} as kp, coalesce(try_cast('0'||replace(byear,'9999','') as int),0) as y, {_city('b.place')} as p
        from regb b join std sn on sn.raw=concat(b.given,' ',b.surname) join std sf on sf.raw=b.father)"""


STD = sides_sql("sn.std", "sn.std", "sf.std", "sf.std")
RAW = sides_sql("full_name", "concat(b.given,' ',b.surname)", "a.father", "b.father")
_FLAGS = "father_in_source, year_in_source, place_in_source"


def _best(cond: str, sides: str = STD, on: str = "l.n=r.n", flags: str = "false,false,false", extra: str = "", keep_all: bool = False, order: str = "b_id") -> str:
    fa, ye, pl = flags.split(",")
    rows = f"select a_id, b_id, {fa} as father_in_source, {ye} as year_in_source, {pl} as place_in_source, row_number() over (partition by a_id order by {order}) as rn from l join r on {on} where {cond}"
    return f"{WITH}{std_ctes()}{sides}{extra} select a_id, b_id, {_FLAGS} from ({rows}) {'' if keep_all else 'where rn=1'}"


def oracle_sql() -> dict[str, str]:
    strict = "l.f=r.f and l.y=r.y and l.p=r.p"
    turned = lambda e: f"array_to_string(list_sort(string_split({e},' ')),' ')"
    listed = " or ".join(f"contains(lower(dplace),'{p.lower()}')" for p in LEFT_OUT_PLACES)
    fs_, ys_, ps_ = "(l.f<>r.f and length(r.f)>0 and contains(l.src,r.f))", "(l.y<>r.y and r.y>0 and (contains(l.source,r.y::varchar) or contains(l.source,(r.y-1)::varchar) or contains(l.source,(r.y+1)::varchar)))", "(l.p<>r.p and length(r.p)>0 and contains(l.src,r.p))"
    keys = "l.n=r.n and l.f=r.f and l.ky=r.ky and l.kp=r.kp"
    relaxed = f"""{WITH}{std_ctes()}{STD}, m1 as (select a_id, min(b_id) as b_id from l join r on {keys} and l.y=r.y and l.p=r.p group by a_id),
      m2 as (select a_id, min(b_id) as b_id from l join r on l.n=r.n and (l.f=r.f or l.f='') and (l.y=r.y or l.y=0) and (l.p=r.p or trim(l.place) in ('','-','*'))
        where a_id not in (select a_id from m1) and (trim(father)='' or trim(l.byear)='' or trim(l.place)='') group by a_id)
      select a_id, b_id, false as father_in_source, false as year_in_source, false as place_in_source from (select * from m1 union all select * from m2)"""
    relaxed = relaxed.replace("trim(father)", "trim(l.father)")
    initials = lambda n: f"array_to_string(list_sort(list_transform(string_split(name,' '),lambda w: substr(w,1,{n}))),'')"
    block = lambda t, n: f"array_to_string(list_sort(list_transform(list_filter(string_split({t},' '),lambda w: w<>''),lambda w: substr(w,1,{n}))),'')"
    sim = "case when greatest(length(l.n),length(r.n))=0 then 1.0 else 1-levenshtein(l.n,r.n)/greatest(length(l.n),length(r.n)) end"
    fuzzy = lambda score, keep, order: (
        f"{WITH}{std_ctes()}{STD} select a_id, b_id, round(score,6) as score from (select a_id, b_id, score, row_number() over (partition by a_id order by {order}, b_id) as rn from "
        f"(select a_id, b_id, {score} as score from l join r on {block('l.n', 2)}={block('r.n', 2)} where abs(l.y-r.y)<=1 and l.p=r.p) where {keep}) where rn=1"
    )
    least = f"{WITH}{std_ctes()}{STD}, d as (select a_id, min(abs(l.y-r.y)) as d from l join r on l.n=r.n where l.f=r.f and l.p=r.p group by a_id), s as (select m, count(*) as n from d join (select unnest(range(0,6)) as m) on d<=m group by m)"
    return {
        "exact_link": _best(strict),
        "exact_link_plain": _best(strict, RAW),
        "exact_link_keys": _best(keys, on="l.n=r.n"),
        "exact_link_all": _best(strict, keep_all=True),
        "exact_link_sorted": _best(strict, on=f"{turned('l.n')}={turned('r.n')}"),
        "exact_link_m2": _best("l.f=r.f and abs(l.y-r.y)<=2 and l.p=r.p"),
        "source_fallback": _source_sql(fs_, ys_, ps_),
        "empty_relaxed": relaxed,
        "exact_link_filtered": _best(f"{strict} and not ({listed})"),
        "std_names": f"{WITH}{std_ctes()} select n.raw, replace(replace(replace(std.std,'*',''),'-',''),'9999','') as std from (select full_name as raw from rega union select concat(given,' ',surname) from regb) n join std on std.raw=n.raw",
        "sorted_initials": f"{WITH} select name, {initials(1)} as i1, {initials(2)} as i2, {initials(3)} as i3, array_to_string(list_sort(string_split(name,' ')),' ') as parts, array_to_string(list_reverse(string_split(name,' ')),' ') as turned from (select distinct lower(full_name) as name from rega)",
        "block_filter": f"{WITH} select dplace, count(*) as n from regb where not ({listed}) group by dplace",
        "exact_sweep": f"{least} select m, n from s",
        "match_growth": f"{least} select m, n, case when lag(m) over (order by m)=m-1 then n-lag(n) over (order by m) end as gained from s",
        "fuzzy_ld": fuzzy("levenshtein(l.n,r.n)::double", "score<=2", "score"),
        "fuzzy_nld": fuzzy(sim, "score>=0.85", "score desc"),
        "fuzzy_jw": _fuzzy_sql(_jaro_winkler_sql(), "j.score>=0.85", "score desc", ""),
        "fuzzy_dld": _fuzzy_sql(_restricted_damerau_sql(), "j.score<=2", "score", "and (l.f=r.f or (l.f<>'' and r.f<>'' and f.score<=2))"),
        "fs_patterns": f"{_fs_sql(0)} select lv_name, lv_father, lv_year, lv_place, n from pat",
        "fs_pattern_scores": f"{_fs_sql()} select lv_name, lv_father, lv_year, lv_place, n, round(fs,6) as fs from pat join sc using (pid)",
        "fs_mu": f"{_fs_sql()} select field, level, round(m,6) as m, round(u,6) as u from q10",
        "fs_match": f"{_fs_sql()}, fm as ({_FS_BEST}) select a_id, b_id, round(fs,4) as score from fm",
        "fs_review": f"{_fs_sql()} select round(fs,4) as score, sum(n)::bigint as n from pat join sc using (pid) where fs>=2 and fs<8 group by 1",
    }


def _block_sql(t: str, n: int) -> str:
    return f"array_to_string(list_sort(list_transform(list_filter(string_split({t},' '),lambda w: w<>''),lambda w: substr(w,1,{n}))),'')"


_FS_BEST = """select a_id, b_id, fs from (select a_id, b_id, fs, row_number() over (partition by a_id order by fs desc, b_id) as rn from v join pat on v.lv_name=pat.lv_name and v.lv_father is not distinct from pat.lv_father
  and v.lv_year is not distinct from pat.lv_year and v.lv_place is not distinct from pat.lv_place join sc using (pid) where fs>=8) where rn=1"""


def _fs_sql(rounds: int = FS.ITERATIONS) -> str:
    """Common table expressions: v (levels of all pairs), pat (their counts), q<k> (m and u after k rounds), sc (scores of patterns)."""
    lev = lambda a, b: f"least(floor((case when greatest(length({a}),length({b}))=0 then 1.0 else 1-levenshtein({a},{b})/greatest(length({a}),length({b})) end)*3)::int,2)"
    out = f"""{WITH}{std_ctes()}{STD}, v as (select a_id, b_id, {lev('l.n', 'r.n')} as lv_name, case when l.f<>'' and r.f<>'' then {lev('l.f', 'r.f')} end as lv_father,
      case when l.y>0 and r.y>0 then (l.y=r.y)::int end as lv_year, case when l.p not in ('','-','*') and r.p<>'' then (l.p=r.p)::int end as lv_place
      from l join r on {_block_sql('l.n', 1)}={_block_sql('r.n', 1)}),
      pat as materialized (select row_number() over (order by lv_name, lv_father, lv_year, lv_place) as pid, * from (select lv_name, lv_father, lv_year, lv_place, count(*) as n from v group by all))"""
    if not rounds:
        return out
    one = " union all ".join(f"select pid, n, '{f}' as field, lv_{f} as level from pat where lv_{f} is not null" for f in FS.FIELDS)
    levels = ", ".join(f"('{f}',{v})" for f, k in FS.level_counts(FS_OPTIONS).items() for v in range(k))
    top = "level=max(level) over (partition by field)"
    rest = "max(level) over (partition by field)"
    out += f", pl as materialized ({one}), lv as (select * from (values {levels}) t(field,level))"
    out += f", q0 as (select field, level, case when {top} then 0.9 else 0.1/{rest} end::double as m, case when {top} then 0.1 else 0.9/{rest} end::double as u from lv), s0 as (select 0.1::double as p)"
    log = lambda e: f"ln(greatest({e},1e-10))"
    for k in range(1, rounds + 1):
        sums = f"select pid, any_value(n) as n, {log('any_value(p)')}+sum({log('m')}) as lm, {log('1-any_value(p)')}+sum({log('u')}) as lu from pl join q{k - 1} using (field,level) cross join s{k - 1} group by pid"
        share = lambda c: f"(coalesce({c},0)+1e-6)/(sum(coalesce({c},0)) over (partition by lv.field)+count(*) over (partition by lv.field)*1e-6)"
        out += f", e{k} as materialized (select pid, n, n/(1+exp(least(700.0,lu-lm))) as w from ({sums})), s{k} as materialized (select sum(w)/sum(n) as p from e{k})"
        out += f", q{k} as materialized (select lv.field, lv.level, {share('a')} as m, {share('b')} as u from lv left join (select field, level, sum(w) as a, sum(e{k}.n-w) as b from pl join e{k} using (pid) group by 1,2) x on x.field=lv.field and x.level=lv.level)"
    return out + f", sc as materialized (select pid, sum(log2(greatest(m,1e-10)/greatest(u,1e-10))) as fs from pl join q{rounds} using (field,level) group by pid)"


def _fuzzy_sql(scores: str, keep: str, order: str, more: str) -> str:
    """Best candidate per left record; ``scores`` gives sc(a, b, score) for the pairs of texts in tx(a, b)."""
    texts = f"select distinct l.n as a, r.n as b from l join r on {_block_sql('l.n', 2)}={_block_sql('r.n', 2)} where abs(l.y-r.y)<=1 and l.p=r.p" + (" union select distinct l.f, r.f from l cross join r where l.f<>'' and r.f<>''" if more else "")
    rows = f"select a_id, b_id, j.score, row_number() over (partition by a_id order by j.{order}, b_id) as rn from l join r on {_block_sql('l.n', 2)}={_block_sql('r.n', 2)} join sc j on j.a=l.n and j.b=r.n {'left join sc f on f.a=l.f and f.b=r.f' if more else ''} where abs(l.y-r.y)<=1 and l.p=r.p and {keep} {more}"
    head = f"{WITH}{std_ctes()}{STD}".replace("with ", "with recursive ", 1)
    return f"{head}, tx as materialized ({texts}), {scores} select a_id, b_id, round(score,6) as score from ({rows}) where rn=1"


def _jaro_winkler_sql() -> str:
    """Letter by letter: which letter of b (``used``) is taken for the i-th letter of a (``got``)."""
    reach = "greatest(0,greatest(length(a),length(b))//2-1)"
    hit = f"list_filter(range(greatest(1,i+1-{reach}),least(length(b),i+1+{reach})+1),lambda k: substr(used,k,1)='0' and substr(b,k,1)=substr(a,i+1,1))[1]"
    step = f"select a, b, i+1 as i, case when h is null then used else substr(used,1,h-1)||'1'||substr(used,h+1) end as used, case when h is null then got else got||substr(a,i+1,1) end as got from (select *, {hit} as h from jr where i<length(a))"
    back = "array_to_string(list_transform(list_filter(range(1,length(b)+1),lambda k: substr(used,k,1)='1'),lambda k: substr(b,k,1)),'')"
    swaps = f"len(list_filter(range(1,length(got)+1),lambda k: substr(got,k,1)<>substr({back},k,1)))/2.0"
    jaro = f"case when a=b then 1.0 when length(got)=0 then 0.0 else (length(got)/length(a)+length(got)/length(b)+(length(got)-{swaps})/length(got))/3 end"
    same = "coalesce(list_filter(range(1,5),lambda k: k>length(a) or k>length(b) or substr(a,k,1)<>substr(b,k,1))[1],5)-1"
    return f"jr as (select a, b, 0 as i, repeat('0',length(b)) as used, '' as got from tx union all {step}), jf as (select a, b, {jaro} as jaro, {same} as same from jr where i=length(a)), sc as materialized (select a, b, (jaro+same*0.1*(1-jaro))::double as score from jf)"


def _restricted_damerau_sql() -> str:
    """Row by row of the distance table; a row's cells from the left are a running minimum of what stands above them."""
    up = "list_transform(range(1,length(b)+1),lambda j: least(row1[j+1]+1, row1[j]+(substr(a,i+1,1)<>substr(b,j,1))::int, case when i>0 and j>1 and substr(a,i+1,1)=substr(b,j-1,1) and substr(a,i,1)=substr(b,j,1) then row0[j-1]+1 else 9999 end))"
    step = f"select a, b, i+1 as i, row1 as row0, list_transform(range(0,length(b)+1),lambda j: list_min(list_transform(range(0,j+1),lambda k: base[k+1]+j-k))) as row1 from (select *, list_concat([i+1],{up}) as base from dr where i<length(a))"
    return f"dr as (select a, b, 0::bigint as i, []::bigint[] as row0, range(0,length(b)+1) as row1 from tx union all {step}), sc as materialized (select a, b, row1[length(b)+1]::double as score from dr where i=length(a))"


def _source_sql(fs_: str, ys_: str, ps_: str) -> str:
    rows = f"select a_id, b_id, {fs_} as father_in_source, {ys_} as year_in_source, {ps_} as place_in_source, row_number() over (partition by a_id order by b_id) as rn from l join r on l.n=r.n where (l.f=r.f or {fs_}) and (l.y=r.y or abs(l.y-r.y)<=1 or {ys_}) and (l.p=r.p or {ps_})"
    return f"{WITH}{std_ctes()}{STD} select a_id, b_id, {_FLAGS} from ({rows}) where rn=1"
