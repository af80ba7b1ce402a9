import zipfile

import pytest
from pyspark.sql import functions as F

from kinweave.functions import compare, names
from kinweave.operators import corpora, exports, extract, fellegi_sunter as fs
from kinweave.operators import keychunks, linkage, reports, thresholds
from kinweave.plans.pipeline import PRESETS, Pipeline, build_right_registry, method_settings, tolerance_settings
from kinweave.sources import registries as io


@pytest.mark.parametrize(
    "a,b,jaro,winkler,osa",
    [("martha", "marhta", 0.944444, 0.961111, 1), ("dixon", "dicksonx", 0.766667, 0.813333, 4), ("abcdefgh", "abzzzzzz", 0.5, 0.6, 6), ("", "", 1, 1, 0), ("", "a", 0, 0, 1), ("ca", "abc", 0, 0, 3), ("ab", "ba", 0, 0, 1), ("abcd", "bcda", 0.833333, 0.833333, 2)],
)
def test_comparators(a, b, jaro, winkler, osa):
    assert compare._jaro(a, b) == pytest.approx(jaro, abs=1e-6)
    assert compare._jaro_winkler(a, b) == pytest.approx(winkler, abs=1e-6)
    assert compare._restricted_damerau(a, b) == osa


def test_comparator_registry(spark):
    df = spark.createDataFrame([("martha", "marhta"), (None, "x")], "a string, b string")
    row = df.select(*[m.score(F.col("a"), F.col("b")).alias(k) for k, m in compare.METHODS.items() if k != "bm"]).collect()
    assert [r.w for r in df.select(compare.within_edits(F.col("a"), F.col("b"), 1).alias("w")).collect()] == [False, None]
    assert row[0]["dld"] == 1.0 and row[0]["ld"] == 2.0 and row[1]["jwd"] is None
    with pytest.raises(RuntimeError):
        compare.phonetic_similarity(F.col("a"), F.col("b"))
    compare.use_phonetic_encoder(lambda w: {w[0]})
    assert df.filter("a is not null").select(compare.phonetic_similarity(F.col("a"), F.col("b")).alias("s")).first().s == 1.0


def test_name_preparation(spark):
    want = {"Hajnrich": "henrik", "Heinrih": "heinrih", "Elias": "ilias", "Avramović": "abramovic", "Andjela": "andela", "Engel": "angel", "Esther": "ester", "Moise": "mose", "mojsije": "mose", "Schwarz Weiss": "svarc veis", "9999": "9"}
    df = spark.createDataFrame([(k,) for k in want] + [(None,)], "n string")
    got = {r.n: r.n_std for r in names.prepared(df, "n").collect()}
    assert got == want | {None: None}


def test_places_and_years(spark):
    df = spark.createDataFrame([("1912 [1913]", "Zagreb, Centar"), ("", "x")], "d string, p string")
    r = df.select(names.year_part(F.col("d")).alias("y"), names.place_part(F.col("p")).alias("p"), names.municipality_part(F.col("p")).alias("m"), names.city(F.col("p")).alias("c"), names.left_year(F.col("d")).alias("n")).collect()
    assert tuple(r[0]) == ("1912", "Zagreb", " Centar", "zagreb", 1912) and r[1].m == "" and r[1].n == 0


def test_expectation_maximisation():
    counts = [((2, 1), 5), ((2, None), 3), ((1, 0), 4), ((0, 0), 20), ((0, 1), 2)]
    m, u, p = fs.estimate(counts, {"name": 3, "father": 2})
    assert p == pytest.approx(0.25250166, abs=1e-6)
    assert [m["name", v] for v in range(3)] == pytest.approx([0.06824364, 1.2e-07, 0.93175624], abs=1e-6)
    assert [u["name", v] for v in range(3)] == pytest.approx([0.84258003, 0.15738774, 3.223e-05], abs=1e-6)
    assert [u["father", v] for v in range(2)] == pytest.approx([0.94435399, 0.05564601], abs=1e-6)
    assert fs.estimate([], {"name": 2})[0] == {}


def _registries(spark):
    left = spark.createDataFrame([(1, "Ana Koen", "Ivan", "1900", "Zagreb", "1942", "rod. 1901"), (2, "Ana Koen", "", "1900", "Zagreb", "", ""), (3, "Iva Levi", "Josip", "1910", "-", "", "")], "a_id long, full_name string, father string, byear string, place string, dyear string, source string")
    right = spark.createDataFrame([(10, "Ana", "Cohen", "Ivan", "1901", "Zagreb-Centar", "1942", "Sisak", "x"), (11, "Ana", "Kohen", "Ivan", "1900", "Zagreb", "1943", "Jasenovac", "x"), (12, "Iva", "Levi", "Jozef", "9999", "Tuzla", "", "Sisak", "x")], "b_id long, given string, surname string, father string, byear string, place string, dyear string, dplace string, circumstances string")
    return left, right


def test_linkage(spark):
    left, right = _registries(spark)
    base = linkage.Options(normalise=True, check_father=True, check_year=True, check_place=True)
    assert {(r.a_id, r.b_id) for r in linkage.link(left, right, base).collect()} == {(1, 11)}
    src = linkage.link(left, right, linkage.Options(normalise=True, check_father=True, check_year=True, check_place=True, alternatives=True)).collect()
    assert [(r.a_id, r.b_id, r.year_in_source) for r in src] == [(1, 10, True)]
    loose = linkage.link(left, right, PRESETS["relaxed"]).collect()
    assert {(r.a_id, r.b_id) for r in loose} == {(1, 11), (2, 11)}
    p = Pipeline(left, right)
    assert {(r.a_id, r.b_id) for r in p.run(linkage.Options(normalise=True, check_year=True, max_year_gap=1)).collect()} == {(1, 10), (2, 10)}
    n = {r.setting: r.n for r in p.sweep(tolerance_settings(base, 2)).groupBy("setting").agg(F.count("*").alias("n")).collect()}
    assert n == {"m1": 1, "m2": 1}
    grid = p.sweep({k: o for k, o in method_settings(base, 1, 1).items()})
    assert {r.setting for r in grid.select("setting").distinct().collect()} <= {"exact_m0", "exact_m1", "ld1_m0", "ld1_m1"} and grid.filter("setting = 'exact_m0'").count() == 0
    report = {(r.section, r.item): (r.n, r.pct) for r in reports.full_report(reports.joined(linkage.link(left, right, base), left, right)).collect()}
    assert report["names", "matches"] == (1, 100.0) and report["death places", "Jasenovac"] == (1, 100.0) and reports.full_report(reports.joined(linkage.link(left.limit(0), right, base), left, right)).count() == 0


def test_comparison_form(spark):
    df = spark.createDataFrame([("  Áłëš* [x]",), ("Đuro",), ("Ťůě ńÿ",)], "t string")
    assert [r.f for r in df.select(names.comparison_form(F.col("t")).alias("f")).collect()] == ["ałes", "đuro", "tue ny"]
    with pytest.raises(Exception, match="CAST_INVALID"):
        df.select(names.strict_int(F.col("t"))).collect()


def test_key_chunks(spark):
    rows = [("a", i, "x") for i in range(50)] + [(None, i, None) for i in range(7)] + [("", 0, None)]
    df = spark.createDataFrame(rows, "k string, o int, extra string")
    got = keychunks.number_rows(df, ["k"], ["o"]).collect()
    assert sorted(r["__no"] for r in got if r.k == "a") == list(range(1, 51)) and all(r.o + 1 == r["__no"] for r in got)
    heavy = keychunks.weighted_keys(df, ["k"], ["o"], 0.1).collect()
    assert {(r.k, r.n_rows) for r in heavy} == {("a", 50), (None, 7)}
    assert keychunks.weighted_keys(df.limit(0), ["k"], ["o"], 0.1).count() == 0
    step = (F.col("o") - F.col("prev.o") > 0).cast("int")
    states = keychunks.chunked_states(df, ["k"], ["o"], [], step, chunk_rows=8)
    merged = keychunks.merged_steps(states, ["k"], (F.col("__head.o") - F.col("prev.o") > 0).cast("int"))
    assert {r.k: r.s for r in merged.groupBy("k").agg(F.sum("__steps").alias("s")).collect()} == {"a": 49, None: 6, "": 0}


def test_extraction(spark):
    html = '<p class="Normal"><span class="Bold">LEVI, Izak (Isak)</span> (Tuzla, 3. V. 1900 – Split, 1. I. 1970) x'
    e = extract.entry_keys(extract.lexicon_entries(spark.createDataFrame([(1, html), (2, "none"), (3, None)], "entry_id int, html string"))).collect()
    assert {r.key_name for r in e} == {"Izak LEVI", "Isak LEVI"} and (e[0].birth_place, e[0].birth_year, e[0].death_place, e[0].death_year) == ("Tuzla", "1900", "Split", "1970")
    page = '<h1>a</h1><h1>Ana K</h1><i class="detail_title">Sex:</i><i class="detail_content"> F </i><i class="detail_title">Sex:</i><i class="detail_content"> M0 </i>'
    f = extract.page_fields(spark.createDataFrame([(page,)], "html string")).first()
    assert f.name == "Ana K" and f.fields == {"Sex:": "M0"}
    spans = spark.createDataFrame([("f", 1, 1, "data", 1, "a", 7.0, 10.0), ("f", 1, 2, "data", 1, "b", 7.0, 18.0), ("f", 1, 3, "data", 1, "c", 7.0, 40.0), ("f", 1, 4, "head", 1, "H", 9.0, 44.0)], "file string, page int, ord long, kind string, column int, text string, font_size double, y1 double")
    assert [r.text for r in extract.merged_lines(spans).orderBy("first_ord").collect()] == ["a b", "c", "H"]
    loc = spark.createDataFrame([("f", 1, "p1")], "file string, ord int, page string")
    recs = spark.createDataFrame([("f", 5, "x"), ("f", 9, "y")], "file string, ord int, v string")
    assert {(r.v, r.page) for r in extract.with_locations(recs, loc).collect()} == {("x", "p1"), ("y", None)}


def test_record_lines():
    good = "Kohn, (Ivan), Ana, rođena 1912. Gorjan, ubijena 1942. u logoru, Sisak (12)"
    assert extract.record_fields("\t\t" + good) == ["Ana", "Kohn", "Ivan", "1912", "Gorjan", "1942", "Sisak", "ubijena", "u logoru", "12"]
    # marks that are missing cut at the last letter, as a position of -1 does
    assert extract.record_fields("\t\tKohn Ana, rođena 1912. Gorjan, ubijena 1942. u logoru, Sisak (12)")[:3] == ["Kohn Ana", "Kohn An", "Kohn An"]
    bad = extract.record_fields("\t\tKohn (Ivan) Ana, rođena 1912. Gorjan, nestala")
    assert bad[:5] == ["Ana", "Kohn", "Ivan", "1912", "Gorjan"] and bad[5] == "" and bad[7] == "nestal"
    assert len(extract.record_fields("")) == 10


def test_second_entries(spark):
    page = lambda sep: f'<div class="tekst"><span class="natuknica">LEVI, Izak</span>, liječnik (Tuzla, 3. V. 1900 {sep} Split, 1970) x</div>'
    df = spark.createDataFrame([(k, page(s)) for k, s in enumerate(["&mdash;", "&ndash;", "–", "—", "-"])] + [(9, "<p>none</p>"), (10, None)], "entry_id int, html string")
    got = extract.second_entries(df).collect()
    assert len(got) == 5 and {(r.name, r.birth_place, r.birth_year, r.death_place, r.death_year) for r in got} == {("Izak LEVI", "Tuzla", "1900", "Split", "1970")}


def test_books_to_records(spark):
    rows = [("k", "f", 1, 1, 50.0, 10.0, 11.0, "Opština Sisak"), ("k", "f", 1, 2, 50.0, 20.0, 9.0, "Petrinja"), ("k", "f", 1, 3, 50.0, 30.0, 7.0, "Kohn (Ivan) Ana, rođena 1912. Gorjan, ubijena 1942. u logoru,"), ("k", "f", 1, 4, 50.0, 38.0, 7.0, "Sisak (12)"), ("k", "f", 1, 5, 320.0, 30.0, 7.0, " "), ("k", "f", 1, 6, 320.0, 30.0, 7.0, "Levi (Mose) Iva, rođen 1900. Gorjan, ubijen 1941. u borbi, Tuzla (13)")]
    spans = spark.createDataFrame(rows, "component string, file string, page int, ord long, x0 double, y1 double, font_size double, text string")
    got = sorted((r.component, r.Name, r.Place, r.Municipality, r.DeathPlace, r.IDNumber, r.File, r.Page, r.Column) for r in build_right_registry(spans).collect())
    assert got == [("k", "Ana", "Petrinja", "Sisak", "Sisak", "12", "f", "1", "left"), ("k", "Iva", "Petrinja", "Sisak", "Tuzla", "13", "f", "1", "right")]


def test_entry_rules(spark):
    left = spark.createDataFrame([(1, "Izak Levi", "Mojsije", "1900", "Tuzla", "1942", ""), (2, "Levi Izak", "", "", "Tuzla", "", ""), (3, "Izak Lewi", "", "1901", "", "", "")], "a_id long, full_name string, father string, byear string, place string, dyear string, source string")
    page = f'{extract.ENTRY_OPEN}LEVI, Izak</span> (Tuzla, 1900) sin Mojsija. {{}}{extract.FOOTER}'
    pages = spark.createDataFrame([(1, page.format("")), (2, page.format("Preživio je.")), (3, page.format("Umro 1970."))], "entry_id long, html string")
    entries = extract.entry_keys(extract.lexicon_entries(pages))
    # without a death place the text has to show survival or a later year
    assert {tuple(r) for r in corpora.entry_matches(left, entries, corpora.FIRST_LEXICON).collect()} == {(1, 2), (1, 3)}
    near = corpora.EntryRules(method="ld", threshold=1, max_year_gap=1, empty_left_year=True)
    assert {tuple(r) for r in corpora.entry_matches(left, entries, near).collect()} == {(1, 1), (2, 1), (3, 1)}
    assert corpora.entry_matches(left.limit(0), entries, near).count() == 0
    listed = corpora.entry_listing(corpora.entry_matches(left, entries, corpora.FIRST_LEXICON), left, pages).collect()
    assert len(listed) == 2 and all("mojsij" in r.context for r in listed)


def test_thresholds(spark):
    s = spark.createDataFrame([(x,) for x in [0.1] * 20 + [0.2] * 20 + [0.9] * 10 + [0.95] * 10 + [None]], "score double")
    assert thresholds.max_gap(s).first().threshold == pytest.approx(0.55)
    assert thresholds.otsu(s).first().threshold == pytest.approx(0.55)
    assert 0.2 < thresholds.kde_valley(s).first().threshold < 0.9
    assert thresholds.distribution(s).count() == 4 and thresholds.chosen(s, 0.4).first().threshold == 0.4
    assert thresholds.max_gap(s.limit(0)).first().threshold is None
    # fewer than three scores: the widest gap, sizes left aside
    two = spark.createDataFrame([(0.2,)] * 9 + [(0.6,)], "score double")
    assert thresholds.kde_valley(two).first().threshold == pytest.approx(0.4) and thresholds.kde_valley(two.filter("score < 0.5")).first().threshold == pytest.approx(0.2)
    assert [(r.bin, r.n) for r in thresholds.histogram(two).orderBy("bin").collect()] == [(1, 9), (50, 1)] and thresholds.applied(two, 0.6).count() == 1


def test_sources(spark, tmp_path):
    right = spark.createDataFrame([tuple(f"{c}{i}" for c in range(15)) for i in (2, 1)], io.RIGHT_FIELDS)
    io.write_right(right, str(tmp_path / "r"))
    back = io.ordered(io.read_right(spark, str(tmp_path / "r"))).orderBy("ord").collect()
    assert [(r.ord, r.Name) for r in back] == [(1, "01"), (2, "02")]
    (tmp_path / "bad.tsv").write_text("a\tb\n")
    with pytest.raises(Exception, match="15 fields"):
        io.read_right(spark, str(tmp_path / "bad.tsv")).collect()
    (tmp_path / "l.json").write_text('[{"name_and_surname": "A B", "Sex:": "F", "Height:": "9"}, {"Camp:": "c"}]')
    read = io.read_left(spark, str(tmp_path / "l.json"))
    assert [(r["Sex:"], r.other) for r in read.collect()] == [("F", {"Height:": "9"}), ("", {})]
    many = spark.range(10).select(F.col("id").cast("string").alias("name_and_surname"), F.lit("x,\n\"").alias("Notes:")).repartition(3)
    io.write_left(many, str(tmp_path / "left"))
    back = io.read_left(spark, str(tmp_path / "left")).collect()
    assert {r.name_and_surname for r in back} == {str(i) for i in range(10)} and {r["Notes:"] for r in back} == {"x,\n\""}
    io.write_left(many.limit(0), str(tmp_path / "none"))
    assert io.read_left(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "e.txt").write_text("name level 2/3: m=0.9, u=0.1\nother\n")
    assert tuple(io.read_estimates(spark, str(tmp_path / "e.txt")).first()) == ("name", 2, 0.9, 0.1)
    (tmp_path / "m.txt").write_text("a|b|c|d|e|f|1.5\n\tx|y\na|b|c|d|e|f\n")
    assert [(r.score, r.right_fields) for r in io.read_match_lines(spark, str(tmp_path / "m.txt")).collect()] == [(1.5, ["x", "y"]), (None, None)]
    assert io.read_scores(spark, str(tmp_path / "m.txt")).count() == 1
    # lines of two files are paired within their file, and fields are trimmed
    (tmp_path / "two").mkdir()
    for n in "pq":
        (tmp_path / "two" / f"{n}.txt").write_text("".join(f"{n}{i} |b|c|d|e|f\n\t{n}{i}| y\n" for i in range(2)))
    got = io.read_match_lines(spark, str(tmp_path / "two")).collect()
    assert len(got) == 4 and all(r.left_fields[0] == r.right_fields[0] and r.right_fields[1] == "y" for r in got)
    assert io.match_count(spark, str(tmp_path / "m.txt")) == 1 and io.match_count(spark, str(tmp_path / "nowhere")) is None
    scored = spark.createDataFrame([(1.5, *"abcdefgh"), (2.25, *"abcdefgh")], "score double, a string, b string, c string, d string, e string, f string, g string, h string")
    io.write_review(scored, list("abcdefgh"), str(tmp_path / "review"))
    assert [r.score for r in io.read_review(spark, str(tmp_path / "review")).orderBy("score").collect()] == [1.5, 2.25]
    assert next((tmp_path / "review").glob("part-*")).read_text().startswith("score\ta")
    (tmp_path / "t.tsv").write_text("\t".join(f"f{i}" for i in range(9)) + "\nshort\tline\n" + "\t".join(f"g{i}" for i in range(12)) + "\n")
    assert sorted(r.DeathPlace for r in io.read_death_places(spark, str(tmp_path / "t.tsv")).collect()) == ["f8", "g8"] and io.read_persons(spark, str(tmp_path / "t.tsv"), True).count() == 1
    exports.write_workbook(str(tmp_path / "w.xlsx"), {"One": scored.select("a", "score"), "Two": scored.limit(0)})
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        assert list(io._sheet_rows((tmp_path / "w.xlsx").read_bytes())) == [["a", "score"], ["a", "1.5"], ["a", "2.25"]] and 'ySplit="1"' in z.read("xl/worksheets/sheet2.xml").decode()
    assert exports.widths(scored, "a", "score").first().asDict() == {"a": 6, "score": 10}
    with zipfile.ZipFile(tmp_path / "c.xlsx", "w") as z:
        cell = lambda r, c, t: f'<c r="{c}{r}" t="inlineStr"><is><t>{t}</t></is></c>'
        rows = "".join(f'<row r="{r}">{"".join(cell(r, c, f"{c}{r}") for c in "ABCDEFG")}</row>' for r in (1, 2))
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{rows}</sheetData></worksheet>')
    c = io.read_certificates(spark, str(tmp_path / "c.xlsx")).first()
    assert (c.surname, c.religion, c.row_idx, c.birth_year) == ("A2", "G2", 2, "")


def test_entry_without_subpackages():
    import __spark_entry__ as e

    assert {"exact_link", "p3_found"} <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_pairs_are_counted_without_forming_them(spark):
    """Thresholds and counts from classes of equal rows are those of the pairs themselves, keys of several rows included."""
    o = linkage.Options(normalise=True, check_year=True, check_place=True, max_year_gap=1, method="nld", threshold=0.0, block_letters=2, keep_all=True)
    names = ["Marko Levi", "Marka Levi", "Mara Levy", "Marko Levin", "Ana Papo"]
    left = [(k // 2 if k < 8 else k, names[k % 5], "", str(1900 + k % 3), ["Zagreb", "Tuzla"][k % 2], "", "") for k in range(40)] + [(None, names[0], "", "1900", "Zagreb", "", "")] * 2
    right = [(k % 25, *names[(k * 3) % 5].split(), "", str(1900 + k % 4), ["Zagreb", "Tuzla"][k % 2], "", "", "") for k in range(30)]
    a = spark.createDataFrame(left, "a_id long, full_name string, father string, byear string, place string, dyear string, source string")
    b = spark.createDataFrame(right, "b_id long, given string, surname string, father string, byear string, place string, dyear string, dplace string, circumstances string")
    pairs = linkage.link(a, b, o).select("a_id", "b_id", "score")
    exact = linkage.link(a, b, linkage.Options(normalise=True, check_year=True, check_place=True, max_year_gap=1, keep_all=True))
    scores, counts = linkage.pair_counts(a, b, o)
    rounded = lambda df: sorted((round(r.score, 9), r.n) for r in df.collect())
    assert rounded(scores) == rounded(pairs.groupBy("score").count().withColumnRenamed("count", "n"))
    # the joins of by_method do not meet null keys, so it is compared without them
    known = pairs.filter("a_id is not null"), exact.filter("a_id is not null")
    at = spark.createDataFrame([("a", 0.95), ("b", 0.7), ("c", 2.0), ("d", None)], "method string, threshold double")
    want = {r.method: tuple(r) for r in thresholds.by_method(*known, at, ["a_id", "b_id"]).collect()}
    scores, counts = linkage.pair_counts(a.filter("a_id is not null"), b, o)
    assert {r.method: tuple(r) for r in thresholds.by_method_counted(counts, at).collect()} == want and want["a"][2] > 20
    for f in (thresholds.max_gap, thresholds.otsu, thresholds.kde_valley):
        assert f(scores).first().threshold == pytest.approx(f(known[0].select("score")).first().threshold)
