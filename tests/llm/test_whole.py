"""The whole job: every pair that later rules accept is met, compared with brute force."""

import random
import time

from pyspark.sql import functions as F

from kinweave.llm import align, linkage, name_keys, people, soft_logic, spellings, trie_join
from kinweave.llm.people import TABLES, _letters


def _lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_trie_join_meets_all_pairs(spark):
    rng = random.Random(7)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(4, 11))) for _ in range(250)}
    for w in sorted(words)[:120]:
        for _ in range(2):
            v = list(w)
            for at in (rng.randrange(3), len(v) - 1 - rng.randrange(3)):
                kind = rng.randrange(3)
                v[at : at + (kind > 0)] = [rng.choice("abcdxy")] if kind < 2 else []
            words.add("".join(v))
    words = sorted(w for w in words if len(w) >= 4) + ["lenda", "leuda", "mark", "marko", "tukran", "turkan"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    brute = {(a, b): _lev(a, b) for a in set(words) for b in set(words) if a != b and abs(len(a) - len(b)) <= 2}
    for k in (1, 2):
        for whole in (trie_join.WHOLE, 0):
            got = {(r.a, r.b): r.d for r in trie_join.trie_join(df, "w", k, whole).collect()}
            assert got == {p: d for p, d in brute.items() if d <= k}


def test_near_words_are_those_same_word_accepts(spark):
    rng = random.Random(8)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(4, 9))) for _ in range(150)} | {"turanstein", "tutanstei", "kendergbam", "lendergbaum"}
    df = spark.createDataFrame([(w,) for w in sorted(words)], "w string")
    both = df.selectExpr("w as a").crossJoin(df.selectExpr("w as b")).filter("a <> b")
    want = {tuple(r) for r in both.filter(spellings.same_word(both.a, both.b)).collect()}
    got = {tuple(r) for r in spellings.near_words(df).select("a", "b").collect()}
    assert got == want and ("turanstein", "tutanstei") in got


PERSON = "rid long, r int, tokens array<string>, given_n int, byear int, byear2 int, bdate int, place string, father string, dyear int, dplace string, sex string, pletters int, fletters int, dletters int"


def _met(spark, rows, tab, forms=()):
    """Pairs found, by key, of (key, tokens, year, date, place, father)."""
    code = TABLES.index(tab)
    bits = lambda v: None if v is None else _letters(v)
    data = [(k * 4 + code, hash((k, tab)) % 1_000_003, t, 1, y, None, d, p, f, None, None, None, bits(p), bits(f), None) for k, t, y, d, p, f in rows]
    records = spark.createDataFrame(data, PERSON).withColumn("nid", F.xxhash64("tokens"))
    given = spark.createDataFrame(list(forms), "s string, f string, weight long")
    return {(r.key_a, r.key_b) for r in spellings.variants(records, given).collect()}


def test_certificates_meet_whatever_their_dates_hold(spark):
    name = lambda w: ["veronika", w]
    rows = [
        (1, name("dremitkak"), 1891, 18910102, "abcdef", None), (2, name("dremitkak"), 1891, 18910304, "bxyzuv", None), (3, name("dremytkak"), 1891, None, None, None),
        (4, name("dremitkak"), 1892, None, None, None), (5, name("dremitkak"), None, None, "abcdef", None), (6, name("dremitkak"), None, None, None, None),
    ]
    rows += [(7, name("torovic"), 1880, 18800505, None, None), (8, name("torovitc"), 1880, None, "abcdef", None), (9, ["veronica", "torovitc"], 1880, None, None, None)]
    # two full dates that differ are no pair; a year or a place alone links if one person can be meant and a word is shared
    assert _met(spark, rows, "match_entries") == {(1, 5), (7, 8), (8, 9)}


def test_order_abbreviations_spaces_and_familiar_forms(spark):
    rest = (1900, None, "stulgrad", "filip")
    names = [["marko", "ilkovic"], ["ilkovic", "marko"], ["m.", "ilkovic"], ["marko", "ilk."], ["marko", "il", "kovic"], ["mare", "ilkovic"], ["ana", "ilkovic"], ["marko", "torovic"], ["n."], []]
    got = _met(spark, [(k, t, *rest) for k, t in enumerate(names)], "export_xlsx", [("mare", "marko", 5)])
    assert {(0, k) for k in range(1, 6)} <= got and not any(k in p for p in got for k in (6, 7, 8, 9))


def test_forms_are_learned(spark):
    rows = [(k, ["filip" if k % 2 else "filko", f"surname{'abcd'[k // 2]}x"], 1900, None, "stulgrad", "ivan") for k in range(8)] + [(20, ["ana", "surnameax"], 1900, None, "stulgrad", "ivan")]
    data = [(k * 4 + 1, 0, t, 1, y, None, None, p, f, None, None, None, 0, 0, 0) for k, t, y, _, p, f in rows]
    forms = spellings.learned_forms(spark.createDataFrame(data, PERSON)).collect()
    assert [(r.s, r.f, r.weight) for r in forms] == [("filko", "filip", 4)]


def test_records_of_popular_names_meet_as_others_do(spark, monkeypatch):
    """The further keys of heavy names lose no pair that is found without them."""
    rng = random.Random(11)
    places, fathers = ["stulgrad", "stulgrat", "vrevgrad", "zamugistar", None], ["ivan", "iva.", "petar", None]
    rows = [(k, ["marko", rng.choice(["ilkovic", "ilkovac"])], rng.choice([None, 1900, 1901, 1903]), None, rng.choice(places), rng.choice(fathers)) for k in range(60)]
    dates = [(k, ["marko", rng.choice(["ilkovic", "ilkovac"])], *rng.choice([(1900, 19000101), (1900, 19000202), (1900, None), (None, None)]), rng.choice(places), None) for k in range(60)]
    for tab, data in (("export_xlsx", rows), ("match_entries", dates)):
        light = _met(spark, data, tab)
        with monkeypatch.context() as m:
            m.setattr(spellings, "HEAVY", 0)
            assert _met(spark, data, tab) == light and len(light) > 20


def test_large_keys_are_joined(spark, monkeypatch):
    rows = [(k, ["marko", w], 1900, None, "stulgrad", None) for k, w in enumerate(["ilkovic", "ilkovac", "ilkovec", "ilkov.", "ilkovcic"])]
    want = _met(spark, rows, "export_xlsx")
    monkeypatch.setattr(name_keys.pairs_of, "__defaults__", (0,))
    assert _met(spark, rows, "export_xlsx") == want and want


def _leaks(spark, docs, items, **kw):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    i = spark.createDataFrame(list(enumerate(items)), "item_id long, item_text string")
    found = align.leaks(d, i, **kw).filter(f"span >= {align.MIN_SPAN} and met >= {align.MIN_MATCHED}")
    return sorted((r.item_id, r.doc_id) for r in found.collect())


def test_wording_shared_by_many_items_leaks_from_all(spark):
    shared = [f"s{k}" for k in range(25)]
    items = [" ".join([f"a{i}x{k}" for k in range(20)] + shared) for i in range(30)]
    docs = ["before " + " ".join(shared) + " after", "nothing of it"]
    want = [(i, 0) for i in range(30)]
    assert _leaks(spark, docs, items) == want
    assert _leaks(spark, docs, items, whole_words=0) == want
    # equal items are one class, and each is reported
    assert _leaks(spark, docs, [items[0]] * 100) == [(i, 0) for i in range(100)]


def test_a_clean_stretch_counts_beside_noise(spark):
    item = [f"w{k}" for k in range(100)]
    noisy = lambda ws, n: [w if k % n else f"x{k}" for k, w in enumerate(ws)]
    # 25 words in a row, then every second one changed
    run_on = item[:25] + noisy(item[25:45], 2)
    # a long noisy passage, and elsewhere a clean one
    elsewhere = noisy(item[30:100], 3) + ["z"] * 90 + item[:26]
    # the same close together, so that both are one passage
    close = noisy(item[30:100], 3) + ["z"] * 12 + item[:26]
    none = noisy(item[:60], 3)
    assert _leaks(spark, [" ".join(x) for x in (run_on, elsewhere, close, none)], [" ".join(item)]) == [(0, 0), (0, 1), (0, 2)]


RULES = "p long, rules array<struct<up:boolean,s:double,w:double>>"
COUPLES = "p long, q long, sign double, c double, w double"


def _reference(rules, couples):
    """Minimum over [0, 1] by coordinate descent with bisection, run until nothing moves."""
    y = dict.fromkeys(rules, 0.5)

    def slope(p, v):
        g = sum((-2 * w * max(0.0, s - v)) if up else 2 * w * max(0.0, v - s) for up, s, w in rules[p])
        for a, b, sign, c, w in couples:
            if p in (a, b):
                ya, yb = (v if a == p else y[a]), (v if b == p else y[b])
                g += 2 * w * max(0.0, yb + sign * ya - c) * (sign if p == a else 1.0)
        return g

    for _ in range(400):
        moved = 0.0
        for p in y:
            lo, hi = 0.0, 1.0
            for _ in range(50):
                mid = (lo + hi) / 2
                lo, hi = (lo, mid) if slope(p, mid) > 0 else (mid, hi)
            moved, y[p] = max(moved, abs(y[p] - lo)), lo
        if moved < 1e-9:
            break
    return y


def test_soft_logic_is_converged(spark):
    prior = (False, 0.0, 2.4)
    # year equal, place differs, year of death equal: a match by little; a rule with a target between
    rules = {1: [prior, (True, 1.0, 3.0), (False, 0.0, 1.5), (True, 1.0, 1.0)], 2: [prior, (True, 1.0, 3.0), (True, 1.0, 2.0), (False, 0.0, 1.5), (False, 0.0, 1.0)], 3: [(True, 0.7, 2.0), (False, 0.2, 1.0)]}
    rng = random.Random(9)
    for p in range(10, 40):
        rules[p] = [prior] + [(True, 1.0, rng.choice([1.5, 2.0, 3.0])) for _ in range(3)] + [(False, 0.0, rng.choice([1.0, 1.5, 4.0]))]
    couples = [(p, 10 + (p - 10) // 5 * 5, sign, float(sign > 0), 2.0) for p in range(10, 40) for sign in [rng.choice([1.0, -1.0])] if (p - 10) % 5]
    want = _reference(rules, couples)
    got = {r.p: r.y for r in soft_logic.solve(spark.createDataFrame(list(rules.items()), RULES), spark.createDataFrame(couples, COUPLES)).collect()}
    assert set(got) == set(want)
    assert max(abs(got[p] - want[p]) for p in want) < 1e-3
    assert got[1] > 0.506 and got[2] > 0.505


def test_frequent_spellings_meet(spark):
    # 17 and 61 records hold the two spellings
    rows = [(k, [w, "matilda"], 1930, 19300426, "p", None) for k, w in enumerate(["lendabnovic"] * 17 + ["lendanovic"] * 61)]
    assert _met(spark, rows, "match_entries") >= {(a, b) for a in range(17) for b in range(17, 78)}


def test_registry_records_one_year_apart_meet(spark):
    name = ["varkodos", "franjo"]
    rows = [(1, name, 1877, None, "tutriste", None), (2, name, 1876, None, "tutris.", None), (3, name, 1879, None, "x", None)]
    assert _met(spark, rows, "export_xlsx") == {(1, 2)}


def _hard(rng):
    """Records of two spellings whose undated pairs rest on places and fathers that differ at both ends or in their first letter."""
    places, fathers = ["abcdef", "xbcdey", "ab.", "t.", "tuzlagrad", "uzlagra", "stulgrad", None], ["ivan", "jvan", "i.", "bepo", "iosip", None]
    names = lambda: ["marko", rng.choice(["ilkovic", "ilkovac"])]
    registry = [(k, names(), rng.choice([None, None, 1900, 1901, 1903]), None, rng.choice(places), rng.choice(fathers)) for k in range(60)]
    dates = [(k, names(), *rng.choice([(1900, 19000101), (1900, 19000202), (1900, None), (None, None), (None, None)]), rng.choice(places), None) for k in range(60)]
    return registry, dates


def test_p1_does_not_depend_on_the_number_of_namesakes(spark, monkeypatch):
    registry, dates = _hard(random.Random(12))
    for tab, data in (("export_xlsx", registry), ("match_entries", dates)):
        got = []
        for heavy in (10**9, 0):
            with monkeypatch.context() as m:
                m.setattr(spellings, "HEAVY", heavy)
                got.append(_met(spark, data, tab, [("bepo", "iosip", 5)]))
        assert got[0] == got[1] and len(got[0]) > 20


def test_near_places_are_those_near_place_accepts(spark):
    rng = random.Random(13)
    values = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(120)} | {"ab.", "t.", ".", "tuzlagrad"})
    df = spark.createDataFrame([(v,) for v in values], "place string")
    both = df.crossJoin(df.withColumnRenamed("place", "near"))
    want = {tuple(r) for r in both.filter(spellings.near_place(both.place, both.near)).collect()}
    assert {tuple(r) for r in spellings.near_places(df).collect()} == want


def test_p6_does_not_depend_on_the_number_of_namesakes(spark, monkeypatch):
    rows, _ = _hard(random.Random(14))
    bits = lambda v: None if v is None else _letters(v)
    data = [(k * 4 + k % 2, k, t, 1, y, None, d, p, f, None, None, None, bits(p), bits(f), None) for k, t, y, d, p, f in rows[:40]]
    records = spark.createDataFrame(data, PERSON).withColumn("nid", F.xxhash64("tokens"))
    forms = spark.createDataFrame([("bepo", "iosip", 5)], "s string, f string, weight long")
    got = []
    for heavy in (10**9, 0):
        with monkeypatch.context() as m:
            m.setattr(spellings, "HEAVY", heavy)
            names = spellings.linked_names(records, forms, linkage.across, F.expr(linkage.BOTH))
            met = spellings.record_pairs(names, records, forms, lambda ta, ra, tb, rb: ta != tb, linkage.LEAST_POINTS)
            got.append({frozenset(r) for r in met.select("a.rid", "b.rid").collect()})
    assert got[0] == got[1] and len(got[0]) > 100


def test_memory_of_trie_runs_does_not_grow_with_the_vocabulary(spark, monkeypatch):
    rng = random.Random(15)
    words = sorted({"".join(rng.choice("abcd") for _ in range(6)) for _ in range(400)})
    df = spark.createDataFrame([(w,) for w in words], "w string")
    whole = trie_join.neighbours

    def bounded(trie, roots, level, k, run=None):
        assert run is None or run.stop - run.start <= 10
        return whole(trie, roots, level, k, run)

    want = {tuple(r) for r in trie_join.trie_join(df, "w").collect()}
    monkeypatch.setattr(trie_join, "RUN", 10)
    monkeypatch.setattr(trie_join, "neighbours", bounded)
    assert {tuple(r) for r in trie_join.trie_join(df, "w").collect()} == want and want


def test_soft_logic_in_one_task_goes_the_rounds_of_joined_tables(spark):
    rng = random.Random(16)
    rules = {p: [(False, 0.0, 2.4)] + [(True, 1.0, rng.choice([1.5, 2.0, 3.0])) for _ in range(3)] + [(False, 0.0, rng.choice([1.0, 4.0]))] for p in range(-20, 40)}
    couples = [(p, (p + 20) // 4 * 4 - 20, sign, float(sign > 0), 2.0) for p in rules for sign in [rng.choice([1.0, -1.0])] if p % 4]
    pairs, ties = spark.createDataFrame(list(rules.items()), RULES), spark.createDataFrame(couples, COUPLES)
    one, many, bare = ({r.p: r.y for r in soft_logic.solve(pairs, t, one_task=n).collect()} for t, n in ((ties, 10**6), (ties, 0), (ties.limit(0), 10**6)))
    assert set(one) == set(many) == set(bare) == set(rules)
    assert max(abs(one[p] - many[p]) for p in rules) < 1e-9
    assert max(abs(one[p] - bare[p]) for p in rules) > 0.01
    # no round is a job of its own
    run = spark.sparkContext.statusTracker().getJobIdsForGroup
    spark.sparkContext.setJobGroup("one task", "")
    soft_logic.solve(pairs, ties).collect()
    jobs = len(run("one task"))
    spark.sparkContext.setJobGroup("", "")
    assert 0 < jobs < 25


def test_words_are_folded_as_whole_names_are():
    rng = random.Random(17)
    letters = "".join(chr(c) for c in range(32, 0x250)) + "  '.()-ČćĐšž" * 12 + "Марко́​"
    for _ in range(20_000):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(1, 24)))
        assert people._tokens(s) == people._any_tokens(s)


def test_only_words_that_weigh_more_stand_for_others(spark):
    rng = random.Random(18)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(4, 9))): rng.randint(1, 4) for _ in range(200)}
    df = spark.createDataFrame(list(words.items()), "w string, n long")
    want = {(r.a, r.b) for r in spellings.near_words(df).collect() if (-words[r.b], r.b) < (-words[r.a], r.a)}
    assert {(r.a, r.b) for r in spellings._met_words(df, "n").collect()} == want and want
    for whole in (0, 10**6):
        got = {(r.a, r.b) for r in trie_join.trie_join(df, "w", whole=whole, weight="n").collect()}
        assert got == {(r.a, r.b) for r in trie_join.trie_join(df, "w").collect() if (-words[r.b], r.b) < (-words[r.a], r.a)}


def test_the_bound_from_numbers_keeps_what_the_evidence_accepts_and_is_short(spark):
    rng = random.Random(19)
    text = lambda: rng.choice([None, "ab.", "tuzla", "tuzlagrad", "uzlagra", "stul"])
    some = [(4 * k + rng.choice([0, 2]), k, rng.choice([None, 1900, 1901, 1903]), rng.choice([None, None, 1902]), rng.choice([None, 19000101, 19000202]), text(), text(), rng.choice([None, 1942]), text(), rng.choice([None, "M", "F"])) for k in range(90)]
    bits = lambda v: None if v is None else _letters(v)
    rows = [(*r, bits(r[5]), bits(r[6]), bits(r[8]), ["x"]) for r in some]
    df = spark.createDataFrame(rows, "rid long, r int, byear int, byear2 int, bdate int, place string, father string, dyear int, dplace string, sex string, pletters int, fletters int, dletters int, tokens array<string>")
    told, numbers = F.struct(*df.columns), F.struct("rid", *spellings._numbers())
    both = df.select(told.alias("a")).crossJoin(df.select(told.alias("b"))).filter("a.rid < b.rid and a.rid % 4 = b.rid % 4")
    points = F.when(F.col("a.rid") % 4 == 2, F.when(spellings.dates_agree(), 9.0).otherwise(-9.0)).otherwise(spellings.evidence())
    want = {tuple(r) for r in both.filter(points >= 2.5).select("a.rid", "b.rid").collect()}
    small = df.select(numbers.alias("a")).crossJoin(df.select(numbers.alias("b"))).filter("a.rid < b.rid and a.rid % 4 = b.rid % 4")
    met = small.filter(spellings.may_agree(2.5))
    got = {tuple(r) for r in met.select("a.rid", "b.rid").collect()}
    assert want <= got and len(want) > 50 and len(got) < small.count() * 2 / 3
    # without tests for null the JVM can compile it
    assert all(not f.nullable for f in df.select(numbers.alias("a")).schema["a"].dataType if f.name != "rid")


def test_a_written_table_leaves_no_shuffle_files(spark):
    from kinweave.plans.runtime import CLEANUP, cut

    def files():
        held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {held.apply(i).getName() for i in range(held.size()) if held.apply(i).getName().startswith("shuffle_")}

    before, setting = files(), spark.conf.get(CLEANUP, "false")
    assert cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()).count() == 7
    left = files() - before
    for _ in range(50):
        if len(left) <= 4:  # those of the count
            break
        time.sleep(0.1)
        left = files() - before
    assert not any(f.endswith(".data") for f in left if f in files()) or len(left) <= 4
    assert spark.conf.get(CLEANUP, "false") == setting


def test_words_sent_to_all_tasks_and_joined_words_give_the_same(spark, monkeypatch):
    rows = [(1, ["ivan", "horvat"], 1900, 19000101, "zagreb", None), (2, ["i.", "horvat"], 1900, 19000101, "zagreb", None), (3, ["horvat", "ivam"], 1900, None, "zagreb", None), (4, ["hor.", "i."], 1900, 19000101, None, None)]
    rows += [(5, ["jo", "kolar"], 1910, 19100101, "split", None), (6, ["josip", "kolar"], 1910, 19100101, "split", None), (7, ["josip", "ko", "lar"], 1910, None, "split", None), (8, ["kol."], 1910, 19100101, None, None), (9, ["kolar"], 1910, 19100101, None, None)]
    rows += [(10 + i, ["ana", "babic"], 1900 + i % 9, 19000101 + 10000 * (i % 9), "sisak", None) for i in range(80)] + [(90, ["ana", "babik"], 1903, None, "sisak", None), (91, ["ana", "babiic"], None, None, "sisak", None)]
    sent = _met(spark, rows, "match_entries")
    monkeypatch.setattr(spellings, "VOCABULARY", 0)
    assert _met(spark, rows, "match_entries") == sent and {(1, 2), (1, 4), (5, 6), (6, 7), (8, 9)} <= sent


def test_records_of_the_smaller_name_go_to_the_larger(spark):
    keys = spark.createDataFrame([(1, 0, 0, 7, 9, 1, 1), (1, 0, 0, 8, 2, 1, 2), (1, 0, 0, 9, 2, 1, 1)], name_keys.KEYS)
    got = {(r.x, r.y, r.y_years) for r in name_keys.pairs_of(keys, lambda t, u: t & u, 100).collect()}
    rows = name_keys.pairs_of(keys, lambda t, u: t & u, 100, 0).select(*name_keys.KEYS.replace(",", "").split()[::2]).filter("key is not null")
    assert got == {(8, 7, 1), (9, 7, 1), (8, 9, 1)}
    assert rows.count() in (0, 3) and {(r.x, r.y) for r in name_keys.joined_pairs(keys, lambda t, u: t & u, 100).collect()} == {(8, 7), (9, 7), (8, 9)}


def test_keys_are_exchanged_in_packs_of_few_bytes_a_row(spark):
    rng = random.Random(20)
    key = lambda: rng.randrange(-(2**63), 2**63)
    names = [(key(), rng.choice([1, 1, 1, 7]), rng.choice([1, 2, 3]), 1 << rng.randrange(60)) for _ in range(8000)]
    shared = [key() for _ in range(3000)]
    rows = [(rng.choice(shared) if k == 0 else key(), kind := rng.choice([0, 0, 0, 0, 1, 2]), 7 * kind, *name) for name in names for k in range(10)]
    keys = spark.createDataFrame(rows, name_keys.KEYS).coalesce(2)
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = written()
    got = {tuple(r) for r in name_keys.pairs_of(keys, lambda t, u: t & u, 100).select("x", "y", "heavy", "y_years", "sides").collect()}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert 0 < (written() - before) / len(rows) < 20
    assert got == {tuple(r) for r in name_keys.joined_pairs(keys, lambda t, u: t & u, 100).collect()} and len(got) > 100


def test_keys_of_many_names_are_handed_on_from_several_packs(spark, monkeypatch):
    rng = random.Random(21)
    rows = [(rng.choice([5, 6, 6, 6, 7]), 0, 0, k, 1, 1, 1 << (k % 8)) for k in range(60)]
    keys = spark.createDataFrame(rows, name_keys.KEYS).repartition(6)
    every = lambda met: {(r.x, r.y, r.y_years) for r in met.collect()}
    want = every(name_keys.pairs_of(keys, lambda t, u: t & u, 100))
    monkeypatch.setattr(name_keys, "PACK", 1)
    out = name_keys.pairs_of(keys, lambda t, u: t & u, 100, 20).cache()
    handed = out.filter("x is null").select("key", "kind", "stem", "nid", "n", "tabs", "years")
    assert {r.key for r in handed.collect()} == {6}
    assert every(out.filter("x is not null")) | every(name_keys.joined_pairs(handed, lambda t, u: t & u, 100)) == want and want
    out.unpersist()


def test_names_of_certificates_meet_where_their_dates_may_agree(spark):
    rng = random.Random(22)
    dates = [(None, None)] * 4 + [(y, None) for y in range(1900, 1906)] + [(y, y * 10000 + m) for y in range(1900, 1906) for m in rng.sample(range(101, 1231), 8)]
    one = lambda i: spark.createDataFrame([(k, y, d, "tuzla") for k, (y, d) in enumerate(dates)], "k int, byear int, bdate int, place string").select(F.struct("*").alias(i))
    both = one("a").crossJoin(one("b")).withColumn("fit", spellings.dates_agree())
    bits = lambda i: spellings.date_bits(f"{i}.byear", f"{i}.bdate")
    met = both.withColumn("met", bits("a").bitwiseAND(bits("b")) != 0).groupBy("fit", "met").count().collect()
    count = {(r.fit, r.met): r["count"] for r in met}
    assert (True, False) not in count and count[False, False] > 3 * count[False, True]
    # names whose certificates have other dates are not written as pairs
    rows = [(k * 4 + 2, k, ["ivan", w], 1, 1900, None, 19000100 + d, "tuzla", None, None, None, None, None, None, None) for k, (w, d) in enumerate([("horvat", 1), ("horvatt", 1), ("horvaat", 2), ("hoorvat", 3), ("horrvat", 4)])]
    records = spark.createDataFrame(rows, PERSON).withColumn("nid", F.xxhash64("tokens"))
    pairs = spellings.linked_names(records, spark.createDataFrame([], "s string, f string, weight long"), lambda t, u: t & u, F.col("mixed"))
    own = {r.rid: r.nid for r in records.collect()}
    found = {frozenset(r) for r in pairs.select("x", "y").collect()}
    assert frozenset((own[2], own[6])) in found and len(found) < 6


def test_years_on_both_sides_of_the_last_step_meet(spark):
    rows = [(1, ["ivan", "horvat"], 1965, None, "zagreb", "petar"), (2, ["ivan", "horvatt"], 1966, None, "zagreb", "petar")]
    assert _met(spark, rows, "export_xlsx") == {(1, 2)}
