import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import align, bins, components, personal, places, redact, set_join, soft_logic, text_forms, trie_join
from kinweave.llm.people import _tokens
from kinweave.llm.spell import plain, sound


def _union_find(pairs):
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in parent}


def test_groups_of_chains_rings_stars_and_cores(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 260)]
    pairs += [(300 + i, 300 + (i + 1) % 17) for i in range(17)] + [(400, i) for i in range(401, 440)]
    pairs += [(rng.randrange(500, 540), rng.randrange(500, 540)) for _ in range(60)] + [(700, 700), (800, 801), (801, 800), (800, 801)]
    rng.shuffle(pairs)
    df = spark.createDataFrame([(a, b, "x") for a, b in pairs] + [(1, None, "x"), (None, 2, None)], "x long, y long, label string")
    got = {r.vertex: r.group for r in components.connected_groups(df, "x", "y").collect()}
    assert got == _union_find(pairs)
    assert components.connected_groups(df.limit(0), "x", "y").count() == 0


def test_consistent_forms(spark):
    cases = {
        "M\u0430rko": "Marko", "Ivan\u200b": "Ivan", "C\u030c": "\u010c", "\uff24ragica": "Dragica", "a\u00a0b": "a b", "\u01c8ubica": "Ljubica",
        "\u00d0uro": "\u0110uro", "\u200b": "", "a\u0307\u0323": "\u1ea1\u0307",
    }
    same = ["Ćiro", "plain", "", None, "Здраво", "a" * 3_000]
    df = spark.createDataFrame([(v, 1) for v in [*cases, *same, *cases]], "value string, form int")
    got = {r.value: r.form for r in text_forms.consistent_forms(df, "value").collect()}
    assert got == cases
    long = "x" * 3_000 + "e\u0301"
    assert text_forms.consistent_forms(spark.createDataFrame([(long,)], "v string"), "v").first().form == "x" * 3_000 + "\u00e9"
    assert text_forms.consistent_forms(df.limit(0), "value").count() == 0


def _lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_trie_join_against_brute_force(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(4, 8))) for _ in range(160)})
    df = spark.createDataFrame([(w, 1) for w in words * 2] + [(None, 1), ("", 2)], "w string, b int")
    got = {(r.a, r.b): r.d for r in trie_join.trie_join(df, "w", whole=0).collect()}
    usable = [w for w in words if len(w) >= trie_join.MIN_LENGTH]
    brute = {(a, b): _lev(a, b) for a in usable for b in usable if a != b and _lev(a, b) <= 2}
    assert set(got) <= set(brute) and all(got[p] >= brute[p] for p in got)
    # one edit is met whenever an end of the words is untouched
    one = {(a, b) for (a, b), d in brute.items() if d == 1 and (a[:3] == b[:3] or a[-3:] == b[-3:])}
    assert one <= set(got)
    assert trie_join.trie_join(df.limit(0), "w").count() == 0


def test_folding_is_the_same_in_both_places(spark):
    texts = ["Ћирило Марковић", "Ｄragica Čavić", "Turarich", "tschWy", "Ðuro", "ЈOVO Jovа"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", sound(plain(F.col("t"))).alias("s")).collect():
        assert _tokens(r.t) == [w for w in r.s.split(" ")]


def test_set_join_against_brute_force(spark):
    rng = random.Random(3)
    make = lambda n: [(f"{n}{i}", [rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 7))]) for i in range(60)]
    a, b = make("l"), make("r")
    schema = "id string, tokens array<string>, left_len int"
    df = lambda rows: spark.createDataFrame([(i, t, 9) for i, t in rows] + [(None, ["a"], 1), ("n", None, 1)], schema)
    got = {(r.left_id, r.right_id) for r in set_join.similar_sets(df(a), df(b), 0.5).collect()}
    want = {(i, j) for i, x in a for j, y in b if x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.5}
    assert got == want


def test_places(spark):
    refs = spark.createDataFrame([(1, "Devlošina", None), (2, "Stara Lipa", "Altlinde; Linde"), (3, "Stara Glava", None)], "ref_id long, ref_name string, alt_names string")
    want = {"u Devlošini": 1, "Devloši.": 1, "DEVLOSINA, logor": 1, "Devlšoina": 1, "St. Lipa": 2, "Altlinde": 2, "Lipa, Stara": 2, "kod kuće": 0, "?": 0, "x" * 3000: 0, "": 0}
    df = spark.createDataFrame([(k, "r") for k in want] + [(None, "r")], "value string, ref_id string")
    assert {r.value: r.ref_id for r in places.map_values(df, refs).collect()} == want
    assert {r.ref_id for r in places.map_values(df, refs.limit(0)).collect()} == {0}


def test_soft_logic(spark):
    up, down = (True, 1.0, 6.0), (False, 0.0, 2.0)
    pairs = spark.createDataFrame([(1, [up, down]), (2, [(True, 1.0, 4.0), down]), (3, [down])], "p long, rules array<struct<up:boolean,s:double,w:double>>")
    none = spark.createDataFrame([], "p long, q long, sign double, c double, w double")
    free = {r.p: r.y for r in soft_logic.solve(pairs, none, 10).collect()}
    assert free[1] == pytest.approx(0.75, abs=0.06) and free[2] == pytest.approx(0.667, abs=0.06) and free[3] == pytest.approx(0, abs=0.06)
    apart = spark.createDataFrame([(2, 1, 1.0, 1.0, 5.0)], none.schema)
    y = {r.p: r.y for r in soft_logic.solve(pairs, apart, 14).collect()}
    # minimum of 6(1-a)^2 + 2a^2 + 4(1-b)^2 + 2b^2 + 5(a+b-1)^2
    grid = np.linspace(0, 1, 401)
    a, b = np.meshgrid(grid, grid)
    f = 6 * (1 - a) ** 2 + 2 * a**2 + 4 * (1 - b) ** 2 + 2 * b**2 + 5 * np.maximum(0, a + b - 1) ** 2
    at = np.unravel_index(f.argmin(), f.shape)
    assert (y[1], y[2]) == pytest.approx((a[at], b[at]), abs=0.06)


def test_leaks(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(400)}" for _ in range(120)]
    passage = words[20:60]
    edited = [w if k % 13 else "other" for k, w in enumerate(passage)]
    docs = [(1, "intro \\textbf{" + " ".join(passage[:20]) + "}\n% " + " ".join(passage[20:]) + " end"), (2, " ".join(edited).upper()), (3, " ".join(words[:12])), (4, None), (5, ""), (6, "z " * 2_000)]
    d = spark.createDataFrame([(*x, "k") for x in docs], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(9, " ".join(words)), (10, None)], "item_id long, item_text string")
    got = {r.doc_id for r in align.leaks(d, items).filter(f"span >= {align.MIN_SPAN} and met >= {align.MIN_MATCHED}").collect()}
    assert got == {1, 2}
    # the same by a join of seeds
    more = items.unionAll(spark.createDataFrame([(11, "q1 q2 q3 " * 30)], items.schema))
    assert {r.doc_id for r in align.leaks(d, more, whole_words=0).filter(f"span >= {align.MIN_SPAN} and met >= {align.MIN_MATCHED}").collect()} == {1, 2}
    assert align.leaks(d, items.limit(0)).count() == 0


def test_packing(spark):
    rng = np.random.default_rng(5)
    sizes = np.column_stack([rng.integers(1, 1500, 400), np.ones(400), rng.integers(0, 900, 400)]).astype(float)
    cap = np.array([2048.0, 6.0, 1500.0])
    where = bins.pack(sizes, cap)
    used = np.zeros((where.max() + 1, 3))
    np.add.at(used, where, sizes)
    assert (used <= cap + 1e-6).all() and (where >= 0).all()
    assert used[:, 0].sum() / (len(used) * 2048) > 0.85
    rows = [(i, 0, 1, 0, int(t), int(t)) for i, t in enumerate(sizes[:, 0])] + [(999, 0, 1, 0, 0, 0), (5, 0, 1, 0, 7, 7)]
    df = spark.createDataFrame(rows, "doc_id long, part int, n_parts int, first_token int, tokens int, loss_tokens int")
    out = bins.packed(df, block=64)
    assert out.count() == len(rows) and out.groupBy("container").agg(F.sum("tokens").alias("t")).agg(F.max("t")).first()[0] <= 2048
    assert bins.packed(df.limit(0)).count() == 0


@pytest.mark.parametrize("sizes,fit", [([1000, 1, 0], 2), ([10, 1, 0], 24), ([700, 1, 700], 2)])
def test_each_limit_binds(sizes, fit):
    """Equal items: tokens, segments and loss-bearing tokens each decide how many go into a container."""
    where = bins.pack(np.array([sizes] * 48, float), np.array(bins.CAPACITY, float))
    assert np.bincount(where).max() == fit and np.bincount(where).sum() == 48


def test_parts_respect_all_limits():
    assert bins.parts_of(0, 0, (10, 9, 6)) == [(0, 0)] and bins.parts_of(8, 3, (10, 9, 6)) == [(0, 8)]
    assert bins.parts_of(20, 3, (10, 9, 6)) == [(0, 9), (9, 15), (15, 20)]


def test_sized_texts(spark):
    docs = spark.createDataFrame([(1, "a short text", "x"), (2, "word " * 5000, "x"), (3, None, None), (4, "", "x"), (5, "\\documentclass{a}\\begin{document}body", "x")], "doc_id long, text string, tokens string")
    got = {}
    for r in bins.sized_texts(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[2]) == 3 and sum(r.tokens for r in got[2]) >= 5000 and max(r.tokens for r in got[2]) == bins.CAPACITY[2]
    assert [r.first_token for r in got[2]] == [0, bins.CAPACITY[2], 2 * bins.CAPACITY[2]]
    assert got[3][0].tokens == got[4][0].tokens == 0 and 0 < got[5][0].loss_tokens < got[5][0].tokens


TEXT = r"""\author{Clara Levin \and Clara Marin \and Ivo Sand \and Ivo Kern}
We thank Clara Br\v{e}vtz and Kern, Ivo; K. Undessen helped at 348 K. Unless it rains.
Mail clara\_b (at) lab dot uni dot example or J.Doe@x.example, phone +44~1632~960~504 or four two zero.
Passport QQ 53 18 38 B, row 000343/0027, Marnowstra\ss e 11, 99B Hesperin Square. Batch 042-086-0087, ISBN 978-0-78-00057-13.
\begin{thebibliography}{9}\bibitem{a} Clara Book, 2001.\end{thebibliography}"""


def test_personal_data(spark):
    docs = spark.createDataFrame([(1, TEXT, "k"), (2, None, "k"), (3, "", "k"), (4, "no data " * 9000, None)], "doc_id long, text string, pii_type string")
    rows = personal.occurrences(docs).collect()
    found = {(r.pii_type, TEXT[r.start_char : r.end_char]) for r in rows}
    assert {k for k in found if k[0] == "name"} == {("name", r"Clara Br\v{e}vtz"), ("name", "Kern, Ivo"), ("name", "K. Undessen")}
    assert {k for k in found if k[0] == "email"} == {("email", r"clara\_b (at) lab dot uni dot example"), ("email", "J.Doe@x.example")}
    assert ("phone", "+44~1632~960~504") in found and {v for k, v in found if k == "id_number"} == {"QQ 53 18 38 B", "000343/0027"}
    assert {v for k, v in found if k == "address"} == {r"Marnowstra\ss e 11", "99B Hesperin Square"}
    assert len([1 for k, _ in found if k == "phone"]) == 1


def test_reading_maps_back():
    read = redact.Reading(r"a\,(at)\,b Br\v{e}v zero one ​x")
    assert read.text == "a@b Brěv 01 x"
    at = read.text.index("01")
    assert read.start(at) == r"a\,(at)\,b Br\v{e}v zero one ​x".index("zero")
