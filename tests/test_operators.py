"""Functions and operators of the core against small cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lontar.functions import arrays as X
from lontar.functions import dates as D
from lontar.functions import text as T
from lontar.operators import aggregates as A
from lontar.operators import gates as Q
from lontar.operators import graph as P
from lontar.operators import guards as G
from lontar.operators import joins as J
from lontar.operators import retrieval as R
from lontar.operators import similarity as S
from lontar.operators import windows as O


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    return [r[0] for r in df.select(column(F.col("s"))).collect()]


@pytest.mark.parametrize("word, stem", [("menanam", "tanam"), ("ditanam", "tanam"), ("menumbuhkan", "tumbuh"), ("memukul", "pukul"), ("menyapu", "sapu"), ("mengambil", "ambil"), ("kitab", "kitab"), ("seia", "seia"), ("bersabar", "sabar")])
def test_stem(spark, word, stem):
    assert one(spark, T.stem, word) == [stem]


def test_affix_forms(spark):
    got = one(spark, T.affix_forms, "pekerjaanku", "ketakutan", "ruangan")
    assert "kerja" in got[0] and "takut" in got[1] and "uang" not in got[2]


def test_text_functions(spark):
    assert one(spark, T.norm, " A-b!  Č٣\n") == ["a-b č٣"]
    assert one(spark, T.refs, "lihat 2:7, 02.07 dan 114:1; 1234:5 x2:3", None) == [["2:7", "114:1"], None]
    assert one(spark, lambda c: T.strict_refs(c), "QS 2:7 dan 3:4; jam 12:30" + " " * 60 + "99:1") == [["2:7", "3:4", "12:30"]]
    assert one(spark, T.markers, "x [H:a-b:3] [H:a-b:3] [H:c:4]") == [["a-b/3", "c/4"]]
    assert one(spark, T.without_markers, "kata [H:a:1] lagi [H:b:2]") == ["kata lagi"]
    assert one(spark, T.clean_markup, "<p>a<br/>b</p>&nbsp;&amp;c") == ["a b &c"]
    assert one(spark, T.slugify, "--Zakat & Toloh!") == ["zakat-toloh"]
    assert one(spark, lambda c: T.cut_at_word(c, 8), "satu dua tiga", "satu") == ["satu…", "satu"]
    assert one(spark, lambda c: T.one_line(c, 6), "a \n b", "abcdefgh") == ["a b", "abcde…"]
    assert one(spark, lambda c: T.time_label(c.cast("double")), "59.9", "3600", "3725.2") == ["0:59", "1:00:00", "1:02:05"]
    assert one(spark, T.arabic_fold, "ٱلْكِتَـٰبُ أة") == ["الكتب اه"]
    assert one(spark, lambda c: T.latin_fold(c), "Āl-‘Imrān", None) == ["al‘imran", None]
    assert one(spark, T.strip_inline_markdown, "**a** [b](c) `d`") == ["a b d"]
    assert one(spark, T.list_or_lines, '["a","b"]', "- a\n2. b, c") == [["a", "b"], ["a", "b", "c"]]
    assert one(spark, lambda c: T.first_int(c, "$.n"), '{"n": 4}', "about 17 of 20", "none") == [4, 17, None]
    assert one(spark, lambda c: T.tolerant_json(c, "k int").k, 'so: {"k": 3} end', "{broken") == [3, None]
    assert one(spark, T.sentences, "A b. C!\nd?? ") == [["A b", "C", "d"]]
    assert one(spark, lambda c: F.array_join(T.paragraphs(c), ""), "a\n\nb\n\n\nc\n") == ["a\n\nb\n\n\nc\n"]
    assert one(spark, lambda c: T.title_echo(F.lit("Keutamaan Surah Fatihah"), c), "inilah keutamaan fatihah surah", "lain") == [True, False]
    h = 0
    for ch in "halo":
        h = (h * 31 + ord(ch)) & 0xFFFFFFFF
    assert one(spark, lambda c: T.variant_index(c, 7), "halo", "") == [abs(h - (1 << 32) if h >> 31 else h) % 7, 0]


def test_more_text_functions(spark):
    df = spark.createDataFrame([("sabar", "sabarlah"), ("sab", "sabar"), ("sab", "sab")], "a string, b string")
    assert [r[0] for r in df.select(T.stem_reach(F.col("a"), F.col("b"))).collect()] == [True, False, True]
    assert one(spark, lambda c: T.linkify(c, "/q"), "2:7, 1:2:3 (4:5)") == ["[2:7](/q/2/7), 1:2:3 ([4:5](/q/4/5))"]
    assert one(spark, lambda c: T.outside_phrases(c, ["a b", "c d"]), "a b c c d d x") == [["x"]]
    deep = "a " * 6 + "b " * 6 + "x"  # six rounds
    assert one(spark, lambda c: T.outside_phrases(c, ["a b"]), deep, None) == [["x"], None]
    assert one(spark, T.failure_class, "Deadline exceeded", "HTTP 429", "x") == ["timeout", "limited", "other"]
    strip = lambda c: T.without_formula(c, "بسم الله", F.lit(True), F.lit(False))
    assert one(spark, strip, "بِسْمِ ٱلله قل هو") == ["قل هو"]
    with pytest.raises(Exception, match="no formula"):
        one(spark, strip, "قل هو الله")
    m = spark.createDataFrame([({"a": "x", "b": "y", "c": "x"},)], "m map<string,string>").select(X.invert(F.col("m"))).first()[0]
    assert [(r.value, r["keys"] if "keys" in r.asDict() else None) for r in m] == [("x", ["a", "c"]), ("y", ["b"])]
    n = spark.createDataFrame([("v10",), ("v9",), ("v9.2",)], "s string")
    assert [r[0] for r in n.orderBy(X.natural_key(F.col("s"))).collect()] == ["v9", "v9.2", "v10"]


def test_embed_checks_the_model(spark):
    t = spark.createDataFrame([(i, f"teks {i}") for i in range(70)], "k int, text string")
    model = lambda texts: [[float(len(x))] for x in texts]
    done = R.embed(t, "k", "text", model)
    assert done.count() == 70 and R.embed(t, "k", "text", model, done.where("k < 60")).count() == 10
    with pytest.raises(Exception, match="vectors for"):
        R.embed(t, "k", "text", lambda texts: model(texts)[1:]).collect()


def test_jaccard_empty_value(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(T.jaccard(F.col("a"), F.col("b"), 0.0)).collect()] == [1 / 3, 0.0]
    assert [r[0] for r in df.select(T.jaccard(F.col("a"), F.col("b"))).collect()] == [1 / 3, 1.0]


def test_nearest_rank(spark):
    r = random.Random(1)
    rows = [(g, float(r.choice([r.random(), 0.5]))) for g in ("a", "b", None) for _ in range(3000)] + [("c", 1.0), ("c", None), ("d", None)]
    got = {x.g: x for x in A.nearest_rank(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", [0, 50, 90, 100]).collect()}
    for g in ("a", "b", "c", None):
        v = sorted(x for k, x in rows if k == g and x is not None)
        for q in (0, 50, 90, 100):
            assert got[g][f"p{q}"] == v[min(len(v) - 1, q * len(v) // 100)], (g, q)
    assert "d" not in got


def test_arg_max_votes_lift(spark):
    df = spark.createDataFrame([("k", "a", 2, 1), ("k", "b", 2, 2), ("m", "a", 1, 3), ("m", "c", 5, 4)], "k string, v string, s int, p int")
    assert {r.k: r.v for r in A.arg_max_or_none(df, ["k"], "v", ["s"]).collect()} == {"k": None, "m": "c"}
    assert {r.k: r.v for r in A.votes(df, ["k"], "v", "p").collect()} == {"k": "a", "m": "a"}
    arms = spark.createDataFrame([("x", "t", True), ("x", "c", False), ("y", "t", True)], "g string, arm string, ok boolean")
    assert {r.g: (r.lift, r.verdict) for r in A.arm_lift(arms, ["g"], "arm", F.col("ok"), "t", "c").collect()} == {"x": (1.0, "strong"), "y": (None, "unknown")}
    n = spark.createDataFrame([(math.nan,), (math.inf,), (2.5,), (None,)], "x double")
    assert [r[0] for r in n.select(A.whole(F.col("x"))).collect()] == [None, None, 3, None]
    assert [r[0] for r in n.select(A.clamp(F.col("x"), 0.0, 1.0)).collect()] == [0.0, 0.0, 1.0, 0.0]


def test_carry_is_independent_of_buckets(spark):
    r = random.Random(2)
    rows = [(r.choice([1, 2, None]), t, r.choice([None, None, t])) for t in r.sample(range(500), 200)]
    df = spark.createDataFrame(rows, "k int, t int, v int")
    for forward in (True, False):
        want = set()
        for k, t, v in rows:
            near = [(x, w) for q, x, w in rows if q == k and w is not None and (x <= t if forward else x > t)]
            want.add((k, t, (max(near) if forward else min(near))[1] if near else None))
        for size in (7, 1000):
            got = {(x.k, x.t, x.near) for x in O.carry(df, ["k"], ["t"], F.floor(F.col("t") / size), F.col("v"), "near", forward).collect()}
            assert got == want


def test_windows(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 1), ("c", None)], "g string, n int")
    assert {r.g: r.first_break for r in O.first_break(df, ["g"], "n").collect()} == {"a": 3, "b": None, "c": 1}
    r = spark.range(100).select((F.col("id") % 3).alias("g"), ((F.col("id") * 37) % 100).alias("x"))
    for size in (5, 1000):
        got = {(a.g, a.x): a["rank"] for a in O.ranked(r, ["g"], [F.col("x")], F.floor(F.col("x") / size)).collect()}
        assert all(n == 1 + sum(1 for (h, y) in got if h == g and y < x) for (g, x), n in got.items())
    b = O.stable_boost(O.ranked(r, ["g"], [F.col("x")], F.floor(F.col("x") / 9)), ["g"], F.col("x") > 90, "rank", size=4).where("g = 0").orderBy("new_rank").collect()
    assert [a.new_rank for a in b] == list(range(1, len(b) + 1)) and [a.x > 90 for a in b] == sorted([a.x > 90 for a in b], reverse=True)
    t = spark.createDataFrame([(1, 1, 3), (1, 4, 9), (1, 11, 12)], "k int, s int, e int")
    assert [r.s for r in O.tile_breaks(t, ["k"], "s", "e").collect()] == [11]
    assert [r.end for r in O.tile_ends(t, ["k"], "s", F.lit(20), "end").orderBy("s").collect()] == [3, 10, 20]
    assert [r.o for r in O.offsets(t, ["k"], ["s"], "e", "o").orderBy("s").collect()] == [0, 3, 12]


def test_folds(spark):
    df = spark.createDataFrame([("Satu dua. Tiga empat lima, enam tujuh. Delapan.",), ("kata " * 30,), ("x" * 50,), ("",)], "s string")
    got = [r.p for r in df.select(O.pack_bytes(F.col("s"), 26).alias("p")).collect()]
    assert [p.level for p in got] == ["clause", "word", "none", "sentence"] and all(len(x) <= 26 for p in got if p.parts for x in p.parts)
    assert " ".join(got[1].parts) == ("kata " * 30).strip()
    items = spark.createDataFrame([([Row(s=5), Row(s=50), Row(s=6), Row(s=4), Row(s=1), Row(s=1)],)], "l array<struct<s:bigint>>")
    assert items.select(O.budget_select(F.col("l"), "s", 3, 20, 10)).first()[0] == ["taken", "too-long", "over-budget", "taken", "taken", "over-max"]
    assert items.select(O.batch_numbers(F.col("l.s"), 10)).first()[0] == [0, 1, 2, 2, 3, 3]
    ranked = spark.createDataFrame([([Row(id=1, themes=["a", "b"]), Row(id=2, themes=["a"]), Row(id=3, themes=["b", "c"]), Row(id=4, themes=["c"])],)], "l array<struct<id:bigint,themes:array<string>>>")
    assert [tuple(x) for x in ranked.select(O.diversify(F.col("l"), 3)).first()[0]] == [(1, "a"), (3, "b"), (4, "c")]


def test_joins(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, None), (4, "d")], "k int, v string")
    assert {(r.k, r.state) for r in J.drift(old, new, ["k"], "v").collect()} == {(1, "missing"), (2, "changed"), (4, "unexpected")}
    assert {r.k for r in J.missing(old, new, ["k"]).collect()} == {1}
    with pytest.raises(Exception, match="no parent"):
        J.strict_join(old, new.withColumnRenamed("v", "w"), ["k"], "old").collect()
    r = J.expand(spark.createDataFrame([(3, 5), (5, 3), (None, 2)], "a int, b int"), "a", "b", "i").collect()
    assert [x.i for x in r] == [3, 4, 5]
    pairs = spark.createDataFrame([(1, None), (2, 7), (2, 7), (3, 7), (3, 8)], "k int, c int")
    assert {x.k: (x.resolution, x.match) for x in J.resolve(pairs, "k", "c").collect()} == {1: ("none", None), 2: ("match", 7), 3: ("ambiguous", None)}


def test_nearest_blocks(spark):
    g = np.random.default_rng(1).standard_normal((60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(g)], "id bigint, v array<double>")
    q = df.where("id < 5").select(F.col("id").alias("q_id"), F.col("v").alias("q_vec"))
    for cells in (16, 1_000_000):
        got = {(r.q_id, r.rank): r.b_id for r in J.nearest(q, df.select(F.col("id").alias("b_id"), F.col("v").alias("b_vec")), 3, cells).collect()}
        assert got == {(i, k + 1): int(np.argsort(-(g @ g[i]), kind="stable")[k]) for i in range(5) for k in range(3)}


def test_longest_runs_against_dynamic_programming(spark):
    r = random.Random(3)
    a = [(i, " ".join(r.choice("abcd") for _ in range(r.choice([0, 2, 12, 30])))) for i in range(8)]
    b = [(i, " ".join(r.choice("abcd") for _ in range(r.choice([0, 2, 12, 30])))) for i in range(8)]
    got = {(x.q, x.t): x.run for x in S.longest_runs(spark.createDataFrame(a, "q int, text string"), "q", spark.createDataFrame(b, "t int, text string"), "t", T.words_of(F.col("text")), 3).collect()}
    want = {(i, j): T.longest_run(x.split(), y.split()) for i, x in a for j, y in b}
    assert got == {k: v for k, v in want.items() if v >= 3} and got


def test_gates_report_all(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 1, ""), (1, 3, "b"), (2, 1, None)], "g int, n int, s string")
    v = Q.run_all(Q.unique("u", df, ["g", "n"]), Q.contiguous("c", df, ["g"], "n"), Q.rows("e", df, F.col("s") == "", F.col("n")), Q.orphans("o", df, spark.createDataFrame([(1,)], "g int"), ["g"]), Q.permutation("p", df.select("n"), "n"), Q.exactly("x", df, ["g"], F.col("n") == 1, 1), Q.at_least("l", df, ["g"], "s", 1), Q.constants("k", df.agg(F.count("*").alias("rows")), {"rows": 5}))
    got = {(r.gate, r.detail) for r in v.collect()}
    assert {g for g, _ in got} == {"u", "c", "e", "o", "p", "x", "l", "k"}
    with pytest.raises(Q.IntegrityError, match="u: 1:1 x2"):
        Q.require(v)
    Q.require(v.limit(0))
    with pytest.raises(Q.IntegrityError) as e:
        Q.require(Q.rows("many", spark.range(60), F.lit(True), F.col("id")))
    assert len(str(e.value).splitlines()) == 61


def test_guards(spark):
    assert one(spark, lambda c: G.foreign_script(c, "ﷺ"), "kata ﷺ", "kata كتاب") == [False, True]
    assert one(spark, lambda c: F.size(G.verdict_sentences(c, ["wajib"], ["mungkin"])), "Ini wajib. Mungkin wajib. Tidak.") == [1]
    assert one(spark, lambda c: F.size(G.unbacked_attributions(c, ["menurut"])), "Menurut dia begitu. Menurut 2:7 begini! Lain.") == [1]
    near, quotes = G.proximity(["allah"], ["berfirman"], ["nabi"]), G.attributed_quotes(["firman"])
    assert one(spark, lambda c: near(c), "Allah telah berfirman", "Nabi allah berfirman", "Allah dan nabi berfirman", "Allah " + "x " * 60 + "berfirman", None) == [True, False, False, False, False]
    assert one(spark, lambda c: quotes(c), 'Firman: "a b c d e f g h"', '"a b c d e f g h" (2:7)', '"a b c d e f g h"', 'Firman "a b"') == [1, 1, 0, 0]
    assert one(spark, lambda c: G.first_cue(c, ["b c", "a"]), "a b c", "a", "z") == ["b c", "a", None]
    assert one(spark, lambda c: G.reasons(("x", c == "a"), ("y", c != "b")), "a", "b") == ["x + y", None]


def test_excise():
    def guard(t):
        return [("bad", w) for w in ("X", "Y") if w in t]

    assert G.excise("a\n\nb", guard) == ("a\n\nb", 0)
    assert G.excise("a\n\nX b\n\nc\n\nY", guard) == ("a\n\nc", 2)
    assert G.excise("X only", guard) == (None, 0)
    assert G.excise("X\n\nY", guard) == (None, 0)
    same = lambda t: [("many", "X")] if "X" in t else []
    assert G.excise("a\n\nX1\n\nX2", same) == ("a", 2)
    assert G.excise("a\n\nX1\n\nX2\n\nX3", same) == (None, 0)
    assert G.excise("\n\n".join(["X"] * 61), guard) == (None, 0)


def test_budgets_and_outcomes(spark):
    df = spark.createDataFrame([(0, 25_000), (0, 24_499), (1, 11_499), (1, 11_500), (2, 20_000), (0, 0)], "a int, r int")
    assert [r[0] for r in df.select(G.attempt_budget(F.col("a"), F.col("r"))).collect()] == [13_500, 24_499, None, 11_500, None, None]
    runs = spark.createDataFrame([([Row(ms=5, outcome="refused"), Row(ms=5, outcome="ok")],), ([Row(ms=50, outcome="ok")],), ([],)], "l array<struct<ms:bigint,outcome:string>>")
    assert [r[0] for r in runs.select(G.outcome(F.col("l"), 20)).collect()] == ["ok", "timeout", "none"]


def test_graph(spark):
    c = spark.createDataFrame([("v1", "s", "a"), ("v1", "s", "a"), ("v1", None, "b"), ("v2", "t", "b"), ("v2", "t", "c"), ("v1", "u", "c")], "v string, m string, g string")
    assert {(r.v, r.g): r.bridge for r in P.bridges(c, "v", "g").collect()}[("v1", "a")] == ["b", "c"]
    assert {(r.a, r.b): r.n for r in P.bonds(c, "v", "g").collect()} == {("a", "b"): 1, ("a", "c"): 1, ("b", "c"): 2}
    assert {(r.kind, r.source, r.target) for r in P.edges(c, "v", "m", "g").collect()} >= {("cited_in", "v1", "b"), ("in_category", "s", "a")}
    e = spark.createDataFrame([("p", "span", "a span here", 0.5), ("q", "span", "a span here", 0.5), ("p", "none", "a span", 0.5), ("p", "a", "a", 1.5)], "predicate string, span string, text string, confidence double")
    assert P.valid_edges(e, ["p"], "text", "span").count() == 1
    w, links = np.array([30.0, 18.0, 18.0]), [(0, 1, 120.0), (0, 2, 120.0)]
    a, b = P.layout(w * 100, links), P.layout(w * 100, links)
    assert (a == b).all() and abs(np.linalg.norm(a, axis=1).max() - 1000) < 2


def test_solar(spark):
    df = spark.createDataFrame([("2024-03-20", -6.2, 106.8, 8.0, 420), ("2024-06-21", 70.0, 25.0, 0.0, 120)], "d string, lat double, lon double, m double, o int").withColumn("day", F.to_date("d"))
    a, b = D.with_day_times(df, "day", "lat", "lon", "m", "o").orderBy("d").collect()
    assert a.dawn < a.sunrise < a.noon < a.afternoon < a.sunset < a.night and abs(a.noon - 720) < 10 and abs(a.sunset - a.sunrise - 727) < 4
    assert b.sunrise is None and b.dawn is None and b.noon is not None
    x = spark.createDataFrame([("2000-01-01",)], "d string").select(D.julian_day(F.to_date("d"), F.lit(12))).first()[0]
    assert x == 2451545.0


def test_retrieval(spark):
    q = spark.createDataFrame([(1, "apakah rumah tanggaku sabar", "2:7"), (2, "sabar", None)], "q_id bigint, text string, ref string")
    lex = spark.createDataFrame([("keluarga", "rumah tangga"), ("sabar", "sabar")], "theme string, term string")
    assert {(r.q_id, r.theme) for r in R.lexicon_hits(q, lex).collect()} == {(1, "keluarga"), (1, "sabar"), (2, "sabar")}
    rows = spark.createDataFrame([(10, "x sabar", "2:7"), (11, "rumah tanggaku apakah", None), (12, "apakah rumah tanggaku", None)], "row_id bigint, text string, ref string")
    themes = spark.createDataFrame([(11, "keluarga"), (11, "sabar")], "row_id bigint, theme string")
    got = {(r.q_id, r.row_id): r.score for r in R.score_rows(q, R.lexicon_hits(q, lex), rows, themes, [], 5).collect()}
    # apakah and tanggaku count two each; rumah is a word of the theme's term and has scored with it
    assert got == {(1, 10): 102, (1, 11): 14, (2, 11): 10}
    told = spark.createDataFrame([(2, "keluarga"), (1, "keluarga")], "q_id bigint, theme string")
    more = {(r.q_id, r.row_id): (r.score, r.theme) for r in R.score_rows(q, R.lexicon_hits(q, lex), rows, themes.unionByName(spark.createDataFrame([(12, "keluarga")], themes.schema)), [], 5, told).collect()}
    # a theme that only the model named gives ten points; one the question names itself goes first
    assert more == {(1, 10): (102, None), (1, 11): (14, "keluarga"), (1, 12): (14, "keluarga"), (2, 11): (10, "sabar"), (2, 12): (10, "keluarga")}
    cues = spark.createDataFrame([("a", "satu"), ("b", "dua"), ("b", "tiga")], "area string, cue string")
    t = spark.createDataFrame([(1, "dua satu"), (2, "satu dua tiga"), (3, "lain")], "k int, text string")
    assert {r.k: r.area for r in R.cue_router(t, "k", "text", cues).collect()} == {1: "b", 2: "b"}


@pytest.mark.parametrize("block", [1, 2, 3, 64])
def test_pair_counts_of_large_sets(spark, block):
    from collections import Counter
    from itertools import combinations

    from lontar.operators.pairs import pair_counts

    sets = [list("abcdefg"), list("abcdefg"), list("abcdefg"), ["a", "a", "g"], ["x", None], [], None, list("gfa")]
    want = Counter(p for s in sets for p in combinations(sorted({x for x in s or [] if x}), 2))
    assert {(r.a, r.b): r.n for r in pair_counts(spark.createDataFrame([(s, 1) for s in sets], "items array<string>, n int"), block=block).collect()} == dict(want)


@pytest.mark.parametrize(
    "message, form, surah, ayah, name",
    [("18:10", "bare", 18, 10, None), (" 18 . 10 ", "bare", 18, 10, None), ("bangun jam 2:30 pagi", "none", None, None, None), ("jam QS 2:30", "marked", 2, 30, None), ("Surat 18 ayat 10", "worded", 18, 10, None), ("surah yasin ay. 3", "named", None, 3, "yasin"), ("al-kahfi", "named", None, None, "al-kahfi"), ("", "none", None, None, None), (None, "none", None, None, None), ("apa kabar 5", "none", None, None, None)],
)
def test_written_ref(spark, message, form, surah, ayah, name):
    r = one(spark, lambda c: T.written_ref(c), message)[0]
    assert (r.form, r.surah, r.ayah, r.name) == (form, surah, ayah, name)


def test_leaks_and_lossless_sentences(spark):
    assert one(spark, T.english_leak, "ini The end", "thea bathe", "kata (WHO)", None, "") == ["the", None, "who", None, None]
    texts = ["Satu. Dua!  “Tiga.” [H:b:1] [H:c:2]\nempat", "", "\n\n", "tanpa akhir", "a." * 500]
    for t, pieces in zip(texts, one(spark, T.lossless_sentences, *texts), strict=True):
        assert "".join(pieces) == t
    assert one(spark, T.lossless_sentences, texts[0])[0][2] == "“Tiga.” [H:b:1] [H:c:2]\n"


def test_reports_of_empty_tables(spark):
    r = A.answer_report(spark.createDataFrame([], "case_id int, observed string, expect string, n_grounds int, groundedness int, fidelity int, humility int, flags array<string>")).first()
    assert r.n == 0 and r.groundedness is None and r.defer_breaches == 0
    rows = [(1, "answered", "answered", 1, 4, 5, 5, []), (2, "repaired", "defer", 0, 2, 3, 2, None), (3, "deadline", "fallback", None, None, None, None, ["ruling-issued"]), (4, None, None, 1, 0, 0, 0, None)]
    r = A.answer_report(spark.createDataFrame(rows, "case_id int, observed string, expect string, n_grounds int, groundedness int, fidelity int, humility int, flags array<string>")).first()
    assert (r.n, r.shipped, r.ungrounded, r.scorable, r.matched, r.judged, r.groundedness, r.grounding_breaches, r.defer_breaches, r.ruling_watch) == (4, 2, 2, 2, 1, 2, 3.0, 1, 1, 1)
    f = A.framing_report(spark.createDataFrame([("a", [True]), ("a", [False, True]), ("a", []), ("a", None), ("b", [None, False])], "k string, attempts array<boolean>"), "k").orderBy("k").collect()
    assert [tuple(x) for x in f] == [("a", 4, 1, 2, 2), ("b", 1, 0, 0, 1)]


def test_retrying_model():
    from lontar.operators.retrieval import retrying

    calls = []

    def model(texts):
        calls.append(texts)
        if len(calls) < 3:
            raise OSError("busy")
        return [[1.0]] * len(texts)

    assert retrying(model, 5, 0)(["a"]) == [[1.0]] and len(calls) == 3
    with pytest.raises(OSError):
        retrying(lambda t: (_ for _ in ()).throw(OSError("down")), 2, 0)(["a"])
