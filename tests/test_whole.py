"""Queries on small inputs whose answer a cut would lose."""

import random

import pytest

import __spark_entry__ as entry
from lontar.operators import retrieval as R

DOCS = "doc_id bigint, source string, kind string, text string, ref string, n_chars bigint"
ITEMS = "item_id bigint, text string, ref string"


def run(spark, d, name, **tables):
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{d}/{t}.parquet")
    return entry.queries()[name](spark, str(d)).collect()


def docs(*texts, source="s"):
    return [(i, source, "k", t, None, len(t)) for i, t in enumerate(texts)]


def test_rare_is_a_share_of_the_texts(spark, tmp_path):
    texts = ["kolam teratai biru"] * 10 + ["lebar tanaman merah"] * 13 + ["lain"] * 977
    got = run(spark, tmp_path, "echo_rare_terms", documents=(docs(*texts), DOCS), eval_items=([(1, "kolam teratai biru", None), (2, "lebar tanaman merah", None)], ITEMS))
    assert sorted((r.item_id, r.doc_id, r.hit, r.rare) for r in got) == [(1, i, 3, 3) for i in range(10)]


def test_questions_without_rare_words_keep_their_top_two(spark, tmp_path):
    rows = [(i, f"s{i % 5}", "k", t, None, 1) for i, t in enumerate(["air"] * 5 + ["air laut"] * 5 + ["air laut emas"])]
    got = run(spark, tmp_path, "lexical_top2", documents=(rows, DOCS), eval_items=([(1, "air laut", None), (2, "laut emas", None), (3, "tiada", None)], ITEMS))
    assert sorted((r.q_id, r.rank, r.doc_id, r.score) for r in got) == [(1, 1, 5, 2), (1, 2, 6, 2), (2, 1, 10, 1)]


ENTRIES = "entry_id bigint, slug string, verse string, text string"


def test_index_and_route_use_every_category(spark):
    e = [(i, f"c{i:02}", f"1:{i}", "samudra") for i in range(14)] + [(20 + i, f"c{i:02}", None, "pelangi") for i in (12, 13, 14, 15)] + [(30, "z", None, "jarang")]
    entries = spark.createDataFrame(e, ENTRIES)
    index = {r.word: r for r in R.inverted_index(entries, []).collect()}
    assert index["samudra"].slugs == [f"c{i:02}" for i in range(14)] and index["jarang"].slugs == ["z"]
    q = spark.createDataFrame([(1, "samudra pelangi")], "q_id bigint, text string")
    index = R.inverted_index(entries, [])
    routes = R.route(q, index, aliases(spark), [], {})
    assert [tuple(r) for r in routes.collect()] == [(1, "c12", "votes")]
    ranked = R.rank_entries(q, entries, routes, index, [], [], {}, 3).orderBy("rank").collect()
    assert [(r.entry_id, r.borrowed) for r in ranked] == [(12, 0), (0, 1), (1, 1)]


def test_entries_without_references_reach_the_index(spark, tmp_path):
    schema = spark.read.parquet("/root/testdata/sf0.001/peta_shards.parquet").schema
    entries = [("samudra", None, []), ("pelangi", None, [(1, 2, True, [])])]
    got = run(spark, tmp_path, "inverted_index", peta_shards=([(1, "a-b", "A", None, None, None, [("s", entries)], None)], schema))
    assert sorted((r.word, r.tier, r.slugs, r.n_slugs) for r in got) == [("pelangi", "narrow", "a-b", 1), ("samudra", "narrow", "a-b", 1)]


def test_broad_words_vote_beside_narrow_ones(spark):
    e = [(1, "a", "1:1", "pelangi")] + [(10 + i, s, f"2:{i}", "samudra gunung") for i, s in enumerate("bcde")]
    index = R.inverted_index(spark.createDataFrame(e, ENTRIES), [])
    q = spark.createDataFrame([(1, "pelangi samudra gunung"), (2, "samudra pelangi"), (3, "pelangi samudra")], "q_id bigint, text string")
    assert sorted(tuple(r) for r in R.route(q, index, aliases(spark), [], {}).collect()) == [(1, "b", "votes"), (2, "b", "votes"), (3, "a", "votes")]


def aliases(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord bigint, slug string, alias string, frame boolean")


def test_route_rules(spark):
    e = [(1, "a", "1:1", "pelangi gunungan"), (2, "b", "1:2", "samudra"), (3, "c", "1:3", "menggunjing sadar")]
    index = R.inverted_index(spark.createDataFrame(e, ENTRIES), [])
    al = aliases(spark, ("a", "pasar", False), ("b", "hukum", True), ("c", "orang tua", False), ("b", "wajib", True))
    texts = [
        "pasar samudra",  # an alias that names a subject wins, whatever the index says
        "hukum samudra",  # the category of a frame alias holds the subject
        "hukum pelangi",  # it does not, another does
        "hukum musik pelangi",  # a word the index lacks: no correction
        "musik",  # nothing
        "ghibah",  # a naming variant
        "sadari",  # the bare form of a word with a suffix
        "gunung",  # the beginning of a written word
        "orang tuanya hukum wajib",  # two frame aliases outvote one of a subject, and are not grounded
        "hukumnya",  # an affix form of an alias, no subject left
        None,
    ]
    q = spark.createDataFrame(list(enumerate(texts)), "q_id bigint, text string")
    got = {r.q_id: (r.slug, r.how) for r in R.route(q, index, al, ["hukum", "hukumnya", "wajib", "orang", "tuanya"], {"ghibah": "menggunjing"}).collect()}
    assert got == {0: ("a", "grounded"), 1: ("b", "kept"), 2: ("a", "votes"), 3: ("b", "alias"), 5: ("c", "votes"), 6: ("c", "votes"), 7: ("a", "votes"), 8: ("b", "alias"), 9: ("b", "alias")}


def test_ranking_needs_the_subject_and_the_routed_category(spark):
    e = [(1, "a", "1:1", "hukum pasar"), (2, "a", "1:2", "pasar ramai"), (3, "b", "1:2", "pasar ramai hujan"), (4, "b", "1:4", "hukum saja"), (5, "c", "1:5", "hujan"), (6, "a", None, "pasar")]
    entries = spark.createDataFrame(e, ENTRIES)
    index = R.inverted_index(entries, [])
    q = spark.createDataFrame([(1, "hukum pasar ramai"), (2, "hukum hujan"), (3, "hukum")], "q_id bigint, text string")
    routes = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "q_id bigint, slug string")
    got = [(r.q_id, r.entry_id, r.score, r.borrowed) for r in R.rank_entries(q, entries, routes, index, [], ["hukum"], {}, 5).orderBy("q_id", "rank").collect()]
    # 1: entry 3 is the same verse as 2 and borrowed; 2: nothing of the routed category, so nothing; 3: no subject, the frame counts
    assert got == [(1, 1, 2, 0), (1, 2, 2, 0), (3, 4, 1, 0)]


def js_variant(text, n):
    h = 0
    units = text.encode("utf-16-le")
    for i in range(0, len(units), 2):
        h = (h * 31 + int.from_bytes(units[i : i + 2], "little")) & 0xFFFFFFFF
    return abs(h - (1 << 32) if h >> 31 else h) % n


def test_variant_of_the_whole_text(spark, tmp_path):
    texts = ["", "halo", "é" * 90, "sama " * 40 + "a", "sama " * 40 + "b", "\n" + "x" * 5000]
    got = {r.doc_id: r.variant for r in run(spark, tmp_path, "variant_pick", documents=(docs(*texts), DOCS))}
    assert got == {i: js_variant(t, 7) for i, t in enumerate(texts)}


def test_markers_anywhere_in_the_text(spark, tmp_path):
    text = "kata " * 30 + "[H:b:12] akhir"
    (r,) = run(spark, tmp_path, "marker_codec", documents=(docs(text), DOCS))
    assert r.ids == "b/12 s/0 a/7" and r.rest == len("kata " * 30 + "akhir")


def test_diversify_walks_the_whole_ranking(spark, tmp_path):
    rows = [(i, "x-y", "k", None, None, 1000) for i in range(300)] + [(300, "x-z", "k", None, None, 9), (301, "y", "k", None, None, 8), (302, "w", "k", None, None, 7)]
    got = run(spark, tmp_path, "greedy_diversify", documents=(rows, DOCS))
    assert sorted((r.place, r.doc_id, r.theme) for r in got) == [(0, 0, "x"), (1, 1, "y"), (2, 300, "z"), (3, 302, "w")]


@pytest.mark.parametrize("cells, words", [(32_000_000, 1_000_000), (40, 1_000_000), (40, 0)])
def test_rare_word_top_against_counting(spark, monkeypatch, cells, words):
    """In one block and in several, with the words broadcast and joined by a shuffle."""
    monkeypatch.setattr(R, "MAX_QUESTION_CELLS", cells)
    monkeypatch.setattr(R, "MAX_ASKED_WORDS", words)
    r = random.Random(4)
    vocabulary = [f"kata{i}" for i in range(30)]
    docs_ = [(i, f"s{i % 6}", " ".join(r.choice(vocabulary[: 5 + i % 25]) for _ in range(r.choice([0, 3, 12])))) for i in range(60)] + [(60, "s0", None), (None, "s0", "kata1")]
    ask = [(i, " ".join(r.choice(vocabulary + ["tiada"]) for _ in range(4))) for i in range(12)] + [(12, None), (13, "")]
    got = {(x.q_id, x["rank"]): (x.row_id, x.score) for x in R.rare_word_top(spark.createDataFrame(ask, "q_id bigint, text string"), spark.createDataFrame(docs_, "row_id bigint, source string, text string").repartition(5), 2, 3).collect()}
    held = {i: set((t or "").split()) for i, _, t in docs_ if i is not None}
    sources = {w: {s for i, s, t in docs_ if i is not None and w in (t or "").split()} for w in vocabulary}
    want = {}
    for q, t in ask:
        known = {w for w in (t or "").split() if sources.get(w)}
        kept = {w for w in known if len(sources[w]) <= 2} or known
        best = sorted((-len(kept & ws), i) for i, ws in held.items() if kept & ws)[:3]
        want |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(best)}
    assert got == want
    assert R.rare_word_top(spark.createDataFrame([], "q_id bigint, text string"), spark.createDataFrame(docs_, "row_id bigint, source string, text string"), 2, 3).count() == 0
