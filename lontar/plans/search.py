"""Queries of retrieval, similarity and guards. Word lists here are small examples for the test data, passed as parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.functions import text as T
from lontar.operators import guards as G
from lontar.operators import retrieval as R
from lontar.operators import similarity as S
from lontar.operators.joins import nearest
from lontar.operators.nested import flat_tables
from lontar.plans.nested import TREE_SQL
from lontar.plans.text import _BODY, _NORM, _SET, _STEM0, _sql_suffix
from lontar.util import cut, table

PINS = [("sebelum", 1, "2:7"), ("sebelum", 2, "7:41"), ("patience", 1, "2:7"), ("sungguh", 1, "999:1"), ("sungguh", 2, "65:26")]
AREAS = [("niaga", "pasar"), ("niaga", "upah"), ("niaga", "harta"), ("niaga", "membeli"), ("ibadah", "puasa"), ("ibadah", "zakat"), ("ibadah", "salat"), ("keluarga", "ibu"), ("keluarga", "yatim"), ("keluarga", "suami"), ("keluarga", "keluarga")]
LEXICON = [("dagang", "pasar"), ("dagang", "harta"), ("dagang", "upah"), ("sabar", "kesabaran"), ("sabar", "patience"), ("sabar", "perdamaian"), ("alam", "laut"), ("alam", "sungai"), ("alam", "gunung"), ("alam", "di negeri jauh"), ("alam", "waktu fajar"), ("keluarga", "yatim"), ("keluarga", "suami")]
#: (category, alias, whether it only names the kind of question)
ALIASES = [("perintah-dan-larangan", "hukumnya apabila", True), ("amanah-satuh", "amanah", False), ("amanah-satuh", "janji", False), ("adab-sehasim", "hukum", True), ("adab-dan-hakim", "hakim", False), ("dagang-hurit", "orang lemah", False), ("dagang-hurit", "harta", False), ("akhlak-dewobin", "penjelasan", True)]
NAMING = {"counsel": "nasihat", "season": "musim", "nasihat": "wasiat"}
FRAMES = ["apakah", "bagaimana", "mengapa", "dikatakan", "penjelasan", "hukumnya", "apabila", "what", "explain", "why"]
SPEECH, VERDICTS, DEFER = ["menurut", "berkata"], ["janganlah", "wajib"], ["bukankah", "mungkin"]
CRISIS = ["binasa", "gelap", "gelisah", "hina"]


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows) + ")"


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select(F.col("item_id").alias("q_id"), "text", "ref")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("row_id"), "source", "text", "ref")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dump_rows").select("dump_id", "q", "turn_bucket", "prose", "verse_refs").dropDuplicates(["dump_id"])


def lexical_top2(spark: SparkSession, d: str) -> DataFrame:
    """The two documents that hold most of a question's words that are rare across sources, or of all its words if none is rare, per question."""
    t = R.rare_word_top(_questions(spark, d), _documents(spark, d), 3, 2)
    return t.select("q_id", F.col("row_id").alias("doc_id"), "score", F.col("rank").cast("bigint").alias("rank"))


def lexicon_hits(spark: SparkSession, d: str) -> DataFrame:
    h = R.lexicon_hits(_questions(spark, d), _rows(spark, LEXICON, "theme string, term string"))
    return h.select("q_id", "theme", F.array_join("terms", ",").alias("terms"))


MODEL_THEMES = [(i, t) for i, t in ((3, "alam"), (11, "sabar"), (17, "keluarga"), (18, "alam"))]


def lexicon_scores(spark: SparkSession, d: str) -> DataFrame:
    q, docs = _questions(spark, d), _documents(spark, d)
    hits = R.lexicon_hits(q, _rows(spark, LEXICON, "theme string, term string"))
    themes = cut(R.themes_of(docs, "row_id", LEXICON))
    s = R.score_rows(q, hits, docs, themes, T.STOP_WORDS, 2, _rows(spark, MODEL_THEMES, "q_id bigint, theme string"))
    return s.select("q_id", F.col("row_id").alias("doc_id"), F.col("score").cast("bigint").alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries with a text; their id is the struct of their keys, so none can collide."""
    t = flat_tables(table(spark, d, "peta_shards"), ("slug",))
    keys = ["shard_id", "subtopic_no", "entry_no"]
    first = t["refs"].where("ref_no = 0").select(*keys, F.concat_ws(":", "surah", "ayah").alias("verse"))
    e = t["entries"].where("text IS NOT NULL").join(t["shards"].select("shard_id", "slug"), "shard_id").join(first, keys, "left")
    return cut(e.select(F.struct(*keys).alias("entry_id"), "slug", "verse", "text"))


def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    i = R.inverted_index(_entries(spark, d), T.STOP_WORDS)
    return i.select("word", "tier", F.array_join("slugs", ",").alias("slugs"), "n_slugs")


def _aliases(spark: SparkSession) -> DataFrame:
    return _rows(spark, [(i, *x) for i, x in enumerate(ALIASES)], "ord bigint, slug string, alias string, frame boolean")


def two_tier_route(spark: SparkSession, d: str) -> DataFrame:
    index = cut(R.inverted_index(_entries(spark, d), T.STOP_WORDS))
    return R.route(_questions(spark, d), index, _aliases(spark), [*T.STOP_WORDS, *FRAMES], NAMING)


def entry_ranking(spark: SparkSession, d: str) -> DataFrame:
    e, q = _entries(spark, d), _questions(spark, d)
    index = cut(R.inverted_index(e, T.STOP_WORDS))
    routes = cut(R.route(q, index, _aliases(spark), [*T.STOP_WORDS, *FRAMES], NAMING))
    r = R.rank_entries(q, e, routes, index, T.STOP_WORDS, FRAMES, NAMING, 8)
    return r.select("q_id", "entry_id.*", "score", "borrowed", F.col("rank").cast("bigint").alias("rank"))


def curated_pins(spark: SparkSession, d: str) -> DataFrame:
    pins = _rows(spark, PINS, "phrase string, ord bigint, ref string")
    return R.pinned(_questions(spark, d), pins, table(spark, d, "documents").select("ref"))


def dense_pipeline(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"))
    top = nearest(q, e.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("b_vec")), 50)
    records = e.select(F.col("vec_id").alias("b_id"), F.when(F.col("label") == 0, "private").alias("rights"), F.when(F.col("vec_id") % 7 != 3, "body").alias("text"))
    p = R.dense(top, records, lambda r: r.withColumn("new_score", F.round("score", 1) - (F.col("b_id") % 5) * 0.5), 8, 2)
    return p.select("q_id", "b_id", F.col("place").cast("bigint").alias("place"), "shown")


def vector_keys(spark: SparkSession, d: str) -> DataFrame:
    """What is embedded for each section, cut at 4000 characters, under the hash of it; batches of 32 in key order of a part."""
    s = table(spark, d, "intro_sections").select("section_id", "title", "body").distinct()
    t = F.left(F.concat_ws("\n", "title", F.coalesce("body", F.lit(""))), F.lit(4000))
    return s.select("section_id", F.sha2(t, 256).alias("key"), F.length(t).alias("n")).groupBy("key").agg(F.min("section_id").alias("section_id"), F.count("*").alias("copies"), F.max("n").alias("n"))


def area_router(spark: SparkSession, d: str) -> DataFrame:
    return R.cue_router(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", _rows(spark, AREAS, "area string, cue string"))


def lane_cascade(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "eval_items")
    p = G.pad(F.col("text"))
    theme = R.lexicon_hits(_questions(spark, d), _rows(spark, LEXICON, "theme string, term string")).groupBy("q_id").agg(F.count("*").alias("themes"))
    lane = R.first_lane(("crisis", G.has_any(p, CRISIS)), ("reference", F.size(T.refs(F.col("text"))) > 0), ("verdict", G.has_any(p, VERDICTS)), ("how", G.has_any(p, ["bagaimana", "how", "why"])), ("theme", F.col("themes") > 0), ("pointer", F.col("ref").isNotNull()))
    return q.join(theme, q.item_id == theme.q_id, "left").select("item_id", lane.alias("lane"))


def echo_longest_run(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")
    r = S.longest_runs(table(spark, d, "eval_items"), "item_id", docs, "doc_id", T.words_of(F.col("text")), 6)
    return r.select("item_id", "doc_id", F.col("run").cast("bigint").alias("run"))


def echo_rare_terms(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share three rare stems with a question; rare as in the reference, 150 of 12,472 texts."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")
    h = S.rare_stem_hits(table(spark, d, "eval_items").select("item_id", "text"), "item_id", docs, "doc_id", (150, 12_472), 3)
    return h.select("item_id", "doc_id", "hit", "rare", F.round("cover", 6).alias("cover"))


def evidence_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Answers whose question's words are, by 60 percent and at least six, words of the answer."""
    r = _answers(spark, d).where("q IS NOT NULL")
    return r.select("dump_id", S.overlap_share(F.col("q"), F.coalesce("prose", F.lit(""))).alias("held"))


def guard_violations(spark: SparkSession, d: str) -> DataFrame:
    r = _answers(spark, d).where("prose IS NOT NULL")
    c = F.col("prose")
    unlisted, invalid, verdicts = G.unlisted_refs(c, F.col("verse_refs")), G.invalid_refs(c), G.verdict_sentences(c, VERDICTS, DEFER)
    v = G.violations(("script", G.foreign_script(c, "ﷺ"), F.lit("arabic")), ("bad_ref", F.size(invalid) > 0, F.get(invalid, F.lit(0))), ("unlisted_ref", F.size(unlisted) > 0, F.get(unlisted, F.lit(0))), ("verdict", F.size(verdicts) > 0, F.get(verdicts, F.lit(0))))
    return r.select("dump_id", F.array_join(F.transform(v, lambda x: F.concat_ws("=", x.kind, x.detail)), "|").alias("found"), (F.size(v) == 0).alias("ok"), F.length(G.safe_text(c, v)).alias("safe"))


def sentence_attribution(spark: SparkSession, d: str) -> DataFrame:
    r = _answers(spark, d).where("prose IS NOT NULL")
    return r.select("dump_id", F.size(G.unbacked_attributions(F.col("prose"), SPEECH)).alias("unbacked"))


def crisis_first(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", G.first_cue(F.col("text"), CRISIS).alias("cue"))
    return t.where("cue IS NOT NULL")


def cue_flags(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text IS NOT NULL")
    p = G.pad(F.col("text"))
    w = G.reasons(("speech", G.has_any(p, SPEECH)), ("verdict", G.has_any(p, VERDICTS) & ~G.has_any(p, DEFER)), ("reference", F.size(T.refs(F.col("text"))) > 0))
    return t.select("doc_id", w.alias("why")).where("why IS NOT NULL")


def question_forms(spark: SparkSession, d: str) -> DataFrame:
    p = G.pad(F.col("text"))
    form = F.when(G.has_any(p, ["i", "my", "saya", "aku"]), "personal").when(G.has_any(p, ["berapa", "count"]), "count").when(p.rlike("^ (bagaimana|how) "), "how").when(p.rlike("^ (apa|what|why|mengapa) "), "factual").otherwise("none")
    return table(spark, d, "eval_items").select("item_id", form.alias("form"))


def reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the first rule they fail, accepted ones under `accepted`."""
    t = table(spark, d, "documents")
    n = F.length(F.trim("text"))
    why = G.first_reason(("empty", n.isNull() | (n == 0)), ("short", n < 200), ("long", n > 4000), ("quotes", F.contains("text", F.lit("“"))), ("no_language", F.col("lang").isNull()), ("not_finished", ~F.col("text").rlike(r"[.!?؟]\s*$")))
    return t.groupBy(F.coalesce(why, F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def proximity_rule(spark: SparkSession, d: str) -> DataFrame:
    check, quotes = G.proximity(["imam", "guru", "khatib"], ["menyampaikan", "menegur", "menolak"], ["murid", "hamba"]), G.attributed_quotes(["menurut", "adalah", "itu"], 3)
    return table(spark, d, "documents").select("doc_id", check("text").alias("near"), quotes("text").alias("quotes")).where("near OR quotes > 0")


def _demo_guard(text: str) -> list[tuple[str, str]]:
    out = [("verdict", w) for w in ("Janganlah", "wajib") if w in text]
    return out + [("many", str(text.count("?")))] * (text.count("?") > 3)


def repair_excise(spark: SparkSession, d: str) -> DataFrame:
    r = _answers(spark, d).where("prose IS NOT NULL").select("dump_id", "prose", G.repairer(_demo_guard)("prose").alias("r"))
    return r.select("dump_id", F.length("r.text").alias("left"), "r.dropped", F.length("prose").alias("was"))


def retry_policy(spark: SparkSession, d: str) -> DataFrame:
    """Budgets of first and second attempts over what remains of a 25 s turn after each event's value in tenths of a second."""
    left = F.lit(25_000) - F.floor(F.col("value") * 100).cast("int")
    return table(spark, d, "events").select("event_id", G.attempt_budget(F.lit(0), left).alias("first"), G.attempt_budget(F.lit(1), left).alias("second"), G.attempt_budget(F.lit(2), left).alias("third"))


def generation_outcome(spark: SparkSession, d: str) -> DataFrame:
    a = F.array(F.struct(F.floor(F.col("value") * 100).cast("bigint").alias("ms"), F.when(F.col("event_type") == "error", "refused").otherwise("ok").alias("outcome")), F.struct(F.lit(9000).cast("bigint").alias("ms"), F.lit("ok").alias("outcome")))
    return table(spark, d, "events").groupBy("event_type", G.outcome(a, 15_000).alias("end")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        lexical_top2, lexicon_hits, lexicon_scores, inverted_index, two_tier_route, entry_ranking, curated_pins, dense_pipeline, vector_keys, area_router, lane_cascade, echo_longest_run, echo_rare_terms,
        evidence_overlap, guard_violations, sentence_attribution, crisis_first, cue_flags, question_forms, reject_reasons, proximity_rule, repair_excise, retry_policy, generation_outcome,
    )
}

_PAD = "' ' || " + _NORM + " || ' '"
_HYPHEN = "list_filter(regexp_split_to_array(" + _NORM + ", '[ -]'), lambda x: x <> '')"
_ENDS = "|".join(sorted(T.AFFIX_SUFFIXES, key=len, reverse=True))
_STOP = "(" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")"
_REFS = r"list_transform(regexp_extract_all({0}, '(?:^|[^0-9A-Za-z_])([0-9]{{1,3}}\s*[:.]\s*[0-9]{{1,3}})\b', 1), lambda x: regexp_replace(replace(regexp_replace(x, '\s', '', 'g'), '.', ':'), '(^|:)0+([0-9])', '\1\2', 'g'))"


def _any(padded: str, cues: list[str]) -> str:
    return "(" + " OR ".join(f"contains({padded}, ' {c} ')" for c in cues) + ")"


def _hits(name: str, source: str, key: str) -> str:
    return f"""{name}_n AS (SELECT {key} AS q_id, text, {_NORM.format('text')} AS n FROM {source} WHERE text IS NOT NULL),
{name}_w AS (SELECT q_id, unnest(list_distinct(list_filter(regexp_split_to_array(n, '[ -]'), lambda x: x <> ''))) AS term FROM {name}_n),
{name} AS (SELECT q_id, theme, list_sort(list(DISTINCT term)) AS terms FROM (SELECT q_id, theme, term FROM {name}_w JOIN lex USING (term) WHERE NOT contains(term, ' ')
  UNION ALL SELECT q_id, theme, term FROM {name}_n, lex WHERE contains(term, ' ') AND regexp_matches(' ' || n || ' ', ' ' || term || '(?:{_ENDS})? ')) GROUP BY 1, 2)"""


_LEX = f"lex AS (SELECT * FROM {_values(LEXICON)} t(theme, term))"
_STEMS = f"""unnest(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9'' ]+', ' ', 'g'), '\\s+'), lambda x: x <> ''))"""


def _stems(source: str, key: str) -> str:
    return f"SELECT DISTINCT {key}, stem FROM (SELECT {key}, CASE WHEN length(s) >= 3 THEN s ELSE word END AS stem FROM (SELECT {key}, word, regexp_replace({_STEM0}, '({T.STEM_SUFFIXES})$', '') AS s FROM (SELECT {key}, {_STEMS} AS word FROM {source} WHERE text IS NOT NULL) WHERE word NOT IN {_STOP})) WHERE length(stem) >= 3"


_ENTRIES = TREE_SQL + """, verses AS (SELECT shard_id, subtopic_no, entry_no, concat_ws(':', surah, ayah) AS verse FROM refs WHERE ref_no = 0),
en AS (SELECT e.shard_id, e.subtopic_no, e.entry_no, e.slug, v.verse, e.text FROM (SELECT shard_id, slug, subtopic_no, entry_no, l[entry_no + 1]->>'$.text' AS text FROM e1 WHERE entry_no >= 0) e LEFT JOIN verses v USING (shard_id, subtopic_no, entry_no) WHERE e.text IS NOT NULL),
ew AS (SELECT slug, unnest(""" + _SET.format("text") + f""") AS word FROM en), own AS (SELECT DISTINCT unnest(string_split(slug, '-')) AS word FROM en),
ix AS (SELECT word, slug, count(*) AS n FROM ew WHERE length(word) >= 4 AND word NOT IN {_STOP} AND word NOT IN (SELECT word FROM own) GROUP BY 1, 2),
idx AS (SELECT word, list(slug ORDER BY n DESC, slug) AS slugs, CASE WHEN count(*) > 3 THEN 1 ELSE 0 END AS tier FROM ix GROUP BY 1)
"""

_FRAMED = "(" + ", ".join(f"'{w}'" for w in [*T.STOP_WORDS, *FRAMES]) + ")"
_FRAME = "(" + ", ".join(f"'{w}'" for w in FRAMES) + ")"
_VARIANTS = f"naming AS (SELECT * FROM {_values(list(NAMING.items()))} t(word, other))"
_STEMMED = "list_filter([v" + "".join(f", CASE WHEN ends_with(v, '{x}') AND length(v) >= {len(x) + 4} THEN left(v, length(v) - {len(x)}) END" for x in T.STEM_ENDINGS) + "], lambda x: x IS NOT NULL)"
_AFFIXED = "f0 AS (SELECT DISTINCT word, word AS x FROM qall UNION SELECT word, " + _BODY + " FROM qall), f1 AS (SELECT word, x, " + _sql_suffix("x") + " AS y FROM f0), f2 AS (SELECT word, x, y, " + _sql_suffix("y") + " AS z FROM f1), ff AS (SELECT word, x AS form FROM f2 UNION SELECT word, y FROM f2 UNION SELECT word, z FROM f2)"


def _holders(name: str, words: str) -> str:
    """The SQL of holders(): CTE `name` (word, slugs) of the words of a CTE."""
    return f"""{name}_v AS (SELECT w.word, 0 AS vn, w.word AS v FROM (SELECT DISTINCT word FROM {words}) w UNION ALL SELECT w.word, 1, other FROM (SELECT DISTINCT word FROM {words}) w JOIN naming USING (word)),
{name}_f AS (SELECT word, vn, generate_subscripts(l, 1) AS sn, unnest(l) AS form FROM (SELECT word, vn, {_STEMMED} AS l FROM {name}_v)),
{name}_r AS (SELECT form, tier, 0 AS kind, idx.word AS key FROM (SELECT DISTINCT form FROM {name}_f) JOIN idx ON idx.word = form UNION ALL
  SELECT form, tier, 1, min(idx.word) FROM (SELECT DISTINCT form FROM {name}_f WHERE length(form) >= 4) JOIN idx ON starts_with(idx.word, form) AND idx.word <> form GROUP BY 1, 2),
{name} AS (SELECT k.word, idx.slugs FROM (SELECT word, arg_min(key, (tier, vn, sn, kind, key)) AS key FROM {name}_f JOIN {name}_r USING (form) GROUP BY 1) k JOIN idx ON idx.word = k.key)"""


_ROUTES = _ENTRIES + f""", {_VARIANTS}, qn AS (SELECT item_id AS q_id, {_NORM.format('text')} AS n FROM eval_items WHERE text IS NOT NULL),
qh AS (SELECT q_id, list_filter(regexp_split_to_array(n, '[ -]'), lambda x: x <> '') AS w FROM qn),
qall AS (SELECT DISTINCT q_id, unnest(w) AS word FROM qh),
al AS (SELECT * FROM {_values([(i, *x) for i, x in enumerate(ALIASES)])} t(ord, slug, alias, frame)),
{_AFFIXED},
ah AS (SELECT DISTINCT q_id, ord, slug, alias, frame FROM qall JOIN ff USING (word) JOIN al ON al.alias = ff.form WHERE NOT contains(alias, ' ')
  UNION SELECT q_id, ord, slug, alias, frame FROM qn, al WHERE contains(alias, ' ') AND regexp_matches(' ' || n || ' ', ' ' || alias || '(?:{_ENDS})? ')),
ag AS (SELECT q_id, slug, count(*) AS score, bool_or(NOT frame) AS grounded FROM ah GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY count(*) DESC, min(ord)) = 1),
qw AS (SELECT q_id, word, row_number() OVER (PARTITION BY q_id ORDER BY i) AS no FROM (SELECT q_id, x.word, x.i FROM (SELECT q_id, unnest(list_transform(w, lambda v, i: {{'word': v, 'i': i}})) AS x FROM qh)) WHERE length(word) > 2 AND word NOT IN {_FRAMED} QUALIFY row_number() OVER (PARTITION BY q_id, word ORDER BY i) = 1),
{_holders("hd", "qw")},
qc AS (SELECT q_id, no, qw.word, slugs FROM qw LEFT JOIN hd USING (word)),
cv AS (SELECT q_id, bool_and(slugs IS NOT NULL) AS covered FROM qc GROUP BY 1),
vt AS (SELECT q_id, slug, count(*) AS votes, min(no * 100000 + pos) AS first FROM (SELECT q_id, no, unnest(slugs) AS slug, generate_subscripts(slugs, 1) AS pos FROM qc WHERE slugs IS NOT NULL) GROUP BY 1, 2),
wn AS (SELECT q_id, slug AS winner FROM vt QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY votes DESC, first) = 1),
rj AS (SELECT coalesce(cv.q_id, ag.q_id) AS q_id, ag.slug, grounded, coalesce(covered, false) AS covered, winner, vt.votes IS NOT NULL AS held FROM cv LEFT JOIN wn USING (q_id) FULL JOIN ag USING (q_id) LEFT JOIN vt ON vt.q_id = ag.q_id AND vt.slug = ag.slug),
rh AS (SELECT *, CASE WHEN grounded THEN 'grounded' WHEN covered AND held THEN 'kept' WHEN covered AND winner IS NOT NULL THEN 'votes' WHEN slug IS NOT NULL THEN 'alias' END AS how FROM rj),
rt AS (SELECT q_id, CASE WHEN how = 'votes' THEN winner ELSE slug END AS slug, how FROM rh WHERE how IS NOT NULL)
"""

SQL = {
    "lexical_top2": f"""WITH w AS (SELECT doc_id, source, unnest({_SET.format('text')}) AS word FROM documents WHERE text IS NOT NULL), b AS (SELECT word, count(DISTINCT source) > 3 AS broad FROM w GROUP BY 1),
      q0 AS (SELECT item_id AS q_id, unnest({_SET.format('text')}) AS word FROM eval_items), q1 AS (SELECT q_id, word, broad, min(broad::INT) OVER (PARTITION BY q_id) AS least FROM q0 JOIN b USING (word)), q AS (SELECT q_id, word FROM q1 WHERE broad::INT = least),
      s AS (SELECT q_id, doc_id, count(*) AS score FROM q JOIN w USING (word) GROUP BY 1, 2)
      SELECT q_id, doc_id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 2""",
    "lexicon_hits": f"WITH {_LEX}, {_hits('h', 'eval_items', 'item_id')} SELECT q_id, theme, array_to_string(terms, ',') AS terms FROM h",
    "lexicon_scores": f"""WITH {_LEX}, {_hits('h', 'eval_items', 'item_id')}, {_hits('g', 'documents', 'doc_id')}, mt AS (SELECT * FROM {_values(MODEL_THEMES)} t(q_id, theme)),
      nm AS (SELECT q_id, theme, terms FROM h UNION ALL SELECT q_id, theme, CAST([] AS VARCHAR[]) FROM mt WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.q_id = mt.q_id AND h.theme = mt.theme)),
      bt AS (SELECT nm.q_id, g.q_id AS doc_id, nm.theme, nm.terms FROM nm JOIN g USING (theme) QUALIFY row_number() OVER (PARTITION BY nm.q_id, g.q_id ORDER BY len(nm.terms) DESC, nm.theme) = 1),
      b AS (SELECT item_id AS q_id, doc_id, 100 AS points, CAST([] AS VARCHAR[]) AS terms FROM eval_items JOIN documents d ON eval_items.ref = d.ref WHERE d.text IS NOT NULL UNION ALL SELECT q_id, doc_id, greatest(10, 10 * len(terms)), terms FROM bt),
      m AS (SELECT q_id, doc_id, sum(points) AS points, string_split(array_to_string(flatten(list(terms)), ' '), ' ') AS own FROM b GROUP BY 1, 2),
      qs AS (SELECT item_id AS q_id, list_filter({_SET.format('text')}, lambda x: length(x) > 3 AND x NOT IN {_STOP}) AS l FROM eval_items), ds AS (SELECT doc_id, list_filter({_SET.format('text')}, lambda x: length(x) > 3 AND x NOT IN {_STOP}) AS r FROM documents),
      s AS (SELECT q_id, doc_id, (points + 2 * len(list_filter(list_intersect(l, r), lambda x: NOT list_contains(own, x))))::BIGINT AS score FROM m JOIN qs USING (q_id) JOIN ds USING (doc_id))
      SELECT q_id, doc_id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 2""",
    "inverted_index": _ENTRIES + "SELECT word, CASE WHEN tier = 1 THEN 'broad' ELSE 'narrow' END AS tier, array_to_string(slugs, ',') AS slugs, len(slugs) AS n_slugs FROM idx",
    "two_tier_route": _ROUTES + "SELECT q_id, slug, how FROM rt",
    "entry_ranking": _ROUTES
    + f""", q1 AS (SELECT DISTINCT qall.q_id, rt.slug AS own, word, word NOT IN {_FRAME} AS subject FROM qall JOIN rt USING (q_id) WHERE length(word) > 2 AND word NOT IN {_STOP} AND NOT list_contains(string_split(rt.slug, '-'), word)),
q2 AS (SELECT *, bool_or(subject) OVER (PARTITION BY q_id) AS has_subject FROM q1), qa AS (SELECT * FROM q2 WHERE subject),
{_holders("ha", "qa")},
pl AS (SELECT q_id, unnest(slugs) AS slug FROM qa JOIN ha USING (word) UNION SELECT q_id, slug FROM rt),
qp AS (SELECT q2.q_id, pl.slug, word, CASE WHEN pl.slug = own THEN 0 ELSE 1 END AS borrowed, subject OR NOT has_subject AS onto FROM q2 JOIN pl USING (q_id)),
xe AS (SELECT DISTINCT shard_id, subtopic_no, entry_no, slug, verse, unnest(list_filter(regexp_split_to_array({_NORM.format('text')}, '[ -]'), lambda x: x <> '')) AS key FROM en WHERE verse IS NOT NULL),
vf AS (SELECT DISTINCT word, word AS form FROM q2 UNION SELECT word, other FROM (SELECT DISTINCT word FROM q2) JOIN naming USING (word)),
rx AS (SELECT DISTINCT word, key FROM (SELECT DISTINCT key FROM xe) JOIN vf ON key = form OR (length(form) >= 4 AND starts_with(key, form))),
xh AS (SELECT DISTINCT shard_id, subtopic_no, entry_no, slug, verse, word FROM xe JOIN rx USING (key)),
xs AS (SELECT q_id, shard_id, subtopic_no, entry_no, verse, count(*) AS score, max(borrowed) AS borrowed FROM xh JOIN qp USING (slug, word) GROUP BY 1, 2, 3, 4, 5 HAVING bool_or(onto)),
xb AS (SELECT * FROM xs WHERE q_id IN (SELECT q_id FROM xs WHERE borrowed = 0)),
xo AS (SELECT * FROM xb QUALIFY row_number() OVER (PARTITION BY q_id, verse ORDER BY score DESC, borrowed, shard_id, subtopic_no, entry_no) = 1)
SELECT q_id, shard_id, CAST(subtopic_no AS INT) AS subtopic_no, CAST(entry_no AS INT) AS entry_no, score, CAST(borrowed AS INT) AS borrowed, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, borrowed, shard_id, subtopic_no, entry_no) AS rank FROM xo QUALIFY rank <= 8""",
    "curated_pins": f"SELECT DISTINCT item_id AS q_id, p.ref, p.ord::BIGINT AS ord FROM eval_items, {_values(PINS)} p(phrase, ord, ref) WHERE regexp_matches({_PAD.format('text')}, ' ' || phrase || '(?:{_ENDS})? ') AND p.ref IN (SELECT ref FROM documents WHERE ref IS NOT NULL)",
    "dense_pipeline": """WITH q AS (SELECT vec_id AS q_id, embedding AS q_vec FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q_id, vec_id AS b_id, label, list_dot_product(CAST(q_vec AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS score FROM q, embeddings),
      t AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, b_id) AS rank FROM s QUALIFY rank <= 50), f AS (SELECT *, round(score, 1) - (b_id % 5) * 0.5 AS new_score FROM t WHERE label <> 0 AND b_id % 7 <> 3)
      SELECT q_id, b_id, row_number() OVER (PARTITION BY q_id ORDER BY new_score DESC, rank) AS place, place <= 2 AS shown FROM f QUALIFY place <= 8""",
    "vector_keys": "WITH s AS (SELECT DISTINCT section_id, title, body FROM intro_sections), t AS (SELECT section_id, left(concat_ws(chr(10), title, coalesce(body, '')), 4000) AS t FROM s) SELECT sha256(t) AS key, min(section_id) AS section_id, count(*) AS copies, max(length(t)) AS n FROM t GROUP BY 1",
    "area_router": f"""WITH d AS (SELECT doc_id, {_PAD.format('text')} AS t FROM documents), g AS (SELECT doc_id, area, count(*) AS n, min(instr(t, ' ' || cue || ' ')) AS p FROM d, {_values(AREAS)} c(area, cue) WHERE contains(t, ' ' || cue || ' ') GROUP BY 1, 2),
      r AS (SELECT *, rank() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS r FROM g) SELECT doc_id, CASE WHEN count(*) = 1 THEN max(area) END AS area, max(n) AS n FROM r WHERE r = 1 GROUP BY 1""",
    "lane_cascade": f"""WITH {_LEX}, {_hits('h', 'eval_items', 'item_id')}, t AS (SELECT q_id, count(*) AS themes FROM h GROUP BY 1), q AS (SELECT item_id, ref, text, {_PAD.format('text')} AS p, themes FROM eval_items LEFT JOIN t ON q_id = item_id)
      SELECT item_id, CASE WHEN {_any('p', CRISIS)} THEN 'crisis' WHEN len({_REFS.format('text')}) > 0 THEN 'reference' WHEN {_any('p', VERDICTS)} THEN 'verdict' WHEN {_any('p', ['bagaimana', 'how', 'why'])} THEN 'how' WHEN themes > 0 THEN 'theme' WHEN ref IS NOT NULL THEN 'pointer' ELSE 'silence' END AS lane FROM q""",
    "echo_longest_run": f"""WITH q AS (SELECT item_id, {_HYPHEN.format('text')} AS w FROM eval_items), t AS (SELECT doc_id, {_HYPHEN.format('text')} AS w FROM documents WHERE text IS NOT NULL),
      qg AS (SELECT item_id, i AS qi, array_to_string(w[i:i + 5], ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 5)) AS i FROM q)), tg AS (SELECT doc_id, i AS ti, array_to_string(w[i:i + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 5)) AS i FROM t)),
      m AS (SELECT DISTINCT item_id, doc_id, ti - qi AS d, qi FROM qg JOIN tg USING (g)), r AS (SELECT *, qi - row_number() OVER (PARTITION BY item_id, doc_id, d ORDER BY qi) AS grp FROM m)
      SELECT item_id, doc_id, max(run) AS run FROM (SELECT item_id, doc_id, d, grp, count(*) + 5 AS run FROM r GROUP BY 1, 2, 3, 4) GROUP BY 1, 2""",
    "echo_rare_terms": f"""WITH t AS ({_stems('documents', 'doc_id')}), q0 AS ({_stems('eval_items', 'item_id')}), rare AS (SELECT stem FROM t GROUP BY 1 HAVING count(*) * 12472 <= (SELECT count(*) FROM documents WHERE text IS NOT NULL) * 150), q AS (SELECT * FROM q0 WHERE stem IN (SELECT stem FROM rare)), n AS (SELECT item_id, count(*) AS rare FROM q GROUP BY 1),
      h AS (SELECT item_id, doc_id, count(*) AS hit FROM t JOIN q USING (stem) GROUP BY 1, 2 HAVING count(*) >= 3) SELECT item_id, doc_id, hit, rare, round(hit / rare, 6) AS cover FROM h JOIN n USING (item_id)""",
    "evidence_overlap": f"""WITH r AS (SELECT DISTINCT ON (dump_id) dump_id, {_HYPHEN.format('q')} AS q, {_SET.format("coalesce(prose, '')")} AS p FROM dump_rows WHERE q IS NOT NULL), f AS (SELECT dump_id, len(q) AS n, len(list_filter(q, lambda x: list_contains(p, x))) AS k FROM r)
      SELECT dump_id, n > 0 AND k >= least(6, n) AND k >= n * 0.6 AS held FROM f""",
    "guard_violations": rf"""WITH r AS (SELECT DISTINCT ON (dump_id) dump_id, prose, coalesce(verse_refs, []) AS allowed FROM dump_rows WHERE prose IS NOT NULL),
      x AS (SELECT *, {_REFS.format('prose')} AS l, list_filter(list_transform(regexp_split_to_array(prose, '[.!?\n]+'), lambda s: trim(s)), lambda s: s <> '') AS s FROM r),
      y AS (SELECT *, list_filter(l, lambda x: NOT (split_part(x, ':', 1)::INT BETWEEN 1 AND 114)) AS bad, list_filter(l, lambda x: NOT list_contains(allowed, x)) AS un, list_filter(s, lambda s: {_any(_PAD.format('s'), VERDICTS)} AND NOT {_any(_PAD.format('s'), DEFER)}) AS v FROM x),
      z AS (SELECT dump_id, prose, list_filter([CASE WHEN regexp_matches(replace(prose, 'ﷺ', ''), '[\x{{0600}}-\x{{06FF}}\x{{0750}}-\x{{077F}}\x{{FB50}}-\x{{FDFF}}\x{{FE70}}-\x{{FEFF}}]') THEN 'script=arabic' END, CASE WHEN len(bad) > 0 THEN 'bad_ref=' || bad[1] END, CASE WHEN len(un) > 0 THEN 'unlisted_ref=' || un[1] END, CASE WHEN len(v) > 0 THEN 'verdict=' || left(v[1], 80) END], lambda x: x IS NOT NULL) AS f FROM y)
      SELECT dump_id, coalesce(array_to_string(f, '|'), '') AS found, len(f) = 0 AS ok, CASE WHEN len(f) = 0 THEN length(prose) END AS safe FROM z""",
    "sentence_attribution": rf"WITH r AS (SELECT DISTINCT ON (dump_id) dump_id, prose FROM dump_rows WHERE prose IS NOT NULL), s AS (SELECT dump_id, regexp_split_to_array(prose, '[!?\n]+|\.(?:\s|$)') AS s FROM r) SELECT dump_id, len(list_filter(s, lambda s: {_any(_PAD.format('s'), SPEECH)} AND len({_REFS.format('s')}) = 0)) AS unbacked FROM s",
    "crisis_first": f"WITH t AS (SELECT doc_id, {_PAD.format('text')} AS p FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, coalesce({', '.join(f'''CASE WHEN contains(p, ' {c} ') THEN '{c}' END''' for c in CRISIS)}) AS cue FROM t) SELECT * FROM c WHERE cue IS NOT NULL",
    "cue_flags": f"WITH t AS (SELECT doc_id, text, {_PAD.format('text')} AS p FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, concat_ws(' + ', CASE WHEN {_any('p', SPEECH)} THEN 'speech' END, CASE WHEN {_any('p', VERDICTS)} AND NOT {_any('p', DEFER)} THEN 'verdict' END, CASE WHEN len({_REFS.format('text')}) > 0 THEN 'reference' END) AS why FROM t) SELECT doc_id, why FROM w WHERE why <> ''",
    "question_forms": f"WITH t AS (SELECT item_id, {_PAD.format('text')} AS p FROM eval_items) SELECT item_id, CASE WHEN {_any('p', ['i', 'my', 'saya', 'aku'])} THEN 'personal' WHEN {_any('p', ['berapa', 'count'])} THEN 'count' WHEN regexp_matches(p, '^ (bagaimana|how) ') THEN 'how' WHEN regexp_matches(p, '^ (apa|what|why|mengapa) ') THEN 'factual' ELSE 'none' END AS form FROM t",
    "reject_reasons": r"""WITH t AS (SELECT *, length(trim(text)) AS n FROM documents) SELECT CASE WHEN n IS NULL OR n = 0 THEN 'empty' WHEN n < 200 THEN 'short' WHEN n > 4000 THEN 'long' WHEN contains(text, '“') THEN 'quotes' WHEN lang IS NULL THEN 'no_language' WHEN NOT regexp_matches(text, '[.!?؟]\s*$') THEN 'not_finished' ELSE 'accepted' END AS reason, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM t GROUP BY 1""",
    "retry_policy": "WITH e AS (SELECT event_id, 25000 - floor(value * 100)::INT AS l FROM events) SELECT event_id, CASE WHEN l <= 0 THEN NULL WHEN l - 11500 >= 13000 THEN l - 11500 ELSE l END AS first, CASE WHEN l <= 0 OR l < 11500 THEN NULL ELSE l END AS second, NULL::INT AS third FROM e",
    "generation_outcome": """WITH e AS (SELECT event_type, floor(value * 100)::BIGINT AS ms, CASE WHEN event_type = 'error' THEN 'refused' ELSE 'ok' END AS o FROM events), a AS (SELECT event_type, ms, CASE WHEN ms > 15000 THEN 'timeout' ELSE o END AS e1 FROM e)
      SELECT event_type, CASE WHEN e1 = 'ok' THEN 'ok' WHEN ms + 9000 > 15000 THEN 'timeout' ELSE 'ok' END AS "end", count(*) AS n FROM a GROUP BY 1, 2""",
}
