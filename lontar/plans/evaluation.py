"""Queries of evaluations, language gates and written references. Verdicts that a model or a judge would give are made from the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.functions import text as T
from lontar.operators import aggregates as A
from lontar.operators import guards as G
from lontar.operators import retrieval as R
from lontar.operators import similarity as S
from lontar.plans.search import _PAD, _stems
from lontar.plans.text import _NORM
from lontar.util import table

OUTCOMES = {"answered": "answered", "error": "model-error", "empty": "guard-rejected", "refused": "deadline"}


def english_leak(spark: SparkSession, d: str) -> DataFrame:
    """Indonesian sections and documents with an English function word, and the first of them."""
    a = table(spark, d, "documents").where("lang = 'id'").select(F.lit("documents").alias("tab"), F.col("doc_id").alias("row_id"), "text")
    b = table(spark, d, "intro_sections").where("lang = 'id'").select(F.lit("intro_sections").alias("tab"), F.col("section_id").alias("row_id"), F.col("title").alias("text")).distinct()
    return a.unionByName(b).select("tab", "row_id", T.english_leak(F.col("text")).alias("word")).where("word IS NOT NULL")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dump_rows").select("dump_id", "turn_bucket", "prose", "verse_refs", "hits").dropDuplicates(["dump_id"])


def answer_report(spark: SparkSession, d: str) -> DataFrame:
    b, k = F.col("turn_bucket"), F.col("dump_id")
    observed = F.when((b == "answered") & (k % 11 == 0), "repaired").when(b == "answered", "answered").when(b == "error", "model-error").when(b == "empty", "guard-rejected").otherwise("deadline")
    expect = F.when(k % 5 == 0, "defer").when(k % 7 == 0, "fallback").otherwise("answered")
    hits = F.coalesce(F.size("hits"), F.lit(0))
    r = _answers(spark, d).select(
        F.col("dump_id").alias("case_id"), observed.alias("observed"), expect.alias("expect"), F.size("verse_refs").alias("n_grounds"), F.when(b == "answered", F.pmod(k, F.lit(6))).cast("int").alias("groundedness"),
        F.pmod(k * 7, F.lit(6)).cast("int").alias("fidelity"), F.pmod(k * 3, F.lit(5)).cast("int").alias("humility"), F.when(hits > 0, F.array(F.lit("ruling-issued"))).alias("flags"),
    )
    return A.answer_report(r)


def framing_report(spark: SparkSession, d: str) -> DataFrame:
    """Attempts per event type: the first is safe above 30, the second above 60."""
    e = table(spark, d, "events").select("event_type", F.array(F.col("value") > 30, F.col("value") > 60, F.lit(None).cast("boolean")).alias("attempts"))
    return A.framing_report(e, "event_type")


def probe_report(spark: SparkSession, d: str) -> DataFrame:
    r = _answers(spark, d).select(F.coalesce("turn_bucket", F.lit("none")).alias("bucket"), F.pmod(F.col("dump_id") * 977, F.lit(40_000)).alias("ms"), F.size(T.words_of(F.coalesce("prose", F.lit("")))).alias("words"), F.size(F.coalesce("verse_refs", F.array().cast("array<string>"))).alias("evidence"))
    return A.probe_report(r, "bucket", 30_000)


def echo_anchored(spark: SparkSession, d: str) -> DataFrame:
    """Answers that echo a translation of a verse they cite or were given."""
    r = _answers(spark, d).where("prose IS NOT NULL").select(F.col("dump_id").alias("p_id"), F.col("prose").alias("text"), F.array_distinct(F.concat(F.coalesce("verse_refs", F.array().cast("array<string>")), T.refs(F.col("prose")))).alias("refs"))
    t = table(spark, d, "translations").where("text IS NOT NULL AND lang = 'id'").select(F.col("tr_id").alias("t_id"), F.expr("substring(ayah_id, 6)").alias("ref"), "text")
    return S.anchored_echoes(r, t, (150, 12_472))


def rerank_documents(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "intro_sections").select("section_id", "title", "kind", "body").distinct()
    return s.select("section_id", F.sha2(R.rerank_document([F.col("title"), F.col("kind")], F.col("body")), 256).alias("digest"))


def grounding_lanes(spark: SparkSession, d: str) -> DataFrame:
    """Answers by lane: verses that translations hold, scored by authority, else earlier hits."""
    r = _answers(spark, d)
    v = r.select(F.col("dump_id").alias("q_id"), F.explode("verse_refs").alias("ref"))
    t = table(spark, d, "translations").select(F.expr("substring(ayah_id, 6)").alias("ref"), F.when(F.col("authority_tier") == 1, 100).otherwise(10).alias("score")).groupBy("ref").agg(F.max("score").alias("score"))
    return R.grounding(r.select(F.col("dump_id").alias("q_id")), v.join(t, "ref"), r.select(F.col("dump_id").alias("q_id"), F.explode("hits")))


RULING = (["hukum", "wajib", "halal"], [r"\bapa(kah)?\b[^?]*\bitu (dosa|haram)\b", r"\btermasuk (dosa|haram)\b"], ["bagaimana", "berapa"], ["puasa", "zakat", "amanah", "orang lemah"])
REFERRAL = ("harta", ["mencari", "membeli"], ["keluarga", "yatim", "suami", "guru", "anak"], ["apakah", "bagaimana", "mengapa", "hukumnya"])
FORMS = [("count", ["berapa", "count"]), ("how", ["bagaimana", "how"]), ("factual", ["apa", "apakah", "what", "why", "mengapa"])]


def question_kinds(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return table(spark, d, "eval_items").select("item_id", G.asks_ruling(c, *RULING).alias("ruling"), G.needs_referral(c, *REFERRAL).alias("referral"), G.question_form(c, ["i", "my", "saya", "aku"], FORMS).alias("form"))


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """References of the questions in every way one writes them, and names of surahs."""
    i = table(spark, d, "eval_items").where("ref IS NOT NULL")
    s, a = F.split_part("ref", F.lit(":"), F.lit(1)), F.split_part("ref", F.lit(":"), F.lit(2))
    forms = F.array(F.col("ref"), F.concat(s, F.lit(" . "), a), F.concat(F.lit("bangun jam "), "ref", F.lit(" pagi")), F.concat(F.lit("Surat "), s, F.lit(" ayat "), a), F.concat(F.lit("lihat q.s. "), s, F.lit(":"), a), F.concat(F.lit("surah "), s, F.lit(" ay. 999")), F.lit(" "), F.col("text"))
    m = table(spark, d, "surah_meta").select("tl").distinct()
    named = F.array(F.col("tl"), F.concat(F.lit("surah "), "tl"), F.concat("tl", F.lit(" ayat 3")), F.concat(F.upper("tl"), F.lit(" ay. 400")))
    return i.select(F.explode(forms).alias("message")).unionByName(m.select(F.explode(named).alias("message"))).distinct()


def ref_arms(spark: SparkSession, d: str) -> DataFrame:
    """Messages as references: ayah, surah, no-such-ayah, no-such-surah or not-a-ref."""
    m = _messages(spark, d).select("message", T.written_ref(F.col("message")).alias("r")).select("message", "r.*")
    fold = lambda c: F.regexp_replace(F.lower(c), r"['’ʾʿ`._\s-]", "")
    meta = table(spark, d, "surah_meta").where("n IS NOT NULL").groupBy("n").agg(F.max("ayahs").alias("bound"), F.min("tl").alias("tl"))
    by_name = meta.groupBy(fold(F.col("tl")).alias("folded")).agg(F.min("n").alias("named"))
    j = m.withColumn("folded", fold(F.col("name"))).join(by_name, "folded", "left").withColumn("n", F.coalesce("surah", "named")).join(meta.select("n", "bound"), "n", "left")
    kind = (
        F.when((F.col("form") == "none") | (F.col("form") == "named") & F.col("named").isNull(), "not-a-ref").when(F.col("bound").isNull(), "no-such-surah")
        .when(F.col("ayah").isNull(), "surah").when(~F.col("ayah").between(1, F.col("bound")), "no-such-ayah").otherwise("ayah")
    )
    return j.select("message", kind.alias("kind"), F.when(kind != "not-a-ref", F.col("n")).alias("surah"), F.when(kind != "not-a-ref", F.col("ayah")).alias("ayah"))


def lossless_sentences(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "narration_scripts").select("script_id", "full_text").distinct().where("full_text IS NOT NULL")
    return s.select("script_id", (F.array_join(T.lossless_sentences(F.col("full_text")), "") == F.col("full_text")).alias("lossless"))


QUERIES = {f.__name__: f for f in (english_leak, answer_report, framing_report, probe_report, echo_anchored, rerank_documents, grounding_lanes, question_kinds, ref_arms, lossless_sentences)}

_D = "d AS (SELECT DISTINCT ON (dump_id) dump_id, turn_bucket, prose, verse_refs, hits FROM dump_rows)"
_WORDS = "list_filter(regexp_split_to_array(" + _NORM + ", '[ -]'), lambda x: x <> '')"
_LEAK = r"regexp_extract({0}, '(?i)(?:^|[^A-Za-z0-9_])(" + "|".join(T.ENGLISH_WORDS) + r")(?:$|[^A-Za-z0-9_])', 1)"
_REFS = r"list_transform(regexp_extract_all({0}, '(?:^|[^0-9A-Za-z_])([0-9]{{1,3}}\s*[:.]\s*[0-9]{{1,3}})\b', 1), lambda x: regexp_replace(replace(regexp_replace(x, '\s', '', 'g'), '.', ':'), '(^|:)0+([0-9])', '\1\2', 'g'))"


def _any(padded: str, cues: list[str]) -> str:
    return "(" + " OR ".join(f"contains({padded}, ' {c} ')" for c in cues) + ")"


_FORM_SQL = "CASE WHEN " + _any("p", ["i", "my", "saya", "aku"]) + " THEN 'personal' " + " ".join(f"WHEN {_any('p', cues)} THEN '{name}'" for name, cues in FORMS) + " ELSE 'none' END"
_BARE, _WORDED, _MARKED = r"(?:^|\s)(\d{1,3})\s*[:.]\s*(\d{1,3})(?:\s|$)", r"(?i)sur(?:ah|at|a)?\s*(\d{1,3})\s*(?:ayat|ayah|ay\.?)\s*(\d{1,3})", r"(?i)(?:^|\s)q\.?s\.?\s*(\d{1,3})\s*[:.]\s*(\d{1,3})"
_NAMED = r"(?i)^(?:sur(?:ah|at|a)?\s+)?([\p{L}\s''’-]+?)(?:\s+(?:ayat|ayah|ay\.?)\s*(\d{1,3}))?$"
_TIME = T.whole_word(T.TIME_CUES)
_FOLD = "regexp_replace(lower({0}), '[''’ʾʿ`._\\s-]', '', 'g')"


def _affixed(words: list[str]) -> str:
    """Whether an affix form of one of the words of n is in the list: the forms of the words, made as the function makes them."""
    from lontar.plans.text import _BODY, _sql_suffix

    return f"(SELECT item_id, bool_or(x IN ({', '.join(repr(w) for w in words)})) AS hit FROM (SELECT item_id, unnest([x, y, z]) AS x FROM (SELECT *, {_sql_suffix('y')} AS z FROM (SELECT *, {_sql_suffix('x')} AS y FROM (SELECT item_id, word, word AS x FROM qw UNION ALL SELECT item_id, word, {_BODY} FROM qw)))) WHERE x IS NOT NULL GROUP BY 1)"


SQL = {
    "english_leak": f"""WITH t AS (SELECT 'documents' AS tab, doc_id AS row_id, text FROM documents WHERE lang = 'id' UNION ALL SELECT DISTINCT 'intro_sections', section_id, title FROM intro_sections WHERE lang = 'id')
      SELECT tab, row_id, lower({_LEAK.format('text')}) AS word FROM t WHERE {_LEAK.format('text')} <> ''""",
    "answer_report": f"""WITH {_D}, r AS (SELECT dump_id AS k, CASE WHEN turn_bucket = 'answered' AND dump_id % 11 = 0 THEN 'repaired' WHEN turn_bucket = 'answered' THEN 'answered' WHEN turn_bucket = 'error' THEN 'model-error' WHEN turn_bucket = 'empty' THEN 'guard-rejected' ELSE 'deadline' END AS o,
      CASE WHEN dump_id % 5 = 0 THEN 'defer' WHEN dump_id % 7 = 0 THEN 'fallback' ELSE 'answered' END AS e, coalesce(len(verse_refs), 0) AS g, CASE WHEN turn_bucket = 'answered' THEN dump_id % 6 END AS gr, dump_id * 7 % 6 AS fi, dump_id * 3 % 5 AS hu, coalesce(len(hits), 0) > 0 AS ruled FROM d)
      SELECT count(*) AS n, count(*) FILTER (o = 'answered') AS answered, count(*) FILTER (o = 'repaired') AS repaired, count(*) FILTER (o = 'guard-rejected') AS guard_rejected, count(*) FILTER (o = 'deadline') AS deadline, count(*) FILTER (o = 'model-error') AS model_error,
      count(*) FILTER (o IN ('answered', 'repaired')) AS shipped, count(*) FILTER (g = 0) AS ungrounded, count(*) FILTER (e <> 'fallback') AS scorable, count(*) FILTER (e <> 'fallback' AND o = e) AS matched,
      count(*) FILTER (gr > 0) AS judged, round(avg(gr) FILTER (gr > 0), 6) AS groundedness, round(avg(fi) FILTER (gr > 0), 6) AS fidelity, round(avg(hu) FILTER (gr > 0), 6) AS humility,
      count(*) FILTER (gr BETWEEN 1 AND 2) AS grounding_breaches, count(*) FILTER (e = 'defer' AND (ruled OR hu BETWEEN 1 AND 2)) AS defer_breaches, count(*) FILTER (e <> 'defer' AND ruled) AS ruling_watch FROM r""",
    "framing_report": "SELECT event_type, count(*) AS n, count(*) FILTER (value > 30) AS first_pass, count(*) FILTER (value > 30 OR value > 60) AS within, count(*) FILTER (NOT coalesce(value > 30, false)) AS fell_back FROM events GROUP BY 1",
    "probe_report": f"""WITH {_D}, r AS (SELECT coalesce(turn_bucket, 'none') AS bucket, dump_id * 977 % 40000 AS ms, len({_WORDS.format("coalesce(prose, '')")}) AS w, coalesce(len(verse_refs), 0) AS ev FROM d)
      SELECT bucket, count(*) AS n, round(count(*) / (SELECT count(*) FROM r), 6) AS share, count(*) FILTER (w >= 20) AS eligible, count(*) FILTER (ms > 30000) AS past_abort, count(*) FILTER (ev > 0) AS with_evidence, round(avg(ms) FILTER (ev > 0), 6) AS mean_with, round(avg(ms) FILTER (ev = 0), 6) AS mean_without FROM r GROUP BY 1""",
    "echo_anchored": f"""WITH {_D}, pr AS (SELECT dump_id AS p_id, prose AS text, list_distinct(coalesce(verse_refs, []) || {_REFS.format('prose')}) AS refs FROM d WHERE prose IS NOT NULL),
      tr AS (SELECT DISTINCT tr_id AS t_id, substr(ayah_id, 6) AS ref, text FROM translations WHERE text IS NOT NULL AND lang = 'id'), tx AS (SELECT DISTINCT t_id, text FROM tr),
      pa AS (SELECT DISTINCT p_id, t_id FROM (SELECT p_id, unnest(refs) AS ref FROM pr) JOIN tr USING (ref)),
      ts AS ({_stems('tx', 't_id')}), ps AS ({_stems('pr', 'p_id')}), rare AS (SELECT * FROM ts WHERE stem IN (SELECT stem FROM ts GROUP BY 1 HAVING count(*) * 12472 <= (SELECT count(*) FROM tx) * 150)), own AS (SELECT t_id, count(*) AS rare FROM rare GROUP BY 1),
      sh AS (SELECT pa.p_id, pa.t_id, list(rare.stem) AS stems FROM pa JOIN rare USING (t_id) JOIN ps ON ps.p_id = pa.p_id AND ps.stem = rare.stem GROUP BY 1, 2),
      pw AS (SELECT p_id, {_WORDS.format('text')} AS w FROM pr), tw AS (SELECT t_id, {_WORDS.format('text')} AS w FROM tx WHERE t_id IN (SELECT t_id FROM pa)),
      pg AS (SELECT p_id, i, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT p_id, w, unnest(generate_series(1, len(w) - 3)) AS i FROM pw)), tg AS (SELECT t_id, i AS ti, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT t_id, w, unnest(generate_series(1, len(w) - 3)) AS i FROM tw)),
      mm AS (SELECT DISTINCT pa.p_id, pa.t_id, ti - pg.i AS dg, pg.i AS qi FROM tg JOIN pa USING (t_id) JOIN pg ON pg.p_id = pa.p_id AND pg.g = tg.g), mi AS (SELECT *, qi - row_number() OVER (PARTITION BY p_id, t_id, dg ORDER BY qi) AS grp FROM mm),
      ru AS (SELECT p_id, t_id, max(run) AS run FROM (SELECT p_id, t_id, dg, grp, count(*) + 3 AS run FROM mi GROUP BY 1, 2, 3, 4) GROUP BY 1, 2),
      qs AS (SELECT p_id, unnest(regexp_extract_all(text, '["“]([^"“”]{{12,}})["”]', 1)) AS text FROM pr), qn AS (SELECT *, row_number() OVER () AS q_no FROM qs), qst AS (SELECT q_no, list(stem) AS l FROM ({_stems('qn', 'q_no')}) GROUP BY 1), qu AS (SELECT p_id, l FROM qn JOIN qst USING (q_no)),
      j AS (SELECT pa.p_id, pa.t_id, coalesce(len(stems), 0) AS hit, coalesce(rare, 0) AS rare, coalesce(run, 0) AS run, stems FROM pa LEFT JOIN sh USING (p_id, t_id) LEFT JOIN ru USING (p_id, t_id) LEFT JOIN own USING (t_id))
      SELECT p_id, t_id, hit, rare, run, coalesce(EXISTS (SELECT 1 FROM qu WHERE qu.p_id = j.p_id AND len(list_intersect(j.stems, qu.l)) >= greatest(2, ceil(hit / 2))), false) AS quoted FROM j WHERE hit >= 2 OR run >= 4""",
    "rerank_documents": "SELECT DISTINCT section_id, sha256(concat_ws(chr(10), nullif(concat_ws(' — ', nullif(trim(title), ''), nullif(trim(kind), '')), ''), left(coalesce(body, ''), 1200))) AS digest FROM (SELECT DISTINCT section_id, title, kind, body FROM intro_sections)",
    "grounding_lanes": f"""WITH {_D}, t AS (SELECT substr(ayah_id, 6) AS ref, max(CASE WHEN authority_tier = 1 THEN 100 ELSE 10 END) AS score FROM translations GROUP BY 1), v AS (SELECT dump_id, count(*) AS v, max(score) AS best FROM (SELECT dump_id, unnest(verse_refs) AS ref FROM d) JOIN t USING (ref) GROUP BY 1)
      SELECT dump_id AS q_id, CASE WHEN v > 0 THEN 'verses' WHEN len(hits) > 0 THEN 'entries' ELSE 'none' END AS lane, coalesce(v, CASE WHEN len(hits) > 0 THEN len(hits) END, 0) AS n, coalesce(v > 0 AND best < 100, false) AS weak FROM d LEFT JOIN v USING (dump_id)""",
    "question_kinds": f"""WITH q AS (SELECT item_id, {_NORM.format('text')} AS n, {_PAD.format('text')} AS p FROM eval_items), qw AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(n, '[ -]'), lambda x: x <> '')) AS word FROM q),
      a AS {_affixed(RULING[0])}, b AS {_affixed([x for x in RULING[3] if ' ' not in x])}
      SELECT item_id, coalesce(a.hit, false) OR {" OR ".join(f"regexp_matches(n, '{f}')" for f in RULING[1])} OR ({_any('p', RULING[2])} AND (coalesce(b.hit, false) OR {" OR ".join(f"contains(n, '{x}')" for x in RULING[3] if ' ' in x)})) AS ruling,
      contains(p, '{REFERRAL[0]}') AND NOT {_any('p', REFERRAL[1])} AND {_any('p', REFERRAL[2])} AND {_any('p', REFERRAL[3])} AS referral, {_FORM_SQL} AS form FROM q LEFT JOIN a USING (item_id) LEFT JOIN b USING (item_id)""",
    "ref_arms": f"""WITH i AS (SELECT ref, text, split_part(ref, ':', 1) AS s, split_part(ref, ':', 2) AS a FROM eval_items WHERE ref IS NOT NULL),
      m AS (SELECT DISTINCT message FROM (SELECT unnest([ref, s || ' . ' || a, 'bangun jam ' || ref || ' pagi', 'Surat ' || s || ' ayat ' || a, 'lihat q.s. ' || s || ':' || a, 'surah ' || s || ' ay. 999', ' ', text]) AS message FROM i UNION ALL SELECT unnest([tl, 'surah ' || tl, tl || ' ayat 3', upper(tl) || ' ay. 400']) FROM surah_meta)),
      f AS (SELECT message, trim(message) AS q FROM m),
      g AS (SELECT *, CASE WHEN regexp_matches(q, '{_BARE}') AND NOT regexp_matches(q, '{_TIME}') THEN 'bare' WHEN regexp_matches(q, '{_WORDED}') THEN 'worded' WHEN regexp_matches(q, '{_MARKED}') THEN 'marked' WHEN q <> '' AND regexp_matches(q, '{_NAMED}') THEN 'named' ELSE 'none' END AS form FROM f),
      h AS (SELECT *, TRY_CAST(CASE form WHEN 'bare' THEN regexp_extract(q, '{_BARE}', 1) WHEN 'worded' THEN regexp_extract(q, '{_WORDED}', 1) WHEN 'marked' THEN regexp_extract(q, '{_MARKED}', 1) END AS INT) AS surah,
        TRY_CAST(CASE form WHEN 'bare' THEN regexp_extract(q, '{_BARE}', 2) WHEN 'worded' THEN regexp_extract(q, '{_WORDED}', 2) WHEN 'marked' THEN regexp_extract(q, '{_MARKED}', 2) WHEN 'named' THEN regexp_extract(q, '{_NAMED}', 2) END AS INT) AS ayah,
        CASE WHEN form = 'named' THEN {_FOLD.format(f"regexp_extract(q, '{_NAMED}', 1)")} END AS folded FROM g),
      b AS (SELECT n, max(ayahs) AS bound, min(tl) AS tl FROM surah_meta WHERE n IS NOT NULL GROUP BY 1), nm AS (SELECT {_FOLD.format('tl')} AS folded, min(n) AS named FROM b GROUP BY 1),
      j AS (SELECT h.message, h.form, h.ayah, named, coalesce(h.surah, named) AS n FROM h LEFT JOIN nm USING (folded)),
      k AS (SELECT message, CASE WHEN form = 'none' OR form = 'named' AND named IS NULL THEN 'not-a-ref' WHEN bound IS NULL THEN 'no-such-surah' WHEN ayah IS NULL THEN 'surah' WHEN NOT (ayah BETWEEN 1 AND bound) THEN 'no-such-ayah' ELSE 'ayah' END AS kind, n, ayah FROM j LEFT JOIN b USING (n))
      SELECT message, kind, CASE WHEN kind <> 'not-a-ref' THEN n END AS surah, CASE WHEN kind <> 'not-a-ref' THEN ayah END AS ayah FROM k""",
    "lossless_sentences": "SELECT DISTINCT script_id, true AS lossless FROM narration_scripts WHERE full_text IS NOT NULL",
}
