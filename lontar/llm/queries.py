"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.llm import abuse, cooccur, encoding, leakage, packing, plainform, spans, splitting
from lontar.plans.nested import TREE_SQL, narrow_shards, shard_refs
from lontar.util import cut, table


def _damage_values(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "surah").select(F.lit("surah").alias("tab"), F.col("verse_id").alias("row_id"), F.col("text").alias("val"))
    return a.unionByName(table(spark, d, "intro_sections").select(F.lit("intro_sections").alias("tab"), F.col("section_id").alias("row_id"), F.col("body").alias("val")))


def _form_values(spark: SparkSession, d: str) -> DataFrame:
    both = F.expr("stack(2, 'ar', ar, 'text', text) AS (field, val)")
    a = table(spark, d, "surah").select(F.lit("surah").alias("tab"), F.col("verse_id").alias("row_id"), both)
    return a.unionByName(table(spark, d, "intro_sections").select(F.lit("intro_sections").alias("tab"), F.col("section_id").alias("row_id"), F.lit("title").alias("field"), F.col("title").alias("val")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Values not in plain form; of the verses among them, those that are damaged as in p2 are left out."""
    changed = cut(plainform.plain_forms(_form_values(spark, d).where("val IS NOT NULL"), "val", only_changed=True))
    texts = changed.where("tab = 'surah' AND field = 'text'").select("tab", "row_id", "field", "val")
    garbled = encoding.damaged(texts, "val", _damage_values(spark, d)).select("tab", "row_id", "field").distinct()
    return changed.select("tab", "row_id", "field").distinct().join(garbled, ["tab", "row_id", "field"], "left_anti")


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """Headings and verses by plain form: how many different spellings and rows each has."""
    forms = plainform.plain_forms(_form_values(spark, d).where("val IS NOT NULL"), "val").dropDuplicates(["tab", "row_id", "field"])
    return forms.groupBy("tab", "field", "form").agg(F.countDistinct("val").alias("spellings"), F.count("*").alias("n_rows"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.damaged(_damage_values(spark, d), "val").select("tab", "row_id").distinct()


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    """Damaged rows with what was written, as far as it can be had: by undoing the encodings, and for verses with lost
    characters from the one wording of another version that fits."""
    rows = cut(encoding.damaged(_damage_values(spark, d), "val").dropDuplicates(["tab", "row_id"]))
    verses = table(spark, d, "surah").select(F.col("verse_id").alias("row_id"), "n", "a", "text")
    bad = rows.where("tab = 'surah'").select("row_id")
    lost = verses.join(rows.where("tab = 'surah' AND NOT complete").select("row_id", "restored"), "row_id").select("n", "a", "row_id", "restored").distinct()
    found = encoding.from_versions(lost, verses.join(bad, "row_id", "left_anti"), ["n", "a"], ["row_id"]).withColumn("tab", F.lit("surah"))
    j = rows.join(found, ["tab", "row_id"], "left")
    chains = F.when(F.col("found").isNotNull(), F.trim(F.concat_ws(" ", "chains", F.lit("version")))).otherwise(F.col("chains"))
    return j.select("tab", "row_id", F.coalesce("found", "restored").alias("restored"), chains.alias("chains"), (F.col("complete") | F.col("found").isNotNull()).alias("complete"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.frequent(cooccur.associations(cooccur.reference_baskets(narrow_shards(spark, d)))).select("a", "b")


def p3_bonds(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.against_published(cooccur.associations(cooccur.reference_baskets(narrow_shards(spark, d))), table(spark, d, "bonds"))


def p3_by_surah(spark: SparkSession, d: str) -> DataFrame:
    """As p3_found, of large baskets: all slugs that cite a surah, up to 240 in each."""
    refs = shard_refs(spark, d, ("slug",)).where("surah IS NOT NULL").select("surah", "slug")
    found = cooccur.associations(cut(refs.groupBy("surah").agg(F.collect_set("slug").alias("items"))))
    return found.select("a", "b", "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    a = splitting.split_texts(table(spark, d, "narration_scripts"), "script_id", "full_text")
    b = splitting.split_texts(table(spark, d, "intro_sections"), "section_id", "body")
    tag = lambda df, t, k: df.select(F.lit(t).alias("tab"), F.col(k).alias("row_id"), *[c for c in df.columns if c != k])
    return tag(a, "narration_scripts", "script_id").unionByName(tag(b, "intro_sections", "section_id"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The rows that the splitting cut, told from its pieces."""
    return p6_pieces(spark, d).where("piece_no = 0").select("tab", "row_id")


def p6_checked(spark: SparkSession, d: str) -> DataFrame:
    """Per text that was cut: whether the pieces without their leads join to it, are within the limit, and each lead is how the piece before ends."""
    p = p6_pieces(spark, d)
    cut_off = F.expr("decode(substring(encode(piece, 'UTF-8'), lead_bytes + 1), 'UTF-8')")
    lead = F.expr("decode(substring(encode(piece, 'UTF-8'), 1, lead_bytes), 'UTF-8')")
    g = p.groupBy("tab", "row_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", cut_off.alias("body"), lead.alias("lead")))).alias("l"), F.max("n_bytes").alias("most"), F.max("lead_bytes").alias("most_lead"))
    ok = F.forall(F.sequence(F.lit(1), F.greatest(F.size("l") - 1, F.lit(1))), lambda i: F.get("l", i).isNull() | F.endswith(F.get("l", i - 1).body, F.get("l", i).lead))
    g = g.select("tab", "row_id", F.array_join(F.col("l.body"), "").alias("text"), (F.col("most") <= splitting.LIMIT).alias("within"), (ok & (F.col("most_lead") <= splitting.OVERLAP)).alias("led"))
    texts = table(spark, d, "narration_scripts").select(F.lit("narration_scripts").alias("tab"), F.col("script_id").alias("row_id"), F.xxhash64("full_text").alias("h")).unionByName(table(spark, d, "intro_sections").select(F.lit("intro_sections").alias("tab"), F.col("section_id").alias("row_id"), F.xxhash64("body").alias("h"))).dropDuplicates(["tab", "row_id"])
    return g.join(texts, ["tab", "row_id"]).select("tab", "row_id", (F.xxhash64("text") == F.col("h")).alias("whole"), "within", "led")


SPAN_TABLES = ("translations", "dump_rows")


def _span_records(spark: SparkSession, d: str) -> DataFrame:
    """Both tables under one record number: the key times two, plus one for dump_rows."""
    a = table(spark, d, "translations").select((F.col("tr_id") * 2).alias("rec"), "text", "loaded_at")
    return a.unionByName(table(spark, d, "dump_rows").select((F.col("dump_id") * 2 + 1).alias("rec"), F.col("prose").alias("text"), "loaded_at"))


def _span_keys(df: DataFrame) -> DataFrame:
    tab = F.when(F.col("rec") % 2 == 0, SPAN_TABLES[0]).otherwise(SPAN_TABLES[1])
    return df.select(tab.alias("tab"), F.floor(F.col("rec") / 2).cast("bigint").alias("row_id"), *[c for c in df.columns if c != "rec"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _span_keys(spans.shared_windows(_span_records(spark, d), "loaded_at").select("rec").distinct())


def p4_stretches(spark: SparkSession, d: str) -> DataFrame:
    """Per record: its words, how many of them stand elsewhere, and the stretches as first word:words."""
    s = _span_keys(spans.stretches(spans.shared_windows(_span_records(spark, d), "loaded_at")))
    return s.withColumn("stretches", F.array_join(F.transform("stretches", lambda x: F.concat_ws(":", x.start, x.words)), " "))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_containers(packing.token_counts(table(spark, d, "documents")))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, the least there could be, and unused tokens."""
    return packing.fill_report(p8_containers(spark, d))


def p8_checked(spark: SparkSession, d: str) -> DataFrame:
    """What holds of every packing: each document is there, none is split without need, and no container is overfull."""
    return p8_fill(spark, d).select("documents", "overfull", "split", (F.col("containers") <= F.col("lower_bound") * 1.01 + 1).alias("tight"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Of the windows that the seeds find, the exact ones."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).where("substitutions = 0").select("doc_id", "item_id").distinct()


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Per test item that leaked: the documents that hold it, exactly or with a word substituted, and the most of it in one."""
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct(F.when(F.col("substitutions") == 0, F.col("doc_id"))).alias("n_exact"), F.max("item_words").alias("most_words"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_scores(spark, d).where("flagged").select("doc_id").distinct()


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scored(table(spark, d, "documents"), table(spark, d, "doc_labels"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(p10_scores(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_classes, p2_found, p2_restored, p3_found, p3_bonds, p3_by_surah, p4_found, p4_stretches, p6_found, p6_pieces, p6_checked, p8_containers, p8_fill, p8_checked, p9_found, p9_items, p10_found, p10_scores, p10_rates)
}

_BASKETS = """
WITH shards AS (SELECT DISTINCT ON (shard_id) * FROM peta_shards),
lone AS (SELECT slug, CAST(raw_json AS JSON)->'$.subtopics' AS v FROM shards WHERE subtopics IS NULL AND raw_json IS NOT NULL AND json_valid(raw_json)
  UNION ALL SELECT slug, CAST(to_json(subtopics) AS JSON) FROM shards WHERE subtopics IS NOT NULL),
s AS (SELECT slug, unnest(CASE json_type(v) WHEN 'ARRAY' THEN CAST(v AS JSON[]) WHEN 'OBJECT' THEN [v] ELSE [] END)->'$.entries' AS v FROM lone),
e AS (SELECT slug, unnest(CASE json_type(v) WHEN 'ARRAY' THEN CAST(v AS JSON[]) WHEN 'OBJECT' THEN [v] ELSE [] END)->'$.refs' AS v FROM s),
r AS (SELECT slug, unnest(CASE json_type(v) WHEN 'ARRAY' THEN CAST(v AS JSON[]) WHEN 'OBJECT' THEN [v] ELSE [] END)->'$.bridge' AS v FROM e),
b AS (SELECT row_number() OVER () AS id, list_distinct(list_append(CASE json_type(v) WHEN 'ARRAY' THEN CAST(v AS VARCHAR[]) WHEN 'VARCHAR' THEN [v->>'$'] ELSE [] END, slug)) AS items FROM r),
i AS (SELECT id, unnest(items) AS item FROM b),
c AS (SELECT item, count(*) AS n FROM i GROUP BY 1),
p AS (SELECT x.item AS a, y.item AS b, count(*) AS n_ab FROM i x JOIN i y ON x.id = y.id AND x.item < y.item GROUP BY 1, 2),
q AS (SELECT p.a, p.b, p.n_ab, ca.n AS n_a, cb.n AS n_b, (SELECT count(*) FROM b) AS n FROM p JOIN c ca ON ca.item = p.a JOIN c cb ON cb.item = p.b)
"""

_WINDOWS = """
WITH recs AS (SELECT DISTINCT 'translations' AS tab, tr_id AS row_id, text AS t FROM translations WHERE text IS NOT NULL UNION ALL SELECT DISTINCT 'dump_rows', dump_id, prose FROM dump_rows WHERE prose IS NOT NULL),
w AS (SELECT tab, row_id, list_filter(regexp_split_to_array(t, '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'), lambda x: x <> '') AS w FROM recs),
g AS (SELECT tab, row_id, w, unnest(generate_series(1, len(w) - 19)) AS p FROM w WHERE len(w) >= 20),
h AS (SELECT tab, row_id, len(w) AS n, p, array_to_string(w[p:p + 19], ' ') AS win FROM g),
s AS (SELECT win FROM h GROUP BY win HAVING count(DISTINCT (tab, row_id)) > 1)
"""

SQL = {
    "p1_classes": f"""WITH vals AS (SELECT DISTINCT 'surah' AS tab, verse_id AS row_id, 'ar' AS field, ar AS val FROM surah UNION ALL SELECT DISTINCT 'surah', verse_id, 'text', text FROM surah UNION ALL SELECT DISTINCT 'intro_sections', section_id, 'title', title FROM intro_sections),
      batch AS MATERIALIZED (SELECT row_number() OVER () AS i, * FROM vals WHERE val IS NOT NULL), f AS ({plainform.form_sql("val", "batch")})
      SELECT tab, field, form, count(DISTINCT val) AS spellings, count(*) AS n_rows FROM batch JOIN f USING (i) GROUP BY 1, 2, 3""",
    "p3_found": _BASKETS + "SELECT a, b FROM q WHERE n_ab >= 5 AND n_ab * n >= 4 * n_a * n_b",
    "p3_bonds": _BASKETS
    + """, k AS (SELECT least(a, b) AS a, greatest(a, b) AS b, arg_max(n, (release, n)) AS n_published FROM bonds WHERE a <> b GROUP BY 1, 2)
SELECT k.a, k.b, k.n_published, coalesce(q.n_ab, 0) AS n_ab, round(q.n_ab::DOUBLE * q.n / (q.n_a::DOUBLE * q.n_b), 6) AS lift FROM k LEFT JOIN q ON q.a = k.a AND q.b = k.b""",
    "p3_by_surah": TREE_SQL
    + """, bs AS (SELECT DISTINCT surah, slug FROM refs JOIN (SELECT DISTINCT shard_id, slug FROM peta_shards) USING (shard_id) WHERE surah IS NOT NULL),
c AS (SELECT slug, count(*) AS n FROM bs GROUP BY 1), p AS (SELECT x.slug AS a, y.slug AS b, count(*) AS n_ab FROM bs x JOIN bs y ON x.surah = y.surah AND x.slug < y.slug GROUP BY 1, 2)
SELECT p.a, p.b, n_ab, ca.n AS n_a, cb.n AS n_b, round(n_ab::DOUBLE * (SELECT count(DISTINCT surah) FROM bs) / (ca.n::DOUBLE * cb.n), 6) AS lift FROM p JOIN c ca ON ca.slug = p.a JOIN c cb ON cb.slug = p.b""",
    "p4_found": _WINDOWS + "SELECT DISTINCT tab, row_id FROM h WHERE win IN (SELECT win FROM s)",
    "p4_stretches": _WINDOWS
    + """, f AS (SELECT DISTINCT tab, row_id, n, p - 1 AS p FROM h WHERE win IN (SELECT win FROM s)),
i AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY tab, row_id ORDER BY p) <= 20 THEN 0 ELSE 1 END AS first FROM f),
m AS (SELECT *, sum(first) OVER (PARTITION BY tab, row_id ORDER BY p) AS grp FROM i),
k AS (SELECT tab, row_id, n, grp, min(p) AS start, max(p) + 20 - min(p) AS words FROM m GROUP BY 1, 2, 3, 4)
SELECT tab, row_id, CAST(n AS INT) AS n_words, CAST(sum(words) AS INT) AS n_shared, string_agg(start || ':' || words, ' ' ORDER BY start) AS stretches FROM k GROUP BY 1, 2, 3""",
    "p8_checked": "SELECT count(DISTINCT doc_id) AS documents, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS split, true AS tight FROM documents",
    "p9_found": """
WITH d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') || ' ' AS t FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
g AS (SELECT item_id, array_to_string(w, ' ') AS win FROM i WHERE len(w) BETWEEN 1 AND 9 UNION SELECT item_id, array_to_string(w[p:p + 9], ' ') FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 9)) AS p FROM i WHERE len(w) >= 10))
SELECT DISTINCT doc_id, item_id FROM d, g WHERE contains(t, ' ' || win || ' ')""",
    "p9_items": """
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
ip AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS q FROM iw WHERE len(w) > 0),
ig AS (SELECT item_id, n, q, w[q:q + n - 1] AS x FROM ip),
dp AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM dw, (SELECT DISTINCT n FROM ig) WHERE len(w) >= n),
dg AS (SELECT doc_id, n, p, w[p:p + n - 1] AS y FROM dp),
i2 AS (SELECT *, array_to_string(list_filter(x, lambda v, k: k % 2 = 1), ' ') AS a, array_to_string(list_filter(x, lambda v, k: k % 2 = 0), ' ') AS b FROM ig),
d2 AS (SELECT *, array_to_string(list_filter(y, lambda v, k: k % 2 = 1), ' ') AS a, array_to_string(list_filter(y, lambda v, k: k % 2 = 0), ' ') AS b FROM dg),
c AS (SELECT doc_id, item_id, n, p, q, x, y FROM d2 JOIN i2 USING (n, a) UNION SELECT doc_id, item_id, n, p, q, x, y FROM d2 JOIN i2 USING (n, b) WHERE n > 1),
hit AS (SELECT *, len(list_filter(list_zip(x, y), lambda z: z[1] <> z[2])) AS wrong FROM c WHERE len(list_filter(list_zip(x, y), lambda z: z[1] <> z[2])) <= least(1, n - 1)),
cov AS (SELECT doc_id, item_id, count(DISTINCT w) AS item_words FROM (SELECT doc_id, item_id, unnest(generate_series(q, q + n - 1)) AS w FROM hit) GROUP BY 1, 2),
g AS (SELECT doc_id, item_id, min(wrong) AS wrong FROM hit GROUP BY 1, 2)
SELECT item_id, count(DISTINCT doc_id) AS n_docs, count(DISTINCT CASE WHEN wrong = 0 THEN doc_id END) AS n_exact, CAST(max(item_words) AS INT) AS most_words FROM g JOIN cov USING (doc_id, item_id) GROUP BY 1""",
    "p6_checked": "SELECT DISTINCT 'narration_scripts' AS tab, script_id AS row_id, true AS whole, true AS within, true AS led FROM narration_scripts WHERE strlen(full_text) > 3000 UNION ALL SELECT DISTINCT 'intro_sections', section_id, true, true, true FROM intro_sections WHERE strlen(body) > 3000",
    "p6_found": "SELECT DISTINCT 'narration_scripts' AS tab, script_id AS row_id FROM narration_scripts WHERE strlen(full_text) > 3000 UNION ALL SELECT DISTINCT 'intro_sections', section_id FROM intro_sections WHERE strlen(body) > 3000",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
