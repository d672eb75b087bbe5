"""Queries of filters, orders, lookups and injected functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.functions import arrays as X
from lontar.functions import text as T
from lontar.operators import retrieval as R
from lontar.plans.text import _NORM, _SET
from lontar.sources import readers
from lontar.util import ship, table

THEMES = ["kajian", "forum", "malam"]
KINDS = ["names", "aims", "topics", "virtues"]
PHRASES = ["di negeri jauh", "di hadapan saksi", "sepanjang hidupnya"]
SYNONYMS = {"laut": "air", "sungai": "air", "hujan": "air"}
ALIASES = ["hati tenang", "pasar ramai", "orang lemah"]


def closed_set_guard(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("source IS NOT NULL").select("doc_id", X.closed_set(F.concat(F.split("source", "-"), F.split("source", "-")), THEMES, 2).alias("l"))
    return t.select("doc_id", F.array_join("l", ",").alias("themes"))


def fragment_openers(spark: SparkSession, d: str) -> DataFrame:
    """Documents that open in the middle of something: with a small letter, or a word that points back."""
    t = table(spark, d, "documents").where("text IS NOT NULL AND lang = 'id'")
    small, back = F.col("text").rlike("^[a-z]"), T.opens_dangling(F.col("text"), ["itu", "mereka", "lalu", "maka"])
    first = F.regexp_extract("text", r"^([^.!?\n]*)", 1)
    return t.where(small | back).select("doc_id", small.alias("small"), back.alias("back"), F.contains(F.lower(first), F.lit(" itu ")).alias("refers"))


def card_filter(spark: SparkSession, d: str) -> DataFrame:
    """Categories whose name holds a needle, and whether it is the only one."""
    c = table(spark, d, "peta_shards").select("slug", "category").distinct()
    hit = c.where(F.contains(F.lower("category"), F.lit("dan"))).select("slug")
    n = hit.count()
    return hit.select("slug", F.lit(n).cast("bigint").alias("n"), F.lit(n == 1).alias("sole"))


def natural_order(spark: SparkSession, d: str) -> DataFrame:
    """Corpus versions in numeric-aware order."""
    v = table(spark, d, "surah").select("corpus_version").distinct()
    return v.select("corpus_version", X.natural_key(F.col("corpus_version")).alias("key"))


def kind_order(spark: SparkSession, d: str) -> DataFrame:
    """The first three sections of each chapter: official ones first, then kinds in their explicit order."""
    from lontar.operators.windows import top_n

    s = table(spark, d, "intro_sections").select("section_id", "n", "official", "kind", "lang").distinct()
    t = top_n(s, ["n"], [F.when(F.col("lang") == "id", 0).otherwise(1), F.when(F.col("official"), 0).otherwise(1), X.enum_place(F.col("kind"), KINDS), F.col("section_id")], 3)
    return t.select("n", "section_id", F.col("rank").cast("bigint").alias("rank"))


def collocation_words(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.outside_phrases(F.col("text"), PHRASES).alias("w"), T.word_set(F.col("text")).alias("a"))
    return t.select("doc_id", F.array_contains("w", "jauh").alias("jauh"), F.array_contains("w", "saksi").alias("saksi"), (F.size("a") - F.size("w")).alias("masked")).where("masked > 0")


def alias_subset(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "eval_items").select("item_id", T.words_of(F.col("text")).alias("w"))
    a = q.select("item_id", "w", F.explode(F.array(*map(F.lit, ALIASES))).alias("alias"))
    return a.where(T.alias_hit(F.col("w"), F.col("alias"))).select("item_id", "alias")


def synonym_words(spark: SparkSession, d: str) -> DataFrame:
    w = T.with_synonyms(T.word_set(F.col("text")), SYNONYMS)
    return table(spark, d, "eval_items").select("item_id", F.size(w).alias("n"), F.array_contains(w, "air").alias("water"))


def linked_refs(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("ref IS NOT NULL").select("doc_id", F.concat(F.lit("Lihat "), "ref", F.lit(" (dan "), "ref", F.lit("), bukan 1:2:3.")).alias("t"))
    return t.select("doc_id", T.linkify(F.col("t"), "/q").alias("linked"))


def formula_strip(spark: SparkSession, d: str) -> DataFrame:
    """First verses, given a marked formula to begin with, without it again; chapters without one are exempt."""
    m = table(spark, d, "surah_meta").groupBy("n").agg(F.min("bismillah").alias("b"))
    v = table(spark, d, "surah").select("verse_id", "n", "a", "ar").distinct().join(F.broadcast(m), "n").where("ar IS NOT NULL")
    led = (F.col("a") == 1) & F.col("b")
    v = v.select("verse_id", "ar", "a", "b", F.when(led, F.concat(F.lit("بِسْمِ ٱلله "), "ar")).otherwise(F.col("ar")).alias("t"))
    out = T.without_formula(F.col("t"), "بسم الله", F.col("a") == 1, ~F.col("b"))
    return v.select("verse_id", F.md5(out).alias("digest"))


def failure_classes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'error'")
    m = F.concat(F.lit("HTTP "), (F.floor(F.col("value")) + 400).cast("string"))
    return e.groupBy(T.failure_class(m).alias("failure")).agg(F.count("*").alias("n"))


def centre_scale(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return X.centred(p, ["x", "y"], 1000.0)


def standalone_pick(spark: SparkSession, d: str) -> DataFrame:
    """The preferred document of each source that cites no verse: questions first, then sermons, then the lowest id."""
    t = table(spark, d, "documents").where("ref IS NULL AND source IS NOT NULL")
    return t.groupBy("source").agg(F.min_by("doc_id", F.struct(X.enum_place(F.col("kind"), ["qa", "sermon"]).alias("k"), "doc_id")).alias("doc_id"))


def path_keys(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "peta_shards").select(F.col("credit.url").alias("url")).distinct()
    return c.select("url", readers.path_key(F.col("url"), 2, 2).alias("host"), readers.path_number(F.col("url")).alias("number"))


def ordinal_join(spark: SparkSession, d: str) -> DataFrame:
    """Listed references by position with the length of the hit reported at the same position; unknown positions dropped."""
    r = table(spark, d, "dump_rows").select("dump_id", "verse_refs", "hits").dropDuplicates(["dump_id"])
    o = r.select("dump_id", F.posexplode("hits").alias("ordinal", "h")).select("dump_id", "ordinal", "h.rare")
    return X.by_ordinal(r, "dump_id", "verse_refs", o).select("dump_id", F.col("ordinal").cast("bigint").alias("ordinal"), F.col("item").alias("ref"), "rare")


def _fake_model(texts: list[str]) -> list[list[float]]:
    return [[b / 255 for b in hashlib.sha256(t.encode()).digest()[:4]] for t in texts]


def embed_missing(spark: SparkSession, d: str) -> DataFrame:
    """Vectors, by an injected model, of sections whose text is not among those of official ones."""
    s = table(spark, d, "intro_sections").select("section_id", "title", "official").distinct()
    done = s.where("official").select(F.sha2(F.left("title", F.lit(4000)), 256).alias("hash"))
    v = R.embed(s, "section_id", "title", _fake_model, done)
    return v.select("section_id", "hash", F.size("values").alias("dims"), F.round(F.element_at("values", 1), 6).alias("first"))


def single_quotes(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "translations").select("tr_id", "ayah_id", "lang", "text").distinct().where("text IS NOT NULL")
    q = R.single_quote(t.select("ayah_id", F.col("tr_id").alias("ord"), "lang", "text"), "ayah_id", F.contains("text", F.lit("Janganlah")), "id")
    return q.select("ayah_id", F.md5("quote").alias("quote"))


def shown_records(spark: SparkSession, d: str) -> DataFrame:
    """How many cited verses have a translation, and how many translated ones are never cited."""
    t = table(spark, d, "translations").select(F.regexp_replace("ayah_id", "^ayah:", "").alias("ref")).distinct()
    c = table(spark, d, "dump_rows").select(F.explode("verse_refs").alias("ref"))
    shown, rest = R.split_shown(t, c, "ref")
    return shown.agg(F.count("*").alias("n")).select(F.lit("shown").alias("part"), "n").unionByName(rest.agg(F.count("*").alias("n")).select(F.lit("reference").alias("part"), "n"))


ship(__name__)

QUERIES = {
    f.__name__: f
    for f in (closed_set_guard, fragment_openers, card_filter, natural_order, kind_order, collocation_words, alias_subset, synonym_words, linked_refs, formula_strip, failure_classes, centre_scale, standalone_pick, path_keys, ordinal_join, embed_missing, single_quotes, shown_records)
}

_HYPHEN = "list_filter(regexp_split_to_array(" + _NORM + ", '[ -]'), lambda x: x <> '')"


def _without(s: str) -> str:
    for _ in range(3):
        for p in PHRASES:
            s = f"replace({s}, ' {p} ', ' ')"
    return s


SQL = {
    "closed_set_guard": "WITH t AS (SELECT doc_id, list_filter(string_split(source, '-'), lambda x: x IN ('kajian', 'forum', 'malam')) AS l FROM documents WHERE source IS NOT NULL) SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[:2], ',') AS themes FROM t",
    "fragment_openers": f"""WITH t AS (SELECT doc_id, regexp_matches(text, '^[a-z]') AS small, regexp_extract({_NORM.format('text')}, '^([^\\s]+)', 1) IN ('itu', 'mereka', 'lalu', 'maka') AS back, contains(lower(regexp_extract(text, '^([^.!?\\n]*)', 1)), ' itu ') AS refers FROM documents WHERE text IS NOT NULL AND lang = 'id') SELECT * FROM t WHERE small OR back""",
    "card_filter": "WITH h AS (SELECT DISTINCT slug, category FROM peta_shards WHERE contains(lower(category), 'dan')) SELECT slug, (SELECT count(*) FROM h) AS n, (SELECT count(*) FROM h) = 1 AS sole FROM h",
    "natural_order": "SELECT DISTINCT corpus_version, array_to_string(list_transform(regexp_extract_all(corpus_version, '([0-9]+|[^0-9]+)', 1), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x::BIGINT::VARCHAR, 20, '0') ELSE x END), '') AS key FROM surah",
    "kind_order": "WITH s AS (SELECT DISTINCT section_id, n, official, kind, lang FROM intro_sections) SELECT n, section_id, row_number() OVER (PARTITION BY n ORDER BY (lang IS DISTINCT FROM 'id')::INT, (NOT coalesce(official, false))::INT, coalesce(nullif(list_position(['names', 'aims', 'topics', 'virtues'], kind), 0), 5), section_id) AS rank FROM s QUALIFY rank <= 3",
    "collocation_words": f"""WITH t AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array({_without("' ' || " + _NORM.format('text') + " || ' '")}, '\\s+'), lambda x: x <> '')) AS w, {_SET.format('text')} AS a FROM documents WHERE text IS NOT NULL)
      SELECT doc_id, list_contains(w, 'jauh') AS jauh, list_contains(w, 'saksi') AS saksi, len(a) - len(w) AS masked FROM t WHERE len(a) > len(w)""",
    "alias_subset": f"""WITH q AS (SELECT item_id, {_HYPHEN.format('text')} AS w FROM eval_items), x AS (SELECT item_id, list_concat(w, list_transform(w, lambda x: regexp_replace(x, '^(.{{3,}}?)(?:nya|ku|mu|kah|lah)$', '\\1'))) AS w FROM q)
      SELECT item_id, alias FROM x, (VALUES ('hati tenang'), ('pasar ramai'), ('orang lemah')) a(alias) WHERE list_has_all(w, string_split(alias, ' '))""",
    "synonym_words": f"WITH t AS (SELECT item_id, {_SET.format('text')} AS w FROM eval_items), s AS (SELECT item_id, w, len(list_intersect(w, ['laut', 'sungai', 'hujan'])) > 0 AS has FROM t) SELECT item_id, len(w) + (has AND NOT list_contains(w, 'air'))::INT AS n, has OR list_contains(w, 'air') AS water FROM s",
    "formula_strip": "SELECT DISTINCT verse_id, md5(ar) AS digest FROM surah WHERE ar IS NOT NULL AND n IN (SELECT n FROM surah_meta)",
    "linked_refs": "WITH t AS (SELECT doc_id, '[' || ref || '](/q/' || replace(ref, ':', '/') || ')' AS l FROM documents WHERE ref IS NOT NULL) SELECT doc_id, 'Lihat ' || l || ' (dan ' || l || '), bukan 1:2:3.' AS linked FROM t",
    "failure_classes": "WITH e AS (SELECT 'http ' || (floor(value)::BIGINT + 400) AS m FROM events WHERE event_type = 'error') SELECT CASE WHEN regexp_matches(m, 'timed? ?out|deadline') THEN 'timeout' WHEN regexp_matches(m, '429|rate limit') THEN 'limited' WHEN regexp_matches(m, '40[13]|denied') THEN 'denied' WHEN regexp_matches(m, '5[0-9][0-9]|unavailable') THEN 'server' ELSE 'other' END AS failure, count(*) AS n FROM e GROUP BY 1",
    "centre_scale": """WITH m AS (SELECT avg(s_acctbal) AS mx, avg(s_nationkey::DOUBLE) AS my FROM supplier), p AS (SELECT s_suppkey, s_acctbal - mx AS x, s_nationkey - my AS y FROM supplier, m), f AS (SELECT max(sqrt(x * x + y * y)) AS far FROM p)
      SELECT s_suppkey, round(x * (1000 / far))::BIGINT AS x, round(y * (1000 / far))::BIGINT AS y FROM p, f""",
    "standalone_pick": "SELECT source, doc_id FROM documents WHERE ref IS NULL AND source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY coalesce(nullif(list_position(['qa', 'sermon'], kind), 0), 3), doc_id) = 1",
    "path_keys": "SELECT DISTINCT credit.url AS url, CASE WHEN len(string_split(credit.url, '/')) > 2 THEN string_split(credit.url, '/')[3] ELSE '' END AS host, coalesce(TRY_CAST(regexp_extract(string_split(credit.url, '/')[-1], '[0-9]+') AS INT), 0) AS number FROM peta_shards",
    "ordinal_join": "WITH r AS (SELECT DISTINCT ON (dump_id) dump_id, verse_refs, hits FROM dump_rows), p AS (SELECT *, unnest(generate_series(1, least(coalesce(len(verse_refs), 0), coalesce(len(hits), 0)))) AS i FROM r) SELECT dump_id, i - 1 AS ordinal, verse_refs[i] AS ref, hits[i].rare AS rare FROM p",
    "embed_missing": "WITH s AS (SELECT DISTINCT section_id, title, official FROM intro_sections), h AS (SELECT section_id, official, sha256(coalesce(title, '')) AS hash, sha256(title) AS t FROM s) SELECT section_id, hash, 4 AS dims, round(('0x' || left(hash, 2))::INT / 255.0::DOUBLE, 6) AS first FROM h WHERE hash NOT IN (SELECT t FROM h WHERE official AND t IS NOT NULL)",
    "single_quotes": "WITH t AS (SELECT DISTINCT tr_id, ayah_id, lang, text FROM translations WHERE text IS NOT NULL), f AS (SELECT * FROM t WHERE ayah_id IN (SELECT ayah_id FROM t GROUP BY 1 HAVING count(*) <= 2)) SELECT ayah_id, md5(arg_min(text, tr_id)) AS quote FROM f WHERE lang = 'id' AND length(text) <= 3000 AND NOT contains(text, 'Janganlah') GROUP BY 1",
    "shown_records": "WITH t AS (SELECT DISTINCT regexp_replace(ayah_id, '^ayah:', '') AS ref FROM translations), c AS (SELECT unnest(verse_refs) AS ref FROM dump_rows) SELECT 'shown' AS part, count(*) AS n FROM t WHERE ref IN (SELECT ref FROM c) UNION ALL SELECT 'reference', count(*) FROM t WHERE ref NOT IN (SELECT ref FROM c WHERE ref IS NOT NULL)",
}
