"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.functions import text as T
from lontar.operators.aggregates import set_digest
from lontar.plans.nested import TREE_SQL
from lontar.util import blank_to_null, table


def text_normalize_digest(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").select("doc_id", T.norm(F.col("text")).alias("n"))
    return c.select("doc_id", F.sha2("n", 256).alias("digest"), F.substring(F.sha2("n", 256), 1, 12).alias("short"), F.octet_length("n").alias("n_bytes"))


def corpus_digest(spark: SparkSession, d: str) -> DataFrame:
    """Per source, a digest of its documents that does not depend on their order."""
    c = table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("source"), "doc_id", "text")
    return set_digest(c, ["source"], F.concat_ws(":", F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))))


def token_spread(spark: SparkSession, d: str) -> DataFrame:
    """Per word its document frequency and in how many sources it occurs."""
    c = table(spark, d, "documents").select("doc_id", "source", F.explode(T.word_set(F.col("text"))).alias("word"))
    return c.groupBy("word").agg(F.count("*").alias("df"), F.countDistinct("source").alias("sources")).where("df >= 5")


def token_sets(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents")
    t = F.col("text")
    return c.select("doc_id", F.size(T.word_set(t)).alias("space_words"), F.size(T.words_of(t)).alias("all_words"), F.size(T.long_words(t, 2)).alias("tokens"), F.size(T.long_words(t, 3, True)).alias("letter_words"))


def stem_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct words of Indonesian documents by stem; stemming runs once per distinct word."""
    c = table(spark, d, "documents").where("lang = 'id'").select(F.explode(F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9' ]+", " "), r"\s+")).alias("word"))
    w = c.where("word <> ''").where(~F.col("word").isin(*T.STOP_WORDS)).groupBy("word").agg(F.count("*").alias("n"))
    return w.select(T.stem(F.col("word")).alias("stem"), "n").where("length(stem) >= 3").groupBy("stem").agg(F.count("*").alias("words"), F.sum("n").alias("n"))


def affix_reach(spark: SparkSession, d: str) -> DataFrame:
    """Distinct affixed words that reach another word of the corpus once affixes are stripped."""
    c = table(spark, d, "documents").where("lang = 'id'").select(F.explode(T.word_set(F.col("text"))).alias("word")).distinct()
    forms = c.select("word", F.explode(T.affix_forms(F.col("word"))).alias("form")).where("form <> word")
    return forms.join(c.select(F.col("word").alias("form")), "form").select("word", "form")


def ref_extract(spark: SparkSession, d: str) -> DataFrame:
    """References written in documents, and how many of them are not the one the document is filed under."""
    c = table(spark, d, "documents").where("text IS NOT NULL")
    r = T.refs(F.col("text"))
    return c.select("doc_id", F.array_join(r, " ").alias("refs"), F.size(r).alias("n"), F.size(F.filter(r, lambda x: ~x.eqNullSafe(F.col("ref")))).alias("others")).where("n > 0")


def ref_parse(spark: SparkSession, d: str) -> DataFrame:
    """The written reference of each entry as name, chapter and range; bounds are reported, not swallowed."""
    from lontar.operators.nested import flat_tables

    e = flat_tables(table(spark, d, "peta_shards"))["entries"].where("ref IS NOT NULL").select("ref").distinct()
    pat = r"^QS\. (.+), ([0-9]+):([0-9]+)(?:-([0-9]+))?$"
    g = lambda k: F.regexp_extract("ref", pat, k)
    p = e.select("ref", blank_to_null(g(1)).alias("name"), g(2).try_cast("int").alias("surah"), g(3).try_cast("int").alias("first"), F.coalesce(g(4).try_cast("int"), g(3).try_cast("int")).alias("last"))
    b = table(spark, d, "surah_meta").groupBy("n").agg(F.max("ayahs").alias("bound"))
    kind = F.when(F.col("surah").isNull(), "unparsed").when(F.col("bound").isNull(), "no_chapter").when((F.col("first") < 1) | (F.col("last") > F.col("bound")), "out_of_range").when(F.col("last") < F.col("first"), "inverted").when(F.col("last") > F.col("first"), "range").otherwise("single")
    return p.join(F.broadcast(b), p.surah == b.n, "left").select("ref", "name", "surah", "first", "last", kind.alias("kind"))


def marker_codec(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").select("doc_id", F.concat("text", F.lit(" "), T.marker(F.regexp_replace("source", "[^a-z0-9-]", "-"), F.col("doc_id")), F.lit(" "), T.marker(F.lit("a"), F.lit(7))).alias("t"))
    return c.select("doc_id", F.array_join(T.markers(F.col("t")), " ").alias("ids"), F.length(T.without_markers(F.col("t"))).alias("rest"))


def quoted_spans(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").select("doc_id", F.posexplode(T.quoted_spans(F.col("text"), 4)).alias("pos", "span"))
    return c.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "span")


def markup_clean(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").select("doc_id", F.concat(F.lit("<p class='a'>"), T.html_escape(F.col("text")), F.lit("</p><BR/>x&nbsp;&amp; y")).alias("t"))
    return c.select("doc_id", F.md5(T.clean_markup(F.col("t"))).alias("clean"), F.length("t").alias("n"))


def slug_check(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "peta_shards").select("slug", "category").distinct()
    return c.select("slug", T.slugify(F.col("category")).alias("made"), (T.slugify(F.col("category")) == F.col("slug")).alias("same"))


def bounded_strings(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(T.cut_at_word(t, 120)).alias("cut"), F.md5(T.one_line(t, 60)).alias("line"), F.length(T.bounded(t, 40)).alias("n40"), F.octet_length(t).alias("n_bytes"))


def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "narration_scripts").select("script_id", "full_text").distinct().where("full_text IS NOT NULL")
    return s.select("script_id", F.size(T.sentences(F.col("full_text"))).alias("sentences"), (F.array_join(T.paragraphs(F.col("full_text")), "") == F.col("full_text")).alias("lossless"))


def arabic_names(spark: SparkSession, d: str) -> DataFrame:
    """Verses that agree once vowel marks and letter variants are folded."""
    c = table(spark, d, "surah").select("n", "a", T.arabic_fold(F.col("ar")).alias("folded")).distinct()
    return c.groupBy("n", "a").agg(F.count("*").alias("forms"), F.min(F.md5("folded")).alias("least"))


def name_fold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "surah_meta").select("tl").distinct().select("tl", T.latin_fold("tl").alias("folded"))


def variant_pick(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.variant_index(F.col("text"), 7).alias("variant"))


def time_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", T.time_label(F.col("value") * 60).alias("label"))


def heading_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Sections by the first word of the folded title, against the kind they are filed under."""
    s = table(spark, d, "intro_sections").where("lang = 'id'").select("section_id", "title", "kind").distinct()
    first = F.regexp_extract(T.norm(F.col("title")), "^[a-z]+", 0)
    kind = F.when(first.startswith("nama"), "names").when(first.isin("maksud", "tujuan"), "aims").when(first.startswith("pokok"), "topics").when(first == "keutamaan", "virtues").otherwise("other")
    return s.groupBy(kind.alias("guess"), F.coalesce("kind", F.lit("none")).alias("kind")).agg(F.count("*").alias("n"))


def json_payload(spark: SparkSession, d: str) -> DataFrame:
    """A member of the payload per user; what does not parse is skipped."""
    e = table(spark, d, "events").select("user_id", T.tolerant_json(F.concat(F.lit("log: "), F.col("props"), F.lit(" end")), "k BIGINT").alias("p"))
    return e.where("p.k IS NOT NULL").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("p.k").alias("total"), F.max("p.k").alias("top"))


QUERIES = {
    f.__name__: f
    for f in (text_normalize_digest, corpus_digest, token_spread, token_sets, stem_counts, affix_reach, ref_extract, ref_parse, marker_codec, quoted_spans, markup_clean, slug_check, bounded_strings, sentence_counts, arabic_names, name_fold, variant_pick, time_labels, heading_kinds, json_payload)
}

_NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\s-]', ' ', 'g'), '\s+', ' ', 'g'))"
_SET = "list_distinct(list_filter(string_split(" + _NORM + ", ' '), lambda x: x <> ''))"
_STOP = "(" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")"
_STEM0 = (
    "CASE WHEN regexp_matches(word, '^men[aeiou]') THEN 't' || substr(word, 4) WHEN regexp_matches(word, '^mem[aeiou]') THEN 'p' || substr(word, 4) "
    f"WHEN regexp_matches(word, '^meny[aeiou]') THEN 's' || substr(word, 5) ELSE regexp_replace(word, '^({T.STEM_PREFIXES})', '') END"
)


def _sql_suffix(x: str) -> str:
    return "CASE " + " ".join(f"WHEN length({x}) > {len(s) + 2} AND ends_with({x}, '{s}') THEN left({x}, length({x}) - {len(s)})" for s in T.AFFIX_SUFFIXES) + " END"


_BODY = "CASE " + " ".join(f"WHEN length(word) > {len(p) + 2} AND starts_with(word, '{p}') THEN substr(word, {len(p) + 1})" for p in T.AFFIX_PREFIXES) + " END"

SQL = {
    "text_normalize_digest": f"SELECT doc_id, sha256(n) AS digest, left(sha256(n), 12) AS short, strlen(n) AS n_bytes FROM (SELECT doc_id, {_NORM.format('text')} AS n FROM documents)",
    "corpus_digest": "WITH h AS (SELECT coalesce(source, '') AS source, sha256(doc_id || ':' || coalesce(text, '')) AS h FROM documents), p AS (SELECT source, left(h, 4) AS p, sha256(string_agg(h, '|' ORDER BY h)) AS d, count(*) AS n FROM h GROUP BY 1, 2) SELECT source, sha256(string_agg(d, '|' ORDER BY p)) AS digest, sum(n)::BIGINT AS n FROM p GROUP BY 1",
    "token_spread": f"SELECT word, count(*) AS df, count(DISTINCT source) AS sources FROM (SELECT doc_id, source, unnest({_SET.format('text')}) AS word FROM documents) GROUP BY word HAVING count(*) >= 5",
    "token_sets": f"""SELECT doc_id, len({_SET.format('text')}) AS space_words, len(list_filter(regexp_split_to_array({_NORM.format('text')}, '[ -]'), lambda x: x <> '')) AS all_words,
      len(list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: length(x) > 2))) AS tokens,
      len(list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^\\p{{L}}]+', ' ', 'g'), ' '), lambda x: length(x) > 3))) AS letter_words FROM documents""",
    "stem_counts": f"""WITH w AS (SELECT unnest(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9'' ]+', ' ', 'g'), '\\s+')) AS word FROM documents WHERE lang = 'id'),
      c AS (SELECT word, count(*) AS n FROM w WHERE word <> '' AND word NOT IN {_STOP} GROUP BY 1),
      s AS (SELECT word, n, regexp_replace({_STEM0}, '({T.STEM_SUFFIXES})$', '') AS s FROM c),
      t AS (SELECT CASE WHEN length(s) >= 3 THEN s ELSE word END AS stem, n FROM s)
      SELECT stem, count(*) AS words, sum(n)::BIGINT AS n FROM t WHERE length(stem) >= 3 GROUP BY 1""",
    "affix_reach": f"""WITH w AS (SELECT DISTINCT unnest({_SET.format('text')}) AS word FROM documents WHERE lang = 'id'), b AS (SELECT word, {_BODY} AS body FROM w),
      f0 AS (SELECT word, word AS x FROM b UNION SELECT word, body FROM b), f1 AS (SELECT word, x, {_sql_suffix('x')} AS y FROM f0), f2 AS (SELECT word, x, y, {_sql_suffix('y')} AS z FROM f1),
      f AS (SELECT word, x AS form FROM f2 UNION SELECT word, y FROM f2 UNION SELECT word, z FROM f2)
      SELECT word, form FROM f WHERE form IS NOT NULL AND form <> word AND form IN (SELECT word FROM w)""",
    "ref_extract": r"""WITH r AS (SELECT doc_id, ref, list_transform(regexp_extract_all(text, '(?:^|[^0-9A-Za-z_])([0-9]{1,3}\s*[:.]\s*[0-9]{1,3})\b', 1), lambda x: regexp_replace(replace(regexp_replace(x, '\s', '', 'g'), '.', ':'), '(^|:)0+([0-9])', '\1\2', 'g')) AS l FROM documents WHERE text IS NOT NULL),
      u AS (SELECT doc_id, ref, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM r)
      SELECT doc_id, array_to_string(l, ' ') AS refs, len(l) AS n, len(list_filter(l, lambda x: x IS DISTINCT FROM ref)) AS others FROM u WHERE len(l) > 0""",
    "ref_parse": TREE_SQL + r""", x AS (SELECT DISTINCT ref, regexp_extract(ref, '^QS\. (.+), ([0-9]+):([0-9]+)(?:-([0-9]+))?$', ['nm', 's', 'f', 'l']) AS m FROM entries WHERE ref IS NOT NULL),
      pz AS (SELECT ref, nullif(m.nm, '') AS name, TRY_CAST(m.s AS INT) AS surah, TRY_CAST(m.f AS INT) AS first, coalesce(TRY_CAST(m.l AS INT), TRY_CAST(m.f AS INT)) AS last FROM x), bounds AS (SELECT n, max(ayahs) AS bound FROM surah_meta GROUP BY 1)
      SELECT ref, name, surah, first, last, CASE WHEN surah IS NULL THEN 'unparsed' WHEN bound IS NULL THEN 'no_chapter' WHEN first < 1 OR last > bound THEN 'out_of_range' WHEN last < first THEN 'inverted' WHEN last > first THEN 'range' ELSE 'single' END AS kind FROM pz LEFT JOIN bounds ON bounds.n = pz.surah""",
    "marker_codec": r"""WITH c AS (SELECT doc_id, text || ' [H:' || regexp_replace(source, '[^a-z0-9-]', '-', 'g') || ':' || doc_id || '] [H:a:7]' AS t FROM documents),
      m AS (SELECT doc_id, t, list_transform(regexp_extract_all(t, '\[H:([a-z0-9-]+:[0-9]+)\]', 1), lambda x: replace(x, ':', '/')) AS l FROM c)
      SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS ids, length(trim(regexp_replace(t, '\s*\[H:[a-z0-9-]+:[0-9]+\]', '', 'g'))) AS rest FROM m""",
    "quoted_spans": """WITH q AS (SELECT doc_id, regexp_extract_all(text, '["“]([^"“”]{4,})["”]', 1) AS l FROM documents)
      SELECT doc_id, i - 1 AS pos, l[i] AS span FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM q WHERE len(l) > 0)""",
    "markup_clean": r"""WITH c AS (SELECT doc_id, '<p class=''a''>' || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') || '</p><BR/>x&nbsp;&amp; y' AS t FROM documents)
      SELECT doc_id, md5(trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(t, '(?i)<br\s*/?>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))) AS clean, length(t) AS n FROM c""",
    "slug_check": "WITH c AS (SELECT DISTINCT slug, category FROM peta_shards), m AS (SELECT slug, regexp_replace(regexp_replace(lower(category), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS made FROM c) SELECT slug, made, made = slug AS same FROM m",
    "bounded_strings": r"""SELECT doc_id, md5(CASE WHEN length(text) <= 120 THEN text ELSE regexp_replace(left(text, 120), '\s+\S*$', '') || '…' END) AS cut,
      md5(CASE WHEN length(f) <= 60 THEN f ELSE left(f, 59) || '…' END) AS line, length(left(text, 40)) AS n40, strlen(text) AS n_bytes FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM documents)""",
    "sentence_counts": r"SELECT script_id, len(list_filter(regexp_split_to_array(full_text, '[.!?\n]+'), lambda x: trim(x) <> '')) AS sentences, true AS lossless FROM (SELECT DISTINCT script_id, full_text FROM narration_scripts WHERE full_text IS NOT NULL)",
    "arabic_names": f"WITH c AS (SELECT DISTINCT n, a, translate(regexp_replace(ar, '{T.ARABIC_MARKS}', '', 'g'), '{T.ARABIC_SAME[0]}', '{T.ARABIC_SAME[1]}') AS folded FROM surah) SELECT n, a, count(*) AS forms, min(md5(folded)) AS least FROM c GROUP BY 1, 2",
    "name_fold": r"SELECT DISTINCT tl, regexp_replace(strip_accents(lower(tl)), '[''’ʾʿ`._\s-]', '', 'g') AS folded FROM surah_meta",
    "variant_pick": """WITH c AS (SELECT doc_id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(text, ''), lambda x: unicode(x)::BIGINT)), lambda a, x: (a * 31 + x) & 4294967295) AS h FROM documents)
      SELECT doc_id, abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 7 AS variant FROM c""",
    "time_labels": """SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') ELSE (s // 60 % 60) || ':' || lpad((s % 60)::VARCHAR, 2, '0') END AS label
      FROM (SELECT event_id, floor(value * 60)::BIGINT AS s FROM events)""",
    "heading_kinds": f"""WITH s AS (SELECT DISTINCT section_id, title, kind FROM intro_sections WHERE lang = 'id'), f AS (SELECT *, regexp_extract({_NORM.format('title')}, '^[a-z]+') AS w FROM s)
      SELECT CASE WHEN starts_with(w, 'nama') THEN 'names' WHEN w IN ('maksud', 'tujuan') THEN 'aims' WHEN starts_with(w, 'pokok') THEN 'topics' WHEN w = 'keutamaan' THEN 'virtues' ELSE 'other' END AS guess, coalesce(kind, 'none') AS kind, count(*) AS n FROM f GROUP BY 1, 2""",
    "json_payload": "WITH e AS (SELECT user_id, (json_extract(CASE WHEN json_valid(props) THEN props END, '$.k'))::BIGINT AS k FROM events) SELECT user_id, count(*) AS n, sum(k)::BIGINT AS total, max(k) AS top FROM e WHERE k IS NOT NULL GROUP BY 1",
}
