"""Queries of sources and sinks: tables are written in the formats of the sources to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.functions import text as T
from lontar.plans.text import _NORM
from lontar.sources import readers as R
from lontar.sources import sinks as K
from lontar.util import fresh_path, table

_LINE = r"[\r\n\x{85}\x{2028}\x{2029}]+"


def _verses(spark: SparkSession, d: str) -> DataFrame:
    """Verses with a text on one line, each once."""
    v = table(spark, d, "surah").where("text IS NOT NULL").select("verse_id", "n", "a", F.regexp_replace("text", _LINE, " ").alias("text")).distinct()
    return v.where("trim(text) <> ''")


def src_pipe(spark: SparkSession, d: str) -> DataFrame:
    """Verses as lines a|b|text with pipes in the text, among comments, blank and malformed lines."""
    path = fresh_path(spark, "pipe")
    v = _verses(spark, d).select(F.explode(F.array(F.concat_ws("|", "n", "a", "text", F.lit("x")), F.lit("# verse"), F.lit(" "), F.concat(F.lit("x|1|"), "text"))).alias("value"))
    v.write.text(path)
    good, bad = R.pipe_text(spark, path)
    g = good.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.md5("text")).alias("least")).withColumn("kind", F.lit("good"))
    return g.unionByName(bad.agg(F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b"), F.count("*").alias("n"), F.min(F.md5("value")).alias("least")).withColumn("kind", F.lit("bad")))


def src_tags(spark: SparkSession, d: str) -> DataFrame:
    """Chapters as self-closing tags: attributes checked as integers, members of a set and texts."""
    path = fresh_path(spark, "tags")
    m = table(spark, d, "surah_meta").where("removed_at IS NULL").select("n", "tl", "ayahs", "rev").distinct()
    attr = lambda k, c: F.concat(F.lit(f' {k}="'), F.coalesce(c.cast("string"), F.lit("")), F.lit('"'))
    m.select(F.concat(F.lit("<sura"), attr("index", F.col("n")), attr("tname", F.col("tl")), attr("ayas", F.col("ayahs")), attr("type", F.col("rev")), F.lit(" />")).alias("value")).write.text(path)
    good, bad = R.checked_tags(R.tags(spark, path, "sura"), ["index", "ayas"], {"type": ["Meccan", "Medinan"]}, ["tname"])
    a = good.select(F.col("index").alias("n"), "ayas", "type", "tname", F.lit(None).cast("string").alias("reason"))
    return a.unionByName(bad.groupBy("reason").agg(F.count("*").cast("int").alias("n")).select("n", F.lit(None).cast("int").alias("ayas"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("tname"), "reason"))


def src_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Answers as gzipped JSON lines, and once more with each line broken off: rows and rejects."""
    path = fresh_path(spark, "lines")
    r = table(spark, d, "dump_rows").select("dump_id", "turn_bucket").distinct()
    K.write_lines(r, f"{path}/whole", "gzip")
    r.select(F.expr("substring(to_json(struct(dump_id, turn_bucket)), 1, 14)").alias("value")).write.text(f"{path}/broken")
    good, none = R.json_records(spark, f"{path}/whole", "dump_id bigint, turn_bucket string")
    kept, bad = R.json_records(spark, f"{path}/broken", "dump_id bigint, turn_bucket string")
    count = lambda df, k: df.agg(F.lit(k).alias("kind"), F.count("*").alias("n"))
    return good.groupBy(F.coalesce("turn_bucket", F.lit("none")).alias("kind")).agg(F.count("*").alias("n")).unionByName(count(none, "rejects")).unionByName(count(kept, "kept of broken")).unionByName(count(bad, "broken"))


def src_json_array(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "array")
    m = table(spark, d, "surah_meta").select("n", "tl", "ayahs")
    m.groupBy(F.pmod("n", F.lit(4)).alias("k")).agg(F.to_json(F.collect_list(F.struct("n", "tl", "ayahs"))).alias("value")).repartition("k").select("value").write.option("lineSep", "\n").partitionBy().text(path)
    files = spark.read.text(path).select(F.from_json("value", "array<struct<n: int, tl: string, ayahs: int>>").alias("a")).select(F.explode("a").alias("r")).select("r.*")
    return R.require_rows(files, "array").groupBy("n").agg(F.count("*").alias("k"), F.max("ayahs").alias("ayahs"))


def src_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Sections as Markdown with front matter, read back by file: scalar, nested scalar, ## sections and a numbered list."""
    path = fresh_path(spark, "markdown")
    s = table(spark, d, "intro_sections").groupBy("section_id").agg(F.min("title").alias("title"), F.min("lang").alias("lang"))
    flat = F.regexp_replace("title", r'["\r\n]', " ")
    text = F.concat(F.lit('---\nid: "'), "section_id", F.lit('"\nsource:\n  lang: '), F.coalesce("lang", F.lit("")), F.lit("\n---\n# x\n## Satu\n"), flat, F.lit("\n## Dua\n1. a\n   lanjut\n2. b\n"))
    s.select("section_id", text.alias("value")).repartition("section_id").write.partitionBy("section_id").text(path)
    m = R.markdown(spark, path, "*.txt").withColumn("x", R.sections(F.col("text")))
    items = R.numbered_items(F.get("x", F.lit(1)).content)
    return m.select(R.front_matter(F.col("text"), "id").cast("bigint").alias("section_id"), R.nested_front_matter(F.col("text"), "source", "lang").alias("lang"), F.size("x").cast("bigint").alias("sections"), F.md5(F.get("x", F.lit(0)).content).alias("first"), F.array_join(items, "|").alias("items"))


def src_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Verses nested by chapter, one payload of which is no array, and under a dynamic key."""
    v = _verses(spark, d)
    b = v.groupBy("n").agg(F.to_json(F.collect_list(F.struct(F.col("a").alias("ayah"), "text"))).alias("payload")).select(F.col("n").alias("surah"), F.when(F.col("n") % 7 == 0, '{"no": 1}').otherwise(F.col("payload")).alias("payload"))
    deep = v.groupBy("n").agg(F.to_json(F.struct(F.struct(F.collect_list(F.struct(F.col("a").alias("verseNumber"), F.create_map(F.when(F.col("a") % 3 == 0, "en").otherwise("id"), F.col("text")).alias("translations"))).alias("verses")).alias("data"))).alias("payload")).select(F.col("n").alias("surah"), "payload")
    count = lambda df, k: df.groupBy("surah").agg(F.lit(k).alias("kind"), F.count("*").alias("n"), F.min(F.md5("text")).alias("least"))
    return count(R.nested_bundle(b), "bundle").unionByName(count(R.deep_values(deep, "id"), "deep"))


def src_transcript(spark: SparkSession, d: str) -> DataFrame:
    """Scripts cut into snippets by their words, with times, and joined again in order."""
    s = table(spark, d, "narration_scripts").select("script_id", "full_text").distinct().where("full_text IS NOT NULL")
    w = s.select("script_id", F.posexplode(T.words_of(F.col("full_text"))).alias("i", "text")).select("script_id", (F.col("i") * 0.5).alias("start"), "text")
    return R.transcript(w, "script_id").select("script_id", F.md5("text").alias("digest"))


def src_lost(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "surah").select("verse_id", "text").distinct()
    return R.lost_characters(v, "verse_id", "text").groupBy("verse_id").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def snk_shards(spark: SparkSession, d: str) -> DataFrame:
    """Verses written as one shard per chapter and read by folder; a manifest of fewer chapters would be refused."""
    path = fresh_path(spark, "shards")
    v = _verses(spark, d)
    K.write_shards(v, path, ["n"], v.select("n").distinct().count())
    return spark.read.schema("verse_id bigint, a int, text string, n int").json(path).groupBy("n").agg(F.count("*").alias("verses"), F.max("a").alias("last"))


def snk_journal(spark: SparkSession, d: str) -> DataFrame:
    """A journal of documents appended in three steps that overlap: what each step added, and what it holds."""
    path = fresh_path(spark, "journal")
    t = table(spark, d, "documents").select("doc_id", "source")
    added = [K.append_new(t.where(c), path, ["doc_id"]) for c in ("doc_id % 3 = 0", "doc_id % 2 = 0", "true")]
    held = spark.read.parquet(path).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("keys"))
    return held.select(*[F.lit(n).cast("bigint").alias(f"step{i}") for i, n in enumerate(added)], "n", "keys")


def src_pins(spark: SparkSession, d: str) -> DataFrame:
    """Pinned files of which one changes, one goes and one comes: every drift."""
    path = fresh_path(spark, "pins")
    texts = [r.region for r in table(spark, d, "region").select(F.col("r_name").alias("region")).orderBy("r_regionkey").collect()]  # five rows
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def put(name: str, text: str) -> None:
        out = fs.create(jvm.Path(f"{path}/{name}"), True)
        out.write(bytearray(text.encode()))
        out.close()

    for i, x in enumerate(texts[:3]):
        put(f"{i}.txt", x)
    lock = R.repin(spark, path).persist()
    lock.count()
    put("1.txt", texts[3])
    fs.delete(jvm.Path(f"{path}/2.txt"), False)
    put("3.txt", texts[4])
    return R.pin_drift(R.inventory(spark, path), lock).select(F.regexp_extract("path", r"([0-9]\.txt)$", 1).alias("file"), "state")


QUERIES = {f.__name__: f for f in (src_pipe, src_tags, src_json_lines, src_json_array, src_markdown, src_bundle, src_transcript, src_lost, snk_shards, snk_journal, src_pins)}

_V = r"v AS (SELECT * FROM (SELECT DISTINCT verse_id, n, a, regexp_replace(text, '[\r\n\x{85}\x{2028}\x{2029}]+', ' ', 'g') AS text FROM surah WHERE text IS NOT NULL) WHERE trim(text) <> '')"
_WORDS = "list_filter(regexp_split_to_array(" + _NORM + ", '[ -]'), lambda x: x <> '')"

SQL = {
    "src_pipe": f"WITH {_V} SELECT n AS a, a AS b, count(*) AS n, min(md5(text || '|x')) AS least, 'good' AS kind FROM v GROUP BY 1, 2 UNION ALL SELECT NULL, NULL, count(*), min(md5('x|1|' || text)), 'bad' FROM v",
    "src_tags": """WITH m AS (SELECT DISTINCT n, tl, ayahs, rev FROM surah_meta WHERE removed_at IS NULL),
      r AS (SELECT *, CASE WHEN n IS NULL THEN 'bad index' WHEN ayahs IS NULL THEN 'bad ayas' WHEN coalesce(rev, '') NOT IN ('Meccan', 'Medinan') THEN 'bad type' WHEN trim(coalesce(tl, '')) = '' THEN 'bad tname' END AS reason FROM m)
      SELECT n, ayahs AS ayas, rev AS type, tl AS tname, NULL::VARCHAR AS reason FROM r WHERE reason IS NULL UNION ALL SELECT count(*)::INT, NULL, NULL, NULL, reason FROM r WHERE reason IS NOT NULL GROUP BY reason""",
    "src_json_lines": "WITH r AS (SELECT DISTINCT dump_id, turn_bucket FROM dump_rows) SELECT coalesce(turn_bucket, 'none') AS kind, count(*) AS n FROM r GROUP BY 1 UNION ALL SELECT 'rejects', 0 UNION ALL SELECT 'kept of broken', 0 UNION ALL SELECT 'broken', count(*) FROM r",
    "src_json_array": "SELECT n, count(*) AS k, max(ayahs) AS ayahs FROM surah_meta WHERE n IS NOT NULL GROUP BY 1",
    "src_markdown": r"""WITH s AS (SELECT section_id, min(title) AS title, min(lang) AS lang FROM intro_sections GROUP BY 1)
      SELECT section_id, nullif(lang, '') AS lang, 2::BIGINT AS sections, md5(regexp_replace(regexp_replace(title, '["\r\n]', ' ', 'g'), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')) AS first, 'a lanjut|b' AS items FROM s WHERE title IS NOT NULL""",
    "src_bundle": f"WITH {_V} SELECT n AS surah, 'bundle' AS kind, count(*) AS n, min(md5(text)) AS least FROM v WHERE n % 7 <> 0 GROUP BY 1 UNION ALL SELECT n, 'deep', count(*), min(md5(text)) FROM v WHERE a % 3 <> 0 GROUP BY 1",
    "src_transcript": f"WITH s AS (SELECT DISTINCT script_id, full_text FROM narration_scripts WHERE full_text IS NOT NULL), w AS (SELECT script_id, {_WORDS.format('full_text')} AS w FROM s) SELECT script_id, md5(array_to_string(w, ' ')) AS digest FROM w WHERE len(w) > 0",
    "src_lost": "WITH v AS (SELECT DISTINCT verse_id, text FROM surah WHERE contains(text, chr(65533))), c AS (SELECT verse_id, string_split(text, '') AS l FROM v), p AS (SELECT verse_id, unnest(l) AS c, generate_subscripts(l, 1) - 1 AS pos FROM c) SELECT verse_id, count(*) AS n, min(pos)::INT AS first, max(pos)::INT AS last FROM p WHERE c = chr(65533) GROUP BY 1",
    "snk_shards": f"WITH {_V} SELECT n, count(*) AS verses, max(a) AS last FROM v GROUP BY 1",
    "snk_journal": "WITH t AS (SELECT DISTINCT doc_id FROM documents) SELECT count(*) FILTER (doc_id % 3 = 0) AS step0, count(*) FILTER (doc_id % 2 = 0 AND doc_id % 3 <> 0) AS step1, count(*) FILTER (doc_id % 2 <> 0 AND doc_id % 3 <> 0) AS step2, count(*) AS n, count(*) AS keys FROM t",
    "src_pins": "SELECT * FROM (VALUES ('1.txt', 'changed'), ('2.txt', 'missing'), ('3.txt', 'unexpected')) t(file, state)",
}
