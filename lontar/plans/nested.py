"""Queries of the nested-shard operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.operators import nested, orphans
from lontar.util import table


#: The structure of the shards without their texts, so that the scan reads no more.
NARROW = "shard_id BIGINT, slug STRING, published_at TIMESTAMP_NTZ, subtopics ARRAY<STRUCT<entries: ARRAY<STRUCT<refs: ARRAY<STRUCT<surah: INT, ayah: INT, bridge: ARRAY<STRING>>>>>>>, raw_json STRING"


def narrow_shards(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.schema(NARROW).parquet(f"{d}/peta_shards.parquet")


def shard_refs(spark: SparkSession, d: str, keep: tuple[str, ...] = ("published_at",)) -> DataFrame:
    t = nested.shard_trees(narrow_shards(spark, d), keep)
    t = t.select("shard_id", *keep, F.posexplode("tree").alias("subtopic_no", "s"))
    t = t.select("shard_id", *keep, "subtopic_no", F.posexplode("s.entries").alias("entry_no", "e"))
    t = t.select("shard_id", *keep, "subtopic_no", "entry_no", F.posexplode("e.refs").alias("ref_no", "r"))
    return t.select("shard_id", "subtopic_no", "entry_no", "ref_no", "r.surah", "r.ayah", *keep)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.leaves(table(spark, d, "peta_shards"))


def _routed(spark: SparkSession, d: str) -> list[tuple[str, str, DataFrame, DataFrame | None]]:
    """(level, variant, its table, the keys of the level above)."""
    t = nested.typed_tables(table(spark, d, "peta_shards"))
    levels = list(nested.SUBTYPES)
    keys = {level: reduce(DataFrame.unionByName, [df.select(*nested.KEYS[level], "children") for df in t.tables(level).values()]) for level in levels}
    return [(level, v, t.table(level, v), keys[levels[i - 1]] if i else None) for i, level in enumerate(levels) for v in nested.SUBTYPES[level]]


def p5_variants(spark: SparkSession, d: str) -> DataFrame:
    """Rows and different states per level and structural variant, of the typed subtype tables."""
    out = None
    for level, variant, df, _ in _routed(spark, d):
        g = df.agg(F.count("*").alias("n_rows"), F.countDistinct("state").alias("states")).where("n_rows > 0").select(F.lit(level).alias("level"), F.lit(variant).alias("variant"), "n_rows", "states")
        out = g if out is None else out.unionByName(g)
    return out


def p5_tables(spark: SparkSession, d: str) -> DataFrame:
    """Per typed table below the shards: rows, different keys, and rows whose parent is in no table of the level above."""
    out = None
    for level, variant, df, parents in _routed(spark, d):
        if parents is not None:
            up = nested.KEYS[level][:-1]
            known = parents.where("children > 0").select(*up, F.lit(1).alias("_p"))
            g = df.select(*nested.KEYS[level]).join(known, up, "left").agg(F.count("*").alias("n_rows"), F.countDistinct(F.struct(*nested.KEYS[level])).alias("n_keys"), F.count_if(F.col("_p").isNull()).alias("orphans"))
            g = g.where("n_rows > 0").select(F.lit(level).alias("level"), F.lit(variant).alias("variant"), "n_rows", "n_keys", "orphans")
            out = g if out is None else out.unionByName(g)
    return out


def p5_entries(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of complete entries: keys, text and written reference."""
    t = nested.typed_tables(table(spark, d, "peta_shards"))
    return t.table("entries", "full").select("shard_id", "subtopic_no", "entry_no", "text", "ref")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = orphans.orphan_references(shard_refs(spark, d), table(spark, d, "surah_meta"))
    return found.select("shard_id", *[F.col(c).cast("int").alias(c) for c in ("subtopic_no", "entry_no", "ref_no")])


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(shard_refs(spark, d), table(spark, d, "surah_meta"))


QUERIES = {"p5_found": p5_found, "p5_variants": p5_variants, "p5_tables": p5_tables, "p5_entries": p5_entries, "p7_found": p7_found, "p7_counts": p7_counts}

# The shards in one form: typed trees as JSON next to the raw texts that parse; lone values become arrays of one.
_LONE = "CASE json_type({0}) WHEN 'ARRAY' THEN CAST({0} AS JSON[]) WHEN 'NULL' THEN [] ELSE CASE WHEN {0} IS NULL THEN [] ELSE [{0}] END END"
TREE_SQL = f"""
WITH j AS (
  SELECT DISTINCT shard_id, published_at, slug,
    CASE WHEN subtopics IS NOT NULL THEN json_object('subtopics', to_json(subtopics)) WHEN raw_json IS NOT NULL AND json_valid(raw_json) THEN CAST(raw_json AS JSON) END AS j
  FROM peta_shards),
s AS (SELECT shard_id, published_at, slug, {_LONE.format("(j->'$.subtopics')")} AS l FROM j),
s1 AS (SELECT shard_id, published_at, slug, CASE WHEN len(l) = 0 THEN NULL ELSE unnest(generate_series(0, len(l) - 1)) END AS subtopic_no, l FROM (SELECT * FROM s WHERE len(l) > 0) UNION ALL SELECT shard_id, published_at, slug, -1, l FROM s WHERE len(l) = 0),
e AS (SELECT shard_id, published_at, slug, subtopic_no, CASE WHEN subtopic_no < 0 THEN [] ELSE {_LONE.format("(l[subtopic_no + 1]->'$.entries')")} END AS l FROM s1),
e1 AS (SELECT shard_id, published_at, slug, subtopic_no, unnest(generate_series(0, len(l) - 1)) AS entry_no, l FROM e WHERE len(l) > 0 UNION ALL SELECT shard_id, published_at, slug, subtopic_no, -1, l FROM e WHERE len(l) = 0),
entries AS (SELECT shard_id, slug, subtopic_no, entry_no, l[entry_no + 1]->>'$.ref' AS ref FROM e1 WHERE entry_no >= 0),
r AS (SELECT shard_id, published_at, slug, subtopic_no, entry_no, CASE WHEN entry_no < 0 THEN [] ELSE {_LONE.format("(l[entry_no + 1]->'$.refs')")} END AS l FROM e1),
r1 AS (SELECT shard_id, published_at, slug, subtopic_no, entry_no, unnest(generate_series(0, len(l) - 1)) AS ref_no, l FROM r WHERE len(l) > 0 UNION ALL SELECT shard_id, published_at, slug, subtopic_no, entry_no, -1, l FROM r WHERE len(l) = 0),
b AS (SELECT shard_id, published_at, slug, subtopic_no, entry_no, ref_no, CASE WHEN ref_no < 0 THEN NULL ELSE l[ref_no + 1] END AS ref, CASE WHEN ref_no < 0 THEN [] ELSE {_LONE.format("(l[ref_no + 1]->'$.bridge')")} END AS l FROM r1),
b1 AS (SELECT shard_id, published_at, subtopic_no, entry_no, ref_no, unnest(generate_series(0, len(l) - 1)) AS bridge_no FROM b WHERE len(l) > 0 UNION ALL SELECT shard_id, published_at, subtopic_no, entry_no, ref_no, -1 FROM b WHERE len(l) = 0),
refs AS (SELECT shard_id, published_at, subtopic_no, entry_no, ref_no, TRY_CAST(ref->>'$.surah' AS INT) AS surah, TRY_CAST(ref->>'$.ayah' AS INT) AS ayah FROM b WHERE ref_no >= 0),
lost AS (SELECT * FROM refs r WHERE surah IS NOT NULL AND ayah IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM surah_meta m WHERE m.n = r.surah AND m.added_at <= r.published_at AND (m.removed_at IS NULL OR r.published_at < m.removed_at) AND r.ayah BETWEEN 1 AND m.ayahs))
"""

# Letters and variants of every node, by the same rules in SQL: number, text, flag, list.
_INT = "BETWEEN -2147483648 AND 2147483647"
_NUM = f"""CASE WHEN {{0}} IS NULL OR json_type({{0}}) = 'NULL' THEN 'a' WHEN json_type({{0}}) IN ('UBIGINT', 'BIGINT') AND TRY_CAST({{0}} AS BIGINT) {_INT} THEN 'w'
  WHEN json_type({{0}}) = 'DOUBLE' AND TRY_CAST({{0}} AS DOUBLE) = floor(TRY_CAST({{0}} AS DOUBLE)) AND TRY_CAST({{0}} AS DOUBLE) {_INT} THEN 'w'
  WHEN json_type({{0}}) = 'VARCHAR' AND regexp_full_match({{0}}->>'$', '\\s*[+-]?[0-9]{{{{1,18}}}}\\s*') AND TRY_CAST(trim({{0}}->>'$') AS BIGINT) {_INT} THEN 'q' ELSE 'x' END""".replace("{{{{", "{{").replace("}}}}", "}}")
_TXT = "CASE WHEN {0} IS NULL OR json_type({0}) = 'NULL' THEN 'a' WHEN json_type({0}) = 'VARCHAR' THEN 't' ELSE 'x' END"
_FLAG = "CASE WHEN {0} IS NULL OR json_type({0}) = 'NULL' THEN 'a' WHEN json_type({0}) = 'BOOLEAN' THEN 'f' WHEN json_type({0}) = 'VARCHAR' AND lower(trim({0}->>'$')) IN ('true', 'false') THEN 'q' ELSE 'x' END"
_KIND = "CASE WHEN {0} IS NULL OR json_type({0}) = 'NULL' OR json_type({0}) = 'ARRAY' AND json_array_length({0}) = 0 THEN 'n' WHEN json_type({0}) = 'ARRAY' THEN 'l' ELSE 'o' END"


def _extra(known: str) -> str:
    return f"CASE WHEN json_type(v) = 'OBJECT' THEN len(list_filter(json_keys(v), lambda k: k NOT IN ({known}))) > 0 ELSE false END"


_V = "(v->'$.{}')".format
VARIANT_SQL = TREE_SQL + f"""
, rv AS (SELECT shard_id, subtopic_no, entry_no, ref_no, ref AS v FROM b WHERE ref_no >= 0),
rk AS (SELECT *, CASE WHEN json_type(v) = 'OBJECT' THEN ({_NUM.format(_V("surah"))}) || ({_NUM.format(_V("ayah"))}) || ({_FLAG.format(_V("resolvable"))}) || ({_KIND.format(_V("bridge"))}) ELSE '!' END AS k, {_extra("'surah', 'ayah', 'resolvable', 'bridge'")} AS x FROM rv),
r2 AS (SELECT *, CASE WHEN k SIMILAR TO '.*[!x].*' THEN 'alien' WHEN x THEN 'extended' WHEN contains(left(k, 2), 'a') THEN 'partial' WHEN contains(k, 'q') THEN 'quoted' ELSE 'plain' END AS variant, k || x AS state FROM rk),
ev AS (SELECT e1.shard_id, e1.subtopic_no, e1.entry_no, l[e1.entry_no + 1] AS v, c.n, c.best, c.states FROM e1 LEFT JOIN (SELECT shard_id, subtopic_no, entry_no, count(*) AS n, bool_and(variant = 'plain') AS best, list_sort(list(DISTINCT state)) AS states FROM r2 GROUP BY 1, 2, 3) c ON c.shard_id IS NOT DISTINCT FROM e1.shard_id AND c.subtopic_no = e1.subtopic_no AND c.entry_no = e1.entry_no WHERE e1.entry_no >= 0),
ek AS (SELECT *, CASE WHEN json_type(v) = 'OBJECT' THEN ({_TXT.format(_V("text"))}) || ({_TXT.format(_V("ref"))}) || ({_KIND.format(_V("refs"))}) ELSE '!' END AS k, {_extra("'text', 'ref', 'refs'")} AS x FROM ev),
e2 AS (SELECT *, CASE WHEN k SIMILAR TO '.*[!x].*' THEN 'alien' WHEN x THEN 'extended' WHEN n IS NULL THEN 'childless' WHEN contains(left(k, 2), 'a') THEN 'partial' WHEN best THEN 'full' ELSE 'mixed' END AS variant, k || x || coalesce(array_to_string(states, ','), '') AS state FROM ek),
sv AS (SELECT s1.shard_id, s1.subtopic_no, l[s1.subtopic_no + 1] AS v, c.n, c.best, c.states FROM s1 LEFT JOIN (SELECT shard_id, subtopic_no, count(*) AS n, bool_and(variant = 'full') AS best, list_sort(list(DISTINCT state)) AS states FROM e2 GROUP BY 1, 2) c ON c.shard_id IS NOT DISTINCT FROM s1.shard_id AND c.subtopic_no = s1.subtopic_no WHERE s1.subtopic_no >= 0),
sk AS (SELECT *, CASE WHEN json_type(v) = 'OBJECT' THEN ({_TXT.format(_V("subtopic"))}) || ({_KIND.format(_V("entries"))}) ELSE '!' END AS k, {_extra("'subtopic', 'entries'")} AS x FROM sv),
s2 AS (SELECT *, CASE WHEN k SIMILAR TO '.*[!x].*' THEN 'alien' WHEN x THEN 'extended' WHEN n IS NULL THEN 'childless' WHEN left(k, 1) = 'a' THEN 'untitled' WHEN best THEN 'full' ELSE 'mixed' END AS variant, k || x || coalesce(array_to_string(states, ';'), '') AS state FROM sk),
origins AS (SELECT DISTINCT shard_id, CASE WHEN subtopics IS NOT NULL OR raw_json IS NULL THEN 'typed' WHEN json_valid(raw_json) AND json_type(CAST(raw_json AS JSON)) = 'OBJECT' THEN 'raw' ELSE 'broken' END AS origin FROM peta_shards),
h2 AS (SELECT o.shard_id, CASE WHEN origin = 'broken' THEN 'broken' WHEN c.n IS NULL THEN 'childless' WHEN best THEN 'full' ELSE 'mixed' END AS variant, origin || coalesce(array_to_string(c.states, '|'), '') AS state FROM origins o LEFT JOIN (SELECT shard_id, count(*) AS n, bool_and(variant = 'full') AS best, list_sort(list(DISTINCT state)) AS states FROM s2 GROUP BY 1) c ON c.shard_id IS NOT DISTINCT FROM o.shard_id),
nodes AS (SELECT 'shards' AS level, variant, shard_id, -1 AS a, -1 AS b, -1 AS c, state FROM h2 UNION ALL SELECT 'subtopics', variant, shard_id, subtopic_no, -1, -1, state FROM s2
  UNION ALL SELECT 'entries', variant, shard_id, subtopic_no, entry_no, -1, state FROM e2 UNION ALL SELECT 'refs', variant, shard_id, subtopic_no, entry_no, ref_no, state FROM r2)
"""

SQL = {
    "p5_variants": VARIANT_SQL + "SELECT level, variant, count(*) AS n_rows, count(DISTINCT state) AS states FROM nodes GROUP BY 1, 2",
    "p5_tables": VARIANT_SQL + "SELECT level, variant, count(*) AS n_rows, count(DISTINCT (shard_id, a, b, c)) AS n_keys, CAST(0 AS BIGINT) AS orphans FROM nodes WHERE level <> 'shards' GROUP BY 1, 2",
    "p5_entries": VARIANT_SQL + "SELECT shard_id, CAST(subtopic_no AS INT) AS subtopic_no, CAST(entry_no AS INT) AS entry_no, v->>'$.text' AS text, v->>'$.ref' AS ref FROM e2 WHERE variant = 'full'",
    "p5_found": TREE_SQL + "SELECT shard_id, CAST(subtopic_no AS INT) AS subtopic_no, CAST(entry_no AS INT) AS entry_no, CAST(ref_no AS INT) AS ref_no, CAST(bridge_no AS INT) AS bridge_no FROM b1",
    "p7_found": TREE_SQL + "SELECT shard_id, CAST(subtopic_no AS INT) AS subtopic_no, CAST(entry_no AS INT) AS entry_no, CAST(ref_no AS INT) AS ref_no FROM lost",
    "p7_counts": TREE_SQL
    + "SELECT 'peta_shards' AS child_table, 'surah_meta' AS parent_table, strftime(published_at, '%Y-%m') AS period, count(*) AS orphans, count(DISTINCT (surah, ayah)) AS orphan_keys FROM lost GROUP BY 3",
}
