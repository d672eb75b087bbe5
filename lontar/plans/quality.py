"""Queries of gates, graphs, evaluations, dates and keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.functions import dates as D
from lontar.operators import aggregates as A
from lontar.operators import gates as Q
from lontar.operators import graph as P
from lontar.operators.nested import flat_tables
from lontar.plans.nested import TREE_SQL
from lontar.streaming import state as S
from lontar.util import scalar, table


def dq_gates(spark: SparkSession, d: str) -> DataFrame:
    """All violations of the domain tables, by gate."""
    m = table(spark, d, "surah_meta")
    v = table(spark, d, "surah").drop("loaded_at").distinct()
    t = table(spark, d, "translations").drop("loaded_at").distinct()
    bounds = m.groupBy("n").agg(F.max("ayahs").alias("bound"))
    return Q.run_all(
        Q.unique("one_count_per_chapter", m, ["n"]),
        Q.permutation("revelation_order", m.where("removed_at IS NULL"), "order_revealed"),
        Q.contiguous("verse_numbers", v, ["n"], "a"),
        Q.rows("verse_bound", v.join(F.broadcast(bounds), "n", "left"), F.col("a") > F.col("bound"), F.col("verse_id")),
        Q.rows("empty_text", v, F.trim("text") == "", F.col("verse_id")),
        Q.orphans("verse_without_chapter", v.select("n"), m, ["n"]),
        Q.rows("no_source", t, F.col("source_id").isNull(), F.col("tr_id")),
        Q.rows("tier_domain", t, ~F.col("authority_tier").isin(1, 2, 3), F.col("tr_id")),
        Q.unique("translation_key", t, ["tr_id"]),
        Q.at_least("single_voice", t.where("text IS NOT NULL"), ["ayah_id"], "translator", 2),
    )


def line_gates(spark: SparkSession, d: str) -> DataFrame:
    """Order lines against orders: counts per gate, gates without violations included."""
    l, o, c = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "customer")  # noqa: E741
    v = Q.run_all(
        Q.orphans("line_without_order", l.select(F.col("l_orderkey").alias("k")), o.select(F.col("o_orderkey").alias("k")), ["k"]),
        Q.orphans("order_without_customer", o.select(F.col("o_custkey").alias("k")), c.select(F.col("c_custkey").alias("k")), ["k"]),
        Q.contiguous("line_numbers", l, ["l_orderkey"], "l_linenumber"),
        Q.rows("discount_range", l, ~F.col("l_discount").between(0, 0.1), F.col("l_orderkey")),
        Q.unique("line_key", l, ["l_orderkey", "l_linenumber"]),
    )
    names = ["line_without_order", "order_without_customer", "line_numbers", "discount_range", "line_key"]
    every = spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("gate"))
    return every.join(v.groupBy("gate").agg(F.count("*").alias("n")), "gate", "left").select("gate", F.coalesce("n", F.lit(0)).alias("n"))


def audited_constants(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the fixed tables that differ from those agreed on."""
    m = table(spark, d, "surah_meta").agg(F.countDistinct("n").alias("chapters"), F.count_if(F.col("removed_at").isNotNull()).alias("ended"), F.count_if(F.col("ayahs") < 1).alias("empty"))
    return Q.constants("surah_meta", m, {"chapters": 114, "ended": 0, "empty": 0})


def coverage_reported(spark: SparkSession, d: str) -> DataFrame:
    """Share of verses each translator covers; reported, and a failure only at zero."""
    t = table(spark, d, "translations").where("text IS NOT NULL").select("translator", "ayah_id").distinct()
    total = F.lit(scalar(table(spark, d, "translations").select(F.countDistinct("ayah_id"))))
    g = t.groupBy("translator").agg(F.count("*").alias("covered"))
    return g.select(F.coalesce("translator", F.lit("none")).alias("translator"), "covered", A.percent(F.col("covered"), total).alias("percent"), (F.col("covered") == 0).alias("failed"))


def _citations(spark: SparkSession, d: str) -> DataFrame:
    t = flat_tables(table(spark, d, "peta_shards"), ("slug",))
    r = t["refs"].where("surah IS NOT NULL AND ayah IS NOT NULL").select("shard_id", "subtopic_no", F.concat_ws(":", "surah", "ayah").alias("verse"))
    s = t["subtopics"].select("shard_id", "subtopic_no", "subtopic")
    return r.join(s, ["shard_id", "subtopic_no"]).join(t["shards"].select("shard_id", "slug"), "shard_id").select("verse", "subtopic", "slug")


def bridge_sets(spark: SparkSession, d: str) -> DataFrame:
    b = P.bridges(_citations(spark, d), "verse", "slug")
    return b.select("verse", "slug", F.array_join("bridge", ",").alias("bridge"))


def bond_weights(spark: SparkSession, d: str) -> DataFrame:
    return P.bonds(_citations(spark, d), "verse", "slug").where("n >= 2")


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Distribution of spans: how many verses are cited by how many categories."""
    return P.nodes(_citations(spark, d), "verse", "slug").groupBy("span").agg(F.count("*").alias("verses"), F.sum("degree").alias("citations"))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return P.edges(_citations(spark, d), "verse", "subtopic", "slug").groupBy("kind").agg(F.count("*").alias("edges"), F.sum("n").alias("citations"), F.max("n").alias("heaviest"))


def node_consistency(spark: SparkSession, d: str) -> DataFrame:
    return P.inconsistent(table(spark, d, "surah_meta").select(F.col("n").alias("node"), "tl", "ayahs", "rev"), "node", ["tl", "ayahs", "rev"])


def related_verses(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chapters that answers cite side by side, same-chapter pairs left out."""
    r = table(spark, d, "dump_rows").select("dump_id", "verse_refs").dropDuplicates(["dump_id"]).select("dump_id", F.array_sort(F.array_distinct(F.transform("verse_refs", lambda x: F.split_part(x, F.lit(":"), F.lit(1)).try_cast("int")))).alias("c"))
    pairs = F.flatten(F.transform("c", lambda x, i: F.transform(F.slice("c", i + 2, F.size("c")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return r.where("c IS NOT NULL").select(F.explode(pairs).alias("p")).where("p.a IS NOT NULL AND p.b IS NOT NULL AND p.a <> p.b").groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def coverage_audit(spark: SparkSession, d: str) -> DataFrame:
    """Answers by bucket, one column per outcome, and the share answered, worst first by value."""
    r = table(spark, d, "dump_rows").select("dump_id", F.coalesce("turn_bucket", F.lit("none")).alias("bucket"), "prose", "verse_refs").dropDuplicates(["dump_id"])
    o = F.when(F.col("prose").isNull() | (F.col("prose") == ""), "silent").when(F.coalesce(F.size("verse_refs"), F.lit(0)) > 0, "cited").otherwise("plain")
    g = r.withColumn("o", o).groupBy("bucket").pivot("o", ["silent", "cited", "plain"]).count().na.fill(0)
    n = F.col("silent") + F.col("cited") + F.col("plain")
    return g.select("bucket", "silent", "cited", "plain", A.percent(n - F.col("silent"), n).alias("answered"))


def answer_eval(spark: SparkSession, d: str) -> DataFrame:
    """Per bucket the mean run of rare hits where any was measured, and how often it exceeds the share of words covered."""
    r = table(spark, d, "dump_rows").select("dump_id", F.coalesce("turn_bucket", F.lit("none")).alias("bucket"), "hits").dropDuplicates(["dump_id"])
    h = r.select("bucket", F.explode("hits").alias("h")).select("bucket", "h.*")
    anchored = (F.col("hit") >= 2) | (F.col("run") >= 4)
    return h.groupBy("bucket").agg(F.round(A.mean_where(F.col("rare") >= 2, F.col("run")), 6).alias("mean_run"), F.round(A.rate(anchored), 6).alias("anchored"), F.round(A.rate(A.clamp(F.col("cover"), 0.0, 1.0) > 0.5), 6).alias("covered"), F.count("*").alias("n"))


def apply_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Reviewers' verdicts applied to documents: withdrawn, kept, split or not reviewed."""
    v = table(spark, d, "doc_labels").where("toxic IS NOT NULL").groupBy("doc_id").agg(F.min("toxic").alias("a"), F.max("toxic").alias("b"))
    j = table(spark, d, "documents").select("doc_id", "source").join(v, "doc_id", "left")
    s = F.when(F.col("a").isNull(), "unreviewed").when(F.col("a") != F.col("b"), "split").when(F.col("a") == 1, "withdrawn").otherwise("kept")
    return j.groupBy("source", s.alias("verdict")).agg(F.count("*").alias("n"))


def solar_times(spark: SparkSession, d: str) -> DataFrame:
    """Six times of a day for every 10th degree of latitude over four days of a year."""
    days = F.array(*map(F.lit, ("2024-01-05", "2024-03-20", "2024-06-21", "2024-12-01")))
    g = spark.range(0, 13).select((F.col("id") * 10 - 60).cast("double").alias("lat"), F.explode(days).alias("day"))
    g = g.withColumns({"date": F.to_date("day"), "lon": F.lit(106.8), "metres": F.lit(8.0), "offset": F.lit(420)})
    x = D.with_day_times(g, "date", "lat", "lon", "metres", "offset").unpivot(["lat", "day"], list(D.SLOTS), "name", "minute")
    return x.select("lat", "day", "name", F.round("minute", 3).alias("minute"))


def daily_pick(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(D.daily_pick(F.to_date("ts"), 7).alias("pick")).agg(F.count("*").alias("n"), F.min(D.epoch_ms(F.col("ts"))).alias("first_ms"))


def profile_high_water(spark: SparkSession, d: str) -> DataFrame:
    """Profiles after a second run: only users with events later than their mark are recomputed."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts", "value")
    cut = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    old = S.profiles(e.where(F.col("ts") < cut))
    return S.refresh(old, e.where(F.col("user_id") % 3 != 0).unionByName(e.where((F.col("user_id") % 3 == 0) & (F.col("ts") < cut))))


def purge_user(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    gone = e.where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 18").select("user_id")
    return S.purge(e, gone, "user_id").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


QUERIES = {
    f.__name__: f
    for f in (dq_gates, line_gates, audited_constants, coverage_reported, bridge_sets, bond_weights, graph_nodes, graph_edges, node_consistency, related_verses, coverage_audit, answer_eval, apply_verdicts, solar_times, daily_pick, profile_high_water, purge_user)
}

_CITES = TREE_SQL + """, names AS (SELECT shard_id, subtopic_no, l[subtopic_no + 1]->>'$.subtopic' AS subtopic FROM s1 WHERE subtopic_no >= 0),
c AS (SELECT concat_ws(':', surah, ayah) AS verse, subtopic, slug FROM refs JOIN names USING (shard_id, subtopic_no) JOIN (SELECT DISTINCT shard_id, slug FROM peta_shards) USING (shard_id) WHERE surah IS NOT NULL AND ayah IS NOT NULL),
u AS (SELECT DISTINCT verse, slug FROM c)
"""
_T = "(SELECT DISTINCT * EXCLUDE (loaded_at) FROM translations)"
_V = "(SELECT DISTINCT * EXCLUDE (loaded_at) FROM surah)"

SQL = {
    "dq_gates": f"""WITH b AS (SELECT n, max(ayahs) AS bound FROM surah_meta GROUP BY 1), m AS (SELECT * FROM surah_meta WHERE removed_at IS NULL)
      SELECT 'one_count_per_chapter' AS gate, n || ' x' || count(*) AS detail FROM surah_meta GROUP BY n HAVING count(*) > 1
      UNION ALL SELECT 'revelation_order', order_revealed || ' x' || count(*) FROM m GROUP BY order_revealed HAVING count(*) > 1 OR NOT (order_revealed BETWEEN 1 AND (SELECT count(*) FROM m))
      UNION ALL SELECT 'verse_numbers', n || ' ' || min(a) || '..' || max(a) || ' n' || count(DISTINCT a) FROM surah GROUP BY n HAVING min(a) <> 1 OR max(a) <> count(DISTINCT a)
      UNION ALL SELECT 'verse_bound', verse_id::VARCHAR FROM {_V} v JOIN b USING (n) WHERE a > bound
      UNION ALL SELECT 'empty_text', verse_id::VARCHAR FROM {_V} v WHERE trim(text) = ''
      UNION ALL SELECT 'verse_without_chapter', n || ' x' || count(*) FROM {_V} v WHERE n NOT IN (SELECT n FROM surah_meta) GROUP BY n
      UNION ALL SELECT 'no_source', tr_id::VARCHAR FROM {_T} t WHERE source_id IS NULL
      UNION ALL SELECT 'tier_domain', tr_id::VARCHAR FROM {_T} t WHERE authority_tier NOT IN (1, 2, 3)
      UNION ALL SELECT 'translation_key', tr_id || ' x' || count(*) FROM {_T} t GROUP BY tr_id HAVING count(*) > 1
      UNION ALL SELECT 'single_voice', ayah_id || ' ' || count(DISTINCT translator) FROM {_T} t WHERE text IS NOT NULL GROUP BY ayah_id HAVING count(DISTINCT translator) < 2""",
    "line_gates": """SELECT 'line_without_order' AS gate, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS n
      UNION ALL SELECT 'order_without_customer', (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
      UNION ALL SELECT 'line_numbers', (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(DISTINCT l_linenumber)))
      UNION ALL SELECT 'discount_range', (SELECT count(*) FROM lineitem WHERE NOT (l_discount BETWEEN 0 AND 0.1::DOUBLE))
      UNION ALL SELECT 'line_key', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))""",
    "audited_constants": """WITH m AS (SELECT count(DISTINCT n) AS chapters, count(removed_at) AS ended, count(*) FILTER (ayahs < 1) AS empty FROM surah_meta), x AS (SELECT 'chapters' AS k, chapters AS a, 114 AS v FROM m UNION ALL SELECT 'ended', ended, 0 FROM m UNION ALL SELECT 'empty', empty, 0 FROM m)
      SELECT 'surah_meta' AS gate, k || ' ' || a || ' not ' || v AS detail FROM x WHERE a <> v""",
    "coverage_reported": "WITH t AS (SELECT DISTINCT translator, ayah_id FROM translations WHERE text IS NOT NULL) SELECT coalesce(translator, 'none') AS translator, count(*) AS covered, round(count(*) * 100.0::DOUBLE / (SELECT count(DISTINCT ayah_id) FROM translations), 1) AS percent, count(*) = 0 AS failed FROM t GROUP BY t.translator",
    "bridge_sets": _CITES + "SELECT u.verse, u.slug, coalesce(string_agg(o.slug, ',' ORDER BY o.slug), '') AS bridge FROM u LEFT JOIN u o ON o.verse = u.verse AND o.slug <> u.slug GROUP BY 1, 2",
    "bond_weights": _CITES + "SELECT x.slug AS a, y.slug AS b, count(*) AS n FROM u x JOIN u y ON x.verse = y.verse AND x.slug < y.slug GROUP BY 1, 2 HAVING count(*) >= 2",
    "graph_nodes": _CITES + ", g AS (SELECT verse, count(DISTINCT slug) AS span, count(*) AS degree FROM c GROUP BY 1) SELECT span, count(*) AS verses, sum(degree)::BIGINT AS citations FROM g GROUP BY 1",
    "graph_edges": _CITES + ", g AS (SELECT 'cited_in' AS kind, verse AS x, coalesce(subtopic, slug) AS y, count(*) AS n FROM c GROUP BY 2, 3 UNION ALL SELECT 'in_category', subtopic, slug, count(*) FROM c WHERE subtopic IS NOT NULL GROUP BY 2, 3) SELECT kind, count(*) AS edges, sum(n)::BIGINT AS citations, max(n) AS heaviest FROM g GROUP BY 1",
    "node_consistency": "WITH g AS (SELECT n AS k, count(DISTINCT tl) AS tl, count(DISTINCT ayahs) AS ayahs, count(DISTINCT rev) AS rev FROM surah_meta GROUP BY 1) SELECT k AS node, 'tl' AS attribute, tl AS n FROM g WHERE tl > 1 UNION ALL SELECT k, 'ayahs', ayahs FROM g WHERE ayahs > 1 UNION ALL SELECT k, 'rev', rev FROM g WHERE rev > 1",
    "related_verses": "WITH r AS (SELECT DISTINCT dump_id, TRY_CAST(split_part(v, ':', 1) AS INT) AS c FROM (SELECT dump_id, unnest(verse_refs) AS v FROM dump_rows)) SELECT x.c AS a, y.c AS b, count(*) AS n FROM r x JOIN r y ON x.dump_id = y.dump_id AND x.c < y.c GROUP BY 1, 2",
    "coverage_audit": """WITH r AS (SELECT DISTINCT ON (dump_id) coalesce(turn_bucket, 'none') AS bucket, CASE WHEN prose IS NULL OR prose = '' THEN 's' WHEN coalesce(len(verse_refs), 0) > 0 THEN 'c' ELSE 'p' END AS o FROM dump_rows)
      SELECT bucket, count(*) FILTER (o = 's') AS silent, count(*) FILTER (o = 'c') AS cited, count(*) FILTER (o = 'p') AS plain, round(count(*) FILTER (o <> 's') * 100.0::DOUBLE / count(*), 1) AS answered FROM r GROUP BY 1""",
    "answer_eval": """WITH h AS (SELECT bucket, h.* FROM (SELECT bucket, unnest(hits) AS h FROM (SELECT DISTINCT ON (dump_id) coalesce(turn_bucket, 'none') AS bucket, hits FROM dump_rows)))
      SELECT bucket, round(avg(run) FILTER (rare >= 2), 6) AS mean_run, round(avg((hit >= 2 OR run >= 4)::INT), 6) AS anchored, round(avg((coalesce(cover, 0) > 0.5)::INT), 6) AS covered, count(*) AS n FROM h GROUP BY 1""",
    "apply_verdicts": "WITH v AS (SELECT doc_id, min(toxic) AS a, max(toxic) AS b FROM doc_labels WHERE toxic IS NOT NULL GROUP BY 1) SELECT source, CASE WHEN a IS NULL THEN 'unreviewed' WHEN a <> b THEN 'split' WHEN a = 1 THEN 'withdrawn' ELSE 'kept' END AS verdict, count(*) AS n FROM documents LEFT JOIN v USING (doc_id) GROUP BY 1, 2",
    "solar_times": """WITH g AS (SELECT (i * 10 - 60)::DOUBLE AS lat, day FROM range(0, 13) r(i), (VALUES ('2024-01-05'), ('2024-03-20'), ('2024-06-21'), ('2024-12-01')) v(day)),
      a AS (SELECT *, ((day::DATE - DATE '2000-01-01')::DOUBLE + 2451544.5 + (12 - 420 / 60) / 24::DOUBLE - 2451545) / 36525 AS t FROM g),
      b AS (SELECT *, (280.46646::DOUBLE + t * (36000.76983::DOUBLE + t * 0.0003032::DOUBLE)) AS l0, radians(357.52911::DOUBLE + t * (35999.05029::DOUBLE - 0.0001537::DOUBLE * t)) AS m, 0.016708634::DOUBLE - t * (0.000042037::DOUBLE + 0.0000001267::DOUBLE * t) AS e, radians(125.04::DOUBLE - 1934.136::DOUBLE * t) AS node FROM a),
      c AS (SELECT *, l0 - 360 * floor(l0 / 360) AS mean, sin(m) * (1.914602::DOUBLE - t * (0.004817::DOUBLE + 0.000014::DOUBLE * t)) + sin(2 * m) * (0.019993::DOUBLE - 0.000101::DOUBLE * t) + sin(3 * m) * 0.000289::DOUBLE AS centre,
        radians(23 + (26 + (21.448::DOUBLE - t * (46.815::DOUBLE + t * (0.00059::DOUBLE - t * 0.001813::DOUBLE))) / 60) / 60 + 0.00256::DOUBLE * cos(node)) AS tilt FROM b),
      d AS (SELECT *, radians(mean) AS l, radians(mean + centre - 0.00569::DOUBLE - 0.00478::DOUBLE * sin(node)) AS app, tan(tilt / 2) * tan(tilt / 2) AS y FROM c),
      f AS (SELECT lat, day, degrees(asin(sin(tilt) * sin(app))) AS de, 4 * degrees(y * sin(2 * l) - 2 * e * sin(m) + 4 * e * y * sin(m) * cos(2 * l) - 0.5::DOUBLE * y * y * sin(4 * l) - 1.25::DOUBLE * e * e * sin(2 * m)) AS eq FROM d),
      h AS (SELECT lat, day, de, 720 - 4 * 106.8::DOUBLE - eq + 420 AS noon, unnest([{'name': 'dawn', 's': -1, 'alt': -20.0::DOUBLE}, {'name': 'sunrise', 's': -1, 'alt': -0.8333::DOUBLE - 0.0293::DOUBLE * sqrt(8.0::DOUBLE)}, {'name': 'noon', 's': 0, 'alt': NULL}, {'name': 'afternoon', 's': 1, 'alt': degrees(atan(1 / (1 + tan(radians(abs(lat - de))))))}, {'name': 'sunset', 's': 1, 'alt': -0.8333::DOUBLE - 0.0293::DOUBLE * sqrt(8.0::DOUBLE)}, {'name': 'night', 's': 1, 'alt': -18.0::DOUBLE}]) AS z FROM f),
      k AS (SELECT lat, day, noon, z, (sin(radians(z.alt)) - sin(radians(lat)) * sin(radians(de))) / (cos(radians(lat)) * cos(radians(de))) AS r FROM h)
      SELECT lat, day, z.name AS name, round(CASE WHEN z.s = 0 THEN noon WHEN r BETWEEN -1 AND 1 THEN noon + z.s * 4 * degrees(acos(CASE WHEN r BETWEEN -1 AND 1 THEN r END)) END, 3) AS minute FROM k""",
    "daily_pick": "SELECT (ts::DATE - DATE '1970-01-01') % 7 AS pick, count(*) AS n, min(epoch_us(ts) // 1000) AS first_ms FROM events GROUP BY 1",
    "profile_high_water": """WITH e AS (SELECT * FROM events WHERE user_id % 3 <> 0 OR ts < TIMESTAMP '2024-01-20'), o AS (SELECT user_id, max(ts) AS mark FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1), n AS (SELECT user_id, max(ts) AS last FROM e GROUP BY 1),
      s AS (SELECT n.user_id, o.mark IS NULL OR n.last > o.mark AS stale FROM n LEFT JOIN o USING (user_id)), c AS (SELECT e.user_id, event_type, count(*) AS k FROM e GROUP BY 1, 2),
      t AS (SELECT user_id, string_agg(event_type, ',' ORDER BY k DESC, event_type) AS top FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC, event_type) <= 3) GROUP BY 1)
      SELECT t.user_id, top, (SELECT count(*) FROM e WHERE e.user_id = t.user_id) AS events, n.last AS last_ts, stale AS refreshed FROM t JOIN n USING (user_id) JOIN s USING (user_id)""",
    "purge_user": "WITH g AS (SELECT user_id FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 18) SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE user_id NOT IN (SELECT user_id FROM g) GROUP BY 1",
}
