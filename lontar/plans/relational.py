"""Queries of the aggregation, window and join operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lontar.functions import text as T
from lontar.operators import aggregates as A
from lontar.operators import joins as J
from lontar.operators import windows as O
from lontar.plans.nested import TREE_SQL
from lontar.util import scalar, table


def _translations(spark: SparkSession, d: str) -> DataFrame:
    """Each translation once, however often delivered."""
    return table(spark, d, "translations").select("tr_id", "ayah_id", "lang", "translator", "text", "source_id", "authority_tier", "display_role").distinct()


def _verses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "surah").drop("loaded_at").distinct()


# Aggregations


def bucket_rates(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    v = F.col("value")
    return e.groupBy("event_type").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.count_if(v > 50).alias("high"), F.round(A.rate(v > 50), 6).alias("high_rate"),
        F.round(A.mean_where(v > 50, v), 6).alias("mean_high"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("top"), F.min("value").alias("least"),
    )


def percentiles_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return A.nearest_rank(table(spark, d, "events"), ["event_type"], "value", [50, 90, 99])


def nested_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per group of a value inside an array: cover of the hits by turn bucket."""
    r = table(spark, d, "dump_rows").select("dump_id", "turn_bucket", "hits").dropDuplicates(["dump_id"])
    h = r.select(F.coalesce("turn_bucket", F.lit("none")).alias("turn_bucket"), F.explode("hits").alias("h")).select("turn_bucket", "h.cover")
    return A.nearest_rank(h, ["turn_bucket"], "cover", [25, 50, 75])


def rollup_totals(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    j = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    g = j.rollup("r_name", "n_name").agg(F.count("*").alias("orders"), F.countDistinct("c_custkey").alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return g.select(F.coalesce("r_name", F.lit("ALL")).alias("region"), F.coalesce("n_name", F.lit("ALL")).alias("nation"), "orders", "customers", "total")


def declared_and_derived(spark: SparkSession, d: str) -> DataFrame:
    """Declared against actual counts of distinct verses, and the ayahs that are missing."""
    m = table(spark, d, "surah_meta").groupBy("n").agg(F.max("ayahs").alias("declared"))
    v = table(spark, d, "surah").groupBy("n").agg(F.countDistinct("a").alias("actual"), F.max("a").alias("last"))
    return m.join(v, "n", "full_outer").select("n", "declared", F.coalesce("actual", F.lit(0)).alias("actual"), (F.coalesce("declared", F.lit(0)) - F.coalesce("actual", F.lit(0))).alias("missing"), (F.col("last") > F.col("declared")).alias("beyond"))


def tier_votes(spark: SparkSession, d: str) -> DataFrame:
    """Which translator most verses have as primary; ties go to the least key."""
    t = _translations(spark, d).where("display_role = 'primary' AND translator IS NOT NULL")
    return A.votes(t, ["lang"], "translator", "tr_id")


def best_tier(spark: SparkSession, d: str) -> DataFrame:
    """The source of the best tier of each ayah; none where two tie."""
    t = _translations(spark, d).where("authority_tier IS NOT NULL").groupBy("ayah_id", "source_id").agg(F.min("authority_tier").alias("tier")).withColumn("o", -F.col("tier"))
    return A.arg_max_or_none(t, ["ayah_id"], "source_id", ["o"])


def coverage_union(spark: SparkSession, d: str) -> DataFrame:
    """Per language the ayahs that have a translation, a chapter verse, or either, and the share of those declared."""
    declared = scalar(table(spark, d, "surah_meta").groupBy("n").agg(F.max("ayahs").alias("k")).agg(F.sum("k")))
    a = _translations(spark, d).select("lang", "ayah_id").distinct().withColumn("t", F.lit(1)).withColumn("s", F.lit(0))
    b = table(spark, d, "surah").select(F.lit("id").alias("lang"), F.concat_ws(":", F.lit("ayah"), "n", "a").alias("ayah_id")).distinct().withColumn("t", F.lit(0)).withColumn("s", F.lit(1))
    u = a.unionByName(b).groupBy("lang", "ayah_id").agg(F.max("t").alias("t"), F.max("s").alias("s"))
    g = u.groupBy("lang").agg(F.sum("t").alias("translated"), F.sum("s").alias("served"), F.sum(F.col("t") * F.col("s")).alias("both"), F.count("*").alias("covered"))
    return g.select("lang", "translated", "served", "both", "covered", A.percent(F.col("covered"), F.lit(declared)).alias("percent"))


def arm_lift(spark: SparkSession, d: str) -> DataFrame:
    """Share of long documents where a verse is cited against where none is, per kind."""
    t = table(spark, d, "documents").select(F.coalesce("kind", F.lit("none")).alias("kind"), F.when(F.col("ref").isNotNull(), "cited").otherwise("blank").alias("arm"), "n_chars")
    g = A.arm_lift(t, ["kind"], "arm", F.col("n_chars") > 600, "cited", "blank")
    return g.select("kind", "n_treated", "n_control", *[F.round(c, 6).alias(c) for c in ("rate_treated", "rate_control", "lift")], "verdict")


def flag_frequency(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "dump_rows").select("dump_id", "hits").dropDuplicates(["dump_id"])
    return r.select("dump_id", F.explode("hits").alias("h")).groupBy("h.kind").agg(F.count("*").alias("hits"), F.countDistinct("dump_id").alias("answers"), F.count("h.run").alias("with_run"))


def first_seen_order(spark: SparkSession, d: str) -> DataFrame:
    """Sources in the order in which they are first seen."""
    f = A.first_seen(table(spark, d, "documents").where("source IS NOT NULL"), "source", "doc_id")
    return f.withColumn("place", F.expr("row_number() OVER (ORDER BY first)").cast("bigint"))


def sole_occurrence(spark: SparkSession, d: str) -> DataFrame:
    """Documents by how many of their words occur once in them only."""
    w = table(spark, d, "documents").select("doc_id", F.explode(T.words_of(F.col("text"))).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("k"))
    return w.groupBy("doc_id").agg(F.count("*").alias("words"), F.count_if(F.col("k") == 1).alias("once"), F.max("k").alias("most"))


# Windows


def tiles_and_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Chapters as tiles of absolute positions: offset, start and end."""
    m = table(spark, d, "surah_meta").where("removed_at IS NULL").groupBy("n").agg(F.max("ayahs").alias("ayahs")).withColumn("one", F.lit(1))
    o = O.offsets(m, ["one"], ["n"], "ayahs", "before").withColumn("start", F.col("before") + 1)
    return O.tile_ends(o, ["one"], "start", F.col("start") + F.col("ayahs") - 1).select("n", "ayahs", "before", "start", "end")


def contiguity(spark: SparkSession, d: str) -> DataFrame:
    """The first gap or repetition of verse numbers within each chapter and corpus version."""
    v = _verses(spark, d).select("corpus_version", "n", "a", "verse_id")
    return O.first_break(v.withColumnRenamed("n", "chapter"), ["corpus_version", "chapter"], "a")


def first_wins_dedupe(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select(F.md5("text").alias("h"), "doc_id", "source")
    return O.first_wins(t, ["h"], ["doc_id"]).select("doc_id", "source")


def latest_state_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return O.last_wins(e, ["user_id", "event_type"], ["ts", "event_id"])


def recent_n_json(spark: SparkSession, d: str) -> DataFrame:
    """The newest three events of each user with a member of their payload."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
    return O.top_n(e, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 3).select("user_id", "event_id", "k", F.col("rank").cast("bigint").alias("rank"))


def stable_boost(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_brand", "p_retailprice")
    p = O.ranked(p, ["p_size"], [F.col("p_retailprice").desc(), F.col("p_partkey")], F.floor(-F.col("p_retailprice") / 100))
    b = O.stable_boost(p, ["p_size"], F.col("p_brand") == "Brand#1", "rank")
    return b.select("p_partkey", F.col("rank").cast("bigint").alias("rank"), F.col("new_rank").cast("bigint").alias("new_rank"))


def next_purchase(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    n = O.carry(e, ["user_id"], ["ts", "event_id"], F.to_date("ts"), F.when(F.col("event_type") == "purchase", F.col("event_id")), "next_purchase", forward=False)
    return n.select("event_id", "next_purchase")


def last_turns(spark: SparkSession, d: str) -> DataFrame:
    e = O.top_n(table(spark, d, "events").select("user_id", "ts", "event_id"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 4)
    return e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x.event_id.cast("string")), ",").alias("turns"))


def first_mention(spark: SparkSession, d: str) -> DataFrame:
    """The first paragraph that mentions each listed reference; -1 for those that none mentions."""
    r = table(spark, d, "dump_rows").select("dump_id", "prose", "verse_refs").dropDuplicates(["dump_id"])
    p = F.split("prose", r"\n{2,}")
    r = r.select("dump_id", F.explode(F.array_distinct("verse_refs")).alias("ref"), F.coalesce(p, F.array().cast("array<string>")).alias("p")).where("ref IS NOT NULL")
    at = F.array_position(F.transform("p", lambda x: F.contains(x, F.col("ref"))), True) - 1
    return r.select("dump_id", "ref", at.cast("bigint").alias("paragraph"))


def byte_pack(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "narration_scripts").select("script_id", "full_text").distinct().where("full_text IS NOT NULL")
    x = s.select("script_id", O.pack_bytes(F.col("full_text"), 900).alias("p"), F.trim(F.regexp_replace("full_text", r"\s+", " ")).alias("flat"))
    return x.select("script_id", "p.level", F.size("p.parts").alias("parts"), (F.array_join("p.parts", " ") == F.col("flat")).alias("lossless"), F.array_max(F.transform("p.parts", F.octet_length)).alias("largest"))


def budget_select(spark: SparkSession, d: str) -> DataFrame:
    """Per chapter which sections fit a budget, in order of seq."""
    s = table(spark, d, "intro_sections").select("section_id", "n", "seq", F.coalesce(F.length("body"), F.lit(0)).cast("bigint").alias("size")).distinct()
    g = s.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("seq", "section_id", "size"))).alias("l"))
    z = F.arrays_zip("l", O.budget_select(F.col("l"), "size", 3, 1500, 3000).alias("status"))
    return g.select(F.explode(z).alias("x")).select("x.l.section_id", "x.l.size", "x.status")


def group_batches(spark: SparkSession, d: str) -> DataFrame:
    """Chapters in batches of about 300 ayahs, none split."""
    m = table(spark, d, "surah_meta").groupBy("n").agg(F.max("ayahs").cast("bigint").alias("ayahs"))
    g = m.groupBy().agg(F.array_sort(F.collect_list(F.struct("n", "ayahs"))).alias("l"))
    z = F.arrays_zip("l", O.batch_numbers(F.col("l.ayahs"), 300).alias("batch"))
    return g.select(F.explode(z).alias("x")).groupBy(F.col("x.batch").cast("bigint").alias("batch")).agg(F.min("x.l.n").alias("first"), F.max("x.l.n").alias("last"), F.sum("x.l.ayahs").alias("ayahs"))


def greedy_diversify(spark: SparkSession, d: str) -> DataFrame:
    """Per kind up to four documents, longest first, each for a theme (a word of its source) not taken yet."""
    order = lambda: [F.col("n_chars").desc(), F.col("doc_id")]
    t = table(spark, d, "documents").where("kind IS NOT NULL").select("kind", "doc_id", "n_chars", "source")
    # Of one theme list the walk admits a first part of its rows, four at most: those after it claim nothing.
    t = O.top_n(t, ["kind", "source"], order(), 4).select("kind", "doc_id", F.split("source", "-").alias("themes"), F.row_number().over(W.partitionBy("kind").orderBy(*order())).alias("rank"))
    g = t.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").alias("id"), "themes"))).alias("l"))
    return g.select("kind", F.posexplode(O.diversify(F.col("l"), 4)).alias("place", "x")).select("kind", F.col("place").cast("bigint").alias("place"), F.col("x.id").alias("doc_id"), "x.theme")


# Joins


def primary_companion(spark: SparkSession, d: str) -> DataFrame:
    """Verse with its first primary and companion wording side by side."""
    t = _translations(spark, d).where("text IS NOT NULL")
    pick = lambda role: F.min_by(F.struct("translator", F.length("text").alias("n")), F.when(F.col("display_role") == role, F.col("tr_id")))
    has = lambda role: F.max(F.when(F.col("display_role") == role, 1))
    g = t.groupBy("ayah_id").agg(pick("primary").alias("p"), pick("companion").alias("c"), has("primary").alias("hp"), has("companion").alias("hc"))
    return g.select("ayah_id", F.when(F.col("hp") == 1, F.col("p.translator")).alias("primary"), F.when(F.col("hp") == 1, F.col("p.n")).alias("n_primary"), F.when(F.col("hc") == 1, F.col("c.translator")).alias("companion"), F.when(F.col("hc") == 1, F.col("c.n")).alias("n_companion"))


def jaccard_divergence(spark: SparkSession, d: str) -> DataFrame:
    """Ayahs whose primary and companion wording share fewest words, least first."""
    t = _translations(spark, d).where("text IS NOT NULL AND tr_id IS NOT NULL")
    pick = lambda role: F.min_by(F.col("text"), F.when(F.col("display_role") == role, F.col("tr_id")))
    g = t.where("display_role IN ('primary', 'companion')").groupBy("ayah_id").agg(pick("primary").alias("p"), pick("companion").alias("c"), F.countDistinct("display_role").alias("k")).where("k = 2")
    s = T.jaccard(T.long_words(F.col("p"), 2), T.long_words(F.col("c"), 2), 1.0)
    return g.select("ayah_id", F.round(s, 6).alias("similarity")).where("similarity < 0.2")


def star_join(spark: SparkSession, d: str) -> DataFrame:
    """Verses of the newest version with chapter names and their translations, best tier first."""
    t = _translations(spark, d).where("text IS NOT NULL").select("ayah_id", F.coalesce("authority_tier", F.lit(9)).alias("t"), "tr_id")
    t = O.top_n(t, ["ayah_id"], [F.col("t"), F.col("tr_id")], 3).groupBy("ayah_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "tr_id"))), lambda x: x.tr_id.cast("string")), ",").alias("best"))
    v = _verses(spark, d).groupBy("n", "a").agg(F.max_by("verse_id", F.struct("corpus_version", "verse_id")).alias("verse_id")).withColumn("ayah_id", F.concat_ws(":", F.lit("ayah"), "n", "a"))
    m = table(spark, d, "surah_meta").where("removed_at IS NULL").groupBy("n").agg(F.min("tl").alias("tl"))
    return v.join(F.broadcast(m), "n", "left").join(t, "ayah_id", "left").select("verse_id", "tl", "best")


def anti_work(spark: SparkSession, d: str) -> DataFrame:
    """Documents per source that no reviewer has labelled."""
    done = table(spark, d, "doc_labels").where("toxic IS NOT NULL")
    return J.missing(table(spark, d, "documents").select("doc_id", "source"), done, ["doc_id"]).groupBy("source").agg(F.count("*").alias("todo"))


def set_drift(spark: SparkSession, d: str) -> DataFrame:
    """Published pairs of two releases: missing, unexpected or changed."""
    b = table(spark, d, "bonds").where("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n", "release")
    snap = lambda r: b.where(F.col("release") == r).groupBy("a", "b").agg(F.max("n").alias("n"))
    return J.drift(snap("rilis-1"), snap("rilis-2"), ["a", "b"], "n")


def hash_semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Answers whose prose agrees, by a short content hash, with that of another answer's registered pair."""
    r = table(spark, d, "dump_rows").select("dump_id", "q", "prose").distinct().where("prose IS NOT NULL AND q IS NOT NULL")
    h = F.substring(F.sha2(F.concat(F.left("q", F.lit(40)), F.lit(" "), F.left("prose", F.lit(800))), 256), 1, 12)
    good = r.where("length(prose) > 400").select(h.alias("h")).distinct()
    return r.select("dump_id", h.alias("h")).join(good, "h", "left_semi")


def range_expand(spark: SparkSession, d: str) -> DataFrame:
    """Every ayah that a written reference covers, with how many entries cite it."""
    from lontar.operators.nested import flat_tables

    e = flat_tables(table(spark, d, "peta_shards"))["entries"].select("ref")
    p = r"^QS\. .+, ([0-9]+):([0-9]+)(?:-([0-9]+))?$"
    g = lambda k: F.regexp_extract("ref", p, k).try_cast("int")
    x = e.where("ref IS NOT NULL").select(g(1).alias("surah"), g(2).alias("f"), F.coalesce(g(3), g(2)).alias("l")).groupBy("surah", "f", "l").agg(F.count("*").alias("k"))
    return J.expand(x, "f", "l", "ayah").groupBy("surah", "ayah").agg(F.sum("k").alias("cited"))


def floor_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Each event with the latest purchase of its user that is not later."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts")
    s = table(spark, d, "events").where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("purchase_id"))
    return J.floor_lookup(e, "ts", s, "ts", "purchase_id", ["user_id"], F.to_date).select("event_id", "purchase_id")


def forbidden_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Published pairs of categories of which both have shards: they must not be shown side by side."""
    live = table(spark, d, "peta_shards").select("slug").distinct()
    b = table(spark, d, "bonds").where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct()
    return b.join(live.select(F.col("slug").alias("a")), "a", "left_semi").join(live.select(F.col("slug").alias("b")), "b", "left_semi").select("a", "b")


def alias_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Chapter names as written in verses, resolved by exact name, folded name, then name without its article."""
    q = table(spark, d, "surah").where("surah_name IS NOT NULL").select(F.col("surah_name").alias("name_q")).distinct()
    m = table(spark, d, "surah_meta").select("n", "tl").distinct()
    exact = m.select(F.col("tl").alias("name"), F.col("n").alias("target"))
    low = m.select(F.regexp_replace(F.lower("tl"), "[^a-z]", "").alias("name"), F.col("n").alias("target"))
    bare = m.select(F.regexp_replace(F.lower("tl"), "^(?:a[a-z]-|[^a-z])", "").alias("name"), F.col("n").alias("target"))
    rules = [("exact", F.col("name_q"), exact), ("folded", F.regexp_replace(F.lower("name_q"), "[^a-z]", ""), low), ("bare", F.regexp_replace(F.lower("name_q"), "^(?:a[a-z]-|[^a-z])", ""), bare)]
    return J.first_of(q, "name_q", rules).select(F.col("name_q").alias("name"), "rule", "target")


def ambiguous_match(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers resolved to customers of their nation with nearly their balance: none, a match, or ambiguous."""
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    near = (s.s_nationkey == c.c_nationkey) & (F.floor(s.s_acctbal / 100) == F.floor(c.c_acctbal / 100))
    return J.resolve(s.join(c, near, "left").select("s_suppkey", "c_custkey"), "s_suppkey", "c_custkey").select("s_suppkey", "n", "resolution", F.col("match").alias("c_custkey"))


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50, itself left out."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"))
    n = J.nearest(q, e.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("b_vec")), 6)
    n = n.where("q_id <> b_id")
    n = n.withColumn("rank", F.expr("row_number() OVER (PARTITION BY q_id ORDER BY score DESC, b_id)")).where("rank <= 5")
    return n.select("q_id", "b_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def rank_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Positions at which an exact and a rounded ranking of the same neighbours agree."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"))
    n = J.nearest(q, e.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("b_vec")), 20).where("rank <= 20")
    n = n.withColumn("rough", F.expr("row_number() OVER (PARTITION BY q_id ORDER BY round(score, 1) DESC, b_id)"))
    return n.groupBy("q_id").agg(F.count_if(F.col("rank") == F.col("rough")).alias("agree"), F.max(F.abs(F.col("rank") - F.col("rough"))).cast("bigint").alias("largest_shift"))


QUERIES = {
    f.__name__: f
    for f in (
        bucket_rates, percentiles_nearest_rank, nested_percentiles, rollup_totals, declared_and_derived, tier_votes, best_tier, coverage_union, arm_lift, flag_frequency, first_seen_order, sole_occurrence,
        tiles_and_gaps, contiguity, first_wins_dedupe, latest_state_upsert, recent_n_json, stable_boost, next_purchase, last_turns, first_mention, byte_pack, budget_select, group_batches, greedy_diversify,
        primary_companion, jaccard_divergence, star_join, anti_work, set_drift, hash_semi_join, range_expand, floor_lookup, forbidden_pairs, alias_lookup, ambiguous_match, cosine_topk, rank_agreement,
    )
}

_TR = "(SELECT DISTINCT tr_id, ayah_id, lang, translator, text, source_id, authority_tier, display_role FROM translations)"
_DUMP = "(SELECT DISTINCT ON (dump_id) * FROM dump_rows)"
_LONG = "list_distinct(list_filter(string_split(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: length(x) > 2))"
_WORDS = r"list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\s-]', ' ', 'g'), '\s+', ' ', 'g')), '[ -]'), lambda x: x <> '')"


def _rank(q: int) -> str:
    return f"(list_sort(list(x)))[least(count(x) - 1, floor({q} * count(x) / 100)::BIGINT) + 1] AS p{q}"


_SCORES = """WITH q AS (SELECT vec_id AS q_id, embedding AS q_vec FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q_id, vec_id AS b_id, list_dot_product(CAST(q_vec AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS score FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, b_id) AS rank FROM s)"""

def _packs(pieces: str) -> str:
    joined = "a[-1] || ' ' || x[1]"
    fold = f"list_reduce(list_transform({pieces}, lambda p: [p]), lambda a, x: CASE WHEN strlen({joined}) <= 900 THEN list_append(list_slice(a, 1, len(a) - 1), {joined}) ELSE list_concat(a, x) END)"
    return f"CASE WHEN len(list_filter({pieces}, lambda p: strlen(p) > 900)) = 0 THEN {fold} END"


_AT = "string_split(regexp_replace(flat, '({0}[\"”’)]?) ', '\\1' || chr(1), 'g'), chr(1))"

SQL = {
    "byte_pack": rf"""WITH s AS (SELECT DISTINCT script_id, trim(regexp_replace(full_text, '\s+', ' ', 'g')) AS flat FROM narration_scripts WHERE full_text IS NOT NULL), pc AS (SELECT script_id, flat, {_AT.format("[.!?…]")} AS s, {_AT.format("[,;:—–]")} AS c, string_split(flat, ' ') AS w FROM s),
      k AS (SELECT script_id, flat, {_packs("s")} AS s, {_packs("c")} AS c, {_packs("w")} AS w FROM pc), r AS (SELECT script_id, flat, CASE WHEN s IS NOT NULL THEN 'sentence' WHEN c IS NOT NULL THEN 'clause' WHEN w IS NOT NULL THEN 'word' ELSE 'none' END AS level, coalesce(s, c, w) AS parts FROM k)
      SELECT script_id, level, CAST(len(parts) AS INT) AS parts, array_to_string(parts, ' ') = flat AS lossless, CAST(list_max(list_transform(parts, lambda p: strlen(p))) AS INT) AS largest FROM r""",
    "greedy_diversify": """WITH RECURSIVE f AS (SELECT kind, doc_id, n_chars, string_split(source, '-') AS themes FROM documents WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY kind, source ORDER BY n_chars DESC, doc_id) <= 4),
      c AS (SELECT kind, doc_id, themes, row_number() OVER (PARTITION BY kind ORDER BY n_chars DESC, doc_id) AS rk FROM f),
      st AS (SELECT DISTINCT kind, 0::BIGINT AS rk, []::VARCHAR[] AS claimed, 0::BIGINT AS n, NULL::BIGINT AS doc_id, NULL::VARCHAR AS theme FROM c UNION ALL
        SELECT t.kind, t.rk, CASE WHEN t.theme IS NULL THEN claimed ELSE list_append(claimed, t.theme) END, n + (t.theme IS NOT NULL)::BIGINT, t.doc_id, t.theme
        FROM (SELECT c.kind, c.rk, st.claimed, st.n, c.doc_id, CASE WHEN st.n < 4 THEN list_filter(c.themes, lambda t: NOT list_contains(st.claimed, t))[1] END AS theme FROM st JOIN c ON c.kind = st.kind AND c.rk = st.rk + 1) t)
      SELECT kind, n - 1 AS place, doc_id, theme FROM st WHERE theme IS NOT NULL""",
    "bucket_rates": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (value > 50) AS high, round(avg((value > 50)::INT), 6) AS high_rate, round(avg(value) FILTER (value > 50), 6) AS mean_high, round(sum(value), 4) AS total, max(value) AS top, min(value) AS least FROM events GROUP BY 1",
    "percentiles_nearest_rank": f"SELECT event_type, count(x) AS n, {_rank(50)}, {_rank(90)}, {_rank(99)} FROM (SELECT event_type, value AS x FROM events WHERE value IS NOT NULL) GROUP BY 1",
    "nested_percentiles": f"SELECT turn_bucket, count(x) AS n, {_rank(25)}, {_rank(50)}, {_rank(75)} FROM (SELECT turn_bucket, h.cover AS x FROM (SELECT coalesce(turn_bucket, 'none') AS turn_bucket, unnest(hits) AS h FROM {_DUMP})) WHERE x IS NOT NULL GROUP BY 1",
    "rollup_totals": "SELECT coalesce(r_name, 'ALL') AS region, coalesce(n_name, 'ALL') AS nation, count(*) AS orders, count(DISTINCT c_custkey) AS customers, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "declared_and_derived": "WITH m AS (SELECT n, max(ayahs) AS declared FROM surah_meta GROUP BY 1), v AS (SELECT n, count(DISTINCT a) AS actual, max(a) AS last FROM surah GROUP BY 1) SELECT n, declared, coalesce(actual, 0) AS actual, coalesce(declared, 0) - coalesce(actual, 0) AS missing, last > declared AS beyond FROM m FULL JOIN v USING (n)",
    "tier_votes": f"WITH g AS (SELECT lang, translator, count(*) AS n, min(tr_id) AS p FROM {_TR} WHERE display_role = 'primary' AND translator IS NOT NULL GROUP BY 1, 2) SELECT lang, translator, n FROM g QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, p) = 1",
    "best_tier": f"WITH g AS (SELECT ayah_id, source_id, min(authority_tier) AS t FROM {_TR} WHERE authority_tier IS NOT NULL GROUP BY 1, 2), b AS (SELECT *, min(t) OVER (PARTITION BY ayah_id) AS m FROM g) SELECT ayah_id, CASE WHEN count(*) = 1 THEN max(source_id) END AS source_id FROM b WHERE t = m GROUP BY 1",
    "coverage_union": f"""WITH m AS (SELECT sum(k) AS declared FROM (SELECT n, max(ayahs) AS k FROM surah_meta GROUP BY 1)),
      u AS (SELECT lang, ayah_id, max(t) AS t, max(s) AS s FROM (SELECT lang, ayah_id, 1 AS t, 0 AS s FROM {_TR} UNION ALL SELECT 'id', 'ayah:' || n || ':' || a, 0, 1 FROM surah) GROUP BY 1, 2)
      SELECT lang, sum(t)::BIGINT AS translated, sum(s)::BIGINT AS served, sum(t * s)::BIGINT AS both, count(*) AS covered, round(count(*) * 100.0::DOUBLE / (SELECT declared FROM m), 1) AS percent FROM u GROUP BY 1""",
    "arm_lift": """WITH g AS (SELECT coalesce(kind, 'none') AS kind, count(*) FILTER (ref IS NOT NULL) AS n_treated, count(*) FILTER (ref IS NULL) AS n_control, avg((n_chars > 600)::INT) FILTER (ref IS NOT NULL) AS a, avg((n_chars > 600)::INT) FILTER (ref IS NULL) AS b FROM documents GROUP BY 1)
      SELECT kind, n_treated, n_control, round(a, 6) AS rate_treated, round(b, 6) AS rate_control, round(a - b, 6) AS lift, CASE WHEN a - b IS NULL THEN 'unknown' WHEN a - b >= 0.5 THEN 'strong' WHEN a - b >= 0.1 THEN 'weak' ELSE 'none' END AS verdict FROM g""",
    "flag_frequency": f"SELECT h.kind AS kind, count(*) AS hits, count(DISTINCT dump_id) AS answers, count(h.run) AS with_run FROM (SELECT dump_id, unnest(hits) AS h FROM {_DUMP}) GROUP BY 1",
    "first_seen_order": "SELECT source, min(doc_id) AS first, row_number() OVER (ORDER BY min(doc_id)) AS place FROM documents WHERE source IS NOT NULL GROUP BY 1",
    "sole_occurrence": f"WITH w AS (SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest({_WORDS}) AS w FROM documents) GROUP BY 1, 2) SELECT doc_id, count(*) AS words, count(*) FILTER (k = 1) AS once, max(k) AS most FROM w GROUP BY 1",
    "tiles_and_gaps": "WITH m AS (SELECT n, max(ayahs) AS ayahs FROM surah_meta WHERE removed_at IS NULL GROUP BY 1), o AS (SELECT n, ayahs, coalesce(sum(ayahs) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM m) SELECT n, ayahs, before, before + 1 AS start, before + ayahs AS \"end\" FROM o",
    "contiguity": "WITH v AS (SELECT DISTINCT corpus_version, n, a, verse_id FROM surah), r AS (SELECT corpus_version, n, a, row_number() OVER (PARTITION BY corpus_version, n ORDER BY a) AS r FROM v) SELECT corpus_version, n AS chapter, count(*) AS n, min(r) FILTER (a IS DISTINCT FROM r) AS first_break FROM r GROUP BY 1, 2",
    "first_wins_dedupe": "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1",
    "latest_state_upsert": "SELECT user_id, event_type, ts, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "recent_n_json": "SELECT user_id, event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events QUALIFY rank <= 3",
    "stable_boost": "WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) SELECT p_partkey, rank, row_number() OVER (PARTITION BY p_size ORDER BY (p_brand <> 'Brand#1')::INT, rank) AS new_rank FROM p",
    "next_purchase": "SELECT event_id, (SELECT arg_min(f.event_id, (f.ts, f.event_id)) FROM events f WHERE f.user_id = e.user_id AND f.event_type = 'purchase' AND (f.ts, f.event_id) > (e.ts, e.event_id)) AS next_purchase FROM events e",
    "last_turns": "SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS turns FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 4) GROUP BY 1",
    "first_mention": rf"WITH r AS (SELECT dump_id, unnest(list_distinct(verse_refs)) AS ref, regexp_split_to_array(prose, '\n{{2,}}') AS p FROM {_DUMP}) SELECT dump_id, ref, (coalesce(list_position(list_transform(p, lambda x: contains(x, ref)), true), 0) - 1)::BIGINT AS paragraph FROM r",
    "primary_companion": f"""WITH t AS (SELECT * FROM {_TR} WHERE text IS NOT NULL) SELECT ayah_id, arg_min(translator, tr_id) FILTER (display_role = 'primary') AS "primary", arg_min(length(text), tr_id) FILTER (display_role = 'primary') AS n_primary,
      arg_min(translator, tr_id) FILTER (display_role = 'companion') AS companion, arg_min(length(text), tr_id) FILTER (display_role = 'companion') AS n_companion FROM t GROUP BY 1""",
    "jaccard_divergence": f"""WITH t AS (SELECT * FROM {_TR} WHERE text IS NOT NULL), g AS (SELECT ayah_id, arg_min(text, tr_id) FILTER (display_role = 'primary') AS p, arg_min(text, tr_id) FILTER (display_role = 'companion') AS c FROM t GROUP BY 1),
      w AS (SELECT ayah_id, {_LONG.format('p')} AS p, {_LONG.format('c')} AS c FROM g WHERE p IS NOT NULL AND c IS NOT NULL), s AS (SELECT ayah_id, CASE WHEN len(p) = 0 OR len(c) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(p, c))::DOUBLE / (len(p) + len(c) - len(list_intersect(p, c))) END AS s FROM w)
      SELECT ayah_id, round(s, 6) AS similarity FROM s WHERE round(s, 6) < 0.2""",
    "star_join": f"""WITH t AS (SELECT ayah_id, string_agg(tr_id::VARCHAR, ',' ORDER BY coalesce(authority_tier, 9), tr_id) AS best FROM (SELECT * FROM {_TR} WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ayah_id ORDER BY coalesce(authority_tier, 9), tr_id) <= 3) GROUP BY 1),
      v AS (SELECT n, a, arg_max(verse_id, (corpus_version, verse_id)) AS verse_id FROM surah GROUP BY 1, 2), m AS (SELECT n, min(tl) AS tl FROM surah_meta WHERE removed_at IS NULL GROUP BY 1)
      SELECT verse_id, tl, best FROM v LEFT JOIN m USING (n) LEFT JOIN t ON t.ayah_id = 'ayah:' || v.n || ':' || v.a""",
    "anti_work": "SELECT source, count(*) AS todo FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM doc_labels WHERE toxic IS NOT NULL AND doc_id IS NOT NULL) GROUP BY 1",
    "set_drift": """WITH b AS (SELECT least(a, b) AS a, greatest(a, b) AS b, release, max(n) AS n FROM bonds WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2, 3), x AS (SELECT * FROM b WHERE release = 'rilis-1'), y AS (SELECT * FROM b WHERE release = 'rilis-2'),
      j AS (SELECT coalesce(x.a, y.a) AS a, coalesce(x.b, y.b) AS b, CASE WHEN y.a IS NULL THEN 'missing' WHEN x.a IS NULL THEN 'unexpected' WHEN x.n IS DISTINCT FROM y.n THEN 'changed' END AS state FROM x FULL JOIN y ON x.a = y.a AND x.b = y.b) SELECT a, b, state FROM j WHERE state IS NOT NULL""",
    "hash_semi_join": "WITH r AS (SELECT DISTINCT dump_id, q, prose FROM dump_rows WHERE prose IS NOT NULL AND q IS NOT NULL), h AS (SELECT dump_id, prose, left(sha256(left(q, 40) || ' ' || left(prose, 800)), 12) AS h FROM r) SELECT h, dump_id FROM h WHERE h IN (SELECT h FROM h WHERE length(prose) > 400)",
    "range_expand": TREE_SQL + r""", x AS (SELECT regexp_extract(ref, '^QS\. .+, ([0-9]+):([0-9]+)(?:-([0-9]+))?$', ['s', 'f', 'l']) AS m FROM entries WHERE ref IS NOT NULL),
      y AS (SELECT TRY_CAST(m.s AS INT) AS surah, TRY_CAST(m.f AS INT) AS f, coalesce(TRY_CAST(m.l AS INT), TRY_CAST(m.f AS INT)) AS l FROM x WHERE m.s <> '')
      SELECT surah, ayah::INT AS ayah, count(*) AS cited FROM (SELECT surah, unnest(generate_series(f, l)) AS ayah FROM y WHERE f <= l) GROUP BY 1, 2""",
    "floor_lookup": "WITH s AS (SELECT user_id, ts, max(event_id) AS purchase_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) SELECT e.event_id, s.purchase_id FROM events e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.ts >= s.ts",
    "forbidden_pairs": "SELECT DISTINCT a, b FROM bonds WHERE a IN (SELECT slug FROM peta_shards) AND b IN (SELECT slug FROM peta_shards)",
    "alias_lookup": """WITH q AS (SELECT DISTINCT surah_name AS name FROM surah WHERE surah_name IS NOT NULL), m AS (SELECT n, tl, regexp_replace(lower(tl), '[^a-z]', '', 'g') AS f, regexp_replace(lower(tl), '^(?:a[a-z]-|[^a-z])', '') AS b FROM surah_meta),
      r AS (SELECT name, (SELECT min(n) FROM m WHERE tl = name) AS e, (SELECT min(n) FROM m WHERE f = regexp_replace(lower(name), '[^a-z]', '', 'g')) AS f, (SELECT min(n) FROM m WHERE b = regexp_replace(lower(name), '^(?:a[a-z]-|[^a-z])', '')) AS b FROM q)
      SELECT name, CASE WHEN e IS NOT NULL THEN 'exact' WHEN f IS NOT NULL THEN 'folded' WHEN b IS NOT NULL THEN 'bare' END AS rule, coalesce(e, f, b) AS target FROM r""",
    "ambiguous_match": "WITH p AS (SELECT s_suppkey, count(DISTINCT c_custkey) AS n, min(c_custkey) AS m FROM supplier LEFT JOIN customer ON s_nationkey = c_nationkey AND floor(s_acctbal / 100) = floor(c_acctbal / 100) GROUP BY 1) SELECT s_suppkey, n, CASE n WHEN 0 THEN 'none' WHEN 1 THEN 'match' ELSE 'ambiguous' END AS resolution, CASE WHEN n = 1 THEN m END AS c_custkey FROM p",
    "cosine_topk": _SCORES + ", x AS (SELECT q_id, b_id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, b_id) AS place FROM r WHERE rank <= 6 AND q_id <> b_id) SELECT q_id, b_id, round(score, 6) AS score, place AS rank FROM x WHERE place <= 5",
    "rank_agreement": _SCORES + ", x AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 1) DESC, b_id) AS rough FROM r WHERE rank <= 20) SELECT q_id, count(*) FILTER (rank = rough) AS agree, max(abs(rank - rough)) AS largest_shift FROM x GROUP BY 1",
    "budget_select": """WITH RECURSIVE s AS (SELECT DISTINCT section_id, n, seq, coalesce(length(body), 0)::BIGINT AS size FROM intro_sections), o AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY seq, section_id, size) AS i FROM s),
      f AS (SELECT n, i, section_id, size, CASE WHEN size > 1500 THEN 'too-long' WHEN size > 3000 THEN 'over-budget' ELSE 'taken' END AS status, CASE WHEN size <= 1500 THEN 1 ELSE 0 END AS k, CASE WHEN size <= 1500 THEN size ELSE 0 END AS used FROM o WHERE i = 1
        UNION ALL SELECT o.n, o.i, o.section_id, o.size, CASE WHEN o.size > 1500 THEN 'too-long' WHEN f.k >= 3 THEN 'over-max' WHEN f.used + o.size > 3000 THEN 'over-budget' ELSE 'taken' END,
        f.k + CASE WHEN o.size <= 1500 AND f.k < 3 AND f.used + o.size <= 3000 THEN 1 ELSE 0 END, f.used + CASE WHEN o.size <= 1500 AND f.k < 3 AND f.used + o.size <= 3000 THEN o.size ELSE 0 END FROM f JOIN o ON o.n = f.n AND o.i = f.i + 1)
      SELECT section_id, size, status FROM f""",
    "group_batches": """WITH RECURSIVE m AS (SELECT n, max(ayahs)::BIGINT AS ayahs, row_number() OVER (ORDER BY n) AS i FROM surah_meta GROUP BY n), f AS (SELECT n, i, ayahs, 0 AS batch, ayahs AS held FROM m WHERE i = 1
      UNION ALL SELECT m.n, m.i, m.ayahs, CASE WHEN f.held > 0 AND f.held + m.ayahs > 300 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.held > 0 AND f.held + m.ayahs > 300 THEN m.ayahs ELSE f.held + m.ayahs END FROM f JOIN m ON m.i = f.i + 1)
      SELECT batch, min(n) AS first, max(n) AS last, sum(ayahs)::BIGINT AS ayahs FROM f GROUP BY 1""",
}
