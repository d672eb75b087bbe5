"""Lexical retrieval and routing over tables: lexicons, inverted index, scores, routes, lanes. Model calls are parameters."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lontar.functions import text as T
from lontar.operators.windows import top_n
from lontar.util import cut, ship, small


def phrase_matches(texts: DataFrame, key: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """(key, *phrases): texts(key, text) with each phrase they have, its last word with one suffix or none.

    Text and phrase meet by the phrase's first word, which in a phrase of one word may have lost a suffix, so no text
    is compared with all phrases.
    """
    first = F.split_part(F.col(phrase), F.lit(" "), F.lit(1))
    bare = lambda w: F.array_compact(F.array(w, *[F.when(w.endswith(s), F.substr(w, F.lit(1), F.length(w) - len(s))) for s in T.AFFIX_SUFFIXES]))
    t = texts.select(key, T.norm(F.col("text")).alias("_n"))
    words = t.select(key, F.explode(F.array_distinct(F.flatten(F.transform(T.parts(F.col("_n")), bare)))).alias("_w"))
    p = phrases.withColumn("_f", first)
    near = words.join(p, words["_w"] == p["_f"]).drop("_w", "_f").distinct()
    return near.join(t, key).where(T.phrase_hit(F.concat(F.lit(" "), "_n", F.lit(" ")), F.col(phrase))).drop("_n")


def lexicon_hits(questions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(q_id, theme, terms): the terms of each theme that a question has, as a word or, of several words, as a phrase.

    questions(q_id, text), lexicon(theme, term). Single words are an equi-join on the question's words; phrases are
    matched as patterns where their first word occurs.
    """
    q = questions.select("q_id", T.norm(F.col("text")).alias("_n"))
    words = q.select("q_id", F.explode(F.array_distinct(T.parts(F.col("_n"), "[ -]"))).alias("term"))
    single = words.join(lexicon.where(~F.contains("term", F.lit(" "))), "term").select("q_id", "theme", "term")
    held = phrase_matches(questions.select("q_id", "text"), "q_id", lexicon.where(F.contains("term", F.lit(" "))), "term").select("q_id", "theme", "term")
    return single.unionByName(held).distinct().groupBy("q_id", "theme").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def themes_of(texts: DataFrame, key: str, lexicon: list[tuple[str, str]]) -> DataFrame:
    """(key, theme): the themes of each text(key, text), by a curated lexicon of (theme, term), tested in place.

    The same rule as lexicon_hits(), for many texts and few terms: nothing is exploded or joined.
    """
    n, words = T.norm(F.col("text")), T.words_of(F.col("text"))
    t = texts.select(key, n.alias("_n"), words.alias("_w"))
    padded = F.concat(F.lit(" "), "_n", F.lit(" "))
    found = []
    for theme in dict.fromkeys(x for x, _ in lexicon):
        terms = [term for x, term in lexicon if x == theme]
        hit = F.arrays_overlap("_w", F.array(*[F.lit(x) for x in terms if " " not in x]).cast("array<string>"))
        for x in terms:
            hit = hit | T.phrase_hit(padded, F.lit(x)) if " " in x else hit
        found.append(F.when(hit, theme))
    return t.select(key, F.explode(F.array_compact(F.array(*found))).alias("theme"))


def score_rows(questions: DataFrame, hits: DataFrame, rows: DataFrame, row_themes: DataFrame, stop: list[str], k: int, model_themes: DataFrame | None = None) -> DataFrame:
    """(q_id, row_id, score, theme, rank): the k best rows of each question; ties to the lower row_id.

    questions(q_id, text, ref), rows(row_id, text, ref), row_themes(row_id, theme), model_themes(q_id, theme). A row
    qualifies by the question's reference, 100 points, or by a theme of the question: ten points per term of its best
    theme (never the sum over themes), or ten for a theme that only the model named. Each shared content word that is no
    word of that theme's terms adds two, but shared words alone never qualify a row.

    All rows of a theme have the same points but for shared words, so the candidates of a question are those that its
    reference names, those that share a word, and of each theme the k lowest; no theme meets all questions with all rows.
    """
    content = lambda c: F.filter(T.word_set(c), lambda w: (F.length(w) > 3) & ~w.isin(*stop))
    named = hits.select("q_id", "theme", "terms")
    if model_themes is not None:
        told = model_themes.select("q_id", "theme").distinct().join(hits.select("q_id", "theme"), ["q_id", "theme"], "left_anti")
        named = named.unionByName(told.select("q_id", "theme", F.array().cast("array<string>").alias("terms")))
    named, row_themes = cut(named), row_themes.distinct()
    first = top_n(row_themes, ["theme"], [F.col("row_id")], k).select("theme", "row_id")
    by_ref = questions.where("ref IS NOT NULL").select("q_id", "ref").join(rows.select("row_id", "ref"), "ref").select("q_id", "row_id", F.lit(100).alias("points"))
    q = questions.select("q_id", F.explode(content(F.col("text"))).alias("w"))
    able = rows.join(row_themes.select("row_id").unionByName(by_ref.select("row_id")).distinct(), "row_id", "left_semi")
    held = able.select("row_id", F.explode(content(F.col("text"))).alias("w")).join(small(q.select("w").distinct()), "w", "left_semi")
    # only pairs that qualify: a theme of the row is one of the question's, or the row is the one it names
    pairs = row_themes.join(small(named.select("q_id", "theme")), "theme").select("q_id", "row_id").unionByName(by_ref.select("q_id", "row_id")).distinct()
    shared = cut(held.join(small(q), "w").join(pairs, ["q_id", "row_id"], "left_semi").groupBy("q_id", "row_id").agg(F.collect_set("w").alias("words")))
    near = shared.select("q_id", "row_id").unionByName(named.select("q_id", "theme").join(first, "theme").select("q_id", "row_id")).distinct()
    # the theme of a pair: most terms, those of the question's own words before the model's, then by name
    best = near.join(row_themes, "row_id").join(named, ["q_id", "theme"]).groupBy("q_id", "row_id").agg(F.min(F.struct((-F.size("terms")).alias("n"), "theme", "terms")).alias("m"))
    themed = best.select("q_id", "row_id", F.greatest(F.lit(10), -10 * F.col("m.n")).alias("points"), F.col("m.theme").alias("theme"), F.col("m.terms").alias("terms"))
    none = by_ref.withColumn("theme", F.lit(None).cast("string")).withColumn("terms", F.array().cast("array<string>"))
    qualified = themed.unionByName(none.select(themed.columns)).groupBy("q_id", "row_id").agg(F.sum("points").alias("points"), F.max("theme").alias("theme"), F.flatten(F.collect_list("terms")).alias("terms"))
    own = F.flatten(F.transform("terms", lambda t: F.split(t, " ")))
    extra = F.coalesce(F.size(F.array_except("words", own)), F.lit(0))
    s = qualified.join(shared, ["q_id", "row_id"], "left").select("q_id", "row_id", (F.col("points") + 2 * F.when(F.col("words").isNull(), 0).otherwise(extra)).alias("score"), "theme")
    return top_n(s, ["q_id"], [F.col("score").desc(), F.col("row_id")], k)


MAX_QUESTION_CELLS, MAX_ASKED_WORDS = 32_000_000, 1_000_000


def _count_top(block, k: int):
    """Arrow batches of (row_id, word number), the words of a row one after another, to the task's own k best rows per question."""

    def run(batches):
        ids, known, matrix = block.value
        best_score, best_row = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0), np.int64)
        rest_row, rest_word = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def take(row, word):
            nonlocal best_score, best_row
            at = np.minimum(np.searchsorted(known, word), len(known) - 1)
            own = known[at] == word
            row, word = row[own], at[own]
            if not len(row):
                return
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            score = np.concatenate([best_score, np.add.reduceat(matrix[word], first, axis=0, dtype=np.int64).T], axis=1)
            rows = np.concatenate([best_row, np.broadcast_to(row[first], (len(ids), len(first)))], axis=1)
            order = np.lexsort((rows, -score), axis=1)[:, :k]
            best_score, best_row = np.take_along_axis(score, order, 1), np.take_along_axis(rows, order, 1)

        for batch in batches:
            row = np.concatenate([rest_row, batch.column(0).to_numpy(zero_copy_only=False)])
            word = np.concatenate([rest_word, batch.column(1).to_numpy(zero_copy_only=False)])
            last = np.flatnonzero(row != row[-1])[-1] + 1 if len(row) and (row != row[-1]).any() else 0  # the last row may go on
            rest_row, rest_word = row[last:], word[last:]
            take(row[:last], word[:last])
        take(rest_row, rest_word)
        n = best_row.shape[1]
        q, r, v = np.repeat(ids, n), best_row.reshape(-1), best_score.reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(q[v > 0]), pa.array(r[v > 0]), pa.array(v[v > 0])], ["q_id", "row_id", "score"])

    return run


def rare_word_top(questions: DataFrame, rows: DataFrame, max_sources: int, k: int) -> DataFrame:
    """(q_id, row_id, score, rank): rows by how many of the question's words they hold that occur in few sources.

    rows(row_id, source, text). Words in more than max_sources sources are a second, broad tier, which scores the
    questions that have no rare word. Questions are a stated set, in blocks of a bounded matrix of words and questions;
    each task counts its rows against a block and passes on its own k best per question. Null ids take no part.
    """
    spark = questions.sparkSession
    asked = cut(questions.where("q_id IS NOT NULL").select("q_id", F.explode(T.word_set(F.col("text"))).alias("word")))
    words = cut(asked.select("word").distinct().withColumn("no", F.monotonically_increasing_id()))
    few = words.count() <= MAX_ASKED_WORDS
    w = rows.where("row_id IS NOT NULL").select(F.col("row_id").cast("bigint"), "source", F.explode(T.word_set(F.col("text"))).alias("word"))
    w = w.join(F.broadcast(words) if few else words, "word").select("row_id", "source", "no")
    w = cut(w if few else w.repartition("row_id").sortWithinPartitions("row_id"))  # the words of a row stay together
    held = w.groupBy("no").agg(F.countDistinct("source").alias("_s")).select("no", (F.col("_s") > max_sources).alias("broad"))
    told = asked.join(words, "word").join(held, "no")
    told = told.join(told.groupBy("q_id").agg(F.min("broad").alias("broad")), ["q_id", "broad"]).select("q_id", "no")
    told, out = cut(told), None
    parts = max(1, math.ceil(words.count() * told.select("q_id").distinct().count() / MAX_QUESTION_CELLS))
    for i in range(parts):
        own = told.where(F.pmod(F.xxhash64("q_id"), F.lit(parts)) == i).collect()
        ids, known = np.array(sorted({r.q_id for r in own}), np.int64), np.array(sorted({r.no for r in own}), np.int64)
        if not len(ids):
            continue
        matrix = np.zeros((len(known), len(ids)), np.uint8)
        matrix[np.searchsorted(known, [r.no for r in own]), np.searchsorted(ids, [r.q_id for r in own])] = 1
        found = w.select("row_id", "no").mapInArrow(_count_top(spark.sparkContext.broadcast((ids, known, matrix)), k), "q_id bigint, row_id bigint, score bigint")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "q_id bigint, row_id bigint, score bigint")
    return top_n(out, ["q_id"], [F.col("score").desc(), F.col("row_id")], k)


def inverted_index(entries: DataFrame, stop: list[str], broad_above: int = 3) -> DataFrame:
    """(word, tier, slugs, n_slugs): categories of each word by presence (once per entry) descending, then slug.

    entries(entry_id, slug, text). Words in more than broad_above categories form the second, broad tier; words under
    4 characters, stop words and words of category names are left out.
    """
    w = entries.select("slug", F.explode(T.word_set(F.col("text"))).alias("word"))
    own = entries.select(F.explode(F.split("slug", "-")).alias("word")).distinct()
    w = w.where((F.length("word") >= 4) & ~F.col("word").isin(*stop)).join(own, "word", "left_anti")
    g = w.groupBy("word", "slug").agg(F.count("*").alias("n"))
    i = g.groupBy("word").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "slug"))).alias("l"))
    return i.select("word", F.when(F.size("l") > broad_above, "broad").otherwise("narrow").alias("tier"), F.col("l.slug").alias("slugs"), F.size("l").alias("n_slugs"))


def with_variants(words: Column, synonyms: dict[str, str]) -> Column:
    """Of one word: itself and the word it is also called by."""
    if not synonyms:
        return F.array(words)
    m = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
    return F.array_compact(F.array(words, F.try_element_at(m, words)))


def reached_keys(forms: DataFrame, keys: DataFrame, group: list[str]) -> DataFrame:
    """(form, *group, kind, key): per asked form and group of keys(key, *group) the key that equals it (kind 0), else, of a
    form of 4 characters and more, the first key it begins (kind 1). Keys meet forms by their prefixes, in equi-joins."""
    asked = forms.select("form").distinct()
    same = keys.join(asked, F.col("key") == F.col("form")).select("form", *group, F.lit(0).alias("kind"), "key")
    k = keys.where(F.length("key") > 4).withColumn("form", F.explode(F.transform(F.sequence(F.lit(4), F.length("key") - 1), lambda n: F.left(F.col("key"), n))))
    longer = k.join(asked, "form", "left_semi").groupBy("form", *group).agg(F.min("key").alias("key")).select("form", *group, F.lit(1).alias("kind"), "key")
    return same.unionByName(longer)


def holders(words: DataFrame, index: DataFrame, synonyms: dict[str, str]) -> DataFrame:
    """(word, slugs): the categories that hold a word. Its naming variants are tried with and without a suffix, in that
    order, each equal or as a beginning; the narrow tier goes before the broad one, word by word. Absent words are left out."""
    forms = words.select("word").distinct().select("word", F.posexplode(F.flatten(F.transform(with_variants(F.col("word"), synonyms), T.suffix_forms))).alias("no", "form"))
    keys = index.select(F.col("word").alias("key"), F.when(F.col("tier") == "narrow", 0).otherwise(1).alias("tier"))
    found = forms.join(reached_keys(forms, keys, ["tier"]), "form").groupBy("word").agg(F.min(F.struct("tier", "no", "kind", "key")).alias("m"))
    return found.select("word", F.col("m.key").alias("key")).join(index.select(F.col("word").alias("key"), "slugs"), "key").select("word", "slugs")


def subject_words(questions: DataFrame, stop: list[str]) -> DataFrame:
    """(q_id, no, word): the distinct words of a question, in order, that are longer than 2 characters and no stop words."""
    kept = F.filter(F.array_distinct(T.words_of(F.col("text"))), lambda w: (F.length(w) > 2) & ~w.isin(*stop))
    return questions.select("q_id", F.posexplode(kept).alias("no", "word"))


def alias_scores(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(q_id, slug, score, grounded): the category with most aliases in a question, the first by `ord` if several have.

    aliases(ord, slug, alias, frame): an alias of one word meets any affix form of a word, others as phrases; grounded
    tells whether one of them names a subject and not only the kind of question (frame).
    """
    words = questions.select("q_id", F.explode(F.array_distinct(F.flatten(F.transform(T.words_of(F.col("text")), T.affix_forms)))).alias("alias"))
    single = words.join(aliases.where(~F.contains("alias", F.lit(" "))), "alias").select("q_id", "ord", "slug", "alias", "frame")
    several = phrase_matches(questions.select("q_id", "text"), "q_id", aliases.where(F.contains("alias", F.lit(" "))), "alias").select("q_id", "ord", "slug", "alias", "frame")
    g = single.unionByName(several).distinct().groupBy("q_id", "slug").agg(F.count("*").alias("score"), F.min("ord").alias("ord"), F.max(~F.col("frame")).alias("grounded"))
    return top_n(g, ["q_id"], [F.col("score").desc(), F.col("ord")], 1).select("q_id", "slug", "score", "grounded")


def route(questions: DataFrame, index: DataFrame, aliases: DataFrame, stop: list[str], synonyms: dict[str, str]) -> DataFrame:
    """(q_id, slug, how): the category of a question; questions without one are left out.

    grounded: the alias category, if an alias names a subject. Else, if every subject word is held by some category:
    kept, the alias category if it holds one of them; votes, the category most subject words point to, ties to the
    earlier word, then to its stronger category. Else alias, the alias category.
    """
    best = alias_scores(questions, aliases)
    w = subject_words(questions, stop)
    w = w.join(holders(w, index, synonyms), "word", "left")
    cover = w.groupBy("q_id").agg(F.bool_and(F.col("slugs").isNotNull()).alias("covered"))
    v = w.select("q_id", "no", F.posexplode("slugs").alias("at", "slug")).groupBy("q_id", "slug").agg(F.count("*").alias("votes"), F.min(F.struct("no", "at")).alias("first"))
    winner = top_n(v, ["q_id"], [F.col("votes").desc(), F.col("first")], 1).select("q_id", F.col("slug").alias("winner"))
    held = v.select("q_id", "slug", F.lit(True).alias("held"))
    j = cover.join(winner, "q_id", "left").join(best, "q_id", "full_outer").join(held, ["q_id", "slug"], "left")
    covered = F.coalesce("covered", F.lit(False))
    how = F.when(F.col("grounded"), "grounded").when(covered & F.col("held"), "kept").when(covered & F.col("winner").isNotNull(), "votes").when(F.col("slug").isNotNull(), "alias")
    return j.select("q_id", F.when(how == "votes", F.col("winner")).otherwise(F.col("slug")).alias("slug"), how.alias("how")).where("how IS NOT NULL")


def pinned(questions: DataFrame, pins: DataFrame, known: DataFrame) -> DataFrame:
    """(q_id, ref, ord): references pinned to a trigger phrase of the question, in order; unknown ones are dropped. pins(phrase, ord, ref), known(ref)."""
    return phrase_matches(questions.select("q_id", "text"), "q_id", pins, "phrase").select("q_id", "ref", "ord").join(known.select("ref").distinct(), "ref", "left_semi").distinct()


def rank_entries(questions: DataFrame, entries: DataFrame, routes: DataFrame, index: DataFrame, stop: list[str], frame: list[str], synonyms: dict[str, str], k: int) -> DataFrame:
    """(q_id, entry_id, score, borrowed, rank): the k best entries of each routed question; each verse once.

    entries(entry_id, slug, verse, text), routes(q_id, slug). An entry scores one for each content word of the question
    that it holds, under a naming variant, as it stands or as the beginning of a word; words of the category's own name
    do not count. Candidates are the entries of the routed category and of those that hold a subject word (one that is
    no frame word). An entry must match a subject word, where the question has one; and if none of the routed category
    does, nothing is borrowed either. An entry without a first reference (verse null) is not ranked.
    """
    q = subject_words(questions, stop).join(routes.select("q_id", F.col("slug").alias("own")), "q_id").where(~F.array_contains(F.split("own", "-"), F.col("word")))
    q = q.select("q_id", "own", "word", (~F.col("word").isin(*frame)).alias("subject"))
    q = cut(q.join(q.groupBy("q_id").agg(F.max("subject").alias("has_subject")), "q_id"))
    asked = q.where("subject")
    pools = asked.join(holders(asked, index, synonyms), "word").select("q_id", F.explode("slugs").alias("slug")).unionByName(routes.select("q_id", "slug")).distinct()
    qp = q.join(pools, "q_id").select("q_id", "slug", "word", F.when(F.col("slug") == F.col("own"), 0).otherwise(1).alias("borrowed"), (F.col("subject") | ~F.col("has_subject")).alias("on"))
    e = entries.where("verse IS NOT NULL").select("entry_id", "slug", "verse", F.explode(F.array_distinct(T.words_of(F.col("text")))).alias("key"))
    forms = q.select("word").distinct().select("word", F.explode(with_variants(F.col("word"), synonyms)).alias("form"))
    vocabulary = e.select("key").distinct()
    prefix = F.explode(F.array_distinct(F.concat(F.array("key"), F.when(F.length("key") > 4, F.transform(F.sequence(F.lit(4), F.greatest(F.length("key") - 1, F.lit(4))), lambda n: F.left(F.col("key"), n))).otherwise(F.array().cast("array<string>")))))
    reach = vocabulary.select("key", prefix.alias("form")).join(forms, "form").select("word", "key").distinct()
    hit = e.join(small(reach), "key").select("entry_id", "slug", "verse", "word").distinct().join(qp, ["slug", "word"])
    s = hit.groupBy("q_id", "entry_id", "verse").agg(F.count("*").alias("score"), F.max("on").alias("on"), F.max("borrowed").alias("borrowed")).where("on").drop("on")
    once = s.groupBy("q_id", "verse").agg(F.min_by(F.struct("entry_id", "score", "borrowed"), F.struct(-F.col("score"), "borrowed", "entry_id")).alias("m"), F.min("borrowed").alias("least"))
    backed = once.where("least = 0").select("q_id").distinct()
    return top_n(once.join(backed, "q_id", "left_semi").select("q_id", "m.*"), ["q_id"], [F.col("score").desc(), F.col("borrowed"), F.col("entry_id")], k).select("q_id", "entry_id", "score", "borrowed", "rank")


def dense(top: DataFrame, records: DataFrame, rerank: Callable[[DataFrame], DataFrame], k: int, shown: int) -> DataFrame:
    """The dense pipeline after the vector search: rights and text are filtered after the top-k, so fewer rows may remain.

    top(q_id, b_id, score, rank), records(b_id, rights, text); a null right passes. rerank adds new_score.
    """
    r = top.join(records, "b_id").where(F.coalesce("rights", F.lit("")) != "private").where("text IS NOT NULL AND text <> ''")
    out = top_n(rerank(r), ["q_id"], [F.col("new_score").desc(), F.col("rank")], k, "place")
    return out.select("q_id", "b_id", "place", (F.col("place") <= shown).alias("shown"))


def cue_router(texts: DataFrame, key: str, text: str, cues: DataFrame) -> DataFrame:
    """(key, area, n): the area with most different cues in the text, then the earliest one; null on a perfect tie. cues(area, cue)."""
    t = texts.select(key, F.concat(F.lit(" "), T.norm(F.col(text)), F.lit(" ")).alias("_t"))
    c = cues.distinct().withColumn("_w", F.split_part("cue", F.lit(" "), F.lit(1)))
    near = t.select(key, F.explode(F.array_distinct(T.parts(F.col("_t")))).alias("_w")).join(c, "_w").select(key, "area", "cue")
    hit = near.join(t, key).where(F.expr("contains(_t, concat(' ', cue, ' '))"))
    g = hit.groupBy(key, "area").agg(F.count("*").alias("n"), F.min(F.expr("instr(_t, concat(' ', cue, ' '))")).alias("_p"))
    best = g.groupBy(key).agg(F.max(F.struct("n", -F.col("_p"))).alias("_m"))
    tied = g.join(best, key).where(F.struct("n", -F.col("_p")) == F.col("_m")).groupBy(key).agg(F.count("*").alias("_k"), F.max("area").alias("area"), F.max("n").alias("n"))
    return tied.select(key, F.when(F.col("_k") == 1, F.col("area")).alias("area"), "n")


def first_lane(*lanes: tuple[str, Column], default: str = "silence") -> Column:
    """The first lane whose condition holds."""
    return F.coalesce(*[F.when(c, name) for name, c in lanes], F.lit(default))


def embed(texts: DataFrame, key: str, text: str, model: Callable[[list[str]], list[list[float]]], done: DataFrame | None = None, batch: int = 32, cut: int = 4000) -> DataFrame:
    """(key, hash, values): vectors of the first `cut` characters of texts whose hash is not done yet, in batches of a model.

    The model is any function of a list of texts; one that returns another number of vectors than it got texts fails the job.
    """
    t = texts.select(key, F.left(F.coalesce(text, F.lit("")), F.lit(cut)).alias("_t")).withColumn("hash", F.sha2("_t", 256))
    if done is not None:
        t = t.join(done.select("hash"), "hash", "left_anti").select(key, "_t", "hash")

    def run(frames):
        for f in frames:
            out = []
            for i in range(0, len(f), batch):
                part = f["_t"].iloc[i : i + batch].tolist()
                vectors = model(part)
                if len(vectors) != len(part):
                    raise ValueError(f"{len(vectors)} vectors for {len(part)} texts")
                out += [list(map(float, v)) for v in vectors]
            yield f[[key, "hash"]].assign(values=out)

    return t.mapInPandas(run, f"`{key}` {texts.schema[key].dataType.simpleString()}, hash string, values array<double>")


def rerank_document(titles: list[Column], body: Column, limit: int = 1200) -> Column:
    """What a reranker reads of a record: its titles on one line, the body below, cut at `limit` characters of the body."""
    line = F.concat_ws(" — ", *[F.nullif(F.trim(t), F.lit("")) for t in titles])
    return F.concat_ws("\n", F.nullif(line, F.lit("")), F.left(F.coalesce(body, F.lit("")), F.lit(limit)))


def grounding(questions: DataFrame, verses: DataFrame, entries: DataFrame, strong: int = 100) -> DataFrame:
    """(q_id, lane, n, weak): verses if a question has any, else its entries, else none; weak if it has verses and all score below `strong`.

    verses(q_id, score), entries(q_id).
    """
    v = verses.groupBy("q_id").agg(F.count("*").alias("v"), F.max("score").alias("best"))
    e = entries.groupBy("q_id").agg(F.count("*").alias("e"))
    j = questions.select("q_id").distinct().join(v, "q_id", "left").join(e, "q_id", "left")
    lane = F.when(F.col("v") > 0, "verses").when(F.col("e") > 0, "entries").otherwise("none")
    return j.select("q_id", lane.alias("lane"), F.coalesce("v", "e", F.lit(0)).alias("n"), F.coalesce((F.col("v") > 0) & (F.col("best") < strong), F.lit(False)).alias("weak"))


def retrying(model: Callable[[list[str]], list], attempts: int = 5, wait: float = 1.0) -> Callable[[list[str]], list]:
    """A model that is called again after a failure, up to `attempts` times, with waits that double; the last failure is raised."""

    def call(texts):
        import time

        for k in range(attempts):
            try:
                return model(texts)
            except Exception:
                if k + 1 == attempts:
                    raise
                time.sleep(wait * 2**k)

    return call


def single_quote(found: DataFrame, key: str, veto: Column, lang: str, limit: int = 3000) -> DataFrame:
    """The first quotable text of each key with at most two entries: in the language, within the limit, not vetoed. found(key, ord, lang, text)."""
    few = found.groupBy(key).agg(F.count("*").alias("_n")).where("_n <= 2").select(key)
    ok = found.join(few, key, "left_semi").where((F.col("lang") == lang) & (F.length("text") <= limit) & ~veto)
    return ok.groupBy(key).agg(F.min_by("text", "ord").alias("quote"))


def split_shown(records: DataFrame, cited: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(shown, reference only): records that are cited and the others."""
    c = cited.select(key).distinct()
    return records.join(c, key, "left_semi"), records.join(c, key, "left_anti")


ship(__name__)
