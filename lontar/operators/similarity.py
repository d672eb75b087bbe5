"""Shared wording between two sets of texts: longest runs by word k-grams, and rare shared stems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lontar.functions import text as T
from lontar.util import cut, ship, small


def grams(df: DataFrame, key: str, words: Column, k: int) -> DataFrame:
    """(key, i, gram): every run of k words with the position of its first."""
    w = df.select(key, words.alias("_w")).where(F.size("_w") >= k)
    return w.select(key, F.posexplode(F.transform(F.sequence(F.lit(1), F.size("_w") - k + 1), lambda i: F.xxhash64(F.array_join(F.slice("_w", i, k), " ")))).alias("i", "gram"))


def longest_runs(queries: DataFrame, q_key: str, texts: DataFrame, t_key: str, words, k: int, pairs: DataFrame | None = None) -> DataFrame:
    """(q_key, t_key, run): longest contiguous run of at least k words that a query shares with a text.

    Any such run holds a shared k-gram, so the join on k-grams loses none; positions on one diagonal that follow each
    other are one run. The grams of the texts are cut to those the queries have before the join.
    """
    q = small(grams(queries, q_key, words, k).select(q_key, F.col("i").alias("qi"), "gram"), 1_000_000)  # a stated set; where it is small, a gram that many texts hold is no key of a shuffle
    t = grams(texts, t_key, words, k).select(t_key, F.col("i").alias("ti"), "gram").join(small(q.select("gram").distinct()), "gram", "left_semi")
    m = (t.join(q, "gram") if pairs is None else t.join(pairs, t_key).join(q, [q_key, "gram"])).select(q_key, t_key, (F.col("ti") - F.col("qi")).alias("d"), "qi").distinct()
    island = F.col("qi") - F.row_number().over(W.partitionBy(q_key, t_key, "d").orderBy("qi"))
    runs = m.withColumn("_g", island).groupBy(q_key, t_key, "d", "_g").agg((F.count("*") + k - 1).alias("run"))
    return runs.groupBy(q_key, t_key).agg(F.max("run").alias("run"))


def rare_stem_hits(queries: DataFrame, q_key: str, texts: DataFrame, t_key: str, max_df: tuple[int, int], least: int) -> DataFrame:
    """(q_key, t_key, hit, rare, cover): texts that share at least `least` rare stems with a query.

    rare: stems of the query that occur in at least one text and at most max_df, (n, per): n of every `per` texts, of
    as many as there are; hit: those the text has; cover: their share.
    """
    q = queries.select(q_key, F.explode(T.stem_set(F.col("text"))).alias("stem"))
    t = texts.select(t_key, F.explode(T.stem_set(F.col("text"))).alias("stem"))
    t = cut(t.join(small(q.select("stem").distinct()), "stem", "left_semi"))  # only stems that a query has
    n, per = max_df
    rare = t.groupBy("stem").agg(F.count("*").alias("df")).where(F.col("df") * per <= F.lit(texts.count()) * n).select("stem")
    q = small(q.join(rare, "stem", "left_semi"))
    own = q.groupBy(q_key).agg(F.count("*").alias("rare"))
    h = t.join(q, "stem").groupBy(q_key, t_key).agg(F.count("*").alias("hit")).where(F.col("hit") >= least)
    return h.join(own, q_key).select(q_key, t_key, "hit", "rare", (F.col("hit") / F.col("rare")).alias("cover"))


#: Proses and texts of a ref that meet in one job; rows of the refs that share a job are as many as a block of texts.
PROSE_BLOCK, TEXT_BLOCK = 4096, 32_768
#: Shared words and stems that a job lists at once.
MATCHES = 2_000_000
_ECHO = "p_id long, t_id long, hit long, rare long, run long, quoted boolean"


def anchored_echoes(prose: DataFrame, texts: DataFrame, max_df: tuple[int, int], least_hits: int = 2, least_run: int = 4) -> DataFrame:
    """(p_id, t_id, hit, rare, run, quoted): where a prose echoes a text that it is anchored to.

    prose(p_id, text, refs) with p_id unique, texts(t_id, ref, text); a pair is anchored if the text has one of the refs.
    rare: stems of the text that stand in at most max_df of the texts, hit: those the prose has; run: longest run of words
    of both. A pair counts with least_hits or least_run; quoted tells whether a quotation in the prose holds half of the
    shared stems, and two of them.

    Anchored pairs are never listed, as a ref that many proses and texts have makes far more of them than rows. Proses and
    texts go to jobs by ref, those of a large ref in blocks that all meet; a job looks words and stems up in an index.
    """
    n, per = max_df
    prose = prose.where("text IS NOT NULL")
    t = texts.where("text IS NOT NULL").groupBy("t_id").agg(F.collect_set("text").alias("texts"), F.collect_set("ref").alias("refs"))
    stems = F.array_distinct(F.flatten(F.transform("texts", T.stem_set)))
    df = t.select(F.size("texts").alias("n"), stems.alias("stems"))
    all_ = df.agg(F.sum("n")).first()[0] or 0
    counts = df.select(F.explode("stems").alias("stem")).groupBy("stem").agg(F.count("*").alias("df"))
    common = [r.stem for r in counts.where(F.col("df") * per > F.lit(all_) * n).select("stem").collect()]  # at most per / n times the stems of a text
    refs_of = lambda df, as_: df.select(F.explode("refs").alias("ref")).groupBy("ref").agg(F.count("*").alias(as_))
    jobs = cut(refs_of(prose, "np").join(refs_of(t, "nt"), "ref").select("ref", "np", "nt", F.ceil(F.col("np") / PROSE_BLOCK).cast("int").alias("bp"), F.ceil(F.col("nt") / TEXT_BLOCK).cast("int").alias("bt")))
    light = F.col("bp") * F.col("bt") == 1
    size = jobs.agg(F.count("*"), F.sum(F.when(light, F.col("nt") + F.col("np") * (TEXT_BLOCK // PROSE_BLOCK))), F.sum(F.when(~light, F.col("bp") * F.col("bt")))).first()
    slots = (size[1] or 0) // TEXT_BLOCK + 1
    jobs = jobs.select("ref", "bp", "bt", F.when(light, F.pmod(F.xxhash64("ref"), F.lit(slots)).cast("string")).alias("slot"))
    jobs = F.broadcast(jobs) if size[0] <= 200_000 else jobs

    def laid(df: DataFrame, key: str, own: str, other: str, **columns: Column) -> DataFrame:
        """Each row once for every block of the other side that it meets."""
        x = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.explode("refs").alias("ref"), F.array_sort("refs").alias("refs"), *[c.alias(k) for k, c in columns.items()]).join(jobs, "ref")
        x = x.withColumn("_own", F.pmod(F.xxhash64("id"), F.col(own))).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        at = [F.col("_own"), F.col("_other")] if own == "bp" else [F.col("_other"), F.col("_own")]
        return x.select(F.coalesce("slot", F.concat_ws("|", "ref", *[c.cast("string") for c in at])).alias("job"), F.lit(own == "bp").alias("asks"), "id", "ref", "refs", *columns)

    words = lambda c: F.array_join(T.words_of(c), " ")
    quotes = F.array_join(F.filter(F.transform(T.quoted_spans(F.col("text")), lambda q: F.array_join(F.array_intersect(T.stems_of(q), T.stem_set(F.col("text"))), " ")), lambda q: q != ""), "\n")
    p = laid(prose, "p_id", "bp", "bt", words=words(F.col("text")), stems=F.array_join(F.filter(T.stem_set(F.col("text")), lambda x: ~x.isin(common)), " "), quotes=quotes)
    t = laid(t, "t_id", "bt", "bp", words=F.array_join(F.transform("texts", words), " \n "), stems=F.array_join(F.filter(stems, lambda x: ~x.isin(common)), " "), quotes=F.lit(""))
    x = p.unionByName(t).repartition(min(slots + int(size[2] or 0), 4000), "job").sortWithinPartitions("job")
    return x.mapInArrow(_echo_jobs(least_hits, least_run, MATCHES), _ECHO)


def _echo_jobs(least_hits: int, least_run: int, matches: int):
    """Rows sorted by job to echoes."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, name = [], None
        for b in batches:
            codes = b.column("job").dictionary_encode()
            at, names = codes.indices.to_numpy(), codes.dictionary.to_pylist()
            for i, j in zip(starts := [0, *(np.flatnonzero(np.diff(at)) + 1)], [*starts[1:], len(at)]):
                if i == j:
                    continue
                if names[at[i]] != name and held:
                    yield from _echoes(pa.Table.from_batches(held), least_hits, least_run, matches)
                    held = []
                name = names[at[i]]
                held.append(b.slice(i, j - i))
        if held:
            yield from _echoes(pa.Table.from_batches(held), least_hits, least_run, matches)

    return run


def _echoes(job, least_hits: int, k: int, matches: int):
    """The echoes among the proses and texts of a job that have the same ref."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    column = lambda c: job.column(c).combine_chunks()
    asks, ids = column("asks").to_numpy(zero_copy_only=False), column("id").to_numpy()
    ref = column("ref").dictionary_encode()
    refs, ref = len(ref.dictionary), ref.indices.to_numpy().astype(np.int64)
    order = np.flatnonzero(asks)  # rows of proses
    if not len(order) or len(order) == len(asks):
        return
    texts = np.flatnonzero(~asks)
    number = np.empty(len(asks), np.int64)  # of a prose, or of a text
    number[order], number[texts] = np.arange(len(order)), np.arange(len(texts))

    def split(strings, by=" "):
        """(row, part) of the parts that are not empty, in order."""
        parts = pc.split_pattern(strings, by)
        row, flat = np.repeat(np.arange(len(strings)), pc.list_value_length(parts).to_numpy(zero_copy_only=False)), parts.flatten()
        full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        return row[full], flat.filter(pa.array(full))

    def coded(parts):
        d = parts.dictionary_encode()
        return d.indices.to_numpy().astype(np.int64), len(d.dictionary)

    def lookup(ask_row, ask_key, text_row, text_key):
        """Index of the texts by (ref, key): for each asking row where its texts begin in the index and how many they are."""
        some = np.unique(ask_key)
        place = np.minimum(np.searchsorted(some, text_key), len(some) - 1) if len(some) else np.zeros(len(text_key), np.int64)
        kept = np.flatnonzero(some[place] == text_key) if len(some) else np.zeros(0, np.int64)
        full = place[kept] * refs + ref[text_row[kept]]
        sort = np.argsort(full, kind="stable")
        kept, full = kept[sort], full[sort]
        want = np.searchsorted(some, ask_key) * refs + ref[ask_row]
        low = np.searchsorted(full, want, "left")
        return kept, low, np.searchsorted(full, want, "right") - low

    def spread(low, count):
        """Places in the index and the asking rows they belong to."""
        end = np.cumsum(count)
        asking = np.repeat(np.arange(len(count)), count)
        return np.arange(end[-1] if len(end) else 0) - (end - count)[asking] + low[asking], asking

    # stems
    row, parts = split(column("stems"))
    stem, _ = coded(parts)
    a, t = asks[row], ~asks[row]
    rare = np.bincount(number[row[t]], minlength=len(texts))
    s_ask, s_text = row[a], number[row[t]]
    s_kept, s_low, s_count = lookup(s_ask, stem[a], row[t], stem[t])
    # stems of quotations
    q_row, q_parts = split(column("quotes"), "\n")
    q_of, q_stems = split(q_parts)
    known = {x: i for x, i in zip(parts.to_pylist(), stem.tolist())} if len(q_row) else {}
    q_stem = np.array([known.get(x, -1) for x in q_stems.to_pylist()], np.int64)
    q_of, q_stem = q_of[q_stem >= 0], q_stem[q_stem >= 0]
    q_kept, q_low, q_count = lookup(q_row[q_of], q_stem, row[t], stem[t])
    # runs of k words
    row, parts = split(column("words"))
    word, words = coded(parts)
    place = np.arange(len(row)) - np.searchsorted(row, row, "left")
    gram, grams = word[: max(0, len(word) - k + 1)], words
    for i in range(1, k):
        if grams * words >= 1 << 62:
            _, gram = np.unique(gram, return_inverse=True)
            grams = int(gram.max(initial=0)) + 1
        gram, grams = gram * words + word[i : i + len(gram)], grams * words
    whole = row[: len(gram)] == row[k - 1 :][: len(gram)]
    g_row, g_place, gram = row[: len(gram)][whole], place[: len(gram)][whole], gram[whole]
    a, t = asks[g_row], ~asks[g_row]
    g_ask, g_from, g_text, g_at = g_row[a], g_place[a], number[g_row[t]], g_place[t]
    g_kept, g_low, g_count = lookup(g_ask, gram[a], g_row[t], gram[t])

    n, longest = len(texts), int(g_from.max(initial=0)) + 1
    diagonals, steps = int(g_at.max(initial=0)) + longest + 1, longest + 1
    each = sum(np.bincount(number[of], count, len(order)) for of, count in ((s_ask, s_count), (q_row[q_of], q_count), (g_ask, g_count)))
    most = max(1, (1 << 62) // (n * diagonals * steps))
    upto, first = np.cumsum(each), 0
    every, several = column("refs"), texts[pc.list_value_length(column("refs")).to_numpy(zero_copy_only=False)[texts] > 1]
    before = {number[i]: set(x[: x.index(r)]) for i, x, r in zip(several, every.take(several).to_pylist(), column("ref").take(several).to_pylist()) if x[0] != r}
    while first < len(order):
        last = min(max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + matches, "right"))), first + most, len(order))
        part = lambda rows: slice(*np.searchsorted(rows, (first, last)))  # noqa: B023, E731

        x = part(number[s_ask])
        at, asking = spread(s_low[x], s_count[x])
        key, hit = np.unique((number[s_ask[x]][asking] - first) * n + s_text[s_kept[at]], return_counts=True)

        x = part(number[g_ask])
        at, asking = spread(g_low[x], g_count[x])
        at, begin = g_kept[at], g_from[x][asking]
        cells = np.sort((((number[g_ask[x]][asking] - first) * n + g_text[at]) * diagonals + (g_at[at] - begin + longest)) * steps + begin)
        starts = np.flatnonzero(np.diff(cells, prepend=-2) != 1)
        run, pair = np.diff(starts, append=len(cells)) + k - 1, cells[starts] // (diagonals * steps)
        new = np.flatnonzero(np.diff(pair, prepend=-1))
        pair, run = pair[new], np.maximum.reduceat(run, new) if len(new) else run

        out = np.union1d(key[hit >= least_hits], pair)

        def of(keys, values):
            """The values of the rows that are put out, 0 where there is none."""
            if not len(keys):
                return np.zeros(len(out), np.int64)  # noqa: B023
            at = np.minimum(np.searchsorted(keys, out), len(keys) - 1)  # noqa: B023
            return np.where(keys[at] == out, values[at], 0)  # noqa: B023

        hits, runs = of(key, hit), of(pair, run)
        x = part(number[q_row[q_of]])
        at, asking = spread(q_low[x], q_count[x])
        quote = q_of[x][asking]
        cell, held = np.unique(quote * n + s_text[q_kept[at]], return_counts=True)
        pair = (number[q_row[cell // n]] - first) * n + cell % n
        sort = np.lexsort((held, pair))
        pair, held = pair[sort], held[sort]
        top = np.flatnonzero(np.diff(pair, append=-1))
        held = of(pair[top], held[top])
        p, t = out // n + first, out % n
        kept = np.ones(len(out), bool)
        if before:  # a pair that meets under an earlier ref too is put out there
            for i in np.flatnonzero(np.isin(t, list(before))):
                kept[i] = not before[t[i]].intersection(every[int(order[p[i]])].as_py())
        quoted = (hits > 0) & (held >= np.maximum(2, (hits + 1) // 2))
        columns = [c[kept] for c in (ids[order[p]], ids[texts[t]], hits, rare[t], runs, quoted)]
        for i in range(0, len(columns[0]), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 200_000]) for c in columns], names=["p_id", "t_id", "hit", "rare", "run", "quoted"])
        first = last


def overlap_share(quoted: Column, real: Column, at_least: float = 0.6, min_words: int = 6) -> Column:
    """Whether enough of the quoted words, with repetitions, are words of the real text (and there are enough of them)."""
    q = T.words_of(quoted)
    r = T.word_set(real)
    found = F.size(F.filter(q, lambda w: F.array_contains(r, w)))
    return (F.size(q) > 0) & (found >= F.least(F.lit(min_words), F.size(q))) & (found >= F.size(q) * at_least)


ship(__name__)
