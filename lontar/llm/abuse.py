"""Scores for abusive, hateful or sexual language.

A word is the mean of the vectors of its hashed character n-grams (subword bag), a passage the mean of its words (over
SHORT at least), and a linear softmax over two classes scores it; vectors and softmax are trained jointly in numpy.
Unseen misspellings share n-grams with the words they come from. Abuse is often one sentence of a long sober text, so
the unit of scoring is the passage: up to PASSAGE words of a sentence; a document scores as its worst passage. Training
knows labels of documents only, so each document spreads its weight over its passages by their present scores: the
worst of an abusive document take its label, and the worst of a harmless one, where abuse is quoted or condemned, teach
what such a passage looks like (multiple instances).

Six models are fitted, each on two of four parts of the labels, as tasks side by side; the score is the mean of their
logits. Reviewers err: two models of complementary halves are fitted first, and documents whose label the model that has
not seen them contradicts strongly are left out. The threshold is set on the labels kept, each scored by the mean of the
three models that have not seen it, for the best F-score with precision weighed double; the harmless labels count for
all those that the sample stands for.

Fitting uses a sample of labelled documents bounded by MAX_ABUSIVE, MAX_HARMLESS and MAX_BYTES, in order of a hash of
their ids; scoring reads every document whole. Labels of several reviewers count by majority; ties and nulls are no
label. Null and empty texts score 0. Without labels of both classes every score is 0.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.util import cut, need, ship

MAX_ABUSIVE, MAX_HARMLESS, MAX_BYTES = 1500, 6000, 32 << 20
BUCKETS, DIM = 1 << 16, 12
PASSAGE, STRIDE, SHORT = 10, 4, 6
EPOCHS, FIRST_EPOCHS, RATE, DECAY, SHRINK = 60, 35, 0.05, 1e-4, 0.02
WARM, FULL_PASS, SETTLED = 15, 10, 0.02
#: What part of the weight of a harmless document is spread evenly over its passages.
EVEN = 0.3
#: The parts of the labels that each model is fitted on; the first and the last are complementary.
PARTS = 4
HALVES = tuple(combinations(range(PARTS), 2))
#: A label is left out if the held-out logit is this far on the other side.
DOUBT = 2.0
MAX_WORDS_KEPT = 500_000
#: Single letters strung out by one separator, marks and invisible characters, letters repeated, and signs that stand for letters.
STRUNG = re.compile(r"(?<!\w)\w([ .*_-])\w(?:\1\w)+(?!\w)")
MARKS = re.compile("[\u0300-\u036f\u0610-\u061a\u0640\u064b-\u065f\u0670\u200b-\u200f\u2060\ufeff\u00ad]+")
REPEATED = re.compile(r"(\w)\1\1+")
TOKEN = re.compile(r"[^\W_]+(?:[*@$][^\W_]+)*|[.!?؟\n]")
LEET = str.maketrans("013457@$", "oieastas")
ENDS = frozenset(".!?؟\n")


def tokens(text: str) -> list[str]:
    """Words in lower case, without combining marks, and the signs that end sentences."""
    return TOKEN.findall(STRUNG.sub(lambda m: m[0].replace(m[1], ""), MARKS.sub("", text.lower())))


def grams(word: str) -> list[int]:
    """Buckets of a word: itself and its character 3- to 5-grams, after undoing digits for letters and repetitions."""
    w = REPEATED.sub(r"\1", word)
    if w.isdecimal():
        w = "#"
    elif not w.isalpha():
        plain = w.translate(LEET)
        w = plain if any(c.isalpha() for c in w) else w
    w = f"<{w}>"
    parts = [w, *(w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1))]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]


def passages(is_end: np.ndarray, text: np.ndarray):
    """(start, end, text) of the passages: within sentences, up to PASSAGE words, every STRIDE words and at the end."""
    n = len(is_end)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    new = np.concatenate([[True], is_end[:-1] | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [n]])
    last = last - is_end[last - 1]
    keep = last > first
    first, last = first[keep], last[keep]
    k = np.maximum(0, -(-(last - first - PASSAGE) // STRIDE)) + 1
    inner = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
    end = np.repeat(last, k)
    start = np.minimum(np.repeat(first, k) + inner * STRIDE, np.maximum(np.repeat(first, k), end - PASSAGE))
    return start, np.minimum(start + PASSAGE, end), text[start]


class Bag:
    """Passages of labelled documents as spans of word numbers, and words as arrays of buckets."""

    def __init__(self, texts: list[str]) -> None:
        vocabulary: dict[str, int] = {}
        toks = [tokens(t or "") for t in texts]
        ids = np.array([-1 if w in ENDS else vocabulary.setdefault(w, len(vocabulary)) for t in toks for w in t], np.int64)
        text = np.repeat(np.arange(len(texts)), [len(t) for t in toks])
        start, end, self.doc = passages(ids < 0, text)
        self.size = end - start
        self.word = ids[np.repeat(start - np.cumsum(self.size) + self.size, self.size) + np.arange(int(self.size.sum()))]
        self.n_docs, self.n_words = len(texts), len(vocabulary)
        g = [grams(w) for w in vocabulary]
        self.gram_size = np.array([len(x) for x in g], np.float32)
        self.gram_start = np.concatenate([[0], np.cumsum(self.gram_size)])[:-1].astype(np.int64)
        self.buckets, self.gram = np.unique(np.fromiter(chain.from_iterable(g), np.int64), return_inverse=True)
        self.gram_word = np.repeat(np.arange(len(g)), self.gram_size.astype(np.int64))


def _sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sum of the rows of values by number."""
    return np.stack([np.bincount(rows, v, n) for v in np.ascontiguousarray(values.T)], axis=1)


class AbuseModel:
    def __init__(self, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        self.vectors = (r.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32)
        self.out = np.zeros((DIM, 2), np.float32)
        self.out[:, 1] = r.standard_normal(DIM) * 0.3
        self.bias = np.zeros(2, np.float32)

    def forward(self, bag: Bag, vectors: np.ndarray, word: np.ndarray, size: np.ndarray):
        """Means and scores of passages, given by the numbers of their words; vectors are those of bag.buckets."""
        words = np.add.reduceat(vectors[bag.gram], bag.gram_start, axis=0) / bag.gram_size[:, None]
        means = np.add.reduceat(words[word], np.cumsum(size) - size, axis=0) / np.maximum(size, SHORT)[:, None].astype(np.float32)
        z = means @ self.out + self.bias
        return means, 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -30, 30)))

    def fit(self, bag: Bag, labels: np.ndarray, weights: np.ndarray, epochs: int) -> AbuseModel:
        """labels and weights (0: left out) of the documents of a bag.

        Up to WARM epochs take a quarter of the passages of harmless documents in turn. Then passages that are settled
        (harmless ones with a low score, little-weighted ones of abusive documents) rest between two full passes.
        """
        vectors = self.vectors[bag.buckets]
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in (vectors, self.out, self.bias)]
        weights = weights / np.array([max(1e-9, weights[labels == k].sum()) for k in (0, 1)])[labels]
        turn = np.where((labels == 1)[bag.doc], -1, np.arange(len(bag.doc)) % 4)
        for epoch in range(epochs):
            full = epoch < WARM or epoch % FULL_PASS == WARM % FULL_PASS
            if full:
                keep = (turn < 0) | (turn == epoch % 4) if epoch < WARM else np.ones(len(turn), bool)
                word, size, doc = bag.word[np.repeat(keep, bag.size)], bag.size[keep], bag.doc[keep]
                label, n_passages = labels[doc], np.bincount(doc, minlength=bag.n_docs)
            means, p = self.forward(bag, vectors, word, size)
            e = np.exp((p - 1) * (min(12.0, epoch) if epoch >= 5 else 0.0))
            if full:
                e_all = np.bincount(doc, e, bag.n_docs)
            share = e / e_all[doc]
            share = np.where(label == 1, share, (1 - EVEN) * share + EVEN / n_passages[doc])
            g = (weights[doc] * share * (p - label)).astype(np.float32)
            dz = np.stack([-g, g], axis=1)
            d_mean = (dz @ self.out.T) / np.maximum(size, SHORT)[:, None].astype(np.float32)
            d_word = _sums(word, np.repeat(d_mean, size, axis=0), bag.n_words) / bag.gram_size[:, None]
            grads = _sums(bag.gram, d_word[bag.gram_word], len(bag.buckets)), means.T @ dz + DECAY * self.out, dz.sum(axis=0)
            for (m, v), param, grad in zip(state, (vectors, self.out, self.bias), grads, strict=True):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                param -= (RATE * (m / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(v / (1 - 0.99 ** (epoch + 1))) + 1e-7)).astype(np.float32)
            vectors *= np.float32(1 - RATE * SHRINK)
            if epoch >= WARM and full:
                keep = (weights[doc] > 0) & np.where(label == 1, share > SETTLED, p > SETTLED)
                word, size, doc, label = word[np.repeat(keep, size)], size[keep], doc[keep], label[keep]
                if not keep.any():
                    break
        self.vectors[bag.buckets] = vectors
        return self

    def scorer(self) -> Scorer:
        return Scorer(self.vectors @ (self.out[:, 1] - self.out[:, 0]), float(self.bias[1] - self.bias[0]), 0.0)


class Scorer:
    """The trained model as one number per bucket: what a word adds to the logit. The threshold is a logit too."""

    def __init__(self, buckets: np.ndarray, bias: float, threshold: float) -> None:
        self.buckets, self.bias, self.threshold = buckets.astype(np.float32), bias, threshold

    def logits(self, texts: list[str | None], known: dict[str, float]) -> np.ndarray:
        """Of the worst passage of each text; -inf without words."""
        toks = [tokens(t) if t else [] for t in texts]
        n = np.array([len(t) for t in toks], np.int64)
        v = np.fromiter(map(known.__getitem__, chain.from_iterable(toks)), np.float64, int(n.sum()))
        start, end, text = passages(np.isnan(v), np.repeat(np.arange(len(toks)), n))
        sums = np.concatenate([[0.0], np.cumsum(np.nan_to_num(v))])
        out = np.full(len(texts), -np.inf)
        np.maximum.at(out, text, (sums[end] - sums[start]) / np.maximum(end - start, SHORT) + self.bias)
        return out


class KnownWords(dict):
    def __init__(self, buckets: np.ndarray) -> None:
        self.buckets = buckets

    def __missing__(self, word: str) -> float:
        if len(self) > MAX_WORDS_KEPT:
            self.clear()
        v = self[word] = float("nan") if word in ENDS else float(self.buckets[grams(word)].mean())
        return v


def best_threshold(logits: np.ndarray, labels: np.ndarray, per_harmless: float) -> float:
    """The best F0.5 if every harmless label counts as per_harmless ones; the middle between the logits on either side."""
    order = np.argsort(-logits, kind="stable")
    hit, wrong = np.cumsum(labels[order]), np.cumsum(1 - labels[order]) * per_harmless
    f = 1.25 * hit / (hit + wrong + 0.25 * max(1, labels.sum()))
    k = int(np.argmax(f))
    after = logits[order[k + 1]] if k + 1 < len(order) else logits[order[k]] - 1
    return float((logits[order[k]] + after) / 2)


def part_of(texts: list[str]) -> np.ndarray:
    """Equal texts are in one part."""
    return np.array([zlib.crc32(t.encode("utf-8", "replace")) % PARTS for t in texts])


def fit_half(texts: list[str], labels: np.ndarray, weights: np.ndarray, half: int, epochs: int) -> tuple[np.ndarray, float, np.ndarray]:
    """(number per bucket, bias, logits of all texts, nan where the model has seen them) of one model."""
    seen = np.isin(part_of(texts), HALVES[half])
    own = np.flatnonzero(seen)
    out = np.full(len(texts), np.nan)
    if len(own) == 0 or labels[own].min() == labels[own].max():
        return np.zeros(BUCKETS, np.float32), 0.0, out
    s = AbuseModel().fit(Bag([texts[i] for i in own]), labels[own], weights[own], epochs).scorer()
    rest = np.flatnonzero(~seen)
    out[rest] = np.maximum(s.logits([texts[i] for i in rest], KnownWords(s.buckets)), -30.0)
    return s.buckets, s.bias, out


def _fitter(sample, epochs: int):
    def run(batches):
        texts, labels, weights = sample.value
        for batch in batches:
            for half in batch.column(0).to_pylist():
                buckets, bias, held = fit_half(texts, labels, weights, half, epochs)
                yield pa.RecordBatch.from_arrays([pa.array([half], pa.int64()), pa.array([buckets.tobytes()], pa.binary()), pa.array([bias]), pa.array([held.tobytes()], pa.binary())], ["half", "buckets", "bias", "held"])

    return run


def fit_halves(spark: SparkSession, texts: list[str], labels: np.ndarray, weights: np.ndarray, halves: list[int], epochs: int):
    """(numbers per bucket, biases, held-out logits) of models fitted as tasks of their own; each sends back 260 KB and 8 bytes a label."""
    sample = spark.sparkContext.broadcast((texts, labels, weights))
    jobs = spark.createDataFrame([(h,) for h in halves], "half bigint").repartitionByRange(len(halves), "half")
    rows = sorted(jobs.mapInArrow(_fitter(sample, epochs), "half bigint, buckets binary, bias double, held binary").collect())
    sample.unpersist()
    return np.array([np.frombuffer(r.buckets, np.float32) for r in rows]), np.array([r.bias for r in rows]), np.array([np.frombuffer(r.held) for r in rows])


def held_logits(held: np.ndarray) -> np.ndarray:
    """The mean over the models that have not seen a text; nan if all have."""
    n = (~np.isnan(held)).sum(axis=0)
    return np.where(n > 0, np.nansum(held, axis=0) / np.maximum(n, 1), np.nan)


def train(spark: SparkSession, texts: list[str], labels: np.ndarray, per_harmless: float = 1.0) -> Scorer:
    """The mean of six models, without the labels that held-out logits contradict, and its threshold."""
    none = Scorer(np.zeros(BUCKETS, np.float32), float("-inf"), 0.0)
    if len(texts) == 0 or labels.min() == labels.max():
        return none
    held = held_logits(fit_halves(spark, texts, labels, np.ones(len(texts)), [0, len(HALVES) - 1], FIRST_EPOCHS)[2])
    kept = ~((labels == 1) & (held < -DOUBT) | (labels == 0) & (held > DOUBT))
    buckets, biases, held = fit_halves(spark, texts, labels, kept.astype(float), list(range(len(HALVES))), EPOCHS)
    fitted, held = ~np.isnan(held).all(axis=1), held_logits(held)
    told = kept & ~np.isnan(held)
    if not fitted.any():  # no half has labels of both classes
        return none
    return Scorer(buckets[fitted].mean(axis=0), float(biases[fitted].mean()), best_threshold(held[told], labels[told], per_harmless))


def labelled(documents: DataFrame, labels: DataFrame, max_abusive: int = MAX_ABUSIVE, max_harmless: int = MAX_HARMLESS, max_bytes: int = MAX_BYTES) -> tuple[list[str], np.ndarray, float]:
    """The bounded training sample: texts, labels, and how many harmless labels each harmless text of it stands for."""
    votes = need(labels, ["doc_id", "toxic"]).where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.avg(F.col("toxic").cast("double")).alias("v")).where("v <> 0.5")
    votes = votes.select("doc_id", (F.col("v") > 0.5).cast("int").alias("label"), F.xxhash64("doc_id").alias("o"))
    sample = votes.where("label = 1").orderBy("o").limit(max_abusive).unionByName(votes.where("label = 0").orderBy("o").limit(max_harmless))
    texts = cut(need(documents, ["doc_id", "text"]).where(F.col("text").isNotNull()).join(F.broadcast(sample), "doc_id").select("doc_id", "label", "o", "text"))
    sizes = texts.select("doc_id", "o", F.octet_length("text").alias("n")).toPandas().sort_values(["o", "doc_id"], kind="stable")  # some 7,500 rows
    within = sizes["doc_id"][sizes["n"].cumsum() <= max_bytes]
    rows = texts.join(F.broadcast(documents.sparkSession.createDataFrame([(int(i),) for i in within.unique()], f"doc_id {texts.schema['doc_id'].dataType.simpleString()}")), "doc_id", "left_semi").toPandas().sort_values("doc_id", kind="stable")
    harmless = votes.where("label = 0").count()
    return rows["text"].tolist(), rows["label"].to_numpy(np.int64), max(1.0, harmless / max(1, int((rows["label"] == 0).sum())))


def _scorer(model):
    def run(batches):
        m = cloudpickle.loads(model.value)
        known = KnownWords(m.buckets)
        for batch in batches:
            z = m.logits(batch.column(batch.num_columns - 1).to_pylist(), known)
            s = np.where(np.isinf(z), 0.0, 1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s), pa.array(z > m.threshold)], [*batch.schema.names[:-1], "score", "flagged"])

    return run


ship(__name__)


def scored(documents: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """(*keep, score, flagged): every document with its score and whether it exceeds the fitted threshold."""
    docs = need(documents, [*keep, "text"])
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(cloudpickle.dumps(train(spark, *labelled(documents, labels))))  # by value: workers need not have this package
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.drop("text").schema)
    return docs.mapInArrow(_scorer(model), f"{fields}, score double, flagged boolean")


def rates(scores: DataFrame) -> DataFrame:
    """(source, n_docs, n_flagged, rate, mean_score)."""
    g = scores.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if("flagged").alias("n_flagged"), F.round(F.avg("score"), 6).alias("mean_score"))
    return g.select("source", "n_docs", "n_flagged", F.round(F.col("n_flagged") / F.col("n_docs"), 6).alias("rate"), "mean_score")
