"""Toxicity by multiple-instance learning: labels of documents, scores of sentences.

A document is a bag of sentences; it is toxic if one of its sentences is.
A sentence's score is a logistic function of its words, and a document's is the
noisy-or of its sentences, ``1 - prod(1 - p)``, so that the labels of documents
train the sentences' scores, and the sentences with the highest scores show where the
offence is.

The model is fitted on at most ``SAMPLE`` labelled training documents, about
evenly drawn by a hash of id and text: the words looked at are chosen by counts
over them, the weights fitted on the driver, where each document is reduced to the
chosen words of its sentences.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, table

#: Labelled documents that the weights are fitted on, at most.
SAMPLE = 20_000
#: Words that have weights, at most.
VOCABULARY = 2_000
#: Documents that must hold a word.
LEAST = 5
#: Lengths of the words' beginnings that count as features, since stems carry an offence into compounds.
STEMS = (5, 6, 7, 8)
#: Weight of a toxic document against a clean one in the fit.
TOXIC_WEIGHT = 2.0
#: Where sentences end.
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)*")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences that aren't blank."""
    out, at = [], 0
    for m in SENTENCE.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return [(a, b) for a, b in out if text[a:b].strip()]


def features(text: str) -> set[str]:
    """The distinct words of a lower-cased text, and the beginnings of the longer ones (marked ``*``)."""
    found = set(_TOKEN.findall(text))
    return found | {f"{w[:n]}*" for w in found for n in STEMS if len(w) > n}


#: Words whose features a worker keeps at hand, at most.
_KEPT = 200_000


class Finder:
    """Which features of an index texts have; what a word comes to is looked up once."""

    def __init__(self, index: dict[str, int]):
        self.index, self.seen = index, {}

    def find(self, text: str) -> set[int]:
        """The numbers of a lower-cased text's features that are in the index."""
        out, seen = set(), self.seen
        for w in set(_TOKEN.findall(text)):
            got = seen.get(w)
            if got is None:
                if len(seen) >= _KEPT:
                    seen.clear()
                got = seen[w] = frozenset(self.index[x] for x in features(w) if x in self.index)
            if got:
                out |= got
        return out


def _word_sets(batches):
    """(text, label) -> distinct words with the label, added up for the batch."""
    for batch in (piece for whole in batches for piece in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500))):
        docs, toxic = {}, {}
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for w in features((text or "").lower()):
                docs[w] = docs.get(w, 0) + 1
                if label:
                    toxic[w] = toxic.get(w, 0) + 1
        keys = list(docs)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(list(docs.values()), pa.int64()), pa.array([toxic.get(w, 0) for w in keys], pa.int64())], names=["word", "docs", "toxic"])


def _bags(index: dict[str, int]):
    """(text, label) -> the chosen words of each sentence that has any, and the number of sentences."""

    def kernel(batches):
        finder = Finder(index)
        for batch in batches:
            rows = [_bag(text or "", finder) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.list_(pa.int32()))), pa.array([r[1] for r in rows], pa.int64()), batch.column(1)], names=["bags", "n", "toxic"])

    return kernel


def _bag(text: str, finder: Finder) -> tuple[list[list[int]], int]:
    out, n = [], 0
    for s in SENTENCE.split(text.lower()):
        if s and not s.isspace():
            n += 1
            if found := sorted(finder.find(s)):
                out.append(found)
    return out, n


class Model:
    """Weights of words and a bias, from documents with labels."""

    def __init__(self, words: list[str], weights: np.ndarray, bias: float):
        kept = [(w, float(x)) for w, x in zip(words, weights, strict=True) if abs(x) > 1e-6]
        self.words, self.weights = [w for w, _ in kept], [x for _, x in kept]
        self.bias = float(bias)
        self.finder = Finder({w: i for i, w in enumerate(self.words)})

    def __reduce__(self):
        return Model, (self.words, self.weights, self.bias)

    def sentence(self, text: str) -> float:
        """The log-odds of one sentence."""
        return self.bias + math.fsum(self.weights[i] for i in self.finder.find(text.lower()))

    def document(self, text: str) -> tuple[float, int, int]:
        """(score, start, end): the noisy-or of the sentences and where the worst one stands; (0, 0, 0) for blank texts."""
        keep, worst, at = 0.0, -math.inf, (0, 0)
        plain = math.log1p(math.exp(self.bias))
        for a, b in sentences(text):
            z = self.sentence(text[a:b])
            keep -= plain if z == self.bias else max(z, 0.0) + math.log1p(math.exp(-abs(z)))
            if z > worst:
                worst, at = z, (a, b)
        return -math.expm1(keep), *at


def fit(per_doc: np.ndarray, per_sentence: np.ndarray, col: np.ndarray, n: np.ndarray, label: np.ndarray, size: int, *, rounds: int = 300, rate: float = 0.3, l2: float = 2e-5) -> tuple[np.ndarray, float]:
    """Weights and bias that maximise the likelihood of the labels under the noisy-or, by gradient steps (Adam).

    per_doc: sentences with chosen words of each document; per_sentence: chosen
    words of each of those; col: the words.  The other sentences of the n that
    a document has get the bias alone as their log-odds.
    """
    docs, sents = len(per_doc), len(per_sentence)
    doc = np.repeat(np.arange(docs), per_doc)
    row = np.repeat(np.arange(sents), per_sentence)
    plain = n - per_doc
    w, b = np.zeros(size), -6.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    weight = np.where(label == 1, TOXIC_WEIGHT, 1.0)
    for step in range(1, rounds + 1):
        z = b + np.bincount(row, w[col], minlength=sents)
        soft = np.logaddexp(0, z)
        keep = -np.bincount(doc, soft, minlength=docs) - plain * np.logaddexp(0, b)
        p = np.clip(-np.expm1(keep), 1e-9, 1.0)
        # d loglik / d keep: -1 for a clean document is keep itself; for a toxic one exp(keep) / p
        d = weight * np.where(label == 1, -np.exp(keep) / p, 1.0)
        gz = d[doc] * -(1 / (1 + np.exp(-z)))
        gw = np.bincount(col, gz[row], minlength=size) / docs - l2 * w
        gb = (gz.sum() + (d * plain * -(1 / (1 + np.exp(-b)))).sum()) / docs
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w = w + rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b = b + rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, b


def train(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from rows with a label of 0 or 1; without both kinds of labels the bias alone is set."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = labelled.select(F.pmod(F.xxhash64(F.col(id_col), text), F.lit(1 << 30)).alias("_h"), text.alias("text"), F.col(label_col).cast("int").alias("toxic")).filter("toxic in (0, 1)")
    total = rows.count()
    # a little less than SAMPLE, and less again should that be exceeded
    limit = 1 << 30 if total <= SAMPLE else int(max(SAMPLE / 2, SAMPLE - 5 * SAMPLE**0.5) / total * (1 << 30))
    sample = saved(rows.filter(F.col("_h") < limit))
    while (n := sample.count()) > SAMPLE:
        limit = limit * SAMPLE // n * 9 // 10
        sample = saved(sample.filter(F.col("_h") < limit))
    sample = sample.select("text", "toxic")
    total, bad = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not total or bad in (0, total):
        return Model([], np.zeros(0), 6.0 if total and bad else -6.0)
    seen = sample.mapInArrow(_word_sets, "word string, docs long, toxic long").groupBy("word").agg(F.sum("docs").alias("d"), F.sum("toxic").alias("t")).filter(F.col("d") >= LEAST)
    # the likelihood ratio of a word's presence against the label
    d, t = F.col("d").cast("double"), F.col("t").cast("double")
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(F.lit(0.0))
    share = float(bad) / float(total)
    g = part(t, d * share) + part(d - t, d * (1 - share)) + part(F.lit(float(bad)) - t, (F.lit(float(total)) - d) * share) + part(F.lit(float(total - bad)) - (d - t), (F.lit(float(total)) - d) * (1 - share))
    words = [r["word"] for r in seen.withColumn("g", g).filter("g > 4").orderBy(F.desc("g"), "word").limit(VOCABULARY).select("word").collect()]
    index = {w: i for i, w in enumerate(words)}
    got = sample.mapInArrow(_bags(index), "bags array<array<int>>, n long, toxic int").toArrow().combine_chunks()
    bags = got.column("bags").combine_chunks()
    per_doc, inner = np.diff(bags.offsets.to_numpy()), bags.flatten()
    per_sentence = np.diff(inner.offsets.to_numpy())
    w, b = fit(per_doc, per_sentence, inner.flatten().to_numpy().astype(np.int64), got["n"].to_numpy(), got["toxic"].to_numpy(), len(words))
    return Model(words, w, b)


def _score_kernel(shared):
    def kernel(batches):
        model = shared.value
        for batch in batches:
            got = [model.document(t or "") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.float64()), pa.array([int(g[0] >= 0.5) for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32())], names=["doc_id", "held_out", "score", "predicted", "worst_start", "worst_end"])

    return kernel


def score(docs: DataFrame, model: Model, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted, worst_start, worst_end``.

    worst: the characters of the sentence with the highest score.  Null and
    blank texts have no sentence: score 0.  Very long texts are scored whole.
    Ties go to the first sentence; repeated rows get equal results; null ids
    are kept; an empty table gives no rows; other columns, whatever their
    names, are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most VOCABULARY words
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_score_kernel(shared), "doc_id long, held_out boolean, score double, predicted int, worst_start int, worst_end int")


def clean(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows whose score is below 0.5, all columns kept; rows and order of columns as they came."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def kernel(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                yield part.filter(pa.array([shared.value.document(t or "")[0] < 0.5 for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(kernel, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the documents' labels, rows whose id's CRC is a multiple of 5 left out."""
    return train(docs.filter(~held_out()).select("doc_id", "text").join(labels.filter("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents, a fifth held out by the CRC of the id."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, trained(docs, table(spark, sf_dir, "labels")), held_out())
