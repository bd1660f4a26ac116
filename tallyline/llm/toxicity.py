"""Toxicity scores from a linear model that is indifferent to which group a text mentions.

The model is a logistic regression on the words a text contains.  For every labelled training text
that mentions a group, a counterfactual copy is made in which the identity term gives way to another
of its kind; training adds ``PENALTY`` times the squared change of the score between the two, so
that a term seen more often in toxic texts does not become evidence by itself.

Words, and beginnings of words, enter the model if they stand in enough training texts and their association with the label
exceeds what chance explains; identity terms always enter, so that the penalty acts on them.  They have no beginnings, so
that the swap of a term changes everything that it says about the group.

Labels are taken from at most ``1.2 * TRAIN_ROWS`` labelled documents, chosen by a hash of the
doc_id; the bound is for fitting only.  Scoring covers every row and whole texts.

Defined results: null and empty texts get the score of a text without words; a document whose label
is null or not 0 or 1 is not learned from; of a doc_id with several labels the largest counts; without
any label of one kind every score is the share of label 1 (0 without labels).  Repeated rows get
equal scores, an empty table an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import common

TRAIN_ROWS = 5_000
THRESHOLD = 0.3
PENALTY = 5.0
RIDGE = 0.02
STEPS = 200
#: Letters of a word's beginning.
PREFIX = 4
#: A word needs this many training texts, and this many standard errors of difference.
LEAST_TEXTS, LEAST_Z = 5, 4.0
#: Words of one line stand for groups of the same kind and are swapped with one another.
IDENTITY = (
    "women men girls boys woman man",
    "black white asian latino arab african european",
    "muslim christian jewish hindu buddhist atheist muslims christians jews hindus buddhists",
    "gay lesbian straight bisexual transgender queer heterosexual",
    "immigrant immigrants refugee refugees foreigner foreigners native natives",
    "frauen männer frau mann muslime christen juden ausländer flüchtlinge",
    "femmes hommes femme homme musulmans chrétiens juifs étrangers réfugiés",
    "mujeres hombres mujer hombre musulmanes cristianos judíos extranjeros refugiados",
)
TERMS = frozenset(" ".join(IDENTITY).split())
_words = re.compile(r"\w+").findall


def words_of(text: str) -> set[str]:
    """The words of a text, and their beginnings, which inflected and compound words share.

    Identity terms have no beginnings.
    """
    words = set(_words(text.lower()))
    return words | {w[:PREFIX] + "*" for w in words if len(w) > PREFIX and w not in TERMS}


def swaps() -> dict[str, str]:
    """Each identity term and the next one of its kind."""
    out = {}
    for line in IDENTITY:
        terms = line.split()
        out.update(zip(terms, [*terms[1:], terms[0]]))
    return out


def counterfactual(words: set[str], swap: dict[str, str]) -> set[str]:
    return {swap.get(w, w) for w in words}


@dataclass
class Model:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, words: set[str]) -> float:
        total = self.bias + sum(self.weights[w] for w in self.weights.keys() & words)
        return float(1 / (1 + np.exp(-total)))


def chosen_words(texts: list[set[str]], labels: np.ndarray) -> list[str]:
    """Words whose share of texts differs between the labels by more than chance."""
    counts = [Counter(), Counter()]
    for words, label in zip(texts, labels):
        counts[label].update(words)
    n = np.array([(labels == 0).sum(), (labels == 1).sum()])
    out = []
    for word in counts[0].keys() | counts[1].keys():
        c = np.array([counts[0][word], counts[1][word]])
        if c.sum() < LEAST_TEXTS:
            continue
        share = c.sum() / n.sum()
        error = np.sqrt(share * (1 - share) * (1 / n).sum())
        if error and abs(c[1] / n[1] - c[0] / n[0]) > LEAST_Z * error:
            out.append(word)
    return sorted(out)


def fit(texts: list[set[str]], labels: np.ndarray, penalty: float = PENALTY) -> Model:
    """Gradient descent with step sizes by coordinate (Adam), over all texts in every step."""
    labels = np.asarray(labels, int)
    rate = float(labels.mean()) if labels.size else 0.0
    if rate in (0.0, 1.0):
        return Model(-30.0 if rate == 0 else 30.0)
    swap = swaps()
    vocabulary = sorted({*chosen_words(texts, labels), *swap})
    place = {w: i for i, w in enumerate(vocabulary)}

    def rows(sets: list[set[str]]) -> tuple[np.ndarray, np.ndarray]:
        hit = [[place[w] for w in words & place.keys()] for words in sets]
        return np.repeat(np.arange(len(sets)), [len(h) for h in hit]), np.array([i for h in hit for i in h], int)

    mentions = [w for w in texts if w & swap.keys()]
    x, a, b = rows(texts), rows(mentions), rows([counterfactual(w, swap) for w in mentions])
    size = len(vocabulary)
    weights, bias = np.zeros(size), float(np.log(rate / (1 - rate)))
    mean, square = np.zeros(size + 1), np.zeros(size + 1)

    def sums(of: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
        return np.bincount(of[0], weights[of[1]], n)

    def score(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    for step in range(1, STEPS + 1):
        off = (score(bias + sums(x, len(texts))) - labels) / len(texts)
        gradient = np.r_[np.bincount(x[1], off[x[0]], size) + RIDGE * weights / size, off.sum()]
        if mentions:
            left, right = (score(bias + sums(of, len(mentions))) for of in (a, b))
            change = 2 * penalty * (left - right) / len(mentions)
            da, db = change * left * (1 - left), -change * right * (1 - right)
            gradient[:-1] += np.bincount(a[1], da[a[0]], size) + np.bincount(b[1], db[b[0]], size)
            gradient[-1] += da.sum() + db.sum()
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        move = 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return Model(bias, {w: float(weights[i]) for w, i in place.items() if weights[i]})


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on labelled documents; ``labels`` has doc_id and toxic and holds no row of the test fold."""
    known = (
        labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    sample = common.sampled(known, F.col("doc_id"), rows, known.count())
    # At most 1.2 * rows ids and labels.
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, column=0):
            sets = [sorted(words_of(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(sets, pa.list_(pa.string())), batch.column(1)], names=["words", "toxic"]
            )

    found = joined.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "words array<string>, toxic int")
    found = found.limit(int(2 * rows)).toArrow()
    seen: dict[str, str] = {}
    texts = [{seen.setdefault(w, w) for w in words} for words in found["words"].to_pylist()]
    return fit(texts, found["toxic"].to_numpy())


class Scorer:
    """Scores of one worker, which remembers the model's words in runs of characters it has met."""

    def __init__(self, model: Model):
        self.place = {w: i for i, w in enumerate(model.weights)}
        self.weights, self.bias = np.array(list(model.weights.values()), float), model.bias
        self.pool = common.Pool(self.learn, common.CACHE_WORDS)

    def learn(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [[self.place[w] for w in words_of(r.decode()) if w in self.place] for r in runs]
        return np.array([i for f in found for i in f], np.int64), np.array([len(f) for f in found], np.int64)

    def scores(self, texts: pa.Array) -> np.ndarray:
        words = common.Words(texts)
        numbers = self.pool.numbers(words.different)[words.codes]
        text = np.repeat(words.text, self.pool.counts[numbers])
        total = np.full(len(texts), self.bias)
        if text.size:
            # A word counts once in a text.
            hit = np.unique(text * self.weights.size + self.pool.gather(numbers))
            total += np.bincount(hit // self.weights.size, self.weights[hit % self.weights.size], len(texts))
        return 1 / (1 + np.exp(-total))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(Model(*sent.value))
        for batch in common.slices(batches):
            scores = own.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    held_out = common.fold(F.col("doc_id"), 4) == 2
    model = train(docs, labels.filter(~held_out))
    return scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
