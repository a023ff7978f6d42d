"""Operator 5: toxicity by a classifier chain.

Categories are predicted one after another by sparse linear models over the words of the whole text; each later model
also gets the probabilities of all earlier categories. For training, those probabilities are out of fold: a row's comes
from a model that did not see the row, so that later models meet what they will meet in use. Folds are by a hash of the
row's words, so copies of a text share one.

Categories are columns of 0/1 labels, in chain order, the last one being the verdict. Where the labels name only the
verdict, `kinds` categories before it are found in the training rows: the words that stand out among toxic rows are dealt
to as many groups by which stand together more often than chance has them (`word_groups`), and a row has a category if
its verdict is 1 and it holds a word of that group. A model out of fold finds the groups without its fold, too.

Training takes a bounded sample of labelled rows (`max_train`, the only bound; of rows that repeat an id, one). Words enter as
presence; only words whose share among the positives stands out are kept, so long clean texts do not collect noise.

Defined results: a null or empty text has the intercepts' probabilities and is not toxic; without both labels in the
training rows a category has a constant probability; repeated rows get their row each; a null doc_id is scored and never
trains; columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm.common import bounded_sample, documents, id_remainder, mapped, table
from strataline.llm.fm import sigmoid

_WORD = re.compile(r"[^\W\d_]+")
VERDICT = "toxic"


def word_set(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


@dataclass
class Link:
    """One category: weights of words and of the probabilities before it."""

    name: str
    bias: float
    weights: dict[str, float]
    before: np.ndarray

    def logit(self, words: set[str], earlier: list[float]) -> float:
        own = self.weights.keys() & words
        return self.bias + sum(map(self.weights.__getitem__, own)) + sum(w * p for w, p in zip(self.before, earlier))


@dataclass
class Chain:
    links: list[Link] = field(default_factory=list)
    threshold: float = 0.5

    def proba(self, text: str | None) -> list[float]:
        words, out = word_set(text), []
        for link in self.links:
            out.append(float(sigmoid(np.array(link.logit(words, out)))))
        return out


def salient(docs: list[np.ndarray], y: np.ndarray, n_words: int, most: int = 2000) -> np.ndarray:
    """Words in at least three positives whose log odds stand out by three standard errors, the strongest first."""
    seen = lambda v: np.bincount(np.concatenate([d for d, x in zip(docs, y) if x == v] or [np.zeros(0, np.int64)]), minlength=n_words)
    pos, neg = seen(1) + 0.5, seen(0) + 0.5
    n1, n0 = y.sum() + 1.0, len(y) - y.sum() + 1.0
    odds = np.log(pos / np.maximum(n1 - pos, 0.5)) - np.log(neg / np.maximum(n0 - neg, 0.5))
    z = np.where(pos > 3, odds / np.sqrt(1 / pos + 1 / neg), 0)
    order = np.argsort(-z, kind="stable")[:most]
    return order[z[order] > 3]


def fit_link(name: str, docs: list[np.ndarray], words: list[str], y: np.ndarray, earlier: np.ndarray, l2: float = 0.02, rounds: int = 300) -> Link:
    """Logistic regression by accelerated gradient steps on the kept words and the earlier probabilities."""
    share = float((y.sum() + 0.5) / (len(y) + 1.0))
    constant = Link(name, float(np.log(share / (1 - share))), {}, np.zeros(earlier.shape[1]))
    if not len(y) or y.min() == y.max():
        return constant
    kept = salient(docs, y, len(words))
    place = np.full(len(words), -1)
    place[kept] = np.arange(len(kept))
    cols = [p[p >= 0] for p in (place[d] for d in docs)]
    rows, cols = np.repeat(np.arange(len(docs)), [len(c) for c in cols]), np.concatenate(cols)
    k, n = len(kept), len(y)
    x = np.concatenate([np.zeros(k), constant.before, [constant.bias]])
    last, t = x, 1.0
    # At most the curvature of the loss: a quarter of the largest squared length of a row.
    step = 4.0 / (1 + earlier.shape[1] + (np.bincount(rows, minlength=n).max() if len(rows) else 0))
    for _ in range(rounds):
        z = np.bincount(rows, x[cols], minlength=n) + earlier @ x[k:-1] + x[-1]
        err = (sigmoid(z) - y) / n
        grad = np.concatenate([np.bincount(cols, err[rows], minlength=k) + l2 / n * x[:k], earlier.T @ err, [err.sum()]])
        new = x - step * grad
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, last, t = new + (t - 1) / t2 * (new - last), new, t2
    return Link(name, float(last[-1]), {words[w]: float(c) for w, c in zip(kept.tolist(), last[:k])}, last[k:-1])


def word_groups(docs: list[np.ndarray], y: np.ndarray, n_words: int, kinds: int, rounds: int = 20) -> np.ndarray:
    """The group of each word that stands out among the positives, -1 of all others.

    Spherical k-means of how often the words stand together in a positive row, over what their counts alone give. It
    starts from the most frequent word and, for each further group, the one that is least like those chosen.
    """
    out = np.full(n_words, -1)
    kept = salient(docs, y, n_words)
    if not len(kept):
        return out
    place = np.full(n_words, -1)
    place[kept] = np.arange(len(kept))
    held = np.zeros((int(y.sum()), len(kept)), np.float32)
    for row, d in zip(held, (d for d, x in zip(docs, y) if x)):
        p = place[d]
        row[p[p >= 0]] = 1
    together, seen = held.T @ held, held.sum(0)
    v = together / np.sqrt(np.outer(seen, seen)) - np.sqrt(np.outer(seen, seen)) / len(held)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    chosen = [int(np.lexsort((kept, -seen))[0])]
    while len(chosen) < min(kinds, len(kept)):
        chosen.append(int((v @ v[chosen].T).max(1).argmin()))
    centres = v[chosen]
    for _ in range(rounds):
        own = (v @ centres.T).argmax(1)
        centres = np.stack([v[own == k].sum(0) if (own == k).any() else c for k, c in enumerate(centres)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    out[kept] = own
    return out


def named_by(docs: list[np.ndarray], y: np.ndarray, n_words: int, kinds: int, like: np.ndarray | None = None) -> list[np.ndarray]:
    """Labels of each kind: the positives that hold a word of its group. `like` are groups whose order is taken over."""
    groups = word_groups(docs, y, n_words, kinds)
    order = list(range(kinds))
    if like is not None:
        shared = np.array([[((groups == k) & (like == j)).sum() for k in range(kinds)] for j in range(kinds)])
        for j in range(kinds):
            k = int(shared[j].argmax())
            order[j] = k
            shared[:, k] = -1
    return [y * np.array([(groups[d] == k).any() for d in docs], float) for k in order]


def fit(docs: list[np.ndarray], words: list[str], labels: dict[str, np.ndarray], folds: int = 3, fold: np.ndarray | None = None, within: Callable[[np.ndarray], dict[str, np.ndarray]] | None = None) -> Chain:
    """docs: the different words of each row, as places in words. labels: category -> 0/1 of each row, in chain order;
    the last is the verdict. fold: the fold of each row; within(rows): the labels as those rows alone give them, where they
    depend on the rows. The threshold is the one with the best F0.5 out of fold: clean texts are left alone."""
    fold = np.arange(len(docs)) % folds if fold is None else fold
    of_fold = [labels if within is None else within(np.flatnonzero(fold != f)) for f in range(folds)]
    earlier, chain = np.zeros((len(docs), 0)), Chain()
    for name, y in labels.items():
        chain.links.append(fit_link(name, docs, words, y, earlier))
        out = np.zeros(len(docs))
        for f in range(folds):
            rows = np.flatnonzero(fold != f)
            target = of_fold[f][name]
            link = fit_link(name, [docs[i] for i in rows], words, target[rows] if len(target) == len(docs) else target, earlier[rows])
            for i in np.flatnonzero(fold == f):
                out[i] = sigmoid(np.array(link.logit({words[w] for w in docs[i]} if link.weights else set(), earlier[i].tolist())))
        earlier = np.column_stack([earlier, out])
    if earlier.size and y.min() < y.max():
        tried = np.linspace(0.1, 0.9, 33)
        f = [1.25 * (y[out >= c].sum()) / max(1, (out >= c).sum() + 0.25 * y.sum()) for c in tried]
        best = np.flatnonzero(np.isclose(f, max(f)))
        chain.threshold = float(tried[best[len(best) // 2]])
    return chain


def fit_kinds(docs: list[np.ndarray], words: list[str], verdict: np.ndarray, kinds: int = 2, folds: int = 3) -> Chain:
    """A chain of kinds found in the rows, kind_1 and on, and the verdict."""
    fold = np.array([crc32(" ".join(sorted(words[w] for w in d)).encode()) % folds for d in docs], np.int64)
    names = [f"kind_{k + 1}" for k in range(kinds)]
    groups = word_groups(docs, verdict, len(words), kinds)

    def labels(rows: np.ndarray, like: np.ndarray | None) -> dict[str, np.ndarray]:
        own = verdict[rows]
        return dict(zip(names, named_by([docs[i] for i in rows], own, len(words), kinds, like))) | {VERDICT: own}

    return fit(docs, words, labels(np.arange(len(docs)), None), folds, fold, lambda rows: labels(rows, groups))


class Vocabulary(dict):
    """word -> place, in order of first sight."""

    def __missing__(self, word: str) -> int:
        self[word] = len(self)
        return self[word]

    def places(self, words: Iterator[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64)


def train(docs: DataFrame, labels: DataFrame, max_train: int = 12_000, kinds: int = 2) -> Chain:
    """labels: doc_id, toxic. Whole texts of the sample come to the driver as sets of words, there as numbers."""
    few = bounded_sample(labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct(), "doc_id", max_train, seed=5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([" ".join(sorted(word_set(t))) for t in b.column(2).to_pylist()])], ["doc_id", "toxic", "words"])

    own = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id").select(F.col("doc_id").cast("string").alias("doc_id"), "toxic", "text")
    made = mapped(own, run, "doc_id string, toxic int, words string").groupBy("doc_id", "toxic").agg(F.min("words").alias("words"))  # of rows that repeat an id, one
    places, rows = Vocabulary(), []
    for r in sorted(made.toLocalIterator(), key=lambda r: (r.doc_id, r.toxic)):
        rows.append((r.toxic, places.places(r.words.split(" ") if r.words else [])))
    return fit_kinds([w for _, w in rows], list(places), np.array([t for t, _ in rows], float), kinds)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, score and toxic of the verdict, and p_<category> of each category before it."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(chain))
    names = [f"p_{link.name}" for link in chain.links[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Chain = pickle.loads(sent.value)
        for b in batches:
            p = np.array([c.proba(t) for t in b.column(1).to_pylist()]).reshape(b.num_rows, len(c.links))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p[:, -1]), pa.array(p[:, -1] >= c.threshold), *(pa.array(p[:, k]) for k in range(len(names)))], ["doc_id", "score", "toxic", *names])

    fields = "".join(f", {n} double" for n in names)
    return mapped(docs.select("doc_id", F.col("text").cast("string")), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, toxic boolean{fields}")


def op5_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from labelled rows whose crc32(doc_id) mod 5 is not 0."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held = id_remainder(F.col("doc_id"), 5)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(held != 0)
    out = score(docs, train(docs, labels))
    return out.withColumn("held_out", held == 0)
