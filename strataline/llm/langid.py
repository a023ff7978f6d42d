"""Operator 7: language by nearest centroid.

A text's letters (lower case, runs of other characters as one gap) give hashed 1-, 2- and 3-grams; log tf x idf vectors
are normalised. Each language has several centroids, from spherical k-means over its own rows, and a text takes the
language of the centroid with the largest cosine. A centroid's radius is the distance within which all but a small share
of its training rows lie, with a margin: a text outside the radius of its nearest centroid is marked `rejected`.

The idf counts all training rows. The centroids take a bounded sample of labelled rows (`max_train` in all, dealt evenly
among the languages; the only bound). Scoring reads whole texts.

Defined results: a null text or one without a letter is `und` with score 0, and is rejected; a text longer than a
chunk is counted chunk by chunk, whole; without training rows every text is `und`; repeated rows get their row each; a
null doc_id gets its row and never trains; columns besides doc_id, text (and lang in training) are not looked at.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm.common import documents, id_remainder, mapped

BITS = 12
DIM = 1 << BITS
UNKNOWN = "und"
_GAP = re.compile(r"[\W\d_]+")
_MULT = np.uint32(2654435761)
CHUNK = 1 << 16


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def grams(text: str) -> np.ndarray:
    """Counts of hashed 1- to 3-grams."""
    out = np.zeros(DIM)
    for at in range(0, len(text), CHUNK):
        # Two characters of the chunk before, so that no gram is lost at the seam.
        clean = _GAP.sub(" ", text[max(0, at - 2) : at + CHUNK].lower())
        c = np.frombuffer(f" {clean} ".encode("utf-32-le", "replace"), np.uint32)
        for n in (1, 2, 3):
            if len(c) < n:
                break
            h = c[: len(c) - n + 1].copy()
            for k in range(1, n):
                h = h * np.uint32(31 * 1009) + c[k : len(c) - n + 1 + k]
            h = (h + np.uint32(n)) * _MULT
            out += np.bincount(h >> np.uint32(32 - BITS), minlength=DIM)
    return out


def unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(-1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray  # [centroids, DIM], unit
    lang: list[str]  # of each centroid
    reach: np.ndarray  # least cosine that a centroid accepts

    def place(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid and cosine of rows of counts."""
        cos = unit(np.log1p(counts) * self.idf) @ self.centroids.T
        best = cos.argmax(1)
        return best, cos[np.arange(len(best)), best]


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means, seeded by farthest points; (centroids, own centroid of each row)."""
    rng = np.random.default_rng(seed)
    c = x[[int(rng.integers(len(x)))]]
    while len(c) < min(k, len(x)):
        c = np.vstack([c, x[[int((x @ c.T).max(1).argmin())]]])
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.vstack([unit(x[own == j].sum(0)) if (own == j).any() else c[j] for j in range(len(c))])
    return c, (x @ c.T).argmax(1)


def document_frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """The number of rows, and of those that hold each gram, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held = 0, np.zeros(DIM, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                n += 1
                held += grams(t) > 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1), pa.int32()), pa.array(np.append(held, n))], ["gram", "n"])

    sums = mapped(rows.select("text"), run, "gram int, n long", 500).groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIM + 1, np.int64)
    for r in sums:
        out[r.gram] = r.n
    return int(out[DIM]), out[:DIM]


def fit(counts: np.ndarray, langs: list[str], per_language: int = 4, outside: float = 0.01, margin: float = 0.1, frequencies: tuple[int, np.ndarray] | None = None) -> Model:
    """With `frequencies` (document_frequencies), the idf is of those instead of counts."""
    n, held = frequencies or (len(counts), (counts > 0).sum(0))
    idf = np.log((1 + n) / (1 + held)) + 1
    x = unit(np.log1p(counts) * idf)
    cents, names, reach = [np.zeros((0, DIM))], [], []
    for k, lang in enumerate(sorted(set(langs))):
        own = x[np.array([v == lang for v in langs])]
        own = own[own.any(1)]
        if not len(own):
            continue
        c, at = kmeans(own, per_language, seed=k)
        cos = (own * c[at]).sum(1)
        cents.append(c)
        names += [lang] * len(c)
        reach += [float(np.quantile(cos[at == j], outside)) - margin if (at == j).any() else 1.0 for j in range(len(c))]
    return Model(idf, np.vstack(cents), names, np.array(reach))


def train(docs: DataFrame, max_train: int = 4000, per_language: int = 4) -> Model:
    """docs: doc_id, text, lang; held-out rows are left out by the caller."""
    spark = docs.sparkSession
    rows = docs.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model(np.ones(DIM), np.zeros((0, DIM)), [], np.zeros(0))
    each, cells = max(1, max_train // len(sizes)), 1 << 30
    share = F.create_map(*(F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, int(cells * min(1.0, each / n)))))
    few = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(cells)) < F.element_at(share, F.col("lang")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([grams(t).astype("<f4").tobytes() for t in b.column(0).to_pylist()], pa.binary())], ["lang", "v"])

    got = sorted((r.lang, bytes(r.v)) for r in mapped(few.select("text", "lang"), run, "lang string, v binary", 500).toLocalIterator())
    got = got or [(min(sizes), np.zeros(DIM, "<f4").tobytes())]
    return fit(np.vstack([np.frombuffer(v, "<f4") for _, v in got]).astype(float), [x for x, _ in got], per_language, frequencies=document_frequencies(rows))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = pickle.loads(sent.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            langs, scores, out = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            able = [i for i, t in enumerate(texts) if m.lang and has_letter(t)]
            for at in range(0, len(able), 64):
                rows = able[at : at + 64]
                best, cos = m.place(np.vstack([grams(texts[i]) for i in rows]))
                for i, k, c in zip(rows, best.tolist(), cos.tolist()):
                    langs[i], scores[i], out[i] = m.lang[k], min(1.0, max(0.0, c)), c < m.reach[k]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores), pa.array(out)], ["doc_id", "lang_pred", "score", "rejected"])

    return mapped(docs.select("doc_id", F.col("text").cast("string")), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean", 500)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held = id_remainder(F.col("doc_id"), 4)
    out = predict(docs, train(docs.filter(held != 2)))
    return out.select("doc_id", (held == 2).alias("held_out"), "lang_pred", "score", "rejected")
