"""Operator 1: quality classifier, a factorisation machine over hashed words, structure statistics and metadata.

Training takes a bounded sample of labelled rows (`max_train`, the only bound); features of the sample are computed
on the executors and only those bounded vectors come to the driver. Scoring streams whole texts in Arrow batches.

Defined results: a null text scores as an empty one; an empty text has its structure features only and so a score;
repeated rows each get their row; a null doc_id is scored, is not held out and never trains; missing classes or no
labels give a constant score; columns besides doc_id, text and n_chars are not looked at (n_chars may be absent).
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm import fm
from strataline.llm.common import bounded_sample, documents, id_remainder, mapped, table

WORD_BITS = 15
BINS = 16
THRESHOLD = 0.3
SYMBOLS = b"#$%&*|"
#: Word buckets, then BINS cells for each statistic.
STATS = ("words", "word_len", "upper", "symbols", "shouts", "digits", "stops", "distinct_words", "distinct_lines", "line_len", "top_word", "repeats", "wide", "spaces", "meta_chars")
DIM = (1 << WORD_BITS) + BINS * len(STATS)
_BYTES = np.arange(256)
_UPPER, _DIGIT = (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 48) & (_BYTES <= 57)
_LETTER = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)


class Buckets(dict):
    """word -> hash bucket, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        b = crc32(word) & ((1 << WORD_BITS) - 1)
        if len(self) < 200_000:
            self[word] = b
        return b


_BUCKETS = Buckets()


def statistics(raw: bytes, words: list[bytes], counts: Counter, n_chars: int | None) -> list[float]:
    """Each in 0..1, in the order of STATS."""
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, int)
    n, k = max(1, len(raw)), max(1, len(words))
    letters, lines = max(1, int(by[_LETTER].sum())), raw.split(b"\n")
    size = lambda x: min(1.0, np.log1p(x) / 14)
    return [
        size(len(words)),
        min(1.0, len(raw) / k / 32),
        by[_UPPER].sum() / letters,
        min(1.0, sum(int(by[c]) for c in SYMBOLS) / k / 4),
        min(1.0, int(by[33]) / k),
        by[_DIGIT].sum() / n,
        min(1.0, int(by[46]) / k),
        len(counts) / k,
        len(set(lines)) / len(lines),
        size(len(raw) / len(lines)),
        max(counts.values(), default=0) / k,
        sum(map(eq, words, words[1:])) / k,
        by[_BYTES >= 128].sum() / n,
        int(by[32] + by[10]) / n,
        0.0 if n_chars is None or n_chars < 0 else size(n_chars),
    ]


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and values: words by L2-normalised 1 + log tf, statistics as one of BINS cells each."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.lower().split()
    counts = Counter(words)
    stats = np.asarray(statistics(raw, words, counts, n_chars))
    cells = (1 << WORD_BITS) + np.arange(len(STATS)) * BINS + np.minimum(BINS - 1, (np.sqrt(np.clip(stats, 0, 1)) * BINS).astype(int))
    own = np.full(len(STATS), 1 / np.sqrt(len(STATS)))
    if not counts:
        return cells, own
    ids = np.fromiter(map(_BUCKETS.__getitem__, counts), np.int64, len(counts))
    val = 1 + np.log(np.fromiter(counts.values(), float, len(counts)))
    return np.concatenate([ids, cells]), np.concatenate([val / np.sqrt((val * val).sum()), own])


def compress(rows: list[tuple[np.ndarray, np.ndarray]]):
    ptr = np.concatenate([[0], np.cumsum([len(i) for i, _ in rows])]).astype(np.int64)
    cat = lambda k, kind: np.concatenate([r[k] for r in rows]).astype(kind) if rows else np.zeros(0, kind)
    return cat(0, np.int64), cat(1, np.float64), ptr


def scores(model: fm.FM, texts: list, chars: list) -> np.ndarray:
    out = [model.proba(*compress([features(t, c) for t, c in zip(texts[at : at + 64], chars[at : at + 64])])) for at in range(0, len(texts), 64)]
    return np.concatenate(out) if out else np.zeros(0)


def with_chars(docs: DataFrame, *keep: str) -> DataFrame:
    has = "n_chars" in docs.columns
    return docs.select(*keep, F.col("text").cast("string").alias("text"), (F.col("n_chars") if has else F.lit(None)).cast("long").alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, max_train: int = 12_000) -> fm.FM:
    """docs: doc_id, text, n_chars. labels: doc_id, label (0 or 1). The caller leaves held-out rows out of labels."""
    spark = docs.sparkSession
    few = bounded_sample(labels.filter("doc_id IS NOT NULL AND label IN (0, 1)").select("doc_id", F.col("label").cast("int").alias("label")).distinct(), "doc_id", max_train)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t, c) for t, c in zip(b.column("text").to_pylist(), b.column("n_chars").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([i.astype("<i4").tobytes() for i, _ in rows], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in rows], pa.binary()), b.column("label"), b.column("doc_id")], ["i", "v", "label", "doc_id"])

    own = with_chars(docs, "doc_id").join(F.broadcast(few), "doc_id").select("text", "n_chars", "label", F.col("doc_id").cast("string").alias("doc_id"))
    made = mapped(own, vectors, "i binary, v binary, label int, doc_id string")
    got = made.groupBy("doc_id", "label").agg(F.min(F.struct("i", "v")).alias("x")).select("doc_id", "label", "x.*").collect()  # of rows that repeat an id, one
    got.sort(key=lambda r: (r.doc_id, r.label, r.i, r.v))  # the same model at every run
    rows = [(np.frombuffer(r.i, "<i4"), np.frombuffer(r.v, "<f4")) for r in got]
    return fm.fit(*compress(rows), np.array([r.label for r in got], float), DIM)


def score(docs: DataFrame, model: fm.FM, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(sent.value)
        for b in batches:
            s = scores(m, b.column("text").to_pylist(), b.column("n_chars").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return mapped(with_chars(docs, "doc_id"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def keep_good(docs: DataFrame, model: fm.FM, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(pickle.dumps(model))
    has = "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(sent.value)
        for b in batches:
            s = scores(m, b.column("text").to_pylist(), b.column("n_chars").to_pylist() if has else [None] * b.num_rows)
            yield b.filter(pa.array(s >= threshold))

    return mapped(docs, run, docs.schema)


def query_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> fm.FM:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return train(docs, labels.filter(id_remainder(F.col("doc_id"), 5) != 0))


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = score(docs, query_model(spark, docs, sf_dir))
    return out.select("doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
