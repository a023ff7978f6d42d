"""Operator 9: token ids in binary segments with Elias-Fano document boundaries.

A segment is self-contained bytes:

    b"SLTB" | version u8 | id width u8 (2 or 4) | flags u16 (1: doc ids are null) | documents u64 | ids u64 | first doc id i64
    | Elias-Fano of doc id - first doc id (not if null) | Elias-Fano of the documents' end offsets | ids, little-endian, concatenated

Segments lie in ascending doc_id order as the binary column of a Parquet table (part, segment, first_id, n_docs, n_ids,
part_offset, payload), so Spark's commit protocol covers retried tasks and any store that Spark reaches will do. A
segment takes at most `segment_ids` ids, or one document if that alone has more. A document's ids begin in the corpus
at its part's base (a prefix sum over one number for each writing task, the only thing the driver sees), plus the ids
of the part before its segment, plus its offset in the segment, which select returns: `bounds` for one document,
`select_many` for all that `read` lists.

Texts are encoded where they lie and only their ids are sorted. Parts follow the number of ids; rows that share a doc_id
may be dealt to several parts, by a hash of their ids and their place.

Defined results: a null text is empty; an empty text has the end id alone; rows with the same doc_id all get written, next
to each other; rows with a null doc_id come first, in segments of their own; an empty table gives no segment; columns
besides doc_id and text are not looked at.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm.common import documents, mapped, materialize, new_path, temporary
from strataline.llm.eliasfano import EliasFano, encode
from strataline.llm.tokens import encoder, vocabulary_path

MAGIC, VERSION, NULL_IDS = b"SLTB", 2, 1
PART_IDS = 1 << 24  # ids of a part, about
_HEAD = struct.Struct("<4sBBHQQq")
SEGMENT_SCHEMA = "part int, segment int, first_id long, n_docs long, n_ids long, part_offset long, payload binary"


def pack_segment(doc_ids: list[int | None], lengths: list[int], ids: bytes, width: int) -> bytes:
    """doc_ids ascending, or all null."""
    first, flags = (0, NULL_IDS) if doc_ids[0] is None else (doc_ids[0], 0)
    own = b"" if flags else encode(np.array([i - first for i in doc_ids], np.uint64))
    return _HEAD.pack(MAGIC, VERSION, width, flags, len(doc_ids), len(ids) // width, first) + own + encode(np.cumsum(np.asarray(lengths, np.uint64))) + ids


class Segment:
    """Reads a payload; offsets come from select."""

    def __init__(self, raw: bytes):
        magic, version, self.width, flags, self.n_docs, self.n_ids, self.first = _HEAD.unpack_from(raw, 0)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token segment")
        self.own = None if flags & NULL_IDS else EliasFano(raw, _HEAD.size)
        at = _HEAD.size + (self.own.size if self.own else 0)
        self.ends = EliasFano(raw, at)
        self.ids = np.frombuffer(raw, f"<u{self.width}", self.n_ids, at + self.ends.size)

    def doc_id(self, k: int) -> int | None:
        return None if self.own is None else self.first + self.own.select(k)

    def doc_ids(self) -> pa.Array:
        if self.own is None:
            return pa.nulls(self.n_docs, pa.int64())
        return pa.array(self.own.select_many(np.arange(self.n_docs)).astype(np.int64) + self.first)

    def bounds(self, k: int) -> tuple[int, int]:
        return (self.ends.select(k - 1) if k else 0), self.ends.select(k)

    def document(self, k: int) -> np.ndarray:
        a, b = self.bounds(k)
        return self.ids[a:b]


def encoded(docs: DataFrame, vocabulary: str, end_id: int, width: int = 2) -> DataFrame:
    """doc_id, ids (packed, with end_id), n (their number), mark: a number that tells rows of a doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary, width), end_id.to_bytes(width, "little")
        for b in batches:
            ids = [packed + end for packed in enc.encode(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // width for x in ids], pa.int64())], ["doc_id", "ids", "n"])

    rows = mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, ids binary, n long", 500)
    return rows.withColumn("mark", F.xxhash64("ids", F.monotonically_increasing_id()))


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int, width: int = 2, segment_ids: int = 1 << 20, partitions: int | None = None) -> None:
    """Encode every text, append end_id, write segments in ascending doc_id order below `path`."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, lengths, ids, size, segment, before = [], [], [], 0, 0, 0

        def flush():
            nonlocal held, lengths, ids, size, segment, before
            row = [part], [segment], [held[0]], [len(held)], [size], [before], [pack_segment(held, lengths, b"".join(ids), width)]
            kinds = pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()
            held, lengths, ids, size, segment, before = [], [], [], 0, segment + 1, before + size
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], ["part", "segment", "first_id", "n_docs", "n_ids", "part_offset", "payload"])

        for b in batches:
            for i, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                k = len(packed) // width
                if held and (size + k > segment_ids or (held[0] is None) != (i is None)):
                    yield flush()
                held.append(i)
                lengths.append(k)
                ids.append(packed)
                size += k
        if held:
            yield flush()

    with temporary(spark):
        rows = materialize(encoded(docs, vocabulary, end_id, width), "token-ids")
        total = rows.agg(F.sum("n")).first()[0] or 0
        few = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // segment_ids))
        n = partitions or max(1, few, -(-total // PART_IDS))
        ordered = rows.repartitionByRange(n, "doc_id", "mark").sortWithinPartitions("doc_id", "mark")
        mapped(ordered.select("doc_id", "ids"), run, SEGMENT_SCHEMA, 500).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the segments below `path`: doc_id, start, n_tokens, ids_crc32 (of the ids as 32 bits each)."""
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    sums = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row for each task that wrote
    base, bases = 0, []
    for r in sums:
        bases.append((r.part, base))
        base += r.n
    of_part = spark.createDataFrame(bases, "part int, part_base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, payload in zip(b.column(0).to_pylist(), b.column(1)):
                s = Segment(memoryview(payload.as_buffer()))
                ends = s.ends.select_many(np.arange(s.n_docs)).astype(np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                wide = s.ids.astype("<u4")
                crcs = [crc32(wide[x:y]) for x, y in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([s.doc_ids(), pa.array(begins + base), pa.array(ends - begins), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = segments.join(F.broadcast(of_part), "part").select((F.col("part_base") + F.col("part_offset")).alias("base"), "payload")
    return mapped(placed, run, "doc_id long, start long, n_tokens long, ids_crc32 long", 8)


def op9_token_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-segments")
    write(documents(spark, sf_dir), path, vocabulary_path("word_bpe_49k.json"), end_id=1)
    return read(spark, path)
