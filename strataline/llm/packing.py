"""Operator 10: sum-of-squares packing of documents into sequences of a fixed length.

A document's ids (with its end id) are one piece if they fit, else its last pieces are full and the first takes what is
left. Pieces are dealt into groups of about `group_size` by a hash, longest first within a group, and each goes to the
open sequence after which the sum over gaps g of N(g)^2, N(g) the open sequences with a gap of g tokens, is smallest;
a new sequence is opened only where none has room. A group's state is one counter for each gap and a list of sequences for each; groups are packed apart,
which costs at most the few sequences a group leaves open. Only lengths move: ids stay where they were made.

Defined results: a null text is empty; an empty text is its end id alone; repeated rows are packed each, told apart by
their place only; a null doc_id is packed like any other; an empty table gives no row; columns besides doc_id and text
are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm.common import documents, materialize, mapped
from strataline.llm.tokens import encoder, vocabulary_path

PIECE_SCHEMA = "doc_id {id}, piece int, start long, length long, ids_crc32 long, slot long"


def cut_lengths(n: int, room: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    first = n % room or room
    return [(0, first)] + [(at, room) for at in range(first, n, room)]


def sum_of_squares(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, taken in the given order."""
    count = np.zeros(room + 1, np.int64)  # open sequences by gap; a full one has gap 0 and is closed
    open_by_gap: dict[int, list[int]] = defaultdict(list)
    seq, off, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for k, size in enumerate(lengths.tolist()):
        # From gap g to g - size: (N(g) - 1)^2 - N(g)^2 + (N(g - size) + 1)^2 - N(g - size)^2; nothing is kept for gap 0.
        after = 2 * count[: room - size + 1] + 1
        after[0] = 0
        change = after + 1 - 2 * count[size:]
        change[count[size:] == 0] = 1 << 60
        at = int(change.argmin())
        g = at + size if change[at] < 1 << 59 else room
        if g == room:
            s, made = made, made + 1
        else:
            s = open_by_gap[g].pop()
            count[g] -= 1
        seq[k], off[k] = s, room - g
        if g > size:
            open_by_gap[g - size].append(s)
            count[g - size] += 1
    return seq, off


def pieces(docs: DataFrame, vocabulary: str, end_id: int, room: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and slot: a number of the row that makes its pieces distinct."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end, slot = encoder(vocabulary, 4), end_id.to_bytes(4, "little"), TaskContext.get().partitionId() << 40
        for b in batches:
            row, piece, start, length, crcs, slots = [], [], [], [], [], []
            for k, packed in enumerate(enc.encode(b.column(1).to_pylist())):
                ids = memoryview(packed + end)
                for p, (at, n) in enumerate(cut_lengths(len(ids) // 4, room)):
                    row.append(k)
                    piece.append(p)
                    start.append(at)
                    length.append(n)
                    crcs.append(crc32(ids[4 * at : 4 * (at + n)]))
                    slots.append(slot)
                    slot += 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crcs, slots))], ["doc_id", "piece", "start", "length", "ids_crc32", "slot"])

    return mapped(docs.select("doc_id", F.col("text").cast("string")), run, PIECE_SCHEMA.format(id=kind), 500)


def pack(made: DataFrame, room: int = 1024, group_size: int = 8192) -> DataFrame:
    """Adds sequence_id and offset to the pieces."""
    groups = max(1, -(-made.count() // group_size))
    kind = made.schema["doc_id"].dataType.simpleString()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "slot"], ascending=[False, True], kind="stable", ignore_index=True)
        seq, off = sum_of_squares(rows["length"].to_numpy(), room)
        return rows.assign(sequence_id=(int(key[0]) << 24) + seq, offset=off)[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    dealt = made.withColumn("pack_group", F.pmod(F.xxhash64("slot"), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInPandas(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, room: int = 1024, group_size: int = 8192) -> DataFrame:
    return pack(materialize(pieces(docs, vocabulary, end_id, room), "pieces"), room, group_size)


def op10_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), vocabulary_path("byte_bpe_50k.json"), end_id=2)
