"""Ordered folds and scans of an associative operation, without a window over a whole set in one task.

Rows are range-partitioned by their order and sorted within partitions; each partition is folded by itself, with a restart
where the key changes. What the partitions before hand over to each one is a product of their totals, one row a partition,
and goes only to the rows of a partition's first key. So an order that matters (composition of transforms) is kept, a
key may span any number of partitions, and no task sees more than its range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.runtime import mapped
from strataline.shared import materialize

Pairs = Callable[[np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Monoid:
    """An associative operation on rows of numbers: combine(left, right) of arrays (n, width), row by row."""

    width: int
    kind: str  # "bigint" or "double"
    combine: Pairs

    @property
    def dtype(self):
        return np.int64 if self.kind == "bigint" else np.float64


def sums(width: int = 1, kind: str = "bigint") -> Monoid:
    return Monoid(width, kind, np.add)


def _rigid_pair(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    r1, t1, r2, t2 = first[:, :9].reshape(-1, 3, 3), first[:, 9:], then[:, :9].reshape(-1, 3, 3), then[:, 9:]
    r = r2 @ r1
    t = (r2 @ t1[:, :, None])[:, :, 0] + t2
    return np.concatenate([r.reshape(-1, 9), t], axis=1)


#: A rotation row by row and a translation; the left one is applied first.
RIGID = Monoid(12, "double", _rigid_pair)


def running(values: np.ndarray, starts: np.ndarray, combine: Pairs) -> np.ndarray:
    """Inclusive products in order, begun anew where `starts` is true; in about log2(n) steps over whole arrays."""
    out, open_ = values.copy(), ~starts
    reach = 1
    while reach < len(out) and open_[reach:].any():
        at = np.flatnonzero(open_[reach:]) + reach
        done, going = combine(out[at - reach], out[at]), open_[at - reach]
        out[at], open_[at] = done, going
        reach *= 2
    return out


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """Where a row's key is not that of the row before it; the first row counts as a change."""
    n = len(columns[0]) if columns else 0
    out = np.zeros(n, bool)
    for c in columns:
        a, b = c.slice(1), c.slice(0, n - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        nulls = c.is_null().to_numpy(zero_copy_only=False)
        out[1:] |= differ | (nulls[1:] != nulls[:-1])
    out[:1] = True
    return out


def _local(df: DataFrame, by: list[str], state: str, monoid: Monoid) -> DataFrame:
    """Products within each partition, with sl_part, sl_head (of the partition's first key), sl_first and sl_last (its end rows)."""
    names = df.columns
    keys, at_state, dtype = [names.index(c) for c in by], names.index(state), monoid.dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        carry, last_key, head, held = None, None, True, None

        def out(batch, last):
            columns, values, heads, first = batch
            n = len(heads)
            flags = np.zeros((2, n), bool)
            flags[0, 0], flags[1, -1] = first, last
            listed = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), monoid.width).cast(pa.list_(pa.from_numpy_dtype(dtype)))
            columns = [listed if i == at_state else c for i, c in enumerate(columns)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(n, part, np.int64)), pa.array(heads), pa.array(flags[0]), pa.array(flags[1])], [*names, "sl_part", "sl_head", "sl_first", "sl_last"])

        for b in batches:
            if not b.num_rows:
                continue
            values = np.asarray(b.column(at_state).flatten().to_numpy(zero_copy_only=False), dtype).reshape(b.num_rows, monoid.width)
            starts = _changes([b.column(i) for i in keys]) if keys else np.arange(b.num_rows) == 0
            key = [b.column(i)[0].as_py() for i in keys]
            if carry is not None and key == last_key:
                values = np.concatenate([carry, values])
                starts = np.concatenate([[True], [False], starts[1:]])
                done = running(values, starts, monoid.combine)[1:]
                starts = starts[1:]
            else:
                done = running(values, starts, monoid.combine)
                head = head and carry is None
            later = np.maximum.accumulate(np.concatenate([[False], starts[1:]]))
            heads = np.full(b.num_rows, head) & ~later
            head = bool(heads[-1])
            if held:
                yield out(held, False)
            held = (b.columns, done, heads, carry is None)
            carry, last_key = done[-1:], [b.column(i)[b.num_rows - 1].as_py() for i in keys]
        if held:
            yield out(held, True)

    fields = ", ".join(f"`{n}` {f'array<{monoid.kind}>' if n == state else f.dataType.simpleString()}" for n, f in zip(names, df.schema))
    return mapped(df, run, f"{fields}, sl_part long, sl_head boolean, sl_first boolean, sl_last boolean", 10_000)


def _sorted(df: DataFrame, order: Sequence[Column], partitions: int | None) -> DataFrame:
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order)


def _handed_over(local: DataFrame, by: list[str], state: str, monoid: Monoid) -> tuple[dict[int, list], np.ndarray | None]:
    """What each partition gets from those before it (by its number), and the product of the last key. One row a partition is collected."""
    ends = local.filter("sl_first OR sl_last").select("sl_part", "sl_head", "sl_first", "sl_last", state, *by).collect()
    first = {r["sl_part"]: [r[c] for c in by] for r in ends if r["sl_first"]}
    out, before, before_key = {}, None, None
    for r in sorted((r for r in ends if r["sl_last"]), key=lambda r: r["sl_part"]):
        own, key = np.array([r[state]], monoid.dtype), [r[c] for c in by]
        if before is not None and first[r["sl_part"]] == before_key:
            out[r["sl_part"]] = before[0].tolist()
            if r["sl_head"]:
                own = monoid.combine(before, own)
        before, before_key = own, key
    return out, before


def scanned(df: DataFrame, order: Sequence[Column | str], state: str, monoid: Monoid, by: Sequence[str] = (), partitions: int | None = None, outlive: bool = False) -> DataFrame:
    """df with `state` (an array of the monoid's width) replaced by the product of all rows up to it in `order`, in its key.

    `order` must begin with the columns of `by`. Rows that are equal in it come in any order, but in one only. The table
    behind the result lies in the shared folder (`outlive` as in `shared.materialize`).
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    by = list(by)
    local = materialize(_local(_sorted(df, order, partitions), by, state, monoid), "scan", outlive)
    carries, _ = _handed_over(local, by, state, monoid)
    if not carries:
        return local.select(*df.columns)
    names, dtype = local.columns, monoid.dtype
    at_state, at_part, at_head = (names.index(c) for c in (state, "sl_part", "sl_head"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.asarray(b.column(at_state).flatten().to_numpy(zero_copy_only=False), dtype).reshape(b.num_rows, monoid.width).copy()
            parts, heads = b.column(at_part).to_numpy(), b.column(at_head).to_numpy(zero_copy_only=False)
            for part in np.unique(parts[heads]).tolist():
                if part in carries:
                    at = np.flatnonzero(heads & (parts == part))
                    values[at] = monoid.combine(np.repeat(np.array([carries[part]], dtype), len(at), axis=0), values[at])
            listed = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), monoid.width).cast(pa.list_(pa.from_numpy_dtype(dtype)))
            yield pa.RecordBatch.from_arrays([listed if i == at_state else c for i, c in enumerate(b.columns)], names)

    return mapped(local, run, local.schema, 10_000).select(*df.columns)


def folded(df: DataFrame, order: Sequence[Column | str], state: str, monoid: Monoid, partitions: int | None = None) -> list | None:
    """The product of all rows in order, a single row of numbers; None without rows."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    local = _local(_sorted(df, order, partitions), [], state, monoid).filter("sl_last")
    _, last = _handed_over(materialize(local.withColumn("sl_first", F.lit(True)), "fold"), [], state, monoid)
    return None if last is None else last[0].tolist()


def numbered(df: DataFrame, order: Sequence[Column | str], by: Sequence[str] = (), out: str = "place", partitions: int | None = None, outlive: bool = False) -> DataFrame:
    """df with the place (from 0) of each row in order, in its key."""
    ones = df.withColumn(out, F.array(F.lit(1).cast("long")))
    return scanned(ones, order, out, sums(), by, partitions, outlive).withColumn(out, F.col(out)[0] - 1)


def running_sum(df: DataFrame, order: Sequence[Column | str], value: Column, by: Sequence[str] = (), out: str = "upto", partitions: int | None = None, outlive: bool = False) -> DataFrame:
    """df with the sum of the whole numbers `value` up to and with each row, in its key."""
    one = df.withColumn(out, F.array(F.coalesce(value.cast("long"), F.lit(0).cast("long"))))
    return scanned(one, order, out, sums(), by, partitions, outlive).withColumn(out, F.col(out)[0])
