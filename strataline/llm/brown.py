"""Operator 2: language-model scores from Brown class-based n-grams.

Words are bytes between ASCII white space with A-Z in lower case; each text ends in an end token. The model is

    P(w | h) = P(class(w) | classes of the two tokens before) * P(w | class(w))

Every training word that occurs at least `least` times gets its class by exchange: it moves to the class in which the
likelihood of the class bigrams it takes part in is largest, given all others. This goes in three steps, from the most
frequent words to the rarest:

* The `heads` most frequent words, and `affixes` groups of all others by a hash of their last three bytes, move one at a
  time; what that needs, the bigrams of these units over the whole training part, is at most (heads + affixes + 1)^2 numbers.
* The next most frequent words, `lookup` with the heads (so that the tables sent out are bounded), start in the class of
  their affix group and move by the classes seen before and after each, a sweep over half of them at a time.
* All others, a distributed table of any size, do so by the classes seen before them. Only words seen fewer than `least`
  times, and unseen ones, keep the class of their affix group. In the history of other words, rare words count by that group
  (class(w) of a word that is predicted and of one that precedes need not be the same function).

Transitions: class trigrams, bigrams and unigrams of the whole training part, interpolated by Witten-Bell. Emissions:
exact counts of every training word, discounted by d (from the counts of counts); what is taken from a class's words is
the probability of the class's unknown word. All sums over a history are 1, with one unknown word for each class.

Texts are cut into words twice: to count them, and to write them as codes (4 bytes a token; of words not looked up also a
64-bit hash, which tells them apart from there on). Bigrams, contexts, trigrams and scores are sums over these codes. For
scoring, words not looked up meet their counts and classes in a join, and only their sums return to the document.

Defined results: a null text is empty; an empty text is its end token; a null doc_id is scored and never trains;
repeated rows count and are scored each; with no training text every word is unknown and the classes are uniform; of other
columns than text, those whose names don't begin with lm_ are passed on.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm.common import documents, id_remainder, mapped, materialize, temporary

END = b"\n"  # no word holds white space
HEADS, AFFIXES, CLASSES, LOOKUP, LEAST = 2048, 512, 64, 1 << 17, 2
CHUNK = 64  # words whose contexts are one row
MERGE_AT = 500_000  # keys a task holds before it merges them
TAIL = 1 << 31  # set in the code of a word that is not looked up, over its unit


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "replace").lower().split(), END]


@dataclass
class Words:
    """The words looked up, most frequent first, the first `heads` of them units of their own; and the number of affix groups."""

    known: list[bytes]
    counts: np.ndarray
    heads: int
    affixes: int

    def affix(self, word: bytes) -> int:
        return self.heads + crc32(word[-3:]) % self.affixes

    @property
    def n_units(self) -> int:
        """With the boundary, the last one."""
        return self.heads + self.affixes + 1

    def units(self) -> np.ndarray:
        """The unit of each word looked up."""
        return np.array([k if k < self.heads else self.affix(w) for k, w in enumerate(self.known)], np.int64)


class Codes(dict):
    """word -> its place among those looked up, else TAIL and its unit."""

    def __init__(self, words: Words):
        super().__init__((w, k) for k, w in enumerate(words.known))
        self.words, self.room = words, len(words.known) + 100_000

    def __missing__(self, word: bytes) -> int:
        c = TAIL | self.words.affix(word)
        if len(self) < self.room:
            self[word] = c
        return c


# ---------------------------------------------------------------------------------------------- counts of the corpus


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), c: over all texts, end tokens included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

        for b in batches:
            for t in b.column(0).to_pylist():
                counts.update(tokens(t))
            if len(counts) > 150_000:
                yield out()
                counts.clear()
        if counts:
            yield out()

    return mapped(docs.select(F.col("text").cast("string").alias("text")), run, "word binary, c long", 250).groupBy("word").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, by_count: list[tuple[int, int]], bound: int) -> list[tuple[bytes, int]]:
    """The most frequent words, at most `bound` of them: those above the count at which the bound would be passed."""
    least, total = None, 0
    for c, n in sorted(by_count, reverse=True):
        if total + n > bound:
            break
        least, total = c, total + n
    if least is None:
        return []
    got = [(bytes(r.word), r.c) for r in counts.filter(F.col("c") >= least).collect()]
    return sorted(got, key=lambda x: (-x[1], x[0]))


def _binary(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Runs of an array as bytes."""
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32) * np.int32(flat.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])


def coded(docs: DataFrame, words: Words) -> DataFrame:
    """The columns of docs but text, lm_codes (a code for each token) and lm_tail (the hash of each that is not looked up)."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(words))
    keep = [f for f in docs.schema.fields if f.name != "text" and not f.name.lower().startswith("lm_")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(pickle.loads(sent.value))
        for b in batches:
            lists = [tokens(t) for t in b.column(len(keep)).to_pylist()]
            n, flat = np.array([len(x) for x in lists]), list(chain.from_iterable(lists))
            c = np.fromiter(map(codes.__getitem__, flat), np.uint32, len(flat))
            tail = np.flatnonzero(c >= TAIL)
            hashes = np.array([xxhash.xxh64_intdigest(flat[i], 42) for i in tail.tolist()], np.uint64)
            of = np.bincount(np.repeat(np.arange(len(lists)), n)[tail], minlength=len(lists))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], _binary(c, n), _binary(hashes, of)], [*(f.name for f in keep), "lm_codes", "lm_tail"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    return mapped(docs.select(*(F.col(f"`{f.name}`") for f in keep), F.col("text").cast("string")), run, f"{fields}lm_codes binary, lm_tail binary", 250)


class Batch:
    """Tokens of the texts of a batch of codes, one after the other."""

    def __init__(self, codes: pa.Array, tail: pa.Array):
        raw = codes.to_pylist()
        self.n = np.array([len(x) // 4 for x in raw], np.int64)
        self.codes = np.frombuffer(b"".join(raw), "<u4")
        self.first = np.cumsum(self.n) - self.n  # no text is without a token
        self.tail = np.flatnonzero(self.codes >= TAIL)
        self.hashes = np.frombuffer(b"".join(tail.to_pylist()), "<i8")

    def of(self, known: np.ndarray, units: np.ndarray) -> np.ndarray:
        """For each token a number of its word if that is looked up, else of its unit."""
        rare = self.codes >= TAIL
        place = np.where(rare, 0, self.codes).astype(np.int64)
        return np.where(rare, units[np.where(rare, self.codes & (TAIL - 1), 0)], known[place] if len(known) else 0)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[Batch]:
    for b in batches:
        yield Batch(b.column(0), b.column(1))


def _codes(coded_docs: DataFrame) -> DataFrame:
    return coded_docs.select("lm_codes", "lm_tail")


def dense_counts(codes: DataFrame, keys_of: Callable[[Batch], np.ndarray], chunks: int, width: int) -> DataFrame:
    """chunk, cells, n: how often keys_of gives each key chunk * width + cell; cells that have a count, and counts, packed.
    There are at most chunks * width, fixed by the model; a task sends what it has seen of a chunk as one row."""

    def rows(chunk: int, sums: np.ndarray) -> pa.RecordBatch:
        cells = np.flatnonzero(sums)
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([cells.astype("<u4").tobytes()], pa.binary()), pa.array([sums[cells].astype("<i8").tobytes()], pa.binary())], ["chunk", "cells", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(chunks * width, np.int32)
        for x in _batches(batches):
            np.add.at(sums, keys_of(x), 1)
        sums = sums.reshape(chunks, width)
        for chunk in np.flatnonzero(sums.any(1)).tolist():
            yield rows(chunk, sums[chunk])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros(width, np.int64)
        for b in batches:
            for chunk, cells, n in zip(*(v.to_pylist() for v in b.columns)):
                if now not in (None, chunk):
                    yield rows(now, sums)
                    sums[:] = 0
                now = chunk
                sums[np.frombuffer(cells, "<u4")] += np.frombuffer(n, "<i8")
        if now is not None:
            yield rows(now, sums)

    schema = "chunk long, cells binary, n binary"
    return mapped(mapped(_codes(codes), count, schema, 500).repartition("chunk").sortWithinPartitions("chunk"), add, schema, 200)


def unit_bigrams(codes: DataFrame, words: Words) -> np.ndarray:
    """[unit, unit after it]; before a text stands the boundary, the last unit."""
    n_units, sent = words.n_units, codes.sparkSession.sparkContext.broadcast(words.units())

    def keys_of(x: Batch) -> np.ndarray:
        u = x.of(sent.value, np.arange(n_units))
        before = np.concatenate([[n_units - 1], u[:-1]])
        before[x.first] = n_units - 1
        return before * n_units + u

    out = np.zeros((n_units, n_units))
    for r in materialize(dense_counts(codes, keys_of, n_units, n_units), "brown-bigrams").toLocalIterator():
        out[r.chunk, np.frombuffer(r.cells, "<u4")] = np.frombuffer(r.n, "<i8")
    return out


def contexts(codes: DataFrame, words: Words, classes: np.ndarray) -> DataFrame:
    """chunk, cells, n: of each CHUNK words looked up that are no heads, how often each class stood before (first) and after
    a word; cells are word in the chunk * width + class."""
    rest, heads, base = len(words.known) - words.heads, words.heads, int(classes[-1]) + 1
    sent = codes.sparkSession.sparkContext.broadcast((words.units(), classes))

    def keys_of(x: Batch) -> np.ndarray:
        known, cls = sent.value
        g = cls[x.of(known, np.arange(len(cls)))]
        before = np.concatenate([[base - 1], g[:-1]])
        before[x.first] = base - 1
        after = np.concatenate([g[1:], [base - 1]])
        after[x.first[1:] - 1] = base - 1
        at = np.flatnonzero((x.codes >= heads) & (x.codes < TAIL))
        row = (x.codes[at].astype(np.int64) - heads) * 2 * base
        return np.concatenate([row + before[at], row + base + after[at]])

    return dense_counts(codes, keys_of, -(-rest // CHUNK), CHUNK * 2 * base)


def tail_contexts(codes: DataFrame, words: Words, classes: np.ndarray, word_class: np.ndarray) -> DataFrame:
    """word (hash), key, n: of the words not looked up, how often each pair of classes stood before; key is that pair after the class of
    the word's group. Rows with a null word: class trigrams of the words looked up, as `trigram_keys` numbers them."""
    sent = codes.sparkSession.sparkContext.broadcast((classes, word_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, known = sent.value
        boundary = int(cls[-1])
        base = boundary + 1
        sums, held, size = np.zeros(base**3, np.int64), [], 0

        def out():
            w, k = (np.concatenate(v) for v in zip(*held))
            by = np.lexsort((k, w))
            w, k = w[by], k[by]
            cuts = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (k[1:] != k[:-1])]))
            return pa.RecordBatch.from_arrays([pa.array(w[cuts]), pa.array(k[cuts].astype(np.int32)), pa.array(np.diff(np.append(cuts, len(w))))], ["word", "key", "n"])

        for x in _batches(batches):
            c = x.of(known, cls)
            keys = trigram_keys(c, x.first, boundary)
            sums += np.bincount(keys[x.codes < TAIL], minlength=len(sums))
            if len(x.tail):
                held.append((x.hashes, c[x.tail] * base * base + keys[x.tail] // base))
                size += len(x.tail)
            if size > 4 * MERGE_AT:
                yield out()
                held, size = [], 0
        if held:
            yield out()
        keys = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.int64()), pa.array(keys.astype(np.int32)), pa.array(sums[keys])], ["word", "key", "n"])

    return mapped(_codes(codes), run, "word long, key int, n long", 500)


def trigram_keys(c: np.ndarray, first: np.ndarray, boundary: int) -> np.ndarray:
    """(class two before, class before, class) as one number in base boundary + 1; before a text stand boundaries."""
    base = boundary + 1
    one = np.concatenate([[boundary], c[:-1]])
    one[first] = boundary
    two = np.concatenate([[boundary], one[:-1]])
    two[first] = boundary
    return (two * base + one) * base + c


# ------------------------------------------------------------------------------------------------------- clustering


def exchange(counts: np.ndarray, n_classes: int, passes: int = 8) -> np.ndarray:
    """counts[u, v]: bigrams of units; the last unit is the boundary and stays alone. Returns the class of each unit.

    Maximises sum N(c,d) log N(c,d) - sum N(c) log N(c) for the left and right margins, moving one unit at a time.
    """
    n = len(counts) - 1
    f = lambda x: x * np.log(np.maximum(x, 1))
    weight = counts[:n].sum(1) + counts[:, :n].sum(0)
    order = np.argsort(-weight, kind="stable")
    cls = np.zeros(n + 1, np.int64)
    cls[order] = np.arange(n) % n_classes
    cls[n] = n_classes
    k = n_classes + 1
    one = np.zeros((n + 1, k))
    one[np.arange(n + 1), cls] = 1
    right, left = counts @ one, counts.T @ one  # [unit, class after it], [unit, class before it]
    table = one.T @ right
    for _ in range(passes):
        moved = 0
        for u in order:
            if not weight[u]:
                continue
            a, own = cls[u], counts[u, u]
            r, l = right[u].copy(), left[u].copy()
            r[a] -= own
            l[a] -= own
            # Without u.
            t = table.copy()
            t[a] -= r
            t[:, a] -= l
            t[a, a] -= own
            rows, cols = t.sum(1), t.sum(0)
            ft, size_r, size_l = f(t), r.sum() + own, l.sum() + own
            # Gain of adding u to each class b: cells (b, d) get r[d], cells (d, b) get l[d], and (b, b) gets both and own.
            gain = (f(t + r[None, :]) - ft).sum(1) + (f(t + l[:, None]) - ft).sum(0)
            d = np.diag(t)
            gain += f(d + r + l + own) - f(d + r) - f(d + l) + f(d)
            gain -= f(rows + size_r) - f(rows) + f(cols + size_l) - f(cols)
            b = int(gain[:n_classes].argmax())
            if gain[b] <= gain[a] + 1e-9:
                continue
            t[b] += r
            t[:, b] += l
            t[b, b] += own
            table, moved = t, moved + 1
            cls[u] = b
            right[:, a] -= counts[:, u]
            right[:, b] += counts[:, u]
            left[:, a] -= counts[u]
            left[:, b] += counts[u]
        if moved <= n // 200:
            break
    return cls


FEW = 16  # counts up to which differences are looked up


def differences(table: np.ndarray) -> np.ndarray:
    """[count, context, class]: what f(x) = x log x grows by if a cell of table grows by a small count."""
    f = lambda x: x * np.log(np.maximum(x, 1))
    return np.stack([f(table + k) - f(table) for k in range(FEW)])


def gains(table: np.ndarray, small: np.ndarray, sizes: np.ndarray, word: np.ndarray, context: np.ndarray, n: np.ndarray, now: np.ndarray, sides: int) -> np.ndarray:
    """[word, class]: the change of likelihood if a word, taken out of its class now, joins each class, all others as they are.

    table[context, class] (small: its `differences`) and sizes[class] hold the words where they are now; word (ascending), context and n are the cells of
    the words' own counts, whose contexts of each of the `sides` sum to the same.
    """
    f = lambda x: x * np.log(np.maximum(x, 1))
    out, total = np.zeros((len(now), table.shape[1])), np.bincount(word, n, minlength=len(now)) / sides
    for x in range(0, len(word), 1 << 16):
        w, c, k = word[x : x + (1 << 16)], context[x : x + (1 << 16)], n[x : x + (1 << 16)]
        step = small[np.minimum(k, FEW - 1), c]
        large = np.flatnonzero(k >= FEW)
        step[large] = f(table[c[large]] + k[large, None]) - f(table[c[large]])
        own = table[c, now[w]]
        step[np.arange(len(w)), now[w]] = f(own) - f(own - k)
        cuts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        out[w[cuts]] += np.add.reduceat(step, cuts)
    rows = np.arange(len(now))
    size = f(sizes[None, :] + total[:, None]) - f(sizes)[None, :]
    size[rows, now] = f(sizes[now]) - f(sizes[now] - total)
    return out - sides * size


def likelihood(table: np.ndarray) -> float:
    """Of the classes given their contexts, but for what does not depend on the classes; the contexts of each side in turn."""
    f = lambda x: x * np.log(np.maximum(x, 1))
    return float(f(table).sum() - sum(f(t.sum(0)).sum() for t in np.split(table, max(1, len(table) // (table.shape[1] + 1)))))


def sweep_known(chunks: DataFrame, words: Words, table: np.ndarray, word_class: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes of the words looked up, and the table, after every second word that is no head took its best class."""
    sent = chunks.sparkSession.sparkContext.broadcast((table, word_class[words.heads :]))
    kinds, width = table.shape[1], len(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, classes = sent.value
        small, sizes, change = differences(t), t[: len(t) // 2].sum(0), np.zeros_like(t)
        for b in batches:
            chunks = b.column(0).to_pylist()
            raw = [np.frombuffer(x, "<u4") for x in b.column(1).to_pylist()]
            cells = np.concatenate(raw).astype(np.int64)
            n = np.concatenate([np.frombuffer(x, "<i8") for x in b.column(2).to_pylist()])
            each = [classes[c * CHUNK : (c + 1) * CHUNK] for c in chunks]
            now, first = np.concatenate(each), np.cumsum([0, *map(len, each)])
            word, context = np.repeat(first[:-1], [len(x) for x in raw]) + cells // width, cells % width
            g = gains(t, small, sizes, word, context, n, now, 2)
            best, rows = g.argmax(1), np.arange(len(now))
            move = (rows % 2 == half) & (g[rows, best] > g[rows, now] + 1e-9)
            new = np.where(move, best, now)
            np.add.at(change, (context, new[word]), n)
            np.add.at(change, (context, now[word]), -n)
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array([new[x:y].astype("<i2").tobytes() for x, y in zip(first, first[1:])], pa.binary())], ["chunk", "v"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([change.astype("<f8").tobytes()], pa.binary())], ["chunk", "v"])

    out, new = word_class.copy(), table.copy()
    for r in mapped(chunks, run, "chunk long, v binary", 64).collect():  # two bytes a word looked up, and a table a task
        if r.chunk < 0:
            new += np.frombuffer(r.v, "<f8").reshape(-1, kinds)
        else:
            own = np.frombuffer(r.v, "<i2")
            out[words.heads + r.chunk * CHUNK : words.heads + r.chunk * CHUNK + len(own)] = own
    return out, new


def _by_word(rows: DataFrame, base: int) -> DataFrame:
    """word, class, c, keys, n of `tail_contexts`: a row for each word, its counts summed; the class is that of its group."""

    def summed(w: np.ndarray, k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        by = np.lexsort((k, w))
        w, k, n = w[by], k[by], n[by]
        cuts = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (k[1:] != k[:-1])]))
        return w[cuts], k[cuts], np.add.reduceat(n, cuts)

    def out(w: np.ndarray, k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        w, k, n = summed(w, k, n)
        cuts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        ends = pa.array(np.append(cuts, len(w)).astype(np.int32))
        lists = pa.ListArray.from_arrays(ends, pa.array((k % (base * base)).astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(n))
        return pa.RecordBatch.from_arrays([pa.array(w[cuts]), pa.array((k[cuts] // (base * base)).astype(np.int32)), pa.array(np.add.reduceat(n, cuts)), *lists], ["word", "class", "c", "keys", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 3  # the last word may go on in the next batch
        for b in batches:
            w, k, n = (np.concatenate([x, c.to_numpy().astype(np.int64)]) for x, c in zip(kept, b.columns))
            last = int(np.searchsorted(w, w[-1]))
            if last:
                yield out(w[:last], k[:last], n[:last])
            kept = list(summed(w[last:], k[last:], n[last:]))
        if len(kept[0]):
            yield out(*kept)

    return mapped(rows.repartition("word").sortWithinPartitions("word"), run, "word long, class int, c long, keys array<int>, n array<long>", 10_000)


def sweep_tail(tail: DataFrame, table: np.ndarray, base: int, half: int, least: int) -> DataFrame:
    """tail (word, class, c, keys, n) after every second word seen at least `least` times took its best class."""
    sent = tail.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        small, sizes = differences(t), t.sum(0)
        for b in batches:
            now, seen = b.column(1).to_numpy().astype(np.int64), b.column(2).to_numpy()
            size = np.array([len(k) for k in b.column(3)])
            word = np.repeat(np.arange(len(now)), size)
            context = b.column(3).flatten().to_numpy().astype(np.int64) % base
            g = gains(t, small, sizes, word, context, b.column(4).flatten().to_numpy(), now, 1)
            best, rows = g.argmax(1), np.arange(len(now))
            move = (b.column(0).to_numpy() % 2 == half) & (seen >= least) & (g[rows, best] > g[rows, now] + 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.where(move, best, now).astype(np.int32)), *b.columns[2:]], b.schema.names)

    return mapped(tail, run, tail.schema, 4096)


def tail_trigrams(tail: DataFrame, base: int) -> np.ndarray:
    """[two before, one before, class]: counts of the words of tail in their classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(base**3, np.int64)
        for b in batches:
            size = np.array([len(k) for k in b.column(3)])
            keys = b.column(3).flatten().to_numpy().astype(np.int64) * base + np.repeat(b.column(1).to_numpy(), size)
            np.add.at(sums, keys, b.column(4).flatten().to_numpy())
        keys = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums[keys])], ["key", "c"])

    return _dense(mapped(tail, run, "key long, c long", 4096).groupBy("key").agg(F.sum("c").alias("c")), base**3).reshape(base, base, base)


# ------------------------------------------------------------------------------------------------------------ model


@dataclass
class Model:
    words: Words
    classes: np.ndarray  # of each unit; the boundary last
    word_class: np.ndarray  # of each word looked up
    steps: np.ndarray  # log10 P(class | two before), flat in base n_classes + 1
    discount: float
    log_class: np.ndarray  # log10 of the tokens in a class
    log_unknown: np.ndarray  # log10 of what the discount took from a class (at least a half)
    total: int
    distinct: int


def transitions(cells: np.ndarray) -> np.ndarray:
    """cells[two, one, c] counts -> log10 of interpolated probabilities, flat; c ranges over all but the boundary."""
    n = len(cells) - 1
    own = cells[:, :, :n].astype(float)
    uni = own.sum((0, 1))

    def mixed(c: np.ndarray, lower: np.ndarray) -> np.ndarray:
        kinds = np.maximum((c > 0).sum(-1, keepdims=True), 1)
        return (c + kinds * lower) / (c.sum(-1, keepdims=True) + kinds)

    p2 = mixed(own.sum(0), (uni + 0.5) / (uni.sum() + 0.5 * n))
    out = np.zeros(cells.shape)
    out[:, :, :n] = np.log10(mixed(own, p2[None]))
    return out.reshape(-1)


def vocabulary(docs: DataFrame, heads: int = HEADS, affixes: int = AFFIXES, lookup: int = LOOKUP) -> tuple[Words, dict[int, int]]:
    """The words to look up, and how many words there are of each count."""
    counts = materialize(word_counts(docs), "brown-words")
    by_count = {r.c: r.n for r in counts.groupBy("c").agg(F.count("*").alias("n")).collect()}  # as many rows as there are different counts
    often = frequent(counts, list(by_count.items()), lookup)
    return Words([w for w, _ in often], np.array([c for _, c in often], np.int64), min(heads, len(often)), affixes), by_count


def fit(codes: DataFrame, words: Words, by_count: dict[int, int], n_classes: int = CLASSES, least: int = LEAST, sweeps: int = 4) -> tuple[Model, DataFrame]:
    """codes: `coded` texts to learn from. The model, and the words that are not looked up: word (hash), class, c."""
    base = n_classes + 1
    cells = unit_bigrams(codes, words)
    classes = exchange(cells, n_classes)
    one = np.eye(base)[classes]
    bigrams = one.T @ cells @ one  # [class, class after it], the boundary last
    del cells
    # Contexts before and after, by class; a text's end has none after it but the boundary.
    ends = bigrams.sum(0) - bigrams.sum(1)
    after = np.vstack([bigrams.T[:n_classes], np.maximum(ends, 0)[None]])
    table = np.vstack([bigrams[:, :n_classes], after[:, :n_classes]])
    word_class = classes[words.units()] if words.known else np.zeros(0, np.int64)
    if len(words.known) > words.heads:
        chunks = materialize(contexts(codes, words, classes), "brown-contexts")
        for k in range(sweeps):
            better, new = sweep_known(chunks, words, table, word_class, k % 2)
            if likelihood(new) <= likelihood(table):
                break
            word_class, table = better, new

    made = materialize(tail_contexts(codes, words, classes, word_class), "brown-tail-contexts")
    known = _dense(made.filter("word IS NULL").groupBy(F.col("key").cast("long").alias("key")).agg(F.sum("n").alias("c")), base**3).reshape(base, base, base)
    tail = materialize(_by_word(made.filter("word IS NOT NULL"), base), "brown-tail")
    three = known + tail_trigrams(tail, base)
    for k in range(2):
        moved = materialize(sweep_tail(tail, three.sum(0)[:, :n_classes], base, k % 2, least), "brown-tail")
        new = known + tail_trigrams(moved, base)
        if likelihood(new.sum(0)[:, :n_classes]) > likelihood(three.sum(0)[:, :n_classes]):
            tail, three = moved, new

    n1, n2 = by_count.get(1, 0), by_count.get(2, 0)
    discount = n1 / (n1 + 2 * n2) if n1 else 0.5
    tokens_of, kinds_of = np.bincount(word_class, words.counts, minlength=n_classes).astype(float), np.bincount(word_class, minlength=n_classes).astype(float)
    for r in tail.groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        tokens_of[r["class"]] += r.n
        kinds_of[r["class"]] += r.v
    log_class = np.log10(np.maximum(tokens_of + (kinds_of == 0), 1))
    # Unknown words of a class: what the discount took; of a class without words, all.
    log_unknown = np.log10(np.where(kinds_of > 0, discount * kinds_of, 1.0))
    total, distinct = sum(c * n for c, n in by_count.items()), sum(by_count.values())
    return Model(words, classes, word_class, transitions(three), discount, log_class, log_unknown, total, distinct), tail.select("word", "class", "c")


def _dense(sums: DataFrame, n: int) -> np.ndarray:
    """key, c as an array of n, a few bytes a row to the driver; n is fixed by the model's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_numpy().astype("<i4").tobytes()]), pa.array([b.column(1).to_numpy().astype("<i8").tobytes()])], ["k", "c"])

    out = np.zeros(n)
    for r in materialize(mapped(sums, run, "k binary, c binary", 100_000), "brown-sums").toLocalIterator():
        out[np.frombuffer(r.k, "<i4")] += np.frombuffer(r.c, "<i8")  # each key comes once
    return out


def train(docs: DataFrame, heads: int = HEADS, affixes: int = AFFIXES, n_classes: int = CLASSES, lookup: int = LOOKUP, least: int = LEAST) -> tuple[Model, DataFrame]:
    """The model of docs (text), and the table of the words that it does not look up."""
    words, by_count = vocabulary(docs, heads, affixes, lookup)
    return fit(materialize(coded(docs.select("text"), words), "brown-codes"), words, by_count, n_classes, least)


def score(codes: DataFrame, model: Model, tail: DataFrame) -> DataFrame:
    """codes: `coded` texts. Their other columns, and n_tokens, n_known, base_score, score, known_score (the part of the known tokens)."""
    spark = codes.sparkSession
    base = int(model.classes[-1]) + 1
    #: log10 P(class | two before) / (tokens in the class): what an emission is multiplied by.
    table = (model.steps.reshape(-1, base) - np.append(model.log_class, 0.0)[None, :]).reshape(-1)
    sent = spark.sparkContext.broadcast((model, table))
    names = [c for c in codes.columns if c not in ("lm_codes", "lm_tail")]
    keep = [f for f in codes.schema.fields if f.name in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m, by_class = sent.value
        row = TaskContext.get().partitionId() << 40
        logs_of, emit_of = np.log10(m.words.counts + 1.0), np.log10(np.maximum(m.words.counts - m.discount, 1e-9))
        for b in batches:
            x = Batch(b.column(len(names)), b.column(len(names) + 1))
            c = x.of(m.word_class, m.classes)
            keys = trigram_keys(c, x.first, base - 1)
            steps = by_class[keys]
            seen = x.codes < TAIL
            of = lambda v: np.where(seen, v[np.where(seen, x.codes, 0)], 0.0) if len(v) else np.zeros(len(seen))
            add = lambda v: np.add.reduceat(v, x.first)
            ids = row + np.arange(len(x.n))
            row += len(x.n)
            own, rare = np.repeat(np.arange(len(x.n)), x.n)[x.tail], len(x.tail)
            nones = [pa.nulls(rare, b.schema.field(i).type) for i in range(len(names))]
            fill = lambda v, kind: pa.concat_arrays([pa.array(v, kind), pa.nulls(rare, kind)])
            last = lambda v, kind: pa.concat_arrays([pa.nulls(len(x.n), kind), pa.array(v, kind)])
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.concat_arrays([b.column(i), nones[i]]) for i in range(len(names))),
                    pa.array(np.concatenate([ids, ids[own]]), pa.int64()),
                    fill(x.n, pa.int64()), fill(add(seen.astype(np.int64)), pa.int64()), fill(add(of(logs_of)), pa.float64()), fill(add(np.where(seen, steps + of(emit_of), 0.0)), pa.float64()),
                    last(x.hashes, pa.int64()), last((keys[x.tail] // base).astype(np.int32), pa.int32()), last((steps[x.tail] + m.log_unknown[c[x.tail]]).astype(np.float32), pa.float32()),
                ],
                [*names, "lm_row", "n_tokens", "lm_known", "lm_base", "lm_score", "lm_word", "lm_history", "lm_unknown"],
            )

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    made = mapped(codes.select(*(F.col(f"`{c}`") for c in names), "lm_codes", "lm_tail"), run, f"{fields}lm_row long, n_tokens long, lm_known long, lm_base double, lm_score double, lm_word long, lm_history int, lm_unknown float", 250)
    made = materialize(made, "brown-scored")
    rare = made.filter("lm_word IS NOT NULL").select("lm_row", F.col("lm_word").alias("word"), "lm_history", "lm_unknown").join(tail, "word", "left")
    key = (F.col("lm_history") * base + F.col("class")).alias("key")
    rare = rare.select("lm_row", "c", "lm_unknown", key).join(F.broadcast(_steps(spark, table)), "key", "left")
    known = F.col("c").isNotNull()
    emitted = F.when(known, F.col("step") + F.log10(F.col("c") - model.discount))
    rare = rare.groupBy("lm_row").agg(
        F.sum(known.cast("long")).alias("more_known"),
        F.sum(F.when(known, F.log10(F.col("c") + 1.0)).otherwise(0.0)).alias("more_base"),
        F.sum(F.coalesce(emitted, F.lit(0.0))).alias("more_known_score"),
        F.sum(F.coalesce(emitted, F.col("lm_unknown").cast("double"))).alias("more_score"),
    )
    out = made.filter("lm_word IS NULL").join(rare, "lm_row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return out.select(
        *(F.col(f"`{c}`") for c in names),
        "n_tokens",
        plus("lm_known", "more_known").cast("long").alias("n_known"),
        (plus("lm_base", "more_base") - F.col("n_tokens") * float(np.log10(model.total + model.distinct + 1.0))).alias("base_score"),
        plus("lm_score", "more_score").alias("score"),
        plus("lm_score", "more_known_score").alias("known_score"),
    )


def _steps(spark: SparkSession, table: np.ndarray) -> DataFrame:
    """key, step: the table of a model as rows, of a size that the number of classes fixes."""
    raw = bytearray(table.astype("<f8").tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.frombuffer(sent.value, "<f8")[at])], ["key", "step"])

    sent = spark.sparkContext.broadcast(bytes(raw))
    return mapped(spark.range(0, len(table), 1, 1), run, "key int, step double", 100_000)


def scored(docs: DataFrame, trains: Column, **options: int) -> tuple[DataFrame, Model]:
    """docs scored by a model of those rows of them for which `trains` holds."""
    fitting = {k: options.pop(k) for k in ("n_classes", "least", "sweeps") if k in options}
    with temporary(docs.sparkSession):
        words, by_count = vocabulary(docs.filter(trains), **options)
        codes = materialize(coded(docs, words), "brown-codes")
        model, tail = fit(codes.filter(trains), words, by_count, **fitting)
        return materialize(score(codes, model, tail), "brown-out", outlive=True), model


def op2_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = id_remainder(F.col("doc_id"), 7)
    out, model = scored(documents(spark, sf_dir).select("doc_id", "text"), (held != 2) & (held >= 0))
    return out.select("doc_id", (held == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score", "known_score")
