"""Language-model scoring with Brown class-based bigrams.

Every word of the corpus has a class. P(word | previous word) is
P(class | previous class) * P(word | class), smoothed; exchange clustering
chooses the classes: each word moves to the class that raises the likelihood
of the class bigrams most. The end of a text is a word with a class to itself.

Every training word takes part in the exchange. It starts from a bounded
problem: the ``OWN`` most frequent words and ``TAIL`` groups of all others (by
their last three bytes) are exchanged one after the other, a few seconds of
numpy on a bounded matrix. Then ``ROUNDS`` rounds go over the whole vocabulary
in Spark. A round counts, for each word of one half of the vocabulary (halves
alternate, so that words which depend on each other seldom move together), the
classes before and after it in all training texts; class bigrams, the only
thing that must be known everywhere, are a CLASSES x CLASSES table; each word
then moves to its best class, in Arrow tasks. The round with the highest
likelihood is kept. A word that training has not seen has its ending's class.

Classes and counts of the (at most) ``CACHE`` most frequent words are looked up
in the tasks. Every other word is a row with its class and its neighbours in the
cache, so that a task that reads the row knows both classes of these bigrams. Only
bigrams of two such words are met by a shuffle join, in which no key is hot, as
frequent words have left. The cache changes no result, only the way.

The score of a text is the sum over its tokens of

    log10( (c + 1) * ( L * P(C | C') / (N_C + V_C + 1) + (1 - L) / (N + V + 1) ) )

with c the word's count, C its class, C' the previous one (the end class
before the first word), N_C and V_C tokens and distinct words of class C in
training: the class model, mixed with the unigram base. Both parts use the
same c + 1, so the logarithm splits into a part that needs the counts and a
part that needs only classes.

Style: Arrow batches with vectorised word hashes, DataFrame aggregation and
joins between them.

Edge cases: a null or empty text is the end token alone; a corpus without
training rows scores every token by 1 / 1; words are 64-bit hashes (a clash of
two words adds their counts); a null doc_id trains (it is not held out);
repeated rows are counted and scored as often as they occur; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store
from .wordhash import Slice, mix, scan

OWN = 1024         # words that start the exchange as units of their own
TAIL = 512         # groups of the other words by their ending, at the start
CACHE = 1 << 20    # most words whose count and class every task looks up (17 bytes each)
CLASSES = 64
SWEEPS = 12        # of the starting exchange
ROUNDS = 4         # over the whole vocabulary, half of it each
LAMBDA = 0.95      # weight of the class model
ALPHA = 0.5        # added to class bigram counts
END = OWN + TAIL   # unit of the end of a text
SELF = 2 * CLASSES     # context codes: class before, CLASSES + class after, the word itself after
CLASS = 255        # as a context code: the word's own class, instead of a count
ENTRY = np.dtype([("code", "u1"), ("n", "<u4")])     # a context and its count, as rows carry them
UNIT = np.dtype([("code", "<u2"), ("n", "<u4")])     # likewise a unit
_MOST = (1 << 32) - 1
FLUSH = 1 << 22    # contexts that a task gathers before it hands on their counts


@dataclass
class Model:
    """words: sorted hashes of the cached words, with their counts and classes;
    rare: table (w, c, cls) of the others; unit_class: class by starting unit, for
    words not seen; log_part[C', C]; end_count, tokens (N), types (V);
    likelihoods: of the class bigrams, at the start and after each round."""

    words: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    rare: DataFrame
    unit_class: np.ndarray
    log_part: np.ndarray
    end_count: int
    tokens: int
    types: int
    likelihoods: list[float]


def _endings(s: Slice) -> np.ndarray:
    """Tail unit of every word: a hash of its last three bytes."""
    length = s.ends - s.starts
    code = length.clip(0, 3).astype(np.uint64)
    for back in (1, 2, 3):
        b = s.data[(s.ends - back).clip(0)].astype(np.uint64)
        code = code * np.uint64(257) + np.where(length >= back, b + np.uint64(1), np.uint64(0))
    return (mix(code) % np.uint64(TAIL)).astype(np.int64) + OWN


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, unit, c): count of every word (by hash) with its tail unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, units = [], []
            for s in scan(batch.column(0), lower=True):
                hashes.append(s.hashes)
                units.append(_endings(s))
            if hashes:
                h, n = np.unique(np.concatenate(hashes), return_counts=True)
                places, unit = Places(h), np.zeros(len(h), np.int32)
                for some, of in zip(hashes, units):
                    unit[places.find(some)[0]] = of
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(unit),
                     pa.array(n.astype(np.int64))], names=["h", "unit", "c"])

    return (texts.select("text").mapInArrow(run, "h bigint, unit int, c bigint")
            .groupBy("h").agg(F.first("unit").alias("unit"), F.sum("c").alias("c")))


def keyed(texts: DataFrame, words: np.ndarray, own: np.ndarray, own_unit: np.ndarray) -> DataFrame:
    """Texts as (keys, rare, units), each closed by the end: the places of its words in
    the sorted ``words`` (the end: behind the last), -1 for others, whose keys and
    starting units follow in the order of the text."""
    end = len(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, owns = Places(words), Places(own)
        for batch in batches:
            for s in scan(batch.column(0), lower=True):
                at, known = places.find(s.hashes)
                keys = np.full(len(at) + s.rows, end, np.int32)
                keys[np.arange(len(at)) + s.row] = np.where(known, at, -1)
                raw, open_ = keys.tobytes(), np.flatnonzero(~known)
                ends = np.r_[0, np.cumsum(s.counts + 1)] * 4
                offsets = pa.array(np.searchsorted(open_, s.bounds()).astype(np.int32))
                units, (place, is_own) = _endings(s)[open_], owns.find(s.hashes[open_])
                units[is_own] = own_unit[place[is_own]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([raw[i:j] for i, j in zip(ends[:-1], ends[1:])], pa.binary()),
                     pa.ListArray.from_arrays(offsets, pa.array(_rare_key(s.hashes[open_]))),
                     pa.ListArray.from_arrays(offsets, pa.array(units.astype(np.int16)))],
                    names=["keys", "rare", "units"])

    return texts.select("text").mapInArrow(run, "keys binary, rare array<bigint>, units array<smallint>")


def unit_bigrams(texts: DataFrame, units: np.ndarray) -> DataFrame:
    """(pair, n): pair = left unit * (END + 1) + right unit, over all texts (as keys).
    ``units``: of cached words and the end, by place. Sums of a task are bounded by the
    matrix; a left unit's row of it is summed over the tasks in one place."""
    size = END + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int32)
        for batch in batches:
            w = _keys(batch.column(0))
            u = units[w]
            u[w < 0] = batch.column(1).flatten().to_numpy()
            for i in range(0, len(u), 1 << 20):
                right = u[i:i + (1 << 20)].astype(np.int32)
                left = np.r_[np.int32(u[i - 1] if i else END), right[:-1]]
                at, n = np.unique(left * np.int32(size) + right, return_counts=True)
                total[at] += n.astype(np.int32)
        at = np.flatnonzero(total)
        yield _packed(at // size, at % size, total[at], UNIT)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):      # a row is at most a row of the matrix
                left, entry = _unpacked(batch.slice(i, 256), UNIT)
                np.add.at(total, left * size + entry["code"], entry["n"].astype(np.int64))
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 20):
            part = at[i:i + (1 << 20)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["pair", "n"])

    return (texts.select("keys", "units").mapInArrow(run, "w bigint, entries binary")
            .repartition("w").mapInArrow(add, "pair bigint, n bigint"))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = SWEEPS) -> np.ndarray:
    """Class of each unit, by exchange clustering of a unit bigram matrix. The
    last unit (the end of a text) keeps the last class to itself."""
    units = len(bigrams)
    count = bigrams.sum(1) + bigrams.sum(0)
    cls = np.empty(units, np.int64)
    order = np.argsort(-count[:-1], kind="stable")
    cls[order] = np.arange(units - 1) % (classes - 1)
    cls[-1] = classes - 1

    def xlogx(v: np.ndarray) -> np.ndarray:
        return v * np.log(np.maximum(v, 1))

    one = np.eye(classes, dtype=np.int64)[cls]
    right = bigrams @ one                    # unit -> next class
    left = bigrams.T @ one                   # unit -> previous class
    table = one.T @ right
    own = np.diag(bigrams)
    others = np.arange(classes - 1)
    for _ in range(rounds):
        moved = 0
        for u in order:
            if not count[u]:
                continue
            a = cls[u]
            r, l, d = right[u], left[u], own[u]
            # take u out of class a
            table[a] -= r
            table[:, a] -= l
            table[a, a] += d
            r0, l0 = r.copy(), l.copy()
            r0[a] -= d
            l0[a] -= d                       # bigrams with other units only
            rows, cols = table.sum(1) + l0, table.sum(0) + r0      # wherever u goes
            # likelihood gained by putting u into class b: cells (b, *), (*, b), and the class totals
            gain = (xlogx(table[:-1] + r0) - xlogx(table[:-1])).sum(1) + (
                xlogx(table[:, :-1] + l0[:, None]) - xlogx(table[:, :-1])).sum(0)
            both = table[others, others]     # cell (b, b) got r0, l0 and d at once
            gain += (xlogx(both + r0[:-1] + l0[:-1] + d) - xlogx(both + r0[:-1]) - xlogx(both + l0[:-1]) + xlogx(both))
            nr, nl = r.sum(), l.sum()
            gain -= xlogx(rows[:-1] + nr) - xlogx(rows[:-1]) + xlogx(cols[:-1] + nl) - xlogx(cols[:-1])
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += r0
            table[:, b] += l0
            table[b, b] += d
            if b != a:
                moved += 1
                cls[u] = b
                before, after = bigrams[:, u], bigrams[u]
                right[:, a] -= before        # units before u now precede class b
                right[:, b] += before
                left[:, a] -= after
                left[:, b] += after
        if moved <= 0.002 * units:
            break
    return cls


class Places:
    """Places of hashes in the sorted ``words``, by an index of their leading bits."""

    def __init__(self, words: np.ndarray) -> None:
        bits = max(1, len(words).bit_length())
        self.words, self.shift = words, np.uint64(64 - bits)
        self.index = np.searchsorted(words, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, is it there) of each hash."""
        words = self.words
        if not len(words):
            return np.zeros(len(hashes), np.int32), np.zeros(len(hashes), bool)
        last = len(words) - 1
        at = self.index[(hashes >> self.shift).view(np.int64)].clip(0, last)
        open_ = np.flatnonzero(words[at] < hashes)
        while len(open_):                  # a few words share their leading bits
            at[open_] += 1
            open_ = open_[at[open_] <= last]
            open_ = open_[words[at[open_]] < hashes[open_]]
        at = at.clip(0, last)
        return at, words[at] == hashes


def _rare_key(hashes: np.ndarray) -> np.ndarray:
    """Keys of words outside the cache: negative; cached words go by their place."""
    return (hashes | np.uint64(1 << 63)).view(np.int64)


def _offsets(column: pa.Array) -> np.ndarray:
    """Where the values of a binary column start, and the last one's end."""
    return np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)


def _keys(texts: pa.Array) -> np.ndarray:
    """The keys of all texts of a batch, one after the other."""
    at, data = _offsets(texts), texts.buffers()[2]
    return np.frombuffer(data, np.int32, (at[-1] - at[0]) // 4, at[0]) if data is not None else np.zeros(0, np.int32)


def _packed(w: np.ndarray, code: np.ndarray, n: np.ndarray, kind: np.dtype = ENTRY) -> pa.RecordBatch:
    """Contexts, sorted by word, as rows (w, entries)."""
    entries = np.empty(len(w), kind)
    entries["code"], entries["n"] = code, n
    first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else np.zeros(0, np.int64)
    offsets = (np.r_[first, len(w)] * kind.itemsize).astype(np.int32)
    column = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(entries.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(w[first]), column], names=["w", "entries"])


def _unpacked(batch: pa.RecordBatch, kind: np.dtype = ENTRY) -> tuple[np.ndarray, np.ndarray]:
    """(word, entry) of the rows of a batch."""
    at, data = _offsets(batch.column(1)), batch.column(1).buffers()[2]
    size = kind.itemsize
    return (np.repeat(batch.column(0).to_numpy(), np.diff(at) // size),
            np.frombuffer(data, kind, (at[-1] - at[0]) // size, at[0]))


def _xlogx(v: np.ndarray) -> np.ndarray:
    return v * np.log(np.maximum(v, 1))


def likelihood(table: np.ndarray) -> float:
    """Log-likelihood of class bigrams, but for the words' own counts."""
    t = table.astype(float)
    return float(_xlogx(t).sum() - _xlogx(t.sum(1)).sum() - _xlogx(t.sum(0)).sum())


def best_classes(table: np.ndarray, own: np.ndarray, word: np.ndarray, code: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The class to which each word should go, given the class bigrams and where
    all others are. ``own``: the words' classes; (word, code, n): their contexts."""
    size, k = len(own), len(table)
    table = table.astype(float)
    i = np.arange(size)
    both = np.bincount(word * (2 * k + 1) + code, n, size * (2 * k + 1)).reshape(size, 2 * k + 1)
    left, right, self_ = both[:, :k], both[:, k:2 * k], both[:, 2 * k]
    n_left, n_right = left.sum(1), right.sum(1)
    # class bigrams without the word: its own row, column and their crossing
    crossing = table[own, own] - left[i, own] - right[i, own] + self_
    left0, right0 = left.copy(), right.copy()          # contexts in other words only
    left0[i, own] -= self_
    right0[i, own] -= self_
    gain = np.zeros((size, k))
    for new, cells, mine, across in ((right0, table, right, left), (left0, table.T, left, right)):
        w, j = np.nonzero(new)                         # the cells (b, j) for every class b
        n_new, at_own = new[w, j], j == own[w]
        # classes other than the word's own gain by (j, count) alone
        kinds, kind = np.unique(n_new.astype(np.int64) * k + j, return_inverse=True)
        base = cells[:, kinds % k].T
        grown = (_xlogx(base + (kinds // k)[:, None]) - _xlogx(base))[kind]
        base = cells[:, j[at_own]].T - across[w[at_own]]
        grown[at_own] = _xlogx(base + n_new[at_own][:, None]) - _xlogx(base)
        e = np.arange(len(w))
        base = np.where(at_own, crossing[w], cells[own[w], j] - mine[w, j])
        grown[e, own[w]] = _xlogx(base + n_new) - _xlogx(base)
        grown[e, j] = 0.0                              # the cell (b, b) comes below
        if len(w):
            first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            gain[w[first]] += np.add.reduceat(grown, first, axis=0)
    cell, new = np.diag(table), left0 + right0 + self_[:, None]
    w, j = np.nonzero(new)
    grown = np.zeros((size, k))
    grown[w, j] = _xlogx(cell[j] + new[w, j]) - _xlogx(cell[j])
    grown[i, own] = _xlogx(crossing + new[i, own]) - _xlogx(crossing)
    gain += grown
    for total, mine in ((table.sum(1), n_right), (table.sum(0), n_left)):
        kinds, kind = np.unique(mine, return_inverse=True)
        grown = (_xlogx(total + kinds[:, None]) - _xlogx(total))[kind]
        rest = total[own] - mine
        grown[i, own] = _xlogx(rest + mine) - _xlogx(rest)
        gain -= grown
    gain = gain[:, :k - 1]                             # the last class is the end's
    best = gain.argmax(1)
    return np.where(gain[i, best] > gain[i, own] + 1e-9, best, own)


def _by_bytes(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches of rare words, cut where their neighbours exceed ``FLUSH`` bytes."""
    for batch in batches:
        ends = _offsets(batch.column(column))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, int(ends[a]) + FLUSH, side="right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def _neighbours(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, is it after) of the cached neighbours of a batch of rare words."""
    near = _keys(batch.column(column))
    return (np.repeat(np.arange(batch.num_rows), np.diff(_offsets(batch.column(column))) // 4),
            near >> 1, (near & 1).astype(bool))


def _counted(keys: Iterator[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows (w, entries) of contexts given as w * 256 + code, counted in the task."""
    held, size = [], 0

    def rows() -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        return _packed(key >> 8, key & 255, n)

    for some in keys:
        held += some
        size += sum(len(x) for x in some)
        if size >= FLUSH:
            yield rows()
            held, size = [], 0
    if size:
        yield rows()


def rare_words(texts: DataFrame, counts: DataFrame, end: int, own: np.ndarray, own_unit: np.ndarray,
               unit_class: np.ndarray) -> DataFrame:
    """(w, c, cls, mixed, near) of the words (h, unit, c) outside the cache. near: their
    cached neighbours in all texts, as place * 2 + (1 if it comes after); as rare
    words are rare, they are few. mixed: some neighbour is rare as well."""
    told, met = -2, -1            # in place of a neighbour: the word's row, a rare neighbour

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = _keys(batch.column(0)).astype(np.int64)
            w[w < 0] = batch.column(1).flatten().to_numpy()
            before = np.r_[end, w[:-1]][:len(w)]
            here, there = w < 0, before < 0
            one, other, both = here & ~there, there & ~here, here & there
            word = np.concatenate([w[one], before[other], w[both], before[both]])
            at = np.concatenate([before[one] * 2, w[other] * 2 + 1, np.full(2 * int(both.sum()), met)])
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(at.astype(np.int32)), pa.nulls(len(at), pa.int64())],
                                             names=["w", "at", "n"])

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns = Places(own)
        for batch in batches:
            w, unit, c = (batch.column(i).to_numpy() for i in range(3))
            at, is_own = owns.find(w.view(np.uint64))
            unit = np.where(is_own, own_unit[at] if len(own) else 0, unit)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_rare_key(w.view(np.uint64))), pa.array(np.full(len(w), told, np.int32)),
                 pa.array(c * 256 + unit_class[unit])], names=["w", "at", "n"])

    def rows(w: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else np.zeros(0, np.int64)
        size, of = len(first), np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(w)]))
        row, some = at == told, at >= 0
        cls = np.zeros(size, np.int32)
        cls[of[row]] = n[row] & 255
        c = np.bincount(of[row], n[row] >> 8, size).astype(np.int64)
        mixed = np.bincount(of[at == met], minlength=size) > 0
        offsets = np.r_[0, np.cumsum(np.bincount(of[some], minlength=size))].astype(np.int32) * 4
        near = pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(at[some].tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(w[first]), pa.array(c), pa.array(cls), pa.array(mixed), near],
                                          names=["w", "c", "cls", "mixed", "near"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)]    # of the word that may go on
        for batch in batches:
            if batch.num_rows:
                now = [np.concatenate([a, batch.column(i).fill_null(0).to_numpy()]) for i, a in enumerate(rest)]
                cut = int(np.searchsorted(now[0], now[0][-1]))
                yield rows(*(a[:cut] for a in now))
                rest = [a[cut:] for a in now]
        yield rows(*rest)

    kind = "w bigint, at int, n bigint"
    return (texts.select("keys", "rare").mapInArrow(seen, kind).unionByName(counts.mapInArrow(known, kind))
            .repartition("w").sortWithinPartitions("w")
            .mapInArrow(gather, "w bigint, c bigint, cls int, mixed boolean, near binary"))


class Exchange:
    """Training texts as word keys, and the classes of the moment: ``classes`` by
    place for cached words (and the end, last); rare words as rows (w, c, cls, near),
    ``alone`` if all their neighbours are cached, else ``mixed``."""

    def __init__(self, texts: DataFrame, words: np.ndarray, classes: np.ndarray, rare: DataFrame) -> None:
        self.texts, self.words, self.classes = texts, words, classes
        self.alone, self.mixed = (rare.where(c).drop("mixed") for c in ("not mixed", "mixed"))
        end = len(words)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                w = _keys(batch.column(0)).astype(np.int64)
                w[w < 0] = batch.column(1).flatten().to_numpy()
                before = np.r_[end, w[:-1]][:len(w)]
                some = (w < 0) & (before < 0)
                yield pa.RecordBatch.from_arrays([pa.array(before[some]), pa.array(w[some])], names=["l", "r"])

        self.pairs = store(texts.select("keys", "rare").mapInArrow(run, "l bigint, r bigint"), "brown-pairs")

    def rare(self) -> DataFrame:
        return self.alone.unionByName(self.mixed)

    def classed_pairs(self) -> DataFrame:
        """(l, r, cl, cr): the bigrams of two rare words and their classes."""
        pairs = self.pairs
        for c in "lr":
            side = self.mixed.select(F.col("w").alias(c), F.col("cls").alias("c" + c))
            pairs = pairs.join(side.hint("merge"), c)
        return store(pairs.select("l", "r", "cl", "cr"), "brown-classed")

    def table(self, pairs: DataFrame) -> np.ndarray:
        """Class bigrams of all training texts."""
        classes, k, end = self.classes, CLASSES, len(self.words)

        def cells(total: np.ndarray) -> pa.RecordBatch:
            at = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k * k, np.int64)
            for batch in batches:
                w = _keys(batch.column(0))
                before = np.r_[np.int32(end), w[:-1]][:len(w)]
                c, b = classes[w].astype(np.int64), classes[before].astype(np.int64)
                total += np.bincount((b * k + c)[(w >= 0) & (before >= 0)], minlength=k * k)
            yield cells(total)

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k * k, np.int64)
            for batch in _by_bytes(batches, 1):
                of, place, after = _neighbours(batch, 1)
                mine, other = batch.column(0).to_numpy()[of], classes[place].astype(np.int64)
                total += np.bincount(np.where(after, mine * k + other, other * k + mine), minlength=k * k)
            yield cells(total)

        kind = "cell int, n bigint"
        found = (self.texts.select("keys").mapInArrow(run, kind)
                 .unionByName(self.rare().select("cls", "near").mapInArrow(near, kind))
                 .unionByName(pairs.select((F.col("cl") * k + F.col("cr")).alias("cell"), F.lit(1).cast("long").alias("n")))
                 .groupBy("cell").agg(F.sum("n").alias("n")).collect())
        out = np.zeros(k * k, np.int64)
        for r in found:
            out[r["cell"]] = r["n"]
        return out.reshape(k, k)

    def contexts(self, pairs: DataFrame, half: int) -> DataFrame:
        """(w, entries) of the words of one half, counted in parts, but for those
        alone; rare words also bring their class."""
        classes, words, k, end = self.classes, self.words, CLASSES, len(self.words)
        active = np.r_[(words >> np.uint64(20)).astype(np.int64) & 1 == half, False]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def keys() -> Iterator[list[np.ndarray]]:
                for batch in batches:
                    w = _keys(batch.column(0)).astype(np.int64)
                    before = np.r_[end, w[:-1]][:len(w)]
                    some = (w >= 0) & (before >= 0)
                    w, before = w[some], before[some]
                    a, b = active[w], active[before]
                    yield [w[a] * 256 + classes[before[a]], before[b] * 256 + k + classes[w[b]],
                           w[a & (w == before)] * 256 + SELF]

            return _counted(keys())

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def keys() -> Iterator[list[np.ndarray]]:
                for batch in _by_bytes(batches, 1):
                    of, place, after = _neighbours(batch, 1)
                    a = active[place]
                    yield [place[a].astype(np.int64) * 256 + batch.column(0).to_numpy()[of[a]] + np.where(after[a], 0, k)]

            return _counted(keys())

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _by_bytes(batches, 2):
                w, cls = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                some = np.flatnonzero((w >> 20) & 1 == half)
                if len(some):
                    of, place, after = _neighbours(batch, 2)
                    a = (w[of] >> 20) & 1 == half
                    row = np.r_[some, of[a]]
                    by = np.argsort(row, kind="stable")
                    yield _packed(w[row][by], np.r_[np.full(len(some), CLASS), classes[place[a]] + np.where(after[a], k, 0)][by],
                                  np.r_[cls[some], np.ones(int(a.sum()), np.int64)][by])

        def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                l, r, cl, cr = (batch.column(i).to_numpy() for i in range(4))  # noqa: E741
                same = l[l == r]
                w, code = np.concatenate([r, l, same]), np.concatenate([cl, cr + k, np.full(len(same), SELF)])
                some = (w >> 20) & 1 == half
                by = np.argsort(w[some], kind="stable")
                if len(by):
                    yield _packed(w[some][by], code[some][by], np.ones(len(by), np.int64))

        kind = "w bigint, entries binary"
        return (self.texts.select("keys").mapInArrow(run, kind)
                .unionByName(self.rare().select("cls", "near").mapInArrow(near, kind))
                .unionByName(self.mixed.select("w", "cls", "near").mapInArrow(own, kind))
                .unionByName(pairs.mapInArrow(both, kind)))

    def move(self, table: np.ndarray, pairs: DataFrame, half: int) -> None:
        """Every word of one half goes to its best class."""
        classes, k = self.classes, CLASSES
        # a word's rows follow one another; only what they add up to is held
        context = self.contexts(pairs, half).repartition("w").sortWithinPartitions("w")

        def decide(w: np.ndarray, entry: np.ndarray) -> Iterator[pa.RecordBatch]:
            first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else np.zeros(0, np.int64)
            for i in range(0, len(first), 2048):
                starts = first[i:i + 2048]
                stop = first[i + 2048] if i + 2048 < len(first) else len(w)
                some, word = entry[starts[0]:stop], w[starts]
                of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, stop]))
                own = classes[np.maximum(word, 0)].astype(np.int64)
                told = some["code"] == CLASS
                own[of[told]] = some["n"][told]
                best = best_classes(table, own, of[~told], some["code"][~told], some["n"][~told].astype(np.int64))
                moves = best != own
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word[moves]), pa.array(best[moves].astype(np.int32))], names=["w", "new"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last_w, last = np.zeros(0, np.int64), np.zeros(0, ENTRY)       # of the word that may go on
            for batch in batches:
                if not batch.num_rows:
                    continue
                w, entry = _unpacked(batch)
                w, entry = np.concatenate([last_w, w]), np.concatenate([last, entry])
                cut = int(np.searchsorted(w, w[-1]))
                yield from decide(w[:cut], entry[:cut])
                code, at = np.unique(entry["code"][cut:], return_inverse=True)
                total = np.bincount(at, entry["n"][cut:]).astype(np.int64)
                # counts beyond an entry's range go on as several entries
                parts = np.maximum(1, -(-total // _MOST))
                last = np.empty(int(parts.sum()), ENTRY)
                last["code"] = np.repeat(code, parts)
                last["n"] = _MOST
                last["n"][np.cumsum(parts) - 1] = total - (parts - 1) * _MOST
                last_w = np.full(len(last), w[-1])
            yield from decide(last_w, last)

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _by_bytes(batches, 3):
                w, cls = batch.column(0).to_numpy(), batch.column(2).to_numpy().copy()
                of, place, after = _neighbours(batch, 3)
                code = classes[place] + np.where(after, k, 0)
                some = np.flatnonzero((w >> 20) & 1 == half)
                for i in range(0, len(some), 2048):
                    part = some[i:i + 2048]
                    a = slice(*np.searchsorted(of, [part[0], part[-1] + 1]))
                    here = (w[of[a]] >> 20) & 1 == half
                    word = np.searchsorted(part, of[a][here])
                    cls[part] = best_classes(table, cls[part].astype(np.int64), word, code[a][here], np.ones(len(word)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cls), batch.column(3)],
                                                 names=["w", "c", "cls", "near"])

        moves = store(context.mapInArrow(run, "w bigint, new int"), "brown-moves")
        cached = moves.where("w >= 0").toArrow()            # at most CACHE rows
        kind = "w bigint, c bigint, cls int, near binary"
        self.alone = store(self.alone.select("w", "c", "cls", "near").mapInArrow(alone, kind), "brown-alone")
        self.mixed = store(self.mixed.join(moves.where("w < 0").hint("merge"), "w", "left")
                           .select("w", "c", F.coalesce("new", "cls").alias("cls"), "near"), "brown-mixed")
        self.classes = classes.copy()
        self.classes[cached.column("w").to_numpy()] = cached.column("new").to_numpy()


def fit(train: DataFrame) -> Model:
    """Classes and counts of all words, from all rows (text)."""
    counts = store(word_counts(train), "brown-counts")
    # words with a unit of their own
    top = np.array([r["h"] for r in counts.orderBy(F.desc("c"), "h").limit(OWN).collect()], np.int64).view(np.uint64)
    own_unit = np.argsort(top)
    own = top[own_unit]

    # the cache: all words above a count that lets at most CACHE in
    step = F.floor(F.log2("c") * 16).cast("int")
    room, least = CACHE, 1 << 30
    for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect():
        if r["n"] > room:
            break
        room, least = room - r["n"], r["step"]
    cached = counts.where(step >= least).toArrow()
    words = cached.column("h").to_numpy().view(np.uint64)
    by = np.argsort(words)
    words, word_counts_ = words[by], cached.column("c").to_numpy()[by]
    units = np.r_[cached.column("unit").to_numpy()[by], END].astype(np.int16)
    at, known = Places(own).find(words)
    units[:-1][known] = own_unit[at[known]]

    texts = store(keyed(train, words, own, own_unit), "brown-keys")
    pairs = unit_bigrams(texts, units).toArrow()              # at most (END + 1) squared numbers
    size = END + 1
    bigrams = np.zeros(size * size, np.int64)
    bigrams[pairs.column("pair").to_numpy()] = pairs.column("n").to_numpy()
    unit_class = exchange(bigrams.reshape(size, size))        # the starting exchange

    rest = counts.where(step < least).select("h", "unit", "c")
    rare = store(rare_words(texts, rest, len(words), own, own_unit, unit_class), "brown-rare")
    work = Exchange(texts, words, unit_class[units].astype(np.uint8), rare)
    best, seen = None, []
    for k in range(ROUNDS + 1):
        pairs = work.classed_pairs()
        table = work.table(pairs)
        seen.append(likelihood(table))
        if best is None or seen[-1] > best[0]:
            best = (seen[-1], work.classes, work.rare(), table)
        if k < ROUNDS:
            work.move(table, pairs, k % 2)
    _, classes, rare, table = best

    n_c = table.sum(0)                                   # every token is the right side of one pair
    v_c = np.bincount(classes[:-1], minlength=CLASSES)
    for r in rare.groupBy("cls").agg(F.count(F.lit(1)).alias("v")).collect():
        v_c[r["cls"]] += r["v"]
    end_count = int(n_c[CLASSES - 1])
    v_c[CLASSES - 1] = end_count > 0
    transition = table + ALPHA
    transition = transition / transition.sum(1, keepdims=True)
    n, v = int(n_c.sum()), int(v_c.sum())
    log_part = np.log10(LAMBDA * transition / (n_c + v_c + 1) + (1 - LAMBDA) / (n + v + 1))
    if n == 0:
        log_part[:] = 0.0
    return Model(words, word_counts_, classes[:-1], rare, unit_class, log_part, end_count, n, v, seen)


def score(docs: DataFrame, model: Model, extra: Column) -> DataFrame:
    """doc_id, extra, n_tokens, n_known, train_tokens, base_score, score."""
    words, counts, classes, unit_class, log_part = (
        model.words, model.counts, model.classes, model.unit_class, model.log_part)
    end_count = model.end_count
    kind = "doc_id bigint, extra boolean, n bigint, known bigint, counted double, classes binary"
    asked_type = pa.list_(pa.struct([("p", pa.int32()), ("w", pa.int64())]))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, log_count, end_log = Places(words), np.log10(counts + 1.0), np.log10(end_count + 1.0)
        for batch in batches:
            for s in scan(batch.column(0), lower=True):
                at, known = places.find(s.hashes)
                c = unit_class[_endings(s)]
                c[known] = classes[at[known]]
                bounds = s.bounds()
                w = np.where(known, log_count[at] if len(words) else 0.0, 0.0)
                open_ = np.flatnonzero(~known)
                place = open_ - bounds[s.row[open_]]
                offsets = np.searchsorted(open_, bounds).astype(np.int32)
                asked = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(
                    [pa.array(place.astype(np.int32)), pa.array(_rare_key(s.hashes[open_]))], names=["p", "w"]))
                raw = c.astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(s.first, s.rows), batch.column(2).slice(s.first, s.rows),
                     pa.array((s.counts + 1).astype(np.int64)),
                     pa.array(np.bincount(s.row, known, s.rows).astype(np.int64) + (end_count > 0)),
                     pa.array(np.bincount(s.row, w, s.rows) + end_log),
                     pa.array([raw[i:j] for i, j in zip(bounds[:-1], bounds[1:])], pa.binary()), asked.cast(asked_type)],
                    names=["doc_id", "extra", "n", "known", "counted", "classes", "asked"])

    local = store(docs.select("text", "doc_id", extra.alias("extra"))
                  .mapInArrow(look_up, kind + ", asked array<struct<p:int,w:bigint>>")
                  .withColumn("rid", F.monotonically_increasing_id()), "brown-local")
    # words outside the cache, by shuffle; one that training has not seen finds nothing
    found = (local.select("rid", F.explode("asked").alias("x")).select("rid", "x.p", "x.w")
             .join(model.rare.hint("merge"), "w")
             .groupBy("rid").agg(F.collect_list(F.struct("p", "cls", "c")).alias("found")))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, counted = batch.column(3).to_numpy().copy(), batch.column(4).to_numpy().copy()
            classed = np.empty(batch.num_rows)
            lists = batch.column(6)
            for i, raw in enumerate(batch.column(5)):
                c = np.frombuffer(raw.as_buffer(), np.uint8)
                if lists[i].is_valid:
                    item = lists[i].values
                    p = item.field(0).to_numpy()
                    c = c.copy()
                    c[p] = item.field(1).to_numpy()
                    known[i] += len(p)
                    counted[i] += np.log10(item.field(2).to_numpy()[np.argsort(p)] + 1.0).sum()
                c = np.r_[np.uint8(CLASSES - 1), c, np.uint8(CLASSES - 1)]
                classed[i] = log_part[c[:-1], c[1:]].sum()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(known), pa.array(counted), pa.array(classed)],
                names=["doc_id", "extra", "n", "known", "counted", "classed"])

    base = float(np.log10(model.tokens + model.types + 1.0))
    done = local.drop("asked").join(found.hint("merge"), "rid", "left").select(
        "doc_id", "extra", "n", "known", "counted", "classes", "found").mapInArrow(
        finish, "doc_id bigint, extra boolean, n bigint, known bigint, counted double, classed double")
    return done.select(
        "doc_id", "extra", F.col("n").alias("n_tokens"), F.col("known").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("counted") - F.col("n") * F.lit(base)).alias("base_score"),
        (F.col("counted") + F.col("classed")).alias("score"))
