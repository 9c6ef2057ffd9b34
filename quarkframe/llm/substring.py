"""Substring dedup by level-wise doubling.

A window of ``window`` consecutive words is a duplicate if its words also
start somewhere in a document with a smaller doc_id; every word that a
duplicate window covers is removed. Windows are judged on the input.

1. Documents with the same words are one class; the member with the smallest
   doc_id stands for it. (The others lose everything if they have ``window``
   words, and nothing otherwise.) A group of copies, however large, goes on as
   one row.
2. Levels. The lengths are the window halved down to ``SHORTEST`` words or
   more (50: 12, 25, 50). At each level, of the windows of that length inside
   a full window the one with the least hash stands for it (a choice by
   content, so equal full windows make it alike); at 12 words these are about
   5 % of all windows. Those that occur in one class only are dropped; only
   full windows whose representative was repeated are read at twice the length,
   and only texts that still have one go on to the next level.
3. The doubling ends when no candidate survives or the asked length is reached:
   the full windows that are left are hashed (128 bits), and those that a class
   with a smaller doc_id has too are duplicates. Longer windows could add no
   word to those that are removed.
4. The duplicates' positions are gathered per text (never more than its
   words), and a last pass cuts them out.

Style: Arrow batches with vectorised hashes between DataFrame joins and
aggregations. Texts are compressed before they are stored and shuffled. Counts
per hash are combined before the shuffle, and the join back reads written tables
on both sides, so adaptive execution can split a hot passage. Texts meet what
was found about them by (doc_id, 128-bit hash of the words), so rows without a
doc_id, or with one doc_id, spread like others.

Edge cases: a null text has no words; texts shorter than the window lose
nothing; a null doc_id counts as larger than any other and not smaller than
another null; rows that repeat a doc_id do not count against each other;
repeated rows get equal answers; an empty table gives an empty result; other
columns are kept as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import fresh, store
from .wordhash import Slice, scan, sequence_hashes, window_starts

WINDOW = 50
LAST = (1 << 63) - 1          # stands for a null doc_id in comparisons
SHORTEST = 12                 # words of the first level's windows, at least (a shorter window is its own level)


def lengths(window: int) -> list[int]:
    """The levels' lengths, each about twice the one before, up to ``window``."""
    out = [window]
    while out[0] // 2 >= SHORTEST:
        out.insert(0, out[0] // 2)
    return out


def _class_keys(s: Slice) -> np.ndarray:
    at = s.bounds()
    return np.stack([sequence_hashes(s.hashes, at[:-1], at[1:], w) for w in (0, 1)], axis=1).view(np.int64)


def _anchors(s: Slice, window: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the full windows and, for each, the least hash of the
    windows of ``length`` words in it."""
    first = window_starts(s, window)
    if not len(first):
        return first, np.zeros(0, np.uint64)
    starts = np.arange(len(s.hashes) - length + 1)
    least, span = sequence_hashes(s.hashes, starts, starts + length), 1
    inside = window - length + 1
    while span < inside:            # running minima over spans that double
        step = min(span, inside - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    return first, least[first]


def _unpacked(z: pa.Array) -> pa.Array:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([unpack(x) for x in z.to_pylist()], pa.large_binary()).cast(pa.large_string())


def _profile(docs: DataFrame, window: int) -> DataFrame:
    """rid, o (doc_id, null last), n, k1, k2 (128-bit hash of the words), anchors
    of the first level, and the text as zstandard bytes (half as much to shuffle
    as by the block codec)."""
    length = lengths(window)[0]
    schema = "o bigint, n bigint, k1 bigint, k2 bigint, anchors array<bigint>, z binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            n, keys, anchors = [], [], []
            for s in scan(batch.column(1)):
                first, least = _anchors(s, window, length)
                cut = np.searchsorted(first, s.bounds())
                n.append(s.counts)
                keys.append(_class_keys(s))
                anchors += [np.unique(least[cut[r]:cut[r + 1]]).view(np.int64) for r in range(s.rows)]
            if n:
                k = np.concatenate(keys)
                z = [pack((t or "").encode()) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.concatenate(n), pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1]),
                     pa.array(anchors, pa.list_(pa.int64())), pa.array(z, pa.binary())],
                    names=["o", "n", "k1", "k2", "anchors", "z"])

    return (docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("o"), "text").mapInArrow(run, schema)
            .withColumn("rid", F.monotonically_increasing_id()))


def _alive(batch: pa.RecordBatch, window: int, length: int) -> Iterator[tuple[int, Slice, slice, np.ndarray]]:
    """Of rows with ``repeated`` and ``z``: row number, its slice of texts, the
    range of its words in there, and the starts (in the slice) of its full windows
    whose representative at ``length`` is among ``repeated``."""
    repeated = batch.column("repeated")
    for s in scan(_unpacked(batch.column("z"))):
        first, least = _anchors(s, window, length)
        at = s.bounds()
        cut = np.searchsorted(first, at)
        for r in range(s.rows):
            held = repeated[s.first + r].values.to_numpy().view(np.uint64)
            mine = np.isin(least[cut[r]:cut[r + 1]], held)
            yield s.first + r, s, slice(at[r], at[r + 1]), first[cut[r]:cut[r + 1]][mine]


def _extended(rows: DataFrame, window: int, length: int, longer: int) -> DataFrame:
    """rid, anchors, z: the texts of rows (rid, repeated, z) with the
    representatives, ``longer`` words, of their surviving full windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, known = [], None
            for _, s, _, mine in _alive(batch, window, length):
                if known is None or known[0] is not s:
                    known = (s, *_anchors(s, window, longer))
                anchors.append(np.unique(known[2][np.searchsorted(known[1], mine)]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), pa.array(anchors, pa.list_(pa.int64())), batch.column("z")],
                names=["rid", "anchors", "z"])

    return rows.select("rid", "repeated", "z").mapInArrow(run, "rid bigint, anchors array<bigint>, z binary")


def _windows(rows: DataFrame, window: int, length: int) -> DataFrame:
    """h1, h2, o, rid, pos of the surviving full windows of rows (rid, o, repeated, z)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            o, rid = batch.column("o").to_numpy(), batch.column("rid").to_numpy()
            for i, s, span, mine in _alive(batch, window, length):
                if len(mine):
                    p = mine - span.start
                    h = [sequence_hashes(s.hashes[span], p, p + window, x).view(np.int64) for x in (0, 1)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[0]), pa.array(h[1]), pa.array(np.full(len(p), o[i])),
                         pa.array(np.full(len(p), rid[i])), pa.array(p.astype(np.int32))],
                        names=["h1", "h2", "o", "rid", "pos"])

    return rows.select("rid", "o", "repeated", "z").mapInArrow(
        run, "h1 bigint, h2 bigint, o bigint, rid bigint, pos int")


def _survivors(level: DataFrame, name: str) -> DataFrame:
    """rid, repeated: the representatives of ``level`` (rid, anchors) that several
    texts have, by text."""
    anchors = level.select("rid", F.explode("anchors").alias("h"))
    repeated = store(anchors.groupBy("h").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi"))
                     .where("lo < hi").select("h"), f"{name}-repeated")
    return store(anchors.join(repeated, "h").groupBy("rid").agg(F.collect_list("h").alias("repeated")), name)


def _duplicates(profile: DataFrame, window: int) -> DataFrame:
    """One row per text that loses words, of a stored profile: o, k1, k2 and
    ``starts``, the positions of its duplicate windows (null: all words go)."""
    # a text shorter than the window has none, so classes only matter from there on
    long_ = profile.where(F.col("n") >= window)
    classes = store(long_.groupBy("k1", "k2").agg(F.min(F.struct("o", "rid")).alias("least"))
                    .select("k1", "k2", "least.o", "least.rid"), "substring-classes")
    copies = (long_.select("o", "k1", "k2").join(classes.select("k1", "k2", F.col("o").alias("first")), ["k1", "k2"])
              .where("o > first").select("o", "k1", "k2", F.lit(None).cast("array<int>").alias("starts")).distinct())

    steps = lengths(window)
    level = long_.join(classes.select("rid"), "rid", "left_semi").select("rid", "anchors", "z")
    for length, longer in zip(steps, steps[1:] + [None]):
        alive = _survivors(level, f"substring-{length}")
        if longer is None or longer == window or alive.isEmpty():
            break
        level = store(_extended(alive.join(level.select("rid", "z"), "rid"), window, length, longer),
                      f"substring-texts-{longer}")
    rows = alive.join(level.select("rid", "z"), "rid").join(classes.select("rid", "o"), "rid")
    full = store(_windows(rows, window, length), "substring-windows")
    twice = store(full.groupBy("h1", "h2").agg(F.min("o").alias("lo"), F.max("o").alias("hi"))
                  .where("lo < hi").select("h1", "h2", "lo"), f"substring-{window}")
    found = (full.join(twice, ["h1", "h2"]).where("o > lo").groupBy("rid").agg(F.collect_set("pos").alias("starts"))
             .join(classes, "rid").select("o", "k1", "k2", "starts"))
    return found.unionByName(copies)


def _covered(n: int, starts: np.ndarray | None, window: int) -> np.ndarray:
    """Which of n words the windows cover."""
    if starts is None:
        return np.ones(n, bool)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.asarray(starts) + window, -1)
    return np.cumsum(edge[:n]) > 0


def _gone(cuts: pa.Array, i: int, n: int, window: int) -> np.ndarray | None:
    """Which of the n words of row i go, or None if all stay; ``cuts``: struct of starts."""
    c = cuts[i].as_py()
    return None if c is None else _covered(n, None if c["starts"] is None else np.array(c["starts"]), window)


def _stored_profile(docs: DataFrame, window: int) -> DataFrame:
    return store(_profile(docs.select("doc_id", "text"), window), "substring-profile")


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    profile = _stored_profile(docs, window)
    cuts = store(_duplicates(profile, window), "substring-cuts").select("o", "k1", "k2", F.struct("starts").alias("cut"))
    rows = profile.join(cuts, ["o", "k1", "k2"], "left").select(
        F.when(F.col("o") != LAST, F.col("o")).alias("doc_id"), "z", "cut")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, sha = [], [], []
            for s in scan(_unpacked(batch.column(1))):
                at, raw = s.bounds(), s.data.tobytes()
                for r in range(s.rows):
                    a, b = at[r], at[r + 1]
                    go = _gone(batch.column(2), s.first + r, int(b - a), window)
                    go = np.zeros(b - a, bool) if go is None else go
                    st, en = s.starts[a:b][~go].tolist(), s.ends[a:b][~go].tolist()
                    n.append(int(b - a))
                    gone.append(int(go.sum()))
                    sha.append(hashlib.sha256(b" ".join([raw[x:y] for x, y in zip(st, en)])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def _keyed(docs: DataFrame, names: list[str]) -> DataFrame:
    """``docs`` and, under two more names, the hash of each text's words."""
    at_text = [x.lower() for x in docs.columns].index("text")
    k1, k2 = names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.zeros((0, 2), np.int64), *(_class_keys(s) for s in scan(batch.column(at_text)))]
            k = np.concatenate(keys)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(k[:, 0]), pa.array(k[:, 1])],
                                             names=[*batch.schema.names, k1, k2])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(k1, LongType()), StructField(k2, LongType())]))


def cut(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the duplicate passages cut out of their texts: removed
    words go with the separators before them; a text that loses nothing stays
    as it is. All rows and columns are kept."""
    o, k1, k2, c = fresh(docs, "cut_o", "cut_k1", "cut_k2", "cut")
    cuts = store(_duplicates(_stored_profile(docs, window), window), "substring-cuts").select(
        F.col("o").alias(o), F.col("k1").alias(k1), F.col("k2").alias(k2), F.struct("starts").alias(c))
    keyed = _keyed(docs, [k1, k2]).withColumn(o, F.coalesce("doc_id", F.lit(LAST)))
    rows = keyed.join(cuts, [o, k1, k2], "left").select(*docs.columns, c)
    names = docs.columns
    at_text = [x.lower() for x in names].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, cut_ = batch.column(at_text), batch.column(len(names))
            if cut_.null_count < len(batch):
                texts = column.to_pylist()
                for s in scan(column):
                    where = s.bounds()
                    raw = s.data.tobytes()
                    ends_of = np.cumsum([0] + [len((t or "").encode()) for t in texts[s.first:s.first + s.rows]])
                    for r in range(s.rows):
                        go = _gone(cut_, s.first + r, int(where[r + 1] - where[r]), window)
                        if go is not None and go.any():
                            st, en = s.starts[where[r]:where[r + 1]], s.ends[where[r]:where[r + 1]]
                            keep = np.ones(int(ends_of[r + 1] - ends_of[r]), bool)
                            begin = np.concatenate([[ends_of[r]], en[:-1]])
                            for x, y in zip(begin[go] - ends_of[r], en[go] - ends_of[r]):
                                keep[x:y] = False
                            piece = np.frombuffer(raw, np.uint8)[ends_of[r]:ends_of[r + 1]][keep]
                            texts[s.first + r] = piece.tobytes().decode()
                column = pa.array(texts, column.type)
            yield pa.RecordBatch.from_arrays(
                [column if i == at_text else batch.column(i) for i in range(len(names))], names=names)

    return rows.mapInArrow(run, docs.schema)
