"""MinHash near-duplicate detection: one-permutation hashing with optimal
densification, banded buckets, star-shaped candidate edges.

1. Every text becomes its set of 5-word shingles (64-bit hashes). One pass
   hashes each set once: the shingle's high bits choose one of ``BINS`` bins,
   the least value per bin is kept, and each empty bin borrows from a
   non-empty one along its own pseudorandom probe sequence (optimal
   densification). ``ROWS`` bins make a band; a band's values are a bucket key.
2. Texts with equal sets are one class; only classes go on, so copies of a
   text cost one row whatever their number.
3. In each bucket with two or more classes one class is the star's centre, and
   the others are its candidate edges: no more edges than members. A sketch of
   element parities rules out, without error, most edges whose sets differ too
   much; the others are confirmed on the full sets: 100 * intersection >=
   percent * union. ``percent`` is the caller's: 85 for the query op7_minhash
   (``PERCENT``), 80 for the pipeline's stage.
4. Links give connected components (alternating large-star and small-star
   steps). A bucket whose members all lie in one component is resolved. The
   others get further stars: centres that were used leave the bucket, the next
   ones are its members with most links so far, twice as many centres each
   round, until all buckets are resolved. So no link between classes that
   share a bucket is lost, and a bucket whose members resemble each other
   (where all pairs would be many) ends with its first or second star. Pairs at
   similarity 0.85 share a bucket with probability 1 - 2.4e-7, pairs at 0.8
   with 1 - 3.3e-5, more similar ones more surely.

Style: Arrow batches compute the sets; joins and aggregations are DataFrame
operations. Tables that later steps read again are written to the shared
folder. A centre with many candidates is dealt to several tasks (its set is
repeated per ``FAN`` members). Nothing but counts reaches the driver.

Edge cases: a text with fewer than five words has its whole sequence as its
only shingle; without words or text the set is empty, it links with nothing
and is its own component; a null doc_id never is a component's id unless the
component has no other; one_of_each keeps one row of each component whatever
its doc_ids; repeated rows get equal answers; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, store
from .wordhash import mix, scan, sequence_hashes, window_starts

SHINGLE = 5
BANDS, ROWS = 26, 5
BINS = BANDS * ROWS
PERCENT = 85        # least similarity of a link, unless the caller gives another
LAST = (1 << 63) - 1          # stands for a null doc_id in joins
ODD_BITS = 2048     # of the sketch that rules out pairs before their sets are read
GROWTH = 8          # times as many stars in each further round
FAN = 256           # members of one star that share a copy of the centre's set


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for s in scan(texts, lower=True):
        at = s.bounds()
        first = window_starts(s, SHINGLE)
        h = sequence_hashes(s.hashes, first, first + SHINGLE)
        cut = np.searchsorted(first, at)
        short = np.flatnonzero((s.counts > 0) & (s.counts < SHINGLE))
        alone = dict(zip(short.tolist(), sequence_hashes(s.hashes, at[short], at[short + 1])))
        for r in range(s.rows):
            yield np.unique(h[cut[r]:cut[r + 1]]) if r not in alone else np.array([alone[r]], np.uint64)


_PROBES = mix(np.arange(BINS, dtype=np.uint64)[None, :] * np.uint64(1 << 20)
              + np.arange(1, 4097, dtype=np.uint64)[:, None]) % np.uint64(BINS)


def band_keys(u: np.ndarray) -> np.ndarray:
    """Bucket keys of a sorted non-empty set."""
    bin_of = ((u >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)     # ascending, as u is
    least = np.flatnonzero(np.concatenate([[True], bin_of[1:] != bin_of[:-1]]))
    sig, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    sig[bin_of[least]], full[bin_of[least]] = u[least], True
    if len(least) == 1:
        sig[:] = u[least[0]]
    else:
        empty, t = np.flatnonzero(~full), 0
        while len(empty):
            donor = (_PROBES[t] if t < len(_PROBES) else _PROBES[t % len(_PROBES)] + np.uint64(t)) % np.uint64(BINS)
            d = donor[empty]
            sig[empty[full[d]]] = sig[d[full[d]]]
            empty, t = empty[~full[d]], t + 1
    band = np.arange(BANDS, dtype=np.uint64)
    key = band + np.uint64(1)
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[r::ROWS][:BANDS])
    return key


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """ODD_BITS bits, each the parity of the elements that fall on it."""
    bits = np.bincount((hashes & np.uint64(ODD_BITS - 1)).astype(np.int64), minlength=ODD_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _may_link(x: str, y: str, n: str, m: str, percent: int) -> Column:
    """False only for sets (odd sketches ``x``, ``y``, sizes ``n``, ``m``) that
    cannot be similar enough: every bit in which the sketches differ needs an
    element that only one of the sets has, and similar sets have few of those."""
    differ = " + ".join(f"bit_count(get({x}, {i}) ^ get({y}, {i}))" for i in range(ODD_BITS // 64))
    return F.expr(f"({differ}) * {100 + percent} <= ({n} + {m}) * {100 - percent}")


def _signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), k1, k2 (128-bit set hash), bands of every text,
    and t1, t2 (128-bit text hash)."""
    schema = ("doc_id bigint, n bigint, k1 bigint, k2 bigint, bands array<bigint>, odd array<bigint>, "
              "t1 bigint, t2 bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k, bands, odd = [], [], [], []
            for u in shingle_sets(batch.column(1)):
                n.append(len(u))
                m = mix(u)
                k.append((m.sum(dtype=np.uint64), mix(m + np.uint64(1)).sum(dtype=np.uint64)))
                bands.append(band_keys(u).view(np.int64) if len(u) else np.zeros(0, np.int64))
                odd.append(odd_sketch(m))
            k = np.array(k, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1]),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64())),
                 batch.column(2), batch.column(3)],
                names=["doc_id", "n", "k1", "k2", "bands", "odd", "t1", "t2"])

    return docs.select("doc_id", "text", *_text_hash()).mapInArrow(run, schema)


def _text_hash() -> list[Column]:
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]


def _sets(rows: DataFrame) -> DataFrame:
    """cid and shingles of rows (cid, k1, text) whose set hash is k1 (a doc_id
    that occurs with several texts is found with each of them)."""
    schema = "cid bigint, shingles array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, k1 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ids, out = [], []
            for i, u in enumerate(shingle_sets(batch.column(2))):
                if int(mix(u).sum(dtype=np.uint64).view(np.int64)) == k1[i]:
                    ids.append(cid[i])
                    out.append(u.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.int64()))],
                                             names=["cid", "shingles"])

    return rows.select("cid", "k1", "text").mapInArrow(run, schema)


def _confirm(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those edges (a, b) whose sets are similar enough. a: the star's centre."""
    fan = edges.groupBy("a").agg((F.floor(F.count(F.lit(1)) / FAN) + 1).alias("fan"))
    centre = (fan.join(sets.withColumnRenamed("cid", "a"), "a")
              .select("a", F.col("shingles").alias("sa"), "fan",
                      F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("salt")).drop("fan"))
    member = (edges.join(fan, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("fan"))).drop("fan")
              .join(sets.withColumnRenamed("cid", "b").withColumnRenamed("shingles", "sb"), "b"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (member.join(centre, ["a", "salt"]).withColumn("both", both)
            .where(F.col("both") * 100 >= (F.size("sa") + F.size("sb") - F.col("both")) * percent)
            .select("a", "b").distinct())


def _large_star(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours point to its least neighbour."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (both.join(least, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point to the least of these."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    return (e.join(least, "u").select(
        F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                          F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        .select("x.u", "x.v").where("u > v").distinct())


def components(links: DataFrame) -> DataFrame:
    """(cid, comp): the least id reachable over links (a, b), for every id that
    occurs in a link. Alternates large-star and small-star steps; each step's
    rows are at most as many as the links."""
    e = store(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    mark = lambda t: t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(e)
    while True:
        # a table after each half: a step reads its input several times, so longer plans grow by powers
        e = store(_small_star(store(_large_star(e), "cc")), "cc")
        now = mark(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("cid"), F.col("v").alias("comp")).unionByName(
        e.select(F.col("v").alias("cid"), F.col("v").alias("comp")).distinct())


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``label`` (cid, comp) after new links (a, b): the links are
    taken between components, whose number falls from round to round."""
    ends = links.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    label = store(label.unionByName(ends.join(label, "cid", "left_anti").withColumn("comp", F.col("cid"))),
                  "neardup-labels")
    of = lambda end: label.withColumnsRenamed({"cid": end, "comp": "c" + end})
    between = (links.join(of("a"), "a").join(of("b"), "b").where("ca <> cb")
               .select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    moved = components(between).select(F.col("cid").alias("comp"), F.col("comp").alias("to"))
    return store(label.join(moved, "comp", "left").select("cid", F.coalesce("to", "comp").alias("comp")),
                 "neardup-components")


def _grouped(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Signatures of every row of ``docs`` (doc_id, text), and k1, k2, comp
    (number of the component), component_id, n_links of every set."""
    docs = docs.select("doc_id", "text")
    sig = store(_signatures(docs), "neardup-signatures")
    # whose text stands for a class: the least doc_id's (null last), then the least hash's
    text = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("d"), "t1", "t2")
    classes = store(sig.where("n > 0").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("rep"), F.min(text).alias("text"), F.first("n").alias("n"), F.first("bands").alias("bands"),
        F.first("odd").alias("odd"))
        .withColumn("cid", F.monotonically_increasing_id()), "neardup-classes")

    rows = classes.select("cid", "n", F.explode("bands").alias("key"))
    shared = store(rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("cid", "n")).alias("c"))
                   .where("members > 1").select("key", F.col("c.cid").alias("a"), F.col("c.n").alias("na")),
                   "neardup-buckets")
    members = store(rows.join(shared, "key"), "neardup-members")
    fits = "least(n, na) * 100 >= greatest(n, na) * " + str(percent)
    odd = classes.select("cid", "odd")
    edges = members.where("cid <> a").where(fits).select("a", "na", F.col("cid").alias("b"), F.col("n").alias("nb"))
    edges = (edges.distinct().join(odd.withColumnsRenamed({"cid": "b", "odd": "ob"}), "b")
             .join(odd.withColumnsRenamed({"cid": "a", "odd": "oa"}), "a")
             .where(_may_link("oa", "ob", "na", "nb", percent)).select("a", "b"))
    edges = store(edges, "neardup-edges")
    # sets of every class that shares a bucket, from one text each; rows meet by doc_id and text hash, so
    # that texts without or with a repeated doc_id meet their own class only
    involved = members.select("cid").distinct().join(classes.select("cid", "k1", "text.*"), "cid")
    texts = (docs.withColumn("d", F.coalesce("doc_id", F.lit(LAST))).withColumn("t1", _text_hash()[0])
             .withColumn("t2", _text_hash()[1]).join(involved, ["d", "t1", "t2"])
             .dropDuplicates(["d", "t1", "t2", "cid"]))      # they lie so already: nothing moves
    sets = store(_sets(texts), "neardup-sets")
    links = store(_confirm(edges, sets, percent), "neardup-links")

    seen, used = edges, shared.select("key", F.col("a").alias("cid"))
    stars, label = 1, store(components(links), "neardup-components")
    while True:
        open_ = members.select("key", "cid", "n").join(label, "cid", "left").withColumn(
            "comp", F.coalesce("comp", "cid"))
        unresolved = (open_.join(used, ["key", "cid"], "left_anti").groupBy("key")
                      .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"))
        unresolved = store(unresolved, "neardup-unresolved")
        if unresolved.isEmpty():
            break
        stars *= GROWTH
        degree = (links.select(F.col("a").alias("cid")).unionByName(links.select(F.col("b").alias("cid")))
                  .groupBy("cid").agg(F.count(F.lit(1)).alias("degree")))
        rest = store(open_.join(unresolved, "key").join(degree, "cid", "left")
                     .join(used.withColumn("done", F.lit(True)), ["key", "cid"], "left").join(odd, "cid"),
                     "neardup-open")
        best = Window.partitionBy("key").orderBy(F.desc_nulls_last("degree"), F.xxhash64("cid"))
        centres = store(rest.where("done is null").withColumn("r", F.row_number().over(best)).where(F.col("r") <= stars)
                        .select("key", F.col("cid").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"),
                                F.col("odd").alias("oa")),
                        "neardup-centres")
        found = (rest.join(centres, "key").where("comp <> ca").where(fits).where(_may_link("oa", "odd", "na", "n", percent))
                 .select(F.least("a", "cid").alias("x"), F.greatest("a", "cid").alias("y"),
                         "a", F.col("cid").alias("b")).dropDuplicates(["x", "y"]))
        before = seen.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        new = store(found.join(before, ["x", "y"], "left_anti").select("a", "b"), "neardup-edges")
        # one table each, so that no plan grows with the rounds
        seen = store(seen.unionByName(new), "neardup-seen")
        used = store(used.unionByName(centres.select("key", F.col("a").alias("cid"))), "neardup-used")
        found = store(_confirm(new, sets, percent), "neardup-links")
        if not found.isEmpty():
            links = store(links.unionByName(found), "neardup-links")
            label = _joined(label, found)

    n_links = (links.select(F.col("a").alias("cid")).unionByName(links.select(F.col("b").alias("cid")))
               .groupBy("cid").agg(F.count(F.lit(1)).alias("n_links")))
    of = classes.select("cid", "k1", "k2", "rep").join(label, "cid", "left").withColumn(
        "comp", F.coalesce("comp", "cid"))
    ids = of.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of = store(of.join(ids, "comp").join(n_links, "cid", "left")
               .select("k1", "k2", "comp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")),
               "neardup-result")
    return sig, of


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, n_links (links of the document's
    class that were confirmed) of every row of ``docs`` (doc_id, text)."""
    sig, of = _grouped(docs, percent)
    empty = F.col("n") == 0
    return (sig.join(of, ["k1", "k2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(empty, F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"),
        F.when(empty, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links")))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Exactly one row of each component of near duplicates, with all its
    columns: that of the least doc_id (null last), then of the least hashes.
    Unrelated texts are all kept, also without doc_id or under the same one,
    and so is every row without words."""
    key = fresh(docs, "kept_null", "kept_id", "kept_t1", "kept_t2")
    r, = fresh(docs, "kept_row")
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    sig, of = _grouped(docs, percent)
    row = F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "t1", "t2")
    first = (sig.where("n > 0").join(of.select("k1", "k2", "comp"), ["k1", "k2"])
             .groupBy("comp").agg(F.min(row).alias("x")).select("x.*").toDF(*key))
    full = docs.where(has_words)
    for name, how in zip(key, [F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), *_text_hash()]):
        full = full.withColumn(name, how)
    # equal rows are reduced to one before and after the exchange, by whose keys the join lies too
    one = Window.partitionBy(*key).orderBy(F.lit(0))
    full = full.withColumn(r, F.row_number().over(one)).where(F.col(r) == 1)
    return full.join(first, key).select(*docs.columns).unionByName(docs.where(~has_words))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``one_of_each``, for tables whose doc_id names a document: of its rows
    that repeat a doc_id (null is none) only the one with the least text hash."""
    d, t, least = fresh(docs, "kept_id", "kept_hash", "kept_least")
    rows = one_of_each(docs, percent)
    full = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]") & F.col("doc_id").isNotNull()
    rows = store(rows.withColumn(d, F.when(full, F.col("doc_id"))).withColumn(t, F.xxhash64("text")), "neardup-kept")
    by_id = rows.where(F.col(d).isNotNull()).groupBy(d).agg(F.min(t).alias(least))
    return (rows.join(by_id, d, "left").where(F.col(d).isNull() | (F.col(t) == F.col(least)))
            .select(*docs.columns))
