"""Document fingerprints: Merkle trees over paragraphs and sections (native:
Column expressions and DataFrame operations only).

Leaves are the hashes of a text's paragraphs (lines). A section is a run of
paragraphs that ends after one whose hash starts with 0 or 1 (on average
eight), so an inserted paragraph moves section borders only nearby. A
section's hash is that of its leaves, the root is the hash of the sections:
equal roots mean equal texts. ``locate`` goes down two trees: it skips the
sections that are equal from the front and from the back, opens only those
between them, and skips equal paragraphs there in the same way.

To compare texts whose paragraphs differ by a few letters, texts are cut once
more, into blocks whose ends their own bytes choose: a block ends after a byte
whose value is 3 modulo ``CUT`` (about every sixth of an English text), or after
32 bytes without one. One rule holds for all lengths and scripts, and an
insertion changes the blocks near it only. A shingle is a block with the one
before it. The fingerprint is the root, a bottom-``KEEP`` sketch of the shingles'
hashes (the n-th occurrence of a shingle hashed with n), and the branches: for
every section 16 digits of its hash and its number of paragraphs. From two
fingerprints alone, ``likeness`` estimates which share of their shingles two texts
have in common (Dice coefficient), and their branches tell the sections that
differ.

Edge cases: a null text counts as empty; two empty texts are alike (1), an
empty and a non-empty one not (0); very long texts are hashed whole; rows are
ordered by descending doc_id, null last, then by descending text hash, so
repeated rows follow each other; rows without a doc_id, or with one doc_id, are
dealt out by text hash, equal ones at random; a single row is its own successor;
an empty table gives an empty result; other columns, whatever their names, are
not read.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUT = 4                      # a block ends after a byte that is 3 modulo this
KEEP = 64
ROWS_PER_RANGE = 5_000       # documents in a range of doc_ids, about
MOST_RANGES = 65_536         # ranges of doc_ids at most (a bound on what reaches the driver)
LOWEST = -(1 << 63)          # stands for a null doc_id


def paragraphs(text: Column) -> Column:
    """Leaves: hash of every paragraph."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: F.sha2(p.cast("binary"), 256))


def tree(leaves: Column) -> Column:
    """The sections: structs of their hash ``h`` and their leaves, comma-joined."""
    ends = lambda h: F.when(F.substring(h, 1, 1).isin("0", "1"), F.concat(h, F.lit(";"))).otherwise(h)
    parts = F.array_remove(F.split(F.array_join(F.transform(leaves, ends), ","), ";,?"), "")
    return F.transform(parts, lambda s: F.struct(F.sha2(s.cast("binary"), 256).alias("h"), s.alias("leaves")))


def root(sections: Column) -> Column:
    return F.sha2(F.array_join(sections["h"], ",").cast("binary"), 256)


def _equal_ahead(a: Column, b: Column) -> Column:
    """In how many first elements two lists agree."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(differs > 0, differs - 1).otherwise(F.size(a)).cast("int")


def _differing(a: Column, b: Column) -> tuple[Column, Column]:
    """How many first elements of two lists agree, and how many last ones of
    what is left."""
    ahead = _equal_ahead(a, b)
    behind = F.least(_equal_ahead(F.reverse(a), F.reverse(b)), F.least(F.size(a), F.size(b)) - ahead)
    return ahead, behind


def locate(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """``df`` with the edit that makes the tree in column ``b`` of that in
    column ``a``: ``out``_paragraph (the first that differs, from 1; 0: equal
    trees), ``out``_removed and ``out``_added (how many paragraphs of ``a`` are
    replaced by how many of ``b``), ``out``_opened (sections read below their hash)."""
    x, y = F.col(a), F.col(b)
    ahead, behind = _differing(x["h"], y["h"])
    df = df.withColumn("_edit", F.struct(ahead.alias("p"), behind.alias("q")))
    p, q = F.col("_edit.p"), F.col("_edit.q")
    middle = lambda t: F.slice(t, p + 1, F.size(t) - p - q)
    leaves = lambda t: F.flatten(F.transform(t["leaves"], lambda s: F.split(s, ",")))
    # a section holds one comma less than leaves, each of 64 digits
    skipped = F.aggregate(F.slice(x["leaves"], F.lit(1), p), F.lit(0), lambda n, s: n + F.ceil(F.length(s) / 65).cast("int"))
    df = df.withColumn("_edit", F.struct("_edit.p", "_edit.q", leaves(middle(x)).alias("a"), leaves(middle(y)).alias("b"),
                                         skipped.alias("skipped"), (F.size(middle(x)) + F.size(middle(y))).alias("opened")))
    la, lb = F.col("_edit.a"), F.col("_edit.b")
    ahead, behind = _differing(la, lb)
    df = df.withColumn("_at", F.struct(ahead.alias("p"), behind.alias("q")))
    removed, added = (F.size(z) - F.col("_at.p") - F.col("_at.q") for z in (la, lb))
    return (df.withColumn(f"{out}_paragraph", F.when((removed == 0) & (added == 0), 0).otherwise(
                F.col("_edit.skipped") + F.col("_at.p") + 1).cast("long"))
            .withColumn(f"{out}_removed", removed.cast("long")).withColumn(f"{out}_added", added.cast("long"))
            .withColumn(f"{out}_opened", F.col("_edit.opened").cast("long")).drop("_edit", "_at"))


def _blocks(text: Column) -> Column:
    """The text's UTF-8 bytes, one character each, cut into blocks."""
    ends = "".join(f"\\x{b:02x}" for b in range(CUT - 1, 256, CUT))
    raw = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return F.regexp_extract_all(raw, F.lit(f"[^{ends}]{{1,31}}[{ends}]?|[{ends}]"), F.lit(0))


def _shingle_hashes(blocks: Column) -> Column:
    return F.sort_array(F.transform(blocks, lambda x, i: F.xxhash64(F.get(blocks, i - 1), x)))


def _occurrences(s: Column) -> Column:
    """Hash of (shingle, how often it came before) for the sorted hashes
    ``s``. Equal hashes stand side by side; the number before one is found by
    halving steps, and only where the neighbour is equal."""
    steps = F.array(*[F.lit(1 << k) for k in range(20, -1, -1)])

    def number(x: Column, j: Column) -> Column:
        back = lambda r, t: F.when((j - r - t >= 0) & (F.get(s, j - r - t) == x), r + t).otherwise(r)
        return F.when(F.get(s, j - 1) == x, F.aggregate(steps, F.lit(0), back)).otherwise(F.lit(0))

    return F.transform(s, lambda x, j: F.shiftrightunsigned(F.xxhash64(x, number(x, j)), 32))


def fingerprint_steps(text: str, out: str) -> list[tuple[str, Column]]:
    """Columns to add one after the other: ``out``_tree, ``out``_root and
    ``out``_sketch of the text column ``text``."""
    t = F.coalesce(F.col(text), F.lit(""))
    return [
        (f"{out}_tree", paragraphs(F.col(text))),
        (f"{out}_tree", tree(F.col(f"{out}_tree"))),
        (f"{out}_root", root(F.col(f"{out}_tree"))),
        (f"{out}_sketch", _blocks(t)),
        (f"{out}_sketch", _shingle_hashes(F.col(f"{out}_sketch"))),
        (f"{out}_sketch", _occurrences(F.col(f"{out}_sketch"))),
        (f"{out}_sketch", F.slice(F.array_distinct(F.sort_array(F.col(f"{out}_sketch"))), 1, KEEP)),
    ]


def _add(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    for name, how in steps:
        df = df.withColumn(name, how)
    return df


def fingerprint(out: str) -> Column:
    """The fingerprint as a string: root, sketch in hexadecimal, branches
    (16 digits of a section's hash, "x", its number of paragraphs)."""
    branch = lambda s: F.concat(F.substring(s["h"], 1, 16), F.lit("x"), F.ceil(F.length(s["leaves"]) / 65))
    return F.concat_ws(":", F.col(f"{out}_root"), F.array_join(
        F.transform(F.col(f"{out}_sketch"), lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""),
        F.array_join(F.transform(F.col(f"{out}_tree"), branch), ","))


def likeness(a: str, b: str) -> Column:
    """Likeness of the fingerprints ``a`` and ``b``: 1 for equal roots, else
    the estimated Dice coefficient of their shingles."""
    x, y = F.col(f"{a}_sketch"), F.col(f"{b}_sketch")
    union = F.sort_array(F.array_union(x, y))
    complete = (F.size(x) < KEEP) & (F.size(y) < KEEP)     # then the sketches are all shingles
    seen = F.when(complete, union).otherwise(F.slice(union, 1, KEEP))
    both = F.size(F.array_intersect(F.array_intersect(seen, x), y))
    j = both / F.size(seen)
    return F.when(F.col(f"{a}_root") == F.col(f"{b}_root"), F.lit(1.0)).when(
        (F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(2 * j / (1 + j))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """Number of the bounds that are at most ``key``: first among every
    step-th, then among those between."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    coarse = F.array(*[F.lit(b) for b in bounds[::step]])
    fine = F.array(*[F.array(*[F.lit(b) for b in bounds[i:i + step]]) for i in range(0, len(bounds), step)])
    i = F.size(F.filter(coarse, lambda b: b <= key))
    within = F.size(F.filter(F.get(fine, i - 1), lambda b: b <= key))
    return F.when(i == 0, F.lit(0)).otherwise((i - 1) * step + within)


def _quantiles(docs: DataFrame, column: str, ranges: int) -> tuple[list[int], dict[int, int]]:
    """Bounds of about ``ranges`` equal ranges of a column, and the values that
    two or more of them fall on, with how many."""
    if ranges < 2:
        return [], {}
    at = [i / ranges for i in range(1, ranges)]
    found = Counter(docs.agg(F.percentile_approx(column, at, 20 * ranges)).first()[0])
    return sorted(found), {v: m + 1 for v, m in found.items() if m > 1}


def ranged(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``key`` (doc_id, null least), ``h`` (text
    hash) and ``range``, in the order of (key, h).

    Ranges are quantiles of doc_id, of about ROWS_PER_RANGE rows. A doc_id that
    several quantiles fall on is a range by itself, divided by ranges of text
    hash; a text hash that several of these fall on is divided at random, as
    its rows are equal."""
    docs = docs.withColumn("key", F.coalesce("doc_id", F.lit(LOWEST))).withColumn("h", F.xxhash64("text"))
    n = docs.agg(F.count(F.lit(1))).first()[0]
    ranges = max(1, min(MOST_RANGES, n // ROWS_PER_RANGE))
    bounds, hot = _quantiles(docs, "key", ranges)
    within = {}
    top = F.shiftright("h", 11)        # quantiles are doubles: as many bits of the hash as they hold
    if hot:
        rows = docs.where(F.col("key").isin(list(hot))).groupBy("key").agg(
            F.percentile_approx(top, [i / ranges for i in range(1, ranges)], 20 * ranges).alias("at")).collect()
        # every ranges/m-th quantile of a key that holds m ranges
        within = {r["key"]: Counter(r["at"][::max(1, ranges // hot[r["key"]])]) for r in rows}
    by_hash, by_chance = F.lit(0), F.lit(0)
    for key, at in within.items():
        mine = F.col("key") == key
        by_hash = F.when(mine, _range_of(top, sorted(at))).otherwise(by_hash)
        for h, m in at.items():
            if m > 1:
                by_chance = F.when(mine & (top == h), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(m))
                                   .cast("int")).otherwise(by_chance)
    # a hot key is the least of its range
    return docs.withColumn("range", F.struct(
        _range_of(F.col("key"), bounds).cast("int").alias("a"), (~F.col("key").isin(list(hot))).cast("int").alias("above"),
        by_hash.cast("int").alias("b"), by_chance.alias("c")))


def with_next(docs: DataFrame, steps: list[tuple[str, Column]], carried: list[str]) -> DataFrame:
    """``docs`` (doc_id, text) with the columns that ``steps`` add, and
    ``next_<c>`` for text and every column ``carried``: those of the next row
    by descending doc_id; the last row's next is the first.

    Every range (``ranged``) is one window. The first row of the following range
    is added to a range as its last, so no window sees more than its range."""
    docs = ranged(docs)
    heads = docs.groupBy("range").agg(F.max(F.struct("key", "h")).alias("head"))
    # one row per range: at most MOST_RANGES in all
    every = Window.orderBy(F.desc("range"))
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = heads.select("range", F.coalesce(F.lead("head").over(every), F.first("head").over(whole)).alias("follower"))
    follow = follow.select(F.col("range").alias("into"), F.col("follower.key").alias("key"), F.col("follower.h").alias("h"))
    ghosts = (docs.join(F.broadcast(follow), ["key", "h"]).dropDuplicates(["into"])
              .drop("range").withColumnRenamed("into", "range").withColumn("ghost", F.lit(True)))
    rows = docs.withColumn("ghost", F.lit(False)).unionByName(ghosts)
    rows = _add(rows, steps).select("ghost", "range", "key", "h", "doc_id", "text", *carried)
    order = Window.partitionBy("range").orderBy("ghost", F.desc("key"), F.desc("h"))
    for c in ["text", *carried]:
        rows = rows.withColumn(f"next_{c}", F.lead(c).over(order))
    return rows.where("not ghost").drop("ghost", "range", "key", "h")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next and where the trees of text and edited text differ:
    edit_paragraph (the first paragraph; 0: equal), edit_removed, edit_added
    (paragraphs), edit_opened (sections read)."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = with_next(d, fingerprint_steps("text", "own"), ["own_root", "own_sketch"])
    d = d.withColumnsRenamed({"next_own_root": "next_root", "next_own_sketch": "next_sketch"})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half),
                                        F.substring("next_text", F.lit(1), half))).drop("next_text")
    d = _add(d, [("own_tree", paragraphs(F.col("text"))), ("own_tree", tree(F.col("own_tree"))),
                 *fingerprint_steps("edited", "edited")])
    d = locate(d, "own_tree", "edited_tree", "edit")
    return d.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint("own").alias("fingerprint"), fingerprint("edited").alias("edited_fingerprint"),
        likeness("own", "edited").alias("near_edited"), likeness("own", "next").alias("near_next"),
        "edit_paragraph", "edit_removed", "edit_added", "edit_opened")
