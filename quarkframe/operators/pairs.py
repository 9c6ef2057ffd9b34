"""Pairings inside an event (J1-J3) and whole-event leading objects (P10).

An event is a row (or, for a split hot event, a few fragment rows of bounded
size). Pairing never crosses events, so no operator here joins events with
each other.

* Fast path, ``n_frag == 1`` (every ordinary event): pairs and top-k are row
  local -- two ``posexplode`` generators, or a sort of a small array -- with
  no shuffle at all.
* Hot path, ``n_frag > 1``: every fragment is repeated for each block
  (fa, fb) it takes part in, and fragments are joined on (evt, fa, fb), one
  row per block with two bounded arrays. No exchange is keyed by the event
  alone, so the ``n_frag^2`` blocks of a huge event spread over all tasks.
  Top-k merges use a
  ``row_number() <= k`` window, which Spark plans with a partial
  ``WindowGroupLimit`` before the shuffle (at most k rows per event and map
  task cross the network).
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kinematics as K
from .nested import leaf


def _is_store(df: DataFrame) -> bool:
    return "n_frag" in df.columns


def legs(coll: str) -> Column:
    """``array<struct<pt, eta, phi>>`` of a collection (three leaves only)."""
    return F.arrays_zip(leaf(coll, "pt").alias("pt"), leaf(coll, "eta").alias("eta"),
                        leaf(coll, "phi").alias("phi"))


def _explode_pairs(df: DataFrame, keep: Sequence[str], va: str, vb: str,
                   fa: Column, fb: Column, unordered: bool, mass: float) -> DataFrame:
    # Two generators in a row; the four-vectors of both legs are computed in
    # the generated code of the projection that follows (no lambda, which
    # Spark would interpret row by row).
    a = df.select(*keep, fa.alias("fa"), fb.alias("fb"), vb, F.posexplode(va).alias("i", "a"))
    p = a.select(*keep, "fa", "fb", "i", "a", F.posexplode(vb).alias("j", "b"))
    if unordered:
        p = p.where(F.struct("fa", "i") < F.struct("fb", "j"))
    return p.select(*keep, "fa", "i", "fb", "j", _pair_sum(mass).alias("pair"))


def _pair_sum(mass: float, a: str = "a", b: str = "b") -> Column:
    """Pair record of the (pt, eta, phi) structs ``a`` and ``b``."""
    return K.pair_record(K.p4_sql(f"{a}.pt", f"{a}.eta", f"{a}.phi", mass),
                         K.p4_sql(f"{b}.pt", f"{b}.eta", f"{b}.phi", mass))


def _split(ev: DataFrame, keep: Sequence[str], z: Column) -> DataFrame:
    """Fragments of split events: ``keep``, evt, frag, n_frag and legs ``z``."""
    return ev.where(F.col("n_frag") > 1).select(
        *keep, *[c for c in ("evt",) if c not in keep], "frag", "n_frag", z.alias("z"))


def _blocks(hot: DataFrame, keep: Sequence[str], upper: bool) -> DataFrame:
    """One row per block (fa, fb) of fragments of a split event, with both
    fragments' legs ``va`` and ``vb``; ``upper``: only fa < fb."""
    last = F.col("n_frag") - 1
    others = F.explode(F.sequence(F.col("frag") + 1, last) if upper else F.sequence(F.lit(0), last))
    left = (hot.where(F.col("frag") < last) if upper else hot).select(
        *keep, F.col("evt").alias("_evt"), F.col("frag").alias("fa"), others.alias("fb"), F.col("z").alias("va"))
    others = F.explode(F.sequence(F.lit(0), F.col("frag") - 1) if upper else F.sequence(F.lit(0), last))
    right = (hot.where(F.col("frag") > 0) if upper else hot).select(
        F.col("evt").alias("_evt"), others.alias("fa"), F.col("frag").alias("fb"), F.col("z").alias("vb"))
    return left.join(right, ["_evt", "fa", "fb"]).drop("_evt")


def ordered_pairs(ev: DataFrame, coll: str = "muons", keep: Sequence[str] = ("evt",),
                  unordered: bool = False, mass: float = K.MUON_MASS) -> DataFrame:
    """Every ordered pair (i, j) of a collection inside each event.

    Default is the reference semantics: *ordered* pairs with ``i == j``
    included, so an event of n elements gives n^2 pairs. ``unordered=True``
    gives the n(n-1)/2 pairs with i < j. Output: ``keep`` columns, pair
    coordinates ``(fa, i, fb, j)`` (fragment, position) and ``pair`` =
    struct(e, px, py, pz).
    """
    keep = list(keep)
    z = legs(coll)
    if not _is_store(ev):
        base = ev.select(*keep, z.alias("z"))
        return _explode_pairs(base, keep, "z", "z", F.lit(0), F.lit(0), unordered, mass)

    single = ev.where(F.col("n_frag") == 1).select(*keep, z.alias("z"))
    fast = _explode_pairs(single, keep, "z", "z", F.lit(0), F.lit(0), unordered, mass)

    slow = _explode_pairs(_blocks(_split(ev, keep, z), keep, False), keep, "va", "vb",
                          F.col("fa"), F.col("fb"), unordered, mass)
    return fast.unionByName(slow)


def symmetric_pairs(ev: DataFrame, coll: str = "muons", keep: Sequence[str] = ("evt",),
                    mass: float = K.MUON_MASS) -> DataFrame:
    """J1 for symmetric uses: the pairs i <= j with a weight ``w``.

    The pair sum is symmetric (``a + b == b + a`` exactly in IEEE
    arithmetic), so any function of it over all n^2 ordered pairs equals the
    weighted sum over i <= j with ``w = 1`` on the diagonal and ``w = 2``
    off it. Histograms of pair quantities use this: half the pairs are
    generated and evaluated, with identical counts.

    Every row (ordinary event or fragment) pairs its own elements; fragments
    of a split event are additionally paired across fragments (fa < fb),
    one block (fa, fb) per row.
    """
    keep = list(keep)
    z = legs(coll)
    base = ev.select(*keep, z.alias("z"))
    a = base.select(*keep, "z", F.posexplode("z").alias("i", "a"))
    tail = F.slice("z", F.col("i") + 1, F.size("z") - F.col("i"))
    p = a.select(*keep, "a", F.posexplode(tail).alias("d", "b"))
    w = F.when(F.col("d") == 0, F.lit(1)).otherwise(F.lit(2))
    intra = p.select(*keep, _pair_sum(mass).alias("pair"), w.alias("w"))
    if not _is_store(ev):
        return intra

    c = _explode_pairs(_blocks(_split(ev, keep, z), keep, True), keep, "va", "vb", F.col("fa"), F.col("fb"), False, mass)
    return intra.unionByName(c.select(*keep, "pair", F.lit(2).alias("w")))


def _zip_sorted(coll: str, fields: Sequence[str]) -> Column:
    """Array of struct(fields...) sorted descending; ``fields[0]`` is the key."""
    z = F.arrays_zip(*[leaf(coll, f).alias(f) for f in fields])
    return F.sort_array(z, asc=False)


def event_top_k(ev: DataFrame, colls: Mapping[str, int], fields: Sequence[str] = ("pt", "eta", "phi"),
                keep: Sequence[str] = ("evt",)) -> DataFrame:
    """Whole-event top-k elements by ``fields[0]`` (descending) per collection.

    Returns ``keep`` + one column per collection: ``array<struct<fields>>`` of
    at most k elements (fewer when the event has fewer). Ties on the key are
    broken by the remaining fields, so the result is deterministic.
    """
    keep = list(keep)
    fields = list(fields)
    tops = {c: F.slice(_zip_sorted(c, fields), 1, k) for c, k in colls.items()}
    if not _is_store(ev):
        return ev.select(*keep, *[t.alias(c) for c, t in tops.items()])

    fast = ev.where(F.col("n_frag") == 1).select(*keep, *[t.alias(c) for c, t in tops.items()])

    hot = ev.where(F.col("n_frag") > 1)
    merged = None
    for c, k in colls.items():
        cand = hot.select("evt", F.explode(tops[c]).alias("x"))
        w = Window.partitionBy("evt").orderBy(F.col("x").desc())
        best = (cand.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
                .groupBy("evt").agg(F.slice(F.sort_array(F.collect_list("x"), asc=False), 1, k).alias(c)))
        merged = best if merged is None else merged.join(best, "evt", "full_outer")
    events = hot.where(F.col("frag") == 0).select(*keep)
    empty = {c: F.slice(_zip_sorted(c, fields), 1, 0) for c in colls}  # typed empty array
    slow = events.join(merged, "evt", "left").select(
        *keep, *[F.coalesce(F.col(c), F.array().cast(hot.select(empty[c]).schema[0].dataType)).alias(c)
                 for c in colls])
    return fast.unionByName(slow)


def top2_pair(ev: DataFrame, coll: str = "muons", keep: Sequence[str] = ("evt",),
              mass: float = K.MUON_MASS) -> DataFrame:
    """Pair of the two highest-pt elements (events with >= 2 elements).

    Sorting uses the raw ``pt``; the four-vector uses ``abs(pt)``, as the
    reference does.
    """
    t = event_top_k(ev, {coll: 2}, ("pt", "eta", "phi"), keep)
    return (t.where(F.size(coll) >= 2)
            .select(*keep, _pair_sum(mass, f"get({coll}, 0)", f"get({coll}, 1)").alias("pair")))


def pair_columns(pair: str = "pair") -> list[Column]:
    """Derived pair quantities (M2-M5) as named columns."""
    p = pair
    return [K.pair_mass2(p).alias("mass2"), K.pair_pt(p).alias("pt"),
            K.pair_phi(p).alias("phi"), K.pair_eta(p).alias("eta")]
