"""The benchmark query groups B1-B6 over the nested event store.

Each query is ``(spark, sf_dir) -> DataFrame``; the caller runs the action.
Actions the reference performs for effect only (``foreach``) return the
computed rows here, so they can be checked; ``sources.sinks.run_for_effect``
runs any of them through the no-op sink.

B3 note: the reference names its zipped (pt, eta, phi) columns
(pt_, phi_, eta_), so its "eta_ < 0" filter really cuts on phi. Here the
columns carry their true names and the filters mean what they say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.histogram import Bin
from ..functions.rounding import round_to
from ..operators import aggregate as A
from ..operators import nested as N
from ..operators import pairs as P
from ..operators.histogram import fill_bundle
from ..sources.events import events

# Histogram ranges of the benchmark bundles.
CANDIDATE_BINS = [
    Bin("pt", 200, 0.0, 200.0, "pt"),
    Bin("eta", 48, -2.4, 2.4, "eta"),
    Bin("phi", 63, -3.15, 3.15, "phi"),
]
PAIR_BINS = [
    Bin("pt", 200, 0.0, 200.0, "pt"),
    Bin("eta", 48, -2.4, 2.4, "eta"),
    Bin("phi", 63, -3.15, 3.15, "phi"),
    Bin("mass", 200, 0.0, 200.0, "mass2"),
]
# Wider mass^2 range: at the fixture's momentum scale most pair masses
# overflow [0, 200), so this exercises the regular bins of the same operator.
PAIR_MASS2_WIDE = Bin("mass", 200, 0.0, 20000.0, "mass2")


def _ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir)


# ------------------------------------------------------------------- B1 / B2

def b1_count_events(spark, sf_dir):
    return A.count_events(_ev(spark, sf_dir))


def b2_count_pt(spark, sf_dir):
    return A.count_rows(N.flatten_leaf(_ev(spark, sf_dir), "muons", "pt"), "n_pt")


def b2_sum_pt_lt10(spark, sf_dir):
    pt = N.flatten_leaf(_ev(spark, sf_dir), "muons", "pt").where("pt < 10")
    return A.sums(pt, ["pt"])


# ---------------------------------------------------------------------- B3

def _pt_eta_phi(spark, sf_dir):
    return N.zip_flatten(_ev(spark, sf_dir), "muons", ["pt", "eta", "phi"])


def _pt_phi(spark, sf_dir):
    return N.zip_flatten(_ev(spark, sf_dir), "muons", ["pt", "phi"])


def b3_sum_triple_eta_neg(spark, sf_dir):
    return A.sums(_pt_eta_phi(spark, sf_dir).where("eta < 0"), ["pt", "eta", "phi"])


def b3_sum_triple_phi_pos(spark, sf_dir):
    return A.sums(_pt_eta_phi(spark, sf_dir).where("phi > 0"), ["pt", "eta", "phi"])


def b3_sum_sqrt_pt(spark, sf_dir):
    s = _pt_phi(spark, sf_dir).where("phi > 0").select(F.sqrt("pt").alias("sqrt_pt"))
    return A.sums(s, ["sqrt_pt"])


def b3_describe_sqrt_pt(spark, sf_dir):
    s = _pt_phi(spark, sf_dir).where("phi > 0").select(F.sqrt("pt").alias("something"))
    return A.describe(s, "something")


# ---------------------------------------------------------------------- B4

def b4_count_events(spark, sf_dir):
    return A.count_events(_ev(spark, sf_dir))


def b4_count_n_gt2(spark, sf_dir):
    return A.count_events(N.cut_size(_ev(spark, sf_dir), "muons", ">", 2))


def b4_count_n_eq1(spark, sf_dir):
    return A.count_events(N.cut_size(_ev(spark, sf_dir), "muons", "==", 1))


def b4_count_n_eq2(spark, sf_dir):
    return A.count_events(N.cut_size(_ev(spark, sf_dir), "muons", "==", 2))


def b4_size_histogram(spark, sf_dir):
    return A.size_histogram(_ev(spark, sf_dir), "muons")


def b4_sum_of_group_counts(spark, sf_dir):
    return A.sum_of_group_counts(A.size_histogram(_ev(spark, sf_dir), "muons"))


_PT_SQ = "CAST(pt AS DOUBLE) * CAST(pt AS DOUBLE)"


def _muons_of_pairs_events(spark, sf_dir, fields):
    """The named leaves of the muons of size-2 events: only these are read."""
    ev = N.cut_size(_ev(spark, sf_dir), "muons", "==", 2)
    return N.zip_flatten(ev, "muons", fields, keep=["evt"])


def b4_count_particles_eq2(spark, sf_dir):
    return A.count_rows(N.flatten_leaf(N.cut_size(_ev(spark, sf_dir), "muons", "==", 2), "muons", "pt"),
                        "n_particles")


def b4_max_pt_particle(spark, sf_dir):
    fields = ["qx3", "pt", "eta", "phi", "mass", "pdfId", "status"]
    x = _muons_of_pairs_events(spark, sf_dir, fields)
    return A.argmax(x, F.struct("evt", *fields), [F.col(c) for c in ("pt", "eta", "phi", "evt")])


def b4_foreach_eq2(spark, sf_dir):
    """B4.Q7: the per-particle computation the reference runs for effect."""
    return _muons_of_pairs_events(spark, sf_dir, ["pt"]).select("evt", "pt", round_to(_PT_SQ, 4).alias("pt_sq"))


def b4_cut_particles(spark, sf_dir):
    """B4.Q8: element cut ``pt > 10 && eta < 2.4`` inside size-2 events."""
    x = _muons_of_pairs_events(spark, sf_dir, ["pt", "eta"]).where((F.col("pt") > 10.0) & (F.col("eta") < 2.4))
    return x.select("evt", "pt", "eta", round_to(_PT_SQ, 4).alias("pt_sq"))


def _top2_pairs(spark, sf_dir):
    ev = N.cut_size(_ev(spark, sf_dir), "muons", ">=", 2)
    return P.top2_pair(ev, "muons").select("evt", "pair", *P.pair_columns("pair"))


def b4_max_pair_mass2(spark, sf_dir):
    """B4.Q9: largest mass^2 of the leading-two-muon pair over all events."""
    return _top2_pairs(spark, sf_dir).agg(F.max("mass2").alias("m")).select(round_to("m", 4).alias("max_mass2"))


def b4_top2_pair_products(spark, sf_dir):
    """B4.Q10: per event leading pair and the product mass^2 * e."""
    t = _top2_pairs(spark, sf_dir)
    return t.select("evt", round_to("pair.e", 4).alias("e"), round_to("mass2", 4).alias("mass2"),
                    round_to("mass2 * pair.e", 2).alias("mass_e"))


# ---------------------------------------------------------------------- B5/B6

def b5_count_events(spark, sf_dir):
    return A.count_events(_ev(spark, sf_dir))


def b5_count_eq2(spark, sf_dir):
    return b4_count_n_eq2(spark, sf_dir)


def b5_group_count_sum(spark, sf_dir):
    """B5.Q2: the reference shuffles every event to group by size; here a
    partial/final count per size, then the total."""
    return b4_sum_of_group_counts(spark, sf_dir)


def _muon_bundle(spark, sf_dir, op, k):
    ev = N.cut_size(_ev(spark, sf_dir), "muons", op, k)
    x = N.zip_flatten(ev, "muons", ["pt", "eta", "phi"])
    return fill_bundle(x, CANDIDATE_BINS)


def b5_muon_bundle_gt0(spark, sf_dir):
    return _muon_bundle(spark, sf_dir, ">", 0)


def b5_muon_bundle_eq2(spark, sf_dir):
    return _muon_bundle(spark, sf_dir, "==", 2)


def _pairs(spark, sf_dir):
    """All ordered pairs (self included) of events with >= 2 muons, as the
    symmetric half with weights 1 (diagonal) / 2 (off-diagonal)."""
    ev = N.cut_size(_ev(spark, sf_dir), "muons", ">=", 2)
    return P.symmetric_pairs(ev, "muons").select("w", *P.pair_columns("pair"))


def b5_pair_bundle(spark, sf_dir):
    return fill_bundle(_pairs(spark, sf_dir), PAIR_BINS, weight="w")


def b6_muon_bundle(spark, sf_dir):
    return _muon_bundle(spark, sf_dir, ">", 0)


def b6_pair_bundle(spark, sf_dir):
    return fill_bundle(_pairs(spark, sf_dir), PAIR_BINS, weight="w")


def pair_mass2_wide(spark, sf_dir):
    return fill_bundle(_pairs(spark, sf_dir), [PAIR_MASS2_WIDE], weight="w")


QUERIES = {
    "b1_count_events": b1_count_events,
    "b2_count_pt": b2_count_pt,
    "b2_sum_pt_lt10": b2_sum_pt_lt10,
    "b3_sum_triple_eta_neg": b3_sum_triple_eta_neg,
    "b3_sum_triple_phi_pos": b3_sum_triple_phi_pos,
    "b3_sum_sqrt_pt": b3_sum_sqrt_pt,
    "b3_describe_sqrt_pt": b3_describe_sqrt_pt,
    "b4_count_events": b4_count_events,
    "b4_count_n_gt2": b4_count_n_gt2,
    "b4_count_n_eq1": b4_count_n_eq1,
    "b4_count_n_eq2": b4_count_n_eq2,
    "b4_size_histogram": b4_size_histogram,
    "b4_sum_of_group_counts": b4_sum_of_group_counts,
    "b4_count_particles_eq2": b4_count_particles_eq2,
    "b4_max_pt_particle": b4_max_pt_particle,
    "b4_foreach_eq2": b4_foreach_eq2,
    "b4_cut_particles": b4_cut_particles,
    "b4_max_pair_mass2": b4_max_pair_mass2,
    "b4_top2_pair_products": b4_top2_pair_products,
    "b5_count_events": b5_count_events,
    "b5_count_eq2": b5_count_eq2,
    "b5_group_count_sum": b5_group_count_sum,
    "b5_muon_bundle_gt0": b5_muon_bundle_gt0,
    "b5_muon_bundle_eq2": b5_muon_bundle_eq2,
    "b5_pair_bundle": b5_pair_bundle,
    "b6_muon_bundle": b6_muon_bundle,
    "b6_pair_bundle": b6_pair_bundle,
    "pair_mass2_wide": pair_mass2_wide,
}
