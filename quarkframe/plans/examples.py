"""The example jobs: pair reduction, five-collection strip, Higgs and photon
lead-object bundles, and the nested-path ingest (P1-P3).

Each is ``(spark, sf_dir) -> DataFrame`` over the nested event store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import kinematics as K
from ..functions.histogram import Bin
from ..functions.rounding import round_to
from ..operators import aggregate as A
from ..operators import nested as N
from ..operators import pairs as P
from ..operators.histogram import densify, fill_bundle, merge_histograms
from ..sources import sinks
from ..sources.aod import AOD_PATHS, aod_events, lead
from ..sources.events import events
from ..sources.ntuples import ntuple_events
from .benchmark import CANDIDATE_BINS, PAIR_BINS, b6_muon_bundle

# Histogram ranges of the Higgs and photon examples.
HIGGS_RANGES = {
    "electron_pt": (200, 0.0, 200.0),
    "muon_pt": (200, 0.0, 200.0),
    "dimuon_mass": (200, 0.0, 200.0),
    "muon_phi": (200, -3.15, 3.15),
    "muon_eta": (200, -2.5, 2.5),
}
PHOTON_RANGES = {
    "pt": (200, 0.0, 200.0),
    "phi": (200, -3.15, 3.15),
    "eta": (200, -2.5, 2.5),
}


# ------------------------------------------------------------------ reduction

def reduction_pairs(spark, sf_dir):
    """All ordered muon pairs (self included) of events with >= 2 muons."""
    ev = N.cut_size(events(spark, sf_dir), "muons", ">=", 2)
    p = P.ordered_pairs(ev, "muons").select("evt", "pair", *P.pair_columns("pair"))
    return p.select("evt", *[round_to(f"pair.{c}", 4).alias(c) for c in ("e", "px", "py", "pz")],
                    *[round_to(c, 4).alias(c) for c in ("mass2", "pt", "phi", "eta")])


def reduced_pair_table(ev: DataFrame) -> DataFrame:
    """The reduction job's stored rows: pair components as float."""
    p = P.ordered_pairs(N.cut_size(ev, "muons", ">=", 2), "muons")
    return p.select("pair.e", "pair.px", "pair.py", "pair.pz")


def reduction_job(spark, sf_dir, out: str | None = None):
    """The reduction example end to end: pairs of events with >= 2 muons are
    written once as Parquet (e, px, py, pz as float, S2); the pair bundle is
    then filled from the written table, whose derived quantities are
    recomputed from the stored components. Writing first and reading back
    replaces the reference's three recomputations of the pair dataset."""
    out = out or sinks.fresh_output(spark, "reduced_pairs")
    sinks.write_parquet(reduced_pair_table(events(spark, sf_dir)), out)
    stored = spark.read.schema("e float, px float, py float, pz float").parquet(out)
    return fill_bundle(stored.select(F.struct("e", "px", "py", "pz").alias("pair")).select(*P.pair_columns("pair")), PAIR_BINS)


# ---------------------------------------------------------------------- strip

def stripped_events(aod: DataFrame) -> DataFrame:
    """Events with >= 2 muons of the original-layout files; the
    five collections' records selected through their ``::`` paths, renamed,
    bound to the candidate record by position and stripped of what it lacks."""
    aod = N.cut_size(aod, "muons", ">=", 2)
    kept = ["evt", "frag", "n_frag", *[f"n_{c}" for c in schemas.COLLECTIONS]]
    raw = N.rename(N.select_paths(aod, *kept, *AOD_PATHS.values()), *kept, *AOD_PATHS)
    fields = [f.name for f in raw.schema["muons"].dataType.elementType.fields if f.name != "cache_"]
    bare = raw.select(*kept, *[N.strip(c, fields).alias(c) for c in AOD_PATHS])
    return bare.select(*kept, *[N.checked_bind(bare, c, f"array<{schemas.CANDIDATE}>").alias(c) for c in AOD_PATHS])


#: Leaves of the candidate record that the summary adds up.
_LEAVES = ["qx3", "pt", "eta", "phi", "mass", "vertex.cs.x", "vertex.cs.y", "vertex.cs.z", "pdfId", "status"]


def _event_summary(st: DataFrame) -> DataFrame:
    """Per event the sums of every kept leaf of the muons and of the other
    collections' pt; fragments of a split event are added up."""
    leaves = {f"sum_{x.rsplit('.', 1)[-1]}_muons": f"muons.{x}" for x in _LEAVES}
    leaves |= {f"sum_pt_{c}": f"{c}.pt" for c in schemas.COLLECTIONS if c != "muons"}
    rows = st.select("evt", "n_frag", *[f"n_{c}" for c in schemas.COLLECTIONS], *[
        F.aggregate(F.col(path), F.lit(0.0), lambda a, x: a + x.cast("double")).alias(k)
        for k, path in leaves.items()])
    out = [F.col(f"n_{c}") for c in schemas.COLLECTIONS]
    rounded = [round_to(s, 3).alias(s) for s in leaves]
    fast = rows.where(F.col("n_frag") == 1).select("evt", *out, *rounded)
    hot = (rows.where(F.col("n_frag") > 1)
           .groupBy("evt", *[f"n_{c}" for c in schemas.COLLECTIONS])
           .agg(*[F.sum(s).alias(s) for s in leaves])
           .select("evt", *out, *rounded))
    return fast.unionByName(hot)


def strip_events(spark, sf_dir):
    """Strip job (five collections), summarised per event for checking."""
    return _event_summary(stripped_events(aod_events(spark, sf_dir)))


def sink_parquet_roundtrip(spark, sf_dir):
    """Write the stripped events to a fresh folder, read them back."""
    st = stripped_events(aod_events(spark, sf_dir))
    path = sinks.write_parquet(st, sinks.fresh_output(spark, "stripped"))
    return _event_summary(spark.read.schema(st.schema).parquet(path))


def sink_hist_json(spark, sf_dir):
    """S3: write the muon bundle as JSON to a fresh folder, read it back."""
    path = sinks.write_histograms_json(b6_muon_bundle(spark, sf_dir), sinks.fresh_output(spark, "bundle"))
    return sinks.read_histograms_json(spark, path)


def hist_merge(spark, sf_dir):
    """A11 / A12 combined: muon bundles of two disjoint sets of events, each
    filled and written on its own (S3), merged and densified."""
    ev = events(spark, sf_dir)
    parts = []
    for k, half in enumerate((F.col("evt") % 2 == 0, F.col("evt") % 2 != 0)):
        filled = fill_bundle(N.flatten(ev.where(half), "muons"), CANDIDATE_BINS, "x")
        out = sinks.write_histograms_json(filled, sinks.fresh_output(spark, f"bundle-{k}"))
        parts.append(sinks.read_histograms_json(spark, out))
    return densify(merge_histograms(CANDIDATE_BINS, *parts), CANDIDATE_BINS)


def preview_pairs(spark, sf_dir):
    """Every reduced pair is evaluated (no-op sink), and the first 20
    by event and components are returned."""
    p = P.ordered_pairs(N.cut_size(events(spark, sf_dir), "muons", ">=", 2), "muons").select("evt", "pair.*")
    sinks.run_for_effect(p)
    first = sinks.first_rows(p, ["evt", "e", "px", "py", "pz"], 20)
    return first.select("evt", *[round_to(c, 4).alias(c) for c in ("e", "px", "py", "pz")])


# ----------------------------------------------------------------- lead objects

def higgs_lead_bundle(spark, sf_dir):
    """Higgs example: events with an electron; first electron/muon pt, the
    mass of the first two muons (reference formula) and first muon phi/eta,
    in stored order.

    Events with a single muon leave ``dimuon_mass`` unfilled (NULL). Files in
    the example's own layout, kinematics in ``baseTrack``."""
    ev = N.cut_size(ntuple_events(spark, sf_dir, "higgs"), "electrons", "!=", 0)
    track = {f: f"baseTrack.{f}" for f in ("pt", "eta", "phi")}
    t = lead(ev, {"muons": (2, "muons", ["pt", "eta", "phi"], track), "electrons": (1, "electrons", ["pt"], track)}, ["evt"])
    m0, e0 = N.element("muons", 0), N.element("electrons", 0)
    vals = {
        "electron_pt": e0["pt"],
        "muon_pt": m0["pt"],
        "dimuon_mass": K.higgs_dimuon_mass("get(muons, 0)", "get(muons, 1)"),
        "muon_phi": m0["phi"],
        "muon_eta": m0["eta"],
    }
    cols = t.select(*[v.alias(k) for k, v in vals.items()])
    return fill_bundle(cols, [Bin(k, *HIGGS_RANGES[k], k) for k in vals])


def photon_lead_bundle(spark, sf_dir):
    """Photon example: events with a photon; first photon pt/phi/eta, in
    stored order; files in the example's own layout, generated particles and
    photons in one event."""
    ev = N.cut_size(ntuple_events(spark, sf_dir, "bacon"), "photons", "!=", 0)
    t = lead(ev, {"photons": (1, "Photon", ["pt", "phi", "eta"], {f: f for f in ("pt", "phi", "eta")})}, ["evt"])
    g = N.element("photons", 0)
    cols = t.select(g["pt"].alias("pt"), g["phi"].alias("phi"), g["eta"].alias("eta"))
    return fill_bundle(cols, [Bin(k, *PHOTON_RANGES[k], k) for k in PHOTON_RANGES])


def lead_pair_mass(spark, sf_dir):
    """J2 + M6: per event the mass of the two muons of largest pt, by the Higgs
    example's formula and as the proper invariant mass."""
    ev = N.cut_size(events(spark, sf_dir), "muons", ">=", 2)
    t = P.event_top_k(ev, {"muons": 2}, ("pt", "eta", "phi"), keep=["evt"])
    a, b = "get(muons, 0)", "get(muons, 1)"
    return t.select("evt", K.higgs_dimuon_mass(a, b).alias("h"), K.invariant_mass(a, b).alias("m")).select(
        "evt", round_to("h", 4).alias("higgs_mass"), round_to("m", 6).alias("inv_mass"))


# ---------------------------------------------------------- nested-path ingest

def aod_path_sum_pt_lt10(spark, sf_dir):
    """P1 + P2 + B2.Q1: the pt leaf of the muon record through its ``::`` path
    (the only leaf that is read), flattened and renamed."""
    pt = N.select_paths(aod_events(spark, sf_dir), AOD_PATHS["muons"] + ".pt_")
    pt = N.rename(pt.select(F.explode(pt.columns[0])), "pt").where("pt < 10")
    return A.sums(pt, ["pt"])


QUERIES = {
    "reduction_pairs": reduction_pairs,
    "reduction_job": reduction_job,
    "strip_events": strip_events,
    "sink_parquet_roundtrip": sink_parquet_roundtrip,
    "sink_hist_json": sink_hist_json,
    "hist_merge": hist_merge,
    "preview_pairs": preview_pairs,
    "higgs_lead_bundle": higgs_lead_bundle,
    "photon_lead_bundle": photon_lead_bundle,
    "lead_pair_mass": lead_pair_mass,
    "aod_path_sum_pt_lt10": aod_path_sum_pt_lt10,
}
