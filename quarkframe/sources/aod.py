"""Nested event files in the original layout.

Every collection is a branch struct holding an array of objects; the record
of an object sits two or three struct levels down, under names with ``::``, its
leaves carry a trailing underscore, and objects hold more than analyses keep
(``cache_``, ``key_``). Arrays are in stored order, which is not by pt.

The files are written once per input from the event store, one row per event
fragment, and read back with their own schema, so queries scan them as a user
scans event files. Stored order: eta, phi, pt, all descending.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..session import derived_path, path_exists, publish
from . import events as ev_src

AOD_VERSION = "v1"

# Paths of the collections' records in the original files.
AOD_PATHS = {
    "muons": "recoMuons_muons__RECO_.recoMuons_muons__RECO_obj.reco::RecoCandidate.reco::LeafCandidate",
    "photons": "recoPhotons_photons__RECO_.recoPhotons_photons__RECO_obj.reco::RecoCandidate.reco::LeafCandidate",
    "electrons": "recoGsfElectrons_gsfElectrons__RECO_.recoGsfElectrons_gsfElectrons__RECO_obj"
                 ".reco::RecoCandidate.reco::LeafCandidate",
    "jets": "recoPFJets_ak5PFJets__RECO_.recoPFJets_ak5PFJets__RECO_obj.reco::Jet.reco::CompositePtrCandidate"
            ".reco::LeafCandidate",
    "met": "recoMETs_htMetAK5__RECO_.recoMETs_htMetAK5__RECO_obj.reco::RecoCandidate.reco::LeafCandidate",
}


def _object(x: Column, levels: list[str]) -> Column:
    """One object: the record below its struct levels, beside fields that
    analyses drop."""
    record = F.struct(
        x["qx3"].alias("qx3_"), x["pt"].alias("pt_"), x["eta"].alias("eta_"), x["phi"].alias("phi_"),
        x["mass"].alias("mass_"), x["vertex"].alias("vertex_"), x["pdfId"].alias("pdfId_"),
        x["status"].alias("status_"), F.struct(x["pt"].alias("r_"), x["phi"].alias("p_")).alias("cache_"))
    for name in reversed(levels):
        record = F.struct(record.alias(name), F.lit(0).alias("key_"))
    return record


def _branch(coll: str) -> Column:
    branch, array, *levels = AOD_PATHS[coll].split(".")
    keyed = F.transform(coll, lambda x: F.struct(x["eta"].alias("e"), x["phi"].alias("p"), x["pt"].alias("q"),
                                                 x.alias("x")))
    stored = F.transform(F.sort_array(keyed, asc=False), lambda k: _object(k["x"], levels))
    return F.struct(stored.alias(array)).alias(branch)


def aod_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan of the original-layout files of ``sf_dir``, written on first use."""
    ev = ev_src.events(spark, sf_dir)
    rows = ev.select("evt", "frag", "n_frag", *[f"n_{c}" for c in schemas.COLLECTIONS],
                     *[_branch(c) for c in schemas.COLLECTIONS])
    path = derived_path(spark, "aod", f"{AOD_VERSION}-{ev_src.store_key(spark, sf_dir)}")
    if not path_exists(spark, path + "/_SUCCESS"):
        parent, name = path.rsplit("/", 1)
        tmp = f"{parent}/_building-{name}-{uuid.uuid4().hex[:12]}"
        rows.write.option("compression", "zstd").parquet(tmp)
        publish(spark, tmp, path)
    return spark.read.schema(rows.schema).parquet(path)


def lead(ev: DataFrame, want: dict[str, tuple[int, str, list[str], dict[str, str]]], keep: list[str]) -> DataFrame:
    """P10 in stored order: ``keep`` and, per collection, an array of its first
    k records, reduced to the named fields (only their leaves are read).

    ``want``: collection -> (k, path of its array of records, fields wanted,
    field -> path of its leaf in the record). Rows of unsplit events take the
    elements as they are stored. The first elements of all collections of a
    split event's fragments are merged together by the stored order (eta, phi,
    pt): the best k of each (event, collection), then one row per event."""
    from ..operators.nested import leaf

    order = ["eta", "phi", "pt"]

    def first(c: str, fields: list[str]) -> Column:
        k, path, _, leaves = want[c]
        return F.slice(F.arrays_zip(*[leaf(path, leaves[f]).alias(f) for f in fields]), 1, k)

    fast = ev.where("n_frag = 1").select(*keep, *[first(c, fields).alias(c) for c, (_, _, fields, _) in want.items()])
    rest = sorted({f for _, _, fields, _ in want.values() for f in fields} - set(order))
    kinds = {f: t for c in want for f, t in _leaf_types(ev, want[c])}

    def tagged(i: int, leaves: dict[str, str]):  # noqa: ANN202
        value = lambda x, f: x[f] if f in leaves else F.lit(None).cast(kinds[f])
        return lambda x: F.struct(F.lit(i).alias("c"),
                                  F.struct(*[value(x, f).alias(f) for f in order + rest]).alias("x"))

    # one list of (collection, element) per fragment, and an entry for the event itself
    items = [F.transform(first(c, [f for f in order + rest if f in leaves]), tagged(i, leaves))
             for i, (c, (_, _, _, leaves)) in enumerate(want.items())]
    element = "struct<" + ",".join(f"{f}:{kinds[f]}" for f in order + rest) + ">"
    itself = F.array(F.struct(F.lit(-1).alias("c"), F.lit(None).cast(element).alias("x")))
    split = ev.where("n_frag > 1").select(*keep, F.explode(F.concat(itself, *items)).alias("i")).select(*keep, "i.*")
    by = Window.partitionBy(*keep, "c").orderBy(F.desc("x"))
    most = max(k for k, _, _, _ in want.values())
    best = (split.withColumn("r", F.row_number().over(by)).where(F.col("r") <= most)
            .groupBy(*keep).agg(F.sort_array(F.collect_list(F.struct("c", "x")), asc=False).alias("all")))

    def of(i: int):  # noqa: ANN202
        return lambda e: e["c"] == i

    def only(fields: list[str]):  # noqa: ANN202
        return lambda e: F.struct(*[e["x"][f].alias(f) for f in fields])

    cut = [F.slice(F.transform(F.filter("all", of(i)), only(fields)), 1, k).alias(c)
           for i, (c, (k, _, fields, _)) in enumerate(want.items())]
    return fast.unionByName(best.select(*keep, *cut))


def _leaf_types(ev: DataFrame, spec: tuple) -> list[tuple[str, str]]:
    from ..operators.nested import leaf

    _, path, _, leaves = spec
    got = ev.select(*[leaf(path, p).alias(f) for f, p in leaves.items()]).schema
    return [(f.name, f.dataType.elementType.simpleString()) for f in got.fields]
