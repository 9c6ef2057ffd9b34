"""P4 + S1: event files of the two lead-object examples, in their own layouts.

* Higgs files: ``muons`` and ``electrons``, whose kinematics lie one struct
  deeper, in ``baseTrack``, among identification flags, isolation sums and
  arrays of booleans. Tracks hold an empty struct ``obj``, which Parquet cannot
  store: the stored schema is the record schema with every empty struct removed,
  at any depth (``operators.nested.drop_empty``).
* Bacon files: ``GenParticle`` and ``Photon`` in one event.

The files are written once per input from the event store, a row per event
fragment, and read with their own schema; a query reads the leaves it names.
Stored order: eta, phi, pt, all descending.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.nested import drop_empty
from ..session import derived_path, path_exists, publish
from . import events as ev_src

NTUPLE_VERSION = "v1"

# Field names and types of the records.
TRACK = "struct<obj:struct<>,charge:int,pt:float,pterr:float,eta:float,phi:float>"
ELECTRON = (f"struct<baseTrack:{TRACK},ids:array<boolean>,sumChargedHadronPt:float,sumNeutralHadronEt:float,"
            "sumPhotonEt:float,sumPUPt:float,sumChargedParticlePt:float,dz:double,isPF:boolean,convVeto:boolean>")
MUON = (f"struct<baseTrack:{TRACK},isTracker:boolean,isStandAlone:boolean,isGlobal:boolean,isTight:boolean,"
        "isMedium:boolean,isLoose:boolean,isPF:boolean,normChi2:float,d0BS:float,dzBS:float,d0PV:float,dzPV:float,"
        "nPLs:int,nTLs:int,nSLs:int,vfrTrk:float,nvMHIts:int,nvPHits:int,nvTHits:int,nvSHits:int,nSegMts:int,"
        "nMtsStatios:int,trackIsoSumPt:float,trackIsoSumPtCorr:float,hIso:float,eIso:float,relCombIso:float,"
        f"track:{TRACK},segmentCompatiblity:float,combinedQChi2:float,combinedQTrkK:float,isHLTMatched:array<boolean>,"
        "sumChargedHadronPt:float,sumChargedParticlePt:float,sumNeutralHadronEt:float,sumPhotonEt:float,sumPUPt:float,"
        "sumChargedHadronPtR04:float,sumChargedParticlePtR04:float,sumNeutralHadronEtR04:float,sumPhotonEtR04:float,"
        "sumPUPtR04:float>")
PHOTON = ("struct<pt:float,eta:float,phi:float,scEt:float,scEta:float,scPhi:float,trkIso:float,ecalIso:float,"
          "hcalIso:float,chHadIso:float,gammaIso:float,neuHadIso:float,mva:float,hovere:float,sthovere:float,sieie:float,"
          "sipip:float,r9:float,fiducialBits:int,typeBits:int,scID:int,hasPixelSeed:boolean,passElectronVeto:boolean,"
          "isConv:boolean,hltMatchBits:array<boolean>>")
GEN_PARTICLE = "struct<parent:int,pdfId:int,status:int,pt:float,eta:float,phi:float,mass:float,y:float>"

#: Files: columns, their record and the collection of the event store they are made from.
LAYOUTS = {
    "higgs": {"muons": (MUON, "muons"), "electrons": (ELECTRON, "electrons")},
    "bacon": {"GenParticle": (GEN_PARTICLE, "muons"), "Photon": (PHOTON, "photons")},
}

# Leaves that the event store has; any other is made of its type (see ``_made``).
_FROM = {"charge": "qx3", "pt": "pt", "eta": "eta", "phi": "phi", "mass": "mass", "pdfId": "pdfId", "status": "status",
         "dz": "vertex.cs.z", "scEt": "pt", "scEta": "eta", "scPhi": "phi"}


def _made(x: Column, name: str, kind) -> Column:  # noqa: ANN001
    """The value of one leaf for particle ``x``: as the store has it, or, by its
    type, the vertex, the charge, the sign of eta."""
    if isinstance(kind, StructType):
        return F.struct(*[_made(x, f.name, f.dataType).alias(f.name) for f in kind.fields])
    if name in _FROM:
        value = x
        for part in _FROM[name].split("."):
            value = value[part]
        return value.cast(kind)
    simple = kind.simpleString()
    if simple == "array<boolean>":
        return F.array(x["qx3"] > 0, x["eta"] > 0)
    return {"boolean": x["eta"] > 0, "int": x["qx3"]}.get(simple, x["vertex"]["cs"]["x"]).cast(kind)


def _maker(record: StructType):  # noqa: ANN202
    return lambda k: _made(k["x"], "", record)


def records(ev: DataFrame, layout: str) -> DataFrame:
    """The events of the store with the records of a layout, empty structs included."""
    keep = ["evt", "frag", "n_frag"]
    cols = []
    for name, (ddl, coll) in LAYOUTS[layout].items():
        record = StructType.fromDDL(f"r {ddl}")["r"].dataType
        keyed = F.transform(coll, lambda x: F.struct(x["eta"].alias("e"), x["phi"].alias("p"), x["pt"].alias("q"),
                                                     x.alias("x")))
        keep.append(f"n_{coll}")
        cols.append(F.transform(F.sort_array(keyed, asc=False), _maker(record)).alias(name))
    return ev.select(*keep, *cols)


def ntuple_events(spark: SparkSession, sf_dir: str, layout: str) -> DataFrame:
    """Scan of the files of ``layout`` for ``sf_dir``, written on first use."""
    rows = drop_empty(records(ev_src.events(spark, sf_dir), layout))
    path = derived_path(spark, layout, f"{NTUPLE_VERSION}-{ev_src.store_key(spark, sf_dir)}")
    if not path_exists(spark, path + "/_SUCCESS"):
        parent, name = path.rsplit("/", 1)
        tmp = f"{parent}/_building-{name}-{uuid.uuid4().hex[:12]}"
        rows.write.option("compression", "zstd").parquet(tmp)
        publish(spark, tmp, path)
    return spark.read.schema(rows.schema).parquet(path)
