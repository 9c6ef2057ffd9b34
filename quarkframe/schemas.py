"""Record schemas of the event data model (Spark DDL strings).

A particle ("candidate") is a struct; an event holds collections of them as
``array<struct>`` columns. The empty structs of the original records cannot be
stored in Parquet and are therefore absent from the stored schema; the
``strip`` operator removes them from in-memory data before writing.
"""

# Field names and types of the event records.
CANDIDATE = (
    "struct<qx3:int,pt:float,eta:float,phi:float,mass:float,"
    "vertex:struct<cs:struct<x:float,y:float,z:float>>,pdfId:int,status:int>"
)

COLLECTIONS = ["muons", "photons", "electrons", "jets", "met"]

# Stored nested event table: one row per event fragment. ``n_<collection>`` are
# whole-event sizes, so size cuts never need to look at other fragments.
EVENT_TABLE = ", ".join(
    ["evt bigint", "frag int", "n_frag int"]
    + [f"n_{c} int" for c in COLLECTIONS]
    + [f"{c} array<{CANDIDATE}>" for c in COLLECTIONS]
)

HISTOGRAM = "label string, bin int, lo double, hi double, n bigint"
