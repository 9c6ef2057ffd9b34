"""The nested event store.

The reference reads events that are already nested (one row per collision,
collections as arrays of structs). The driver's tables are flat, so the store
is derived once from them and written as Parquet under the shared
``spark.checkpoint.dir``; queries then scan it with nested-column pruning,
exactly like the reference scans its event files.

Mapping (one event = one ``orders`` row, its particles = its ``lineitem``
rows; orders without lines become events with empty collections):

    pt      = l_extendedprice / 1000
    eta     = ((l_suppkey % 97) - 48) / 20 + 0.013
    phi     = ((l_partkey % 127) - 63) / 20 + 0.017
    qx3     = +1 if l_returnflag = 'A' else -1
    mass    = l_tax
    vertex  = (l_discount, l_tax, l_quantity)
    pdfId   = -13 * qx3, status = 1
    muons   = all lines; photons / electrons / jets / met = lines with
              l_suppkey % 4 = 0 / 1 / 2 / 3
    order   = pt descending inside every collection

Skew: a single event may hold a large share of all particles. No event is
ever collected into one row: an event of n particles has ``ceil(n / chunk)``
fragments (at least one), a particle's fragment being a hash of it; each
fragment is a row of the store (``frag``, ``n_frag``). A fragment that no
particle fell into is a row with empty collections. ``n_<collection>`` always
carries the whole-event size, so size cuts stay row-local. Operators that need
the whole event (leading objects, pairs) merge fragments with keyed
aggregation or a block join of fragments that only touches split events.

The build decides everything per event on narrow rows (``event_sizes``), and
particles cross exchanges keyed by (event, salt) and (event, fragment) only:
no window, join or exchange of particles is keyed by the event alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..session import delete_on_exit, derived_path, path_exists, publish, source_fingerprint

CHUNK = 4096                 # particles per fragment, about
MOST_SENT = 1_000_000        # split events whose fragment counts are sent to all tasks (16 bytes each)
SALTS = 64                   # parts of an event when its fragment count is joined to its particles
STORE_VERSION = "v8"
STORE_TAG = ""               # extra key part; set by a caller that wants its own store (bench)

_KIND_OF = {"photons": 0, "electrons": 1, "jets": 2, "met": 3}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def candidate(li: DataFrame | None = None) -> Column:
    """Candidate struct of one ``lineitem`` row (see module mapping)."""
    qx3 = F.when(F.col("l_returnflag") == "A", F.lit(1)).otherwise(F.lit(-1))
    return F.struct(
        qx3.alias("qx3"),
        (F.col("l_extendedprice") / F.lit(1000.0)).cast("float").alias("pt"),
        ((F.col("l_suppkey") % 97 - 48) / F.lit(20.0) + F.lit(0.013)).cast("float").alias("eta"),
        ((F.col("l_partkey") % 127 - 63) / F.lit(20.0) + F.lit(0.017)).cast("float").alias("phi"),
        F.col("l_tax").cast("float").alias("mass"),
        F.struct(F.struct(
            F.col("l_discount").cast("float").alias("x"),
            F.col("l_tax").cast("float").alias("y"),
            F.col("l_quantity").cast("float").alias("z"),
        ).alias("cs")).alias("vertex"),
        (F.lit(-13) * qx3).alias("pdfId"),
        F.lit(1).alias("status"),
    )


def particles(lineitem: DataFrame) -> DataFrame:
    """Flat particle rows ``(evt, kind, c)`` from ``lineitem``."""
    return lineitem.select(
        F.col("l_orderkey").alias("evt"),
        (F.col("l_suppkey") % 4).cast("int").alias("kind"),
        candidate().alias("c"),
    )


def _sorted_particles() -> Column:
    """One list per group of ``(k=pt, c, kind)``, sorted by pt descending.

    Callers shuffle by the group key first (``repartition``), so the whole
    collect runs after the exchange: a map-side partial ``collect_list``
    would build and sort object buffers for every key of a map task (the
    object hash aggregate falls back to sorting beyond 128 keys) only to
    ship the same particles."""
    item = F.struct(F.col("c.pt").alias("k"), F.col("c").alias("c"), F.col("kind").alias("kind"))
    return F.sort_array(F.collect_list(item), asc=False).alias("s")


def _of_kind(k: int):
    return lambda x: x["kind"] == F.lit(k)


def _collections(grouped: DataFrame, keys: list[str]) -> DataFrame:
    """Split the sorted particle list into the five collections. Filtering a
    sorted list keeps its order, so one collect and one sort serve all five."""
    return grouped.select(
        *keys,
        F.transform("s", lambda x: x["c"]).alias("muons"),
        *[F.transform(F.filter("s", _of_kind(k)), lambda x: x["c"]).alias(c) for c, k in _KIND_OF.items()])


def event_sizes(orders: DataFrame, lineitem: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One narrow row per event: evt, n_frag and the sizes of its collections.

    The particle counts are partially aggregated, so a hot event costs one row
    per map task; the join with ``orders`` drops particles without an event and
    keeps events without particles."""
    size_cols = [F.count(F.lit(1)).cast("int").alias("n_muons")] + [
        F.count_if(F.col("kind") == k).cast("int").alias(f"n_{c}") for c, k in _KIND_OF.items()
    ]
    sizes = particles(lineitem).drop("c").groupBy("evt").agg(*size_cols)
    ev = orders.select(F.col("o_orderkey").alias("evt")).join(sizes, "evt", "left")
    n = [F.coalesce(f"n_{c}", F.lit(0)).alias(f"n_{c}") for c in schemas.COLLECTIONS]
    return ev.select("evt", *n).withColumn(
        "n_frag", F.greatest(F.ceil(F.col("n_muons") / F.lit(chunk)), F.lit(1)).cast("int"))


def build_event_table(sizes: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Nested event fragments from ``event_sizes`` (a written table, read
    several times here) and the particles."""
    # fragment counts of split events: at most ``MOST_SENT`` rows are sent to the
    # tasks, so that particles cross one exchange; more are repeated per salt and
    # joined on (evt, salt)
    split = sizes.where("n_frag > 1").select("evt", "n_frag")
    h = F.xxhash64("c")
    rows = particles(lineitem)
    if split.limit(MOST_SENT + 1).count() <= MOST_SENT:
        met = rows.join(F.broadcast(split), "evt", "left")
    else:
        salted = split.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("salt", F.pmod(h, F.lit(SALTS)).cast("int")).join(salted, ["evt", "salt"], "left")
    parts = (met
             .withColumn("frag", F.pmod(F.shiftrightunsigned(h, 8), F.coalesce("n_frag", F.lit(1))).cast("int")))
    frags = _collections(parts.select("evt", "frag", "kind", "c").repartition("evt", "frag")
                         .groupBy("evt", "frag").agg(_sorted_particles()), ["evt", "frag"])
    every = sizes.withColumn("frag", F.explode(F.sequence(F.lit(0), F.col("n_frag") - 1)))
    empty = F.array().cast(f"array<{schemas.CANDIDATE}>")
    return every.join(frags, ["evt", "frag"], "left").select(
        "evt", "frag", "n_frag", *[f"n_{c}" for c in schemas.COLLECTIONS],
        *[F.coalesce(c, empty).alias(c) for c in schemas.COLLECTIONS])


def store_key(spark: SparkSession, sf_dir: str, chunk: int | None = None) -> str:
    """Names a store derived from the tables of ``sf_dir`` as they are now."""
    srcs = [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in ("orders", "lineitem")]
    return f"{STORE_VERSION}-{source_fingerprint(spark, srcs)}-c{chunk or CHUNK}{STORE_TAG}"


def events(spark: SparkSession, sf_dir: str, chunk: int | None = None) -> DataFrame:
    """Scan of the nested event store for ``sf_dir``, building it on first use.

    The store is keyed by the identity of its input tables, looked up at every
    call (so changed inputs are seen), and written with the Parquet committer,
    so a lost executor only re-runs its tasks and a finished store is reused by
    every later query and application. It is written to a private folder and
    renamed into place when complete, so concurrent builders never see or
    clobber a half-written store.
    """
    chunk = chunk or CHUNK
    path = derived_path(spark, "events", store_key(spark, sf_dir, chunk))
    if not path_exists(spark, path + "/_SUCCESS"):
        # leading "_": hidden from Spark's file listing wherever it ends up
        parent, name = path.rsplit("/", 1)
        tmp = f"{parent}/_building-{name}-{uuid.uuid4().hex[:12]}"
        narrow = delete_on_exit(spark, tmp + "-sizes")
        sizes = event_sizes(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), chunk)
        sizes.write.option("compression", "zstd").parquet(narrow)
        sizes = spark.read.schema(sizes.schema).parquet(narrow)
        build_event_table(sizes, table(spark, sf_dir, "lineitem")).write.option("compression", "zstd").parquet(tmp)
        publish(spark, tmp, path)
    return read_events(spark, path)


def read_events(spark: SparkSession, path: str, schema: str = schemas.EVENT_TABLE) -> DataFrame:
    """Read a nested event table with a fixed schema."""
    return spark.read.schema(schema).parquet(path)
