"""Histogram bundles over a stream of event files.

Filling a bundle is a ``groupBy(label, bin).count()`` (see
``operators.histogram``), so the same plan runs incrementally in Structured
Streaming: new event-store files in a folder are cut, flattened and binned,
and the running bin counts are kept in Spark's state store (one row per
non-empty bin). Checkpoints go to the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..functions.histogram import Bin
from ..operators.histogram import fill_bundle
from ..session import derived_path


def read_event_stream(spark: SparkSession, folder: str, schema: str = schemas.EVENT_TABLE,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming scan of event-store Parquet files arriving in ``folder``."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(folder)


def bundle_stream(events: DataFrame, bins: Sequence[Bin],
                  to_rows: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Running bundle: ``to_rows`` turns events into the rows to fill
    (e.g. a size cut and a flatten); the bins read their columns."""
    return fill_bundle(to_rows(events), bins)


def start_bundle_query(hist: DataFrame, name: str, sink: str = "memory",
                       checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Start the running-count query (complete output: the whole bundle).

    The default checkpoint is ``<spark.checkpoint.dir>/quarkframe/streams/<name>``:
    stable per query name, so a restarted application resumes the query
    from its offsets and state instead of recounting (or double counting)."""
    spark = hist.sparkSession
    w = (hist.writeStream.outputMode("complete").format(sink).queryName(name)
         .option("checkpointLocation", checkpoint or derived_path(spark, "streams", name)))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
