"""The muon bundle filled incrementally from a stream equals the batch fill."""

import uuid

from quarkframe.operators import nested as N
from quarkframe.operators.histogram import fill_bundle
from quarkframe.plans.benchmark import CANDIDATE_BINS
from quarkframe.sources.events import events
from quarkframe.streaming.histograms import bundle_stream, read_event_stream, start_bundle_query

from conftest import SF_SMALL


def _rows(ev):
    return N.zip_flatten(N.cut_size(ev, "muons", ">", 0), "muons", ["pt", "eta", "phi"])


def test_stream_bundle_equals_batch(spark, tmp_path):
    ev = events(spark, SF_SMALL)
    folder = str(tmp_path / "incoming")
    ev.repartition(4).write.parquet(folder)          # four files arrive
    name = f"bundle_{uuid.uuid4().hex[:8]}"
    q = start_bundle_query(bundle_stream(read_event_stream(spark, folder, max_files_per_trigger=1),
                                         CANDIDATE_BINS, _rows),
                           name, checkpoint=str(tmp_path / "ckpt"))
    q.awaitTermination(300)
    got = sorted(tuple(r) for r in spark.sql(f"SELECT * FROM {name}").collect())
    want = sorted(tuple(r) for r in fill_bundle(_rows(ev), CANDIDATE_BINS).collect())
    assert got == want
    assert q.lastProgress is not None
