"""Plan checks: pruned scans, no Python evaluation, no Cartesian products."""

import pytest

import __spark_entry__ as E
from quarkframe.plans.catalog import QUERIES

from conftest import SF_SMALL

FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "MapInArrow", "MapInPandas", "CartesianProduct",
             "BroadcastNestedLoopJoin")


@pytest.fixture(scope="module", autouse=True)
def whole_schemas(spark):
    """Plans print read schemas whole, not their first 100 characters."""
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    yield
    spark.conf.set("spark.sql.maxMetadataStringLength", old)


def _plan(df):
    df.collect()  # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_or_cartesian(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    for bad in FORBIDDEN:
        assert bad not in plan, f"{name}: {bad}"


def test_leaf_scan_is_pruned(spark):
    plan = _plan(E.queries()["b2_count_pt"](spark, SF_SMALL))
    assert "ReadSchema: struct<muons:array<struct<pt:float>>>" in plan


def test_pair_bundle_reads_three_leaves(spark):
    plan = _plan(E.queries()["b5_pair_bundle"](spark, SF_SMALL))
    scans = [ln for ln in plan.splitlines() if "ReadSchema" in ln]
    assert scans
    for ln in scans:
        schema = ln.split("ReadSchema:")[1]
        assert "vertex" not in schema and "qx3" not in schema and "photons" not in schema


def test_size_cut_reads_no_collection(spark):
    plan = _plan(E.queries()["b4_count_n_eq2"](spark, SF_SMALL))
    schema = [ln for ln in plan.splitlines() if "ReadSchema" in ln][0].split("ReadSchema:")[1]
    assert schema.strip() == "struct<frag:int,n_muons:int>"
    assert "PushedFilters" in plan and "EqualTo(n_muons,2)" in plan


# queries that keep whole records; every other query reads only the leaves it uses
WHOLE = {"strip_events", "sink_parquet_roundtrip"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WHOLE))
def test_scans_read_only_the_leaves_in_use(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    for ln in plan.splitlines():
        if "ReadSchema" in ln:
            schema = ln.split("ReadSchema:")[1]
            assert "vertex" not in schema and "cache_" not in schema and "key_" not in schema, schema


def test_path_query_reads_one_leaf_of_the_original_layout(spark):
    plan = _plan(QUERIES["aod_path_sum_pt_lt10"](spark, SF_SMALL))
    schemas = {ln.split("ReadSchema:")[1].strip() for ln in plan.splitlines() if "ReadSchema" in ln}
    assert schemas and all(x.count("pt_:float") == 1 and x.count("float") == 1 for x in schemas)


@pytest.mark.parametrize("name", ["k_log_job_time", "k_log_totals", "k_log_stage_summary"])
def test_log_reports_read_ingested_records_of_the_events_they_need(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    scans = [ln for ln in plan.splitlines() if "FileScan" in ln]
    assert scans and not any("FileScan json" in ln or "FileScan text" in ln for ln in scans)
    assert all("PartitionFilters: [isnotnull(event" in ln for ln in scans)
    if name == "k_log_job_time":
        assert not any("= task)" in ln for ln in scans)


def test_nested_metrics_are_parsed_once_for_jobs_and_once_for_tasks(spark):
    plan = _plan(QUERIES["k_json_totals"](spark, SF_SMALL)).split("Initial Plan")[0]
    scans = [ln for ln in plan.splitlines() if "FileScan" in ln]
    assert scans and all("FileScan text" in ln for ln in scans) and len(scans) <= 2


def test_nested_metrics_are_parsed_once_for_every_use_of_jobs_and_stages(spark):
    """the summary uses the jobs once and the stages twice; they come from one exchange."""
    df = QUERIES["k_json_stage_summary"](spark, SF_SMALL)
    df.collect()
    final = _plan(df).split("Initial Plan")[0]
    assert sum("FileScan text" in ln for ln in final.splitlines()) == 2 and final.count("ReusedExchange") == 2


def test_stage_ordinals_scan_the_stages_once(spark):
    plan = _plan(QUERIES["k_stage_time_by_ordinal"](spark, SF_SMALL))
    final = plan.split("Initial Plan")[0]
    assert sum("FileScan" in ln for ln in final.splitlines()) == 2      # stages and jobs
    assert sum(" Exchange " in ln or "- Exchange" in ln for ln in final.splitlines()) <= 4


def _schemas(spark, name):
    return [ln.split("ReadSchema:")[1].strip() for ln in _plan(QUERIES[name](spark, SF_SMALL)).splitlines() if "ReadSchema" in ln]


def test_lead_bundles_read_the_leaves_of_the_nested_track_only(spark):
    for schema in _schemas(spark, "higgs_lead_bundle"):
        assert schema.count("baseTrack") == 2 and "charge" not in schema and "isPF" not in schema and "ids" not in schema
    assert any("electrons:array<struct<baseTrack:struct<pt:float>>>" in x for x in _schemas(spark, "higgs_lead_bundle"))
    for schema in _schemas(spark, "photon_lead_bundle"):
        assert "GenParticle" not in schema and "Photon:array<struct<pt:float,eta:float,phi:float>>" in schema


def test_one_leaf_of_a_nested_record_is_one_column_of_the_scan(spark):
    from quarkframe.operators import nested as N
    from quarkframe.sources.ntuples import ntuple_events

    plan = N.flatten_leaf(ntuple_events(spark, SF_SMALL, "higgs"), "muons.baseTrack", "pt")
    assert "ReadSchema: struct<muons:array<struct<baseTrack:struct<pt:float>>>>" in _plan(plan)


def test_preview_keeps_a_few_rows_per_task(spark):
    assert "TakeOrderedAndProject(limit=20" in _plan(QUERIES["preview_pairs"](spark, SF_SMALL))
