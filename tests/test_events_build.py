"""Event-store builder on small hand-made orders/lineitem tables."""

import datetime

import pytest

from quarkframe.sources import events as E

LI = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
      "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate date")


def _line(order, i):
    return (order, 100 + i, 7 + i, i, float(i), 1000.0 * (i % 50 + 1), 0.01, 0.02, "A" if i % 2 else "N",
            datetime.date(1995, 1, 1))


def _build(orders, li, chunk):
    return E.build_event_table(E.event_sizes(orders, li, chunk), li)


@pytest.mark.parametrize("chunk", [4, 1000])
def test_build_with_and_without_split_events(spark, chunk):
    """Order 1 has 40 lines (split when chunk=4), order 2 has 3, order 3 none;
    the orphan line of order 9 (not in orders) is not an event."""
    orders = spark.createDataFrame([(1,), (2,), (3,)], "o_orderkey long")
    lines = [_line(1, i) for i in range(40)] + [_line(2, i) for i in range(3)] + [_line(9, 0)]
    li = spark.createDataFrame(lines, LI)
    ev = _build(orders, li, chunk)
    assert {"frag", "n_frag"} < set(ev.columns)
    by_evt = {}
    for r in ev.collect():
        by_evt.setdefault(r.evt, []).append(r)
    assert sorted(by_evt) == [1, 2, 3]
    hot = by_evt[1]
    assert {r.n_muons for r in hot} == {40}
    assert sum(len(r.muons) for r in hot) == 40
    assert sorted(r.frag for r in hot) == list(range(10 if chunk == 4 else 1))
    assert {r.n_frag for r in hot} == {len(hot)}
    for r in hot:
        pts = [m.pt for m in r.muons]
        assert pts == sorted(pts, reverse=True)
        assert sum(len(getattr(r, c)) for c in ("photons", "electrons", "jets", "met")) == len(r.muons)
    (empty,) = by_evt[3]
    assert empty.frag == 0 and empty.n_frag == 1 and empty.n_muons == 0 and empty.muons == []
    (two,) = by_evt[2]
    assert two.n_muons == 3 and len(two.muons) == 3


def test_a_hot_event_is_spread_over_tasks(spark):
    """Neither the particles of the store build nor the pairs of a hot event
    gather in one task (broadcast off, as at large scale)."""
    from pyspark.sql import functions as F

    from quarkframe.operators.pairs import ordered_pairs, symmetric_pairs

    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
        spark.conf.set(k, v)
    try:
        orders = spark.createDataFrame([(1,), (2,)], "o_orderkey long")
        li = spark.createDataFrame([_line(1, i) for i in range(640)] + [_line(2, 0)], LI)
        ev = _build(orders, li, 20)
        assert ev.where("evt = 1").count() == 32

        def largest_share(df, weight=F.lit(1)):
            df = df.where("evt = 1").select(F.spark_partition_id().alias("p"), weight.alias("w"))
            n = [r[1] for r in df.groupBy("p").agg(F.sum("w")).collect()]
            return max(n) / sum(n), sum(n)

        share, n = largest_share(ev, F.size("muons"))
        assert share < 0.4 and n == 640
        for pairs, total in ((ordered_pairs(ev), 640 ** 2), (symmetric_pairs(ev), None)):
            share, n = largest_share(pairs, F.when(F.col("pair").isNotNull(), 1))
            assert share < 0.35 and (total is None or n == total)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_appended_rows_are_seen_in_the_same_session(spark, tmp_path):
    orders = spark.createDataFrame([(k,) for k in range(5)], "o_orderkey long")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([_line(1, 0)], LI).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert E.events(spark, str(tmp_path)).count() == 5
    spark.createDataFrame([(k,) for k in range(5, 9)], "o_orderkey long").write.mode("append").parquet(
        str(tmp_path / "orders.parquet"))
    assert E.events(spark, str(tmp_path)).count() == 9


def test_source_fingerprint_follows_file_changes(spark, tmp_path):
    from quarkframe.session import source_fingerprint

    d = str(tmp_path / "t.parquet")
    spark.range(10).write.parquet(d)
    a = source_fingerprint(spark, [d])
    assert source_fingerprint(spark, [d]) == a
    spark.range(5).write.mode("append").parquet(d)
    assert source_fingerprint(spark, [d]) != a


def test_derived_tables_use_the_configured_shared_folder(spark):
    from quarkframe.session import derived_path

    base = spark.conf.get("spark.checkpoint.dir", None)
    p = derived_path(spark, "events", "k")
    if base:
        assert p == base.rstrip("/") + "/quarkframe/events/k"
    else:
        assert p.endswith("/quarkframe/events/k")


def test_publish_keeps_the_first_store(spark, tmp_path):
    from quarkframe.session import publish

    base = str(tmp_path)
    spark.range(3).write.parquet(base + "/_a")
    spark.range(7).write.parquet(base + "/_b")
    publish(spark, base + "/_a", base + "/store")
    publish(spark, base + "/_b", base + "/store")      # second builder loses, keeps the first
    assert spark.read.parquet(base + "/store").count() == 3
    import os
    assert not os.path.exists(base + "/_b") and not os.path.exists(base + "/_a")


@pytest.mark.parametrize("chunk", [4, 1000])
def test_build_collects_after_the_shuffle(spark, chunk):
    """The particles cross one exchange keyed by event (or event, fragment);
    the collect runs after it, never as a map-side partial buffer."""
    orders = spark.createDataFrame([(1,), (2,)], "o_orderkey long")
    li = spark.createDataFrame([_line(1, i) for i in range(40)] + [_line(2, 0)], LI)
    plan = _build(orders, li, chunk)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    partial = [i for i, ln in enumerate(lines) if "partial_collect_list" in ln]
    repart = [i for i, ln in enumerate(lines) if "REPARTITION_BY_COL" in ln]
    assert partial and repart
    # the plan prints parents first: every partial collect sits above (after) a repartition
    assert all(any(r > p for r in repart) for p in partial)


def test_published_store_is_reused_not_rebuilt(spark, monkeypatch):
    from conftest import SF_SMALL

    monkeypatch.setattr(E, "STORE_TAG", "-reuse-test")
    n = E.events(spark, SF_SMALL).count()

    def no_build(*a, **k):
        raise AssertionError("store rebuilt")

    monkeypatch.setattr(E, "build_event_table", no_build)
    assert E.events(spark, SF_SMALL).count() == n


def test_particles_cross_one_exchange(spark, monkeypatch):
    """with broadcast by size off, the particles meet the few fragment counts where they are;
    more counts than may be sent are met in salted parts, with the same result."""
    orders = spark.createDataFrame([(k,) for k in range(1, 5)], "o_orderkey long")
    li = spark.createDataFrame([_line(1, i) for i in range(70)] + [_line(2, 0)], LI)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent = _build(orders, li, 20)
        plan = sent._jdf.queryExecution().executedPlan().toString()
        assert "salt" not in plan
        monkeypatch.setattr(E, "MOST_SENT", 0)
        salted = _build(orders, li, 20)
        assert "salt" in salted._jdf.queryExecution().executedPlan().toString()
        order = ["evt", "frag"]
        assert sent.orderBy(*order).collect() == salted.orderBy(*order).collect() and sent.where("n_frag > 1").count() == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
