"""Pair kinematics on the 20 printed sample pairs and on edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from quarkframe.functions import kinematics as K

# Golden rows: the 20 printed pair candidates (e, px, py, pz), pairs (0,0),
# (0,1), (1,0), (1,1) of five two-muon events. Fixed values.
GOLDEN = [
    (9.027341, 2.8114102, 2.0337317, -8.331155),
    (20.616512, 4.2575407, 5.383979, -19.399937),
    (20.616512, 4.2575407, 5.383979, -19.399937),
    (32.205685, 5.7036715, 8.734226, -30.46872),
    (14.988299, -1.2429894, -3.692814, -14.471439),
    (10.421754, -0.0064013065, -3.198005, -9.756542),
    (10.421754, -0.0064013065, -3.198005, -9.756542),
    (5.855208, 1.2301868, -2.7031958, -5.041644),
    (16.901054, -2.2639802, -5.7359023, -15.73451),
    (12.972484, -2.917809, -2.4680312, -12.000999),
    (12.972484, -2.917809, -2.4680312, -12.000999),
    (9.043912, -3.5716379, 0.79984, -8.267488),
    (28.126917, -1.6677399, 5.838281, 27.46292),
    (19.399242, -1.5881548, 4.0297585, 18.8945),
    (19.399242, -1.5881548, 4.0297585, 18.8945),
    (10.671566, -1.5085697, 2.221235, 10.326083),
    (109.69228, 6.773477, 48.19971, -98.30189),
    (58.403553, 2.2265315, 24.095825, -52.512177),
    (58.403553, 2.2265315, 24.095825, -52.512177),
    (7.1148167, -2.3204138, -0.008062047, -6.722468),
]


def _pairs_df(spark, rows):
    df = spark.createDataFrame(rows, "e float, px float, py float, pz float")
    return df.select(F.struct("e", "px", "py", "pz").alias("v"))


def test_golden_rows(spark):
    """Rebuild each event's muons from its self-pairs (half of each) and pair
    them: all 20 printed records, then their derived quantities in float."""
    rows, want = [], []
    for k in range(0, 20, 4):
        legs = []
        for e, px, py, pz in (GOLDEN[k], GOLDEN[k + 3]):
            pt = math.hypot(px, py) / 2
            legs.append((pt, math.asinh(pz / 2 / pt), math.atan2(py, px)))
        rows += [(*a, *b) for a in legs for b in legs]
        want += GOLDEN[k:k + 4]
    df = spark.createDataFrame(rows, "p1 double, e1 double, f1 double, p2 double, e2 double, f2 double")
    v = df.select(K.pair_record(K.p4_sql("p1", "e1", "f1"), K.p4_sql("p2", "e2", "f2")).alias("v"))
    assert dict(v.dtypes)["v"] == "struct<e:float,px:float,py:float,pz:float>"
    for r, w in zip(v.collect(), want):
        assert list(r.v) == pytest.approx(list(w), rel=2e-6, abs=2e-6)
    out = _pairs_df(spark, GOLDEN).select(
        K.pair_mass2("v").alias("m2"), K.pair_pt("v").alias("pt"),
        K.pair_phi("v").alias("phi"), K.pair_eta("v").alias("eta"))
    assert [t for _, t in out.dtypes] == ["float", "double", "double", "double"]
    import numpy as np
    for r, w in zip(out.collect(), GOLDEN):
        e, px, py, pz = (np.float32(x) for x in w)
        assert r.m2 == e * e - px * px - py * py - pz * pz
        assert r.pt == math.sqrt(px * px + py * py)
        assert r.phi == pytest.approx(math.atan(py / px), rel=1e-15)
        assert r.eta == pytest.approx(0.5 * math.log((e + pz) / (e - pz)), rel=1e-14)


def test_phi_guard_and_rapidity_edges(spark):
    rows = [(5.0, 0.0, 1.0, 3.0), (5.0, 1.0, 1.0, 5.0), (5.0, 1.0, 1.0, -5.0)]
    out = _pairs_df(spark, rows).select(K.pair_phi("v").alias("phi"), K.pair_eta("v").alias("eta")).collect()
    assert out[0].phi == K.PHI_AT_ZERO_PX
    assert out[1].eta == math.inf
    assert out[2].eta == -math.inf


def test_self_pair_of_built_candidate(spark):
    df = spark.createDataFrame([(10.0, 0.5, 1.0)], "pt float, eta float, phi float")
    v = K.p4_sql("pt", "eta", "phi")
    r = df.select(K.pair_record(v, v).alias("s")).select(
        K.pair_mass2("s").alias("m2"), K.pair_mass("s").alias("m")).first()
    # float components of about 24 give mass^2 to a few 1e-5
    assert r.m2 == pytest.approx(4 * K.MUON_MASS ** 2, abs=2e-4)
    assert r.m == pytest.approx(2 * K.MUON_MASS, abs=1e-3)


def test_abs_pt_in_pair_builder(spark):
    df = spark.createDataFrame([(-10.0, 0.5, 1.0), (10.0, 0.5, 1.0)], "pt float, eta float, phi float")
    a, b = df.select(K.p4("pt", "eta", "phi").alias("v")).collect()
    assert a.v == b.v


def test_higgs_mass_missing_leg_is_null(spark):
    df = spark.createDataFrame([((10.0, 0.1, 0.2), None)],
                               "a struct<pt:float,eta:float,phi:float>, b struct<pt:float,eta:float,phi:float>")
    r = df.select(K.higgs_dimuon_mass("a", "b").alias("m")).first()
    assert r.m is None


def test_invariant_mass_back_to_back(spark):
    # two massless-ish legs back to back in phi at eta 0: m ~ 2 pt
    df = spark.createDataFrame([((50.0, 0.0, 0.0), (50.0, 0.0, math.pi))],
                               "a struct<pt:double,eta:double,phi:double>, b struct<pt:double,eta:double,phi:double>")
    r = df.select(K.invariant_mass("a", "b").alias("m")).first()
    assert r.m == pytest.approx(100.0, rel=1e-4)


def test_round_to_matches_floor_half_up(spark):
    from quarkframe.functions.rounding import round_to
    vals = [1.23456, -1.23456, 2.5e-5, -2.5e-5, 0.0, 1e6 + 0.12345, float("nan"), float("inf"), None, 1e16, -1e20]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(round_to("x", 4)).collect()]
    import math
    for v, g in zip(vals, got):
        if v is None:
            assert g is None
        elif math.isnan(v):
            assert math.isnan(g)
        elif math.isinf(v) or abs(v) >= 1e16:
            assert g == v
        else:
            assert g == math.floor(v * 1e4 + 0.5) / 1e4
