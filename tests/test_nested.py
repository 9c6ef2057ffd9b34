"""Projections, cuts and strip on hand-made nested rows."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructField, StructType

from quarkframe.operators import nested as N

CAND = "array<struct<qx3:int,pt:float,eta:float,phi:float>>"


@pytest.fixture(scope="module")
def ev(spark):
    rows = [
        (1, []),
        (2, None),
        (3, [(1, 5.0, 0.1, 0.2)]),
        (4, [(1, 7.0, 0.1, 0.2), (-1, 7.0, 0.3, 0.4), (1, 3.0, -0.5, 1.0)]),
    ]
    return spark.createDataFrame(rows, f"evt bigint, muons {CAND}")


def test_leaf_flatten_and_zip(ev):
    assert sorted(r.pt for r in N.flatten_leaf(ev, "muons", "pt").collect()) == [3.0, 5.0, 7.0, 7.0]
    z = N.zip_flatten(ev, "muons", ["pt", "eta"], keep=["evt"]).collect()
    assert sorted((r.evt, r.pt, r.eta) for r in z)[0] == (3, 5.0, pytest.approx(0.1))


def test_size_cuts_and_nulls(ev):
    # size(NULL) is -1 in Spark; a NULL collection never passes a >= / == cut
    assert N.cut_size(ev, "muons", ">=", 2).select("evt").collect()[0].evt == 4
    assert sorted(r.evt for r in N.cut_size(ev, "muons", "==", 1).collect()) == [3]
    assert sorted(r.evt for r in N.cut_size(ev, "muons", ">", 0).collect()) == [3, 4]


def test_element_out_of_range_is_null(ev):
    got = {r.evt: r.x for r in ev.select("evt", N.element("muons", 1)["pt"].alias("x")).collect()}
    assert got[1] is None and got[2] is None and got[3] is None and got[4] == 7.0


def test_top_k_ties_are_deterministic(ev):
    t = ev.where("evt = 4").select(N.top_k("muons", 2).alias("t")).first().t
    assert [m.pt for m in t] == [7.0, 7.0]
    # equal pt: the rest of the element decides
    assert [m.qx3 for m in t] == [1, -1]


def test_sort_by_ascending(ev):
    t = ev.where("evt = 4").select(N.sort_by("muons", "pt", desc=False).alias("t")).first().t
    assert [m.pt for m in t] == [3.0, 7.0, 7.0]


def test_path_with_double_colon_and_positional_bind(spark):
    leafrec = "struct<qx3_:int,pt_:float,eta_:float,phi_:float>"
    schema = (f"evt bigint, branch struct<obj:array<struct<`reco::RecoCandidate`:"
              f"struct<`reco::LeafCandidate`:{leafrec}>>>>")
    df = spark.createDataFrame([(1, ([(((1, 2.5, 0.1, 0.2),),), (((-1, 4.0, 0.3, 0.4),),)],))], schema)
    raw = N.select_paths(df, "branch.obj.reco::RecoCandidate.reco::LeafCandidate")
    assert raw.columns == ["reco::LeafCandidate"]
    m = N.rename(raw, "muons").select(N.bind("muons", CAND).alias("muons"))
    assert m.schema["muons"].dataType.elementType.names == ["qx3", "pt", "eta", "phi"]
    assert sorted(r.pt for r in N.flatten_leaf(m, "muons", "pt").collect()) == [2.5, 4.0]
    leafs = N.select_paths(df, "branch.obj.reco::RecoCandidate.reco::LeafCandidate.pt_").first()[0]
    assert leafs == [2.5, 4.0]


def test_strip_empty_structs_then_parquet(spark, tmp_path):
    elem = StructType([StructField("base", StructType([])), StructField("qx3", IntegerType()),
                       StructField("pt", FloatType()), StructField("cache", StructType([]))])
    schema = StructType([StructField("muons", ArrayType(elem))])
    df = spark.createDataFrame([([((), 1, 3.0, ())],)], schema)
    assert N.non_empty_fields(df, "muons") == ["qx3", "pt"]
    st = N.strip_empty(df, ["muons"])
    out = str(tmp_path / "stripped")
    st.write.parquet(out)
    back = spark.read.parquet(out).first().muons[0]
    assert (back.qx3, back.pt) == (1, 3.0)


def test_flatten_struct_keeps_pruning(spark, tmp_path):
    path = str(tmp_path / "ev")
    spark.createDataFrame([(1, [(1, 5.0, 0.1, 0.2)])], f"evt bigint, muons {CAND}").write.parquet(path)
    df = spark.read.parquet(path)
    plan = N.flatten_leaf(df, "muons", "pt")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<muons:array<struct<pt:float>>>" in plan


def test_drop_empty_removes_empty_structs_at_any_depth(spark, tmp_path):
    from pyspark.sql.types import StructType as S

    schema = S.fromDDL(
        "evt bigint, muons array<struct<baseTrack:struct<obj:struct<>,charge:int,pt:float>,flags:array<boolean>,"
        "inner:struct<a:struct<>,b:struct<c:struct<>>>>>, tracks map<string,struct<obj:struct<>,v:int>>, "
        "hollow array<struct<o:struct<>>>, top struct<>, plain struct<x:int>")
    row = (1, [(((), 1, 2.5), [True, False], ((), ((),))), None], {"k": ((), 7), "n": None}, [((),)], (), (3,))
    out = N.drop_empty(spark.createDataFrame([row], schema))
    assert out.schema.simpleString() == (
        "struct<evt:bigint,muons:array<struct<baseTrack:struct<charge:int,pt:float>,flags:array<boolean>>>,"
        "tracks:map<string,struct<v:int>>,plain:struct<x:int>>")
    out.write.parquet(str(tmp_path / "o"))
    got = spark.read.parquet(str(tmp_path / "o")).first()
    assert got.muons[0].baseTrack.pt == 2.5 and got.muons[0].flags == [True, False] and got.muons[1] is None
    assert got.tracks["k"].v == 7 and got.tracks["n"] is None and got.plain.x == 3


@pytest.mark.parametrize("have, want, why", [
    ("array<struct<a_:int,b_:double>>", "array<struct<a:int,b:float>>", "double does not fit"),
    ("array<struct<a_:int>>", "array<struct<a:int,b:float>>", "1 fields for 2"),
    ("struct<a_:bigint>", "struct<a:int>", "bigint does not fit"),
    ("struct<a_:string>", "struct<a:int>", "string does not fit"),
    ("struct<v_:struct<x_:float,y_:float>>", "struct<v:struct<x:float>>", "2 fields for 1"),
    ("array<int>", "struct<a:int>", "is not a record"), ("struct<a:int>", "array<int>", "is not an array"),
    ("map<string,double>", "map<string,float>", "double does not fit"),
])
def test_checked_bind_refuses_what_would_lose_values(spark, have, want, why):
    df = spark.createDataFrame([], f"c {have}")
    with pytest.raises(TypeError, match=why):
        N.checked_bind(df, "c", want)


def test_checked_bind_widens_and_renames(spark):
    df = spark.createDataFrame([([(1, 2.5)],)], "c array<struct<a_:int,b_:float>>")
    got = df.select(N.checked_bind(df, "c", "array<struct<a:bigint,b:double>>").alias("c"))
    assert got.schema.simpleString() == "struct<c:array<struct<a:bigint,b:double>>>" and got.first().c[0].b == 2.5
