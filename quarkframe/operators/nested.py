"""Projections and cuts on nested collections.

Pruning rules (checked in tests against ``ReadSchema``): address leaves by
path (``muons.pt``), zip only the leaves needed, and apply lambdas to arrays
that are already narrowed. ``size(muons)`` or ``transform(muons, ...)`` on the
whole struct array would make the scan read every leaf.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


# ---------------------------------------------------------------- projections

def select_paths(df: DataFrame, *paths: str) -> DataFrame:
    """Select (nested) column paths; segments may contain ``::``.

    A path through an array of structs yields an array of the addressed
    field, named after the last segment.
    """
    return df.select(*[F.col(_quote_path(p)) for p in paths])


def _quote_path(p: str) -> str:
    # dots separate segments; backtick a segment only if it needs it
    segs = p.split(".")
    return ".".join(f"`{s}`" if not s.replace("_", "a").isalnum() else s for s in segs)


def rename(df: DataFrame, *names: str) -> DataFrame:
    """Rename all output columns positionally."""
    return df.toDF(*names)


def bind(col: str | Column, ddl: str) -> Column:
    """Bind a column to a fixed record type by *position*.

    A struct cast matches fields by position, so leaf names such as ``pt_``
    become ``pt``; the field count must agree.
    """
    c = F.col(col) if isinstance(col, str) else col
    return c.cast(ddl)


_WIDER = {  # casts that keep every value
    "tinyint": {"smallint", "int", "bigint", "float", "double"}, "smallint": {"int", "bigint", "float", "double"},
    "int": {"bigint", "double"}, "float": {"double"}, "date": {"timestamp"}}


def _check(have: DataType, want: DataType, at: str) -> None:
    if isinstance(want, StructType):
        if not isinstance(have, StructType):
            raise TypeError(f"{at}: {have.simpleString()} is not a record")
        if len(have.fields) != len(want.fields):
            raise TypeError(f"{at}: {len(have.fields)} fields for {len(want.fields)}: "
                            f"{have.names} against {want.names}")
        for h, w in zip(have.fields, want.fields):
            _check(h.dataType, w.dataType, f"{at}.{w.name}")
    elif isinstance(want, ArrayType):
        if not isinstance(have, ArrayType):
            raise TypeError(f"{at}: {have.simpleString()} is not an array")
        _check(have.elementType, want.elementType, at)
    elif isinstance(want, MapType):
        if not isinstance(have, MapType):
            raise TypeError(f"{at}: {have.simpleString()} is not a map")
        _check(have.keyType, want.keyType, at + ".key")
        _check(have.valueType, want.valueType, at + ".value")
    else:
        h, w = have.simpleString(), want.simpleString()
        if h != w and h != "void" and w not in _WIDER.get(h, ()):
            raise TypeError(f"{at}: {h} does not fit into {w} without loss")


def checked_bind(df: DataFrame, col: str, ddl: str) -> Column:
    """``bind`` that first compares the column's type with the record's, by
    position and at any depth: another number of fields, another kind of type or
    a cast that may lose values (double to float, bigint to int, string to a
    number) is a TypeError."""
    want = StructType.fromDDL(f"r {ddl}")["r"].dataType
    _check(df.schema[col].dataType, want, col)
    return bind(col, ddl)


def leaf(coll: str, field: str) -> Column:
    """P5: ``array<field>`` of one leaf of an array of structs."""
    return F.col(f"{coll}.{field}")


def flatten_leaf(df: DataFrame, coll: str, field: str, alias: str | None = None,
                 keep: Sequence[str] = ()) -> DataFrame:
    """One row per element of a leaf array."""
    return df.select(*keep, F.explode(leaf(coll, field)).alias(alias or field))


def zip_flatten(df: DataFrame, coll: str, fields: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Zip parallel leaf arrays and flatten to one row per element.

    Leaves of one collection always have equal length, so zip truncation and
    padding cannot differ here.
    """
    z = F.arrays_zip(*[leaf(coll, f).alias(f) for f in fields])
    return df.select(*keep, F.inline(z))


def flatten(df: DataFrame, coll: str, alias: str = "x", keep: Sequence[str] = (),
            with_pos: bool = False) -> DataFrame:
    """One row per element of an array of structs (struct column ``alias``)."""
    if with_pos:
        return df.select(*keep, F.posexplode(coll).alias("pos", alias))
    return df.select(*keep, F.explode(coll).alias(alias))


def strip(coll: str | Column, fields: Iterable[str]) -> Column:
    """Keep only ``fields`` of every element of a collection."""
    c = F.col(coll) if isinstance(coll, str) else coll
    fields = list(fields)
    return F.transform(c, lambda x: F.struct(*[x[f].alias(f) for f in fields]))


def non_empty_fields(df: DataFrame, coll: str) -> list[str]:
    """Fields of the element struct that are not empty structs."""
    dt = df.schema[coll].dataType
    assert isinstance(dt, ArrayType) and isinstance(dt.elementType, StructType)
    return [f.name for f in dt.elementType.fields
            if not (isinstance(f.dataType, StructType) and len(f.dataType.fields) == 0)]


def strip_empty(df: DataFrame, colls: Iterable[str]) -> DataFrame:
    """Drop empty-struct fields (which Parquet cannot store) from collections."""
    colls = list(colls)
    return df.select(*[strip(c, non_empty_fields(df, c)).alias(c) if c in colls else F.col(c)
                       for c in df.columns])


def _without_empty(c: Column, kind: DataType) -> Column | None:
    """The value without empty structs at any depth; None if nothing is left."""
    if isinstance(kind, StructType):
        parts = [(f.name, _without_empty(c[f.name], f.dataType)) for f in kind.fields]
        kept = [p.alias(n) for n, p in parts if p is not None]
        return F.when(c.isNotNull(), F.struct(*kept)) if kept else None
    if isinstance(kind, ArrayType) and _holds_empty(kind.elementType):
        if _hollow(kind.elementType):
            return None
        return F.transform(c, lambda x: _without_empty(x, kind.elementType))
    if isinstance(kind, MapType) and _holds_empty(kind.valueType):
        if _hollow(kind.valueType):
            return None
        return F.transform_values(c, lambda _, x: _without_empty(x, kind.valueType))
    return c


def _hollow(kind: DataType) -> bool:
    """Made of empty structs only."""
    if isinstance(kind, StructType):
        return all(_hollow(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return _hollow(kind.elementType)
    return isinstance(kind, MapType) and _hollow(kind.valueType)


def _holds_empty(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return not kind.fields or any(_holds_empty(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return _holds_empty(kind.elementType)
    return isinstance(kind, MapType) and _holds_empty(kind.valueType)


def drop_empty(df: DataFrame) -> DataFrame:
    """P9 by schema: every column without the empty structs that lie in it at
    any depth (in structs, arrays of structs and map values); a column of
    nothing else goes. Columns without empty structs are passed as they are."""
    cols = []
    for f in df.schema.fields:
        if _hollow(f.dataType):
            continue
        c = F.col(f"`{f.name}`")
        cols.append(_without_empty(c, f.dataType).alias(f.name) if _holds_empty(f.dataType) else c)
    return df.select(*cols)


def element(coll: str | Column, k: int) -> Column:
    """P10: element ``k`` (0-based); NULL when the collection is shorter."""
    c = F.col(coll) if isinstance(coll, str) else coll
    return F.get(c, F.lit(k))


# ----------------------------------------------------------------- sizes, cuts

def size_of(df: DataFrame, coll: str, leaf_name: str = "pt") -> Column:
    """Whole-event size of a collection.

    The event store carries it as ``n_<coll>`` (fragments of a split event all
    hold the whole-event size); otherwise the size of one leaf array is used,
    which keeps the scan pruned to that leaf.
    """
    if f"n_{coll}" in df.columns:
        return F.col(f"n_{coll}")
    return F.size(leaf(coll, leaf_name))


def cut_size(df: DataFrame, coll: str, op: str, k: int) -> DataFrame:
    """Keep events whose collection size compares to ``k``."""
    s = size_of(df, coll)
    cond = {">=": s >= k, ">": s > k, "==": s == k, "!=": s != k, "<": s < k, "<=": s <= k}[op]
    return df.where(cond)


def first_fragment(df: DataFrame) -> DataFrame:
    """One row per event (fragment 0) for event-level counting."""
    return df.where(F.col("frag") == 0) if "frag" in df.columns else df


# ------------------------------------------------------------- sort, top-k

def sort_by(coll: str | Column, key: str = "pt", desc: bool = True) -> Column:
    """O1: sort an array of structs by one field (stable for ties by the rest)."""
    c = F.col(coll) if isinstance(coll, str) else coll
    keyed = F.transform(c, lambda x: F.struct(x[key].alias("k"), x.alias("v")))
    return F.transform(F.sort_array(keyed, asc=not desc), lambda s: s["v"])


def top_k(coll: str | Column, k: int, key: str = "pt") -> Column:
    """O3: the ``k`` elements with the largest ``key``."""
    return F.slice(sort_by(coll, key, desc=True), 1, k)
