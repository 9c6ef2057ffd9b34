"""Shared helpers: reading documents, written intermediate tables, fresh
column names, word splitting as a Column expression."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import derived_path

#: A word is a maximal run of characters other than space and \t..\r.
SEPARATORS = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder that
    ``spark.checkpoint.dir`` names and read it back. A lost executor costs a
    re-run of its own tasks only. The folder is private to the call and is
    removed when the driver's JVM ends."""
    spark = df.sparkSession
    path = derived_path(spark, "llm", f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores appended as it takes to clash
    with no column of ``df`` (case-insensitively, as Spark resolves them)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def words(text: Column) -> Column:
    """The words of a text, in order; null or blank text: empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def doc_mod(m: int) -> Column:
    """crc32 of the decimal doc_id, modulo m (null doc_id: null)."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % F.lit(m)


def sample_by_hash(rows: DataFrame, group: Column, k: int | dict, by: Column) -> DataFrame:
    """About ``k`` rows of each group (all of a smaller one; a dict gives the
    number by group): those whose
    hash (of ``by``) lies below a threshold that the group's count sets. Groups
    are few (languages, labels); their counts are the only thing collected."""
    counts = rows.groupBy(group.alias("g")).agg(F.count(F.lit(1)).alias("n")).collect()
    h = F.pmod(F.xxhash64(F.lit(17), by), F.lit(1 << 40))
    # a spread of 4 standard deviations above k, so that a group rarely gets fewer
    size = lambda g: k[g] if isinstance(k, dict) else k
    share = lambda g, n: min(1.0, (size(g) + 4 * math.sqrt(size(g))) / n)
    keep = F.lit(False)
    for r in counts:
        keep = keep | (group.eqNullSafe(F.lit(r["g"])) & (h < int(share(r["g"], r["n"]) * (1 << 40))))
    return rows.where(keep)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, k: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """About ``k[y]`` rows (text, y) of each value y of ``label`` (0, 1) among the labelled
    ``docs`` (doc_id, text), and how many labelled rows each value has.

    The sample is drawn from the narrow label table, so at most about k[0] + k[1]
    rows (fixed parameters) are broadcast to the scan of the texts."""
    rows = labels.select("doc_id", F.col(label).alias("y")).where("doc_id is not null and y in (0, 1)").distinct()
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = sample_by_hash(rows, F.col("y"), k, F.col("doc_id"))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y"), totals
