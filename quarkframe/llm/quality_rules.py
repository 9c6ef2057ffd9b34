"""Quality rules with adaptive thresholds (native: Column expressions only).

Per text the operator measures how much of it is symbols, capitals, repeated
lines, repeated 8-word windows, and the mean word length. Instead of fixed
cutoffs, each measure's upper fence comes from a mergeable quantile sketch
per (lang, source):

* The sketch is a table of counts over geometrically spaced bins (relative
  error ``(GAMMA - 1) / 2``): merging is adding counts, so it builds as one
  partial aggregation, and the sketches of a language and of the whole corpus
  are sums of those of its (lang, source) groups. It is exact about counts
  and does not depend on how rows are dealt out, so reruns agree.
* The sketches hold the documents that pass the base rules. A fence is
  Tukey's, on the sketch's own logarithmic scale: ``FENCE`` times the distance
  of the quartiles' bins above the upper one, a distance counting at least
  ``ERROR_BINS`` (the sketch's error). If the lower quartile is zero, it is
  ``q75 + FENCE * q75``. If both are, the fence is the quantile that
  ``MEASURES`` names: the upper quartile itself for symbols, so that a group
  that hardly has any tolerates hardly any, and for repeated lines and words
  the one that a further document of the group exceeds with probability
  ``1 - TAIL`` at most. No fence is below ``FENCE * LEAST``, values under
  ``LEAST`` being one bin. The group is (lang, source) if it has
  ``MIN_GROUP`` documents, else the language, else all documents.
* Documents then join the small table of fences by (lang, source),
  null-safely, and those above a fence are rejected.

Edge cases: a null or blank text has no words and fails the base rules; null
lang or source is a group of its own; repeated rows are judged alike; an
empty table gives an empty result; input columns are all kept, whatever
their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, store, words

SYMBOLS = "[^#*$%&|<>]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

GAMMA = 1.01          # bin width of the quantile sketch
LEAST = 1e-3          # values up to this share bin 0
FENCE = 3.0           # Tukey's outer fence
ERROR_BINS = 2        # error of a distance of two quantiles
TAIL = 0.99
MIN_GROUP = 50        # documents a (lang, source) or language needs for fences of its own

#: measure -> quantile that is its fence in a group whose quartiles are zero
MEASURES = {"symbols": 0.75, "capitals": 0.75, "dup_lines": TAIL, "repeats": TAIL, "word_length": 0.75}


def _repeat_words(w: str, h: str, s: str, p: str) -> list[tuple[str, Column]]:
    """Steps that count the words covered by a WINDOW-word window that occurs
    twice or more in its text: window hashes ``h``; if any is repeated, their
    sort ``s`` with positions; the sorted positions ``p`` of repeated ones."""
    n = F.size(h)
    same = lambda j, k: F.get(s, j)["h"] == F.get(s, k)["h"]
    return [
        (h, F.when(F.size(w) >= WINDOW, F.transform(
            F.sequence(F.lit(1), F.size(w) - F.lit(WINDOW - 1)),
            lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW))))).otherwise(F.array().cast("array<bigint>"))),
        (s, F.when(F.size(F.array_distinct(h)) < n, F.sort_array(
            F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))),
        (p, F.when(F.col(s).isNotNull(), F.sort_array(F.filter(
            F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.when(
                F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)),
                F.get(s, j)["i"])),
            lambda x: x.isNotNull())))),
    ]


def _covered(p: str) -> Column:
    step = lambda acc, i: F.struct(
        (i + WINDOW).alias("end"),
        (acc["n"] + (i + WINDOW - F.greatest(i, acc["end"])).cast("long")).alias("n"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.coalesce(F.aggregate(p, start, step)["n"], F.lit(0).cast("long"))


def measure(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` plus a struct column ``name``: n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed and the array ``m`` of MEASURES."""
    w, h, s, p, lines = fresh(docs, "w", "h", "s", "p", "lines")
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn(w, words(F.col("text"))).withColumn(
        lines, F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    for col, how in _repeat_words(w, h, s, p):
        d = d.withColumn(col, how)
    d = d.withColumn(name, F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _covered(p).alias("n_repeat_words"),
        F.length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
        F.size(lines).alias("n_lines"),
    )).drop(w, h, s, p, lines)
    q = F.col(name)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return d.withColumn(name, q.withField("base_failed", (q["n_words"] < MIN_WORDS) | (
        q["n_repeat_words"] * 100 > q["n_words"] * MAX_REPEAT_PERCENT)).withField("m", F.array(
            share(q["n_symbols"], q["word_chars"]), share(q["n_capitals"], q["word_chars"]),
            share(q["n_dup_lines"], q["n_lines"]), share(q["n_repeat_words"], q["n_words"]),
            share(q["word_chars"], q["n_words"]))))


def _bin(x: Column) -> Column:
    return F.when(x <= LEAST, F.lit(0)).otherwise(F.ceil(F.log(x / LEAST) / math.log(GAMMA)).cast("int"))


def _value(b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(LEAST * F.pow(F.lit(GAMMA), b - F.lit(0.5)))


def sketches(measured: DataFrame, name: str) -> DataFrame:
    """Counts per (lang, source, measure, bin): one mergeable quantile sketch
    for each (lang, source, measure), of the documents that pass the base rules.
    Partially aggregated before the shuffle."""
    q = F.col(name)
    return (measured.where(~q["base_failed"])
            .select("lang", "source", F.posexplode(F.transform(q["m"], _bin)).alias("k", "b"))
            .groupBy("lang", "source", "k", "b").agg(F.count(F.lit(1)).alias("n")))


def fences(sketch: DataFrame) -> DataFrame:
    """(lang, source, fence array): upper fences by measure of every group."""
    sums = lambda keys: sketch.groupBy(*keys, "k", "b").agg(F.sum("n").alias("n"))

    def quartiles(t: DataFrame, keys: list[str], tag: str) -> DataFrame:
        by = Window.partitionBy(*keys, "k")
        cum = t.select(*keys, "k", "b", F.sum("n").over(by).alias("total"),
                       F.sum("n").over(by.orderBy("b")).alias("cum"))
        at = lambda rank: F.min(F.when(F.col("cum") >= rank, F.col("b")))
        level = F.element_at(F.array(*[F.lit(x) for x in MEASURES.values()]), F.col("k") + 1)
        further = F.when(level == TAIL, 1).otherwise(0)      # the document to come counts as one more
        rank = F.least(F.ceil(level * (F.col("total") + further)), F.col("total"))
        lo, hi = F.col("lo"), F.col("hi")
        edge = lambda b: LEAST * F.pow(F.lit(GAMMA), b)
        fence = (F.when(lo > 0, edge(hi + FENCE * F.greatest(hi - lo, F.lit(ERROR_BINS))))
                 .when(hi > 0, edge(hi) * (1 + FENCE)).otherwise(edge(F.col("tail"))))
        return (cum.groupBy(*keys, "k").agg(F.max("total").alias("total"), at(0.25 * F.col("total")).alias("lo"),
                                            at(0.75 * F.col("total")).alias("hi"), at(rank).alias("tail"))
                # a value on its bin's edge is not above it
                .withColumn("fence", F.greatest(fence, F.lit(FENCE * LEAST)) * (1 + 1e-9))
                .groupBy(*keys).agg(F.max("total").alias(f"n_{tag}"),
                                    F.transform(F.array_sort(F.collect_list(F.struct("k", "fence"))),
                                                lambda x: x["fence"]).alias(f"f_{tag}")))

    own = quartiles(sketch, ["lang", "source"], "own")
    lang = quartiles(sums(["lang"]), ["lang"], "lang").withColumnRenamed("lang", "lang_")
    every = quartiles(sums([]), [], "all")
    return (own.join(lang, F.col("lang").eqNullSafe(F.col("lang_")), "left").join(every, F.lit(True), "left")
            .select("lang", "source", F.when(F.col("n_own") >= MIN_GROUP, F.col("f_own"))
                    .when(F.col("n_lang") >= MIN_GROUP, F.col("f_lang")).otherwise(F.col("f_all")).alias("fence")))


def judge(docs: DataFrame, payload: list[str] | None = None, name: str = "quality") -> tuple[DataFrame, str]:
    """``docs`` (or its columns ``payload`` with lang and source) plus the
    measures as a struct, to which ``kept`` is added; also the struct's name.

    The measured rows are written once: the sketches and the filter read the
    same table instead of measuring every text twice."""
    (name,) = fresh(docs, name)
    m = measure(docs, name)
    if payload is not None:
        m = m.select(*payload, name)
    m = store(m, "quality-measured")
    f = store(fences(sketches(m, name)), "quality-fences")
    l, s, x = fresh(m, "fence_lang", "fence_source", "fence")
    f = f.select(F.col("lang").alias(l), F.col("source").alias(s), F.col("fence").alias(x))
    # the table of fences is read from its own files, so Spark knows its size:
    # it is broadcast below autoBroadcastJoinThreshold, else joined by shuffle,
    # where AQE splits a hot source
    q = F.col(name)
    over = F.exists(F.arrays_zip(q["m"].alias("v"), F.col(x).alias("f")), lambda z: z["v"] > z["f"])
    out = m.join(f, F.col("lang").eqNullSafe(F.col(l)) & F.col("source").eqNullSafe(F.col(s)), "left")
    return out.withColumn(name, q.withField("kept", ~q["base_failed"] & ~F.coalesce(over, F.lit(False)))
                          ).drop(l, s, x), name


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    out, name = judge(docs)
    return out.where(F.col(name)["kept"]).select(*docs.columns)
