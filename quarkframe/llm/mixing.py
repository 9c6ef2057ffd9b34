"""Mixing sources to target weights (native: DataFrame operations only).

1. Every source's documents form one stream of words, in an order by hash;
   the stream is packed into blocks of ``BLOCK`` words (the last holds the rest).
2. Targets: the sources' weights share ``TOTAL`` times all words; a target
   stops at ``MOST`` times its source's words and the excess is shared by
   weight among the others (water filling, solved in one pass over the
   sources in order of words per weight).
3. A source gets the slots that its target fills, a block each; the last slot
   of its last epoch is trimmed to the words still missing, so its taken words
   are its target but for a rounded word. The output consists of shards of
   ``SHARD`` slots. A pseudorandom permutation of all slots deals them out to the
   shards: the source counts of the shards are multinomial draws by the
   targets' shares, conditioned on the sources' totals (unconditioned ones would
   miss the targets of small sources).
4. A source's slots, numbered through all shards, run through a pseudorandom
   permutation of its block numbers (swap-or-not: a permutation of any range
   from hashes alone), one permutation per epoch. Joining documents and slots
   by block number gives what the mix takes of each document, and for which
   shard.

No document, block or source is ever collected: a document's place in its
stream comes from sums over hashed buckets of the source (``BUCKETS``), so a
source with a third of all rows is spread over as many tasks, and slots are
expanded in two steps, dealt out to tasks before each. Tables per source and
per bucket are small; a stream has no order but that of hashes.

Edge cases: null text: size 0, taken 0; a null source is a source, last in
order; a null doc_id is a document like others; repeated rows are different
documents of one size; ties in the order of a stream occur between equal rows
only, so reruns agree; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, store, words

WEIGHTS = (5.0, 2.0, 1.0)    # of the sources in order, repeating
TOTAL = 1.5                  # words of the mix per word of input
MOST = 2.0                   # times a source may be taken
BLOCK = 128                  # words
SHARD = 8192                 # slots of an output shard
TASK_SLOTS = 32_768          # slots expanded by one task
TASK_RANGES = 4096           # ranges of so many slots that one row is expanded into
BUCKETS = 4096               # parts of a source's stream
ROUNDS = 20                  # of swap-or-not
SEED = 2024


def permute(x: Column, n: Column, *key: Column, back: bool = False) -> Column:
    """Where a pseudorandom permutation of 0..n-1, chosen by ``key``, sends x;
    ``back``: which number it sends to x (every round is its own inverse)."""
    def swap_or_not(at: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), r, *key), n) - at, n)
        return F.when(F.xxhash64(F.lit(SEED), F.greatest(at, mirror), r, *key).bitwiseAND(1) == 1, mirror).otherwise(at)

    rounds = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if back else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, x.cast("long"), swap_or_not)


def targets(sizes: DataFrame) -> DataFrame:
    """(s, source, source_size, target, blocks): one row per source. s: its
    place in order of code points, null last. ``sizes``: (source, size)."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source: the windows below run over sources, not documents
    place = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), F.pmod("s", F.lit(len(WEIGHTS))) + 1)
    by = by.withColumn("s", F.row_number().over(place) - 1).withColumn("w", w).withColumn(
        "most", F.col("source_size") * MOST)
    upto = Window.orderBy(F.col("most") / F.col("w"), "s")
    every = upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    by = (by.withColumn("all", F.sum("source_size").over(every) * TOTAL)
          .withColumn("full", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
          .withColumn("left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
          .withColumn("level", (F.col("all") - F.col("full")) / F.col("left")))
    # the first source that its share does not fill sets the level for the rest
    by = by.withColumn("open", F.min(F.when(F.col("level") * F.col("w") <= F.col("most"),
                                            F.struct((F.col("most") / F.col("w")).alias("at"), "s", "level"))).over(every))
    target = F.when(F.col("open").isNull(), F.col("most")).otherwise(
        F.least(F.col("open.level") * F.col("w"), F.col("most")))
    return (by.withColumn("target", target)
            .withColumn("blocks", F.ceil(F.col("source_size") / BLOCK).cast("long"))
            .select("s", "source", "source_size", "target", "blocks"))


def slot_counts(sources: DataFrame) -> DataFrame:
    """``sources`` with, per source, how many slots it gets (``n``), how many
    words of its last epoch are wanted (``rest``), the slot of that epoch that
    holds the stream's short last block (``tail_at``), and the number of its first
    slot among those of all sources (``lo``; ``all``: of all sources)."""
    size, words_ = F.col("source_size"), F.round("target").cast("long")
    rest = F.when(size > 0, F.pmod(words_, size)).otherwise(0).cast("long")
    epochs = F.when(size > 0, F.floor(words_ / size)).otherwise(0).cast("long")
    d = sources.withColumn("rest", rest).withColumn("epochs", epochs).withColumn(
        "tail_at", F.when(F.col("blocks") > 0, permute(F.col("blocks") - 1, F.col("blocks"), F.col("s"), F.col("epochs"), back=True)))
    full = F.ceil(F.col("rest") / BLOCK)
    short = BLOCK * F.col("blocks") - F.col("source_size")     # words that the last block lacks
    last = F.when(F.col("tail_at") < full, F.ceil((F.col("rest") + short) / BLOCK)).otherwise(full)
    d = d.withColumn("short", short).withColumn("n", (F.col("epochs") * F.col("blocks") + last).cast("long")).where("n > 0")
    order = Window.orderBy("s")            # one row per source
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return d.withColumn("lo", F.sum("n").over(order) - F.col("n")).withColumn("all", F.sum("n").over(every))


def slots(counted: DataFrame, about: int) -> DataFrame:
    """(shard, s, block, epoch, upto): one row per slot of the mix: the block it
    takes, in which epoch of its source, and how many words of it (the first).
    ``counted``: from ``slot_counts``; ``about``: how many slots there are."""
    wide = TASK_SLOTS * TASK_RANGES
    ranges = (counted.withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(wide).cast("long"))))
              .repartition(about // wide + 1, "s", "a")
              .withColumn("a", F.explode(F.sequence(F.col("a"), F.least(F.col("a") + wide, F.col("n")) - 1,
                                                    F.lit(TASK_SLOTS).cast("long"))))
              .repartition(about // TASK_SLOTS + 1, "s", "a"))
    d = ranges.withColumn("slot", F.explode(F.sequence(F.col("a"), F.least(F.col("a") + TASK_SLOTS, F.col("n")) - 1)))
    place = F.pmod("slot", F.col("blocks"))
    d = (d.withColumn("epoch", F.floor(F.col("slot") / F.col("blocks")))
         .withColumn("block", permute(place, F.col("blocks"), F.col("s"), F.col("epoch")))
         .withColumn("shard", F.floor(permute(F.col("lo") + F.col("slot"), F.col("all"), F.lit(-1)) / SHARD)))
    # words of the last epoch's slots before this one
    before = BLOCK * place - F.when(place > F.col("tail_at"), F.col("short")).otherwise(0)
    upto = F.when(F.col("epoch") < F.col("epochs"), F.lit(BLOCK)).otherwise(F.least(F.lit(BLOCK), F.col("rest") - before))
    return d.select("shard", "s", "block", F.col("epoch").cast("int").alias("epoch"), upto.cast("int").alias("upto"))


def draws(slots_: DataFrame) -> DataFrame:
    """(shard, s, n): how many slots of each shard a source got."""
    return slots_.groupBy("shard", "s").agg(F.count(F.lit(1)).alias("n"))


def placed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` (rid, doc_id, source, size, h) with their source's row and
    ``start``, the place of their first word in the source's stream."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.lit(BUCKETS)))
    ahead = Window.partitionBy("source").orderBy("bucket")
    offsets = (rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
               .withColumn("offset", F.sum("words").over(ahead) - F.col("words")).drop("words")
               .join(sources.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_")))
               .drop("source_").withColumnsRenamed({"source": "of", "bucket": "part"}))
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "h", "size", "rid")
    return (rows.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
            .join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("part")))
            .withColumn("start", F.col("offset") + F.col("inside")).drop("of", "part", "bucket", "offset", "inside", "blocks"))


def pieces(at: DataFrame, slots_: DataFrame) -> DataFrame:
    """(rid, first, n, epoch, shard): the taken runs of every row's words, by slot."""
    lo = lambda b: F.greatest(b * BLOCK, F.col("start"))
    cut = (at.where("size > 0").select("rid", "s", "start", "size", F.explode(F.sequence(
        F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK))).alias("block"))
        .select("rid", "s", "block", "start", lo(F.col("block")).alias("lo"), (F.col("start") + F.col("size")).alias("end")))
    # Spark takes the expanded slots for as small as the sources they come from
    # and would broadcast the blocks, which grow with the corpus
    n = F.least(F.col("block") * BLOCK + F.col("upto"), F.col("end")) - F.col("lo")
    return (cut.join(slots_.hint("merge"), ["s", "block"])
            .select("rid", (F.col("lo") - F.col("start")).alias("first"), n.alias("n"), "epoch", "shard").where("n > 0"))


def _rows(docs: DataFrame, rid: Column) -> DataFrame:
    return docs.select(rid.alias("rid"), "doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"),
                       F.xxhash64("text").alias("h"))


def _plan(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The placed rows and the pieces the mix takes of them."""
    sources = store(targets(rows), "mixing-sources")
    at = store(placed(rows, sources), "mixing-placed")
    counted = store(slot_counts(sources), "mixing-counts")
    return at, pieces(at, slots(counted, counted.agg(F.sum("n")).first()[0] or 0))


def shares(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and shards (pieces that the mix
    takes, by shard, are counted once a shard) of every row of ``docs``."""
    at, taken = _plan(store(_rows(docs, F.monotonically_increasing_id()), "mixing-rows"))
    got = taken.groupBy("rid").agg(F.sum("n").alias("taken"), F.size(F.collect_set("shard")).alias("shards"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return at.join(got, "rid", "left").select("doc_id", "size", "source_size", "target", none("taken"), none("shards"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: for each epoch that
    takes any of a document's words, one row whose text is what it takes (the
    text as it is when all of it is taken, else its runs of words joined by
    spaces). Documents of which nothing is taken have no row."""
    rid, got, w = fresh(docs, "mix_rid", "mix_got", "mix_words")
    kept = store(docs.withColumn(rid, F.monotonically_increasing_id()), "mixing-documents")
    _, taken = _plan(store(_rows(kept, F.col(rid)), "mixing-rows"))
    runs = (taken.groupBy("rid", "epoch").agg(F.array_sort(F.collect_list(F.struct("first", "n"))).alias("runs"),
                                              F.sum("n").alias("n"))
            .select(F.col("rid").alias(rid), F.struct("epoch", "runs", "n").alias(got)))
    d = kept.join(runs, rid).withColumn(w, words(F.col("text")))
    piece = F.array_join(F.flatten(F.transform(F.col(f"{got}.runs"), lambda r: F.slice(
        F.col(w), (r["first"] + 1).cast("int"), r["n"].cast("int")))), " ")
    text = F.when(F.col(f"{got}.n") == F.size(w), F.col("text")).otherwise(piece)
    return d.withColumn("text", text).select(*docs.columns)
