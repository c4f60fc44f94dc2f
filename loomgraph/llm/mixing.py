"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

The mix is a sequence of slots of `block` words. Slot i's point, i times the golden ratio mod 1, falls into one source's
stretch of the cumulative target shares; the slots of a source are ranked; slot number r of a source takes block r mod
(number of blocks) of that source's documents, laid end to end in an order shuffled by a digest of doc_id. Each source so
gets its share of every stretch of the mix, repeats of a block lie a whole pass apart, and any slot can be found again
from its number alone.

Edge cases: a null text has size 0; a null source is a source of its own, after all others; a document of no words takes
nothing; rows repeated in the input are documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Words in a slot: what a source's taken words may be off its target by is a few of these.
BLOCK = 64
#: Weights by the source's place, repeating; the mix's size against the input's; the most times that a document is read.
WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
#: Pieces that each source's shuffled order is cut into, so that no window holds a whole source; slots ranked together.
SPLITS, CHUNK = 4096, 1 << 16
#: Cells of the unit interval on which slots meet sources.
CELLS = 4096
#: 2**32 over the golden ratio squared: its multiples mod 2**32 are the golden-ratio points, in integers.
STEP, RING = 1640531527, 1 << 32


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: words of the whole text."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", words.alias("size"))


def targets(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target, low, high: one row per source of sized documents; [low, high) is its stretch of 0 to 1.

    Water-filling: sources in ascending order of cap over weight; the first whose cap isn't above its part of what is
    left ends the capped ones. The windows run over one row per source, never over documents.
    """
    one = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    cap = F.col("source_size").cast("double") * repeats
    one = one.select("source", "source_size", place.alias("place"), weight.alias("weight"), cap.alias("cap"))
    order = everything.orderBy(F.col("cap") / F.col("weight"), "place")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything).cast("double") * share - before) / after
    one = one.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    # The first level that its own cap allows holds for every later source; the earlier ones stand at their caps.
    flat = F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    one = one.withColumn("target", F.coalesce(flat * F.col("weight"), F.col("cap")))
    upto = everything.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total, high = F.sum("target").over(everything), F.sum("target").over(upto)
    ring = lambda c: F.when(total > 0, F.round(c / total * RING).cast("long")).otherwise(F.lit(0).cast("long"))
    return one.select("source", "source_size", "target", "place", ring(high - F.col("target")).alias("low"), ring(high).alias("high"), total.alias("total"))


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, place, rank, block, pass: the whole mix, one row per slot, from the rows of targets().

    Slots meet sources on cells of the unit interval (an equi-join with at most CELLS rows more than sources), and are
    ranked within chunks of the sequence, to which the earlier chunks' counts are added: no window holds a hot source.
    Slots beyond the allowed repeats of a source are left out.
    """
    spark = sources.sparkSession
    total = sources.agg(F.max("total")).first()[0] or 0.0
    slots = spark.range(0, int(-(-total // block))).withColumnRenamed("id", "slot")
    slots = slots.withColumn("point", F.col("slot") % RING * STEP % RING)
    wide = RING // CELLS
    cells = sources.where("high > low").select(
        "place", "source_size", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / wide), F.floor((F.col("high") - 1) / wide))).alias("cell")
    )
    hit = slots.withColumn("cell", F.floor(F.col("point") / wide)).join(cells, "cell").where("point >= low and point < high")
    hit = hit.select("slot", "place", "source_size", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = hit.groupBy("place", "chunk").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("place", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    rank = F.col("base") + F.row_number().over(Window.partitionBy("place", "chunk").orderBy("slot")) - 1
    blocks = F.ceil(F.col("source_size") / block)
    out = hit.join(counts, ["place", "chunk"]).select("slot", "place", rank.alias("rank"), blocks.alias("blocks"))
    out = out.where(F.col("rank") < F.col("blocks") * REPEATS)
    return out.select("slot", "place", "rank", (F.col("rank") % F.col("blocks")).alias("block"), F.floor(F.col("rank") / F.col("blocks")).alias("pass"))


def streams(docs: DataFrame) -> DataFrame:
    """sized documents with start: the words of its source that come before it in the shuffled order."""
    key = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    docs = docs.withColumn("key", key).withColumn("split", (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % SPLITS))
    # conv of the first digits keeps no order, so the split leads the order itself
    sums = docs.groupBy("source", "split").agg(F.sum("size").alias("part"))
    earlier = Window.partitionBy("source").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("split").alias("p"), F.coalesce(F.sum("part").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "split").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    docs = docs.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("split") == F.col("p")))
    return docs.select("doc_id", "source", "size", (F.col("base") + F.col("inner")).alias("start"))


def overlap(start: Column, end: Column, upto: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(end, upto) - start)


def takes(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of each document the mix takes.

    Slots of rank r take block r mod b, so the n slots of a source read its blocks n div b times, and its first n mod b
    blocks once more: a document's part of those follows from where it starts, without a row per slot and document.
    """
    docs = cut(sized(docs))  # the texts are read once
    sources = targets(docs)
    slots = schedule(sources, block).groupBy("place").agg(F.count(F.lit(1)).alias("slots"))
    sources = sources.join(slots, "place", "left").select(
        F.col("source").alias("s"), "source_size", "target", F.coalesce("slots", F.lit(0)).alias("slots"), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / block)).alias("blocks")
    )
    docs = streams(docs).join(sources, F.col("source").eqNullSafe(F.col("s")))
    again = F.floor(F.col("slots") / F.col("blocks"))
    more = overlap(F.col("start"), F.col("start") + F.col("size"), F.col("slots") % F.col("blocks") * block)
    return docs.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * again + more).cast("long").alias("taken"))
