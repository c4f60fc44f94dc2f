"""Suffix ranks by a distributed difference cover modulo 3, and the repeated strings they show.

Suffixes that start at positions 1 and 2 modulo 3 are sorted by their first three symbols, which gives names; where names
repeat, the string of names is ranked by the same means, and its ranks order the sampled suffixes. The others are ordered
by their first symbol and the next sampled suffix, and merged by counting, for each suffix, those below it in the unions
of two classes. Every order is a range partitioning numbered from per-task counts: no task holds all positions.

A position costs tens of bytes in each of several shuffles (the README has figures), so whole corpora go through exact.py.
Edge cases: null and empty texts hold no suffix; every document ends in a symbol of its own, so no match crosses; an empty
table gives no rows. Documents are numbered by doc_id, which must be unique here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut


def numbered(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df with its row number (from 0) in the order of unique keys."""
    placed = cut(df.repartitionByRange(*by).withColumn("task", F.spark_partition_id()))
    inner = F.row_number().over(Window.partitionBy("task").orderBy(*by)) - 1
    sizes = placed.groupBy("task").agg(F.count(F.lit(1)).alias("rows"))
    base = F.coalesce(F.sum("rows").over(Window.partitionBy(F.lit(0)).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a task: its size is bounded by the number of partitions
    return placed.withColumn("inner", inner).join(F.broadcast(sizes.select("task", base.alias("base"))), "task").withColumn(name, (F.col("inner") + F.col("base")).cast("long")).drop("task", "inner", "base")


def ranks(symbols: DataFrame) -> DataFrame:
    """pos, rank of every suffix of the string (pos from 0, sym above 0)."""
    n = symbols.count()
    if n < 2:
        return symbols.select("pos", F.lit(0).cast("long").alias("rank"))
    # a dummy position when the last one is 0 modulo 3, so that each of these has a sampled neighbour
    ends = [n + k for k in range(3)]
    spark = symbols.sparkSession
    padded = symbols.unionByName(spark.createDataFrame([(p, 0) for p in ends], "pos long, sym long"))
    near = padded.select(F.explode(F.array(*(F.struct((F.col("pos") - k).alias("pos"), F.lit(k).alias("k"), "sym") for k in range(3)))).alias("x")).select("x.*")
    last = n if n % 3 == 1 else n - 1
    near = near.where((F.col("pos") >= 0) & (F.col("pos") <= last))
    triples = cut(near.groupBy("pos").agg(*(F.max(F.when(F.col("k") == k, F.col("sym"))).alias(f"s{k}") for k in range(3))))
    sample = triples.where("pos % 3 <> 0")
    names = cut(numbered(sample.select("s0", "s1", "s2").distinct(), "name", "s0", "s1", "s2"))
    named = cut(sample.join(names, ["s0", "s1", "s2"]).select("pos", (F.col("name") + 1).alias("sym")))
    total, kinds = named.count(), names.count()
    if kinds == total:
        sampled = named.select("pos", (F.col("sym") - 1).alias("r"))
    else:
        ones = (last + 2) // 3  # positions 1 modulo 3 up to the last
        place = F.when(F.col("pos") % 3 == 1, F.floor(F.col("pos") / 3)).otherwise(F.floor(F.col("pos") / 3) + ones)
        below = ranks(named.select(place.cast("long").alias("pos"), "sym"))
        back = F.when(F.col("pos") < ones, F.col("pos") * 3 + 1).otherwise((F.col("pos") - ones) * 3 + 2)
        sampled = below.select(back.cast("long").alias("pos"), F.col("rank").alias("r"))
    sampled = cut(sampled)
    after = lambda k: sampled.select((F.col("pos") - k).alias("pos"), F.col("r").alias(f"r{k}"))
    keyed = triples.join(after(1), "pos", "left").join(after(2), "pos", "left").withColumn("m", F.col("pos") % 3)
    keyed = cut(keyed.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("r1", "r2")}))
    zero_one = numbered(keyed.where("m <> 2").select("pos", "m", "s0", "r1"), "p01", "s0", "r1")
    zero_two = numbered(keyed.where("m <> 1").select("pos", "m", "s0", "s1", "r2"), "p02", "s0", "s1", "r2")
    inside = numbered(zero_one.where("m = 0").select("pos", "p01"), "own", "p01").select("pos", "own")
    for m in (1, 2):
        inside = inside.unionByName(numbered(sampled.where(F.col("pos") % 3 == m), "own", "r").select("pos", "own"))
    all_ = inside.join(zero_one.select("pos", "p01"), "pos", "left").join(zero_two.select("pos", "p02"), "pos", "left").join(sampled, "pos", "left")
    rank = F.when(F.col("pos") % 3 == 0, F.col("p01") + F.col("p02") - F.col("own")).otherwise(F.col("r") + F.coalesce("p01", "p02") - F.col("own"))
    dummies = 1 if last == n else 0  # the dummy suffix is the least
    return cut(all_.where(F.col("pos") < n).select("pos", (rank - dummies).cast("long").alias("rank")))


def repeated_starts(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, at: byte positions whose `length` bytes start elsewhere too, by comparing each suffix with the next in rank."""
    sizes = docs.where("octet_length(coalesce(text, '')) > 0").select("doc_id", (F.octet_length("text") + 1).cast("long").alias("n"))
    order = numbered(sizes, "number", "doc_id")
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cut(order.select("doc_id", "number", before.alias("start"), "n"))
    hexes = docs.join(starts, "doc_id").select("doc_id", "start", "number", F.hex(F.col("text").cast("binary")).alias("h"), "n")
    each = hexes.select("start", "number", "n", F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.when(i < F.col("n") - 1, F.conv(F.substring(F.col("h"), (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("long") + 1))).alias("i", "sym"))
    symbols = cut(each.select((F.col("start") + F.col("i")).alias("pos"), F.coalesce("sym", F.col("number") + 257).alias("sym")))
    ranked = ranks(symbols)
    whole = ranked.join(docs.join(starts, "doc_id").select(F.explode(F.sequence("start", F.greatest("start", F.col("start") + F.col("n") - 1 - length))).alias("pos"), "doc_id", "start", "n"), "pos").where(F.col("pos") + length <= F.col("start") + F.col("n") - 1)
    text = docs.select("doc_id", F.col("text").cast("binary").alias("raw"))
    head = cut(whole.join(text, "doc_id").select("rank", "doc_id", (F.col("pos") - F.col("start")).alias("at"), F.md5(F.substring("raw", (F.col("pos") - F.col("start") + 1).cast("int"), F.lit(length))).alias("head")))
    # equal prefixes stand next to each other, but suffixes shorter than `length` may stand between: these were left out
    near = numbered(head, "k", "rank")
    next_ = near.select((F.col("k") - 1).alias("k"), F.col("head").alias("next"))
    last = near.select((F.col("k") + 1).alias("k"), F.col("head").alias("last"))
    return near.join(next_, "k", "left").join(last, "k", "left").where("head = next or head = last").select("doc_id", "at")
