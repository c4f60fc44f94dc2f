"""Set operations and differences between graphs and manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..schema import GraphError


def compared(pairs: list[tuple[str, DataFrame, DataFrame, str, bool]]) -> DataFrame:
    """item_kind, status (added, removed or changed), item_id of pairs (item_kind, old, new, key, whether rows are compared).

    All sides in one aggregation by id: rows meet as counts and as two 64-bit digests, of which the least and the greatest
    are kept, so nothing is sorted and one id is one small row. An id has one status, also where a side repeats it.
    """
    def side(df: DataFrame, what: str, key: str, rest: list[str], then: int) -> DataFrame:
        texts = [F.to_json(c) if isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)) else F.col(c).cast("string") for c in rest]
        digests = [F.xxhash64(F.lit(seed), *(x for t in texts for x in (t, t.isNull()))) if rest else F.lit(0).cast("long") for seed in (1, 2)]
        return df.select(F.lit(what).alias("item_kind"), F.col(key).alias("item_id"), F.lit(then).alias("then"), digests[0].alias("a"), digests[1].alias("b"))

    every = reduce(DataFrame.unionByName, (side(df, what, key, [c for c in old.columns if c != key] if rows else [], then) for what, old, new, key, rows in pairs for then, df in enumerate((old, new))))
    met = every.groupBy("item_kind", "item_id").agg(F.min("then").alias("first"), F.max("then").alias("last"), *(f(c).alias(f"{c}{n}") for c in "ab" for n, f in enumerate((F.min, F.max))))
    status = F.when(F.col("first") == 1, "added").when(F.col("last") == 0, "removed").when((F.col("a0") != F.col("a1")) | (F.col("b0") != F.col("b1")), "changed")
    return met.select("item_kind", status.alias("status"), "item_id").where("status is not null")


def _pairs(old, new, rows: bool) -> list:
    lost = lambda s: s.omitted.select(F.concat_ws(":", "reason", "item_id").alias("id"))
    return [("node", old.nodes, new.nodes, "id", rows), ("edge", old.edges, new.edges, "id", rows), ("omitted", lost(old), lost(new), "id", False)]


def structural(old, new) -> DataFrame:
    """item_kind, status, item_id: ids added and removed; omitted rows count as a set of reason:item_id."""
    return compared(_pairs(old, new, False))


def changed(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Keys in both whose rows differ."""
    return compared([("", old, new, key, True)]).where("status = 'changed'").select(F.col("item_id").alias(key))


def ci_delta(old, new) -> DataFrame:
    """structural() and changed ids."""
    return compared(_pairs(old, new, True))


def header_changes(old: dict, new: dict) -> list[str]:
    return sorted(k for k in {*old, *new} if old.get(k) != new.get(k))


def path_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, status, reasons of two manifests: a full join."""
    fields = ("content_hash", "parser", "parser_version", "size_bytes", "file_kind")
    o, n = (df.select("path", F.struct(*fields).alias(x)) for df, x in ((old, "o"), (new, "n")))
    both = o.join(n, "path", "full")
    reasons = F.array_compact(F.array(*(F.when(F.col(f"o.{f}") != F.col(f"n.{f}"), f"{f}_changed") for f in fields)))
    status = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.size(reasons) > 0, "changed").otherwise("unchanged")
    reasons = F.when(F.col("o").isNull(), F.array(F.lit("new_path"))).when(F.col("n").isNull(), F.array(F.lit("path_missing"))).otherwise(reasons)
    return both.select("path", status.alias("status"), reasons.alias("reasons"))


def refresh_sets(changes: DataFrame) -> DataFrame:
    """path_changes() with what a refresh has to parse again: new paths, new content or a new parser version."""
    again = F.col("status").isin("added") | F.arrays_overlap("reasons", F.array(F.lit("content_hash_changed"), F.lit("parser_version_changed")))
    return changes.withColumn("parse", again)


def first_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key."""
    rest = F.struct(*order, *(c for c in df.columns if c not in (key, *order)))
    first = df.groupBy(key).agg(F.min(rest).alias("r"))  # combined before the shuffle, unlike a ranking window
    return first.select(*(F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in df.columns))


def last_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    rest = F.struct(*order, *(c for c in df.columns if c not in (key, *order)))
    last = df.groupBy(key).agg(F.max(rest).alias("r"))
    return last.select(*(F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in df.columns))


def duplicates(df: DataFrame, key: str = "id") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def disjoint_union(parts: list[DataFrame], what: str) -> DataFrame:
    """All rows of the parts; an id in more than one place is an error."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if (twice := duplicates(out).select("id").orderBy("id").limit(20).collect()):
        raise GraphError(f"DUPLICATE_{what}_ID", "inputs share ids", ids=[r[0] for r in twice])
    return out


def snapshot_patch(old, new) -> DataFrame:
    """Ordered operations that turn one graph into another: op, position, item_id."""
    gone = lambda a, b, op: a.select("id").join(b.select("id"), "id", "left_anti").select(F.lit(op).alias("op"), F.col("id").alias("item_id"))
    new_ = lambda a, b, op: b.select("id").join(a.select("id"), "id", "left_anti").unionByName(changed(a, b)).select(F.lit(op).alias("op"), F.col("id").alias("item_id"))
    ops = [("edge_delete", gone(old.edges, new.edges, "edge_delete")), ("node_delete", gone(old.nodes, new.nodes, "node_delete")), ("node_upsert", new_(old.nodes, new.nodes, "node_upsert")), ("edge_upsert", new_(old.edges, new.edges, "edge_upsert"))]
    out = ops[0][1].withColumn("position", F.lit(0))
    for i, (_, df) in enumerate(ops[1:], 1):
        out = out.unionByName(df.withColumn("position", F.lit(i)))
    return out


def patched(rows: DataFrame, upserts: DataFrame, deletes: DataFrame, key: str = "id") -> DataFrame:
    """rows after a delta: those neither deleted nor replaced, and the upserts."""
    return rows.join(upserts.select(key).unionByName(deletes.select(key)), key, "left_anti").unionByName(upserts)


def unique_transitions(old: DataFrame, new: DataFrame, *match: str) -> DataFrame:
    """previous_id, current_id of rows that match on some columns and are alone in that on both sides, under another id."""
    def alone(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*match).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias(name)).where("n = 1").drop("n")

    return alone(old, "previous_id").join(alone(new, "current_id"), list(match)).where("previous_id <> current_id").select("previous_id", "current_id")


def ranked_rows(df: DataFrame, partition: str, *order: str, n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(partition).orderBy(*order))).where(F.col("rank") <= n)
