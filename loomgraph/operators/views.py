"""Aggregates and structural views: counts, degrees, reports, document graph, clusters and bundles for a viewer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import absolute, haystack, is_symbol, meta, tokens
from ..schema import REFERENCE_EDGES, SYMBOL_KINDS
from .search import incident


def counts(df: DataFrame, by: str = "kind") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree_in, degree_out, degree of every end of an edge; a loop counts twice."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.i").alias("degree_in"), F.sum("e.o").alias("degree_out"), F.count(F.lit(1)).alias("degree"))


def ranked(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node with its degrees."""
    zero = F.lit(0).cast("long")
    return nodes.join(degrees(edges), "id", "left").withColumns({c: F.coalesce(c, zero) for c in ("degree_in", "degree_out", "degree")})


def topology_rank(nodes: DataFrame, edges: DataFrame, top_n: int = 10) -> DataFrame:
    return ranked(nodes, edges).orderBy(F.col("degree").desc(), "kind", "path", "id").limit(max(1, top_n))


def report_rank(nodes: DataFrame, edges: DataFrame, top_n: int = 10) -> DataFrame:
    return ranked(nodes, edges).orderBy(F.col("degree").desc(), F.col("degree_out").desc(), "kind", "path", "id").limit(max(1, top_n))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(incident(edges.select("id", "source_id", "target_id")).select(F.col("node_id").alias("id")).distinct(), "id", "left_anti")


def health(nodes: DataFrame, edges: DataFrame, omitted: DataFrame) -> DataFrame:
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(nodes, "nodes").crossJoin(one(edges, "edges")).crossJoin(one(omitted, "omitted"))  # three rows of one


def omitted_rate(nodes: DataFrame, edges: DataFrame, omitted: DataFrame) -> DataFrame:
    h = health(nodes, edges, omitted)
    return h.withColumn("omitted_rate", F.round(F.col("omitted") / F.greatest(F.lit(1), F.col("nodes") + F.col("edges")), 6))


def report_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """depends_on edges with both ends present."""
    s, t = (nodes.select(F.col("id").alias(f"{x}_id"), F.col("label").alias(f"{x}_label")) for x in ("source", "target"))
    return edges.where("kind = 'depends_on'").select("id", "source_id", "target_id").join(s, "source_id").join(t, "target_id")


def top_directories(nodes: DataFrame, edges: DataFrame, top_n: int = 10) -> DataFrame:
    holders = nodes.where("kind in ('project', 'directory')").select(F.col("id").alias("source_id"), "path")
    kids = edges.where("kind = 'contains'").select("source_id").join(holders, "source_id").groupBy("source_id", "path").agg(F.count(F.lit(1)).alias("children"))
    return kids.orderBy(F.col("children").desc(), "path").limit(max(1, top_n))


def recent_commits(nodes: DataFrame, top_n: int = 10) -> DataFrame:
    from .navigate import commit_order

    return nodes.where("kind = 'git_commit'").orderBy(*commit_order()).limit(max(1, top_n))


def doc_targets(edges: DataFrame, referrers: int = 5) -> DataFrame:
    """Per link target: all incoming links, and its first distinct referrers, in order.

    Referrers are made distinct before they are gathered, ranked in their target's window and cut there, so a target
    that half of all documents link to stays a sorted run on disk, not a list in memory.
    """
    links = edges.where(F.col("kind").isin(*REFERENCE_EDGES)).groupBy("target_id", "source_id").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("target_id").orderBy("source_id"))
    first = links.withColumn("r", rank).where(F.col("r") <= referrers).groupBy("target_id").agg(F.sort_array(F.collect_list("source_id")).alias("referrer_ids"))
    return links.groupBy("target_id").agg(F.sum("n").alias("incoming_count")).join(first, "target_id")


#: Distinct beginnings of labels up to which they are looked for where the documents lie.
HEADS = 2000


def mentions(docs: DataFrame, candidates: DataFrame, links: DataFrame | None = None, least: int = 4, max_results: int | None = None) -> DataFrame:
    """(doc_id, candidate_id): a document's text holds a candidate's label of `least` characters or more; linked pairs left out.

    Not all pairs are compared: of a label's words all but the first and last stand whole in a text that holds it, so
    a label meets only the documents with its longest inner word. Labels without one meet documents by their first
    `least` characters.
    """
    short = candidates.where(F.length("label") >= least).select(F.col("id").alias("candidate_id"), F.lower("label").alias("label"))
    words = F.split("label", "[^a-zA-Z0-9_]+")
    inner = F.filter(F.slice(words, 2, F.greatest(F.lit(0), F.size(words) - 2)), lambda w: w != "")
    longest = F.element_at(F.sort_array(F.transform(inner, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)["w"]
    short = short.withColumn("word", F.when(F.size(inner) > 0, longest))
    low = docs.select(F.col("id").alias("doc_id"), F.lower(haystack() if "kind" in docs.columns else F.col("text")).alias("hay"))
    by_word = low.select("doc_id", F.explode(tokens("hay")).alias("word")).join(short.where("word is not null"), "word").select("doc_id", "candidate_id", "label")
    rare = short.where("word is null").withColumn("head", F.substring("label", 1, least))
    heads = [r[0] for r in rare.select("head").distinct().limit(HEADS + 1).collect()]
    if heads:
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("hay") - least + 1)), lambda i: F.substring(F.col("hay"), i, F.lit(least))))
        if len(heads) <= HEADS:
            # so few beginnings go to the documents, and only what begins a label is shuffled
            grams = F.array_intersect(grams, F.array(*(F.lit(h) for h in sorted(heads))))
        by_word = by_word.unionByName(low.select("doc_id", F.explode(grams).alias("head")).join(rare, "head").select("doc_id", "candidate_id", "label"))
    hits = by_word.join(low, "doc_id").where(F.contains("hay", "label") & (F.col("doc_id").cast("string") != F.col("candidate_id").cast("string"))).select("doc_id", "candidate_id")
    if links is not None:
        hits = hits.join(links.select(F.col("source_id").alias("doc_id"), F.col("target_id").alias("candidate_id")), ["doc_id", "candidate_id"], "left_anti")
    return hits if max_results is None else hits.orderBy("doc_id", "candidate_id").limit(max_results)


def privacy_profile(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Full and hashed e-mail fields, absolute paths, and whether the graph may leave the house."""
    has = lambda key: F.when(F.coalesce(meta("metadata", key), F.lit("")) != "", 1).otherwise(0)
    both = nodes.select("path", "metadata").unionByName(edges.select("path", "metadata"))
    sums = both.agg(
        F.sum(has("author_email") + has("committer_email")).alias("full_email_fields"),
        F.sum(has("author_email_hash") + has("committer_email_hash")).alias("hashed_email_fields"),
        F.sum(F.when(absolute("path"), 1).otherwise(0)).alias("absolute_refs"),
    )
    sums = sums.select(*(F.coalesce(c, F.lit(0)).alias(c) for c in sums.columns))
    return sums.withColumn("export_safe", (F.col("full_email_fields") == 0) & (F.col("absolute_refs") == 0))


PRESETS = frozenset("changed_recently doc_links file_map high_degree orphans symbol_map".split())


def preset(name: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes that an investigation preset looks at; high_degree only orders, so it keeps all."""
    if name == "file_map":
        return nodes.where("kind = 'file'")
    if name == "symbol_map":
        return nodes.where(F.col("kind").isin(*SYMBOL_KINDS))
    if name == "doc_links":
        ends = edges.where(F.col("kind").isin(*REFERENCE_EDGES, "documents")).select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
        return nodes.join(ends, "id", "left_semi")
    if name == "changed_recently":
        return nodes.where(meta("metadata", "freshness").isin("changed", "fresh") | meta("metadata", "committer_time_epoch").isNotNull())
    if name == "orphans":
        return orphans(nodes, edges)
    if name == "high_degree":
        return nodes
    raise ValueError(f"preset must be one of {sorted(PRESETS)}")


def symbols(nodes: DataFrame) -> DataFrame:
    return nodes.where(is_symbol(F.col("kind")))


# --- viewer ---


def positions(ids: DataFrame, column: str = "id", chunk: int = 1 << 16) -> DataFrame:
    """ids with `position` (from 0) in ascending order, without one task that holds them all.

    Rows go to tasks by ranges and are numbered there; each task's rows are counted, and the counts of the ones before
    it added: what one window sees is a row per task.
    """
    placed = ids.repartitionByRange(column).withColumn("task", F.spark_partition_id())
    from ..session import cut

    placed = cut(placed)
    inner = F.row_number().over(Window.partitionBy("task").orderBy(column)) - 1
    tasks = placed.groupBy("task").agg(F.count(F.lit(1)).alias("rows"))
    base = F.coalesce(F.sum("rows").over(Window.partitionBy(F.lit(0)).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("inner", inner).join(F.broadcast(tasks.select("task", base.alias("base"))), "task").withColumn("position", (F.col("inner") + F.col("base")).cast("long")).drop("task", "inner", "base")


def clusters(nodes: DataFrame, edges: DataFrame, size: int = 24) -> DataFrame:
    """id, cluster: nodes in order of id, cut into runs of at least four."""
    return positions(nodes.select("id")).select("id", F.floor(F.col("position") / max(4, size)).cast("long").alias("cluster"))


def cluster_summary(nodes: DataFrame, edges: DataFrame, size: int = 24) -> DataFrame:
    """Per cluster: members, degree sum, its representative and its three hubs by degree."""
    deg = ranked(nodes.select("id"), edges).select("id", "degree")
    own = clusters(nodes, edges, size).join(deg, "id")
    return own.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("node_count"), F.sum("degree").alias("edge_count"), F.min("id").alias("representative_id"),
        F.transform(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("degree")).alias("d"), "id"))), 1, 3), lambda x: x["id"]).alias("hub_ids"),
    )


def edge_bundles(assigned: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between two clusters (id, cluster): how many, of how many kinds, and the first edge's id."""
    a = assigned.select(F.col("id").alias("source_id"), F.col("cluster").alias("a"))
    b = assigned.select(F.col("id").alias("target_id"), F.col("cluster").alias("b"))
    pairs = edges.select("id", "kind", "source_id", "target_id").join(a, "source_id").join(b, "target_id").where("a <> b")
    return pairs.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.count(F.lit(1)).alias("edge_count"), F.count_distinct("kind").alias("kinds"), F.min("id").alias("first_edge_id"))


def visible_edges(selected: DataFrame, edges: DataFrame, budget: int | None = None) -> DataFrame:
    """Edges with both ends selected, in order of id, up to a budget."""
    ids = selected.select("id")
    out = edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return out if budget is None else out.orderBy("id").limit(budget)


def related(nodes: DataFrame, edges: DataFrame, node_id: str, per_bucket: int = 5) -> DataFrame:
    """Neighbours by bucket (files, symbols, docs, other), the first of each by edge id."""
    from ..functions import related_bucket

    own = edges.where((F.col("source_id") == node_id) | (F.col("target_id") == node_id)).select(F.col("id").alias("edge_id"), F.when(F.col("source_id") == node_id, F.col("target_id")).otherwise(F.col("source_id")).alias("other"))
    near = own.join(nodes, F.col("other") == F.col("id")).withColumn("bucket", related_bucket(F.col("kind"), F.col("path")))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("edge_id"))
    return near.withColumn("n", rank).where(F.col("n") <= per_bucket).select("bucket", "n", "edge_id", "id", "kind", "label")
