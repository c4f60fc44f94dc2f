"""Structural lookups: who depends on, imports, links to or touches a node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import meta
from ..schema import GIT_EDGES, REFERENCE_EDGES, STATIC_EDGES, GraphError
from ..session import cut


def _sources(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...], target: str) -> DataFrame:
    """One row per edge of these kinds into a node, with the edge's source; in order of edge id."""
    hit = edges.where(F.col("kind").isin(*kinds) & (F.col("target_id") == target)).select(F.col("id").alias("edge_id"), F.col("kind").alias("edge_kind"), "source_id")
    return hit.join(nodes, F.col("source_id") == F.col("id")).select("edge_id", "edge_kind", "id", "kind", "label", "path", F.lit(100.0).alias("score"))


def limited(hits: DataFrame, max_results: int | None, *order: str) -> DataFrame:
    return hits.orderBy(*order).limit(max(0, max_results)) if max_results is not None else hits


def reverse_dependencies(nodes: DataFrame, edges: DataFrame, target: str, max_results: int | None = 10) -> DataFrame:
    return limited(_sources(nodes, edges, ("depends_on",), target), max_results, "edge_id")


def backlinks(nodes: DataFrame, edges: DataFrame, target: str, max_results: int | None = 10) -> DataFrame:
    return limited(_sources(nodes, edges, REFERENCE_EDGES, target), max_results, "edge_id")


def reverse_imports(nodes: DataFrame, edges: DataFrame, target: str, max_results: int | None = 10) -> DataFrame:
    """Nodes that import a module: by edges into its resolved import nodes, and files at those nodes' source_path."""
    imports = edges.where("kind = 'imports'")
    resolved = imports.where((F.col("target_id") == target) & (meta("metadata", "resolved") == "true"))
    via = resolved.select(F.col("id").alias("edge_id"), F.col("source_id").alias("import_id")).join(nodes.select(F.col("id").alias("import_id"), meta("metadata", "source_path").alias("source_path")), "import_id")
    by_edge = via.join(imports.select(F.col("target_id").alias("import_id"), F.col("source_id").alias("id"), F.col("id").alias("second")), "import_id").where("id <> import_id")
    by_path = via.where("source_path <> ''").join(nodes.where("kind = 'file'").select("id", "path"), F.col("path") == F.col("source_path"))
    found = by_edge.select("id", F.struct("edge_id", F.lit(0).alias("branch"), F.col("second").alias("at")).alias("first")).unionByName(by_path.select("id", F.struct("edge_id", F.lit(1).alias("branch"), F.col("id").alias("at")).alias("first")))
    once = found.groupBy("id").agg(F.min("first").alias("first"))
    return limited(once.join(nodes, "id").select("id", "kind", "label", "path", "first", F.lit(100.0).alias("score")), max_results, "first", "id").drop("first")


def resolution_class(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with `resolution`: static, heuristic or unsupported."""
    ends = nodes.select("id", "path", (meta("metadata", "external") == "true").alias("external"))
    s = ends.select(F.col("id").alias("source_id"), F.col("path").alias("source_path"))
    t = ends.select(F.col("id").alias("target_id"), F.col("path").alias("target_path"), "external")
    symbols = edges.where("kind in ('calls', 'inherits')").join(s, "source_id", "left").join(t, "target_id", "left")
    local = F.coalesce((F.col("source_path") == F.col("target_path")) & ~F.coalesce("external", F.lit(False)), F.lit(False))
    symbols = symbols.select(*edges.columns, F.when(local, "static").otherwise("heuristic").alias("resolution"))
    # only calls and inheritance look at the ends: the other edges need no join
    plain = F.when(F.col("kind").isin(*STATIC_EDGES), "static").when(F.col("kind") == "imports", F.when(meta("metadata", "resolved") == "true", "static").otherwise("heuristic")).otherwise("unsupported")
    return edges.where("kind not in ('calls', 'inherits')").withColumn("resolution", plain).unionByName(symbols)


def impact(nodes: DataFrame, edges: DataFrame, node_id: str) -> tuple[DataFrame, DataFrame]:
    """Hits by static edges into a node, and the edges that are only heuristic or unsupported."""
    inbound = resolution_class(edges.where(F.col("target_id") == node_id), nodes).withColumnRenamed("id", "edge_id").withColumnRenamed("kind", "edge_kind")
    sure = inbound.where("resolution = 'static'").select("edge_id", "edge_kind", "source_id", "resolution")
    hits = sure.join(nodes, F.col("source_id") == F.col("id")).select("edge_id", "edge_kind", "resolution", "id", "kind", "label", "path", F.lit(100.0).alias("score"))
    return hits, inbound.where("resolution <> 'static'").select(F.lit("impact_edge_unresolved").alias("reason"), F.col("edge_id").alias("item_id"), "edge_kind", "resolution")


def _git(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """commit_id, edge_id, edge_kind, target_id, target_kind, place of every touch of a path by a commit."""
    touch = edges.where(F.col("kind").isin(*GIT_EDGES)).select(F.col("id").alias("edge_id"), F.col("kind").alias("edge_kind"), F.col("source_id").alias("commit_id"), "target_id")
    target = nodes.select(F.col("id").alias("target_id"), F.col("kind").alias("target_kind"), F.when(F.col("path") != "", F.col("path")).otherwise(F.col("label")).alias("place"))
    return touch.join(target, "target_id")


def commit_order() -> list[Column]:
    epoch = lambda key: F.coalesce(meta("metadata", key).cast("long"), F.lit(0))
    return [epoch("committer_time_epoch").desc(), epoch("author_time_epoch").desc(), F.col("id")]


def commits_for_path(nodes: DataFrame, edges: DataFrame, target_path: str, max_results: int = 10) -> DataFrame:
    """Commits that touch a path, newest first."""
    own = _git(nodes, edges).where(F.col("place") == target_path.strip().strip("/")).select("commit_id").distinct()
    commits = nodes.where("kind = 'git_commit'").join(own, F.col("id") == F.col("commit_id"), "left_semi")
    return commits.orderBy(*commit_order()).limit(max(0, max_results))


def find_commit(nodes: DataFrame, ref: str) -> str | None:
    """Id of the commit with that id or, if just one has it, full or short hash."""
    commits = nodes.where("kind = 'git_commit'")
    hit = commits.where((F.col("id") == ref) | (meta("metadata", "commit_hash") == ref) | (meta("metadata", "short_commit_hash") == ref)).select("id").limit(2).collect()
    ids = [r[0] for r in hit]
    return ref if ref in ids else ids[0] if len(ids) == 1 else None


def files_for_commit(nodes: DataFrame, edges: DataFrame, commit_id: str, max_results: int = 50) -> DataFrame:
    """One row per path that a commit touches, real files first."""
    own = _git(nodes, edges.where(F.col("source_id") == commit_id)).where("target_kind in ('file', 'changed_path')")
    rank = F.when(F.col("edge_kind") == "touches", 0).otherwise(1)
    first = F.row_number().over(Window.partitionBy("place").orderBy(rank, "edge_id"))
    once = own.withColumn("n", first).where("n = 1")
    score = F.when(F.col("target_kind") == "file", 100.0).otherwise(90.0)
    return once.select(rank.alias("rank"), "edge_id", "edge_kind", "target_id", "place", score.alias("score")).orderBy("rank", "edge_id").limit(max(0, max_results)).drop("rank")


def commits_for_symbol(nodes: DataFrame, edges: DataFrame, symbol_id: str, max_results: int = 10) -> DataFrame:
    row = nodes.where(F.col("id") == symbol_id).select("path").first()
    if row is None:
        raise GraphError("symbol_not_found", "no such symbol", item_id=symbol_id)
    if not row["path"]:
        raise GraphError("symbol_has_no_source_path", "the symbol has no file", item_id=symbol_id)
    return commits_for_path(nodes, edges, row["path"], max_results)


def resolved_definitions(edges: DataFrame) -> DataFrame:
    """source_id, target_id of symbols with exactly one exact cross-root definition."""
    exact = edges.where(meta("metadata", "resolution_kind") == "exact")
    return exact.groupBy("source_id").agg(F.count_distinct("target_id").alias("n"), F.min("target_id").alias("target_id")).where("n = 1").drop("n")


def incoming_externals(nodes: DataFrame, edges: DataFrame, target: str, limit: int = 10) -> DataFrame:
    """External symbols that resolve to a node; the limit comes before the test that they exist."""
    ids = edges.where((F.col("target_id") == target) & (meta("metadata", "resolution_kind") == "exact")).select("source_id").distinct().orderBy("source_id").limit(max(0, limit))
    return ids.join(nodes, F.col("source_id") == F.col("id")).select(*nodes.columns)


def lineage(changes: DataFrame, start: str) -> DataFrame:
    """path, epoch, commit_id, previous_path of a path's whole history, back through all its names; newest first is the order of (epoch desc, commit_id).

    changes: path, previous_path, epoch, commit_id. A rename hands on to the first rename of its former path that lies
    before it, found for all renames at once by a pass in order over each path. Those that the start leads to are met by
    doubled steps, so a chain of n renames takes log n joins of renames only. A row belongs to it if it lies on a name
    of the chain between the rename that led to that name and the one that leads on.
    """
    # sort keys of a place in history: newest first, the start before all
    rows = changes.select("path", F.lit(1).alias("after"), (-F.col("epoch")).cast("long").alias("age"), "commit_id", "epoch", "previous_path")
    at = ("after", "age", "commit_id")
    renames = rows.where("previous_path <> '' and previous_path <> path").groupBy("path", *at).agg(F.min("previous_path").alias("was"))
    # `from_` names the rename that asks for the next one on its former path; the start asks too
    key = F.to_json(F.struct("path", *at), {"ignoreNullFields": "false"})
    renames = cut(renames.withColumn("rename", key))
    first = changes.sparkSession.createDataFrame([(start, 0, None, None, "")], "path string, after int, age long, commit_id string, from_ string")
    asks = renames.select(F.col("was").alias("path"), *at, F.col("rename").alias("from_")).unionByName(first)
    both = renames.select("path", *at, F.lit(None).cast("string").alias("from_"), "rename").unionByName(asks.withColumn("rename", F.lit(None).cast("string")))
    # oldest first, so what stands before a row is older; at the same place the one that asks comes first and doesn't meet itself
    older = Window.partitionBy("path").orderBy(F.col("after").desc(), F.col("age").desc(), F.col("commit_id").desc(), F.col("from_").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("to", F.last("rename", ignorenulls=True).over(older)).where("from_ is not null").select("from_", "to")
    steps = jump = cut(met)
    reached, n = cut(steps.where("from_ = ''").select("from_")), 1
    while True:
        more = reached.join(jump.where("to is not null"), "from_").select(F.col("to").alias("from_"))
        reached = cut(reached.unionByName(more))
        if (now := reached.count()) == n:
            break
        n = now
        jump = cut(jump.join(jump.select(F.col("from_").alias("to"), F.col("to").alias("beyond")), "to").where("beyond is not null").select("from_", F.col("beyond").alias("to")))
    # a name's stretch opens after the rename that led to it and closes after the one that leads on
    chain = reached.join(steps, "from_")
    opened = asks.join(chain.select("from_"), "from_", "left_semi").select("path", *at, F.lit(1).alias("change"))
    closed = renames.join(chain.select(F.col("to").alias("rename")), "rename", "left_semi").select("path", *at, F.lit(-1).alias("change"))
    marks = opened.unionByName(closed).withColumns({"epoch": F.lit(None).cast("long"), "previous_path": F.lit(None).cast("string")})
    so_far = Window.partitionBy("path").orderBy(*at, F.col("change") != 0).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = rows.withColumn("change", F.lit(0)).unionByName(marks).withColumn("open", F.sum("change").over(so_far))
    return walked.where("change = 0 and open > 0").select("path", "epoch", "commit_id", "previous_path")


def rename_lineage(changes: DataFrame, start: str) -> list[tuple[str, int, str, str]]:
    """lineage() as a list, newest first: for histories that the driver holds."""
    rows = lineage(changes, start).orderBy(F.col("epoch").desc(), "commit_id")
    return [tuple(r) for r in rows.toLocalIterator()]
