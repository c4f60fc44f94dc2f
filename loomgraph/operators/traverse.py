"""Bounded breadth-first traversal over undirected edges, and connected components.

A node's place in breadth-first order is the list of edge ids by which it was first reached: lists compare like the
queue would run, so each round is a join and a minimum, and no round ranks its frontier on one task.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

Kinds = tuple[str, ...]


#: Ids that a side may have to be sent to every task; beyond it both sides are shuffled by id.
SMALL = 200_000


def _links(edges: DataFrame, kinds: Kinds, rounds: int) -> DataFrame:
    """id, source_id, target_id of the edges of some kinds; written once where several rounds read them."""
    edges = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    edges = edges.select("id", "source_id", "target_id")
    return cut(edges) if rounds > 1 else edges


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def _step(links: DataFrame, frontier: DataFrame, n: int, visited: DataFrame, seen: int) -> DataFrame:
    """Nodes first reached by one more edge, with their way; the edges stay where they lie while the frontier is small."""
    from_ = _sized(frontier.select("node_id", "way"), n)
    out = links.join(from_, F.col("source_id") == F.col("node_id")).select(F.col("target_id").alias("other"), "way", "id")
    back = links.where("source_id <> target_id").join(from_, F.col("target_id") == F.col("node_id")).select(F.col("source_id").alias("other"), "way", "id")
    reached = out.unionByName(back).groupBy(F.col("other").alias("node_id")).agg(F.min(F.concat("way", F.array("id"))).alias("way"))
    return reached.join(_sized(visited.select("node_id"), seen), "node_id", "left_anti")


def _start(links: DataFrame, node_id: str) -> DataFrame:
    return links.sparkSession.createDataFrame([(node_id, [])], "node_id string, way array<string>")


def neighborhood(nodes: DataFrame, edges: DataFrame, node_id: str, depth: int = 1, max_results: int = 10, edge_kinds: Kinds = (), node_kinds: Kinds = ()) -> DataFrame:
    """Nodes around one, in breadth-first order: depth, way, score (max_results less the place, 1 at least).

    A node of another kind than asked for, or that has no row, counts as visited and isn't gone on from.
    """
    links = _links(edges, edge_kinds, depth)
    visited = frontier = _start(links, node_id)
    kept = (nodes.where(F.col("kind").isin(*node_kinds)) if node_kinds else nodes).select(F.col("id").alias("node_id"))
    found, n, seen = None, 1, 1
    for d in range(1, depth + 1):
        reached = cut(_step(links, frontier, n, visited, seen))
        new = reached.count()
        visited, seen = visited.unionByName(reached), seen + new
        # the few that were reached go to the nodes, not the nodes to them
        real = kept.join(_sized(reached.select("node_id"), new), "node_id", "left_semi")
        frontier = cut(reached.join(_sized(real, new), "node_id", "left_semi").withColumn("depth", F.lit(d)))
        n = frontier.count()
        found = frontier if found is None else found.unionByName(frontier)
        if not n:
            break
    if found is None:
        found = visited.withColumn("depth", F.lit(0)).limit(0)
    top = found.orderBy("depth", "way").limit(max_results)
    # max_results rows: one window over them is no bottleneck
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("depth", "way"))
    top = top.withColumn("place", place).withColumn("score", F.greatest(F.lit(1.0), (max_results - F.col("place") + 1).cast("double")))
    return _sized(top, max_results).join(nodes, F.col("node_id") == F.col("id")).select("id", "kind", "label", "path", "depth", "way", "place", "score")


def path(edges: DataFrame, source_id: str, target_id: str, max_hops: int = 4, edge_kinds: Kinds = ()) -> list[str] | None:
    """Edge ids of the first shortest path; [] from a node to itself, None if there is none within max_hops."""
    if source_id == target_id:
        return []
    links = _links(edges, edge_kinds, max_hops)
    visited = frontier = _start(links, source_id)
    n = seen = 1
    for _ in range(max_hops):
        frontier = cut(_step(links, frontier, n, visited, seen))
        if hit := frontier.where(F.col("node_id") == target_id).first():
            return hit["way"]
        n = frontier.count()
        if not n:
            return None
        visited, seen = visited.unionByName(frontier), seen + n
    return None


def path_nodes(nodes: DataFrame, edges: DataFrame, source_id: str, way: list[str], node_kinds: Kinds = ()) -> DataFrame | None:
    """The nodes along a path, by hop; None if one has another kind than asked for (no other path is tried)."""
    ends = {r["id"]: (r["source_id"], r["target_id"]) for r in edges.where(F.col("id").isin(*way)).select("id", "source_id", "target_id").collect()} if way else {}
    ids = [source_id]
    for e in way:
        a, b = ends[e]
        ids.append(b if a == ids[-1] else a)
    order = nodes.sparkSession.createDataFrame([(k, i) for k, i in enumerate(ids)], "hop int, id string")
    out = nodes.join(F.broadcast(order), "id")
    if node_kinds and not out.where(~F.col("kind").isin(*node_kinds)).isEmpty():
        return None
    return out.orderBy("hop")


def contracted(edges: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(u, v): of the edges (a, b) that a task reads together, `most` at a time, each node with the least that it is tied to.

    The same components in at most as many edges as there are nodes in such a part, so edges that lie near each other are
    settled before anything is shuffled. A part's result is taken into the next one while it is small.
    """

    def contract(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def forest(parts: list) -> tuple:
            both = pa.concat_arrays([*(a for a, _ in parts), *(b for _, b in parts)]).dictionary_encode()
            names, at = both.dictionary, np.asarray(both.indices)
            order = np.asarray(pc.sort_indices(names))
            rank = np.empty(len(order), "i8")
            rank[order] = np.arange(len(order))
            x, y = np.split(rank[at], 2)
            root = np.arange(len(order))
            while True:
                x, y = root[x], root[y]
                open_ = x != y
                if not open_.any():
                    break
                x, y = x[open_], y[open_]
                # any lower root will do: one is taken now, what it leaves is met again
                root[np.maximum(x, y)] = np.minimum(x, y)
                while not np.array_equal(next_ := root[root], root):
                    root = next_
            child = np.flatnonzero(root != np.arange(len(root)))
            return names.take(pa.array(order[child])), names.take(pa.array(order[root[child]]))

        parts, n = [], 0
        for batch in batches:
            parts.append((batch.column(0), batch.column(1)))
            n += batch.num_rows
            if n >= most:
                parts = [forest(parts)]
                n = len(parts[0][0])
                if n > most // 2:
                    yield pa.RecordBatch.from_arrays(list(parts[0]), ["u", "v"])
                    parts, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays(list(forest(parts)), ["u", "v"])

    return edges.where("a <> b").select(F.col("a").cast("string"), F.col("b").cast("string")).mapInArrow(contract, "u string, v string")


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of the undirected edges (a, b): root is the least node that can be reached.

    What lies together is contracted, then what has the greater end in common. A node that is left with one edge, to a
    lesser one, is a leaf and waits for that one's root. Stars are made of the rest, which is mostly roots of parts.
    """
    parts = contracted(edges).repartition("u").select(F.col("u").alias("a"), F.col("v").alias("b"))
    now = cut(contracted(parts))
    down, up = now.select(F.col("u").alias("node"), F.col("v").alias("to"), F.lit(1).alias("down"), F.lit(0).alias("up")), now.select(F.col("v").alias("node"), F.lit(None).cast("string").alias("to"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    each = down.unionByName(up).groupBy("node").agg(F.first("to", ignorenulls=True).alias("to"), F.sum("down").alias("down"), F.max("up").alias("up"))
    leaf = (F.col("down") == 1) & (F.col("up") == 0)
    each = cut(each.select("node", F.when(leaf, F.col("to")).otherwise(F.col("node")).alias("via"), (~leaf).alias("core")))
    core = each.where("core").select(F.col("node").alias("u"))
    found = _stars(now.join(_sized(core, core.count()), "u", "left_semi"))
    roots = found.select(F.col("node").alias("via"), "root")
    return each.join(_sized(roots, roots.count()), "via", "left").select("node", F.coalesce("root", "via").alias("root"))


def _stars(now: DataFrame) -> DataFrame:
    """node, root of edges (u, v) with u > v, by alternating large and small stars: logarithmically many rounds of
    aggregations and joins on ids, none of which holds a hub's edges in one place."""
    now, seen = cut(now), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = cut(small.where("u <> v").distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def component_facts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """component_id, node_count (ends without a node too), edge_count, real (rows of nodes), isolated (such without an edge) and max_degree of all components."""
    roots = components(edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    end = lambda df, c, real, out, into: df.select(F.col(c).alias("node"), real.alias("real"), out.alias("out"), into.alias("into"))
    rows = end(nodes, "id", one, zero, zero).unionByName(end(edges, "source_id", zero, one, zero)).unionByName(end(edges, "target_id", zero, zero, one))
    each = rows.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("real", "out", "into")))
    member = each.join(roots, "node", "left").withColumn("component_id", F.coalesce("root", "node"))
    degree = F.col("out") + F.col("into")
    return member.groupBy("component_id").agg(
        F.count(F.lit(1)).alias("node_count"), F.sum("out").alias("edge_count"), F.sum("real").alias("real"),
        F.sum(F.when(degree == 0, F.col("real")).otherwise(0)).alias("isolated"), F.max(degree).alias("max_degree"),
    )


def graph_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """component_id, node_count, edge_count of all components with a real node; dangling ends count as members."""
    return component_facts(nodes, edges).where("real > 0").select("component_id", "node_count", "edge_count")
