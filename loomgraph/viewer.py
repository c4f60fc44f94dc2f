"""What a viewer shows of a graph: a bounded envelope, clusters with hubs and bridges, omissions, deltas and live patches.

Selections, clusters and bundles are tables; an envelope takes their first rows, up to its budgets, to the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import level_of_detail, meta
from .operators import diff, traverse, views
from .schema import GraphError
from .snapshot import Snapshot, bundle

VERSION = "loomgraph.viewer.v1"
NODE_BUDGET, EDGE_BUDGET, CLUSTER = 240, 480, 24
CAPABILITIES = {"levels": ["raw", "sampled", "cluster", "meta"], "patches": True, "expansion": True, "content": ["preview", "full"], "version": VERSION}
PREVIEW = 360


@dataclass(frozen=True)
class Envelope:
    level: str
    nodes: list[dict]
    edges: list[dict]
    clusters: list[dict]
    bundles: list[dict]
    omissions: list[dict]
    header: dict = field(default_factory=dict)


def viewer_id(header: dict) -> str:
    return f"{header.get('namespace', '')}:{header.get('created_at', '')}"


def level_for(spark: SparkSession, n: int) -> str:
    return spark.range(1).select(level_of_detail(F.lit(n))).first()[0]


def selection(nodes: DataFrame, edges: DataFrame, level: str, budget: int = NODE_BUDGET, size: int = CLUSTER) -> DataFrame:
    """The nodes that a level shows: by id when raw; else each cluster's representative first, then by kind, path and id."""
    if level == "raw":
        return nodes.orderBy("id").limit(max(0, budget))
    first = views.clusters(nodes, edges, size).groupBy("cluster").agg(F.min("id").alias("id")).select("id", F.lit(0).alias("rank"))
    ranked = nodes.join(first, "id", "left").withColumn("rank", F.coalesce("rank", F.lit(1)))
    return ranked.orderBy("rank", "kind", "path", "id").limit(max(0, budget)).drop("rank")


def cluster_table(nodes: DataFrame, edges: DataFrame, size: int = CLUSTER) -> DataFrame:
    """cluster, node_count, edge_count, representative_id, hub_ids (three of most degree), bridge_ids (the first two of them)."""
    return views.cluster_summary(nodes, edges, size).withColumn("bridge_ids", F.slice("hub_ids", 1, 2))


def cluster_nodes(nodes: DataFrame, edges: DataFrame, cluster: int, size: int = CLUSTER, role: str = "member", budget: int = NODE_BUDGET) -> tuple[DataFrame, list[dict]]:
    """A cluster's nodes, or its hubs or bridges, up to a budget; and what the budget left out."""
    own = views.clusters(nodes, edges, size).where(F.col("cluster") == cluster)
    if role != "member":
        if role not in ("hub", "bridge"):
            raise ValueError("role must be member, hub or bridge")
        ids = views.cluster_summary(nodes, edges, size).where(F.col("cluster") == cluster).select(F.explode(F.slice("hub_ids", 1, 3 if role == "hub" else 2)).alias("id"))
        own = own.join(ids, "id", "left_semi")
    total = own.count()
    reason = "cluster_budget" if role == "member" else f"{role}_node_budget"
    return nodes.join(own.select("id"), "id", "left_semi").orderBy("id").limit(budget), omission(reason, str(cluster), total, budget)


def omission(reason: str, item: str, total: int, budget: int) -> list[dict]:
    """A record of what a budget left out, with how to get it; none if nothing was."""
    left = max(0, total - budget)
    return [{"reason": reason, "item_id": item, "omitted": left, "budget": budget, "cursor": f"{reason}:{item}:{budget}"}] if left else []


def explain_omitted(omissions: list[dict], reason: str = "") -> list[dict]:
    return [o for o in omissions if not reason or o["reason"] == reason]


def node_records(nodes: DataFrame) -> DataFrame:
    """id, kind, label, citation, provenance, tags, span: nodes as a viewer reads them."""
    place = F.concat_ws(":", F.when(F.col("path") != "", F.col("path")), F.col("line").cast("string"))
    span = F.when(F.col("line").isNotNull(), F.concat_ws("-", F.col("line").cast("string"), F.coalesce("end_line", "line").cast("string")))
    made = F.concat_ws("@", meta("metadata", "parser"), meta("metadata", "parser_version"))
    return nodes.select("id", "kind", "label", place.alias("citation"), made.alias("provenance"), F.array_compact(F.array("kind", meta("metadata", "language"))).alias("tags"), F.coalesce(span, F.lit("")).alias("span"))


def edge_records(edges: DataFrame) -> DataFrame:
    return edges.select("id", "kind", F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.coalesce(meta("metadata", "resolution_kind"), F.lit("")).alias("evidence"))


def content(nodes: DataFrame, node_id: str, mode: str = "preview") -> dict:
    """A node's text, whole or its first PREVIEW characters."""
    if mode not in CAPABILITIES["content"]:
        raise ValueError("mode must be preview or full")
    row = nodes.where(F.col("id") == node_id).select("id", "text").first()
    if row is None:
        raise GraphError("not_found", "no such node", node_id=node_id)
    text = row["text"] or ""
    return {"id": node_id, "text": text if mode == "full" else text[:PREVIEW], "truncated": mode == "preview" and len(text) > PREVIEW}


def envelope(s: Snapshot, level: str = "", node_budget: int = NODE_BUDGET, edge_budget: int = EDGE_BUDGET, size: int = CLUSTER) -> Envelope:
    """The bounded view: chosen nodes, the edges between them by id, clusters and bundles when not raw, and all omissions."""
    total, n_edges = s.nodes.count(), s.edges.count()
    level = level or level_for(s.spark, total)
    chosen = selection(s.nodes, s.edges, level, node_budget, size).cache()
    inner = views.visible_edges(chosen, s.edges)
    shown = [r.asDict() for r in node_records(chosen).orderBy("id").collect()]
    drawn = [r.asDict() for r in edge_records(inner.orderBy("id").limit(edge_budget)).collect()]
    groups, bundles = [], []
    if level != "raw":
        groups = [r.asDict() for r in cluster_table(s.nodes, s.edges, size).orderBy("cluster").limit(node_budget).collect()]
        bundles = [r.asDict() for r in views.edge_bundles(views.clusters(s.nodes, s.edges, size), s.edges).orderBy("low", "high").limit(edge_budget).collect()]
    lost = omission("node_budget", "nodes", total, node_budget) + omission("edge_budget", "edges", inner.count(), edge_budget)
    header = {"version": VERSION, "id": viewer_id(s.header), "node_count": total, "edge_count": n_edges, "node_budget": node_budget, "edge_budget": edge_budget}
    chosen.unpersist()
    return Envelope(level, shown, drawn, groups, bundles, lost, header)


def write_envelope(e: Envelope) -> str:
    return json.dumps({"header": e.header, "level": e.level, "nodes": e.nodes, "edges": e.edges, "clusters": e.clusters, "bundles": e.bundles, "omissions": e.omissions}, indent=2, sort_keys=True) + "\n"


def read_envelope(text: str) -> Envelope:
    body = json.loads(text)
    if body.get("header", {}).get("version") != VERSION:
        raise GraphError("UNSUPPORTED_SCHEMA_VERSION", "the envelope has another version")
    return Envelope(body["level"], body["nodes"], body["edges"], body["clusters"], body["bundles"], body["omissions"], body["header"])


# --- within an envelope: as small as its budgets, so on the driver ---


def _links(e: Envelope) -> dict[str, list[tuple[str, str]]]:
    out: dict[str, list[tuple[str, str]]] = {}
    for x in e.edges:
        out.setdefault(x["source"], []).append((x["id"], x["target"]))
        if x["source"] != x["target"]:
            out.setdefault(x["target"], []).append((x["id"], x["source"]))
    return out


def visible_neighborhood(e: Envelope, node_id: str, depth: int = 1, node_budget: int = 40, edge_budget: int = 80) -> dict:
    """Nodes and edges around one among those shown, in the envelope's order, each up to its own budget."""
    links, seen, order, used = _links(e), {node_id}, [], []
    ring = [node_id]
    for _ in range(depth):
        after = []
        for at in ring:
            for edge, other in links.get(at, ()):
                if edge not in used:
                    used.append(edge)
                if other not in seen:
                    seen.add(other)
                    order.append(other)
                    after.append(other)
        ring = after
    lost = omission("neighborhood_budget", node_id, len(order), node_budget) + omission("neighborhood_budget", f"{node_id}:edges", len(used), edge_budget)
    return {"nodes": order[:node_budget], "edges": used[:edge_budget], "omissions": lost}


def visible_path(e: Envelope, source: str, target: str, max_hops: int = 8) -> dict:
    links, back, ring = _links(e), {source: ("", "")}, [source]
    for _ in range(max_hops):
        if target in back:
            break
        after = []
        for at in ring:
            for edge, other in links.get(at, ()):
                if other not in back:
                    back[other] = (edge, at)
                    after.append(other)
        ring = after
    if target not in back:
        return {"found": False, "edges": [], "omissions": [{"reason": "path_budget", "item_id": f"{source}:{target}", "budget": max_hops}]}
    way, at = [], target
    while at != source:
        edge, at = back[at]
        way.append(edge)
    return {"found": True, "edges": way[::-1], "omissions": []}


def snapshot_neighborhood(s: Snapshot, node_id: str, budget: int = 40) -> DataFrame:
    return traverse.neighborhood(s.nodes, s.edges, node_id, depth=1, max_results=budget)


def snapshot_path(s: Snapshot, source: str, target: str, budget: int = 8) -> dict:
    way = traverse.path(s.edges, source, target, max_hops=budget)
    return {"found": way is not None, "edges": way or []}


# --- deltas and patches ---


def delta_markers(old: Snapshot, new: Snapshot, budget: int | None = None) -> DataFrame:
    """position, marker, item_id: what came and went, edges after nodes, omitted last; up to a budget."""
    order = F.create_map(*(F.lit(x) for i, k in enumerate(("node", "edge", "omitted")) for x in (k, i)))
    rows = diff.structural(old, new).select(order[F.col("item_kind")].alias("position"), F.concat_ws("_", "item_kind", "status").alias("marker"), "item_id")
    return rows if budget is None else rows.orderBy("position", "marker", "item_id").limit(budget)


def live_patch(old: Snapshot, new: Snapshot, revision: int) -> dict:
    """The ordered operations that bring a client from one graph to another, with their rows; a patch is for clients that hold the graph."""
    ops = diff.snapshot_patch(old, new).orderBy("position", "item_id").collect()
    rows = {"node_upsert": {}, "edge_upsert": {}}
    for op, df, records in (("node_upsert", new.nodes, node_records), ("edge_upsert", new.edges, edge_records)):
        ids = [r["item_id"] for r in ops if r["op"] == op]
        if ids:
            wanted = new.spark.createDataFrame([(i,) for i in ids], "id string")
            rows[op] = {r["id"]: r.asDict() for r in records(df.join(wanted, "id", "left_semi")).collect()}
    steps = [{"op": r["op"], "id": r["item_id"]} | ({"row": rows[r["op"]][r["item_id"]]} if r["op"] in rows else {}) for r in ops]
    return {"revision": revision, "operations": steps, "metadata": {"id": viewer_id(new.header), "changed": diff.header_changes(old.header, new.header)}}


def project_health(nodes: DataFrame, edges: DataFrame, omitted: DataFrame) -> DataFrame:
    """nodes, edges, omitted and the distinct source paths over both: one row."""
    paths = nodes.select("path").unionByName(edges.select("path")).where("path <> ''").agg(F.count_distinct("path").alias("source_paths"))
    return views.health(nodes, edges, omitted).crossJoin(paths)  # rows of one


# --- fixtures ---


def ring(spark: SparkSession, n: int, per_node: float = 1.45) -> Snapshot:
    """A generated graph of n nodes and per_node edges for each, of any size: edge i runs from node i mod n to the next but i div n."""
    i = F.col("id")
    nodes = spark.range(n).select(F.format_string("node:%09d", i).alias("id"), F.when(i % 10 == 0, "file").otherwise("symbol").alias("kind"), F.format_string("Node %d", i).alias("label"), F.format_string("src/file-%d.py", F.floor(i / 100)).alias("path"))
    e = spark.range(int(n * per_node)).select(i.alias("k"), (i % n).alias("a"), ((i % n + 1 + F.floor(i / n)) % n).alias("b"))
    edges = e.select(F.format_string("edge:%09d", "k").alias("id"), F.lit("links").alias("kind"), F.format_string("node:%09d", "a").alias("source_id"), F.format_string("node:%09d", "b").alias("target_id"))
    return bundle(nodes, edges, namespace="ring", created_at="fixed")


def chain(spark: SparkSession, n: int) -> Snapshot:
    """n nodes in a row, a hundred a file."""
    i = F.col("id")
    nodes = spark.range(n).select(F.format_string("node:%d", i).alias("id"), F.lit("symbol").alias("kind"), F.format_string("node %d", i).alias("label"), F.format_string("src/file-%d.py", F.floor(i / 100)).alias("path"))
    edges = spark.range(max(0, n - 1)).select(F.format_string("edge:%d", i).alias("id"), F.lit("links").alias("kind"), F.format_string("node:%d", i).alias("source_id"), F.format_string("node:%d", i + 1).alias("target_id"))
    return bundle(nodes, edges, namespace="chain")


def demo(spark: SparkSession) -> Snapshot:
    """A small graph that shows every kind of fact."""
    n = [("p", "project", "demo", ""), ("f1", "file", "app.py", "src/app.py"), ("f2", "file", "guide.md", "docs/guide.md"), ("c", "python_class", "App", "src/app.py"), ("m", "python_function", "main", "src/app.py"), ("s", "doc_section", "Start", "docs/guide.md"), ("g", "git_commit", "First", "")]
    e = [("p", "contains", "f1"), ("p", "contains", "f2"), ("f1", "defines", "c"), ("f1", "defines", "m"), ("m", "calls", "c"), ("f2", "contains", "s"), ("s", "references_doc", "f1"), ("g", "touches", "f1")]
    nodes = spark.createDataFrame(n, "id string, kind string, label string, path string")
    edges = spark.createDataFrame([("|".join(x), *x) for x in e], "id string, source_id string, kind string, target_id string")
    return bundle(nodes, edges, spark.createDataFrame([("unresolved_markdown_reference", "docs/guide.md", "{}")], "reason string, item_id string, details string"), namespace="demo")
