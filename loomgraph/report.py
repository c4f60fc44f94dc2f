"""Reports over a graph: topology, structure, repository map, document graph and certification, as tables and as Markdown.

Tables are DataFrames; only their first rows, as many as a report shows, reach the driver to be written out.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import blank, is_symbol, meta
from .operators import search, traverse, views
from .operators.navigate import commit_order
from .snapshot import Snapshot, to_json

#: Whose first node a report suggests to search for, in this order.
PREFERRED = ("python_class", "python_function", "script_class", "script_function", "doc_section", "file")


# --- formats ---


def node_line() -> Column:
    """label (kind, path:line), with as much of the place as there is."""
    place = F.concat(blank("path"), F.when(F.col("line").isNotNull(), F.concat(F.lit(":"), F.col("line").cast("string"))).otherwise(F.lit("")))
    return F.concat(F.col("label"), F.lit(" ("), F.col("kind"), F.when(blank("path") != "", F.concat(F.lit(", "), place)).otherwise(F.lit("")), F.lit(")"))


def commit_line() -> Column:
    return F.concat_ws(" ", F.coalesce(meta("metadata", "short_commit_hash"), F.substring(meta("metadata", "commit_hash"), 1, 12)), F.col("label"))


def finding(omitted: DataFrame) -> DataFrame:
    """omitted rows with the path and line that their details name."""
    return omitted.select("reason", "item_id", F.coalesce(meta("details", "path"), F.lit("")).alias("path"), meta("details", "line").cast("int").alias("line"))


# --- tables ---


def component_rank(nodes: DataFrame, edges: DataFrame, top_n: int | None = 10) -> DataFrame:
    """Components by size: most nodes, then most edges, then id."""
    found = traverse.graph_components(nodes, edges)
    return found if top_n is None else found.orderBy(F.col("node_count").desc(), F.col("edge_count").desc(), "component_id").limit(max(1, top_n))


def topology_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_count, edge_count, component_count, isolated_count, largest_component, max_degree: one row."""
    real = F.col("real") > 0
    count = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    # all of it follows from the components, so the graph is gone over for them only
    return traverse.component_facts(nodes, edges).agg(
        count(F.sum("real")).alias("node_count"), count(F.sum("edge_count")).alias("edge_count"), F.count(F.when(real, 1)).alias("component_count"),
        count(F.max(F.when(real, F.col("node_count")))).alias("largest_component"), count(F.sum("isolated")).alias("isolated_count"), count(F.max("max_degree")).alias("max_degree"),
    )


def suggestions(nodes: DataFrame) -> DataFrame:
    """kind, label of the first node by id of each preferred kind, in the order of preference."""
    place = F.array_position(F.array(*(F.lit(k) for k in PREFERRED)), F.col("kind"))
    first = nodes.where(F.col("kind").isin(*PREFERRED)).groupBy("kind").agg(F.min(F.struct("id", "label")).alias("x"))
    return first.select("kind", F.col("x.id").alias("id"), F.col("x.label").alias("label"), place.cast("int").alias("place"))


def repo_map(nodes: DataFrame, edges: DataFrame, omitted: DataFrame, top_n: int = 10) -> DataFrame:
    """section, position, item: the first directories, files, symbols, sections, commits and omitted reasons of a repository."""
    n = max(1, top_n)
    dirs = views.top_directories(nodes, edges, n).select((-F.col("children")).alias("a"), F.lit("").alias("b"), F.concat(F.col("path"), F.lit(" ("), F.col("children").cast("string"), F.lit(")")).alias("item"))
    plain = lambda df, item: df.select(F.lit(0).cast("long").alias("a"), item.alias("b"), item.alias("item"))
    files = plain(nodes.where("kind = 'file'"), F.col("path"))
    symbols = plain(nodes.where(is_symbol(F.col("kind"))), node_line())
    sections = plain(nodes.where("kind = 'doc_section'"), node_line())
    epoch = F.coalesce(meta("metadata", "committer_time_epoch").cast("long"), F.lit(0))
    commits = nodes.where("kind = 'git_commit'").select((-epoch).alias("a"), F.col("id").alias("b"), commit_line().alias("item"))
    lost = views.counts(omitted, "reason").select((-F.col("n")).alias("a"), F.col("reason").alias("b"), F.concat(F.col("reason"), F.lit(": "), F.col("n").cast("string")).alias("item"))
    out = None
    for name, df in (("directories", dirs), ("files", files), ("symbols", symbols), ("sections", sections), ("commits", commits), ("omitted", lost)):
        # a top-k each; the window then sees n rows
        own = df.orderBy("a", "b").limit(n).withColumn("section", F.lit(name))
        own = own.groupBy("section").agg(F.sort_array(F.collect_list(F.struct("a", "b", "item"))).alias("rows")).select("section", F.posexplode("rows").alias("position", "row")).select("section", (F.col("position") + 1).alias("position"), "row.item")
        out = own if out is None else out.unionByName(own)
    return out


def document_graph(nodes: DataFrame, edges: DataFrame, referrers: int = 5) -> DataFrame:
    """id, label, incoming_count, referrer_ids of the sections and documents that something links to."""
    return views.doc_targets(edges, referrers).join(nodes.select(F.col("id").alias("target_id"), "label"), "target_id", "left").select(F.col("target_id").alias("id"), F.coalesce("label", F.lit("")).alias("label"), "incoming_count", "referrer_ids")


def doc_target_rank(targets: DataFrame, top_n: int = 10) -> DataFrame:
    return targets.orderBy(F.col("incoming_count").desc(), "id").limit(max(1, top_n))


def map_commits(nodes: DataFrame, top_n: int = 10) -> DataFrame:
    """Commits as the repository map orders them: newest committer time, then id."""
    epoch = F.coalesce(meta("metadata", "committer_time_epoch").cast("long"), F.lit(0))
    return nodes.where("kind = 'git_commit'").orderBy(epoch.desc(), "id").limit(max(1, top_n))


def ordered_orphans(nodes: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    out = views.orphans(nodes, edges).orderBy("kind", "path", "id")
    return out if limit is None else out.limit(limit)


def snapshot_stats(nodes: DataFrame, edges: DataFrame, omitted: DataFrame) -> DataFrame:
    """Counts, distinct parsers and their versions, and those of the history: one row."""
    n = nodes.agg(
        F.count(F.lit(1)).alias("nodes"), F.sum(F.when(F.col("kind") == "file", 1).otherwise(0)).alias("files"), F.count_distinct(meta("metadata", "parser")).alias("parsers"),
        F.count_distinct(meta("metadata", "parser"), meta("metadata", "parser_version")).alias("parser_versions"),
        F.sum(F.when(F.col("kind") == "git_commit", 1).otherwise(0)).alias("git_commits"), F.sum(F.when(F.col("kind") == "changed_path", 1).otherwise(0)).alias("git_changed_paths"),
    )
    return n.crossJoin(edges.agg(F.count(F.lit(1)).alias("edges"))).crossJoin(omitted.agg(F.count(F.lit(1)).alias("omitted")))  # three rows of one


def git_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """git_commits, git_changed_paths, git_renames: one row."""
    sums = nodes.agg(F.sum(F.when(F.col("kind") == "git_commit", 1).otherwise(0)).alias("git_commits"), F.sum(F.when(F.col("kind") == "changed_path", 1).otherwise(0)).alias("git_changed_paths"))
    renamed = edges.where("kind in ('touches', 'changes_path')").agg(F.sum(F.when(F.coalesce(meta("metadata", "previous_path"), F.lit("")) != "", 1).otherwise(0)).alias("git_renames"))
    return sums.crossJoin(renamed)  # two rows of one


def certification(nodes: DataFrame, edges: DataFrame, omitted: DataFrame) -> DataFrame:
    """Counts, kinds, topology and privacy of a graph in one row."""
    kinds = nodes.agg(F.count_distinct("kind").alias("node_kinds")).crossJoin(edges.agg(F.count_distinct("kind").alias("edge_kinds"))).crossJoin(omitted.agg(F.count(F.lit(1)).alias("omitted_count")))
    return topology_summary(nodes, edges).crossJoin(kinds).crossJoin(views.privacy_profile(nodes, edges))  # tables of one row


def canonical(snapshot: Snapshot) -> dict:
    """sha256 and length of the canonical text (for graphs that a driver holds)."""
    text = to_json(snapshot).encode()
    return {"sha256": hashlib.sha256(text).hexdigest(), "bytes": len(text)}


def parser_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("parser", "parser_version").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))


# --- Markdown ---


def table_md(df: DataFrame, limit: int = 50) -> str:
    names = df.columns
    rows = [[str("" if x is None else ", ".join(map(str, x)) if isinstance(x, list) else x).replace("|", "\\|").replace("\n", " ") for x in r] for r in df.limit(limit).collect()]
    return "\n".join(["| " + " | ".join(names) + " |", "| " + " | ".join("---" for _ in names) + " |", *("| " + " | ".join(r) + " |" for r in rows)])


def report_md(s: Snapshot, top_n: int = 10) -> str:
    n, e, o = s.nodes, s.edges, s.omitted
    parts = [
        ("Nodes", views.counts(n).orderBy("kind")), ("Edges", views.counts(e).orderBy("kind")), ("Omitted", views.counts(o, "reason").orderBy("reason")),
        ("Most connected", views.report_rank(n, e, top_n).select("id", "kind", "label", "degree", "degree_out")), ("Alone", ordered_orphans(n, e, top_n).select("id", "kind", "label")),
        ("Dependencies", views.report_dependencies(n, e).orderBy("id").limit(top_n).select("source_label", "target_label")),
        ("Commits", n.where("kind = 'git_commit'").orderBy(*commit_order()).limit(top_n).select(commit_line().alias("commit"))),
        ("Searches to try", suggestions(n).orderBy("place").select("kind", "label")),
    ]
    return "# Graph report\n\n" + "\n\n".join(f"## {name}\n\n{table_md(df)}" for name, df in parts) + "\n"


def topology_md(s: Snapshot, top_n: int = 10) -> str:
    return f"# Topology\n\n{table_md(topology_summary(s.nodes, s.edges))}\n\n## Components\n\n{table_md(component_rank(s.nodes, s.edges, top_n))}\n\n## Degrees\n\n{table_md(views.topology_rank(s.nodes, s.edges, top_n).select('id', 'kind', 'degree'))}\n"


def repo_map_md(s: Snapshot, top_n: int = 10) -> str:
    rows = repo_map(s.nodes, s.edges, s.omitted, top_n).orderBy("section", "position").collect()
    out = ["# Repository map"]
    for name in dict.fromkeys(r["section"] for r in rows):
        out += [f"\n## {name}\n", *(f"- {r['item']}" for r in rows if r["section"] == name)]
    return "\n".join(out) + "\n"


def doc_graph_md(s: Snapshot, top_n: int = 10) -> str:
    return f"# Documents\n\n{table_md(doc_target_rank(document_graph(s.nodes, s.edges), top_n))}\n"


def certification_md(s: Snapshot) -> str:
    return f"# Certification\n\n{table_md(certification(s.nodes, s.edges, s.omitted))}\n"


def investigation(s: Snapshot, text: str, preset: str = "high_degree", max_results: int = 10) -> dict:
    """Matches among a preset's nodes, what surrounds the first and how the first two connect, and what to run next."""
    got = search.search(views.preset(preset, s.nodes, s.edges), search.Request(text, max_results=max_results))
    matches = [r.asDict() for r in got.hits.select("id", "kind", "label", "path", "score").collect()]
    near, way, close = [], None, []
    if matches:
        first = matches[0]["id"]
        near = [r.asDict() for r in traverse.neighborhood(s.nodes, s.edges, first, max_results=max_results).select("id", "kind", "label", "depth").collect()]
        close = [r.asDict() for r in views.related(s.nodes, s.edges, first).orderBy("bucket", "n").collect()]
        way = traverse.path(s.edges, first, matches[1]["id"]) if len(matches) > 1 else None
    fresh = {r[0]: r[1] for r in freshness(s.nodes).collect()}
    commands = [f"python -m loomgraph {c} STORE {m['id']}" for m in matches[:2] for c in ("neighborhood", "impact")]
    return {"matches": matches, "omitted": got.omitted, "neighborhood": near, "path": way, "related": close, "freshness": fresh, "next_commands": commands}


def freshness(nodes: DataFrame) -> DataFrame:
    """marker, n: nodes by the freshness that their metadata states."""
    return nodes.groupBy(F.coalesce(meta("metadata", "freshness"), F.lit("unknown")).alias("marker")).agg(F.count(F.lit(1)).alias("n"))


def investigation_md(found: dict) -> str:
    lines = ["# Investigation", "", "## Matches", "", *(f"- {m['label']} ({m['kind']}): {m['score']:g}" for m in found["matches"]), "", "## Related", "", *(f"- {r['bucket']}: {r['label']}" for r in found["related"]), "", "## Next", "", *(f"    {c}" for c in found["next_commands"])]
    return "\n".join(lines) + "\n"
