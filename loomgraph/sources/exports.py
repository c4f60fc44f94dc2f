"""Graphs as DOT, Mermaid and JSON documents."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blank
from ..snapshot import Snapshot


def _dot(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.replace(F.replace(F.replace(blank(x), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def node_label() -> Column:
    """label, kind and path, joined by a literal backslash-n; without a path if there is none."""
    nl = F.lit("\\n")
    return F.concat(_dot("label"), nl, _dot("kind"), F.when(blank("path") != "", F.concat(nl, _dot("path"))).otherwise(F.lit("")))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """part, key, line: in this order they are the body of a DOT file; edges with a missing end are left out."""
    ids = nodes.select(F.col("id").alias("source_id"))
    whole = edges.join(ids, "source_id", "left_semi").join(ids.withColumnRenamed("source_id", "target_id"), "target_id", "left_semi")
    n = nodes.select(F.lit(1).alias("part"), F.col("id").alias("key"), F.concat(F.lit('  "'), _dot("id"), F.lit('" [label="'), node_label(), F.lit('"];')).alias("line"))
    e = whole.select(F.lit(2).alias("part"), F.col("id").alias("key"), F.concat(F.lit('  "'), _dot("source_id"), F.lit('" -> "'), _dot("target_id"), F.lit('" [label="'), _dot("kind"), F.lit('"];')).alias("line"))
    return n.unionByName(e)


def dot(snapshot: Snapshot) -> str:
    lines = [r[0] for r in dot_lines(snapshot.nodes, snapshot.edges).orderBy("part", "key").select("line").toLocalIterator()]
    return "\n".join(["digraph loom {", *lines, "}"]) + "\n"


def mermaid_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """part, key, line of a Mermaid flow chart; a node's alias is its place by id."""
    from ..operators.views import positions

    clean = lambda x: F.replace(F.replace(blank(x), F.lit('"'), F.lit("'")), F.lit("\n"), F.lit(" "))
    alias = positions(nodes.select("id")).select("id", F.concat(F.lit("n"), F.col("position").cast("string")).alias("alias"), "position")
    n = nodes.join(alias, "id").select(F.lit(1).alias("part"), F.format_string("%020d", "position").alias("key"), F.concat(F.lit("  "), "alias", F.lit('["'), clean("label"), F.lit('"]')).alias("line"))
    s, t = (alias.select(F.col("id").alias(f"{x}_id"), F.col("alias").alias(x)) for x in ("source", "target"))
    e = edges.join(s, "source_id").join(t, "target_id").select(F.lit(2).alias("part"), F.col("id").alias("key"), F.concat(F.lit("  "), "source", F.lit(" -->|"), clean("kind"), F.lit("| "), "target").alias("line"))
    return n.unionByName(e)


def mermaid(snapshot: Snapshot) -> str:
    lines = [r[0] for r in mermaid_lines(snapshot.nodes, snapshot.edges).orderBy("part", "key").select("line").toLocalIterator()]
    return "\n".join(["flowchart LR", *lines]) + "\n"


def export(snapshot: Snapshot, kind: str) -> str:
    makers = {"dot": dot, "mermaid": mermaid, "mmd": mermaid, "graph_json": graph_json}
    if kind not in makers:
        raise ValueError(f"format must be one of {sorted(makers)}")
    return makers[kind](snapshot)


def graph_json(snapshot: Snapshot) -> str:
    """Node and edge lists under the names other graph tools read (omitted facts stay out)."""
    nodes = [{"id": r["id"], "type": r["kind"], "name": r["label"], "file": r["path"], "properties": json.loads(r["metadata"] or "{}")} for r in snapshot.nodes.orderBy("id").toLocalIterator()]
    edges = [{"id": r["id"], "type": r["kind"], "source": r["source_id"], "target": r["target_id"]} for r in snapshot.edges.orderBy("id").toLocalIterator()]
    return json.dumps({"nodes": nodes, "edges": edges}, indent=2, sort_keys=True) + "\n"


def reference_bundle(snapshot: Snapshot) -> tuple[DataFrame, DataFrame]:
    """Symbols and references of a graph, for other indexers."""
    from ..operators.views import symbols

    kinds = ("calls", "inherits", "imports", "references", "references_doc", "references_section", "mentions", "depends_on", "defines", "parent_symbol")
    return symbols(snapshot.nodes).select("id", "kind", "label", "path", "line", "metadata"), snapshot.edges.where(F.col("kind").isin(*kinds)).select("id", "kind", "source_id", "target_id", "path", "line")
