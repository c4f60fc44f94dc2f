"""Cited evidence: references from nodes to the content they rest on, their states, and bundles of them."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import source_ref_id
from .operators import resolve, search, traverse
from .schema import GraphError
from .snapshot import Snapshot
from .workspace import fingerprint

STATES = ("fresh", "stale", "changed", "missing")
QUERY_KINDS = ("search", "neighborhood")
REFS = "ref_uri string, node_id string, source_ref_id string, snapshot_id string, observed_at_iso string, freshness_state string, content_hash string"


def snapshot_id(snapshot: Snapshot) -> str:
    """16 digits of a digest of all rows, computed once where they lie."""
    return fingerprint(snapshot)[:16]


def refs(nodes: DataFrame, of: str, manifest: DataFrame | None = None, observed_at: str = "", state: str = "fresh") -> DataFrame:
    """One reference a node: where it is, in which snapshot, and the hash of its file now."""
    if state not in STATES:
        raise GraphError("EVIDENCE_BAD_FRESHNESS", "no such state", state=state)
    if not of:
        raise GraphError("EVIDENCE_SNAPSHOT_REQUIRED", "a reference names its snapshot")
    now = (manifest.select("path", "content_hash") if manifest is not None else nodes.sparkSession.createDataFrame([], "path string, content_hash string")).dropDuplicates(["path"])
    out = nodes.withColumn("source_ref_id", source_ref_id()).join(now, "path", "left")
    return out.select(F.concat(F.lit(f"evidence://{of}/"), "id").alias("ref_uri"), F.col("id").alias("node_id"), "source_ref_id", F.lit(of).alias("snapshot_id"), F.lit(observed_at).alias("observed_at_iso"), F.lit(state).alias("freshness_state"), F.coalesce("content_hash", F.lit("")).alias("content_hash"))


def verify(given: DataFrame, nodes: DataFrame, manifest: DataFrame) -> DataFrame:
    """The references with the state that they are in now; where there is no hash now the old one stays."""
    asked = given.select("ref_uri", "node_id", "content_hash", (F.col("freshness_state") == "stale").alias("stale"))
    now = resolve.evidence_state(asked, nodes, manifest)
    rest = given.select("ref_uri", "source_ref_id", "snapshot_id", "observed_at_iso")
    return now.join(rest, "ref_uri").select("ref_uri", "node_id", "source_ref_id", "snapshot_id", "observed_at_iso", F.col("state").alias("freshness_state"), "content_hash")


def state_counts(given: DataFrame) -> DataFrame:
    """state, n: every state, also those that don't occur."""
    every = given.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    return every.join(given.groupBy(F.col("freshness_state").alias("state")).agg(F.count(F.lit(1)).alias("n")), "state", "left").select("state", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def omitted_of(given: DataFrame) -> DataFrame:
    """reason, item_id of the references that aren't fresh."""
    return given.where("freshness_state <> 'fresh'").select(F.concat(F.lit("evidence_"), "freshness_state").alias("reason"), F.col("ref_uri").alias("item_id"))


def bundle_id(*parts: str) -> str:
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:16]


def collect(s: Snapshot, query: str, kind: str = "search", manifest: DataFrame | None = None, observed_at: str = "", max_results: int = 10) -> tuple[str, DataFrame]:
    """(bundle id, references) of a search's hits or of a node's neighbourhood."""
    if kind not in QUERY_KINDS:
        raise GraphError("EVIDENCE_BAD_QUERY_KIND", "no such kind of query", kind=kind)
    if not query.strip():
        raise GraphError("EVIDENCE_NODE_REQUIRED", "a query or a node is needed")
    of = snapshot_id(s)
    if kind == "search":
        ids = search.search(s.nodes, search.Request(query, max_results=max_results)).hits.select("id")
    else:
        ids = traverse.neighborhood(s.nodes, s.edges, query, max_results=max_results).select("id")
    return bundle_id(of, kind, query), refs(s.nodes.join(ids, "id", "left_semi"), of, manifest, observed_at)


def require(given: Sequence[dict]) -> None:
    """A bundle that came from outside: refused if a reference lacks what it must name."""
    if not given:
        raise GraphError("EVIDENCE_BUNDLE_REQUIRED", "the bundle is empty")
    for r in given:
        for key, code in (("ref_uri", "EVIDENCE_REF_REQUIRED"), ("node_id", "EVIDENCE_NODE_REQUIRED"), ("snapshot_id", "EVIDENCE_SNAPSHOT_REQUIRED")):
            if not r.get(key):
                raise GraphError(code, f"a reference needs {key}")
        if r.get("freshness_state") not in STATES:
            raise GraphError("EVIDENCE_BAD_FRESHNESS", "no such state", state=r.get("freshness_state"))
