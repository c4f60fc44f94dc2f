"""Several roots as one graph: validated composition, symbols resolved across roots, and a workspace folder with its state.

Inputs are few (a list on the driver); their rows are only ever joined and counted where they lie.
"""

from __future__ import annotations

import hashlib
import json
import tomllib
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .folders import join, read_text, replace_text, there
from .functions import meta, uri
from .operators import diff, resolve
from .schema import EDGES, NODES, OMITTED, SNAPSHOT_VERSION, GraphError
from .snapshot import Snapshot, bundle, conform, load, save, to_json
from .sources import files

CONFIG_VERSION = "loomgraph.workspace.v1"
DETAILS_PER_OUTCOME, IDS_PER_DETAIL = 100, 20


@dataclass(frozen=True)
class Root:
    name: str
    path: str
    namespace: str


@dataclass(frozen=True)
class Input:
    name: str
    snapshot: Snapshot


# --- roots indexed together ---


def check_roots(roots: list[Root]) -> None:
    if not roots:
        raise GraphError("NO_ROOTS", "at least one root is needed")
    for r in roots:
        if not r.name.strip() or not r.namespace.strip() or not r.path:
            raise GraphError("INVALID_ROOT", "a root has a name, a path and a namespace", root=r.name)
    for what, code in (("name", "DUPLICATE_ROOT"), ("namespace", "DUPLICATE_ROOT_NAMESPACE")):
        values = [getattr(r, what) for r in roots]
        if len(set(values)) < len(values):
            raise GraphError(code, f"roots share a {what}", values=sorted(v for v in set(values) if values.count(v) > 1))


def multi_root_union(parts: list[tuple[str, Snapshot]], namespace: str, created_at: str = "") -> Snapshot:
    """The parts' rows with `workspace_root` in their metadata; of rows that share an id those of the last part stay."""

    def gathered(name: str, schema: str) -> DataFrame:
        each = [conform(getattr(s, name), schema).withColumn("order", F.lit(i)).withColumn("metadata", tagged(F.lit(root))) for i, (root, s) in enumerate(parts)]
        return diff.last_wins(reduce(DataFrame.unionByName, each), "id", "order").drop("order")

    omitted = reduce(DataFrame.unionByName, (conform(s.omitted, OMITTED) for _, s in parts))
    return bundle(gathered("nodes", NODES), gathered("edges", EDGES), omitted, namespace=namespace, created_at=created_at, roots=[r for r, _ in parts])


def tagged(root) -> F.Column:
    """metadata with workspace_root as its last key."""
    body = F.when(F.coalesce("metadata", F.lit("")).isin("", "{}"), F.lit("{")).otherwise(F.concat(F.expr("left(metadata, length(metadata) - 1)"), F.lit(",")))
    return F.concat(body, F.lit('"workspace_root":"'), root, F.lit('"}'))


def index_multi_root(spark: SparkSession, roots: list[Root], namespace: str = "workspace", created_at: str = "") -> Snapshot:
    check_roots(roots)
    return multi_root_union([(r.name, files.index_path(spark, r.path, r.namespace, created_at=created_at)) for r in roots], namespace, created_at)


# --- composition of finished snapshots ---


def check_inputs(inputs: list[Input]) -> None:
    """Names, namespaces and versions on the driver; projects and dangling ends by a count each."""
    if not inputs:
        raise GraphError("NO_SNAPSHOT_INPUTS", "at least one snapshot is needed")
    for i in inputs:
        if not i.name.strip() or not isinstance(i.snapshot, Snapshot):
            raise GraphError("INVALID_SNAPSHOT_INPUT", "an input has a name and a snapshot", name=i.name)
    names = [i.name for i in inputs]
    if len(set(names)) < len(names):
        raise GraphError("DUPLICATE_SNAPSHOT_INPUT", "inputs share a name", names=sorted(names))
    spaces = [i.snapshot.header.get("namespace", "") for i in inputs]
    if len(set(spaces)) < len(spaces):
        raise GraphError("DUPLICATE_SNAPSHOT_NAMESPACE", "inputs share a namespace", namespaces=sorted(spaces))
    for i in inputs:
        if i.snapshot.header.get("schema_version") != SNAPSHOT_VERSION:
            raise GraphError("UNSUPPORTED_SCHEMA_VERSION", "an input has another version", name=i.name)
        if i.snapshot.header.get("composed"):
            raise GraphError("NESTED_SNAPSHOT_COMPOSITION", "an input is itself composed", name=i.name)
        projects = i.snapshot.nodes.where("kind = 'project'").limit(2).count()
        if projects != 1:
            raise GraphError("INVALID_PROJECT_NODE_COUNT", "an input has exactly one project", name=i.name, projects=projects)
        resolve.require_ends(i.snapshot.nodes, i.snapshot.edges)


def symbols_of(nodes: DataFrame, root: str) -> DataFrame:
    """root, node_id, symbol, family, valid, external, defines of the nodes that carry a symbol identity.

    A definition is one that isn't external and has a path and a line.
    """
    parts = F.split(meta("metadata", "scip_symbol"), " ")
    known = nodes.where(meta("metadata", "scip_symbol").isNotNull())
    external = F.coalesce(meta("metadata", "scip_external") == "true", F.lit(False))
    return known.select(
        F.lit(root).alias("root"), F.col("id").alias("node_id"), meta("metadata", "scip_symbol").alias("symbol"),
        # scheme, manager and name without the version, then the descriptors
        F.concat_ws(" ", parts[0], parts[1], parts[2], F.array_join(F.slice(parts, 5, 1000), " ")).alias("family"),
        (F.size(parts) >= 5).alias("valid"), external.alias("external"), (~external & (F.col("path") != "") & F.col("line").isNotNull()).alias("defines"),
    )


def resolution_edges(outcomes: DataFrame, namespace: str) -> DataFrame:
    """Edges from external symbols to their one exact definition, with what they rest on; the symbol itself only as a digest."""
    exact = outcomes.where("outcome = 'exact'")
    digest = F.sha2(F.col("symbol"), 256)
    made = F.to_json(F.struct(F.lit("exact").alias("resolution_kind"), F.col("root").alias("source_root"), digest.alias("symbol_sha256")))
    out = exact.select(uri(namespace, F.lit("edge"), F.concat_ws("|", "node_id", F.lit("resolves_to"), "target_id")).alias("id"), F.lit("resolves_to").alias("kind"), F.col("node_id").alias("source_id"), "target_id", made.alias("metadata"))
    return conform(out, EDGES)


def resolution_details(outcomes: DataFrame, per_outcome: int = DETAILS_PER_OUTCOME) -> DataFrame:
    """Rows of `omitted` about what didn't resolve: the first of each outcome by node, as reason, item_id, details."""
    rank = F.row_number().over(Window.partitionBy("outcome").orderBy("node_id"))
    first = outcomes.where("outcome <> 'exact'").withColumn("n", rank).where(F.col("n") <= per_outcome)
    names = {"missing": "cross_repo_definition_missing", "ambiguous": "cross_repo_definition_ambiguous", "same_root": "cross_repo_definition_same_root", "version_mismatch": "cross_repo_package_version_mismatch", "invalid": "cross_repo_identity_invalid"}
    reason = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[F.col("outcome")]
    return first.select(reason.alias("reason"), F.col("node_id").alias("item_id"), F.to_json(F.struct("root", F.sha2("symbol", 256).alias("symbol_sha256"))).alias("details"))


def diagnostics(omitted: DataFrame, reason: str = "", limit: int | None = None) -> DataFrame:
    """Cross-root rows of `omitted`, of one reason or all, in order."""
    own = omitted.where(F.col("reason").startswith("cross_repo_") & ((F.lit(reason) == "") | (F.col("reason") == reason)))
    return own if limit is None else own.orderBy("reason", "item_id", "details").limit(max(0, limit))


def canonical_sha(snapshot: Snapshot) -> str:
    return hashlib.sha256(to_json(snapshot).encode()).hexdigest()


def fingerprint(snapshot: Snapshot) -> str:
    """A digest of all rows that doesn't bring them to the driver: equal graphs agree, whatever their order."""
    parts = []
    for name in ("nodes", "edges", "omitted"):
        df = getattr(snapshot, name)
        row = df.agg(F.count(F.lit(1)), *(F.sum(F.xxhash64(F.lit(seed), *df.columns).cast("decimal(38,0)")) for seed in (1, 2))).first()
        parts.append([name, *map(str, row)])
    return hashlib.sha256(json.dumps([parts, snapshot.header], sort_keys=True).encode()).hexdigest()


def compose(inputs: list[Input], namespace: str = "workspace", created_at: str = "", check: bool = True) -> Snapshot:
    """Disjoint union of the inputs under a workspace node, with symbols resolved across them and a digest of each input."""
    if check:
        check_inputs(inputs)
    spark = inputs[0].snapshot.spark
    nodes = diff.disjoint_union([conform(i.snapshot.nodes, NODES) for i in inputs], "NODE")
    edges = diff.disjoint_union([conform(i.snapshot.edges, EDGES) for i in inputs], "EDGE")
    omitted = reduce(DataFrame.unionByName, (conform(i.snapshot.omitted, OMITTED) for i in inputs))
    top = spark.range(1).select(uri(namespace, F.lit("workspace"), F.lit(namespace)).alias("id"), F.lit("workspace").alias("kind"), F.lit(namespace).alias("label"))
    held = nodes.where("kind = 'project'").crossJoin(F.broadcast(top.select(F.col("id").alias("top"))))  # one row on the right
    contains = held.select(F.concat_ws("|", "top", F.lit("contains"), "id").alias("id"), F.lit("contains").alias("kind"), F.col("top").alias("source_id"), F.col("id").alias("target_id"))
    symbols = reduce(DataFrame.unionByName, (symbols_of(i.snapshot.nodes, i.name) for i in inputs))
    outcomes = resolve.symbol_outcomes(symbols.where("external").select("root", "node_id", "symbol", "family", "valid"), symbols.where("defines").select("root", "node_id", "symbol", "family"))
    edges = edges.unionByName(conform(contains, EDGES)).unionByName(resolution_edges(outcomes, namespace))
    omitted = omitted.unionByName(conform(resolution_details(outcomes), OMITTED))
    sums = {i.name: fingerprint(i.snapshot) for i in inputs}
    return bundle(nodes.unionByName(conform(top, NODES)), edges, omitted, namespace=namespace, created_at=created_at, composed=True, inputs=sums)


# --- a workspace: configuration, roots, store and state in one folder ---


def read_config(path: str) -> dict:
    """The roots and namespace of a workspace's TOML; paths are relative to the file's folder."""
    file = Path(path)
    if not file.is_file():
        raise GraphError("WORKSPACE_CONFIG_NOT_FOUND", "no such configuration", path=path)
    try:
        found = tomllib.loads(file.read_text())
    except tomllib.TOMLDecodeError as e:
        raise GraphError("INVALID_WORKSPACE_CONFIG", "the configuration isn't TOML", error=str(e)) from e
    roots = found.get("roots", [])
    if found.get("schema_version") != CONFIG_VERSION or not isinstance(roots, list) or not all(isinstance(r, dict) and {"name", "path"} <= set(r) for r in roots):
        raise GraphError("INVALID_WORKSPACE_CONFIG", "a version and a list of roots with name and path are needed", path=path)
    base = file.resolve().parent
    return {"namespace": found.get("namespace", "workspace"), "roots": [Root(r["name"], str((base / r["path"]).resolve()), r.get("namespace", r["name"])) for r in roots]}


def write_config(path: str, namespace: str, roots: list[Root]) -> None:
    quote = lambda x: '"' + x.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    lines = [f"schema_version = {quote(CONFIG_VERSION)}", f"namespace = {quote(namespace)}"]
    for r in roots:
        lines += ["", "[[roots]]", f"name = {quote(r.name)}", f"path = {quote(r.path)}", f"namespace = {quote(r.namespace)}"]
    Path(path).write_text("\n".join(lines) + "\n")


class Workspace:
    """workspace.json, the store, each root's refresh state and the last status, below one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def init(self, namespace: str, roots: list[Root]) -> dict:
        check_roots(roots)
        body = {"schema_version": CONFIG_VERSION, "namespace": namespace, "roots": [[r.name, r.path, r.namespace] for r in roots]}
        replace_text(self.spark, join(self.folder, "workspace.json"), json.dumps(body, sort_keys=True, indent=2))
        return body

    def metadata(self) -> dict:
        path = join(self.folder, "workspace.json")
        if not there(self.spark, path):
            raise GraphError("WORKSPACE_NOT_FOUND", "no workspace here", path=self.folder)
        try:
            body = json.loads(read_text(self.spark, path))
            roots = [Root(*r) for r in body["roots"]]
            if body["schema_version"] != CONFIG_VERSION:
                raise ValueError("another version")
        except (ValueError, KeyError, TypeError) as e:
            raise GraphError("INVALID_WORKSPACE_METADATA", "the workspace's metadata can't be read", error=str(e)) from e
        return {"namespace": body["namespace"], "roots": roots}

    def refresh(self, created_at: str = "") -> dict:
        """Every root refreshed from its own state, their union saved, and the status written last."""
        m = self.metadata()
        parts, work = [], {}
        try:
            for r in m["roots"]:
                snap, work[r.name] = files.refresh(self.spark, r.path, join(self.folder, "state", r.name), r.namespace)
                parts.append((r.name, snap))
            version = save(multi_root_union(parts, m["namespace"], created_at), join(self.folder, "store"))
            status = {"ok": True, "version": version, "work": work}
        except Exception as e:
            replace_text(self.spark, join(self.folder, "status.json"), json.dumps({"ok": False, "error": type(e).__name__}))
            raise
        replace_text(self.spark, join(self.folder, "status.json"), json.dumps(status, sort_keys=True))
        return status

    def status(self) -> dict:
        path = join(self.folder, "status.json")
        return json.loads(read_text(self.spark, path)) if there(self.spark, path) else {"ok": False, "error": "never_refreshed"}

    def snapshot(self) -> Snapshot:
        return load(self.spark, join(self.folder, "store"))
