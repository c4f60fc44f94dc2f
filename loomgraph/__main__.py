"""python -m loomgraph COMMAND ...: the engine from a shell; every command prints JSON, Markdown or lines.

Stores are folders written by `index` or `store-import`; SNAPSHOT is such a folder or a canonical .json file.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable
from dataclasses import asdict
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from . import evidence, mcp, pack, refresh, registry, report, store, viewer, workspace
from .operators import diff, navigate, search
from .schema import GraphError
from .service import Service
from .snapshot import Snapshot, from_json, load, save, to_json
from .sources import exports, files, git, interchange, scip

Command = Callable[[SparkSession, argparse.Namespace], Any]
COMMANDS: dict[str, tuple[tuple[str, ...], Command]] = {}


def command(name: str, *operands: str) -> Callable[[Command], Command]:
    def add(f: Command) -> Command:
        COMMANDS[name] = (operands, f)
        return f

    return add


def read(spark: SparkSession, path: str) -> Snapshot:
    return from_json(spark, Path(path).read_text()) if path.endswith(".json") else load(spark, path)


def rows(df: DataFrame, limit: int = 1000) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(limit).collect()]


# --- index and search ---


@command("index", "root", "store")
def _(spark, a):
    s = files.index_path(spark, a.root, a.namespace)
    return save(git.with_history(s, a.root) if a.history else s, a.store)


@command("snapshot", "store")
def _(spark, a):
    return to_json(read(spark, a.store))


for _name, *_operands in (("query", "text"), ("explain", "text"), ("investigate", "text"), ("neighborhood", "node"), ("impact", "node"), ("path", "source", "target"), ("report",), ("health",), ("repo-map",), ("topology",)):

    def _serve(spark, a, name=_name):
        given = {"query": getattr(a, "text", None), "node_id": getattr(a, "node", None), "source_id": getattr(a, "source", None), "target_id": getattr(a, "target", None), "max_results": a.max_results if name in ("query", "explain", "investigate", "neighborhood") else None}
        return Service(read(spark, a.store)).handle({"method": name.replace("-", "_"), "params": {k: v for k, v in given.items() if v is not None}})

    command(_name, "store", *_operands)(_serve)


@command("query-plan", "store", "text")
def _(spark, a):
    return rows(store.query_plan(read(spark, a.store).nodes, search.Request(a.text, max_results=a.max_results)))


@command("ci-delta", "old", "new")
def _(spark, a):
    return refresh.delta_review(read(spark, a.old), read(spark, a.new))


@command("serve", "store")
def _(spark, a):
    Service(read(spark, a.store)).serve()


@command("mcp", "store")
def _(spark, a):
    mcp.Server(Service(read(spark, a.store))).serve()


@command("mcp-config", "store")
def _(spark, a):
    return mcp.client_config(sys.executable, a.store)


@command("mcp-smoke", "store")
def _(spark, a):
    return mcp.smoke(mcp.Server(Service(read(spark, a.store))))


# --- history, documents, reports ---


@command("git-commits-for-path", "store", "place")
def _(spark, a):
    s = read(spark, a.store)
    return rows(navigate.commits_for_path(s.nodes, s.edges, a.place, a.max_results).select("id", "label", "metadata"))


@command("git-files-for-commit", "store", "commit")
def _(spark, a):
    s = read(spark, a.store)
    found = navigate.find_commit(s.nodes, a.commit)
    if found is None:
        raise GraphError("git_commit_not_found", "no such commit, or more than one", commit=a.commit)
    return rows(navigate.files_for_commit(s.nodes, s.edges, found, a.max_results))


@command("git-commits-for-symbol", "store", "symbol")
def _(spark, a):
    s = read(spark, a.store)
    return rows(navigate.commits_for_symbol(s.nodes, s.edges, a.symbol, a.max_results).select("id", "label"))


@command("git-lineage", "root", "place")
def _(spark, a):
    text, why = git.log(a.root)
    if why:
        raise GraphError(why, "no history here", root=a.root)
    return navigate.rename_lineage(git.changes(git.commits(spark, text)).withColumnRenamed("commit_hash", "commit_id"), a.place)


for _name, _make in (("report-md", report.report_md), ("repo-map-md", report.repo_map_md), ("topology-md", report.topology_md), ("doc-graph", report.doc_graph_md), ("certify", report.certification_md)):
    command(_name, "store")(lambda spark, a, make=_make: make(read(spark, a.store)))


@command("certify-json", "store")
def _(spark, a):
    s = read(spark, a.store)
    return rows(report.certification(s.nodes, s.edges, s.omitted))[0] | report.canonical(s)


@command("parser-support")
def _(spark, a):
    return rows(registry.support(spark))


# --- interchange ---


@command("export", "store", "format")
def _(spark, a):
    return exports.export(read(spark, a.store), a.format)


@command("graph-json-export", "store")
def _(spark, a):
    return exports.graph_json(read(spark, a.store))


@command("graph-json-import", "file", "store")
def _(spark, a):
    return save(interchange.from_graph_json(spark, Path(a.file).read_text(), a.namespace), a.store)


@command("interchange", "store")
def _(spark, a):
    symbols, references = exports.reference_bundle(read(spark, a.store))
    return {"symbols": rows(symbols), "references": rows(references)}


@command("scip-export", "store")
def _(spark, a):
    return scip.to_index_json(read(spark, a.store))


@command("precise-import", "file", "store")
def _(spark, a):
    snap, told = scip.load(spark, a.file, a.namespace)
    return told | {"version": save(snap, a.store)}


# --- refresh ---


@command("refresh", "root", "state")
def _(spark, a):
    return files.refresh(spark, a.root, a.state, a.namespace)[1]


@command("refresh-plan", "root", "state")
def _(spark, a):
    return rows(refresh.plan_root(spark, a.root, a.state).where("changed").orderBy("path"))


@command("refresh-status", "state")
def _(spark, a):
    return asdict(refresh.read_status(spark, a.state))


@command("profile-init", "profile", "root", "state")
def _(spark, a):
    refresh.write_profile(spark, a.profile, refresh.Profile(Path(a.profile).stem, a.root, a.state, a.namespace))


@command("profile-run", "profile")
def _(spark, a):
    return asdict(refresh.run(spark, refresh.read_profile(spark, a.profile)))


@command("freshness", "old", "new")
def _(spark, a):
    return refresh.freshness(read(spark, a.old), read(spark, a.new))


# --- stores ---


@command("store-catalog")
def _(spark, a):
    return rows(store.catalog(spark))


@command("store-import", "snapshot", "folder")
def _(spark, a):
    return store.open_store(spark, a.folder, a.backend).import_snapshot(read(spark, a.snapshot))


@command("store-export", "folder")
def _(spark, a):
    return to_json(store.open_store(spark, a.folder, a.backend).export_snapshot())


for _name, _method in (("store-manifest", "manifest"), ("store-capabilities", "capabilities"), ("store-health", "health"), ("store-migrate", "migrate")):
    command(_name, "folder")(lambda spark, a, method=_method: getattr(store.open_store(spark, a.folder, a.backend), method)())


@command("store-query", "folder", "text")
def _(spark, a):
    got = store.open_store(spark, a.folder, a.backend).query(search.Request(a.text, max_results=a.max_results))
    return {"hits": rows(got.hits.select("id", "kind", "label", "path", "score")), "omitted": got.omitted, "diagnostics": got.diagnostics}


@command("store-explain", "folder", "text")
def _(spark, a):
    return asdict(store.ParquetStore(spark, a.folder).explain(search.Request(a.text, max_results=a.max_results)))


@command("store-delta", "snapshot", "folder")
def _(spark, a):
    return asdict(store.ParquetStore(spark, a.folder).apply_delta(read(spark, a.snapshot)))


@command("store-neighborhood", "folder", "node")
def _(spark, a):
    return rows(store.open_store(spark, a.folder, a.backend).neighborhood(a.node, max_results=a.max_results).drop("way"))


@command("store-path", "folder", "source", "target")
def _(spark, a):
    return store.open_store(spark, a.folder, a.backend).path(a.source, a.target)


@command("store-round-trip", "snapshot", "folder")
def _(spark, a):
    return store.round_trip(read(spark, a.snapshot), store.open_store(spark, a.folder, a.backend))


# --- workspaces ---


def _roots(items: list[str]) -> list[workspace.Root]:
    return [workspace.Root(name, path, name) for name, _, path in (x.partition("=") for x in items)]


@command("workspace-init", "folder", "roots+")
def _(spark, a):
    return workspace.Workspace(spark, a.folder).init(a.namespace, _roots(a.roots))


@command("workspace-init-config", "folder", "config")
def _(spark, a):
    found = workspace.read_config(a.config)
    return workspace.Workspace(spark, a.folder).init(found["namespace"], found["roots"])


@command("workspace-refresh", "folder")
def _(spark, a):
    return workspace.Workspace(spark, a.folder).refresh()


@command("workspace-status", "folder")
def _(spark, a):
    return workspace.Workspace(spark, a.folder).status()


@command("workspace-query", "folder", "text")
def _(spark, a):
    return Service(workspace.Workspace(spark, a.folder).snapshot()).handle({"method": "query", "params": {"query": a.text, "max_results": a.max_results}})


@command("workspace-serve", "folder")
def _(spark, a):
    Service.of_workspace(spark, a.folder).serve()


@command("multi-root-index", "store", "roots+")
def _(spark, a):
    return save(workspace.index_multi_root(spark, _roots(a.roots), a.namespace), a.store)


@command("multi-root-compose", "store", "roots+")
def _(spark, a):
    parts = [workspace.Input(name, read(spark, path)) for name, _, path in (x.partition("=") for x in a.roots)]
    return save(workspace.compose(parts, a.namespace), a.store)


# --- viewer, packs, evidence ---


@command("viewer-envelope", "store")
def _(spark, a):
    return viewer.write_envelope(viewer.envelope(read(spark, a.store)))


@command("viewer-capabilities")
def _(spark, a):
    return viewer.CAPABILITIES


@command("viewer-cluster", "store", "cluster")
def _(spark, a):
    s = read(spark, a.store)
    got, lost = viewer.cluster_nodes(s.nodes, s.edges, int(a.cluster))
    return {"nodes": rows(viewer.node_records(got)), "omissions": lost}


@command("viewer-content", "store", "node")
def _(spark, a):
    return viewer.content(read(spark, a.store).nodes, a.node, "full")


@command("viewer-neighborhood", "envelope", "node")
def _(spark, a):
    return viewer.visible_neighborhood(viewer.read_envelope(Path(a.envelope).read_text()), a.node)


@command("viewer-path", "envelope", "source", "target")
def _(spark, a):
    return viewer.visible_path(viewer.read_envelope(Path(a.envelope).read_text()), a.source, a.target)


@command("viewer-omitted", "envelope")
def _(spark, a):
    return viewer.explain_omitted(viewer.read_envelope(Path(a.envelope).read_text()).omissions)


@command("viewer-delta", "old", "new")
def _(spark, a):
    return rows(viewer.delta_markers(read(spark, a.old), read(spark, a.new), a.max_results))


@command("viewer-patch", "old", "new")
def _(spark, a):
    return viewer.live_patch(read(spark, a.old), read(spark, a.new), 1)


@command("viewer-fixture", "nodes", "store")
def _(spark, a):
    return save(viewer.ring(spark, int(a.nodes)), a.store)


@command("graph-pack-write", "snapshot", "folder")
def _(spark, a):
    return pack.write(read(spark, a.snapshot), a.folder)


for _name, _do in (("graph-pack-inspect", pack.inspect), ("graph-pack-review", pack.review)):
    command(_name, "folder")(lambda spark, a, do=_do: do(spark, a.folder))


@command("graph-pack-verify", "folder")
def _(spark, a):
    return rows(pack.verify(spark, a.folder))


@command("graph-pack-import", "folder", "store")
def _(spark, a):
    return save(pack.load(spark, a.folder), a.store)


@command("evidence", "store", "text")
def _(spark, a):
    of, refs = evidence.collect(read(spark, a.store), a.text, max_results=a.max_results)
    return {"bundle_id": of, "refs": rows(refs)}


@command("doctor", "store")
def _(spark, a):
    s = read(spark, a.store)
    gap = diff.duplicates(s.nodes).isEmpty()
    return {"unique_ids": gap, "privacy": rows(report.certification(s.nodes, s.edges, s.omitted))[0], "freshness": rows(report.freshness(s.nodes))}


def main(args: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="loomgraph", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name, (operands, _f) in COMMANDS.items():
        p = sub.add_parser(name)
        for o in operands:
            p.add_argument(o.rstrip("+"), **({"nargs": "+"} if o.endswith("+") else {}))
        p.add_argument("--max-results", type=int, default=10)
        p.add_argument("--namespace", default="default")
        p.add_argument("--backend", default="parquet")
        p.add_argument("--history", action="store_true")
    a = top.parse_args(args)
    here = str(Path(__file__).resolve().parent.parent)
    os.environ["PYTHONPATH"] = os.pathsep.join([here, os.environ.get("PYTHONPATH", "")]).rstrip(os.pathsep)
    spark = SparkSession.builder.appName("loomgraph").getOrCreate()
    try:
        got = COMMANDS[a.command][1](spark, a)
        if isinstance(got, str) and "\n" in got:
            sys.stdout.write(got)
        elif got is not None:
            print(got if isinstance(got, str) else json.dumps(got, indent=2, sort_keys=True, default=str))
        return int(isinstance(got, dict) and "error" in got)
    except GraphError as e:
        print(json.dumps({"error": {"code": e.code, "message": e.message}}), file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
