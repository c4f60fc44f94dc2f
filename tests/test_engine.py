"""Stores, workspaces, viewer, packs, evidence, precise indexes, registry, refresh and the servers, on small graphs."""

import io
import json
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomgraph import evidence, mcp, pack, refresh, registry, report, store, viewer, workspace
from loomgraph.operators import search, traverse
from loomgraph.schema import GraphError
from loomgraph.service import Service
from loomgraph.snapshot import bundle, save, to_json
from loomgraph.sources import files, parsers, scip

ROOT = str(Path(__file__).resolve().parent.parent)


def small(spark, n=40, seed=2, **header):
    r = random.Random(seed)
    words = "river mill wheel flour water road floor".split()
    nodes = [(f"n{i:02d}", r.choice(("file", "symbol", "doc_section")), " ".join(r.sample(words, 2)), f"src/{i % 7}.py", "x " * (i % 4), "{}") for i in range(n)]
    edges = sorted({(f"n{r.randrange(n):02d}", f"n{r.randrange(n):02d}") for _ in range(2 * n)})
    return bundle(
        spark.createDataFrame(nodes, "id string, kind string, label string, path string, text string, metadata string"),
        spark.createDataFrame([(f"e{k:03d}", "links", a, b) for k, (a, b) in enumerate(edges)], "id string, kind string, source_id string, target_id string"),
        spark.createDataFrame([("binary_file", "a.bin", "{}")], "reason string, item_id string, details string"), **header,
    )


@pytest.mark.parametrize("text", ["river", "mill wheel", "n0", "src/3.py", "ri", "x", "nothing here", "", "RIVER Road"])
def test_store_search_equals_the_scan(spark, tmp_path, text):
    s = small(spark)
    st = store.ParquetStore(spark, f"file://{tmp_path}/s")
    st.import_snapshot(s)
    for request in (search.Request(text, max_results=7), search.Request(text, node_ids=("n03", "n11"))):
        want, got = search.search(s.nodes, request, s.edges), st.query(request)
        rows = lambda x: [tuple(r) for r in x.hits.orderBy(*search.order()).select("id", "score", "edge_ids").collect()]
        assert rows(got) == rows(want) and got.diagnostics["candidate_count"] == want.diagnostics["candidate_count"] and got.next_cursor == want.next_cursor


def test_store_work_and_deltas(spark, tmp_path):
    s, folder = small(spark), f"file://{tmp_path}/s"
    st = store.open_store(spark, folder)
    with pytest.raises(GraphError, match="STORE_SNAPSHOT_NOT_FOUND"):
        st.manifest()
    st.import_snapshot(s)
    assert st.manifest()["source_ref_count"] == 40 + s.edges.count() and st.capabilities()["delta"]
    x = st.explain("flour water")
    assert x.strategy == "indexed_trigram" and 0 < x.candidates < x.nodes and "==" in x.plan
    assert st.explain("ri").strategy == "full_scan" and st.explain(search.Request("", ("n01",))).candidates == 1
    version = st._version()
    assert st.apply_delta(s) == store.Update(0, 0, 0, 0, version)
    new = s.with_(nodes=s.nodes.where("id <> 'n00'").withColumn("label", F.when(F.col("id") == "n01", "new name").otherwise(F.col("label"))), edges=s.edges.where("source_id <> 'n00' and target_id <> 'n00'"))
    with pytest.raises(RuntimeError):
        st.apply_delta(new, fail_after="edges")
    assert st._version() == version and st.node("n00").count() == 1
    u = st.apply_delta(new)
    assert (u.added, u.changed, u.rows_written) == (0, 1, 1) and st.node("n00").isEmpty() and st.query("new name").hits.first()["id"] == "n01"
    assert to_json(st.export_snapshot()) == to_json(new)
    assert [r["id"] for r in st.neighborhood("n05", depth=2).orderBy("place").collect()] == [r["id"] for r in traverse.neighborhood(new.nodes, new.edges, "n05", depth=2).orderBy("place").collect()]
    with pytest.raises(GraphError, match="STORE_BACKEND_UNSUPPORTED"):
        store.open_store(spark, folder, "kuzu")
    old = store.ParquetStore(spark, f"file://{tmp_path}/old")
    old.import_snapshot(s, layout=1)
    assert old.query("river").omitted[-1]["reason"] == "migration_required"
    with pytest.raises(GraphError, match="STORE_MIGRATION_REQUIRED"):
        old.apply_delta(new)
    assert old.migrate()["layout"] == 2 == old.migrate()["layout"] and old.query("river").omitted == []
    js = store.JsonStore(spark, f"file://{tmp_path}/s.json")
    assert store.round_trip(s, js)["equal"] and js.health()["ok"] and js.path("n00", "n00") == []
    assert [r["id"] for r in js.query("river").hits.orderBy(*search.order()).collect()] == [r["id"] for r in search.search(s.nodes, "river").hits.orderBy(*search.order()).collect()]


def test_empty_store(spark, tmp_path):
    st = store.ParquetStore(spark, f"file://{tmp_path}/s")
    st.import_snapshot(store.empty(spark))
    assert st.query("river").hits.isEmpty() and st.manifest()["node_count"] == 0


def project(spark, root, name, body):
    (root / name).mkdir(parents=True)
    (root / name / "app.py").write_text(body)
    (root / name / "README.md").write_text(f"# {name}\n\nsee [app](app.py) and [gone](#gone)\n")
    return workspace.Root(name, str(root / name), name)


def test_workspace(spark, tmp_path):
    roots = [project(spark, tmp_path / "r", "one", "import json\n\ndef f():\n    return 1\n"), project(spark, tmp_path / "r", "two", "class A:\n    pass\n")]
    ws = workspace.Workspace(spark, f"file://{tmp_path}/ws")
    with pytest.raises(GraphError, match="WORKSPACE_NOT_FOUND"):
        ws.metadata()
    assert ws.status()["ok"] is False
    ws.init("both", roots)
    first = ws.refresh()
    assert first["ok"] and all(w["reused"] == 0 for w in first["work"].values())
    (tmp_path / "r/two/app.py").write_text("class B:\n    pass\n")
    again = ws.refresh()
    assert again["work"]["one"] == {"parsed": 0, "removed": 0, "reused": 2} and again["work"]["two"]["parsed"] == 1
    labels = {r["label"] for r in ws.snapshot().nodes.collect()}
    assert "B" in labels and "A" not in labels and "f" in labels
    config = tmp_path / "ws.toml"
    workspace.write_config(str(config), "both", [workspace.Root("one", "r/one", "one")])
    assert workspace.read_config(str(config))["roots"][0].path == str(tmp_path / "r/one")
    config.write_text("roots = 1")
    with pytest.raises(GraphError, match="INVALID_WORKSPACE_CONFIG"):
        workspace.read_config(str(config))
    with pytest.raises(GraphError, match="WORKSPACE_CONFIG_NOT_FOUND"):
        workspace.read_config(str(tmp_path / "none.toml"))
    parts = [workspace.Input(r.name, files.index_path(spark, r.path, r.namespace)) for r in roots]
    whole = workspace.compose(parts, "all", check=False)
    assert whole.nodes.where("kind = 'workspace'").count() == 1 and set(whole.header["inputs"]) == {"one", "two"}
    assert whole.edges.where("source_id like '%/workspace/%'").count() == 2
    assert workspace.fingerprint(parts[0].snapshot) == workspace.fingerprint(parts[0].snapshot) != workspace.fingerprint(parts[1].snapshot)


def test_profiles(spark, tmp_path):
    root = project(spark, tmp_path, "p", "x = 1\n")
    where = f"file://{tmp_path}/p.json"
    with pytest.raises(GraphError, match="INVALID_REFRESH_PROFILE"):
        refresh.read_profile(spark, where)
    refresh.write_profile(spark, where, refresh.Profile("p", root.path, f"file://{tmp_path}/out"))
    profile = refresh.read_profile(spark, where)
    assert refresh.plan_root(spark, root.path, f"{profile.folder}/state").where("changed").count() == 2
    done = refresh.run(spark, profile)
    assert done.ok and done.parsed == 2 and refresh.read_status(spark, profile.folder) == done
    assert refresh.plan_root(spark, root.path, f"{profile.folder}/state").where("changed").isEmpty()
    Path(root.path, "more.py").write_text("y = 2\n")
    more = refresh.run(spark, profile)
    assert more.parsed == 1 and more.reused == 2 and more.delta["node_added"] >= 1 and more.parsers == ["markdown", "python"]
    with pytest.raises(Exception):
        refresh.run(spark, refresh.Profile("p", str(tmp_path / "nowhere/at/all"), f"file://{tmp_path}/bad/\0"))
    with pytest.raises(GraphError, match="INVALID_REFRESH_STATUS"):
        refresh.read_status(spark, f"file://{tmp_path}/empty")
    a, b = small(spark), small(spark, seed=3)
    assert refresh.freshness(a, a)["differs"] is False and refresh.freshness(a, b)["differs"] and refresh.delta_review(a, b)["exit_code"] == 1


def test_refresh_state_of_another_namespace_is_left(spark, tmp_path):
    root = project(spark, tmp_path, "p", "x = 1\n")
    state = f"file://{tmp_path}/state"
    assert [files.refresh(spark, root.path, state, n)[1]["parsed"] for n in ("a", "a", "b")] == [2, 0, 2]
    snap, _ = files.refresh(spark, root.path, state, "b")
    assert snap.nodes.where("id like 'loom://a/%'").isEmpty()


def test_history_in_the_index(spark, tmp_path):
    from loomgraph.sources import git

    root = project(spark, tmp_path, "p", "x = 1\n")
    s = files.index_path(spark, root.path)
    assert git.with_history(s, root.path).omitted.where("reason = 'git_not_repo'").count() == 1
    run = lambda *a: subprocess.run(["git", "-C", root.path, "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "-A")
    run("commit", "-qm", "one")
    whole = git.with_history(s, root.path)
    part = git.overlay_of(whole)
    assert part.nodes.where("kind = 'git_commit'").count() == 1 and part.nodes.where("kind = 'changed_path'").count() == 2 and part.edges.where("kind = 'touches'").count() == 2
    assert whole.nodes.count() == s.nodes.count() + part.nodes.count()


@pytest.mark.parametrize("most", [2000, 1])
def test_mentions_of_labels_without_an_inner_word(spark, monkeypatch, most):
    from loomgraph.operators import views

    monkeypatch.setattr(views, "HEADS", most)
    texts = ["the red barn and the big dogma", "infrared", "Big Dog", "a wheel of flour is here", ""]
    labels = ["redb", "barn", "big dog", "rare", "heel of flour is", "of"]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "id string, text string")
    marks = spark.createDataFrame([(f"m{i}", x) for i, x in enumerate(labels)], "id string, label string")
    want = {(f"d{i}", f"m{j}") for i, t in enumerate(texts) for j, x in enumerate(labels) if len(x) >= 4 and x in t.lower()}
    assert {tuple(r) for r in views.mentions(docs, marks).collect()} == want and len(want) == 5


def test_viewer(spark):
    s = viewer.ring(spark, 200)
    assert s.edges.count() == 290
    raw = viewer.envelope(s, "raw", node_budget=50, edge_budget=20)
    assert [n["id"] for n in raw.nodes] == [f"node:{i:09d}" for i in range(50)] and len(raw.edges) == 20
    assert {o["reason"]: o["omitted"] for o in raw.omissions} == {"node_budget": 150, "edge_budget": s.edges.join(s.nodes.orderBy("id").limit(50).select(F.col("id").alias("source_id")), "source_id").join(s.nodes.orderBy("id").limit(50).select(F.col("id").alias("target_id")), "target_id").count() - 20}
    assert viewer.read_envelope(viewer.write_envelope(raw)) == raw
    near = viewer.visible_neighborhood(raw, "node:000000005", depth=1)
    assert near["nodes"] and not near["omissions"] and viewer.visible_neighborhood(raw, "node:000000005", depth=3, node_budget=1)["omissions"]
    assert viewer.visible_path(raw, "node:000000001", "node:000000004")["found"] and not viewer.visible_path(raw, "node:000000001", "gone")["found"]
    grouped = viewer.envelope(s, "cluster", node_budget=30)
    assert len(grouped.clusters) == 9 and grouped.bundles and {c["representative_id"] for c in grouped.clusters} <= {n["id"] for n in grouped.nodes}
    members, lost = viewer.cluster_nodes(s.nodes, s.edges, 0, budget=5)
    assert members.count() == 5 and lost[0]["reason"] == "cluster_budget"
    assert viewer.cluster_nodes(s.nodes, s.edges, 0, role="hub")[0].count() == 3 and viewer.cluster_nodes(s.nodes, s.edges, 0, role="bridge", budget=1)[1][0]["reason"] == "bridge_node_budget"
    text = bundle(spark.createDataFrame([("a", "y" * 400)], "id string, text string"), s.edges.limit(0))
    assert viewer.content(text.nodes, "a")["truncated"] and len(viewer.content(text.nodes, "a", "full")["text"]) == 400
    with pytest.raises(GraphError, match="not_found"):
        viewer.content(text.nodes, "b")
    old = s.with_(nodes=s.nodes.where("id <> 'node:000000000'"))
    patch = viewer.live_patch(old, s, 4)
    assert patch["revision"] == 4 and [(o["op"], o["id"]) for o in patch["operations"]] == [("node_upsert", "node:000000000")] and patch["operations"][0]["row"]["label"] == "Node 0"
    assert [r["marker"] for r in viewer.delta_markers(old, s).collect()] == ["node_added"]
    assert viewer.level_for(spark, 2000) == "raw" and viewer.level_for(spark, 60_000) == "cluster" and viewer.chain(spark, 0).nodes.isEmpty()


def test_packs_and_evidence(spark, tmp_path):
    s, folder = small(spark, namespace="p"), f"file://{tmp_path}/pack"
    with pytest.raises(GraphError, match="GRAPH_PACK_MANIFEST_NOT_FOUND"):
        pack.inspect(spark, folder)
    of, refs = evidence.collect(s, "river")
    assert len(of) == 16 and refs.count() > 0 and evidence.collect(s, "river")[0] == of != evidence.collect(s, "mill")[0]
    pack.write(s, folder, store="yes", evidence=refs)
    assert pack.review(spark, folder)["ok"] and to_json(pack.load(spark, folder)) == to_json(s)
    assert pack.load_evidence(spark, folder).count() == refs.count() and pack.load_store(spark, folder).manifest()["node_count"] == 40
    victim = next((tmp_path / "pack/nodes").glob("part-*.parquet"))
    data = victim.read_bytes()
    victim.with_name(f".{victim.name}.crc").unlink()  # or the file system finds the damage itself
    victim.write_bytes(data[:-1] + bytes([data[-1] ^ 1]))
    assert f"file:nodes/{victim.name}" in pack.review(spark, folder)["failed"]
    victim.write_bytes(data)
    (tmp_path / "pack/nodes/extra.txt").write_text("x")
    assert {"file:nodes/extra.txt", "count:nodes"} <= set(pack.review(spark, folder)["failed"])
    (tmp_path / "pack/nodes/extra.txt").unlink()
    assert pack.review(spark, folder)["ok"]
    (tmp_path / "pack/.pack.json.crc").unlink()
    (tmp_path / "pack/pack.json").write_text("{}")
    with pytest.raises(GraphError, match="GRAPH_PACK_MANIFEST_INVALID"):
        pack.inspect(spark, folder)
    (tmp_path / "pack/pack.json").write_text('{"pack_version": "0", "counts": {}}')
    with pytest.raises(GraphError, match="GRAPH_PACK_SCHEMA_UNSUPPORTED"):
        pack.inspect(spark, folder)
    for bad, code in (([], "BUNDLE_REQUIRED"), ([{}], "REF_REQUIRED"), ([{"ref_uri": "a"}], "NODE_REQUIRED"), ([{"ref_uri": "a", "node_id": "b"}], "SNAPSHOT_REQUIRED"), ([{"ref_uri": "a", "node_id": "b", "snapshot_id": "c", "freshness_state": "new"}], "BAD_FRESHNESS")):
        with pytest.raises(GraphError, match=code):
            evidence.require(bad)
    with pytest.raises(GraphError, match="BAD_QUERY_KIND"):
        evidence.collect(s, "x", "other")
    assert {r["state"]: r["n"] for r in evidence.state_counts(refs).collect()} == {"fresh": refs.count(), "stale": 0, "changed": 0, "missing": 0}


# --- precise indexes: a writer of the wire format, for tests ---


def varint(n):
    out = b""
    while True:
        n, low = n >> 7, n & 127
        out += bytes([low | 128 * (n > 0)])
        if not n:
            return out


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def occurrence(symbol, place, roles=0, typed=False):
    at = field(8, field(1, place[0]) + field(2, place[1]) + field(3, place[2])) if typed else field(1, b"".join(map(varint, place)))
    return field(2, at + field(2, symbol) + (field(3, roles) if roles else b""))


A, B, C = "s npm pkg 1 A#", "s npm pkg 1 B#", "s npm other 2 C#"


def index():
    one = field(1, "a.ts") + field(4, "typescript") + occurrence(A, (4, 1, 6), 1) + occurrence(B, (9, 0, 3)) + field(3, field(1, A) + field(5, 7) + field(6, "Alpha") + field(3, "words") + field(4, field(1, B) + field(3, 1)))
    two = field(1, "b.ts") + occurrence(B, (0, 2, 1, 5), 1) + occurrence(A, (2, 0, 4), 1) + occurrence(C, (7, 0, 2), typed=True) + field(2, field(2, A)) + field(99, "what")
    return field(1, field(2, field(1, "tool") + field(2, "9")) + field(3, "file:///here")) + field(2, one) + field(2, two) + field(3, field(1, C) + field(6, "Gamma"))


def test_precise_index(spark, tmp_path):
    (tmp_path / "index.scip").write_bytes(index())
    snap, told = scip.load(spark, f"file://{tmp_path}/index.scip", root="file:///here")
    assert (told["producer"], told["freshness"]) == ("tool 9", "match") and told["loss"] == {"malformed": 1, "unknown": 1, "text": 1, "duplicate_definition": 1}
    nodes = {r["label"]: r for r in snap.nodes.collect()}
    assert nodes["Alpha"]["kind"] == "scip_class" and (nodes["Alpha"]["path"], nodes["Alpha"]["line"], nodes["Alpha"]["col"]) == ("a.ts", 5, 2)
    assert (nodes[B]["line"], nodes[B]["end_line"], nodes[B]["end_col"]) == (1, 2, 6) and json.loads(nodes["Gamma"]["metadata"])["scip_external"] is True
    edges = {(r["kind"], r["source_id"], r["target_id"]) for r in snap.edges.collect()}
    assert edges == {("defines", "file:a.ts", f"scip:{A}"), ("defines", "file:b.ts", f"scip:{B}"), ("mentions", "file:a.ts", f"scip:{B}"), ("mentions", "file:b.ts", f"scip:{C}"), ("related", f"scip:{A}", f"scip:{B}")}
    assert {r["reason"] for r in snap.omitted.collect()} == {"malformed_scip_facts", "unsupported_scip_fields"}
    back = json.loads(scip.to_index_json(snap))["documents"]
    assert [x["relative_path"] for x in back] == ["a.ts", "b.ts"] and back[0]["occurrences"][0]["range"][0] == 4
    with pytest.raises(GraphError, match="SCIP_FRESHNESS_MISMATCH"):
        scip.load(spark, f"file://{tmp_path}/index.scip", root="elsewhere", strict=True)
    with pytest.raises(GraphError, match="SCIP_INPUT_NOT_FOUND"):
        scip.load(spark, f"file://{tmp_path}/none.scip")
    for cut in (b"\x0a", b"\x0a\x05ab", b"\xff" * 12, b"\x07"):
        with pytest.raises(GraphError, match="SCIP_PAYLOAD_INVALID"):
            list(scip.fields(cut))


def test_registry(spark, tmp_path):
    class Upper:
        name, version, suffixes = "upper", "3", (".up",)

        def parse(self, f, path, text):
            f.edge(f.file, "defines", f.node("shout", path, text.strip().upper(), 1))

    own = registry.default().with_parsers([Upper()])
    (tmp_path / "a.up").write_text("hello")
    (tmp_path / "b.ts").write_text("export class X {}\n")
    snap = files.index_path(spark, str(tmp_path), registry=own)
    assert {r["label"] for r in snap.nodes.where("kind = 'shout'").collect()} == {"HELLO"}
    assert snap.omitted.where("reason = 'optional_parser_unavailable'").select("item_id").first()[0] == "b.ts"
    assert own.select("x.up").parser.name == "upper" and own.select("x.none").parser is None
    assert registry.support(spark, own).where("family = 'upper'").first()["version"] == "3"


def test_terraform_and_other_artifacts():
    f = parsers.Facts("main.tf", "n")
    parsers.artifact(f, "main.tf", 'resource "aws_x" "y" {\n}\nprovider "z" {\n# data "no"\nmodule "m" {}\n')
    assert [(r["kind"], r["label"], r["line"]) for r in f.rows if r["row"] == "node"] == [("terraform_resource", "resource.aws_x.y", 1), ("terraform_provider", "provider.z", 3), ("terraform_module", "module.m", 5)]


def test_mcp(spark, tmp_path):
    s = small(spark)
    server = mcp.Server(Service(s), refresh=lambda: Service(small(spark, n=10)))
    ask = lambda method, **p: server.handle({"jsonrpc": "2.0", "id": 7, "method": method, "params": p})
    assert {t["name"] for t in ask("tools/list")["result"]["tools"]} == {t.name for t in mcp.TOOLS} and len(mcp.TOOLS) == 11
    got = ask("tools/call", name="graph_query", arguments={"query": "river", "max_results": 3})["result"]
    assert not got["isError"] and len(json.loads(got["content"][0]["text"])["hits"]) == 3
    assert ask("tools/call", name="graph_neighborhood", arguments={"node_id": "none"})["result"]["isError"]
    for name, arguments, code in (("graph_query", {}, "invalid_params"), ("graph_query", {"query": "x", "max_results": True}, "invalid_params"), ("graph_query", {"query": "x", "other": 1}, "invalid_params"), ("summarize", {}, "unsupported_tool"), ("nope", {}, "unknown_tool")):
        assert ask("tools/call", name=name, arguments=arguments)["error"]["data"]["code"] == code
    assert server.handle({"jsonrpc": "2.0", "method": "ping"}) is None and server.handle([])["error"]["code"] == mcp.REQUEST
    for uri, _, _ in mcp.RESOURCES:
        assert json.loads(ask("resources/read", uri=uri)["result"]["contents"][0]["text"])
    assert ask("resources/read", uri="graph://else")["error"]["data"]["code"] == "unknown_resource"
    assert mcp.smoke(server)["ok"]
    assert not ask("tools/call", name="graph_refresh", arguments={})["result"]["isError"] and server.service.snapshot.nodes.count() == 10
    out = io.StringIO()
    server.serve(io.StringIO('{"jsonrpc":"2.0","id":1,"method":"ping"}\nnot json\n\n'), out)
    assert [json.loads(x).get("error", {}).get("code") for x in out.getvalue().splitlines()] == [None, mcp.PARSE]


def test_reports(spark):
    s = viewer.demo(spark)
    for make in (report.report_md, report.topology_md, report.repo_map_md, report.doc_graph_md, report.certification_md):
        assert make(s).startswith("# ")
    found = report.investigation(s, "app")
    assert found["matches"] and found["next_commands"] and "## Matches" in report.investigation_md(found)
    assert report.canonical(s)["bytes"] == len(to_json(s).encode())
    empty = bundle(s.nodes.limit(0), s.edges.limit(0))
    assert report.topology_summary(empty.nodes, empty.edges).first()["component_count"] == 0 and report.repo_map(empty.nodes, empty.edges, empty.omitted).isEmpty()


def test_command_line(spark, tmp_path):
    s = viewer.demo(spark)
    (tmp_path / "s.json").write_text(to_json(s))
    from loomgraph import __main__ as cli

    assert len(cli.COMMANDS) > 70
    ran = lambda *a: cli.COMMANDS[a[0]][1](spark, __import__("argparse").Namespace(max_results=5, namespace="n", backend="parquet", history=False, **dict(zip((o.rstrip("+") for o in cli.COMMANDS[a[0]][0]), a[1:]))))
    js, st = str(tmp_path / "s.json"), f"file://{tmp_path}/st"
    assert ran("store-import", js, st)["node_count"] == 7 and ran("store-query", st, "app")["hits"][0]["id"] and ran("store-explain", st, "app")["nodes"] == 7
    assert ran("store-health", st)["ok"] and ran("store-delta", js, st)["rows_written"] == 0 and ran("store-path", st, "p", "c") == ["p|contains|f1", "f1|defines|c"]
    assert "# Topology" in ran("topology-md", js) and ran("ci-delta", js, js)["exit_code"] == 0 and ran("query-plan", js, "app")[0]["strategy"] == "lexical_structural"
    assert ran("git-commits-for-path", js, "src/app.py")[0]["id"] == "g" and ran("certify-json", js)["node_count"] == 7
    with pytest.raises(GraphError, match="git_commit_not_found"):
        ran("git-files-for-commit", js, "nothing")
    (tmp_path / "e.json").write_text(ran("viewer-envelope", js))
    assert ran("viewer-path", str(tmp_path / "e.json"), "p", "c")["found"] and ran("query", js, "app")["result"]["hits"]
    assert ran("graph-pack-write", js, f"file://{tmp_path}/pk")["counts"]["nodes"] == 7 and all(r["ok"] for r in ran("graph-pack-verify", f"file://{tmp_path}/pk"))
    done = subprocess.run([sys.executable, "-m", "loomgraph", "--help"], capture_output=True, text=True, cwd=ROOT)
    assert done.returncode == 0 and "viewer-patch" in done.stdout


def test_snapshots_need_no_local_disk_calls(spark, tmp_path):
    folder = f"file://{tmp_path}/deep/er"
    save(small(spark), folder)
    from loomgraph.snapshot import load

    assert load(spark, folder).nodes.count() == 40
