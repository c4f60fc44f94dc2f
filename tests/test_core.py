"""Operators on small graphs, against plain Python and by relations that must hold."""

import json
import os
import random
import subprocess
from collections import deque
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomgraph import functions as fn
from loomgraph import snapshot as snaps
from loomgraph.operators import diff, navigate, resolve, search, traverse, views
from loomgraph.schema import GraphError
from loomgraph.service import Service
from loomgraph.sources import exports, files, git, interchange
from loomgraph.streaming import activity, follow


def graph(spark, n=60, m=90, seed=3):
    r = random.Random(seed)
    ids = [f"n{i:02d}" for i in range(n)]
    edges = sorted({(r.choice(ids), r.choice(ids)) for _ in range(m)})
    nodes = [(i, "even" if int(i[1:]) % 2 == 0 else "odd", f"Label {i}", f"src/{i}.py", "", "some text " * (int(i[1:]) % 3), "{}") for i in ids]
    df = spark.createDataFrame(nodes, "id string, kind string, label string, path string, section string, text string, metadata string")
    return df, spark.createDataFrame([(f"e{k:03d}", "links", a, b, "{}") for k, (a, b) in enumerate(edges)], "id string, kind string, source_id string, target_id string, metadata string"), edges


def bfs(edges, start, depth):
    seen, order, queue = {start}, [], deque([(start, 0)])
    while queue:
        at, d = queue.popleft()
        if d >= depth:
            continue
        for k, (a, b) in enumerate(edges):
            if at in (a, b):
                other = b if a == at else a
                if other not in seen:
                    seen.add(other)
                    order.append(other)
                    queue.append((other, d + 1))
    return order


@pytest.mark.parametrize("start", ["n00", "n07", "n33"])
def test_neighborhood_order(spark, start):
    nodes, edges, pairs = graph(spark)
    got = [r["id"] for r in traverse.neighborhood(nodes, edges, start, depth=3, max_results=100).orderBy("place").collect()]
    assert got == bfs(pairs, start, 3)


def test_path_is_shortest(spark):
    nodes, edges, pairs = graph(spark)
    for target in ("n01", "n40"):
        hops = next((d for d in range(5) if target in bfs(pairs, "n07", d)), None)
        way = traverse.path(edges, "n07", target, max_hops=4)
        assert (None if way is None else len(way)) == hops
    assert traverse.path(edges, "n07", "n07") == []
    assert [r["id"] for r in traverse.path_nodes(nodes, edges, "n07", []).collect()] == ["n07"]


def test_components(spark):
    nodes, edges, pairs = graph(spark, m=40)
    root = {f"n{i:02d}": f"n{i:02d}" for i in range(60)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {}
    for x in root:
        want[find(x)] = want.get(find(x), 0) + 1
    assert {r["component_id"]: r["node_count"] for r in traverse.graph_components(nodes, edges).collect()} == want


def test_search_pages_and_cursors(spark):
    nodes, edges, _ = graph(spark)
    full = [r["id"] for r in search.page(search.scored(nodes, "label n1"), 0, 100).collect()]
    got, cursor = [], ""
    while True:
        r = search.search(nodes, search.Request("label n1", max_results=7, cursor=cursor), edges)
        got += [x["id"] for x in r.hits.orderBy(*search.order()).collect()]
        if not (cursor := r.next_cursor):
            break
    assert got == full and len(full) == 60
    first = search.search(nodes, search.Request("label", max_results=5)).next_cursor
    with pytest.raises(GraphError, match="QUERY_CURSOR_MISMATCH"):
        search.search(nodes, search.Request("other", max_results=5, cursor=first))
    with pytest.raises(GraphError, match="INVALID_QUERY_CURSOR"):
        search.search(nodes, search.Request("label", cursor="%%%"))
    over = search.search(nodes, search.Request("label", max_examined=10))
    assert over.omitted[0]["reason"] == "work_budget_exhausted" and over.hits.isEmpty()
    assert search.search(nodes, "").hits.isEmpty()
    assert search.scored(nodes, "", ("n05",)).first()["score"] == 1000.0


def test_scores_add_up(spark):
    nodes, _, _ = graph(spark)
    r = search.scored(nodes, "Label n05").where("id = 'n05'").first()
    assert r["score"] == 500 + 50 + 20 and r["exact_match"] == "label" and r["matched_tokens"] == ["label", "n05"]
    assert search.match_summary(search.scored(nodes, "n05")).where("id = 'n05'").first()["summary"][0] == "exact:id"


def test_diff_of_equal_graphs_is_empty(spark):
    nodes, edges, _ = graph(spark)
    a = snaps.bundle(nodes, edges)
    assert diff.ci_delta(a, a).isEmpty() and diff.snapshot_patch(a, a).isEmpty()
    b = a.with_(nodes=a.nodes.where("id <> 'n00'").withColumn("label", F.when(F.col("id") == "n01", "x").otherwise(F.col("label"))))
    assert {(r["status"], r["item_id"]) for r in diff.ci_delta(a, b).collect()} == {("removed", "n00"), ("changed", "n01")}
    assert diff.header_changes({"a": 1, "b": 2}, {"a": 1, "b": 3}) == ["b"]
    with pytest.raises(GraphError, match="DUPLICATE_NODE_ID"):
        diff.disjoint_union([nodes, nodes], "NODE")


def test_json_and_store_round_trips(spark, tmp_path):
    nodes, edges, _ = graph(spark)
    a = snaps.bundle(nodes, edges, namespace="t")
    text = snaps.to_json(a)
    assert snaps.to_json(snaps.from_json(spark, text)) == text
    snaps.save(a, str(tmp_path))
    with pytest.raises(RuntimeError):
        snaps.save(a.with_(nodes=a.nodes.limit(0)), str(tmp_path), fail_after="edges")
    assert snaps.to_json(snaps.load(spark, str(tmp_path))) == text
    with pytest.raises(GraphError, match="UNSUPPORTED_SCHEMA_VERSION"):
        snaps.from_json(spark, '{"schema_version": "other"}')
    with pytest.raises(GraphError, match="STORE_SNAPSHOT_NOT_FOUND"):
        snaps.load(spark, str(tmp_path / "none"))


def test_exports(spark):
    nodes, edges, _ = graph(spark)
    a = snaps.bundle(nodes, edges.unionByName(spark.createDataFrame([("ex", "links", "n00", "gone", "{}")], edges.schema)))
    assert exports.dot(a).count("->") == edges.count()
    assert exports.mermaid(a).splitlines()[1] == '  n0["Label n00"]'
    back = interchange.from_graph_json(spark, exports.export(a, "graph_json"))
    assert back.nodes.count() == 60


def test_redaction(spark):
    n = spark.createDataFrame([("a", "git_commit", "s", "/abs/x.py", "", "body", '{"author_email":"me@x","author_name":"Me","k":"v"}')], "id string, kind string, label string, path string, section string, text string, metadata string")
    e = spark.createDataFrame([], "id string, kind string, source_id string, target_id string")
    a = snaps.bundle(n, e, root_path="/home/me", git_repo_root="/home/me")
    out = resolve.redacted(a, "portable")
    r = out.nodes.first()
    assert (r["text"], r["path"], json.loads(r["metadata"])) == ("", "x.py", {"k": "v"}) and "git_repo_root" not in out.header
    assert resolve.redacted_fields(a, "portable") == ["author_email", "author_name", "text"]
    assert views.privacy_profile(a.nodes, a.edges).first()["export_safe"] is False


def test_outcomes(spark):
    d = spark.createDataFrame([("p", "d1", "s1", "f1"), ("q", "d2", "s2", "f2"), ("p", "d3", "s2", "f2"), ("c", "d4", "s4", "f4"), ("p", "d5", "s5v2", "f5")], "root string, node_id string, symbol string, family string")
    u = spark.createDataFrame([("c", "u1", "s1", "f1", True), ("c", "u2", "s2", "f2", True), ("c", "u4", "s4", "f4", True), ("c", "u5", "s5v1", "f5", True), ("c", "u6", "s6", "f6", True), ("c", "u7", "s1", "f1", False)], "root string, node_id string, symbol string, family string, valid boolean")
    got = {r["node_id"]: (r["outcome"], r["target_id"]) for r in resolve.symbol_outcomes(u, d).collect()}
    assert got == {"u1": ("exact", "d1"), "u2": ("ambiguous", None), "u4": ("same_root", None), "u5": ("version_mismatch", None), "u6": ("missing", None), "u7": ("invalid", None)}
    assert resolve.outcome_counts(resolve.symbol_outcomes(u, d)).count() == 6


def write(root: Path, **parts: str) -> None:
    for name, text in parts.items():
        p = root / name.replace("__", "/").replace("_dot_", ".")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "repo"
    write(root, README_dot_md="# Top\nsee [guide](docs/guide.md) and [here](#part)\n## Part\n", docs__guide_dot_md="# Guide\n[gone](missing.md)\n[bad](#nope)\n", src__helper_dot_py="def help():\n    return 1\n")
    write(root, src__app_dot_py='import helper\nimport os.path\nclass Base:\n    pass\nclass App(Base):\n    """Doc."""\n    def run(self):\n        return go()\ndef go():\n    return 2\n', package_dot_json='{"dependencies": {"left": "1"}}', web__a_dot_ts="import {x} from './b'\nexport class A {}\n", web__b_dot_ts="export const x = () => 1\n")
    write(root, bad_dot_py="def (:\n", schema_dot_sql="create table a (id int);\ncreate table b (x int references a);\n", requirements_dot_txt="numpy>=1\n# no\n")
    (root / ".gitignore").write_text("*.log\n")
    (root / "x.log").write_text("x")
    (root / "bin.dat").write_bytes(b"a\0b")
    return root


def test_index(spark, tree):
    s = files.index_path(spark, str(tree), "t")
    kinds = {r["kind"]: r["n"] for r in views.counts(s.nodes).collect()}
    assert kinds["python_class"] == 2 and kinds["python_method"] == 1 and kinds["sql_table"] == 2 and kinds["script_class"] == 1
    reasons = {r["reason"]: r["n"] for r in views.counts(s.omitted, "reason").collect()}
    assert reasons["gitignored"] == 1 and reasons["binary_file"] == 1 and reasons["python_syntax_error"] == 1
    assert reasons["unresolved_markdown_anchor"] == 1 and reasons["unresolved_markdown_reference"] == 2
    first = search.page(search.scored(s.nodes, "App"), 0, 1).first()
    assert (first["kind"], first["label"], first["path"]) == ("python_class", "App", "src/app.py")
    resolved = {(r["source_id"].rpartition("/")[2], r["target_id"].rpartition("/")[2]) for r in s.edges.where(fn.meta("metadata", "resolved") == "true").collect()}
    assert ("app.py#helper", "helper.py") in resolved and ("b", "b.ts") in resolved
    importers = navigate.reverse_imports(s.nodes, s.edges, "loom://t/python_module/src/helper.py")
    assert [r["label"] for r in importers.collect()] == ["app.py"]
    assert snaps.to_json(s) == snaps.to_json(files.index_path(spark, str(tree), "t"))


def test_refresh_parses_only_what_changed(spark, tree, tmp_path):
    state = tmp_path / "state"
    state.mkdir()
    whole, work = files.refresh(spark, str(tree), str(state), "t")
    assert work["parsed"] == whole.spark.read.parquet(str(state / (state / "CURRENT").read_text() / "manifest")).count()
    _, work = files.refresh(spark, str(tree), str(state), "t")
    assert work["parsed"] == 0
    (tree / "src" / "helper.py").write_text("def other():\n    return 1\n")
    (tree / "bad.py").unlink()
    got, work = files.refresh(spark, str(tree), str(state), "t")
    assert (work["parsed"], work["removed"]) == (1, 1)
    a, b = got, files.index_path(spark, str(tree), "t")
    assert diff.ci_delta(a, b).isEmpty()


def test_git(spark, tree):
    def run(*a, at="2024-01-01T00:00:00Z"):
        dates = {"GIT_AUTHOR_DATE": at, "GIT_COMMITTER_DATE": at}
        subprocess.run(["git", "-C", str(tree), "-c", "user.name=A", "-c", "user.email=A@x.org", *a], check=True, capture_output=True, env=os.environ | dates)

    run("init", "-q")
    run("add", "-A")
    run("commit", "-qm", "one")
    run("mv", "src/helper.py", "src/util.py")
    run("commit", "-qm", "two", at="2024-01-02T00:00:00Z")
    text, why = git.log(str(tree))
    assert not why
    rows = git.commits(spark, text).cache()
    assert {r["change_kind"] for r in git.changes(rows).where("path = 'src/util.py'").collect()} == {"renamed"}
    s = files.index_path(spark, str(tree), "t")
    nodes, edges = git.overlay(rows, s.nodes)
    all_nodes = s.nodes.select("id", "kind", "label", "path", "metadata").unionByName(nodes)
    got = navigate.commits_for_path(all_nodes, edges, "src/util.py").collect()
    assert [r["label"] for r in got] == ["two"] and "A@x.org" not in got[0]["metadata"]
    assert edges.where("kind = 'git_parent'").count() == 1
    commit = navigate.find_commit(all_nodes, got[0]["id"])
    assert {r["place"] for r in navigate.files_for_commit(all_nodes, edges, commit).collect()} == {"src/util.py"}
    lineage = navigate.rename_lineage(git.changes(rows).withColumn("commit_id", F.col("commit_hash")), "src/util.py")
    assert [x[0] for x in lineage] == ["src/util.py", "src/helper.py"]


def test_service(spark, tree):
    s = Service(files.index_path(spark, str(tree), "t"))
    assert s.handle({"id": 1, "method": "query", "params": {"query": "App", "max_results": 1}})["result"]["hits"][0]["label"] == "App"
    assert s.handle({"id": 2, "method": "query", "params": {"max_results": True}})["error"]["code"] == "invalid_params"
    assert s.handle({"id": 3, "method": "nope"})["error"]["code"] == "unknown_method"
    assert s.handle({"id": 4, "method": "neighborhood", "params": {"node_id": "x"}})["error"]["code"] == "not_found"
    assert s.handle([])["error"]["code"] == "invalid_request"
    assert s.handle({"id": 5, "method": "report"})["result"]["orphans"] == []
    s.handle({"method": "shutdown"})
    assert not s.running


def test_functions(spark):
    df = spark.createDataFrame([("./a//b/../c", "Über x!", "src/pkg/__init__.py", "a/{x => y}/b.py", "num-py >= 1.2 ")], "p string, s string, m string, r string, q string")
    old, new = fn.rename_parts("r")
    name, limit = fn.requirement("q")
    r = df.select(fn.relative_path("p").alias("p"), fn.slug("s").alias("s"), fn.module_name("m").alias("m"), old.alias("o"), new.alias("n"), name.alias("name"), limit.alias("limit"), fn.quoted(F.lit("ü a/~*%")).alias("u")).first()
    assert tuple(r) == ("a/b/../c", "ber-x", "pkg", "a/x/b.py", "a/y/b.py", "num-py", ">= 1.2", "%C3%BC%20a/~%2A%25")


def test_symbols_and_facts(spark):
    df = spark.createDataFrame([("scip py pkg 1.0 `a`/b.",), ("local 3",), ("bad",), ("x . . . d",)], "s string")
    got = [r[0] for r in df.select(interchange.symbol_parts("s")).collect()]
    assert got[0]["version"] == "1.0" and got[1]["local"] == "3" and got[2] is None and got[3]["package"] == ""
    doc = json.dumps({"documents": [{"relative_path": "a.py", "occurrences": [{"range": [0, 4, 9], "symbol": "s1", "symbol_roles": 1}, {"range": [3, 0, 2], "symbol": "s1"}, {"range": [4, 0, 2], "symbol": "gone"}], "symbols": [{"symbol": "s1", "kind": "fn", "display_name": "f"}]}]})
    sym, ref = interchange.from_index_json(spark, spark.createDataFrame([(doc,)], "value string"))
    nodes, edges, lost = interchange.from_compiler_facts(sym, ref)
    assert nodes.count() == 2 and edges.count() == 2 and lost.first()["item_id"] == "gone"


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int").write.parquet(str(src))
    read = lambda: spark.readStream.schema("id string, v int").parquet(str(src))
    follow(read(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    spark.createDataFrame([("b", 2), ("c", 2)], "id string, v int").write.mode("append").parquet(str(src))
    follow(read(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    rev = (tmp_path / "out" / "CURRENT").read_text()
    assert {(r["id"], r["v"]) for r in spark.read.parquet(str(tmp_path / "out" / rev)).collect()} == {("a", 1), ("b", 2), ("c", 2)}
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert activity(ev).agg(F.sum("n")).first()[0] == ev.count()
