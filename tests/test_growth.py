"""That what a step costs doesn't grow faster than its input."""

import random
from itertools import count

from pyspark.sql import functions as F

from loomgraph.operators import navigate

_groups = count()


def jobs(spark, run):
    """(result, Spark jobs that it took)."""
    group = f"growth-{next(_groups)}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


CHANGES = "path string, previous_path string, epoch long, commit_id string"


def test_lineage_takes_few_jobs_however_many_renames(spark):
    rows = [(f"f{i // 3}", f"f{i // 3 - 1}" if i % 3 == 0 and i else "", i, str(i)) for i in range(600)]
    got, n = jobs(spark, lambda: navigate.rename_lineage(spark.createDataFrame(rows, CHANGES), "f199"))
    assert [(r[0], r[1]) for r in got] == [(r[0], r[2]) for r in reversed(rows)]
    assert n < 150


def test_lineage_walks_names_that_come_back(spark):
    rnd = random.Random(5)
    rows = [(p, rnd.choice(["", p, *"abcd"]), rnd.randrange(40), f"c{i}") for i, p in ((i, rnd.choice("abcd")) for i in range(150))]
    rows += [("a", "b", 3, "same"), ("b", "a", 3, "same"), ("a", "", 3, "same")]
    changes = spark.createDataFrame(rows, CHANGES)
    for start in (*"abcd", "none"):
        want, cursor, before = [], start, (float("-inf"), "")
        while True:
            own = sorted(r for r in ((-e, c, p, was) for p, was, e, c in rows) if r[2] == cursor and r[:2] > before)
            at = next((r for r in own if r[3] and r[3] != r[2]), None)
            want += [(p, -a, c, was) for a, c, p, was in own if at is None or (a, c) <= at[:2]]
            if at is None:
                break
            cursor, before = at[3], at[:2]
        got = navigate.rename_lineage(changes, start)
        assert sorted(got) == sorted(want) and [(-r[1], r[2]) for r in got] == sorted((-r[1], r[2]) for r in got)


def test_store_indexes_blocks(spark, tmp_path):
    from loomgraph import store
    from loomgraph.operators import search
    from loomgraph.snapshot import bundle

    # several blocks, of which one holds a word; texts with an accent, a letter beyond 16 bits, and none
    nodes = spark.range(20_000).select(F.format_string("n%05d", "id").alias("id"), F.lit("k").alias("kind"), F.when(F.col("id") == 9000, "Ähre 𝔘nique hammer").when(F.col("id") % 50 == 0, "").otherwise("common words here").alias("label"))
    edges = nodes.limit(0).select("id", "kind", F.col("id").alias("source_id"), F.col("id").alias("target_id"))
    st = store.ParquetStore(spark, f"file://{tmp_path}/s")
    st.import_snapshot(bundle(nodes, edges))
    index = st.table("grams")
    assert index.count() < 20_000 and index.count() == index.distinct().count()
    for text in ("hammer", "𝔘nique", "ähre", "common here", "n09000", "absent"):
        want = {r[0] for r in search.scored(nodes.withColumns({c: F.lit("") for c in ("path", "section", "text", "metadata")}), text).select("id").collect()}
        got = {r[0] for r in st.candidates(search.Request(text)).select("id").collect()}
        assert want <= got and {r["id"] for r in st.query(search.Request(text, max_results=20_000)).hits.collect()} == want
    assert st.explain("hammer").candidates == 1


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_deltas_are_one_aggregation(spark):
    from loomgraph.operators import diff
    from loomgraph.snapshot import bundle

    edges = spark.createDataFrame([], "id string, kind string, source_id string, target_id string")
    rows = lambda *r: bundle(spark.createDataFrame(list(r), "id string, kind string, label string, line int"), edges)
    old = rows(("same", "k", "x", 1), ("gone", "k", "x", 1), ("label", "k", "x", 1), ("null", "k", "x", None), ("twice", "k", "x", 1), ("twice", "k", "y", 1), ("moved", "k", "ab", 1))
    new = rows(("same", "k", "x", 1), ("come", "k", "x", 1), ("label", "k", "y", 1), ("null", "k", "x", 0), ("twice", "k", "x", 1), ("twice", "k", "y", 1), ("moved", "ka", "b", 1))
    got = diff.ci_delta(old, new)
    assert {(r["status"], r["item_id"]) for r in got.collect()} == {("removed", "gone"), ("added", "come"), ("changed", "label"), ("changed", "null"), ("changed", "twice"), ("changed", "moved")}
    assert got.count() == 6
    for df in (got, diff.structural(old, new)):
        assert "Join" not in plan(df) and plan(df).count("Aggregate") == 1


def test_scoring_cuts_no_text_into_tokens(spark):
    from loomgraph.operators import search

    rows = [("a", "red_fox fox"), ("b", "foxes"), ("c", "the Fox."), ("d", "x-fox-y"), ("e", "fo x")]
    hits = search.scored(spark.createDataFrame([(i, "k", t, "", "", "", "") for i, t in rows], "id string, kind string, label string, path string, section string, text string, metadata string"), "fox brown")
    assert {r["id"]: (r["score"], r["matched_tokens"]) for r in hits.collect()} == {i: (10.0, ["fox"]) for i in "acd"}
    assert "split(" not in plan(hits)


def test_components_contract_what_lies_together(spark):
    from loomgraph.operators import traverse

    # one long way, one star, loops and a pair, in an order that mixes them
    pairs = [(f"p{i:04d}", f"p{i + 1:04d}") for i in range(900)] + [("hub", f"s{i:03d}") for i in range(300)] + [("x", "y"), ("y", "x"), ("z", "z"), (None, "x")]
    random.Random(3).shuffle(pairs)
    edges = spark.createDataFrame(pairs, "a string, b string").coalesce(1)
    want = {f"p{i:04d}": "p0000" for i in range(901)} | {f"s{i:03d}": "hub" for i in range(300)} | {"hub": "hub", "x": "x", "y": "x"}
    assert {r["node"]: r["root"] for r in traverse.components(edges).collect()} == want
    for most in (1 << 20, 100):
        part = traverse.contracted(edges, most)
        assert part.where("u <= v").isEmpty() and {r["node"]: r["root"] for r in traverse.components(part.select(F.col("u").alias("a"), F.col("v").alias("b"))).collect()} == want
    assert {(r["u"], r["v"]) for r in traverse.contracted(edges).collect()} == {x for x in want.items() if x[0] != x[1]}


def test_topology_goes_over_the_edges_once_for_all_figures(spark):
    from loomgraph import report

    nodes = spark.createDataFrame([(x,) for x in "abcdez"], "id string")
    edges = spark.createDataFrame([("1", "a", "b"), ("2", "b", "a"), ("3", "c", "x"), ("4", "d", "x"), ("5", "e", "e"), ("6", "p", "q")], "id string, source_id string, target_id string")
    got = report.topology_summary(nodes, edges)
    assert got.first().asDict() == {"node_count": 6, "edge_count": 6, "component_count": 4, "isolated_count": 1, "largest_component": 3, "max_degree": 2}
    assert plan(got).count("Join") == 1


SMALLEST = "/root/testdata/sf0.001"


def test_dated_commits_need_no_join(spark):
    from loomgraph.plans import graph_queries

    n = graph_queries._mixed(spark, SMALLEST)
    assert "Join" not in plan(n)
    assert n.where("kind = 'git_commit' and metadata like '%\"commit_hash\":\"orders:%'").count() == spark.read.parquet(f"{SMALLEST}/orders.parquet").count()


def test_edges_without_ends_are_sought_once(spark):
    from loomgraph.operators import resolve

    nodes = lambda *ids: spark.createDataFrame([(i, "k") for i in ids], "id string, kind string")
    edges = lambda *rows: spark.createDataFrame(list(rows), "id string, source_id string, target_id string")
    n, e, lost = resolve.merged(nodes("a", "b"), edges(("1", "a", "b"), ("2", "a", "x"), ("3", "a", "c")), nodes("c"), edges(("3", "a", "a"), ("4", "y", "x")))
    assert {r["id"] for r in e.collect()} == {"1", "3"} and n.count() == 3
    assert {(r["reason"], r["item_id"]) for r in lost.collect()} == {("precise_merge_collision", "3"), ("precise_merge_referential_gap", "2"), ("precise_merge_referential_gap", "4")}
    assert "Generate" not in plan(e) and "Generate" not in plan(lost)


def test_edges_of_a_page_score_it_once(spark):
    from loomgraph.plans import tabular_queries

    p = plan(tabular_queries.search_with_edges(spark, SMALLEST))
    assert "split(" not in p and "rlike" not in p.lower()
