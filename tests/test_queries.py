"""Every query against its SQL on the smallest tables."""

import collections

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return c


def rows(df, cols):
    return sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(entry.tabular_queries.SQL))
def test_query(spark, con, name):
    ours, theirs = entry.queries()[name](spark, DIR).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    cols = sorted(theirs.columns)
    assert sorted(ours.columns) == cols
    assert rows(ours, cols) == rows(theirs, cols)


def test_graph_components_of_the_whole_graph(spark, con):
    from loomgraph.plans.tabular_queries import E, N

    nodes = {r[0] for r in con.sql(f"with {N} select id from nodes").fetchall()}
    edges = con.sql(f"with {E} select source_id, target_id from edges").fetchall()
    root = {x: x for x in nodes.union(*edges)}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    size, inner = collections.Counter(map(find, root)), collections.Counter(find(a) for a, _ in edges)
    real = {find(x) for x in nodes}
    got = {tuple(r) for r in entry.queries()["graph_components"](spark, DIR).collect()}
    assert got == {(c, size[c], inner[c]) for c in real}


def test_graph_components_with_dangling_ends(spark):
    from loomgraph.operators import traverse

    nodes = spark.createDataFrame([(x,) for x in "abcdez"], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "x"), ("d", "x"), ("e", "e"), ("p", "q")], "source_id string, target_id string")
    got = {tuple(r) for r in traverse.graph_components(nodes, edges).collect()}
    assert got == {("a", 2, 2), ("c", 3, 2), ("e", 1, 1), ("z", 1, 0)}


def test_queries_read_whole_tables(spark, con):
    got = {tuple(r) for r in entry.queries()["report_dependencies"](spark, DIR).select("source_key", "target_key").collect()}
    assert got == set(con.sql("select distinct l_orderkey, l_partkey from lineitem where l_orderkey in (select o_orderkey from orders) and l_partkey in (select p_partkey from part)").fetchall())
    assert entry.queries()["dependency_resolution"](spark, DIR).count() == con.sql("select count(*) from (select distinct l_orderkey, l_partkey from lineitem)").fetchall()[0][0]


#: Queries that once stood for an operator without calling it, and what each must call.
CALLS = {"scope_filter": "sources.files.scoped", "manifest_scan": "sources.files.manifest_of", "scale_chain": "viewer.chain", "incident_edges": "operators.search.incident", "resolution_outcomes": "operators.resolve.symbol_outcomes", "evidence_state": "evidence.verify", "components": "operators.traverse.components"}


@pytest.mark.parametrize("name", sorted(CALLS))
def test_queries_call_their_operator(spark, monkeypatch, name):
    class Called(Exception):
        pass

    def stand_in(*a, **k):
        raise Called

    monkeypatch.setattr(f"loomgraph.{CALLS[name]}", stand_in)
    with pytest.raises(Called):
        entry.queries()[name](spark, DIR)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
