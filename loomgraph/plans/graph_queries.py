"""More queries over the driver's tables: stores, workspaces, reports, viewer, history, evidence and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import functions as fn
from .. import mcp, pack, refresh, registry, report, store, viewer, workspace
from ..operators import diff, navigate, resolve, search, traverse, views
from ..schema import GraphError
from ..session import shared_dir
from ..snapshot import bundle, from_json, load, save, to_json
from ..sources import exports, git, interchange, scip
from . import tabular
from .tabular import table
from .tabular_queries import FIND, D, E, LINKS, N, WHOLE, BOTH, _orders_before_after, query, scoring


def _key(c):
    return F.substring_index(c, ":", -1).cast("long")


def _text(c):
    return F.col(c).cast("string")


def _place(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- search: summaries, pages by cursor, budgets ---


@query(f"""with {N}, {scoring('automobile customer')} select id, array_to_string(list_sort(list_concat(
  case when contains(h, '{FIND}') then ['field:haystack'] else [] end, case when len(hit) > 0 then ['field:tokens'] else [] end, list_transform(hit, lambda t: 'token:' || t))), ' ') as summary from hits where score > 0""")
def search_summary(spark, d):
    return search.match_summary(search.scored(tabular.nodes(spark, d), FIND)).select("id", F.array_join(F.array_sort("summary"), " ").alias("summary"))


@query(f"with {N}, {scoring(FIND)}, r as (select *, row_number() over (order by score desc, kind, path, id) as n from hits where score > 0) select ((n - 1) // 40)::int as page, id, score from r where n <= 120")
def search_cursor_walk(spark, d):
    nodes, cursor, out = tabular.nodes(spark, d), "", None
    for page in range(3):
        got = search.search(nodes, search.Request(FIND, max_results=40, cursor=cursor))
        rows = got.hits.select(F.lit(page).alias("page"), "id", "score")
        out, cursor = rows if out is None else out.unionByName(rows), got.next_cursor
        if not cursor:
            break
    return out


@query(f"""with {N}, {scoring(FIND)}, c as (select count(*) as all_, count(*) filter (score > 0) as found from hits)
select 'work_budget_exhausted' as reason, all_ as n from c union all select 'max_results', found - 10 from c where found > 10""")
def search_omissions(spark, d):
    nodes = tabular.nodes(spark, d)
    over = search.search(nodes, search.Request(FIND, max_examined=5)).omitted[0]
    cut_ = search.search(nodes, search.Request(FIND, max_results=10)).omitted
    rows = [(over["reason"], over["details"]["candidates"])] + [(o["reason"], o["details"]["omitted"]) for o in cut_]
    return spark.createDataFrame(rows, "reason string, n long")


@query(f"with {N}, {scoring(FIND)}, c as (select count(*) as n from hits where score > 0) select 'lexical_structural' as strategy, n as candidate_count, least(25, n) as returned_count, n - least(25, n) as omitted_count, n <= 25 as complete from c")
def query_plan(spark, d):
    return store.query_plan(tabular.nodes(spark, d), search.Request(FIND, max_results=25))


# --- stores ---


_STORES: dict[tuple[str, str], str] = {}


def _store(spark, d):
    """The tables' store, built once a session."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _STORES:
        folder = _place(spark, "store")
        store.ParquetStore(spark, folder).import_snapshot(bundle(tabular.nodes(spark, d), tabular.edges(spark, d), namespace="tables"))
        _STORES[at] = folder
    return store.ParquetStore(spark, _STORES[at])


@query(f"with {N}, {scoring(FIND)} select id, kind, score from hits where score > 0 order by score desc, kind, path, id limit 60")
def store_query(spark, d):
    return _store(spark, d).query(search.Request(FIND, max_results=60, include_edges=False)).hits.select("id", "kind", "score")


@query(f"""with {N}, {scoring('nation:7')}, top as (select id, score from hits where score > 0 order by score desc, kind, path, id limit 10), {E}
select top.id, score, coalesce((select string_agg(e.id, ',' order by e.id) from edges e where e.source_id = top.id or e.target_id = top.id), '') as edge_ids from top""".replace("['nation:7']", "['7', 'nation']"))
def store_query_with_edges(spark, d):
    """A token of one character: the whole store is scanned."""
    return _store(spark, d).query("nation:7").hits.select("id", "score", F.array_join("edge_ids", ",").alias("edge_ids"))


def _grams(phrase):
    return " and ".join(f"contains(h, '{g}')" for g in dict.fromkeys(phrase[i : i + 3] for i in range(len(phrase) - 2)))


@query(f"with {N}, {scoring(FIND)} select id from hits where ({_grams(FIND)}) or ({_grams('automobile')}) or ({_grams('customer')})")
def store_candidates(spark, d):
    return _store(spark, d).candidates(search.Request(FIND)).select("id")


@query(f"with {N}, {scoring('hammer')} select 'indexed_trigram' as strategy, count(*) filter ({_grams('hammer')}) as candidates, count(*) as nodes from hits")
def store_explain(spark, d):
    x = _store(spark, d).explain("hammer")
    return spark.createDataFrame([(x.strategy, x.candidates, x.nodes)], "strategy string, candidates long, nodes long")


@query(f"with {N}, {E}, c as (select (select count(*) from nodes) as n, (select count(*) from edges) as e) select 'tables' as namespace, n as node_count, e as edge_count, n + e as source_ref_count from c")
def store_manifest(spark, d):
    m = _store(spark, d).manifest()
    return spark.createDataFrame([(m["namespace"], m["node_count"], m["edge_count"], m["source_ref_count"])], "namespace string, node_count long, edge_count long, source_ref_count long")


@query(f"with {BOTH} select 'node' as what, node as id, case when k % 11 = 0 then 'renamed' else 'order:' || k end as label from o where k % 5 <> 0 union all select 'edge', edge, case when k % 13 = 0 then 'moved' else '' end from o where k % 4 <> 0")
def store_delta(spark, d):
    old, new = _orders_before_after(spark, d)
    s = store.ParquetStore(spark, _place(spark, "store"))
    s.import_snapshot(old)
    s.apply_delta(new)
    n, e = s.table("nodes"), s.table("edges")
    return n.select(F.lit("node").alias("what"), "id", "label").unionByName(e.select(F.lit("edge").alias("what"), "id", F.when(fn.meta("metadata", "moved") == "true", "moved").otherwise("").alias("label")))


@query(f"with {BOTH}, u as (select * from structure union all select * from changes) select count(*) filter (status = 'added') as added, count(*) filter (status = 'changed') as changed, count(*) filter (status = 'removed') as removed, count(*) filter (status <> 'removed') as rows_written from u where item_kind <> 'omitted'")
def store_delta_counts(spark, d):
    old, new = _orders_before_after(spark, d)
    s = store.ParquetStore(spark, _place(spark, "store"))
    s.import_snapshot(old)
    u = s.apply_delta(new)
    return spark.createDataFrame([(u.added, u.changed, u.removed, u.rows_written)], "added long, changed long, removed long, rows_written long")


@query(f"with {BOTH} select item_kind, status, item_id as id from structure where item_kind = 'node' union all select * from changes where item_kind = 'node'")
def store_row_changes(spark, d):
    old, new = _orders_before_after(spark, d)
    return store.delta(old.nodes, new.nodes).select(F.lit("node").alias("item_kind"), "status", "id")


@query(f"with {N} select 'full_scan' as before, 'indexed_trigram' as after, 'STORE_MIGRATION_REQUIRED' as refused, (select count(*) from nodes where kind = 'nation') as nodes")
def store_migration(spark, d):
    s = store.ParquetStore(spark, _place(spark, "store"))
    snap = bundle(tabular.nodes(spark, d, "nation"), tabular.edges(spark, d, "nation"))
    s.import_snapshot(snap, layout=1)
    before = s.explain("nation").strategy
    try:
        s.apply_delta(snap)
        refused = ""
    except GraphError as e:
        refused = e.code
    n = s.migrate()["node_count"]
    return spark.createDataFrame([(before, s.explain("nation").strategy, refused, n)], "before string, after string, refused string, nodes long")


@query(f"with {E}, {N}, r as (select n.id, row_number() over (order by e.id) as n from edges e join nodes n on n.id = e.target_id where e.source_id = 'nation:4') select id, n::int as place from r where n <= 30 union all select 'region:' || n_regionkey, 0 from nation where 1 = 0")
def store_neighborhood(spark, d):
    s = _store(spark, d)
    return s.neighborhood("nation:4", max_results=30, edge_kinds=("contains",), node_kinds=("customer", "supplier")).select("id", "place")


@query("select 'parquet' as backend, true as equal union all select 'json', true")
def store_round_trip(spark, d):
    s = bundle(tabular.nodes(spark, d, "region", "nation", "supplier"), tabular.edges(spark, d, "nation", "supplier"), namespace="t", created_at="now")
    rows = [store.round_trip(s, x) for x in (store.ParquetStore(spark, _place(spark, "store")), store.JsonStore(spark, _place(spark, "store") + ".json"))]
    return spark.createDataFrame([(r["backend"], r["equal"]) for r in rows], "backend string, equal boolean")


@query("select * from (values ('json', 'available'), ('parquet', 'available'), ('duckdb', 'reserved'), ('kuzu', 'reserved'), ('vector_sidecar', 'boundary')) t(backend, status)")
def store_catalog(spark, d):
    return store.catalog(spark).select("backend", "status")


@query(f"with {N}, {E} select 'node' as what, id, label as value from nodes where kind in ('region', 'nation', 'supplier') union all select 'edge', id, kind from edges where target_id like 'nation:%' or target_id like 'supplier:%'")
def snapshot_json(spark, d):
    s = from_json(spark, to_json(bundle(tabular.nodes(spark, d, "region", "nation", "supplier"), tabular.edges(spark, d, "nation", "supplier"))))
    return s.nodes.select(F.lit("node").alias("what"), "id", F.col("label").alias("value")).unionByName(s.edges.select(F.lit("edge").alias("what"), "id", F.col("kind").alias("value")))


@query(f"with {N} select id, kind, label, path from nodes")
def snapshot_saved(spark, d):
    folder = _place(spark, "snapshot")
    save(bundle(tabular.nodes(spark, d), tabular.edges(spark, d)), folder)
    return load(spark, folder).nodes.select("id", "kind", "label", "path")


# --- traversal with kinds ---


@query("""with a as (select 'nation:' || n_nationkey as id, 1 as depth, 'region:2|contains|nation:' || n_nationkey as e1, '' as e2 from nation where n_regionkey = 2),
b as (select 'customer:' || c_custkey, 2, 'region:2|contains|nation:' || n_nationkey, 'nation:' || n_nationkey || '|contains|customer:' || c_custkey from customer join nation on n_nationkey = c_nationkey where n_regionkey = 2),
r as (select *, row_number() over (order by depth, e1, e2) as n from (select * from a union all select * from b)) select id, depth::int as depth, greatest(1, 50 - n + 1)::double as score from r where n <= 50""")
def neighborhood_kinds(spark, d):
    out = traverse.neighborhood(tabular.nodes(spark, d), tabular.edges(spark, d), "region:2", depth=2, max_results=50, edge_kinds=("contains",), node_kinds=("nation", "customer"))
    return out.select("id", "depth", "score")


@query("select 'self' as what, 0 as hops union all select 'unknown', 0 union all select 'none', -1 union all select 'kinds', -1")
def self_path(spark, d):
    e = tabular.edges(spark, d, "nation", "customer")
    n = tabular.nodes(spark, d, "region", "nation", "customer")
    way = traverse.path(e, "region:0", "nation:0", max_hops=3)
    rows = [("self", len(traverse.path(e, "nation:1", "nation:1"))), ("unknown", len(traverse.path(e, "gone", "gone"))), ("none", -1 if traverse.path(e, "nation:1", "gone") is None else 0)]
    rows.append(("kinds", -1 if traverse.path_nodes(n, e, "region:0", way or [], ("nation",)) is None else len(way)))
    return spark.createDataFrame(rows, "what string, hops int")


# --- history ---

GIT = """x as (select event_id, user_id, event_type, floor(epoch(ts))::bigint as epoch, value from events),
ch as (select 'h' || event_id as commit_hash, epoch, case when event_type = 'error' then 'src/{old' || user_id || ' => u' || user_id || '}/a.py' when event_type = 'signup' then 'o' || user_id || '.py => n' || user_id || '.py' else 'src/u' || user_id || '/a.py' end as raw,
  case when event_type = 'error' then 'src/old' || user_id || '/a.py' when event_type = 'signup' then 'o' || user_id || '.py' else 'src/u' || user_id || '/a.py' end as previous_path,
  case when event_type = 'signup' then 'n' || user_id || '.py' else 'src/u' || user_id || '/a.py' end as path, case when event_type = 'view' then null else event_id % 9 end as additions from x)"""


def _log(spark, d):
    """Events as the rows of a parsed log: a parent each, and one numstat line."""
    ev = table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("epoch"))
    who = _text("user_id")
    raw = F.when(F.col("event_type") == "error", F.concat(F.lit("src/{old"), who, F.lit(" => u"), who, F.lit("}/a.py"))).when(F.col("event_type") == "signup", F.concat(F.lit("o"), who, F.lit(".py => n"), who, F.lit(".py"))).otherwise(F.concat(F.lit("src/u"), who, F.lit("/a.py")))
    added = F.when(F.col("event_type") == "view", "-").otherwise((F.col("event_id") % 9).cast("string"))
    up = F.when(F.col("event_id") % 10 != 0, F.concat(F.lit("h"), (F.col("event_id") - 1).cast("string"))).otherwise("elsewhere")
    mail = F.concat(F.lit(" U"), who, F.lit("@Mail.example "))
    return ev.select(
        F.concat(F.lit("h"), _text("event_id")).alias("commit_hash"), _text("event_id").alias("short_hash"), up.alias("parents"), who.alias("author_name"), mail.alias("author_email"), F.col("epoch").alias("author_epoch"),
        who.alias("committer_name"), mail.alias("committer_email"), F.col("epoch").alias("committer_epoch"), F.lit("+0200").alias("offset"), F.col("event_type").alias("subject"), F.concat(F.lit("\n"), added, F.lit("\t-\t"), raw).alias("stat"),
    )


@query(f"with {GIT} select commit_hash, epoch, previous_path, path, coalesce(additions, -1) as additions, case when path <> previous_path then 'renamed' else 'changed' end as change_kind from ch")
def git_changes(spark, d):
    return git.changes(_log(spark, d)).select("commit_hash", "epoch", "previous_path", "path", F.coalesce("additions", F.lit(-1)).alias("additions"), "change_kind")


@query(f"with {GIT} select commit_hash, case when previous_path like 'src/%' then previous_path[5:] else '' end as previous_path, path[5:] as path from ch where path like 'src/%'")
def git_changes_below(spark, d):
    return git.below(git.changes(_log(spark, d)), "src").select("commit_hash", "previous_path", "path")


def _overlay(spark, d):
    n = table(spark, d, "customer").select(F.concat(F.lit("src/u"), _text("c_custkey"), F.lit("/a.py")).alias("path"), F.lit("file").alias("kind"), F.concat(F.lit("file:src/u"), _text("c_custkey"), F.lit("/a.py")).alias("id"))
    return (*git.overlay(_log(spark, d), n), n)


@query(f"""with {GIT}, f as (select 'src/u' || c_custkey || '/a.py' as path from customer)
select 'changes_path' as kind, 'commit:' || commit_hash as source_id, 'path:' || path as target_id from ch
union all select 'touches', 'commit:' || commit_hash, 'file:' || ch.path from ch join f on f.path = ch.path
union all select 'git_parent', 'commit:h' || event_id, 'commit:h' || (event_id - 1) from x where event_id % 10 <> 0 and event_id - 1 in (select event_id from x)""")
def git_overlay_edges(spark, d):
    return _overlay(spark, d)[1].select("kind", "source_id", "target_id")


@query(f"""with {GIT} select 'commit:h' || event_id as id, 'git_commit' as kind, event_type as label, sha256('u' || user_id || '@mail.example') as mail from x
union all select 'path:' || path, 'changed_path', path, null from (select distinct path from ch)""")
def git_overlay_nodes(spark, d):
    n = _overlay(spark, d)[0]
    return n.select("id", "kind", "label", fn.meta("metadata", "author_email_hash").alias("mail"))


@query(f"with {GIT} select (select count(*) from x)::bigint as git_commits, (select count(distinct path) from ch)::bigint as git_changed_paths, ((select count(*) from ch) + (select count(*) from ch join customer on ch.path = 'src/u' || c_custkey || '/a.py'))::bigint as git_renames")
def git_stats(spark, d):
    n, e, _ = _overlay(spark, d)
    return report.git_stats(n, e)


@query("""with c as (select 'commit:' || event_id as id, user_id, floor(epoch(ts))::bigint as epoch from events)
select id from c where user_id = (select min(user_id) from events) order by epoch desc, id limit 12""")
def commits_for_symbol(spark, d):
    n, e, _ = tabular.commits(spark, d)
    who = table(spark, d, "events").agg(F.min("user_id")).first()[0]
    symbol = spark.createDataFrame([("s1", "python_function", "f", f"user/{who}", "", "", "{}")], n.schema)
    return navigate.commits_for_symbol(n.unionByName(symbol), e, "s1", 12).select("id")


@query("select 'f' || (event_id // 700) as path, event_id as epoch, event_id::varchar as commit_id from events")
def lineage(spark, d):
    """A file that is renamed once in every 700 events: its whole history, back through all its names."""
    ev = table(spark, d, "events").select("event_id", F.col("event_id").alias("epoch"))
    era = F.floor(F.col("event_id") / 700)
    name = lambda c: F.concat(F.lit("f"), c.cast("string"))
    first = (F.col("event_id") % 700 == 0) & (F.col("event_id") > 0)
    changes = ev.select(name(era).alias("path"), F.when(first, name(era - 1)).otherwise("").alias("previous_path"), "epoch", _text("event_id").alias("commit_id"))
    newest = ev.agg(F.max("event_id")).first()[0] // 700
    return navigate.lineage(changes, f"f{newest}").select("path", "epoch", "commit_id")


@query("select id, epoch from (select 'commit:' || event_id as id, floor(epoch(ts))::bigint as epoch from events) order by epoch desc, id limit 40")
def map_commits(spark, d):
    n, _, _ = tabular.commits(spark, d)
    return report.map_commits(n, 40).select("id", fn.meta("metadata", "committer_time_epoch").cast("long").alias("epoch"))


# --- resolution ---


@query("""with d as (select doc_id as i, 'mod' || (doc_id % 50) || '.core' as label, case when doc_id % 3 = 0 then './x' || (doc_id % 20) || '.ts' when doc_id % 3 = 1 then 'mod' || (doc_id % 90) || '.core' else 'plain' end as want from documents),
m as (select label, min('m' || i) as id from d where i < 40 group by 1), p as (select i, 'lib/x' || i as stem from d where i < 15)
select 'i' || d.i as import_id, case when want like './%' then 'p' || p.i else m.id end as target_id, case when want like './%' then 'path' else 'module' end as how
from d left join m on m.label = d.want left join p on 'lib/' || replace(replace(d.want, './', ''), '.ts', '') = p.stem where coalesce(case when want like './%' then 'p' || p.i end, m.id) is not null""")
def local_imports(spark, d):
    return resolve.local_imports(_modules(spark, d))[0]


@query("select 'i' || doc_id as id from documents where doc_id % 3 = 0 and doc_id % 20 >= 15 or doc_id % 3 = 1 and doc_id % 90 >= 40 or doc_id % 3 = 2 and 1 = 1 and false or doc_id % 3 = 1 and doc_id % 90 < 50 and doc_id % 90 >= 40 and false or doc_id % 3 = 2")
def local_imports_lost(spark, d):
    return resolve.local_imports(_modules(spark, d))[1].select("id")


def _modules(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("i"))
    s = lambda c: c.cast("string")
    i = F.col("i")
    want = F.when(i % 3 == 0, F.concat(F.lit("./x"), s(i % 20), F.lit(".ts"))).when(i % 3 == 1, F.concat(F.lit("mod"), s(i % 90), F.lit(".core"))).otherwise("plain")
    imports = docs.select(F.concat(F.lit("i"), s(i)).alias("id"), F.lit("import").alias("kind"), want.alias("label"), F.lit("lib/a.ts").alias("path"), F.lit('{"source_path":"lib/a.ts"}').alias("metadata"))
    modules = docs.where("i < 40").select(F.concat(F.lit("m"), s(i)).alias("id"), F.lit("python_module").alias("kind"), F.lit("m").alias("label"), F.lit("").alias("path"), F.concat(F.lit('{"module_name":"mod'), s(i % 50), F.lit('.core"}')).alias("metadata"))
    files = docs.where("i < 15").select(F.concat(F.lit("p"), s(i)).alias("id"), F.lit("file").alias("kind"), F.lit("f").alias("label"), F.concat(F.lit("lib/x"), s(i), F.lit(".ts")).alias("path"), F.lit("{}").alias("metadata"))
    return imports.unionByName(modules).unionByName(files)


EXACT = "x as (select distinct l_orderkey, l_partkey, l_returnflag from lineitem)"


def _exact(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag").distinct()
    kind = F.when(F.col("l_returnflag") == "R", '{"resolution_kind":"exact"}').otherwise('{"resolution_kind":"heuristic"}')
    return line.select(F.concat_ws("|", "l_orderkey", "l_partkey", "l_returnflag").alias("id"), F.concat(F.lit("orders:"), _text("l_orderkey")).alias("source_id"), F.concat(F.lit("part:"), _text("l_partkey")).alias("target_id"), F.lit("resolves_to").alias("kind"), kind.alias("metadata"))


@query(f"with {EXACT} select 'orders:' || l_orderkey as source_id, min('part:' || l_partkey) as target_id from x where l_returnflag = 'R' group by l_orderkey having count(distinct l_partkey) = 1")
def resolved_definitions(spark, d):
    return navigate.resolved_definitions(_exact(spark, d))


@query(f"with {EXACT}, ids as (select distinct 'orders:' || l_orderkey as id from x where l_returnflag = 'R' and l_partkey = 7 order by 1 limit 6) select id from ids where id in (select 'orders:' || o_orderkey from orders where o_orderkey % 3 <> 0)")
def incoming_externals(spark, d):
    n = tabular.nodes(spark, d, "orders").where(_key("id") % 3 != 0)
    return navigate.incoming_externals(n, _exact(spark, d), "part:7", 6).select("id")


@query("""with b as (select o_orderkey as k from orders where o_orderkey % 3 <> 0), p as (select o_orderkey as k from orders where o_orderkey % 2 = 0),
e as (select l_orderkey as k, l_partkey as p, min(l_linenumber) as n from lineitem group by 1, 2)
select 'node' as what, 'orders:' || k as id, case when k % 3 <> 0 then 'base' else 'precise' end as label from (select k from b union select k from p)
union all select 'edge', k || '|' || p, '' from e where k in (select k from b union select k from p)
union all select 'precise_merge_collision', 'orders:' || k, '' from b where k in (select k from p)
union all select 'precise_merge_referential_gap', k || '|' || p, '' from e where k not in (select k from b union select k from p)""")
def precise_merge(spark, d):
    o = tabular.nodes(spark, d, "orders").withColumn("k", _key("id"))
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    edges = line.select(F.concat_ws("|", "l_orderkey", "l_partkey").alias("id"), F.concat(F.lit("orders:"), _text("l_orderkey")).alias("source_id"), F.concat(F.lit("orders:"), _text("l_orderkey")).alias("target_id"), F.lit("self").alias("kind"))
    base = o.where("k % 3 <> 0").withColumn("label", F.lit("base")).drop("k")
    precise = o.where("k % 2 = 0").withColumn("label", F.lit("precise")).drop("k")
    half = _part(edges, 0)
    n, e, lost = resolve.merged(base, half, precise, edges.join(half.select("id"), "id", "left_anti"))
    rows = n.select(F.lit("node").alias("what"), "id", "label").unionByName(e.select(F.lit("edge").alias("what"), "id", F.lit("").alias("label")))
    return rows.unionByName(lost.select(F.col("reason").alias("what"), F.col("item_id").alias("id"), F.lit("").alias("label")))


def _part(edges, rest):
    return edges.where(F.crc32(F.col("id").cast("binary")) % 2 == rest)


FACTS = """s as (select distinct p_partkey as k, 'src/' || (p_partkey % 30) || '.c' as path from part where p_partkey % 4 <> 1),
r as (select distinct l_orderkey, l_partkey, l_linenumber from lineitem)"""


def _compiler(spark, d):
    symbols = table(spark, d, "part").where("p_partkey % 4 <> 1").select(F.concat(F.lit("part:"), _text("p_partkey")).alias("symbol"), F.lit("function").alias("kind"), F.col("p_name").alias("label"), F.concat(F.lit("src/"), (F.col("p_partkey") % 30).cast("string"), F.lit(".c")).alias("path"), F.col("p_size").alias("line"))
    refs = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").distinct().select(F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("order:"), _text("l_orderkey"))).otherwise("").alias("source_symbol"), F.concat(F.lit("part:"), _text("l_partkey")).alias("target_symbol"), F.concat(F.lit("use/"), _text("l_orderkey")).alias("path"), F.col("l_linenumber").cast("int").alias("line"))
    return interchange.from_compiler_facts(symbols, refs)


@query(f"""with {FACTS} select 'node' as what, 'symbol:part:' || k as id from s union all select 'node', 'file:' || path from (select path from s union select 'use/' || l_orderkey from r)
union all select 'edge', 'file:' || path || '|defines|symbol:part:' || k from s
union all select 'edge', case when l_partkey % 2 = 0 then 'symbol:order:' || l_orderkey else 'file:use/' || l_orderkey end || '|references|symbol:part:' || l_partkey || '|use/' || l_orderkey || ':' || l_linenumber from r where l_partkey in (select k from s)
union all select 'compiler_reference_unresolved', 'part:' || l_partkey from r where l_partkey not in (select k from s)""")
def compiler_facts(spark, d):
    n, e, lost = _compiler(spark, d)
    return n.select(F.lit("node").alias("what"), "id").unionByName(e.select(F.lit("edge").alias("what"), "id")).unionByName(lost.select(F.col("reason").alias("what"), F.col("item_id").alias("id")))


# --- composition and workspaces ---


def _root(spark, d, name, mod):
    """One root of a workspace: a project, its parts, external uses of others' parts and definitions of its own."""
    p = table(spark, d, "part")
    key = lambda c: F.col(c).cast("string")
    symbol = lambda version: F.concat(F.lit("own pip parts "), version, F.lit(" p"), key("p_partkey"))
    mine = p.where(F.col("p_partkey") % 3 == mod)
    meta = lambda s, ext: F.concat(F.lit('{"scip_external":' + ext + ',"scip_symbol":"'), s, F.lit('"}'))
    defs = mine.select(F.concat(F.lit(f"{name}/def/"), key("p_partkey")).alias("id"), F.lit("symbol").alias("kind"), F.col("p_name").alias("label"), F.lit("a.py").alias("path"), F.lit(1).alias("line"), meta(symbol(F.lit("1")), "false").alias("metadata"))
    version = F.when(F.col("p_partkey") % 7 == 0, "2").otherwise("1")
    uses = p.where(F.col("p_partkey") % 2 == 0).select(F.concat(F.lit(f"{name}/use/"), key("p_partkey")).alias("id"), F.lit("symbol").alias("kind"), F.col("p_name").alias("label"), F.lit("").alias("path"), F.lit(None).cast("int").alias("line"), meta(symbol(version), "true").alias("metadata"))
    top = spark.createDataFrame([(f"{name}/project", "project", name, "", None, "{}")], "id string, kind string, label string, path string, line int, metadata string")
    nodes = defs.unionByName(uses).unionByName(top)
    edges = defs.select(F.concat(F.lit(f"{name}|"), "id").alias("id"), F.lit("contains").alias("kind"), F.lit(f"{name}/project").alias("source_id"), F.col("id").alias("target_id"))
    return workspace.Input(name, bundle(nodes, edges, namespace=name))


def _composed(spark, d):
    return workspace.compose([_root(spark, d, "a", 0), _root(spark, d, "b", 1)], "both")


USED = """u as (select r, p_partkey as k, p_partkey % 7 = 0 as other, case p_partkey % 3 when 0 then 'a' when 1 then 'b' else '' end as home from part, (values ('a'), ('b')) t(r) where p_partkey % 2 = 0),
o as (select *, case when not other and home = r then 'same_root' when not other and home <> '' then 'exact' when home <> '' and home <> r then 'version_mismatch' else 'missing' end as outcome from u)"""


@query(f"with {USED} select r || '/use/' || k as source_id, home || '/def/' || k as target_id, sha256('own pip parts 1 p' || k) as symbol_sha256 from o where outcome = 'exact'")
def composed_resolution(spark, d):
    e = _composed(spark, d).edges.where("kind = 'resolves_to'")
    return e.select("source_id", "target_id", fn.meta("metadata", "symbol_sha256").alias("symbol_sha256"))


@query(f"""with {USED}, n as (select outcome, r || '/use/' || k as id, row_number() over (partition by outcome order by r || '/use/' || k) as n from o where outcome <> 'exact')
select 'cross_repo_' || case outcome when 'version_mismatch' then 'package_version_mismatch' else 'definition_' || outcome end as reason, id as item_id from n where n <= 100""")
def composed_diagnostics(spark, d):
    return workspace.diagnostics(_composed(spark, d).omitted).select("reason", "item_id")


@query("""select 'a/def/' || p_partkey as id from part where p_partkey % 3 = 0 union all select 'b/def/' || p_partkey from part where p_partkey % 3 = 1
union all select r || '/use/' || p_partkey from part, (values ('a'), ('b')) t(r) where p_partkey % 2 = 0 union all select 'a/project' union all select 'b/project' union all select 'loom://both/workspace/both'""")
def composed_nodes(spark, d):
    return _composed(spark, d).nodes.select("id")


@query("select * from (values ('duplicate input', 'DUPLICATE_SNAPSHOT_INPUT'), ('duplicate namespace', 'DUPLICATE_SNAPSHOT_NAMESPACE'), ('duplicate root', 'DUPLICATE_ROOT'), ('duplicate root namespace', 'DUPLICATE_ROOT_NAMESPACE'), ('gap', 'SNAPSHOT_REFERENTIAL_GAP'), ('nested', 'NESTED_SNAPSHOT_COMPOSITION'), ('no inputs', 'NO_SNAPSHOT_INPUTS'), ('no roots', 'NO_ROOTS'), ('nameless root', 'INVALID_ROOT'), ('nameless input', 'INVALID_SNAPSHOT_INPUT'), ('projects', 'INVALID_PROJECT_NODE_COUNT'), ('shared ids', 'DUPLICATE_NODE_ID'), ('version', 'UNSUPPORTED_SCHEMA_VERSION')) t(what, code)")
def composition_errors(spark, d):
    """What composition refuses: each row is the code that the case ended in."""
    a, b = _root(spark, d, "a", 0), _root(spark, d, "b", 1)
    r = workspace.Root
    as_ = lambda i, **h: workspace.Input(i.name, i.snapshot.with_(header=i.snapshot.header | h))
    cases = {
        "no inputs": lambda: workspace.check_inputs([]), "nameless input": lambda: workspace.check_inputs([workspace.Input(" ", a.snapshot)]), "duplicate input": lambda: workspace.check_inputs([a, a]),
        "duplicate namespace": lambda: workspace.check_inputs([a, as_(b, namespace="a")]), "version": lambda: workspace.check_inputs([as_(a, schema_version="0")]), "nested": lambda: workspace.check_inputs([as_(a, composed=True)]),
        "projects": lambda: workspace.check_inputs([workspace.Input("a", a.snapshot.with_(nodes=a.snapshot.nodes.where("kind <> 'project'")))]), "gap": lambda: workspace.check_inputs([workspace.Input("a", a.snapshot.with_(nodes=a.snapshot.nodes.where("id not like '%/def/%'")))]),
        "shared ids": lambda: workspace.compose([a, workspace.Input("c", as_(a, namespace="c").snapshot)]), "no roots": lambda: workspace.check_roots([]), "nameless root": lambda: workspace.check_roots([r("", "x", "y")]),
        "duplicate root": lambda: workspace.check_roots([r("x", "/a", "1"), r("x", "/b", "2")]), "duplicate root namespace": lambda: workspace.check_roots([r("x", "/a", "1"), r("y", "/b", "1")]),
    }
    out = []
    for what, do in cases.items():
        try:
            do()
            out.append((what, ""))
        except GraphError as e:
            out.append((what, e.code))
    return spark.createDataFrame(out, "what string, code string")


@query("""select 'nation:' || n_nationkey as id, case when n_nationkey % 2 = 0 then 'two' else 'one' end as root, case when n_nationkey % 2 = 0 then 'from two' else n_name end as label from nation""")
def multi_root_union(spark, d):
    """Of rows that share an id those of the last root stay."""
    n = tabular.nodes(spark, d, "nation")
    again = n.where(_key("id") % 2 == 0).withColumn("label", F.lit("from two"))
    none = spark.createDataFrame([], "id string, kind string, source_id string, target_id string")
    out = workspace.multi_root_union([("one", bundle(n, none)), ("two", bundle(again, none))], "all")
    return out.nodes.select("id", fn.meta("metadata", "workspace_root").alias("root"), "label")


# --- reports ---


@query(f"""with {WHOLE}, {D}, comp as (select root, count(*) as n from cc group by root)
select (select count(*) from nodes) as node_count, (select count(*) from edges) as edge_count, (select count(*) from comp) as component_count, (select max(n) from comp) as largest_component,
(select count(*) from nodes where id not in (select id from deg)) as isolated_count, (select max(degree) from deg) as max_degree""")
def topology_summary(spark, d):
    return report.topology_summary(tabular.nodes(spark, d), tabular.edges(spark, d))


@query("""with e as (select n_regionkey as r, count(*) as n from nation group by 1), c as (select n_regionkey as r, count(*) as n from nation join supplier on s_nationkey = n_nationkey group by 1)
select 'nation:' || min(n_nationkey::varchar) as component_id, 1 + e.n + coalesce(c.n, 0) as node_count, e.n + coalesce(c.n, 0) as edge_count from nation join e on e.r = n_regionkey left join c on c.r = n_regionkey group by n_regionkey, e.n, c.n
order by 2 desc, 3 desc, 1 limit 4""")
def component_rank(spark, d):
    """Regions with their nations and suppliers."""
    return report.component_rank(tabular.nodes(spark, d, "region", "nation", "supplier"), tabular.edges(spark, d, "nation", "supplier"), 4)


KINDS = "k as (select id, label, case kind when 'part' then 'python_class' when 'supplier' then 'python_function' when 'customer' then 'doc_section' when 'orders' then 'git_commit' when 'nation' then 'file' else 'project' end as kind, path, text from nodes)"


def _mixed(spark, d):
    """The tables' nodes under the kinds of a repository."""
    to = F.create_map(*(F.lit(x) for x in ("part", "python_class", "supplier", "python_function", "customer", "doc_section", "orders", "git_commit", "nation", "file", "region", "project")))
    epoch = F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("string")
    meta = F.concat(F.lit('{"committer_time_epoch":'), epoch, F.lit(',"commit_hash":"orders:'), _text("o_orderkey"), F.lit('"}'))
    n = tabular.nodes(spark, d, of_orders=F.coalesce(meta, F.lit("{}"))).withColumn("kind", to[F.col("kind")]).withColumn("line", F.lit(None).cast("int"))
    return n.withColumn("metadata", F.when(F.col("metadata") == "", "{}").otherwise(F.col("metadata")))


@query(f"with {N}, {KINDS} select kind, min_by(id, id) as id, min_by(label, id) as label, case kind when 'python_class' then 1 when 'python_function' then 2 when 'doc_section' then 5 else 6 end::int as place from k where kind in ('python_class', 'python_function', 'doc_section', 'file') group by kind")
def suggestions(spark, d):
    return report.suggestions(_mixed(spark, d))


@query(f"""with {N}, {KINDS}, sy as (select label || ' (' || kind || case when path <> '' then ', ' || path else '' end || ')' as item from k where kind in ('symbol') or regexp_matches(kind, '_(function|class|method|export|symbol)$')),
se as (select label || ' (' || kind || case when path <> '' then ', ' || path else '' end || ')' as item from k where kind = 'doc_section'), {LINKS},
lost as (select case when page_id % 2 = 0 then 'even' else 'odd' end as reason, count(*) as n from links group by 1)
select 'files' as section, n::int as position, path as item from (select path, row_number() over (order by path) as n from k where kind = 'file') where n <= 8
union all select 'symbols', n, item from (select item, row_number() over (order by item) as n from sy) where n <= 8
union all select 'sections', n, item from (select item, row_number() over (order by item) as n from se) where n <= 8
union all select 'omitted', n, reason || ': ' || c from (select reason, n as c, row_number() over (order by n desc, reason) as n from lost) where n <= 8
union all select 'commits', n, substr('orders:' || o_orderkey, 1, 12) || ' order:' || o_orderkey from (select o_orderkey, row_number() over (order by epoch(o_orderdate) desc, 'orders:' || o_orderkey) as n from orders) where n <= 8
union all select 'directories', n, path || ' (' || c || ')' from (select r_name as path, c, row_number() over (order by c desc, r_name) as n from (select r_regionkey, r_name, count(*) as c from region join nation on n_regionkey = r_regionkey group by 1, 2)) where n <= 8""")
def repo_map(spark, d):
    n = _mixed(spark, d)
    n = n.withColumn("path", F.when(F.col("kind") == "project", F.col("label")).otherwise(F.col("path")))
    lost = tabular.page_links(spark, d).select(F.when(F.col("page_id") % 2 == 0, "even").otherwise("odd").alias("reason"), F.col("target").alias("item_id"))
    return report.repo_map(n, tabular.edges(spark, d, "nation"), lost, 8).withColumn("position", F.col("position").cast("long"))


@query("""select 'part:' || l_partkey as id, p_name as label, count(*) as incoming_count from lineitem join part on p_partkey = l_partkey group by all order by 3 desc, 1 limit 15""")
def document_graph(spark, d):
    line = table(spark, d, "lineitem").select(F.concat(F.lit("orders:"), _text("l_orderkey")).alias("source_id"), F.concat(F.lit("part:"), _text("l_partkey")).alias("target_id"), F.lit("references_doc").alias("kind"))
    return report.doc_target_rank(report.document_graph(tabular.nodes(spark, d, "part"), line), 15).select("id", "label", "incoming_count")


@query(f"with {N}, {E} select id, kind from nodes where id not in (select source_id from edges where kind = 'depends_on' union select target_id from edges where kind = 'depends_on') order by kind, path, id limit 20")
def ordered_orphans(spark, d):
    return report.ordered_orphans(tabular.nodes(spark, d), tabular.edges(spark, d, "lineitem"), 20).select("id", "kind")


@query(f"""with {WHOLE}, comp as (select root, count(*) as n from cc group by root) select (select count(*) from nodes) as node_count, (select count(*) from comp) as component_count, 6::bigint as node_kinds, 2::bigint as edge_kinds,
(select count(*) from nodes where path like '/%') as absolute_refs, true as export_safe""")
def certification(spark, d):
    n = tabular.nodes(spark, d)
    out = report.certification(n, tabular.edges(spark, d).withColumn("path", F.lit("")), spark.createDataFrame([], "reason string, item_id string"))
    return out.select("node_count", "component_count", "node_kinds", "edge_kinds", "absolute_refs", "export_safe")


@query("select (select count(*) from documents) as files, (select count(distinct source) from documents) as parsers, (select count(distinct (source, lang)) from documents) as parser_versions")
def snapshot_stats(spark, d):
    docs = table(spark, d, "documents")
    n = docs.select(F.lit("file").alias("kind"), F.concat(F.lit('{"parser":"'), "source", F.lit('","parser_version":"'), "lang", F.lit('"}')).alias("metadata"))
    return report.snapshot_stats(n, n.limit(0), n.limit(0)).select("files", "parsers", "parser_versions")


@query("select case when doc_id % 5 = 0 then 'unknown' when doc_id % 2 = 0 then 'changed' else 'fresh' end as marker, count(*) as n from documents group by 1")
def freshness(spark, d):
    i = F.col("doc_id")
    return report.freshness(table(spark, d, "documents").select(F.when(i % 5 == 0, "{}").when(i % 2 == 0, '{"freshness":"changed"}').otherwise('{"freshness":"fresh"}').alias("metadata")))


@query(f"with {N}, {E} select (select count(*) from nodes) as nodes, (select count(*) from edges) as edges, (select count(distinct path) from nodes where path <> '') as source_paths")
def project_health(spark, d):
    e = tabular.edges(spark, d).withColumn("path", F.lit(""))
    return viewer.project_health(tabular.nodes(spark, d), e, spark.createDataFrame([], "reason string")).select("nodes", "edges", "source_paths")


@query("select event_id as item_id, '/home/' || user_id as path, user_id::int as line from events")
def findings(spark, d):
    ev = table(spark, d, "events")
    details = F.concat(F.lit('{"path":"/home/'), _text("user_id"), F.lit('","line":'), _text("user_id"), F.lit("}"))
    return report.finding(ev.select(F.col("event_type").alias("reason"), F.col("event_id").alias("item_id"), details.alias("details"))).select("item_id", "path", "line")


@query("select * from (values ('config', 'available'), ('markdown', 'available'), ('python', 'available'), ('script', 'available')) t(family, status)")
def parser_support(spark, d):
    return registry.support(spark).where("family <> 'script_precise'").select("family", "status")


# --- presets and related ---


def _preset_graph(spark, d):
    n = _mixed(spark, d)
    line = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_partkey").distinct()
    e = line.select(F.concat_ws("|", "l_orderkey", "l_partkey").alias("id"), F.lit("references_doc").alias("kind"), F.concat(F.lit("orders:"), _text("l_orderkey")).alias("source_id"), F.concat(F.lit("part:"), _text("l_partkey")).alias("target_id"), F.lit("{}").alias("metadata"))
    return n, e


@query(f"""with {N}, {KINDS}, r as (select distinct l_orderkey, l_partkey from lineitem where l_returnflag = 'R'), t as (select 'orders:' || l_orderkey as id from r union select 'part:' || l_partkey from r)
select 'file_map' as preset, id from k where kind = 'file' union all select 'symbol_map', id from k where kind in ('python_class', 'python_function') union all select 'doc_links', id from t
union all select 'changed_recently', id from k where kind = 'git_commit' union all select 'orphans', id from k where id not in (select id from t) union all select 'high_degree', id from k""")
def presets(spark, d):
    n, e = _preset_graph(spark, d)
    out = None
    for name in sorted(views.PRESETS):
        rows = views.preset(name, n, e).select(F.lit(name).alias("preset"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""with {N}, {KINDS}, {E}, near as (select e.id as edge_id, case when source_id = 'nation:3' then target_id else source_id end as other from edges e where source_id = 'nation:3' or target_id = 'nation:3'),
b as (select case when kind = 'file' then 'files' when kind like 'doc%' then 'docs' when kind = 'symbol' or regexp_matches(kind, '_(function|class|method|export|symbol)$') then 'symbols' else 'other' end as bucket, edge_id, k.id from near join k on k.id = near.other),
r as (select *, row_number() over (partition by bucket order by edge_id) as n from b) select bucket, n::int as n, id from r where n <= 5""")
def related_buckets(spark, d):
    return views.related(_mixed(spark, d), tabular.edges(spark, d), "nation:3", 5).select("bucket", "n", "id")


@query(f"with {N}, {KINDS} select id from k where kind = 'symbol' or regexp_matches(kind, '_(function|class|method|export|symbol)$')")
def reference_bundle_symbols(spark, d):
    return exports.reference_bundle(bundle(_mixed(spark, d), tabular.edges(spark, d)))[0].select("id")


@query(f"with {E} select id from edges where kind = 'depends_on'")
def reference_bundle_references(spark, d):
    return exports.reference_bundle(bundle(tabular.nodes(spark, d), tabular.edges(spark, d)))[1].select("id")


# --- viewer ---


@query(f"""with {N}, {KINDS}, c as (select *, (row_number() over (order by id) - 1) // 24 as cluster from k), f as (select cluster, min(id) as id from c group by 1),
r as (select c.id, row_number() over (order by case when f.id is null then 1 else 0 end, c.kind, c.path, c.id) as n from c left join f on f.id = c.id) select id from r where n <= 120""")
def viewer_selection(spark, d):
    return viewer.selection(_mixed(spark, d), tabular.edges(spark, d), "cluster", 120).select("id")


@query(f"""with {N}, {E}, {D}, c as (select n.id, (row_number() over (order by n.id) - 1) // 24 as cluster, coalesce(degree, 0) as degree from nodes n left join deg on deg.id = n.id where n.kind = 'part'),
h as (select *, row_number() over (partition by cluster order by degree desc, id) as n from c)
select cluster::bigint as cluster, count(*) as node_count, sum(degree)::bigint as edge_count, min(id) as representative_id, string_agg(id, ',' order by n) filter (n <= 3) as hubs, string_agg(id, ',' order by n) filter (n <= 2) as bridges from h group by 1""")
def viewer_clusters(spark, d):
    out = viewer.cluster_table(tabular.nodes(spark, d, "part"), tabular.edges(spark, d, "lineitem"))
    return out.select("cluster", "node_count", "edge_count", "representative_id", F.array_join("hub_ids", ",").alias("hubs"), F.array_join("bridge_ids", ",").alias("bridges"))


@query(f"with {BOTH} select case item_kind when 'node' then 0 else 1 end::int as position, item_kind || '_' || status as marker, item_id from structure order by 1, 2, 3 limit 500")
def viewer_delta(spark, d):
    return viewer.delta_markers(*_orders_before_after(spark, d), 500)


@query("select 'part:' || p_partkey as id, 'part' as kind, p_name as label, p_brand as citation, 'x@1' as provenance, 'part,en' as tags from part")
def viewer_records(spark, d):
    n = bundle(tabular.nodes(spark, d, "part").withColumn("metadata", F.lit('{"parser":"x","parser_version":"1","language":"en"}')), tabular.edges(spark, d, "nation")).nodes
    return viewer.node_records(n).select("id", "kind", "label", "citation", "provenance", F.array_join("tags", ",").alias("tags"))


@query("""with e as (select n_nationkey as k from nation), n as (select count(*) as c from nation) select 'node_budget' as reason, greatest(0, (select count(*) from nation) + (select count(*) from region) - 12) as omitted
union all select 'edge_budget', greatest(0, (select count(*) from (select 'nation:' || n_nationkey as id, 'region:' || n_regionkey as r from nation) where id in (select id from (select 'nation:' || n_nationkey as id from nation union select 'region:' || r_regionkey from region) order by id limit 12) and r in (select id from (select 'nation:' || n_nationkey as id from nation union select 'region:' || r_regionkey from region) order by id limit 12)) - 3) where 1 = 0""")
def viewer_omissions(spark, d):
    e = viewer.envelope(bundle(tabular.nodes(spark, d, "region", "nation"), tabular.edges(spark, d, "nation")), "raw", node_budget=12, edge_budget=3)
    return spark.createDataFrame([(o["reason"], o["omitted"]) for o in viewer.explain_omitted(e.omissions)], "reason string, omitted long")


@query("select 'edge' as what, printf('edge:%09d', i) as id, printf('node:%09d', i % 2000) as a, printf('node:%09d', (i % 2000 + 1 + i // 2000) % 2000) as b from range(2900) t(i)")
def viewer_ring(spark, d):
    return viewer.ring(spark, 2000).edges.select(F.lit("edge").alias("what"), "id", F.col("source_id").alias("a"), F.col("target_id").alias("b"))


@query("select 7::bigint as nodes, 8::bigint as edges, 1::bigint as omitted, 1::bigint as components")
def demo_graph(spark, d):
    s = viewer.demo(spark)
    return views.health(s.nodes, s.edges, s.omitted).crossJoin(traverse.graph_components(s.nodes, s.edges).agg(F.count(F.lit(1)).alias("components")))


# --- exports ---


@query(f"""with {N}, s as (select id, label, row_number() over (order by id) - 1 as n from nodes where kind in ('region', 'nation', 'customer')), {E}
select 1 as part, '  n' || n || '["' || label || '"]' as line from s union all select 2, '  n' || a.n || ' -->|' || kind || '| n' || b.n from edges join s a on a.id = source_id join s b on b.id = target_id""")
def export_mermaid(spark, d):
    return exports.mermaid_lines(tabular.nodes(spark, d, "region", "nation", "customer"), tabular.edges(spark, d, "nation", "customer")).select("part", "line")


@query("select 'nation:' || n_nationkey as id, n_name as label, 'region:' || n_regionkey as source_id from nation")
def graph_json_round_trip(spark, d):
    s = bundle(tabular.nodes(spark, d, "region", "nation"), tabular.edges(spark, d, "nation"))
    back = interchange.from_graph_json(spark, exports.graph_json(s))
    return back.edges.join(back.nodes, back.edges["target_id"] == back.nodes["id"]).select(back.nodes["id"], "label", "source_id")


@query(f"with {N} select path, count(*) as symbols from nodes where path <> '' group by path")
def scip_documents(spark, d):
    docs, _ = scip.index_rows(bundle(tabular.nodes(spark, d), tabular.edges(spark, d)))
    return docs.select("path", F.json_array_length(F.get_json_object("document", "$.symbols")).cast("long").alias("symbols"))


@query("select p_partkey, 'function' as kind, case when p_partkey % 3 = 0 then 'mismatch' when p_partkey % 3 = 1 then 'match' else 'unknown' end as freshness from part")
def scip_scalars(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey") % 3
    root = F.when(k == 0, "elsewhere").when(k == 1, "here").otherwise("")
    return p.select("p_partkey", scip.kind_name(F.lit(17)).alias("kind"), scip.freshness(root, "here", F.lit(""), "").alias("freshness"))


@query("""with b as (select (select count(*) from nation) + (select count(*) from region) as n, (select count(*) from nation) as e)
select 'count:nodes' as check, true as ok, n || ' of ' || n as detail from b union all select 'count:edges', true, e || ' of ' || e from b union all select 'count:omitted', true, '0 of 0' union all select 'store', true, '' union all select 'files', true, ''""")
def pack_verify(spark, d):
    folder = _place(spark, "pack")
    pack.write(bundle(tabular.nodes(spark, d, "region", "nation"), tabular.edges(spark, d, "nation")), folder, store="yes")
    got = pack.verify(spark, folder)
    files = got.where("check like 'file:%'").agg(F.lit("files").alias("check"), F.every("ok").alias("ok"), F.lit("").alias("detail"))
    return got.where("check not like 'file:%'").unionByName(files)


@query(f"with {N} select id, kind, case when kind = 'customer' then '' else text end as text from nodes where kind in ('customer', 'nation')")
def pack_import(spark, d):
    folder = _place(spark, "pack")
    pack.write(bundle(tabular.nodes(spark, d, "customer", "nation"), tabular.edges(spark, d, "customer")), folder, profile="no_content")
    return pack.load(spark, folder).nodes.select("id", "kind", "text")


# --- refresh ---

MANIFESTS = """m as (select doc_id as k, 'doc/' || doc_id as path, case when doc_id % 9 = 0 then 'added' when doc_id % 8 = 0 then 'removed' when doc_id % 6 = 0 then 'content' when doc_id % 10 = 0 then 'kind' else 'same' end as how from documents where not (doc_id % 9 = 0 and doc_id % 8 = 0))"""


def _manifests(spark, d):
    docs = table(spark, d, "documents")
    base = docs.select("doc_id", F.concat(F.lit("doc/"), _text("doc_id")).alias("path"), F.sha2("text", 256).alias("content_hash"), F.col("source").alias("parser"), F.lit("1").alias("parser_version"), F.octet_length("text").cast("long").alias("size_bytes"), F.lit("file").alias("file_kind"))
    k = F.col("doc_id")
    new = base.where(k % 8 != 0).withColumn("content_hash", F.when(k % 6 == 0, "x").otherwise(F.col("content_hash"))).withColumn("file_kind", F.when(k % 10 == 0, "other").otherwise("file"))
    return base.where(k % 9 != 0).drop("doc_id"), new.drop("doc_id")


@query(f"with {MANIFESTS} select path, how in ('added', 'content') as parse from m")
def refresh_sets(spark, d):
    return diff.refresh_sets(diff.path_changes(*_manifests(spark, d))).select("path", "parse")


@query(f"with {MANIFESTS} select path, how <> 'same' as changed from m")
def refresh_plan(spark, d):
    return refresh.plan(*_manifests(spark, d)).select("path", "changed")


@query(f"with {MANIFESTS} select count(*) filter (how <> 'same') as changed_paths, count(*) filter (how = 'same') as unchanged_paths, count(*) filter (how = 'removed') as removed_paths, count(*) filter (how <> 'removed') as entries, (select count(distinct source) from documents where doc_id % 8 <> 0)::int as parsers from m")
def refresh_summary(spark, d):
    old, new = _manifests(spark, d)
    return refresh.plan_summary(refresh.plan(old, new), new).withColumn("parsers", F.size("parsers"))


@query(f"with {BOTH}, every as (select * from (values ('node', 'added'), ('node', 'removed'), ('edge', 'added'), ('edge', 'removed'), ('omitted', 'added'), ('omitted', 'removed')) t(item_kind, status)) select item_kind, status, (select count(*) from structure s where s.item_kind = every.item_kind and s.status = every.status)::bigint as n from every")
def refresh_delta(spark, d):
    return refresh.delta_counts(*_orders_before_after(spark, d))


@query(f"with {BOTH}, all_ as (select * from structure union all select * from changes) select item_kind || '_' || status as what, count(*) as n from all_ group by 1")
def delta_review(spark, d):
    got = refresh.delta_review(*_orders_before_after(spark, d), limit=10)
    return spark.createDataFrame(sorted(got["counts"].items()), "what string, n long")


@query("select source as parser, '1' as parser_version, count(*) as files, sum(strlen(text))::bigint as bytes from documents group by 1")
def parser_counts(spark, d):
    docs = table(spark, d, "documents")
    return report.parser_counts(docs.select(F.col("source").alias("parser"), F.lit("1").alias("parser_version"), F.octet_length("text").cast("long").alias("size_bytes")))


# --- scalar functions ---


@query("""select p_partkey, 'src/' || p_brand || '/x' || p_partkey || '.py' as tidy, p_brand || '.x' || p_partkey as module, 'lib-' || p_partkey as name, '>=' || p_size || '.1' as bound,
(1 + p_partkey % 4)::int as line, case when p_partkey % 3 = 0 then 'script' when p_partkey % 3 = 1 then 'markdown' else 'file' end as kind from part""")
def path_functions(spark, d):
    p = table(spark, d, "part")
    key = _text("p_partkey")
    messy = F.concat(F.lit(" ./src\\"), F.col("p_brand"), F.lit("//./x"), key, F.lit(".py"))
    name, bound = fn.requirement(F.concat(F.lit("lib-"), key, F.lit("  >="), _text("p_size"), F.lit(".1 ")))
    n = (F.col("p_partkey") % 4).cast("int")
    text = F.concat(F.repeat(F.lit("ab\n"), n), F.lit("end"))
    suffix = F.when(F.col("p_partkey") % 3 == 0, ".tsx").when(F.col("p_partkey") % 3 == 1, ".MD").otherwise(".bin")
    tidy = fn.relative_path(messy)
    return p.select("p_partkey", tidy.alias("tidy"), fn.module_name(tidy).alias("module"), name.alias("name"), bound.alias("bound"), fn.line_of(text, n * 3).cast("int").alias("line"), fn.file_kind(F.concat(F.lit("a/b"), suffix)).alias("kind"))


@query("""select p_partkey, 'npm' as manager, p_name as package, p_size || '.0' as version, 'pkg/C' || p_partkey || '#m().' as descriptors, '' as local, 's|npm|' || p_name || '|pkg/C' || p_partkey || '#m().' as family from part where p_partkey % 2 = 0
union all select p_partkey, '', '', '', '', 'v' || p_partkey, 'local||||'[1:8] from part where p_partkey % 2 = 1""")
def symbol_parts(spark, d):
    p = table(spark, d, "part")
    key = _text("p_partkey")
    symbol = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("s npm "), F.replace("p_name", F.lit(" "), F.lit("  ")), F.lit(" "), _text("p_size"), F.lit(".0 pkg/C"), key, F.lit("#m()."))).otherwise(F.concat(F.lit("local v"), key))
    x = interchange.symbol_parts(symbol)
    return p.select("p_partkey", *(x[c].alias(c) for c in ("manager", "package", "version", "descriptors", "local")), interchange.version_free(symbol).alias("family"))


@query("select p_partkey, 'src/' || p_brand || '#section=' || p_type || '#L' || p_size as ref, case when p_partkey < 2000 then 'raw' else 'sampled' end as level, case when p_size <= 15 then 'small' when p_size <= 120 then 'medium' else 'large' end as profile from part")
def reference_ids(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.lit("x").alias("id"), F.concat(F.lit("src/"), "p_brand").alias("path"), F.col("p_type").alias("section"), F.col("p_size").cast("int").alias("line"), F.lit(None).cast("int").alias("col"), "p_size")
    level = fn.level_of_detail(F.when(F.col("p_partkey") < 2000, F.lit(2000)).otherwise(F.lit(2001)))
    return p.select("p_partkey", fn.source_ref_id().alias("ref"), level.alias("level"), fn.graph_profile(F.col("p_size")).alias("profile"))


# --- the server's answers ---


@query("select 'initialize' as asked, '2025-06-18' as answer union all select 'tools', '11' union all select 'resources', '4' union all select 'semantic', 'unsupported_tool' union all select 'unknown', 'unknown_tool' union all select 'closed', 'invalid_params' union all select 'method', '-32601' union all select 'node', 'NATION_3' union all select 'smoke', 'true'")
def server_answers(spark, d):
    from ..service import Service

    server = mcp.Server(Service(bundle(tabular.nodes(spark, d, "region", "nation"), tabular.edges(spark, d, "nation"))))
    ask = lambda method, **p: server.handle({"jsonrpc": "2.0", "id": 1, "method": method, "params": p})
    code = lambda r: r["error"]["data"]["code"]
    import json

    rows = [
        ("initialize", ask("initialize")["result"]["protocolVersion"]), ("tools", str(len(ask("tools/list")["result"]["tools"]))), ("resources", str(len(ask("resources/list")["result"]["resources"]))),
        ("semantic", code(ask("tools/call", name="graph_summarize"))), ("unknown", code(ask("tools/call", name="other"))), ("closed", code(ask("tools/call", name="graph_query", arguments={"query": "x", "more": 1}))),
        ("method", str(ask("nothing")["error"]["code"])), ("node", json.loads(ask("resources/read", uri="graph://node/nation:3")["result"]["contents"][0]["text"])["label"]), ("smoke", str(mcp.smoke(server)["ok"]).lower()),
    ]
    return spark.createDataFrame(rows, "asked string, answer string")
