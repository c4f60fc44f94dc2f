"""One query per operator over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import functions as fn
from ..operators import diff, navigate, resolve, search, traverse, views
from ..snapshot import bundle
from . import tabular
from .tabular import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


N = """nodes as (
  select 'region:' || r_regionkey as id, 'region' as kind, r_name as label, '' as path, '' as text from region
  union all select 'nation:' || n_nationkey, 'nation', n_name, 'region:' || n_regionkey, '' from nation
  union all select 'customer:' || c_custkey, 'customer', c_name, 'nation:' || c_nationkey, c_mktsegment from customer
  union all select 'supplier:' || s_suppkey, 'supplier', s_name, 'nation:' || s_nationkey, '' from supplier
  union all select 'part:' || p_partkey, 'part', p_name, p_brand, p_type from part
  union all select 'orders:' || o_orderkey, 'orders', 'order:' || o_orderkey, 'customer:' || o_custkey, o_orderpriority || ' ' || o_orderstatus from orders)"""
E = """pairs as (
  select 'region:' || n_regionkey as source_id, 'contains' as kind, 'nation:' || n_nationkey as target_id from nation
  union all select 'nation:' || c_nationkey, 'contains', 'customer:' || c_custkey from customer
  union all select 'nation:' || s_nationkey, 'contains', 'supplier:' || s_suppkey from supplier
  union all select 'customer:' || o_custkey, 'contains', 'orders:' || o_orderkey from orders
  union all select distinct 'orders:' || l_orderkey, 'depends_on', 'part:' || l_partkey from lineitem),
edges as (select source_id || '|' || kind || '|' || target_id as id, * from pairs)"""
D = """ends as (select source_id as id, 0 as i, 1 as o from edges union all select target_id, 1, 0 from edges),
deg as (select id, sum(i)::bigint as degree_in, sum(o)::bigint as degree_out, count(*) as degree from ends group by id)"""
HAY = "lower(concat_ws(' ', id, kind, label, path, '', text, ''))"


def scoring(q: str) -> str:
    words = "[" + ", ".join(f"'{w}'" for w in sorted(set(q.split()))) + "]"
    return f"""hay as (select *, {HAY} as h from nodes),
s as (select *, list_sort(list_intersect({words}, list_distinct(string_split_regex(h, '[^a-zA-Z0-9_]+')))) as hit from hay),
hits as (select *, (case when lower(id) = '{q}' then 900 else 0 end + case when lower(path) = '{q}' then 700 else 0 end + case when lower(label) = '{q}' then 500 else 0 end
  + case when contains(h, '{q}') then 50 else 0 end + 10 * len(hit))::double as score from s)"""


# --- search ---

FIND = "automobile customer"


@query(f"with {N}, {scoring(FIND)} select id, kind, label, path, score from hits where score > 0 order by score desc, kind, path, id limit 50")
def search_lexical(spark, d):
    return search.page(search.scored(tabular.nodes(spark, d), FIND), 0, 50).select("id", "kind", "label", "path", "score")


@query(f"with {N}, {scoring(FIND)} select id, score from hits where score > 0 order by score desc, kind, path, id limit 20 offset 20")
def search_page2(spark, d):
    return search.page(search.scored(tabular.nodes(spark, d), FIND), 20, 20).select("id", "score")


@query(
    f"with {N}, {scoring('nation:7')} select id, score, array_to_string(hit, ',') as matched_tokens, case when lower(label) = 'nation:7' then 'label' when lower(path) = 'nation:7' then 'source_ref.path' when lower(id) = 'nation:7' then 'id' else '' end as exact_match, "
    "case when text <> '' then text when label <> '' then label when path <> '' then path else id end as snippet from hits where score > 0".replace("['nation:7']", "['7', 'nation']")
)
def search_explain(spark, d):
    return search.scored(tabular.nodes(spark, d), "nation:7").select("id", "score", F.array_join("matched_tokens", ",").alias("matched_tokens"), "exact_match", "snippet")


SQL["search_explain"] = SQL["search_explain"].replace("['nation:7']", "['7', 'nation']")


@query(f"with {N} select id, 1000.0::double as score from nodes where id in ('part:3', 'region:1', 'orders:9')")
def search_requested_ids(spark, d):
    return search.scored(tabular.nodes(spark, d), "", ("part:3", "region:1", "orders:9")).select("id", "score")


@query(f"with {N}, {scoring(FIND)}, top as (select id from hits where score > 0 order by score desc, kind, path, id limit 5), {E}, "
       "inc as (select source_id as node, id from edges union all select target_id, id from edges where source_id <> target_id) "
       "select top.id, coalesce(string_agg(inc.id, ',' order by inc.id), '') as edge_ids from top left join inc on inc.node = top.id group by top.id")  # fmt: skip
def search_with_edges(spark, d):
    hits = search.page(search.scored(tabular.nodes(spark, d), FIND), 0, 5)
    return search.with_edges(hits, tabular.edges(spark, d)).select("id", F.array_join("edge_ids", ",").alias("edge_ids"))


@query(f"with {N}, t as (select distinct id, unnest(string_split_regex({HAY}, '[^a-zA-Z0-9_]+')) as token from nodes) select token, count(*) as nodes from t where token <> '' group by token")
def token_document_frequency(spark, d):
    return search.document_frequency(tabular.nodes(spark, d))


# --- sources and predicates ---


@query("""select doc_id, case when lang = 'es' then 'ignored_name' when doc_id % 13 = 0 then 'outside_root' when doc_id % 11 = 0 then 'symlink_skipped'
when not (doc_id % 3 = 0 or source like 'src1%') then 'not_included' when doc_id % 3 = 0 and doc_id % 10 = 7 then 'excluded' when source = 'src3' then 'gitignored' when n_chars > 2000 then 'max_file_size' end as reason from documents""")
def scope_filter(spark, d):
    from ..sources.files import Scope, scoped

    t = table(spark, d, "documents")
    name = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".md").otherwise(".txt")))
    entries = t.select("doc_id", name.alias("path"), F.lit(False).alias("is_dir"), (F.col("doc_id") % 11 == 0).alias("is_symlink"), (F.col("doc_id") % 13 != 0).alias("inside"), F.col("n_chars").alias("size"))
    rules = Scope(ignored=("es",), include=("*.md", "src1*"), exclude=("*7.md",), max_bytes=2000, patterns=("src3",))
    return scoped(entries, rules).select("doc_id", "reason")


LINKS = "hrefs as (select page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) as h from pages), links as (select page_id, unnest(range(len(h))) as position, unnest(h) as target from hrefs)"


@query(f"with {LINKS} select page_id, position::int as position, target from links")
def page_links(spark, d):
    return tabular.page_links(spark, d)


@query(f"with {LINKS} select 'unresolved_reference' as reason, target as item_id, count(*) as n from links where target not in (select url from pages where url is not null) group by target")
def unresolved_links(spark, d):
    links = tabular.page_links(spark, d)
    lost = links.join(table(spark, d, "pages").select(F.col("url").alias("target")), "target", "left_anti")
    return lost.groupBy(F.lit("unresolved_reference").alias("reason"), F.col("target").alias("item_id")).agg(F.count(F.lit(1)).alias("n"))


@query("select p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug, trim(regexp_replace(p_type, '\\s+', ' ', 'g')) as one_line from part")
def slugs(spark, d):
    return table(spark, d, "part").select("p_partkey", fn.slug("p_name").alias("slug"), fn.one_line("p_type").alias("one_line"))


@query("select 'doc/' || doc_id || '.md' as path, sha256(text) as content_hash, 'markdown' as parser, '1' as parser_version, strlen(text)::bigint as size_bytes, 'markdown' as file_kind from documents")
def manifest_scan(spark, d):
    from ..sources.files import manifest_of

    t = table(spark, d, "documents")
    return manifest_of(t.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").cast("binary").alias("content")))


@query("""select 'node' as what, 'node:' || i as id, 'src/file-' || (i // 100) || '.py' as path, '' as ends from range(10000) t(i)
union all select 'edge', 'edge:' || i, '', 'node:' || i || '>node:' || (i + 1) from range(9999) t(i)""")
def scale_chain(spark, d):
    from ..viewer import chain

    s = chain(spark, 10_000)
    edges = s.edges.select(F.lit("edge").alias("what"), "id", F.lit("").alias("path"), F.concat_ws(">", "source_id", "target_id").alias("ends"))
    return s.nodes.select(F.lit("node").alias("what"), "id", "path", F.lit("").alias("ends")).unionByName(edges)


# --- joins and navigation ---


@query(f"""with {E}, i as (select source_id as node_id, id, kind from edges union all select target_id, id, kind from edges where source_id <> target_id)
select node_id, id, kind from i where node_id in ('nation:3', 'customer:7')""")
def incident_edges(spark, d):
    return search.incident(tabular.edges(spark, d)).where(F.col("node_id").isin("nation:3", "customer:7")).select("node_id", "id", "kind")


@query(f"with {E} select id as edge_id, source_id as id from edges where kind = 'depends_on' and target_id = 'part:5'")
def reverse_dependencies(spark, d):
    return navigate.reverse_dependencies(tabular.nodes(spark, d, "orders"), tabular.edges(spark, d, "lineitem"), "part:5", None).select("edge_id", "id")


IMPORTS = "with e as (select distinct l_orderkey, l_partkey from lineitem)"


@query(f"{IMPORTS} select distinct 'customer:' || o_custkey as id from e join orders on o_orderkey = l_orderkey where l_partkey = 5")
def reverse_imports(spark, d):
    e = tabular.edges(spark, d, "lineitem", "orders")
    e = e.withColumn("metadata", F.when(F.col("kind") == "depends_on", F.lit('{"resolved":true}')).otherwise("{}")).withColumn("kind", F.lit("imports"))
    return navigate.reverse_imports(tabular.nodes(spark, d, "orders", "customer", "part"), e, "part:5", None).select("id")


@query("select 'part:' || l_partkey as target_id, count(*) as incoming_count, array_to_string(list_sort(list_distinct(list('orders:' || l_orderkey)))[:5], ',') as referrers from lineitem group by l_partkey")
def doc_targets(spark, d):
    links = table(spark, d, "lineitem").select(F.concat(F.lit("orders:"), F.col("l_orderkey").cast("string")).alias("source_id"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("target_id"), F.lit("references_doc").alias("kind"))
    return views.doc_targets(links).select("target_id", "incoming_count", F.array_join("referrer_ids", ",").alias("referrers"))


@query("select distinct 'orders:' || l_orderkey || '|references_doc|part:' || l_partkey as edge_id, 'orders:' || l_orderkey as id from lineitem where l_partkey = 11")
def backlinks(spark, d):
    e = tabular.edges(spark, d, "lineitem").withColumn("kind", F.lit("references_doc")).withColumn("id", F.concat_ws("|", "source_id", "kind", "target_id"))
    return navigate.backlinks(tabular.nodes(spark, d, "orders"), e, "part:11", None).select("edge_id", "id")


#: Lines as calls, imports and inheritance between orders and parts, some of which share a file.
CODE = """code as (select distinct 'orders:' || l_orderkey || '|' || l_returnflag || '|part:' || l_partkey as id, case l_returnflag when 'R' then 'calls' when 'A' then 'imports' else 'inherits' end as kind,
  'orders:' || l_orderkey as source_id, 'part:' || l_partkey as target_id, l_orderkey % 5 as f, l_partkey % 5 as g, l_partkey % 7 = 0 as external, l_orderkey % 2 = 1 as resolved from lineitem),
classed as (select *, case when kind = 'imports' then case when resolved then 'static' else 'heuristic' end when f = g and not external then 'static' else 'heuristic' end as resolution from code)"""


def _code(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag").distinct()
    o, p = F.concat(F.lit("orders:"), F.col("l_orderkey").cast("string")), F.concat(F.lit("part:"), F.col("l_partkey").cast("string"))
    meta = F.when((F.col("l_returnflag") == "A") & (F.col("l_orderkey") % 2 == 1), '{"resolved":true}').otherwise("{}")
    edges = line.select(F.concat_ws("|", o, "l_returnflag", p).alias("id"), F.when(F.col("l_returnflag") == "R", "calls").when(F.col("l_returnflag") == "A", "imports").otherwise("inherits").alias("kind"), o.alias("source_id"), p.alias("target_id"), meta.alias("metadata"))
    n = tabular.nodes(spark, d, "orders", "part")
    key = F.substring_index("id", ":", -1).cast("long")
    return n.withColumn("path", F.concat(F.lit("f"), (key % 5).cast("string"))).withColumn("metadata", F.when((F.col("kind") == "part") & (key % 7 == 0), '{"external":true}').otherwise("{}")), edges



@query(f"with {CODE}, nothing as (select 1) select id as edge_id, kind as edge_kind, resolution, source_id as node from classed where target_id in ('part:5', 'part:14', 'part:23')")
def impact(spark, d):
    nodes, edges = _code(spark, d)
    out = None
    for target in ("part:5", "part:14", "part:23"):
        hits, lost = navigate.impact(nodes, edges, target)
        rows = hits.select("edge_id", "edge_kind", "resolution", F.col("id").alias("node")).unionByName(lost.select(F.col("item_id").alias("edge_id"), "edge_kind", "resolution", F.substring_index("item_id", "|", 1).alias("node")))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"with {E}, {CODE} select id, kind, resolution from classed union all select id, kind, 'static' from edges where kind = 'contains' union all select event_id::varchar, event_type, 'unsupported' from events")
def edge_resolution(spark, d):
    nodes, edges = _code(spark, d)
    more = tabular.edges(spark, d, "nation", "customer", "supplier", "orders")
    odd = table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("kind"), F.lit("a").alias("source_id"), F.lit("b").alias("target_id"), F.lit("").alias("metadata"))
    return navigate.resolution_class(edges.unionByName(more).unionByName(odd), nodes).select("id", "kind", "resolution")


@query("select 'commit:' || event_id as id, floor(epoch(ts))::bigint as epoch from events where user_id = 7 order by 2 desc, 1 limit 15")
def commits_for_path(spark, d):
    n, e, _ = tabular.commits(spark, d)
    return navigate.commits_for_path(n, e, "user/7", 15).select("id", fn.meta("metadata", "committer_time_epoch").cast("long").alias("epoch"))


@query("""with l as (select l_orderkey, l_partkey, min(l_linenumber) as n from lineitem where l_orderkey in (select l_orderkey from lineitem group by 1 order by count(distinct l_partkey) desc, 1 limit 1) group by 1, 2)
select case when n % 2 = 1 then 'touches' else 'changes_path' end as edge_kind, 'p/' || l_partkey as place, case when n % 2 = 1 then 100.0 else 90.0 end::double as score from l""")
def files_for_commit(spark, d):
    line = table(spark, d, "lineitem")
    first = line.groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("n"))
    most = line.groupBy("l_orderkey").agg(F.count_distinct("l_partkey").alias("n")).orderBy(F.col("n").desc(), "l_orderkey").first()[0]
    order, place = F.concat(F.lit("commit:"), F.col("l_orderkey").cast("string")), F.concat(F.lit("p/"), F.col("l_partkey").cast("string"))
    file = F.col("n") % 2 == 1
    target = F.concat(F.when(file, "file:").otherwise("path:"), place)
    # a touched file is a changed path too, and comes first
    both = first.select(F.explode(F.filter(F.array(F.struct(F.lit("changes_path").alias("kind"), F.concat(F.lit("path:"), place).alias("target_id")), F.struct(F.when(file, "touches").alias("kind"), target.alias("target_id"))), lambda x: x["kind"].isNotNull())).alias("x"), order.alias("source_id"))
    edges = both.select("x.*", "source_id").select(F.concat_ws("|", "source_id", "kind", "target_id").alias("id"), "kind", "source_id", "target_id")
    targets = both.select("x.target_id").distinct().select(F.col("target_id").alias("id"), F.when(F.col("target_id").startswith("file:"), "file").otherwise("changed_path").alias("kind"), F.substring_index("target_id", ":", -1).alias("path"), F.lit("").alias("label"), F.lit("{}").alias("metadata"))
    nodes = targets.unionByName(table(spark, d, "orders").select(F.concat(F.lit("commit:"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("git_commit").alias("kind"), F.lit("").alias("path"), F.lit("").alias("label"), F.lit("{}").alias("metadata")))
    return navigate.files_for_commit(nodes, edges, f"commit:{most}", 1000).select("edge_kind", "place", "score")


@query("select 'commit:' || event_id as id, floor(epoch(ts))::bigint as epoch from events order by 2 desc, 1 limit 25")
def recent_commits(spark, d):
    n, _, _ = tabular.commits(spark, d)
    return views.recent_commits(n, 25).select("id", fn.meta("metadata", "committer_time_epoch").cast("long").alias("epoch"))


@query(f"with {E} select p.c as id, count(*) as children from (select source_id as c from edges where kind = 'contains' and source_id like 'nation:%') p group by 1 order by 2 desc, 1 limit 10")
def top_directories(spark, d):
    n = tabular.nodes(spark, d, "nation").withColumn("kind", F.lit("directory")).withColumn("path", F.col("id"))
    return views.top_directories(n, tabular.edges(spark, d, "customer", "supplier"), 10).select(F.col("source_id").alias("id"), "children")


@query("select doc_id, item_id from documents, benchmark where contains(lower(documents.text), lower(benchmark.text)) and length(benchmark.text) >= 40")
def mentions(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    marks = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("label"))
    out = views.mentions(docs.withColumn("id", F.concat(F.lit("d"), F.col("id").cast("string"))), marks.withColumn("id", F.concat(F.lit("b"), F.col("id").cast("string"))), least=40)
    return out.select(F.substring("doc_id", 2, 30).cast("long").alias("doc_id"), F.substring("candidate_id", 2, 30).cast("long").alias("item_id"))


@query("select o_orderkey as declared_id, l_partkey as resolved_id from orders join (select distinct l_orderkey, l_partkey from lineitem) on o_orderkey = l_orderkey")
def dependency_resolution(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("Lines").alias("ecosystem"), F.col("o_orderkey").cast("string").alias("package"))
    b = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.lit("lines").alias("ecosystem"), F.col("l_orderkey").cast("string").alias("package")).distinct()
    return resolve.dependencies(a, b)[0]


@query("select o_orderkey as declared_id from orders where o_orderkey not in (select l_orderkey from lineitem)")
def dependency_unresolved(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("lines").alias("ecosystem"), F.col("o_orderkey").cast("string").alias("package"))
    b = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.lit("lines").alias("ecosystem"), F.col("l_orderkey").cast("string").alias("package"))
    return resolve.dependencies(a, b)[1]


#: Documents of even ids define their text, all others use it; a use whose text isn't defined away from its source may find its first words there.
USES = """u as (select *, sha256(text) as symbol, substr(text, 1, 12) as family from documents),
per as (select symbol, source, count(*) as n from u where doc_id % 2 = 0 group by 1, 2), per_f as (select distinct family, source from u where doc_id % 2 = 0),
o as (select u.doc_id, case when u.doc_id % 29 = 1 then 'invalid'
  when coalesce((select sum(n) from per where per.symbol = u.symbol and per.source <> u.source), 0) = 1 then 'exact'
  when coalesce((select sum(n) from per where per.symbol = u.symbol and per.source <> u.source), 0) > 1 then 'ambiguous'
  when exists (select 1 from per where per.symbol = u.symbol and per.source = u.source) then 'same_root'
  when exists (select 1 from per_f where per_f.family = u.family and per_f.source <> u.source) then 'version_mismatch' else 'missing' end as outcome from u where doc_id % 2 = 1)"""


def _uses(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("root"), F.col("doc_id").alias("node_id"), F.sha2("text", 256).alias("symbol"), F.substring("text", 1, 12).alias("family"))
    uses = docs.where("node_id % 2 = 1").withColumn("valid", F.col("node_id") % 29 != 1)
    return resolve.symbol_outcomes(uses, docs.where("node_id % 2 = 0"))


@query(f"with {USES} select doc_id, outcome from o")
def resolution_outcomes(spark, d):
    return _uses(spark, d).select(F.col("node_id").alias("doc_id"), "outcome")


@query(f"with {USES}, names as (select unnest(['exact', 'ambiguous', 'same_root', 'version_mismatch', 'missing', 'invalid']) as outcome) select outcome, (select count(*) from o where o.outcome = names.outcome)::bigint as n from names")
def resolution_counts(spark, d):
    return resolve.outcome_counts(_uses(spark, d)).select("outcome", F.col("n").cast("long").alias("n"))


@query(f"""with {USES} select 'cross_repo_' || case outcome when 'version_mismatch' then 'package_version_mismatch' when 'invalid' then 'identity_invalid' else 'definition_' || outcome end as reason, doc_id::varchar as item_id
from (select *, row_number() over (partition by outcome order by doc_id) as n from o where outcome <> 'exact') where n <= 7""")
def resolution_details(spark, d):
    from ..workspace import resolution_details

    return resolution_details(_uses(spark, d), 7).select("reason", F.col("item_id").cast("string").alias("item_id"))


STATE = """h as (select doc_id, case when doc_id % 50 = 7 then 'missing' when doc_id % 4 = 0 then 'changed' when doc_id % 3 = 0 then 'stale' else 'fresh' end as state, sha256(text) as now from documents)"""


def _evidence(spark, d):
    from .. import evidence

    docs = table(spark, d, "documents").withColumn("path", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")))
    nodes = docs.select(F.col("path").alias("id"), "path", F.lit("").alias("section"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("col"), "doc_id")
    before = docs.select("path", F.sha2(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("content_hash"))
    refs = evidence.refs(nodes, "s1", before).withColumn("freshness_state", F.when(F.substring_index("node_id", "/", -1).cast("long") % 3 == 0, "stale").otherwise("fresh"))
    return evidence.verify(refs, nodes.where("doc_id % 50 <> 7"), docs.select("path", F.sha2("text", 256).alias("content_hash")))


@query(f"with {STATE} select 'evidence://s1/doc/' || doc_id as ref_uri, 'doc/' || doc_id as source_ref_id, state, case when state = 'missing' and doc_id % 4 = 0 then null else now end as content_hash from h")
def evidence_state(spark, d):
    out = _evidence(spark, d).select("ref_uri", "source_ref_id", F.col("freshness_state").alias("state"), "content_hash")
    # of a document that is gone and had changed, the old hash stays: it is no hash of a text in the table
    lost = (F.col("state") == "missing") & (F.substring_index("ref_uri", "/", -1).cast("long") % 4 == 0)
    return out.withColumn("content_hash", F.when(~lost, F.col("content_hash")))


@query(f"with {STATE}, names as (select unnest(['fresh', 'stale', 'changed', 'missing']) as state) select state, (select count(*) from h where h.state = names.state)::bigint as n from names")
def evidence_counts(spark, d):
    from .. import evidence

    return evidence.state_counts(_evidence(spark, d))


@query(f"with {STATE} select 'evidence_' || state as reason, 'evidence://s1/doc/' || doc_id as item_id from h where state <> 'fresh'")
def evidence_omitted(spark, d):
    from .. import evidence

    return evidence.omitted_of(_evidence(spark, d))


@query(f"with {E}, {N} select id as edge_id, target_id as missing_id from edges where target_id like 'part:%' and target_id not in (select id from nodes where kind = 'part' and id < 'part:5')")
def referential_gaps(spark, d):
    return resolve.dangling(tabular.nodes(spark, d, "part", "orders").where("kind = 'orders' or id < 'part:5'"), tabular.edges(spark, d, "lineitem"))


# --- traversal ---


@query(f"""with {E}, {N}, l as (select source_id as a, target_id as b, id from edges union all select target_id, source_id, id from edges where source_id <> target_id),
r1 as (select b as node, min([id]) as way from l where a = 'customer:11' and b <> 'customer:11' group by b),
r2 as (select l.b as node, min(list_append(r1.way, l.id)) as way from r1 join l on l.a = r1.node where l.b <> 'customer:11' and l.b not in (select node from r1) group by l.b),
f as (select node, 1 as depth, way from r1 union all select node, 2, way from r2)
select f.node as id, depth::int as depth, (row_number() over (order by depth, way))::int as place from f join nodes n on n.id = f.node order by depth, way limit 40""")
def neighborhood_d2(spark, d):
    return traverse.neighborhood(tabular.nodes(spark, d), tabular.edges(spark, d), "customer:11", depth=2, max_results=40).select("id", "depth", "place")


PATH_TARGETS = "t as (select unnest(list_distinct([(select min(o_orderkey) from orders), (select max(o_orderkey) from orders), (select min(o_orderkey) + 7 from orders)])) as k)"


@query(f"""with {PATH_TARGETS} select 'orders:' || o_orderkey as target, hop::int as hop, edge_id from (select o_orderkey, unnest([1, 2, 3]) as hop,
unnest(['region:' || n_regionkey || '|contains|nation:' || n_nationkey, 'nation:' || n_nationkey || '|contains|customer:' || c_custkey, 'customer:' || c_custkey || '|contains|orders:' || o_orderkey]) as edge_id
from orders join t on o_orderkey = k join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey)""")
def path_edges(spark, d):
    """From the region of an order to it: the way is a tree's, so it is the only one."""
    o = table(spark, d, "orders")
    low, high = o.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    tree, out = tabular.edges(spark, d, "nation", "customer", "orders"), []
    up = o.where(F.col("o_orderkey").isin(low, low + 7, high)).join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    for r in up.select("o_orderkey", "n_regionkey").collect():
        way = traverse.path(tree, f"region:{r[1]}", f"orders:{r[0]}", max_hops=4)
        out += [(f"orders:{r[0]}", i, e) for i, e in enumerate(way or [], 1)]
    return spark.createDataFrame(out, "target string, hop int, edge_id string")


#: Labels sink to the least node along the edges, each node keeping its best so far.
SINK = """recursive {nodes}, cc(node, root) using key (node) as (select node, node from every
  union (select u.node, v.root from recurring.cc u join l on l.a = u.node join cc v on v.node = l.b where v.root < u.root order by u.node, v.root desc))"""


@query(f"""with {SINK.format(nodes="e as (select distinct 'o' || l_orderkey as a, 'p' || l_partkey as b from lineitem), l as (select a, b from e union all select b, a from e), every as (select distinct a as node from l)")}
select root as component_id, count(*) as node_count from cc group by root""")
def components(spark, d):
    e = table(spark, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("a"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("b"))
    return traverse.components(e).groupBy(F.col("root").alias("component_id")).agg(F.count(F.lit(1)).alias("node_count"))


WHOLE = SINK.format(nodes=f"{N}, {E}, l as (select source_id as a, target_id as b from edges union all select target_id, source_id from edges), every as (select id as node from nodes union select a from l)")


@query(f"with {WHOLE} select root as component_id, count(*) as node_count, (select count(*) from edges join cc c on c.node = edges.source_id where c.root = cc.root)::bigint as edge_count from cc group by root")
def graph_components(spark, d):
    return traverse.graph_components(tabular.nodes(spark, d), tabular.edges(spark, d))


# --- aggregates and views ---


@query(f"with {N}, {E} select 'node' as what, kind, count(*) as n from nodes group by kind union all select 'edge', kind, count(*) from edges group by kind")
def kind_counts(spark, d):
    a, b = views.counts(tabular.nodes(spark, d)), views.counts(tabular.edges(spark, d))
    return a.select(F.lit("node").alias("what"), "kind", "n").unionByName(b.select(F.lit("edge").alias("what"), "kind", "n"))


@query(f"with {E}, {D} select id, degree_in, degree_out, degree from deg")
def degrees(spark, d):
    return views.degrees(tabular.edges(spark, d))


@query(f"with {N}, {E}, {D} select n.id, coalesce(degree, 0) as degree from nodes n left join deg on deg.id = n.id order by 2 desc, n.kind, n.path, n.id limit 30")
def degree_topk(spark, d):
    return views.topology_rank(tabular.nodes(spark, d), tabular.edges(spark, d), 30).select("id", "degree")


@query(f"with {N}, {E}, {D} select n.id, coalesce(degree, 0) as degree, coalesce(degree_out, 0)::bigint as degree_out from nodes n left join deg on deg.id = n.id order by 2 desc, 3 desc, n.kind, n.path, n.id limit 30")
def report_rank(spark, d):
    return views.report_rank(tabular.nodes(spark, d), tabular.edges(spark, d), 30).select("id", "degree", "degree_out")


@query(f"with {N}, {E} select id, kind from nodes where id not in (select source_id from edges where kind = 'depends_on' union select target_id from edges where kind = 'depends_on')")
def orphans(spark, d):
    return views.orphans(tabular.nodes(spark, d), tabular.edges(spark, d, "lineitem")).select("id", "kind")


@query(f"""with {N}, {E}, {LINKS}, c as (select (select count(*) from nodes) as nodes, (select count(*) from edges) as edges, (select count(*) from links where target not in (select url from pages where url is not null)) as omitted)
select nodes, edges, omitted, round(omitted / (nodes + edges), 6)::double as omitted_rate from c""")
def health(spark, d):
    lost = tabular.page_links(spark, d).join(table(spark, d, "pages").select(F.col("url").alias("target")), "target", "left_anti")
    return views.omitted_rate(tabular.nodes(spark, d), tabular.edges(spark, d), lost.select(F.lit("unresolved_reference").alias("reason"), F.col("target").alias("item_id")))


@query(f"with {E} select e.id, s.o_orderkey as source_key, t.p_partkey as target_key from edges e join orders s on e.source_id = 'orders:' || s.o_orderkey join part t on e.target_id = 'part:' || t.p_partkey where kind = 'depends_on'")
def report_dependencies(spark, d):
    out = views.report_dependencies(tabular.nodes(spark, d, "orders", "part"), tabular.edges(spark, d, "lineitem"))
    key = lambda c: F.substring_index(c, ":", -1).cast("long")
    return out.select("id", key("source_id").alias("source_key"), key("target_id").alias("target_key"))


@query("select sum(case when text like '%@%' then 1 else 0 end)::bigint as full_email_fields, sum(case when text like '%http%' then 1 else 0 end)::bigint as hashed_email_fields, sum(case when doc_id % 10 = 0 then 1 else 0 end)::bigint as absolute_refs, false as export_safe from documents")
def privacy_profile(spark, d):
    meta = F.concat(F.lit("{"), F.concat_ws(",", F.when(F.contains("text", F.lit("@")), F.lit('"author_email":"x"')), F.when(F.contains("text", F.lit("http")), F.lit('"author_email_hash":"y"'))), F.lit("}"))
    n = table(spark, d, "documents").select(F.when(F.col("doc_id") % 10 == 0, "/abs").otherwise("rel").alias("path"), meta.alias("metadata"))
    return views.privacy_profile(n, n.limit(0))


@query("select 'part:' || p_partkey as id, ((row_number() over (order by 'part:' || p_partkey) - 1) // 24)::bigint as cluster from part")
def clusters(spark, d):
    return views.clusters(tabular.nodes(spark, d, "part"), tabular.edges(spark, d, "lineitem"))


@query(f"""with {E}, {N}, c as (select id, ((row_number() over (order by id) - 1) // 240) as cluster from nodes where kind in ('customer', 'orders', 'nation')),
p as (select e.id, e.kind, a.cluster as x, b.cluster as y from edges e join c a on a.id = e.source_id join c b on b.id = e.target_id where a.cluster <> b.cluster)
select least(x, y)::bigint as low, greatest(x, y)::bigint as high, count(*) as edge_count, count(distinct kind) as kinds, min(id) as first_edge_id from p group by 1, 2""")
def edge_bundles(spark, d):
    n = tabular.nodes(spark, d, "customer", "orders", "nation")
    e = tabular.edges(spark, d, "customer", "orders")
    return views.edge_bundles(views.clusters(n, e, 240), e)


@query(f"with {E} select id from edges where source_id like 'nation:%' and target_id like 'customer:%'")
def visible_edges(spark, d):
    return views.visible_edges(tabular.nodes(spark, d, "nation", "customer"), tabular.edges(spark, d)).select("id")


@query("select p_brand, p_partkey, n as rank from (select p_brand, p_partkey, (row_number() over (partition by p_brand order by p_size desc, p_partkey))::int as n from part) where n <= 3")
def top_n_per_group(spark, d):
    p = table(spark, d, "part").withColumn("less", -F.col("p_size"))
    return diff.ranked_rows(p, "p_brand", "less", "p_partkey", n=3).select("p_brand", "p_partkey", "rank")


# --- diffs and merges ---

def _orders_before_after(spark, d):
    o = tabular.nodes(spark, d, "orders").withColumn("k", F.substring_index("id", ":", -1).cast("long"))
    old = o.where("k % 7 <> 0").drop("k")
    new = o.where("k % 5 <> 0").withColumn("label", F.when(F.col("k") % 11 == 0, "renamed").otherwise(F.col("label"))).drop("k")
    e = tabular.edges(spark, d, "orders").withColumn("k", F.substring_index("id", ":", -1).cast("long"))
    links = e.where("k % 3 <> 0").drop("k")
    now = e.where("k % 4 <> 0").withColumn("metadata", F.when(F.col("k") % 13 == 0, '{"moved":true}').otherwise(F.col("metadata"))).drop("k")
    return bundle(old, links), bundle(new, now)


BOTH = """o as (select o_orderkey as k, 'orders:' || o_orderkey as node, 'customer:' || o_custkey || '|contains|orders:' || o_orderkey as edge from orders),
structure as (select 'node' as item_kind, case when k % 7 = 0 then 'added' else 'removed' end as status, node as item_id from o where (k % 7 = 0) <> (k % 5 = 0)
  union all select 'edge', case when k % 3 = 0 then 'added' else 'removed' end, edge from o where (k % 3 = 0) <> (k % 4 = 0)),
changes as (select 'node' as item_kind, 'changed' as status, node as item_id from o where k % 7 <> 0 and k % 5 <> 0 and k % 11 = 0
  union all select 'edge', 'changed', edge from o where k % 3 <> 0 and k % 4 <> 0 and k % 13 = 0)"""


@query(f"with {BOTH} select * from structure")
def diff_nodes(spark, d):
    return diff.structural(*_orders_before_after(spark, d))


@query(f"with {BOTH} select * from structure union all select * from changes")
def ci_delta(spark, d):
    return diff.ci_delta(*_orders_before_after(spark, d))


@query(f"""with {BOTH}, all_ as (select * from structure union all select * from changes)
select item_kind || case when status = 'removed' then '_delete' else '_upsert' end as op, case item_kind || status when 'edgeremoved' then 0 when 'noderemoved' then 1 when 'nodeadded' then 2 when 'nodechanged' then 2 else 3 end::int as position, item_id from all_""")
def snapshot_patch(spark, d):
    return diff.snapshot_patch(*_orders_before_after(spark, d)).select("op", "position", "item_id")


@query("""select doc_id, case when doc_id % 9 = 0 then 'added' when doc_id % 8 = 0 then 'removed' when doc_id % 6 = 0 or doc_id % 10 = 0 then 'changed' else 'unchanged' end as status,
case when doc_id % 9 = 0 then 'new_path' when doc_id % 8 = 0 then 'path_missing' else concat_ws(',', case when doc_id % 6 = 0 then 'content_hash_changed' end, case when doc_id % 10 = 0 then 'parser_version_changed' end) end as reasons
from documents where not (doc_id % 9 = 0 and doc_id % 8 = 0)""")
def path_changes(spark, d):
    docs = table(spark, d, "documents")
    base = docs.select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("content_hash"), F.lit("text").alias("parser"), F.lit("1").alias("parser_version"), F.octet_length("text").cast("long").alias("size_bytes"), F.lit("file").alias("file_kind"))
    old = base.where("doc_id % 9 <> 0")
    new = base.where("doc_id % 8 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 6 == 0, "x").otherwise(F.col("content_hash"))).withColumn("parser_version", F.when(F.col("doc_id") % 10 == 0, "2").otherwise("1"))
    out = diff.path_changes(old.drop("doc_id"), new.drop("doc_id"))
    return out.select(F.substring_index("path", "/", -1).cast("long").alias("doc_id"), "status", F.array_join("reasons", ",").alias("reasons"))


@query("select l_orderkey || '|' || l_partkey as id, min(l_linenumber)::int as line from lineitem group by 1")
def first_wins(spark, d):
    t = table(spark, d, "lineitem").select(F.concat_ws("|", "l_orderkey", "l_partkey").alias("id"), F.col("l_linenumber").cast("int").alias("line"))
    return diff.first_wins(t, "id", "line").select("id", "line")


@query("select l_orderkey || '|' || l_partkey as id, max(l_linenumber)::int as line from lineitem group by 1")
def last_wins(spark, d):
    t = table(spark, d, "lineitem").select(F.concat_ws("|", "l_orderkey", "l_partkey").alias("id"), F.col("l_linenumber").cast("int").alias("line"))
    return diff.last_wins(t, "id", "line").select("id", "line")


@query("select 'a/' || n_nationkey as id, n_name as label from nation union all select 'b/' || n_nationkey, n_name from nation")
def compose_union(spark, d):
    n = table(spark, d, "nation")
    part = lambda root: n.select(F.concat(F.lit(f"{root}/"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("label"))
    return diff.disjoint_union([part("a"), part("b")], "NODE")


@query("""with h as (select sha256(text) as hash, min(doc_id) as doc_id, count(*) as n from documents group by 1)
select 'old/' || doc_id as previous_id, 'new/' || doc_id as current_id from h where n = 1""")
def identity_transitions(spark, d):
    side = lambda root: table(spark, d, "documents").select(F.concat(F.lit(f"{root}/"), F.col("doc_id").cast("string")).alias("id"), F.sha2("text", 256).alias("hash"))
    return diff.unique_transitions(side("old"), side("new"), "hash")


@query("""with n as (select 'customer:' || c_custkey as id, case when c_custkey % 2 = 0 then '/home/' || c_custkey || '/a.py' else 'src/' || c_custkey || '.py' end as path, c_mktsegment as text, c_name as name from customer)
select 'full' as profile, id, path, text, '{"author_name":"' || name || '","segment":"' || text || '"}' as metadata from n
union all select 'no_content', id, path, '', '{"author_name":"' || name || '","segment":"' || text || '"}' from n
union all select 'no_identities', id, path, text, '{"segment":"' || text || '"}' from n
union all select 'portable', id, case when path like '/%' then 'a.py' else path end, '', '{"segment":"' || text || '"}' from n""")
def redaction(spark, d):
    n = tabular.nodes(spark, d, "customer")
    key = F.substring_index("id", ":", -1)
    n = n.withColumn("metadata", F.concat(F.lit('{"author_name":"'), "label", F.lit('","segment":"'), "text", F.lit('"}'))).withColumn("uri", F.lit(""))
    n = n.withColumn("path", F.when(key.cast("long") % 2 == 0, F.concat(F.lit("/home/"), key, F.lit("/a.py"))).otherwise(F.concat(F.lit("src/"), key, F.lit(".py"))))
    s = bundle(n, spark.createDataFrame([], "id string, kind string, source_id string, target_id string"))
    out = None
    for profile in resolve.PROFILES:
        rows = resolve.redacted(s, profile).nodes.select(F.lit(profile).alias("profile"), "id", "path", "text", "metadata")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""with {N}, {E} select 1 as part, id as key, '  "' || id || '" [label="' || label || '\\n' || kind || case when path <> '' then '\\n' || path else '' end || '"];' as line from nodes
union all select 2, id, '  "' || source_id || '" -> "' || target_id || '" [label="' || kind || '"];' from edges""")
def export_dot(spark, d):
    from ..sources.exports import dot_lines

    return dot_lines(tabular.nodes(spark, d), tabular.edges(spark, d))


@query("select 'loom://tables/part/' || p_partkey as uri, 'loom://tables/edge/x%7Ccontains%7C' || p_partkey as edge from part")
def node_uris(spark, d):
    key = F.col("p_partkey").cast("string")
    return table(spark, d, "part").select(fn.uri("tables", F.lit("part"), key).alias("uri"), fn.edge_uri("tables", F.lit("x"), F.lit("contains"), key).alias("edge"))
