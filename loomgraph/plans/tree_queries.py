"""Queries over directory trees: one that stands here, and one of the tables' regions and nations as linked documents."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import functions as F

from .. import workspace
from ..session import shared_dir
from ..sources import files
from .tabular import table
from .tabular_queries import query

TREE = {
    "README.md": "# Demo\n\nsee [guide](docs/guide.md) and [[notes.md]], [setup](#setup) and [gone](#gone)\n\n## Setup\n",
    "docs/guide.md": "# Guide\n### Deep\n## Back\n[up](../README.md#setup)\n",
    "src/app.py": "import json\nfrom src.helper import help_me\n\n\nclass Base:\n    def run(self):\n        return help_me()\n\n\nclass App(Base):\n    pass\n",
    "src/helper.py": "def help_me():\n    return 1\n",
    "src/broken.py": "def f(:\n",
    "web/main.ts": "import { x } from './util';\nexport class View {}\nexport function draw() {}\nconst size = 3;\n",
    "web/util.ts": "export const x = 1;\n",
    "package.json": '{"dependencies": {"left": "1"}, "name": "demo"}',
    "package-lock.json": '{"packages": {"": {}, "node_modules/left": {"version": "1.2"}}}',
    "requirements.txt": "Requests>=2 # comment\n\nnumpy\n",
    "api/openapi.yaml": "openapi: 3.0.0\npaths:\n  /pets:\n    get:\n      x: 1\n    post:\n",
    "db/schema.sql": "create table if not exists owner (id int);\ncreate table pet (id int, o int references owner(id), z int references zoo(id));\n",
    "infra/main.tf": 'resource "aws_x" "y" {\n}\nprovider "z" {\n}\n',
    "svc/a.proto": "message Ask {}\nservice Desk {\n  rpc Open (Ask) returns (Ask);\n}\n",
    ".github/workflows/ci.yml": "on: push\njobs:\n  test:\n    steps:\n      - uses: actions/checkout@v4\n",
    "bad.json": "{",
    "node_modules/x.js": "var a = 1;\n",
    "secret/key.txt": "s\n",
    ".gitignore": "# local\nsecret/\n!keep\n",
    "big.txt": "b" * 3000,
    "blob.dat": "a\0b",
}
RULES = files.Scope(max_bytes=2000, exclude=("*.skip",))


def _written(spark, tree: dict[str, str]) -> str:
    base = Path(shared_dir(spark).removeprefix("file://").removeprefix("file:"), f"tree-{uuid.uuid4().hex}", "root")
    for name, text in tree.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text(text)
    return str(base)


def _short(c):
    return F.regexp_replace(c, "loom://t/", "")


def _values(rows: str, columns: str) -> str:
    return "select * from (values " + ", ".join("(" + ", ".join(f"'{x}'" for x in line.split("~")) + ")" for line in rows.strip().splitlines()) + f") t({columns})"


NODES = """
api_operation~api_operation/api/openapi.yaml:get /pets~GET /pets~4
api_operation~api_operation/api/openapi.yaml:post /pets~POST /pets~6
ci_job~ci_job/.github/workflows/ci.yml:test~test~
config_key~config_key/package-lock.json#packages.node_modules/left.version~packages.node_modules/left.version~
config_key~config_key/package-lock.json#packages.node_modules/left~packages.node_modules/left~
config_key~config_key/package-lock.json#packages.~packages.~
config_key~config_key/package-lock.json#packages~packages~
config_key~config_key/package.json#dependencies.left~dependencies.left~
config_key~config_key/package.json#dependencies~dependencies~
config_key~config_key/package.json#name~name~
dependency~dependency/actions/checkout@v4~actions/checkout@v4~
dependency~dependency/left~left~
dependency~dependency/requirements.txt:Requests~Requests~1
dependency~dependency/requirements.txt:numpy~numpy~3
directory~directory/.github/workflows~workflows~
directory~directory/.github~.github~
directory~directory/api~api~
directory~directory/db~db~
directory~directory/docs~docs~
directory~directory/infra~infra~
directory~directory/src~src~
directory~directory/svc~svc~
directory~directory/web~web~
doc_section~doc_section/README.md#demo~Demo~1
doc_section~doc_section/README.md#setup~Setup~5
doc_section~doc_section/docs/guide.md#back~Back~3
doc_section~doc_section/docs/guide.md#deep~Deep~2
doc_section~doc_section/docs/guide.md#guide~Guide~1
document~document/README.md~README.md~1
document~document/docs/guide.md~guide.md~
document~document/notes.md~notes.md~
file~file/.github/workflows/ci.yml~ci.yml~
file~file/.gitignore~.gitignore~
file~file/README.md~README.md~
file~file/api/openapi.yaml~openapi.yaml~
file~file/bad.json~bad.json~
file~file/db/schema.sql~schema.sql~
file~file/docs/guide.md~guide.md~
file~file/infra/main.tf~main.tf~
file~file/package-lock.json~package-lock.json~
file~file/package.json~package.json~
file~file/requirements.txt~requirements.txt~
file~file/src/app.py~app.py~
file~file/src/broken.py~broken.py~
file~file/src/helper.py~helper.py~
file~file/svc/a.proto~a.proto~
file~file/web/main.ts~main.ts~
file~file/web/util.ts~util.ts~
import~import/src/app.py#json~json~1
import~import/src/app.py#src.helper~src.helper~2
project~project/root~root~
proto_message~proto_message/svc/a.proto:Ask~Ask~1
proto_rpc~proto_rpc/svc/a.proto:Open~Open~3
proto_service~proto_service/svc/a.proto:Desk~Desk~2
python_class~python_class/src/app.py#App~App~10
python_class~python_class/src/app.py#Base~Base~5
python_function~python_function/src/helper.py#help_me~help_me~1
python_method~python_method/src/app.py#Base.run~run~6
python_module~python_module/src/app.py~app~1
python_module~python_module/src/helper.py~helper~1
resolved_dependency~resolved_dependency/package-lock.json:left~left~
script_class~script_class/web/main.ts#View~View~2
script_const~script_const/web/main.ts#size~size~4
script_const~script_const/web/util.ts#x~x~1
script_export~script_export/web/main.ts#export:View~View~2
script_export~script_export/web/main.ts#export:draw~draw~3
script_export~script_export/web/util.ts#export:x~x~1
script_function~script_function/web/main.ts#draw~draw~3
script_import~script_import/web/main.ts#./util~./util~1
sql_table~sql_table/db/schema.sql:owner~owner~1
sql_table~sql_table/db/schema.sql:pet~pet~2
sql_table~sql_table/external:zoo~zoo~
terraform_provider~terraform_provider/infra/main.tf:provider.z~provider.z~3
terraform_resource~terraform_resource/infra/main.tf:resource.aws_x.y~resource.aws_x.y~1
"""
EDGES = """
contains~directory/.github/workflows~file/.github/workflows/ci.yml
contains~directory/.github~directory/.github/workflows
contains~directory/api~file/api/openapi.yaml
contains~directory/db~file/db/schema.sql
contains~directory/docs~file/docs/guide.md
contains~directory/infra~file/infra/main.tf
contains~directory/src~file/src/app.py
contains~directory/src~file/src/broken.py
contains~directory/src~file/src/helper.py
contains~directory/svc~file/svc/a.proto
contains~directory/web~file/web/main.ts
contains~directory/web~file/web/util.ts
contains~doc_section/README.md#demo~doc_section/README.md#setup
contains~doc_section/docs/guide.md#guide~doc_section/docs/guide.md#back
contains~doc_section/docs/guide.md#guide~doc_section/docs/guide.md#deep
contains~document/README.md~doc_section/README.md#demo
contains~document/docs/guide.md~doc_section/docs/guide.md#guide
contains~project/root~directory/.github
contains~project/root~directory/api
contains~project/root~directory/db
contains~project/root~directory/docs
contains~project/root~directory/infra
contains~project/root~directory/src
contains~project/root~directory/svc
contains~project/root~directory/web
contains~project/root~file/.gitignore
contains~project/root~file/README.md
contains~project/root~file/bad.json
contains~project/root~file/package-lock.json
contains~project/root~file/package.json
contains~project/root~file/requirements.txt
defines~file/.github/workflows/ci.yml~ci_job/.github/workflows/ci.yml:test
defines~file/api/openapi.yaml~api_operation/api/openapi.yaml:get /pets
defines~file/api/openapi.yaml~api_operation/api/openapi.yaml:post /pets
defines~file/db/schema.sql~sql_table/db/schema.sql:owner
defines~file/db/schema.sql~sql_table/db/schema.sql:pet
defines~file/infra/main.tf~terraform_provider/infra/main.tf:provider.z
defines~file/infra/main.tf~terraform_resource/infra/main.tf:resource.aws_x.y
defines~file/package-lock.json~resolved_dependency/package-lock.json:left
defines~file/requirements.txt~dependency/requirements.txt:Requests
defines~file/requirements.txt~dependency/requirements.txt:numpy
defines~file/src/app.py~python_module/src/app.py
defines~file/src/helper.py~python_module/src/helper.py
defines~file/svc/a.proto~proto_message/svc/a.proto:Ask
defines~file/svc/a.proto~proto_rpc/svc/a.proto:Open
defines~file/svc/a.proto~proto_service/svc/a.proto:Desk
defines~file/web/main.ts~script_class/web/main.ts#View
defines~file/web/main.ts~script_const/web/main.ts#size
defines~file/web/main.ts~script_export/web/main.ts#export:View
defines~file/web/main.ts~script_export/web/main.ts#export:draw
defines~file/web/main.ts~script_function/web/main.ts#draw
defines~file/web/util.ts~script_const/web/util.ts#x
defines~file/web/util.ts~script_export/web/util.ts#export:x
defines~python_class/src/app.py#Base~python_method/src/app.py#Base.run
defines~python_module/src/app.py~python_class/src/app.py#App
defines~python_module/src/app.py~python_class/src/app.py#Base
defines~python_module/src/helper.py~python_function/src/helper.py#help_me
depends_on~config_key/package.json#dependencies.left~dependency/left
depends_on~file/.github/workflows/ci.yml~dependency/actions/checkout@v4
depends_on~file/requirements.txt~dependency/requirements.txt:Requests
depends_on~file/requirements.txt~dependency/requirements.txt:numpy
depends_on~proto_rpc/svc/a.proto:Open~proto_service/svc/a.proto:Desk
depends_on~sql_table/db/schema.sql:pet~sql_table/db/schema.sql:owner
depends_on~sql_table/db/schema.sql:pet~sql_table/external:zoo
documents~file/README.md~document/README.md
documents~file/docs/guide.md~document/docs/guide.md
has_key~file/package-lock.json~config_key/package-lock.json#packages
has_key~file/package-lock.json~config_key/package-lock.json#packages.
has_key~file/package-lock.json~config_key/package-lock.json#packages.node_modules/left
has_key~file/package-lock.json~config_key/package-lock.json#packages.node_modules/left.version
has_key~file/package.json~config_key/package.json#dependencies
has_key~file/package.json~config_key/package.json#dependencies.left
has_key~file/package.json~config_key/package.json#name
imports~file/src/app.py~import/src/app.py#json
imports~file/src/app.py~import/src/app.py#src.helper
imports~file/web/main.ts~script_import/web/main.ts#./util
imports~script_import/web/main.ts#./util~file/web/util.ts
inherits~python_class/src/app.py#App~python_class/src/app.py#Base
parent_symbol~python_method/src/app.py#Base.run~python_class/src/app.py#Base
references_doc~document/README.md~document/docs/guide.md
references_doc~document/README.md~document/notes.md
references_section~document/README.md~doc_section/README.md#setup
references_section~document/docs/guide.md~doc_section/README.md#setup
resolves_to~dependency/left~resolved_dependency/package-lock.json:left
"""
OMITTED = """
binary_file~blob.dat
config_key_extraction_unsupported~.github/workflows/ci.yml
config_key_extraction_unsupported~api/openapi.yaml
config_parse_error~bad.json
dependency_unresolved~dependency/actions/checkout@v4
dependency_unresolved~dependency/requirements.txt:Requests
dependency_unresolved~dependency/requirements.txt:numpy
gitignored~secret
gitignored~secret/key.txt
ignored_name~node_modules
ignored_name~node_modules/x.js
max_file_size~big.txt
optional_parser_unavailable~web/main.ts
optional_parser_unavailable~web/util.ts
python_syntax_error~src/broken.py
unresolved_local_import~import/src/app.py#json
unresolved_local_import~import/src/app.py#src.helper
unresolved_markdown_anchor~README.md:3:gone
unresolved_markdown_reference~README.md:3:docs/guide.md
unresolved_markdown_reference~README.md:3:notes.md
unresolved_markdown_reference~docs/guide.md:4:../README.md#setup
"""


@query(_values(NODES, "kind, key, label, line"))
def tree_nodes(spark, d):
    n = files.index_path(spark, _written(spark, TREE), "t", RULES).nodes
    return n.select("kind", _short("id").alias("key"), "label", F.coalesce(F.col("line").cast("string"), F.lit("")).alias("line"))


@query(_values(EDGES, "kind, source, target"))
def tree_edges(spark, d):
    return files.index_path(spark, _written(spark, TREE), "t", RULES).edges.select("kind", _short("source_id").alias("source"), _short("target_id").alias("target"))


@query(_values(OMITTED, "reason, item_id"))
def tree_omitted(spark, d):
    return files.index_path(spark, _written(spark, TREE), "t", RULES).omitted.select("reason", _short("item_id").alias("item_id"))


@query("""select 'full' as run, 15::bigint as parsed, 0::bigint as reused, 0::bigint as removed union all select 'same', 0, 15, 0 union all select 'changed', 2, 13, 1""")
def tree_refresh(spark, d):
    """A full refresh, one of the same tree, and one after a file changed, one came and one went."""
    tree = {k: v for k, v in TREE.items() if not k.startswith(("node_modules", "secret", "big", ".gitignore", "blob", "bad"))}
    root, state = _written(spark, tree), _written(spark, {"x": ""})
    out = [("full", files.refresh(spark, root, state, "t", RULES)[1]), ("same", files.refresh(spark, root, state, "t", RULES)[1])]
    Path(root, "src/app.py").write_text("class Other:\n    pass\n")
    Path(root, "new.md").write_text("# New\n")
    Path(root, "src/broken.py").unlink()
    out.append(("changed", files.refresh(spark, root, state, "t", RULES)[1]))
    return spark.createDataFrame([(run, w["parsed"], w["reused"], w["removed"]) for run, w in out], "run string, parsed long, reused long, removed long")


def _documents(spark, d) -> str:
    """A Markdown file a region and a nation, linked upwards; each names itself in a heading and a section of its customers' number."""
    tree = {}
    regions, nations = table(spark, d, "region").collect(), table(spark, d, "nation").collect()
    for r in regions:
        tree[f"region_{r['r_regionkey']}.md"] = f"# {r['r_name']}\n"
    for n in nations:
        tree[f"nation_{n['n_nationkey']}.md"] = f"# {n['n_name']}\n\nin [its region](region_{n['n_regionkey']}.md)\n\n## Facts\n\n### Key {n['n_nationkey']}\n\n[top](#{n['n_name'].lower().replace('_', '-')})\n"
    return _written(spark, tree)


@query("""select 'region_' || r_regionkey || '.md' as path, r_name as label, 1 as line, '' as parent from region
union all select 'nation_' || n_nationkey || '.md', n_name, 1, '' from nation union all select 'nation_' || n_nationkey || '.md', 'Facts', 5, n_name from nation union all select 'nation_' || n_nationkey || '.md', 'Key ' || n_nationkey, 7, 'Facts' from nation""")
def document_sections(spark, d):
    """Headings with the nearest one above that is of a smaller level."""
    s = files.index_path(spark, _documents(spark, d), "t")
    sections = s.nodes.where("kind = 'doc_section'").select("id", "path", "label", "line")
    up = s.edges.where("kind = 'contains'").select(F.col("target_id").alias("id"), "source_id").join(sections.select(F.col("id").alias("source_id"), F.col("label").alias("parent")), "source_id", "left")
    return sections.join(up, "id").select("path", "label", "line", F.coalesce("parent", F.lit("")).alias("parent"))


@query("""select 'references_doc' as kind, 'nation_' || n_nationkey || '.md' as source, 'region_' || n_regionkey || '.md' as target from nation
union all select 'references_section', 'nation_' || n_nationkey || '.md', 'nation_' || n_nationkey || '.md' from nation""")
def document_links(spark, d):
    s = files.index_path(spark, _documents(spark, d), "t")
    at = s.nodes.select("id", F.col("path").alias("p"))
    links = s.edges.where("kind in ('references_doc', 'references_section')").select("kind", "source_id", "target_id")
    a, b = (at.select(F.col("id").alias(f"{x}_id"), F.col("p").alias(x)) for x in ("source", "target"))
    return links.join(a, "source_id").join(b, "target_id").select("kind", "source", "target")


@query("""with f as (select 'region_' || r_regionkey || '.md' as path, '# ' || r_name || chr(10) as text from region union all select 'nation_' || n_nationkey || '.md', '# ' || n_name || chr(10) || chr(10) || 'in [its region](region_' || n_regionkey || '.md)' || chr(10) || chr(10) || '## Facts' || chr(10) || chr(10) || '### Key ' || n_nationkey || chr(10) || chr(10) || '[top](#' || replace(lower(n_name), '_', '-') || ')' || chr(10) from nation)
select path, sha256(text) as content_hash, strlen(text)::bigint as size_bytes, 'markdown' as parser from f""")
def document_manifest(spark, d):
    return files.manifest(spark, _documents(spark, d)).select("path", "content_hash", "size_bytes", "parser")


@query("""select 'one' as root, count(*) as documents from (select 1 from region union all select 1 from nation) union all select 'two', 2""")
def multi_root_index(spark, d):
    one, two = _documents(spark, d), _written(spark, {"a.md": "# A\n", "b.md": "# B\n"})
    s = workspace.index_multi_root(spark, [workspace.Root("one", one, "n1"), workspace.Root("two", two, "n2")])
    from ..functions import meta

    return s.nodes.where("kind = 'document'").groupBy(meta("metadata", "workspace_root").alias("root")).agg(F.count(F.lit(1)).alias("documents"))
