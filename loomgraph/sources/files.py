"""A directory tree as facts: walk on the driver, scope as an ordered chain of reasons, one parse per file on the executors.

Spark's file sources hide names that begin with `_` or `.`, so paths are listed here and opened in the parse step; the
tree must be on storage that every executor mounts.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import join, read_text, replace_text, there
from ..functions import meta
from ..operators.diff import first_wins
from ..operators.resolve import dependencies, local_imports
from ..schema import EDGES, MANIFEST, NODES, OMITTED
from ..snapshot import Snapshot, bundle
from .parsers import parse_file

if TYPE_CHECKING:
    from ..registry import Registry

IGNORED = (".git", ".hg", ".svn", "__pycache__", ".venv", "venv", "node_modules", "dist", "build")
FACTS = "file string, row string, position long, " + NODES + ", source_id string, target_id string, reason string, item_id string, details string"


@dataclass(frozen=True)
class Scope:
    """Which paths count. Rules are tried in order; the first that hits names the reason."""

    ignored: tuple[str, ...] = IGNORED
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    max_bytes: int = 1_000_000
    symlinks: bool = False
    gitignore: bool = True
    patterns: tuple[str, ...] = field(default=())


def gitignore(root: str) -> tuple[str, ...]:
    """Patterns of the root's .gitignore; comments and negations are skipped."""
    p = Path(root, ".gitignore")
    lines = p.read_text(errors="replace").splitlines() if p.is_file() else []
    return tuple(x.strip().rstrip("/") for x in lines if x.strip() and x.strip()[0] not in "#!")


def walk(spark: SparkSession, root: str) -> DataFrame:
    """path, is_dir, is_symlink, inside, size of everything below a root, in path order."""
    base = Path(root).resolve()
    rows = []
    for p in sorted(base.rglob("*")):
        link = p.is_symlink()
        inside = p.resolve().is_relative_to(base)
        rows.append((p.relative_to(base).as_posix(), p.is_dir(), link, inside, p.stat().st_size if p.exists() and not p.is_dir() else 0))
    return spark.createDataFrame(rows, "path string, is_dir boolean, is_symlink boolean, inside boolean, size long")


def _any_match(patterns: tuple[str, ...]) -> F.Column:
    """Whole path or base name matches one of the globs."""
    hit = F.lit(False)
    for p in patterns:
        regex = "^" + fnmatch.translate(p).replace(r"\Z", "$").replace(r"\z", "$") + "$"
        hit = hit | F.col("path").rlike(regex) | F.regexp_extract("path", "[^/]*$", 0).rlike(regex)
    return hit


def scoped(entries: DataFrame, scope: Scope) -> DataFrame:
    """entries with `reason`, null where the path counts."""
    parts = F.split("path", "/")
    ignored = F.arrays_overlap(parts, F.array(*(F.lit(x) for x in scope.ignored))) if scope.ignored else F.lit(False)
    under = F.lit(False)
    for p in scope.patterns if scope.gitignore else ():
        under = under | _any_match((p,)) | F.col("path").startswith(p + "/")
    file = ~F.col("is_dir")
    reason = (
        F.when(ignored, "ignored_name").when(~F.col("inside"), "outside_root").when(F.col("is_symlink") & F.lit(not scope.symlinks), "symlink_skipped")
        .when(file & ~(_any_match(scope.include) if scope.include else F.lit(True)), "not_included").when(_any_match(scope.exclude), "excluded")
        .when(under, "gitignored").when(file & (F.col("size") > scope.max_bytes), "max_file_size")
    )
    return entries.withColumn("reason", reason)


def _parse(root: str, namespace: str, registry: Registry | None = None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in FACTS.split(", ")]
        for frame in frames:
            for path, is_dir in zip(frame["path"], frame["is_dir"]):
                rows = parse_file(root, path, bool(is_dir), namespace, registry)
                out = pd.DataFrame([{**r, "file": path, "position": i} for i, r in enumerate(rows)], columns=columns).astype(object)
                out = out.where(out.notna(), None)
                yield out.astype({c: "Int32" for c in ("line", "col", "end_line", "end_col")} | {"position": "int64"})

    return run


def facts(spark: SparkSession, root: str, namespace: str, scope: Scope, registry: Registry | None = None) -> tuple[DataFrame, DataFrame]:
    """(facts of every file that counts, entries with reasons)."""
    scope = Scope(**{**scope.__dict__, "patterns": gitignore(root)})
    entries = scoped(walk(spark, root), scope).cache()
    kept = entries.where("reason is null").select("path", "is_dir")
    return kept.repartition("path").mapInPandas(_parse(str(Path(root).resolve()), namespace, registry), FACTS), entries


def index_path(spark: SparkSession, root: str, namespace: str = "default", scope: Scope = Scope(), created_at: str = "", registry: Registry | None = None) -> Snapshot:
    """Snapshot of a tree: every file's facts, the first one of an id winning in path order, and imports resolved."""
    got, entries = facts(spark, root, namespace, scope, registry)
    return assemble(got, entries, root, namespace, created_at)


def assemble(got: DataFrame, entries: DataFrame, root: str, namespace: str, created_at: str = "") -> Snapshot:
    from ..session import cut

    got = cut(got.withColumn("order", F.split("file", "/")))
    node_columns = [c.split()[0] for c in NODES.split(", ")]
    edge_columns = [c.split()[0] for c in EDGES.split(", ")]
    nodes = first_wins(got.where("row = 'node'").select("order", "position", *node_columns), "id", "order", "position").select(*node_columns)
    edges = first_wins(got.where("row = 'edge'").select("order", "position", *edge_columns), "id", "order", "position").select(*edge_columns)
    omitted = got.where("row = 'omitted'").select("reason", "item_id", "details")
    omitted = omitted.unionByName(entries.where("reason is not null").select("reason", F.col("path").alias("item_id"), F.lit("{}").alias("details")))
    found, lost = local_imports(nodes)
    extra = found.select(
        F.concat_ws("|", "import_id", F.lit("imports"), "target_id").alias("id"), F.lit("imports").alias("kind"), F.col("import_id").alias("source_id"), "target_id",
        F.lit('{"resolved":true}').alias("metadata"),
    )
    snap = bundle(nodes, edges, omitted, namespace=namespace, root_path=str(root), created_at=created_at)
    from ..snapshot import conform

    lost = lost.select(F.lit("unresolved_local_import").alias("reason"), F.col("id").alias("item_id"), F.to_json(F.struct("label")).alias("details"))
    pairs, open_ = declared_and_resolved(nodes)
    pinned = pairs.select(
        F.concat_ws("|", "declared_id", F.lit("resolves_to"), "resolved_id").alias("id"), F.lit("resolves_to").alias("kind"), F.col("declared_id").alias("source_id"), F.col("resolved_id").alias("target_id"),
        F.lit('{"resolution_kind":"same_name"}').alias("metadata"),
    )
    open_ = open_.select(F.lit("dependency_unresolved").alias("reason"), F.col("declared_id").alias("item_id"), F.lit("{}").alias("details"))
    return snap.with_(edges=snap.edges.unionByName(conform(extra, EDGES)).unionByName(conform(pinned, EDGES)), omitted=snap.omitted.unionByName(lost).unionByName(open_))


def declared_and_resolved(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, unresolved) of the packages that files declare and those that lock files pin."""
    side = lambda kind: nodes.where(F.col("kind") == kind).select("id", *(F.coalesce(meta("metadata", k), F.lit("")).alias(k) for k in ("ecosystem", "package")))
    return dependencies(side("dependency"), side("resolved_dependency"))


def _manifest(root: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .parsers import PARSER_VERSION, parser_name

        for frame in frames:
            rows = []
            for path in frame["path"]:
                data = Path(root, path).read_bytes()
                name = parser_name(path)
                rows.append((path, hashlib.sha256(data).hexdigest(), name, PARSER_VERSION, len(data), name or "file"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MANIFEST.split(", ")])

    return run


def manifest(spark: SparkSession, root: str, scope: Scope = Scope()) -> DataFrame:
    """path, content_hash, parser, parser_version, size_bytes, file_kind of every file that counts."""
    scope = Scope(**{**scope.__dict__, "patterns": gitignore(root)})
    kept = scoped(walk(spark, root), scope).where("reason is null and not is_dir").select("path")
    return kept.repartition("path").mapInPandas(_manifest(str(Path(root).resolve())), MANIFEST)


def manifest_of(contents: DataFrame) -> DataFrame:
    """manifest() of files that are rows already: path, content (binary)."""
    from .parsers import PARSER_VERSION, SUFFIXES

    name = F.lit("")
    for parser, ends in reversed(list(SUFFIXES.items())):
        hit = F.lit(False)
        for end in ends:
            hit = hit | F.endswith("path", F.lit(end))
        name = F.when(hit, parser).otherwise(name)
    out = contents.select("path", F.sha2("content", 256).alias("content_hash"), name.alias("parser"), F.lit(PARSER_VERSION).alias("parser_version"), F.octet_length("content").cast("long").alias("size_bytes"))
    return out.withColumn("file_kind", F.when(F.col("parser") == "", "file").otherwise(F.col("parser")))


# --- incremental refresh: facts are kept per file and parsed again only where the content or the parser changed ---


def extraction_key(namespace: str, scope: Scope) -> str:
    """A digest of all that a file's facts depend on besides the file."""
    from .parsers import PARSER_VERSION

    return hashlib.sha256(json.dumps([namespace, PARSER_VERSION, FACTS, scope.__dict__], sort_keys=True, default=list).encode()).hexdigest()


def refresh(spark: SparkSession, root: str, state: str, namespace: str = "default", scope: Scope = Scope()) -> tuple[Snapshot, dict]:
    """Snapshot of the tree as it is, from stored facts and the changed files' own; and what was parsed and reused.

    state: a folder of versions with a pointer that moves last, so a refresh that breaks off leaves the former state.
    """
    import uuid

    from ..operators.diff import path_changes

    now = manifest(spark, root, scope).cache()
    pointer = join(state, "CURRENT")
    key = extraction_key(namespace, scope)
    old = join(state, read_text(spark, pointer)) if there(spark, pointer) else None
    # facts under another namespace, scope or parser version are of no use
    if old and (not there(spark, join(old, "key")) or read_text(spark, join(old, "key")) != key):
        old = None
    before = spark.read.schema(MANIFEST).parquet(join(old, "manifest")) if old else now.limit(0)
    changes = path_changes(before, now)
    again = changes.where("status = 'added' or array_contains(reasons, 'content_hash_changed') or array_contains(reasons, 'parser_version_changed')").select("path")
    scope_ = Scope(**{**scope.__dict__, "patterns": gitignore(root)})
    entries = scoped(walk(spark, root), scope_).cache()
    dirs = entries.where("reason is null and is_dir").select("path", "is_dir")
    todo = entries.where("reason is null and not is_dir").join(again, "path", "left_semi").select("path", "is_dir")
    fresh = todo.unionByName(dirs).repartition("path").mapInPandas(_parse(str(Path(root).resolve()), namespace), FACTS)
    out = join(state, version := uuid.uuid4().hex)
    if old:
        unchanged = changes.where("status = 'unchanged'").select(F.col("path").alias("file"))
        kept = spark.read.parquet(join(old, "facts")).join(unchanged, "file", "left_semi")
        fresh = fresh.unionByName(kept)  # directories are always new: they cost nothing
    fresh.write.parquet(join(out, "facts"))
    now.write.parquet(join(out, "manifest"))
    got = spark.read.parquet(join(out, "facts"))
    snap = assemble(got, entries, root, namespace)
    counts = {r["status"]: r["n"] for r in changes.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    work = {"parsed": todo.count(), "reused": counts.get("unchanged", 0), "removed": counts.get("removed", 0)}
    replace_text(spark, join(out, "work.json"), json.dumps(work, sort_keys=True))
    replace_text(spark, join(out, "key"), key)
    replace_text(spark, pointer, version)
    return snap, work
