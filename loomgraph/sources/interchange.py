"""Facts from and for other indexers: graph JSON, symbol-index JSON, compiler facts, symbol strings."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import GraphError
from ..snapshot import Snapshot, bundle


def from_graph_json(spark: SparkSession, text: str, namespace: str = "default") -> Snapshot:
    """Rows without an id or an end are dropped; omitted facts aren't in the format."""
    try:
        body = json.loads(text)
    except ValueError as e:
        raise GraphError("INVALID_SNAPSHOT", "the graph isn't JSON", error=str(e)) from e
    nodes = [(n["id"], n.get("type") or "node", n.get("name") or n["id"], n.get("file") or "", json.dumps(n.get("properties") or {}, sort_keys=True)) for n in body.get("nodes", []) if n.get("id")]
    edges = [(e.get("id") or f"{e['source']}|{e.get('type')}|{e['target']}", e.get("type") or "references", e["source"], e["target"]) for e in body.get("edges", []) if e.get("source") and e.get("target")]
    return bundle(spark.createDataFrame(nodes, "id string, kind string, label string, path string, metadata string"), spark.createDataFrame(edges, "id string, kind string, source_id string, target_id string"), namespace=namespace)


def from_compiler_facts(symbols: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, omitted) of symbols (symbol, kind, label, path, line) and references (source_symbol, target_symbol, path, line).

    An empty source is the file itself; a target that isn't declared is an omitted fact.
    """
    sid = lambda c: F.concat(F.lit("symbol:"), c)
    fid = lambda c: F.concat(F.lit("file:"), c)
    nodes = symbols.select(sid("symbol").alias("id"), F.coalesce("kind", F.lit("symbol")).alias("kind"), F.coalesce("label", "symbol").alias("label"), "path", "line", F.to_json(F.struct("symbol")).alias("metadata"))
    files = symbols.select("path").unionByName(references.select("path")).where("path <> ''").distinct().select(fid("path").alias("id"), F.lit("file").alias("kind"), F.col("path").alias("label"), "path", F.lit(None).cast("int").alias("line"), F.lit("{}").alias("metadata"))
    defines = symbols.where("path <> ''").select(F.concat_ws("|", fid("path"), F.lit("defines"), sid("symbol")).alias("id"), F.lit("defines").alias("kind"), fid("path").alias("source_id"), sid("symbol").alias("target_id"), "path", "line")
    known = symbols.select(F.col("symbol").alias("target_symbol")).distinct()
    bound = references.join(known, "target_symbol", "left_semi")
    source = F.when(F.coalesce("source_symbol", F.lit("")) != "", sid("source_symbol")).otherwise(fid("path"))
    refs = bound.select(F.concat_ws("|", source, F.lit("references"), sid("target_symbol"), F.concat_ws(":", "path", "line")).alias("id"), F.lit("references").alias("kind"), source.alias("source_id"), sid("target_symbol").alias("target_id"), "path", "line")
    lost = references.join(known, "target_symbol", "left_anti").select(F.lit("compiler_reference_unresolved").alias("reason"), F.col("target_symbol").alias("item_id"), F.to_json(F.struct("path", "line")).alias("details"))
    return nodes.unionByName(files), defines.unionByName(refs), lost


INDEX = "documents array<struct<relative_path:string, language:string, occurrences:array<struct<range:array<int>, symbol:string, symbol_roles:int>>, symbols:array<struct<symbol:string, kind:string, display_name:string>>>>"


def from_index_json(spark: SparkSession, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, references) for from_compiler_facts() of symbol-index documents in a column `value`; the first definition of a symbol wins."""
    docs = texts.select(F.explode(F.from_json("value", INDEX)["documents"]).alias("d")).select("d.*")
    occ = docs.select(F.col("relative_path").alias("path"), F.explode("occurrences").alias("o")).select("path", "o.symbol", (F.col("o.range")[0] + 1).alias("line"), (F.col("o.range")[1] + 1).alias("col"), (F.coalesce("o.symbol_roles", F.lit(0)).bitwiseAND(1) == 1).alias("defines"))
    names = docs.select(F.explode("symbols").alias("s")).groupBy("s.symbol").agg(F.min("s.kind").alias("kind"), F.min("s.display_name").alias("label"))
    first = occ.where("defines").groupBy("symbol").agg(F.min(F.struct("path", "line", "col")).alias("at")).select("symbol", "at.path", "at.line")
    symbols = first.join(names, "symbol", "left").select("symbol", "kind", "label", "path", "line")
    return symbols, occ.where("not defines").select(F.lit("").alias("source_symbol"), F.col("symbol").alias("target_symbol"), "path", "line")


def symbol_parts(symbol: Column | str) -> Column:
    """A precise symbol as a struct: scheme, manager, package, version, descriptors, local; null if it isn't one.

    Fields end at single spaces; a doubled space is a space within one; `.` stands for an empty field.
    """
    c = F.col(symbol) if isinstance(symbol, str) else symbol
    field = r"((?:[^ ]|  )+) "
    pattern = f"^{field * 4}(.+)$"
    part = lambda i: F.replace(F.nullif(F.regexp_extract(c, pattern, i), F.lit(".")), F.lit("  "), F.lit(" "))
    local = F.struct(F.lit("local").alias("scheme"), F.lit("").alias("manager"), F.lit("").alias("package"), F.lit("").alias("version"), F.lit("").alias("descriptors"), F.substring_index(c, " ", -1).alias("local"))
    whole = F.struct(part(1).alias("scheme"), F.coalesce(part(2), F.lit("")).alias("manager"), F.coalesce(part(3), F.lit("")).alias("package"), F.coalesce(part(4), F.lit("")).alias("version"), F.regexp_extract(c, pattern, 5).alias("descriptors"), F.lit("").alias("local"))
    return F.when(c.rlike(r"^local [A-Za-z0-9_+$-]+$"), local).when(c.rlike(pattern) & ~c.startswith(" "), whole)


def version_free(symbol: Column | str) -> Column:
    p = symbol_parts(symbol)
    return F.concat_ws("|", p["scheme"], p["manager"], p["package"], p["descriptors"])


def symbol_error(symbol: str) -> None:
    if not re.match(r"local [A-Za-z0-9_+$-]+$|(?:(?:[^ ]|  )+ ){4}.+$", symbol):
        raise GraphError("INVALID_SCIP_SYMBOL", "not a precise symbol", symbol=symbol)
