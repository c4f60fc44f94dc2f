"""Precise indexes in the public SCIP format: the binary form read by its wire encoding, and a JSON form written.

An index file is a run of fields; each document among them is cut out as it is met and decoded by itself, so memory
follows the largest document. What is known of symbols across documents is found by joins and aggregates.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EDGES, NODES, OMITTED, GraphError
from ..snapshot import Snapshot, bundle, conform

FACTS = "what string, path string, language string, symbol string, line int, col int, end_line int, end_col int, roles int, kind int, label string, target string, flags array<string>, text_bytes long, position long"
FLAGS = ((2, "is_reference"), (3, "is_implementation"), (4, "is_type_definition"), (5, "is_definition"))
KINDS = {7: "class", 11: "enum", 15: "field", 16: "file", 17: "function", 21: "interface", 26: "method", 29: "module", 30: "namespace", 61: "variable"}
DEFINES = 1


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of every field of a message."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            if at >= end or shift > 63:
                raise GraphError("SCIP_PAYLOAD_INVALID", "a number is cut off", offset=at)
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, wire, varint()
            continue
        size = varint() if wire == 2 else {1: 8, 5: 4}.get(wire, -1)
        if size < 0 or at + size > end or not number:
            raise GraphError("SCIP_PAYLOAD_INVALID", "a field is cut off or of an unknown kind", offset=at)
        yield number, wire, data[at : at + size]
        at += size


def numbers(value: int | bytes) -> list[int]:
    """A repeated number, packed or single; negative ones as 32 bits."""
    if isinstance(value, int):
        return [value if value < 1 << 31 else value - (1 << 64)]
    out, at = [], 0
    while at < len(value):
        n = shift = 0
        while True:
            byte = value[at]
            at += 1
            n |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                break
        out.append(n)
    return out


def place(message: list[tuple[int, int, int | bytes]]) -> tuple[int, int, int, int] | None:
    """1-based line, column, end line and end column of an occurrence: three or four numbers, or a typed range."""
    plain = [n for number, _, value in message if number == 1 for n in numbers(value)]
    for number, _, value in message:
        if number in (8, 9):
            x = {n: v for n, _, v in fields(value)}
            plain = [x.get(1, 0), x.get(2, 0), x.get(3, 0)] if number == 8 else [x.get(k, 0) for k in (1, 2, 3, 4)]
    if len(plain) == 3:
        plain = [plain[0], plain[1], plain[0], plain[2]]
    return tuple(n + 1 for n in plain) if len(plain) == 4 else None


def _text(value: int | bytes) -> str:
    return value.decode(errors="replace") if isinstance(value, bytes) else ""


def _symbol(data: bytes, path: str, language: str, where: str) -> list[dict]:
    got = {"symbol": "", "label": "", "kind": 0}
    rows, kept = [], 0
    for number, _, value in fields(data):
        match number:
            case 1:
                got["symbol"] = _text(value)
            case 3:
                kept += len(value)
            case 5:
                got["kind"] = value
            case 6:
                got["label"] = _text(value)
            case 4:
                r = list(fields(value))
                flags = [name for k, name in FLAGS if any(n == k and v for n, _, v in r)]
                rows.append({"what": "relationship", "target": next((_text(v) for n, _, v in r if n == 1), ""), "flags": flags, "path": path})
    for r in rows:
        r["symbol"] = got["symbol"]
    return [{"what": where, "path": path, "language": language, "text_bytes": kept, **got}, *rows]


def document(data: bytes) -> list[dict]:
    """The facts of one document's payload."""
    parts = list(fields(data))
    path = next((_text(v) for n, _, v in parts if n == 1), "")
    language = next((_text(v) for n, _, v in parts if n == 4), "")
    rows = [{"what": "document", "path": path, "language": language, "text_bytes": sum(len(v) for n, _, v in parts if n == 5)}]
    for number, _, value in parts:
        if number == 2:
            o = list(fields(value))
            at = place(o)
            symbol = next((_text(v) for n, _, v in o if n == 2), "")
            if at is None or not symbol:
                rows.append({"what": "malformed", "path": path, "symbol": symbol})
                continue
            rows.append({"what": "occurrence", "path": path, "language": language, "symbol": symbol, "roles": next((v for n, _, v in o if n == 3), 0), **dict(zip(("line", "col", "end_line", "end_col"), at))})
        elif number == 3:
            rows += _symbol(value, path, language, "symbol")
        elif number not in (1, 4, 5, 6):
            rows.append({"what": "unknown", "path": path, "text_bytes": len(value) if isinstance(value, bytes) else 8})
    return rows


def parts_of(data: bytes) -> Iterator[dict]:
    """All facts of an index, document by document; external symbols have no path."""
    for number, _, value in fields(data):
        if number == 1:
            m = {n: v for n, _, v in fields(value)}
            tool = {n: _text(v) for n, _, v in fields(m[2])} if 2 in m else {}
            yield {"what": "metadata", "label": " ".join(x for x in (tool.get(1, ""), tool.get(2, "")) if x), "target": _text(m.get(3, b""))}
        elif number == 2:
            yield from document(value)
        elif number == 3:
            yield from _symbol(value, "", "", "external")
        else:
            yield {"what": "unknown", "path": "", "text_bytes": len(value) if isinstance(value, bytes) else 8}


def facts(files: DataFrame) -> DataFrame:
    """FACTS of index files given as a table (content binary), each decoded where it lies."""
    columns = [c.split()[0] for c in FACTS.replace("array<string>", "x").split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for data in frame["content"]:
                rows, n = [], 0
                for n, r in enumerate(parts_of(bytes(data))):
                    rows.append({**dict.fromkeys(columns), **r, "position": n})
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                yield pd.DataFrame(rows, columns=columns)

    return files.select("content").mapInPandas(run, FACTS)


def freshness(root: Column, wanted_root: str, commit: Column, wanted_commit: str) -> Column:
    """match, mismatch or unknown; one mismatch is enough."""
    one = lambda c, w: F.when(F.lit(w == "") | (F.coalesce(c, F.lit("")) == ""), "unknown").when(c == w, "match").otherwise("mismatch")
    a, b = one(root, wanted_root), one(commit, wanted_commit)
    return F.when((a == "mismatch") | (b == "mismatch"), "mismatch").when((a == "match") | (b == "match"), "match").otherwise("unknown")


def kind_name(kind: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    return F.when(F.coalesce(kind, F.lit(0)) == 0, "symbol").otherwise(F.coalesce(known[kind], F.concat(F.lit("UNKNOWN_"), kind.cast("string"))))


def graph(got: DataFrame, namespace: str = "default") -> tuple[Snapshot, DataFrame]:
    """(snapshot, loss) of FACTS: symbols, where the first of them is defined, mentions by file and relationships.

    A document's word on a symbol counts before an external one's; of several definitions the first by path, range and
    symbol wins; a symbol that only occurs is an external one. loss: what, n, bytes of facts that have no place in a graph.
    """
    sid, fid = (lambda c: F.concat(F.lit("scip:"), c)), (lambda c: F.concat(F.lit("file:"), c))
    told = got.where("what in ('symbol', 'external') and symbol <> ''").groupBy("symbol").agg(F.min(F.struct(F.when(F.col("what") == "symbol", 0).otherwise(1).alias("order"), "path", "position", "label", "kind", "language")).alias("s"))
    occ = got.where("what = 'occurrence'")
    where = F.struct("path", "line", "col", "end_line", "end_col")
    defined = occ.where(F.col("roles").bitwiseAND(DEFINES) == 1)
    first = defined.groupBy("symbol").agg(F.min(where).alias("at"), F.count(F.lit(1)).alias("times"))
    every = told.select("symbol").unionByName(occ.select("symbol")).unionByName(got.where("what = 'relationship'").select(F.col("target").alias("symbol"))).where("symbol <> ''").distinct()
    s = every.join(told, "symbol", "left").join(first, "symbol", "left")
    external = F.col("at").isNull()
    nodes = s.select(
        sid("symbol").alias("id"), F.concat(F.lit("scip_"), kind_name(F.col("s.kind"))).alias("kind"), F.coalesce(F.nullif("s.label", F.lit("")), "symbol").alias("label"), F.coalesce("at.path", F.lit("")).alias("path"),
        *(F.col(f"at.{c}").alias(c) for c in ("line", "col", "end_line", "end_col")), F.to_json(F.struct(external.alias("scip_external"), F.col("symbol").alias("scip_symbol"), F.col("s.language").alias("language"))).alias("metadata"),
    )
    files = got.where("what = 'document'").groupBy("path").agg(F.max("language").alias("language")).select(fid("path").alias("id"), F.lit("file").alias("kind"), F.col("path").alias("label"), "path", F.to_json(F.struct("language")).alias("metadata"))
    edge = lambda df, kind, a, b, *more: df.select(F.concat_ws("|", a, F.lit(kind), b, *more).alias("id"), F.lit(kind).alias("kind"), a.alias("source_id"), b.alias("target_id"), *(c for c in ("path", "line", "col", "metadata") if c in df.columns))
    defines = edge(s.where("at is not null").select("symbol", "at.path", "at.line", "at.col"), "defines", fid("path"), sid("symbol"))
    used = occ.where(F.col("roles").bitwiseAND(DEFINES) == 0).dropDuplicates(["path", "line", "col", "symbol"])
    mentions = edge(used, "mentions", fid("path"), sid("symbol"), F.concat_ws(":", "line", "col"))
    rel = got.where("what = 'relationship' and target <> ''").groupBy("symbol", "target").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("flags")))).alias("flags")).withColumn("metadata", F.to_json(F.struct("flags")))
    related = edge(rel, "related", sid("symbol"), sid("target"))
    lost = {
        "malformed": got.where("what = 'malformed' or what in ('symbol', 'external') and symbol = ''"), "unknown": got.where("what = 'unknown'"), "text": got.where("what in ('document', 'symbol', 'external') and text_bytes > 0"),
    }
    loss = None
    for name, df in lost.items():
        row = df.agg(F.lit(name).alias("what"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("text_bytes"), F.lit(0)).cast("long").alias("bytes"))
        loss = row if loss is None else loss.unionByName(row)
    twice = first.agg(F.lit("duplicate_definition").alias("what"), F.coalesce(F.sum(F.col("times") - 1), F.lit(0)).cast("long").alias("n"), F.lit(0).cast("long").alias("bytes"))
    loss = loss.unionByName(twice)
    reasons = F.create_map(*(F.lit(x) for x in ("malformed", "malformed_scip_facts", "unknown", "unsupported_scip_fields", "text", "unsupported_scip_fields")))
    omitted = loss.where("n > 0 and what <> 'duplicate_definition'").select(reasons[F.col("what")].alias("reason"), F.concat(F.lit("scip:"), "what").alias("item_id"), F.to_json(F.struct("n", "bytes")).alias("details"))
    all_nodes = conform(nodes, NODES).unionByName(conform(files, NODES))
    all_edges = conform(defines, EDGES).unionByName(conform(mentions, EDGES)).unionByName(conform(related, EDGES))
    return bundle(all_nodes, all_edges, conform(omitted, OMITTED), namespace=namespace), loss


def load(spark: SparkSession, path: str, namespace: str = "default", root: str = "", commit: str = "", indexed_commit: str = "", strict: bool = False) -> tuple[Snapshot, dict]:
    """(snapshot, report) of an index file or a folder of them: producer, freshness and loss."""
    from ..folders import there

    if not there(spark, path):
        raise GraphError("SCIP_INPUT_NOT_FOUND", "no such index", path=path)
    got = facts(spark.read.format("binaryFile").load(path)).cache()
    meta = got.where("what = 'metadata'").select("label", "target", freshness(F.col("target"), root, F.lit(indexed_commit), commit).alias("freshness")).first()
    report = {"producer": meta["label"] if meta else "", "project_root": meta["target"] if meta else "", "freshness": meta["freshness"] if meta else "unknown"}
    if strict and report["freshness"] == "mismatch":
        raise GraphError("SCIP_FRESHNESS_MISMATCH", "the index belongs to another root or commit", **report)
    snap, loss = graph(got, namespace)
    report["loss"] = {r["what"]: r["n"] for r in loss.collect()}
    return snap, report


def index_rows(s: Snapshot) -> tuple[DataFrame, DataFrame]:
    """(documents, omitted): per path a JSON document of its symbols and occurrences, defines edges left out; edges that name an exact definition elsewhere are counted as omitted."""
    from ..functions import meta

    symbols = s.nodes.where("path <> '' and kind <> 'file' and kind <> 'directory'")
    occurs = symbols.where("line is not null").select("path", F.struct(F.array(F.col("line") - 1, F.coalesce(F.col("col") - 1, F.lit(0)), F.coalesce(F.col("end_col") - 1, F.length("label"))).alias("range"), F.col("id").alias("symbol"), F.lit(1).alias("symbol_roles")).alias("o"))
    uses = s.edges.where("kind <> 'defines' and path <> '' and line is not null")
    exact = F.coalesce(meta("metadata", "resolution_kind") == "exact", F.lit(False))
    used = uses.where(~exact).select("path", F.struct(F.array(F.col("line") - 1, F.coalesce(F.col("col") - 1, F.lit(0)), F.coalesce(F.col("col"), F.lit(1))).alias("range"), F.col("target_id").alias("symbol"), F.lit(0).alias("symbol_roles")).alias("o"))
    named = symbols.groupBy("path").agg(F.sort_array(F.collect_list(F.struct(F.col("id").alias("symbol"), "kind", F.col("label").alias("display_name")))).alias("symbols"))
    seen = occurs.unionByName(used).groupBy("path").agg(F.sort_array(F.collect_list("o")).alias("occurrences"))
    docs = named.join(seen, "path", "full").select("path", F.to_json(F.struct(F.col("path").alias("relative_path"), "symbols", "occurrences")).alias("document"))
    omitted = s.edges.where(exact).agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("cross_repo_definition_exact").alias("reason"), F.lit("scip").alias("item_id"), F.to_json(F.struct("n")).alias("details"))
    return docs, omitted


def to_index_json(s: Snapshot) -> str:
    docs, _ = index_rows(s)
    body = [json.loads(r["document"]) for r in docs.orderBy("path").toLocalIterator()]
    return json.dumps({"documents": body}, indent=2, sort_keys=True) + "\n"
