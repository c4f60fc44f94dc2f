"""Graph packs: a graph, optionally its store and evidence, in one folder with the checksum of every file."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import join, names, read_text, replace_text, there
from .operators import resolve
from .schema import EDGES, NODES, OMITTED, GraphError
from .snapshot import Snapshot
from .store import ParquetStore, same_rows

PACK_VERSION = "loomgraph.pack.v1"


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """file, size_bytes, sha256 of every data file below a folder, hashed where it is read."""
    listed = [n for n in names(spark, folder) if not n.rpartition("/")[2].startswith(("_", ".")) and n != "pack.json"]
    if not listed:
        return spark.createDataFrame([], "file string, size_bytes long, sha256 string")
    files = spark.read.format("binaryFile").load([join(folder, n) for n in listed])
    mark = "/" + folder.rstrip("/").rpartition("/")[2] + "/"
    return files.select(F.substring_index("path", mark, -1).alias("file"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def write(s: Snapshot, folder: str, store: str = "", evidence: DataFrame | None = None, profile: str = "full") -> dict:
    """The pack's manifest; the store, if asked for, is built anew from the redacted graph."""
    spark = s.spark
    kept = resolve.redacted(s, profile)
    for name, by in (("nodes", "id"), ("edges", "id"), ("omitted", "item_id")):
        getattr(kept, name).repartitionByRange(by).sortWithinPartitions(by).write.parquet(join(folder, name))
    if store:
        ParquetStore(spark, join(folder, "store")).import_snapshot(load_tables(spark, folder, kept.header))
    if evidence is not None:
        evidence.write.json(join(folder, "evidence"))
    read = load_tables(spark, folder, kept.header)
    body = {
        "pack_version": PACK_VERSION, "profile": profile, "header": kept.header, "store": bool(store), "evidence": evidence is not None,
        "counts": {"nodes": read.nodes.count(), "edges": read.edges.count(), "omitted": read.omitted.count()},
        "files": {r["file"]: r["sha256"] for r in checksums(spark, folder).toLocalIterator()},
    }
    replace_text(spark, join(folder, "pack.json"), json.dumps(body, sort_keys=True, indent=2))
    return body


def inspect(spark: SparkSession, folder: str) -> dict:
    path = join(folder, "pack.json")
    if not there(spark, path):
        raise GraphError("GRAPH_PACK_MANIFEST_NOT_FOUND", "no pack here", path=folder)
    try:
        body = json.loads(read_text(spark, path))
        version, _ = body["pack_version"], body["counts"]
    except (ValueError, KeyError, TypeError) as e:
        raise GraphError("GRAPH_PACK_MANIFEST_INVALID", "the pack's manifest can't be read", error=str(e)) from e
    if version != PACK_VERSION:
        raise GraphError("GRAPH_PACK_SCHEMA_UNSUPPORTED", "the pack has another version", found=version)
    return body


def load_tables(spark: SparkSession, folder: str, header: dict) -> Snapshot:
    read = lambda name, schema: spark.read.schema(schema).parquet(join(folder, name))
    return Snapshot(read("nodes", NODES), read("edges", EDGES), read("omitted", OMITTED), header)


def load(spark: SparkSession, folder: str) -> Snapshot:
    return load_tables(spark, folder, inspect(spark, folder)["header"])


def load_store(spark: SparkSession, folder: str) -> ParquetStore:
    if not inspect(spark, folder)["store"]:
        raise GraphError("GRAPH_PACK_STORE_NOT_FOUND", "the pack holds no store", path=folder)
    return ParquetStore(spark, join(folder, "store"))


def load_evidence(spark: SparkSession, folder: str) -> DataFrame:
    if not inspect(spark, folder)["evidence"]:
        raise GraphError("GRAPH_PACK_EVIDENCE_NOT_FOUND", "the pack holds no evidence", path=folder)
    from .evidence import REFS

    return spark.read.schema(REFS).json(join(folder, "evidence"))


def import_pack(spark: SparkSession, folder: str, store: ParquetStore) -> dict:
    return store.import_snapshot(load(spark, folder))


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """check, ok, detail: counts, every file's checksum, the store against the graph, and whether the evidence reads."""
    body = inspect(spark, folder)
    found = {r["file"]: r["sha256"] for r in checksums(spark, folder).toLocalIterator()}
    rows = [(f"file:{name}", found.get(name) == body["files"].get(name), "" if name in found else "gone") for name in sorted({*found, *body["files"]})]
    schema = "check string, ok boolean, detail string"
    if not all(ok for _, ok, _ in rows):
        # a table with a foreign or damaged file isn't read
        return spark.createDataFrame(rows + [(f"count:{k}", False, "not read") for k in body["counts"]], schema)
    s = load(spark, folder)
    now = {"nodes": s.nodes.count(), "edges": s.edges.count(), "omitted": s.omitted.count()}
    rows += [(f"count:{k}", now[k] == body["counts"][k], f"{now[k]} of {body['counts'][k]}") for k in now]
    if body["store"]:
        kept = load_store(spark, folder).export_snapshot()
        rows.append(("store", all(same_rows(getattr(kept, k), getattr(s, k)) for k in now), ""))
    if body["evidence"]:
        rows.append(("evidence", load_evidence(spark, folder).where("ref_uri is null").isEmpty(), ""))
    return spark.createDataFrame(rows, schema)


def review(spark: SparkSession, folder: str) -> dict:
    """What verify() says in all, and what to do next; nothing is changed."""
    bad = [r["check"] for r in verify(spark, folder).where("not ok").collect()]
    steps = [f"python -m loomgraph graph-pack-import {folder} STORE"] if not bad else [f"python -m loomgraph graph-pack-verify {folder}"]
    return {"ok": not bad, "failed": bad, "manifest": inspect(spark, folder), "next_commands": steps}
