"""A snapshot: nodes, edges and omitted as DataFrames with a small header; stored as Parquet or canonical JSON."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folders import join, read_text, replace_text, there
from .schema import EDGES, NODES, OMITTED, SNAPSHOT_VERSION, GraphError

PLACE = ("path", "line", "col", "end_line", "end_col", "section", "uri")


@dataclass(frozen=True)
class Snapshot:
    nodes: DataFrame
    edges: DataFrame
    omitted: DataFrame
    header: dict = field(default_factory=lambda: {"schema_version": SNAPSHOT_VERSION, "namespace": "default"})

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def with_(self, **changes: object) -> Snapshot:
        return replace(self, **changes)


def conform(df: DataFrame, schema: str) -> DataFrame:
    """df with the columns of a schema, in order; missing ones are empty (strings) or null."""
    fields = T.StructType.fromDDL(schema).fields
    empty = lambda f: F.lit("{}" if f.name in ("metadata", "details") else "") if isinstance(f.dataType, T.StringType) else F.lit(None).cast(f.dataType)
    return df.select(*((F.coalesce(F.col(f.name), empty(f)) if f.name in df.columns else empty(f)).cast(f.dataType).alias(f.name) for f in fields))


def bundle(nodes: DataFrame, edges: DataFrame, omitted: DataFrame | None = None, **header: object) -> Snapshot:
    spark = nodes.sparkSession
    omitted = spark.createDataFrame([], OMITTED) if omitted is None else omitted
    return Snapshot(conform(nodes, NODES), conform(edges, EDGES), conform(omitted, OMITTED), {"schema_version": SNAPSHOT_VERSION, "namespace": "default"} | header)


def check_version(header: dict) -> None:
    if header.get("schema_version") != SNAPSHOT_VERSION:
        raise GraphError("UNSUPPORTED_SCHEMA_VERSION", "the snapshot has another version", found=header.get("schema_version"))


# --- Parquet store: versions side by side, one pointer file that is replaced at the end ---


def save(snapshot: Snapshot, folder: str, fail_after: str = "") -> str:
    """Writes a new version and moves the pointer to it; a failure on the way leaves the version before in place."""
    version = uuid.uuid4().hex
    for name in ("nodes", "edges", "omitted"):
        df = getattr(snapshot, name)
        keys = ["id"] if "id" in df.columns else ["reason", "item_id"]
        df.sortWithinPartitions(*keys).write.parquet(f"{folder}/{version}/{name}")
        if fail_after == name:
            raise RuntimeError(f"stopped after {name}")
    replace_text(snapshot.spark, join(folder, version, "header.json"), json.dumps(snapshot.header, sort_keys=True))
    replace_text(snapshot.spark, join(folder, "CURRENT"), version)
    return version


def load(spark: SparkSession, folder: str) -> Snapshot:
    pointer = join(folder, "CURRENT")
    if not there(spark, pointer):
        raise GraphError("STORE_SNAPSHOT_NOT_FOUND", "the store has no snapshot", path=folder)
    base = join(folder, read_text(spark, pointer))
    header = json.loads(read_text(spark, join(base, "header.json")))
    check_version(header)
    read = lambda name, schema: spark.read.schema(schema).parquet(join(base, name))
    return Snapshot(read("nodes", NODES), read("edges", EDGES), read("omitted", OMITTED), header)


# --- canonical JSON: for graphs that a driver can hold ---


def _row(r: dict, what: str) -> dict:
    out = {k: r[k] for k in r if k not in PLACE and k not in ("metadata", "details")}
    if what != "omitted":
        out["source_ref"] = {k: r[k] for k in PLACE if r[k] not in (None, "")}
    key = "details" if what == "omitted" else "metadata"
    return out | {key: json.loads(r[key] or "{}")}


def to_json(snapshot: Snapshot) -> str:
    """Sorted rows, sorted keys, ASCII: equal snapshots give equal text."""
    body = {**snapshot.header}
    for name, keys in (("nodes", ["id"]), ("edges", ["id"]), ("omitted", ["reason", "item_id", "details"])):
        body[name] = [_row(r.asDict(), name) for r in getattr(snapshot, name).orderBy(*keys).toLocalIterator()]
    return json.dumps(body, indent=2, sort_keys=True) + "\n"


def from_json(spark: SparkSession, text: str) -> Snapshot:
    try:
        body = json.loads(text)
    except ValueError as e:
        raise GraphError("INVALID_SNAPSHOT", "the snapshot isn't JSON", error=str(e)) from e
    if not isinstance(body, dict):
        raise GraphError("INVALID_SNAPSHOT", "the snapshot isn't an object")
    header = {k: v for k, v in body.items() if k not in ("nodes", "edges", "omitted")}
    check_version(header)

    def rows(name: str, schema: str) -> DataFrame:
        fields = T.StructType.fromDDL(schema).fieldNames()
        flat = []
        for r in body.get(name, []):
            r = {**r, **r.get("source_ref", {})}
            for key in ("metadata", "details"):
                if key in fields:
                    r[key] = json.dumps(r.get(key) or {}, sort_keys=True, separators=(",", ":"))
            flat.append(tuple(r.get(f, None if f in ("line", "col", "end_line", "end_col") else "") for f in fields))
        return spark.createDataFrame(flat, schema)

    return Snapshot(rows("nodes", NODES), rows("edges", EDGES), rows("omitted", OMITTED), header)
