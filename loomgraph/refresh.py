"""Refresh as an operation: what would be parsed, a profile to run it by, and the status that it leaves."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import join, read_text, replace_text, there
from .operators import diff, views
from .schema import MANIFEST, GraphError
from .snapshot import Snapshot, load, save
from .sources import files

PROFILE_VERSION, STATUS_VERSION = "loomgraph.profile.v1", "loomgraph.status.v1"


@dataclass(frozen=True)
class Profile:
    label: str
    root: str
    folder: str  # of the store, the facts and the status
    namespace: str = "default"
    identity: str = "name_email_hash"
    version: str = PROFILE_VERSION


@dataclass(frozen=True)
class Status:
    ok: bool
    root: str
    namespace: str
    attempted_at: int
    error: str = ""
    snapshot: str = ""
    parsed: int = 0
    reused: int = 0
    removed: int = 0
    delta: dict | None = None
    omitted: dict | None = None
    parsers: list | None = None
    version: str = STATUS_VERSION


def write_profile(spark: SparkSession, path: str, profile: Profile) -> None:
    replace_text(spark, path, json.dumps(asdict(profile), sort_keys=True, indent=2))


def read_profile(spark: SparkSession, path: str) -> Profile:
    try:
        body = json.loads(read_text(spark, path)) if there(spark, path) else None
        if not isinstance(body, dict) or body.get("version") != PROFILE_VERSION or not body.get("label") or not body.get("root"):
            raise ValueError("a version, a label and a root are needed")
        return Profile(**body)
    except (ValueError, TypeError) as e:
        raise GraphError("INVALID_REFRESH_PROFILE", "the profile can't be read", path=path, error=str(e)) from e


def read_status(spark: SparkSession, folder: str) -> Status:
    path = join(folder, "status.json")
    try:
        body = json.loads(read_text(spark, path)) if there(spark, path) else {}
        if body.get("version") != STATUS_VERSION:
            raise ValueError("another version, or none")
        return Status(**body)
    except (ValueError, TypeError) as e:
        raise GraphError("INVALID_REFRESH_STATUS", "the status can't be read", path=path, error=str(e)) from e


def stored_manifest(spark: SparkSession, folder: str) -> DataFrame | None:
    pointer = join(folder, "CURRENT")
    return spark.read.schema(MANIFEST).parquet(join(folder, read_text(spark, pointer), "manifest")) if there(spark, pointer) else None


def plan(before: DataFrame, now: DataFrame) -> DataFrame:
    """path, status, reasons, changed of two manifests: changed paths are those added, changed and removed."""
    return diff.path_changes(before, now).withColumn("changed", F.col("status") != "unchanged")


def plan_root(spark: SparkSession, root: str, folder: str, scope: files.Scope = files.Scope()) -> DataFrame:
    now = files.manifest(spark, root, scope)
    before = stored_manifest(spark, folder)
    return plan(now.limit(0) if before is None else before, now)


def plan_summary(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """changed_paths, unchanged_paths, removed_paths, entries, parsers: one row."""
    one = lambda c, name: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long").alias(name)
    sums = rows.agg(one(F.col("changed"), "changed_paths"), one(~F.col("changed"), "unchanged_paths"), one(F.col("status") == "removed", "removed_paths"))
    return sums.crossJoin(manifest.agg(F.count(F.lit(1)).alias("entries"), F.array_sort(F.collect_set("parser")).alias("parsers")))  # two rows of one


def delta_counts(old: Snapshot, new: Snapshot) -> DataFrame:
    """item_kind, status, n of a structural difference, none left out."""
    spark = new.spark
    every = spark.createDataFrame([(k, s) for k in ("node", "edge", "omitted") for s in ("added", "removed")], "item_kind string, status string")
    got = diff.structural(old, new).groupBy("item_kind", "status").agg(F.count(F.lit(1)).alias("n"))
    return every.join(got, ["item_kind", "status"], "left").select("item_kind", "status", F.coalesce("n", F.lit(0)).alias("n"))


def run(spark: SparkSession, profile: Profile, scope: files.Scope = files.Scope()) -> Status:
    """The former state read, the root refreshed, the snapshot saved, the status written last; a failure leaves a status too."""
    began = int(time.time())
    store, state = join(profile.folder, "store"), join(profile.folder, "state")
    try:
        old = load(spark, store) if there(spark, join(store, "CURRENT")) else None
        snap, work = files.refresh(spark, profile.root, state, profile.namespace, scope)
        version = save(snap, store)
        now = load(spark, store)
        counts = {f"{r['item_kind']}_{r['status']}": r["n"] for r in delta_counts(old, now).collect()} if old else {}
        reasons = {r["reason"]: r["n"] for r in views.counts(now.omitted, "reason").collect()}
        kinds = [r[0] for r in stored_manifest(spark, state).select("parser").distinct().orderBy("parser").collect()]
        done = Status(True, profile.root, profile.namespace, began, snapshot=version, **{k: work[k] for k in ("parsed", "reused", "removed")}, delta=counts, omitted=reasons, parsers=kinds)
    except Exception as e:
        failed = Status(False, profile.root, profile.namespace, began, error=getattr(e, "code", type(e).__name__))
        replace_text(spark, join(profile.folder, "status.json"), json.dumps(asdict(failed), sort_keys=True))
        raise
    replace_text(spark, join(profile.folder, "status.json"), json.dumps(asdict(done), sort_keys=True))
    return done


def freshness(s: Snapshot, other: Snapshot | None = None) -> dict:
    """The snapshot's header and, against another one, whether and how they differ."""
    out: dict = {"header": s.header, "differs": None}
    if other is not None:
        counts = {f"{r['item_kind']}_{r['status']}": r["n"] for r in diff.ci_delta(s, other).groupBy("item_kind", "status").agg(F.count(F.lit(1)).alias("n")).collect()}
        out |= {"differs": bool(counts), "counts": counts, "header_changes": diff.header_changes(s.header, other.header)}
    return out


def exit_code(delta: DataFrame, changed_header: list[str]) -> int:
    """0 if nothing differs, 1 if something does."""
    return int(bool(changed_header) or not delta.isEmpty())


def delta_review(old: Snapshot, new: Snapshot, limit: int = 200) -> dict:
    """What a reviewer sees of a difference: counts, the first rows and the code that a check would end with."""
    rows, changed = diff.ci_delta(old, new), diff.header_changes(old.header, new.header)
    counts = {f"{r['item_kind']}_{r['status']}": r["n"] for r in rows.groupBy("item_kind", "status").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = [r.asDict() for r in rows.orderBy("item_kind", "status", "item_id").limit(limit).collect()]
    return {"counts": counts, "rows": first, "header_changes": changed, "exit_code": int(bool(counts or changed))}
