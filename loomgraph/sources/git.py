"""Commit history as facts: one `git log` on the driver, split and joined as DataFrames."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rename_parts
from ..operators.diff import first_wins
from ..schema import EDGES, NODES, OMITTED
from ..snapshot import Snapshot, conform

FIELDS = ("commit_hash", "short_hash", "parents", "author_name", "author_email", "author_epoch", "committer_name", "committer_email", "committer_epoch", "offset", "subject")
FORMAT = "%x1e%H%x1f%h%x1f%P%x1f%an%x1f%ae%x1f%at%x1f%cn%x1f%ce%x1f%ct%x1f%ai%x1f%s%x1f"


def log(root: str, limit: int | None = None) -> tuple[str, str]:
    """(log text, reason why there is none)."""
    try:
        out = subprocess.run(["git", "-C", root, "log", "--date-order", "--find-renames", "--numstat", f"--format={FORMAT}", *([f"-{limit}"] if limit else [])], capture_output=True, text=True, errors="replace", env={"LC_ALL": "C", "PATH": "/usr/bin:/bin:/usr/local/bin", "GIT_OPTIONAL_LOCKS": "0"})
    except FileNotFoundError:
        return "", "git_unavailable"
    return (out.stdout, "") if out.returncode == 0 else ("", "git_not_repo")


def commits(spark: SparkSession, text: str) -> DataFrame:
    """One row per commit, with its numstat lines."""
    records = spark.createDataFrame([(i, r) for i, r in enumerate(text.split("\x1e")[1:])], "position int, record string")
    parts = F.split("record", "\x1f")
    df = records.select("position", *(parts[i].alias(n) for i, n in enumerate(FIELDS)), parts[len(FIELDS)].alias("stat"))
    return df.withColumns({c: F.col(c).cast("long") for c in ("author_epoch", "committer_epoch")}).withColumn("offset", F.substring_index("offset", " ", -1))


def changes(log_rows: DataFrame) -> DataFrame:
    """commit_hash, path, previous_path, additions, deletions, change_kind, epoch: numstat dashes are null."""
    line = log_rows.select("commit_hash", "committer_epoch", F.explode(F.split("stat", "\n")).alias("row")).where("row like '%\t%'")
    parts = F.split("row", "\t")
    old, new = rename_parts(parts[2])
    df = line.select("commit_hash", F.col("committer_epoch").alias("epoch"), parts[0].try_cast("long").alias("additions"), parts[1].try_cast("long").alias("deletions"), old.alias("previous_path"), new.alias("path"))
    return df.withColumn("change_kind", F.when(F.col("previous_path") != F.col("path"), "renamed").otherwise("changed"))


def below(changed: DataFrame, prefix: str) -> DataFrame:
    """Changes of paths below a folder of the repository, by their paths from there; others go."""
    if not prefix:
        return changed
    start = prefix.rstrip("/") + "/"
    cut_ = lambda c: F.expr(f"substring({c}, {len(start) + 1})")
    inside = changed.where(F.col("path").startswith(start))
    return inside.withColumn("previous_path", F.when(F.col("previous_path").startswith(start), cut_("previous_path")).otherwise("")).withColumn("path", cut_("path"))


def overlay(log_rows: DataFrame, files: DataFrame, identity: str = "name_email_hash", prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): commits, changed paths, parents among them, and touches of files that are there now."""
    if identity not in ("name_email_hash", "full"):
        raise ValueError("identity must be name_email_hash or full")
    mail = lambda c: F.col(c) if identity == "full" else F.sha2(F.lower(F.trim(c)), 256)
    suffix = "" if identity == "full" else "_hash"
    meta = F.to_json(F.struct(F.col("author_epoch").alias("author_time_epoch"), mail("author_email").alias(f"author_email{suffix}"), "author_name", "commit_hash", F.col("committer_epoch").alias("committer_time_epoch"), mail("committer_email").alias(f"committer_email{suffix}"), "committer_name", F.col("offset").alias("offset"), F.col("short_hash").alias("short_commit_hash"), "subject"))
    cid = lambda c: F.concat(F.lit("commit:"), c)
    pid = lambda c: F.concat(F.lit("path:"), c)
    node = log_rows.select(cid("commit_hash").alias("id"), F.lit("git_commit").alias("kind"), F.col("subject").alias("label"), F.lit("").alias("path"), meta.alias("metadata"))
    ch = below(changes(log_rows), prefix)
    paths = ch.groupBy("path").agg(F.max_by("previous_path", "epoch").alias("previous_path")).select(pid("path").alias("id"), F.lit("changed_path").alias("kind"), F.col("path").alias("label"), "path", F.to_json(F.struct("previous_path")).alias("metadata"))
    edge = lambda s, kind, t, m: F.struct(F.concat_ws("|", s, F.lit(kind), t).alias("id"), F.lit(kind).alias("kind"), s.alias("source_id"), t.alias("target_id"), m.alias("metadata"))
    detail = F.to_json(F.struct("additions", "change_kind", "deletions", "previous_path"))
    changed = ch.select(edge(cid("commit_hash"), "changes_path", pid("path"), detail).alias("e"))
    touched = ch.join(files.where("kind = 'file'").select("path", F.col("id").alias("file_id")), "path").select(edge(cid("commit_hash"), "touches", F.col("file_id"), detail).alias("e"))
    up = log_rows.select("commit_hash", F.explode(F.filter(F.split("parents", " "), lambda p: p != "")).alias("parent"))
    parents = up.join(log_rows.select(F.col("commit_hash").alias("parent")), "parent", "left_semi").select(edge(cid("commit_hash"), "git_parent", cid("parent"), F.lit("{}")).alias("e"))
    return node.unionByName(paths), changed.unionByName(touched).unionByName(parents).select("e.*")


KINDS, LINKS = ("git_commit", "changed_path"), ("touches", "changes_path", "git_parent")


def with_history(s: Snapshot, root: str, identity: str = "name_email_hash", prefix: str = "") -> Snapshot:
    """The snapshot of a tree with its commits, what they changed below a folder of the repository, and why there is no more."""
    text, why = log(root)
    spark = s.spark
    note = lambda reason: spark.createDataFrame([(reason, root, "{}")], OMITTED)
    if why:
        return s.with_(omitted=s.omitted.unionByName(note(why)))
    nodes, edges = overlay(commits(spark, text), s.nodes, identity, prefix)
    omitted = s.omitted.unionByName(note("git_shallow_repository")) if Path(root, ".git", "shallow").exists() else s.omitted
    return s.with_(nodes=s.nodes.unionByName(conform(nodes, NODES)), edges=s.edges.unionByName(conform(first_wins(edges, "id", "metadata"), EDGES)), omitted=omitted)


def overlay_of(s: Snapshot) -> Snapshot:
    """The part of a snapshot that its history gave."""
    return s.with_(nodes=s.nodes.where(F.col("kind").isin(*KINDS)), edges=s.edges.where(F.col("kind").isin(*LINKS)), omitted=s.omitted.where(F.col("reason").startswith("git_")))
