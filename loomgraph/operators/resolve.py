"""Resolution across roots, imports and dependencies; evidence checks; redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import meta
from ..schema import GraphError
from ..session import cut

OUTCOMES = ("exact", "ambiguous", "same_root", "version_mismatch", "missing", "invalid")


def symbol_outcomes(uses: DataFrame, definitions: DataFrame) -> DataFrame:
    """uses (root, node_id, symbol, family, valid) with `outcome` and, if exact, `target_id`.

    definitions: root, node_id, symbol, family. By precedence: invalid symbols; one definition in other roots is exact,
    several ambiguous; else one in the own root is same_root; else the same family in another root under another
    symbol is a version mismatch; else missing. Definitions are counted per symbol before they meet the uses, so a
    symbol that a third of all rows use or define is one row on that side.
    """
    per_root = definitions.groupBy("symbol", "root").agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("first"))
    total = per_root.groupBy("symbol").agg(F.sum("n").alias("all"), F.min(F.struct("root", "first")).alias("low"), F.max(F.struct("root", "first")).alias("high"))
    own = per_root.select("symbol", "root", F.col("n").alias("own"))
    others = definitions.groupBy("family", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("family").agg(F.min("root").alias("fl"), F.max("root").alias("fh"))
    df = uses.join(total, "symbol", "left").join(own, ["symbol", "root"], "left").join(others, "family", "left")
    away = F.coalesce("all", F.lit(0)) - F.coalesce("own", F.lit(0))
    # with one definition away from the own root, that root is at one end of the symbol's roots
    target = F.when(F.col("low.root") != F.col("root"), F.col("low.first")).otherwise(F.col("high.first"))
    outcome = (
        F.when(~F.col("valid"), "invalid").when(away == 1, "exact").when(away > 1, "ambiguous").when(F.coalesce("own", F.lit(0)) > 0, "same_root")
        .when((F.col("fl") != F.col("root")) | (F.col("fh") != F.col("root")), "version_mismatch").otherwise("missing")
    )
    df = df.withColumn("outcome", outcome)
    return df.select(*uses.columns, "outcome", F.when(F.col("outcome") == "exact", target).alias("target_id"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Every outcome, also those that don't occur."""
    every = outcomes.sparkSession.createDataFrame([(o,) for o in OUTCOMES], "outcome string")
    return every.join(outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")), "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("n"))


def dependencies(declared: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, unresolved): declarations and resolutions (id, ecosystem, package) that meet, many to many; the rest."""
    key = lambda df, name: df.select(F.col("id").alias(name), F.lower("ecosystem").alias("e"), F.lower("package").alias("p"))
    d, r = key(declared, "declared_id"), key(resolved, "resolved_id")
    return d.join(r, ["e", "p"]).select("declared_id", "resolved_id"), d.join(r, ["e", "p"], "left_anti").select("declared_id")


def local_imports(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(import_id, target_id, how) of imports of local modules, and ids of those that look local but aren't found."""
    modules = nodes.where(F.coalesce(meta("metadata", "module_name"), F.lit("")) != "").groupBy(meta("metadata", "module_name").alias("name")).agg(F.min("id").alias("by_name"))
    files = nodes.where("kind = 'file'").groupBy(F.regexp_replace("path", r"\.[^./]+$", "").alias("stem")).agg(F.min("id").alias("by_path"))
    imports = nodes.where("kind in ('import', 'script_import')").select("id", "label", F.coalesce(meta("metadata", "source_path"), F.lit("")).alias("source_path"))
    folder = F.regexp_replace("source_path", r"[^/]*$", "")
    joined = F.concat(folder, F.regexp_replace(F.regexp_replace("label", r"^(\./)+", ""), r"\.[jt]sx?$", ""))
    stems = imports.where("label like '.%'").select("id", F.posexplode(F.array(joined, F.concat(joined, F.lit("/index")))).alias("order", "stem"))
    near = stems.join(files, "stem").groupBy("id").agg(F.min(F.struct("order", "by_path")).alias("hit")).select("id", F.col("hit.by_path").alias("by_path"))
    found = imports.join(modules, F.col("label") == F.col("name"), "left").join(near, "id", "left").withColumn("target_id", F.coalesce("by_name", "by_path"))
    lost = found.where(F.col("target_id").isNull() & (F.contains("label", F.lit(".")) | (F.col("source_path") != "")))
    return found.where("target_id is not null").select(F.col("id").alias("import_id"), "target_id", F.when(F.col("by_name").isNotNull(), "module").otherwise("path").alias("how")), lost.select("id", "label")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edge_id, missing_id of ends without a node."""
    ends = edges.select(F.col("id").alias("edge_id"), F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("missing_id"))
    return ends.join(nodes.select(F.col("id").alias("missing_id")), "missing_id", "left_anti").select("edge_id", "missing_id")


def require_ends(nodes: DataFrame, edges: DataFrame) -> None:
    if (gap := dangling(nodes, edges).first()) is not None:
        raise GraphError("SNAPSHOT_REFERENTIAL_GAP", "an edge has no node at one end", edge_id=gap["edge_id"], missing_id=gap["missing_id"])


def precise_merge(base: DataFrame, extra: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, collisions): base rows, and extra ones of other ids; ids whose rows differ keep the base's."""
    from .diff import changed

    return base.unionByName(extra.join(base.select("id"), "id", "left_anti")), changed(base, extra)


def merged(base_nodes: DataFrame, base_edges: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, omitted): a precise graph's rows added to a base. Ids whose rows differ keep the base's; edges without both ends go; both are noted."""
    all_nodes, twice = precise_merge(base_nodes, nodes)
    all_edges, again = precise_merge(base_edges, edges)
    # ids only, and read twice: what leads to them is a pass over both graphs
    lost = cut(dangling(all_nodes, all_edges).select("edge_id").distinct())
    note = lambda df, reason, c: df.select(F.lit(reason).alias("reason"), F.col(c).alias("item_id"), F.lit("{}").alias("details"))
    omitted = note(twice.unionByName(again), "precise_merge_collision", "id").unionByName(note(lost, "precise_merge_referential_gap", "edge_id"))
    return all_nodes, all_edges.join(lost.select(F.col("edge_id").alias("id")), "id", "left_anti"), omitted


def evidence_state(refs: DataFrame, nodes: DataFrame, manifest: DataFrame) -> DataFrame:
    """refs (ref_uri, node_id, content_hash, stale) with `state`: missing, changed, stale or fresh, in that precedence."""
    at = nodes.select(F.col("id").alias("node_id"), F.col("path").alias("node_path"), F.lit(True).alias("there"))
    now = manifest.select(F.col("path").alias("node_path"), F.col("content_hash").alias("now_hash"))
    df = refs.join(at, "node_id", "left").join(now, "node_path", "left")
    state = F.when(F.col("there").isNull(), "missing").when(F.col("now_hash").isNull() & (F.col("content_hash") != ""), "missing").when(F.col("now_hash") != F.col("content_hash"), "changed").when(F.col("stale"), "stale").otherwise("fresh")
    return df.select("ref_uri", "node_id", F.coalesce("now_hash", "content_hash").alias("content_hash"), state.alias("state"))


PROFILES = ("full", "no_content", "no_identities", "portable")
IDENTITY_KEYS = ("author_name", "author_email", "committer_name", "committer_email", "author_email_hash", "committer_email_hash")


def redacted(snapshot, profile: str):
    """The snapshot without what a profile hides: text; names and addresses; both, and absolute paths."""
    if profile not in PROFILES:
        raise ValueError(f"profile must be one of {PROFILES}")
    if profile == "full":
        return snapshot

    def without(keys: tuple[str, ...]):
        kept = F.map_filter(F.from_json("metadata", "map<string,string>"), lambda k, v: ~k.isin(*keys))
        hit = F.lit(False)
        for k in keys:
            hit = hit | meta("metadata", k).isNotNull()
        return F.when(hit, F.to_json(kept)).otherwise(F.col("metadata"))

    def clean(df: DataFrame) -> DataFrame:
        if profile in ("no_content", "portable") and "text" in df.columns:
            df = df.withColumn("text", F.lit(""))
        if profile in ("no_identities", "portable"):
            df = df.withColumn("metadata", without(IDENTITY_KEYS))
        if profile == "portable":
            df = df.withColumn("path", F.when(F.col("path").startswith("/"), F.regexp_extract("path", r"[^/]*$", 0)).otherwise(F.col("path"))).withColumn("uri", F.when(F.col("uri").startswith("file:"), F.lit("")).otherwise(F.col("uri")))
        return df

    header = {k: v for k, v in snapshot.header.items() if profile != "portable" or k not in ("root_path", "git_repo_root")}
    return snapshot.with_(nodes=clean(snapshot.nodes), edges=clean(snapshot.edges), header=header)


def redacted_fields(snapshot, profile: str) -> list[str]:
    """Names of what a profile hides that are there at all."""
    found = set()
    if profile in ("no_content", "portable") and not snapshot.nodes.where("text <> ''").isEmpty():
        found.add("text")
    if profile in ("no_identities", "portable"):
        keys = snapshot.nodes.select(F.explode(F.json_object_keys("metadata")).alias("k")).where(F.col("k").isin(*IDENTITY_KEYS)).distinct()
        found |= {r[0] for r in keys.collect()}
    return sorted(found)
