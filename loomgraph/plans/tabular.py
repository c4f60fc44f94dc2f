"""The driver's tables as nodes, edges and omitted facts: declared as scans and projections, so filters reach Parquet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def _node(df: DataFrame, kind: str, key: str, label: Column, path: Column, text: Column, metadata: Column | None = None) -> DataFrame:
    return df.select(_id(kind, key).alias("id"), F.lit(kind).alias("kind"), label.alias("label"), path.alias("path"), F.lit("").alias("section"), text.alias("text"), (F.lit("") if metadata is None else metadata).alias("metadata"))


def nodes(spark: SparkSession, sf_dir: str, *kinds: str, of_orders: Column | None = None) -> DataFrame:
    """id, kind, label, path, section, text, metadata of region, nation, customer, supplier, part and orders (or some of them); of_orders: metadata of orders, over their columns."""
    none = F.lit("")
    make = {
        "region": lambda t: _node(t, "region", "r_regionkey", F.col("r_name"), none, none),
        "nation": lambda t: _node(t, "nation", "n_nationkey", F.col("n_name"), _id("region", "n_regionkey"), none),
        "customer": lambda t: _node(t, "customer", "c_custkey", F.col("c_name"), _id("nation", "c_nationkey"), F.col("c_mktsegment")),
        "supplier": lambda t: _node(t, "supplier", "s_suppkey", F.col("s_name"), _id("nation", "s_nationkey"), none),
        "part": lambda t: _node(t, "part", "p_partkey", F.col("p_name"), F.col("p_brand"), F.col("p_type")),
        "orders": lambda t: _node(t, "orders", "o_orderkey", _id("order", "o_orderkey"), _id("customer", "o_custkey"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus"), of_orders),
    }
    return reduce(DataFrame.unionByName, (make[k](table(spark, sf_dir, k)) for k in (kinds or make)))


def _edge(df: DataFrame, kind: str, source: Column, target: Column) -> DataFrame:
    pair = df.select(source.alias("source_id"), target.alias("target_id"))
    return pair.select(F.concat_ws("|", "source_id", F.lit(kind), "target_id").alias("id"), F.lit(kind).alias("kind"), "source_id", "target_id", F.lit("").alias("metadata"))


def edges(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """contains from region down to orders, and depends_on from orders to the distinct parts of their lines, which stay together by order."""
    t = lambda name: table(spark, sf_dir, name)
    make = {
        "nation": lambda: _edge(t("nation"), "contains", _id("region", "n_regionkey"), _id("nation", "n_nationkey")),
        "customer": lambda: _edge(t("customer"), "contains", _id("nation", "c_nationkey"), _id("customer", "c_custkey")),
        "supplier": lambda: _edge(t("supplier"), "contains", _id("nation", "s_nationkey"), _id("supplier", "s_suppkey")),
        "orders": lambda: _edge(t("orders"), "contains", _id("customer", "o_custkey"), _id("orders", "o_orderkey")),
        "lineitem": lambda: _edge(t("lineitem").select("l_orderkey", "l_partkey").repartitionByRange("l_orderkey").distinct(), "depends_on", _id("orders", "l_orderkey"), _id("part", "l_partkey")),
    }
    return reduce(DataFrame.unionByName, (make[k]() for k in (names or make)))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, position, target of every href."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1).alias("hrefs"))
    return pages.select("page_id", F.posexplode("hrefs").alias("position", "target"))


def commits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """events as commits: (nodes, edges, changes); an event touches its user's path."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("epoch"))
    meta = F.concat(F.lit('{"committer_time_epoch":'), F.col("epoch").cast("string"), F.lit(',"commit_hash":"'), F.col("event_id").cast("string"), F.lit('"}'))
    node = ev.select(_id("commit", "event_id").alias("id"), F.lit("git_commit").alias("kind"), F.col("event_type").alias("label"), F.lit("").alias("path"), F.lit("").alias("section"), F.lit("").alias("text"), meta.alias("metadata"))
    place = F.concat(F.lit("user/"), F.col("user_id").cast("string"))
    paths = ev.select(place.alias("path")).distinct().select(F.concat(F.lit("path:"), "path").alias("id"), F.lit("changed_path").alias("kind"), F.col("path").alias("label"), "path", F.lit("").alias("section"), F.lit("").alias("text"), F.lit("").alias("metadata"))
    edge = _edge(ev, "changes_path", _id("commit", "event_id"), F.concat(F.lit("path:"), place))
    changes = ev.select(place.alias("path"), F.lit("").alias("previous_path"), "epoch", _id("commit", "event_id").alias("commit_id"))
    return node.unionByName(paths), edge, changes
