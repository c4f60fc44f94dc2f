"""Graph stores: one interface over canonical JSON and over indexed Parquet, with candidates by trigram and deltas by version.

A Parquet store holds, per version, nodes sorted by id, edges by source and once more by target, and an index of the
trigrams that occur in each block of nodes (some thousands that stand together), cut into folders by hash. A lookup reads
a few folders of the index, then the blocks that may hold a hit, whose nodes are tested one by one. A pointer file names
the current version and moves last.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .folders import join, read_text, replace_text, there
from .functions import haystack
from .operators import search, traverse
from .operators.diff import compared
from .schema import EDGES, NODES, OMITTED, SNAPSHOT_VERSION, GraphError
from .session import cut
from .snapshot import Snapshot, bundle, check_version, from_json, to_json

#: Layouts: 1 has no index (searches read all nodes, deltas are refused), 2 has one. Nodes of a block: 2 to this power.
LAYOUT, FOLDERS, GRAM, BLOCK = 2, 32, 3, 12
CATALOG = (
    ("json", "available", "one canonical document, for graphs that a driver holds"),
    ("parquet", "available", "versions of sorted Parquet with an index of trigrams"),
    ("duckdb", "reserved", "not built"),
    ("kuzu", "reserved", "not built"),
    ("vector_sidecar", "boundary", "vectors live outside the graph"),
)


class GraphStore(Protocol):
    """What every backend answers."""

    def manifest(self) -> dict: ...
    def capabilities(self) -> dict: ...
    def health(self) -> dict: ...
    def export_snapshot(self) -> Snapshot: ...
    def query(self, request: search.Request | str) -> search.Result: ...
    def neighborhood(self, node_id: str, **how: object) -> DataFrame: ...
    def path(self, source_id: str, target_id: str, **how: object) -> list[str] | None: ...


@dataclass(frozen=True)
class Explanation:
    strategy: str  # direct_exact, indexed_trigram or full_scan
    candidates: int
    nodes: int
    command: str
    plan: str


@dataclass(frozen=True)
class Update:
    added: int
    changed: int
    removed: int
    rows_written: int
    version: str


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CATALOG), "backend string, status string, note string")


def blocks_of(nodes: DataFrame) -> DataFrame:
    """Nodes as they stand in their partitions, with the block that each belongs to."""
    return nodes.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK))


def gram_index(nodes: DataFrame) -> DataFrame:
    """folder, gram, block of every trigram of each block's searched texts; nodes: with block, those of one together.

    A batch's trigrams are numbers that are made distinct block by block before any of them becomes a row.
    """

    def distinct(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = [t.decode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            block = np.asarray(batch.column(0))
            row = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), int, len(texts)))
            u = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
            codes, same = u[:-2] | u[1:-1] << 21 | u[2:] << 42, row[:-2] == row[2:]
            codes, of = codes[same], block[row[:-2][same]]
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1), len(of)]
            for i, j in zip(cuts, cuts[1:]):
                if i < j:
                    once = np.unique(codes[i:j])
                    each = np.stack([once & 0x1FFFFF, once >> 21 & 0x1FFFFF, once >> 42], 1).astype("<u4").tobytes().decode("utf-32-le")
                    yield pa.RecordBatch.from_arrays([pa.array([each[k : k + 3] for k in range(0, len(each), 3)]), pa.array(np.full(len(once), of[i]))], ["gram", "block"])

    found = nodes.select("block", F.lower(haystack()).cast("binary").alias("text")).mapInArrow(distinct, "gram string, block long").distinct()
    return found.select(folder_of(F.col("gram")).alias("folder"), "gram", "block")


def folder_of(gram: Column) -> Column:
    return F.pmod(F.crc32(gram.cast("binary")), F.lit(FOLDERS)).cast("int")


def phrases(request: search.Request) -> list[str]:
    """What a hit must hold one of: the whole query or one of its tokens."""
    q = request.query.strip().lower()
    return list(dict.fromkeys(x for x in (q, *sorted(t for t in re.split(r"[^a-zA-Z0-9_]+", q) if t)) if x))


def strategy(request: search.Request) -> str:
    wanted = phrases(request)
    return "direct_exact" if not wanted else "full_scan" if min(map(len, wanted)) < GRAM else "indexed_trigram"


def candidates(nodes: DataFrame, index: DataFrame | None, request: search.Request) -> DataFrame:
    """Nodes that may score, all that do among them: by requested id, or with every trigram of the query or of a token.

    The index tells the blocks in which all of them occur, whose nodes are tested; without one all nodes are. A phrase
    shorter than a trigram could hide anywhere, so then all nodes are candidates.
    """
    ids = F.col("id").isin(*request.node_ids) if request.node_ids else F.lit(False)
    how = strategy(request)
    if how == "full_scan":
        return nodes.drop("block")
    if how == "direct_exact":
        return nodes.where(ids).drop("block")
    parts = [list(dict.fromkeys(p[i : i + GRAM] for i in range(len(p) - GRAM + 1))) for p in phrases(request)]
    any_of = lambda tests: reduce(lambda a, b: a | b, tests)
    every_of = lambda tests: reduce(lambda a, b: a & b, tests)
    # an array of one text, so that the text is made once for all tests
    holds = F.exists(F.array(F.lower(haystack())), lambda h: any_of(every_of(F.contains(h, F.lit(g)) for g in p) for p in parts))
    near = nodes
    if index is not None:
        every = sorted({g for p in parts for g in p})
        spark = nodes.sparkSession
        folders = [r[0] for r in spark.createDataFrame([(g,) for g in every], "gram string").select(folder_of(F.col("gram"))).distinct().collect()]
        met = index.where(F.col("folder").isin(*folders) & F.col("gram").isin(*every)).groupBy("block").agg(F.collect_set("gram").alias("met"))
        whole = any_of(F.size(F.array_intersect("met", F.array(*(F.lit(g) for g in p)))) == len(p) for p in parts)
        blocks = cut(met.where(whole).select("block"))
        low, high, n = blocks.agg(F.min("block"), F.max("block"), F.count(F.lit(1))).first()
        near = nodes.where(F.col("block").between(low, high)).join(F.broadcast(blocks) if n <= traverse.SMALL else blocks, "block", "left_semi")
    hits = near.where(holds)
    return (hits.unionByName(nodes.where(ids)).dropDuplicates(["id"]) if request.node_ids else hits).drop("block")


class ParquetStore:
    """A store in a folder on any file system that Spark writes to."""

    backend = "parquet"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    # --- layout ---

    def _version(self) -> str:
        if not there(self.spark, pointer := join(self.folder, "CURRENT")):
            raise GraphError("STORE_SNAPSHOT_NOT_FOUND", "the store has no snapshot", path=self.folder)
        return read_text(self.spark, pointer)

    def _header(self) -> dict:
        path = join(self.folder, self._version(), "store.json")
        if not there(self.spark, path):
            raise GraphError("STORE_MANIFEST_NOT_FOUND", "the store's version has no manifest", path=path)
        return json.loads(read_text(self.spark, path))

    def table(self, name: str) -> DataFrame:
        schema = {"nodes": NODES, "edges": EDGES, "edges_by_target": EDGES, "omitted": OMITTED, "blocks": f"{NODES}, block long", "grams": "gram string, block long, folder int"}[name]
        return self.spark.read.schema(schema).parquet(join(self.folder, self._version(), "nodes" if name == "blocks" else name))

    def _write(self, s: Snapshot, layout: int = LAYOUT, fail_after: str = "") -> str:
        version = uuid.uuid4().hex
        base = join(self.folder, version)

        def put(name: str, df: DataFrame, *by: str) -> DataFrame:
            df = df.repartitionByRange(*by).sortWithinPartitions(*by)
            (blocks_of(df) if name == "nodes" else df).write.parquet(join(base, name))
            if fail_after == name:
                raise RuntimeError(f"stopped after {name}")
            return self.spark.read.schema(f"{NODES}, block long" if name == "nodes" else EDGES if name == "edges" else df.schema).parquet(join(base, name))

        # what is written is read again where it is needed once more, for the snapshot may be dear
        nodes = put("nodes", s.nodes, "id")
        edges = put("edges", s.edges, "source_id", "id")
        put("edges_by_target", edges, "target_id", "id")
        put("omitted", s.omitted, "reason", "item_id")
        if layout >= 2:
            gram_index(nodes).repartition("folder").sortWithinPartitions("folder", "gram").write.partitionBy("folder").parquet(join(base, "grams"))
        counts = {"nodes": nodes.count(), "edges": edges.count(), "omitted": self.spark.read.parquet(join(base, "omitted")).count()}
        replace_text(self.spark, join(base, "store.json"), json.dumps({"layout": layout, "index": "blocks" if layout >= 2 else "", "header": s.header, "counts": counts}, sort_keys=True))
        replace_text(self.spark, join(self.folder, "CURRENT"), version)
        return version

    # --- the interface ---

    def import_snapshot(self, snapshot: Snapshot, layout: int = LAYOUT) -> dict:
        """Replaces all that the store holds."""
        self._write(snapshot, layout)
        return self.manifest()

    def manifest(self) -> dict:
        h = self._header()
        n = h["counts"]
        return {"backend": self.backend, "layout": h["layout"], "namespace": h["header"].get("namespace", ""), "schema_version": h["header"].get("schema_version", ""), "node_count": n["nodes"], "edge_count": n["edges"], "omitted_count": n["omitted"], "source_ref_count": n["nodes"] + n["edges"]}

    def capabilities(self) -> dict:
        indexed = self._header()["layout"] >= 2
        return {"backend": self.backend, "indexed_query": indexed, "delta": indexed, "traversal": True, "versions": True}

    def health(self) -> dict:
        h = self._header()
        return {"ok": bool(h["header"].get("schema_version")), **h["counts"]}

    def export_snapshot(self) -> Snapshot:
        header = self._header()["header"]
        try:
            check_version(header)
        except GraphError as e:
            raise GraphError("INVALID_STORE_SNAPSHOT", "the store's snapshot can't be read", error=e.message) from e
        return Snapshot(self.table("nodes"), self.table("edges"), self.table("omitted"), header)

    def candidates(self, request: search.Request) -> DataFrame:
        h = self._header()
        if h["layout"] < 2:
            return self.table("nodes")
        # a version that was written with an index of ids is read without it
        return candidates(self.table("blocks"), self.table("grams"), request) if h.get("index") == "blocks" else candidates(self.table("nodes"), None, request)

    def query(self, request: search.Request | str) -> search.Result:
        """search() over the candidates; a store of the first layout is read whole, which its diagnostics say."""
        r = search.Request(request) if isinstance(request, str) else request
        edges = incident_of(self.table("edges"), self.table("edges_by_target"))
        got = search.search(self.candidates(r), r, None)
        hits = search.with_edges(got.hits, edges(got.hits)) if r.include_edges else got.hits
        old = [{"reason": "migration_required", "item_id": self.folder, "details": {"layout": 1}}] if self._header()["layout"] < 2 else []
        return replace(got, hits=hits, omitted=[*got.omitted, *old], diagnostics=got.diagnostics | {"strategy": strategy(r) if not old else "full_scan"})

    def explain(self, request: search.Request | str) -> Explanation:
        r = search.Request(request) if isinstance(request, str) else request
        found = self.candidates(r)
        plan = self.spark._jvm.PythonSQLUtils.explainString(search.scored(found, r.query, r.node_ids)._jdf.queryExecution(), "simple")
        how = strategy(r) if self._header()["layout"] >= 2 else "full_scan"
        return Explanation(how, found.count(), self._header()["counts"]["nodes"], f"python -m loomgraph store-query {self.folder} {json.dumps(r.query)}", plan)

    def neighborhood(self, node_id: str, **how: object) -> DataFrame:
        return traverse.neighborhood(self.table("nodes"), self.table("edges"), node_id, **how)

    def path(self, source_id: str, target_id: str, **how: object) -> list[str] | None:
        return traverse.path(self.table("edges"), source_id, target_id, **how)

    def node(self, node_id: str) -> DataFrame:
        return self.table("nodes").where(F.col("id") == node_id)

    def apply_delta(self, new: Snapshot, fail_after: str = "") -> Update:
        """The store as the new snapshot: rows that went, came or changed are counted by id, and a new version is written if there are any."""
        if self._header()["layout"] < 2:
            raise GraphError("STORE_MIGRATION_REQUIRED", "deltas need the second layout", path=self.folder)
        counts = {r[0]: r[1] for r in delta(self.table("nodes"), new.nodes).unionByName(delta(self.table("edges"), new.edges)).groupBy("status").count().collect()}
        n = lambda what: counts.get(what, 0)
        version = self._version()
        if counts or self._header()["header"] != new.header or not same_rows(self.table("omitted"), new.omitted):
            version = self._write(new, fail_after=fail_after)
        return Update(n("added"), n("changed"), n("removed"), n("added") + n("changed"), version)

    def migrate(self) -> dict:
        """The first layout becomes the second; the second stays."""
        h = self._header()
        if h["layout"] not in (1, LAYOUT):
            raise GraphError("STORE_MIGRATION_UNSUPPORTED", "no way from this layout", layout=h["layout"])
        if h["layout"] == 1:
            self._write(self.export_snapshot())
        return self.manifest()


class JsonStore:
    """A store of one canonical JSON document: what the others are held against."""

    backend = "json"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.file = spark, path

    def import_snapshot(self, snapshot: Snapshot) -> dict:
        replace_text(self.spark, self.file, to_json(snapshot))
        return self.manifest()

    def export_snapshot(self) -> Snapshot:
        if not there(self.spark, self.file):
            raise GraphError("SNAPSHOT_NOT_FOUND", "no such snapshot", path=self.file)
        return from_json(self.spark, read_text(self.spark, self.file))

    def manifest(self) -> dict:
        s = self.export_snapshot()
        n, e, o = s.nodes.count(), s.edges.count(), s.omitted.count()
        return {"backend": self.backend, "layout": 0, "namespace": s.header.get("namespace", ""), "schema_version": s.header.get("schema_version", ""), "node_count": n, "edge_count": e, "omitted_count": o, "source_ref_count": n + e}

    def capabilities(self) -> dict:
        return {"backend": self.backend, "indexed_query": False, "delta": False, "traversal": True, "versions": False}

    def health(self) -> dict:
        s = self.export_snapshot()
        return {"ok": bool(s.header.get("schema_version")), "nodes": s.nodes.count(), "edges": s.edges.count(), "omitted": s.omitted.count()}

    def query(self, request: search.Request | str) -> search.Result:
        s = self.export_snapshot()
        return search.search(s.nodes, request, s.edges)

    def neighborhood(self, node_id: str, **how: object) -> DataFrame:
        s = self.export_snapshot()
        return traverse.neighborhood(s.nodes, s.edges, node_id, **how)

    def path(self, source_id: str, target_id: str, **how: object) -> list[str] | None:
        return traverse.path(self.export_snapshot().edges, source_id, target_id, **how)


def open_store(spark: SparkSession, path: str, backend: str = "parquet") -> GraphStore:
    makers = {"parquet": ParquetStore, "json": JsonStore}
    if backend not in makers:
        raise GraphError("STORE_BACKEND_UNSUPPORTED", "no such backend", backend=backend, available=sorted(makers))
    return makers[backend](spark, path)


def incident_of(by_source: DataFrame, by_target: DataFrame):
    """The edges at either end of a page of nodes, which goes to the edges; each side read in the order that it is sorted by."""

    def of(hits: DataFrame) -> DataFrame:
        ids = F.broadcast(hits.select(F.col("id").alias("n")))
        a = by_source.join(ids, F.col("source_id") == F.col("n"), "left_semi")
        b = by_target.join(ids, F.col("target_id") == F.col("n"), "left_semi")
        return a.unionByName(b).dropDuplicates(["id"])

    return of


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """status (added, changed or removed), id."""
    return compared([("", old, new, "id", True)]).select("status", F.col("item_id").alias("id"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeats included: by counts and sums of digests."""
    state = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return state(a) == state(b)


def round_trip(snapshot: Snapshot, store: ParquetStore | JsonStore) -> dict:
    """Import, export, and whether the canonical texts agree byte for byte."""
    before = to_json(snapshot)
    store.import_snapshot(snapshot)
    after = to_json(store.export_snapshot())
    return {"backend": store.backend, "bytes": len(before.encode()), "equal": before == after}


def query_plan(nodes: DataFrame, request: search.Request) -> DataFrame:
    """strategy, candidate_count, returned_count, omitted_count, complete: one row about a search."""
    total = search.scored(nodes, request.query, request.node_ids).agg(F.count(F.lit(1)).alias("candidate_count"))
    offset = search.read_cursor(request)
    got = F.least(F.lit(max(1, request.max_results)).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("candidate_count") - offset))
    out = total.withColumn("returned_count", got).withColumn("omitted_count", F.col("candidate_count") - offset - got)
    return out.select(F.lit("lexical_structural").alias("strategy"), "candidate_count", "returned_count", "omitted_count", (F.col("omitted_count") == 0).alias("complete"))


def first_per_id(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("kind"))).where("n = 1").drop("n")


def empty(spark: SparkSession, **header: object) -> Snapshot:
    return bundle(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES), None, **({"schema_version": SNAPSHOT_VERSION} | header))


def described(x: Explanation | Update) -> dict:
    return asdict(x)
