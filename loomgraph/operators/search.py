"""Lexical search: additive scores over one scan, a total order, pages by cursor, and refusal beyond a work budget."""

from __future__ import annotations

import json
import re
from base64 import urlsafe_b64decode, urlsafe_b64encode
from dataclasses import dataclass, field, replace
from functools import reduce
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import haystack, snippet, tokens
from ..schema import CURSOR_VERSION, GraphError
from ..session import cut

#: Hits up to which a page is found and counted in one pass over the nodes, its rows held by the driver.
ONE_PASS = 10_000
PARTS = {"requested_node_id": 1000.0, "exact_id": 900.0, "exact_path": 700.0, "exact_label": 500.0, "substring": 50.0}


@dataclass(frozen=True)
class Request:
    query: str
    node_ids: tuple[str, ...] = ()
    max_results: int = 10  # 1 at least
    cursor: str = ""
    max_examined: int | None = None
    include_edges: bool = True


@dataclass(frozen=True)
class Result:
    hits: DataFrame
    omitted: list[dict] = field(default_factory=list)
    diagnostics: dict = field(default_factory=dict)
    next_cursor: str = ""


def order() -> list[Column]:
    return [F.col("score").desc(), F.col("kind"), F.col("path"), F.col("id")]


def _tests(query: str, node_ids: tuple[str, ...], hay: Column) -> tuple[dict[str, Column], list[str]]:
    """What scores by itself, and the query's words. An empty query matches requested ids only."""
    q, no = query.strip().lower(), F.lit(False)
    tests = {
        "requested_node_id": F.col("id").isin(*node_ids) if node_ids else no,
        "exact_id": F.lower("id") == q if q else no,
        "exact_path": F.lower("path") == q if q else no,
        "exact_label": F.lower("label") == q if q else no,
        "substring": F.contains(hay, F.lit(q)) if q else no,
    }
    return tests, sorted({t for t in re.split(r"[^a-zA-Z0-9_]+", q) if t})


def _has(hay: Column, word: str) -> Column:
    """Whether a word is one of a text's tokens: cheaper than cutting the text into tokens."""
    return F.contains(hay, F.lit(word)) & F.rlike(hay, F.lit(f"(?<![a-zA-Z0-9_]){word}(?![a-zA-Z0-9_])"))


def ranked(nodes: DataFrame, query: str, node_ids: tuple[str, ...] = ()) -> DataFrame:
    """nodes that score, with matched_tokens and score: all that their order needs. One projection over one scan."""
    def any_hit(hay: Column) -> Column:
        tests, words = _tests(query, node_ids, hay)
        return reduce(lambda a, b: a | b, [*tests.values(), *(_has(hay, w) for w in words)])

    hay = F.lower(haystack())
    # the filter makes each text once (an array of one), since what it repeats is evaluated again; it leaves what scores
    df = nodes.where(F.exists(F.array(hay), any_hit)).withColumn("hay", hay)
    tests, words = _tests(query, node_ids, F.col("hay"))
    met = F.array_compact(F.array(*(F.when(_has(F.col("hay"), w), w) for w in words))) if words else F.array().cast("array<string>")
    score = sum((F.when(t, PARTS[k]).otherwise(0.0) for k, t in tests.items()), F.lit(0.0)) + F.size("matched_tokens") * 10.0
    return df.withColumn("matched_tokens", met).withColumn("score", score).drop("hay")


def detailed(hits: DataFrame, query: str, node_ids: tuple[str, ...] = ()) -> DataFrame:
    """ranked() nodes, or the best of them, with matched_fields, exact_match and snippet."""
    tests, _ = _tests(query, node_ids, F.lower(haystack()))
    names = {"requested_node_id": "id", "exact_id": "id", "exact_path": "source_ref.path", "exact_label": "label", "substring": "haystack"}
    fields = F.array_distinct(F.array_compact(F.array(*(F.when(t, names[k]) for k, t in tests.items()), F.when(F.size("matched_tokens") > 0, "tokens"))))
    exact = F.coalesce(*(F.when(tests[k], names[k]) for k in ("exact_label", "exact_path", "exact_id", "requested_node_id")), F.lit(""))
    return hits.withColumn("matched_fields", fields).withColumn("exact_match", exact).withColumn("snippet", snippet())


def scored(nodes: DataFrame, query: str, node_ids: tuple[str, ...] = ()) -> DataFrame:
    """nodes that score, with score, its parts, matched_fields, matched_tokens, exact_match and snippet; nothing is shuffled."""
    return detailed(ranked(nodes, query, node_ids), query, node_ids)


def page(hits: DataFrame, offset: int, limit: int) -> DataFrame:
    """Hits ranked offset + 1 to offset + limit: a top-k, then its tail, so no global sort is needed."""
    return hits.orderBy(*order()).limit(offset + limit).offset(offset) if offset else hits.orderBy(*order()).limit(limit)


def fingerprint(r: Request) -> str:
    return sha256(repr((r.query, tuple(r.node_ids), r.max_results, r.max_examined, r.include_edges)).encode()).hexdigest()


def make_cursor(r: Request, offset: int) -> str:
    raw = json.dumps([CURSOR_VERSION, fingerprint(r), offset])
    return urlsafe_b64encode(raw.encode()).decode().rstrip("=")


def read_cursor(r: Request) -> int:
    if not r.cursor:
        return 0
    try:
        missing = -len(r.cursor) % 4
        version, of, offset = json.loads(urlsafe_b64decode(r.cursor + missing * "="))
        if version != CURSOR_VERSION or type(offset) is not int or offset < 0:
            raise ValueError("another version, or no offset")
    except (ValueError, TypeError) as e:
        raise GraphError("INVALID_QUERY_CURSOR", "the cursor is malformed", error=str(e)) from e
    if of != fingerprint(r):
        raise GraphError("QUERY_CURSOR_MISMATCH", "the cursor belongs to another request")
    return offset


def search(nodes: DataFrame, request: Request | str, edges: DataFrame | None = None) -> Result:
    """A page of hits, with their incident edges (`edges`: sorted ids) if asked for."""
    r = Request(request) if isinstance(request, str) else request
    r = replace(r, max_results=max(1, r.max_results))
    offset = read_cursor(r)
    hits = ranked(nodes, r.query, r.node_ids)
    full = lambda df: detailed(df, r.query, r.node_ids)
    # a budget is checked on what would be scored, before any of it is
    if r.max_examined is not None and (examined := nodes.count()) > r.max_examined:
        why = [{"reason": "work_budget_exhausted", "item_id": "query", "details": {"candidates": examined, "max_examined": r.max_examined}}]
        return Result(full(hits.limit(0)), why, {"work_budget_exhausted": True, "examined_count": examined})
    if offset + r.max_results <= ONE_PASS:
        # hits are counted while the best of them are found, and only those get their details
        seen = Observation()
        best = full(hits.observe(seen, F.count(F.lit(1)).alias("n")).orderBy(*order()).limit(offset + r.max_results))
        rows = best.collect()
        total, out = seen.get["n"], hits.sparkSession.createDataFrame(rows[offset:], best.schema)
    else:
        total, out = hits.count(), full(page(hits, offset, r.max_results))
    if offset > total:
        raise GraphError("QUERY_CURSOR_OUT_OF_RANGE", "the cursor lies beyond the results", offset=offset, candidate_count=total)
    to = min(total, offset + r.max_results)
    if edges is not None and r.include_edges:
        out = with_edges(out, edges)
    left = total - to
    omitted = [{"reason": "max_results", "item_id": "query", "details": {"omitted": left}}] if left else []
    return Result(out, omitted, {"candidate_count": total, "page_offset": offset, "page_complete": not left, "work_budget_exhausted": False}, make_cursor(r, to) if left else "")


def incident(edges: DataFrame) -> DataFrame:
    """node_id and the edge, once for each end (once for a loop)."""
    a = edges.withColumn("node_id", F.col("source_id"))
    return a.unionByName(edges.where("source_id <> target_id").withColumn("node_id", F.col("target_id")))


def with_edges(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """hits (a page of them) with edge_ids, the sorted ids of all their edges; only the hits' own edges are gathered."""
    hits = cut(hits)  # read twice
    own = incident(edges.select("id", "source_id", "target_id")).withColumnRenamed("id", "edge_id").join(F.broadcast(hits.select(F.col("id").alias("node_id"))), "node_id", "left_semi")
    lists = own.groupBy("node_id").agg(F.sort_array(F.collect_list("edge_id")).alias("edge_ids")).withColumnRenamed("node_id", "id")
    return hits.join(lists, "id", "left").withColumn("edge_ids", F.coalesce("edge_ids", F.array().cast("array<string>")))


def match_summary(hits: DataFrame) -> DataFrame:
    """hits with `summary`: exact:, field:, token: and score: lines."""
    line = lambda name, c: F.transform(c, lambda x: F.concat(F.lit(name), x))
    exact = F.array_compact(F.array(F.when(F.col("exact_match") != "", F.concat(F.lit("exact:"), "exact_match"))))
    return hits.withColumn("summary", F.array_distinct(F.concat(exact, line("field:", F.col("matched_fields")), line("token:", F.col("matched_tokens")))))


def token_index(nodes: DataFrame) -> DataFrame:
    """(token, id) of every node: an inverted index over the scorer's own tokens."""
    return nodes.select(F.explode(tokens(haystack())).alias("token"), "id")


def document_frequency(nodes: DataFrame) -> DataFrame:
    return token_index(nodes).groupBy("token").agg(F.count(F.lit(1)).alias("nodes"))
