"""Exact top-k by integer inner product in three phases with a uniform threshold.

The vectors' dimensions fall into `LISTS` groups; a row's partial score in each group is one local score list, and the
rows into shards. Phase 1: in every shard each list gives its k best entries for a query, whose scores are summed over
all lists; the k-th best of these sums over all shards is the query's cutoff, which no true top-k score is below.
Phase 2: the cutoff goes back to every shard, and each list gives its entries of at least cutoff / lists: a row with
none can't reach the cutoff. Phase 3: for rows whose upper bound (their entries, plus the threshold for the lists they
miss) reaches the cutoff, the missing scores are resolved exactly and those that reach it are collected.

Queries and rows meet in cells of at most QUERY_BLOCK x SHARD_ROWS: nothing is broadcast and no score of a whole
block is kept. Only rows of equal length are compared.

Edge cases: vectors that are null or hold null or non-finite components take no part, neither do null ids; rows that
repeat an id are candidates each, but never of a query of that id; equal scores go to the smaller vec_id; fewer than
k candidates give all; empty tables give no rows. A score beyond 64 bits raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, mapped

LISTS, QUERY_BLOCK, SHARD_ROWS, SCALE = 4, 2048, 8192, 1024
#: Queries scored at once in a task.
STEP = 256


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v: floor(scale * x) of every component, of the rows that take part."""
    whole = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(whole & finite).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def partials(q: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """Each list's scores, queries x rows, as exact integers."""
    top = (int(np.abs(q).max(initial=0)), int(np.abs(c).max(initial=0)))
    if top[0] * top[1] * q.shape[1] >= 1 << 63:
        raise OverflowError("an inner product may pass 64 bits")
    exact = top[0] * top[1] * q.shape[1] < 1 << 53
    groups = np.array_split(np.arange(q.shape[1]), min(LISTS, q.shape[1]))
    if exact:  # float64 products and sums are exact below 2**53, and use BLAS
        return [(q[:, g].astype(np.float64) @ c[:, g].astype(np.float64).T).astype(np.int64) for g in groups]
    return [q[:, g] @ c[:, g].T for g in groups]


def _cells(vectors: DataFrame, every: int) -> tuple[DataFrame, int, int]:
    counts = vectors.agg(F.count(F.lit(1)), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    shards, blocks = max(1, -(-counts[0] // SHARD_ROWS)), max(1, -(-counts[1] // QUERY_BLOCK))
    place = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    rows = vectors.withColumn("shard", place(shards, 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # rows that repeat a query's id ask once, with the least of their vectors
    asked = vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("block", place(blocks, 2)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return rows.withColumn("asked", F.lit(False)), asked.withColumn("asked", F.lit(True)), shards * blocks


def _each_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list, np.ndarray, np.ndarray]]:
    """(queries' ids, vectors and cutoffs, rows' ids and vectors) of each (dim, shard, block), in slices of STEP queries; the input is sorted by these, queries first."""
    key, held = None, []

    def cell() -> Iterator[tuple]:
        ids, flat, asked = (np.concatenate([h[k] for h in held]) for k in range(3))
        cut, v = [x for h in held for x in h[3]], flat.reshape(len(ids), -1)
        n = int(asked.sum())
        if n and n < len(ids):
            for at in range(0, n, STEP):
                to = min(n, at + STEP)
                yield ids[at:to], v[at:to], cut[at:to], ids[n:], v[n:]

    for batch in batches:
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        ids, asked, dims = (col[c].to_numpy(zero_copy_only=False) for c in ("vec_id", "asked", "dim"))
        keys = np.stack([dims, *(col[c].to_numpy(zero_copy_only=False) for c in ("shard", "block"))], axis=1)
        ends = [*(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
        flat, at, start = col["v"].flatten().to_numpy(), np.concatenate(([0], np.cumsum(dims))), 0
        for end in ends if len(keys) else []:
            k = tuple(keys[start])
            if k != key and held:
                yield from cell()
                held = []
            key = k
            held.append((ids[start:end], flat[at[start] : at[end]], asked[start:end], col["cutoff"].slice(start, end - start).to_pylist()))
            start = end
    if held:
        yield from cell()


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of every row whose vec_id is divisible by `every`."""
    vectors = cut(quantised(vectors, scale))
    rows, asked, cells = _cells(vectors, every)
    parts = min(max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), max(1, cells))

    def together(asked: DataFrame) -> DataFrame:
        both = rows.withColumn("cutoff", F.lit(None).cast("long")).unionByName(asked).withColumn("dim", F.size("v"))
        return both.repartition(parts, "dim", "shard", "block").sortWithinPartitions("dim", "shard", "block", F.col("asked").desc(), "vec_id")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asked, q, _, ids, v in _each_cell(batches):
            lists = partials(q, v)
            total = sum(lists[1:], lists[0])
            out: tuple[list, list] = ([], [])
            for i, query in enumerate(asked.tolist()):
                # as many more as the query's own rows, which are among the entries and leave
                n = min(len(ids), k + int((ids == query).sum()))
                best = np.unique(np.concatenate([np.argpartition(-p[i], n - 1)[:n] for p in lists]))
                mine = np.sort(total[i, best[ids[best] != query]])[::-1][:k]
                out[0].extend([query] * len(mine))
                out[1].extend(mine.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["query_id", "score"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asked, q, cutoffs, ids, v in _each_cell(batches):
            lists = partials(q, v)
            out: tuple[list, list, list] = ([], [], [])
            for i, (query, cutoff) in enumerate(zip(asked.tolist(), cutoffs)):
                cutoff = -(1 << 62) if cutoff is None else cutoff
                least = -(-cutoff // len(lists))
                bound, met = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
                for p in lists:
                    enough = p[i] >= least
                    met |= enough
                    bound += np.where(enough, p[i], least)
                left = np.flatnonzero(met & (bound >= cutoff) & (ids != query))
                score = np.zeros(len(left), np.int64)
                for p in lists:
                    score += p[i, left]
                good = np.flatnonzero(score >= cutoff)
                # at most k of one cell's rows can be among the best k, and ties go by id there as they do in the end
                good = good[np.lexsort((ids[left[good]], -score[good]))[:k]]
                out[0].extend([query] * len(good))
                out[1].extend(ids[left[good]].tolist())
                out[2].extend(score[good].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["query_id", "vec_id", "score"])

    first = mapped(together(asked.withColumn("cutoff", F.lit(None).cast("long"))), gather, "query_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    # The k-th best sum; a query with fewer than k rows in all has none, and takes every row.
    kth = first.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("cutoff"))
    found = mapped(together(asked.join(kth, "vec_id", "left").select(*rows.columns, "cutoff")), collect, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
