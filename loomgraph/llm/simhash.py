"""Near duplicates by SimHash and vantage-point trees.

Fingerprints within `radius` bits of each other differ by at most radius // blocks bits in one of `blocks` blocks, so
each block has a vantage-point tree of its own under that smaller radius. The top of a tree, built on a bounded sample,
cuts the fingerprints into shards by their Hamming distance to vantage points; a fingerprint lives in one shard and also
visits every shard that the triangle bound can't rule out. Inside a shard the tree goes on, down to small leaves, where
distances are computed. A shard gives a spanning forest of the links it finds, not the links, so a group of copies
costs a row a member; connected components of the forests are those of all links.

Edge cases: a null or wordless text has fingerprint zero, linked like any other; fewer words than a shingle are one
shingle; equal fingerprints are one node; rows with a null doc_id get the component of their fingerprint and never name
one; an empty table gives no rows.

similar() asks for near copies by Jaccard similarity instead: wider fingerprints over distinct shingles, so that a
repeated line counts once, only propose candidates; the sets of shingles decide.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.traverse import components
from .common import aside, cut, mapped, packed, partitions_for, spread, steps
from .nptext import U64, bit_counts, majority, mix, shingles

#: Shingle of the contract's fingerprint, bits that may differ, blocks that those are spread over.
SHINGLE, RADIUS, BLOCKS = 4, 4, 4
#: Fingerprints that the top of a tree is built on; how many a shard should hold; a leaf's most.
SAMPLE, SHARD, LEAF = 8192, 32768, 128
#: Fingerprints of one band of sizes that similar() compares with as many others in one go.
CHUNK = 16384
#: Sets of a component of candidates that are confirmed together; a larger component is cut into parts, each held against each.
CELL = 2048


def xxh_fingerprints(texts: pa.Array) -> np.ndarray:
    """64-bit SimHash over XXH64 (seed 42) of the space-joined 4-word shingles of the text with A-Z in lower case."""
    digest = xxhash.xxh64_intdigest
    hashes: list[np.ndarray] = []
    for t in texts.to_pylist():
        joined = b" ".join((t or "").encode().lower().split())
        if not joined:
            hashes.append(np.zeros(0, np.uint64))
            continue
        gap = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        start, end = [0, *(gap + 1).tolist()], [*gap.tolist(), len(joined)]
        if len(start) <= SHINGLE:
            hashes.append(np.array([digest(joined, 42)], np.uint64))
        else:
            hashes.append(np.array([digest(joined[s:e], 42) for s, e in zip(start, end[SHINGLE - 1 :])], np.uint64))
    n = np.array([len(h) for h in hashes], np.int64)
    begin = np.concatenate(([0], np.cumsum(n)))
    return majority(bit_counts(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), begin), n)[:, None]


def distinct_shingles(texts: pa.Array, shingle: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's distinct five-word shingles in order, and for each row the number of its first one."""
    data, off = packed(texts)
    h, begin = shingles(data, off, shingle)
    row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=len(begin) - 1)))).astype(np.int64)


def wide_fingerprints(texts: pa.Array, words: int = 4, shingle: int = 5) -> np.ndarray:
    """`words` independent 64-bit SimHashes over the distinct five-word shingles: rows x words."""
    return _wide(*distinct_shingles(texts, shingle), words)


def _wide(h: np.ndarray, begin: np.ndarray, words: int) -> np.ndarray:
    n = np.diff(begin)
    return np.stack([majority(bit_counts(mix(h + U64(k * 0x9E3779B97F4A7C15 % (1 << 64))), begin), n) for k in range(words)], axis=1)


def bits_for(similarity: float, bits: int) -> int:
    """The most bits that two texts are expected to differ by, whose equally large sets of shingles have that Jaccard similarity."""
    return round(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def fingerprinted(docs: DataFrame, make: Callable[[pa.Array], np.ndarray], words: int) -> DataFrame:
    """doc_id, f0, f1, ...: the fingerprint of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(batch, "text"):
                f = make(b.column(1)).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(f[:, k])) for k in range(words))], names=["doc_id", *(f"f{k}" for k in range(words))])

    return mapped(spread(docs.select("doc_id", "text")), run, "doc_id long, " + ", ".join(f"f{k} long" for k in range(words)))


def block(f: np.ndarray, k: int) -> np.ndarray:
    """Block k of the fingerprints (rows x words): 16 bits of them."""
    return (f[:, k // 4] >> U64(16 * (k % 4))).astype(np.uint16)


class Top:
    """The top levels of one block's tree, as a heap of vantage points and radii."""

    def __init__(self, values: np.ndarray, depth: int) -> None:
        self.depth = depth
        self.vantage, self.mu = np.zeros(1 << depth, np.uint16), np.zeros(1 << depth, np.int64)
        groups = [values]
        for node in range(1, 1 << depth):
            own = groups[node - 1]
            if len(own):
                self.vantage[node] = own[0]
                d = np.bitwise_count(own ^ own[0])
                # the radius that cuts most evenly; a vantage point lies at 0 itself
                self.mu[node] = min(range(16), key=lambda r: abs(2 * int((d <= r).sum()) - len(own)))
                groups += [own[d <= self.mu[node]][1:], own[d > self.mu[node]]]
            else:
                groups += [own, own]

    def route(self, v: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, at home) of each visit."""
        row, node, home = np.arange(len(v)), np.ones(len(v), np.int64), np.ones(len(v), bool)
        for _ in range(self.depth):
            d, mu = np.bitwise_count(v[row] ^ self.vantage[node]).astype(np.int64), self.mu[node]
            left, right = d <= mu + radius, d > mu - radius
            row, node, home = (np.concatenate(x) for x in ((row[left], row[right]), (2 * node[left], 2 * node[right] + 1), ((home & (d <= mu))[left], (home & (d > mu))[right])))
        return row, node - (1 << self.depth), home


def forest(f: np.ndarray, home: np.ndarray, k: int, radius: int, within: int) -> list[tuple[int, int]]:
    """Pairs of rows that join, of the rows of one shard (visitors aren't compared with each other), all that the links join whose block k differs by `within` bits or fewer.

    Where a block's value is so frequent that its tree can't cut a leaf further, the leaf is cut by the other blocks in
    turn: a link's bits are spread over these, so one of them differs by no more than the radius over their number.
    """
    blocks: dict[int, np.ndarray] = {}
    root = np.arange(len(f))
    found: list[tuple[int, int]] = []
    todo = [(np.flatnonzero(home), np.arange(len(f)), 0, k, within, tuple(i for i in range(4 * f.shape[1]) if i != k))]
    while todo:
        own, ask, depth, k, within, rest = todo.pop()
        if not len(own) or not len(ask):
            continue
        if k not in blocks:
            blocks[k] = block(f, k)
        v = blocks[k]
        if len(own) > LEAF:
            # any row will do as a vantage point; a middle one differs from level to level
            p = v[own[(7919 * (depth + 1)) % len(own)]]
            d, e = np.bitwise_count(v[own] ^ p).astype(np.int64), np.bitwise_count(v[ask] ^ p).astype(np.int64)
            mu = min(range(17), key=lambda r: abs(2 * int((d <= r).sum()) - len(own)))
            if depth < 40 and (d <= mu).any() and (d > mu).any():
                todo += [(own[d <= mu], ask[e <= mu + within], depth + 1, k, within, rest), (own[d > mu], ask[e > mu - within], depth + 1, k, within, rest)]
                continue
            if rest:
                near = ask[np.bitwise_count(v[ask] ^ p) <= within] if not d.any() else ask
                todo += [(own, near, 0, other, radius // len(rest), tuple(i for i in rest if i != other)) for other in rest]
                continue
        at = max(1, (1 << 20) // len(own))
        for s in range(0, len(ask), at):
            q = ask[s : s + at]
            i, j = np.nonzero(np.bitwise_count(v[q][:, None] ^ v[own][None, :]) <= within)
            a, b = q[i], own[j]
            # a home row meets every other home row of its leaf; each pair once, and none already joined
            far = np.zeros(len(a), np.int64)
            for w in range(f.shape[1]):
                far += np.bitwise_count(f[a, w] ^ f[b, w])
            ok = (far <= radius) & ((a < b) | ~home[a])
            a, b = a[ok], b[ok]
            new = root[a] != root[b]
            while new.any():
                a, b = a[new], b[new]
                x, y = root[a[0]], root[b[0]]
                found.append((int(a[0]), int(b[0])))
                root[root == max(x, y)] = min(x, y)
                new = root[a] != root[b]
    return found


def linked(prints: DataFrame, words: int, radius: int, blocks: int) -> DataFrame:
    """prints with `component_id`: the least doc_id reached over links of at most `radius` bits; blocks times a block's radius cover every link (pigeonhole)."""
    spark = prints.sparkSession
    names = [f"f{k}" for k in range(words)]
    within = radius // blocks
    prints = cut(prints)
    # one node a fingerprint; of several words, the first is enough to hash by and a digest stands for all
    node = F.col("f0") if words == 1 else F.xxhash64(*names)
    nodes = cut(prints.groupBy(*names).agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies")).withColumn("node", node))
    n = nodes.count()
    if n == 0:
        return prints.withColumn("component_id", F.col("doc_id"))
    depth = max(0, math.ceil(math.log2(n / SHARD))) if n > SHARD else 0
    sample = nodes.select(*names).orderBy(F.xxhash64(*names, F.lit(7)), *names).limit(SAMPLE).collect()
    picked = np.array([list(r) for r in sample], np.int64).reshape(len(sample), words).view(np.uint64)
    tops = [Top(block(picked, k), depth) for k in range(blocks)]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.stack([batch.column(k).to_numpy() for k in range(words)], axis=1).view(np.uint64)
            for k, top in enumerate(tops):
                row, leaf, home = top.route(block(f, k), within)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array((k << 24 | leaf).astype(np.int32)), pa.array(home), batch.column(words).take(take), *(batch.column(i).take(take) for i in range(words))], names=["shard", "home", "node", *names])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        shard = None

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            f = np.stack([t.column(x).to_numpy() for x in names], axis=1).view(np.uint64)
            ids = t.column("node").to_numpy()
            pairs = np.array(forest(f, t.column("home").to_numpy(), shard >> 24, radius, within), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, 0]]), pa.array(ids[pairs[:, 1]])], names=["a", "b"])

        for batch in batches:
            keys = batch.column(0).to_numpy()
            start = 0
            for end in [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []:
                if held and keys[start] != shard:
                    yield done()
                    held = []
                shard = int(keys[start])
                held.append(batch.slice(start, end - start))
                start = end
        if held:
            yield done()

    visits = mapped(nodes.select(*names, "node"), route, "shard int, home boolean, node long, " + ", ".join(f"{x} long" for x in names))
    shards = visits.repartition(max(1, min(blocks << depth, 4 * partitions_for(spark))), "shard").sortWithinPartitions("shard", "node")
    roots = components(mapped(shards, search, "a long, b long"))
    # The component's id: the least of its nodes' least ids; nodes without a link keep their own.
    marked = nodes.join(roots, "node", "left").select(*names, "id", F.coalesce("root", "node").alias("root"))
    marked = cut(marked)
    least = marked.groupBy("root").agg(F.min("id").alias("component_id"))
    named = marked.join(least, "root").select(*names, "component_id")
    return prints.join(named, names)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every document, by the contract's 64-bit fingerprint and 4 bits."""
    done = linked(fingerprinted(docs, xxh_fingerprints, 1), 1, RADIUS, BLOCKS)
    return done.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def size_bounds(similarity: Fraction, most: int) -> np.ndarray:
    """Least size of each band, up to size `most`: sets of that Jaccard similarity lie in one band or in two that adjoin."""
    out = [0, 1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, math.ceil(out[-1] / similarity)))
    return np.array(out)


def near_pairs(f: np.ndarray, size: np.ndarray, first: np.ndarray, radius: int, similarity: Fraction) -> list[tuple[int, int]]:
    """Pairs of rows that join what all links join: of the rows marked `first` with the others, or with each other if there are no others.

    A link is at most `radius` bits between sets whose sizes allow the similarity.
    """
    own, ask = np.flatnonzero(first), np.flatnonzero(~first)
    same = not len(ask)
    ask = own if same else ask
    cols = [np.ascontiguousarray(f[own, w]) for w in range(f.shape[1])]
    root = np.arange(len(f))
    found: list[tuple[int, int]] = []
    at = max(1, (1 << 19) // max(1, len(own)))
    for s in range(0, len(ask), at):
        q = ask[s : s + at]
        far = np.zeros((len(q), len(own)), np.uint16)
        for w in range(max(1, f.shape[1] - 1)):
            far += np.bitwise_count(f[q, w][:, None] ^ cols[w][None, :])
        i, j = np.nonzero(far <= radius)
        d = far[i, j]
        if f.shape[1] > 1:
            d = d + np.bitwise_count(f[q[i], -1] ^ cols[-1][j])
        a, b = q[i], own[j]
        low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        ok = (d <= radius) & (similarity.denominator * low >= similarity.numerator * high)
        if same:
            ok &= a < b
        a, b = a[ok], b[ok]
        new = root[a] != root[b]
        a, b = a[new], b[new]
        for x in np.unique(a).tolist():
            others = b[a == x]
            roots, at_ = np.unique(root[others], return_index=True)
            other = roots != root[x]
            if other.any():
                found += [(x, int(y)) for y in others[at_[other]]]
                root[np.isin(root, roots) | (root == root[x])] = min(int(roots.min()), int(root[x]))
    return found


def similar_sets(sets: list[np.ndarray], similarity: Fraction) -> np.ndarray:
    """For each set (sorted hashes) the least row that links of exactly that Jaccard similarity or more join it to.

    Prefix filter: with the rarest hashes first, two such sets share one of their first |set| - ceil(similarity |set|) + 1.
    """
    num, den = similarity.numerator, similarity.denominator
    size = np.array([len(x) for x in sets], np.int64)
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    edges = np.concatenate(([0], np.cumsum(size)))
    ranked = [np.sort(rank[code[a:z]]) for a, z in zip(edges[:-1].tolist(), edges[1:].tolist())]
    held: dict[int, list[int]] = {}
    mark = np.zeros(len(count), bool)
    for b in np.argsort(size, kind="stable").tolist():
        mine, n = ranked[b], int(size[b])
        head = mine[: n + num * -n // den + 1].tolist() if n else []
        mark[mine] = True
        seen: set[int] = set()
        for token in head:
            for a in held.get(token, ()):
                if a in seen:
                    continue
                seen.add(a)
                m = int(size[a])
                if den * m >= num * n and find(a) != find(b) and (num + den) * int(mark[ranked[a]].sum()) >= num * (m + n):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
        mark[mine] = False
        for token in head:
            held.setdefault(token, []).append(b)
    return np.array([find(x) for x in range(len(sets))])


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each value of the first column, by which the batches are sorted."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = batch.column(0).to_numpy()
        start = 0
        for end in [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []:
            if held and keys[start] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = keys[start]
            held.append(batch.slice(start, end - start))
            start = end
    if held:
        yield pa.Table.from_batches(held)


def similar_prints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, row_key, text_key, node (a digest of the set of distinct shingles), size of that set, f0, f1, ...: of every whole text."""
    names = [f"f{k}" for k in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(batch, "text"):
                h, begin = distinct_shingles(b.column(3))
                f = _wide(h, begin, words).view(np.int64)
                edges = begin.tolist()
                node = np.array([xxhash.xxh64_intdigest(h[a:z].tobytes()) for a, z in zip(edges, edges[1:])], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(node), pa.array(np.diff(begin)), *(pa.array(np.ascontiguousarray(f[:, k])) for k in range(words))], names=["doc_id", "row_key", "text_key", "node", "size", *names])

    return mapped(docs.select("doc_id", row_key(docs).alias("row_key"), text_key().alias("text_key"), "text"), run, "doc_id long, row_key long, text_key long, node long, size long, " + ", ".join(f"{x} long" for x in names))


def text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def row_key(docs: DataFrame) -> Column:
    """A digest of the whole row; rows that share it are the same in every column."""
    return F.xxhash64(*docs.columns, *(F.col(c).isNull() for c in docs.columns))


def similar(docs: DataFrame, similarity: float = 0.8, words: int = 4) -> DataFrame:
    """doc_id, component_id: the least doc_id of the documents that similar_rows() joins."""
    marked = similar_rows(docs, similarity, words)
    least = marked.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return marked.join(least, "root").select("doc_id", "component_id")


def one_each(docs: DataFrame) -> DataFrame:
    """One row of every component of similar_rows(): that of the least doc_id, null last; of rows that share it any one, the same at every run."""
    docs, named = aside(docs, "doc_id", "text")
    rows = similar_rows(docs).groupBy("root", "row_key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumn("place", F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))
    best = rows.groupBy("root").agg(F.min("place").alias("best"))
    gone = cut(rows.join(best, "root").where(F.col("place") != F.col("best")).select("row_key"))
    # equal rows become one before they are shuffled; the join finds the texts where that left them
    once = docs.withColumn("row_key", row_key(docs)).dropDuplicates(["row_key"])
    return named(once.join(gone, "row_key", "left_anti"))


def similar_rows(docs: DataFrame, similarity: float = 0.8, words: int = 4) -> DataFrame:
    """doc_id, row_key, root of every row: rows of one root are joined by links between texts whose sets of distinct five-word shingles have that Jaccard similarity or more.

    Candidates are all pairs of fingerprints within five standard deviations of the bits expected at that similarity, of
    sets whose sizes allow it; every component of candidates is then cut by the exact similarities of its sets, a large one
    in cells of a bounded number of sets.
    """
    spark, names, bits = docs.sparkSession, [f"f{k}" for k in range(words)], 64 * words
    t = Fraction(str(similarity))
    share = bits_for(similarity, bits) / bits
    radius = round(bits * share + 5 * math.sqrt(bits * share * (1 - share)))
    prints = cut(similar_prints(docs, words))
    nodes = cut(prints.groupBy("node").agg(F.min("text_key").alias("text_key"), F.first("size").alias("size"), *(F.first(x).alias(x) for x in names)))
    most = nodes.agg(F.max("size")).first()[0]
    if most is None:
        return prints.select("doc_id", "row_key", F.col("node").alias("root"))
    bounds = size_bounds(t, most)
    band = F.array_size(F.filter(F.array(*(F.lit(int(x)) for x in bounds)), lambda x: x <= F.col("size"))) - 1
    nodes = nodes.withColumn("band", band.cast("int"))
    chunks = np.zeros(len(bounds) + 1, np.int64)
    for r in nodes.groupBy("band").count().collect():
        chunks[r[0]] = -(-r[1] // CHUNK)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a chunk meets every chunk of its band and of the next; a meeting is numbered by the two chunks
        base = np.concatenate(([0], np.cumsum(chunks)))
        for batch in batches:
            b, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            own = base[b] + (mix(node.view(np.uint64)) % chunks[b].astype(np.uint64)).astype(np.int64)
            low = base[np.maximum(b - 1, 0)]
            many = base[b + 2] - low
            row = np.repeat(np.arange(len(b)), many)
            other = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + low[row]
            mine = own[row]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(mine, other) << 32 | np.maximum(mine, other)), pa.array(mine <= other), *(batch.column(i).take(take) for i in range(1, batch.num_columns))], names=["shard", "first", "node", "size", *names])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs_of(batches):
            first, shard = group.column("first").to_numpy(), int(group.column("shard")[0].as_py())
            if shard >> 32 != shard & 0xFFFFFFFF and first.all() or not first.any():
                continue
            f = np.stack([group.column(x).to_numpy() for x in names], axis=1).view(np.uint64)
            ids = group.column("node").to_numpy()
            pairs = np.array(near_pairs(f, group.column("size").to_numpy(), first, radius, t), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, 0]]), pa.array(ids[pairs[:, 1]])], names=["a", "b"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs_of(batches):
            ids = group.column("node").to_numpy()
            sets: list[np.ndarray] = []
            for batch in group.to_batches():
                for b in steps(batch, "text"):
                    h, begin = distinct_shingles(b.column(3))
                    sets += [h[a:z] for a, z in zip(begin[:-1].tolist(), begin[1:].tolist())]
            hot = group.column("hot").combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[similar_sets(sets, t)]), hot.chunk(0) if isinstance(hot, pa.ChunkedArray) else hot], names=["node", "root", "hot"])

    visits = mapped(nodes.select("band", "node", "size", *names), meet, "shard long, first boolean, node long, size long, " + ", ".join(f"{x} long" for x in names))
    shards = visits.repartition(4 * partitions_for(spark), "shard").sortWithinPartitions("shard")
    loose = components(mapped(shards, search, "a long, b long"))
    asked = cut(nodes.select("node", "text_key").join(loose, "node"))
    texts = docs.select(text_key().alias("text_key"), "text").join(asked.select("text_key"), "text_key", "left_semi").groupBy("text_key").agg(F.max("text").alias("text"))
    # components of up to CELL sets are one cell; a larger one has one for each two of its parts, so no task holds it whole
    large = asked.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL).select("root", F.ceil(F.col("n") / CELL).cast("int").alias("parts"))
    members = asked.join(texts, "text_key").join(large, "root", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own, other = F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    members = members.withColumn("own", own).withColumn("other", other)
    cell = F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other"))
    members = members.select(cell.alias("cell"), (F.col("parts") > 1).alias("hot"), "node", F.coalesce("text", F.lit("")).alias("text"))
    members = members.repartition(partitions_for(spark), "cell").sortWithinPartitions("cell", "node")
    found = cut(mapped(members, confirm, "node long, root long, hot boolean"))
    joined = components(found.where("hot and node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    exact = found.where("not hot").select("node", "root").unionByName(joined)
    return cut(prints.select("doc_id", "row_key", "node").join(exact, "node", "left").select("doc_id", "row_key", F.coalesce("root", "node").alias("root")))
