"""Threshold-scaled document fingerprints.

A fingerprint keeps every hash of a document's five-word shingles below a fixed fraction of the hash range, so its size
follows the document's, the union of fingerprints is the fingerprint of the union, and resemblance and containment can
be estimated between documents of very unequal length. As text: shingles counted, a digest of the word sequence, and
the kept hashes in ascending order (base64 of big-endian 64-bit words).

Edge cases: a null text counts as empty; no words give a fingerprint without hashes; fewer than five words are one
shingle; when two fingerprints keep no hash, they are alike (1) only if their word sequences are equal; rows that repeat
a doc_id stand in the order of their texts; an empty table gives no rows; the only document follows itself.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, packed, partitions_for, steps
from .nptext import U64, prefix_hashes, shingles, span_hashes

SHINGLE, ONE_IN = 5, 4
_LIMIT = U64((1 << 64) // ONE_IN - 1)
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class Sketch:
    """The kept hashes of one text, sorted, with the count of its shingles and its words' digest."""

    __slots__ = ("count", "digest", "kept")

    def __init__(self, count: int, digest: int, kept: np.ndarray) -> None:
        self.count, self.digest, self.kept = count, digest, kept

    def __str__(self) -> str:
        return f"{self.count:x}:{self.digest:016x}:{base64.b64encode(self.kept.astype('>u8').tobytes()).decode()}"

    @classmethod
    def parse(cls, text: str) -> Sketch:
        count, digest, kept = text.split(":")
        return cls(int(count, 16), int(digest, 16), np.frombuffer(base64.b64decode(kept), ">u8").astype(np.uint64))

    def merged(self, other: Sketch) -> Sketch:
        """The fingerprint of both documents' shingles together (its count is an upper bound)."""
        return Sketch(self.count + other.count, self.digest ^ other.digest, np.union1d(self.kept, other.kept))


def _common(a: Sketch, b: Sketch) -> int:
    both = np.concatenate((a.kept, b.kept))
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated resemblance: common shingles over all."""
    if a.digest == b.digest and a.count == b.count:
        return 1.0
    if not len(a.kept) and not len(b.kept):
        return 0.0
    common = _common(a, b)
    return common / (len(a.kept) + len(b.kept) - common)


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated part of a's shingles that b has too."""
    if a.digest == b.digest and a.count == b.count:
        return 1.0
    return _common(a, b) / len(a.kept) if len(a.kept) else 0.0


def sketches(texts: pa.Array) -> list[Sketch]:
    data, off = packed(texts)
    h, begin = shingles(data, off, SHINGLE)
    # a digest of the shingles in order, so of the word sequence
    whole = span_hashes(prefix_hashes(h.view(np.uint8)), begin[:-1] * 8, begin[1:] * 8).tolist()
    row = np.repeat(np.arange(len(off) - 1), np.diff(begin))
    few = h <= _LIMIT
    h, row = h[few], row[few]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    at = np.searchsorted(row, np.arange(len(off)))
    return [Sketch(int(begin[i + 1] - begin[i]), whole[i], h[at[i] : at[i + 1]]) for i in range(len(off) - 1)]


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, order): each but a part's last is followed by the next; rows with `only_next` just follow."""
    last: tuple | None = None
    for batch in batches:
        for b in steps(batch, "text"):
            text = b.column(3).fill_null("")
            own = sketches(text)
            rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), text.to_pylist(), own))
            rows, last = ([last] if last else []) + rows, rows[-1]
            pairs = [(a, z) for a, z in zip(rows, rows[1:]) if a[0] == z[0] and not a[1]]
            changed = [_edited(a[3], z[3]) for a, z in pairs]
            near = sketches(pa.array(changed, pa.string()))
            out = [
                (a[2], len(a[3]), hashlib.sha256(t.encode()).hexdigest(), str(a[4]), str(e), likeness(a[4], e), likeness(a[4], z[4]))
                for (a, z), t, e in zip(pairs, changed, near)
            ]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            cols = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _labels(spark: SparkSession, n: int) -> list[int]:
    """n numbers that hash partitioning sends to n different tasks."""
    found: dict[int, int] = {}
    size = 16 * n
    while len(found) < n:
        ids = spark.range(size).select(F.col("id").cast("int").alias("id"))
        found = {slot: label for label, slot in ids.groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("slot")).agg(F.min("id").alias("id")).select("id", "slot").collect()}
        size *= 4
    return [found[slot] for slot in range(n)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text (its last half replaced by the start of the next document).

    The next document is found without a global order on one task: documents go by ranges of doc_id to parts, each
    sorted by itself, and one copy of each part's first document goes to the part before, to follow its last. The text
    is shuffled once; what reaches the driver is one (part, first doc_id) row a part.
    """
    parts = max(1, partitions_for(docs.sparkSession))
    docs = docs.select("doc_id", "text")
    low = F.coalesce("doc_id", F.lit(-(1 << 63)))
    bounds = docs.agg(F.percentile_approx(low, [k / parts for k in range(1, parts)] or [0.5], 100 * parts)).first()[0] or []
    bounds = sorted(set(bounds)) if parts > 1 else []
    labels = _labels(docs.sparkSession, len(bounds) + 1)

    # the part is the number of bounds below the id: a binary search, as nested WHENs of logarithmic depth
    def search(a: int, b: int) -> Column:
        if a == b:
            return F.lit(labels[a])
        m = (a + b) // 2
        return F.when(low <= F.lit(bounds[m]), search(a, m)).otherwise(search(m + 1, b))

    placed = docs.select(search(0, len(bounds)).alias("part"), F.lit(False).alias("only_next"), "doc_id", "text")
    firsts = sorted((r[1], r[0]) for r in placed.groupBy("part").agg(F.min(low)).collect())
    if not firsts:
        return mapped(placed.limit(0), _run, OUT)
    # a part's first document follows up on the part before; the first part's on the last, to close the ring
    where = F.create_map(*(F.lit(x) for k, (first, _) in enumerate(firsts) for x in (first, firsts[k - 1][1])))
    first_rows = placed.where(low.isin([first for first, _ in firsts]))
    # of rows that share a first doc_id only the first by text follows
    first_rows = first_rows.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    both = placed.unionByName(first_rows.select(where[low].alias("part"), F.lit(True).alias("only_next"), "doc_id", "text"))
    return mapped(both.repartition(len(labels), "part").sortWithinPartitions("part", "only_next", "doc_id", F.coalesce("text", F.lit(""))), _run, OUT)
