"""Exact substring dedup: every byte covered by a string of `length` bytes that also starts elsewhere.

A suffix array over every byte (suffixes.py has it, by difference covers) shuffles hundreds of bytes per byte of text, far
more than a corpus may take on disk; the README has figures.
The production path keeps the idea of naming sampled positions and settling the rest by their names, but samples by
content: of the K-byte strings in every window of `length` bytes the one with the least hash is its anchor, so equal
windows have their anchor at the same place. Windows in a row that share an anchor form a block, and

1. blocks whose anchor's string occurs once in the corpus hold no repeated window and drop out;
2. blocks whose whole stretch occurs twice are repeated in every window; where an anchor's blocks differ in their
   stretches, one of each kind goes on, with
3. pieces of 16 windows: those whose common core occurs once drop out, those whose whole stretch occurs twice are
   repeated, and of the rest
4. each window stands for itself.

Each step is one aggregation by hash, combined before it is shuffled, from which only the row of a group of one is
named: a passage that a third of all documents share is one row. Hashes have 64 bits; equal ones count as equal strings.

Edge cases: a null text is empty; texts shorter than `length` keep all; rows that repeat a doc_id, or a whole document,
are documents of their own; windows may overlap, in one document too; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, cut, gone_at_exit, mapped, packed, partitions_for, shared_dir, steps
from .nptext import U64, powers, prefix_hashes, span_hashes

LENGTH, PIECE = 400, 16
#: A window starts up to length - length // 2 bytes before its anchor, and a piece's number has five bits.
LONGEST = 1022
_POS = U64((1 << 34) - 1)


class Blocks:
    """The blocks of texts laid end to end: row, first and last window, anchor, number within the row."""

    def __init__(self, texts: pa.Array, length: int) -> None:
        self.length, self.k = length, length // 2
        self.data, self.off = packed(texts)
        self.prefix = prefix_hashes(self.data)
        n = len(self.data) - length + 1
        if n <= 0:
            self.row = self.first = self.last = self.anchor = self.number = np.zeros(0, np.int64)
            return
        k, span = self.k, length - self.k + 1
        _, inverse = powers(len(self.prefix))
        grams = (self.prefix[k:] - self.prefix[:-k]) * inverse[: len(self.data) - k + 1]
        # mix in place, to hold fewer arrays
        grams ^= grams >> U64(30)
        grams *= U64(0xBF58476D1CE4E5B9)
        grams ^= grams >> U64(27)
        grams *= U64(0x94D049BB133111EB)
        low = (grams & ~_POS) | np.arange(len(grams), dtype=np.uint64)
        del grams
        wide, size = low, 1
        while 2 * size <= span:
            wide = np.minimum(wide[:-size], wide[size:])
            size *= 2
        if size < span:
            wide = np.minimum(wide[: len(low) - span + 1], wide[span - size :][: len(low) - span + 1])
        anchor = (wide & _POS).astype(np.int64)
        # windows that lie in one row
        whole = np.zeros(n + 1, np.int32)
        lengths = np.diff(self.off)
        fit = np.flatnonzero(lengths >= length)
        np.add.at(whole, self.off[fit], 1)
        # a row's last window ends before the next row's first begins, so that no block reaches over
        np.add.at(whole, self.off[fit + 1] - length + 1, -1)
        inside = np.cumsum(whole[:-1]) > 0
        at = np.flatnonzero(inside)
        anchor = anchor[at]
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(new)
        self.first = at[begin]
        self.last = at[np.append(begin[1:] - 1, len(at) - 1)] if len(at) else self.first
        self.anchor = anchor[begin]
        self.row = np.searchsorted(self.off, self.first, "right") - 1
        head = np.searchsorted(self.row, self.row)
        self.number = np.arange(len(self.row)) - head

    def hashes(self, start: np.ndarray, end: np.ndarray, *tags: np.ndarray) -> np.ndarray:
        h = span_hashes(self.prefix, start, end)
        for t in tags:
            h = (h ^ t.astype(np.uint64)) * U64(0x9E3779B97F4A7C15)
            h ^= h >> U64(32)
        return h


def _row(cols: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v).view(np.int64) if v.dtype == np.uint64 else v.astype(np.int64)) for v in cols.values()], names=list(cols))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with k, h, text: k is doc_id (null: the least long); h tells documents apart that share it; and whether the text was null."""
    text = F.coalesce("text", F.lit(""))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), F.hash(text).cast("long").alias("h"), text.alias("text"), F.col("text").isNull().alias("none"), "doc_id", *rest)


def _lists(refs: DataFrame) -> DataFrame:
    """(k, h, code) gathered by document: bounded by its own length."""
    return refs.groupBy("k", "h").agg(F.collect_list("code").alias("codes"))


def _over(docs: DataFrame, lists: dict[str, DataFrame], make: Callable, schema: str) -> DataFrame:
    """make(batches) over the documents that have lists; docs is bucketed by (k, h), so only the lists move."""
    for name, codes in lists.items():
        docs = docs.join(_lists(codes).withColumnRenamed("codes", name), ["k", "h"], "left")
    return mapped(docs.where(" or ".join(f"{n} is not null" for n in lists)), make, schema)


def _codes(column: pa.Array, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of every code in a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(base, size), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _marked(blocks: Blocks, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For codes (block number << 1 | donor): block, donor flag."""
    row, code = _codes(column, np.arange(len(blocks.off) - 1))
    head = np.searchsorted(blocks.row, np.arange(len(blocks.off)))
    return head[row] + (code >> 1), (code & 1).astype(bool)


def _pieces(blocks: Blocks, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(block, q, first and last window) of the pieces of some blocks: windows whose anchor lies 16q to 16q + 15 bytes in."""
    far, near = blocks.anchor[which] - blocks.first[which], blocks.anchor[which] - blocks.last[which]
    low, high = near // PIECE, far // PIECE
    n = high - low + 1
    owner = np.repeat(which, n)
    q = np.repeat(low, n) + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    a = blocks.anchor[owner]
    return owner, q, np.maximum(blocks.first[owner], a - PIECE * q - PIECE + 1), np.minimum(blocks.last[owner], a - PIECE * q)


def _classes(rows: DataFrame, group: str) -> DataFrame:
    """One row per (group, whole): copies, a document and code of it, and how many kinds its group has."""
    one = F.min_by(F.struct("k", "h", "code"), F.xxhash64("k", "h", "code")).alias("ref")
    kinds = cut(rows.groupBy(group, "whole").agg(F.count(F.lit(1)).alias("copies"), one))
    return kinds.join(kinds.groupBy(group).agg(F.count(F.lit(1)).alias("kinds")), group)


def cleaned(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256, kept of every row: kept is the text left, without bytes of cut characters (of a null text, null).

    The texts are shuffled once, into a bucketed copy that every later step reads, the result too; it goes when the
    session ends. Columns of docs other than doc_id and text have names of aside().
    """
    if not 2 * PIECE <= length <= LONGEST:
        raise ValueError(f"length must be from {2 * PIECE} to {LONGEST}")
    spark = docs.sparkSession
    everything = _keyed(docs)
    rest = everything.columns[3:]
    keyed = everything.where(F.octet_length("text") >= length).select("k", "h", "text")
    parts = partitions_for(spark)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(batch, "text"):
                blocks = Blocks(b.column(2), length)
                k, h = (b.column(i).to_numpy(zero_copy_only=False)[blocks.row] for i in (0, 1))
                yield _row({"gram": blocks.hashes(blocks.anchor, blocks.anchor + blocks.k), "k": k, "tag": (h & 0xFFFFFFFF) << 32 | blocks.number, "blocks": np.bincount(blocks.row, minlength=b.num_rows)[blocks.row]})

    grams = mapped(keyed, anchors, "gram long, k long, tag long, blocks long")
    single = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("k"), F.min("tag").alias("tag"), F.min("blocks").alias("blocks")).where("n = 1")
    # the tag's upper half is h again, sign and all
    single = single.select("k", F.shiftright("tag", 32).alias("h"), F.col("tag").bitwiseAND(0xFFFFFFFF).alias("code"), "blocks")

    name = f"llm_exact_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    # a document is live while it holds a block whose anchor's string occurs again
    dead = single.groupBy("k", "h").agg(F.collect_list("code").alias("dead"), F.max("blocks").alias("blocks"))
    live = (F.octet_length("text") >= length) & F.coalesce(F.size("dead") < F.col("blocks"), F.lit(True))
    joined = everything.join(dead, ["k", "h"], "left")
    joined.select("k", "h", "text", "dead", *rest, live.alias("live")).write.bucketBy(parts, "k", "h").option("path", path).saveAsTable(name)
    whole = spark.table(name)
    # the plan has found its files; the catalog needs no entry, and the files go with the session
    spark.sql(f"drop table {name}")
    gone_at_exit(spark, path)
    some = whole.where("live").select("k", "h", "text", "dead")

    def alive(b: pa.RecordBatch) -> tuple[Blocks, np.ndarray]:
        blocks = Blocks(b.column(2), length)
        row, number = _codes(b.column(3), np.arange(b.num_rows))
        on = np.ones(len(blocks.row), bool)
        on[np.searchsorted(blocks.row, row) + number] = False
        return blocks, on

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(batch, "text"):
                blocks, on = alive(b)
                i = np.flatnonzero(on)
                f, z, a = blocks.first[i], blocks.last[i], blocks.anchor[i]
                k, h = (b.column(c).to_numpy(zero_copy_only=False)[blocks.row[i]] for c in (0, 1))
                yield _row({"gram": blocks.hashes(a, a + blocks.k), "whole": blocks.hashes(f, z + length, a - f), "k": k, "h": h, "code": blocks.number[i]})

    kinds = _classes(mapped(some, stretches, "gram long, whole long, k long, h long, code long"), "gram").where("kinds > 1")
    refs = cut(kinds.select("ref.k", "ref.h", (F.col("ref.code") * 2 + F.when(F.col("copies") > 1, 1).otherwise(0)).alias("code")))

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(batch, "text"):
                blocks = Blocks(b.column(2), length)
                which, donor = _marked(blocks, b.column(4))
                order = np.argsort(which, kind="stable")
                which, donor = which[order], donor[order]
                owner, q, _, _ = _pieces(blocks, which)
                given = donor[np.searchsorted(which, owner)]
                a, row = blocks.anchor[owner], blocks.row[owner]
                core = blocks.hashes(a - PIECE * q, a - PIECE * q - PIECE + 1 + length, q)
                from_, to = a - PIECE * q - PIECE + 1, a - PIECE * q + length
                fits = (from_ >= blocks.off[row]) & (to <= blocks.off[row + 1])
                k, h = (b.column(c).to_numpy(zero_copy_only=False)[row] for c in (0, 1))
                code = (blocks.number[owner] << 5 | q) << 1 | given
                whole = blocks.hashes(np.where(fits, from_, 0), np.where(fits, to, 0), q)
                # a stretch that the document cuts short is a kind of its own
                own = blocks.hashes(np.zeros_like(row), np.zeros_like(row), k, h, code, np.full_like(row, 77))
                yield _row({"core": core, "whole": np.where(fits, whole, own), "k": k, "h": h, "code": code})

    kinds = cut(_classes(_over(some, {"refs": refs}, cores, "core long, whole long, k long, h long, code long"), "core"))
    # asked: pieces whose windows are looked at one by one, code (block << 5 | q) << 1 | whether they ask (or only answer)
    lone = F.col("copies") == 1
    dropped = kinds.where((F.col("kinds") == 1) & lone & (F.col("ref.code").bitwiseAND(1) == 0)).select("ref.k", "ref.h", F.shiftright("ref.code", 1).alias("code"))
    open_ = kinds.where("kinds > 1")
    asked = open_.select("ref.k", "ref.h", (F.col("ref.code").bitwiseAND(~1) + (lone & (F.col("ref.code").bitwiseAND(1) == 0)).cast("long")).alias("code"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(batch, "text"):
                blocks = Blocks(b.column(2), length)
                head = np.searchsorted(blocks.row, np.arange(b.num_rows))
                row, code = _codes(b.column(4), np.arange(b.num_rows))
                s, row, own = _windows(blocks, head[row] + (code >> 6), code >> 1 & 31)
                asks = code[own] & 1
                k, h = (b.column(c).to_numpy(zero_copy_only=False)[row] for c in (0, 1))
                yield _row({"window": blocks.hashes(s, s + length), "k": k, "tag": (h & 0xFFFFFFFF) << 32 | (s - blocks.off[row]) << 1 | asks})

    each = _over(some, {"pieces": asked}, windows, "window long, k long, tag long")
    alone = each.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("k"), F.min("tag").alias("tag")).where("n = 1")
    alone = alone.where(F.col("tag").bitwiseAND(1) == 1).select("k", F.shiftright("tag", 32).alias("h"), F.shiftright(F.col("tag").bitwiseAND(0xFFFFFFFF), 1).alias("code"))

    def removal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(batch, "text"):
                yield _removed(b, alive(b), length)

    lists = {"refs": refs.where("code % 2 = 0"), "dropped": dropped, "asked": asked.where("code % 2 = 1").withColumn("code", F.shiftright("code", 1)), "alone": alone}
    lively = whole.where("live").select("k", "h", "text", "dead", *rest)
    for list_, codes in lists.items():
        lively = lively.join(_lists(codes).withColumnRenamed("codes", list_), ["k", "h"], "left")
    lively = lively.select("k", "h", "text", "dead", *lists, *rest)
    others = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lively.schema.fields[8:])
    done = mapped(lively, removal, f"{others}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
    zero = F.lit(0).cast("long")
    plain = whole.where("not live").select(*rest, F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.col("text").alias("kept"))
    out = done.unionByName(plain)
    return out.withColumn("kept", F.when(~F.col("none"), F.col("kept"))).drop("none")


def _windows(blocks: Blocks, block: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every window of some pieces: start, row, number of the piece."""
    a = blocks.anchor[block]
    first, last = np.maximum(blocks.first[block], a - PIECE * q - PIECE + 1), np.minimum(blocks.last[block], a - PIECE * q)
    n = np.maximum(0, last - first + 1)
    own = np.repeat(np.arange(len(block)), n)
    s = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    return s, blocks.row[block][own], own


def _fill(at: np.ndarray, start: np.ndarray, end: np.ndarray, by: int) -> None:
    np.add.at(at, start, by)
    np.add.at(at, end, -by)


def _removed(b: pa.RecordBatch, state: tuple[Blocks, np.ndarray], length: int) -> pa.RecordBatch:
    blocks, on = state
    n = len(blocks.data)
    head = np.searchsorted(blocks.row, np.arange(b.num_rows))
    row, number = _codes(b.column(4), np.arange(b.num_rows))
    unsure = head[row] + (number >> 1)
    sure = on.copy()
    sure[unsure] = False
    starts = np.zeros(n + 1, np.int32)
    i = np.flatnonzero(sure)
    _fill(starts, blocks.first[i], blocks.last[i] + 1, 1)
    owner, q, first, last = _pieces(blocks, np.sort(unsure))
    piece = owner << 5 | q
    gone = []
    for column in (5, 6):
        row, code = _codes(b.column(column), np.arange(b.num_rows))
        gone.append((head[row] + (code >> 5)) << 5 | code & 31)
    keep = ~np.isin(piece, np.concatenate(gone)) if len(piece) else np.zeros(0, bool)
    _fill(starts, first[keep], last[keep] + 1, 1)
    flagged = np.cumsum(starts[:-1]) > 0
    s, _, _ = _windows(blocks, gone[1] >> 5, gone[1] & 31)
    flagged[s] = True
    row, pos = _codes(b.column(7), np.arange(b.num_rows))
    flagged[blocks.off[row] + pos] = False
    cover = np.zeros(n + 1, np.int32)
    s = np.flatnonzero(flagged)
    _fill(cover, s, s + length, 1)
    covered = np.cumsum(cover[:-1]) > 0
    out: list[list] = [[], [], [], [], []]
    for i in range(b.num_rows):
        own = covered[blocks.off[i] : blocks.off[i + 1]]
        data = blocks.data[blocks.off[i] : blocks.off[i + 1]]
        kept = data[~own].tobytes()
        spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if len(own) else 0
        for column, value in zip(out, (len(own), int(own.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore"))):
            column.append(value)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    cols = [*b.columns[8:], *(pa.array(c, t) for c, t in zip(out, kinds))]
    return pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[8:], "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def removals(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and text (what is left of it, without bytes of cut characters) of every document."""
    done = cleaned(docs.select("doc_id", "text"), length)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.coalesce("kept", F.lit("")).alias("text"))


def without_repeats(docs: DataFrame, length: int) -> DataFrame:
    """docs with repeated passages taken out of their texts (and n_chars, where there is one, made to fit); documents of which nothing is left go."""
    docs, named = aside(docs, "doc_id", "text", "n_chars")
    own = "n_chars" in docs.columns
    # n_chars is put aside too, for the columns that come in with it
    done = cleaned(docs.withColumnRenamed("n_chars", "__chars__"), length)
    lost = F.col("n_removed") > 0
    out = done.where(~lost | (F.trim("kept") != "")).withColumnRenamed("kept", "text")
    return named(out.withColumn("n_chars", F.when(lost, F.length("text").cast("long")).otherwise(F.col("__chars__"))) if own else out)
