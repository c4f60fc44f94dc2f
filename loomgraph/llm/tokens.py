"""Token counts of sections by offset-mapped attribution.

A document is encoded once, whole, with a byte-level vocabulary; token byte lengths give exact character spans, which
are joined to the document's sections (sorted intervals, so the join is a merge). A token that crosses a boundary goes
by rule: "start" to the section that holds its first character, "end" its last, "most" the one that holds most of its
characters (of equals the earlier). Section counts add up to the document's.

Sections here are lines, with the line feed that ends each; fields() joins columns into one document with a section for
each. Edge cases: a null or empty text is one section of no tokens; a character whose bytes fall into several tokens
counts as whole for each; an empty table gives no rows; rows that repeat a doc_id are each attributed.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, packed, spread, steps

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("start", "end", "most")
OUT = "doc_id long, section int, start_char long, end_char long, n_tokens long, n_crossing long, doc_tokens long"


@lru_cache(4)
def encoder(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding of a vocabulary file, and the byte length of every token."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def attribute(texts: pa.Array, cuts: np.ndarray, first: np.ndarray, path: str = VOCABULARY, rule: str = "start") -> dict[str, np.ndarray]:
    """Per section, in order: its characters' start and end, tokens, crossing tokens, and its row's tokens.

    cuts: byte offset in the packed texts at which each section starts, ascending; first: number of each row's first
    section (one more than rows).
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    enc, sizes = encoder(path)
    data, off = packed(texts)
    parts = [sizes[np.array(enc.encode_ordinary(t), np.int64)] if t else np.zeros(0, np.int64) for t in texts.to_pylist()]
    length = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    n_tokens = np.array([len(p) for p in parts], np.int64)
    end = np.cumsum(length)
    if (end[-1] if len(end) else 0) != len(data):
        raise ValueError("the tokens don't cover the text")
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    begin = end - length
    # A token's first and last character: the ones that hold its first and last byte.
    a, z = chars[begin + 1] - 1, chars[end] - 1
    edge = chars[cuts]
    # Empty sections share their start with the next one, which wins here: it is the last not after the character.
    s, e = np.searchsorted(edge, a, "right") - 1, np.searchsorted(edge, z, "right") - 1
    owner = s if rule == "start" else e
    cross = np.flatnonzero(s != e)
    if rule == "most":
        owner = s.copy()
        for t in cross.tolist():
            best = 0
            for k in range(s[t], e[t] + 1):
                stop = edge[k + 1] if k + 1 < len(edge) else chars[-1]
                held = min(z[t] + 1, stop) - max(a[t], edge[k])
                if held > best:
                    best, owner[t] = held, k
    touched = np.zeros(len(cuts) + 1, np.int64)
    np.add.at(touched, s[cross], 1)
    np.add.at(touched, e[cross] + 1, -1)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    base = chars[off[:-1]][row]
    stop = np.concatenate((edge[1:], chars[-1:])) if len(edge) else edge
    return {"start": edge - base, "end": stop - base, "n": np.bincount(owner, minlength=len(cuts)), "cross": np.cumsum(touched)[:-1], "all": n_tokens[row], "row": row}


def lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """cuts and first of attribute(), with a section for every line."""
    data, off = packed(texts)
    after = np.flatnonzero(data == 10) + 1
    inner = after[~np.isin(after, off)]
    cuts = np.sort(np.concatenate((off[:-1], inner)), kind="stable")
    # a row's own start comes first among its sections; empty rows share theirs with the next row's, in order
    at = np.searchsorted(inner, off[:-1])
    return cuts, np.concatenate((np.arange(len(off) - 1) + at, [len(cuts)]))


def section_tokens(docs: DataFrame, path: str = VOCABULARY, rule: str = "start") -> DataFrame:
    """One row per line of every document: its span in characters, its tokens, those of them that cross, the document's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(batch, "text"):
                text = b.column(1).fill_null("")
                cuts, first = lines(text)
                got = attribute(text, cuts, first, path, rule)
                ids = b.column(0).take(pa.array(got["row"]))
                section = np.arange(len(cuts)) - first[got["row"]]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(section.astype(np.int32)), *(pa.array(got[k].astype(np.int64)) for k in ("start", "end", "n", "cross", "all"))],
                    names=["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens"],
                )

    return mapped(spread(docs.select("doc_id", "text")), run, OUT)


def field_tokens(table: DataFrame, fields: list[str], path: str = VOCABULARY, rule: str = "start") -> DataFrame:
    """Each row's fields, joined by line feeds and encoded as one document: a count `tokens_<field>` for each, then the row's columns.

    A line feed belongs to the field before it; a column that has a count's name already gives way to the count.
    """
    names = [f"tokens_{f}" for f in fields]
    table = table.drop(*names)
    size, joined = [f"__tokens_size_{k}__" for k in range(len(fields))], "__tokens_text__"
    known = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(batch, joined):
                sizes = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(len(fields))], axis=1)
                sizes[:, :-1] += 1
                _, off = packed(b.column(len(fields)))
                cuts = (off[:-1, None] + np.cumsum(sizes, axis=1) - sizes).ravel()
                first = np.arange(b.num_rows + 1) * len(fields)
                n = attribute(b.column(len(fields)), cuts, first, path, rule)["n"].reshape(-1, len(fields))
                yield pa.RecordBatch.from_arrays([pa.array(n[:, k].astype(np.int64)) for k in range(len(fields))] + b.columns[len(fields) + 1 :], names=names + b.schema.names[len(fields) + 1 :])

    given = table.select(*(F.octet_length(k).alias(s) for s, k in zip(size, known)), F.concat_ws("\n", *known).alias(joined), *table.columns)
    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
    return mapped(given, run, ", ".join(f"`{n}` long" for n in names) + ", " + rest)
