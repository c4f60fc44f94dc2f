"""Language of a text by n-gram filters with a bit for every language.

One Bloom filter per learned language, bit-sliced: slot s holds a mask whose bit l is slot s of language l's filter, so
the AND of the masks at an n-gram's slots is the set of all languages that contain it. A text's hits per language,
less what the filter's false positives are expected to add, decide.

fit() learns from a sample bounded by `per_language` documents a language (chosen by a hash of doc_id, whatever their
number); predict() reads whole texts and nothing but the text.

Edge cases: a null text or one without a letter is `und` with score 0, and so is every text if nothing was learned; a
text with letters but no known n-gram gets the language most documents were learned from, score 0; ties go to the
language first by code point; up to 64 languages can be learned, more raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, spread, steps

U64 = np.uint64
#: Documents of a language that fit() learns from, n-grams it keeps of each, the least documents an n-gram is in.
PER_LANGUAGE, KEEP, LEAST = 1000, 12000, 3
#: An n-gram belongs to every language in which it is at least this fraction as frequent as where it is most frequent.
SHARED = 0.5
SIZES, HASHES = (3, 4), 2
_A = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]
_tables: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point its lower-case letter, or a space."""
    if not _tables:
        t = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and (s := chr(c)).isalpha():
                low = s.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _tables.append(t)
    return _tables[0]


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts' lower-case letters (others count as one space), the row of each, and each row's letters."""
    marked = [f" {t} " for t in texts]
    raw = letters()[np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)]
    row = np.repeat(np.arange(len(texts)), [len(t) for t in marked])
    blank = raw == 32
    n_letters = np.bincount(row[~blank], minlength=len(texts))
    # Runs of spaces become one; each text keeps the one before its first word.
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[np.concatenate(([0], np.cumsum([len(t) for t in marked])[:-1])).astype(np.int64)] = True
    raw, row, blank = raw[keep].astype(np.uint64), row[keep], blank[keep]
    hashes, rows = [], []
    for n in SIZES:
        if len(raw) < n:
            continue
        m = len(raw) - n + 1
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = h * U64(_A[0]) + raw[k : k + m] * U64(_A[1])
        h ^= h >> U64(29)
        same = row[:m] == row[n - 1 :]
        # a space inside divides two words; an n-gram may begin or end with one
        inner = np.zeros(m, bool)
        for k in range(1, n - 1):
            inner |= blank[k : k + m]
        ok = same & ~inner
        hashes.append(h[ok])
        rows.append(row[:m][ok])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), n_letters
    return np.concatenate(hashes), np.concatenate(rows), n_letters


@dataclass(frozen=True)
class Model:
    languages: list[str]
    masks: np.ndarray
    false: np.ndarray
    usual: int

    def slots(self, h: np.ndarray, k: int) -> np.ndarray:
        shift = U64(64 - int(len(self.masks)).bit_length() + 1)
        return (h * U64(_A[2 + k])) >> shift

    def hits(self, h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """n-grams per row, and of these, per language, those that its filter holds."""
        mask = self.masks[self.slots(h, 0)]
        for k in range(1, HASHES):
            mask = mask & self.masks[self.slots(h, k)]
        n, L = np.bincount(row, minlength=rows), len(self.languages)
        if L <= 8:
            by = np.bincount(row * (1 << L) + mask.astype(np.int64), minlength=rows << L).reshape(rows, 1 << L)
            return n, by @ (np.arange(1 << L)[:, None] >> np.arange(L) & 1)
        return n, np.stack([np.bincount(row[(mask >> mask.dtype.type(i) & mask.dtype.type(1)) > 0], minlength=rows) for i in range(L)], axis=1)

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (its part of all languages' corrected hits) and coverage (of all n-grams) of each text."""
        texts = [t or "" for t in texts]
        h, row, n_letters = ngrams(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        n, hits = self.hits(h, row, len(texts))
        fixed = np.maximum(0.0, (hits - n[:, None] * self.false) / (1 - self.false))
        best = np.where(fixed.sum(axis=1) > 0, fixed.argmax(axis=1), self.usual)
        top = fixed[np.arange(len(texts)), best]
        score = np.where(n_letters > 0, top / np.maximum(fixed.sum(axis=1), 1e-9), 0.0)
        cover = np.where(n_letters > 0, np.minimum(1.0, top / np.maximum(n, 1)), 0.0)
        return [self.languages[b] if k else "und" for b, k in zip(best.tolist(), n_letters.tolist())], np.clip(score, 0.0, 1.0), cover


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, keep: int = KEEP) -> Model:
    """Learns from the rows (doc_id, text, lang) whose text and lang aren't null.

    What reaches the driver is bounded: `keep` n-grams of at most 64 languages. The sample takes each language's rows
    whose doc_id hashes below per_language / rows of it, about per_language of them.
    """
    labelled = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().limit(65).collect()}
    if len(counts) > 64:
        raise ValueError("more than 64 languages")
    names = sorted(counts, key=lambda s: s.encode())
    if not names:
        return Model([], np.zeros(2, np.uint8), np.zeros(0), 0)
    part = F.create_map(*(F.lit(x) for name in names for x in (name, min(1.0, per_language / counts[name]))))
    chance = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(chance < part[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(batch, "text"):
                h, row, _ = ngrams(b.column(0).to_pylist())
                lang = np.array([names.index(x) for x in b.column(1).to_pylist()])[row] if len(row) else row
                for i in np.unique(lang):
                    mine = lang == i
                    pair = np.unique(np.stack([h[mine], row[mine].astype(np.uint64)], axis=1), axis=0)
                    gram, docs = np.unique(pair[:, 0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), i, np.int32)), pa.array(gram.view(np.int64)), pa.array(docs)], names=["lang", "gram", "docs"])

    grams = mapped(spread(sample.select("text", "lang")), count, "lang int, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
    sizes = F.create_map(*(F.lit(x) for i, name in enumerate(names) for x in (i, float(max(1.0, min(per_language, counts[name]))))))
    grams = grams.where(F.col("docs") >= LEAST).withColumn("part", F.col("docs") / sizes[F.col("lang")])
    most = grams.groupBy("gram").agg(F.max("part").alias("most"))
    grams = grams.join(most, "gram").where(F.col("part") >= SHARED * F.col("most"))
    best = grams.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("part")).alias("p"), "gram"))), 1, keep).alias("top"))
    rows = best.select("lang", F.transform("top", lambda x: x["gram"]).alias("grams")).collect()
    kind = next(t for bits, t in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (64, np.uint64)) if len(names) <= bits)
    size = 1 << max(16, int(keep * HASHES * 8 - 1).bit_length())
    model = Model(names, np.zeros(size, kind), np.zeros(len(names)), names.index(max(names, key=lambda n: counts[n])))
    for lang, top in rows:
        h = np.array(top, np.int64).view(np.uint64)
        for k in range(HASHES):
            s = np.unique(model.slots(h, k))
            model.masks[s] |= kind(1 << lang)
    for i in range(len(names)):
        model.false[i] = np.mean(model.masks >> kind(i) & kind(1)) ** HASHES
    return model


def predict(docs: DataFrame, model: Model, *others: Column | str, keep_text: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, coverage of every whole text (and other columns asked for, or the text)."""
    skip = 0 if keep_text else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(batch, "text", 1 << 20):
                lang, score, cover = model.decide(b.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns[skip:], pa.array(lang, pa.string()), pa.array(score), pa.array(cover)], names=[*b.schema.names[skip:], "lang_pred", "score", "coverage"])

    given = docs.select("text", "doc_id", *others)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[skip:])
    return mapped(spread(given), run, f"{schema}, lang_pred string, score double, coverage double")
