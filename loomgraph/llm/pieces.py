"""SentencePiece segmentation with n best paths, and decoding.

No piece spans a character that no piece holds, or (checked when a vocabulary is loaded) a space that follows another
character, so a text's lattice falls apart into chunks whose paths are independent. Forward Viterbi scores of all distinct chunks of a batch
are found together, column by column. The n best paths of a text differ from the best in the n - 1 chunks at most whose
second path costs least; those chunks' own n best paths come from a backward A* search in which the forward scores are
the exact heuristic, and a best-first search over them gives the text's.

A character that no piece holds is a node of its own, scored `UNKNOWN` below the least piece, written as the pieces of
its bytes. Edge cases: a null or empty text has no pieces, score 0 and one path; a literal U+2581 is written as bytes, so
that decoding gives every text back exactly; of paths of equal score the one whose last pieces are longer comes first.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from bisect import insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import mapped, spread, steps
from .nptext import U64, mix, powers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE, LITERAL, UNKNOWN = 0x2581, 0x10FFFE, 10.0
N_BEST = 3
#: Chunks longer than this many characters are searched one by one; ends looked up together there.
WIDE, WINDOW = 400, 1 << 16


class Vocabulary:
    """Pieces, scores and byte pieces of a model file, with a hash table of the pieces for vectorised lookup."""

    def __init__(self, path: str) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.vocab_size())
        self.bytes = np.zeros(256, np.int64)
        self.of: dict[str, int] = {}
        self.raw: list[bytes] = [b""] * len(ids)
        for i in ids:
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
                self.raw[i] = bytes([int(piece[3:-1], 16)])
            elif not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i)):
                self.of[piece] = i
                self.raw[i] = piece.replace("▁", " ").encode()
        self.score = np.array([sp.get_score(i) for i in ids])
        self.longest = max(map(len, self.of))
        #: whether spaces part a text: they don't with a vocabulary that has a piece with a space after another character
        self.parted = not any(re.search("[^▁]▁", p) for p in self.of)
        self.low = min(self.score[list(self.of.values())].min(initial=0.0, where=self.score[list(self.of.values())] > -1e8), 0.0) - UNKNOWN
        self.single = np.zeros(0x110000, bool)
        self.single[[ord(p) for p in self.of if len(p) == 1]] = True
        keys = np.concatenate([self._hash(np.array([ord(c) for c in p], np.uint32)) for p in self.of])
        self.keys, self.ids = np.zeros(1 << 18, np.uint64), np.full(1 << 18, -1, np.int64)
        self.probes = 1
        for key, i in zip(keys.tolist(), self.of.values()):
            at, n = key >> 46, 1
            while self.ids[at] >= 0:
                at, n = (at + 1) & (1 << 18) - 1, n + 1
            self.keys[at], self.ids[at], self.probes = key, i, max(self.probes, n)

    @staticmethod
    def prefix(cps: np.ndarray) -> np.ndarray:
        p, _ = powers(len(cps) + 1)
        out = np.zeros(len(cps) + 1, np.uint64)
        np.cumsum(mix(cps.astype(np.uint64) + U64(1)) * p[: len(cps)], out=out[1:])
        return out

    def _hash(self, cps: np.ndarray) -> np.ndarray:
        return self.hashes(self.prefix(cps), np.array([0]), len(cps))

    @staticmethod
    def hashes(prefix: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
        _, q = powers(len(prefix))
        return mix((prefix[start + size] - prefix[start]) * q[start] + U64(size))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash, -1 if none."""
        at = (h >> U64(46)).astype(np.int64)
        out = np.where(self.keys[at] == h, self.ids[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.ids[at] >= 0))
        for n in range(1, self.probes):
            if not len(open_):
                break
            k = (at[open_] + n) & (1 << 18) - 1
            hit = (self.keys[k] == h[open_]) & (self.ids[k] >= 0)
            out[open_[hit]] = self.ids[k[hit]]
            open_ = open_[~hit & (self.ids[k] >= 0)]
        return out


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def escaped(text: str) -> np.ndarray:
    """Code points with spaces as the space mark after a leading one, and a literal mark as one no piece holds."""
    cps = np.frombuffer(("▁" + text.replace("▁", chr(LITERAL)).replace(" ", "▁")).encode("utf-32-le"), np.uint32) if text else np.zeros(0, np.uint32)
    return cps


def chunk_starts(cps: np.ndarray, off: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Where chunks begin: at each text, at a run of spaces, at and after each character that no piece holds."""
    begin = np.zeros(len(cps) + 1, bool)
    if vocab.parted:
        mark = cps == SPACE
        begin[1:-1] = mark[1:] & ~mark[:-1]
    odd = ~vocab.single[cps]
    begin[:-1] |= odd
    begin[1:] |= odd
    begin[off[:-1]] = True
    begin[-1] = False
    return np.flatnonzero(begin[:-1])


def viterbi(cps: np.ndarray, start: np.ndarray, end: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Best and second-best score of every chunk (second: -inf if there is one path), and its best path's pieces."""
    prefix = vocab.prefix(cps)
    n = end - start
    order = np.argsort(-n, kind="stable")
    start, n = start[order], n[order]
    widest = int(n.max(initial=0))
    m = len(start)
    best = np.full((widest + 1, m), -np.inf)
    second = np.full((widest + 1, m), -np.inf)
    back = np.zeros((widest + 1, m), np.int8 if vocab.longest < 128 else np.int32)
    via = np.full((widest + 1, m), -1, np.int32)
    best[0] = 0.0
    for j in range(1, widest + 1):
        live = int(np.searchsorted(-n, -j, "right"))
        s = start[:live]
        for size in range(min(j, vocab.longest), 0, -1):
            piece = vocab.find(vocab.hashes(prefix, s + (j - size), size))
            if size == 1:
                odd = (piece < 0) & ~vocab.single[cps[s + (j - 1)]]
                step = np.where(piece >= 0, vocab.score[piece], np.where(odd, vocab.low, -np.inf))
                some = np.flatnonzero(np.isfinite(step))
            else:
                some = np.flatnonzero(piece >= 0)
                step = vocab.score[piece]
            if not len(some):
                continue
            a, b = best[j - size, some] + step[some], second[j - size, some] + step[some]
            old, next_ = best[j, some], second[j, some]
            wins = a > old
            best[j, some] = np.where(wins, a, old)
            second[j, some] = np.maximum(np.maximum(next_, b), np.where(wins, old, a))
            back[j, some[wins]] = size
            via[j, some[wins]] = piece[some[wins]]
    top, runner = best[n, np.arange(m)], second[n, np.arange(m)]
    # all paths back at once: step t gives each chunk's t-th piece from its end
    at, taken = n.copy(), []
    while (going := np.flatnonzero(at > 0)).size:
        taken.append((going, via[at[going], going], at[going]))
        at[going] -= back[at[going], going]
    count = np.zeros(m, np.int64)
    for going, _, _ in taken:
        count[going] += 1
    first = np.cumsum(count) - count
    flat, where = np.zeros(int(count.sum()), np.int64), np.zeros(int(count.sum()), np.int64)
    for t, (going, piece, stop) in enumerate(taken):
        k = first[going] + count[going] - 1 - t
        flat[k], where[k] = piece, start[going] + stop - 1
    # back to the order given
    rank = np.empty(m, np.int64)
    rank[order] = np.arange(m)
    return top[rank], runner[rank], [flat, where, first[rank], count[rank]]


def long_paths(cps: np.ndarray, vocab: Vocabulary, n: int) -> list[tuple[float, np.ndarray]]:
    """The n best paths of one very long chunk, in time and memory linear in it: (score, pieces).

    Pieces are looked up by length in windows of ends, and kept as flat arrays; the forward scores follow one by one.
    A character that no piece holds is a chunk of its own, so there is none here.
    """
    size, prefix = len(cps), vocab.prefix(cps)
    first, widths, found = np.zeros(size + 2, np.int64), [], []
    forward = [0.0]
    score = vocab.score.tolist()
    for low in range(1, size + 1, WINDOW):
        end = np.arange(low, min(low + WINDOW, size + 1))
        at, wide, piece = [], [], []
        for k in range(min(vocab.longest, int(end[-1])), 0, -1):
            own = end[end >= k]
            p = vocab.find(vocab.hashes(prefix, own - k, k))
            some = np.flatnonzero(p >= 0)
            at.append(own[some])
            wide.append(np.full(len(some), k, np.int32))
            piece.append(p[some])
        at, wide, piece = (np.concatenate(x) for x in (at, wide, piece))
        order = np.argsort(at, kind="stable")
        at, wide, piece = at[order], wide[order], piece[order]
        count = np.bincount(at - low, minlength=len(end))
        first[end + 1] = count
        widths.append(wide)
        found.append(piece.astype(np.int32))
        ways = zip(wide.tolist(), piece.tolist())
        for n_ways in count.tolist():
            best = -np.inf
            for _ in range(n_ways):
                k, p = next(ways)
                reach = forward[len(forward) - k] + score[p]
                if reach > best:
                    best = reach
            forward.append(best)
    first = np.cumsum(first)
    width, pieces_ = np.concatenate(widths), np.concatenate(found)

    def edges(at: int) -> list[tuple[int, int, float]]:
        a, z = first[at], first[at + 1]
        return [(k, p, score[p]) for k, p in zip(width[a:z].tolist(), pieces_[a:z].tolist())]

    return [(x, np.array(p, np.int64)) for x, p in backward(size, edges, forward, n)]


def backward(size: int, edges: Callable[[int], list[tuple[int, int, float]]], forward: list[float], n: int) -> list[tuple[float, list[int]]]:
    """The n best paths by A* from the end of a lattice, best first; edges(at) ends there, the longest first.

    A state is a suffix: what it has scored plus the best way to reach it from the front is exact, so every open state
    stands for a path of just that score and no more than n have to be open. Of equal states the one further on goes first.
    """
    open_: list[tuple[float, int, int, float, tuple]] = [(-forward[size], size, 0, 0.0, ())]
    out: list[tuple[float, list[int]]] = []
    tick = 0
    while open_ and len(out) < n:
        _, at, _, done, tail = open_.pop(0)
        if at == 0:
            path = []
            while tail:
                path.append(tail[0])
                tail = tail[1]
            out.append((done, path))
            continue
        left = n - len(out)
        for k, piece, score in edges(at):
            key = -(done + score + forward[at - k])
            if key < np.inf and (len(open_) < left or key <= open_[-1][0]):
                tick += 1
                insort(open_, (key, at - k, tick, done + score, (piece, tail)))
                del open_[left:]
    return out


def a_star(chunk: str, path: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best paths of one chunk: (score, pieces), an unknown character as -1 minus its place."""
    return _a_star(chunk, path, n)


@lru_cache(1 << 16)
def _a_star(chunk: str, path: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
    vocab = vocabulary(path)
    ends: list[list[tuple[int, int, float]]] = [[] for _ in range(len(chunk) + 1)]
    forward = [0.0] + [-np.inf] * len(chunk)
    for j in range(1, len(chunk) + 1):
        for size in range(min(j, vocab.longest), 0, -1):
            piece = vocab.of.get(chunk[j - size : j], -1)
            if piece >= 0 or size == 1 and not vocab.single[ord(chunk[j - 1])]:
                score = float(vocab.score[piece]) if piece >= 0 else vocab.low
                ends[j].append((size, piece if piece >= 0 else -j, score))
                forward[j] = max(forward[j], forward[j - size] + score)
    return [(x, tuple(p)) for x, p in backward(len(chunk), ends.__getitem__, forward, n)]


def best_picks(lists: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n greatest sums of one value of each descending list, best first, each with the places of its values."""
    if not lists:
        return [(0.0, ())]
    total = sum(x[0] for x in lists)
    heap, seen, out = [(-total, (0,) * len(lists))], {(0,) * len(lists)}, []
    while heap and len(out) < n:
        score, at = heapq.heappop(heap)
        out.append((-score, at))
        for k, x in enumerate(lists):
            if at[k] + 1 < len(x):
                to = (*at[:k], at[k] + 1, *at[k + 1 :])
                if to not in seen:
                    seen.add(to)
                    heapq.heappush(heap, (score + x[at[k]] - x[at[k] + 1], to))
    return out


def best_sums(lists: list[list[float]], n: int) -> list[float]:
    """The sums of best_picks()."""
    return [x for x, _ in best_picks(lists, n)]


def encode(texts: list[str | None], path: str = MODEL, n_best: int = N_BEST) -> list[tuple[np.ndarray, list[float]]]:
    """Each text's best path's pieces, and the scores of its n best paths."""
    return [(paths[0], scores) for paths, scores in segmentations(texts, path, n_best)]


def segmentations(texts: list[str | None], path: str = MODEL, n_best: int = N_BEST) -> list[tuple[list[np.ndarray], list[float]]]:
    """The pieces of each text's n best paths, best first, and their scores."""
    vocab = vocabulary(path)
    parts = [escaped(t or "") for t in texts]
    off = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    cps = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    if not len(cps):
        return [([np.zeros(0, np.int64)], [0.0]) for _ in texts]
    begin = chunk_starts(cps, off, vocab)
    end = np.append(begin[1:], len(cps))
    prefix = vocab.prefix(cps)
    _, q = powers(len(prefix))
    key = mix((prefix[end] - prefix[begin]) * q[begin] + (end - begin).astype(np.uint64))
    _, lead, kind = np.unique(key, return_index=True, return_inverse=True)
    s, e = begin[lead], end[lead]
    top, runner = np.zeros(len(lead)), np.zeros(len(lead))
    sizes = e - s
    flats, firsts, counts = [], np.zeros(len(lead), np.int64), np.zeros(len(lead), np.int64)
    base = 0
    groups = [np.flatnonzero((sizes > lo) & (sizes <= hi)) for lo, hi in zip((0, 8, 16, 40, 100), (8, 16, 40, 100, WIDE))]
    long = {int(i): long_paths(cps[s[i] : e[i]], vocab, max(2, n_best)) for i in np.flatnonzero(sizes > WIDE)}
    for g in groups:
        if not len(g):
            continue
        top[g], runner[g], (flat, where, first, count) = viterbi(cps, s[g], e[g], vocab)
        # an unknown character: minus one minus its code point
        flats.append(np.where(flat < 0, -1 - cps[where].astype(np.int64), flat))
        firsts[g], counts[g] = base + first, count
        base += len(flat)
    for i, found in long.items():
        top[i], runner[i] = found[0][0], found[1][0] if len(found) > 1 else -np.inf
        flats.append(found[0][1])
        firsts[i], counts[i] = base, len(flats[-1])
        base += len(flats[-1])
    flat = np.concatenate(flats)
    n = counts[kind]
    total = np.cumsum(n) - n
    at = np.repeat(firsts[kind] - total, n) + np.arange(int(n.sum()))
    ids = flat[at]
    if (ids < 0).any():
        ids, n = _bytes(ids, n, vocab)
    edges = np.concatenate(([0], np.cumsum(n)))
    text_chunk = np.searchsorted(begin, off)
    loss = top - runner
    own_loss, own_top = loss[kind], top[kind]
    out = []
    for i in range(len(texts)):
        a, z = text_chunk[i], text_chunk[i + 1]
        if a == z:
            out.append(([np.zeros(0, np.int64)], [0.0]))
            continue
        near = own_loss[a:z]
        pick = np.argsort(near, kind="stable")[: n_best - 1] if z - a < 4 * n_best else _least(near, n_best - 1)
        chosen = sorted(pick[np.isfinite(near[pick])].tolist())
        lists, ways = [], []
        for k in chosen:
            c = a + k
            if found := long.get(int(kind[c])):
                lists.append([x - own_top[c] for x, _ in found[:n_best]])
                ways.append([p for _, p in found[:n_best]])
                continue
            chunk = cps[begin[c] : end[c]].tobytes().decode("utf-32-le")
            found = a_star(chunk, path, n_best)
            lists.append([x - own_top[c] for x, _ in found])
            # of equal scores A* may put another path before Viterbi's, which every text begins with
            best = ids[edges[c] : edges[c + 1]]
            others = [w for w in (_written(p, chunk, vocab) for _, p in found) if not np.array_equal(w, best)]
            ways.append([best, *others][: len(found)])
        score = float(own_top[a:z].sum())
        picks = best_picks(lists, n_best)
        paths = []
        for _, places in picks:
            parts, at = [], edges[a]
            for k, way, place in zip(chosen, ways, places):
                if place:
                    parts += [ids[at : edges[a + k]], way[place]]
                    at = edges[a + k + 1]
            paths.append(np.concatenate([*parts, ids[at : edges[z]]]) if parts else ids[at : edges[z]])
        out.append((paths, [score + x for x, _ in picks]))
    return out


def _written(path: tuple[int, ...], chunk: str, vocab: Vocabulary) -> np.ndarray:
    """The pieces of a path of a_star(), with each unknown character as its byte pieces."""
    out: list[int] = []
    for p in path:
        out += [p] if p >= 0 else [int(vocab.bytes[x]) for x in (chunk[-1 - p].replace(chr(LITERAL), "▁")).encode()]
    return np.array(out, np.int64)


def _least(x: np.ndarray, n: int) -> np.ndarray:
    k = np.argpartition(x, n)[: n + 1]
    return k[np.lexsort((k, x[k]))][:n]


def _bytes(ids: np.ndarray, n: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """ids with each unknown character as its byte pieces, and the chunks' new sizes."""
    odd = np.flatnonzero(ids < 0)
    raw = [chr(0x2581 if c == LITERAL else c).encode() for c in (-1 - ids[odd]).tolist()]
    wide = np.ones(len(ids), np.int64)
    wide[odd] = [len(r) for r in raw]
    place = np.cumsum(wide) - wide
    out = np.zeros(int(wide.sum()), np.int64)
    plain = ids >= 0
    out[place[plain]] = ids[plain]
    size = wide[odd]
    at = np.repeat(place[odd] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    out[at] = vocab.bytes[np.frombuffer(b"".join(raw), np.uint8)]
    owner = np.repeat(np.arange(len(n)), n)
    return out, np.bincount(owner, weights=wide, minlength=len(n)).astype(np.int64)


def decode(ids: np.ndarray, path: str = MODEL) -> str:
    """The text whose pieces these are."""
    return decode_bytes(ids, path).decode(errors="replace")


def decode_bytes(ids: np.ndarray, path: str = MODEL) -> bytes:
    raw = vocabulary(path).raw
    return b"".join(map(raw.__getitem__, ids.tolist()))[1:]


KINDS = {"n_chars": (pa.int64(), "long"), "n_pieces": (pa.int64(), "long"), "pieces": (pa.list_(pa.int32()), "array<int>"), "alternatives": (pa.list_(pa.list_(pa.int32())), "array<array<int>>"), "pieces_sha256": (pa.string(), "string"), "alternatives_sha256": (pa.list_(pa.string()), "array<string>"), "n_paths": (pa.int32(), "int"), "best_score": (pa.float64(), "double"), "scores": (pa.list_(pa.float64()), "array<double>"), "decoded_sha256": (pa.string(), "string"), "decodes": (pa.bool_(), "boolean")}


def encoded(docs: DataFrame, *columns: str, path: str = MODEL, n_best: int = N_BEST) -> DataFrame:
    """doc_id and the columns asked for (of KINDS) of every whole text; alternatives: the second to n-th best paths' pieces; decodes: whether decoding each of the n best paths gives the text back."""
    columns = columns or tuple(KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(batch, "text"):
                texts = b.column(1).to_pylist()
                rows: dict[str, list] = {c: [] for c in columns}
                for t, (paths, scores) in zip(texts, segmentations(texts, path, n_best)):
                    ids, rest = paths[0], paths[1:]
                    raw = (t or "").encode()
                    back = decode_bytes(ids, path) if "decodes" in rows or "decoded_sha256" in rows else b""
                    own = {"n_chars": len(t or ""), "n_pieces": len(ids), "n_paths": len(scores), "best_score": scores[0], "scores": scores}
                    for c in columns:
                        match c:
                            case "pieces":
                                own[c] = ids.astype(np.int32)
                            case "alternatives":
                                own[c] = [p.astype(np.int32) for p in rest]
                            case "pieces_sha256":
                                own[c] = hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest()
                            case "alternatives_sha256":
                                own[c] = [hashlib.sha256(p.astype("<i4").tobytes()).hexdigest() for p in rest]
                            case "decoded_sha256":
                                own[c] = hashlib.sha256(back).hexdigest()
                            case "decodes":
                                own[c] = back == raw and all(decode_bytes(p, path) == raw for p in rest)
                        rows[c].append(own[c])
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(rows[c], KINDS[c][0]) for c in columns)], names=["doc_id", *columns])

    return mapped(spread(docs.select("doc_id", "text")), run, "doc_id long, " + ", ".join(f"{c} {KINDS[c][1]}" for c in columns))
