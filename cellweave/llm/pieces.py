"""SentencePiece encoding and decoding with n-best segmentation.

The lattice of a text has an edge for every vocabulary piece that matches, and
byte pieces for characters that no piece covers. Pieces hold the space mark
only in front, so a lattice falls apart where a word ends, and distinct words
are solved once: forward Viterbi scores for many words at a time in numpy, the
two best of each position. Where an alternative is asked for, A-star runs
backward from the word's end with the forward scores as its heuristic, which
is exact, so segmentations come out best first. The n best of a text differ
from the best in the words with the smallest gaps between their two best.

An edge costs the logarithm of its piece's rank (Zipf's law for the file's
merge order), in whole 65536ths, so sums are exact in any order.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_map

SPACE = "▁"
WORD = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*")
#: Words that a worker keeps; words longer than this are solved one by one.
CACHE, LONG = 300_000, 48
_P = np.uint64(0x9E3779B97F4A7C15)
NONE = -(1 << 60)


class Segmenter:
    """Best, n-best and decoding for one SentencePiece model file (its bytes)."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        first = sum(special)
        self.byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.cost = {}
        for rank, i in enumerate(i for i in range(n) if not special[i]):
            self.cost[sp.id_to_piece(i)] = (i, -round(65536 * math.log(2 + rank)))
        self.byte_score = -round(65536 * (math.log(2 + n - first) + 2))
        self.bytes_of = [sp.id_to_piece(i).encode() for i in range(n)]
        for b, i in self.byte.items():
            self.bytes_of[i] = bytes([b])
        for i in range(n):
            if special[i] and i not in self.byte.values():
                self.bytes_of[i] = b""
        self.bytes_of[self.unknown] = "⁇".encode()
        self.longest = max(map(len, self.cost))
        self.tables = []
        by_len: dict[int, list] = {}
        for p, (i, s) in self.cost.items():
            by_len.setdefault(len(p), []).append((int(self._hash(p)), i, s))
        for k in range(1, self.longest + 1):
            rows = sorted(by_len.get(k, []))
            self.tables.append((np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int32), np.array([r[2] for r in rows], np.int64)))
        self.lists: dict[tuple[str, int], list] = {}
        self._clear()

    @staticmethod
    def _hash(s: str) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for c in s:
            h = h * _P + np.uint64(ord(c) + 1)
        return h[0]

    # --- single words ---------------------------------------------------------

    def fallback(self, char: str) -> tuple[tuple[int, ...], int]:
        """Ids and score of a character that no piece covers."""
        raw = char.encode("utf-8", "surrogatepass")
        if all(b in self.byte for b in raw):
            return tuple(self.byte[b] for b in raw), self.byte_score * len(raw)
        return (self.unknown,), self.byte_score

    def edges(self, word: str, end: int):
        """(begin, ids, score) of the lattice edges that end at ``end``."""
        single = False
        for k in range(1, min(self.longest, end) + 1):
            hit = self.cost.get(word[end - k : end])
            if hit:
                single |= k == 1
                yield end - k, (hit[0],), hit[1]
        if not single:
            ids, score = self.fallback(word[end - 1])
            yield end - 1, ids, score

    def forward(self, word: str) -> list[int]:
        best = [0] + [NONE] * len(word)
        for end in range(1, len(word) + 1):
            best[end] = max(best[b] + s for b, _, s in self.edges(word, end))
        return best

    def nbest_word(self, word: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The n best (score, ids), best first: A-star from the end, guided by the forward scores."""
        if not word:
            return [(0, ())]
        best = self.forward(word)
        count = itertools.count()
        # Of equal totals the one nearer to the start goes first: ties then cost a walk, not all their combinations.
        heap = [(-best[-1], len(word), next(count), 0, None)]
        out = []
        while heap and len(out) < n:
            _, at, _, done, path = heapq.heappop(heap)
            if at == 0:
                ids = []
                while path:
                    ids += path[0]
                    path = path[1]
                out.append((done, tuple(ids)))
                continue
            for begin, ids, score in self.edges(word, at):
                heapq.heappush(heap, (-(best[begin] + done + score), begin, next(count), done + score, (ids, path)))
        return out

    # --- many words -------------------------------------------------------------

    def _clear(self) -> None:
        """Forget the solved words: their slots, and by slot where the ids start, how many there are, the score and the gap to the second best (-1: none)."""
        self.slot: dict[str, int] = {}
        self.start, self.size, self.score, self.gap = (np.empty(0, np.int64) for _ in range(4))
        self.flat = np.empty(0, np.int32)
        self.lists.clear()

    def _solve(self, keys: list[str]) -> None:
        by_len: dict[int, list[str]] = {}
        for w in keys:
            by_len.setdefault(len(self.word_of(w)), []).append(w)
        done = []
        for group in by_len.values():
            for at in range(0, len(group), 4096):
                done += self._solve_equal(group[at : at + 4096])
        n = np.concatenate([d[2] for d in done]) if done else np.empty(0, np.int64)
        base = len(self.flat)
        self.flat = np.concatenate([self.flat, *(d[1] for d in done)])
        for w in itertools.chain.from_iterable(d[0] for d in done):
            self.slot[w] = len(self.slot)
        self.start = np.concatenate([self.start, base + np.cumsum(n) - n])
        self.size = np.concatenate([self.size, n])
        self.score = np.concatenate([self.score, *(d[3] for d in done)])
        self.gap = np.concatenate([self.gap, *(d[4] for d in done)])

    def _one_by_one(self, keys: list[str]):
        two = [self.nbest_word(self.word_of(w), 2) for w in keys]
        ids = np.array([i for t in two for i in t[0][1]], np.int32)
        return keys, ids, np.array([len(t[0][1]) for t in two], np.int64), np.array([t[0][0] for t in two], np.int64), np.array([t[0][0] - t[1][0] if len(t) > 1 else -1 for t in two], np.int64)

    def _solve_equal(self, keys: list[str]) -> list[tuple]:
        """(keys, their ids in a row, numbers of ids, scores, gaps) of words of one length."""
        words = [self.word_of(w) for w in keys]
        size, rows = len(words[0]), len(words)
        if size > LONG:
            return [self._one_by_one(keys)]
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(rows, size).astype(np.uint64) + np.uint64(1)
        top = min(self.longest, size)
        ids, scores = np.full((top, size, rows), -1, np.int32), np.full((top, size, rows), NONE)
        h = np.zeros((rows, size), np.uint64)
        for k in range(1, top + 1):
            h = h[:, : size - k + 1] * _P + codes[:, k - 1 :]
            hashes, own, cost = self.tables[k - 1]
            if len(hashes):
                pos = np.minimum(np.searchsorted(hashes, h.ravel()), len(hashes) - 1).reshape(h.shape)
                ok = hashes[pos] == h
                ids[k - 1, : size - k + 1] = np.where(ok, own[pos], -1).T
                scores[k - 1, : size - k + 1] = np.where(ok, cost[pos], NONE).T
        wide = np.zeros(rows, bool)  # words with a character that takes several byte pieces
        for col, row in np.argwhere(ids[0] < 0):
            own, cost = self.fallback(words[row][col])
            scores[0, col, row] = cost
            ids[0, col, row] = own[0]
            wide[row] |= len(own) > 1
        one = np.full((size + 1, rows), NONE)
        two, length = one.copy(), np.zeros((size + 1, rows), np.int64)
        one[0] = 0
        for end in range(1, size + 1):
            a, b, pick = one[end], two[end], length[end]
            for k in range(1, min(top, end) + 1):
                s = scores[k - 1, end - k]
                x, y = one[end - k] + s, two[end - k] + s
                better = x > a
                b[:] = np.maximum(np.where(better, np.maximum(a, y), np.maximum(b, x)), NONE)
                pick[better] = k
                a[:] = np.maximum(a, x)
        every = np.arange(rows)
        end, back = np.full(rows, size), []
        while end.any():  # all words at once, from their ends
            k = length[end, every]
            back.append(np.where(end > 0, ids[np.maximum(k - 1, 0), np.maximum(end - np.maximum(k, 1), 0), every], -1))
            end = end - k
        path = np.stack(back[::-1], 1)
        keep = path >= 0
        gap = np.where(two[size] > NONE // 2, one[size] - two[size], -1)
        fine = ~wide
        out = [([w for w, f in zip(keys, fine) if f], path[fine][keep[fine]], keep[fine].sum(1), one[size][fine], gap[fine])]
        return out + ([self._one_by_one([w for w, f in zip(keys, fine) if not f])] if wide.any() else [])

    @staticmethod
    def word_of(key: str) -> str:
        """Keys leave out the space mark in front; those that start with a line end have none."""
        return key if key[:1] == "\n" else SPACE + key

    def split(self, text: str) -> list[str]:
        """Keys of a text's words, with the mark that SentencePiece puts in front; none for an empty text."""
        if not text:
            return []
        if text[0] != " " and "  " not in text and SPACE not in text:
            return text.replace("\n", " \n").split(" ")
        return [w[1:] if w[0] == SPACE else w for w in WORD.findall(SPACE + text.replace(" ", SPACE))]

    def encode(self, texts: list[str], n: int = 1) -> list[list[tuple[int, np.ndarray]]]:
        """The n best (score, ids) of each text, best first."""
        cut = [self.split(t) for t in texts]
        every = set().union(*cut)
        new = every.difference(self.slot)
        if len(self.slot) + len(new) > CACHE:
            self._clear()
            new = every
        self._solve(list(new))
        get = self.slot.__getitem__
        out = []
        for words in cut:
            at = np.fromiter(map(get, words), np.int64, len(words))
            size = self.size[at]
            ends = np.cumsum(size)
            ids = self.flat[np.repeat(self.start[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
            score = int(self.score[at].sum())
            out.append([(score, ids)] + (self._others(words, self.gap[at], ids, ends, size, score, n) if n > 1 and words else []))
        return out

    def _others(self, words, gaps: np.ndarray, ids: np.ndarray, ends, size, score: int, n: int) -> list[tuple[int, np.ndarray]]:
        """The 2nd to n-th best. At most n - 1 words can differ in them, those with the smallest gaps."""
        gaps = np.where(gaps < 0, 1 << 60, gaps)
        near = np.argpartition(gaps, n - 1)[: n - 1] if len(gaps) > n else np.arange(len(gaps))
        combos: list[tuple[int, tuple]] = [(0, ())]
        for k in near.tolist():
            if gaps[k] >= 1 << 60:
                continue
            key = (words[k], n)
            if key not in self.lists:
                if len(self.lists) > CACHE // 4:
                    self.lists.clear()
                self.lists[key] = self.nbest_word(self.word_of(words[k]), n)
            options = self.lists[key]
            top = options[0][0]
            combos = heapq.nsmallest(n, [(lost + top - s, changed + ((k, own),) if r else changed) for lost, changed in combos for r, (s, own) in enumerate(options)], key=lambda c: c[0])
        out = []
        for lost, changed in combos[1:n]:
            parts, at = [], 0
            for k, own in sorted(changed):
                parts += [ids[at : ends[k] - size[k]], np.array(own, np.int32)]
                at = ends[k]
            out.append((score - lost, np.concatenate([*parts, ids[at:]])))
        return out

    def decode(self, ids) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text.removeprefix(" ")


def _load(spark, path: str):
    """A broadcast of the file's bytes, and a function that gives each worker its one segmenter."""
    with open(path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())

    def segmenter():
        import sys

        held = sys.modules.setdefault("_cellweave_segmenters", type(sys)("_cellweave_segmenters")).__dict__
        if path not in held:
            held[path] = Segmenter(model.value)
        return held[path]

    return segmenter


def encode(docs: DataFrame, model_path: str, n: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Row by row (doc_id, ids, scores, others): the best segmentation, the scores of the n best, and the ids of the 2nd to n-th.

    A null or empty text has one segmentation, of no pieces, with score 0. A
    text has fewer than n if its lattice has. Ties are broken alike in every
    run. Repeated rows are answered alike, extra columns ignored.
    """
    segmenter = _load(docs.sparkSession, model_path)

    def setup():
        seg = segmenter()

        def work(texts):
            found = seg.encode(texts, n)
            return [x[0][1] for x in found], [[s for s, _ in x] for x in found], [[y.tolist() for _, y in x[1:]] for x in found]

        return work

    return text_map(docs, {doc_id: doc_id}, text, "ids array<int>, scores array<long>, others array<array<int>>", setup)


def decode(encoded: DataFrame, model_path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Row by row (doc_id, text) from ids; null ids give a null text. The space mark itself comes back as a space."""
    segmenter = _load(encoded.sparkSession, model_path)
    source = encoded.select(F.col(doc_id).alias(doc_id), F.col(ids).alias("_ids"))
    schema = f"{doc_id} {dict(encoded.dtypes)[doc_id]}, text string"

    def run(batches):
        import pyarrow as pa

        seg = segmenter()
        for b in batches:
            texts = [None if x is None else seg.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[doc_id, "text"])

    return source.mapInArrow(run, schema)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_and_check(docs: DataFrame, path: str, n: int = 4, ids: bool = False) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, score, gap, n_best, round_trip): digests of the n best, and whether decoding the best gives the text back. ``ids`` adds them."""
    segmenter = _load(docs.sparkSession, path)

    def setup():
        seg = segmenter()

        def work(texts):
            found = seg.encode(texts, n)
            best = [x[0][1] for x in found]
            return [
                [len(x) for x in best], [zlib.crc32(x.tobytes()) for x in best], [x[0][0] for x in found],
                [x[0][0] - x[1][0] if len(x) > 1 else None for x in found], [len(x) for x in found],
                [seg.decode(x.tolist()) == t.replace(SPACE, " ") for x, t in zip(best, texts)], *([best] if ids else []),
            ]

        return work

    return text_map(docs, {"doc_id": "doc_id"}, "text", "n_pieces long, ids_crc32 long, score long, gap long, n_best int, round_trip boolean" + ", ids array<int>" * ids, setup)


def op3_pieces(spark, sf_dir, path: str | None = None):
    return encode_and_check(spark.read.parquet(f"{sf_dir}/documents.parquet"), path or model_path())
