"""N-gram Jaccard join by vertical partitioning.

1. Texts with the same set of shingles form a class; one document stands for it.
2. The global order of shingles is by hash, with shingles that recur within
   some task's documents after all others, by how often they do. Any order is
   right as long as all documents share it; this one keeps common passages out
   of the prefixes.
3. A document's first |x| - ceil(t|x|) + l(x) shingles in that order are its
   prefix. Two sets that link have like sizes and share at least the smaller l
   of their prefix shingles: of the set whose prefix ends first, ceil(t|x|) -
   l(x) shingles lie beyond, and the overlap is at least ceil(t max(|x|, |y|)).
4. Pairs to be counted: members of a bucket against its smallest document,
   then, once those links are joined into components, every pair in two
   components that shares l prefix shingles. No link between components is
   lost, and a group of n near copies costs about n pairs.
5. The order is cut into fragments. Each fragment counts the overlap of its
   part of both sets for each pair; the counts are summed per pair.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import connected_components, map_slices, materialize

#: Fragments of the global order, pairs that one counting task holds, about, and ids that are broadcast.
FRAGMENTS, TASK_PAIRS, BROADCAST_ROWS = 8, 20_000, 1_000_000
#: Bits of a prefix shingle by which those of one document only are told; more than one document may share them, which costs time only.
SHARED_BITS, SHARED_ROWS = 40, 4_000_000
#: Shingles that come last in the order: at most so many, of at least so many documents that a task has seen at once.
HOT_SHINGLES, HOT_DOCS, WINDOW_SHINGLES = 500_000, 6, 1_500_000
#: Bytes of text that are hashed at a time.
CHUNK_BYTES = 1 << 20

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_P, _PI = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_C = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _C[3]
    h = (h ^ (h >> np.uint64(29))) * _C[0]
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Sorted distinct 64-bit hashes of each text's k-word shingles; words stand between ASCII white space, A-Z count as a-z."""

    def __init__(self, k: int):
        self.k = k
        self.letter = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))
        self.up = self.down = np.ones(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            n = max(n + 1, CHUNK_BYTES + 1)
            self.up, self.down = np.full(n, _P, np.uint64), np.full(n, _PI, np.uint64)
            self.up[0] = self.down[0] = 1
            self.up, self.down = np.cumprod(self.up), np.cumprod(self.down)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        part: list[bytes] = []
        held = 0
        for t in texts:
            b = t.encode("utf-8", "surrogatepass")
            if part and held + len(b) > CHUNK_BYTES:
                out += self._chunk(part)
                part, held = [], 0
            part.append(b)
            held += len(b) + 1
        return out + (self._chunk(part) if part else [])

    def _chunk(self, texts: list[bytes]) -> list[np.ndarray]:
        blob = np.frombuffer(b" ".join([*texts, b""]).translate(_LOWER), np.uint8)
        first = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        word = (blob != 32) & ((blob < 9) | (blob > 13))
        edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        self._powers(len(blob))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.letter[blob] * self.up[: len(blob)])])
        h = _mix((total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64))
        cut = np.searchsorted(start, np.append(first, len(blob)))
        k = self.k
        gram = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for j in range(k):
            gram = _mix(gram * _C[1] + h[j : len(h) - k + 1 + j]) if len(gram) else gram
        out = []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if b - a >= k:
                s = gram[a : b - k + 1].copy()
                s.sort()
                if len(s) > 1:
                    s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif b > a:  # fewer words: the whole sequence is one shingle, of its own kind
                s = np.array([b - a], np.uint64)
                for j in range(a, b):
                    s = _mix(s * _C[2] + h[j : j + 1])
            else:
                s = np.empty(0, np.uint64)
            out.append(s)
        return out


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def least_shared(n: int) -> int:
    """Prefix shingles that a document must share: 7 in 100 of its set."""
    return max(1, n * 7 // 100)


def _least_shared(n):
    return F.greatest(F.lit(1), F.floor(n * 7 / 100))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + least_shared(n)


def _describe(docs: DataFrame, k: int) -> DataFrame:
    """Rows (d, n, digest) for each document, and rows (token, times) for shingles that several documents of one task have."""

    def run(batches):
        shingle, held, size, seen = Shingler(k), [], 0, set()

        def repeated():
            every = np.concatenate(held) if held else np.empty(0, np.uint64)
            every.sort()
            edge = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1], [True]])) if len(every) else np.zeros(1, int)
            times = np.diff(edge)
            hot = times >= 2
            return pd.DataFrame({"d": pd.array([None] * int(hot.sum()), "Int64"), "n": 0, "digest": None, "token": every[edge[:-1]][hot].view(np.int64), "times": times[hot]})

        for part in batches:
            sets = shingle([t or "" for t in part["t"]])
            marks = [_digest(s) for s in sets]
            yield pd.DataFrame({"d": part["d"].astype("Int64"), "n": [len(s) for s in sets], "digest": marks, "token": pd.array([None] * len(sets), "Int64"), "times": 0})
            for s, m in zip(sets, marks):
                if m not in seen:  # copies of one text say nothing about passages
                    seen.add(m)
                    held.append(s)
                    size += len(s)
            if size > WINDOW_SHINGLES:
                yield repeated()
                held, size, seen = [], 0, set()
        yield repeated()

    return map_slices(docs, run, "d long, n int, digest binary, token long, times long")


def _standing(docs: DataFrame, reps: DataFrame, bound: int) -> DataFrame:
    """The texts (d, t, digest) of the documents in ``reps``; who repeats an id with another text is sorted out by digest."""
    few = reps.limit(bound + 1).count() <= bound
    return docs.join(F.broadcast(reps) if few else reps, "d")


def links(docs: DataFrame, reps: DataFrame, hot: np.ndarray, hot_times: np.ndarray, k: int, percent: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """(a, b, overlap, n_a, n_b): links between representatives, enough of them to connect all that links connect."""
    spark = docs.sparkSession
    order = np.argsort(hot)
    hot_b = spark.sparkContext.broadcast((hot[order], hot_times[order]))

    def prefixes(batches):
        shingle = Shingler(k)
        tokens, times = hot_b.value
        for part in batches:
            out = []
            for d, mark, s in zip(part["d"], part["digest"], shingle([t or "" for t in part["t"]])):
                if _digest(s) != mark:
                    continue
                p = prefix_length(len(s), percent)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    is_hot = tokens[at] == s
                    cool = s[~is_hot][:p]
                    if len(cool) < p:
                        warm, t = s[is_hot], times[at[is_hot]]
                        cool = np.concatenate([cool, warm[np.lexsort((warm, t))][: p - len(cool)]])
                else:
                    cool = s[:p]
                out.append((d, len(s), cool.view(np.int64)))
            yield pd.DataFrame(out, columns=["d", "n", "tokens"])

    pre = materialize(map_slices(_standing(docs, reps, bound), prefixes, "d long, n int, tokens array<long>"), "jaccard-prefixes")
    part = lambda t: F.shiftrightunsigned(t, 64 - SHARED_BITS)
    shared = pre.select(F.explode("tokens").alias("token")).groupBy(part("token").alias("part")).agg(F.count(F.lit(1)).alias("df")).filter("df > 1").select("part")
    shared = materialize(shared, "jaccard-shared")
    few = shared.limit(SHARED_ROWS + 1).count() <= SHARED_ROWS
    post = pre.select("d", "n", F.explode("tokens").alias("token")).withColumn("part", part("token")).join(F.broadcast(shared) if few else shared, "part", "left_semi").select("d", "n", "token")
    near = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    by_size = Window.partitionBy("token").orderBy("n", "d")
    mate = F.coalesce(near(F.col("n"), F.lag("n").over(by_size)), F.lit(False)) | F.coalesce(near(F.col("n"), F.lead("n").over(by_size)), F.lit(False))
    post = materialize(post.withColumn("mate", mate).filter("mate").drop("mate"), "jaccard-postings")
    band = F.floor(F.log(F.col("n").cast("double")) / -math.log(percent / 100))
    hub = post.withColumn("band", band).groupBy("token", "band").agg(F.min(F.struct("d", "n")).alias("hub"))
    star = post.withColumn("band", band).join(hub, ["token", "band"]).filter((F.col("d") != F.col("hub.d")) & near(F.col("n"), F.col("hub.n")))
    both = lambda a, b: F.least(_least_shared(F.col(a)), _least_shared(F.col(b)))
    star = star.select(F.col("hub.d").alias("a"), F.col("d").alias("b"), F.col("hub.n").alias("n_a"), F.col("n").alias("n_b")).groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("m"))
    # A document isn't the smallest of every bucket that it shares, so half of what a link needs is enough here.
    star = materialize(star.filter(F.col("m") * 2 >= both("n_a", "n_b")).drop("m"), "jaccard-star")
    n_star = star.count()
    packed = materialize(_packed(star, max(1, -(-n_star // TASK_PAIRS))), "jaccard-pairs")
    first = materialize(_count(docs, reps, packed, k, percent, bound), "jaccard-links")

    comp = connected_components(first.select("a", "b"), "jaccard-first")
    marked = post.join(comp.withColumnRenamed("node", "d"), "d", "left").withColumn("c", F.coalesce("component", "d")).drop("component")
    split = marked.groupBy("token").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 < c1").select("token")
    open_ = materialize(marked.join(split, "token", "left_semi"), "jaccard-open")
    tasks = max(16, -(-open_.count() // 100_000))
    listed = map_slices(open_.select("token", "d", "n", "c").repartition("token").sortWithinPartitions("token", "n", "d"), _across(percent, tasks), "h int, pairs binary", rows=50_000)
    rest = materialize(listed.groupBy("h").applyInPandas(_enough, "h int, pairs binary"), "jaccard-rest")
    return first.union(_count(docs, reps, rest, k, percent, bound))


#: A pair, as tasks pass it on.
PAIR = np.dtype([("a", "<i8"), ("b", "<i8"), ("n_a", "<i4"), ("n_b", "<i4"), ("m", "<i4")])


def _task_of(a: np.ndarray, b: np.ndarray, tasks: int) -> np.ndarray:
    """A pair's task: by its first document, in 64 parts, so that one with very many partners is spread."""
    return (_mix(a.astype(np.uint64) * np.uint64(64) + b.astype(np.uint64) % np.uint64(64)) % np.uint64(tasks)).astype(np.int32)


def _summed(p: np.ndarray) -> np.ndarray:
    """Equal pairs as one, m added up."""
    if not len(p):
        return p
    p = p[np.lexsort((p["b"], p["a"]))]
    first = np.flatnonzero(np.concatenate([[True], (p["a"][1:] != p["a"][:-1]) | (p["b"][1:] != p["b"][:-1])]))
    out = p[first]
    out["m"] = np.add.reduceat(p["m"], first)
    return out


def _across(percent: int, tasks: int):
    """Pairs of like size within a token's documents that lie in two components; the input is sorted by token, size, document."""

    def run(slices):
        held, count = [], 0

        def flush():
            p = _summed(np.concatenate(held))
            h = _task_of(p["a"], p["b"], tasks)
            order = np.argsort(h, kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1], [True]]))
            return pd.DataFrame([(int(h[order[i]]), p[order[i:j]].tobytes()) for i, j in zip(edge[:-1], edge[1:])], columns=["h", "pairs"])

        def pairs(g: pd.DataFrame):
            t, d, n, c = (g[x].to_numpy() for x in ("token", "d", "n", "c"))
            i, step = np.arange(len(t)), 1
            while True:
                i = i[i + step < len(t)]
                j = i + step
                near = (t[i] == t[j]) & (n[i].astype(np.int64) * 100 >= n[j].astype(np.int64) * percent)
                i, j = i[near], j[near]
                if not len(i):
                    return
                x, y = i[c[i] != c[j]], j[c[i] != c[j]]
                turn = d[x] > d[y]
                x, y = np.where(turn, y, x), np.where(turn, x, y)
                out = np.empty(len(x), PAIR)
                out["a"], out["b"], out["n_a"], out["n_b"], out["m"] = d[x], d[y], n[x], n[y], 1
                yield out[out["a"] != out["b"]]
                step += 1

        def parts():
            last = None
            for g in slices:
                g = g if last is None else pd.concat([last, g], ignore_index=True)
                t = g["token"].to_numpy()
                cut = len(t) - int((t[::-1] != t[-1]).argmax() if (t != t[-1]).any() else len(t))
                last = g.iloc[cut:]
                if cut:
                    yield g.iloc[:cut]
            if last is not None:
                yield last

        for g in parts():
            for p in pairs(g):
                if len(p):
                    held.append(p)
                    count += len(p)
                if count > 1_000_000:
                    yield flush()
                    held, count = [], 0
        if held:
            yield flush()

    return run


def _enough(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
    """The pairs of a task that share enough prefix shingles."""
    p = _summed(np.concatenate([np.frombuffer(x, PAIR) for x in g["pairs"]]))
    least = np.maximum(1, np.minimum(p["n_a"], p["n_b"]).astype(np.int64) * 7 // 100)
    p = p[p["m"] >= least]
    if not len(p):
        return pd.DataFrame({"h": pd.Series([], dtype="int32"), "pairs": pd.Series([], dtype=object)})
    rows = np.stack([p[c].astype(np.int64) for c in ("a", "b", "n_a", "n_b")])
    return pd.DataFrame({"h": [key[0]], "pairs": [rows.tobytes()]})


def _packed(pairs: DataFrame, tasks: int) -> DataFrame:
    """(h, pairs): the rows a, b, n_a, n_b of a task's pairs, sorted by a and b."""

    def mark(slices):
        for g in slices:
            yield g.assign(h=_task_of(g["a"].to_numpy(np.int64), g["b"].to_numpy(np.int64), tasks))

    def pack(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["a", "b"])
        return pd.DataFrame({"h": [key[0]], "pairs": [g[["a", "b", "n_a", "n_b"]].to_numpy(np.int64).T.tobytes()]})

    return map_slices(pairs, mark, "a long, b long, n_a int, n_b int, h int", rows=50_000).groupBy("h").applyInPandas(pack, "h int, pairs binary")


def _cutter(k: int):
    def cut(batches):
        shingle = Shingler(k)
        step = (1 << 64) // FRAGMENTS
        edges = np.array([step * i for i in range(1, FRAGMENTS)], np.uint64)
        for part in batches:
            out = []
            for d, mark, s in zip(part["d"], part["digest"], shingle([t or "" for t in part["t"]])):
                if _digest(s) == mark:
                    at = [0, *np.searchsorted(s, edges).tolist(), len(s)]
                    out += [(d, f, s[at[f] : at[f + 1]].tobytes()) for f in range(FRAGMENTS) if at[f] < at[f + 1]]
            yield pd.DataFrame(out, columns=["d", "f", "seg"])

    return cut


def _count(docs: DataFrame, reps: DataFrame, packed: DataFrame, k: int, percent: int, bound: int) -> DataFrame:
    """The pairs (a, b, overlap, n_a, n_b) whose Jaccard similarity reaches ``percent``; sets are made for the documents in them only."""

    def ends(slices):
        for g in slices:
            for h, p in zip(g["h"], g["pairs"]):
                yield pd.DataFrame({"h": h, "d": np.unique(np.frombuffer(p, np.int64).reshape(4, -1)[:2])})

    need = materialize(map_slices(packed, ends, "h int, d long"), "jaccard-asked")
    pieces = map_slices(_standing(docs, reps.join(need.select("d").distinct(), "d", "left_semi"), bound), _cutter(k), "d long, f int, seg binary")
    small = need.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sent = pieces.join(F.broadcast(need) if small else need, "d")

    def overlaps(key: tuple, segs: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        if not len(want):
            return pd.DataFrame({"h": [], "f": [], "n": []})
        a, b, _, _ = np.frombuffer(want["pairs"].iloc[0], np.int64).reshape(4, -1)
        own = {d: np.frombuffer(s, np.uint64) for d, s in zip(segs["d"], segs["seg"])}
        none = np.empty(0, np.uint64)
        n = np.zeros(len(a), np.int32)
        cut = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]]))
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
            x = own.get(a[i], none)
            if not len(x):
                continue
            for lo in range(i, j, 256):
                ys = [own.get(d, none) for d in b[lo : min(j, lo + 256)].tolist()]
                every = np.concatenate(ys)
                at = np.minimum(np.searchsorted(x, every), len(x) - 1)
                hit = np.concatenate([[0], np.cumsum(x[at] == every)])
                ends = np.cumsum([len(y) for y in ys])
                n[lo : lo + len(ys)] = hit[ends] - hit[np.concatenate([[0], ends[:-1]])]
        return pd.DataFrame({"h": [key[0]], "f": [key[1]], "n": [n.tobytes()]})

    wanted = packed.select("h", "pairs", F.explode(F.array(*map(F.lit, range(FRAGMENTS)))).alias("f"))
    counts = sent.groupBy("h", "f").cogroup(wanted.groupBy("h", "f")).applyInPandas(overlaps, "h int, f int, n binary")

    def total(key: tuple, parts: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        a, b, n_a, n_b = np.frombuffer(want["pairs"].iloc[0], np.int64).reshape(4, -1)
        both = np.zeros(len(a), np.int64)
        for x in parts["n"]:
            both += np.frombuffer(x, np.int32)
        ok = 100 * both >= percent * (n_a + n_b - both)
        return pd.DataFrame({"a": a[ok], "b": b[ok], "overlap": both[ok], "n_a": n_a[ok], "n_b": n_b[ok]})

    return counts.groupBy("h").cogroup(packed.groupBy("h")).applyInPandas(total, "a long, b long, overlap long, n_a long, n_b long")


def jaccard_classes(docs: DataFrame, k: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_shingles, component_id).

    Documents link when the Jaccard similarity of their shingle sets is at
    least ``percent`` hundredths; component_id is the smallest doc_id reachable
    by links. Texts without words, empty or null, have no shingles and link
    with nothing. A null doc_id takes no part: its component is null. Of rows
    that repeat a doc_id with different texts the largest set (then the
    largest digest) links for all of them; each row tells its own n_shingles.
    Extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    told = materialize(_describe(rows, k), "jaccard-described")
    each = told.filter("digest is not null").select("d", "n", "digest")
    hot = told.filter("digest is null").groupBy("token").agg(F.sum("times").alias("times")).filter(F.col("times") >= HOT_DOCS)
    hot = hot.orderBy(F.desc("times"), "token").limit(HOT_SHINGLES).toPandas()
    linking = each.filter("d is not null and n > 0").groupBy("d").agg(F.max(F.struct("n", "digest")).alias("s")).select("d", "s.n", "s.digest")
    linking = materialize(linking, "jaccard-linking")
    classes = materialize(linking.groupBy("n", "digest").agg(F.min("d").alias("rep")), "jaccard-classes")
    reps = classes.select(F.col("rep").alias("d"), "digest")
    found = materialize(links(rows, reps, hot["token"].to_numpy(np.int64).view(np.uint64), hot["times"].to_numpy(np.int64), k, percent), "jaccard-all-links")
    comp = connected_components(found.select("a", "b"), "jaccard-components").withColumnRenamed("node", "rep")
    final = classes.join(comp, "rep", "left").select("n", "digest", F.coalesce("component", "rep").alias("c"))
    member = linking.join(final, ["n", "digest"]).select("d", "c")
    out = each.join(member, "d", "left")
    return out.select(F.col("d").alias(doc_id), F.col("n").cast("long").alias("n_shingles"), F.coalesce("c", "d").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` less near duplicates: of each component the smallest doc_id stays, once; rows with a null doc_id stay.

    Different texts of a repeated doc_id are judged each for itself: one takes
    part under the id, the others under ids of their own past 2**62. Of rows
    that repeat both one stays.
    """
    known = docs.filter("doc_id is not null").withColumn("_own", F.xxhash64("text"))
    texts = known.groupBy("doc_id").agg(F.min("_own").alias("_first"), F.max("_own").alias("_last")).filter("_first <> _last")
    texts = materialize(texts.select("doc_id", "_first"), "jaccard-several-texts")
    n = texts.limit(BROADCAST_ROWS + 1).count()
    key = F.col("doc_id").cast("long")
    if n:
        known = known.join(F.broadcast(texts) if n <= BROADCAST_ROWS else texts, "doc_id", "left")
        past = F.xxhash64("doc_id", "_own").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
        key = F.when(F.col("_first").isNull() | (F.col("_first") == F.col("_own")), key).otherwise(past)
    known = known.withColumn("_own", key)
    comp = jaccard_classes(known.select(F.col("_own").alias("doc_id"), "text"), k, percent)
    stay = comp.filter("doc_id = component_id").select(F.col("doc_id").alias("_own")).distinct()
    few = stay.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    own = known.join(F.broadcast(stay) if few else stay, "_own", "left_semi")
    return own.dropDuplicates(["_own"]).select(docs.columns).unionByName(docs.filter("doc_id is null"))


def op5_jaccard(spark, sf_dir):
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 3), ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
c AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(c.b) AS component_id
FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""
