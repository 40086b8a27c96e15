"""Quality by an interpolated modified Kneser-Ney model of trusted text.

N-grams are pairs of whole words, counted over all trusted texts of a language
and sharded by hash, so the model grows with the corpus and is nowhere held
whole. Texts are read in blocks; what a block counts, or asks, goes to each
shard as one packed message of numbered words, a few bytes for a pair instead
of a row. Thresholds are a quantile of the trusted perplexities of a language,
each by a model without the text's fold, since a text's own counts would make
it look better than any other text.

The small character model (``_codes``, ``kneser_ney``) isn't part of the query.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import defaultdict
from contextlib import contextmanager

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, fresh_path, materialize, release, remove_path, small_batches

N, CLASSES = 4, 32
#: A run of letters, marks and digits; one character of a script without spaces; one other symbol.
_ALONE = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
WORD = rf"(?V1)[{_ALONE}]|[\p{{L}}\p{{M}}\p{{N}}--[{_ALONE}]]+|[^\s\p{{Z}}]"
#: The same in characters where it can be said in fewer words, and what lies outside them.
_FULL, _QUICK, _OUTSIDE = regex.compile(WORD), re.compile(r"[^\W_]+|[^\t-\r\x20\x85\xa0]"), re.compile("[^\x00-\u02af\u0386-\u03ff\u0400-\u0482\u048a-\u04ff\u2010-\u2027\u20ac]")
#: Parts of the trusted texts that are left out in turn.
FOLDS = 4
#: Words of a block of texts, and trusted characters (and characters asked for at once) of a shard: what a task holds.
BLOCK_WORDS, SHARD_CHARS = 600_000, 8_000_000
#: Stands for trusted texts without a language.
NAMELESS = "\0"
#: Turns in which documents are scored, so that only a part of their words lies on disk at a time.
ROUNDS = 6
#: Between tasks: 0 pairs of a shard, 1 words of a pair shard, 2 and 3 sums of pairs and words by name, 4 words of a shard, 5 sums sent back, 6 languages, 7 questions, 8 texts.
MESSAGE = "shard long, kind int, name string, values array<double>, blob binary"


def class_table() -> np.ndarray:
    """Class of every 16-bit code point: 0 text start, 1-26 letters, 27 white space, 28 digits, 29 punctuation, 30 other letters, 31 the rest."""
    table = np.full(65536, 31, np.uint8)
    for c in range(1, 65536):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind[0] == "L":
            base = unicodedata.normalize("NFKD", ch)[0].lower()
            table[c] = ord(base) - 96 if "a" <= base <= "z" else 30
        elif kind[0] == "Z" or ch in "\t\n\r\f\v":
            table[c] = 27
        elif kind == "Nd":
            table[c] = 28
        elif ch in ".,;:!?'\"-()":
            table[c] = 29
    table[0] = 0
    return table


def _codes(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram address of every character, number of characters of each text); contexts start with text starts."""
    pad = "\0" * (N - 1)
    points = np.frombuffer("".join(pad + t.replace("\0", " ") for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    s = table[np.minimum(points, 65535)].astype(np.int32)
    n = np.array([len(t) for t in texts], np.int64)
    code = s[N - 1 :].copy() if len(s) >= N else s[:0]
    for k in range(1, N):
        code += s[N - 1 - k : len(s) - k] << (5 * k)
    start = np.cumsum(n + N - 1) - n - (N - 1)
    keep = np.ones(len(code), bool)
    for k in range(N - 1):  # addresses that end in the next text's start
        at = start[1:] + k - (N - 1)
        keep[at[(at >= 0) & (at < len(code))]] = False
    return code[keep], n


def kneser_ney(counts: np.ndarray) -> np.ndarray:
    """Natural log probabilities, shape (32,)*4, of interpolated modified Kneser-Ney over n-gram counts of that shape."""
    orders = [counts.astype(np.float64)]
    for _ in range(N - 1):
        orders.append((orders[-1] > 0).sum(0).astype(np.float64))  # in how many contexts
    p = np.full(CLASSES, 1 / CLASSES)
    for c in reversed(orders):
        k = [float((c == r).sum()) for r in (1, 2, 3, 4)]
        y = k[0] / (k[0] + 2 * k[1]) if k[0] + k[1] else 0.0
        d = [min(max(r - (r + 1) * y * k[r] / k[r - 1], 0.05), r) if k[r - 1] else 0.5 * r for r in (1, 2, 3)]
        cut = np.where(c >= 3, d[2], np.where(c >= 2, d[1], np.where(c >= 1, d[0], 0.0)))
        total = c.sum(-1, keepdims=True)
        seen = total > 0
        safe = np.where(seen, total, 1)
        p = np.where(seen, (c - cut) / safe + cut.sum(-1, keepdims=True) / safe * p, p)
    return np.log(p)


def discounts(n: list[Column]) -> list[Column]:
    """The three discounts of modified Kneser-Ney from the numbers of entries that were counted once, twice, three and four times."""
    y = F.coalesce(F.try_divide(n[0], n[0] + 2 * n[1]), F.lit(0.0))
    return [F.when(n[r - 1] > 0, F.least(F.greatest(r - (r + 1) * y * n[r] / n[r - 1], F.lit(0.05)), F.lit(float(r)))).otherwise(0.5 * r) for r in (1, 2, 3)]


def _words(text: str, ids) -> np.ndarray:
    """Numbers of a text start, its words and a text end (two spaces) in the growing dictionary ``ids``."""
    text = text.lower()
    pattern = _FULL if _OUTSIDE.search(text) else _QUICK
    found = pattern.findall(text) if len(text) < 1_000_000 else (m[0] for m in pattern.finditer(text))
    n = ids[""], ids["  "]
    return np.concatenate([[n[0]], np.fromiter(map(ids.__getitem__, found), np.int64), [n[1]]])


def _dictionary():
    ids = defaultdict()
    ids.default_factory = ids.__len__
    return ids


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit key for two."""
    k = a * np.uint64(0x9E3779B97F4A7C15) + b
    for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        k = (k ^ (k >> np.uint64(33))) * np.uint64(c)
    return k ^ (k >> np.uint64(33))


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed: small numbers and sorted steps leave their high planes empty."""
    import zstandard

    arrays = [np.ascontiguousarray(a) for a in arrays]
    head = json.dumps([(a.dtype.str, len(a)) for a in arrays]).encode()
    body = b"".join(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays)
    return zstandard.compress(len(head).to_bytes(4, "little") + head + body, 3)


def _unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.decompress(bytes(blob))
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for kind, n in json.loads(raw[4:at]):
        size = np.dtype(kind).itemsize
        out.append(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).reshape(n))
        at += n * size
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def _blocks(batches):
    """Blocks of about BLOCK_WORDS words: (rows without their texts, word hashes, name number of each, names, word numbers of all texts, words of each text)."""
    import xxhash

    dictionaries, kept, texts, n = {}, [], [], 0

    def block():
        keys, number, shift, at = [], [], {}, 0
        for k, (name, ids) in enumerate(dictionaries.items()):
            keys.append(np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in ids), np.uint64, len(ids)))
            number.append(np.full(len(ids), k, np.int64))
            shift[name] = at
            at += len(ids)
        words = np.concatenate([w + shift[r["name"]] for r, w in zip(kept, texts)])
        return kept, np.concatenate(keys), np.concatenate(number), list(dictionaries), words, np.array([len(w) for w in texts])

    for whole in batches:
        for start in range(0, whole.num_rows, 200):
            for r in whole.slice(start, 200).to_pylist():
                text = r.pop("text")
                texts.append(_words(text, dictionaries.setdefault(r["name"], _dictionary())))
                kept.append(r)
                n += len(texts[-1])
                if n >= BLOCK_WORDS:
                    made = block()
                    dictionaries, kept, texts, n = {}, [], [], 0
                    yield made
                    del made
    if kept:
        yield block()


def _pairs(words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of words that a word of the same text follows."""
    last = np.zeros(len(words), bool)
    last[np.cumsum(size) - 1] = True
    return np.flatnonzero(~last)


def _own(words: np.ndarray, number: np.ndarray, names: list) -> np.ndarray:
    """Keys of words in their languages. Shards go by the bare hash, so that all languages' counts of a word or pair meet."""
    import xxhash

    seeds = np.array([xxhash.xxh3_64_intdigest(json.dumps(n)) for n in names], np.uint64)
    return _mix(words, seeds[number])


def _split(to: np.ndarray):
    """(shard, positions) of each shard that occurs; positions keep their order."""
    order = np.argsort(to, kind="stable")
    some, first = np.unique(to[order], return_index=True)
    return zip(some, np.split(order, first[1:]))


def _message(shard, kind, name=None, values=None, blob=None):
    return {"shard": int(shard), "kind": kind, "name": name, "values": values, "blob": blob}


def _names(names: list) -> np.ndarray:
    return np.frombuffer(json.dumps(names).encode(), np.uint8)


def _join_words(parts):
    """Union of (words, name numbers, names) vocabularies in the words' order: words, name numbers, names, and each part's places in it."""
    names = list(dict.fromkeys(n for _, _, own in parts for n in own))
    at = {n: k for k, n in enumerate(names)}
    every = np.concatenate([k for k, _, _ in parts])
    number = np.concatenate([np.array([at[n] for n in own], np.int64)[num] if len(num) else num for _, num, own in parts])
    _, first, place = np.unique(_own(every, number, names), return_index=True, return_inverse=True)
    words, number = every[first], number[first]
    order = np.lexsort((number, words))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return words[order], number[order], names, np.split(rank[place], np.cumsum([len(k) for k, _, _ in parts])[:-1])


def _pooled(words, number, names, a, b, counts):
    """The same pairs, and after them those of all languages together, under the name None."""
    alone, place = np.unique(words, return_inverse=True)
    x, y, n = place[a], place[b], len(alone)
    pair, at = np.unique(x * n + y, return_inverse=True)
    both = np.stack([np.bincount(at, c, len(pair)) for c in counts]).astype(np.int64)
    words, number = np.concatenate([words, alone]), np.concatenate([number, np.full(n, len(names))])
    shift = len(place)
    return words, number, [*names, None], np.concatenate([a, pair // n + shift]), np.concatenate([b, pair % n + shift]), np.concatenate([counts, both], axis=1)


def _without(c: np.ndarray) -> np.ndarray:
    """Counts of all folds, then without each fold, from counts by fold."""
    total = c.sum(0)
    return np.stack([total, *(total - x for x in c)])


def _stats(shard, kind, number, names, of):
    """A row of sums for each name; ``of(mask)`` gives the values."""
    return [_message(shard, kind, n, [float(x) for x in of(number == k)]) for k, n in enumerate(names) if (number == k).any()]


def _times(c: np.ndarray) -> list[int]:
    return [int((x == r).sum()) for x in c for r in (1, 2, 3, 4)]


def _count(trusted: DataFrame, shards: int) -> DataFrame:
    """Messages (shard, kind 0) of the word pairs of blocks of texts, to the shard of the pair."""

    def run(batches):
        import pyarrow as pa

        for kept, keys, number, names, words, size in _blocks(batches):
            at = _pairs(words, size)
            fold = np.repeat([r["fold"] for r in kept], size)[at]
            pair, place = np.unique(words[at] * len(keys) + words[at + 1], return_inverse=True)
            counts = np.stack([np.bincount(place[fold == f], minlength=len(pair)) for f in range(1, FOLDS + 1)]).astype(np.uint32)
            a, b = pair // len(keys), pair % len(keys)
            order = np.lexsort((number, keys))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            to, a, b = _shard(_mix(keys[a], keys[b]), shards), rank[a], rank[b]
            by = np.lexsort((b, a))
            out = []
            for s, at in _split(to[by]):
                m = by[at]
                used, place = np.unique(np.concatenate([a[m], b[m]]), return_inverse=True)
                x, y = place[: len(m)], place[len(m) :]
                used = order[used]
                out.append(_message(s, 0, blob=_pack(_steps(keys[used]), number[used].astype(np.uint32), _names(names), _steps(x).astype(np.uint32), y.astype(np.uint32), *counts[:, m])))
            yield pa.RecordBatch.from_pylist(out, _arrow())
        release()

    return trusted.select("name", "fold", "text").mapInArrow(run, MESSAGE)


def _arrow():
    import pyarrow as pa

    return pa.schema([("shard", pa.int64()), ("kind", pa.int32()), ("name", pa.string()), ("values", pa.list_(pa.float64())), ("blob", pa.binary())])


def _read_pairs(blob: bytes):
    """(keys, name numbers, names, a, b, counts by fold) of a packed set of pairs."""
    k, num, names, a, b, *c = _unpack(blob)
    return np.cumsum(k), num.astype(np.int64), json.loads(names.tobytes()), np.cumsum(a.astype(np.int64)), b.astype(np.int64), np.stack(c).astype(np.int64)


def _merge_pairs(shards: int, pool: bool):
    """Of a shard's pairs: their counts (kind 0), counts of counts by name (2), and words' sums for the words' shards (1)."""

    def run(key, rows):
        import pandas as pd

        s = int(key[0])
        parts = [_read_pairs(x) for x in rows["blob"]]
        keys, number, names, places = _join_words([p[:3] for p in parts])
        pair = np.concatenate([w[p[3]] * len(keys) + w[p[4]] for p, w in zip(parts, places)])
        counts = np.concatenate([p[5] for p in parts], axis=1)
        del parts
        pair, at = np.unique(pair, return_inverse=True)
        counts = np.stack([np.bincount(at, x, len(pair)) for x in counts]).astype(np.int64)
        a, b = pair // len(keys), pair % len(keys)
        out = [_message(s, 0, blob=_pack(_steps(keys), number.astype(np.uint32), _names(names), _steps(a).astype(np.uint32), b.astype(np.uint32), *counts.astype(np.uint32)))]
        if pool:
            keys, number, names, a, b, counts = _pooled(keys, number, names, a, b, counts)
        c = _without(counts)
        out += _stats(s, 2, number[a], names, lambda m: _times(c[:, m]))
        sums = [np.bincount(b, x > 0, len(keys)) for x in c] + [np.bincount(a, x, len(keys)) for x in c]
        sums += [np.bincount(a, t, len(keys)) for test in (lambda x: x == 1, lambda x: x == 2, lambda x: x >= 3) for t in map(test, c)]
        sums = np.stack(sums).astype(np.int64)
        for t, m in _split(_shard(keys, shards)):
            out.append(_message(t, 1, values=[float(s)], blob=_pack(_steps(keys[m]), number[m].astype(np.uint32), _names(names), _flat(sums[:, m]))))
        del keys, number, pair, a, b, at, counts, c, sums, places
        release()
        return pd.DataFrame(out, columns=_arrow().names)

    return run


def _flat(sums: np.ndarray) -> np.ndarray:
    """Sums word by word: those of rare words repeat and compress well."""
    return sums.T.astype(np.uint32 if not sums.size or sums.max() < 2**32 else np.uint64).ravel()


def _sums(flat: np.ndarray) -> np.ndarray:
    return flat.reshape(-1, 5 * (FOLDS + 1)).T.astype(np.int64)


def _merge_words(key, rows):
    """Of a shard's words: their sums (kind 4), sums by name (3), and the sums of each pair shard's words, in its order (5)."""
    import pandas as pd

    s = int(key[0])
    parts = [_unpack(x) for x in rows["blob"]]
    keys, number, names, places = _join_words([(np.cumsum(k), n.astype(np.int64), json.loads(own.tobytes())) for k, n, own, _ in parts])
    sums = np.zeros((5 * (FOLDS + 1), len(keys)), np.int64)
    for (_, _, _, own), w in zip(parts, places):
        sums[:, w] += _sums(own)
    after = sums[: FOLDS + 1]
    out = [_message(s, 4, blob=_pack(_steps(keys), number.astype(np.uint32), _names(names), _flat(sums)))]
    out += _stats(s, 3, number, names, lambda m: [*_times(after[:, m]), *after[:, m].sum(1), *(after[:, m] > 0).sum(1)])
    out += [_message(v[0], 5, values=[float(s)], blob=_pack(_flat(sums[:, w]))) for v, w in zip(rows["values"], places)]
    del parts, keys, number, places, sums, after
    release()
    return pd.DataFrame(out, columns=_arrow().names)


def train(trusted: DataFrame, shards: int = 4, pool: bool = False) -> tuple[DataFrame, DataFrame]:
    """Count table, as packed messages (shard, kind, name, values, blob), and languages (name, unk0, ..., values) of trusted (name, fold, text).

    Pairs are counted inside blocks of texts, then in the shard of the pair's
    hash, so a frequent word is spread over all shards; what a pair needs of
    its words (in how many contexts they stand, what discounts take from
    them) is summed in the shards of the words and sent back. Counts are kept
    by fold, so every fold can be left out. With ``pool`` the name None, which
    no text may have then, stands for all languages' counts together.
    """
    ks = range(FOLDS + 1)
    grouped = lambda df: df.repartition(shards, "shard").groupBy("shard")
    spark = trusted.sparkSession
    path = fresh_path(spark, "quality-pairs")
    grouped(_count(trusted, shards)).applyInPandas(_merge_pairs(shards, pool), MESSAGE).write.partitionBy("kind").parquet(path)
    pairs = spark.read.schema(MESSAGE).parquet(path).select("shard", "kind", "name", "values", "blob")
    words = materialize(grouped(pairs.filter("kind = 1")).applyInPandas(_merge_words, MESSAGE), "quality-words")
    remove_path(spark, f"{path}/kind=1")
    pairs = spark.read.schema(MESSAGE).parquet(path).select("shard", "kind", "name", "values", "blob")
    total = lambda df, kind, n: df.filter(f"kind = {kind}").groupBy("name").agg(*(F.sum(F.get("values", F.lit(i))).alias(f"x{i}") for i in range(n)))
    x = lambda i: F.col(f"x{i}")
    at = lambda k: [x(4 * k + r) for r in range(4)]
    e = total(pairs, 2, 20).select(F.col("name").alias("of"), F.array(*(d for k in ks for d in discounts(at(k)))).alias("e"))
    low = total(words, 3, 30)
    d = {k: discounts(at(k)) for k in ks}
    t, seen = [x(20 + k) for k in ks], [x(25 + k) for k in ks]
    # The mass that discounts leave, over all words and an unknown one.
    rest = [F.coalesce(F.try_divide(d[k][0] * at(k)[0] + d[k][1] * at(k)[1] + d[k][2] * (seen[k] - at(k)[0] - at(k)[1]), t[k]), F.lit(1.0)) / (seen[k] + 1) for k in ks]
    low = low.select("name", F.array(*(c for k in ks for c in d[k]), *t, *rest).alias("values"), *(F.log(rest[k]).alias(f"unk{k}") for k in ks))
    languages = materialize(low.join(e, F.col("name").eqNullSafe(F.col("of"))).select("name", F.concat("e", "values").alias("values"), *(f"unk{k}" for k in ks)), "quality-languages")
    return pairs.filter("kind in (0, 2)").union(words.filter("kind in (3, 4, 5)")), languages


def _requests(rows: DataFrame, shards: int, salts: int) -> DataFrame:
    """What blocks of texts ask the shards (kind 7: their words and pairs), and a row for each text (kind 8): all columns but the text as ``_c0``, ``_c1``, ..., and ``_n``, the number of words and the text end."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(rows.sparkSession)
    columns = [c for c in rows.columns if c != "text"]
    source = rows.select(*(F.col(c).alias(f"_c{k}") for k, c in enumerate(columns)), F.col("name").alias("_name"), F.col("fold").alias("_fold"), "name", "text", F.monotonically_increasing_id().alias("_row"))
    kept = StructType([f for f in source.schema.fields if f.name not in ("name", "text")])
    for f in kept.fields:
        f.nullable = True
    schema = StructType(kept.fields + StructType.fromDDL("_n long, _block long, _v binary, shard long, salt int, kind int, blob binary").fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        for own, keys, number, names, words, size in _blocks(batches):
            at = _pairs(words, size)
            pair, place = np.unique(words[at] * len(keys) + words[at + 1], return_inverse=True)
            a, b, own_keys = pair // len(keys), pair % len(keys), _own(keys, number, names)
            every = np.concatenate([own_keys, _mix(own_keys[a], own_keys[b])])
            to = _shard(np.concatenate([keys, _mix(keys[a], keys[b])]), shards)
            order = np.lexsort((every, to))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            text = np.repeat(np.arange(len(size)), size)
            asked = rank[np.concatenate([words, len(keys) + place])]
            doc = np.concatenate([text, text[at]])
            every, to = every[order], to[order]
            # By shard, text and key, with the times that a text asks.
            what, times = np.unique((to[asked] * len(size) + doc) * len(every) + asked, return_counts=True)
            k = what % len(every)
            who = what // len(every) % len(size)
            some, first = np.unique(to, return_index=True)
            lines = np.searchsorted(to[k], some)
            ids, folds = (np.array([r[c] for r in own], np.int64) for c in ("_row", "_fold"))
            salt = int(_mix(ids[:1].astype(np.uint64), np.uint64(0))[0]) % salts
            out = [{c: r[c] for c in kept.names} | {"_n": int(n) - 1, "_block": int(ids[0]), "shard": r["_row"] % shards, "salt": salt, "kind": 8} for r, n in zip(own, size)]
            for s, key, line in zip(some, np.split(np.arange(len(every)), first[1:]), np.split(np.arange(len(k)), lines[1:])):
                near, local = who[line], k[line] - key[0]
                # Within a text steps, at its start the whole number.
                step = np.where(np.diff(near, prepend=-1) == 0, _steps(local), local)
                per = np.bincount(near, minlength=len(size))
                out.append({"shard": int(s), "salt": salt, "kind": 7, "_block": int(ids[0]), "blob": _pack(_steps(ids), folds.astype(np.uint8), per.astype(np.uint32), _steps(every[key]), step.astype(np.uint32), times[line].astype(np.uint32))})
            yield pa.RecordBatch.from_pylist(out, arrow)
        release()

    return source.mapInArrow(run, schema)


def _values(rows, asked: np.ndarray) -> np.ndarray:
    """Scores (fold, key) of a shard's words and pairs among the sorted keys ``asked``, 0 where the model has none.

    With interpolation p(b | a) = bow(a) p(b) (1 + (c(ab) - D) / (g(a) p(b))),
    where g(a) is the count mass that discounts take from a: a word scores
    log p + log bow - unk, a pair the logarithm of the last factor.
    """
    told = {n if isinstance(n, str) else None: np.array(v) for n, v in zip(*(rows.loc[rows["kind"] == 6, c] for c in ("name", "values")))}
    blobs = lambda kind: rows.loc[rows["kind"] == kind, "blob"]
    none = np.zeros(40)  # of a language that the block held and the shard doesn't
    out = np.zeros((FOLDS + 1, len(asked)), np.float32)
    shards, pool = int(rows["shards"].iloc[0]), bool(rows["pool"].iloc[0])

    # A first look that most other keys don't pass.
    seen, low = np.zeros(1 << 22, bool), np.uint64((1 << 22) - 1)
    seen[asked & low] = True

    def wanted(keys):
        near = np.flatnonzero(seen[keys & low])
        keys = keys[near]
        at = np.minimum(np.searchsorted(asked, keys), len(asked) - 1)
        use = np.flatnonzero(asked[at] == keys)
        return near[use], at[use]

    def cut(c, d):
        return np.where(c >= 3, d[2], np.where(c == 2, d[1], np.where(c == 1, d[0], 0)))

    def word_scores(sums, number, names, k):
        """(p, g, m, u) of words without fold k, and the discounts of their languages' pairs."""
        v = np.stack([told.get(n, none) for n in names]).T
        e, d, t, u = v[3 * k : 3 * k + 3], v[15 + 3 * k : 18 + 3 * k], v[30 + k], v[35 + k]
        after, m, *times = (sums[i * (FOLDS + 1) + k].astype(np.float64) for i in range(5))
        total = t[number]
        p = np.where(total > 0, (after - cut(after, d[:, number])) / np.where(total > 0, total, 1), 0) + u[number]
        return p, sum(x * y for x, y in zip(e[:, number], times)), m, u[number], e

    if not len(asked):
        return out
    for blob in blobs(4):
        words, number, names, sums = _unpack(blob)
        names, number = json.loads(names.tobytes()), number.astype(np.int64)
        use, at = wanted(_own(np.cumsum(words), number, names))
        number, sums = number[use], _sums(sums)[:, use]
        for k in range(FOLDS + 1):
            p, g, m, u, _ = word_scores(sums, number, names, k)
            out[k, at] = np.log(p / u) + np.where(m > 0, np.log(np.where(m > 0, g, 1) / np.where(m > 0, m, 1)), 0)
    replies = {int(v[0]): b for v, b in zip(rows.loc[rows["kind"] == 5, "values"], blobs(5))}
    for blob in blobs(0):
        words, number, names, a, b, counts = _read_pairs(blob)
        keys = _own(words, number, names)
        use, at = wanted(_mix(keys[a], keys[b]))
        x, y, c = a[use], b[use], counts[:, use]
        if pool:  # as _pooled has them, but only what is asked
            alone, place = np.unique(words, return_inverse=True)
            keys = _own(alone, np.zeros(len(alone), np.int64), [None])
            use, near = wanted(_mix(keys[place[a]], keys[place[b]]))
            near, first, which = np.unique(near, return_index=True, return_inverse=True)
            both = np.stack([np.bincount(which, n, len(near)) for n in counts[:, use]]).astype(np.int64)
            use = use[first]
            x, y = (np.concatenate([o, place[z[use]] + len(words)]) for o, z in ((x, a), (y, b)))
            at, c = np.concatenate([at, near]), np.concatenate([c, both], axis=1)
            words, number, names = np.concatenate([words, alone]), np.concatenate([number, np.full(len(alone), len(names))]), [*names, None]
        sums = np.zeros((5 * (FOLDS + 1), len(words)), np.int64)
        for s, where in _split(_shard(words, shards)):
            sums[:, where] = _sums(*_unpack(replies[int(s)]))
        need, place = np.unique(np.concatenate([x, y]), return_inverse=True)
        a, b = place[: len(x)], place[len(x) :]
        number, sums, c = number[need], sums[:, need], _without(c)
        for k in range(FOLDS + 1):
            p, g, _, _, e = word_scores(sums, number, names, k)
            on = np.flatnonzero(c[k] > 0)
            x, n = c[k][on], number[a[on]]
            out[k, at[on]] = np.log1p((x - cut(x, e[:, n])) / (g[a[on]] * p[b[on]]))
    return out


def _answer(table):
    """Of each block that asks a shard the sums of its texts, and the texts' own rows as they came."""
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = table.select(["shards", "pool", "kind", "name", "values", "blob"]).filter(pc.less(table["kind"], 8)).to_pandas()
    blocks = table.filter(pc.equal(table["kind"], 7))["_block"]
    questions = [_unpack(x) for x in rows.loc[rows["kind"] == 7, "blob"]]
    keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(q[3]) for q in questions)]))
    v = _values(rows, keys)
    sums = []
    for row, fold, per, asked, step, times in questions:
        at, per = np.searchsorted(keys, np.cumsum(asked)), per.astype(np.int64)
        doc = np.repeat(np.arange(len(row)), per)
        k = np.cumsum(step.astype(np.int64))
        first = np.cumsum(per) - per
        k -= np.repeat((k - step)[first[per > 0]], per[per > 0])
        score = v[np.repeat(fold, per), at[k]].astype(np.float64) * times
        sums.append(_pack(np.bincount(doc, score, len(row))))
    del questions, keys, v, rows
    release()
    names = [c for c in table.column_names if c not in ("shards", "pool", "salt", "shard", "kind", "name", "values", "blob")]
    own = table.filter(pc.equal(table["kind"], 8)).select(names)
    made = {"_block": blocks, "_v": pa.array(sums, own.schema.field("_v").type)}
    return pa.concat_tables([own, pa.table([made.get(f.name, pa.nulls(len(sums), f.type)) for f in own.schema], schema=own.schema)])


def _block_sums(table):
    """A block's texts, in the order of their ids, with the sums of all shards' answers."""
    import pyarrow as pa
    import pyarrow.compute as pc

    own = table.filter(pc.is_valid(table["_n"])).sort_by("_row")
    total = np.zeros(own.num_rows)
    for blob in table.filter(pc.is_valid(table["_v"]))["_v"]:
        total += _unpack(blob.as_py())[0]
    return own.drop_columns(["_v", "_block"]).append_column("v", pa.array(total))


def score(rows: DataFrame, table: DataFrame, languages: DataFrame, shards: int = 4, salts: int = 1, pool: bool = False) -> DataFrame:
    """Rows (name, fold, text, ...) with ``perplexity`` for the text: their words and word pairs joined to the count table, shard by shard.

    ``salts``: into how many tasks the questions to a shard are divided. Texts may not be empty or null.
    """
    asked = _requests(rows, shards, salts)
    few = F.broadcast(languages) if languages.limit(10_001).count() <= 10_000 else languages
    own = few.select(F.col("name").alias("of"), F.col("values").alias("told"))
    told = table.filter("kind in (2, 3)").select("shard", "name").distinct().join(own, F.col("name").eqNullSafe(F.col("of"))).select("shard", F.lit(6).alias("kind"), "name", F.col("told").alias("values"), F.lit(None).cast("binary").alias("blob"))
    model = table.filter("kind in (0, 4, 5)").union(told).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    kept = [c for c in asked.columns if c not in ("shard", "kind", "salt", "blob")]
    sent = model.unionByName(asked, allowMissingColumns=True).withColumn("shards", F.lit(shards)).withColumn("pool", F.lit(pool))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.select(kept).schema)
    answers = sent.repartition(shards * salts, "shard", "salt").groupBy("shard", "salt").applyInArrow(_answer, out)
    last = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.select([c for c in kept if c not in ("_v", "_block")]).schema)
    docs = answers.groupBy("_block").applyInArrow(_block_sums, f"{last}, v double")
    docs = docs.join(few.select(F.col("name").alias("of"), *(f"unk{k}" for k in range(FOLDS + 1))), F.col("_name").eqNullSafe(F.col("of")), "left")
    unk = F.coalesce(F.element_at(F.array(*(f"unk{k}" for k in range(FOLDS + 1))), F.col("_fold") + 1), F.lit(0.0))
    own = [F.col(f"_c{k}").alias(c) for k, c in enumerate(c for c in rows.columns if c != "text")]
    return materialize(docs.select(*own, F.exp(-(F.col("v") / F.col("_n") + unk)).alias("perplexity")), "quality-scores")


@contextmanager
def _shuffles_removed(spark):
    """Shuffle files go when their query ends: everything here is written out before it is read again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def classify(docs: DataFrame, trusted_ids: DataFrame, quantile: float = 0.98, doc_id: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """Row by row (doc_id, lang, perplexity, threshold, keep).

    ``trusted_ids``: the doc_ids of trusted texts. A language's threshold is
    the ``quantile`` of its trusted perplexities; a language without trusted
    texts, or a null one, is scored by the counts of all trusted texts and
    takes the threshold of all. Trusted texts are scored by the counts
    outside their fold (equal texts share one), others by all counts. An
    empty or null text has no perplexity and isn't kept. Rows that repeat a
    doc_id are judged by their own texts; extra columns are ignored. With no
    trusted text at all thresholds are null and everything with a text is kept.
    """
    ids = materialize(trusted_ids.select(F.col(doc_id).alias("t")).filter(F.col("t").isNotNull()).distinct(), "quality-trusted")
    ids = F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids
    fold = F.when(F.col("t").isNotNull(), F.pmod(F.xxhash64("text"), F.lit(FOLDS)) + 1).otherwise(0).cast("int")
    told = docs.select(F.col(doc_id).alias("d"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).join(ids, F.col("d") == F.col("t"), "left").select("d", "lang", "text", fold.alias("fold"))
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    full = told.filter(size > 0)
    with _shuffles_removed(docs.sparkSession):
        found = materialize(full.groupBy("lang").agg(F.sum(size).alias("n"), F.sum(F.when(F.col("fold") > 0, size)).alias("known")), "quality-found")
        has = F.col("known").isNotNull() & (F.col("lang") != NAMELESS)
        n, known, strangers = found.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0)), F.coalesce(F.bool_or(~has | F.col("lang").isNull()), F.lit(False))).first()
        own = found.filter(has).select(F.col("lang").alias("own"))
        own = F.broadcast(own) if own.limit(100_001).count() <= 100_000 else own
        named = full.join(own, F.col("lang") == F.col("own"), "left").withColumnRenamed("own", "name")
        learn = named.filter("fold > 0 and name is not null").select("name", "fold", "text")
        # Trusted texts without a language count for nothing but the pool, under a name that no language has.
        if strangers:
            learn = learn.union(named.filter("fold > 0 and name is null").select(F.lit(NAMELESS), "fold", "text"))
        shards = max(4, -(-known // SHARD_CHARS))
        salts = max(1, -(-n // (ROUNDS * shards * SHARD_CHARS)))
        table, languages = train(learn, shards, strangers)
        scored = materialize(told.filter(size == 0).select("d", "lang", "fold", F.lit(None).cast("double").alias("perplexity")), "quality-scores")
        for turn in range(ROUNDS):
            part = named.filter(F.pmod(F.xxhash64("d", "text"), F.lit(ROUNDS)) == turn)
            scored = scored.union(score(part, table, languages, shards, salts, strangers).select("d", "lang", "fold", "perplexity"))
    known = scored.filter("fold > 0 and perplexity is not null")
    cut = known.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10000).alias("own"))
    every = known.agg(F.percentile_approx("perplexity", quantile, 10000)).first()[0]
    # A row for each language.
    few = cut.filter("lang is not null")
    threshold = F.coalesce("own", F.lit(every).cast("double"))
    out = scored.join(F.broadcast(few) if few.limit(100_001).count() <= 100_000 else few, "lang", "left")
    return out.select(F.col("d").alias(doc_id), "lang", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.col("perplexity").isNotNull()).alias("keep"))


def op8_quality(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels.filter("quality = 1"))
