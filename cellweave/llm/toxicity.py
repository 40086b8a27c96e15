"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score over its
words, and a document is toxic with the noisy-or of its sentences,
``1 - prod(1 - p)``. Only documents carry labels; the gradient of the noisy-or
finds the sentences that explain them, which ``offending`` then locates.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, rewrite_texts, semi_join, text_map

#: Bounds of the sample that the model is fitted on: documents of each label, and characters in all.
FIT_DOCS, FIT_CHARS = 3000, 24_000_000
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
ENDS = (".", "!", "?", "\n")


def held_out(doc_id):
    """crc32 of the id as text, modulo 5, is 0; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sentences(text: str, known) -> tuple[np.ndarray, np.ndarray]:
    """(words, sentence of each word), words by number, unknown ones as -1; sentences without words have no number."""
    ids = np.fromiter((known(t, -1) for t in TOKEN.findall(text.lower())), np.int64)
    end = ids == -2
    sent = np.cumsum(end)[~end]
    return ids[~end], np.unique(sent, return_inverse=True)[1] if len(sent) else sent


def fit_noisy_or(texts: list[str], y: np.ndarray, weight: np.ndarray, steps: int = 200, rate: float = 0.15, l1: float = 5e-5, least: int = 4) -> dict:
    """{"bias": b, "words": {word: weight}}; words of fewer than ``least`` documents are left out."""
    seen: dict[str, int] = {}
    for t in texts:
        for w in set(TOKEN.findall(t.lower())):
            seen[w] = seen.get(w, 0) + 1
    vocab = {w: k for k, w in enumerate(sorted(w for w, n in seen.items() if n >= least and w not in ENDS))}
    known = (vocab | dict.fromkeys(ENDS, -2)).get
    words, sents, docs, n_sent = [], [], [], 0
    for d, t in enumerate(texts):
        w, s = _sentences(t, known)
        if len(w):
            k = int(s.max()) + 1
            docs.append(np.full(k, d, np.int32))
            pair = np.unique(np.stack([s[w >= 0] + n_sent, w[w >= 0]]), axis=1)
            sents.append(pair[0].astype(np.int32))
            words.append(pair[1].astype(np.int32))
            n_sent += k
    if not n_sent or not len(vocab) or y.min() == y.max():
        share = float(np.clip(np.average(y, weights=weight), 0.01, 0.99)) if len(y) else 0.01
        return {"bias": float(np.log(share / (1 - share))) - 3, "words": {}}
    word, sent, doc = (np.concatenate(x) for x in (words, sents, docs))
    w, b, n = np.zeros(len(vocab)), -5.0, len(y)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    scale = weight / weight.sum()
    for t in range(1, steps + 1):
        z = b + np.bincount(sent, w[word], n_sent)
        p = 1 / (1 + np.exp(-z))
        a = np.bincount(doc, np.logaddexp(0, z), n)
        slope = scale * np.where(y > 0, -1 / np.expm1(np.clip(a, 1e-6, 50)), 1.0)
        g = slope[doc] * p
        gw, gb = np.bincount(word, g[sent], len(w)), g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        size = rate / (np.sqrt(v / c2) + 1e-5)
        w = w - size * m / c1
        w = np.sign(w) * np.maximum(np.abs(w) - size * l1, 0)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-5)
    return {"bias": float(b), "words": {k: float(w[i]) for k, i in vocab.items() if abs(w[i]) > 0.05}}


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS) -> dict:
    """Model from a bounded sample of labelled documents outside the held-out fifth.

    Of each label the ``fit_docs`` documents with the smallest id hashes are
    taken; of these, those that fit in the label's share of ``fit_chars`` (what
    a label leaves goes to the other), in that order and passing over any that
    don't. Weights restore the shares that the labels have. Null ids, labels
    and texts don't count. It is an error if none of a label's texts is taken.
    """
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).select(F.col(doc_id).alias("_d"), F.col(label).alias("_y")).groupBy("_d").agg(F.max("_y").alias("_y")).filter(~held_out(F.col("_d")))
    shares = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for y in shares:
        part = known.filter(F.col("_y") == y).orderBy(F.xxhash64("_d"), "_d").limit(fit_docs)
        picked = part if picked is None else picked.union(part)
    if picked is None:
        return {"bias": -6.0, "words": {}}
    rows = docs.select(F.col(doc_id).alias("_d"), F.col(text).alias("_t")).filter("_t is not null").join(F.broadcast(picked), "_d")
    rows = materialize(rows.groupBy("_d").agg(F.max("_y").alias("_y"), F.min("_t").alias("_t")).withColumn("_n", F.length("_t")), "toxicity-sample")
    sizes = rows.select("_d", "_n", "_y").orderBy(F.xxhash64("_d"), "_d").toPandas()
    ids, left = [], fit_chars
    groups = sorted((g for _, g in sizes.groupby("_y")), key=lambda g: g["_n"].sum())
    for k, g in enumerate(groups):
        room = left // (len(groups) - k)
        for d, n in zip(g["_d"].tolist(), g["_n"].tolist()):
            if n <= room:
                ids.append(d)
                room, left = room - n, left - n
    used = rows.join(F.broadcast(rows.sparkSession.createDataFrame([(x,) for x in ids], rows.select("_d").schema)), "_d").orderBy("_d").toPandas() if ids else rows.limit(0).toPandas()
    y = used["_y"].to_numpy(np.int64)
    for k in set(shares) - set(y.tolist()):
        if semi_join(docs.filter(F.col(text).isNotNull()), known.filter(F.col("_y") == k).select(F.col("_d").alias(doc_id)), doc_id).limit(1).count():
            raise ValueError(f"no text labelled {label} = {k} is in the sample of {fit_docs} documents and {fit_chars} characters")
    taken = {k: max(1, int((y == k).sum())) for k in shares}
    weight = np.array([shares[k] / taken[k] for k in y])
    return fit_noisy_or(used["_t"].tolist(), y, weight) if len(y) else {"bias": -6.0, "words": {}}


def _scorer(model: dict):
    known = model["words"] | dict.fromkeys(ENDS, np.nan)
    bias = model["bias"]

    def sentence_logits(text: str) -> np.ndarray:
        """A logit for each sentence that has words."""
        get = known.get
        v = np.array([get(t, 0.0) for t in TOKEN.findall(text.lower())])
        if not len(v):
            return v
        end = np.isnan(v)
        n = np.bincount(np.cumsum(end)[~end])
        return bias + np.bincount(np.cumsum(end)[~end], v[~end])[n > 0]

    return sentence_logits


def _noisy_or(logits: np.ndarray) -> float:
    return float(-np.expm1(-np.logaddexp(0, logits).sum())) if len(logits) else 0.0


def score(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` row by row as (doc_id, score): the noisy-or of its sentences.

    A null or empty text, or one without words, has no sentences and scores
    0. Repeated rows are scored alike, extra columns ignored.
    """

    def setup():
        logits = _scorer(model)
        return lambda texts: [[_noisy_or(logits(t)) for t in texts]]

    return text_map(docs, {doc_id: doc_id}, text, "score double", setup)


def offending(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """(doc_id, start, end, sentence, score) of sentences that score ``least`` or more; ends exclusive, in code points."""
    part = re.compile(r"[^.!?\n]+")

    def setup():
        logits = _scorer(model)

        def locate(t: str) -> list[dict]:
            out = []
            for m in part.finditer(t):
                z = logits(m[0])
                if len(z) and (p := _noisy_or(z)) >= least:
                    out.append({"start": m.start(), "end": m.end(), "sentence": m[0], "score": p})
            return out

        return lambda texts: [[locate(t) for t in texts]]

    found = text_map(docs, {doc_id: doc_id}, text, "found array<struct<start:long,end:long,sentence:string,score:double>>", setup)
    return found.select(doc_id, F.explode("found").alias("f")).select(doc_id, "f.*")


def filter_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``threshold``."""
    model = fit(docs, labels)

    def setup():
        logits = _scorer(model)
        return lambda texts: ([_noisy_or(logits(t or "")) < threshold for t in texts], None)

    return rewrite_texts(docs, "text", setup)


def op6_toxicity(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
