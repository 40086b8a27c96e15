"""Exact top-k by inner product as a Voronoi kNN join.

Rows and queries are grouped by their nearest pivot. A group of queries keeps
its pivot ``g``, radius ``R`` and largest norm ``N``; a cell of data keeps its
pivot ``p`` and the smallest distances ``d`` of its members to it. For a query
``q`` of the group and a member ``x`` at distance ``d``,

    q.x  >=  g.p - R|p| - N d      (lower bound, from the summaries alone)
    q.x  <=  g.x + R|x|            (upper bound, for a given row)

so the (k+1)-th largest lower bound of a group (one row may be the query
itself) is a score that every query of it reaches, and only rows whose upper
bound reaches it are sent there. A cell's own bound, from its summary, tells how
many rows a group will be sent; groups that would get most of the table anyway
become one, to which each row goes once rather than once for each of them.
Groups are solved in blocks of queries and rows and merged. Any pivots give the
same result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Rows and queries that one task holds, and of these how many are scored at a time.
BLOCK_ROWS, BLOCK_QUERIES = 50_000, 10_000
STEP_ROWS, STEP_QUERIES = 16_384, 256
#: Pivots at most; with fewer rows, an eighth of the root of their number.
MAX_PIVOTS = 4096
#: A group that is sent more than this share of the table shares one copy of it with others like it.
WIDE = 0.5


def quantize(df: DataFrame, id_col: str, vec_col: str, scale: int = 1024) -> DataFrame:
    """(id, v): floor(scale * x) of each component, for rows with an id and only finite components."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    fine = F.col(vec_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return df.filter(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def _unpack(col: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(col), kind).reshape(len(col), -1)


def _dot(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Exact integer products; floats carry them while every sum stays below 2**53."""
    if most * most * max(1, a.shape[1]) < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def top_k(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, most: int) -> pd.DataFrame:
    """(query_id, vec_id, score): the ``k`` best rows of each query but itself, ties to the smaller id; scored in steps of bounded size."""
    order = np.argsort(ids, kind="stable")
    ids, rows, out = ids[order], rows[order], []
    for at in range(0, len(query_ids), STEP_QUERIES):
        who, part = query_ids[at : at + STEP_QUERIES], queries[at : at + STEP_QUERIES]
        q, i, s = (np.empty(0, np.int64) for _ in range(3))
        least = np.full(len(who), -(2**63), np.int64)  # only scores above it, or what is not yet k rows, count
        full = np.zeros(len(who), bool)
        for row in range(0, len(ids), STEP_ROWS):
            own = ids[row : row + STEP_ROWS]
            score = _dot(part, rows[row : row + STEP_ROWS], most)
            bar = np.partition(score, -(k + 1), axis=1)[:, -(k + 1)] if len(own) > k else np.full(len(who), -(2**63), np.int64)
            # Ids ascend from step to step, so a later row must beat the k-th, not equal it.
            hit = (score >= bar[:, None]) & (own[None] != who[:, None]) & ((score > least[:, None]) | ~full[:, None])
            a, b = np.nonzero(hit)
            q, i, s = np.concatenate([q, a]), np.concatenate([i, own[b]]), np.concatenate([s, score[a, b]])
            best = np.lexsort((i, ~s, q))
            q, i, s = q[best], i[best], s[best]
            first = np.searchsorted(q, np.arange(len(who)))
            keep = np.arange(len(q)) - first[q] < k
            q, i, s = q[keep], i[keep], s[keep]
            count = np.bincount(q, minlength=len(who))
            full = count >= k
            last = np.cumsum(count) - 1
            least[full] = s[last[full]]
        out.append(pd.DataFrame({"query_id": who[q], "vec_id": i, "score": s}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")


def knn_join(data: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", n_pivots: int | None = None, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` rows with the largest integer inner product, ties to the smaller id.

    ``is_query``: a condition on ``id``. Rows with a null id or vector, or with
    a null or non-finite component, take no part. Of rows that repeat an id
    the smallest vector counts, once. Shorter vectors count as padded with
    zeros, empty ones as zero. Components, and scores, saturate at 64 bits.
    An empty table gives no rows; extra columns are ignored.
    """
    asked, sent, most, kind = route(data, is_query, k, id_col, vec_col, n_pivots, block_rows, block_queries)

    def solve(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        return top_k(queries["id"].to_numpy(), _unpack(queries["v"], kind), rows["id"].to_numpy(), _unpack(rows["v"], kind), k, most)

    keys = ["g", "part", "block"]
    best = asked.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(solve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def route(data: DataFrame, is_query, k: int, id_col: str, vec_col: str, n_pivots: int | None, block_rows: int, block_queries: int) -> tuple[DataFrame, DataFrame, int, str]:
    """(queries, rows, largest component, type): queries and the rows that may be among their best, both (g, part, block, id, v) by group, block of its queries and block of rows."""
    spark = data.sparkSession
    schema = "g int, part int, block int, id long, v binary"
    ints = materialize(quantize(data, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v")), "vectors")
    shape = ints.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.greatest(F.abs(F.coalesce(F.array_max("v"), F.lit(0))), F.abs(F.coalesce(F.array_min("v"), F.lit(0)))))).first()
    n, dim, most = shape[0], max(1, shape[1] or 1), int(shape[2] or 0)
    if most < 0:
        most = 2**63
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8"
    wanted = n_pivots or min(MAX_PIVOTS, max(8, int(n**0.5) // 8))
    pivot_rows = ints.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
    if not n:
        return spark.createDataFrame([], schema), spark.createDataFrame([], schema), most, kind
    pivots = np.zeros((len(pivot_rows), dim))
    for r, row in enumerate(pivot_rows):
        pivots[r, : len(row["v"])] = row["v"]
    pivots = np.unique(pivots, axis=0)
    p_norm = np.sqrt((pivots**2).sum(1))

    def assign(batches):
        for b in batches:
            v = np.zeros((len(b), dim), np.int64)
            for r, row in enumerate(b["v"]):
                v[r, : len(row)] = row
            x = v.astype(np.float64)
            d2 = (x**2).sum(1)[:, None] - 2 * (x @ pivots.T) + (p_norm**2)[None]
            cell = d2.argmin(1)
            dist = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
            yield pd.DataFrame({"id": b["id"], "v": [r.tobytes() for r in v.astype(kind)], "cell": cell.astype(np.int32), "dist": dist, "norm": np.sqrt((x**2).sum(1))})

    cells = materialize(ints.mapInPandas(assign, "id long, v binary, cell int, dist double, norm double"), "cells")

    def nearest(batches):
        for b in batches:
            yield b.sort_values(["cell", "dist"]).groupby("cell").head(k + 1)

    def nearest_of(g: pd.DataFrame) -> pd.DataFrame:
        return g.nsmallest(k + 1, "dist")

    near = cells.select("cell", "dist").mapInPandas(nearest, "cell int, dist double").groupBy("cell").applyInPandas(nearest_of, "cell int, dist double").toPandas()
    # A row for each pivot at most.
    groups = cells.filter(is_query).groupBy("cell").agg(F.max("dist").alias("radius"), F.max("norm").alias("norm"), F.count(F.lit(1)).alias("n")).toPandas()
    about = cells.groupBy("cell").agg(F.max("dist").alias("far"), F.max("norm").alias("norm"), F.count(F.lit(1)).alias("n")).toPandas()
    if groups.empty:
        return spark.createDataFrame([], schema), spark.createDataFrame([], schema), most, kind
    gid, radius, q_norm = groups["cell"].to_numpy(), groups["radius"].to_numpy(), groups["norm"].to_numpy()
    c, d = near["cell"].to_numpy(), near["dist"].to_numpy()
    low = pivots[gid] @ pivots[c].T - radius[:, None] * p_norm[c][None] - q_norm[:, None] * d[None]
    floor = np.sort(low, axis=1)[:, -(k + 1)] if low.shape[1] > k else np.full(len(gid), -np.inf)
    floor = floor - 1e-6 * (1 + np.abs(floor))  # rounding

    # g.x <= g.p + |g| far, for any member x of a cell; whole cells that can't reach the floor count for nothing.
    at = about["cell"].to_numpy()
    reach = pivots[gid] @ pivots[at].T + p_norm[gid][:, None] * about["far"].to_numpy()[None] + radius[:, None] * about["norm"].to_numpy()[None]
    rows_of = (reach >= floor[:, None]) @ about["n"].to_numpy()
    wide = rows_of > WIDE * n
    lone = np.flatnonzero(~wide)
    parts_of = lambda q: max(1, -(-int(q) // block_queries))
    blocks_of = lambda r: max(1, -(-int(r) // block_rows))
    #: Group of each pivot, with its blocks of queries and of rows; -1 is the group of all wide ones.
    group = {int(gid[x]): (int(gid[x]), parts_of(groups["n"][x]), blocks_of(rows_of[x])) for x in lone}
    if wide.any():
        shared = (-1, parts_of(groups["n"][wide].sum()), blocks_of(n))
        group |= {int(g): shared for g in gid[wide]}
    centres, gid, radius, floor = pivots[gid[lone]], gid[lone], radius[lone], floor[lone]
    sizes = [group[int(g)][1:] for g in gid]
    spread = lambda ids, m: ((ids ^ (ids >> 7)) % m).astype(np.int32)

    def ask(batches):
        for b in batches:
            g, parts, blocks = (np.array([group[x][y] for x in b["cell"]], np.int64) for y in range(3))
            rows = np.repeat(np.arange(len(b)), blocks)
            block = np.arange(len(rows)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            ids = b["id"].to_numpy()
            yield pd.DataFrame({"g": g[rows].astype(np.int32), "part": spread(ids, parts)[rows], "block": block.astype(np.int32), "id": ids[rows], "v": b["v"].to_numpy()[rows]})

    def replicate(batches):
        for b in batches:
            ids, v = b["id"].to_numpy(), b["v"].to_numpy()
            if wide.any():
                for part in range(shared[1]):
                    yield pd.DataFrame({"g": np.int32(-1), "part": np.int32(part), "block": spread(ids, shared[2]), "id": ids, "v": v})
            if len(gid):
                x, norm = _unpack(b["v"], kind).astype(np.float64), b["norm"].to_numpy()
                for lo in range(0, len(gid), STEP_QUERIES):
                    some = slice(lo, lo + STEP_QUERIES)
                    high = centres[some] @ x.T + radius[some, None] * norm[None]
                    hit = high + 1e-6 * (1 + np.abs(high)) >= floor[some, None]
                    for g in np.flatnonzero(hit.any(1)).tolist():
                        at = np.flatnonzero(hit[g])
                        parts, blocks = sizes[lo + g]
                        for part in range(parts):
                            yield pd.DataFrame({"g": np.int32(gid[lo + g]), "part": np.int32(part), "block": spread(ids[at], blocks), "id": ids[at], "v": v[at]})

    asked = cells.filter(is_query).select("cell", "id", "v").mapInPandas(ask, schema)
    return asked, cells.select("id", "v", "norm").mapInPandas(replicate, schema), most, kind


def op2_knn(spark, sf_dir):
    return knn_join(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
