"""Fits the cost models' weights to stores that are written and asked here."""

from __future__ import annotations

import itertools
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..array import ArrayMeta
from ..functions import decode_cell
from ..lineage.store import Store
from .cost import Shape, byte_terms, capture_terms, fit, query_terms
from .strategy import Desc, Mode, Spec

SIDE = 1000
#: (regions, input cells, output cells) of the stores that the weights in ``cost`` come from.
SIZES = ((2000, 9, 1), (40_000, 9, 1), (20_000, 25, 4), (4000, 100, 10), (1000, 400, 25))
LAYOUTS = tuple(Desc(Mode.PTR, o, i, b) for o, i, b in itertools.product((Spec.ONE, Spec.MANY), (Spec.MANY, Spec.KEY), (True, False)))


def region_edges(spark: SparkSession, regions: int, fanin: int, fanout: int) -> DataFrame:
    """Edges of regions with ``fanout`` outputs of their own and ``fanin`` inputs in a row, on a 1000 x 1000 array."""
    r = spark.range(regions).select(F.col("id").alias("r"))
    n = r.select("r", F.explode(F.sequence(F.lit(0), F.lit(fanin - 1))).alias("k")).select("r", ((F.col("r") * 7919 + F.col("k")) % (SIDE * SIDE)).alias("n"))
    e = n.withColumn("o", F.explode(F.transform(F.sequence(F.lit(0), F.lit(fanout - 1)), lambda k: F.col("r") * fanout + k)))
    (oi, oj), (ii, ij) = decode_cell(F.col("o"), SIDE), decode_cell(F.col("n"), SIDE)
    return e.select(oi.alias("oi"), oj.alias("oj"), ii.alias("ii"), ij.alias("ij"))


def _timed(f):
    start = time.time()
    out = f()
    return out, time.time() - start


def measure_stores(spark: SparkSession, sizes=SIZES, layouts=LAYOUTS, n_query: int = 500) -> list[tuple]:
    """(layout, shape, bytes, capture seconds, (result cells, seconds) backward, the same forward) of each store."""
    meta, rows = ArrayMeta(SIDE, SIDE), []
    for regions, fanin, fanout in sizes:
        s = Shape(fanin, fanout, 1.0, regions * fanout)
        i, j = decode_cell(F.col("id") * max(1, regions * fanout // n_query), SIDE)
        asked = spark.range(n_query).select(i.alias("i"), j.alias("j"))
        for d in layouts:
            store, took = _timed(lambda: Store(d, meta, meta, region_edges(spark, regions, fanin, fanout)))
            rows.append((d, s, store.size(), took, _timed(store.backward(asked).count), _timed(store.forward(asked).count)))
    return rows


def calibrate(rows: list[tuple], n_query: int = 500) -> dict[str, dict[str, float]]:
    """Weights for ``cost.BYTES``, ``cost.CAPTURE`` and ``cost.QUERY_S`` from measured stores."""
    asked = [(query_terms(d, s, n_query, cells / n_query, back), took) for d, s, _, _, b, f in rows for back, (cells, took) in ((True, b), (False, f))]
    return {
        "BYTES": fit([byte_terms(d, s) for d, s, *_ in rows], [x[2] for x in rows]),
        "CAPTURE": fit([capture_terms(d, s) for d, s, *_ in rows], [x[3] for x in rows]),
        "QUERY_S": fit([t for t, _ in asked], [x for _, x in asked]),
    }
