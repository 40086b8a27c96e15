"""Connected regions of cells above a threshold."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..array import ArrayMeta, CellArray
from ..lineage.expr import All, Restrict, Table
from ..storage import written
from .base import ArrayOp

TILE = 256


def _local(g: pd.DataFrame) -> pd.DataFrame:
    """Smallest cell number of each 8-connected region within one tile."""
    at = {c: k for k, c in enumerate(zip(g["i"], g["j"]))}
    up = list(range(len(at)))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for (i, j), k in at.items():
        for n in ((i - 1, j - 1), (i - 1, j), (i - 1, j + 1), (i, j - 1)):
            if n in at:
                a, b = root(k), root(at[n])
                up[max(a, b)] = min(a, b)
    cell = g["cell"].to_numpy()
    roots = np.array([root(k) for k in range(len(at))], int)
    least = pd.Series(cell).groupby(roots).transform("min")
    return pd.DataFrame({"i": g["i"], "j": g["j"], "label": least.to_numpy()})


def regions(cells: DataFrame, meta: ArrayMeta, tile: int = TILE) -> DataFrame:
    """(i, j, label): label is the smallest row-major cell number of the cell's 8-connected region.

    Regions are found inside tiles first; only pairs of labels that touch
    across tile borders go through the joined rounds, which grow with the
    logarithm of the tiles that a region crosses.
    """
    numbered = cells.select("i", "j", (F.col("i") * meta.ncols + F.col("j")).alias("cell"), F.expr(f"i div {tile}").alias("ti"), F.expr(f"j div {tile}").alias("tj"))
    found = written(numbered.groupBy("ti", "tj").applyInPandas(_local, "i long, j long, label long"), "regions")
    edge = F.expr(f"i % {tile} IN (0, {tile - 1}) OR j % {tile} IN (0, {tile - 1})")
    rim = found.filter(edge)
    step = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    near = rim.withColumn("o", step).select((F.col("i") + F.col("o.r")).alias("i"), (F.col("j") + F.col("o.c")).alias("j"), F.col("label").alias("a"))
    touch = near.join(rim.withColumnRenamed("label", "b"), ["i", "j"]).filter("a <> b").select("a", "b")
    pairs = written(touch.union(touch.select("b", "a")).distinct(), "touching")
    if pairs.limit(1).count() == 0:
        return found
    label = pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("low"))
    while True:
        seen = pairs.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("low").alias("near"))
        best = label.join(seen, "node").select("node", F.col("low").alias("old"), F.least("low", "near").alias("key"))
        up = label.select(F.col("node").alias("key"), F.col("low").alias("up"))
        new = written(best.join(up, "key", "left").select("node", "old", F.least("key", "up").alias("low")), "labels")
        label = new.select("node", "low")
        if new.filter("low <> old").limit(1).count() == 0:
            break
    return found.join(label.withColumnRenamed("node", "label"), "label", "left").select("i", "j", F.coalesce("low", "label").alias("label"))


class Cluster(ArrayOp):
    """Each cell above the threshold (first cell of the second array) gets 1 + the smallest cell number of its 8-connected region, others 0."""

    n_args = 2
    modes = ("PTMAP", "PTR")

    def shape(self, metas):
        return ArrayMeta(metas[0].nrows, metas[0].ncols)

    def compute(self, inputs):
        a, limit = inputs
        meta = self.shape([a.meta])
        above = a.df.join(F.broadcast(limit.scalar()), how="cross").filter("v > s")
        found = regions(above.select("i", "j"), meta)
        out = a.cells().join(found, ["i", "j"], "left")
        return CellArray(out.select("i", "j", F.coalesce(F.col("label") + 1, F.lit(0)).cast("double").alias("v")), meta)

    def lineage(self, k, inputs, output):
        """A region's cells come from all its cells, and from the threshold; background has no lineage."""
        member = output.df.filter("v > 0")
        if k == 1:
            return Restrict(All(output.meta, ArrayMeta(1, 1)), member)
        return Regions(output.meta, inputs[0].meta, member)


class Regions(Table):
    """Cells related when they share a label; a query joins labels, never all pairs of a region."""

    def __init__(self, out: ArrayMeta, inp: ArrayMeta, labelled: DataFrame):
        self.out, self.inp, self.labelled = out, inp, labelled.select("i", "j", F.col("v").alias("label"))

    def backward(self, cells):
        hit = self.labelled.join(cells.select("i", "j"), ["i", "j"], "left_semi").select("label").distinct()
        return self.labelled.join(hit, "label", "left_semi").select("i", "j")

    forward = backward
    expands_back = expands_fwd = False

    def edges(self, spark):
        outs = self.labelled.select(F.col("i").alias("oi"), F.col("j").alias("oj"), "label")
        return outs.join(self.labelled.select(F.col("i").alias("ii"), F.col("j").alias("ij"), "label"), "label").select("oi", "oj", "ii", "ij")
