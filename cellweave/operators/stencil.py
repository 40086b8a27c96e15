"""Neighbourhood operators: convolution, medians, resampling, cosmic rays.

Small kernels are shifted sums: every cell sends one product for each kernel
cell, summed map-side before the shuffle. Wider footprints work on tiles: a
cell goes to its own tile and to those whose halo it lies in, so the shuffle
carries little more than the array, and numpy does the rest on a dense block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..array import ArrayMeta, CellArray
from ..lineage.expr import All, Restrict, Union, Window, identity
from .base import ArrayOp, same_shape

#: Cells on a tile's side.
TILE = 256
#: Kernels of more cells than this use tiles.
SHIFT_CELLS = 25


def on_tiles(df: DataFrame, meta: ArrayMeta, halo: int, f, values: tuple[str, ...] = ("v",), tile: int = TILE) -> DataFrame:
    """``f(block, ...)`` for each tile with its halo, one dense block for each value column; returns the core cells (i, j, v).

    Blocks end where the array ends, so ``f`` sees true edges there; what it
    makes within ``halo`` of other edges is cut off.
    """
    tile = max(tile, halo + 1)
    nr, nc = -(-meta.nrows // tile), -(-meta.ncols // tile)
    near = lambda c, n: F.sequence(F.greatest(F.floor((F.col(c) - halo) / tile), F.lit(0)), F.least(F.floor((F.col(c) + halo) / tile), F.lit(n - 1)))
    spread = df.withColumn("tj", near("j", nc)).withColumn("ti", F.explode(near("i", nr))).withColumn("tj", F.explode("tj"))

    def work(g: pd.DataFrame) -> pd.DataFrame:
        ti, tj = int(g["ti"].iloc[0]), int(g["tj"].iloc[0])
        r0, r1 = max(0, ti * tile - halo), min(meta.nrows, (ti + 1) * tile + halo)
        c0, c1 = max(0, tj * tile - halo), min(meta.ncols, (tj + 1) * tile + halo)
        blocks = []
        for v in values:
            block = np.zeros((r1 - r0, c1 - c0))
            block[g["i"] - r0, g["j"] - c0] = g[v]
            blocks.append(block)
        out = f(*blocks)
        a, b = ti * tile - r0, tj * tile - c0
        core = out[a : a + min(tile, meta.nrows - ti * tile), b : b + min(tile, meta.ncols - tj * tile)]
        i, j = np.indices(core.shape)
        return pd.DataFrame({"i": (i + ti * tile).ravel(), "j": (j + tj * tile).ravel(), "v": core.ravel().astype(float)})

    return spread.select("ti", "tj", "i", "j", *[F.col(v).cast("double").alias(v) for v in values]).groupBy("ti", "tj").applyInPandas(work, "i long, j long, v double")


#: Names of numpy's paddings: "reflect" is (d c b a | a b c d | d c b a), "mirror" (d c b | a b c d | c b a).
_PAD = {"reflect": "symmetric", "mirror": "reflect"}


def _padded(a: np.ndarray, h: int, w: int, mode: str) -> np.ndarray:
    if mode == "constant":
        return np.pad(a, ((h, h), (w, w)))
    # A side of one cell has nothing to reflect without its edge: repeat it.
    out = np.pad(a, ((h, h), (0, 0)), mode=_PAD[mode] if a.shape[0] > 1 else "edge")
    return np.pad(out, ((0, 0), (w, w)), mode=_PAD[mode] if a.shape[1] > 1 else "edge")


def convolve_block(a: np.ndarray, kernel: np.ndarray, mode: str = "constant") -> np.ndarray:
    h, w = kernel.shape[0] // 2, kernel.shape[1] // 2
    p = _padded(a, h, w, mode)
    out = np.zeros(a.shape)
    for r in range(kernel.shape[0]):
        for c in range(kernel.shape[1]):
            k = kernel[kernel.shape[0] - 1 - r, kernel.shape[1] - 1 - c]
            if k:
                out += k * p[r : r + a.shape[0], c : c + a.shape[1]]
    return out


def median_block(a: np.ndarray, size: int, mode: str = "mirror") -> np.ndarray:
    p = _padded(a, size // 2, size // 2, mode)
    return np.median(np.lib.stride_tricks.sliding_window_view(p, (size, size)), axis=(2, 3))


def median_filter(a: CellArray, size: int, mode: str = "mirror") -> CellArray:
    """Median of the size x size window around every cell."""
    return CellArray(on_tiles(a.df, a.meta, size, lambda x: median_block(x, size, mode)), ArrayMeta(a.meta.nrows, a.meta.ncols))


def upsample2(a: CellArray) -> CellArray:
    """Each cell four times; values lose their fraction."""
    four = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (0, 1) for c in (0, 1)]))
    df = a.df.withColumn("o", four).select((F.col("i") * 2 + F.col("o.r")).alias("i"), (F.col("j") * 2 + F.col("o.c")).alias("j"), F.col("v").cast("long").cast("double").alias("v"))
    return CellArray(df, ArrayMeta(2 * a.meta.nrows, 2 * a.meta.ncols))


def rebin(a: CellArray, f: int = 2) -> CellArray:
    """Means of f x f blocks; the sides must be multiples of f."""
    if a.meta.nrows % f or a.meta.ncols % f:
        raise ValueError(f"sides must be multiples of {f}")
    df = a.df.groupBy(F.expr(f"i div {f}").alias("i"), F.expr(f"j div {f}").alias("j")).agg(F.avg("v").alias("v"))
    return CellArray(df, ArrayMeta(a.meta.nrows // f, a.meta.ncols // f))


class Convolve(ArrayOp):
    """Two-dimensional convolution with zeros outside; the second array is the kernel, of odd sides."""

    n_args = 2
    modes = ("MAP", "PTMAP", "PTR")

    def shape(self, metas):
        return ArrayMeta(metas[0].nrows, metas[0].ncols)

    def compute(self, inputs):
        a, kernel = inputs
        meta, km = self.shape([a.meta]), kernel.meta
        if km.size > SHIFT_CELLS:
            k = np.array(kernel.to_matrix(), float)
            return CellArray(on_tiles(a.df, meta, max(k.shape) // 2, lambda x: convolve_block(x, k)), meta)
        # out[i, j] = sum k[r, c] * a[i + h - r, j + w - c]
        k = kernel.df.select((F.col("i") - km.nrows // 2).alias("dr"), (F.col("j") - km.ncols // 2).alias("dc"), F.col("v").cast("double").alias("k"))
        sent = a.df.join(F.broadcast(k), how="cross").select((F.col("i") + F.col("dr")).alias("i"), (F.col("j") + F.col("dc")).alias("j"), (F.col("v") * F.col("k")).alias("v"))
        inside = sent.filter((F.col("i") >= 0) & (F.col("i") < meta.nrows) & (F.col("j") >= 0) & (F.col("j") < meta.ncols))
        return CellArray(inside.groupBy("i", "j").agg(F.sum("v").alias("v")), meta)

    def lineage(self, k, inputs, output):
        km = inputs[1].meta
        if k == 1:
            return All(output.meta, km)
        return Window(output.meta, inputs[0].meta, (-(km.nrows // 2), km.nrows // 2), (-(km.ncols // 2), km.ncols // 2))


# --- cosmic rays --------------------------------------------------------------

#: Fixed values of the detector: gain, read noise, detection limit, share of it for neighbours, contrast limit.
GAIN, READ_NOISE, SIGCLIP, SIGFRAC, OBJLIM = 2.2, 10.0, 5.0, 0.3, 5.0
#: Cells that a mask cell can depend on, in each direction: the stages' footprints added up.
CR_HALO = 10


def cosmic_block(a: np.ndarray, laplacian: np.ndarray) -> np.ndarray:
    """The mask of cosmic-ray cells of a block."""
    fine = np.trunc(np.repeat(np.repeat(a, 2, 0), 2, 1))
    edges = np.maximum(convolve_block(fine, laplacian, "reflect"), 0)
    up = edges.reshape(a.shape[0], 2, a.shape[1], 2).mean(axis=(1, 3))
    noise = np.sqrt(GAIN * np.maximum(median_block(a, 5), 1e-5) + READ_NOISE**2) / GAIN
    s = up / (2 * noise)
    s = s - median_block(s, 5)
    small = median_block(a, 3)
    contrast = np.maximum((small - median_block(small, 7)) / noise, 0.01)
    found = (s > SIGCLIP) & (s / contrast > OBJLIM)
    grow = lambda m: convolve_block(m.astype(float), np.ones((3, 3)), "mirror") > 0
    return grow(grow(found) & (s > SIGCLIP)) & (s > SIGCLIP * SIGFRAC)


class CRDetect(ArrayOp):
    """Boolean mask of cosmic rays, by Laplacian edge detection; the second array is the Laplacian kernel."""

    n_args = 2
    modes = ("MAP+PTMAP", "PTR")

    def shape(self, metas):
        return ArrayMeta(metas[0].nrows, metas[0].ncols, "boolean")

    def compute(self, inputs):
        a, kernel = inputs
        k = np.array(kernel.to_matrix(), float)
        df = on_tiles(a.df, a.meta, CR_HALO, lambda x: cosmic_block(x, k))
        return CellArray(df.select("i", "j", (F.col("v") > 0).alias("v")), self.shape([a.meta]))

    def lineage(self, k, inputs, output):
        """Every cell comes from itself; a cosmic-ray cell from its 7 x 7 neighbours and the kernel too."""
        hit = output.df.filter("v")
        if k == 1:
            return Restrict(All(output.meta, inputs[1].meta), hit)
        return Union(identity(output.meta), Restrict(Window(output.meta, inputs[0].meta, (-3, 3), (-3, 3)), hit))


class RemoveCRs(ArrayOp):
    """Masked cells replaced by the median of the unmasked cells in the 5 x 5 window around them.

    A masked cell without an unmasked neighbour there is an error.
    """

    n_args = 2
    modes = ("MAP+PTMAP", "PTR")

    def shape(self, metas):
        same_shape(*metas)
        return ArrayMeta(metas[0].nrows, metas[0].ncols)

    def compute(self, inputs):
        a, mask = inputs
        meta = self.shape([a.meta, mask.meta])
        both = a.df.join(mask.df.select("i", "j", F.col("v").cast("boolean").alias("m")), ["i", "j"])
        # Only masked cells ask for neighbours: 25 keys each, joined once.
        off = F.sequence(F.lit(-2), F.lit(2))
        asked = both.filter("m").select(F.col("i").alias("ci"), F.col("j").alias("cj"), F.explode(off).alias("dr")).withColumn("dc", F.explode(off))
        asked = asked.select("ci", "cj", (F.col("ci") + F.col("dr")).alias("i"), (F.col("cj") + F.col("dc")).alias("j"))
        fill = asked.join(both.filter("not m").select("i", "j", "v"), ["i", "j"]).groupBy(F.col("ci").alias("i"), F.col("cj").alias("j")).agg(F.median("v").alias("fill"))
        out = both.join(fill, ["i", "j"], "left")
        v = F.when(~F.col("m"), F.col("v")).when(F.col("fill").isNull(), F.raise_error("a masked cell has no unmasked neighbour").cast("double")).otherwise(F.col("fill"))
        return CellArray(out.select("i", "j", v.cast("double").alias("v")), meta)

    def lineage(self, k, inputs, output):
        if k == 1:
            return identity(output.meta)
        masked = inputs[1].df.filter(F.col("v").cast("boolean"))
        return Union(identity(output.meta), Restrict(Window(output.meta, inputs[0].meta, (-2, 2), (-2, 2)), masked))
