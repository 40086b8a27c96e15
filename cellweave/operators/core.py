"""Cell-wise, zip, slice, transpose and reduce operators."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..array import ArrayMeta, CellArray, domain
from ..lineage.expr import Affine, All, Union, identity
from .base import ArrayOp, same_shape

Expr = Callable[..., Column]


def python_cell(f: Callable[..., float]) -> Expr:
    """A plain Python function of cell values as an Arrow-batched column function."""

    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([float(f(*v)) for v in zip(*cols)], dtype="float64")

    def call(*cols: Column) -> Column:
        if len(cols) == 1:

            @F.pandas_udf("double")
            def one(a: pd.Series) -> pd.Series:
                return run(a)

            return one(*cols)

        @F.pandas_udf("double")
        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return run(a, b)

        return two(*cols)

    return call


def take(a: CellArray, rows: list[int] | None = None, cols: list[int] | None = None) -> CellArray:
    """Rows and columns by index lists, in the lists' order; an index may repeat."""
    spark, df, n, m = a.df.sparkSession, a.df, a.meta.nrows, a.meta.ncols
    for key, wanted in (("i", rows), ("j", cols)):
        if wanted is not None:
            at = spark.createDataFrame(list(enumerate(wanted)), f"new long, {key} long")
            df = df.join(F.broadcast(at), key).drop(key).withColumnRenamed("new", key)
    return CellArray(df, ArrayMeta(n if rows is None else len(rows), m if cols is None else len(cols), a.meta.dtype))


class OneToOne(ArrayOp):
    """``f`` of every cell, a Column function (see ``python_cell`` for plain ones); float result."""

    def __init__(self, f: Expr, dtype: str = "double"):
        self.f, self.dtype = f, dtype

    def shape(self, metas):
        return ArrayMeta(metas[0].nrows, metas[0].ncols, self.dtype)

    def compute(self, inputs):
        return inputs[0].with_values(self.f(F.col("v")).cast(self.dtype), self.dtype)

    def lineage(self, k, inputs, output):
        return identity(output.meta)


class Clip(OneToOne):
    """The value where ``keep`` holds, else 0."""

    def __init__(self, keep: Expr):
        super().__init__(lambda v: F.when(keep(v), v).otherwise(0.0))


class Clean(OneToOne):
    """Values clamped to [lo, hi]."""

    def __init__(self, lo: float = 100.0, hi: float = 16000.0):
        super().__init__(lambda v: F.greatest(F.least(v, F.lit(float(hi))), F.lit(float(lo))))


class NormalizeTrain(OneToOne):
    """log10 of every cell."""

    def __init__(self):
        super().__init__(F.log10)


class Sigmoid(OneToOne):
    def __init__(self):
        super().__init__(lambda v: 1 / (1 + F.exp(-v)))


class GetClasses(OneToOne):
    """"Y" above one half, else "N"."""

    def __init__(self):
        super().__init__(lambda v: F.when(v > 0.5, "Y").otherwise("N"), "string")


class MeanSingleVal(ArrayOp):
    """The mean as a 1x1 array."""

    def shape(self, metas):
        return ArrayMeta(1, 1)

    def compute(self, inputs):
        one = inputs[0].df.agg(F.avg(F.col("v").cast("double")).alias("v"))
        return CellArray(one.select(F.lit(0).alias("i"), F.lit(0).alias("j"), "v"), ArrayMeta(1, 1))

    def lineage(self, k, inputs, output):
        return All(output.meta, inputs[0].meta)


class Mean(MeanSingleVal):
    """An array of the same shape, filled with the mean: one row, sent to every task."""

    def shape(self, metas):
        return ArrayMeta(metas[0].nrows, metas[0].ncols)

    def compute(self, inputs):
        a = inputs[0]
        one = a.df.agg(F.avg(F.col("v").cast("double")).alias("v"))
        return CellArray(domain(a.df.sparkSession, a.meta).join(F.broadcast(one), how="cross"), ArrayMeta(a.meta.nrows, a.meta.ncols))


class Merge(ArrayOp):
    """``f`` of the cells of two arrays of one shape; other shapes are an error."""

    n_args = 2

    def __init__(self, f: Expr):
        self.f = f

    def shape(self, metas):
        same_shape(*metas)
        return ArrayMeta(metas[0].nrows, metas[0].ncols)

    def compute(self, inputs):
        a, b = inputs
        meta = self.shape([a.meta, b.meta])
        both = a.df.withColumnRenamed("v", "a").join(b.df.withColumnRenamed("v", "b"), ["i", "j"])
        return CellArray(both.select("i", "j", self.f(F.col("a"), F.col("b")).cast("double").alias("v")), meta)

    def lineage(self, k, inputs, output):
        return identity(output.meta)


class Diff(Merge):
    def __init__(self):
        super().__init__(lambda a, b: a - b)


class Add(Merge):
    def __init__(self):
        super().__init__(lambda a, b: a + b)


class Div(Merge):
    """a / b; null where b is 0."""

    def __init__(self):
        super().__init__(lambda a, b: F.try_divide(a, b))


class LogicalAnd(Merge):
    """1 where both are true, else 0; numbers count as true unless 0."""

    def __init__(self):
        super().__init__(lambda a, b: F.when(a.cast("boolean") & b.cast("boolean"), 1.0).otherwise(0.0))


class BadPixRemoval(Merge):
    """90 where the mask (second array) is set, or where the value is 0."""

    def __init__(self):
        super().__init__(lambda a, b: F.when(~b.cast("boolean") & (a != 0), a).otherwise(90.0))


class MergeSingleVal(ArrayOp):
    """``f`` of every cell and a scalar, the first cell of the second array."""

    n_args = 2

    def __init__(self, f: Expr):
        self.f = f

    def shape(self, metas):
        return ArrayMeta(metas[0].nrows, metas[0].ncols)

    def compute(self, inputs):
        a, s = inputs
        both = a.df.join(F.broadcast(s.scalar()), how="cross")
        return CellArray(both.select("i", "j", self.f(F.col("v"), F.col("s")).cast("double").alias("v")), self.shape([a.meta]))

    def lineage(self, k, inputs, output):
        return identity(output.meta) if k == 0 else All(output.meta, ArrayMeta(1, 1))


class DiffSingleVal(MergeSingleVal):
    def __init__(self):
        super().__init__(lambda v, s: v - s)


class Subsample(ArrayOp):
    """Rows r0..r1 and columns c0..c1, ends exclusive, moved to the origin; the filter reaches the scan."""

    def __init__(self, box: tuple[tuple[int, int], tuple[int, int]]):
        self.box = box

    def _clipped(self, meta):
        (r0, r1), (c0, c1) = self.box
        return r0, min(r1, meta.nrows), c0, min(c1, meta.ncols)

    def shape(self, metas):
        r0, r1, c0, c1 = self._clipped(metas[0])
        return ArrayMeta(max(0, r1 - r0), max(0, c1 - c0), metas[0].dtype)

    def compute(self, inputs):
        r0, r1, c0, c1 = self._clipped(inputs[0].meta)
        df = inputs[0].df.filter((F.col("i") >= r0) & (F.col("i") < r1) & (F.col("j") >= c0) & (F.col("j") < c1))
        return CellArray(df.select((F.col("i") - r0).alias("i"), (F.col("j") - c0).alias("j"), "v"), self.shape([inputs[0].meta]))

    def lineage(self, k, inputs, output):
        return Affine(output.meta, inputs[0].meta, dr=self.box[0][0], dc=self.box[1][0])


class Transpose(ArrayOp):
    def shape(self, metas):
        return ArrayMeta(metas[0].ncols, metas[0].nrows, metas[0].dtype)

    def compute(self, inputs):
        return CellArray(inputs[0].df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), self.shape([inputs[0].meta]))

    def lineage(self, k, inputs, output):
        return Affine(output.meta, inputs[0].meta, swap=True)


class Dummy(ArrayOp):
    """A stand-in for tests: passes its input on and captures nothing."""

    modes = ("NOOP",)

    def compute(self, inputs):
        return inputs[0]

    def lineage(self, k, inputs, output):
        return Union(identity(output.meta))
