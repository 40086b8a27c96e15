"""Gene-expression operators: genes are rows, patients columns; the first ``n`` columns are group 1."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..array import ArrayMeta, CellArray
from ..lineage.expr import All, Match, identity
from .base import ArrayOp

#: Fixed values of the filter and the predictor: fold change, range, genes from each end.
FOLD, RANGE, ENDS = 5.0, 500.0, 25


def _groups(n: int):
    return F.col("j") < n, F.col("j") >= n


def row_scores(a: CellArray, n: int):
    """(i, mean, std, b, snr, t): one pass over each row's sums gives all of them.

    ``b`` is the mean of the two group means of z-scores; ``snr`` is
    (m1 - m2) / (s1 + s2) of z-scores; ``t`` divides by the pooled variance.
    """
    one, two = _groups(n)
    v = F.col("v").cast("double")
    g = a.df.groupBy("i").agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.avg(F.when(one, v)).alias("m1"), F.avg(F.when(two, v)).alias("m2"),
        F.stddev_pop(F.when(one, v)).alias("s1"), F.stddev_pop(F.when(two, v)).alias("s2"),
        F.sum(F.when(one, v * v)).alias("q1"), F.sum(F.when(two, v * v)).alias("q2"),
        F.count_if(one).alias("n1"), F.count_if(two).alias("n2"),
    )
    pooled = (F.col("q1") + F.col("q2") - F.col("n1") * F.col("m1") * F.col("m1") - F.col("n2") * F.col("m2") * F.col("m2")) / (F.col("n1") + F.col("n2") - 2)
    return g.select(
        "i", "mean", "std",
        F.when(F.col("std") == 0, 0.0).otherwise(F.try_divide((F.col("m1") + F.col("m2")) / 2 - F.col("mean"), F.col("std"))).alias("b"),
        F.try_divide(F.col("m1") - F.col("m2"), F.col("s1") + F.col("s2")).alias("snr"),
        F.try_divide(F.try_divide(F.col("m1") - F.col("m2"), pooled), F.sqrt(1 / F.col("n1") + 1 / F.col("n2"))).alias("t"),
    )


class _RowOp(ArrayOp):
    """One output row for each input row."""

    width = 1

    def shape(self, metas):
        return ArrayMeta(metas[0].nrows, self.width)

    def lineage(self, k, inputs, output):
        return Match(output.meta, inputs[0].meta, "i", "i") if k == 0 else All(output.meta, inputs[k].meta)


class GeneFilter(_RowOp):
    """True for genes to leave out: max/min of at most 5, or max - min of at most 500."""

    def shape(self, metas):
        return ArrayMeta(metas[0].nrows, 1, "boolean")

    def compute(self, inputs):
        g = inputs[0].df.groupBy("i").agg(F.max("v").alias("hi"), F.min("v").alias("lo"))
        drop = F.coalesce(F.try_divide("hi", "lo") <= FOLD, F.lit(False)) | (F.col("hi") - F.col("lo") <= RANGE)
        return CellArray(g.select("i", F.lit(0).alias("j"), drop.alias("v")), self.shape([inputs[0].meta]))


class _Scored(_RowOp):
    n_args = 2
    column = ""

    def compute(self, inputs):
        n = int(inputs[1].scalar().first()["s"])
        return CellArray(row_scores(inputs[0], n).select("i", F.lit(0).alias("j"), F.col(self.column).alias("v")), self.shape([inputs[0].meta]))


class Correlate(_Scored):
    """Signal to noise of the two groups; the second argument is the number of columns of group 1."""

    column = "snr"


class TTest(_Scored):
    column = "t"


class GenStats(_RowOp):
    """Mean, population deviation and b of each gene, as three columns."""

    n_args, width = 2, 3

    def compute(self, inputs):
        s = row_scores(inputs[0], int(inputs[1].scalar().first()["s"]))
        df = s.select("i", F.posexplode(F.array("mean", "std", "b")).alias("j", "v"))
        return CellArray(df, self.shape([inputs[0].meta]))


class NormalizeTest(ArrayOp):
    """(log10(v) - mean / std) - b for genes of a positive sum, other genes as they are; arg 1 holds GenStats."""

    n_args = 2

    def compute(self, inputs):
        a, stats = inputs
        s = stats.df.groupBy("i").agg(*[F.max(F.when(F.col("j") == k, F.col("v"))).alias(n) for k, n in enumerate(("mean", "std", "b"))])
        total = a.df.groupBy("i").agg(F.sum("v").alias("total"))
        both = a.df.join(s.join(total, "i"), "i")
        v = F.when(F.col("total") > 0, F.log10("v") - F.try_divide("mean", "std") - F.col("b")).otherwise(F.col("v"))
        return CellArray(both.select("i", "j", v.cast("double").alias("v")), ArrayMeta(a.meta.nrows, a.meta.ncols))

    def lineage(self, k, inputs, output):
        return Match(output.meta, inputs[k].meta, "i", "i")


class PredictorMask(ArrayOp):
    """Of the genes that aren't left out (arg 0), the 25 highest and 25 lowest scores (arg 1)."""

    n_args = 2

    def shape(self, metas):
        return ArrayMeta(metas[0].nrows, 1, "boolean")

    def compute(self, inputs):
        left_out, scores = inputs
        kept = scores.df.join(left_out.df.filter("not v").select("i"), "i", "left_semi")
        # Two bounded top-k selections, no global sort.
        top = kept.orderBy(F.desc("v"), "i").limit(ENDS).select("i").union(kept.orderBy(F.asc("v"), F.desc("i")).limit(ENDS).select("i")).distinct()
        out = left_out.df.select("i").join(F.broadcast(top.withColumn("hit", F.lit(True))), "i", "left")
        return CellArray(out.select("i", F.lit(0).alias("j"), F.coalesce("hit", F.lit(False)).alias("v")), self.shape([left_out.meta]))

    def lineage(self, k, inputs, output):
        return identity(output.meta)


class PredictVote(ArrayOp):
    """For each patient (column) the winner and the margin of weighted votes; args: data, scores, mask."""

    n_args = 3

    def shape(self, metas):
        return ArrayMeta(metas[0].ncols, 2)

    def compute(self, inputs):
        data, scores, mask = inputs
        used = scores.df.select("i", F.col("v").alias("w")).join(mask.df.filter("v").select("i"), "i", "left_semi")
        votes = data.df.join(used, "i").withColumn("x", F.col("v") * F.col("w"))
        g = votes.groupBy("j").agg(F.abs(F.coalesce(F.sum(F.when(F.col("x") > 0, F.col("x"))), F.lit(0.0))).alias("a"), F.abs(F.coalesce(F.sum(F.when(F.col("x") < 0, F.col("x"))), F.lit(0.0))).alias("b"))
        pair = F.array(F.when(F.col("a") > F.col("b"), 1.0).otherwise(0.0), F.try_divide(F.abs(F.col("a") - F.col("b")), F.col("a") + F.col("b")))
        return CellArray(g.select(F.col("j").alias("i"), F.posexplode(pair).alias("j", "v")), self.shape([data.meta]))

    def lineage(self, k, inputs, output):
        return Match(output.meta, inputs[0].meta, "i", "j") if k == 0 else All(output.meta, inputs[k].meta)


__all__ = ["Correlate", "GenStats", "GeneFilter", "NormalizeTest", "PredictVote", "PredictorMask", "TTest", "row_scores"]
