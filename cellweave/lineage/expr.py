"""Lineage of one operator argument as an algebra of relations between output and input cells.

Each relation is stated once; backward and forward are derived from the same
statement, so they are always converses. Queries are DataFrames of distinct
cells (i, j). Relations that are pure arithmetic become projections, which
Catalyst merges across hops; only stored tables need joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..array import ArrayMeta, domain


class Lineage:
    """out, inp: the shapes of the two sides."""

    out: ArrayMeta
    inp: ArrayMeta
    #: Whether a hop can make duplicates, in each direction; where it can't, no distinct is needed.
    expands_back = expands_fwd = True

    def backward(self, cells: DataFrame) -> DataFrame:
        """Input cells of these output cells; may repeat."""
        raise NotImplementedError

    def forward(self, cells: DataFrame) -> DataFrame:
        raise NotImplementedError

    def full_back(self) -> bool:
        """Whether all output cells together come from every input cell, by the relation itself."""
        return False

    def full_fwd(self) -> bool:
        return False

    def edges(self, spark) -> DataFrame:
        """The whole relation (oi, oj, ii, ij)."""
        raise NotImplementedError


def _inside(df: DataFrame, meta: ArrayMeta) -> DataFrame:
    return df.filter((F.col("i") >= 0) & (F.col("i") < meta.nrows) & (F.col("j") >= 0) & (F.col("j") < meta.ncols))


def _as_out(spark, meta: ArrayMeta) -> DataFrame:
    return domain(spark, meta).select(F.col("i").alias("oi"), F.col("j").alias("oj"))


@dataclass(frozen=True)
class Affine(Lineage):
    """in = out + (dr, dc), with rows and columns exchanged if ``swap``; one cell on each side."""

    out: ArrayMeta
    inp: ArrayMeta
    swap: bool = False
    dr: int = 0
    dc: int = 0
    expands_back = expands_fwd = False

    def _in(self, i, j):
        i, j = (j, i) if self.swap else (i, j)
        return i + self.dr, j + self.dc

    def backward(self, cells):
        i, j = self._in(F.col("i"), F.col("j"))
        return _inside(cells.select(i.alias("i"), j.alias("j")), self.inp)

    def forward(self, cells):
        i, j = F.col("i") - self.dr, F.col("j") - self.dc
        i, j = (j, i) if self.swap else (i, j)
        return _inside(cells.select(i.alias("i"), j.alias("j")), self.out)

    def full_back(self):
        return self.out.size == self.inp.size

    full_fwd = full_back

    def edges(self, spark):
        i, j = self._in(F.col("oi"), F.col("oj"))
        return _as_out(spark, self.out).select("oi", "oj", i.alias("ii"), j.alias("ij"))


def identity(meta: ArrayMeta) -> Affine:
    return Affine(meta, meta)


@dataclass(frozen=True)
class Window(Lineage):
    """in = out + offset for every offset of a box, clipped to the input."""

    out: ArrayMeta
    inp: ArrayMeta
    rows: tuple[int, int]
    cols: tuple[int, int]

    def _spread(self, cells, rows, cols, meta):
        box = lambda c, lo, hi, n: F.sequence(F.greatest(F.col(c) + lo, F.lit(0)), F.least(F.col(c) + hi, F.lit(n - 1)))
        near = (F.col("i") + rows[1] >= 0) & (F.col("i") + rows[0] < meta.nrows) & (F.col("j") + cols[1] >= 0) & (F.col("j") + cols[0] < meta.ncols)
        return cells.filter(near).select(F.explode(box("i", *rows, meta.nrows)).alias("i"), box("j", *cols, meta.ncols).alias("js")).select("i", F.explode("js").alias("j"))

    def backward(self, cells):
        return self._spread(cells.select("i", "j"), self.rows, self.cols, self.inp)

    def forward(self, cells):
        return self._spread(cells.select("i", "j"), (-self.rows[1], -self.rows[0]), (-self.cols[1], -self.cols[0]), self.out)

    def full_back(self):
        return self.out == self.inp and self.rows[0] <= 0 <= self.rows[1] and self.cols[0] <= 0 <= self.cols[1]

    full_fwd = full_back

    def edges(self, spark):
        both = domain(spark, self.out).withColumns({"oi": F.col("i"), "oj": F.col("j")})
        r = both.withColumn("i", F.explode(F.sequence(F.col("oi") + self.rows[0], F.col("oi") + self.rows[1])))
        r = r.withColumn("j", F.explode(F.sequence(F.col("oj") + self.cols[0], F.col("oj") + self.cols[1])))
        return _inside(r, self.inp).select("oi", "oj", F.col("i").alias("ii"), F.col("j").alias("ij"))


@dataclass(frozen=True)
class All(Lineage):
    """Every output cell comes from every input cell; scalars and global aggregates."""

    out: ArrayMeta
    inp: ArrayMeta

    def _any(self, cells, meta):
        # One row if there is any query cell at all, then the whole range.
        return cells.limit(1).select(F.lit(1).alias("_one")).join(F.broadcast(domain(cells.sparkSession, meta)) if meta.size <= 10_000 else domain(cells.sparkSession, meta), how="cross").select("i", "j")

    def backward(self, cells):
        return self._any(cells, self.inp)

    def forward(self, cells):
        return self._any(cells, self.out)

    def full_back(self):
        return True

    full_fwd = full_back
    expands_back = expands_fwd = False  # one row times a range has no duplicates

    def edges(self, spark):
        return _as_out(spark, self.out).join(domain(spark, self.inp).select(F.col("i").alias("ii"), F.col("j").alias("ij")), how="cross")


@dataclass(frozen=True)
class Match(Lineage):
    """Output and input cells that agree in one coordinate each; ``at`` fixes input coordinates, the others are free."""

    out: ArrayMeta
    inp: ArrayMeta
    out_key: str
    in_key: str
    at: tuple = ()

    def _free(self, df, key, value, meta, fixed):
        n = {"i": meta.nrows, "j": meta.ncols}
        cols = {}
        for c in "ij":
            if c == key:
                cols[c] = value
            elif c in fixed:
                cols[c] = F.lit(fixed[c]).cast("long")
            else:
                cols[c] = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n[c] - 1).cast("long")))
        return _inside(df.select(*[x.alias(c) for c, x in cols.items()]), meta)

    def backward(self, cells):
        return self._free(cells.select(F.col(self.out_key).alias("k")).distinct(), self.in_key, F.col("k"), self.inp, dict(self.at))

    def forward(self, cells):
        for c, v in self.at:
            cells = cells.filter(F.col(c) == v)
        return self._free(cells.select(F.col(self.in_key).alias("k")).distinct(), self.out_key, F.col("k"), self.out, {})

    expands_back = expands_fwd = False  # keys are distinct, and cells of different keys differ

    def full_back(self):
        size = lambda m, k: m.nrows if k == "i" else m.ncols
        return not self.at and size(self.out, self.out_key) == size(self.inp, self.in_key)

    def full_fwd(self):
        size = lambda m, k: m.nrows if k == "i" else m.ncols
        return size(self.out, self.out_key) == size(self.inp, self.in_key)

    def edges(self, spark):
        outs = _as_out(spark, self.out).withColumn("k", F.col("oi" if self.out_key == "i" else "oj"))
        inner = domain(spark, self.inp)
        for c, v in self.at:
            inner = inner.filter(F.col(c) == v)
        return outs.join(inner.select(F.col(self.in_key).alias("k"), F.col("i").alias("ii"), F.col("j").alias("ij")), "k").select("oi", "oj", "ii", "ij")


class Table(Lineage):
    """Explicit edges (oi, oj, ii, ij): equi-joins on cell coordinates."""

    def __init__(self, out: ArrayMeta, inp: ArrayMeta, edges: DataFrame):
        self.out, self.inp, self._edges = out, inp, edges.select("oi", "oj", "ii", "ij")

    def backward(self, cells):
        q = cells.select(F.col("i").alias("oi"), F.col("j").alias("oj"))
        return self._edges.join(q, ["oi", "oj"], "left_semi").select(F.col("ii").alias("i"), F.col("ij").alias("j"))

    def forward(self, cells):
        q = cells.select(F.col("i").alias("ii"), F.col("j").alias("ij"))
        return self._edges.join(q, ["ii", "ij"], "left_semi").select(F.col("oi").alias("i"), F.col("oj").alias("j"))

    def edges(self, spark):
        return self._edges


class Union(Lineage):
    """A default relation and stored exceptions: the answer is the union of both."""

    def __init__(self, *parts: Lineage):
        self.parts, self.out, self.inp = parts, parts[0].out, parts[0].inp

    def _all(self, frames):
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def backward(self, cells):
        return self._all([p.backward(cells) for p in self.parts])

    def forward(self, cells):
        return self._all([p.forward(cells) for p in self.parts])

    def full_back(self):
        return any(p.full_back() for p in self.parts)

    def full_fwd(self):
        return any(p.full_fwd() for p in self.parts)

    def edges(self, spark):
        return self._all([p.edges(spark) for p in self.parts]).distinct()


class Restrict(Lineage):
    """A relation that holds only for some output cells, those of ``outs`` (i, j)."""

    def __init__(self, base: Lineage, outs: DataFrame):
        self.base, self.outs, self.out, self.inp = base, outs.select("i", "j"), base.out, base.inp

    def backward(self, cells):
        return self.base.backward(cells.select("i", "j").join(self.outs, ["i", "j"], "left_semi"))

    def forward(self, cells):
        return self.base.forward(cells).join(self.outs, ["i", "j"], "left_semi")

    def edges(self, spark):
        keep = self.outs.select(F.col("i").alias("oi"), F.col("j").alias("oj"))
        return self.base.edges(spark).join(keep, ["oi", "oj"], "left_semi")
