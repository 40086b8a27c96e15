"""Stored lineage: encodings of edges, and stores that answer queries from them.

An edge table (oi, oj, ii, ij) is kept in one of several encodings. Cell sets
are arrays of 64-bit row-major cell numbers, so neither large arrays nor long
lists overflow. Equi-joins take the place of hash files; regions are found by
their exploded cells, or by tiles for boxes, never by comparing all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..array import ArrayMeta
from ..functions import box_of, decode_cell, encode_cell, grid_decode, grid_encode, in_box
from ..plans.strategy import Desc, Mode, Spec, Strategy
from ..storage import bytes_of, written
from .expr import Lineage, Table, Union

#: Side of the squares by which boxes are found.
BOX_TILE = 64


def regions_of(edges: DataFrame, out: ArrayMeta, inp: ArrayMeta) -> DataFrame:
    """(outs, ins): output cells with the same inputs become one region; both sorted arrays of cell numbers."""
    num = edges.select(encode_cell(F.col("oi"), F.col("oj"), out.ncols).alias("o"), encode_cell(F.col("ii"), F.col("ij"), inp.ncols).alias("n")).distinct()
    per = num.groupBy("o").agg(F.sort_array(F.collect_list("n")).alias("ins"))
    return per.groupBy("ins").agg(F.sort_array(F.collect_list("o")).alias("outs")).select("outs", "ins")


def edges_of(pairs: DataFrame, out: ArrayMeta, inp: ArrayMeta) -> DataFrame:
    """Edges of (outs, ins) arrays."""
    flat = pairs.select(F.explode("outs").alias("o"), "ins").select("o", F.explode("ins").alias("n"))
    (oi, oj), (ii, ij) = decode_cell(F.col("o"), out.ncols), decode_cell(F.col("n"), inp.ncols)
    return flat.select(oi.alias("oi"), oj.alias("oj"), ii.alias("ii"), ij.alias("ij"))


def merged(pairs: DataFrame) -> DataFrame:
    """Region pairs with equal outputs become one, their inputs united as a set."""
    return pairs.groupBy("outs").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ins")))).alias("ins"))


def encode_set(cells, spec: Spec, ncols: int):
    """Column that holds a cell set in an encoding (for KEY see ``Store``)."""
    if spec is Spec.BOX:
        return box_of(cells, ncols)
    if spec is Spec.GRID:
        return grid_encode(cells, ncols)
    return cells


def decode_set(col, spec: Spec, ncols: int):
    if spec is Spec.GRID:
        return grid_decode(col, ncols)
    return col


def _inside(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """(i, j, box) for cells (i, j) that lie in a box: equal tiles first, then the comparison."""
    span = lambda a: F.sequence(F.floor(F.col(f"box.lo_{a}") / BOX_TILE), F.floor(F.col(f"box.hi_{a}") / BOX_TILE))
    tiles = boxes.select("box", F.explode(span("i")).alias("ti")).select("box", "ti", F.explode(span("j")).alias("tj"))
    points = cells.select("i", "j", F.floor(F.col("i") / BOX_TILE).alias("ti"), F.floor(F.col("j") / BOX_TILE).alias("tj"))
    return points.join(tiles, ["ti", "tj"]).filter(in_box(F.col("i"), F.col("j"), F.col("box"))).select("i", "j", "box")


class Store(Lineage):
    """One capture (``Desc``) of one argument's lineage, written as Parquet.

    Backward layouts keep ``out`` as the key side and ``inp`` as the value
    side, forward ones the reverse. A query in the layout's direction joins on
    key cells; against it, the store is scanned and semi-joined.
    """

    def __init__(self, desc: Desc, out: ArrayMeta, inp: ArrayMeta, edges: DataFrame, exact: Lineage | None = None):
        self.desc, self.out, self.inp, self.exact = desc, out, inp, exact
        self.kmeta, self.vmeta = (out, inp) if desc.backward else (inp, out)
        turned = edges if desc.backward else edges.select(F.col("ii").alias("oi"), F.col("ij").alias("oj"), F.col("oi").alias("ii"), F.col("oj").alias("ij"))
        pairs = regions_of(turned, self.kmeta, self.vmeta)
        if desc.out is Spec.ONE:
            pairs = pairs.select(F.explode("outs").alias("key"), "ins")
        else:
            pairs = pairs.select(encode_set(F.col("outs"), desc.out, self.kmeta.ncols).alias("key"), "ins")
        self.dictionary = None
        if desc.inp is Spec.KEY:
            # Equal value sets are kept once, under a 64-bit key; what nothing refers to is never written.
            keyed = written(pairs.select("key", F.xxhash64("ins").alias("ref"), "ins"), "lineage-keyed")
            self.dictionary = written(keyed.select("ref", "ins").dropDuplicates(["ref"]), "lineage-dictionary")
            self.table = written(keyed.select("key", "ref"), "lineage")
        else:
            self.table = written(pairs.select("key", encode_set(F.col("ins"), desc.inp, self.vmeta.ncols).alias("value")), "lineage")

    def size(self) -> int:
        """Bytes of the written tables."""
        return sum(bytes_of(t) for t in (self.table, self.dictionary) if t is not None)

    def _values(self, rows: DataFrame) -> DataFrame:
        """(key, ins) with the value side as an array of cells."""
        if self.dictionary is not None:
            return rows.join(self.dictionary, "ref").select("key", "ins")
        return rows.select("key", decode_set(F.col("value"), self.desc.inp, self.vmeta.ncols).alias("ins"))

    def _numbers(self, cells: DataFrame, meta: ArrayMeta) -> DataFrame:
        return cells.select(encode_cell(F.col("i"), F.col("j"), meta.ncols).alias("q")).distinct()

    def _cells(self, numbers: DataFrame, meta: ArrayMeta) -> DataFrame:
        i, j = decode_cell(F.col("n"), meta.ncols)
        return numbers.select(i.alias("i"), j.alias("j"))

    def _matched(self, q: DataFrame) -> DataFrame:
        """Entries whose key set holds a query cell."""
        if self.desc.out is Spec.ONE:
            return self.table.join(q.withColumnRenamed("q", "key"), "key", "left_semi")
        if self.desc.out is Spec.BOX:
            return self._in_boxes(q, "key", self.kmeta)
        keys = decode_set(F.col("key"), self.desc.out, self.kmeta.ncols)
        hit = self.table.select("key", F.explode(keys).alias("q")).join(q, "q", "left_semi").select("key").distinct()
        return self.table.join(hit, "key", "left_semi")

    def _along(self, cells: DataFrame) -> DataFrame:
        """Value cells of key cells."""
        rows = self._matched(self._numbers(cells, self.kmeta))
        return self._cells(self._values(rows).select(F.explode("ins").alias("n")).distinct(), self.vmeta)

    def _in_boxes(self, q: DataFrame, side: str, meta: ArrayMeta) -> DataFrame:
        """Entries whose box on a side holds a query cell."""
        i, j = decode_cell(F.col("q"), meta.ncols)
        hit = _inside(q.select(i.alias("i"), j.alias("j")), self.table.select(F.col(side).alias("box")).distinct())
        return self.table.join(hit.select(F.col("box").alias(side)).distinct(), side, "left_semi")

    def _against(self, cells: DataFrame) -> DataFrame:
        """Key cells of value cells: one scan of the store."""
        q = self._numbers(cells, self.vmeta)
        rows = self._values(self.table)
        hit = rows.select("key", F.explode("ins").alias("q")).join(q, "q", "left_semi").select("key").distinct()
        keys = F.array("key") if self.desc.out is Spec.ONE else decode_set(F.col("key"), self.desc.out, self.kmeta.ncols)
        return self._cells(hit.select(F.explode(keys).alias("n")).distinct(), self.kmeta)

    def _boxed(self, cells: DataFrame, back: bool) -> DataFrame:
        """The exact relation run again, held to what the stored boxes of matched entries admit."""
        if back:
            rows, found, side, spec, meta = self._matched(self._numbers(cells, self.kmeta)), self.exact.backward(cells), "value", self.desc.inp, self.vmeta
        else:
            q = self._numbers(cells, self.vmeta)
            if self.desc.inp is Spec.BOX:
                rows = self._in_boxes(q, "value", self.vmeta)
            else:
                hit = self._values(self.table).select("key", F.explode("ins").alias("q")).join(q, "q", "left_semi").select("key").distinct()
                rows = self.table.join(hit, "key", "left_semi")
            found, side, spec, meta = self.exact.forward(cells), "key", self.desc.out, self.kmeta
        if spec is Spec.BOX:
            return _inside(found.distinct(), rows.select(F.col(side).alias("box")).distinct()).select("i", "j").distinct()
        if side == "value":
            sets = self._values(rows).select("ins")
        else:
            sets = rows.select((F.array("key") if spec is Spec.ONE else decode_set(F.col("key"), spec, meta.ncols)).alias("ins"))
        return found.distinct().join(self._cells(sets.select(F.explode("ins").alias("n")).distinct(), meta), ["i", "j"], "left_semi")

    def backward(self, cells):
        if Spec.BOX in (self.desc.out, self.desc.inp) and self.exact is not None:
            return self._boxed(cells, True)
        return self._along(cells) if self.desc.backward else self._against(cells)

    def forward(self, cells):
        if Spec.BOX in (self.desc.out, self.desc.inp) and self.exact is not None:
            return self._boxed(cells, False)
        return self._against(cells) if self.desc.backward else self._along(cells)

    def bounds(self, cells: DataFrame) -> DataFrame:
        """Union bounding box of the matched entries' value boxes, one row: what a boxed re-execution reads of its input."""
        rows = self._matched(self._numbers(cells, self.kmeta))
        return rows.agg(F.min("value.lo_i").alias("lo_i"), F.min("value.lo_j").alias("lo_j"), F.max("value.hi_i").alias("hi_i"), F.max("value.hi_j").alias("hi_j"))

    def edges(self, spark):
        rows = self._values(self.table)
        outs = F.array("key") if self.desc.out is Spec.ONE else decode_set(F.col("key"), self.desc.out, self.kmeta.ncols)
        e = edges_of(rows.select(outs.alias("outs"), "ins"), self.kmeta, self.vmeta)
        return e if self.desc.backward else e.select(F.col("ii").alias("oi"), F.col("ij").alias("oj"), F.col("oi").alias("ii"), F.col("oj").alias("ij"))


class PayloadStore(Lineage):
    """Regions kept as (oi, oj, payload); inputs are worked out by the operator when asked."""

    def __init__(self, op, k: int, metas, out: ArrayMeta, payload: DataFrame):
        self.op, self.k, self.metas, self.out, self.inp = op, k, metas, out, metas[k]
        self.table = written(payload.select("oi", "oj", "payload"), "lineage-payload")

    def backward(self, cells):
        q = cells.select(F.col("i").alias("oi"), F.col("j").alias("oj"))
        hit = self.table.join(q, ["oi", "oj"], "left_semi")
        return self.op.expand(hit, self.k, self.metas).select(F.col("ii").alias("i"), F.col("ij").alias("j"))

    def forward(self, cells):
        return Table(self.out, self.inp, self.edges(None)).forward(cells)

    def edges(self, spark):
        return self.op.expand(self.table, self.k, self.metas)


class Both(Lineage):
    """A backward and a forward layout of one relation."""

    def __init__(self, back: Lineage, fwd: Lineage):
        self.back, self.fwd, self.out, self.inp = back, fwd, back.out, back.inp

    def backward(self, cells):
        return self.back.backward(cells)

    def forward(self, cells):
        return self.fwd.forward(cells)

    def edges(self, spark):
        return self.back.edges(spark)


def capture(strategy: Strategy, op, k: int, inputs, output) -> Lineage | None:
    """The lineage of argument ``k`` as the strategy keeps it; None for strategies that keep nothing."""
    exact = op.lineage(k, inputs, output)
    spark = output.df.sparkSession

    def one(d: Desc) -> Lineage | None:
        if d.mode in (Mode.NOOP, Mode.STAT):
            return None
        if d.mode in (Mode.QUERY, Mode.FULL_MAPFUNC, Mode.FULL_MAPFUNC_BOX):
            return exact.parts[0] if d.mode == Mode.FULL_MAPFUNC and isinstance(exact, Union) else exact
        if d.mode in (Mode.PT_MAPFUNC, Mode.PT_MAPFUNC_BOX) and hasattr(op, "payload"):
            return PayloadStore(op, k, [a.meta for a in inputs], output.meta, op.payload(inputs, output))
        return Store(d, output.meta, exact.inp, exact.edges(spark), exact)

    layouts = []
    for bucket in strategy.buckets:
        parts = [x for x in map(one, bucket) if x is not None]
        if parts:
            layouts.append(parts[0] if len(parts) == 1 else Union(*parts))
    if not layouts:
        return None
    if len(layouts) == 1:
        return layouts[0]
    back = next((x for x, b in zip(layouts, strategy.buckets) if b[0].backward), layouts[0])
    fwd = next((x for x, b in zip(layouts, strategy.buckets) if not b[0].backward), layouts[-1])
    return Both(back, fwd)


def measure(op, k: int, inputs, output) -> DataFrame:
    """One row of statistics: (fanin, area, density, nptrs, oclustsize, noutcells), exact over all regions."""
    exact = op.lineage(k, inputs, output)
    regions = regions_of(exact.edges(output.df.sparkSession), output.meta, exact.inp)
    box = box_of(F.col("ins"), exact.inp.ncols)
    r = regions.select(F.size("outs").alias("o"), F.size("ins").alias("f"), box.alias("b"))
    area = (F.col("b.hi_i") - F.col("b.lo_i") + 1) * (F.col("b.hi_j") - F.col("b.lo_j") + 1)
    return r.agg(
        F.avg("f").alias("fanin"), F.avg(area).alias("area"), F.avg(F.col("f") / area).alias("density"),
        F.sum(F.col("o") * F.col("f")).alias("nptrs"), F.avg("o").alias("oclustsize"), F.sum("o").alias("noutcells"),
    )
