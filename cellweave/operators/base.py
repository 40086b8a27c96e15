"""What an operator is: a computation and one lineage relation for each argument."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..array import ArrayMeta, CellArray
from ..lineage.expr import Lineage


class ArrayOp:
    """Subclass with ``compute`` and ``lineage``; ``payload`` where lineage is stored as regions with a payload.

    ``modes``: the capture modes that an operator supports, by name: MAP (a
    relation that needs no data), PTMAP (regions with a payload), PTR
    (explicit pairs).
    """

    n_args = 1
    modes: tuple[str, ...] = ("MAP", "PTR")

    @property
    def name(self) -> str:
        return type(self).__name__

    def shape(self, metas: Sequence[ArrayMeta]) -> ArrayMeta:
        return metas[0]

    def compute(self, inputs: Sequence[CellArray]) -> CellArray:
        raise NotImplementedError

    def lineage(self, k: int, inputs: Sequence[CellArray], output: CellArray) -> Lineage:
        """Relation between the output and argument ``k``."""
        raise NotImplementedError

    def regions(self, k: int, inputs: Sequence[CellArray], output: CellArray) -> DataFrame:
        """The relation as explicit edges (oi, oj, ii, ij): what PTR strategies store."""
        return self.lineage(k, inputs, output).edges(output.df.sparkSession)


def same_shape(a: ArrayMeta, b: ArrayMeta) -> None:
    if (a.nrows, a.ncols) != (b.nrows, b.ncols):
        raise ValueError(f"shapes differ: {a.nrows}x{a.ncols} and {b.nrows}x{b.ncols}")
