"""Two-dimensional arrays as DataFrames of cells (i, j, v), with their shape on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ArrayMeta:
    """Shape and value type; cells are 0-based, and every one has a row."""

    nrows: int
    ncols: int
    dtype: str = "double"

    @property
    def size(self) -> int:
        return self.nrows * self.ncols


def domain(spark: SparkSession, meta: ArrayMeta) -> DataFrame:
    """All cells (i, j) of a shape; a range, so nothing is read or sent."""
    return spark.range(meta.size).select((F.col("id") / meta.ncols).cast("long").alias("i") if meta.ncols == 1 else F.expr(f"id div {meta.ncols}").alias("i"), (F.col("id") % meta.ncols).alias("j"))


class CellArray:
    """``df`` has columns i, j (long) and v. A missing row isn't a zero: sources fill, operators keep arrays dense."""

    def __init__(self, df: DataFrame, meta: ArrayMeta):
        self.df, self.meta = df.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "v"), meta

    @classmethod
    def from_matrix(cls, spark: SparkSession, rows: Sequence, dtype: str = "double") -> CellArray:
        """A small literal array; a flat list becomes one row."""
        rows = rows if len(rows) and isinstance(rows[0], (list, tuple)) else [rows]
        kind = {"double": float, "string": str, "boolean": bool, "long": int}[dtype]
        cells = [(i, j, kind(v)) for i, row in enumerate(rows) for j, v in enumerate(row)]
        return cls(spark.createDataFrame(cells, f"i long, j long, v {dtype}"), ArrayMeta(len(rows), len(rows[0]), dtype))

    @classmethod
    def from_table(cls, df: DataFrame, i: Column, j: Column, v: Column, nrows: int, ncols: int, fill=0.0, dtype: str = "double") -> CellArray:
        """Aggregate a table into a dense array: cell (i, j) holds ``v`` (an aggregate), cells without rows ``fill``."""
        meta = ArrayMeta(nrows, ncols, dtype)
        got = df.groupBy(i.cast("long").alias("i"), j.cast("long").alias("j")).agg(v.cast(dtype).alias("v"))
        whole = domain(df.sparkSession, meta).join(got, ["i", "j"], "left")
        return cls(whole.select("i", "j", F.coalesce("v", F.lit(fill).cast(dtype)).alias("v")), meta)

    def with_values(self, v: Column, dtype: str | None = None) -> CellArray:
        return CellArray(self.df.select("i", "j", v.alias("v")), ArrayMeta(self.meta.nrows, self.meta.ncols, dtype or self.meta.dtype))

    def cells(self) -> DataFrame:
        return self.df.select("i", "j")

    def scalar(self) -> DataFrame:
        """The first cell as a one-row table (s): what operators with a scalar argument read."""
        return self.df.filter("i = 0 AND j = 0").select(F.col("v").alias("s"))

    def to_matrix(self) -> list[list]:
        """Nested lists on the driver, for small arrays."""
        out = [[None] * self.meta.ncols for _ in range(self.meta.nrows)]
        for r in self.df.collect():
            out[r["i"]][r["j"]] = r["v"]
        return out
