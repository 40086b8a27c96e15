"""Column functions for cells, boxes and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_cell(i: Column, j: Column, ncols: int) -> Column:
    """Row-major number of a cell, 64 bits."""
    return i.cast("long") * ncols + j


def decode_cell(cell: Column, ncols: int) -> tuple[Column, Column]:
    j = F.pmod(cell, F.lit(ncols).cast("long"))
    return ((cell - j) / ncols).cast("long"), j


def encode_point(coords: list[Column], shape: list[int]) -> Column:
    """Row-major number of a point of any number of dimensions."""
    out = coords[0].cast("long")
    for c, n in zip(coords[1:], shape[1:]):
        out = out * n + c
    return out


def decode_point(code: Column, shape: list[int]) -> list[Column]:
    out = []
    for n in reversed(shape[1:]):
        out.append(F.pmod(code, F.lit(n).cast("long")))
        code = ((code - out[-1]) / n).cast("long")
    return [code, *reversed(out)]


def bounding_box(i: Column, j: Column) -> Column:
    """Aggregate: the inclusive box of cells, (-1, -1, -1, -1) of none."""
    low = lambda c: F.coalesce(F.min(c), F.lit(-1).cast("long"))
    high = lambda c: F.coalesce(F.max(c), F.lit(-1).cast("long"))
    return F.struct(low(i).alias("lo_i"), low(j).alias("lo_j"), high(i).alias("hi_i"), high(j).alias("hi_j"))


def in_box(i: Column, j: Column, box: Column) -> Column:
    return i.between(box["lo_i"], box["hi_i"]) & j.between(box["lo_j"], box["hi_j"])


def box_cells(box: Column, ncols: int) -> Column:
    """All cell numbers of a box, as an array; an empty box has none."""
    rows = F.flatten(F.transform(F.sequence(box["lo_i"], box["hi_i"]), lambda r: F.transform(F.sequence(box["lo_j"], box["hi_j"]), lambda c: r * ncols + c)))
    return F.when(box["lo_i"] < 0, F.array().cast("array<bigint>")).otherwise(rows)


def box_of(cells: Column, ncols: int) -> Column:
    """Inclusive box of an array of cell numbers."""
    i = F.transform(cells, lambda c: F.floor(c / ncols))
    j = F.transform(cells, lambda c: F.pmod(c, F.lit(ncols).cast("long")))
    least = lambda a, f: F.coalesce(f(a), F.lit(-1)).cast("long")
    return F.struct(least(i, F.array_min).alias("lo_i"), least(j, F.array_min).alias("lo_j"), least(i, F.array_max).alias("hi_i"), least(j, F.array_max).alias("hi_j"))


def grid_encode(cells: Column, ncols: int) -> Column:
    """A cell set as its box and the box's cells that aren't in it."""
    box = box_of(cells, ncols)
    return F.struct(box.alias("box"), F.array_except(box_cells(box, ncols), cells).alias("absent"))


def grid_decode(grid: Column, ncols: int) -> Column:
    return F.array_except(box_cells(grid["box"], ncols), grid["absent"])


def sigmoid(v: Column) -> Column:
    return 1 / (1 + F.exp(-v))
