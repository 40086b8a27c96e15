"""Trace segmentation and per-segment aggregates.

Points are rows (id, ts, lat, lon). A segment ends at a gap of more than
``gap`` seconds or a change of id; points whose time doesn't pass every earlier
one of their id are dropped. All ids are flushed, the last one too, and the
rule that a segment has more than one point and lasts longer than ``least``
seconds holds for every segment unless ``last_only`` is set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def segments(points: DataFrame, gap: float = 120, least: float = 30, last_only: bool = False, id_col: str = "id", ts_col: str = "ts") -> DataFrame:
    """``points`` in segments: adds seg (number within the id, from 0) and pt (position within the segment)."""
    order = Window.partitionBy(id_col).orderBy(ts_col)
    # Of equal times the first counts; sorted by time, that is the only way a time can fail to pass the others.
    one = points.withColumn("_r", F.row_number().over(Window.partitionBy(id_col, ts_col).orderBy(*[c for c in points.columns if c not in (id_col, ts_col)]))).filter("_r = 1").drop("_r")
    cut = one.withColumn("_gap", F.coalesce(F.col(ts_col) - F.lag(ts_col).over(order) > gap, F.lit(False)).cast("int"))
    cut = cut.withColumn("seg", F.sum("_gap").over(order).cast("long")).drop("_gap")
    within = Window.partitionBy(id_col, "seg")
    cut = cut.withColumn("pt", (F.row_number().over(within.orderBy(ts_col)) - 1).cast("long"))
    cut = cut.withColumn("_n", F.count(F.lit(1)).over(within)).withColumn("_span", F.max(ts_col).over(within) - F.min(ts_col).over(within))
    fine = (F.col("_n") > 1) & (F.col("_span") > least)
    if last_only:
        fine = fine | (F.col("seg") < F.max("seg").over(Window.partitionBy(id_col)))
    return cut.withColumn("_fine", fine).filter("_fine").drop("_n", "_span", "_fine")


def chunks(points: DataFrame, order_by: list[str], size: int = 5, id_col: str = "id") -> DataFrame:
    """Fixed segments of ``size`` points of each id, in order; adds seg and pt."""
    at = F.row_number().over(Window.partitionBy(id_col).orderBy(*order_by)) - 1
    return points.withColumn("_at", at).withColumn("seg", F.expr(f"_at div {size}")).withColumn("pt", (F.col("_at") % size).cast("long")).drop("_at")


def per_segment(segmented: DataFrame, value: Column, how: str = "sum", id_col: str = "id") -> DataFrame:
    """(id, seg, v): sum or mean of a value of each segment."""
    agg = {"sum": F.sum, "avg": F.avg}[how]
    return segmented.groupBy(id_col, "seg").agg(agg(value).alias("v"))


def sources_of(segmented: DataFrame, asked: DataFrame, id_col: str = "id") -> DataFrame:
    """Backward lineage of aggregates: the points of the asked segments (id, seg)."""
    return segmented.join(asked.select(id_col, "seg").distinct(), [id_col, "seg"], "left_semi")
