"""An extension: trace segmentation over a stream.

Sessions close when the watermark passes their last point by the gap; late
points are dropped by the watermark. State is a session's bounds and sums, not
its points, so it grows with open sessions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_segments(points: DataFrame, gap: str = "2 minutes", late: str = "10 minutes", id_col: str = "id", time_col: str = "time", value_col: str = "value") -> DataFrame:
    """(id, start, end, n, total, mean) of each session of more than one point; append mode."""
    w = F.session_window(time_col, gap)
    g = points.withWatermark(time_col, late).groupBy(w.alias("w"), F.col(id_col))
    out = g.agg(F.count(F.lit(1)).alias("n"), F.sum(value_col).alias("total"), F.avg(value_col).alias("mean"))
    return out.filter("n > 1").select(id_col, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total", "mean")
