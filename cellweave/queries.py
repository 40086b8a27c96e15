"""Queries over the driver's tables for every operator, store and analysis, with their SQL.

The tables hold no arrays, so they are derived: a 32 x 32 grid of quantities
(``g``), a second one of prices (``h``), a labelled matrix of orders, genes
from embeddings, traces from events. Sums of whole numbers and means over 1024
cells are exact in any order; other doubles are rounded.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Rows
from pyspark.sql import functions as F

from .array import ArrayMeta, CellArray
from .functions import grid_decode, grid_encode
from .lineage.expr import Affine, Match, Table, Window, identity
from .lineage.store import Store, edges_of, measure, regions_of
from .operators import core, evidence, expression, stencil, trajectory
from .operators.cluster import Cluster
from .plans.optimizer import Predictor, optimize
from .plans.strategy import COMPOSITE, Desc, Mode, Spec, Strategy, candidates
from .sources import star_image
from .workflow import Workflow

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SIDE = 32

GRID = """g AS (SELECT CAST(d.i AS BIGINT) AS i, CAST(d.j AS BIGINT) AS j, coalesce(x.v, 0.0) AS v FROM (SELECT a.range AS i, b.range AS j FROM range(32) a, range(32) b) d
  LEFT JOIN (SELECT l_orderkey % 32 AS i, l_partkey % 32 AS j, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2) x ON d.i = x.i AND d.j = x.j)"""
GRID2 = """h AS (SELECT CAST(d.i AS BIGINT) AS i, CAST(d.j AS BIGINT) AS j, coalesce(x.v, 0.0) AS v FROM (SELECT a.range AS i, b.range AS j FROM range(32) a, range(32) b) d
  LEFT JOIN (SELECT l_orderkey % 32 AS i, l_suppkey % 32 AS j, CAST(sum(CAST(round(l_extendedprice) AS BIGINT)) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2) x ON d.i = x.i AND d.j = x.j)"""
GENES = "e AS (SELECT i, j, CAST(floor((y * y * y) * (y * y * y) * 1000) AS DOUBLE) AS v FROM (SELECT CAST(vec_id AS BIGINT) AS i, CAST(p AS BIGINT) - 1 AS j, CAST(embedding[p] AS DOUBLE) + 1 AS y FROM embeddings, range(1, 65) t(p)))"
LABELS = """o AS (SELECT o_orderkey AS i, CASE o_orderstatus WHEN 'F' THEN 'Y' WHEN 'O' THEN 'N' ELSE 'NA' END AS cls, o_orderpriority AS pri, c_mktsegment AS seg,
  CASE WHEN o_totalprice > 150000 THEN 'high' ELSE 'low' END AS price FROM orders JOIN customer ON o_custkey = c_custkey)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def grid(spark, sf) -> CellArray:
    return CellArray.from_table(table(spark, sf, "lineitem"), F.col("l_orderkey") % SIDE, F.col("l_partkey") % SIDE, F.sum("l_quantity"), SIDE, SIDE)


def grid2(spark, sf) -> CellArray:
    return CellArray.from_table(table(spark, sf, "lineitem"), F.col("l_orderkey") % SIDE, F.col("l_suppkey") % SIDE, F.sum(F.round("l_extendedprice").cast("long")), SIDE, SIDE)


def genes(spark, sf) -> CellArray:
    e = table(spark, sf, "embeddings")
    n = e.agg(F.max("vec_id")).first()[0] + 1
    df = e.select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "x")).select("i", "j", (F.col("x").cast("double") + 1).alias("y"))
    cube = F.col("y") * F.col("y") * F.col("y")
    df = df.select("i", "j", F.floor(cube * cube * 1000).cast("double").alias("v"))
    return CellArray(df, ArrayMeta(n, 64))


FTYPES = ["target.feature", "clinical", "genom", "pathway.dep.outcome"]


def labelled(spark, sf) -> tuple[CellArray, DataFrame]:
    """(matrix of class, priority, price, segment; segment as subclass)."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    cls = F.when(F.col("o_orderstatus") == "F", "Y").when(F.col("o_orderstatus") == "O", "N").otherwise("NA")
    price = F.when(F.col("o_totalprice") > 150000, "high").otherwise("low")
    rows = o.select(F.col("o_orderkey").alias("i"), cls.alias("cls"), F.col("o_orderpriority").alias("pri"), price.alias("price"), F.col("c_mktsegment").alias("seg"))
    md = rows.select("i", F.posexplode(F.array("cls", "pri", "price", "price")).alias("j", "v"))
    n = table(spark, sf, "orders").agg(F.max("o_orderkey")).first()[0] + 1
    return CellArray(md, ArrayMeta(n, 4, "string")), rows.select("i", F.col("seg").alias("s"))


def const(spark, rows, dtype="double") -> CellArray:
    return CellArray.from_matrix(spark, rows, dtype)


ONES = [[1, 1, 1], [1, 1, 1], [1, 1, 1]]
LAPLACIAN = [[0, -1, 0], [-1, 4, -1], [0, -1, 0]]


def cells_sql(body: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)} {body}"


# --- cell-wise, zip, slice, reduce ------------------------------------------------


def _unary(name, op, sql, dtype="double"):
    @query(name, cells_sql(f"SELECT i, j, {sql} AS v FROM g", GRID))
    def run(spark, sf):
        return op().compute([grid(spark, sf)]).df


_unary("map_clamp", lambda: core.Clean(100.0, 16000.0), "greatest(least(v, 16000.0), 100.0)")
_unary("map_clip", lambda: core.Clip(lambda v: v > 150), "CASE WHEN v > 150 THEN v ELSE 0.0 END")
_unary("map_log10", lambda: core.OneToOne(lambda v: F.round(F.log10(v + 1), 9)), "round(log10(v + 1), 9)")
_unary("map_sigmoid", lambda: core.OneToOne(lambda v: F.round(1 / (1 + F.exp(-(v - 150) / 100)), 9)), "round(1 / (1 + exp(-(v - 150) / 100)), 9)")
_unary("map_python", lambda: core.OneToOne(core.python_cell(lambda v: v * 2 + 1)), "v * 2 + 1")
_unary("classify", lambda: core.OneToOne(lambda v: F.when(v > 150, "Y").otherwise("N"), "string"), "CASE WHEN v > 150 THEN 'Y' ELSE 'N' END")


def _binary(name, op, sql):
    @query(name, cells_sql(f"SELECT g.i, g.j, CAST({sql} AS DOUBLE) AS v FROM g JOIN h ON g.i = h.i AND g.j = h.j", GRID, GRID2))
    def run(spark, sf):
        return op().compute([grid(spark, sf), grid2(spark, sf)]).df


_binary("zip_diff", core.Diff, "g.v - h.v")
_binary("zip_add", core.Add, "g.v + h.v")
_binary("zip_div", core.Div, "CASE WHEN h.v = 0 THEN NULL ELSE g.v / h.v END")
_binary("zip_merge", lambda: core.Merge(lambda a, b: F.greatest(a, b)), "greatest(g.v, h.v)")


@query("zip_and", cells_sql("SELECT g.i, g.j, CAST(CASE WHEN g.v > 150 AND h.v > 200000 THEN 1 ELSE 0 END AS DOUBLE) AS v FROM g JOIN h ON g.i = h.i AND g.j = h.j", GRID, GRID2))
def zip_and(spark, sf):
    a, b = grid(spark, sf).with_values(F.col("v") > 150, "boolean"), grid2(spark, sf).with_values(F.col("v") > 200000, "boolean")
    return core.LogicalAnd().compute([a, b]).df


@query("badpix", cells_sql("SELECT g.i, g.j, CASE WHEN h.v <= 200000 AND g.v <> 0 THEN g.v ELSE 90.0 END AS v FROM g JOIN h ON g.i = h.i AND g.j = h.j", GRID, GRID2))
def badpix(spark, sf):
    return core.BadPixRemoval().compute([grid(spark, sf), grid2(spark, sf).with_values(F.col("v") > 200000, "boolean")]).df


@query("mean_bcast", cells_sql("SELECT i, j, (SELECT avg(v) FROM g) AS v FROM g", GRID))
def mean_bcast(spark, sf):
    return core.Mean().compute([grid(spark, sf)]).df


@query("mean_single", cells_sql("SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS j, avg(v) AS v FROM g", GRID))
def mean_single(spark, sf):
    return core.MeanSingleVal().compute([grid(spark, sf)]).df


@query("scalar_diff", cells_sql("SELECT i, j, v - (SELECT avg(v) FROM g) AS v FROM g", GRID))
def scalar_diff(spark, sf):
    a = grid(spark, sf)
    return core.DiffSingleVal().compute([a, core.MeanSingleVal().compute([a])]).df


@query("slice", cells_sql("SELECT i - 4 AS i, j - 10 AS j, v FROM g WHERE i >= 4 AND i < 20 AND j >= 10 AND j < 30", GRID))
def slice_(spark, sf):
    return core.Subsample(((4, 20), (10, 30))).compute([grid(spark, sf)]).df


@query("transpose", cells_sql("SELECT j AS i, i AS j, v FROM g", GRID))
def transpose(spark, sf):
    return core.Transpose().compute([grid(spark, sf)]).df


@query("take_rows", cells_sql("SELECT CAST(n.k AS BIGINT) AS i, g.j, g.v FROM g JOIN (VALUES (0, 5), (1, 3), (2, 5)) n(k, src) ON g.i = n.src", GRID))
def take_rows(spark, sf):
    return core.take(grid(spark, sf), rows=[5, 3, 5]).df


# --- neighbourhoods -----------------------------------------------------------------


@query("upsample2", cells_sql("SELECT 2 * i + a.range AS i, 2 * j + b.range AS j, CAST(trunc(v) AS DOUBLE) AS v FROM g, range(2) a, range(2) b", GRID))
def upsample2(spark, sf):
    return stencil.upsample2(grid(spark, sf)).df


@query("rebin2", cells_sql("SELECT i // 2 AS i, j // 2 AS j, avg(v) AS v FROM g GROUP BY 1, 2", GRID))
def rebin2(spark, sf):
    return stencil.rebin(grid(spark, sf), 2).df


@query("convolve3", cells_sql("""SELECT a.i, a.j, sum(b.v * CASE WHEN a.i = b.i AND a.j = b.j THEN 4 WHEN abs(a.i - b.i) + abs(a.j - b.j) = 1 THEN -1 ELSE 0 END) AS v
  FROM g a JOIN g b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY 1, 2""", GRID))
def convolve3(spark, sf):
    return stencil.Convolve().compute([grid(spark, sf), const(spark, LAPLACIAN)]).df


@query("convolve7", cells_sql("SELECT a.i, a.j, sum(b.v) AS v FROM g a JOIN g b ON abs(a.i - b.i) <= 3 AND abs(a.j - b.j) <= 3 GROUP BY 1, 2", GRID))
def convolve7(spark, sf):
    return stencil.Convolve().compute([grid(spark, sf), const(spark, [[1] * 7] * 7)]).df


def _median(size: int):
    h = size // 2
    fold = lambda c: f"CASE WHEN a.{c} + d{c}.range - {h} < 0 THEN {h} - a.{c} - d{c}.range WHEN a.{c} + d{c}.range - {h} > 31 THEN 62 + {h} - a.{c} - d{c}.range ELSE a.{c} + d{c}.range - {h} END"

    @query(f"median{size}", cells_sql(f"""SELECT i, j, median(v) AS v FROM (SELECT a.i, a.j, b.v FROM g a, range({size}) di, range({size}) dj, g b WHERE b.i = {fold('i')} AND b.j = {fold('j')}) GROUP BY 1, 2""", GRID))
    def run(spark, sf):
        return stencil.median_filter(grid(spark, sf), size).df


_median(3)
_median(5)


@query("remove_cr", cells_sql("""SELECT a.i, a.j, CASE WHEN a.v > 180 THEN (SELECT median(b.v) FROM g b WHERE abs(a.i - b.i) <= 2 AND abs(a.j - b.j) <= 2 AND b.v <= 180) ELSE a.v END AS v FROM s a""",
  GRID, "s AS (SELECT * FROM g)").replace("180", "(SELECT quantile_disc(v, 0.9) FROM g)"))
def remove_cr(spark, sf):
    a = grid(spark, sf)
    cut = a.df.agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY v)")).first()[0]
    return stencil.RemoveCRs().compute([a, a.with_values(F.col("v") > cut, "boolean")]).df


@query("star_image")
def star(spark, sf):
    return star_image(spark, 128).df


CLUSTER = """m AS (SELECT avg(v) + 20 AS t FROM g), c AS (SELECT i, j, i * 32 + j AS n FROM g, m WHERE v > t),
  r AS (SELECT n, i, j, n AS low FROM c UNION SELECT b.n, b.i, b.j, r.low FROM r JOIN c b ON abs(b.i - r.i) <= 1 AND abs(b.j - r.j) <= 1)"""


def cluster_setup(spark, sf):
    a = grid(spark, sf)
    limit = core.OneToOne(lambda v: v + 20).compute([core.MeanSingleVal().compute([a])])
    op = Cluster()
    return op, [a, limit], op.compute([a, limit])


@query("cluster", f"WITH RECURSIVE {GRID}, {CLUSTER} SELECT g.i, g.j, CAST(coalesce(x.low + 1, 0) AS DOUBLE) AS v FROM g LEFT JOIN (SELECT i, j, min(low) AS low FROM r GROUP BY 1, 2) x ON g.i = x.i AND g.j = x.j")
def cluster(spark, sf):
    return cluster_setup(spark, sf)[2].df


# --- evidence ---------------------------------------------------------------------------


@query("contingency", cells_sql("SELECT p.pri, c.cls, CAST(count(o.i) AS BIGINT) AS n FROM (SELECT DISTINCT pri FROM o) p CROSS JOIN (SELECT DISTINCT cls FROM o WHERE cls <> 'NA') c LEFT JOIN o ON o.pri = p.pri AND o.cls = c.cls GROUP BY 1, 2", LABELS))
def contingency(spark, sf):
    md, _ = labelled(spark, sf)
    wide = md.df.groupBy("i").agg(F.max(F.when(F.col("j") == 1, F.col("v"))).alias("pri"), F.max(F.when(F.col("j") == 0, F.col("v"))).alias("cls"))
    return evidence.contingency(wide, ["pri", "cls"])


EVIDENCE = f"""{LABELS}, q AS (SELECT count(*) FILTER (cls = 'Y') AS y, count(*) FILTER (cls = 'N') AS n FROM o),
 f AS (SELECT 1 AS k, pri AS v, cls FROM o UNION ALL SELECT 2, price, cls FROM o),
 c1 AS (SELECT k, v, count(*) FILTER (cls = 'Y') + 2 AS y, count(*) FILTER (cls = 'N') + 2 AS n FROM f GROUP BY 1, 2),
 c2 AS (SELECT s.seg, p.price, count(o.i) FILTER (o.cls = 'Y') + 2 AS y, count(o.i) FILTER (o.cls = 'N') + 2 AS n
   FROM (SELECT DISTINCT seg FROM o) s CROSS JOIN (SELECT DISTINCT price FROM o) p LEFT JOIN o ON o.seg = s.seg AND o.price = p.price GROUP BY 1, 2),
 ev AS (SELECT 0 AS k, '' AS k1, '' AS k2, ln((y + 2.0) / (n + 2)) AS lo FROM q
   UNION ALL SELECT k, v, '', ln(y / CAST(n AS DOUBLE)) - ln(sum(y) OVER (PARTITION BY k) / CAST(sum(n) OVER (PARTITION BY k) AS DOUBLE)) FROM c1
   UNION ALL SELECT 3, seg, price, ln(y / CAST(n AS DOUBLE)) - ln(sum(y) OVER (PARTITION BY seg) / CAST(sum(n) OVER (PARTITION BY seg) AS DOUBLE)) FROM c2)"""


@query("evidence", f"WITH {EVIDENCE} SELECT CAST(row_number() OVER (ORDER BY k, k1, k2) - 1 AS BIGINT) AS idx, CAST(k AS BIGINT) AS k, k1, k2, round(lo, 9) AS logodds FROM ev")
def evidence_all(spark, sf):
    md, sub = labelled(spark, sf)
    return evidence.build_evidence(md, sub, FTYPES).withColumn("logodds", F.round("logodds", 9))


def _predicted(spark, sf):
    md, sub = labelled(spark, sf)
    return evidence.predict_logodds(evidence.build_evidence(md, sub, FTYPES), md, sub, FTYPES), md


PREDICTED = f"""{EVIDENCE}, p AS (SELECT o.i, k, round(coalesce(lo, 0), 9) AS lo, o.cls FROM o CROSS JOIN (SELECT DISTINCT k FROM ev) kk
  LEFT JOIN ev USING (k) WHERE (k = 0 AND o.cls <> 'NA') OR (k = 1 AND k1 = pri) OR (k = 2 AND k1 = price) OR (k = 3 AND k1 = seg AND k2 = price)
  UNION ALL SELECT i, 0, 0.0, cls FROM o WHERE cls = 'NA')"""


@query("predict_logodds", f"WITH {PREDICTED} SELECT i, CAST(k AS BIGINT) AS k, lo AS logodds FROM p")
def predict_logodds(spark, sf):
    return _predicted(spark, sf)[0].select("i", "k", F.round("logodds", 9).alias("logodds"))


@query("cum_odds", f"WITH {PREDICTED} SELECT CAST(0 AS BIGINT) AS i, i AS j, round(sum(lo), 6) AS v FROM p GROUP BY i".replace("SELECT CAST(0 AS BIGINT) AS i, i AS j", "SELECT CAST(0 AS BIGINT) AS i, p.i AS j").replace("GROUP BY i", "GROUP BY p.i"))
def cum_odds(spark, sf):
    p, md = _predicted(spark, sf)
    a = CellArray(p.select("i", F.col("k").alias("j"), F.round("logodds", 9).alias("v")), ArrayMeta(md.meta.nrows, 4))
    return evidence.CumOdds().compute([a]).with_values(F.round("v", 6)).df


@query("confusion", f"WITH {PREDICTED}, s AS (SELECT i, any_value(cls) AS cls, sum(lo) AS x FROM p GROUP BY i) SELECT CASE WHEN x > 0 THEN 'Y' ELSE 'N' END AS pred, cls AS actual, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1, 2")
def confusion(spark, sf):
    p, md = _predicted(spark, sf)
    total = p.groupBy("i").agg(F.sum(F.round("logodds", 9)).alias("x"))
    pred = CellArray(total.select(F.lit(0).alias("i"), F.col("i").alias("j"), F.when(F.col("x") > 0, "Y").otherwise("N").alias("v")), ArrayMeta(1, md.meta.nrows, "string"))
    return evidence.Validate().compute([pred, md]).df.select("v.*")


# --- genes ------------------------------------------------------------------------------------


@query("gene_filter", cells_sql("SELECT i, CAST(0 AS BIGINT) AS j, max(v) <= 5 * min(v) AND min(v) > 0 OR max(v) - min(v) <= 500 AS v FROM e GROUP BY i", GENES))
def gene_filter(spark, sf):
    return expression.GeneFilter().compute([genes(spark, sf)]).df


GENE_STATS = """s AS (SELECT i, avg(v) AS m, stddev_pop(v) AS sd, avg(v) FILTER (j < 27) AS m1, avg(v) FILTER (j >= 27) AS m2, stddev_pop(v) FILTER (j < 27) AS s1, stddev_pop(v) FILTER (j >= 27) AS s2,
  sum(v * v) FILTER (j < 27) AS q1, sum(v * v) FILTER (j >= 27) AS q2 FROM e GROUP BY i)"""


def _scores(name, sql, op):
    @query(name, cells_sql(f"SELECT i, CAST(0 AS BIGINT) AS j, round({sql}, 7) AS v FROM s", GENES, GENE_STATS))
    def run(spark, sf):
        return op().compute([genes(spark, sf), const(spark, [[27]])]).with_values(F.round("v", 7)).df


_scores("signal_noise", "(m1 - m2) / (s1 + s2)", expression.Correlate)
_scores("ttest", "(m1 - m2) / ((q1 + q2 - 27 * m1 * m1 - 37 * m2 * m2) / 62) / sqrt(1 / 27.0 + 1 / 37.0)", expression.TTest)


@query("gene_stats", cells_sql("SELECT i, CAST(k AS BIGINT) AS j, round(CASE k WHEN 0 THEN m WHEN 1 THEN sd ELSE ((m1 + m2) / 2 - m) / sd END, 7) AS v FROM s, range(3) t(k)", GENES, GENE_STATS))
def gene_stats(spark, sf):
    return expression.GenStats().compute([genes(spark, sf), const(spark, [[27]])]).with_values(F.round("v", 7)).df


@query("normalize_test", cells_sql("SELECT e.i, e.j, round(log10(v) - m / sd - ((m1 + m2) / 2 - m) / sd, 7) AS v FROM e JOIN s USING (i)", GENES, GENE_STATS))
def normalize_test(spark, sf):
    a = genes(spark, sf)
    return expression.NormalizeTest().compute([a, expression.GenStats().compute([a, const(spark, [[27]])])]).with_values(F.round("v", 7)).df


MASK = "k AS (SELECT s.i, round((m1 - m2) / (s1 + s2), 7) AS w FROM s JOIN (SELECT i, max(v) <= 5 * min(v) AND min(v) > 0 OR max(v) - min(v) <= 500 AS d FROM e GROUP BY i) x USING (i) WHERE NOT d), t AS ((SELECT i FROM k ORDER BY w DESC, i LIMIT 25) UNION (SELECT i FROM k ORDER BY w ASC, i DESC LIMIT 25))"


def _mask(spark, sf):
    a = genes(spark, sf)
    score = expression.Correlate().compute([a, const(spark, [[27]])]).with_values(F.round("v", 7))
    return a, score, expression.PredictorMask().compute([expression.GeneFilter().compute([a]), score])


@query("predictor_mask", cells_sql("SELECT DISTINCT e.i, CAST(0 AS BIGINT) AS j, t.i IS NOT NULL AS v FROM e LEFT JOIN t ON e.i = t.i", GENES, GENE_STATS, MASK))
def predictor_mask(spark, sf):
    return _mask(spark, sf)[2].df


@query("vote", cells_sql("SELECT j AS i, CAST(c AS BIGINT) AS j, round(CASE c WHEN 0 THEN CASE WHEN a > b THEN 1.0 ELSE 0.0 END ELSE abs(a - b) / (a + b) END, 6) AS v FROM (SELECT j, sum(greatest(v * w, 0)) AS a, -sum(least(v * w, 0)) AS b FROM e JOIN k USING (i) JOIN t USING (i) GROUP BY j), range(2) z(c)", GENES, GENE_STATS, MASK))
def vote(spark, sf):
    a, score, mask = _mask(spark, sf)
    return expression.PredictVote().compute([a, score, mask]).with_values(F.round("v", 6)).df


# --- traces -------------------------------------------------------------------------------------


def traces(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), F.round("value", 6).alias("value"))


TRACE = """e AS (SELECT id, ts, value FROM (SELECT user_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, round(value, 6) AS value, row_number() OVER (PARTITION BY user_id, CAST(floor(epoch(ts)) AS BIGINT) ORDER BY round(value, 6)) AS r FROM events) WHERE r = 1),
 c AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY id ORDER BY ts) > 21600 THEN 1 ELSE 0 END AS cut FROM e),
 d AS (SELECT id, ts, value, CAST(sum(cut) OVER (PARTITION BY id ORDER BY ts) AS BIGINT) AS seg FROM c),
 x AS (SELECT *, row_number() OVER (PARTITION BY id, seg ORDER BY ts) - 1 AS pt, count(*) OVER (PARTITION BY id, seg) AS n, max(ts) OVER (PARTITION BY id, seg) - min(ts) OVER (PARTITION BY id, seg) AS span FROM d)"""


@query("segment", cells_sql("SELECT id, ts, value, seg, CAST(pt AS BIGINT) AS pt FROM x WHERE n > 1 AND span > 30", TRACE))
def segment(spark, sf):
    return trajectory.segments(traces(spark, sf), gap=21600).select("id", "ts", "value", "seg", "pt")


for _how in ("sum", "avg"):

    @query(f"segment_{_how}", cells_sql(f"SELECT id, seg, round({_how}(value), 5) AS v FROM x WHERE n > 1 AND span > 30 GROUP BY 1, 2", TRACE))
    def _segment(spark, sf, how=_how):
        return trajectory.per_segment(trajectory.segments(traces(spark, sf), gap=21600), F.col("value"), how).withColumn("v", F.round("v", 5))


@query("chunk5", cells_sql("SELECT id, ts, value, CAST((r - 1) // 5 AS BIGINT) AS seg, CAST((r - 1) % 5 AS BIGINT) AS pt FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, value) AS r FROM e)", TRACE))
def chunk5(spark, sf):
    first = traces(spark, sf).groupBy("id", "ts").agg(F.min("value").alias("value"))
    return trajectory.chunks(first, ["ts", "value"]).select("id", "ts", "value", F.col("seg").cast("long").alias("seg"), "pt")


# --- lineage ------------------------------------------------------------------------------------

META = ArrayMeta(SIDE, SIDE)
BRIGHT = "q AS (SELECT i, j FROM g WHERE v > (SELECT avg(v) + 60 FROM g))"


def bright(spark, sf) -> DataFrame:
    a = grid(spark, sf)
    return a.df.join(F.broadcast(a.df.agg((F.avg("v") + 60).alias("t"))), how="cross").filter("v > t").select("i", "j")


@query("bwd_map", cells_sql("SELECT j AS i, i AS j FROM q", GRID, BRIGHT))
def bwd_map(spark, sf):
    return Affine(META, META, swap=True).backward(bright(spark, sf))


@query("bwd_shift", cells_sql("SELECT i + 4 AS i, j + 10 AS j FROM q WHERE i + 4 < 32 AND j + 10 < 32", GRID, BRIGHT))
def bwd_shift(spark, sf):
    return Affine(META, META, dr=4, dc=10).backward(bright(spark, sf))


@query("fwd_shift", cells_sql("SELECT i - 4 AS i, j - 10 AS j FROM q WHERE i >= 4 AND j >= 10", GRID, BRIGHT))
def fwd_shift(spark, sf):
    return Affine(META, META, dr=4, dc=10).forward(bright(spark, sf))


NEAR = "SELECT DISTINCT g.i, g.j FROM g JOIN q ON abs(g.i - q.i) <= {0} AND abs(g.j - q.j) <= {0}"


@query("bwd_window", cells_sql(NEAR.format(1), GRID, BRIGHT))
def bwd_window(spark, sf):
    return Window(META, META, (-1, 1), (-1, 1)).backward(bright(spark, sf)).distinct()


@query("bwd_row", cells_sql("SELECT g.i, g.j FROM g WHERE i IN (SELECT j FROM q)", GRID, BRIGHT))
def bwd_row(spark, sf):
    return Match(ArrayMeta(1, SIDE), META, "j", "i").backward(bright(spark, sf))


@query("bwd_cluster", f"WITH RECURSIVE {GRID}, {CLUSTER}, {BRIGHT} SELECT DISTINCT b.i, b.j FROM (SELECT i, j, min(low) AS l FROM r GROUP BY 1, 2) b JOIN (SELECT min(low) AS l FROM r JOIN q USING (i, j) GROUP BY i, j) s ON b.l = s.l")
def bwd_cluster(spark, sf):
    op, inputs, out = cluster_setup(spark, sf)
    return op.lineage(0, inputs, out).backward(bright(spark, sf))


def pipeline(spark, sf):
    """mean -> diff -> convolve on the grid, as a workflow; then a threshold on its output."""
    w = Workflow()
    mean, diff, conv = (w.register(op) for op in (core.Mean(), core.Diff(), stencil.Convolve()))
    a = grid(spark, sf)
    w.bind(mean, 0, a)
    w.bind(diff, 0, a)
    w.bind(conv, 1, const(spark, ONES))
    w.connect(mean, diff, 1)
    w.connect(diff, conv, 0)
    run = w.run()
    return w, run, mean, diff, conv


CONV = "d AS (SELECT i, j, v - (SELECT avg(v) FROM g) AS v FROM g), k AS (SELECT a.i, a.j, sum(b.v) AS v FROM d a JOIN d b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY 1, 2), q AS (SELECT i, j FROM k WHERE v > 150)"
FLAGSHIP = cells_sql(NEAR.format(1), GRID, CONV)


@query("flagship", FLAGSHIP)
def flagship(spark, sf):
    """The source cells of the cells that stand out after mean, difference and convolution."""
    w, run, _, diff, conv = pipeline(spark, sf)
    hot = w.output(conv, run).df.filter("v > 150")
    return w.backward_path(hot, run, [(conv, 0), (diff, 0)]).cells


@query("fwd_path", cells_sql("SELECT i, j FROM g WHERE i <= 3 AND j <= 3", GRID))
def fwd_path(spark, sf):
    w, run, _, diff, conv = pipeline(spark, sf)
    corner = grid(spark, sf).df.filter("i < 3 AND j < 3")
    return w.forward_path(corner, run, [(diff, 0), (conv, 0)]).cells


@query("all_to_all", cells_sql("SELECT i, j FROM g", GRID))
def all_to_all(spark, sf):
    w, run, mean, diff, conv = pipeline(spark, sf)
    one = grid(spark, sf).df.filter("i = 3 AND j = 3")
    return w.forward_path(one, run, [(mean, 0), (diff, 1), (conv, 0)]).cells


@query("path_union", cells_sql(f"SELECT i, j FROM ({NEAR.format(1)}) UNION SELECT j AS i, i AS j FROM q", GRID, CONV))
def path_union(spark, sf):
    w, run, _, diff, conv = pipeline(spark, sf)
    hot = w.output(conv, run).df.filter("v > 150")
    back = w.backward_path(hot, run, [(conv, 0), (diff, 0)])
    from .workflow import PathResult

    return back.union(PathResult(Affine(META, META, swap=True).backward(hot), [])).cells


def _edges(spark) -> DataFrame:
    return Window(META, META, (-1, 1), (-1, 1)).edges(spark)


def _stores():
    for out, inp in itertools.product((Spec.ONE, Spec.MANY, Spec.GRID), (Spec.MANY, Spec.KEY, Spec.GRID)):
        for back in (True, False):
            d = Desc(Mode.PTR, out, inp, back)
            for way in ("bwd", "fwd"):

                @query(f"store_{way}_{str(d).lower()}", cells_sql(NEAR.format(1), GRID, BRIGHT))
                def run(spark, sf, d=d, way=way):
                    s = Store(d, META, META, _edges(spark))
                    return s.backward(bright(spark, sf)) if way == "bwd" else s.forward(bright(spark, sf))


_stores()


@query("box_reexec", cells_sql(NEAR.format(1), GRID, BRIGHT))
def box_reexec(spark, sf):
    rel = Window(META, META, (-1, 1), (-1, 1))
    return Store(Desc(Mode.PTR, Spec.MANY, Spec.BOX), META, META, _edges(spark), rel).backward(bright(spark, sf)).distinct()


@query("box_bounds", cells_sql("SELECT min(g.i) AS lo_i, min(g.j) AS lo_j, max(g.i) AS hi_i, max(g.j) AS hi_j FROM g JOIN q ON abs(g.i - q.i) <= 1 AND abs(g.j - q.j) <= 1", GRID, BRIGHT))
def box_bounds(spark, sf):
    return Store(Desc(Mode.PTR, Spec.ONE, Spec.BOX), META, META, _edges(spark), None).bounds(bright(spark, sf))


@query("composite_union", cells_sql(f"{NEAR.format(3)} AND (g.i, g.j) IN (SELECT (i, j) FROM g) AND q.i % 2 = 0 UNION SELECT i, j FROM q", GRID, BRIGHT))
def composite_union(spark, sf):
    from .lineage.expr import Restrict, Union

    even = grid(spark, sf).df.filter("i % 2 = 0")
    return Union(identity(META), Restrict(Window(META, META, (-3, 3), (-3, 3)), even)).backward(bright(spark, sf)).distinct()


@query("enc_grid_roundtrip", cells_sql("SELECT i, j, CAST(32 * greatest(i - 1, 0) + greatest(j - 1, 0) AS BIGINT) AS low, CAST((least(i + 1, 31) - greatest(i - 1, 0) + 1) * (least(j + 1, 31) - greatest(j - 1, 0) + 1) AS BIGINT) AS n FROM g", GRID))
def enc_grid_roundtrip(spark, sf):
    num = _edges(spark).groupBy("oi", "oj").agg(F.collect_list(F.col("ii") * SIDE + F.col("ij")).alias("c"))
    back = num.select("oi", "oj", grid_decode(grid_encode(F.col("c"), SIDE), SIDE).alias("c"))
    return back.select(F.col("oi").alias("i"), F.col("oj").alias("j"), F.array_min("c").alias("low"), F.size("c").cast("long").alias("n"))


@query("enc_key_roundtrip", cells_sql("SELECT g.i AS oi, g.j AS oj, b.i AS ii, b.j AS ij FROM g JOIN g b ON abs(g.i - b.i) <= 1 AND abs(g.j - b.j) <= 1", GRID))
def enc_key_roundtrip(spark, sf):
    return Store(Desc(Mode.PTR, Spec.MANY, Spec.KEY), META, META, _edges(spark)).edges(spark)


@query("regions", cells_sql("SELECT CAST(count(*) AS BIGINT) AS regions, CAST(sum(n) AS BIGINT) AS cells FROM (SELECT low, count(*) AS n FROM (SELECT i, j, v AS low FROM g) GROUP BY low)", GRID))
def regions(spark, sf):
    a = grid(spark, sf).df
    label = a.join(a.select("v", F.col("i").alias("ii"), F.col("j").alias("ij")), "v").select(F.col("i").alias("oi"), F.col("j").alias("oj"), "ii", "ij")
    r = regions_of(label, META, META)
    return r.agg(F.count(F.lit(1)).alias("regions"), F.sum(F.size("outs")).cast("long").alias("cells"))


@query("edges_roundtrip", cells_sql("SELECT CAST(count(*) AS BIGINT) AS n FROM g JOIN g b ON abs(g.i - b.i) <= 1 AND abs(g.j - b.j) <= 1", GRID))
def edges_roundtrip(spark, sf):
    return edges_of(regions_of(_edges(spark), META, META), META, META).agg(F.count(F.lit(1)).alias("n"))


@query("bwd_payload", f"WITH {EVIDENCE}, x AS (SELECT k, k1, k2, row_number() OVER (ORDER BY k, k1, k2) - 1 AS idx FROM ev) SELECT DISTINCT CAST(o.i AS BIGINT) AS i, CAST(c AS BIGINT) AS j FROM o, x, range(3) t(c) WHERE idx < 3 AND (c = 0 OR c = x.k)")
def bwd_payload(spark, sf):
    md, _ = labelled(spark, sf)
    op = evidence.CreateModel()
    ev = evidence.build_evidence(md, labelled(spark, sf)[1], FTYPES)
    out = CellArray(ev.select(F.lit(0).alias("i"), F.col("idx").alias("j"), F.struct("k", "k1", "k2", "logodds").alias("v")), ArrayMeta(1, ev.count(), "record"))
    t = F.when(F.col("v.k") == 0, "1_").when(F.col("v.k") < 3, "2_").otherwise("3_")
    pay = out.df.select(F.col("i").alias("oi"), F.col("j").alias("oj"), F.concat(t, F.col("v.k"), F.when(F.col("v.k") < 3, "").otherwise("_3")).alias("payload"))
    hit = pay.filter("oj < 3")
    rows = op.expand(hit, 0, [md.meta]).select(F.col("ii").alias("i"), F.col("ij").alias("j")).distinct()
    return rows.join(md.df.select("i").distinct(), "i", "left_semi").select("i", "j")


@query("lineage_stats", cells_sql("SELECT avg(n) AS fanin, CAST(sum(n) AS BIGINT) AS nptrs FROM (SELECT g.i, g.j, count(*) AS n FROM g JOIN g b ON abs(g.i - b.i) <= 1 AND abs(g.j - b.j) <= 1 GROUP BY 1, 2)", GRID))
def lineage_stats(spark, sf):
    op, a = stencil.Convolve(), grid(spark, sf)
    return measure(op, 0, [a, const(spark, ONES)], a).select("fanin", F.col("nptrs").cast("long").alias("nptrs"))


# --- statistics: the analysis queries over stand-in rows ------------------------------------------

#: A wid for each line item. Order and line repeat; rows that agree in what is read here may be numbered either way.
WID = "(l_orderkey * 100 + l_linenumber) * 1000000 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity, l_extendedprice, l_returnflag)"
RUNS = f"""li AS (SELECT *, {WID} AS wid FROM lineitem),
 wr AS (SELECT wid, l_orderkey % 20 AS eid, l_partkey % 5 AS opid, l_returnflag AS strat, l_quantity AS opcost FROM li),
 po AS (SELECT wid, l_extendedprice AS overhead, l_quantity * 1048576 AS disk FROM li)"""


def _t(spark, sf):
    """Statistics tables with the columns that the queries read, from all line items and orders; a wid for each line item."""
    li = table(spark, sf, "lineitem")
    nth = F.row_number().over(Rows.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_quantity", "l_extendedprice", "l_returnflag"))
    li = li.withColumn("wid", (F.col("l_orderkey").cast("long") * 100 + F.col("l_linenumber")) * 1_000_000 + nth)
    order = table(spark, sf, "orders")
    views = {
        "workflow_run": li.select("wid", (F.col("l_orderkey") % 20).alias("eid"), F.lit(1).cast("long").alias("runid"), (F.col("l_partkey") % 5).alias("opid"), F.concat(F.lit("op"), F.col("l_partkey") % 5).alias("op"), F.col("l_returnflag").alias("strat"), F.col("l_quantity").alias("opcost"), (F.col("l_quantity") * 3).alias("nptrs"), (F.col("l_quantity") % 7 + 1).alias("oclustsize"), (F.col("l_quantity") * 2).alias("noutcells"), (F.col("l_quantity") * 5).alias("outputsize")),
        "workflow_inputs": li.select("wid", F.lit(0).cast("long").alias("arridx"), (F.col("l_quantity") + 1).alias("area")),
        "capture_cost": li.select("wid", F.col("l_extendedprice").alias("overhead"), (F.col("l_quantity") * 1048576).alias("disk")),
        "capture_shape": li.select("wid", F.lit(0).cast("long").alias("arridx"), (F.col("l_quantity") % 9 + 1).alias("fanin"), F.lit(9.0).alias("area"), ((F.col("l_quantity") % 9 + 1) / 9).alias("density")),
        "exec": order.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 4).alias("width"), (F.col("o_custkey") % 3).alias("height"), (F.col("o_custkey") % 5).alias("runmode"), F.when(F.col("o_orderstatus") == "F", "opt").when(F.col("o_orderstatus") == "O", "noop").otherwise("stats").alias("runtype"), F.lit(1).alias("finished"), F.lit(0.0).alias("diskconstraint"), F.lit(0.0).alias("runconstraint")),
        "pq": order.select(F.col("o_orderkey").alias("pqid"), F.col("o_orderkey").alias("eid"), F.lit(1).cast("long").alias("runid"), (F.col("o_orderkey") % 2).alias("forward"), F.col("o_totalprice").alias("cost")),
        "iq": li.select(F.col("l_orderkey").alias("pqid"), (F.col("l_partkey") % 5).alias("opid"), F.lit(0).cast("long").alias("arridx"), F.col("l_quantity").alias("noutputs"), (F.col("l_quantity") % 4).alias("ninputs"), (F.col("l_orderkey") % 2).alias("forward")),
        "exec_stats": order.select(F.col("o_orderkey").alias("eid"), F.col("o_totalprice").alias("disk")),
        "pq_path": table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pqid"), F.col("l_linenumber").cast("long").alias("idx"), F.concat(F.lit("op"), F.col("l_partkey") % 5).alias("op")),
    }
    return views.__getitem__


@query("stats_op", cells_sql("""SELECT CAST(a.l_partkey % 5 AS BIGINT) AS opid, CAST(0 AS BIGINT) AS arridx, round(avg(c.l_quantity % 9 + 1), 6) AS fanin, round(avg(a.l_quantity % 7 + 1), 6) AS oclustsize, round(avg(a.l_quantity * 3), 6) AS nptrs, round(avg(b.l_quantity + 1), 6) AS inputsize, round(avg(a.l_quantity), 6) AS opcost
  FROM li a JOIN li b ON a.wid = b.wid JOIN li c ON a.wid = c.wid GROUP BY 1, 2""", RUNS))
def stats_op(spark, sf):
    from . import stats

    q = stats.op_stats(_t(spark, sf), list(range(20)))
    return q.select("opid", "arridx", *[F.round(c, 6).alias(c) for c in ("fanin", "oclustsize", "nptrs", "inputsize", "opcost")])


@query("stats_similar", "SELECT e2.o_orderkey AS id FROM orders e1, orders e2 WHERE e1.o_orderkey = (SELECT min(o_orderkey) FROM orders) AND e1.o_custkey % 4 = e2.o_custkey % 4 AND e1.o_custkey % 3 = e2.o_custkey % 3 AND e1.o_custkey % 5 = e2.o_custkey % 5 AND e2.o_orderstatus = 'F'")
def stats_similar(spark, sf):
    from . import stats

    first = table(spark, sf, "orders").agg(F.min("o_orderkey")).first()[0]
    return stats.similar(_t(spark, sf), first)


@query("stats_noops", "SELECT o_orderkey AS id FROM orders WHERE o_custkey % 5 = 1 AND o_custkey % 4 = 2 AND o_custkey % 3 = 1 AND o_orderstatus = 'P'")
def stats_noops(spark, sf):
    from . import stats

    return stats.matching_noops(_t(spark, sf), 1, (2, 1))


@query("stats_selectivity", """SELECT opid, CAST(count(*) AS BIGINT) AS n, round(avg(noutputs / (ninputs + 1)), 6) AS sel FROM (SELECT CAST(l_partkey % 5 AS BIGINT) AS opid, l_quantity AS noutputs, l_quantity % 4 AS ninputs FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 2 = 1) GROUP BY 1""")
def stats_selectivity(spark, sf):
    from . import stats

    q = stats.selectivity(_t(spark, sf), True)
    return q.groupBy("opid").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("sel") * F.col("n")) / F.sum("n"), 6).alias("sel"))


@query("stats_overheads", cells_sql("SELECT concat('op', opid) AS op, strat, round(avg(overhead), 4) AS overhead, round(avg(disk) / 1048576, 6) AS disk, round(avg(opcost), 6) AS opcost FROM wr JOIN po USING (wid) GROUP BY 1, 2", RUNS))
def stats_overheads(spark, sf):
    from . import stats

    return stats.overheads(_t(spark, sf)).select("op", "strat", F.round("overhead", 4).alias("overhead"), F.round("disk", 6).alias("disk"), F.round("opcost", 6).alias("opcost"))


@query("overhead_having", cells_sql("SELECT opid, strat, round(avg(overhead), 4) AS mean, round(stddev_samp(overhead), 4) AS dev, round(min(overhead), 4) AS lo, round(max(overhead), 4) AS hi FROM wr JOIN po USING (wid) GROUP BY 1, 2 HAVING count(*) > 40", RUNS))
def overhead_having(spark, sf):
    t = _t(spark, sf)
    q = t("workflow_run").join(t("capture_cost"), "wid").groupBy("opid", "strat")
    q = q.agg(F.count(F.lit(1)).alias("c"), F.round(F.avg("overhead"), 4).alias("mean"), F.round(F.stddev_samp("overhead"), 4).alias("dev"), F.round(F.min("overhead"), 4).alias("lo"), F.round(F.max("overhead"), 4).alias("hi"))
    return q.filter("c > 40").drop("c")


@query("stats_paths", "SELECT l_orderkey AS pqid, string_agg(concat('op', l_partkey % 5), ',' ORDER BY l_linenumber, concat('op', l_partkey % 5)) AS path FROM lineitem GROUP BY 1")
def stats_paths(spark, sf):
    from . import stats

    return stats.paths(_t(spark, sf))


@query("stats_pivot", cells_sql("SELECT concat('op', opid) AS op, round(avg(overhead) FILTER (strat = 'A'), 4) AS A, round(avg(overhead) FILTER (strat = 'N'), 4) AS N, round(avg(overhead) FILTER (strat = 'R'), 4) AS R FROM wr JOIN po USING (wid) GROUP BY 1", RUNS))
def stats_pivot(spark, sf):
    from . import stats

    q = stats.pivot_strategies(_t(spark, sf))
    return q.select("op", *[F.round(c, 4).alias(c) for c in q.columns if c != "op"])


# --- optimizer --------------------------------------------------------------------------------------


@query("optimizer")
def optimizer(spark, sf):
    """(op, strategy) chosen for three operators under a disk and a capture budget, from the statistics queries' rows."""
    from . import stats
    from .plans.optimizer import History

    rows = stats.op_stats(_t(spark, sf), list(range(20))).orderBy("opid").collect()
    order = ("fanin", None, "density", "oclustsize", "nptrs", "noutcells", "outputsize", "inputsize", "opcost")
    st = {(f"op{r['opid']}", 0): tuple(r["area"] if c is None else r[c] for c in order) for r in rows}
    hist = {key: History([(2.0, 3, 10.0)], [(4.0, 5, 10.0)]) for key in st}
    modes = {op: ("PTMAP", "PTR") for op, _ in st}
    picked, _ = optimize(Predictor(st, hist, modes), [op for op, _ in st], max_disk=50.0, max_write_share=1000.0)
    return spark.createDataFrame([(str(op), str(s)) for op, s in sorted(picked.items(), key=lambda x: str(x[0]))], "op string, strategy string")


@query("strategies")
def strategies(spark, sf):
    """The optimizer's candidates by name."""
    return spark.createDataFrame([(k, str(s)) for k, s in enumerate([*candidates(), Strategy.single(COMPOSITE)])], "k long, strategy string")


@query("edges_table", cells_sql("SELECT DISTINCT b.i, b.j FROM q JOIN g b ON b.i = q.j", GRID, BRIGHT))
def edges_table(spark, sf):
    e = Match(META, META, "j", "i").edges(spark)
    return Table(META, META, e).backward(bright(spark, sf)).distinct()


from . import scenarios  # noqa: E402, F401
