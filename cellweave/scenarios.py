"""Three whole workflows as queries with SQL: two exposures of the sky, a relapse model, a gene vote.

The exposures are 300 x 300, so windows and clusters cross the seams of the
256-wide tiles and the borders; cosmic rays are single bright cells, sources
5 x 5 squares. The relapse model takes a labelled matrix of all orders.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .array import ArrayMeta, CellArray
from .operators import core, evidence, expression, stencil
from .operators.cluster import Cluster
from .queries import EVIDENCE, GENES, LAPLACIAN, PREDICTED, cells_sql, const, genes, labelled, query, table
from .workflow import PathResult, Workflow

# --- two exposures ----------------------------------------------------------------------

SKY = 300


def exposures(spark, sf) -> tuple[CellArray, CellArray]:
    """Background, squares of sources, and cosmic rays that the second exposure shares and adds to."""
    li = table(spark, sf, "lineitem")
    u = CellArray.from_table(li, F.col("l_orderkey") % SKY, F.col("l_partkey") % SKY, F.sum("l_quantity"), SKY, SKY)
    w = CellArray.from_table(li, F.col("l_partkey") % SKY, F.col("l_orderkey") % SKY, F.sum("l_quantity"), SKY, SKY)
    both = u.df.join(w.df.withColumnRenamed("v", "w"), ["i", "j"])
    star = F.when((F.col("i") % 60).between(20, 24) & (F.col("j") % 60).between(20, 24), 800).otherwise(0)
    ray = lambda c: F.when((F.col(c) > 0) & (F.col(c) % 41 == 0), 3000).otherwise(0)
    one, two = 100 + F.col("v") % 5 + star + ray("v"), 100 + F.col("w") % 7 + star + F.greatest(ray("v"), ray("w"))
    meta = ArrayMeta(SKY, SKY)
    return tuple(CellArray(both.select("i", "j", x.cast("double").alias("v")), meta) for x in (one, two))


def _sum(i: str, j: str) -> str:
    return f"(SELECT CAST({i} % {SKY} AS BIGINT) AS i, CAST({j} % {SKY} AS BIGINT) AS j, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2)"


EXPOSURES = f"""sky AS MATERIALIZED (SELECT CAST(a.range AS BIGINT) AS i, CAST(b.range AS BIGINT) AS j FROM range({SKY}) a, range({SKY}) b),
 raw AS MATERIALIZED (SELECT i, j, coalesce(x.v, 0.0) AS v, coalesce(y.v, 0.0) AS w, CASE WHEN i % 60 BETWEEN 20 AND 24 AND j % 60 BETWEEN 20 AND 24 THEN 800 ELSE 0 END AS star
   FROM sky LEFT JOIN {_sum('l_orderkey', 'l_partkey')} x USING (i, j) LEFT JOIN {_sum('l_partkey', 'l_orderkey')} y USING (i, j)),
 rays AS MATERIALIZED (SELECT *, CASE WHEN v > 0 AND v % 41 = 0 THEN 3000 ELSE 0 END AS r, CASE WHEN w > 0 AND w % 41 = 0 THEN 3000 ELSE 0 END AS s FROM raw),
 e1 AS MATERIALIZED (SELECT i, j, CAST(100 + v % 5 + star + r AS DOUBLE) AS v FROM rays), e2 AS MATERIALIZED (SELECT i, j, CAST(100 + w % 7 + star + greatest(r, s) AS DOUBLE) AS v FROM rays)"""


def window_sql(name: str, source: str, size: int, value: str = "median(b.v)") -> str:
    """A CTE of an aggregate over the size x size window, mirrored at the borders without repeating the border's cells."""
    h, last = size // 2, SKY - 1
    at = lambda c: f"CASE WHEN a.{c} + d{c}.range < {h} THEN {h} - a.{c} - d{c}.range WHEN a.{c} + d{c}.range > {last + h} THEN {2 * last + h} - a.{c} - d{c}.range ELSE a.{c} + d{c}.range - {h} END"
    return f"{name} AS MATERIALIZED (SELECT n.i, n.j, {value} AS v FROM (SELECT a.i, a.j, {at('i')} AS bi, {at('j')} AS bj FROM sky a, range({size}) di, range({size}) dj) n JOIN {source} b ON b.i = n.bi AND b.j = n.bj GROUP BY 1, 2)"


def rays_sql(out: str, a: str) -> str:
    """CTEs that end in the cosmic-ray mask ``out`` of image ``a``: Laplacian of the doubled image, noise, contrast, growth."""
    p = out + "_"
    near = lambda x, c, d, n: f"JOIN {p}t {x} ON {x}.i = least(greatest(t.i + {c}, 0), {n}) AND {x}.j = least(greatest(t.j + {d}, 0), {n})"
    edge = " + ".join(f"greatest(2 * t.v - {x}.v - {y}.v, 0)" for x in ("up", "down") for y in ("west", "east"))
    last = SKY - 1
    return f"""{p}t AS MATERIALIZED (SELECT i, j, trunc(v) AS v FROM {a}),
 {p}up AS MATERIALIZED (SELECT t.i, t.j, ({edge}) / 4 AS v FROM {p}t t {near('up', -1, 0, last)} {near('down', 1, 0, last)} {near('west', 0, -1, last)} {near('east', 0, 1, last)}),
 {window_sql(p + 'm5', a, 5)},
 {p}noise AS MATERIALIZED (SELECT i, j, sqrt(2.2 * greatest(v, 1e-5) + 100) / 2.2 AS v FROM {p}m5),
 {p}s0 AS MATERIALIZED (SELECT i, j, u.v / (2 * n.v) AS v FROM {p}up u JOIN {p}noise n USING (i, j)),
 {window_sql(p + 's5', p + 's0', 5)}, {window_sql(p + 'm3', a, 3)}, {window_sql(p + 'm37', p + 'm3', 7)},
 {p}s AS MATERIALIZED (SELECT i, j, x.v - y.v AS v FROM {p}s0 x JOIN {p}s5 y USING (i, j)),
 {p}found AS MATERIALIZED (SELECT i, j, CASE WHEN s.v > 5 AND s.v / greatest((m.v - k.v) / n.v, 0.01) > 5 THEN 1 ELSE 0 END AS v FROM {p}s s JOIN {p}m3 m USING (i, j) JOIN {p}m37 k USING (i, j) JOIN {p}noise n USING (i, j)),
 {window_sql(p + 'g1', p + 'found', 3, 'max(b.v)')},
 {p}more AS MATERIALIZED (SELECT i, j, CASE WHEN g.v > 0 AND s.v > 5 THEN 1 ELSE 0 END AS v FROM {p}g1 g JOIN {p}s s USING (i, j)),
 {window_sql(p + 'g2', p + 'more', 3, 'max(b.v)')},
 {out} AS MATERIALIZED (SELECT i, j, g.v > 0 AND s.v > 1.5 AS v FROM {p}g2 g JOIN {p}s s USING (i, j))"""


@query("cr_mask", cells_sql("SELECT * FROM c", EXPOSURES, rays_sql("c", "e1")))
def cr_mask(spark, sf):
    return stencil.CRDetect().compute([exposures(spark, sf)[0], const(spark, LAPLACIAN)]).df


#: What is done to each exposure, as name: (operator, arguments), an argument being an operator of the same exposure or a fixed array.
EXPOSURE = {
    "linear": (lambda: core.OneToOne(lambda v: v * 1.0), ["exposure"]),
    "attributes": (lambda: core.OneToOne(lambda v: v + 0.0), ["linear"]),
    "pixels": (core.BadPixRemoval, ["attributes", "bad"]),
    "overscan": (lambda: core.Subsample(((0, 1), (0, 1))), ["pixels"]),
    "level": (core.MeanSingleVal, ["overscan"]),
    "levelled": (core.DiffSingleVal, ["pixels", "level"]),
    "bias": (core.Diff, ["levelled", "zero"]),
    "dark": (core.Diff, ["bias", "zero"]),
    "flat": (core.Diff, ["dark", "one"]),
    "sky": (core.Mean, ["flat"]),
    "clean": (core.Diff, ["flat", "sky"]),
    "rays": (stencil.CRDetect, ["clean", "kernel"]),
}
#: What merges them; exposures' operators have their number.
MERGED = {
    "sum": (core.Add, ["clean1", "clean2"]),
    "mask": (core.LogicalAnd, ["rays1", "rays2"]),
    "picture": (stencil.RemoveCRs, ["sum", "mask"]),
    "sources": (Cluster, ["picture", "limit"]),
}


def build(graph: dict, fixed: dict) -> tuple[Workflow, dict]:
    """A workflow of name: (operator, arguments by name) and its operators by name."""
    w, at = Workflow(), {name: kind() for name, (kind, _) in graph.items()}
    for op in at.values():
        w.register(op)
    for name, (_, args) in graph.items():
        for k, x in enumerate(args):
            if x in at:
                w.connect(at[x], at[name], k)
            else:
                w.bind(at[name], k, fixed[x])
    return w, at


def sky_survey(spark, sf, keep=("clean1", "clean2", "rays1", "rays2", "sources")) -> tuple[Workflow, dict, int]:
    """The workflow, its operators and a run that writes the outputs of ``keep``."""
    flat = lambda v, kind="double": CellArray(exposures(spark, sf)[0].df.select("i", "j", F.lit(v).cast(kind).alias("v")), ArrayMeta(SKY, SKY, kind))
    fixed = {"bad": flat(False, "boolean"), "zero": flat(0.0), "one": flat(1.0), "kernel": const(spark, LAPLACIAN), "limit": const(spark, [[400.0, 0.0]])}
    fixed |= {f"exposure{n}": x for n, x in enumerate(exposures(spark, sf), 1)}
    graph = {f"{name}{n}": (kind, [x if x in fixed else f"{x}{n}" for x in args]) for n in (1, 2) for name, (kind, args) in EXPOSURE.items()}
    w, at = build(graph | MERGED, fixed)
    return w, at, w.run(keep=tuple(at[x] for x in keep))


def cleaned_sql(n: int) -> str:
    """clean<n>, an exposure without its overscan level, flat field and mean, and its mask."""
    e = f"e{n}"
    return f"""px{n} AS MATERIALIZED (SELECT i, j, CASE WHEN v <> 0 THEN v ELSE 90.0 END AS v FROM {e}), fl{n} AS MATERIALIZED (SELECT i, j, v - (SELECT v FROM px{n} WHERE i = 0 AND j = 0) - 1 AS v FROM px{n}),
 clean{n} AS MATERIALIZED (SELECT i, j, v - (SELECT avg(v) FROM fl{n}) AS v FROM fl{n}), {rays_sql(f'rays{n}', f'clean{n}')}"""


SURVEY = f"""{EXPOSURES}, {cleaned_sql(1)}, {cleaned_sql(2)},
 mask AS MATERIALIZED (SELECT i, j, x.v AND y.v AS v FROM rays1 x JOIN rays2 y USING (i, j)), total AS MATERIALIZED (SELECT i, j, x.v + y.v AS v FROM clean1 x JOIN clean2 y USING (i, j)),
 fill AS MATERIALIZED (SELECT m.i, m.j, median(t.v) AS v FROM mask m JOIN (SELECT total.* FROM total JOIN mask USING (i, j) WHERE NOT mask.v) t ON abs(t.i - m.i) <= 2 AND abs(t.j - m.j) <= 2 WHERE m.v GROUP BY 1, 2),
 picture AS MATERIALIZED (SELECT t.i, t.j, coalesce(f.v, t.v) AS v FROM total t LEFT JOIN fill f USING (i, j)),
 bright AS MATERIALIZED (SELECT i, j, i * {SKY} + j AS n FROM picture WHERE v > 400),
 walk AS (SELECT n, i, j, n AS low FROM bright UNION SELECT b.n, b.i, b.j, w.low FROM walk w JOIN bright b ON abs(b.i - w.i) <= 1 AND abs(b.j - w.j) <= 1),
 sources AS MATERIALIZED (SELECT i, j, min(low) + 1 AS v FROM walk GROUP BY 1, 2)"""


def _survey(body: str) -> str:
    return f"WITH RECURSIVE {SURVEY} {body}"


@query("sky_picture", _survey("SELECT i, j, round(v, 6) AS v FROM picture"))
def sky_picture(spark, sf):
    w, at, run = sky_survey(spark, sf)
    return w.output(at["picture"], run).with_values(F.round("v", 6)).df


@query("sky_sources", _survey("SELECT s.i, s.j, CAST(coalesce(x.v, 0) AS DOUBLE) AS v FROM sky s LEFT JOIN sources x USING (i, j)"))
def sky_sources(spark, sf):
    w, at, run = sky_survey(spark, sf)
    return w.output(at["sources"], run).df


def _faint(w, at, run):
    """The cells that carry the five smallest labels' own numbers: one of each source."""
    out = w.output(at["sources"], run).df
    return out.filter((F.col("v") > 0) & (F.col("v") == F.col("i") * SKY + F.col("j") + 1)).orderBy("v").limit(5).select("i", "j")


BACK = "f AS (SELECT v FROM sources WHERE v = i * 300 + j + 1 ORDER BY v LIMIT 5), members AS MATERIALIZED (SELECT i, j FROM sources WHERE v IN (SELECT v FROM f))"
SEEN = "SELECT i, j FROM members UNION SELECT s.i, s.j FROM sky s JOIN (SELECT m.i, m.j FROM members m JOIN rays{0} r USING (i, j) WHERE r.v) q ON abs(s.i - q.i) <= 3 AND abs(s.j - q.j) <= 3"


def _back(w, at, run, n: int, upto: list[str]) -> PathResult:
    path = [("sources", 0), ("picture", 1), ("mask", n - 1), (f"rays{n}", 0), *((f"{x}{n}", 0) for x in upto)]
    return w.backward_path(_faint(w, at, run), run, [(at[x], k) for x, k in path])


for _n in (1, 2):

    @query(f"sky_check{_n}", _survey(f", {BACK} {SEEN.format(_n)}").replace(" ,", ","))
    def _check(spark, sf, n=_n):
        """Back from a few sources to the flat-fielded exposure, to see whether they are real."""
        w, at, run = sky_survey(spark, sf)
        return _back(w, at, run, n, ["clean", "flat"]).cells


@query("sky_origin", _survey(f", {BACK} {SEEN.format(1)} UNION {SEEN.format(2)}").replace(" ,", ","))
def sky_origin(spark, sf):
    """Back from a few sources to both exposures as they came in."""
    w, at, run = sky_survey(spark, sf)
    upto = ["clean", "flat", "dark", "bias", "levelled", "pixels", "attributes", "linear"]
    return _back(w, at, run, 1, upto).union(_back(w, at, run, 2, upto)).cells


@query("sky_fault", f"WITH {EXPOSURES} SELECT i, j FROM sky")
def sky_fault(spark, sf):
    """Forward from a faulty corner through the overscan level: it reaches every cell."""
    w, at, run = sky_survey(spark, sf)
    corner = exposures(spark, sf)[0].df.filter("i < 10 AND j < 10")
    path = [("linear1", 0), ("attributes1", 0), ("pixels1", 0), ("overscan1", 0), ("level1", 0), ("levelled1", 1)]
    return w.forward_path(corner, run, [(at[x], k) for x, k in path]).cells


@query("sky_missing", _survey("SELECT i, j FROM sky WHERE i BETWEEN 25 AND 49 AND j BETWEEN 30 AND 49"))
def sky_missing(spark, sf):
    """Back from where a source should be: what the mask had to say there."""
    w, at, run = sky_survey(spark, sf)
    there = exposures(spark, sf)[0].df.filter("i BETWEEN 25 AND 49 AND j BETWEEN 30 AND 49")
    return w.backward_path(there, run, [(at["picture"], 1)]).cells


# --- relapse --------------------------------------------------------------------------------

#: Rows of the matrix that is read: a name, three columns of description, then a column for each subject.
NAMES, SKIP = ["RELAPSE", "PRIORITY", "PRICE", "DEPENDENT", evidence.SUBCLASS, "UNUSED"], 4
TYPES = ["target.feature", "clinical", "genom", "pathway.dep.outcome"]
MODEL = {
    "names": (evidence.GetNames, ["matrix"]),
    "subjects": (lambda: core.Subsample(((0, len(NAMES)), (SKIP, 2**62))), ["matrix"]),
    "turned": (core.Transpose, ["subjects"]),
    "features": (evidence.ExtractNonsubclass, ["turned", "names", "wanted"]),
    "model": (evidence.CreateModel, ["features", "turned", "names", "types"]),
    "odds": (evidence.PredictEvidence, ["model", "features", "turned", "types", "names"]),
    "total": (evidence.CumOdds, ["odds"]),
    "chance": (core.Sigmoid, ["total"]),
    "class": (core.GetClasses, ["chance"]),
    "verdict": (evidence.Validate, ["class", "turned"]),
}


def relapse(spark, sf, keep=("model",)) -> tuple[Workflow, dict, int]:
    md, sub = labelled(spark, sf)
    rows = md.df.union(sub.select("i", F.lit(4).alias("j"), F.col("s").alias("v"))).union(sub.select("i", F.lit(5).alias("j"), F.lit("x")))
    cells = rows.select(F.col("j").alias("i"), (F.col("i") + SKIP).alias("j"), "v")
    head = spark.createDataFrame([(i, j, n if j == 0 else "") for i, n in enumerate(NAMES) for j in range(SKIP)], "i long, j long, v string")
    matrix = CellArray(head.union(cells), ArrayMeta(len(NAMES), md.meta.nrows + SKIP, "string"))
    w, at = build(MODEL, {"matrix": matrix, "wanted": const(spark, [NAMES[:4]], "string"), "types": const(spark, [TYPES], "string")})
    return w, at, w.run(keep=tuple(at[x] for x in keep))


@query("relapse_verdict", f"WITH {PREDICTED}, s AS (SELECT i, any_value(cls) AS cls, sum(lo) AS x FROM p GROUP BY i) SELECT CASE WHEN x > 0 THEN 'Y' ELSE 'N' END AS pred, cls AS actual, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1, 2")
def relapse_verdict(spark, sf):
    w, at, run = relapse(spark, sf)
    return w.output(at["verdict"], run).df.select("v.*")


@query("relapse_model", f"WITH {EVIDENCE} SELECT CAST(row_number() OVER (ORDER BY k, k1, k2) - 1 AS BIGINT) AS idx, CAST(k AS BIGINT) AS k, k1, k2, round(lo, 9) AS logodds FROM ev")
def relapse_model(spark, sf):
    w, at, run = relapse(spark, sf)
    return w.output(at["model"], run).df.select(F.col("j").alias("idx"), F.col("v.k").cast("long").alias("k"), "v.k1", "v.k2", F.round("v.logodds", 9).alias("logodds"))


LISTED = "x AS (SELECT k, k1, k2, CAST(row_number() OVER (ORDER BY k, k1, k2) - 1 AS BIGINT) AS idx FROM ev)"


@query("relapse_fault", f"WITH {EVIDENCE}, {LISTED} SELECT CAST(0 AS BIGINT) AS i, idx AS j FROM x WHERE k = 1")
def relapse_fault(spark, sf):
    """Forward from one subject's doubtful priority: the evidence that it went into."""
    w, at, run = relapse(spark, sf)
    cell = spark.createDataFrame([(1, SKIP + 1)], "i long, j long")
    return w.forward_path(cell, run, [(at[x], 0) for x in ("subjects", "turned", "features", "model")]).cells


WHOLE = "CAST(a AS BIGINT) AS i, CAST(b AS BIGINT) + 4 AS j FROM range(4) t(a), (SELECT unnest(range(max(o_orderkey) + 1)) AS b FROM orders)"


@query("relapse_evidence", f"WITH {EVIDENCE}, {LISTED} SELECT {WHOLE} WHERE a = 0 OR a = (SELECT k FROM x WHERE idx = 2)")
def relapse_evidence(spark, sf):
    """Back from one piece of evidence to the matrix: its feature and the class, of every subject."""
    w, at, run = relapse(spark, sf)
    cell = spark.createDataFrame([(0, 2)], "i long, j long")
    return w.backward_path(cell, run, [(at[x], 0) for x in ("model", "features", "turned", "subjects")]).cells


FIRST = "(SELECT min(i) FROM o WHERE cls <> 'NA')"


@query("relapse_subject", f"WITH {EVIDENCE}, {LISTED} SELECT {WHOLE} WHERE a = 0 OR a IN (SELECT x.k FROM x, o WHERE o.i = {FIRST} AND ((x.k = 1 AND x.k1 = pri) OR (x.k = 2 AND x.k1 = price) OR (x.k = 3 AND x.k1 = seg AND x.k2 = price)))")
def relapse_subject(spark, sf):
    """Back from one subject's class through the evidence that decided it."""
    w, at, run = relapse(spark, sf)
    known = w.output(at["turned"], run).df.filter("j = 0 AND v <> 'NA'").agg(F.min("i").alias("j")).select(F.lit(0).alias("i"), "j")
    return w.backward_path(known, run, [(at[x], 0) for x in ("class", "chance", "total", "odds", "model", "features", "turned", "subjects")]).cells


@query("relapse_spread", f"WITH {PREDICTED}, s AS (SELECT i, any_value(cls) AS cls, sum(lo) AS x FROM p GROUP BY i), g AS (SELECT CASE WHEN x > 0 THEN 'Y' ELSE 'N' END AS pred, cls FROM s GROUP BY 1, 2) SELECT CAST(0 AS BIGINT) AS i, CAST(row_number() OVER (ORDER BY pred, cls) - 1 AS BIGINT) AS j FROM g")
def relapse_spread(spark, sf):
    """Forward from ten subjects' priorities and prices to the verdict: by way of the evidence, every group."""
    w, at, run = relapse(spark, sf, ("model", "odds", "class", "verdict"))
    some = spark.range(10, 20).select(F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("i"), (F.col("id") + SKIP).alias("j"))
    return w.forward_path(some, run, [(at[x], 0) for x in ("subjects", "turned", "features", "model", "odds", "total", "chance", "class", "verdict")]).cells


# --- gene vote ----------------------------------------------------------------------------------

VOTE = {
    "clean": (core.Clean, ["training"]),
    "fresh": (core.Clean, ["test"]),
    "dull": (expression.GeneFilter, ["clean"]),
    "logs": (core.NormalizeTrain, ["clean"]),
    "noise": (expression.Correlate, ["clean", "n"]),
    "t": (expression.TTest, ["logs", "n"]),
    "stats": (expression.GenStats, ["logs", "n"]),
    "level": (expression.NormalizeTest, ["fresh", "stats"]),
    "mask_noise": (expression.PredictorMask, ["dull", "noise"]),
    "mask_t": (expression.PredictorMask, ["dull", "t"]),
    "vote_noise": (expression.PredictVote, ["level", "noise", "mask_noise"]),
    "vote_t": (expression.PredictVote, ["level", "t", "mask_t"]),
}


def gene_vote(spark, sf) -> tuple[Workflow, dict, int]:
    w, at = build(VOTE, {"training": genes(spark, sf), "test": genes(spark, sf), "n": const(spark, [[27]])})
    return w, at, w.run(keep=(at["level"],))


VOTED = f"""{GENES}, c AS (SELECT i, j, greatest(least(v, 16000.0), 100.0) AS v FROM e), l AS (SELECT i, j, log10(v) AS v FROM c),
 cs AS (SELECT i, avg(v) FILTER (j < 27) AS m1, avg(v) FILTER (j >= 27) AS m2, stddev_pop(v) FILTER (j < 27) AS s1, stddev_pop(v) FILTER (j >= 27) AS s2, max(v) <= 5 * min(v) OR max(v) - min(v) <= 500 AS dull FROM c GROUP BY i),
 ls AS (SELECT i, avg(v) AS m, stddev_pop(v) AS sd, avg(v) FILTER (j < 27) AS m1, avg(v) FILTER (j >= 27) AS m2 FROM l GROUP BY i),
 lev AS (SELECT l.i, l.j, l.v - m / sd - ((m1 + m2) / 2 - m) / sd AS v FROM l JOIN ls USING (i)),
 k AS (SELECT i, (m1 - m2) / (s1 + s2) AS w FROM cs WHERE NOT dull),
 t AS ((SELECT i FROM k ORDER BY w DESC, i LIMIT 25) UNION (SELECT i FROM k ORDER BY w ASC, i DESC LIMIT 25))"""


@query("gene_vote", f"WITH {VOTED} SELECT j AS i, CAST(c AS BIGINT) AS j, round(CASE c WHEN 0 THEN CASE WHEN a > b THEN 1.0 ELSE 0.0 END ELSE abs(a - b) / (a + b) END, 6) AS v FROM (SELECT j, sum(greatest(v * w, 0)) AS a, -sum(least(v * w, 0)) AS b FROM lev JOIN k USING (i) JOIN t USING (i) GROUP BY j), range(2) z(c)")
def gene_vote_cells(spark, sf):
    w, at, run = gene_vote(spark, sf)
    return w.output(at["vote_noise"], run).with_values(F.round("v", 6)).df


@query("gene_origin", f"WITH {GENES} SELECT i, j FROM e")
def gene_origin(spark, sf):
    """Back from one patient's vote: every test value, since normalization looks at whole rows."""
    w, at, run = gene_vote(spark, sf)
    return w.backward_path(spark.createDataFrame([(0, 0)], "i long, j long"), run, [(at["vote_noise"], 0), (at["level"], 0), (at["fresh"], 0)]).cells
