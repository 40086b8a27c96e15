"""Operators against numpy and hand-worked values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.array import ArrayMeta, CellArray
from cellweave.operators import core, evidence, expression, stencil, trajectory
from cellweave.operators.cluster import Cluster

TINY = [[0, 0, 1, 1], [0, 0, 0, 1], [1, 0, 0, 0], [1, 1, 0, 0]]


def arr(spark, rows, dtype="double"):
    return CellArray.from_matrix(spark, rows, dtype)


def mat(a):
    return np.array(a.to_matrix(), float)


def test_flat_list_is_one_row(spark):
    assert arr(spark, [1, 2, 3]).meta == ArrayMeta(1, 3)


def test_small_pipeline_golden(spark):
    a = arr(spark, TINY)
    mean = core.Mean().compute([a])
    assert np.allclose(mat(mean), 0.375)
    diff = core.Diff().compute([a, mean])
    conv = stencil.Convolve().compute([diff, arr(spark, [[1] * 3] * 3)])
    want = [[-1.5, -1.25, 0.75, 1.5], [-1.25, -1.375, -0.375, 0.75], [0.75, -0.375, -1.375, -1.25], [1.5, 0.75, -1.25, -1.5]]
    assert np.allclose(mat(conv), want)
    got = mat(Cluster().compute([conv, arr(spark, [[0.5, 0.5]])]))
    groups = {v: {tuple(map(int, c)) for c in np.argwhere(got == v)} for v in set(got.ravel()) - {0}}
    assert sorted(map(sorted, groups.values())) == [[(0, 2), (0, 3), (1, 3)], [(2, 0), (3, 0), (3, 1)]]


def test_concave_region_is_one_cluster_across_tiles(spark):
    u = np.zeros((9, 9))
    u[:, 0] = u[:, 8] = u[8, :] = 1
    a = arr(spark, u.tolist())
    from cellweave.operators.cluster import regions

    found = {(r.i, r.j): r.label for r in regions(a.df.filter("v > 0").select("i", "j"), a.meta, tile=3).collect()}
    assert len(found) == int(u.sum()) and set(found.values()) == {0}


def test_scalar_ops_and_masks(spark):
    a, b = arr(spark, [[1, 0], [3, 4]]), arr(spark, [[0, 0], [1, 0]])
    assert mat(core.DiffSingleVal().compute([a, arr(spark, [[2, 9]])])).tolist() == [[-1, -2], [1, 2]]
    assert mat(core.BadPixRemoval().compute([a, b])).tolist() == [[1, 90], [90, 4]]
    assert mat(core.LogicalAnd().compute([a, b])).tolist() == [[0, 0], [1, 0]]
    assert core.Div().compute([a, b]).to_matrix() == [[None, None], [3.0, None]]
    assert mat(core.Clip(lambda v: v > 2).compute([a])).tolist() == [[0, 0], [3, 4]]
    assert core.MeanSingleVal().compute([a]).to_matrix() == [[2.0]]
    with pytest.raises(ValueError):
        core.Add().compute([a, arr(spark, [[1, 2, 3]])])


def test_slice_transpose_take_python(spark):
    x = np.arange(30).reshape(5, 6)
    a = arr(spark, x.tolist())
    s = core.Subsample(((1, 4), (2, 9))).compute([a])
    assert s.meta == ArrayMeta(3, 4) and np.array_equal(mat(s), x[1:4, 2:9])
    assert np.array_equal(mat(core.Transpose().compute([a])), x.T)
    assert np.array_equal(mat(core.take(a, cols=[5, 0, 5])), x[:, [5, 0, 5]])
    assert np.array_equal(mat(core.OneToOne(core.python_cell(lambda v: v**2)).compute([a])), x**2)


@pytest.mark.parametrize("size", [3, 5])
def test_median_and_wide_convolution_on_tiles(spark, size):
    rng = np.random.default_rng(size)
    x = rng.integers(0, 50, (11, 13)).astype(float)
    a = arr(spark, x.tolist())
    p = np.pad(x, size // 2, mode="reflect")
    want = np.median(np.lib.stride_tricks.sliding_window_view(p, (size, size)), axis=(2, 3))
    got = CellArray(stencil.on_tiles(a.df, a.meta, size, lambda b: stencil.median_block(b, size), tile=4), a.meta)
    assert np.array_equal(mat(got), want)
    k = rng.integers(-3, 4, (7, 7)).astype(float)
    z = np.pad(x, 3)
    slow = np.array([[sum(k[r, c] * z[i + 6 - r, j + 6 - c] for r in range(7) for c in range(7)) for j in range(13)] for i in range(11)])
    assert np.allclose(mat(stencil.Convolve().compute([a, arr(spark, k.tolist())])), slow)


def test_resampling(spark):
    a = arr(spark, [[1.9, 2], [3, 4]])
    up = stencil.upsample2(a)
    assert np.array_equal(mat(up), np.repeat(np.repeat([[1, 2], [3, 4]], 2, 0), 2, 1))
    assert mat(stencil.rebin(up)).tolist() == [[1, 2], [3, 4]]
    with pytest.raises(ValueError):
        stencil.rebin(arr(spark, [[1, 2, 3]]))


def test_cosmic_rays_tiles_agree_with_one_block_and_are_removed(spark):
    x = np.random.default_rng(0).normal(100, 3, (40, 40))
    for i, j in ((5, 5), (20, 31), (39, 0)):
        x[i, j] = 5000
    a = arr(spark, x.tolist())
    lap = np.array([[0, -1, 0], [-1, 4, -1], [0, -1, 0]], float)
    whole = stencil.cosmic_block(x, lap)
    assert whole[5, 5] and whole[20, 31] and whole.sum() < 40
    tiled = stencil.on_tiles(a.df, a.meta, stencil.CR_HALO, lambda b: stencil.cosmic_block(b, lap), tile=16)
    assert np.array_equal(mat(CellArray(tiled, a.meta)) > 0, whole)
    mask = stencil.CRDetect().compute([a, arr(spark, lap.tolist())])
    clean = mat(stencil.RemoveCRs().compute([a, mask]))
    assert clean.max() < 200 and np.array_equal(clean[~whole], x[~whole])


def test_masked_cell_without_neighbours_is_an_error(spark):
    a = arr(spark, [[1, 2], [3, 4]])
    with pytest.raises(Exception, match="no unmasked neighbour"):
        stencil.RemoveCRs().compute([a, arr(spark, [[1, 1], [1, 1]])]).df.collect()


def test_evidence_smoothing_and_prediction(spark):
    md = arr(spark, [["Y", "a", "x"], ["N", "b", "x"], ["Y", "a", "NA"], ["NA", "b", "y"], ["N", "a", "y"]], "string")
    sub = spark.createDataFrame([(k, "c1" if k < 3 else "c2") for k in range(5)], "i long, s string")
    types = ["target.feature", "clinical", "pathway.dep.outcome"]
    ev = {(r.k, r.k1, r.k2): r.logodds for r in evidence.build_evidence(md, sub, types).collect()}
    assert math.isclose(ev[0, "", ""], math.log((2 + 2) / (2 + 2)))
    ya, na, yb, nb = 2 + 2, 1 + 2, 0 + 2, 1 + 2
    assert math.isclose(ev[1, "a", ""], math.log(ya / na) - math.log((ya + yb) / (na + nb)))
    assert math.isclose(ev[1, "b", ""], math.log(yb / nb) - math.log((ya + yb) / (na + nb)))
    assert len([k for k in ev if k[0] == 2]) == 4
    p = evidence.predict_logodds(evidence.build_evidence(md, sub, types), md, sub, types).collect()
    by = {(r.i, r.k): (r.idx, r.logodds) for r in p}
    assert by[3, 0] == (None, 0.0) and by[2, 2] == (None, 0.0) and math.isclose(by[0, 1][1], ev[1, "a", ""]) and len(by) == 15


def test_gene_scores(spark):
    x = np.random.default_rng(1).uniform(50, 9000, (6, 9))
    a, n = arr(spark, x.tolist()), arr(spark, [[4]])
    z = (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True)
    snr = (z[:, :4].mean(1) - z[:, 4:].mean(1)) / (z[:, :4].std(1) + z[:, 4:].std(1))
    assert np.allclose(mat(expression.Correlate().compute([a, n]))[:, 0], snr)
    q = ((x[:, :4] ** 2).sum(1) + (x[:, 4:] ** 2).sum(1) - 4 * x[:, :4].mean(1) ** 2 - 5 * x[:, 4:].mean(1) ** 2) / 7
    assert np.allclose(mat(expression.TTest().compute([a, n]))[:, 0], (x[:, :4].mean(1) - x[:, 4:].mean(1)) / q / math.sqrt(1 / 4 + 1 / 5))
    st = mat(expression.GenStats().compute([a, n]))
    b = (z[:, :4].mean(1) + z[:, 4:].mean(1)) / 2
    assert np.allclose(st, np.stack([x.mean(1), x.std(1), b], 1))
    norm = mat(expression.NormalizeTest().compute([a, expression.GenStats().compute([a, n])]))
    assert np.allclose(norm, np.log10(x) - (x.mean(1) / x.std(1))[:, None] - b[:, None])
    drop = [bool(v) for v in mat(expression.GeneFilter().compute([a]))[:, 0]]
    assert drop == [bool(r.max() / r.min() <= 5 or r.max() - r.min() <= 500) for r in x]
    mask = expression.PredictorMask().compute([expression.GeneFilter().compute([a]), expression.Correlate().compute([a, n])])
    assert [bool(v) for v in mat(mask)[:, 0]] == [not d for d in drop]
    vote = mat(expression.PredictVote().compute([a, expression.Correlate().compute([a, n]), mask]))
    w = np.where(drop, 0, snr)[:, None] * x
    up, down = np.maximum(w, 0).sum(0), -np.minimum(w, 0).sum(0)
    assert np.allclose(vote, np.stack([up > down, abs(up - down) / (up + down)], 1))


def test_segments_flush_every_id_and_drop_short_ones(spark):
    rows = [("a", t, float(k)) for k, t in enumerate([0, 60, 100, 100, 400, 410, 900])] + [("b", t, 1.0) for t in (5, 50)]
    s = trajectory.segments(spark.createDataFrame(rows, "id string, ts long, v double"))
    got = {}
    for r in s.collect():
        got.setdefault((r.id, r.seg), []).append(r.ts)
    assert {k: sorted(v) for k, v in got.items()} == {("a", 0): [0, 60, 100], ("b", 0): [5, 50]}
    total = {(r.id, r.seg): r.v for r in trajectory.per_segment(s, F.col("v")).collect()}
    assert total["b", 0] == 2.0
    assert trajectory.sources_of(s, s.filter("id = 'b'")).count() == 2
    loose = trajectory.segments(spark.createDataFrame(rows, "id string, ts long, v double"), last_only=True)
    assert loose.filter("id = 'a'").select("seg").distinct().count() == 2
