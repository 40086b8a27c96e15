"""Strategies, cost models by value, prediction, and the exact choice."""

import itertools

import pytest

from cellweave.plans import calibrate, cost
from cellweave.plans.cost import Shape, Volume, disk_model, fit, query_model, volume, write_model
from cellweave.plans.optimizer import Choice, History, Predictor, choose, latest, optimize
from cellweave.plans.strategy import COMPOSITE, MAP, NOOP, QUERY, STAT, Desc, Mode, Spec, Strategy, candidates


def test_names_and_equality():
    assert [str(s) for s in (QUERY, MAP, NOOP, STAT)] == ["Q", "MAP", "NOOP", "STAT"]
    assert str(Strategy.single(Mode.PTR, Spec.ONE, Spec.KEY)) == "ONE_KEY_b"
    assert str(Strategy.single(Mode.PTR, Spec.MANY, Spec.MANY, False)) == "MANY_MANY_f"
    assert str(Strategy.single(Mode.PT_MAPFUNC, Spec.ONE, Spec.BIN)) == "PTMAP_ONE_BIN"
    assert str(Strategy.single(COMPOSITE, Spec.ONE, Spec.BIN)) == "MAP__PTMAP_ONE_BIN"
    every = candidates()
    assert len(every) == 46 == len(set(every)) == len(set(map(str, every)))
    assert Strategy.single(Mode.PTR, Spec.ONE, Spec.KEY) == Strategy.single(Mode.PTR, Spec.ONE, Spec.KEY)


S = Shape(fanin=100, fanout=25, density=0.5, noutput=1000)
ONE, MANY = Strategy.single(Mode.PTR, Spec.ONE, Spec.MANY), Strategy.single(Mode.PTR, Spec.MANY, Spec.MANY)


def test_volumes_count_what_a_layout_writes():
    made = lambda mode, out, inp, back=True: volume(Desc(mode, out, inp, back), S)
    assert made(Mode.PTR, Spec.MANY, Spec.MANY) == Volume(1, 1000, 4000, 0, 0)
    assert made(Mode.PTR, Spec.ONE, Spec.MANY) == Volume(1, 1000, 4000, 96_000, 0)
    assert made(Mode.PTR, Spec.ONE, Spec.MANY, False) == Volume(1, 4000, 1000, 99_000, 0)
    assert made(Mode.PTR, Spec.ONE, Spec.KEY) == Volume(2, 1000, 4000, 0, 1040)
    assert made(Mode.PTR, Spec.MANY, Spec.KEY) == Volume(2, 1000, 4000, 0, 80)
    assert made(Mode.PTR, Spec.MANY, Spec.GRID) == Volume(1, 1000, 40 * 104, 0, 0)
    assert made(Mode.PTR, Spec.MANY, Spec.BOX) == Volume(1, 1000, 160, 0, 0)
    assert made(Mode.PT_MAPFUNC, Spec.ONE, Spec.BIN) == Volume(1, 1000, 2000, 0, 0)
    assert disk_model(QUERY, S) == disk_model(MAP, S) == write_model(QUERY, S) == write_model(NOOP, S) == 0
    assert disk_model(MANY, S) == pytest.approx(cost.BYTES["files"] + 5000 * cost.BYTES["cells"])


def test_queries_against_a_layout_scan_all_of_it():
    ask = lambda s, back, n=10: query_model(s, S, 0.5, n, 2.0, 1e6, back)
    assert ask(QUERY, True) == pytest.approx(0.5 + 2e-5) and ask(Strategy(()), True) == cost.NO_LAYOUT
    w = cost.QUERY_S
    assert ask(ONE, True) == pytest.approx(w["tables"] + 1000 * w["scanned"] + 20 * w["matched"])
    assert ask(ONE, False) == pytest.approx(w["tables"] + 101_000 * w["scanned"] + 20 * w["matched"])
    fwd = Strategy.single(Mode.PTR, Spec.ONE, Spec.MANY, False)
    both = Strategy(ONE.buckets + fwd.buckets)
    assert ask(both, True) == ask(ONE, True) and ask(both, False) == ask(fwd, False) < ask(ONE, False)
    box = Strategy.single(Mode.PTR, Spec.MANY, Spec.BOX)
    assert query_model(box, S, 8.0, 10, 2.0, 400, True) == pytest.approx(query_model(box, S, 0.0, 10, 2.0, 400, True) + 8.0 * 200 / 400)


def test_fit_finds_the_weights_and_keeps_them_above_zero():
    terms = [{"a": x, "b": y, "c": x * y} for x, y in itertools.product((1, 2, 5), (3, 4, 9))]
    assert fit(terms, [2 * t["a"] + 0.5 * t["b"] for t in terms]) == pytest.approx({"a": 2.0, "b": 0.5, "c": 0.0}, abs=1e-9)
    assert fit(terms, [max(0.1, 9 * t["a"] - t["b"]) for t in terms])["b"] >= 0


def test_calibration_follows_measured_stores(spark):
    rows = calibrate.measure_stores(spark, ((50, 9, 1), (400, 4, 5)), (Desc(Mode.PTR, Spec.ONE, Spec.MANY), Desc(Mode.PTR, Spec.MANY, Spec.KEY)), n_query=10)
    weights = calibrate.calibrate(rows, n_query=10)
    assert {k: set(v) for k, v in weights.items()} == {k: set(getattr(cost, k)) for k in ("BYTES", "CAPTURE", "QUERY_S")}
    for d, s, size, *_ in rows:
        assert cost.weigh(cost.byte_terms(d, s), weights["BYTES"]) == pytest.approx(size, rel=0.6)


def test_write_costs_grow_with_output_and_are_nothing_for_free_modes():
    for c in candidates():
        small, large = write_model(c, Shape(9, 4, 1.0, 100)), write_model(c, Shape(9, 4, 1.0, 10_000))
        assert (small, large) == (0, 0) if c.modes <= {Mode.QUERY, Mode.FULL_MAPFUNC} else 0 < small < large


def test_latest():
    assert latest([None, 3.0, 9.0]) == 3.0 and latest([]) == 1_000_000 and latest([2.0, 4.0], alpha=0.5) == 3.0


def test_choice_is_exact():
    import random

    r = random.Random(3)
    for _ in range(30):
        groups = [[Choice(k, QUERY, r.random(), r.random(), r.random()) for _ in range(4)] for k in range(4)]
        disk, write = r.uniform(0.5, 3), r.uniform(0.5, 3)
        best = min((sum(c.cost for c in p) for p in itertools.product(*groups) if sum(c.disk for c in p) <= disk and sum(c.write for c in p) <= write), default=None)
        got = choose(groups, disk, write)
        assert (got is None) == (best is None)
        if got:
            assert sum(c.cost for c in got) == pytest.approx(best) and [c.op for c in got] == [0, 1, 2, 3]


def test_optimizer_spends_disk_only_where_allowed():
    stats = {("a", 0): (100, 900, 1.0, 1, 1e5, 1000, 1e6, 1e6, 5.0), ("m", 0): (1, 1, 1.0, 1, 10, 10, 10, 10, 0.1)}
    hist = {k: History([(1.0, 0, 10.0)], [(100.0, 9, 10.0)]) for k in stats}
    p = Predictor(stats, hist, {"a": ("PTR", "PTMAP"), "m": ("MAP", "PTR")})
    rich, _ = optimize(p, ["a", "m"], 1e9, 1e9)
    poor, dropped = optimize(p, ["a", "m"], 0.0, 0.0, stored=[(1, "a", Strategy.single(Mode.PTR, Spec.ONE, Spec.MANY), 3.0)])
    assert rich["m"] == MAP == poor["m"] and poor["a"] == QUERY and dropped == [("a", 1)]
    assert any(d.backward and d.mode in (Mode.PTR, Mode.PT_MAPFUNC) for d in rich["a"].descs)
    assert p.cheaper("a", 0, Strategy.single(Mode.PTR, Spec.ONE, Spec.MANY), True, 10) != QUERY
    assert p.cheaper("m", 0, ONE, True, 10) == QUERY  # running it again takes less than opening a store
    assert str(Desc(Mode.PTR, Spec.ONE, Spec.NONE)) == "ONE_-1_b"


def test_optimizer_reads_every_line_item_once(spark, monkeypatch):
    from cellweave import queries, stats

    seen, plain = [], stats.op_stats
    monkeypatch.setattr(stats, "op_stats", lambda t, eids: seen.append((t, eids)) or plain(t, eids))
    sf = "/root/testdata/sf0.001"
    assert queries.optimizer(spark, sf).count() > 0
    t, eids = seen[0]
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert sorted(eids) == list(range(20))
    for name in ("workflow_run", "workflow_inputs", "capture_cost", "capture_shape"):
        assert t(name).count() == t(name).select("wid").distinct().count() == n
