"""Fits over moment tiles against fits on arrays."""

import numpy as np
import pandas as pd
import pytest

from loomline.operators import factor_model as fm
from loomline.operators import moments, tiles, tuning
from tests.test_factor_model import as_moments, make_panel

CFG = fm.FitConfig(K=2, n_lambdas=2, ratio=2e-1, tol=1e-7, warmup=1)


@pytest.fixture(scope="module")
def data(spark):
    t, x, y = make_panel(T=14, N=30, L=9, seed=3)
    rows = spark.createDataFrame(pd.DataFrame({"t_idx": t.astype("int32"), "y": y, "x": list(x)})).repartition(5)
    return as_moments(t, x, y), rows


def test_tiles_are_the_cross_products(spark, data):
    held, rows = data
    for made in (tiles.moment_tiles(rows, 4), tiles.tiles_of(moments.period_moments(rows), 4)):
        table, head = made
        assert table.count() == 14 * 6
        for r in table.where("t_idx in (0, 7)").collect():
            want = held.s[r["t_idx"]][r["i"] * 4:r["i"] * 4 + 4, r["j"] * 4:r["j"] * 4 + 4]
            assert np.reshape(r["s"], want.shape) == pytest.approx(want)
        assert head.v == pytest.approx(held.v) and head.sigma() == pytest.approx(held.sigma()) and head.n.tolist() == held.n.tolist()


def test_path_is_that_of_arrays(spark, data):
    held, rows = data
    want = [f for k in (1, 2) for f in fm.fit_path(fm.ArrayPeriods(held), fm.replace(CFG, K=k))]
    got = tiles.tiled_path(rows, CFG, (1, 2), 4)
    assert [f.lam for f in got] == pytest.approx([f.lam for f in want], rel=1e-7)
    for a, b in zip(got, want):
        assert a.objective == pytest.approx(b.objective, rel=1e-6) and a.total_r2 == pytest.approx(b.total_r2, abs=1e-4) and a.pred_r2 == pytest.approx(b.pred_r2, abs=1e-4)
        assert list(a.selected) == list(b.selected)
        assert all(np.diff(a.path) <= 1e-9 * a.path[0])


def test_row_blocks_reach_a_stationary_point(spark, data, monkeypatch):
    """With the Gram matrix solved in two row blocks every row of loadings still meets its optimality condition, recomputed from the panel."""
    held, rows = data
    monkeypatch.setattr(tiles, "GRAM_BYTES", 1)
    lam, per = 3e-2, fm.ArrayPeriods(held)
    fit = tiles.tiled_path(rows, fm.replace(CFG, K=1, lambdas=(lam,), tol=1e-9), block=5)[0]
    assert all(np.diff(fit.path) <= 1e-9 * fit.path[0])
    assert fit.objective == pytest.approx(fm.fit_sparse(per, lam, fm.replace(CFG, K=1)).objective, rel=1e-5)
    g = fit.gamma * fit.sigma[:, None]
    now = per.run(g)
    grad = (now.gram @ g.ravel() - now.cross.ravel()).reshape(g.shape)
    pen, norm = lam * per.n_obs, np.linalg.norm(g, axis=1)
    assert np.all(np.linalg.norm(grad[norm == 0], axis=1) <= pen * (1 + 1e-6))
    assert np.abs(grad[norm > 0] + pen * g[norm > 0] / norm[norm > 0, None]).max() < 1e-2 * pen


def test_left_out_and_refits_match_tasks(spark, data, monkeypatch):
    held, rows = data
    m = moments.period_moments(rows)
    tune = tuning.TuneConfig(criterion="loocv", max_folds=2)
    cfg = fm.replace(CFG, K=1, lambdas=(3e-2,), tol=1e-5)
    oos = tuning.OosConfig(min_train=8, refit_every=6)
    plan = tuning.refit_schedule(spark.createDataFrame([(i, f"2000-01-{i + 1:02d}") for i in range(14)], "t_idx int, period string").selectExpr("t_idx", "to_date(period) as period"), oos)
    small = tuning.penalty_path(m, cfg, tune).orderBy("lam").toPandas(), tuning.run_out_of_sample(m, plan, cfg, oos=oos).orderBy("t_idx").toPandas()
    frozen = tuning.run_out_of_sample(m, plan, cfg, oos=tuning.OosConfig(min_train=8, refit_every=6, retune=False)).orderBy("t_idx").toPandas()
    monkeypatch.setattr(tuning, "collect_moments", lambda moments: None)
    large = tuning.penalty_path(m, cfg, tune).orderBy("lam").toPandas(), tuning.run_out_of_sample(m, plan, cfg, oos=oos).orderBy("t_idx").toPandas()
    again = tuning.run_out_of_sample(m, plan, cfg, oos=tuning.OosConfig(min_train=8, refit_every=6, retune=False)).orderBy("t_idx").toPandas()
    assert large[0]["criterion"].to_numpy() == pytest.approx(small[0]["criterion"].to_numpy(), rel=1e-3)
    assert large[0]["objective"].to_numpy() == pytest.approx(small[0]["objective"].to_numpy(), rel=1e-7)
    for a, b in ((large[1], small[1]), (again, frozen)):
        assert a[["refit", "t_idx", "n_selected", "K"]].equals(b[["refit", "t_idx", "n_selected", "K"]])
        assert a["lam"].to_numpy() == pytest.approx(b["lam"].to_numpy()) and a["mve"].to_numpy() == pytest.approx(b["mve"].to_numpy(), rel=1e-3, abs=1e-4)


def test_gradient_from_tiles(spark, data):
    held, rows = data
    g, per = np.random.default_rng(1).standard_normal((10, 2)), fm.ArrayPeriods(held)
    table, head = tiles.moment_tiles(rows, 4)
    states, grads = tiles.TileSweeps(table, head, 4).gradients({0: (tiles.Window(head), g), 1: (tiles.Window(head, np.arange(14) > 3), g[:, :1])})
    now = per.run(g)
    assert grads[0] == pytest.approx((now.gram @ g.ravel() - now.cross.ravel()).reshape(g.shape)) and states[0].ssr == pytest.approx(now.ssr)
    part = fm.ArrayPeriods(held.subset(np.arange(14) > 3))
    now = part.run(g[:, :1])
    assert grads[1] == pytest.approx((now.gram @ g[:, 0] - now.cross.ravel())[:, None]) and states[1].f_outer == pytest.approx(now.f_outer)
