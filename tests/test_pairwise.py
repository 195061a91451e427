"""Pairwise-complete moments by tiles."""

import numpy as np
import pandas as pd
import pytest

from loomline.operators import scoring


@pytest.mark.parametrize("tile", [3, 128])
def test_tiles_against_pandas(spark, monkeypatch, tile):
    monkeypatch.setattr(scoring, "PART_KEYS", 20)
    rng = np.random.default_rng(4)
    wide = pd.DataFrame(rng.standard_normal((70, 8)) * 10.0 ** rng.integers(-3, 4, 8), columns=[f"s{i}" for i in range(8)])
    wide = wide.mask(rng.random(wide.shape) < 0.4)
    wide["s7"] = np.where(np.arange(70) < 2, wide["s7"], np.nan)
    wide["flat"] = 1.0
    long = wide.rename_axis("day").reset_index().melt("day", var_name="name", value_name="value")
    table = spark.createDataFrame([(int(r.day), r.name_, None if np.isnan(r.value) else float(r.value)) for r in long.rename(columns={"name": "name_"}).itertuples()], "day long, name string, value double")
    got = scoring.pairwise_correlation(table, "day", "name", "value", list(wide.columns), tile=tile).toPandas().set_index(["a", "b"])
    names, seen = sorted(wide.columns), 0
    for x, a in enumerate(names):
        for b in names[x + 1:]:
            both = wide[[a, b]].dropna()
            if not len(both):
                assert (a, b) not in got.index
                continue
            row, seen = got.loc[(a, b)], seen + 1
            assert row["n"] == len(both) and row["cov"] == pytest.approx(np.cov(both.T, ddof=0)[0, 1] if len(both) > 1 else 0, rel=1e-6, abs=1e-9)
            want = both[a].corr(both[b]) if len(both) >= 3 and "flat" not in (a, b) else np.nan
            assert row["corr"] == pytest.approx(want, rel=1e-6, abs=1e-9, nan_ok=True)
    assert len(got) == seen
