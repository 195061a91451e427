"""Pricing regressions, joint tests and summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.dense import f_survival
from loomline.operators.moments import collect_moments, period_moments

SINGULAR = 1e-12
PRICING_SCHEMA = "asset string, alpha double, t_stat double, betas array<double>, r2 double, n int"


def price_test_assets(returns: DataFrame, factors: DataFrame, K: int, hac_lags: int | None = None) -> DataFrame:
    """Regression of each asset's period return on the factors: alpha, its t, betas and R2.

    ``returns`` is (t_idx, asset, y) and ``factors`` (t_idx, f). Cross products
    are sums of the JVM and only one short row per asset is solved. With ``hac_lags``
    the t of alpha is robust to heteroskedasticity and autocorrelation (Bartlett
    weights, no small-sample factor). Assets with fewer than K + 2 periods have NULL results.
    """
    rows = returns.where("y IS NOT NULL").join(factors, "t_idx").select("asset", "t_idx", "y", "f")
    x = [F.lit(1.0)] + [F.col("f")[k] for k in range(K)]
    products = [F.sum(x[i] * x[j]) for i in range(K + 1) for j in range(K + 1)]
    sums = rows.groupBy("asset").agg(
        F.count("*").alias("n"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.array(*products).alias("xx"), F.array(*[F.sum(c * F.col("y")) for c in x]).alias("xy")
    )

    def solve(batches):
        for batch in batches:
            out = [_plain_row(a, int(n), yy, np.reshape(xx, (K + 1, K + 1)), np.asarray(xy, float)) for a, n, yy, xx, xy in zip(batch["asset"], batch["n"], batch["yy"], batch["xx"], batch["xy"])]
            yield pd.DataFrame(out, columns=["asset", "alpha", "t_stat", "betas", "r2", "n"])

    plain = sums.mapInPandas(solve, PRICING_SCHEMA)
    return plain if hac_lags is None else _with_robust_errors(rows, sums.select("asset", "xx"), plain, K, hac_lags)


def _with_robust_errors(rows: DataFrame, squares: DataFrame, plain: DataFrame, K: int, lags: int) -> DataFrame:
    """Replaces the t of alpha by its robust form.

    A period's score is u = x e. With g the Bartlett-weighted sum of the scores
    before it, the middle of the sandwich is the sum of uu' + ug' + gu', so one
    window per asset and one grouped sum hold all lags.
    """
    line = plain.where("alpha IS NOT NULL").select("asset", F.concat(F.array("alpha"), "betas").alias("b"))
    x = F.concat(F.array(F.lit(1.0)), "f")
    error = F.col("y") - F.aggregate(F.zip_with(x, "b", lambda p, q: p * q), F.lit(0.0), lambda p, q: p + q)
    scores = rows.join(line, "asset").withColumn("e", error).withColumn("u", F.transform(x, lambda p: p * F.col("e")))
    order = Window.partitionBy("asset").orderBy("t_idx")

    def earlier(i: int):
        terms = [F.coalesce(F.lag(F.col("u")[i], j).over(order), F.lit(0.0)) * (1 - j / (lags + 1)) for j in range(1, lags + 1)]
        return sum(terms, F.lit(0.0))

    scores = scores.select("asset", "u", F.array(*[earlier(i) for i in range(K + 1)]).alias("g"))
    u, g = F.col("u"), F.col("g")
    middle = scores.groupBy("asset").agg(F.array(*[F.sum(u[i] * u[j] + u[i] * g[j] + g[i] * u[j]) for i in range(K + 1) for j in range(K + 1)]).alias("middle"))

    def deviation(batches):
        for batch in batches:
            out = []
            for xx, mid in zip(batch["xx"], batch["middle"]):
                bread = np.linalg.pinv(np.reshape(xx, (K + 1, K + 1)))[0]
                out.append(float(np.sqrt(max(bread @ np.reshape(mid, (K + 1, K + 1)) @ bread, 0.0))))
            yield pd.DataFrame({"asset": batch["asset"], "se": out})

    robust = middle.join(squares, "asset").mapInPandas(deviation, "asset string, se double")
    t_stat = F.when(F.col("se") > 0, F.col("alpha") / F.col("se"))
    return plain.join(robust, "asset", "left").select("asset", "alpha", t_stat.alias("t_stat"), "betas", "r2", "n")


def _plain_row(asset, n: int, yy: float, xx: np.ndarray, xy: np.ndarray):
    """OLS with classical errors from cross products."""
    k = len(xy) - 1
    if n < k + 2:
        return asset, None, None, None, None, n
    inverse = np.linalg.pinv(xx)
    coef = inverse @ xy
    rss = max(yy - coef @ xy, 0.0)
    spread = yy - xy[0] ** 2 / n
    se = np.sqrt(max(inverse[0, 0] * rss / max(n - k - 1, 1), 0.0))
    return asset, coef[0], coef[0] / se if se > 0 else None, coef[1:].tolist(), 1 - rss / spread if spread > 0 else None, n


def joint_alpha_test(returns: DataFrame, factors: DataFrame, n_assets: int, K: int) -> DataFrame:
    """F test that all alphas are zero, on the periods in which every asset is observed.

    All regressions share their regressors, so alphas and the residual covariance
    come from one cross-product matrix of (1, factors, returns), summed by Spark.
    The statistic is NULL unless T > N + K + 1 and both covariances are regular;
    that bound also limits the matrix.
    """
    spark = returns.sparkSession
    schema = "f_stat double, p_value double, n_periods int, n_assets int"
    packed = returns.where("y IS NOT NULL").groupBy("t_idx").agg(F.sort_array(F.collect_list(F.struct("asset", "y"))).alias("a"))
    full = packed.where(F.size("a") == n_assets).join(factors, "t_idx")
    x = F.concat(F.array(F.lit(1.0)), "f", F.transform("a", lambda s: s["y"]))
    n_periods = full.count()
    none = spark.createDataFrame([(None, None, n_periods, n_assets)], schema)
    if n_periods <= n_assets + K + 1:
        return none
    rows = full.select(F.lit(0).alias("t_idx"), F.lit(0.0).alias("y"), x.alias("x"))
    s = collect_moments(period_moments(rows), None).s[0]
    t, n = n_periods, n_assets
    # Regressors and returns about their means: the factors' block, the returns' block and what they share.
    mean = s[0, 1:] / t
    spread = s[1:, 1:] - t * np.outer(mean, mean)
    slopes = np.linalg.pinv(spread[:K, :K], hermitian=True) @ spread[:K, K:]
    roots = [_root(spread[:K, :K] / t), _root((spread[K:, K:] - spread[K:, :K] @ slopes) / (t - K - 1))]
    if any(r is None for r in roots):
        return none
    alpha = mean[K:] - mean[:K] @ slopes
    ahead, left = (float(np.square(np.linalg.solve(r, x)).sum()) for r, x in zip(roots, (mean[:K], alpha)))
    stat = t * (t - n - K) / (n * (t - K - 1)) * left / (1 + ahead)
    return spark.createDataFrame([(stat, f_survival(stat, n, t - n - K), n_periods, n_assets)], schema)


def _root(m: np.ndarray) -> np.ndarray | None:
    """Cholesky factor of a covariance, or None where it has none or is singular to working precision."""
    try:
        root = np.linalg.cholesky(0.5 * (m + m.T))
    except np.linalg.LinAlgError:
        return None
    power = np.linalg.svd(root, compute_uv=False)
    return root if power[-1] ** 2 > SINGULAR * power[0] ** 2 else None


def pricing_summary(tests: DataFrame, t_crit: float = 1.96) -> DataFrame:
    """Mean absolute alpha and t, and the share of significant alphas, over fitted assets."""
    return tests.agg(
        F.count("*").alias("n_assets"), F.avg(F.abs("alpha")).alias("avg_abs_alpha"), F.avg(F.abs("t_stat")).alias("avg_abs_t"),
        F.avg((F.abs("t_stat") > t_crit).cast("double")).alias("frac_significant"),
    )


def factor_correlations(left: DataFrame, right: DataFrame, key: str, min_obs: int = 3) -> DataFrame:
    """Pairwise-complete correlation of every factor with every other series.

    Both sides are (key, name, value) and join on the key; a key meets one row per
    series, and the sums behind each correlation combine map-side.
    """
    a = left.where("value IS NOT NULL").select(key, F.col("name").alias("factor"), F.col("value").alias("a"))
    b = right.where("value IS NOT NULL").select(key, F.col("name").alias("other"), F.col("value").alias("b"))
    pairs = a.join(b, key).groupBy("factor", "other").agg(F.corr("a", "b").alias("c"), F.count("*").alias("n"))
    return pairs.select("factor", "other", F.when(F.col("n") >= min_obs, F.col("c")).alias("corr"), "n")


def placebo_counts(selected: DataFrame, reference: DataFrame) -> DataFrame:
    """Placebos among the selected topics and the overlap of the real ones with a reference set.

    Both inputs have one ``topic`` per row.
    """
    from loomline.operators.shocks import PLACEBO_PATTERN

    fake = F.col("topic").rlike(f"^{PLACEBO_PATTERN}$")
    both = selected.withColumn("now", F.lit(1)).join(reference.withColumn("ref", F.lit(1)), "topic", "full")
    real = F.when(~fake, 1)
    return both.agg(
        F.count(F.when(fake & (F.col("now") == 1), 1)).alias("n_placebo"),
        F.count(F.when(~fake & (F.col("now") == 1), 1)).alias("n_real"),
        F.coalesce(F.try_divide(F.count(F.when((F.col("now") == 1) & (F.col("ref") == 1), real)).cast("double"), F.count(real)), F.lit(1.0)).alias("jaccard"),
    )
