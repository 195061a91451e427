"""Queries on period labels, fills, view tables and canonical correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions.columns import softmax
from loomline.operators import align, calendar, panel, scoring, views
from loomline.plans.catalog_lab import EDGES, edges
from loomline.plans.oracle import with_ctes
from loomline.plans.registry import query
from loomline.plans.tables import Tables, tidy


@query("aligned_observable", with_ctes("cal", """
    SELECT c.period_id, CAST(c.period_end AS VARCHAR) AS period_end, round(o.mean_price, 6) AS mean_price, o.n_orders
    FROM (SELECT DISTINCT period_id, period_end, period_start FROM cal) c JOIN obs o ON o.label = c.period_start""",
    obs="SELECT date_trunc('month', o_orderdate) AS label, avg(o_totalprice) AS mean_price, count(*) AS n_orders FROM orders GROUP BY 1"))
def aligned_observable(t: Tables):
    """A monthly series stamped on the last order day, weekend or not, on the periods of the return calendar."""
    month = F.date_trunc("month", "date")
    series = t.orders.groupBy(month.alias("m")).agg(F.max("date").alias("date"), F.avg("o_totalprice").alias("mean_price"), F.count("*").alias("n_orders"))
    return tidy(align.match_periods(series, t.calendar, "M", "mean_price", "n_orders"), 6)


@query("rf_backward_fill", with_ctes("rfm cal", """
    SELECT CAST(c.date AS VARCHAR) AS date, round(first_value(r.rf IGNORE NULLS) OVER (ORDER BY c.date ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING), 10) AS rf
    FROM cal c LEFT JOIN rfm r ON r.date = c.date"""))
def rf_backward_fill(t: Tables):
    return tidy(align.carry_backward(t.risk_free, t.calendar, "rf", 5), 10)


@query("idle_weekdays", with_ctes("cal", """
    SELECT CAST(d.date AS VARCHAR) AS date, c.date IS NOT NULL AS traded
    FROM (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM cal) d LEFT JOIN cal c ON c.date = d.date
    WHERE isodow(d.date) <= 5"""))
def idle_weekdays(t: Tables):
    """Every weekday from the first to the last trading day and whether it was one."""
    ends = t.calendar.agg(F.min("date").cast("string"), F.max("date").cast("string")).first()
    days = calendar.weekday_calendar(t.spark, *ends)
    return tidy(days.join(t.calendar.select("date", F.lit(True).alias("seen")), "date", "left").select("date", F.coalesce("seen", F.lit(False)).alias("traded")))


@query("replaced_instruments", with_ctes("panel", """
    SELECT t_idx, asset, round(y, 8) AS y, round(2 * x[2], 8) AS x2, len(x) AS width FROM panel WHERE t_idx % 2 = 0"""))
def replaced_instruments(t: Tables):
    """The panel with the instruments of every other period doubled; periods without new ones leave."""
    other = t.panel.where("t_idx % 2 = 0").select("period", "asset", F.transform("x", lambda v: 2 * v).alias("x"))
    got = panel.replace_instruments(t.panel, other)
    return tidy(got.select(F.col("t_idx").cast("long").alias("t_idx"), "asset", "y", F.col("x")[1].alias("x2"), F.size("x").cast("long").alias("width")))


@query("listed_universe", """
    SELECT n_name AS asset, r_name AS asset_class FROM nation JOIN region ON r_regionkey = n_regionkey
    WHERE r_regionkey <= 2 AND n_nationkey % 7 <> 3 AND n_nationkey <= 20""")
def listed_universe(t: Tables):
    """Nations of three regions, without some that are dropped and within a list."""
    nations = t.read("nation").join(t.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = lambda rows, c: [r[0] for r in rows.select(c).collect()]  # noqa: E731  one short list per parameter
    classes, drop, listed = name(t.read("region").where("r_regionkey <= 2"), "r_name"), name(nations.where("n_nationkey % 7 = 3"), "n_name"), name(nations.where("n_nationkey <= 20"), "n_name")
    return views.listed_subset(nations.select(F.col("n_name").alias("asset"), F.col("r_name").alias("asset_class")), classes, drop, listed)


@query("stacked_totals", """
    SELECT l_returnflag, measure, round(value, 4) AS value FROM (
      SELECT l_returnflag, sum(l_quantity) AS quantity, sum(CASE WHEN l_linestatus = 'O' AND l_returnflag <> 'A' THEN l_extendedprice END) AS open_price, avg(l_discount) AS discount
      FROM lineitem GROUP BY 1) UNPIVOT (value FOR measure IN (quantity, open_price, discount)) WHERE value IS NOT NULL""")
def stacked_totals(t: Tables):
    open_price = F.sum(F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") != "A"), F.col("l_extendedprice")))
    wide = t.read("lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").cast("double").alias("quantity"), open_price.cast("double").alias("open_price"), F.avg("l_discount").alias("discount"))
    return tidy(views.stack(wide, "l_returnflag", ["quantity", "open_price", "discount"], "measure", "value"), 4)


@query("trade_shares", with_ctes("", "SELECT topic, asset, round(qty / sum(qty) OVER (PARTITION BY topic), 9) AS share FROM edges", edges=EDGES))
def trade_shares(t: Tables):
    """Share of each brand in what a nation ships."""
    return tidy(views.share_of_total(edges(t).select("topic", "asset", "qty"), "qty", "topic").select("topic", "asset", "share"), 9)


@query("softmax_priorities", with_ctes("att", """
    SELECT CAST(date AS VARCHAR) AS date, topic, round(exp(level / 10 - m) / sum(exp(level / 10 - m)) OVER (PARTITION BY date), 9) AS share
    FROM (SELECT *, max(level / 10) OVER (PARTITION BY date) AS m FROM att)"""))
def softmax_priorities(t: Tables):
    """Softmax of the order counts of each day."""
    return tidy(t.attention.select("date", "topic", softmax(F.col("level") / 10, "date").alias("share")), 9)


@query("tie_band", """
    SELECT lam, round(criterion, 6) AS criterion, round(best - greatest(abs(best) * 0.02, 1e-9 * greatest(1, abs(best))), 6) AS floor,
      criterion >= best - greatest(abs(best) * 0.02, 1e-9 * greatest(1, abs(best))) AS in_band
    FROM (SELECT *, max(criterion) OVER () AS best FROM (SELECT l_linenumber AS lam, avg(l_extendedprice) AS criterion FROM lineitem GROUP BY 1))""")
def tie_band(t: Tables):
    """The band of near-best values of one curve."""
    path = t.read("lineitem").groupBy(F.col("l_linenumber").alias("lam")).agg(F.avg("l_extendedprice").alias("criterion"))
    return tidy(views.tie_band_chart(path, 0.02).select("lam", "criterion", "floor", "in_band"), 6)


_PAIRS = {"v": "SELECT CAST(embedding[1] AS DOUBLE) AS a1, CAST(embedding[2] AS DOUBLE) AS a2, CAST(embedding[3] AS DOUBLE) AS b1, CAST(embedding[4] AS DOUBLE) AS b2 FROM embeddings",
          "m": "SELECT count(*) AS n, " + ", ".join(f"covar_pop({x}, {y}) AS {x}{y}" for x in ("a1", "a2", "b1", "b2") for y in ("a1", "a2", "b1", "b2")) + " FROM v"}
# M = A^-1 C B^-1 C' for two columns a side; its eigenvalues are the squared correlations.
_PAIRS["q"] = "SELECT *, a1a1 * a2a2 - a1a2 * a1a2 AS da, b1b1 * b2b2 - b1b2 * b1b2 AS db FROM m"
_PAIRS["l"] = """SELECT n, (a2a2 * a1b1 - a1a2 * a2b1) / da AS p11, (a2a2 * a1b2 - a1a2 * a2b2) / da AS p12, (a1a1 * a2b1 - a1a2 * a1b1) / da AS p21, (a1a1 * a2b2 - a1a2 * a1b2) / da AS p22,
    (b2b2 * a1b1 - b1b2 * a1b2) / db AS q11, (b2b2 * a2b1 - b1b2 * a2b2) / db AS q12, (b1b1 * a1b2 - b1b2 * a1b1) / db AS q21, (b1b1 * a2b2 - b1b2 * a2b1) / db AS q22 FROM q"""
_PAIRS["e"] = """SELECT n, p11 * q11 + p12 * q21 + p21 * q12 + p22 * q22 AS tr, (p11 * p22 - p12 * p21) * (q11 * q22 - q12 * q21) AS det FROM l"""


@query("canonical_corr_two", with_ctes("", """
    SELECT k, round(sqrt(greatest(tr / 2 + CASE WHEN k = 1 THEN 1 ELSE -1 END * sqrt(greatest(tr * tr / 4 - det, 0)), 0)), 8) AS corr, n
    FROM e, (SELECT CAST(unnest([1, 2]) AS BIGINT) AS k)""", **_PAIRS))
def canonical_corr_two(t: Tables):
    """Both canonical correlations of the first two and the next two components of all vectors."""
    rows = t.read("embeddings").select(F.slice("embedding", 1, 2).alias("a"), F.slice("embedding", 3, 2).alias("b"))
    return tidy(scoring.canonical_correlations(rows, 2))


@query("canonical_corr_halves")
def canonical_corr_halves(t: Tables):
    """All canonical correlations of the two halves of all vectors."""
    rows = t.read("embeddings").select(F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    return tidy(scoring.canonical_correlations(rows, 32))
