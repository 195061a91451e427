"""Queries on series repair, scorecards and view tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomline.functions.columns import clip, serial_id, slug, truthy
from loomline.functions.session import bounded_list, materialise
from loomline.operators import align, calendar, cleaning, kernel, panel, scoring, shocks, views
from loomline.plans.catalog_lab import EDGES, edges
from loomline.plans.oracle import with_ctes
from loomline.plans.registry import query
from loomline.plans.tables import Tables, tidy

# Hourly series per event type: the smallest value, which jumps across units, and the count, which repeats.
HOURLY = "SELECT event_type AS series, date_trunc('hour', ts) AS tm, min(value) AS level, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1, 2"


def hourly(t: Tables):
    return t.read("events").groupBy(F.col("event_type").alias("series"), F.date_trunc("hour", "ts").alias("at")).agg(
        F.min("value").alias("level"), F.count("*").cast("double").alias("n"))


def stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query("fix_100x", with_ctes("", """
    SELECT series, strftime(tm, '%Y-%m-%d %H:%M:%S') AS "at", round(level / pow(100.0, unit - usual), 6) AS level, unit <> usual AS repaired
    FROM u JOIN (SELECT series, unit AS usual FROM (SELECT series, unit, row_number() OVER (PARTITION BY series ORDER BY count(*) DESC, unit) AS k FROM u GROUP BY 1, 2)
                 WHERE k = 1) m USING (series)""", h=HOURLY, d="SELECT *, log10(level) - lag(log10(level)) OVER (PARTITION BY series ORDER BY tm) AS d FROM h",
    u="""SELECT *, sum(CASE WHEN k <> 0 AND abs(d - 2 * k) < 0.35 THEN k ELSE 0 END) OVER (PARTITION BY series ORDER BY tm ROWS UNBOUNDED PRECEDING) AS unit
         FROM (SELECT *, round(d / 2) AS k FROM d)"""))
def fix_100x(t: Tables):
    return tidy(cleaning.repair_unit_slips(hourly(t).drop("n")).withColumn("at", stamp("at")), 6)


@query("repeated_prints", with_ctes("", """
    SELECT series, strftime(tm, '%Y-%m-%d %H:%M:%S') AS "at", n AS level FROM (
      SELECT *, lag(n) OVER (PARTITION BY series ORDER BY tm) AS p FROM h) WHERE p IS NULL OR p <> n""", h=HOURLY))
def repeated_prints(t: Tables):
    series = hourly(t).select("series", "at", F.col("n").alias("level"))
    return tidy(cleaning.drop_repeats(series).withColumn("at", stamp("at")))


@query("rolling_median", with_ctes("", """
    SELECT series, strftime(tm, '%Y-%m-%d %H:%M:%S') AS "at", round(level, 6) AS level, round(median(level) OVER (
      PARTITION BY series ORDER BY tm ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING), 6) AS median FROM h""", h=HOURLY))
def rolling_median(t: Tables):
    return tidy(cleaning.rolling_median(hourly(t).drop("n"), 10).withColumn("at", stamp("at")), 6)


def _tick_passes(k: float, floor: float, passes: int = 6) -> dict[str, str]:
    """The passes of the outlier rule, one group of subqueries each."""
    w, out = "PARTITION BY series ORDER BY tm", {"p0": "SELECT series, tm, n, ln(n) AS x FROM h"}
    for i in range(1, passes + 1):
        out[f"d{i}"] = f"SELECT *, x - lag(x) OVER w AS a, lead(x) OVER w - x AS b, abs(x - (lag(x) OVER w + lead(x) OVER w) / 2) AS off FROM p{i - 1} WINDOW w AS ({w})"
        out[f"s{i}"] = f"SELECT *, CASE WHEN count(a) OVER f >= 20 THEN 1.4826 * median(abs(a)) OVER f END AS sc FROM d{i} WINDOW f AS ({w} ROWS BETWEEN 62 PRECEDING AND 62 FOLLOWING)"
        out[f"l{i}"] = f"""SELECT *, coalesce(first_value(sc IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
            last_value(sc IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS c FROM s{i}"""
        out[f"b{i}"] = f"""SELECT *, CASE WHEN c IS NOT NULL AND sign(a) <> sign(b) AND least(abs(a), abs(b), off) > greatest({k} * c, {floor}) AND a IS NOT NULL AND b IS NOT NULL
            THEN off / greatest({k} * c, {floor}) ELSE 0 END AS pk FROM l{i}"""
        out[f"p{i}"] = f"""SELECT series, tm, n, x FROM (SELECT *, pk > 0 AND pk >= coalesce(lag(pk) OVER w, 0) AND pk >= coalesce(lead(pk) OVER w, 0) AS gone FROM b{i} WINDOW w AS ({w})) WHERE NOT gone"""
    return out


@query("bad_ticks", with_ctes("", "SELECT series, strftime(tm, '%Y-%m-%d %H:%M:%S') AS \"at\", n AS level FROM p6", h=HOURLY, **_tick_passes(3.0, 0.2)))
def bad_ticks(t: Tables):
    """Hourly counts left after removal of isolated outliers."""
    series = hourly(t).select("series", "at", F.col("n").alias("level"))
    return tidy(cleaning.remove_bad_ticks(series, 3.0, 0.2).withColumn("at", stamp("at")))


@query("longest_run", with_ctes("rets cal", """
    SELECT asset, max(n) AS longest FROM (
      SELECT asset, g, count(*) AS n FROM (SELECT r.asset, c.pos - row_number() OVER (PARTITION BY r.asset ORDER BY c.pos) AS g FROM rets r JOIN cal c USING (date))
      GROUP BY 1, 2) GROUP BY asset"""))
def longest_run(t: Tables):
    rows = t.returns.join(t.calendar.select("date", "pos"), "date").withColumn("seen", F.lit(True))
    return tidy(cleaning.longest_run(rows, "asset", "pos", "seen"))


@query("series_coverage", with_ctes("cal rets", """
    SELECT asset AS series, CAST(min(date) AS VARCHAR) AS first_valid, CAST(max(date) AS VARCHAR) AS last_valid, count(*) AS n_valid,
      count(*) FILTER (WHERE stale) AS n_stale, (SELECT count(*) FROM cal) - count(*) AS n_missing
    FROM (SELECT g.date, g.asset, last_value(r.ret IGNORE NULLS) OVER (PARTITION BY g.asset ORDER BY g.date
            ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS v, r.ret IS NULL AS stale
          FROM (SELECT c.date, a.asset FROM cal c CROSS JOIN (SELECT DISTINCT asset FROM rets) a) g LEFT JOIN rets r USING (date, asset))
    WHERE v IS NOT NULL GROUP BY asset"""))
def series_coverage(t: Tables):
    filled = align.fill_gaps(t.returns.withColumnRenamed("ret", "level"), t.calendar, "asset", "level", 5)
    return tidy(cleaning.coverage(filled.withColumnRenamed("asset", "series"), t.calendar))


# Daily prices per brand: mean line price, and mean list price times quantity as a second source.
PRICES = """SELECT p_brand AS series, date, avg(l_extendedprice) AS level, avg(p_retailprice * l_quantity) AS other
    FROM lines JOIN part ON p_partkey = l_partkey GROUP BY 1, 2"""


def prices(t: Tables):
    per_part = t.lineitem.groupBy("date", "l_partkey").agg(F.sum("l_extendedprice").alias("s"), F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    part = t.read("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("series"), "p_retailprice")
    daily = per_part.join(part, "l_partkey").groupBy("series", "date").agg(
        (F.sum("s") / F.sum("n")).alias("level"), (F.sum(F.col("p_retailprice") * F.col("q")) / F.sum("n")).alias("other"))
    return materialise(daily, "prices")


BASKET = {"px": PRICES, "mv": "SELECT p.date, c.pos, p.level / b.level - 1 AS r FROM px p JOIN cal c USING (date) JOIN cal d ON d.pos = c.pos - 1 JOIN px b ON b.series = p.series AND b.date = d.date",
          "bk": "SELECT date, pos, avg(r) AS ret, count(*) AS n FROM mv GROUP BY 1, 2 HAVING count(*) >= 3"}


@query("basket_returns", with_ctes("lines cal", "SELECT CAST(date AS VARCHAR) AS date, pos, round(ret, 7) AS ret, n FROM bk", **BASKET))
def basket_returns(t: Tables):
    return tidy(cleaning.basket_returns(prices(t), t.calendar, 3), 7)


@query("basket_level", with_ctes("lines cal", """
    SELECT CAST(date AS VARCHAR) AS date, pos, n, round(ln(100) + sum(ln(1 + ret)) OVER (ORDER BY pos) - first_value(ln(1 + ret)) OVER (ORDER BY pos), 6) AS log_level FROM bk""", **BASKET))
def basket_level(t: Tables):
    return tidy(cleaning.cumulate(cleaning.basket_returns(prices(t), t.calendar, 3)).select("date", "pos", "n", "log_level"), 6)


@query("detect_spikes", with_ctes("rets cal", """
    SELECT asset, round(max(threshold), 8) AS threshold, count(*) FILTER (WHERE abs(ret) > threshold AND abs(nxt) > threshold AND sign(ret) <> sign(nxt)
      AND abs(ret + nxt) < 0.5 * abs(ret)) AS n_spikes
    FROM (SELECT r.asset, r.ret, n.ret AS nxt FROM r10 r JOIN cal c USING (date) LEFT JOIN cal d ON d.pos = c.pos + 1 LEFT JOIN r10 n ON n.asset = r.asset AND n.date = d.date)
    JOIN lim USING (asset) GROUP BY asset""",
    r10="SELECT date, asset, round(ret, 10) AS ret FROM rets",
    med="SELECT asset, median(ret) AS m, count(*) AS k FROM r10 WHERE ret <> 0 GROUP BY asset",
    lim="SELECT asset, greatest(6 * 1.4826 * median(abs(ret - m)), 0.015) AS threshold FROM r10 JOIN med USING (asset) WHERE ret <> 0 GROUP BY asset HAVING max(k) >= 50"))
def detect_spikes(t: Tables):
    return tidy(cleaning.detect_spikes(t.returns.withColumn("ret", F.round("ret", 10)), t.calendar))


@query("compare_sources", with_ctes("lines", """
    SELECT series, n_common, round(corr_lag_m1, 7) AS corr_lag_m1, round(corr_lag_0, 7) AS corr_lag_0, round(corr_lag_p1, 7) AS corr_lag_p1,
      round(level_gap, 7) AS level_gap, n_disagree, round(corr_weekly, 7) AS corr_weekly
    FROM (SELECT series, count(*) AS n_common, count(*) FILTER (WHERE abs(a - b - CASE WHEN c >= 5 THEN md END) > 0.03) AS n_disagree, corr(dap, db) AS corr_lag_m1, corr(da, db) AS corr_lag_0, corr(dan, db) AS corr_lag_p1, median(abs(a - b)) AS level_gap
          FROM (SELECT *, lag(da) OVER w AS dap, lead(da) OVER w AS dan, median(a - b) OVER (w ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS md, count(a) OVER (w ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS c
                FROM mv WINDOW w AS (PARTITION BY series ORDER BY date)) GROUP BY series)
    JOIN (SELECT series, corr(da, db) AS corr_weekly FROM (
            SELECT series, a - lag(a) OVER w AS da, b - lag(b) OVER w AS db FROM (
              SELECT series, date_trunc('week', date + 2) AS wk, max_by(a, date) AS a, max_by(b, date) AS b FROM mv GROUP BY 1, 2) WINDOW w AS (PARTITION BY series ORDER BY wk))
          GROUP BY series) USING (series)""", px=PRICES,
    mv="SELECT *, a - lag(a) OVER w AS da, b - lag(b) OVER w AS db FROM (SELECT series, date, ln(level) AS a, ln(other) AS b FROM px) WINDOW w AS (PARTITION BY series ORDER BY date)"))
def compare_sources(t: Tables):
    px = prices(t)
    return tidy(cleaning.compare_sources(px.select("series", "date", "level"), px.select("series", "date", F.col("other").alias("level"))), 7)


# A daily conversion rate per region: mean order value of the day over that of all orders that day.
FX = """SELECT CAST(o_orderdate AS DATE) AS date, r_name AS ccy, avg(o_totalprice) / 100000 AS usd_per FROM orders JOIN customer ON c_custkey = o_custkey
    JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2"""


# Quotes of every brand on the days as shipped, weekends too: the mean line price, its taxed form as adjusted close, and a snapshot of another measure.
RAW = """SELECT p_brand AS b, CAST(l_shipdate AS DATE) AS d, avg(l_extendedprice) AS c, avg(l_extendedprice * (1 + l_tax)) AS a, avg(p_retailprice * l_quantity) AS o
    FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2"""
CHAIN = {
    "raw": RAW, "num": "SELECT *, CAST(regexp_extract(b, '[0-9]+') AS INTEGER) AS k FROM raw",
    "q1": "SELECT b AS leg, d, o AS level, log10(o) - lag(log10(o)) OVER (PARTITION BY b ORDER BY d) AS mv FROM num WHERE k % 2 = 1 AND o > 0",
    "q2": """SELECT *, sum(CASE WHEN round(mv / 2) <> 0 AND abs(mv - 2 * round(mv / 2)) < 0.35 THEN round(mv / 2) ELSE 0 END) OVER (PARTITION BY leg ORDER BY d ROWS UNBOUNDED PRECEDING) AS unit FROM q1""",
    "q3": "SELECT leg, unit AS usual FROM (SELECT leg, unit, row_number() OVER (PARTITION BY leg ORDER BY count(*) DESC, unit) AS r FROM q2 GROUP BY 1, 2) WHERE r = 1",
    "q4": "SELECT leg, d, level / pow(100.0, unit - usual) AS level, unit <> usual AS fixed FROM q2 JOIN q3 USING (leg)",
    "cnd": """SELECT leg, 0 AS seq, CAST(CASE WHEN isodow(d) = 1 THEN d - 3 WHEN isodow(d) = 7 THEN d - 2 ELSE d - 1 END AS DATE) AS day, d, level / 100 AS level, fixed FROM q4
      UNION ALL SELECT b, 1, d, d, CASE WHEN k % 3 = 0 THEN a ELSE c END, false FROM num
      UNION ALL SELECT b, 2, d, d, 1 / c, false FROM num""",
    "day1": "SELECT leg, seq, day AS date, max_by(level, d) AS level FROM cnd WHERE isodow(day) <= 5 GROUP BY 1, 2, 3",
    "cst": "SELECT leg, seq, count(*) AS n_quotes, count(*) AS n_positive, count(*) FILTER (WHERE fixed) AS n_repaired, count(*) FILTER (WHERE isodow(day) > 5) AS n_weekend FROM cnd GROUP BY 1, 2",
    "cob": "SELECT d.leg, d.seq, d.date, CASE WHEN d.seq = 1 THEN level * f.usd_per / g.usd_per ELSE level END AS level FROM day1 d LEFT JOIN fx f ON f.date = d.date AND f.ccy = 'ASIA' LEFT JOIN fx g ON g.date = d.date AND g.ccy = 'EUROPE' WHERE d.seq <> 1 OR (f.usd_per IS NOT NULL AND g.usd_per IS NOT NULL)",
}


def chain(t: Tables):
    """(candidates, quotes, rates): odd brands have a snapshot in pence first; then a foreign quote to be converted, and an inverse."""
    per_part = t.read("lineitem").groupBy(F.to_date("l_shipdate").alias("date"), "l_partkey").agg(
        F.sum("l_extendedprice").alias("c"), F.sum(F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("a"), F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    part = t.read("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("leg"), "p_retailprice")
    daily = materialise(per_part.join(part, "l_partkey").groupBy("leg", "date").agg(
        (F.sum("c") / F.sum("n")).alias("c"), (F.sum("a") / F.sum("n")).alias("a"), (F.sum(F.col("p_retailprice") * F.col("q")) / F.sum("n")).alias("o")), "raw_quotes")
    number = F.regexp_extract("leg", "[0-9]+", 0).cast("int")
    quotes = daily.where(number % 2 == 1).select(F.concat("leg", F.lit("=X")).alias("ticker"), "date", F.col("o").alias("close"), F.lit(None).cast("double").alias("adj_close"))
    quotes = quotes.unionByName(daily.select(F.col("leg").alias("ticker"), "date", F.col("c").alias("close"), F.when(number % 3 == 0, F.col("a")).alias("adj_close")))
    legs = daily.select("leg").distinct()
    make = lambda df, seq, source, ticker, ccy, invert: df.select("leg", F.lit(seq).alias("seq"), F.lit(source).alias("source"), ticker.alias("ticker"), F.lit(ccy).alias("ccy"), F.lit(invert).alias("invert"), F.lit("equity").alias("kind"), F.lit("EUROPE" if seq == 1 else ccy.upper()).alias("return_ccy"), F.lit(seq == 1).alias("total_return"))
    cand = make(legs.where(number % 2 == 1), 0, "yahoo", F.concat("leg", F.lit("=X")), "GBp", False).unionByName(make(legs, 1, "fred", F.col("leg"), "ASIA", False)).unionByName(make(legs, 2, "fred", F.col("leg"), "USD", True))
    place = t.read("nation").join(t.read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("ccy"))
    who = t.read("customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "ccy")
    sums = t.orders.groupBy("date", "o_custkey").agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("n"))
    fx = sums.join(who, "o_custkey").groupBy("date", "ccy").agg((F.sum("s") / F.sum("n") / 100000).alias("usd_per"))
    return materialise(cand, "candidates"), quotes, materialise(fx, "rates")


@query("candidate_steps", with_ctes("", """
    SELECT s.*, n.n_days, CAST(0 AS BIGINT) AS n_repeats, CAST(0 AS BIGINT) AS n_bad_ticks, CAST(coalesce(o.n_obs, 0) AS BIGINT) AS n_obs FROM cst s
    JOIN (SELECT leg, seq, count(*) AS n_days FROM day1 GROUP BY 1, 2) n USING (leg, seq) LEFT JOIN (SELECT leg, seq, count(*) AS n_obs FROM cob GROUP BY 1, 2) o USING (leg, seq)""", fx=FX, **CHAIN)
    .replace("SELECT s.*", "SELECT s.leg, CAST(s.seq AS BIGINT) AS seq, s.n_quotes, s.n_positive, s.n_repaired, s.n_weekend"))
def candidate_steps(t: Tables):
    """What every step of the candidate chain took from the quotes of every brand."""
    cand, quotes, fx = chain(t)
    return tidy(cleaning.candidate_observations(cand, quotes, fx)[1])


@query("candidate_prices", with_ctes("cal", """
    SELECT leg, CAST(date AS VARCHAR) AS date, round(ln(level), 9) AS log_level, stale FROM (
      SELECT *, first_value(seq) OVER (PARTITION BY leg ORDER BY CASE WHEN n = t THEN 0 ELSE 1 END, CASE WHEN n = t THEN 0 ELSE -n END, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS pick
      FROM (SELECT *, count(*) OVER (PARTITION BY leg, seq) AS n, (SELECT count(*) FROM cal) AS t FROM (
        SELECT g.leg, g.seq, g.date, last_value(o.level IGNORE NULLS) OVER (PARTITION BY g.leg, g.seq ORDER BY g.date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS level, o.level IS NULL AS stale
        FROM (SELECT DISTINCT c.date, d.leg, d.seq FROM cal c CROSS JOIN (SELECT DISTINCT leg, seq FROM cnd) d) g LEFT JOIN cob o USING (leg, seq, date)) WHERE level IS NOT NULL))
    WHERE seq = pick""", fx=FX, **CHAIN))
def candidate_prices(t: Tables):
    """Levels of every brand from the first of its candidates that covers the calendar, else from the fullest."""
    cand, quotes, fx = chain(t)
    obs, _ = cleaning.candidate_observations(cand, quotes, fx)
    levels = cleaning.candidate_prices(obs, cand, t.calendar)[0]
    return tidy(levels.select("leg", "date", F.log("level").alias("log_level"), "stale"), 9)


@query("leg_spread", with_ctes("rets", """
    SELECT CAST(l.date AS VARCHAR) AS date, l.asset || ' v Brand#1' AS asset, round(l.ret - s.ret, 8) AS ret
    FROM rets l JOIN rets s ON s.date = l.date AND s.asset = 'Brand#1' WHERE l.asset <> 'Brand#1'"""))
def leg_spread(t: Tables):
    """Every brand against the first one."""
    pairs = t.returns.select(F.col("asset").alias("long_leg")).distinct().where("long_leg <> 'Brand#1'").select(
        F.concat("long_leg", F.lit(" v Brand#1")).alias("asset"), "long_leg", F.lit("Brand#1").alias("short_leg"))
    return tidy(cleaning.leg_spread(pairs, t.returns.withColumnRenamed("asset", "leg")))


@query("convert_currency", with_ctes("lines", """
    SELECT series, CAST(date AS VARCHAR) AS date, round(level * f.usd_per / g.usd_per, 4) AS level
    FROM px JOIN fx f USING (date) JOIN fx g USING (date) WHERE f.ccy = 'ASIA' AND g.ccy = 'EUROPE'""", px=PRICES, fx=FX))
def convert_currency(t: Tables):
    place = t.read("nation").join(t.read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("ccy"))
    who = t.read("customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "ccy")
    sums = t.orders.groupBy("date", "o_custkey").agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("n"))
    fx = sums.join(who, "o_custkey").groupBy("date", "ccy").agg((F.sum("s") / F.sum("n") / 100000).alias("usd_per"))
    levels = prices(t).select("series", "date", "level", F.lit("ASIA").alias("ccy"))
    return tidy(cleaning.convert_currency(levels, fx, "EUROPE"), 4)


TOKENS = """SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN 'yahoo:' WHEN 1 THEN 'fred:' ELSE '' END || replace(s_name, 'Supplier#', 'S') ||
    CASE s_nationkey % 4 WHEN 0 THEN '@eur' WHEN 1 THEN '@GBp' WHEN 2 THEN '@GBP' ELSE '' END || CASE WHEN s_acctbal < 0 THEN '/inv' ELSE '' END AS token FROM supplier"""


@query("parse_token", with_ctes("", """
    SELECT s_suppkey, CASE WHEN token LIKE 'fred:%' THEN 'fred' ELSE 'yahoo' END AS source, regexp_extract(token, 'S[0-9]+') AS ticker,
      CASE WHEN token LIKE '%@eur%' THEN 'EUR' WHEN token LIKE '%@GBp%' THEN 'GBp' WHEN token LIKE '%@GBP%' THEN 'GBP' END AS ccy, token LIKE '%/inv' AS invert FROM tk""", tk=TOKENS))
def parse_token(t: Tables):
    def pick(column, n, names):
        out = F.lit("")
        for value, name in names.items():
            out = F.when(F.col(column) % n == value, name).otherwise(out)
        return out

    token = F.concat(
        pick("s_nationkey", 3, {0: "yahoo:", 1: "fred:"}), F.replace("s_name", F.lit("Supplier#"), F.lit("S")),
        pick("s_nationkey", 4, {0: "@eur", 1: "@GBp", 2: "@GBP"}), F.when(F.col("s_acctbal") < 0, "/inv").otherwise(""))
    return t.read("supplier").select("s_suppkey", *cleaning.parse_token(token))


@query("candidate_choice", with_ctes("", """
    SELECT leg, n_valid, n_missing, seq, CASE WHEN n_missing = 0 THEN 'ok' WHEN n_valid > 0 THEN 'partial' ELSE 'failed' END AS status FROM (
      SELECT *, row_number() OVER (PARTITION BY leg ORDER BY CASE WHEN n_missing = 0 AND quality_ok THEN 0 ELSE 1 END,
        CASE WHEN n_missing = 0 AND quality_ok THEN 0 ELSE -n_valid END, seq) AS k FROM cand) WHERE k = 1""",
    cand="""SELECT n_name AS leg, s_suppkey AS seq, count(DISTINCT CAST(l_shipdate AS DATE)) AS n_valid,
        greatest(0, 400 - count(DISTINCT CAST(l_shipdate AS DATE))) AS n_missing, s_acctbal > 0 AS quality_ok
      FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name, s_suppkey, s_acctbal"""))
def candidate_choice(t: Tables):
    """Per nation the first supplier that ships on at least 400 days and is in credit, else the busiest."""
    days = t.read("lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("d")).distinct().groupBy("l_suppkey").agg(F.count("*").alias("n_valid"))
    who = t.read("supplier").join(t.read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    cand = days.join(who, F.col("s_suppkey") == F.col("l_suppkey")).select(
        F.col("n_name").alias("leg"), F.col("s_suppkey").alias("seq"), "n_valid", F.greatest(F.lit(0), 400 - F.col("n_valid")).alias("n_missing"), (F.col("s_acctbal") > 0).alias("quality_ok"))
    return tidy(cleaning.choose_candidate(cand).select("leg", "n_valid", "n_missing", "seq", "status"))


@query("market_manifest", with_ctes("rets cal", """
    SELECT asset, CAST(min(date) AS VARCHAR) AS first_day, CAST(max(date) AS VARCHAR) AS last_day, count(*) AS n, round(stddev_samp(ret) * sqrt(261), 7) AS ann_vol,
      round(count(*) / (SELECT count(*) FROM cal), 8) AS coverage, CASE WHEN count(*) >= (SELECT count(*) FROM cal) THEN 'ok' ELSE 'partial' END AS status
    FROM rets GROUP BY asset"""))
def market_manifest(t: Tables):
    return tidy(cleaning.market_manifest(t.returns, t.calendar.count()), 8, ann_vol=7)


# Scores per (segment, order year), read off the orders and standing in for runs of a study.
RUNS = """SELECT scenario, seed, CASE WHEN scenario IN ('AUTOMOBILE', 'BUILDING') THEN 'null' ELSE 'signal' END AS kind, name, value FROM (
    SELECT scenario, seed, unnest(['selection_recall', 'selection_precision', 'null_selection_lift', 'placebo_selected']) AS name,
      unnest([CAST(f AS DOUBLE) / n, CAST(u AS DOUBLE) / n * 3, CAST(n AS DOUBLE) / 300, CAST(CASE WHEN n % 2 = 0 THEN 0 ELSE 1 END AS DOUBLE)]) AS value
    FROM (SELECT c_mktsegment AS scenario, CAST(year(o_orderdate) AS BIGINT) AS seed, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f,
            count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS u FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2))"""


def runs(t: Tables):
    per = t.orders.groupBy("o_custkey", F.year("date").cast("long").alias("seed")).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("f"), F.count(F.when(F.col("o_orderpriority") == "1-URGENT", 1)).alias("u"))
    seg = t.read("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("scenario"))
    g = per.join(seg, "o_custkey").groupBy("scenario", "seed").agg(F.sum("n").alias("n"), F.sum("f").alias("f"), F.sum("u").alias("u"))
    d = [F.col(c).cast("double") for c in "nfu"]
    wide = g.select("scenario", "seed", (d[1] / d[0]).alias("selection_recall"), (d[2] / d[0] * 3).alias("selection_precision"),
                    (d[0] / 300).alias("null_selection_lift"), F.when(F.col("n") % 2 == 0, 0.0).otherwise(1.0).alias("placebo_selected"))
    names = ["selection_recall", "selection_precision", "null_selection_lift", "placebo_selected"]
    return wide.unpivot(["scenario", "seed"], names, "name", "value").withColumn(
        "kind", F.when(F.col("scenario").isin("AUTOMOBILE", "BUILDING"), "null").otherwise("signal"))


CHECK_ROWS = "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{d}', {b}::DOUBLE, '{k}')" for c, d, b, k in scoring.CHECKS) + ") v(chk, direction, bound, kind)"
FLAGS = {"runs": RUNS, "chk": CHECK_ROWS, "flags": """
    SELECT r.scenario, r.seed, c.kind, c.chk, m.value, c.bound, coalesce(CASE WHEN c.direction = '>=' THEN m.value >= c.bound ELSE m.value <= c.bound END, false) AS passed
    FROM (SELECT DISTINCT scenario, seed, kind FROM runs) r JOIN chk c ON c.kind = r.kind
    LEFT JOIN runs m ON m.scenario = r.scenario AND m.seed = r.seed AND m.name = c.chk"""}


@query("checks_pass_flags", with_ctes("", 'SELECT scenario, seed, kind, chk AS "check", round(value, 8) AS value, bound, passed FROM flags', **FLAGS))
def checks_pass_flags(t: Tables):
    return tidy(scoring.pass_flags(runs(t), scoring.check_table(t.spark), ["scenario", "seed"]))


OWN = [("building-fast", "null_selection_lift", 9.0), ("HOUSEHOLD", "selection_recall", 0.45), ("machinery", "placebo_selected", 1.0)]


@query("checks_scenario_bounds", with_ctes("", """
    SELECT f.scenario, f.seed, f.kind, chk AS "check", round(value, 8) AS value, coalesce(o.bound, f.bound) AS bound,
      coalesce(CASE WHEN direction = '>=' THEN value >= coalesce(o.bound, f.bound) ELSE value <= coalesce(o.bound, f.bound) END, false) AS passed
    FROM flags f JOIN (SELECT DISTINCT chk, kind, direction FROM chk) USING (chk, kind) LEFT JOIN own o ON o.scenario = f.scenario AND o.name = f.chk""", **FLAGS,
    own="SELECT * FROM (VALUES ('BUILDING', 'null_selection_lift', 9.0::DOUBLE), ('HOUSEHOLD', 'selection_recall', 0.45::DOUBLE), ('MACHINERY', 'placebo_selected', 1.0::DOUBLE)) v(scenario, name, bound)"))
def checks_scenario_bounds(t: Tables):
    """Pass flags where three scenarios have a bound of their own."""
    own = t.spark.createDataFrame(OWN, "scenario string, check string, bound double")
    return tidy(scoring.pass_flags(runs(t), scoring.check_table(t.spark), ["scenario", "seed"], own))


@query("pass_rates", with_ctes("", 'SELECT scenario, chk AS "check", round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 8) AS pass_rate, count(*) AS runs FROM flags GROUP BY 1, 2', **FLAGS))
def pass_rates(t: Tables):
    return tidy(scoring.pass_rates(scoring.pass_flags(runs(t), scoring.check_table(t.spark), ["scenario", "seed"])))


@query("harness_summary", with_ctes("", "SELECT scenario, name, round(avg(value), 8) AS mean, round(stddev_samp(value), 8) AS std, count(value) AS n FROM runs GROUP BY 1, 2", runs=RUNS))
def harness_summary(t: Tables):
    return tidy(scoring.scenario_summary(runs(t)))


@query("selection_scores", with_ctes("", """
    SELECT round(sum(CASE WHEN sel AND rel THEN 1.0 ELSE 0 END) / sum(CASE WHEN rel THEN 1.0 ELSE 0 END), 8) AS selection_recall,
      round(sum(CASE WHEN sel AND strong THEN 1.0 ELSE 0 END) / sum(CASE WHEN strong THEN 1.0 ELSE 0 END), 8) AS selection_recall_strong,
      round(sum(CASE WHEN sel AND rel THEN 1.0 ELSE 0 END) / sum(CASE WHEN sel THEN 1.0 ELSE 0 END), 8) AS selection_precision,
      CAST(count(*) FILTER (WHERE sel AND plc) AS DOUBLE) AS placebo_selected
    FROM (SELECT *, rel AND qty >= (SELECT median(qty) FROM tp WHERE rel) AS strong FROM tp)""", edges=EDGES,
    tp="SELECT topic, asset, qty, rank <= 8 AS sel, sign = 1 AS rel, rank = 5 AS plc FROM edges"))
def selection_scores(t: Tables):
    rows = edges(t).select((F.col("rank") <= 8).alias("selected"), (F.col("sign") == 1).alias("relevant"), F.col("qty").alias("strength"), (F.col("rank") == 5).alias("placebo"))
    return tidy(scoring.selection_scores(rows))


@query("canonical_corr")
def canonical_corr(t: Tables):
    """First canonical correlation of the two halves of the vectors, per label."""
    rows = t.read("embeddings").select("label", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    return scoring.canonical_correlations(rows, 32, "label").where("k = 1").select("g", F.col("corr").alias("first"), "n")


@query("canonical_corr_one_column", """
    SELECT CAST(label AS VARCHAR) AS g, round(abs(corr(CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE))), 7) AS first, count(*) AS n FROM embeddings GROUP BY label""")
def canonical_corr_one_column(t: Tables):
    """With one column a side it is the absolute correlation."""
    rows = t.read("embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    left = rows.select("vec_id", "label", F.slice("e", 1, 1).alias("v"))
    return tidy(scoring.first_canonical_correlation(left, rows.select("vec_id", "label", F.slice("e", 2, 1).alias("v")), ["vec_id", "label"], 1, "label"), 7)


@query("instrument_beta_r2", """
    SELECT CAST(label AS VARCHAR) AS g, k AS instrument, round(corr(CAST(embedding[1] AS DOUBLE), CAST(embedding[k + 2] AS DOUBLE)) ** 2, 7) AS r2, count(*) AS n
    FROM embeddings CROSS JOIN (SELECT unnest(range(63)) AS k) GROUP BY label, k""")
def instrument_beta_r2(t: Tables):
    """R2 of every other column on the first one, per label."""
    rows = t.read("embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    beta = rows.select("vec_id", "label", F.slice("e", 1, 1).alias("v"))
    return tidy(scoring.instrument_beta_r2(rows.select("vec_id", "label", F.slice("e", 2, 63).alias("v")), beta, ["vec_id", "label"], 1, "label"), 7)


@query("embedding_scale", """
    SELECT l, round(stddev_pop(v), 7) AS sd, round(avg(v), 7) AS mean FROM (
      SELECT CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS l FROM embeddings) GROUP BY l""")
def embedding_scale(t: Tables):
    """Spread and mean of every matrix column."""
    long = t.read("embeddings").select(F.posexplode("embedding").alias("l", "v"))
    return tidy(long.groupBy("l").agg(F.stddev_pop(F.col("v").cast("double")).alias("sd"), F.avg(F.col("v").cast("double")).alias("mean")), 7)


@query("attention_weekly", with_ctes("att", """
    SELECT topic, CAST(CAST(date_trunc('week', date + 2) AS DATE) + 4 AS VARCHAR) AS week_end, round(avg(level), 8) AS level FROM att GROUP BY 1, 2"""))
def attention_weekly(t: Tables):
    return tidy(views.weekly_means(t.attention, "topic", "level"))


@query("cumulative_returns", with_ctes("rets", """
    SELECT CAST(date AS VARCHAR) AS date, asset, round(sum(ret) OVER (PARTITION BY asset ORDER BY date), 7) AS cumulative FROM rets"""))
def cumulative_returns(t: Tables):
    return tidy(views.cumulative(t.returns, "asset", "ret").select("date", "asset", "cumulative"), 7)


# Sensitivity deliveries: one estimate per (year end, nation, brand).
DELIVERED = """SELECT CAST(make_date(year(l_shipdate), 12, 31) AS DATE) AS as_of, n_name AS topic, p_brand AS asset, avg(l_discount) AS sensitivity,
      CASE WHEN count(*) >= 12 THEN 'full' WHEN count(*) >= 8 THEN 'partial' ELSE 'none' END AS coverage
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3"""


def delivered(t: Tables):
    sums = t.read("lineitem").groupBy(F.year("l_shipdate").alias("y"), "l_suppkey", "l_partkey").agg(F.sum("l_discount").alias("s"), F.count("*").alias("n"))
    who = t.read("supplier").join(t.read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("topic"))
    part = t.read("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("asset"))
    g = sums.join(who, "l_suppkey").join(part, "l_partkey").groupBy("y", "topic", "asset").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return g.select(F.make_date("y", F.lit(12), F.lit(31)).alias("as_of"), "topic", "asset", (F.col("s") / F.col("n")).alias("sensitivity"),
                    F.when(F.col("n") >= 12, "full").when(F.col("n") >= 8, "partial").otherwise("none").alias("coverage"))


@query("sensitivity_matrix", with_ctes("", """
    SELECT asset, """ + ", ".join(f"round(max(CASE WHEN topic = 'NATION_{i}' AND coverage <> 'none' THEN sensitivity END), 7) AS NATION_{i}" for i in range(25)) + """
    FROM d WHERE as_of = DATE '1999-12-31' GROUP BY asset""", d=DELIVERED))
def sensitivity_matrix(t: Tables):
    nations = bounded_list(t.read("nation"), "n_name")
    return tidy(views.sensitivity_matrix(delivered(t), "1999-12-31", nations), 7)


@query("blank_and_flip", with_ctes("", """
    SELECT CAST(as_of AS VARCHAR) AS as_of, topic, asset, coverage, CASE WHEN coverage <> 'none' AND abs(sensitivity) >= 0.0501
      THEN round(sensitivity * CASE WHEN asset IN ('Brand#1', 'Brand#2') THEN -1 ELSE 1 END, 7) END AS sensitivity FROM d""", d=DELIVERED))
def blank_and_flip(t: Tables):
    """Blanks weak or uncovered cells and flips the rows held short."""
    short = t.spark.createDataFrame([("Brand#1", -1), ("Brand#2", -1)], "asset string, sign int")
    kept = views.blank(delivered(t), "sensitivity", F.col("coverage") != "none", 0.0501)
    return tidy(views.apply_views(kept, short, "sensitivity"), 7)


@query("contract_checks", with_ctes("", """
    SELECT count(*) AS n_rows, count(*) - count(DISTINCT (as_of, topic, asset)) AS n_duplicates, count(*) FILTER (WHERE coverage NOT IN ('full', 'partial', 'none')) AS n_bad_coverage,
      count(*) FILTER (WHERE topic NOT IN (SELECT n_name FROM nation)) AS n_unknown_topic FROM d""", d=DELIVERED))
def contract_checks(t: Tables):
    from loomline.sources.contracts import sensitivity_problems

    return tidy(sensitivity_problems(delivered(t), t.read("nation").select(F.col("n_name").alias("topic"))))


@query("pair_order", with_ctes("", 'SELECT topic, asset, qty, row_number() OVER (ORDER BY qty DESC, topic || asset) AS rank FROM edges', edges=EDGES))
def pair_order(t: Tables):
    rows = edges(t).select("topic", "asset", "qty", F.concat("topic", "asset").alias("tie"))
    return tidy(views.ordered(rows, "qty", "tie").drop("tie"))


@query("label_overlap", """
    SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS in_left, b.k IS NOT NULL AS in_right
    FROM (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal < 0) a FULL JOIN (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal < -900) b ON a.k = b.k""")
def label_overlap(t: Tables):
    left = t.read("supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("k"))
    return views.label_overlap(left, t.read("customer").where("c_acctbal < -900").select(F.col("c_nationkey").alias("k")), "k")


@query("pair_sample")
def pair_sample(t: Tables):
    """Every linked pair and a seeded sample of the others."""
    return views.sample_pairs(edges(t).select("topic", "asset", "qty", "rank"), F.col("rank") <= 6, 100)


@query("string_forms", """
    SELECT p_partkey, 'G' || CASE WHEN p_partkey < 1000 THEN lpad(CAST(p_partkey AS VARCHAR), 3, '0') ELSE CAST(p_partkey AS VARCHAR) END AS id,
      trim(regexp_replace(lower(p_type || ' / ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS scenario, p_size > 25 AS flag,
      round(least(greatest(p_retailprice, 950), 1800), 4) AS clipped FROM part""")
def string_forms(t: Tables):
    """Serial ids, normalised names, booleans from text and clipped values."""
    flag = truthy(F.when(F.col("p_size") > 25, " Yes").otherwise("no"))
    return tidy(t.read("part").select(
        "p_partkey", serial_id("G", F.col("p_partkey")).alias("id"), slug(F.concat("p_type", F.lit(" / "), "p_brand")).alias("scenario"),
        flag.alias("flag"), clip(F.col("p_retailprice"), 950, 1800).alias("clipped")), 4)


@query("date_forms", """
    SELECT o_orderkey, CAST(CAST(d AS DATE) - INTERVAL 12 MONTH + INTERVAL 1 DAY AS DATE)::VARCHAR AS train_start,
      CAST(CASE WHEN isodow(d) = 1 THEN d - 3 WHEN isodow(d) = 6 THEN d - 1 WHEN isodow(d) = 7 THEN d - 2 ELSE d - 1 END AS DATE)::VARCHAR AS previous_weekday,
      date_diff('day', d, DATE '2001-12-31') AS days_left
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def date_forms(t: Tables):
    """Training starts, weekday shifts and day differences."""
    previous = calendar.shift_business_days(F.col("date"), -1)
    return tidy(t.orders.select(
        "o_orderkey", calendar.training_start(F.col("date"), 12).alias("train_start"), previous.alias("previous_weekday"),
        F.datediff(F.lit("2001-12-31").cast("date"), "date").alias("days_left")))


@query("trace_shock_identity", with_ctes("shk att", """
    SELECT 'shocks' AS step, 'trailing mean formula' AS name, CAST(0 AS DOUBLE) AS value, CAST(0 AS BIGINT) AS unmatched, count(*) AS n, 1e-12 AS tolerance, 'pass' AS status
    FROM shk SEMI JOIN att USING (date)"""))
def trace_shock_identity(t: Tables):
    """Shocks against a formula written with lags instead of a frame."""
    by = Window.partitionBy("topic").orderBy("pos")
    rows = t.attention.join(t.calendar.select("date", "pos"), "date")
    lags = [F.lag("level", k).over(by) for k in range(1, 6)]
    near = F.lag("pos", 5).over(by) == F.col("pos") - 5
    direct = rows.withColumn("want", F.when(near, F.col("level") - (lags[0] + lags[1] + lags[2] + lags[3] + lags[4]) / 5)).select("date", "topic", "want")
    out = scoring.difference_check(t.shocks.join(direct, ["date", "topic"], "full"), "shocks", "trailing mean formula", "z", "want", 1e-12)
    return tidy(out.withColumn("value", F.round("value", 12)), 13)


@query("trace_panel_checks", with_ctes("panel", """
    SELECT 'panel' AS step, name, CAST(0 AS DOUBLE) AS value, CAST(0 AS BIGINT) AS unmatched, n, tol AS tolerance, 'pass' AS status FROM (
      SELECT 'constant column' AS name, count(*) AS n, CAST(0 AS DOUBLE) AS tol FROM panel UNION ALL
      SELECT 'two kernel routes', count(*) * 5, 1e-10 FROM panel UNION ALL SELECT 'period return', count(*), 1e-12 FROM panel)"""))
def trace_panel_checks(t: Tables):
    """Panel identities: constant, both kernel routes, and period returns rebuilt from days."""
    one = scoring.difference_check(t.panel.select(F.col("x")[0].alias("a"), F.lit(1.0).alias("b")), "panel", "constant column", "a", "b", 0.0)
    blocks = kernel.kernel_covariance_blocks(t.returns, t.shocks, t.calendar, t.topics, kernel.KernelConfig(), 8)
    other = panel.build_panel(blocks, align.period_returns(t.returns, t.calendar), 12, 20)
    long = t.panel.select("t_idx", "asset", F.posexplode(F.slice("x", 2, len(t.topics))).alias("l", "a"))
    both = long.join(other.select("t_idx", "asset", F.posexplode(F.slice("x", 2, len(t.topics))).alias("l", "b")), ["t_idx", "asset", "l"], "full")
    routes = scoring.difference_check(both, "panel", "two kernel routes", "a", "b", 1e-10)
    ends = t.calendar.groupBy("period_id").agg(F.max("date").alias("period"))
    daily = t.returns.join(t.calendar.select("date", "period_id"), "date").groupBy("asset", "period_id").agg(F.sum("ret").alias("b")).join(ends, "period_id")
    sums = scoring.difference_check(t.panel.join(daily, ["asset", "period"], "left").select(F.col("y").alias("a"), "b"), "panel", "period return", "a", "b", 1e-12)
    return tidy(one.unionByName(routes).unionByName(sums).withColumn("value", F.round("value", 9)), 13)


@query("null_sharpe_quantiles")
def null_sharpe_quantiles(t: Tables):
    """Sharpe ratios that pure noise reaches with the panel's number of periods."""
    from loomline.operators.trace import null_sharpe

    n = t.panel.select("t_idx").distinct().count()
    return t.spark.createDataFrame([(k, float(p), float(v)) for k in (1, 2, 3) for p, v in null_sharpe(k, n).items()], "K int, prob double, sharpe double")
