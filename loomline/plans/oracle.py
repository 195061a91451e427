"""SQL counterparts of the table projections, as named common table expressions."""

from __future__ import annotations

# Each entry: name -> (entries it reads, SQL body).
CTES: dict[str, tuple[list[str], str]] = {
    "lines": ([], "SELECT *, CAST(CAST(l_shipdate AS DATE) + CAST(CASE isodow(CAST(l_shipdate AS DATE)) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS INTEGER) AS DATE) AS date FROM lineitem"),
    "days": (["lines"], "SELECT DISTINCT date FROM lines"),
    "cal": (["days"], """
        SELECT date, CAST(date_trunc('month', date) AS DATE) AS period_start,
          row_number() OVER (ORDER BY date) - 1 AS pos,
          dense_rank() OVER (ORDER BY date_trunc('month', date)) - 1 AS period_id,
          max(date) OVER (PARTITION BY date_trunc('month', date)) AS period_end,
          row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY date DESC) AS back
        FROM days"""),
    "wcal": (["days"], """
        SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos,
          dense_rank() OVER (ORDER BY date_trunc('week', date)) - 1 AS period_id,
          max(date) OVER (PARTITION BY date_trunc('week', date)) AS period_end,
          row_number() OVER (PARTITION BY date_trunc('week', date) ORDER BY date DESC) AS back
        FROM days"""),
    "rets": (["lines"], """
        SELECT date, p_brand AS asset, avg(l_discount - l_tax) AS ret
        FROM lines JOIN part ON p_partkey = l_partkey GROUP BY 1, 2"""),
    "tops": ([], "SELECT DISTINCT o_orderpriority AS topic FROM orders"),
    "oday": ([], "SELECT CAST(unnest(generate_series(min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY)) AS DATE) AS date FROM orders"),
    "att_all": (["tops", "oday"], """
        SELECT d.date, t.topic, CAST(count(o.o_orderkey) AS DOUBLE) AS level
        FROM oday d CROSS JOIN tops t
        LEFT JOIN orders o ON CAST(o.o_orderdate AS DATE) = d.date AND o.o_orderpriority = t.topic
        GROUP BY 1, 2"""),
    "att": (["att_all", "cal"], "SELECT a.* FROM att_all a SEMI JOIN cal c ON a.date = c.date"),
    "grid": (["cal", "tops", "att"], """
        SELECT c.date, c.pos, c.period_id, c.back, t.topic, a.level
        FROM cal c CROSS JOIN tops t LEFT JOIN att a ON a.date = c.date AND a.topic = t.topic"""),
    "shk": (["grid"], """
        SELECT date, pos, period_id, back, topic,
          CASE WHEN count(level) OVER w = 5 THEN level - avg(level) OVER w END AS z
        FROM grid WINDOW w AS (PARTITION BY topic ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"""),
    "okday": (["shk"], "SELECT date FROM shk GROUP BY date HAVING count(z) = (SELECT count(*) FROM tops)"),
    "rfm": (["lines"], """
        SELECT max(date) AS date, avg(l_tax) / 252 AS rf FROM lines GROUP BY date_trunc('month', date)"""),
    "pret": (["rets", "cal"], """
        SELECT r.asset, c.period_id, c.period_end, sum(r.ret) AS ret, count(r.ret) AS n_days
        FROM rets r JOIN cal c USING (date) GROUP BY 1, 2, 3"""),
    # Direct definition of the kernel covariance: every day weighted on its own.
    "prods": (["rets", "shk", "okday"], """
        SELECT r.asset, s.topic, s.date, s.period_id, s.back, r.ret AS r, s.z
        FROM rets r JOIN shk s USING (date) SEMI JOIN okday k ON k.date = s.date"""),
    "periods": (["cal"], "SELECT DISTINCT period_id AS t, period_end FROM cal"),
    "kcov": (["prods", "periods"], """
        SELECT t AS period_id, asset, topic,
          sum(w * r * z) / sum(w) - sum(w * r) / sum(w) * (sum(w * z) / sum(w)) AS cov, count(*) AS n_days
        FROM (SELECT p.t, d.asset, d.topic, d.r, d.z, pow(0.99, p.t - d.period_id) AS w
              FROM periods p JOIN prods d ON d.period_id < p.t OR (d.period_id = p.t AND d.back > 1))
        GROUP BY 1, 2, 3 HAVING count(*) >= 60"""),
    "packed": (["kcov"], """
        SELECT period_id, asset, list_prepend(1.0, list(cov ORDER BY topic)) AS x
        FROM kcov GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM tops)"""),
    "pairs": (["packed", "pret"], """
        SELECT r.period_id, r.period_end AS period, r.asset, r.ret AS y, k.x
        FROM packed k JOIN pret r ON r.asset = k.asset AND r.period_id = k.period_id + 1
        WHERE k.period_id >= 12"""),
    "panel": (["pairs"], """
        SELECT dense_rank() OVER (ORDER BY period_id) - 1 AS t_idx, * EXCLUDE (period_id)
        FROM pairs WHERE period_id IN (SELECT period_id FROM pairs GROUP BY 1 HAVING count(*) >= 20)"""),
}


def with_ctes(names: str, body: str, **extra: str) -> str:
    """``body`` preceded by the named expressions and everything they read, then ``extra`` ones."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in CTES[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        visit(name)
    parts = [f"{n} AS ({CTES[n][1].strip()})" for n in ordered] + [f"{n} AS ({b.strip()})" for n, b in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip() if parts else body.strip()
