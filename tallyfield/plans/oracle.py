"""The domain tables once more, as DuckDB common table expressions."""

from __future__ import annotations

COMMON = """
trades AS (SELECT l_linestatus AS portfolio, p_brand AS ticker, CAST(l_shipdate AS DATE) AS date,
  CASE WHEN l_returnflag = 'R' THEN 'S' ELSE 'B' END AS side,
  CASE WHEN l_returnflag = 'R' THEN CAST(l_linenumber AS DOUBLE) ELSE l_quantity END AS quantity,
  floor(l_extendedprice * 100 / l_quantity + 0.5) AS price, l_discount AS discount
  FROM lineitem JOIN part ON l_partkey = p_partkey),
signed AS (SELECT *, CASE side WHEN 'B' THEN quantity ELSE -quantity END AS q FROM trades),
by_day AS (SELECT portfolio, ticker, date, SUM(q) AS signed_quantity,
  COALESCE(SUM(q) FILTER (price <> 0), 0) AS traded_quantity, COALESCE(SUM(q * price) FILTER (price <> 0), 0) AS signed_cash,
  COALESCE(SUM(quantity * price) FILTER (price <> 0), 0) AS gross_cash, COUNT(*) FILTER (price <> 0) AS n_trades
  FROM signed GROUP BY ALL),
instruments AS (SELECT DISTINCT p_brand AS ticker, 'C' || (CAST(substr(p_brand, 7) AS INT) % 5) AS ccy,
  'S' || (CAST(substr(p_brand, 7) AS INT) % 4) AS c1, 'C' || (CAST(substr(p_brand, 7) AS INT) % 5) AS c2 FROM part),
px0 AS (SELECT ticker, date, SUM(price) AS s, COUNT(*) AS volume FROM trades GROUP BY ALL),
px1 AS (SELECT *, floor(SUM(s) OVER w / SUM(volume) OVER w) AS close FROM px0 WINDOW w AS (PARTITION BY ticker ORDER BY date)),
prices AS (SELECT ticker, date, close, volume,
  CASE WHEN row_number() OVER (PARTITION BY ticker, date_trunc('quarter', date) ORDER BY date) = 1 THEN floor(close / 128) ELSE 0.0 END AS dividend,
  CASE WHEN CAST(substr(ticker, 7) AS INT) % 2 = 1 AND date = MIN(date) FILTER (date >= DATE '1998-06-01') OVER (PARTITION BY ticker) THEN 2.0 ELSE 0.0 END AS split
  FROM px1),
quoted AS (SELECT *, close * later AS raw_close, later * s1 AS split_factor FROM (
  SELECT *, COALESCE(product(s1) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1.0) AS later
  FROM (SELECT *, CASE WHEN split = 0 THEN 1.0 ELSE split END AS s1 FROM prices))),
fx AS (SELECT ccy, date, 1 + CAST(substr(ccy, 2) AS DOUBLE) / 8 + month(date) / 64 + day(date) / 1024 AS fx_rate
  FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem WHERE isodow(l_shipdate) < 6), (SELECT DISTINCT ccy FROM instruments)),
snapshots AS (SELECT portfolio, ticker, date, SUM(signed_quantity) OVER (PARTITION BY portfolio, ticker ORDER BY date) AS quantity FROM by_day),
spans AS (SELECT *, lead(date) OVER (PARTITION BY portfolio, ticker ORDER BY date) AS nxt, MAX(date) OVER (PARTITION BY portfolio) AS last FROM snapshots),
daily AS (SELECT portfolio, ticker, CAST(unnest(generate_series(CAST(date AS TIMESTAMP), CAST(CASE WHEN quantity = 0 THEN date ELSE COALESCE(nxt - 1, last) END AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date, quantity FROM spans),
priced AS (SELECT d.portfolio, d.ticker, d.date, d.quantity, i.ccy, i.c1, i.c2, q.close, q.dividend, q.split_factor, f.fx_rate
  FROM daily d LEFT JOIN instruments i USING (ticker) LEFT JOIN quoted q ON q.ticker = d.ticker AND q.date = d.date
  LEFT JOIN fx f ON f.ccy = i.ccy AND f.date = d.date),
filled AS (SELECT p.portfolio, p.ticker, p.date, p.ccy, p.c1, p.c2, p.quantity, last_value(p.close IGNORE NULLS) OVER w AS close,
  COALESCE(last_value(p.fx_rate IGNORE NULLS) OVER w, 1.0) AS fx_rate, last_value(p.split_factor IGNORE NULLS) OVER w AS split_factor,
  COALESCE(p.dividend, 0.0) AS dividend, b.traded_quantity, b.signed_cash, b.gross_cash, COALESCE(b.n_trades, 0) AS n_trades
  FROM priced p LEFT JOIN by_day b ON b.portfolio = p.portfolio AND b.ticker = p.ticker AND b.date = p.date
  WINDOW w AS (PARTITION BY p.portfolio, p.ticker ORDER BY p.date ROWS UNBOUNDED PRECEDING)),
lagged AS (SELECT *, lag(quantity) OVER w AS q1, lag(close) OVER w AS cl1, lag(fx_rate) OVER w AS x1,
  COALESCE(split_factor / NULLIF(lead(split_factor) OVER w, 0), 1.0) AS adj FROM filled WINDOW w AS (PARTITION BY portfolio, ticker ORDER BY date)),
valued AS (SELECT *, quantity * close AS mkt_value_lcl, COALESCE(q1 * cl1, 0) AS bod_lcl, COALESCE(q1 * cl1 * x1, 0) AS bod,
  COALESCE(q1 * adj * (close + dividend), 0) AS eod_lcl, COALESCE(q1 * adj * dividend, 0) AS income_pnl_lcl,
  COALESCE(traded_quantity * close - signed_cash, 0) AS tx_pnl_lcl, COALESCE(gross_cash, 0) AS gross FROM lagged),
profit AS (SELECT *, mkt_value_lcl * fx_rate AS mkt_value, eod_lcl * fx_rate AS eod, income_pnl_lcl * fx_rate AS income_pnl, tx_pnl_lcl * fx_rate AS tx_pnl,
  bod AS position_basis, bod_lcl AS position_basis_lcl, bod AS m2m_bod, eod_lcl - bod_lcl + tx_pnl_lcl AS pnl_lcl,
  CASE WHEN bod_lcl = 0 AND n_trades > 0 THEN gross ELSE bod_lcl END AS trb_lcl, CASE WHEN bod = 0 AND n_trades > 0 THEN gross * fx_rate ELSE bod END AS trb,
  eod_lcl * fx_rate - bod + tx_pnl_lcl * fx_rate AS pnl FROM valued),
perf AS (SELECT *, ret - ret_lcl + 1 AS ccy_ret FROM (SELECT *,
  CASE WHEN trb <> 0 THEN pnl / trb + 1 ELSE 1.0 END AS ret, CASE WHEN trb_lcl <> 0 THEN pnl_lcl / trb_lcl + 1 ELSE 1.0 END AS ret_lcl,
  CASE WHEN trb <> 0 THEN tx_pnl / trb + 1 ELSE 1.0 END AS tx_ret, CASE WHEN trb_lcl <> 0 THEN tx_pnl_lcl / trb_lcl + 1 ELSE 1.0 END AS tx_ret_lcl,
  CASE WHEN position_basis <> 0 THEN (pnl - tx_pnl) / position_basis + 1 ELSE 1.0 END AS ret_hlds,
  CASE WHEN position_basis_lcl <> 0 THEN (pnl_lcl - tx_pnl_lcl) / position_basis_lcl + 1 ELSE 1.0 END AS ret_hlds_lcl FROM profit)),
denominated AS (SELECT *, SUM(m2m_bod) OVER (PARTITION BY portfolio, date) AS denom_trb, SUM(mkt_value) OVER (PARTITION BY portfolio, date) AS denom_mv FROM perf),
weighted AS (SELECT *, w_trb * (ret - 1) AS contribution, w_trb * (ret_lcl - 1) AS contribution_lcl FROM (SELECT *, trb / NULLIF(denom_trb, 0) AS w_trb,
  position_basis / NULLIF(denom_trb, 0) AS w_pos, mkt_value / NULLIF(denom_mv, 0) * 100 AS w_mv FROM denominated)),
summed AS (SELECT portfolio, date, c1, c2, CASE GROUPING_ID(portfolio, date, c1, c2) WHEN 3 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS level,
  SUM(w_pos) AS wp, SUM(w_trb) AS wt, SUM(w_mv) AS w_mv, SUM((ret_hlds - 1) * w_pos) AS h, SUM((ret_hlds_lcl - 1) * w_pos) AS hl,
  SUM((tx_ret - 1) * w_trb) AS t, SUM((tx_ret_lcl - 1) * w_trb) AS tl, SUM(pnl) AS pnl, SUM(pnl_lcl) AS pnl_lcl, SUM(income_pnl) AS income_pnl,
  SUM(mkt_value) AS mkt_value, COALESCE(SUM(contribution), 0) AS contribution, SUM(close * w_mv / 100) AS close
  FROM weighted GROUP BY GROUPING SETS ((portfolio, date), (portfolio, date, c1), (portfolio, date, c1, c2))),
returned AS (SELECT *, wp AS w_pos, wt AS w_trb, CASE level WHEN 0 THEN COALESCE(h, 0) + 1 ELSE h / NULLIF(wp, 0) + 1 END AS ret_hlds,
  CASE level WHEN 0 THEN COALESCE(hl, 0) + 1 ELSE hl / NULLIF(wp, 0) + 1 END AS ret_hlds_lcl,
  CASE level WHEN 0 THEN COALESCE(t, 0) + 1 ELSE t / NULLIF(wt, 0) + 1 END AS tx_ret, CASE level WHEN 0 THEN COALESCE(tl, 0) + 1 ELSE tl / NULLIF(wt, 0) + 1 END AS tx_ret_lcl FROM summed),
nodes AS (SELECT *, ret - ret_lcl + 1 AS ccy_ret FROM (SELECT *, COALESCE(ret_hlds, 1) + COALESCE(tx_ret, 1) - 1 AS ret, COALESCE(ret_hlds_lcl, 1) + COALESCE(tx_ret_lcl, 1) - 1 AS ret_lcl FROM returned)),
root AS (SELECT * FROM nodes WHERE level = 0),
all_nodes AS MATERIALIZED (SELECT portfolio, date, level, c1, c2, NULL AS ticker, w_pos, w_trb, ret, ret_lcl, ret_hlds, ret_hlds_lcl, tx_ret_lcl, contribution FROM nodes
  UNION ALL SELECT portfolio, date, 3, c1, c2, ticker, w_pos, w_trb, ret, ret_lcl, ret_hlds, ret_hlds_lcl, tx_ret_lcl, contribution FROM weighted),
tree AS (SELECT COALESCE(a.date, b.date) AS date, COALESCE(a.level, b.level) AS level, COALESCE(a.c1, b.c1) AS c1, COALESCE(a.c2, b.c2) AS c2, COALESCE(a.ticker, b.ticker) AS ticker,
  a.w_pos, b.w_pos AS w_pos_bench, a.ret, b.ret AS ret_bench, a.ret_hlds_lcl, b.ret_hlds_lcl AS ret_hlds_lcl_bench
  FROM (SELECT * FROM all_nodes WHERE portfolio = 'F') a FULL JOIN (SELECT * FROM all_nodes WHERE portfolio = 'O') b
  ON a.date = b.date AND a.level = b.level AND a.c1 IS NOT DISTINCT FROM b.c1 AND a.c2 IS NOT DISTINCT FROM b.c2 AND a.ticker IS NOT DISTINCT FROM b.ticker),
sides AS (SELECT date, level, c1, c2, ticker, COALESCE(w_pos, 0) AS p, COALESCE(w_pos_bench, 0) AS b, COALESCE(ret_hlds_lcl, 1) AS rp, COALESCE(ret_hlds_lcl_bench, 1) AS rb FROM tree),
hurdle AS (SELECT date, rb AS h, rp AS root_rp FROM sides WHERE level = 0 AND p <> 0 AND b <> 0),
parented AS (SELECT s.*, h.h, h.root_rp, u.p AS pp, u.b AS bp FROM sides s JOIN hurdle h USING (date) LEFT JOIN sides u ON u.date = s.date AND u.level = s.level - 1 AND u.level >= 1
  AND u.c1 = s.c1 AND (u.level = 1 OR u.c2 = s.c2)),
effects0 AS (SELECT *, CASE WHEN level = 1 THEN (p - b) * (rb - h) WHEN level = 2 THEN COALESCE(p - pp * b / NULLIF(bp, 0), p) * (rp - h) END * 100 AS a0,
  CASE WHEN level IN (1, 2) THEN p * (rp - rb) WHEN level = 3 THEN COALESCE((p - pp * b / NULLIF(bp, 0)) * (rb - h), p * (rp - h)) END * 100 AS s0 FROM parented),
effects AS (SELECT e.*, CASE WHEN e.level = 0 THEN t.a ELSE a0 END AS allocation, CASE WHEN e.level = 0 THEN t.s ELSE s0 END AS selection,
  CASE WHEN e.level = 0 THEN (p - b) * (rb - 1) * 100 END AS leverage FROM effects0 e LEFT JOIN (SELECT date, SUM(a0) AS a, SUM(s0) AS s FROM effects0 WHERE level = 1 GROUP BY date) t ON t.date = e.date),
panel0 AS (SELECT user_id AS ticker, CAST(ts AS DATE) AS date, SUM(floor(value * 100 + 0.5)) AS s, COUNT(*) AS volume FROM events GROUP BY ALL),
panel AS (SELECT ticker, date, floor(SUM(s) OVER w / SUM(volume) OVER w) AS close, volume FROM panel0 WINDOW w AS (PARTITION BY ticker ORDER BY date)),
statements0 AS (SELECT o_custkey AS ticker, last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS period_end, CAST(SUM(floor(o_totalprice)) AS DOUBLE) AS revenue, CAST(COUNT(*) AS DOUBLE) AS n FROM orders GROUP BY ALL),
statements AS (SELECT ticker, CAST(period_end AS DATE) AS period_end, revenue, floor(revenue / 8) AS net_income, n * 1024 AS shares, n * 2 AS dividends, revenue / 65536 AS eps, floor(revenue / 4) AS cash_flow, revenue / 1024 AS price, revenue - 250000 AS equity FROM statements0),
customer_dates AS (SELECT DISTINCT o_custkey AS ticker, CAST(o_orderdate AS DATE) AS date FROM orders),
quarters AS (SELECT * FROM (SELECT d.ticker, d.date, s.* EXCLUDE (ticker), row_number() OVER (PARTITION BY d.ticker, d.date ORDER BY s.period_end DESC) AS quarter_no
  FROM customer_dates d JOIN statements s ON s.ticker = d.ticker AND s.period_end <= d.date - 45) WHERE quarter_no <= 8),
exposures AS (SELECT vec_id AS ticker, 'f' || i AS factor, floor(CAST(embedding[i + 1] AS DOUBLE) * 1024) / 1024 AS x FROM embeddings, (SELECT unnest([0, 1, 2, 3]) AS i)),
factor_returns AS (SELECT date, factor, (s % 2048 - 1024) / 65536 AS factor_return, (n % 16 - 8) / 2 AS t_stat FROM (
  SELECT CAST(ts AS DATE) AS date, event_type AS factor, CAST(SUM(floor(value * 100 + 0.5)) AS BIGINT) AS s, COUNT(*) AS n FROM events GROUP BY ALL)),
cov AS (SELECT 'f' || a AS i, 'f' || b AS j, CASE WHEN a = b THEN 4.0 ELSE 1.0 END / 65536 AS covariance FROM (SELECT unnest([0, 1, 2, 3]) AS a), (SELECT unnest([0, 1, 2, 3]) AS b)),
idio AS (SELECT vec_id AS ticker, (vec_id % 7 + 1) / 65536.0 AS idio_var FROM embeddings),
weights AS (SELECT portfolio, ticker, u / SUM(u) OVER (PARTITION BY portfolio) AS weight FROM (SELECT CAST(label AS VARCHAR) AS portfolio, vec_id AS ticker, CAST(vec_id % 5 + 1 AS DOUBLE) AS u FROM embeddings))
"""


def sql(body: str, more: str = "") -> str:
    """A query over the common tables; ``more`` has further expressions."""
    return f"WITH {COMMON.strip()}{', ' + more if more else ''} {body}"


def r(expression: str, name: str, digits: int = 6) -> str:
    """A rounded double without a negative zero."""
    return f"round(CAST({expression} AS DOUBLE), {digits}) + 0.0 AS {name}"
