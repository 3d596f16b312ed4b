"""The registered queries of the portfolio engine, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfield.functions.columns import date_from, node_id, rounded
from tallyfield.operators import attribution as A
from tallyfield.operators import factors as X
from tallyfield.operators import fundamentals as C
from tallyfield.operators import indicators as I
from tallyfield.operators import linking as L
from tallyfield.operators import performance as D
from tallyfield.operators import positions as P
from tallyfield.operators import regime as G
from tallyfield.operators import risk as R
from tallyfield.operators import rollup as U
from tallyfield.plans.adapters import CLASSES, Tables
from tallyfield.plans.oracle import r, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEY = ["portfolio", "ticker", "date"]
SMALL = X.FactorSettings(momentum=10, momentum_skip=2, low_vol=10, reversal=3, liquidity=5, min_history=11, min_stocks=20)
DUMMY_SECTORS = ["0", "1", "2", "3", "4", "5", "6", "7", "8", "9"]


def query(oracle: str | None = None):
    """Register a function of the domain tables under its name."""

    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


#: Amounts of money: too large for six digits after the point.
MONEY = {"denom_trb", "denom_mv", "mkt_value", "mkt_value_lcl", "m2m_bod", "position_basis", "trb", "trb_lcl", "pnl", "pnl_lcl", "tx_pnl", "tx_pnl_lcl", "income_pnl", "income_pnl_lcl", "acc_pnl", "market_cap"}


def shown(df: DataFrame, keys: list, doubles: list[str], digits: int = 6) -> DataFrame:
    """Keys and rounded doubles."""
    return df.select(*keys, *(rounded(c, 2 if c in MONEY else digits).alias(c) for c in doubles))


def both(keys: list[str], doubles: list[str], digits: int = 6) -> str:
    """The same columns in SQL."""
    return ", ".join([*keys, *(r(c, c, 2 if c in MONEY else digits) for c in doubles)])


# --- scans, projections, scalars


@query("SELECT CAST(l_shipdate AS DATE) AS date, COUNT(*) AS n, SUM(l_quantity) AS quantity FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN "
       "(SELECT greatest(MIN(CAST(l_shipdate AS DATE)), DATE '1996-01-01') FROM lineitem WHERE l_linestatus = 'O') AND (SELECT least(MAX(CAST(l_shipdate AS DATE)), DATE '1997-06-30') FROM lineitem WHERE l_linestatus = 'O') GROUP BY ALL")  # fmt: skip
def scan_filter_window(t: Tables) -> DataFrame:
    line = t.read("lineitem").select(F.to_date("l_shipdate").alias("date"), "l_shipdate", "l_quantity", "l_linestatus")
    a, b = F.lit("1996-01-01").cast("date"), F.lit("1997-06-30").cast("date")
    window = line.where("l_linestatus = 'O'").agg(F.greatest(F.min("date"), a).alias("a"), F.least(F.max("date"), b).alias("b"))  # one row
    # the range that both ends lie in reaches the scan
    inside = line.where((F.col("l_shipdate") >= a) & (F.col("l_shipdate") < F.date_add(b, 1)))
    return inside.join(F.broadcast(window), F.col("date").between(F.col("a"), F.col("b"))).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query(sql(f"SELECT {both(['portfolio', 'date'], ['ret', 'contribution'])} FROM (SELECT portfolio, date, (ret - 1) * 100 AS ret, contribution * 100 AS contribution FROM root)"))
def pct_format(t: Tables) -> DataFrame:
    return shown(U.percent_form(t.root(), ("ret",), ("contribution",)), ["portfolio", "date"], ["ret", "contribution"])


@query("SELECT o_orderkey, upper(trim(o_orderpriority)) AS priority, split_part(o_orderpriority, '-', 2) AS label, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter, "
       "isodow(o_orderdate) - 1 AS weekday, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days, "
       "round(ln(o_totalprice), 6) + 0.0 AS log_price, round(sqrt(o_totalprice), 6) + 0.0 AS root_price, o_orderstatus IN ('F', 'O') AS known, CAST(o_orderdate AS DATE) AS parsed FROM orders")  # fmt: skip
def scalar_functions(t: Tables) -> DataFrame:
    d = F.to_date("o_orderdate")
    return t.read("orders").select(
        "o_orderkey", F.upper(F.trim("o_orderpriority")).alias("priority"), F.split("o_orderpriority", "-")[1].alias("label"), C.quarter_label(d).alias("quarter"),
        F.weekday(d).cast("bigint").alias("weekday"), F.trunc(d, "month").alias("month"), F.datediff(d, F.lit("1995-01-01").cast("date")).cast("bigint").alias("days"),
        rounded(F.ln("o_totalprice")).alias("log_price"), rounded(F.sqrt("o_totalprice")).alias("root_price"), F.col("o_orderstatus").isin("F", "O").alias("known"),
        date_from(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("parsed"),
    )


# --- positions


@query(sql("SELECT portfolio, ticker, date, quantity FROM snapshots"))
def pos_running_quantity(t: Tables) -> DataFrame:
    return t.snapshots().select(*KEY, "quantity")


@query(sql("SELECT * FROM daily UNION ALL SELECT portfolio, ticker, CAST(unnest(generate_series(CAST(date + 1 AS TIMESTAMP), CAST(last AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date, quantity FROM "
           "(SELECT d.*, p.last, row_number() OVER (PARTITION BY d.portfolio, d.ticker ORDER BY d.date DESC) AS n FROM daily d JOIN (SELECT ticker, MAX(date) AS last FROM prices GROUP BY ticker) p USING (ticker)) WHERE n = 1 AND quantity > 0 AND last > date"))  # fmt: skip
def pos_unroll_daily(t: Tables) -> DataFrame:
    return P.extend_to_last_price(t.daily(), t.prices()).select(*KEY, "quantity")


@query(sql(f"SELECT {both(['ticker', 'date'], ['raw_close', 'split_factor'])} FROM quoted"))
def pos_split_unadjust(t: Tables) -> DataFrame:
    return shown(P.unadjust_prices(t.prices()), ["ticker", "date"], ["raw_close", "split_factor"])


_FREE = "free AS (SELECT portfolio, ticker, date, side, quantity, CASE WHEN discount = 0 THEN 0.0 ELSE price END AS price FROM trades), split_days AS (SELECT DISTINCT ticker, date AS split_date FROM trades WHERE quantity = 50 AND side = 'B')"


@query(sql("SELECT portfolio, ticker, COALESCE(moved, date) AS date, COUNT(*) AS n, SUM(quantity) AS quantity FROM (SELECT f.*, (SELECT MIN(split_date) FROM split_days s WHERE f.price = 0 AND s.ticker = f.ticker AND s.split_date BETWEEN "
           "f.date - (CASE WHEN isodow(f.date) = 1 THEN 3 ELSE 1 END) AND f.date + (CASE WHEN isodow(f.date) = 5 THEN 3 ELSE 1 END)) AS moved FROM free f) GROUP BY ALL", _FREE))  # fmt: skip
def pos_split_date_align(t: Tables) -> DataFrame:
    trades = t.trades().withColumn("price", F.when(F.col("discount") == 0, 0.0).otherwise(F.col("price"))).drop("discount")
    splits = t.trades().where("quantity = 50 and side = 'B'").select("ticker", F.col("date").alias("split_date")).distinct()
    return P.align_split_dates(trades, splits).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"))


@query(sql("SELECT 'transactions' AS kind, portfolio AS name, COUNT(*) AS n, SUM(quantity) AS quantity FROM trades GROUP BY ALL UNION ALL SELECT 'assets', ticker, 1, NULL FROM (SELECT DISTINCT ticker FROM instruments)"))
def pos_append_merge(t: Tables) -> DataFrame:
    rows = t.trades().withColumn("date_cut", F.col("date") < F.lit("1998-01-01").cast("date"))
    merged = P.append_transactions(rows.where("date_cut").drop("discount"), rows.where("not date_cut"))
    assets = t.instruments().select(F.col("ticker").alias("isin"), F.col("ticker").alias("figi"), "ccy")
    one = P.append_assets(assets, assets.drop("ccy"))
    return merged.groupBy(F.lit("transactions").alias("kind"), F.col("portfolio").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity")).unionByName(
        one.select(F.lit("assets").alias("kind"), F.col("isin").alias("name"), F.lit(1).cast("bigint").alias("n"), F.lit(None).cast("double").alias("quantity"))
    )


@query("""WITH tx AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'NONE-' || o_custkey WHEN o_orderpriority = '1-URGENT' THEN 'EUR' ELSE c_name END AS isin, c_mktsegment AS currency FROM orders JOIN customer ON o_custkey = c_custkey),
inst AS (SELECT isin, currency, MIN_BY(ticker, exchange || ticker) AS ticker, MIN(exchange) AS exchange FROM (SELECT c_name AS isin, c_mktsegment AS currency, 'T' || c_nationkey AS ticker, 'X' || (c_custkey % 4) AS exchange FROM customer
  UNION ALL SELECT c_name, c_mktsegment, 'U' || c_nationkey, 'X' || (c_custkey % 3) FROM customer) GROUP BY ALL)
SELECT ticker, security_type, COUNT(*) AS n FROM (SELECT CASE WHEN t.isin = 'EUR' THEN 'EUR' ELSE i.ticker || CASE exchange WHEN 'X0' THEN '.A' WHEN 'X1' THEN '.B' ELSE '' END END AS ticker,
  CASE WHEN t.isin = 'EUR' THEN 'Currency' WHEN i.ticker IS NOT NULL THEN 'Common Stock' END AS security_type FROM tx t LEFT JOIN inst i ON i.isin = t.isin AND i.currency = t.currency) GROUP BY ALL""")
def pos_identifier_resolve(t: Tables) -> DataFrame:
    c = t.read("customer")
    p = F.col("o_orderpriority")
    isin = F.when(p == "5-LOW", F.concat(F.lit("NONE-"), "o_custkey")).when(p == "1-URGENT", "EUR").otherwise(F.col("c_name"))
    tx = t.read("orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(isin.alias("isin"), F.col("c_mktsegment").alias("currency"))
    listing = lambda a, m: c.select(F.col("c_name").alias("isin"), F.col("c_mktsegment").alias("currency"), F.concat(F.lit(a), "c_nationkey").alias("ticker"), F.concat(F.lit("X"), F.col("c_custkey") % m).alias("exchange"), F.lit("Common Stock").alias("security_type"))
    suffixes = t.spark.range(2).select(F.when(F.col("id") == 0, "X0").otherwise("X1").alias("exchange"), F.when(F.col("id") == 0, ".A").otherwise(".B").alias("suffix"))
    currencies = t.spark.range(1).select(F.lit("EUR").alias("isin"))
    resolved, discarded = P.resolve_identifiers(tx, listing("T", 4).unionByName(listing("U", 3)), suffixes, currencies)
    return resolved.unionByName(discarded).groupBy("ticker", "security_type").agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT ticker, CAST(unnest(generate_series(TIMESTAMP '2001-01-01', TIMESTAMP '2001-03-02', INTERVAL 1 DAY)) AS DATE) AS date, 1.0::DOUBLE AS close FROM (SELECT DISTINCT ccy AS ticker FROM instruments)"))
def pos_cash_calendar(t: Tables) -> DataFrame:
    return P.cash_calendar(t.instruments().select(F.col("ccy").alias("ticker")).distinct(), "2001-01-01", "2001-03-04")


_SHARES = "shares AS (SELECT ticker, CAST(date_trunc('quarter', date) AS DATE) AS report_date, COUNT(*) * 1000.0 AS shares FROM trades GROUP BY ALL)"
_INDEX = _SHARES + """, idx AS (SELECT * FROM (SELECT d.ticker, d.date, last_value(p.close IGNORE NULLS) OVER (PARTITION BY d.ticker ORDER BY d.date ROWS UNBOUNDED PRECEDING) AS close, s.shares
  FROM (SELECT ticker, CAST(unnest(generate_series(CAST(MIN(date) AS TIMESTAMP), CAST(MAX(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM prices GROUP BY ticker) d
  LEFT JOIN prices p ON p.ticker = d.ticker AND p.date = d.date ASOF LEFT JOIN shares s ON s.ticker = d.ticker AND s.report_date <= d.date) WHERE close IS NOT NULL AND shares IS NOT NULL)"""


@query(sql(f"SELECT {both(['ticker', 'date'], ['close', 'market_cap', 'quantity', 'weight'])} FROM (SELECT *, close * shares AS market_cap, shares / 1e5 AS quantity, close * shares / NULLIF(SUM(close * shares) OVER (PARTITION BY date), 0) * 100 AS weight FROM idx)", _INDEX))
def index_build(t: Tables) -> DataFrame:
    shares = t.trades().groupBy("ticker", F.trunc("date", "quarter").alias("report_date")).agg((F.count(F.lit(1)) * 1000.0).alias("shares"))
    return shown(P.build_index(t.prices(), shares), ["ticker", "date"], ["close", "market_cap", "quantity", "weight"])


# --- daily performance

_PERF = ["quantity", "close", "mkt_value", "position_basis", "trb", "pnl", "pnl_lcl", "ret", "ret_lcl", "ret_hlds", "ccy_ret", "tx_ret"]


@query(sql(f"SELECT {both(KEY, _PERF)} FROM perf"))
def perf_daily_flagship(t: Tables) -> DataFrame:
    return shown(t.perf(), KEY, _PERF)


@query(sql(f"SELECT {both(KEY, ['tx_pnl', 'tx_pnl_lcl', 'trb', 'trb_lcl', 'tx_ret', 'tx_ret_lcl'])} FROM perf WHERE n_trades > 0"))
def perf_trade_pnl(t: Tables) -> DataFrame:
    return shown(t.perf().where("n_trades > 0"), KEY, ["tx_pnl", "tx_pnl_lcl", "trb", "trb_lcl", "tx_ret", "tx_ret_lcl"])


@query(sql(f"SELECT {both(KEY, ['income_pnl', 'income_pnl_lcl', 'pnl_lcl'])} FROM perf WHERE income_pnl <> 0"))
def perf_income(t: Tables) -> DataFrame:
    return shown(t.perf().where("income_pnl <> 0"), KEY, ["income_pnl", "income_pnl_lcl", "pnl_lcl"])


@query(sql(f"SELECT {both(KEY, ['fx_rate', 'ccy_ret'])} FROM perf WHERE ccy_ret <> 1"))
def perf_fx_return(t: Tables) -> DataFrame:
    return shown(t.perf().where("ccy_ret <> 1"), KEY, ["fx_rate", "ccy_ret"])


@query(sql(f"SELECT {both(KEY, ['mkt_value', 'mkt_value_lcl', 'm2m_bod', 'pnl'])} FROM (SELECT * REPLACE (CASE WHEN c1 = 'S0' THEN 0 ELSE mkt_value END AS mkt_value, CASE WHEN c1 = 'S0' THEN 0 ELSE mkt_value_lcl END AS mkt_value_lcl, CASE WHEN c1 = 'S0' THEN 0 ELSE m2m_bod END AS m2m_bod) FROM perf)"))
def perf_futures_zero(t: Tables) -> DataFrame:
    kind = F.when(F.col("c1") == "S0", D.FUTURES[0]).otherwise("Common Stock")
    return shown(D.daily_performance(t.priced().withColumn("security_type", kind), t.by_day()), KEY, ["mkt_value", "mkt_value_lcl", "m2m_bod", "pnl"])


# --- weights, hierarchy, totals


@query(sql(f"SELECT {both(KEY, ['denom_trb', 'denom_mv', 'w_trb', 'w_pos', 'w_mv'])} FROM weighted"))
def agg_denominators_weights(t: Tables) -> DataFrame:
    return shown(t.weighted(), KEY, ["denom_trb", "denom_mv", "w_trb", "w_pos", "w_mv"])


@query(sql(f"SELECT {both(KEY, ['contribution', 'contribution_lcl'])} FROM weighted"))
def agg_contribution(t: Tables) -> DataFrame:
    return shown(t.weighted(), KEY, ["contribution", "contribution_lcl"])


_NODE = ["portfolio", "date", "level", "c1", "c2"]
_ROLL = ["ret", "ret_lcl", "ret_hlds", "tx_ret", "w_pos", "w_trb", "w_mv", "pnl", "income_pnl", "mkt_value", "contribution"]


@query(sql(f"SELECT {both(_NODE, _ROLL)} FROM nodes"))
def agg_rollup_returns(t: Tables) -> DataFrame:
    return shown(t.nodes(), _NODE, _ROLL)


@query(sql(f"SELECT {both(_NODE, ['ccy_ret'])} FROM nodes"))
def agg_ccy_return(t: Tables) -> DataFrame:
    return shown(t.nodes(), _NODE, ["ccy_ret"])


@query(sql(f"SELECT {both(_NODE, ['close'], 4)} FROM nodes"))
def agg_characteristics(t: Tables) -> DataFrame:
    return shown(U.rollup(U.classified(t.weighted(), CLASSES), CLASSES, ("close",)), _NODE, ["close"], 4)


@query(sql(f'SELECT date, {r("MAX(ret) FILTER (portfolio = {q}F{q})".format(q=chr(39)), "F")}, {r("MAX(ret) FILTER (portfolio = {q}O{q})".format(q=chr(39)), "O")} FROM root GROUP BY date'))
def agg_totals_wide(t: Tables) -> DataFrame:
    return shown(U.totals_wide(t.root(), "ret", ["F", "O"]), ["date"], ["F", "O"])


# --- linking

_FLAT = """firsts AS (SELECT portfolio, date, CASE WHEN n = 1 THEN 1.0 WHEN ret > 0 THEN ret ELSE 1.0 END AS tr, CASE WHEN n = 1 THEN 1.0 ELSE COALESCE(ret_lcl, 1) END AS sl, CASE WHEN n = 1 THEN 1.0 ELSE COALESCE(ccy_ret, 1) END AS sc
  FROM (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY date) AS n FROM root)),
ks AS (SELECT *, CASE WHEN tr = 1 THEN 1.0 ELSE ln(tr) / (tr - 1) END AS k, product(tr) OVER w AS total FROM firsts WINDOW w AS (PARTITION BY portfolio ORDER BY date))"""


@query(sql(f"SELECT {both(['portfolio', 'date'], ['acc_ret', 'acc_ret_lcl', 'acc_ccy_ret'], 5)} FROM (SELECT portfolio, date, total AS acc_ret, SUM(k * (sl - 1)) OVER w / big + 1 AS acc_ret_lcl, SUM(k * (sc - 1)) OVER w / big + 1 AS acc_ccy_ret "
           "FROM (SELECT *, CASE WHEN total = 1 THEN 1.0 ELSE ln(total) / (total - 1) END AS big FROM ks) WINDOW w AS (PARTITION BY portfolio ORDER BY date))", _FLAT))  # fmt: skip
def link_split(t: Tables) -> DataFrame:
    return shown(L.link_split(t.root(), ["portfolio"], "ret", ["ret_lcl", "ccy_ret"]), ["portfolio", "date"], ["acc_ret", "acc_ret_lcl", "acc_ccy_ret"], 5)


_ACTIVE = """pair AS (SELECT f.date, f.ret AS rp, o.ret AS rb, (f.ret - o.ret) * 100 AS e, row_number() OVER (ORDER BY f.date) AS n FROM root f JOIN root o ON o.date = f.date WHERE f.portfolio = 'F' AND o.portfolio = 'O'),
pair1 AS (SELECT date, CASE WHEN n = 1 THEN 1.0 WHEN rp > 0 THEN rp ELSE 1.0 END AS p, CASE WHEN n = 1 THEN 1.0 WHEN rb > 0 THEN rb ELSE 1.0 END AS b, CASE WHEN n = 1 THEN 0.0 ELSE e END AS e FROM pair),
pair2 AS (SELECT *, CASE WHEN p = b THEN 1 / p ELSE (ln(p) - ln(b)) / (p - b) END AS k, product(p) OVER w AS bp, product(b) OVER w AS bb FROM pair1 WINDOW w AS (ORDER BY date))"""


@query(sql(f"SELECT {both(['date'], ['acc_e', 'acc_active'], 4)} FROM (SELECT date, SUM(k * e) OVER (ORDER BY date) / CASE WHEN bp = bb THEN 1.0 ELSE (ln(bp) - ln(bb)) / (bp - bb) END AS acc_e, (bp - bb) * 100 AS acc_active FROM pair2)", _ACTIVE))
def link_active(t: Tables) -> DataFrame:
    root = t.root()
    f = root.where("portfolio = 'F'").select("date", F.col("ret").alias("rp"))
    o = root.where("portfolio = 'O'").select("date", F.col("ret").alias("rb"))
    rows = f.join(o, "date").withColumns({"e": (F.col("rp") - F.col("rb")) * 100, "pair": F.lit("F/O")})
    return shown(L.link_active(rows, ["pair"], "rp", "rb", ["e"]), ["date"], ["acc_e", "acc_active"], 4)


@query(sql(f"SELECT {both(KEY, ['acc_ret', 'acc_pnl'], 4)} FROM (SELECT portfolio, ticker, date, product(CASE WHEN n = 1 THEN 1.0 ELSE ret END) OVER w AS acc_ret, SUM(pnl) OVER w AS acc_pnl FROM (SELECT *, row_number() OVER (PARTITION BY portfolio, ticker ORDER BY date) AS n FROM perf) WINDOW w AS (PARTITION BY portfolio, ticker ORDER BY date))"))
def acc_pnl_return(t: Tables) -> DataFrame:
    return shown(L.accumulate(t.perf(), ["portfolio", "ticker"], ["ret"], ["pnl"]), KEY, ["acc_ret", "acc_pnl"], 4)


# --- indicators

_SERIES = "series AS (SELECT *, row_number() OVER (PARTITION BY portfolio, ticker ORDER BY date) AS n, CASE WHEN ret > 0 AND ret <> 1 THEN ln(ret) / (ret - 1) ELSE 1.0 END AS k FROM perf)"
_W = "(PARTITION BY portfolio, ticker ORDER BY date ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"


def _trailing(h, n):
    return f"CASE WHEN n > {n} THEN (product(ret) OVER {_W.format(n=n)} - 1) * 100 END AS ret_{h}"


def _trailing_local(h, n):
    total = f"product(ret) OVER {_W.format(n=n)}"
    return f"CASE WHEN n > {n} THEN SUM(k * (ret_lcl - 1)) OVER {_W.format(n=n)} / CASE WHEN {total} > 0 AND {total} <> 1 THEN ln({total}) / ({total} - 1) ELSE 1.0 END * 100 END AS ret_{h}_lcl"


_TRAIL = [f"ret_{h}" for h in I.HORIZONS]


@query(sql(f"SELECT {both(KEY, _TRAIL, 5)} FROM (SELECT portfolio, ticker, date, {', '.join(_trailing(h, n) for h, n in I.HORIZONS.items())} FROM series)", _SERIES))
def ind_trailing_returns(t: Tables) -> DataFrame:
    return shown(I.trailing_returns(t.perf(), ["portfolio", "ticker"]), KEY, _TRAIL, 5)


@query(sql(f"SELECT {both(KEY, [f'{c}_lcl' for c in _TRAIL], 4)} FROM (SELECT portfolio, ticker, date, {', '.join(_trailing_local(h, n) for h, n in I.HORIZONS.items())} FROM series)", _SERIES))
def ind_trailing_local(t: Tables) -> DataFrame:
    return shown(I.trailing_local(t.perf(), ["portfolio", "ticker"]), KEY, [f"{c}_lcl" for c in _TRAIL], 4)


_E = "(PARTITION BY portfolio ORDER BY date ROWS UNBOUNDED PRECEDING)"
_X = "xs AS (SELECT portfolio, date, ret, ret_lcl, ret - 1 AS x, ret_lcl - 1 AS xl, ln(CASE WHEN ret > 0 THEN ret ELSE 1.0 END) AS lr FROM root)"
_PD = ["portfolio", "date"]


@query(sql(f"SELECT {both(_PD, ['std_dev', 'std_dev_lcl', 'mean_ret'], 5)}, {r('CASE WHEN m2 > 1e-14 THEN m3 / power(m2, 1.5) END', 'skew', 2)} FROM (SELECT portfolio, date, stddev_pop(x) OVER {_E} * 100 AS std_dev, stddev_pop(xl) OVER {_E} * 100 AS std_dev_lcl, AVG(x) OVER {_E} * 100 AS mean_ret, "
           f"var_pop(x) OVER {_E} AS m2, AVG(x * x * x) OVER {_E} - 3 * AVG(x) OVER {_E} * AVG(x * x) OVER {_E} + 2 * power(AVG(x) OVER {_E}, 3) AS m3 FROM xs)", _X))  # fmt: skip
def ind_std_mean_skew(t: Tables) -> DataFrame:
    rows = I.spread(t.root(), ["portfolio"])
    skew = F.when(F.col("std_dev") / 100 > 1e-7, F.col("skew"))
    return shown(rows, _PD, ["std_dev", "std_dev_lcl", "mean_ret"], 5).join(rows.select(*_PD, rounded(skew, 2).alias("skew")), _PD)


@query(sql(f"SELECT {both(_PD, ['var_95', 'var_99'], 5)} FROM (SELECT portfolio, date, (1 - exp(AVG(lr) OVER {_E} - 1.64485 * stddev_pop(lr) OVER {_E})) * 100 AS var_95, (1 - exp(AVG(lr) OVER {_E} - 2.33 * stddev_pop(lr) OVER {_E})) * 100 AS var_99 FROM xs)", _X))
def ind_var(t: Tables) -> DataFrame:
    return shown(I.spread(t.root(), ["portfolio"]), _PD, ["var_95", "var_99"], 5)


@query(sql(f"SELECT {both(_PD, ['sharpe', 'downside'], 4)} FROM (SELECT portfolio, date, (AVG(x) OVER {_E} - 0.01 / 252) * sqrt(252.0) / NULLIF(stddev_pop(x) OVER {_E}, 0) AS sharpe, stddev_pop(CASE WHEN x < 0 THEN x END) OVER {_E} * sqrt(252.0) AS downside FROM xs)", _X))
def ind_sharpe_downside(t: Tables) -> DataFrame:
    return shown(I.spread(t.root(), ["portfolio"]), _PD, ["sharpe", "downside"], 4)


@query(sql(f"SELECT ticker, {r('stddev_pop(p.ret - b.ret) * sqrt(252.0)', 'tracking_error', 5)}, {r('covar_samp(p.ret - 1, b.ret - 1) / NULLIF(var_samp(b.ret - 1), 0)', 'beta', 5)}, COUNT(*) AS n_days FROM perf p JOIN root b ON b.date = p.date AND b.portfolio = 'O' WHERE p.portfolio = 'F' GROUP BY ticker"))
def ind_te_beta(t: Tables) -> DataFrame:
    bench = t.root().where("portfolio = 'O'").select("date", F.col("ret").alias("bench_ret"))
    return shown(I.tracking(t.perf().where("portfolio = 'F'"), bench, ["ticker"]), ["ticker", "n_days"], ["tracking_error", "beta"], 5)


# --- attribution

_TREE = ["date", "level", "c1", "c2", "ticker"]


def _tree(t: Tables) -> DataFrame:
    w = t.weighted()
    return A.merge_tree(A.tree_nodes(U.rollup(w, CLASSES), w, CLASSES), "F", "O", CLASSES)


_WA = "CASE WHEN w_pos IS NOT NULL OR w_pos_bench IS NOT NULL THEN COALESCE(w_pos, 0) - COALESCE(w_pos_bench, 0) END * 100"
_RA = "CASE WHEN ret IS NOT NULL OR ret_bench IS NOT NULL THEN COALESCE(ret, 1) - COALESCE(ret_bench, 1) END * 100"


@query(sql(f"SELECT {both(_TREE, ['w_pos', 'w_pos_bench'])}, {r(_WA, 'w_pos_active', 5)}, {r(_RA, 'ret_active', 5)} FROM tree"))
def tree_outer_merge(t: Tables) -> DataFrame:
    tree = _tree(t)
    return tree.select(*_TREE, *(rounded(c).alias(c) for c in ("w_pos", "w_pos_bench")), *(rounded(c, 5).alias(c) for c in ("w_pos_active", "ret_active")))


_EFFECTS = ["allocation", "selection", "leverage"]


@query(sql(f"SELECT {both(_TREE, _EFFECTS, 5)} FROM effects"))
def attr_daily_effects(t: Tables) -> DataFrame:
    return shown(A.daily_effects(_tree(t), CLASSES), _TREE, _EFFECTS, 5)


_LINKED = """own AS (SELECT date, level, c1, c2, ticker, allocation, selection, leverage, CASE WHEN level = 3 THEN rp ELSE root_rp END AS xp, CASE WHEN level = 3 THEN rb ELSE h END AS xb, row_number() OVER (PARTITION BY level, c1, c2, ticker ORDER BY date) AS n FROM effects),
own1 AS (SELECT *, CASE WHEN n = 1 OR NOT xp > 0 THEN 1.0 ELSE xp END AS p, CASE WHEN n = 1 OR NOT xb > 0 THEN 1.0 ELSE xb END AS b FROM own),
own2 AS (SELECT *, CASE WHEN p = b THEN 1 / p ELSE (ln(p) - ln(b)) / (p - b) END AS k, product(p) OVER w AS bp, product(b) OVER w AS bb FROM own1 WINDOW w AS (PARTITION BY level, c1, c2, ticker ORDER BY date)),
own3 AS (SELECT *, CASE WHEN bp = bb THEN 1.0 ELSE (ln(bp) - ln(bb)) / (bp - bb) END AS big FROM own2)"""


@query(sql(f"SELECT {both(['date', 'level', 'c1', 'c2', 'ticker'], ['acc_allocation', 'acc_selection', 'acc_leverage', 'acc_active'], 3)} FROM (SELECT *, (bp - bb) * 100 AS acc_active, " + ", ".join(f"SUM(k * CASE WHEN n = 1 THEN 0.0 ELSE COALESCE({e}, 0) END) OVER (PARTITION BY level, c1, c2, ticker ORDER BY date) / big AS acc_{e}" for e in _EFFECTS) + " FROM own3)", _LINKED))
def attr_linked(t: Tables) -> DataFrame:
    return shown(A.linked_effects(A.daily_effects(_tree(t), CLASSES), CLASSES), _TREE, ["acc_allocation", "acc_selection", "acc_leverage", "acc_active"], 3)


@query(sql(f"SELECT {both(['date'], _EFFECTS, 5)} FROM effects WHERE level = 0 AND date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND dayofweek(date) = 0"))
def attr_weekly_trend(t: Tables) -> DataFrame:
    return shown(A.trend(A.daily_effects(_tree(t), CLASSES).where("level = 0"), "1997-01-01", "1998-12-31"), ["date"], _EFFECTS, 5)


# --- fundamentals


def _quarters(t: Tables) -> DataFrame:
    return C.asof_quarters(t.customer_dates(), t.statements())


@query(sql(f"SELECT {both(['ticker', 'date', 'period_end', 'quarter_no'], ['revenue'])} FROM quarters"))
def asof_fundamentals(t: Tables) -> DataFrame:
    return shown(_quarters(t), ["ticker", "date", "period_end", F.col("quarter_no").cast("bigint").alias("quarter_no")], ["revenue"])


@query(sql("SELECT ticker, date, last_value(c IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS close FROM (SELECT d.ticker, d.date, arg_min(p.close, abs(p.date - d.date) * 10 + CASE WHEN p.date > d.date THEN 1 ELSE 0 END) AS c "
           "FROM (SELECT DISTINCT user_id AS ticker, CAST(ts AS DATE) AS date FROM events WHERE event_type = 'view') d LEFT JOIN (SELECT * FROM panel WHERE volume > 2) p ON p.ticker = d.ticker AND abs(p.date - d.date) <= 1 GROUP BY ALL)"))  # fmt: skip
def asof_nearest_price(t: Tables) -> DataFrame:
    dates = t.read("events").where("event_type = 'view'").select(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date")).distinct()
    return C.nearest_price(dates, t.events_panel().where("volume > 2")).select("ticker", "date", "close")


_VAL = ["pe", "pcf", "eps", "avg_shares", "market_cap", "net_income", "dividend_yield"]


@query(sql(f"SELECT {both(['ticker', 'date'], _VAL, 5)} FROM (SELECT ticker, date, AVG(price) / NULLIF(SUM(eps), 0) AS pe, AVG(price) / NULLIF(SUM(cash_flow / NULLIF(shares, 0)), 0) AS pcf, SUM(eps) AS eps, AVG(shares) AS avg_shares, SUM(shares * price) / 4 AS market_cap, SUM(net_income) AS net_income, SUM(dividends) / NULLIF(AVG(price), 0) * 100 AS dividend_yield FROM quarters WHERE quarter_no <= 4 GROUP BY ALL HAVING COUNT(*) >= 4)"))
def char_ratios(t: Tables) -> DataFrame:
    return shown(C.valuation_ratios(_quarters(t)), ["ticker", "date"], _VAL, 5)


@query(sql(f"SELECT {both(['ticker', 'date'], ['revenue_ttm', 'revenue_yoy', 'net_income_ttm', 'net_income_yoy'], 4)} FROM (SELECT ticker, date, " + ", ".join(
    f"CASE WHEN COUNT(*) FILTER (quarter_no <= 4) >= 2 THEN SUM({f}) FILTER (quarter_no <= 4) * 4 / COUNT(*) FILTER (quarter_no <= 4) END AS {f}_ttm, (arg_max({f}, period_end) - arg_min({f}, period_end)) * 100 / NULLIF(abs(arg_min({f}, period_end)), 0) AS {f}_yoy" for f in ("revenue", "net_income")) + " FROM quarters GROUP BY ALL)"))
def char_ttm_yoy(t: Tables) -> DataFrame:
    return shown(C.trailing_sums(_quarters(t), ["revenue", "net_income"]), ["ticker", "date"], ["revenue_ttm", "revenue_yoy", "net_income_ttm", "net_income_yoy"], 4)


_PERIODS = "CASE s_suppkey % 5 WHEN 0 THEN '0q' WHEN 1 THEN '+1q' WHEN 2 THEN '0y' WHEN 3 THEN '+1y' ELSE 'LTG' END"


@query("SELECT ticker, " + ", ".join(f"MAX(v) FILTER (p = '{p}') AS \"earnings_{p.lstrip('+')}\"" for p in C.ESTIMATE_PERIODS) + f" FROM (SELECT s_nationkey AS ticker, {_PERIODS} AS p, s_acctbal AS v FROM supplier) GROUP BY ticker")
def char_estimates(t: Tables) -> DataFrame:
    m = F.col("s_suppkey") % 5
    p = F.when(m == 0, "0q").when(m == 1, "+1q").when(m == 2, "0y").when(m == 3, "+1y").otherwise("LTG")
    return C.estimates_wide(t.read("supplier").select(F.col("s_nationkey").alias("ticker"), F.lit("earnings").alias("kind"), p.alias("period"), F.col("s_acctbal").alias("value")), ["earnings"])


# --- factors

_FAC = f"""fac AS (SELECT * FROM (SELECT date, ticker, row_number() OVER w AS n, lag(close, 2) OVER w / lag(close, 9) OVER w - 1 AS momentum, -(close / lag(close, 3) OVER w - 1) AS reversal,
  ln(AVG(close * volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) AS liquidity,
  -stddev_samp(q) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) * sqrt(252.0) AS low_vol FROM (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS q FROM panel) WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE n >= {SMALL.min_history})"""
_DT = ["date", "ticker"]


@query(sql(f"SELECT {both(_DT, ['momentum'])} FROM fac", _FAC))
def fac_momentum(t: Tables) -> DataFrame:
    return shown(X.price_factors(t.events_panel(), SMALL), _DT, ["momentum"])


@query(sql(f"SELECT {both(_DT, ['low_vol'])} FROM fac", _FAC))
def fac_lowvol(t: Tables) -> DataFrame:
    return shown(X.price_factors(t.events_panel(), SMALL), _DT, ["low_vol"])


@query(sql(f"SELECT {both(_DT, ['reversal', 'liquidity'])} FROM fac", _FAC))
def fac_reversal_liquidity(t: Tables) -> DataFrame:
    return shown(X.price_factors(t.events_panel(), SMALL), _DT, ["reversal", "liquidity"])


_Z = _FAC + """, clip AS (SELECT date, ticker, momentum AS raw, COUNT(momentum) OVER d AS n, greatest(least(momentum, AVG(momentum) OVER d + 3 * stddev_samp(momentum) OVER d), AVG(momentum) OVER d - 3 * stddev_samp(momentum) OVER d) AS c FROM fac WINDOW d AS (PARTITION BY date)),
zs AS (SELECT date, ticker, CASE WHEN n >= 5 AND stddev_samp(c) OVER d > 0 AND raw IS NOT NULL THEN (c - AVG(c) OVER d) / stddev_samp(c) OVER d ELSE 0.0 END AS momentum FROM clip WINDOW d AS (PARTITION BY date))"""


@query(sql(f"SELECT {both(_DT, ['momentum'], 5)} FROM zs", _Z))
def fac_winsor_z(t: Tables) -> DataFrame:
    return shown(X.winsor_z(X.price_factors(t.events_panel(), SMALL).select(*_DT, "momentum"), ["momentum"]), _DT, ["momentum"], 5)


@query("SELECT vec_id, " + ", ".join(f"CASE WHEN label = {s} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sector_{s}" for s in DUMMY_SECTORS[1:]) + " FROM embeddings")
def fac_sector_dummies(t: Tables) -> DataFrame:
    return X.sector_dummies(t.read("embeddings").select("vec_id", F.col("label").cast("string").alias("sector")), DUMMY_SECTORS).drop("sector")


_VF = ["size", "value_ep", "value_bp", "quality_roe", "quality_gm"]


@query(sql(f"SELECT {both(['ticker', 'period_end'], _VF)} FROM (SELECT ticker, period_end, ln(price * shares) AS size, net_income / NULLIF(price * shares, 0) AS value_ep, equity / NULLIF(price * shares, 0) AS value_bp, CASE WHEN equity > 0 THEN net_income / equity END AS quality_roe, cash_flow / NULLIF(revenue, 0) AS quality_gm FROM statements)"))
def fac_values(t: Tables) -> DataFrame:
    return shown(X.value_factors(t.statements().withColumn("gross_profit", F.col("cash_flow"))), ["ticker", "period_end"], _VF)


# --- risk

_RET = _Z + """, rets AS (SELECT date, ticker, q AS ret FROM (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS q FROM panel) WHERE q BETWEEN -0.5 AND 0.5),
days AS (SELECT date, lag(date) OVER (ORDER BY date) AS before FROM (SELECT DISTINCT date FROM rets)),
cross_section AS (SELECT r.date, r.ticker, r.ret, z.momentum FROM rets r JOIN days d USING (date) JOIN zs z ON z.date = d.before AND z.ticker = r.ticker)"""


def _cross_section(t: Tables) -> DataFrame:
    panel = t.events_panel()
    z = X.winsor_z(X.price_factors(panel, SMALL).select(*_DT, "momentum", "reversal"), ["momentum", "reversal"])
    return X.previous_exposures(z, X.daily_returns(panel))


@query(sql(f"SELECT {both(['date'], ['factor_return'], 7)} FROM (SELECT date, SUM(momentum * ret) / NULLIF(SUM(momentum * momentum), 0) AS factor_return FROM cross_section GROUP BY date HAVING COUNT(*) >= 20)", _RET))
def risk_wls_single(t: Tables) -> DataFrame:
    return shown(R.wls_single(_cross_section(t), "momentum"), ["date"], ["factor_return"], 7)


def _scores(columns: list[str], source: str, keep: str = "") -> str:
    """Clipped cross-sectional z-scores of columns of ``source`` (date, ticker, ...)."""
    clip = ", ".join(f"{c} AS raw_{c}, COUNT({c}) OVER d AS n_{c}, CASE WHEN {c} IS NOT NULL THEN greatest(least({c}, AVG({c}) OVER d + 3 * stddev_samp({c}) OVER d), AVG({c}) OVER d - 3 * stddev_samp({c}) OVER d) END AS c_{c}" for c in columns)
    score = ", ".join(f"CASE WHEN n_{c} >= 5 AND stddev_samp(c_{c}) OVER d > 0 AND raw_{c} IS NOT NULL THEN (c_{c} - AVG(c_{c}) OVER d) / stddev_samp(c_{c}) OVER d ELSE 0.0 END AS {c}" for c in columns)
    return f"SELECT date, ticker{keep}, {score} FROM (SELECT date, ticker{keep}, {clip} FROM {source} WINDOW d AS (PARTITION BY date)) WINDOW d AS (PARTITION BY date)"


_TWO = _RET + f""", two AS ({_scores(["momentum", "reversal"], "fac")}),
xy AS (SELECT r.date, r.ret AS y, z.momentum AS a, z.reversal AS b FROM rets r JOIN days d USING (date) JOIN two z ON z.date = d.before AND z.ticker = r.ticker),
mom2 AS (SELECT date, COUNT(*) AS n, SUM(a * a) AS aa, SUM(a * b) AS ab, SUM(b * b) AS bb, SUM(a * y) AS ay, SUM(b * y) AS yb, SUM(y * y) AS yy, SUM(y) AS sy FROM xy GROUP BY date HAVING COUNT(*) >= 20),
sol AS (SELECT *, aa * bb - ab * ab AS det, (bb * ay - ab * yb) / (aa * bb - ab * ab) AS fa, (aa * yb - ab * ay) / (aa * bb - ab * ab) AS fb FROM mom2),
err AS (SELECT *, yy - fa * ay - fb * yb AS sse, yy - sy * sy / n AS sst FROM sol)"""


@query(sql(f"SELECT {both(['date', 'factor'], ['factor_return', 't_stat', 'r2'], 5)} FROM (SELECT date, 'momentum' AS factor, fa AS factor_return, fa / sqrt(bb / det * sse / n) AS t_stat, 1 - sse / sst AS r2 FROM err UNION ALL SELECT date, 'reversal', fb, fb / sqrt(aa / det * sse / n), 1 - sse / sst FROM err)", _TWO))
def risk_wls_multi(t: Tables) -> DataFrame:
    return shown(R.wls_multi(_cross_section(t), ["momentum", "reversal"], ieee=True), ["date", "factor"], ["factor_return", "t_stat", "r2"], 5)


_ALL = [*X.PRICE_FACTORS, *X.VALUE_FACTORS]
_PANEL = _FAC.replace("SELECT date, ticker, row_number()", "SELECT date, ticker, close AS price, row_number()") + f""", reported AS (SELECT * FROM (SELECT f.ticker, f.date, s.* EXCLUDE (ticker), row_number() OVER (PARTITION BY f.ticker, f.date ORDER BY s.period_end DESC) AS quarter_no FROM fac f JOIN statements s ON s.ticker = f.ticker AND s.period_end <= f.date - 45) WHERE quarter_no <= 8),
flow AS (SELECT ticker, date, arg_max(equity, period_end) AS equity, arg_max(shares, period_end) AS shares, {", ".join(f"CASE WHEN COUNT(*) FILTER (quarter_no <= 4) >= 2 THEN SUM({c}) FILTER (quarter_no <= 4) * 4 / COUNT(*) FILTER (quarter_no <= 4) END AS {c}" for c in ("net_income", "revenue", "cash_flow"))} FROM reported GROUP BY ALL),
style AS (SELECT f.*, price * shares AS cap, ln(CASE WHEN price * shares > 0 THEN price * shares END) AS size, net_income / NULLIF(price * shares, 0) AS value_ep, equity / NULLIF(price * shares, 0) AS value_bp, CASE WHEN equity > 0 THEN net_income / equity END AS quality_roe, cash_flow / NULLIF(revenue, 0) AS quality_gm FROM fac f LEFT JOIN flow USING (ticker, date)),
full_panel AS ({_scores(_ALL, "style", ", cap")})"""


@query(sql(f"SELECT {both(['date', 'ticker'], ['cap', *_ALL], 4)}, {', '.join(f'CASE WHEN ticker % 4 = {i} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sector_{i}' for i in (1, 2, 3))} FROM full_panel", _PANEL))
def risk_exposure_panel(t: Tables) -> DataFrame:
    """All factors of the calibration: price, value and quality scores and sector dummies, with the capitalisation."""
    sectors = t.read("events").select(F.col("user_id").alias("ticker"), (F.col("user_id") % 4).cast("string").alias("sector")).distinct()
    z, _ = X.exposure_panel(t.events_panel(), SMALL, t.statements().withColumn("gross_profit", F.col("cash_flow")), sectors, ["0", "1", "2", "3"], ieee=True)
    return shown(z, ["date", "ticker", "sector_1", "sector_2", "sector_3"], ["cap", *_ALL], 4).select("date", "ticker", *(rounded(c, 4).alias(c) for c in ("cap", *_ALL)), "sector_1", "sector_2", "sector_3")


_LAM = "0.5 ** (1 / 63.0)"
_COV = f"""aged AS (SELECT f.*, dense_rank() OVER (ORDER BY date) AS i, (SELECT COUNT(DISTINCT date) FROM factor_returns) AS n FROM factor_returns f),
ewma AS (SELECT a.factor AS i, b.factor AS j, SUM(CASE WHEN a.i = 1 THEN CASE WHEN a.factor = b.factor THEN ({_LAM}) ** (a.n - 1) * a.factor_return * b.factor_return ELSE 0 END ELSE (1 - {_LAM}) * ({_LAM}) ** (a.n - a.i) * a.factor_return * b.factor_return END) AS covariance FROM aged a JOIN aged b ON a.date = b.date GROUP BY ALL)"""


@query(sql(f"SELECT {both(['i', 'j'], ['covariance'], 9)} FROM ewma", _COV))
def risk_ewma_cov(t: Tables) -> DataFrame:
    return shown(R.ewma_covariance(t.factor_returns()), ["i", "j"], ["covariance"], 9)


@query(sql(f"SELECT {both(['i', 'j'], ['correlation'])} FROM (SELECT e.i, e.j, e.covariance / NULLIF(sqrt(a.covariance * b.covariance), 0) AS correlation FROM ewma e JOIN ewma a ON a.i = e.i AND a.j = e.i JOIN ewma b ON b.i = e.j AND b.j = e.j)", _COV))
def risk_correlation(t: Tables) -> DataFrame:
    return shown(R.correlation(R.ewma_covariance(t.factor_returns())), ["i", "j"], ["correlation"])


_IDIO = "0.5 ** (1 / 21.0)"


@query(sql(f"SELECT ticker, {r('SUM(CASE WHEN i = 1 THEN (' + _IDIO + ') ** (n - 1) ELSE (1 - ' + _IDIO + ') * (' + _IDIO + ') ** (n - i) END * q * q)', 'idio_var', 8)} FROM (SELECT ticker, q, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i, COUNT(*) OVER (PARTITION BY ticker) AS n FROM (SELECT ticker, date, ret AS q FROM rets)) GROUP BY ticker", _RET))
def risk_ewma_idio(t: Tables) -> DataFrame:
    return shown(R.ewma_idio(X.daily_returns(t.events_panel()).withColumnRenamed("ret", "residual")), ["ticker"], ["idio_var"], 8)


_XFX = "xfx AS (SELECT a.ticker, SUM(a.x * c.covariance * b.x) AS f FROM exposures a JOIN cov c ON c.i = a.factor JOIN exposures b ON b.ticker = a.ticker AND b.factor = c.j GROUP BY a.ticker)"
_VOLS = ["factor_vol", "idio_vol", "total_vol", "factor_share"]


@query(sql(f"SELECT {both(['ticker'], _VOLS, 5)} FROM (SELECT ticker, sqrt(greatest(f, 0) * 252) * 100 AS factor_vol, sqrt(idio_var * 252) * 100 AS idio_vol, sqrt((f + idio_var) * 252) * 100 AS total_vol, f / (f + idio_var) * 100 AS factor_share FROM xfx JOIN idio USING (ticker))", _XFX))
def risk_stock(t: Tables) -> DataFrame:
    return shown(R.stock_risk(t.exposures(), t.model_cov(), t.model_idio()), ["ticker"], _VOLS, 5)


_BETA = """beta AS (SELECT portfolio, factor, SUM(weight * x) AS beta FROM weights JOIN exposures USING (ticker) GROUP BY ALL),
pvar AS (SELECT a.portfolio, SUM(a.beta * c.covariance * b.beta) AS fv FROM beta a JOIN cov c ON c.i = a.factor JOIN beta b ON b.portfolio = a.portfolio AND b.factor = c.j GROUP BY ALL),
psum AS (SELECT * FROM pvar JOIN (SELECT portfolio, SUM(weight * weight * idio_var) AS iv FROM weights JOIN idio USING (ticker) GROUP BY ALL) USING (portfolio))"""
_RISK = ["factor_vol", "idio_vol", "total_vol", "var_95", "var_99"]


@query(sql(f"SELECT {both(['portfolio'], _RISK, 4)} FROM (SELECT portfolio, sqrt(greatest(fv, 0) * 252) * 100 AS factor_vol, sqrt(iv * 252) * 100 AS idio_vol, sqrt((fv + iv) * 252) * 100 AS total_vol, sqrt(fv + iv) * sqrt(10.0) * 1.6449 * 1e6 AS var_95, sqrt(fv + iv) * sqrt(10.0) * 2.3263 * 1e6 AS var_99 FROM psum)", _BETA))
def risk_portfolio_var(t: Tables) -> DataFrame:
    return shown(R.portfolio_risk(t.model_weights(), t.exposures(), t.model_cov(), t.model_idio(), horizon_days=10), ["portfolio"], _RISK, 4)


_RC = _BETA + """, fb AS (SELECT b.portfolio, c.i AS factor, SUM(c.covariance * b.beta) AS fb FROM beta b JOIN cov c ON c.j = b.factor GROUP BY ALL),
rc AS (SELECT w.portfolio, w.ticker, ANY_VALUE(w.weight) AS weight, SUM(e.x * f.fb) AS m FROM weights w JOIN exposures e USING (ticker) JOIN fb f ON f.portfolio = w.portfolio AND f.factor = e.factor GROUP BY ALL),
rc1 AS (SELECT r.portfolio, r.ticker, r.weight, r.weight * (r.m + i.idio_var * r.weight) AS c, SUM(r.weight * (r.m + i.idio_var * r.weight)) OVER (PARTITION BY r.portfolio) AS v FROM rc r JOIN idio i USING (ticker)),
rc2 AS (SELECT portfolio, CAST(ticker AS BIGINT) AS ticker, weight, c / v * 100 AS rc_pct, c / sqrt(v) * sqrt(252.0) * 100 AS rc_vol FROM rc1)"""


@query(sql(f"SELECT {both(['portfolio', 'ticker'], ['weight', 'rc_pct', 'rc_vol'])} FROM (SELECT * FROM rc2 UNION ALL SELECT portfolio, NULL, SUM(weight), SUM(rc_pct), SUM(rc_vol) FROM rc2 GROUP BY portfolio)", _RC))
def risk_euler(t: Tables) -> DataFrame:
    return shown(R.euler(t.model_weights(), t.exposures(), t.model_cov(), t.model_idio()), ["portfolio", "ticker"], ["weight", "rc_pct", "rc_vol"])


_SUM = ["mean", "std", "min", "max", "avg_t", "avg_abs_t", "significant_pct", "cumulative", "sharpe"]


@query(sql(f"SELECT {both(['factor'], _SUM, 5)}, abs(sharpe) > 4 AS implausible_sharpe, abs(avg_t) > 1.5 AS implausible_t FROM (SELECT *, mean / std AS sharpe FROM (SELECT factor, AVG(factor_return) * 252 * 100 AS mean, stddev_samp(factor_return) * sqrt(252.0) * 100 AS std, MIN(factor_return) AS min, MAX(factor_return) AS max, AVG(t_stat) AS avg_t, AVG(abs(t_stat)) AS avg_abs_t, AVG(CASE WHEN abs(t_stat) > 2 THEN 1.0 ELSE 0.0 END) * 100 AS significant_pct, product(1 + factor_return) AS cumulative FROM factor_returns GROUP BY factor))"))
def risk_factor_summary(t: Tables) -> DataFrame:
    out = R.factor_summary(t.factor_returns())
    return out.select("factor", *(rounded(c, 5).alias(c) for c in _SUM), "implausible_sharpe", "implausible_t")


def _factor_inputs(t: Tables):
    """Holdings of users by event day, exposures to event types, factor returns and portfolio returns."""
    e = t.read("events").select(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date"), "event_type", (F.col("user_id") % 3).cast("string").alias("portfolio"))
    held = e.groupBy("portfolio", "date", "ticker").agg(F.count(F.lit(1)).alias("n"))
    day = Window.partitionBy("portfolio", "date")
    weights = held.select("portfolio", "date", "ticker", (F.col("n") / F.sum("n").over(day)).alias("weight"))
    x = e.groupBy("date", "ticker", F.col("event_type").alias("factor")).agg(F.count(F.lit(1)).cast("double").alias("x"))
    returns = held.groupBy("portfolio", "date").agg((1 + (F.sum("n") % 32 - 16) / 1024).alias("ret_hlds"))
    return weights, x, t.factor_returns(), returns


_FA = """ev AS (SELECT user_id AS ticker, CAST(ts AS DATE) AS date, event_type, CAST(user_id % 3 AS VARCHAR) AS portfolio FROM events),
held AS (SELECT portfolio, date, ticker, COUNT(*) AS n FROM ev GROUP BY ALL), wt AS (SELECT portfolio, date, ticker, n / SUM(n) OVER (PARTITION BY portfolio, date) AS weight FROM held),
xs AS (SELECT date, ticker, event_type AS factor, CAST(COUNT(*) AS DOUBLE) AS x FROM ev GROUP BY ALL), pr AS (SELECT portfolio, date, 1 + (CAST(SUM(n) AS BIGINT) % 32 - 16) / 1024 AS ret_hlds FROM held GROUP BY ALL),
comp AS (SELECT *, CASE WHEN date = MIN(date) OVER (PARTITION BY portfolio) THEN 0 ELSE b * factor_return END AS component FROM (SELECT portfolio, date, factor, SUM(weight * x) AS b FROM wt JOIN xs USING (date, ticker) GROUP BY ALL) JOIN factor_returns USING (date, factor)),
tot AS (SELECT portfolio, date, SUM(component) AS component FROM comp GROUP BY ALL),
fa AS (SELECT portfolio, date, factor, component FROM comp UNION ALL SELECT portfolio, date, 'total', component FROM tot
  UNION ALL SELECT portfolio, date, 'excess', CASE WHEN date = MIN(date) OVER (PARTITION BY portfolio) THEN 0 ELSE COALESCE(ret_hlds, 1) - 1 - component END FROM tot LEFT JOIN pr USING (portfolio, date))"""
_PDF = ["portfolio", "date", "factor"]


@query(sql(f"SELECT {both(_PDF, ['component'], 7)} FROM fa", _FA))
def fattr_daily(t: Tables) -> DataFrame:
    return shown(R.factor_attribution(*_factor_inputs(t)), _PDF, ["component"], 7)


_FL = _FA + """, fl AS (SELECT f.portfolio, f.date, f.factor, row_number() OVER (PARTITION BY f.portfolio, f.factor ORDER BY f.date) AS n, f.component, COALESCE(p.ret_hlds, 1) AS ret FROM fa f LEFT JOIN pr p USING (portfolio, date)),
fl1 AS (SELECT *, CASE WHEN n = 1 OR NOT ret > 0 THEN 1.0 ELSE ret END AS tr, CASE WHEN n = 1 THEN 0.0 ELSE component END AS c FROM fl),
fl2 AS (SELECT *, CASE WHEN tr = 1 THEN 1.0 ELSE ln(tr) / (tr - 1) END AS k, product(tr) OVER (PARTITION BY portfolio, factor ORDER BY date) AS total FROM fl1)"""


@query(sql(f"SELECT {both(_PDF, ['acc_component'])} FROM (SELECT portfolio, date, factor, SUM(k * c) OVER (PARTITION BY portfolio, factor ORDER BY date) / CASE WHEN total = 1 THEN 1.0 ELSE ln(total) / (total - 1) END AS acc_component FROM fl2)", _FL))
def fattr_linked(t: Tables) -> DataFrame:
    inputs = _factor_inputs(t)
    return shown(R.linked_factor_attribution(R.factor_attribution(*inputs), inputs[3]), _PDF, ["acc_component"])


# --- regimes and construction


def _beliefs(t: Tables) -> DataFrame:
    """(date, regime, probability): two regimes with a probability from the day's event count."""
    d = t.read("events").groupBy(F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.col("n") % 64 / 64)
    return d.select("date", F.explode(F.array(F.struct(F.lit(0).alias("regime"), F.col("p").alias("probability")), F.struct(F.lit(1).alias("regime"), (1 - F.col("p")).alias("probability")))).alias("b")).select("date", "b.*")


_BEL = "bel AS (SELECT date, regime, CASE regime WHEN 0 THEN p ELSE 1 - p END AS probability FROM (SELECT CAST(ts AS DATE) AS date, COUNT(*) % 64 / 64 AS p FROM events GROUP BY ALL), (SELECT unnest([0, 1]) AS regime))"
_TRANS = "tr AS (SELECT * FROM (VALUES (0, 0, 0.75::DOUBLE), (0, 1, 0.25), (1, 0, 0.125), (1, 1, 0.875)) v(i, j, p))"


@query(sql(f"SELECT date, regime, {r('probability', 'probability')}, {r('dwell_days', 'dwell_days')} FROM (SELECT b.date, t.j AS regime, SUM(b.probability * t.p) AS probability, MAX(s.d) AS dwell_days FROM bel b JOIN tr t ON t.i = b.regime JOIN (SELECT i, 1 / (1 - p) AS d FROM tr WHERE i = j) s ON s.i = t.j WHERE b.date = (SELECT MAX(date) FROM bel) GROUP BY ALL)", _BEL + ", " + _TRANS))
def regime_next_belief(t: Tables) -> DataFrame:
    b = _beliefs(t)
    last = b.agg(F.max("date").alias("date"))  # one row
    now = b.join(F.broadcast(last), "date")
    trans = t.spark.range(4).select((F.col("id") >= 2).cast("int").alias("i"), (F.col("id") % 2).cast("int").alias("j"), F.element_at(F.array(*map(F.lit, (0.75, 0.25, 0.125, 0.875))), (F.col("id") + 1).cast("int")).alias("p"))
    out = G.next_belief(now.select("regime", "probability"), trans)
    return out.crossJoin(F.broadcast(last)).select("date", "regime", rounded("probability").alias("probability"), rounded("dwell_days").alias("dwell_days"))


@query(sql(f"SELECT left_id, right_id, {r('sqrt(SUM((a.m - b.m) ** 2 + (a.s - b.s) ** 2))', 'distance', 5)} FROM (SELECT label AS left_id, factor, AVG(x) AS m, stddev_pop(x) AS s FROM exposures JOIN embeddings ON vec_id = ticker GROUP BY ALL) a JOIN (SELECT label AS right_id, factor, AVG(x) AS m, stddev_pop(x) AS s FROM exposures JOIN embeddings ON vec_id = ticker GROUP BY ALL) b USING (factor) GROUP BY ALL"))
def regime_w2_diag(t: Tables) -> DataFrame:
    labels = t.read("embeddings").select(F.col("vec_id").alias("ticker"), F.col("label").alias("id"))
    m = t.exposures().join(labels, "ticker").groupBy("id", "factor").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    return shown(G.wasserstein_diagonal(m, m), ["left_id", "right_id"], ["distance"], 5)


_MOM = _BEL + """, nx AS (SELECT * FROM (SELECT date, factor, lead(factor_return) OVER (PARTITION BY factor ORDER BY date) AS q FROM factor_returns) WHERE q IS NOT NULL),
mom AS (SELECT regime, factor, SUM(probability * q) / NULLIF(SUM(probability), 0) AS mean FROM bel JOIN nx USING (date) GROUP BY ALL),
dv AS (SELECT b.date, b.regime, b.probability, n.factor, n.q - m.mean AS d FROM bel b JOIN nx n USING (date) JOIN mom m ON m.regime = b.regime AND m.factor = n.factor)"""


@query(sql(f"SELECT regime, i, j, {r('covariance', 'covariance', 9)} FROM (SELECT a.regime, a.factor AS i, b.factor AS j, SUM(a.probability * a.d * b.d) / NULLIF(SUM(a.probability), 0) AS covariance FROM dv a JOIN dv b ON a.date = b.date AND a.regime = b.regime GROUP BY ALL) UNION ALL SELECT regime, factor, NULL, {r('mean', 'mean', 8)} FROM mom", _MOM))
def regime_weighted_moments(t: Tables) -> DataFrame:
    means, cov = G.weighted_moments(_beliefs(t), t.factor_returns())
    return cov.select("regime", "i", "j", rounded("covariance", 9).alias("covariance")).unionByName(means.select("regime", F.col("factor").alias("i"), F.lit(None).cast("string").alias("j"), rounded("mean", 8).alias("covariance")))


@query()
def regime_hmm(t: Tables) -> DataFrame:
    """Rolling fits of a daily two-factor series of trades, the order picked on a holdout."""
    w = Window.orderBy("month")
    e = t.trades().groupBy(F.trunc("date", "month").alias("month")).agg(F.avg("price").alias("a"), F.avg("quantity").alias("b"), F.count(F.lit(1)).alias("n"))  # one row a month
    s = e.select(F.col("month").alias("date"), F.array(F.col("a") / F.lag("a").over(w) - 1, F.col("b") / F.lag("b").over(w) - 1).alias("x")).where("x[0] is not null")
    fits = G.fit_windows(s, window=60, refit=10, k_range=(1, 2), holdout=12)
    return G.best_order(fits).select("window_id", "k", "score", "last_date")


_IR = _XFX + ", scored AS (SELECT ticker, mu / sqrt(greatest(f + idio_var, 1e-12)) AS information_ratio FROM (SELECT ticker, SUM(x * m) AS mu FROM exposures JOIN (SELECT 'f' || i AS factor, (i + 1) / 1024.0 AS m FROM (SELECT unnest([0, 1, 2, 3]) AS i)) USING (factor) GROUP BY ticker) JOIN xfx USING (ticker) JOIN idio USING (ticker))"


def _tilt(t: Tables) -> DataFrame:
    return t.spark.range(4).select(F.concat(F.lit("f"), "id").alias("factor"), ((F.col("id") + 1) / 1024.0).alias("mean"))


@query(sql(f"SELECT ticker, {r('information_ratio', 'information_ratio', 5)} FROM scored ORDER BY scored.information_ratio DESC, ticker LIMIT 20", _IR))
def construct_topn(t: Tables) -> DataFrame:
    x, cov = t.exposures(), t.model_cov()
    mu = x.join(_tilt(t), "factor").groupBy("ticker").agg(F.sum(F.col("x") * F.col("mean")).alias("mu"))
    half = x.join(cov, x.factor == cov.i).select("ticker", "x", F.col("j").alias("factor2"), "covariance").join(x.select("ticker", F.col("factor").alias("factor2"), F.col("x").alias("x2")), ["ticker", "factor2"])
    var = half.groupBy("ticker").agg(F.sum(F.col("x") * F.col("covariance") * F.col("x2")).alias("fv"))
    scored = mu.join(var, "ticker").join(t.model_idio(), "ticker").select("ticker", (F.col("mu") / F.sqrt(F.greatest(F.col("fv") + F.col("idio_var"), F.lit(1e-12)))).alias("information_ratio"))
    return shown(G.top_names(scored, 20), ["ticker"], ["information_ratio"], 5)


@query()
def construct_qp(t: Tables) -> DataFrame:
    before = t.model_weights().where("portfolio = '0'").select("ticker", "weight")
    return G.construct_portfolio(t.exposures(), t.model_cov(), t.model_idio(), _tilt(t), before, target_n=50, max_weight=0.1)



# --- smaller operators


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS isin, CAST(o_orderdate AS DATE) AS transaction_date, CASE o_orderstatus WHEN 'F' THEN 'B' WHEN 'O' THEN 'S' ELSE o_orderstatus END AS buy_sell, o_totalprice AS price FROM orders""")
def pos_map_transactions(t: Tables) -> DataFrame:
    raw = t.read("orders").select(F.col("o_orderkey").cast("string").alias("Id"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("Day"), F.col("o_orderstatus").alias("Way"), F.col("o_totalprice").alias("Paid"))
    return P.map_transactions(raw, {"Id": "isin", "Day": "transaction_date", "Way": "buy_sell", "Paid": "price", "None": "nothing"}, {"F": "B", "O": "S"}, "dd/MM/yyyy")


@query(sql("SELECT portfolio, MAX(date) AS date FROM weighted WHERE w_mv IS NOT NULL AND date BETWEEN DATE '1998-03-01' - 10 AND DATE '1998-03-01' GROUP BY portfolio"))
def scan_latest_valid_date(t: Tables) -> DataFrame:
    target = F.lit("1998-03-01").cast("date")
    return t.weighted().where(F.col("w_mv").isNotNull() & F.col("date").between(F.date_sub(target, 10), target)).groupBy("portfolio").agg(F.max("date").alias("date"))


@query("""WITH f AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_linestatus = 'F'), o AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_linestatus = 'O')
SELECT 'both' AS kind, l_partkey FROM (SELECT * FROM f INTERSECT SELECT * FROM o) UNION ALL SELECT 'only F', l_partkey FROM (SELECT * FROM f EXCEPT SELECT * FROM o)
UNION ALL SELECT 'no order', p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey) UNION ALL SELECT 'returned', p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')""")
def set_operations(t: Tables) -> DataFrame:
    line, part = t.read("lineitem"), t.read("part").select(F.col("p_partkey").alias("l_partkey"))
    of = lambda s: line.where(F.col("l_linestatus") == s).select("l_partkey").distinct()
    named = lambda kind, df: df.select(F.lit(kind).alias("kind"), "l_partkey")
    out = named("both", of("F").intersect(of("O"))).unionByName(named("only F", of("F").subtract(of("O"))))
    out = out.unionByName(named("no order", part.join(line.select("l_partkey"), "l_partkey", "left_anti")))
    return out.unionByName(named("returned", part.join(line.where("l_returnflag = 'R'").select("l_partkey"), "l_partkey", "left_semi")))


@query(sql(f"SELECT {both(['portfolio', 'date', 'ticker'], ['weight'])} FROM (SELECT portfolio, date, ticker, COALESCE(CASE WHEN abs(b) > 1e-12 THEN w_pos WHEN abs(m) > 1e-12 THEN w_mv / 100 ELSE 1.0 / n END, 0) AS weight FROM (SELECT *, SUM(w_pos) OVER d AS b, SUM(w_mv) OVER d AS m, COUNT(*) OVER d AS n FROM weighted WINDOW d AS (PARTITION BY portfolio, date)))"))
def agg_resolved_weights(t: Tables) -> DataFrame:
    return shown(R.resolved_weights(t.weighted()), ["portfolio", "date", "ticker"], ["weight"])


@query(sql("SELECT portfolio, ticker, date, COALESCE(last_value(CASE WHEN month(date) % 2 = 0 THEN c1 END IGNORE NULLS) OVER (PARTITION BY portfolio, ticker ORDER BY date ROWS UNBOUNDED PRECEDING), 'Not Classified') AS c1, 'Not Classified' AS sector FROM perf"))
def agg_classified(t: Tables) -> DataFrame:
    rows = t.perf().withColumn("c1", F.when(F.month("date") % 2 == 0, F.col("c1")))
    return U.classified(rows, ["c1", "sector"]).select("portfolio", "ticker", "date", "c1", "sector")


@query(sql("SELECT date, CASE level WHEN 0 THEN '.[top]' WHEN 1 THEN '[' || c1 || '\\]' WHEN 2 THEN '[' || c1 || '\\' || c2 || ']' ELSE '[' || c1 || '\\' || c2 || ']\\' || ticker END AS node FROM all_nodes WHERE portfolio = 'F'"))
def tree_node_ids(t: Tables) -> DataFrame:
    w = t.weighted().where("portfolio = 'F'")
    nodes = A.tree_nodes(U.rollup(w, CLASSES), w, CLASSES)
    return nodes.select("date", node_id(F.col("level"), [F.col("c1"), F.col("c2")], F.col("ticker")).alias("node"))


@query(sql(f"SELECT {both(['date', 'ticker'], ['ret', 'momentum'])} FROM (SELECT *, COUNT(*) OVER (PARTITION BY date) AS n FROM cross_section) WHERE n >= 20", _RET))
def fac_previous_exposures(t: Tables) -> DataFrame:
    rows = _cross_section(t).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("date"))).where("n >= 20")
    return shown(rows, ["date", "ticker"], ["ret", "momentum"])


@query(sql(f"SELECT factor, date, {r('product(1 + factor_return) OVER (PARTITION BY factor ORDER BY date)', 'cumulative')} FROM factor_returns"))
def risk_cumulative_returns(t: Tables) -> DataFrame:
    w = Window.partitionBy("factor").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return t.factor_returns().select("factor", "date", rounded(F.product(1 + F.col("factor_return")).over(w)).alias("cumulative"))


@query(sql("SELECT regime, COUNT(*) AS days FROM (SELECT date, arg_max(regime, probability * 10 - regime) AS regime FROM bel GROUP BY date) GROUP BY regime", _BEL))
def regime_days(t: Tables) -> DataFrame:
    top = _beliefs(t).groupBy("date").agg(F.max_by("regime", F.col("probability") * 10 - F.col("regime")).alias("regime"))
    return top.groupBy("regime").agg(F.count(F.lit(1)).alias("days"))


@query(sql(f"SELECT {both(['ticker', 'date'], ['equity', 'cash'], 4)} FROM (SELECT ticker, date, arg_max(equity, period_end) AS equity, arg_max(cash_flow, period_end) AS cash FROM quarters GROUP BY ALL)"))
def char_latest_values(t: Tables) -> DataFrame:
    q = _quarters(t).withColumn("none", F.lit(None).cast("double"))
    return shown(C.latest_values(q, {"equity": ["equity"], "cash": ["none", "cash_flow"]}), ["ticker", "date"], ["equity", "cash"], 4)


@query(sql(f"SELECT d.ticker, d.date, {r('v.pe', 'pe', 5)} FROM customer_dates d LEFT JOIN (SELECT ticker, date, AVG(price) / NULLIF(SUM(eps), 0) AS pe FROM quarters WHERE quarter_no <= 4 GROUP BY ALL HAVING COUNT(*) >= 4) v ON v.ticker = d.ticker AND v.date = d.date"))
def char_attach(t: Tables) -> DataFrame:
    out = C.attach(t.customer_dates(), C.valuation_ratios(_quarters(t)), ["pe", "not there"])
    return shown(out, ["ticker", "date"], ["pe"], 5)


@query(sql(f"SELECT portfolio, factor, {r('beta', 'beta')}, {r('variance', 'variance', 9)} FROM (SELECT a.portfolio, a.factor, MAX(a.beta) AS beta, SUM(a.beta * c.covariance * b.beta) AS variance FROM beta a JOIN cov c ON c.i = a.factor JOIN beta b ON b.portfolio = a.portfolio AND b.factor = c.j GROUP BY ALL)", _BETA))
def risk_factor_contributions(t: Tables) -> DataFrame:
    out = R.factor_contributions(t.model_weights(), t.exposures(), t.model_cov())
    return out.select("portfolio", "factor", rounded("beta").alias("beta"), rounded("variance", 9).alias("variance"))


@query("SELECT 'f' || i AS factor, CASE WHEN i = 3 THEN 0 ELSE 0.25::DOUBLE END + 0.5 * ((i + 1) / 1024.0 - CASE WHEN i = 3 THEN 0 ELSE 0.25 END) AS mean FROM (SELECT unnest([0, 1, 2]) AS i) UNION ALL SELECT 'sector_x', 0.5 * 4 / 1024.0::DOUBLE")
def regime_tilt(t: Tables) -> DataFrame:
    name = F.when(F.col("factor") == "f3", "sector_x").otherwise(F.col("factor")).alias("factor")
    regime = _tilt(t).select(name, "mean")
    return G.shrunk_tilt(regime.select("factor", F.lit(0.25).alias("mean")), regime, 0.5)
