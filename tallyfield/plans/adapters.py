"""Domain tables from the order, part, event and embedding tables.

Prices are whole cents and rates are binary fractions, so that sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfield.operators import positions as P
from tallyfield.operators.performance import daily_performance
from tallyfield.operators.rollup import rollup, weighted

CLASSES = ["c1", "c2"]
FIRST_SPLIT = "1998-06-01"


class Tables:
    """Tables of a data folder and the domain tables on them; each is a lazy plan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def trades(self) -> DataFrame:
        """(portfolio, ticker, date, side, quantity, price, discount, tax)."""
        line, part = self.read("lineitem"), self.read("part").select("p_partkey", "p_brand")
        sold = F.col("l_returnflag") == "R"
        return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_linestatus").alias("portfolio"), F.col("p_brand").alias("ticker"), F.to_date("l_shipdate").alias("date"),
            F.when(sold, "S").otherwise("B").alias("side"), F.when(sold, F.col("l_linenumber").cast("double")).otherwise(F.col("l_quantity")).alias("quantity"),
            F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity") + 0.5).cast("double").alias("price"), F.col("l_discount").alias("discount"),
        )

    def by_day(self) -> DataFrame:
        return P.daily_trades(self.trades())

    def instruments(self) -> DataFrame:
        n = F.substring("p_brand", 7, 9).cast("int")
        ccy = F.concat(F.lit("C"), (n % 5).cast("string"))
        return self.read("part").select(F.col("p_brand").alias("ticker"), ccy.alias("ccy"), F.concat(F.lit("S"), (n % 4).cast("string")).alias("c1"), ccy.alias("c2")).distinct()

    def prices(self) -> DataFrame:
        """(ticker, date, close, volume, dividend, split): close is the whole mean price so far; a
        dividend on a quarter's first price, and one split of odd brands."""
        one = self.trades().groupBy("ticker", "date").agg(F.sum("price").alias("s"), F.count(F.lit(1)).alias("volume"))
        w = Window.partitionBy("ticker").orderBy("date")
        e = w.rowsBetween(Window.unboundedPreceding, 0)
        one = one.withColumn("close", F.floor(F.sum("s").over(e) / F.sum("volume").over(e)).cast("double"))
        odd = F.substring("ticker", 7, 9).cast("int") % 2 == 1
        late = F.min(F.when(F.col("date") >= F.lit(FIRST_SPLIT).cast("date"), F.col("date"))).over(Window.partitionBy("ticker"))
        first = F.row_number().over(Window.partitionBy("ticker", F.trunc("date", "quarter")).orderBy("date")) == 1
        return one.select("ticker", "date", "close", "volume", F.when(first, F.floor(F.col("close") / 128).cast("double")).otherwise(0.0).alias("dividend"), F.when(odd & (F.col("date") == late), 2.0).otherwise(0.0).alias("split"))

    def fx(self) -> DataFrame:
        """(ccy, date, fx_rate): daily rates, of weekdays only."""
        days = self.read("lineitem").select(F.to_date("l_shipdate").alias("date")).distinct().where(F.weekday("date") < 5)
        ccys = self.instruments().select("ccy").distinct()
        # five currencies and the days there are
        both = days.crossJoin(F.broadcast(ccys))
        return both.select("ccy", "date", (1 + F.substring("ccy", 2, 9).cast("double") / 8 + F.month("date") / 64 + F.dayofmonth("date") / 1024).alias("fx_rate"))

    def snapshots(self) -> DataFrame:
        return P.running_quantity(self.by_day())

    def daily(self) -> DataFrame:
        return P.unroll_daily(self.snapshots())

    def priced(self) -> DataFrame:
        prices = P.unadjust_prices(self.prices()).select("ticker", "date", "close", "dividend", "split_factor")
        return P.price_positions(self.daily(), prices, self.fx(), self.instruments())

    def perf(self) -> DataFrame:
        return daily_performance(self.priced(), self.by_day())

    def weighted(self) -> DataFrame:
        return weighted(self.perf())

    def nodes(self) -> DataFrame:
        return rollup(self.weighted(), CLASSES)

    def root(self) -> DataFrame:
        return rollup(self.weighted(), [])

    def events_panel(self) -> DataFrame:
        """(ticker, date, close, volume) of users' event values."""
        one = self.read("events").groupBy(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date")).agg(F.sum(F.floor(F.col("value") * 100 + 0.5)).cast("double").alias("s"), F.count(F.lit(1)).alias("volume"))
        e = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        return one.select("ticker", "date", F.floor(F.sum("s").over(e) / F.sum("volume").over(e)).cast("double").alias("close"), "volume")

    def statements(self) -> DataFrame:
        """(ticker, period_end, revenue, net_income, shares, dividends, eps, cash_flow, price, equity) by customer and quarter."""
        q = self.read("orders").groupBy(F.col("o_custkey").alias("ticker"), F.last_day(F.add_months(F.trunc(F.to_date("o_orderdate"), "quarter"), 2)).alias("period_end")).agg(
            F.sum(F.floor("o_totalprice")).cast("double").alias("revenue"), F.count(F.lit(1)).cast("double").alias("n")
        )
        return q.select("ticker", "period_end", "revenue", F.floor(F.col("revenue") / 8).cast("double").alias("net_income"), (F.col("n") * 1024).alias("shares"), (F.col("n") * 2).alias("dividends"),
                        (F.col("revenue") / 65536).alias("eps"), F.floor(F.col("revenue") / 4).cast("double").alias("cash_flow"), (F.col("revenue") / 1024).alias("price"), (F.col("revenue") - 250000).alias("equity"))

    def customer_dates(self) -> DataFrame:
        """(ticker, date): a customer's order dates."""
        return self.read("orders").select(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("date")).distinct()

    def exposures(self, k: int = 4) -> DataFrame:
        """(ticker, factor, x): the first components of embeddings, in 1/1024."""
        e = self.read("embeddings")
        pairs = F.array(*(F.struct(F.lit(f"f{i}").alias("factor"), (F.floor(F.col("embedding")[i].cast("double") * 1024) / 1024).alias("x")) for i in range(k)))
        return e.select(F.col("vec_id").alias("ticker"), F.explode(pairs).alias("p")).select("ticker", "p.factor", "p.x")

    def factor_returns(self, k: int = 4) -> DataFrame:
        """(date, factor, factor_return, t_stat): daily sums of event values by type, as returns."""
        e = self.read("events").groupBy(F.to_date("ts").alias("date"), F.col("event_type").alias("factor")).agg(F.sum(F.floor(F.col("value") * 100 + 0.5)).alias("s"), F.count(F.lit(1)).alias("n"))
        return e.select("date", "factor", ((F.col("s") % 2048 - 1024) / 65536).alias("factor_return"), ((F.col("n") % 16 - 8) / 2).alias("t_stat"))

    def model_cov(self) -> DataFrame:
        """(i, j, covariance) between the embedding factors: a fixed positive form."""
        f = self.spark.range(4).select(F.col("id").alias("a"))
        both = f.crossJoin(F.broadcast(f.select(F.col("a").alias("b"))))
        return both.select(F.concat(F.lit("f"), F.col("a")).alias("i"), F.concat(F.lit("f"), F.col("b")).alias("j"), (F.when(F.col("a") == F.col("b"), 4.0).otherwise(1.0) / 65536).alias("covariance"))

    def model_idio(self) -> DataFrame:
        return self.read("embeddings").select(F.col("vec_id").alias("ticker"), ((F.col("vec_id") % 7 + 1) / 65536.0).alias("idio_var"))

    def model_weights(self) -> DataFrame:
        """(portfolio, ticker, weight): by label, in proportion to a whole number."""
        e = self.read("embeddings").select(F.col("label").cast("string").alias("portfolio"), F.col("vec_id").alias("ticker"), (F.col("vec_id") % 5 + 1).cast("double").alias("u"))
        return e.select("portfolio", "ticker", (F.col("u") / F.sum("u").over(Window.partitionBy("portfolio"))).alias("weight"))
