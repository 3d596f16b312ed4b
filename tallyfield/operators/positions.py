"""From transactions to dense, priced daily positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions.columns import carried

POSITION = ["portfolio", "ticker"]


class MappingError(ValueError):
    """A column mapping that can't be applied."""


def map_transactions(raw: DataFrame, columns: dict[str, str], codes: dict[str, str], date_format: str) -> DataFrame:
    """Raw rows with internal names, parsed dates and B / S codes; unknown names are ignored."""
    if clash := set(columns.values()) & (set(columns) - {k for k, v in columns.items() if k == v}):
        raise MappingError(f"targets are also sources: {sorted(clash)}")
    out = raw.withColumnsRenamed({k: v for k, v in columns.items() if k in raw.columns})
    code = F.col("buy_sell")
    mapped = F.coalesce(*(F.when(code == k, v) for k, v in codes.items()), code) if codes else code
    return out.withColumns({"buy_sell": mapped, "transaction_date": F.to_date(F.col("transaction_date").cast("string"), date_format)})


def resolve_identifiers(transactions: DataFrame, instruments: DataFrame, suffixes: DataFrame, currencies: DataFrame, preferred_exchange: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(resolved, discarded) transactions.

    ``instruments`` (isin, currency, ticker, exchange, security_type): the first by exchange and ticker
    stands for an (isin, currency), one at ``preferred_exchange`` before all others. ``suffixes`` (exchange, suffix): the first in order is put after
    the ticker. Ids in ``currencies`` (isin) are spot currencies.
    """
    liked = F.coalesce(F.col("exchange") == preferred_exchange, F.lit(False)) if preferred_exchange else F.lit(False)
    first = Window.partitionBy("isin", "currency").orderBy(F.desc(liked), "exchange", "ticker")
    known = instruments.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    one = suffixes.groupBy("exchange").agg(F.min("suffix").alias("suffix"))
    known = known.join(one, "exchange", "left").withColumn("ticker", F.concat("ticker", F.coalesce("suffix", F.lit("")))).drop("suffix", "exchange")
    spot = currencies.select("isin", F.lit(True).alias("_spot")).distinct()
    out = transactions.join(known, ["isin", "currency"], "left").join(spot, "isin", "left")
    out = out.withColumns({
        "ticker": F.when(F.col("_spot"), F.col("isin")).otherwise(F.col("ticker")),
        "security_type": F.when(F.col("_spot"), "Currency").otherwise(F.col("security_type")),
    }).drop("_spot")
    return out.where("ticker is not null"), out.where("ticker is null")


def append_transactions(before: DataFrame, new: DataFrame) -> DataFrame:
    """Append mode: transactions are all kept, repeated ones too."""
    return before.unionByName(new, allowMissingColumns=True)


def append_assets(before: DataFrame, new: DataFrame) -> DataFrame:
    """Append mode: one asset for each isin and figi."""
    return before.unionByName(new, allowMissingColumns=True).dropDuplicates(["isin", "figi"])


def align_split_dates(trades: DataFrame, splits: DataFrame) -> DataFrame:
    """Trades without a price move to the earliest split date within a business day.

    From Monday the look back, and from Friday the look ahead, is three days. ``splits`` has (ticker,
    split_date).
    """
    day = F.weekday("date")
    back = F.when(day == 0, 3).otherwise(1)
    ahead = F.when(day == 4, 3).otherwise(1)
    free = trades.where("price = 0").select("ticker", "date", back.alias("_b"), ahead.alias("_a")).distinct()
    near = free.join(splits, "ticker").where("split_date between date_sub(date, _b) and date_add(date, _a)")
    moved = near.groupBy("ticker", "date").agg(F.min("split_date").alias("_to")).withColumn("price", F.lit(0.0))
    out = trades.join(moved, ["ticker", "date", "price"], "left")
    return out.withColumn("date", F.coalesce("_to", "date")).select(*trades.columns)


def daily_trades(trades: DataFrame) -> DataFrame:
    """Trades summed by position and date before anything is joined: signed quantity, and of priced
    trades signed quantity, signed and gross cash and how many there are.

    ``trades`` has portfolio, ticker, date, side (B, S; others count for nothing), quantity, price.
    """
    sign = F.when(F.col("side") == "B", 1.0).when(F.col("side") == "S", -1.0).otherwise(0.0)
    q = sign * F.col("quantity")
    priced = F.col("price") != 0
    return trades.groupBy(*POSITION, "date").agg(
        F.sum(q).alias("signed_quantity"),
        F.coalesce(F.sum(F.when(priced, q)), F.lit(0.0)).alias("traded_quantity"),
        F.coalesce(F.sum(F.when(priced, q * F.col("price"))), F.lit(0.0)).alias("signed_cash"),
        F.coalesce(F.sum(F.when(priced, F.col("quantity") * F.col("price"))), F.lit(0.0)).alias("gross_cash"),
        F.count(F.when(priced & (sign != 0), 1)).alias("n_trades"),
    )


def running_quantity(by_day: DataFrame) -> DataFrame:
    """End-of-day quantity on every date with trades; it may go below zero."""
    w = Window.partitionBy(*POSITION).orderBy("date")
    return by_day.select(*POSITION, "date", F.sum("signed_quantity").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("quantity"))


def unroll_daily(snapshots: DataFrame) -> DataFrame:
    """Calendar days from each snapshot to the day before the next, at most to the portfolio's last
    snapshot; an empty position isn't carried on."""
    w = Window.partitionBy(*POSITION).orderBy("date")
    last = snapshots.groupBy("portfolio").agg(F.max("date").alias("_last"))
    out = snapshots.withColumn("_next", F.lead("date").over(w)).join(last, "portfolio")
    until = F.when(F.col("quantity") == 0, F.col("date")).otherwise(F.coalesce(F.date_sub("_next", 1), F.col("_last")))
    days = F.explode(F.sequence("date", until, F.expr("interval 1 day")))
    return out.select(*POSITION, days.alias("date"), "quantity")


def extend_to_last_price(daily: DataFrame, prices: DataFrame) -> DataFrame:
    """Long positions go on from their last day to their ticker's last price."""
    w = Window.partitionBy(*POSITION).orderBy(F.desc("date"))
    last = daily.withColumn("_n", F.row_number().over(w)).where("_n = 1 and quantity > 0").drop("_n")
    end = prices.groupBy("ticker").agg(F.max("date").alias("_end"))
    more = last.join(end, "ticker").where("_end > date")
    more = more.select(*POSITION, F.explode(F.sequence(F.date_add("date", 1), "_end", F.expr("interval 1 day"))).alias("date"), "quantity")
    return daily.unionByName(more)


def unadjust_prices(prices: DataFrame) -> DataFrame:
    """Prices as they were quoted: close times all later splits; split_factor is the product of this
    and all later splits. A split of 0 is none."""
    w = Window.partitionBy("ticker").orderBy("date")
    out = prices.withColumn("_s", F.when(F.coalesce("split", F.lit(0.0)) == 0, 1.0).otherwise(F.col("split")))
    later = F.coalesce(F.product("_s").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(1.0))
    return out.withColumns({"split_factor": later * F.col("_s"), "raw_close": F.col("close") * later}).drop("_s")


def price_positions(daily: DataFrame, prices: DataFrame, fx: DataFrame, instruments: DataFrame) -> DataFrame:
    """Positions with prices by (ticker, date) and rates by (ccy, date); missing ones stay null, and
    daily performance carries the last ones forward.

    ``instruments`` has ticker, ccy and classification columns.
    """
    out = daily.join(instruments, "ticker", "left").join(prices, ["ticker", "date"], "left")
    return out.join(fx, ["ccy", "date"], "left")


def rebased(fx: DataFrame, base: str) -> DataFrame:
    """Rates (ccy, date, fx_rate) against another currency of the table: each by that one's rate of the date."""
    to = fx.where(F.col("ccy") == base).select("date", F.col("fx_rate").alias("_to"))
    return fx.join(to, "date").select("ccy", "date", (F.col("fx_rate") / F.nullif("_to", F.lit(0.0))).alias("fx_rate"))


def cash_calendar(tickers: DataFrame, start: str, end: str) -> DataFrame:
    """Cash at price 1 on every calendar day, without a weekend at the end."""
    days = tickers.select("ticker", F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day"))).alias("date"))
    last = F.lit(end).cast("date")
    workday = F.when(F.weekday(last) == 6, F.date_sub(last, 2)).when(F.weekday(last) == 5, F.date_sub(last, 1)).otherwise(last)
    return days.where(F.col("date") <= workday).withColumn("close", F.lit(1.0))


def build_index(prices: DataFrame, shares: DataFrame) -> DataFrame:
    """A capitalisation-weighted index on calendar days.

    Shares count from the last report at or before a date; gaps in prices are carried forward by
    ticker; weight is the share of the date's capitalisation in percent. ``shares`` has (ticker,
    report_date, shares).
    """
    span = prices.groupBy("ticker").agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    days = span.select("ticker", F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias("date"))
    both = days.join(prices.select("ticker", "date", "close"), ["ticker", "date"], "left").unionByName(
        shares.select("ticker", F.col("report_date").alias("date"), "shares"), allowMissingColumns=True
    )
    # reports of a day come before its price
    w = Window.partitionBy("ticker").orderBy("date", F.col("shares").isNull())
    both = both.withColumns({"_c": carried("close", w), "_n": carried("shares", w)}).where("shares is null")
    caps = both.select("ticker", "date", F.col("_c").alias("close"), (F.col("_c") * F.col("_n")).alias("market_cap"), (F.col("_n") / 1e5).alias("quantity")).where("market_cap is not null")
    total = F.sum("market_cap").over(Window.partitionBy("date"))
    return caps.withColumns({"weight": F.col("market_cap") / F.when(total != 0, total) * 100, "fx_rate": F.lit(1.0)})
