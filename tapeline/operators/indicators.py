"""Technical indicators on bars: one exchange and one sort per ticker serve every window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.scalars import exact_round, finite, missing_if_nan, number_text, snap_round

MIN_BARS, YEAR_BARS = 60, 252


def by_date():
    """Rows of a ticker by date."""
    return Window.partitionBy("ticker").orderBy("bar_date")


def rolling_mean(x: Column, n: int) -> Column:
    """Mean of the last n rows; null unless all n are there."""
    w = by_date().rowsBetween(1 - n, 0)
    return F.when(F.count(x).over(w) == n, F.avg(x).over(w))


def clean_bars(bars: DataFrame) -> DataFrame:
    return bars.withColumns({c: missing_if_nan(F.col(c)) for c in ("high", "low", "close")})


def sma(bars: DataFrame, *windows: int) -> DataFrame:
    return clean_bars(bars).select("ticker", "bar_date", *[rolling_mean(F.col("close"), n).alias(f"sma_{n}") for n in windows or (20, 50)])


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """Simple means of gains and losses; the first row's change counts as none."""
    moved = clean_bars(bars).withColumn("change", F.col("close") - F.lag("close").over(by_date()))
    gain, loss = (rolling_mean(F.when(c > 0, c).otherwise(0.0), n) for c in (F.col("change"), -F.col("change")))
    return moved.select("ticker", "bar_date", (100 - 100 / (1 + gain / (loss + 1e-9))).alias(f"rsi_{n}"))


def true_range() -> Column:
    before = F.lag("close").over(by_date())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    return clean_bars(bars).withColumn("range", true_range()).select("ticker", "bar_date", rolling_mean(F.col("range"), n).alias(f"atr_{n}"))


def year_range(bars: DataFrame) -> DataFrame:
    w = by_date().rowsBetween(1 - YEAR_BARS, 0)
    return clean_bars(bars).select("ticker", "bar_date", F.max("high").over(w).alias("52w_high"), F.min("low").over(w).alias("52w_low"))


def latest(bars: DataFrame) -> DataFrame:
    """All indicators at each ticker's last bar, unrounded, with the number of bars."""
    w = by_date().rowsBetween(1 - YEAR_BARS, 0)
    one = clean_bars(bars).withColumns({"change": F.col("close") - F.lag("close").over(by_date()), "range": true_range(), "nth": F.row_number().over(by_date()), "next": F.lead("bar_date").over(by_date())})
    gain, loss = (rolling_mean(F.when(c > 0, c).otherwise(0.0), 14) for c in (F.col("change"), -F.col("change")))
    every = one.select(
        "ticker", "bar_date", "close", "volume", "nth", "next", rolling_mean(F.col("close"), 20).alias("sma_20"), rolling_mean(F.col("close"), 50).alias("sma_50"),
        (100 - 100 / (1 + gain / (loss + 1e-9))).alias("rsi_14"), rolling_mean(F.col("range"), 14).alias("atr_14"), F.max("high").over(w).alias("52w_high"), F.min("low").over(w).alias("52w_low"),
    )
    return every.where("next is null").drop("next")


def market_packet(bars: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """One row per ticker with enough bars, finite indicators and a positive price; two places."""
    good = latest(bars).where((F.col("nth") >= MIN_BARS) & (F.col("close") > 0))
    for c in ("close", "sma_20", "sma_50", "rsi_14", "atr_14"):
        good = good.where(finite(F.col(c)))
    packet = good.select(
        "ticker", exact_round(F.col("close")).alias("current_price"), *[snap_round(F.col(c)).alias(c) for c in ("sma_20", "sma_50", "rsi_14", "atr_14")],
        *[exact_round(F.col(f"`{c}`")).alias(c) for c in ("52w_high", "52w_low")], F.col("volume").cast("long").alias("recent_volume"),
    )
    from tapeline.operators.news import NO_NEWS

    if digests is None:
        return packet.withColumn("news_summary", F.lit(NO_NEWS))
    return packet.join(digests, "ticker", "left").withColumn("news_summary", F.coalesce("news_summary", F.lit(NO_NEWS)))


def insufficient_history(bars: DataFrame, least: int = MIN_BARS) -> DataFrame:
    return bars.groupBy("ticker").agg(F.count("*").alias("n_bars")).where(F.col("n_bars") < least)


def watchlist_packets(watchlist: DataFrame, packets: DataFrame) -> DataFrame:
    """watchlist (position, ticker) with packets; repeats stay, tickers without a packet go."""
    return watchlist.join(packets, "ticker")


def prompt_context(packets: DataFrame) -> DataFrame:
    """The text that a verdict is asked on."""
    price = lambda c: F.concat(F.lit("$"), number_text(F.col(f"`{c}`")))
    lines = [
        F.concat(F.lit("Ticker: "), F.col("ticker")), F.concat(F.lit("Current Price: "), price("current_price")),
        F.concat(F.lit("SMA 20: "), price("sma_20"), F.lit(" | SMA 50: "), price("sma_50")), F.concat(F.lit("14-Day RSI: "), number_text(F.col("rsi_14"))),
        F.concat(F.lit("14-Day ATR: "), price("atr_14")), F.concat(F.lit("52-Week Range: "), price("52w_low"), F.lit(" - "), price("52w_high")),
        F.lit("Recent News:"), F.col("news_summary"),
    ]
    return packets.select("ticker", F.concat(F.lit("\n"), F.concat_ws("\n", *lines), F.lit("\n")).alias("context"))
