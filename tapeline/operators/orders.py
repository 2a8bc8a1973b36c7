"""Resting orders and account state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions.scalars import safe_double
from tapeline.sources.settings import Settings


def order_kind() -> Column:
    return F.lower(F.coalesce("order_type", "type"))


def is_protective() -> Column:
    """A sell order with `stop` in its type."""
    return F.coalesce(F.contains(order_kind(), F.lit("stop")) & (F.lower("side") == "sell"), F.lit(False))


def classify(orders: DataFrame) -> DataFrame:
    return orders.select("*", order_kind().alias("kind"), F.lower("side").alias("side_kind"), is_protective().alias("protective"))


def open_only(orders: DataFrame) -> DataFrame:
    """Orders whose status is open, in any case."""
    return orders.where(F.lower("status") == "open")


def by_id(orders: DataFrame, *ids: str) -> DataFrame:
    """The orders of the given ids; the filter reaches the scan."""
    return orders.where(F.col("id").isin(*ids))


def pending_symbols(orders: DataFrame) -> DataFrame:
    return orders.where(~is_protective()).select("acct", "symbol").distinct()


def protected_symbols(orders: DataFrame) -> DataFrame:
    return orders.where(is_protective()).select("acct", "symbol").distinct()


def stops_to_cancel(orders: DataFrame, sells: DataFrame) -> DataFrame:
    """Protective orders of positions (acct, symbol) about to be sold."""
    return orders.where(is_protective()).join(sells.select("acct", "symbol").distinct(), ["acct", "symbol"], "left_semi").select("acct", "symbol", "id")


def overview(accounts: DataFrame, positions: DataFrame, orders: DataFrame, settings: Settings) -> DataFrame:
    """One row per account: nav, cash, the day's result, counts, and whether the loss limit is passed (strictly)."""
    nav, last = safe_double(F.col("portfolio_value")), safe_double(F.col("last_equity"))
    base = accounts.select("acct", nav.alias("nav"), safe_double(F.col("cash")).alias("cash"), F.when(last > 0, (nav - last) / last).otherwise(0.0).alias("daily_pnl_pct"))
    held = positions.groupBy("acct").agg(F.count_distinct("symbol").alias("n_positions"))
    resting = orders.groupBy("acct").agg(F.count("*").alias("n_open_orders"), F.count_if(~is_protective()).alias("n_pending"), F.count_distinct(F.when(is_protective(), F.col("symbol"))).alias("n_protected"))
    joined = base.join(held, "acct", "left").join(resting, "acct", "left").fillna(0, ["n_positions", "n_open_orders", "n_pending", "n_protected"])
    return joined.withColumn("is_day_loss_triggered", F.col("daily_pnl_pct") < -settings.daily_loss_limit_percent)
