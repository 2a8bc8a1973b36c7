"""Stop coverage: long positions without a protective order get a stop intent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions.scalars import money, plain, safe_double, truthy_text
from tapeline.operators.orders import protected_symbols
from tapeline.operators.risk import stop_price
from tapeline.sources.settings import Settings


def reference_price() -> Column:
    """The current price, or the entry price where that text is missing or empty; a text "0" stays 0."""
    return F.coalesce(safe_double(F.coalesce(truthy_text(F.col("current_price")), truthy_text(F.col("avg_entry_price")))), F.lit(0.0))


def stop_intents(positions: DataFrame, orders: DataFrame, settings: Settings) -> DataFrame:
    longs = positions.select("acct", "symbol", safe_double(F.col("qty")).alias("qty"), reference_price().alias("reference")).where("qty > 0 and reference > 0")
    bare = longs.join(protected_symbols(orders), ["acct", "symbol"], "left_anti")
    return bare.select("acct", "symbol", "qty", "reference", stop_price(F.col("reference"), F.lit(None), settings.hard_stop_loss_percent).alias("stop"), F.lit("SELL").alias("side"), F.lit("STOP").alias("order_type"), F.lit("GTC").alias("time_in_force"), F.lit("Reconciliation stop-loss").alias("note"))


def attached_stops(intents: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Stop intents as rows of trade_executions; one with an error in (acct, symbol, error) is FAILED and keeps it in its notes."""
    rows = intents.withColumn("error", F.lit(None).cast("string")) if errors is None else intents.join(errors.select("acct", "symbol", "error"), ["acct", "symbol"], "left")
    bad = F.col("error").isNotNull()
    return rows.select("acct", F.col("symbol").alias("ticker"), "side", "qty", "order_type", F.when(bad, "FAILED").otherwise("SUBMITTED").alias("status"), "stop", F.when(bad, F.concat("note", F.lit(" | "), "error")).otherwise(F.col("note")).alias("execution_notes"))


def attached_counts(accounts: DataFrame, attached: DataFrame) -> DataFrame:
    """One row per account: how many stops were attached, and the event's text."""
    n = attached.groupBy("acct").agg(F.count_if(F.col("status") == "SUBMITTED").alias("attached"))
    out = accounts.select("acct").join(n, "acct", "left").withColumn("attached", F.coalesce("attached", F.lit(0)).cast("long"))
    return out.select("acct", "attached", F.format_string("Attached %d stop-loss order(s)", "attached").alias("details"))


def position_status(positions: DataFrame, orders: DataFrame) -> DataFrame:
    """One formatted line per position."""
    shield = protected_symbols(orders).withColumn("shield", F.lit("protected"))
    joined = positions.join(shield, ["acct", "symbol"], "left").withColumn("shield", F.coalesce("shield", F.lit("NO STOP")))
    line = F.concat(
        F.lit("    - "), F.concat("symbol", F.repeat(F.lit(" "), F.greatest(F.lit(0), 6 - F.length("symbol")))), F.lit(" : "),
        F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(0), 8 - F.length("qty"))), "qty"), F.lit(" sh | Entry: $"), _left(money(safe_double(F.col("avg_entry_price"))), 9),
        F.lit(" | P&L: $"), _left(money(safe_double(F.col("unrealized_pl"))), 10), F.lit(" | "), F.col("shield"),
    )
    return joined.select("acct", "symbol", "shield", line.alias("line"))


def _left(x: Column, width: int) -> Column:
    return F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(0), width - F.length(x))), x)


def order_lines(orders: DataFrame) -> DataFrame:
    side = F.upper("side")
    return orders.select("acct", "id", F.concat(F.lit("    - "), F.concat("symbol", F.repeat(F.lit(" "), F.greatest(F.lit(0), 6 - F.length("symbol")))), F.lit(" : "), F.concat(side, F.repeat(F.lit(" "), F.greatest(F.lit(0), 4 - F.length(side)))), F.lit(" "), F.col("qty"), F.lit(" @ "), F.upper(F.coalesce("order_type", "type"))).alias("line"))


def attached_note(stop: Column, fill: Column) -> Column:
    return F.concat(F.lit("Companion GTC stop-loss at $"), plain(stop), F.lit(" (fill $"), plain(fill), F.lit(")"))
