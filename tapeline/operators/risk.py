"""Rule-based order validation and sizing: one ordered CASE, the first guard that fits decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions.scalars import exact_round, money, number_text, plain, safe_double
from tapeline.sources.settings import Settings


def stop_price(reference: Column, suggested: Column, hard: float) -> Column:
    """The suggestion if it lies in the band (both ends included), else the hard stop."""
    s = F.coalesce(safe_double(suggested), F.lit(0.0))
    return exact_round(F.when(s.between(reference * (1 - min(0.9, 2 * hard)), reference * 0.98), s).otherwise(reference * (1 - hard)))


def guards(settings: Settings) -> list[tuple[str, Column, Column, Column]]:
    """(code, condition, reason, quantity) in order, over ticker, action, conviction_score, allocation_percentage,
    current_price, nav, cash, pending, held, qty and market_value."""
    c, none, text = F.col, F.lit(0.0), lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    most, buffer, least = settings.max_position_percent, settings.min_cash_buffer_percent, settings.min_conviction
    price, nav, cash, ticker = c("current_price"), c("nav"), c("cash"), c("ticker")
    held_qty, sell = safe_double(c("qty")), c("action") == "SELL"
    exposure = F.coalesce(F.abs(safe_double(c("market_value"))), F.lit(0.0))
    allocation = F.least(c("allocation_percentage"), F.lit(most))
    headroom, reserve = nav * most - exposure, nav * buffer
    capital = F.least(nav * allocation, headroom, cash - reserve)
    shares = F.floor(capital / F.when(price > 0, price)).cast("double")
    return [
        ("G1", price <= 0, text("Invalid reference price ($", plain(price), ")"), none),
        ("G2", nav <= 0, text("Account NAV is zero or negative"), none),
        ("G3", c("action") == "HOLD", text("Decision is HOLD"), none),
        ("G4", c("pending"), text("Duplicate guard: Pending order already exists for ", ticker), none),
        ("G5", sell & ~c("held"), text("Cannot SELL: No active position held in ", ticker), none),
        ("G6", sell & held_qty.isNull(), text("Cannot SELL: Unreadable quantity on ", ticker, " position"), none),
        ("G7", sell & (held_qty <= 0), text("Cannot SELL: ", ticker, " position is not long (", number_text(held_qty), " shares)"), none),
        ("G8", sell, text("Approved SELL of existing position (", number_text(held_qty), " shares)"), held_qty),
        ("G9", c("conviction_score") < least, text("Conviction ", plain(c("conviction_score")), f" is below minimum threshold {least:.2f}"), none),
        ("G10", allocation <= 0, text("Recommended allocation is 0%"), none),
        ("G11", headroom <= 0, text("Concentration cap: ", ticker, " exposure ($", money(exposure), f") already at the {most * 100:.1f}% NAV limit"), none),
        ("G12", cash - reserve <= 0, text("Cash buffer triggered: Available cash ($", money(cash), ") is below reserve ($", money(reserve), ")"), none),
        ("G13", capital < price, text("Insufficient allocated capital ($", money(capital), ") to purchase 1 share ($", money(price), ")"), none),
        ("G14", shares <= 0, text("Calculated order quantity is 0 shares"), none),
        ("G15", F.lit(True), text("Approved BUY of ", shares.cast("long").cast("string"), " shares ($", money(shares * price), ")"), shares),
    ]


def validate(candidates: DataFrame, settings: Settings) -> DataFrame:
    """candidates with guard, approved, reason and approved_qty."""
    chain = guards(settings)
    code = F.lit(None).cast("string")
    for name, fits, _, _ in reversed(chain):
        code = F.when(fits, F.lit(name)).otherwise(code)
    coded = candidates.withColumn("guard", code)
    reason, qty = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, _, why, n in reversed(chain):
        reason, qty = F.when(F.col("guard") == name, why).otherwise(reason), F.when(F.col("guard") == name, n).otherwise(qty)
    return coded.select("*", F.col("guard").isin("G8", "G15").alias("approved"), reason.alias("reason"), qty.alias("approved_qty"))


def last_positions(positions: DataFrame, arrival: str = "arrival") -> DataFrame:
    """One row per account and ticker: the whole row that arrived last. Without a column of that name the order is by content."""
    row = F.struct("qty", "market_value")
    by = F.struct(F.col(arrival), row) if arrival in positions.columns else row
    return positions.groupBy("acct", F.col("symbol").alias("ticker")).agg(F.max_by(row, by).alias("last")).select("acct", "ticker", "last.*")


def candidates(decisions: DataFrame, prices: DataFrame, accounts: DataFrame, positions: DataFrame, pending: DataFrame) -> DataFrame:
    """Decisions with price (0 if none), account, holding and pending flag. Sizes of the sides are left to the planner."""
    held = last_positions(positions).withColumn("held", F.lit(True))
    waiting = pending.select("acct", F.col("symbol").alias("ticker"), F.lit(True).alias("pending"))
    joined = decisions.join(prices.select("ticker", F.col("price").alias("current_price")), "ticker", "left").join(accounts.select("acct", "nav", "cash"), "acct")
    joined = joined.join(held, ["acct", "ticker"], "left").join(waiting, ["acct", "ticker"], "left")
    return joined.withColumns({"current_price": F.coalesce("current_price", F.lit(0.0)), "held": F.coalesce("held", F.lit(False)), "pending": F.coalesce("pending", F.lit(False))})
