"""One cycle: candidates, validation, order intents, fills, counters; and the account-dependent live fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.functions.scalars import plain, safe_double
from tapeline.operators.reconcile import attached_note
from tapeline.operators.risk import candidates, stop_price, validate
from tapeline.sources.settings import Settings


def halted_accounts(overview: DataFrame) -> DataFrame:
    return overview.where("is_day_loss_triggered").select("acct", "daily_pnl_pct")


def dry_run(decisions: DataFrame, prices: DataFrame, overview: DataFrame, positions: DataFrame, pending: DataFrame, settings: Settings) -> DataFrame:
    """Every decision validated on the account as it is; halted accounts do nothing."""
    live = overview.where(~F.col("is_day_loss_triggered"))
    return validate(candidates(decisions, prices, live, positions, pending), settings)


def counters(outcomes: DataFrame, *by: str) -> DataFrame:
    """executed, rejected, skipped: a candidate without a price is skipped."""
    skipped = F.col("current_price") <= 0
    return outcomes.groupBy(*by).agg(F.count_if(F.col("approved") & ~skipped).alias("executed"), F.count_if(~F.col("approved") & ~skipped).alias("rejected"), F.count_if(skipped).alias("skipped"))


def order_intents(outcomes: DataFrame) -> DataFrame:
    """Market day orders for what was approved; nothing is sent anywhere."""
    return outcomes.where("approved").select("acct", "ticker", F.col("action").alias("side"), F.col("approved_qty").alias("qty"), F.lit("MARKET").alias("order_type"), F.lit("DAY").alias("time_in_force"), F.concat(F.lit("Entry market order submitted at ~$"), plain(F.col("current_price"))).alias("note"))


def fill_outcomes(entries: DataFrame, settings: Settings) -> DataFrame:
    """entries (order_id, ticker, qty, current_price, suggested_stop, status, filled_qty, filled_avg_price) of BUY orders -> stop rows.

    A fill gives a stop for what filled; an order that ended or still works leaves the stop to reconciliation.
    """
    state = F.lower("status")
    filled = F.coalesce(state == "filled", F.lit(False))
    qty = F.coalesce(safe_double(F.when(F.col("filled_qty") != "", F.col("filled_qty"))), F.col("qty"))
    price = F.coalesce(safe_double(F.when(F.col("filled_avg_price") != "", F.col("filled_avg_price"))), F.col("current_price"))
    stop = stop_price(price, F.col("suggested_stop"), settings.hard_stop_loss_percent)
    rows = entries.select("order_id", "ticker", filled.alias("filled"), state.isin("canceled", "cancelled", "expired", "rejected").alias("ended"), F.when(filled, qty).otherwise(F.col("qty")).alias("qty"), price.alias("fill_price"), stop.alias("stop"))
    return rows.select(
        "order_id", "ticker", F.lit("SELL").alias("side"), "qty", F.lit("STOP").alias("order_type"), F.when(F.col("filled"), "SUBMITTED").otherwise("DEFERRED").alias("status"), F.when(F.col("filled"), F.col("stop")).alias("stop_price"), F.coalesce("ended", F.lit(False)).alias("ended"),
        F.when(F.col("filled"), attached_note(F.col("stop"), F.col("fill_price"))).otherwise("Entry unfilled at submission; stop-loss deferred to reconciliation").alias("notes"),
    )


def executions(entries: DataFrame, settings: Settings) -> DataFrame:
    """entries (order_id, ticker, side, qty, current_price, suggested_stop, status, filled_qty, filled_avg_price, submit_error,
    stop_id, stop_error) -> rows of trade_executions, several per entry, numbered by `step`.

    An entry that could not be submitted is one FAILED row. Else its market order is SUBMITTED; a BUY then gets its stop: SUBMITTED
    on a fill, FAILED where the stop could not be placed, DEFERRED where nothing filled.
    """
    buy, failed = F.upper("side") == "BUY", F.col("submit_error").isNotNull()
    filled = F.coalesce(F.lower("status") == "filled", F.lit(False))
    text = lambda c: safe_double(F.when(F.col(c) != "", F.col(c)))
    amount, price = F.coalesce(text("filled_qty"), F.col("qty")), F.coalesce(text("filled_avg_price"), F.col("current_price"))
    stop = stop_price(price, F.col("suggested_stop"), settings.hard_stop_loss_percent)
    note, bad = attached_note(stop, price), F.col("stop_error").isNotNull()
    line = lambda step, side, qty, kind, ident, status, notes: F.struct(F.lit(step).alias("step"), side.alias("side"), qty.alias("qty"), F.lit(kind).alias("order_type"), ident.alias("order_id"), status.alias("status"), notes.alias("execution_notes"))
    none, sell = F.lit("NONE"), F.lit("SELL")
    lines = F.array(
        F.when(failed, line(1, F.col("side"), F.col("qty"), "FAILED", none, F.lit("FAILED"), F.col("submit_error"))),
        F.when(~failed, line(1, F.col("side"), F.col("qty"), "MARKET", F.col("order_id"), F.lit("SUBMITTED"), F.concat(F.lit("Entry market order submitted at ~$"), plain(F.col("current_price"))))),
        F.when(~failed & buy & filled, line(2, sell, amount, "STOP", F.when(bad, none).otherwise(F.col("stop_id")), F.when(bad, "FAILED").otherwise("SUBMITTED"), F.when(bad, F.concat(note, F.lit(" | "), "stop_error")).otherwise(note))),
        F.when(~failed & buy & ~filled, line(2, sell, F.col("qty"), "STOP", none, F.lit("DEFERRED"), F.lit("Entry unfilled at submission; stop-loss deferred to reconciliation"))),
    )
    return entries.select(F.col("order_id").alias("entry_id"), "ticker", F.explode(F.array_compact(lines)).alias("x")).select("entry_id", "ticker", "x.*")


def live_fold(found: DataFrame, settings: Settings, order: str) -> DataFrame:
    """Candidates of each account in order, each sized on what the approved ones before it left.

    found: as candidates() gives, with a unique `order` column. Assumption: an order fills at once at its price; cash and the
    position move with it, the account's value stays, pending entries stay as they were. An account's candidates are
    one task's array, as many as its watchlist has.
    """
    most, buffer, least = settings.max_position_percent, settings.min_cash_buffer_percent, settings.min_conviction
    row = F.struct(order, "ticker", "action", "conviction_score", "allocation_percentage", "current_price", "pending", "held", safe_double(F.col("qty")).alias("q"), F.coalesce(F.abs(safe_double(F.col("market_value"))), F.lit(0.0)).alias("mv"))
    accounts = found.groupBy("acct", "nav", "cash").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    kind = f"array<struct<{order}:bigint,guard:string,approved_qty:double,cash_before:double>>"
    start = F.struct(F.col("cash").alias("cash"), F.expr("cast(map() as map<string,struct<held:boolean,q:double,mv:double>>)").alias("moved"), F.expr(f"cast(array() as {kind})").alias("out"))

    def step(acc, r):
        now = F.coalesce(F.try_element_at(acc["moved"], r["ticker"]), F.struct(r["held"].alias("held"), r["q"].alias("q"), r["mv"].alias("mv")))
        sell, nav, p = r["action"] == "SELL", F.col("nav"), r["current_price"]
        allocation = F.least(r["allocation_percentage"], F.lit(most))
        headroom, surplus = nav * most - now["mv"], acc["cash"] - nav * buffer
        capital = F.least(nav * allocation, headroom, surplus)
        guard = (
            F.when(p <= 0, "G1").when(nav <= 0, "G2").when(r["action"] == "HOLD", "G3").when(r["pending"], "G4").when(sell & ~now["held"], "G5").when(sell & now["q"].isNull(), "G6").when(sell & (now["q"] <= 0), "G7").when(sell, "G8")
            .when(r["conviction_score"] < least, "G9").when(allocation <= 0, "G10").when(headroom <= 0, "G11").when(surplus <= 0, "G12").when(capital < p, "G13").otherwise("G15")
        )
        shares = F.when(guard == "G8", now["q"]).when(guard == "G15", F.floor(capital / F.when(p > 0, p)).cast("double")).otherwise(0.0)
        value = shares * p
        gone = F.struct(F.lit(False).alias("held"), F.lit(None).cast("double").alias("q"), F.lit(0.0).alias("mv"))
        more = F.struct(F.lit(True).alias("held"), (F.coalesce(now["q"], F.lit(0.0)) + shares).alias("q"), (now["mv"] + value).alias("mv"))
        rest = F.map_filter(acc["moved"], lambda k, v: k != r["ticker"])
        moved = F.when(guard == "G8", F.map_concat(rest, F.create_map(r["ticker"], gone))).when(guard == "G15", F.map_concat(rest, F.create_map(r["ticker"], more))).otherwise(acc["moved"])
        cash = acc["cash"] + F.when(guard == "G8", value).when(guard == "G15", -value).otherwise(0.0)
        line = F.struct(r[order].alias(order), guard.alias("guard"), shares.alias("approved_qty"), acc["cash"].alias("cash_before"))
        return F.struct(cash.alias("cash"), moved.alias("moved"), F.concat(acc["out"], F.array(line)).alias("out"))

    return accounts.select("acct", F.explode(F.aggregate("rows", start, step, lambda a: a["out"])).alias("x")).select("acct", "x.*")
