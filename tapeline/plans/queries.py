"""Queries over the driver's tables, one per operator or group of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions.scalars import exact_round, plain, safe_double, snap_round, tickers
from tapeline.operators import audit, indicators, models, news, orders, reconcile, risk, verdict
from tapeline.plans import cycle, provider
from tapeline.sources import adapters
from tapeline.sources.settings import Settings, catalog, catalog_rows, describe_models, settings_from, with_overrides

SETTINGS = Settings()
CLOCK = "2026-01-02T14:30:00+00:00"

#: Settings as text, some out of bounds or not numbers.
CONFIG = {"MAX_POSITION_PERCENT": "5.0", "DAILY_LOSS_LIMIT_PERCENT": "0.0", "HARD_STOP_LOSS_PERCENT": "ten percent", "WATCHLIST": " aapl , msft ,, nvda ", "EFFORT": "turbo", "PM_MODEL": catalog_rows()[4][0], "PM_MAX_TOKENS": "12"}


def bars_daily(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.bars(spark, sf)


def bars_wide(spark: SparkSession, sf: str) -> DataFrame:
    b = adapters.bars_wide(spark, sf)
    return b.select("ticker", "bar_date", *[exact_round(F.col(c), 4).alias(c) for c in ("open", "high", "low", "close")], "volume")


def bars_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.bars_hourly(spark, sf)


def indicator_sma(spark: SparkSession, sf: str) -> DataFrame:
    s = indicators.sma(adapters.bars(spark, sf))
    return s.select("ticker", "bar_date", snap_round(F.col("sma_20")).alias("sma_20"), snap_round(F.col("sma_50")).alias("sma_50"))


def indicator_rsi(spark: SparkSession, sf: str) -> DataFrame:
    return indicators.rsi(adapters.bars(spark, sf)).select("ticker", "bar_date", snap_round(F.col("rsi_14")).alias("rsi_14"))


def indicator_atr(spark: SparkSession, sf: str) -> DataFrame:
    return indicators.atr(adapters.bars(spark, sf)).select("ticker", "bar_date", snap_round(F.col("atr_14")).alias("atr_14"))


def range_52w(spark: SparkSession, sf: str) -> DataFrame:
    return indicators.year_range(adapters.bars(spark, sf))


def market_packet(spark: SparkSession, sf: str) -> DataFrame:
    return indicators.market_packet(adapters.bars(spark, sf))


def market_packet_wide(spark: SparkSession, sf: str) -> DataFrame:
    return indicators.market_packet(adapters.bars_wide(spark, sf))


def insufficient_history(spark: SparkSession, sf: str) -> DataFrame:
    return indicators.insufficient_history(adapters.bars_wide(spark, sf), 1500)


def watchlist(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.posexplode(tickers(F.lit(adapters.WATCHLIST))).alias("position", "ticker"))


def watchlist_packets(spark: SparkSession, sf: str) -> DataFrame:
    return indicators.watchlist_packets(watchlist(spark), indicators.market_packet(adapters.bars(spark, sf)))


def prompt_contexts(spark: SparkSession, sf: str) -> DataFrame:
    return indicators.prompt_context(indicators.market_packet(adapters.bars(spark, sf)))


def order_classes(spark: SparkSession, sf: str) -> DataFrame:
    return orders.classify(adapters.open_orders(spark, sf)).groupBy("acct", "symbol").agg(F.count_if("protective").alias("n_protective"), F.count_if(~F.col("protective")).alias("n_pending"), F.min("kind").alias("first_kind"))


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.order_lines(adapters.open_orders(spark, sf))


def _overview(spark: SparkSession, sf: str) -> DataFrame:
    return orders.overview(adapters.accounts(spark, sf), adapters.positions(spark, sf), adapters.open_orders(spark, sf), SETTINGS)


def account_overview(spark: SparkSession, sf: str) -> DataFrame:
    return _overview(spark, sf).withColumns({c: exact_round(F.col(c), 4) for c in ("nav", "cash", "daily_pnl_pct")})


def daily_loss_halt(spark: SparkSession, sf: str) -> DataFrame:
    return cycle.halted_accounts(_overview(spark, sf)).select("acct", exact_round(F.col("daily_pnl_pct"), 4).alias("daily_pnl_pct"))


def stop_prices(spark: SparkSession, sf: str) -> DataFrame:
    e = adapters.table(spark, sf, "events").selectExpr("event_id", "cast(100 as double) as reference", "case when event_id % 50 = 0 then null when event_id % 50 = 1 then 'none' else cast(cast(70 + event_id % 40 as double) as string) end as suggested")
    return e.select("event_id", risk.stop_price(F.col("reference"), F.col("suggested"), SETTINGS.hard_stop_loss_percent).alias("stop"))


def unprotected_longs(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.stop_intents(adapters.positions(spark, sf), adapters.open_orders(spark, sf), SETTINGS).select("acct", "symbol", "qty", "reference", "stop")


def position_status(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.position_status(adapters.positions(spark, sf), adapters.open_orders(spark, sf))


def _candidates(spark: SparkSession, sf: str, live_only: bool = False) -> DataFrame:
    """Decisions whose action is upper case and known, as the normaliser leaves them, on each account."""
    d = adapters.decisions(spark, sf).withColumn("action", F.upper(F.trim("action"))).withColumn("action", F.when(F.col("action").isin("BUY", "SELL", "HOLD"), F.col("action")).otherwise("HOLD"))
    found = _overview(spark, sf)
    if live_only:
        found = found.where(~F.col("is_day_loss_triggered"))
    return risk.candidates(d, adapters.prices(spark, sf), found, adapters.positions(spark, sf), orders.pending_symbols(adapters.open_orders(spark, sf)))


def risk_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return risk.validate(_candidates(spark, sf), SETTINGS).select("event_id", "guard", "approved", "reason", "approved_qty")


def guard_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return risk.validate(_candidates(spark, sf), SETTINGS).groupBy("guard").agg(F.count("*").alias("n"))


def dry_run_cycle(spark: SparkSession, sf: str) -> DataFrame:
    out = risk.validate(_candidates(spark, sf, live_only=True), SETTINGS)
    return cycle.order_intents(out)


def cycle_counters(spark: SparkSession, sf: str) -> DataFrame:
    return cycle.counters(risk.validate(_candidates(spark, sf, live_only=True), SETTINGS), "acct")


def live_cycle_fold(spark: SparkSession, sf: str) -> DataFrame:
    out = cycle.live_fold(_candidates(spark, sf, live_only=True), SETTINGS, "event_id")
    return out.select("acct", "event_id", "guard", "approved_qty", exact_round(F.col("cash_before"), 4).alias("cash_before"))


def verdict_extract(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.verdict_texts(spark, sf).select("event_id", verdict.extract_json(F.col("raw")).alias("json"))


def verdict_normalized(spark: SparkSession, sf: str) -> DataFrame:
    out = verdict.normalised(adapters.verdict_texts(spark, sf), SETTINGS)
    return out.select("event_id", "action", "conviction_score", "allocation_percentage", "target_price", "stop_loss_price", "thesis_summary", F.array_join("key_risks", "|").alias("key_risks"))


def verdict_fallbacks(spark: SparkSession, sf: str) -> DataFrame:
    return verdict.normalised(adapters.verdict_texts(spark, sf), SETTINGS).where("fallback is not null").select("event_id", "action", "stop_loss_price", "fallback")


def news_digest(spark: SparkSession, sf: str) -> DataFrame:
    return news.digest(adapters.news(spark, sf))


def usage_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return models.ledger(adapters.usage(spark, sf), catalog(spark), "model").withColumn("cost_usd", exact_round(F.col("cost_usd"), 6))


def usage_summary(spark: SparkSession, sf: str) -> DataFrame:
    return models.ledger(adapters.usage(spark, sf), catalog(spark)).select(models.summary_line().alias("summary"))


def unknown_models(spark: SparkSession, sf: str) -> DataFrame:
    return models.unknown_models(adapters.usage(spark, sf), catalog(spark))


def feature_flags(spark: SparkSession, sf: str) -> DataFrame:
    used = adapters.usage(spark, sf).select("model").distinct()
    p = models.profiles(used, catalog(spark)).withColumn("features", models.feature_set(F.lit(True)))
    return p.withColumn("next_drop", models.next_to_drop(F.col("features"))).select("model", "label", F.array_join("features", ",").alias("features"), "next_drop")


def degradation_paths(spark: SparkSession, sf: str) -> DataFrame:
    used = adapters.usage(spark, sf).select("model").distinct()
    p = models.profiles(used, catalog(spark)).withColumn("features", models.feature_set(F.lit(True)))
    steps = p.select("model", F.posexplode(models.degradation_path(F.col("features"))).alias("step", "left"))
    return steps.select("model", F.col("step").cast("long").alias("step"), F.array_join("left", ",").alias("features"))


def model_routing(spark: SparkSession, sf: str) -> DataFrame:
    roles = spark.createDataFrame([("bull",), ("bear",), ("risk",), ("pm",)], "role string")
    return models.routing(settings_from(CONFIG), roles)


def model_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return catalog(spark).select("model", F.concat(F.lit("  "), F.rpad("model", 20, " "), F.lit(" "), F.rpad("label", 20, " "), F.lit(" "), F.rpad("context", 9, " "), F.lit(" "), F.lpad(plain(F.col("input_price")), 8, " "), F.lit(" "), F.lpad(plain(F.col("output_price")), 9, " ")).alias("line"))


def config_values(spark: SparkSession, sf: str) -> DataFrame:
    s = settings_from(CONFIG)
    pairs = [(k, ",".join(v) if isinstance(v, tuple) else str(v)) for k, v in vars(s).items() if k not in ("analyst_model", "pm_model")]
    return spark.createDataFrame(pairs, "name string, value string")


def request_rows(spark: SparkSession, sf: str) -> DataFrame:
    contexts = prompt_contexts(spark, sf).select("ticker", F.col("context").alias("user"))
    roles = models.profiles(model_routing(spark, sf), catalog(spark)).withColumn("features", models.feature_set(F.col("want_schema")))
    # four roles per ticker, by an array of literals rather than a product of tables
    calls = contexts.withColumn("role", F.explode(F.array(*map(F.lit, ("bull", "bear", "risk", "pm"))))).join(roles, "role").withColumn("system", F.concat(F.lit("You argue as "), F.col("role")))
    return models.requests(calls, SETTINGS).select("ticker", "role", "model", "request")


def fill_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    o = adapters.table(spark, sf, "orders").selectExpr(
        "cast(o_orderkey as string) as order_id", "o_orderpriority as ticker", "cast(1 + o_orderkey % 40 as double) as qty", "cast(50 + o_orderkey % 300 as double) as current_price",
        "case when o_orderkey % 4 = 0 then null else cast(cast(50 + o_orderkey % 300 as double) * (80 + o_orderkey % 25) / 100 as string) end as suggested_stop",
        "element_at(array('FILLED', 'filled', 'new', 'canceled', 'expired', 'partially_filled'), cast(o_orderkey % 6 + 1 as int)) as status",
        "case when o_orderkey % 7 = 0 then '' when o_orderkey % 7 = 1 then null else cast(1 + o_orderkey % 20 as string) end as filled_qty", "case when o_orderkey % 5 = 0 then null else cast(49 + o_orderkey % 300 as string) end as filled_avg_price",
    )
    return cycle.fill_outcomes(o, SETTINGS)


def stop_cancellations(spark: SparkSession, sf: str) -> DataFrame:
    out = risk.validate(_candidates(spark, sf, live_only=True), SETTINGS).where("guard = 'G8'").select("acct", F.col("ticker").alias("symbol"))
    return orders.stops_to_cancel(adapters.open_orders(spark, sf), out).groupBy("acct", "symbol").agg(F.count("*").alias("n_cancelled"))


def audit_decisions(spark: SparkSession, sf: str) -> DataFrame:
    out = risk.validate(_candidates(spark, sf, live_only=True), SETTINGS)
    rows = audit.numbered(out, "event_id")
    ids = rows.select("id", "event_id")
    return audit.decision_rows(rows, CLOCK, "id").join(ids, "id").select("id", "event_id", "timestamp", "ticker", "action", "current_price", "risk_approved", "risk_reason", "approved_qty")


def audit_events(spark: SparkSession, sf: str) -> DataFrame:
    """A cycle's events per account: start, then halt or completion with its counts."""
    found = _overview(spark, sf)
    done = cycle.counters(risk.validate(_candidates(spark, sf, live_only=True), SETTINGS), "acct")
    pnl = plain(F.col("daily_pnl_pct") * 100)
    halt = F.concat(F.lit("EMERGENCY HALT: Account daily loss ("), pnl, F.lit(f"%) exceeds hard limit (-{SETTINGS.daily_loss_limit_percent * 100:.2f}%). Halting all trades."))
    start = found.select("acct", F.lit("INFO").alias("level"), F.lit("cycle_start").alias("event"), F.lit("mode=DRY-RUN").alias("details"))
    stopped = found.where("is_day_loss_triggered").select("acct", F.lit("CRITICAL").alias("level"), F.lit("daily_loss_halt").alias("event"), halt.alias("details"))
    ended = done.select("acct", F.lit("INFO").alias("level"), F.lit("cycle_complete").alias("event"), F.format_string("executed=%d rejected=%d skipped=%d", "executed", "rejected", "skipped").alias("details"))
    return start.union(stopped).union(ended)


def last_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Holdings reported several times: the last report of each account and ticker stands, whole."""
    reports = adapters.table(spark, sf, "orders").selectExpr("o_custkey as acct", "o_orderpriority as symbol", "o_orderkey as arrival", "cast(o_orderkey % 40 as string) as qty", "cast(o_totalprice as string) as market_value")
    out = risk.last_positions(reports)
    return out.select("acct", "ticker", "qty", safe_double(F.col("market_value")).alias("market_value"))


def order_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return orders.by_id(orders.open_only(adapters.open_orders(spark, sf)), "1", "2", "3", "4", "5", "7", "32", "33", "64", "65", "96", "97", "128").select("id", "acct", "symbol", "qty", F.lower("status").alias("status"))


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    """Entry orders and what became of them; some could not be submitted, some of their stops neither."""
    return adapters.table(spark, sf, "orders").selectExpr(
        "cast(o_orderkey as string) as order_id", "o_orderpriority as ticker", "case when o_orderkey % 4 = 3 then 'SELL' else 'BUY' end as side", "cast(1 + o_orderkey % 40 as double) as qty", "cast(50 + o_orderkey % 300 as double) as current_price",
        "case when o_orderkey % 4 = 0 then null else cast(cast(50 + o_orderkey % 300 as double) * (80 + o_orderkey % 25) / 100 as string) end as suggested_stop",
        "element_at(array('FILLED', 'filled', 'new', 'canceled', 'expired', 'partially_filled'), cast(o_orderkey % 6 + 1 as int)) as status",
        "case when o_orderkey % 7 = 0 then '' when o_orderkey % 7 = 1 then null else cast(1 + o_orderkey % 20 as string) end as filled_qty", "case when o_orderkey % 5 = 0 then null else cast(49 + o_orderkey % 300 as string) end as filled_avg_price",
        "case when o_orderkey % 23 = 0 then 'no route' end as submit_error", "concat('s', cast(o_orderkey as string)) as stop_id", "case when o_orderkey % 29 = 0 then 'held shares' end as stop_error",
    )


def trade_executions(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of trade_executions with their ids, written as the audit table and read back."""
    rows = cycle.executions(_entries(spark, sf), SETTINGS).withColumns({"at": F.col("entry_id").cast("long"), "timestamp": F.lit(CLOCK)})
    return audit.stored(audit.numbered(rows, "at", "step"), "trade_executions")


def audit_readback(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions written to the audit table, then its ticker, approval and reason read back."""
    out = risk.validate(_candidates(spark, sf, live_only=True), SETTINGS)
    rows = audit.decision_rows(audit.numbered(out, "event_id"), CLOCK, "id")
    return audit.stored(rows, "agent_decisions").select("id", "ticker", "risk_approved", "risk_reason")


def stops_attached(spark: SparkSession, sf: str) -> DataFrame:
    intents = reconcile.stop_intents(adapters.positions(spark, sf), adapters.open_orders(spark, sf), SETTINGS)
    errors = intents.where("acct % 19 = 0").select("acct", "symbol", F.lit("no route").alias("error"))
    return reconcile.attached_counts(adapters.accounts(spark, sf), reconcile.attached_stops(intents, errors))


def model_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    ids = adapters.model_names()
    pairs = [(a, p, describe_models(with_overrides(SETTINGS, analyst_model=a, pm_model=p))) for a in ids for p in (ids[0], a)]
    return spark.createDataFrame(pairs, "analyst_model string, pm_model string, line string").distinct()


def response_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of three blocks each, thinking and text, some refused."""
    c = adapters.table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn", "array(named_struct('type', 'thinking', 'text', 'hm'), named_struct('type', 'text', 'text', concat(' turn ', cast(turn as string), ' ')), named_struct('type', case when turn % 2 = 0 then 'text' else 'tool' end, 'text', concat('of ', cast(conv_id as string), ' '))) as content",
        "case when (conv_id + turn) % 7 = 0 then 'refusal' when turn % 3 = 0 then 'max_tokens' when turn % 5 <> 0 then 'end_turn' end as stop_reason",
    )
    return models.read_responses(c).select("conv_id", "turn", "refused", "text")


def call_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Calls that are rejected or fail in various orders."""
    used = adapters.usage(spark, sf).select("conv_id", "turn", "model")
    calls = models.profiles(used, catalog(spark)).withColumn("features", models.feature_set(F.col("turn") % 2 == 0))
    answer = lambda i: F.get(F.array(*map(F.lit, ("bad_request", "retry", "bad_request", "ok", "retry", "bad_request", "bad_request"))), ((F.col("conv_id") * 5 + F.col("turn") * (i + 2) + i * i) % 7).cast("int"))
    out = models.call_outcomes(calls.withColumn("answers", F.array(*[answer(i) for i in range(8)])))
    return out.select("conv_id", "turn", "model", "status", F.array_join("features_left", ",").alias("features_left"), "attempts", "wait_seconds", "n_requests")


def debate_decisions(spark: SparkSession, sf: str) -> DataFrame:
    packets = indicators.market_packet(adapters.bars_wide(spark, sf))
    said = provider.debate(indicators.prompt_context(packets), provider.RuleProvider())
    joined = said.join(packets.select("ticker", "current_price"), "ticker")
    return verdict.normalised(joined, SETTINGS).select("ticker", "current_price", "action", "conviction_score", "allocation_percentage", "stop_loss_price", F.array_join("key_risks", "|").alias("key_risks"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        bars_daily, bars_wide, bars_hourly, indicator_sma, indicator_rsi, indicator_atr, range_52w, market_packet, market_packet_wide, insufficient_history, watchlist_packets, prompt_contexts,
        order_classes, order_lines, account_overview, daily_loss_halt, stop_prices, unprotected_longs, position_status, risk_outcomes, guard_histogram, dry_run_cycle, cycle_counters, live_cycle_fold,
        verdict_extract, verdict_normalized, verdict_fallbacks, news_digest, usage_ledger, usage_summary, unknown_models, feature_flags, degradation_paths, model_routing, model_catalog, config_values,
        request_rows, fill_outcomes, stop_cancellations, audit_decisions, audit_events, debate_decisions, last_positions, order_lookup, trade_executions, audit_readback, stops_attached, model_descriptions,
        response_texts, call_outcomes,
    )
}
