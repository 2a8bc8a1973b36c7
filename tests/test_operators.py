import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from tapeline.functions import scalars
from tapeline.operators import audit, models, news, orders, reconcile
from tapeline.plans import cycle, provider
from tapeline.operators import risk
from tapeline.sources.settings import Settings, catalog, catalog_rows, describe_models, read_key_values, settings_from, with_overrides

#: Ids of the catalog, in order; the sixth is the cheaper one, the eighth the plainest.
IDS = [r[0] for r in catalog_rows()]
ENTRY = "is_object boolean, title string, publisher string, content struct<title:string,provider:struct<displayName:string>>"


def test_rounding(spark):
    rng = random.Random(4)
    xs = [2.675, 1.005, 0.125, 0.375, 1.115, -2.675, 0.0] + [rng.randint(-(10**6), 10**6) / 1000 for _ in range(500)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", scalars.exact_round(F.col("x")).alias("r"), scalars.money(F.col("x")).alias("m")).collect()
    assert all(r["r"] == round(r["x"], 2) and (r["m"] == f"{r['x']:,.2f}" or round(r["x"], 2) == 0) for r in got)


def test_scalars(spark):
    r = spark.range(1).select(
        scalars.clamp(F.lit(float("nan")), 0, 1).alias("nan"), scalars.clamp(F.lit(-3.0), 0, 1).alias("low"), scalars.safe_double(F.lit(" 1.5\n")).alias("ok"), scalars.safe_double(F.lit("n/a")).alias("bad"),
        scalars.finite(F.lit(float("inf"))).alias("inf"), scalars.tickers(F.lit(" aapl , msft ,, nvda ")).alias("t"),
    ).first()
    assert tuple(r) == (1.0, 0.0, 1.5, None, False, ["AAPL", "MSFT", "NVDA"])


def test_settings(spark, tmp_path):
    s = settings_from({"MAX_POSITION_PERCENT": "5.0", "DAILY_LOSS_LIMIT_PERCENT": "0.0", "HARD_STOP_LOSS_PERCENT": "ten percent", "EFFORT": "turbo", "WATCHLIST": " aapl , msft ,, nvda ", "PM_MAX_TOKENS": "3"})
    assert (s.max_position_percent, s.daily_loss_limit_percent, s.hard_stop_loss_percent, s.effort, s.watchlist, s.pm_max_tokens) == (0.50, 0.005, 0.10, "high", ("AAPL", "MSFT", "NVDA"), 1024)
    roles = settings_from({"MODEL": IDS[5], "PM_MODEL": IDS[4]})
    assert (roles.analyst_model, roles.pm_model) == (IDS[5], IDS[4])
    assert [getattr(with_overrides(roles, model=IDS[7]), k) for k in ("analyst_model", "pm_model")] == [IDS[7], IDS[7]]
    assert [getattr(with_overrides(roles, model=IDS[7], pm_model=IDS[0]), k) for k in ("analyst_model", "pm_model")] == [IDS[7], IDS[0]]
    (tmp_path / "e.env").write_text("# c\n\nA = 'x=1' \nB=\"two\"\nnope\nA=later\n")
    assert {r["key"]: r["value"] for r in read_key_values(spark, str(tmp_path / "e.env")).collect()} == {"A": "x=1", "B": "two"}


def test_news(spark):
    flat, nested = (True, "t1", "p1", None), (True, None, None, ("t2", ("p2",)))
    cases = {
        "a": [flat, nested], "none": [], "anon": [(True, "t", None, None), (True, None, None, ("u", None))], "untitled": [(True, "", "p", None)],
        "slots": [(False, "x", "p", None)] * 4 + [flat, nested], "many": [(True, f"n{i}", "p", None) for i in range(9)],
    }
    df = spark.createDataFrame(list(cases.items()), f"k string, e array<struct<{ENTRY.replace(' boolean', ':boolean').replace(' string', ':string').replace(' struct', ':struct')}>>")
    got = {r["k"]: r["d"] for r in df.select("k", news.digest_array(F.col("e")).alias("d")).collect()}
    assert got == {"a": "- [p1] t1\n- [p2] t2", "none": news.NO_NEWS, "anon": "- [Unknown] t\n- [Unknown] u", "untitled": news.NO_NEWS, "slots": "- [p1] t1", "many": "\n".join(f"- [p] n{i}" for i in range(5))}


ORDERS = "acct long, symbol string, id string, side string, order_type string, type string, qty string"
ROWS = [(1, "A", "1", "SELL", "stop", None, "5"), (1, "B", "2", "sell", None, "STOP_LIMIT", "5"), (1, "C", "3", "Sell", "trailing_stop", "x", "5"), (1, "D", "4", "buy", "stop", None, "5"), (1, "E", "5", "sell", "market", None, "5")]


def test_orders_and_reconcile(spark):
    o = spark.createDataFrame(ROWS, ORDERS)
    assert {r["symbol"] for r in orders.protected_symbols(o).collect()} == {"A", "B", "C"}
    assert {r["symbol"] for r in orders.pending_symbols(o).collect()} == {"D", "E"}
    assert [r["id"] for r in orders.stops_to_cancel(o, spark.createDataFrame([(1, "A"), (1, "D")], "acct long, symbol string")).collect()] == ["1"]
    p = spark.createDataFrame(
        [(1, "A", "10", "0", "50", "50", "1"), (1, "X", "10", "0", "100", "50", "1"), (1, "Y", "10", "0", None, "80", "1"), (1, "Z", "10", "0", "0", "80", "1"), (1, "S", "-4", "0", "10", "10", "1"), (1, "N", "n/a", "0", "10", "10", "1"), (1, "W", "0", "0", "10", "10", "1")],
        "acct long, symbol string, qty string, market_value string, current_price string, avg_entry_price string, unrealized_pl string",
    )
    got = {r["symbol"]: (r["qty"], r["stop"]) for r in reconcile.stop_intents(p, o, Settings()).collect()}
    assert got == {"X": (10.0, 90.0), "Y": (10.0, 72.0)}
    line = {r["symbol"]: r["line"] for r in reconcile.position_status(p, o).collect()}
    assert line["A"] == "    - A      :       10 sh | Entry: $    50.00 | P&L: $      1.00 | protected"


def test_overview_is_strict(spark):
    a = spark.createDataFrame([(1, "97", "1", "100"), (2, "96.9", "1", "100"), (3, "97.1", "1", "100"), (4, "50", "1", "0")], "acct long, portfolio_value string, cash string, last_equity string")
    p = spark.createDataFrame([], "acct long, symbol string")
    got = {r["acct"]: (r["is_day_loss_triggered"], r["n_open_orders"]) for r in orders.overview(a, p, spark.createDataFrame(ROWS, ORDERS), Settings()).collect()}
    assert got == {1: (False, 5), 2: (True, 0), 3: (False, 0), 4: (False, 0)}


def test_usage(spark):
    u = spark.createDataFrame([(IDS[0], 600_000, 100_000, 300_000, 100_000), ("nobody", 10**6, 10**6, None, None), (IDS[7], None, 1000, None, None)], "model string, input_tokens long, output_tokens long, cache_read_input_tokens long, cache_creation_input_tokens long")
    got = {r["model"]: r for r in models.ledger(u, catalog(spark), "model").collect()}
    assert got[IDS[0]]["cost_usd"] == pytest.approx(7.50) and got["nobody"]["cost_usd"] == 0.0 and got["nobody"]["calls"] == 1
    assert [r["model"] for r in models.unknown_models(u, catalog(spark)).collect()] == ["nobody"]
    assert sum(r["cost_usd"] for r in models.priced(u, catalog(spark)).collect()) == pytest.approx(7.505)
    assert models.ledger(u, catalog(spark)).select(models.summary_line().alias("s")).first()["s"] == "3 API calls | 2,000,000 in / 1,101,000 out tokens | ~$7.50"


def test_features_and_requests(spark):
    m = models.profiles(spark.createDataFrame([(IDS[0],), (IDS[7],), ("new",)], "model string"), catalog(spark)).withColumn("features", models.feature_set(F.lit(True)))
    got = {r["model"]: r for r in m.select("model", "features", models.next_to_drop(F.col("features")).alias("drop"), models.degradation_path(F.col("features")).alias("path")).collect()}
    assert got[IDS[0]]["features"] == ["thinking", "effort", "fallbacks", "json_schema"] and got[IDS[0]]["drop"] == "fallbacks"
    assert got["new"]["features"] == ["json_schema"] and got["new"]["path"] == [["json_schema"], []]
    assert [len(x) for x in got[IDS[0]]["path"]] == [4, 3, 2, 1, 0] and got[IDS[0]]["path"][3] == ["thinking"]
    calls = m.withColumns({"system": F.lit("s"), "user": F.lit('say "hi"'), "max_tokens": F.lit(8000)})
    body = {r["model"]: json.loads(r["request"]) for r in models.requests(calls, Settings(effort="max")).collect()}
    assert body[IDS[0]]["thinking"] == {"type": "adaptive"} and body[IDS[0]]["output_config"]["effort"] == "max" and body[IDS[0]]["fallbacks"] == "default"
    assert body[IDS[0]]["output_config"]["format"]["schema"]["additionalProperties"] is False and body[IDS[0]]["messages"] == [{"role": "user", "content": 'say "hi"'}]
    assert "thinking" not in body[IDS[7]] and "fallbacks" not in body[IDS[7]] and "effort" not in body[IDS[7]]["output_config"]


def test_responses(spark):
    r = spark.createDataFrame([([("thinking", "hm"), ("text", " a"), ("text", "b ")], "end_turn"), ([("text", "x")], "refusal")], "content array<struct<type:string,text:string>>, stop_reason string")
    assert [(x["refused"], x["text"]) for x in models.read_responses(r).collect()] == [(False, "ab"), (True, None)]


class Failing(provider.RuleProvider):
    def answer(self, role, context, so_far):
        if role == context:
            raise RuntimeError("down")
        return super().answer(role, context, so_far)


def test_debate(spark):
    got = {r["ticker"]: r for r in provider.debate(spark.createDataFrame([("ok", "x"), ("early", "bear"), ("late", "pm")], "ticker string, context string"), Failing()).collect()}
    assert got["ok"]["failed"] is None and got["ok"]["raw"].startswith("```json") and got["ok"]["risk_assessment"].startswith("risk view after 2")
    assert got["early"]["failed"] == "debate" and got["early"]["bull_thesis"] and not got["early"]["risk_assessment"]
    assert got["late"]["failed"] == "PM synthesis" and got["late"]["risk_assessment"]


def test_fills(spark):
    rows = [("1", "A", 10.0, 100.0, "95", "FILLED", "7", "101"), ("2", "A", 10.0, 100.0, None, "filled", None, None), ("3", "A", 10.0, 100.0, None, "new", "0", None), ("4", "A", 10.0, 100.0, None, "Canceled", None, None)]
    got = [(r["qty"], r["status"], r["stop_price"], r["ended"]) for r in cycle.fill_outcomes(spark.createDataFrame(rows, "order_id string, ticker string, qty double, current_price double, suggested_stop string, status string, filled_qty string, filled_avg_price string"), Settings()).orderBy("order_id").collect()]
    assert got == [(7.0, "SUBMITTED", 95.0, False), (10.0, "SUBMITTED", 90.0, False), (10.0, "DEFERRED", None, False), (10.0, "DEFERRED", None, True)]


def fold(rows, nav, cash, s):
    """One account by hand."""
    out, moved = [], {}
    for r in rows:
        held, q, mv = moved.get(r["ticker"], (r["held"], r["qty"] and float(r["qty"]), abs(float(r["market_value"] or 0))))
        p, n, before = r["current_price"], 0.0, cash
        capital = min(nav * min(r["allocation_percentage"], s.max_position_percent), nav * s.max_position_percent - mv, cash - nav * s.min_cash_buffer_percent)
        if r["action"] == "SELL" and held and q and q > 0 and not r["pending"]:
            n, cash, moved[r["ticker"]] = q, cash + q * p, (False, None, 0.0)
        elif r["action"] == "BUY" and not r["pending"] and r["conviction_score"] >= s.min_conviction and capital >= p:
            n = float(capital // p)
            cash, moved[r["ticker"]] = cash - n * p, (True, (q or 0.0) + n, mv + n * p)
        out.append((r["nth"], n, before))
    return out


def test_live_fold(spark):
    rng, rows = random.Random(8), []
    for acct in range(12):
        for nth in range(25):
            t = rng.choice("ABCD")
            rows.append({"acct": acct, "nav": 50_000.0, "cash": 30_000.0, "nth": nth, "ticker": t, "action": rng.choice(["BUY", "BUY", "SELL", "HOLD"]), "conviction_score": rng.choice([0.5, 0.7, 0.9]), "allocation_percentage": rng.choice([0.02, 0.06, 0.2]), "current_price": 20.0 + ord(t), "pending": t == "D" and acct % 2 == 0, "held": t == "A", "qty": "12" if t == "A" else None, "market_value": "1020" if t == "A" else None})
    df = spark.createDataFrame(rows, "acct long, nav double, cash double, nth long, ticker string, action string, conviction_score double, allocation_percentage double, current_price double, pending boolean, held boolean, qty string, market_value string")
    got = {(r["acct"], r["nth"]): (r["approved_qty"], r["cash_before"]) for r in cycle.live_fold(df.repartition(5), Settings(), "nth").collect()}
    for acct in range(12):
        for nth, n, before in fold([r for r in rows if r["acct"] == acct], 50_000.0, 30_000.0, Settings()):
            assert got[acct, nth] == (n, pytest.approx(before)), (acct, nth)


def test_audit(spark):
    spark.sql("create database if not exists audit_test")
    for t in audit.TABLES:
        spark.sql(f"drop table if exists audit_test.{t}")
    audit.create_tables(spark, "audit_test")
    e = audit.event(spark, "INFO", "cycle_start", "x", "2026-01-01T00:00:00+00:00").union(audit.event(spark, "ERROR", "cycle_abort", "y", "2026-01-02T00:00:00+00:00"))
    audit.append(audit.numbered(e, "timestamp"), "audit_test.system_events")
    assert [(r["id"], r["event"]) for r in spark.table("audit_test.system_events").orderBy("id").collect()] == [(1, "cycle_start"), (2, "cycle_abort")]
    assert [r["id"] for r in audit.numbered(spark.range(1000).withColumnRenamed("id", "k").repartition(7), "k", per_range=90).orderBy("k").collect()] == list(range(1, 1001))
    assert audit.numbered(e.limit(0), "timestamp").count() == 0
    spark.sql("drop database audit_test cascade")


def test_streaming_bars(spark, tmp_path):
    from tapeline.streaming.bars import hourly_bars, ingest, read_ticks

    at = [datetime.datetime(2024, 1, 1, h, 30) for h in (0, 0, 1, 9)]
    spark.createDataFrame([(i, "A", t, float(i)) for i, t in enumerate(at)], "event_id long, event_type string, ts timestamp, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = read_ticks(spark, str(tmp_path / "in"), "event_id long, event_type string, ts timestamp, value double")
    ingest(hourly_bars(stream, "event_type", "ts", "value", "event_id"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("bar_date").collect()
    assert [(r["open"], r["close"], r["volume"]) for r in got] == [(0.0, 1.0, 2), (2.0, 2.0, 1)]


def test_ids_over_several_ranges(spark):
    """Dense, unique and in order over many ranges, again and again, and with negative and large keys."""
    rows = spark.range(60_000).selectExpr("id * id * 7919 % 1000003 - 500000 as k", "id as v").dropDuplicates(["k"]).repartition(9)
    want = {r["k"]: i for i, r in enumerate(rows.orderBy("k").collect(), 1)}
    for per_range in (3_000, 9_000, 100_000):
        assert {r["k"]: r["id"] for r in audit.numbered(rows, "k", per_range=per_range).collect()} == want


def test_what_is_not_finite_stays(spark):
    r = spark.range(1).select(scalars.exact_round(F.lit(float("inf"))).alias("a"), scalars.exact_round(F.lit(float("-inf"))).alias("b"), scalars.exact_round(F.lit(float("nan"))).alias("c"), scalars.exact_round(F.lit(None).cast("double")).alias("d"), scalars.plain(F.lit(float("inf"))).alias("e"), scalars.money(F.lit(-1234.5)).alias("f")).first()
    assert r["a"] == float("inf") and r["b"] == float("-inf") and r["c"] != r["c"] and r["d"] is None and r["e"] == "inf" and r["f"] == "-1,234.50"


def test_number_text(spark):
    xs = [0.0, 1.0, 1234.5, 1e7, 12345678.9, 123456789012.25, 0.0005, -1e9, 0.001]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", scalars.number_text(F.col("x")).alias("t")).collect()
    assert all(r["t"] == repr(r["x"]) for r in got)


def test_last_report_wins_whole(spark):
    rows = [(1, "A", 1, "9", "900.0"), (1, "A", 3, "10", "50.0"), (1, "A", 2, "95", "9500.0"), (2, "A", 1, None, None)]
    got = {(r["acct"], r["ticker"]): (r["qty"], r["market_value"]) for r in risk.last_positions(spark.createDataFrame(rows, "acct long, symbol string, arrival long, qty string, market_value string")).collect()}
    assert got == {(1, "A"): ("10", "50.0"), (2, "A"): (None, None)}


def test_descriptions():
    assert describe_models(Settings()) == f"{IDS[0]} (all agents), effort=high"
    assert describe_models(with_overrides(Settings(), analyst_model=IDS[5], effort="low")) == f"analysts={IDS[5]}, PM={IDS[0]}, effort=low"


def test_catalog_is_a_parameter(spark, tmp_path):
    (tmp_path / "c.csv").write_text("model,label,input_price,output_price,context,adaptive_thinking,effort,server_side_fallbacks\nm,M,1,2,9K,true,false,false\n")
    u = spark.createDataFrame([("m", 10**6, 10**6, None, None)], "model string, input_tokens long, output_tokens long, cache_read_input_tokens long, cache_creation_input_tokens long")
    assert models.ledger(u, catalog(spark, str(tmp_path / "c.csv"))).first()["cost_usd"] == 3.0
