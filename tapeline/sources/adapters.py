"""Inputs of the operators from the driver's tables: deterministic stand-ins for bars, accounts, orders and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.sources.settings import catalog_rows

WATCHLIST = " 1-urgent , 2-high ,, 5-Low,1-URGENT, NOPX "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ohlc(rows: DataFrame, ticker: str, at: str, price: str, order: str, volume: str) -> DataFrame:
    """Bars from ticks: first and last price by a unique order, extremes, and a volume expression."""
    named = rows.selectExpr(f"{ticker} as ticker", f"{at} as bar_date", f"{price} as price", f"{order} as nth", f"{volume} as part")
    return named.groupBy("ticker", "bar_date").agg(F.min_by("price", "nth").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "nth").alias("close"), F.sum("part").cast("long").alias("volume"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ohlc(table(spark, sf_dir, "orders"), "o_orderpriority", "cast(o_orderdate as date)", "o_totalprice", "o_orderkey", "1L")


def bars_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 tickers. Parts are joined as they are; their table stays small beside the line items."""
    ticks = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return ohlc(ticks, "p_brand", "cast(l_shipdate as date)", "l_extendedprice / l_quantity", "struct(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)", "cast(l_quantity as bigint)")


def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ohlc(table(spark, sf_dir, "events"), "event_type", "cast(date_trunc('hour', ts) as timestamp_ntz)", "value", "event_id", "1L")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last close of each ticker in thousands, two places."""
    last = bars(spark, sf_dir).groupBy("ticker").agg(F.max_by("close", "bar_date").alias("close"))
    return last.select("ticker", (F.floor(F.col("close") / 10) / 100).alias("price"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdings per account; numbers land as text, some of them unreadable, empty or zero."""
    f = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    sums = f.groupBy(F.col("o_custkey").alias("acct"), F.col("o_orderpriority").alias("symbol")).agg(
        F.expr("sum(case when o_orderkey % 11 = 0 then -1 when o_orderkey % 11 = 1 then 0 else 1 end * (1 + o_orderkey % 40))").alias("q"),
        F.expr("sum(cast(round(o_totalprice * 100) as bigint))").alias("cents"),
    )
    return sums.selectExpr(
        "acct", "symbol", "case when acct % 17 = 0 and symbol = '2-HIGH' then 'n/a' else cast(q as string) end as qty",
        "cast(cents / 10000.0D as string) as market_value",
        "case when acct % 5 = 0 then null when acct % 5 = 1 then '0' when acct % 5 = 2 then '' else cast(100 + acct % 90 as string) end as current_price",
        "cast(90 + acct % 70 as string) as avg_entry_price", "cast((acct % 400 - 200) * 1.25D as string) as unrealized_pl",
    )


def open_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resting orders; types and sides in mixed case, the type in either of two columns."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    kind = "element_at(array('market', 'stop', 'STOP_LIMIT', 'trailing_stop'), cast(o_orderkey % 4 + 1 as int))"
    return o.selectExpr(
        "cast(o_orderkey as string) as id", "o_custkey as acct", "o_orderpriority as symbol", "case when o_orderkey % 5 = 0 then 'buy' else 'SELL' end as side",
        f"case when o_orderkey % 3 <> 0 then {kind} end as order_type", f"{kind} as type", "'open' as status", "cast(1 + o_orderkey % 40 as string) as qty",
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per account, numbers as text: cash, value with holdings, and the value of the day before."""
    held = positions(spark, sf_dir).groupBy("acct").agg(F.sum(F.expr("cast(round(cast(market_value as double) * 10000) as bigint)")).alias("v"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("acct"), F.expr("cast(round(c_acctbal * 100) as bigint)").alias("cents")).join(held, "acct", "left")
    nav = "(greatest(0, cents * 1000) + coalesce(v, 0)) / 10000.0D"
    return c.selectExpr("acct", f"cast({nav} as string) as portfolio_value", "cast(cents / 10.0D as string) as cash", f"cast(case when acct % 13 = 0 then 0.0D else {nav} * (1 + (acct % 11 - 5) / 100.0D) end as string) as last_equity")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One verdict per event, for the account of its user."""
    e = table(spark, sf_dir, "events")
    return e.selectExpr(
        "event_id", "user_id as acct",
        "element_at(array('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW', 'NOPX'), cast(event_id % 6 + 1 as int)) as ticker",
        "case event_type when 'purchase' then 'BUY' when 'error' then 'SELL' when 'view' then 'HOLD' when 'click' then ' buy ' else 'ACCUMULATE' end as action",
        "cast(get_json_object(props, '$.k') as double) / 80 as conviction_score", "value / 1000 - 0.01D as allocation_percentage",
    )


def verdict_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw verdicts: fenced, in prose or bare; some without an object, with nulls, odd types or missing fields."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", "event_type", "cast(get_json_object(props, '$.k') as bigint) as k", "event_id % 13 as kind")
    conviction = "case kind when 1 then '4.2' when 2 then concat('\"', cast(k * 125 as string), 'e-4\"') when 3 then 'true' when 4 then 'null' when 5 then '\"high\"' else concat(cast(k * 125 as string), 'e-4') end"
    risks = "case kind when 6 then ', \"key_risks\": \"single\"' when 7 then ', \"key_risks\": [\"a\", 1]' when 8 then ', \"key_risks\": null' when 9 then '' else ', \"key_risks\": [\"rates\", \"volume\"]' end"
    target = "case kind when 10 then ', \"target_price\": null' when 11 then ', \"target_price\": 120.5, \"stop_loss_price\": \"91\"' else '' end"
    action = "case event_type when 'purchase' then 'BUY' when 'error' then 'sell' when 'click' then ' buy ' when 'view' then 'HOLD' else 'ACCUMULATE' end"
    missing = "case when kind = 12 then '' else concat(', \"conviction_score\": ', " + conviction + ") end"
    obj = f"concat('{{\"action\": \"', {action}, '\"', {missing}, ', \"allocation_percentage\": ', cast(k as string), 'e-3', {target}, {risks}, '}}')"
    text = "case when event_id % 7 = 0 then 'No view on this one.' when event_id % 3 = 0 then concat('Verdict:\\n```json\\n', obj, '\\n```\\nDone.') when event_id % 3 = 1 then concat('My call is ', obj, ' as argued.') else obj end"
    return e.selectExpr("event_id", f"{obj} as obj").selectExpr("event_id", f"{text} as raw", "cast(50 + event_id % 400 as double) + 0.25D as current_price")


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries per ticker in order: flat and nested shapes, some no objects, some without title or publisher."""
    d = table(spark, sf_dir, "documents").selectExpr("coalesce(source, '') as ticker", "doc_id as nth", "substring_index(coalesce(text, ''), '\\n', 1) as line", "doc_id % 11 <> 3 as is_object", "doc_id % 2 = 0 as nested", "case when doc_id % 5 = 0 then '' when doc_id % 5 <> 1 then concat('wire ', cast(doc_id % 9 as string)) end as who")
    return d.selectExpr("ticker", "nth", "is_object", "case when nth % 7 <> 2 and not nested then line end as title", "case when not nested then who end as publisher", "case when nested then named_struct('title', case when nth % 7 <> 2 then line end, 'provider', named_struct('displayName', who)) end as content")


def model_names() -> list[str]:
    """The catalog's ids and one that it doesn't have."""
    return [r[0] for r in catalog_rows()] + ["unlisted-model"]


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    names = ", ".join(f"'{n}'" for n in model_names())
    return c.selectExpr("conv_id", "turn", f"element_at(array({names}), cast(conv_id % {len(model_names())} + 1 as int)) as model", "cast(length(text) as bigint) as input_tokens", "turn * 10 as output_tokens", "case when turn % 2 = 0 then 7L end as cache_read_input_tokens", "case when turn % 3 = 0 then 11L end as cache_creation_input_tokens")
