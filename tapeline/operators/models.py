"""Model catalog operators: ledger, unknown models, feature sets, routing, requests, degradation, responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions.scalars import BLANK, money
from tapeline.sources.settings import UNKNOWN_LABEL, Settings

#: Which feature a rejected request gives up first (fixed order).
DEGRADE_ORDER = ("fallbacks", "json_schema", "effort", "thinking")

#: What a request with fallbacks announces; attempts of a call and the base of its waits in seconds (fixed values).
FALLBACK_BETA, ATTEMPTS, WAIT_BASE = "server-side-fallback-2026-07-01", 3, 2

#: The closed schema of a decision (fixed values).
DECISION_FIELDS = {"action": {"type": "string", "enum": ["BUY", "SELL", "HOLD"]}} | {k: {"type": "number"} for k in ("conviction_score", "allocation_percentage", "target_price", "stop_loss_price")} | {"thesis_summary": {"type": "string"}, "key_risks": {"type": "array", "items": {"type": "string"}}}
DECISION_SCHEMA = {"type": "object", "properties": DECISION_FIELDS, "required": list(DECISION_FIELDS), "additionalProperties": False}


def priced(usage: DataFrame, catalog: DataFrame) -> DataFrame:
    """Usage with its cost; cached tokens count at the full input rate, an unknown model costs nothing."""
    nums = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")}
    joined = usage.withColumns(nums).join(catalog, "model", "left")
    total = F.col("input_tokens") + F.col("cache_read_input_tokens") + F.col("cache_creation_input_tokens")
    return joined.select("*", total.alias("total_input"), (total / 1_000_000 * F.coalesce("input_price", F.lit(0.0)) + F.col("output_tokens") / 1_000_000 * F.coalesce("output_price", F.lit(0.0))).alias("cost_usd"))


def ledger(usage: DataFrame, catalog: DataFrame, *by: str) -> DataFrame:
    """Calls, tokens and cost, by the given columns or in all. Tokens are summed before they are priced."""
    sums = usage.groupBy("model", *[c for c in by if c != "model"]).agg(
        F.count("*").alias("calls"), F.sum(F.coalesce("input_tokens", F.lit(0)) + F.coalesce("cache_read_input_tokens", F.lit(0)) + F.coalesce("cache_creation_input_tokens", F.lit(0))).cast("long").alias("input_tokens"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).cast("long").alias("output_tokens"),
    )
    cost = F.col("input_tokens") / 1_000_000 * F.coalesce("input_price", F.lit(0.0)) + F.col("output_tokens") / 1_000_000 * F.coalesce("output_price", F.lit(0.0))
    out = sums.join(catalog.select("model", "input_price", "output_price"), "model", "left").withColumn("cost_usd", cost)
    return out.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("calls", "input_tokens", "output_tokens", "cost_usd")])


def summary_line() -> Column:
    return F.concat(F.col("calls").cast("string"), F.lit(" API calls | "), money(F.col("input_tokens"), 0), F.lit(" in / "), money(F.col("output_tokens"), 0), F.lit(" out tokens | ~$"), money(F.col("cost_usd")))


def unknown_models(usage: DataFrame, catalog: DataFrame) -> DataFrame:
    return usage.join(catalog, "model", "left_anti").groupBy("model").agg(F.count("*").alias("calls"))


def profiles(models: DataFrame, catalog: DataFrame) -> DataFrame:
    """models (model, ...) with their profile, or the plainest one where the catalog has none."""
    joined = models.join(catalog, "model", "left")
    defaults = {"label": F.lit(UNKNOWN_LABEL), "input_price": F.lit(0.0), "output_price": F.lit(0.0), "context": F.lit("unknown"), **{c: F.lit(False) for c in ("adaptive_thinking", "effort", "server_side_fallbacks")}}
    return joined.withColumns({c: F.coalesce(c, d) for c, d in defaults.items()})


def feature_set(want_schema: Column) -> Column:
    return F.array_compact(F.array(F.when(F.col("adaptive_thinking"), "thinking"), F.when(F.col("effort"), "effort"), F.when(F.col("server_side_fallbacks"), "fallbacks"), F.when(want_schema, "json_schema")))


def next_to_drop(features: Column) -> Column:
    """The first feature of the degradation order that is still there, null if none."""
    return F.get(F.filter(F.array(*map(F.lit, DEGRADE_ORDER)), lambda f: F.array_contains(features, f)), F.lit(0))


def degradation_path(features: Column) -> Column:
    """What rejected requests leave, from all features to none: array<array<string>>."""
    ordered = F.filter(F.array(*map(F.lit, DEGRADE_ORDER)), lambda f: F.array_contains(features, f))
    return F.transform(F.sequence(F.lit(0), F.size(ordered)), lambda i: F.array_except(features, F.slice(ordered, F.lit(1), i)))


def call_outcomes(calls: DataFrame, answers: str = "answers") -> DataFrame:
    """calls (features, answers: array of `bad_request`, `retry` or `ok` in order) with what the call comes to.

    A bad request drops the next feature and is sent again, or ends the call as `rejected` where none is left. Anything
    to retry waits 2, 4, ... seconds and ends the call as `unavailable` at the third. What no answer ends is `ok`.
    """
    state = lambda status, left, tries, waits, sent: F.struct(status.alias("status"), left.alias("features_left"), tries.alias("attempts"), waits.alias("wait_seconds"), sent.alias("n_requests"))
    start = state(F.lit("open"), F.col("features"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"))

    def step(s: Column, answer: Column) -> Column:
        drop, tries = next_to_drop(s["features_left"]), s["attempts"] + 1
        bad, over = answer == "bad_request", (answer == "retry") & (s["attempts"] + 1 >= ATTEMPTS)
        status = F.when(answer == "ok", "ok").when(bad & drop.isNull(), "rejected").when(over, "unavailable").otherwise("open")
        retried = answer == "retry"
        moved = state(status, F.when(bad & drop.isNotNull(), F.array_remove(s["features_left"], drop)).otherwise(s["features_left"]), F.when(retried, tries).otherwise(s["attempts"]), s["wait_seconds"] + F.when(retried & ~over, F.pow(F.lit(WAIT_BASE), tries).cast("long")).otherwise(F.lit(0).cast("long")), s["n_requests"] + 1)
        return F.when(s["status"] == "open", moved).otherwise(s)

    folded = calls.withColumn("__end", F.aggregate(answers, start, step))
    return folded.select(*calls.columns, F.when(F.col("__end.status") == "open", "ok").otherwise(F.col("__end.status")).alias("status"), "__end.features_left", "__end.attempts", "__end.wait_seconds", "__end.n_requests")


def routing(settings: Settings, roles: DataFrame) -> DataFrame:
    """roles (role) with the model and token limit of each."""
    pm = F.col("role") == "pm"
    return roles.select("role", F.when(pm, settings.pm_model).otherwise(settings.analyst_model).alias("model"), F.when(pm, settings.pm_max_tokens).otherwise(settings.analyst_max_tokens).alias("max_tokens"), pm.alias("want_schema"))


def requests(calls: DataFrame, settings: Settings) -> DataFrame:
    """calls (model, system, user, max_tokens, features) with `request`, the JSON that would be sent. Absent parts are left out."""
    has = lambda f: F.array_contains("features", f)
    import json

    schema = F.when(has("json_schema"), F.lit(json.dumps(DECISION_SCHEMA, separators=(",", ":"))))
    body = F.to_json(F.struct(
        "model", "max_tokens", F.col("system"), F.array(F.struct(F.lit("user").alias("role"), F.col("user").alias("content"))).alias("messages"),
        F.when(has("thinking"), F.struct(F.lit("adaptive").alias("type"))).alias("thinking"),
        F.when(has("effort") | has("json_schema"), F.struct(F.when(has("effort"), F.lit(settings.effort)).alias("effort"), F.when(has("json_schema"), F.struct(F.lit("json_schema").alias("type"), F.lit("@schema").alias("schema"))).alias("format"))).alias("output_config"),
        F.when(has("fallbacks"), F.array(F.lit(FALLBACK_BETA))).alias("betas"), F.when(has("fallbacks"), F.lit("default")).alias("fallbacks"),
    ))
    return calls.withColumn("request", F.coalesce(F.replace(body, F.lit('"@schema"'), schema), body))


def read_text(content: Column) -> Column:
    """Text blocks of a response, joined and stripped."""
    return F.btrim(F.array_join(F.transform(F.filter(content, lambda b: b["type"] == "text"), lambda b: b["text"]), ""), F.lit(BLANK))


def read_responses(responses: DataFrame) -> DataFrame:
    """responses (content, stop_reason, ...) with `text`, or `refused` and no text."""
    refused = F.coalesce(F.col("stop_reason") == "refusal", F.lit(False))
    return responses.select("*", refused.alias("refused"), F.when(~refused, read_text(F.col("content"))).alias("text"))
