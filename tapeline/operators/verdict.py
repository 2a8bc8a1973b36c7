"""Verdict texts: extract the JSON object, validate and coerce its fields, normalise, fall back to HOLD.

Fields go through VARIANT, which tells a null from an absent field. Two deviations, both on the safe side: a NaN literal
and an object with repeated keys do not parse and fall back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions.scalars import BLANK, clamp, exact_round, plain, upper_strip
from tapeline.sources.settings import Settings

PARSE_FAILED = "Model output parsing failed"


def extract_json(raw: Column) -> Column:
    """From the first { to the last } of the first fenced chunk that starts with one, else of the text; null if none."""
    text = F.btrim(F.coalesce(raw, F.lit("")), F.lit(BLANK))
    parts = F.split(text, "```")
    chunks = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda c: F.btrim(F.regexp_replace(c, r"(?i)^\s*json", ""), F.lit(BLANK)))
    chunk = F.get(F.filter(chunks, lambda c: F.startswith(c, F.lit("{"))), F.lit(0))
    return F.nullif(F.regexp_extract(F.coalesce(chunk, text), r"(?s)\{.*\}", 0), F.lit(""))


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _number(v: Column, path: str, default: Column | None) -> tuple[Column, Column]:
    """Value and whether it is valid: numbers, booleans and numeric texts are; absent takes the default, if there is one."""
    field, kind = F.try_variant_get(v, path, "variant"), _kind(v, path)
    text = F.btrim(F.try_variant_get(v, path, "string"), F.lit(BLANK)).try_cast("double")
    value = F.when(kind == "STRING", text).when(kind == "BOOLEAN", F.when(F.try_variant_get(v, path, "boolean"), 1.0).otherwise(0.0)).when(F.rlike(kind, F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")), F.try_variant_get(v, path, "double"))
    if default is None:
        return value, value.isNotNull()
    return F.when(field.isNull(), default).otherwise(value), field.isNull() | value.isNotNull()


def normalised(texts: DataFrame, settings: Settings, raw: str = "raw", price: str = "current_price") -> DataFrame:
    """texts with the seven decision fields and `fallback`, the reason why the verdict was not usable (else null)."""
    p = F.col(price)
    parsed = texts.withColumn("__v", F.try_parse_json(extract_json(F.col(raw))))
    v = F.col("__v")
    stop = exact_round(p * 0.90)
    conviction, c_ok = _number(v, "$.conviction_score", None)
    allocation, a_ok = _number(v, "$.allocation_percentage", None)
    target, t_ok = _number(v, "$.target_price", p)
    loss, l_ok = _number(v, "$.stop_loss_price", stop)
    thesis, thesis_kind = F.try_variant_get(v, "$.thesis_summary", "variant"), _kind(v, "$.thesis_summary")
    risks, risks_kind = F.try_variant_get(v, "$.key_risks", "variant"), _kind(v, "$.key_risks")
    risks_ok = risks.isNull() | (risks_kind == "STRING") | risks_kind.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.coalesce(F.exists(F.try_variant_get(v, "$.key_risks", "array<string>"), lambda x: x.isNull()), F.lit(False))
    listed = F.when(risks.isNull(), F.expr("cast(array() as array<string>)")).when(risks_kind == "STRING", F.array(F.try_variant_get(v, "$.key_risks", "string"))).otherwise(F.try_variant_get(v, "$.key_risks", "array<string>"))
    valid = v.isNotNull() & (F.schema_of_variant(v).startswith("OBJECT")) & c_ok & a_ok & t_ok & l_ok & (thesis.isNull() | (thesis_kind == "STRING")) & risks_ok
    # an action of any type is read as text; null reads as NONE and so becomes HOLD
    action = upper_strip(F.coalesce(F.try_variant_get(v, "$.action", "string"), F.lit("HOLD")))
    first = parsed.select(
        *texts.columns, F.coalesce(valid, F.lit(False)).alias("__ok"), F.when(action.isin("BUY", "SELL", "HOLD"), action).otherwise("HOLD").alias("__action"), clamp(conviction, 0, 1).alias("__c"), clamp(allocation, 0, 1).alias("__a"),
        target.alias("__t"), loss.alias("__l"), F.coalesce(F.try_variant_get(v, "$.thesis_summary", "string"), F.lit("")).alias("__s"), listed.alias("__r"), stop.alias("__stop"),
    )
    ok, low = F.col("__ok"), (F.col("__action") == "BUY") & (F.col("__c") < settings.min_conviction)
    note = F.concat(F.lit("[Auto-downgraded to HOLD: conviction "), plain(F.col("__c")), F.lit(f" < {settings.min_conviction:.2f}] "), F.col("__s"))
    return first.select(
        *texts.columns,
        F.when(ok & ~low, F.col("__action")).otherwise("HOLD").alias("action"),
        F.when(ok, F.col("__c")).otherwise(0.0).alias("conviction_score"),
        F.when(ok & ~low, F.col("__a")).otherwise(0.0).alias("allocation_percentage"),
        F.when(ok, F.col("__t")).otherwise(p).alias("target_price"),
        F.when(ok, F.col("__l")).otherwise(F.col("__stop")).alias("stop_loss_price"),
        F.when(ok, F.when(low, note).otherwise(F.col("__s"))).otherwise(F.lit(f"Defaulted to HOLD: {PARSE_FAILED}")).alias("thesis_summary"),
        F.when(ok, F.col("__r")).otherwise(F.array(F.lit(PARSE_FAILED))).alias("key_risks"),
        F.when(~ok, F.lit(PARSE_FAILED)).alias("fallback"),
    )


def fallback(packets: DataFrame, reason: Column, price: str = "current_price") -> DataFrame:
    """The HOLD decision for each row."""
    return packets.select(
        "*", F.lit("HOLD").alias("action"), F.lit(0.0).alias("conviction_score"), F.lit(0.0).alias("allocation_percentage"), F.col(price).alias("target_price"),
        exact_round(F.col(price) * 0.90).alias("stop_loss_price"), F.concat(F.lit("Defaulted to HOLD: "), reason).alias("thesis_summary"), F.array(reason).alias("key_risks"),
    )
