"""Append-only audit tables. Decisions are written once, with their risk outcome, so nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.sources.interim import written

DECISIONS = "id bigint, timestamp string, ticker string, action string, conviction_score double, allocation_percentage double, target_price double, stop_loss_price double, current_price double, bull_thesis string, bear_thesis string, risk_assessment string, pm_summary string, key_risks string, risk_approved int, risk_reason string, approved_qty double"
EXECUTIONS = "id bigint, timestamp string, ticker string, side string, qty double, order_type string, order_id string, status string, execution_notes string"
EVENTS = "id bigint, timestamp string, level string, event string, details string"
TABLES = {"agent_decisions": DECISIONS, "trade_executions": EXECUTIONS, "system_events": EVENTS}


def create_tables(spark: SparkSession, database: str = "default") -> None:
    for name, columns in TABLES.items():
        spark.sql(f"create table if not exists {database}.{name} ({columns}) using parquet")


def numbered(rows: DataFrame, *order: str, first: int = 1, per_range: int = 50_000, most_ranges: int = 10_000) -> DataFrame:
    """rows with a dense id in the given unique order.

    Rows are dealt to ranges and written once with their range's number; counts and ids both come from what was written, as the bounds
    of ranges are sampled anew whenever they are dealt. Rows of equal order, if any, get different ids in some order.
    """
    total = rows.count()
    if not total:
        return rows.withColumn("id", F.lit(first).cast("long"))
    parts = max(1, min(most_ranges, -(-total // per_range)))
    dealt = written(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "numbered")
    starts, at = [], first - 1
    for part, n in sorted(tuple(r) for r in dealt.groupBy("__part").count().collect()):  # at most most_ranges rows
        starts.append((part, at))
        at += n
    ahead = rows.sparkSession.createDataFrame(starts, "__part int, __ahead long")
    nth = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__nth", nth).join(F.broadcast(ahead), "__part").withColumn("id", F.col("__ahead") + F.col("__nth")).drop("__part", "__ahead", "__nth")


def decision_rows(outcomes: DataFrame, timestamp: str, *keep: str) -> DataFrame:
    """Validated decisions as rows of agent_decisions, with the columns in keep first (an id from numbered(), say)."""
    have = set(outcomes.columns)
    text = lambda c: (F.coalesce(c, F.lit("")) if c in have else F.lit("")).alias(c)
    return outcomes.select(
        *keep, F.lit(timestamp).alias("timestamp"), "ticker", F.coalesce("action", F.lit("HOLD")).alias("action"), F.coalesce("conviction_score", F.lit(0.0)).alias("conviction_score"), F.coalesce("allocation_percentage", F.lit(0.0)).alias("allocation_percentage"),
        *[(F.col(c) if c in have else F.lit(None).cast("double")).alias(c) for c in ("target_price", "stop_loss_price", "current_price")], text("bull_thesis"), text("bear_thesis"), text("risk_assessment"),
        (F.col("thesis_summary") if "thesis_summary" in have else F.lit("")).alias("pm_summary"), (F.to_json("key_risks") if "key_risks" in have else F.lit("[]")).alias("key_risks"),
        F.col("approved").cast("int").alias("risk_approved"), F.col("reason").alias("risk_reason"), "approved_qty",
    )


def append(rows: DataFrame, table: str) -> None:
    rows.select(*[c.strip().split(" ")[0] for c in TABLES[table.rpartition(".")[2]].split(",")]).write.mode("append").insertInto(table)


def stored(rows: DataFrame, table: str) -> DataFrame:
    """rows as an audit table's columns and types, written once and read back."""
    columns = [c.strip().split(" ") for c in TABLES[table].split(",")]
    return written(rows.select(*[F.col(n).cast(t).alias(n) for n, t in columns]), table)


def event(spark: SparkSession, level: str, name: str, details: str, timestamp: str) -> DataFrame:
    return spark.createDataFrame([(timestamp, level, name, details)], "timestamp string, level string, event string, details string")
