"""Verdict providers: anything that answers a prompt. Only a rule-based one ships; nothing is called over a network."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    def answer(self, role: str, context: str, so_far: dict[str, str]) -> str:
        """Text of one role; raises RuntimeError where there is none."""


class RuleProvider:
    """Deterministic answers from the numbers in the prompt, for tests and dry runs."""

    def answer(self, role: str, context: str, so_far: dict[str, str]) -> str:
        if role != "pm":
            return f"{role} view after {len([v for v in so_far.values() if v])} others on {context.strip().splitlines()[0]}"
        numbers = {k: float(v.lstrip("$")) for k, _, v in (line.partition(": ") for line in context.splitlines()) if v.lstrip("$").replace(".", "", 1).isdigit()}
        rsi = numbers.get("14-Day RSI", 50.0)
        action, conviction = ("BUY", 0.9) if rsi < 45 else ("SELL", 0.8) if rsi > 55 else ("HOLD", 0.3)
        return f'```json\n{{"action": "{action}", "conviction_score": {conviction}, "allocation_percentage": 0.05, "key_risks": ["volatility"]}}\n```'


def debate(contexts: DataFrame, provider: Provider) -> DataFrame:
    """contexts (ticker, context) -> bull, bear, risk, pm texts and `failed`, the stage that gave none.

    One provider per partition. Its answers need not repeat: write them before they are used twice.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for ticker, context in zip(frame["ticker"], frame["context"]):
                said, failed = {"bull": "", "bear": "", "risk": ""}, None
                try:
                    for role in said:
                        said[role] = provider.answer(role, context, said)
                    pm = provider.answer("pm", context, said)
                except RuntimeError:
                    failed, pm = "PM synthesis" if said["risk"] else "debate", ""
                rows.append((ticker, context, *said.values(), pm, failed))
            yield pd.DataFrame(rows, columns=["ticker", "context", "bull_thesis", "bear_thesis", "risk_assessment", "raw", "failed"])

    return contexts.select("ticker", "context").mapInPandas(run, "ticker string, context string, bull_thesis string, bear_thesis string, risk_assessment string, raw string, failed string")


def failure_reason() -> Column:
    return F.concat(F.lit("Provider unavailable during "), F.col("failed"))
