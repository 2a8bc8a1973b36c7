import datetime
import random

import numpy as np
import pandas as pd
import pytest

from tapeline.operators import indicators


def frame(spark, series):
    rows = []
    for ticker, bars in series.items():
        for i, (h, lo, c) in enumerate(bars):
            rows.append((ticker, datetime.date(2024, 1, 1) + datetime.timedelta(days=i), c, h, lo, c, i))
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "ticker string, bar_date date, open double, high double, low double, close double, volume long")


def walk(n, seed):
    rng = np.random.default_rng(seed)
    c = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    return [(float(x * 1.01), float(x * 0.98), float(x)) for x in c]


SERIES = {"walk": walk(300, 1), "flat": [(5.0, 5.0, 5.0)] * 70, "up": [(i + 1.0, i + 0.5, i + 1.0) for i in range(80)], "short": walk(59, 2), "edge": walk(60, 3)}


def expected(bars):
    df = pd.DataFrame(bars, columns=["h", "l", "c"])
    d = df.c.diff()
    gain, loss = d.where(d > 0, 0).rolling(14).mean(), (-d.where(d < 0, 0)).rolling(14).mean()
    tr = pd.concat([df.h - df.l, (df.h - df.c.shift()).abs(), (df.l - df.c.shift()).abs()], axis=1).max(axis=1)
    return pd.DataFrame({"sma_20": df.c.rolling(20).mean(), "sma_50": df.c.rolling(50).mean(), "rsi_14": 100 - 100 / (1 + gain / (loss + 1e-9)), "atr_14": tr.rolling(14).mean()})


def test_series_match_pandas(spark):
    df = frame(spark, SERIES)
    got = indicators.sma(df).join(indicators.rsi(df), ["ticker", "bar_date"]).join(indicators.atr(df), ["ticker", "bar_date"]).toPandas()
    for ticker, bars in SERIES.items():
        mine = got[got.ticker == ticker].sort_values("bar_date").reset_index(drop=True)
        want = expected(bars)
        for c in want:
            assert mine[c].isna().equals(want[c].isna()), (ticker, c)
            assert np.nanmax(np.abs(mine[c] - want[c]), initial=0) < 1e-9, (ticker, c)


def test_packet(spark):
    got = {r["ticker"]: r for r in indicators.market_packet(frame(spark, SERIES)).collect()}
    assert set(got) == {"walk", "flat", "up", "edge"}
    assert got["flat"]["rsi_14"] == 0.0 and got["up"]["rsi_14"] > 99.9
    last = SERIES["walk"][-252:]
    assert got["walk"]["52w_high"] == round(max(b[0] for b in last), 2) and got["walk"]["52w_low"] == round(min(b[1] for b in last), 2)
    assert {r["ticker"] for r in indicators.insufficient_history(frame(spark, SERIES)).collect()} == {"short"}


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), 0.0, -1.0])
def test_unusable_last_close(spark, bad):
    bars = walk(70, 5)
    bars[-1] = (bars[-1][0], bars[-1][1], bad)
    assert indicators.market_packet(frame(spark, {"x": bars})).count() == 0


def test_gap_in_last_fifty(spark):
    bars = walk(70, 6)
    bars[40] = (bars[40][0], bars[40][1], float("nan"))
    assert indicators.market_packet(frame(spark, {"x": bars})).count() == 0


def test_one_exchange_serves_all_windows(spark):
    df = frame(spark, SERIES)
    plan = indicators.market_packet(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_empty(spark):
    assert indicators.market_packet(frame(spark, SERIES).limit(0)).count() == 0
