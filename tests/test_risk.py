import pytest

from tapeline.operators.risk import stop_price, validate
from tapeline.sources.settings import Settings
from pyspark.sql import functions as F

SCHEMA = "name string, ticker string, action string, conviction_score double, allocation_percentage double, current_price double, nav double, cash double, qty string, market_value string, held boolean, pending boolean"
BASE = {"ticker": "AAA", "action": "BUY", "conviction_score": 0.8, "allocation_percentage": 0.1, "current_price": 100.0, "nav": 100000.0, "cash": 100000.0, "qty": None, "market_value": None, "held": False, "pending": False}
HOLD60, FULL, SHORT = {"held": True, "qty": "60", "market_value": "6000"}, {"held": True, "qty": "100", "market_value": "10000"}, {"held": True, "qty": "-25", "market_value": "2500"}

#: name, change, guard, quantity, part of the reason.
CASES = [
    ("capped", {"allocation_percentage": 0.5}, "G15", 100.0, "Approved BUY of 100 shares ($10,000.00)"),
    ("below cap", {"allocation_percentage": 0.04}, "G15", 40.0, "40 shares"),
    ("low conviction", {"conviction_score": 0.64}, "G9", 0.0, "below minimum threshold"),
    ("conviction at the limit", {"conviction_score": 0.65}, "G15", 100.0, "Approved"),
    ("nan conviction passes", {"conviction_score": float("nan")}, "G15", 100.0, "Approved"),
    ("hold", {"action": "HOLD"}, "G3", 0.0, "HOLD"),
    ("duplicate", {"pending": True}, "G4", 0.0, "Duplicate guard"),
    ("duplicate sell", {"pending": True, "action": "SELL", **FULL}, "G4", 0.0, "Duplicate guard"),
    ("reserve breached", {"cash": 15000.0}, "G12", 0.0, "Cash buffer"),
    ("reserve at zero", {"cash": 20000.0}, "G12", 0.0, "Cash buffer"),
    ("reserve cap", {"cash": 25000.0}, "G15", 50.0, "50 shares"),
    ("headroom", HOLD60, "G15", 40.0, "40 shares"),
    ("at cap", FULL, "G11", 0.0, "Concentration cap"),
    ("short counts", {**SHORT, "market_value": "-10000"}, "G11", 0.0, "$10,000.00"),
    ("unreadable value", {**FULL, "market_value": "?"}, "G15", 100.0, "Approved"),
    ("sell none", {"action": "SELL"}, "G5", 0.0, "No active position"),
    ("sell unreadable", {"action": "SELL", "held": True, "qty": "n/a"}, "G6", 0.0, "Unreadable"),
    ("sell long", {"action": "SELL", "held": True, "qty": "37", "market_value": "3700"}, "G8", 37.0, "(37.0 shares)"),
    ("sell short", {"action": "SELL", **SHORT}, "G7", 0.0, "not long"),
    ("zero price", {"current_price": 0.0}, "G1", 0.0, "Invalid reference price ($0.00)"),
    ("no value", {"nav": 0.0}, "G2", 0.0, "zero or negative"),
    ("no allocation", {"allocation_percentage": 0.0}, "G10", 0.0, "0%"),
    ("too small", {"nav": 1000.0, "cash": 1000.0, "current_price": 500.0}, "G13", 0.0, "Insufficient allocated capital"),
]


def test_guards(spark):
    rows = [tuple({"name": n, **BASE, **c}[k.split(" ")[0]] for k in SCHEMA.split(", ")) for n, c, *_ in CASES]
    got = {r["name"]: r for r in validate(spark.createDataFrame(rows, SCHEMA), Settings()).collect()}
    for name, _, guard, qty, text in CASES:
        r = got[name]
        assert (r["guard"], r["approved_qty"], r["approved"]) == (guard, qty, guard in ("G8", "G15")), name
        assert text in r["reason"], (name, r["reason"])


@pytest.mark.parametrize("suggested, stop", [("92", 92.0), ("105", 90.0), ("40", 90.0), (None, 90.0), ("80", 80.0), ("98", 98.0), ("x", 90.0)])
def test_stop_band(spark, suggested, stop):
    df = spark.createDataFrame([(100.0, suggested)], "r double, s string")
    assert df.select(stop_price(F.col("r"), F.col("s"), 0.10).alias("x")).first()["x"] == stop
