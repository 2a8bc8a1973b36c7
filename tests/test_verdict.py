import pytest
from pyspark.sql import functions as F

from tapeline.operators.verdict import PARSE_FAILED, extract_json, fallback, normalised
from tapeline.sources.settings import Settings


@pytest.mark.parametrize("raw, found", [
    ('x\n```json\n{"a": 1}\n```\n', '{"a": 1}'), ('I say {"a": {"b": 2}} now', '{"a": {"b": 2}}'), ("nothing", None), (None, None), ("", None), ("} {", None),
    ('```\ncode\n``` then {"a": 3}', '{"a": 3}'), ('```JSON {"a": 4}```', '{"a": 4}'), ('{"a":\n 5}', '{"a":\n 5}'),
])
def test_extract(spark, raw, found):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(extract_json(F.col("raw")).alias("j")).first()["j"] == found


def test_extract_behind_many_fences(spark):
    df = spark.createDataFrame([("{x} " + "```code" * 1500 + '``` {"a": 6}``` {y}',)], "raw string")
    assert df.select(extract_json(F.col("raw")).alias("j")).first()["j"] == '{"a": 6}'


#: object, action, conviction, allocation, target, stop, risks, usable
CASES = [
    ('{"action": "buy", "conviction_score": 0.5, "allocation_percentage": 0.08}', "HOLD", 0.5, 0.0, 100.0, 90.0, [], True),
    ('{"action": "TRIM", "conviction_score": 0.9, "allocation_percentage": 0.05}', "HOLD", 0.9, 0.05, 100.0, 90.0, [], True),
    ('{"action": "BUY", "conviction_score": 7.5, "allocation_percentage": 2.5}', "BUY", 1.0, 1.0, 100.0, 90.0, [], True),
    ('{"action": "BUY", "conviction_score": 0.8, "allocation_percentage": 0.05}', "BUY", 0.8, 0.05, 100.0, 90.0, [], True),
    ('{"action": "SELL", "conviction_score": 0.1, "allocation_percentage": 0}', "SELL", 0.1, 0.0, 100.0, 90.0, [], True),
    ('{"action": "BUY", "conviction_score": " 0.9 ", "allocation_percentage": true, "key_risks": "one", "target_price": 120, "stop_loss_price": 91.5, "extra": {}}', "BUY", 0.9, 1.0, 120.0, 91.5, ["one"], True),
    ('{"conviction_score": 0.9, "allocation_percentage": 0.1, "key_risks": ["a", "b"]}', "HOLD", 0.9, 0.1, 100.0, 90.0, ["a", "b"], True),
]
BAD = [
    '{"action": "BUY", "conviction_score": null, "allocation_percentage": 0.1}', '{"action": "BUY", "allocation_percentage": 0.1}', '{"action": "BUY", "conviction_score": 0.9, "allocation_percentage": 0.1, "target_price": null}',
    '{"action": "BUY", "conviction_score": 0.9, "allocation_percentage": 0.1, "key_risks": ["a", 1]}', '{"action": "BUY", "conviction_score": 0.9, "allocation_percentage": 0.1, "key_risks": null}',
    '{"action": "BUY", "conviction_score": [1], "allocation_percentage": 0.1}', '{"action": "BUY", "conviction_score": 0.9, "allocation_percentage": 0.1, "thesis_summary": 3}', "{broken", "no object", None, "",
]


def test_normalise(spark):
    rows = [(i, c[0], 100.0) for i, c in enumerate(CASES)] + [(100 + i, b, 100.0) for i, b in enumerate(BAD)]
    got = {r["id"]: r for r in normalised(spark.createDataFrame(rows, "id int, raw string, current_price double"), Settings()).collect()}
    for i, (_, action, conviction, allocation, target, stop, risks, _) in enumerate(CASES):
        r = got[i]
        assert (r["action"], r["conviction_score"], r["allocation_percentage"], r["target_price"], r["stop_loss_price"], r["key_risks"], r["fallback"]) == (action, conviction, allocation, target, stop, risks, None), i
    assert got[0]["thesis_summary"] == "[Auto-downgraded to HOLD: conviction 0.50 < 0.65] "
    for i in range(len(BAD)):
        r = got[100 + i]
        assert (r["action"], r["conviction_score"], r["stop_loss_price"], r["key_risks"], r["fallback"]) == ("HOLD", 0.0, 90.0, [PARSE_FAILED], PARSE_FAILED), BAD[i]


def test_fallback(spark):
    r = fallback(spark.createDataFrame([(99.99,)], "current_price double"), F.lit("down")).first()
    assert (r["action"], r["target_price"], r["stop_loss_price"], r["thesis_summary"], r["key_risks"]) == ("HOLD", 99.99, 89.99, "Defaulted to HOLD: down", ["down"])
