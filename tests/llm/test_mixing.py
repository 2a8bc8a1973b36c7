import random
from collections import defaultdict

from pyspark.sql import functions as F

from tapeline.llm import mixing


def fill(sizes, weights, share=1.5, most=2):
    """Targets by repeated resharing."""
    left, capped, names = share * sum(sizes.values()), {}, sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    while True:
        rest = [s for s in names if s not in capped]
        total = sum(weight[s] for s in rest)
        target = {s: left * weight[s] / total for s in rest}
        over = [s for s in rest if target[s] > most * sizes[s]]
        if not over:
            return capped | target
        for s in over:
            capped[s] = most * sizes[s]
            left -= capped[s]


def corpus(n=3000, seed=4):
    rng = random.Random(seed)
    for i in range(n):
        s = "hot" if i % 3 == 0 else rng.choice(["a", "b", "é", None, "z", "Z"])
        yield i, rng.choice([None, "", " ".join("w" for _ in range(rng.randint(1, 300)))]) if i % 50 == 0 else "word " * rng.randint(1, 120), s


def test_mix(spark):
    df = spark.createDataFrame(list(corpus()), "doc_id long, text string, source string").repartition(5).withColumn("size", F.lit("clash"))
    rows = mixing.taken_words(mixing.mix(df)).collect()
    assert len(rows) == 3000
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = fill(sizes, (5, 2, 1))
    assert all(abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= max(0.02 * want[s], 300) for s in want)
    again = mixing.taken_words(mixing.mix(df.repartition(3))).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    copies = mixing.mixed_documents(df.drop("size"))
    assert copies.columns == ["doc_id", "text", "source"]
    words = copies.select(mixing.word_count(F.col("text")).alias("n")).agg(F.sum("n")).first()[0]
    assert abs(words - sum(want.values())) < 0.03 * words and copies.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_edges(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.taken_words(mixing.mix(spark.createDataFrame([], schema))).count() == 0
    none = mixing.taken_words(mixing.mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], schema))).collect()
    assert [(r["size"], r["taken"]) for r in none] == [(0, 0), (0, 0)]
    same = mixing.taken_words(mixing.mix(spark.createDataFrame([(1, "a b c", "s")] * 4 + [(None, "x y", None)], schema))).collect()
    assert len(same) == 5 and all(r["taken"] <= 2 * r["size"] for r in same)


def test_points_are_even(spark):
    u = sorted(r["u"] for r in spark.range(4096).select(mixing.golden_point(F.col("id")).alias("u")).collect())
    assert max(b - a for a, b in zip(u, u[1:])) < 3 / 4096
