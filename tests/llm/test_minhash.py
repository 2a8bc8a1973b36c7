import random
import re
from collections import Counter

import pytest

from tapeline.llm import components, minhash


def brute(rows, k, num, den):
    """doc_id -> (set size, component) by all pairs."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    comp = {d: d for d in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and den * n >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


def corpus():
    """A hot family of near copies with isolates, chains of edits, copies, short and empty texts."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, rows = [word() for _ in range(120)], []
    for i in range(120):
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            t[rng.randrange(120)] = word()
        rows.append((1000 + i, " ".join(t)))
    chain = [word() for _ in range(150)]
    for i in range(12):
        chain = list(chain)
        chain[i * 12 : i * 12 + 5] = [word() for _ in range(5)]
        rows.append((2000 + i, " ".join(chain)))
    rows += [(3000 + i, "Copy of\tone TEXT\nhere " * (1 + i % 2)) for i in range(10)] + [(4000, "one"), (4001, "ONE"), (4002, "one two"), (4003, None), (4004, ""), (4005, " \n"), (4006, "é É"), (4007, "é É")]
    rows += [(5000 + i, " ".join(word() for _ in range(rng.randint(1, 60)))) for i in range(60)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k, num, den", [(3, 85, 100), (5, 80, 100)])
def test_equals_brute_force(spark, k, num, den):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, node string").repartition(4)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df, k, (num, den)).collect()}
    want = brute(rows, k, num, den)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items())


def test_edges(spark):
    df = spark.createDataFrame([(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect())
    assert got == {(7, 7, True): 2, (None, 7, False): 1, (None, None, True): 1}
    assert minhash.keep_one_each(df).count() == 2
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_bands_miss_little():
    for t in (0.8, 0.85, 0.9):
        b, r = minhash.bands_for(t)
        assert (1 - t**r) ** b <= minhash.MISS and b * r <= minhash.MOST_HASHES


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(45)] + [(1, 1), (2, 1)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r["u"]: r["v"] for r in components.stars(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}
    assert components.stars(spark.createDataFrame([], "u long, v long")).count() == 0
