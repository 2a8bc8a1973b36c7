import hashlib
import random
import re

from pyspark.sql import functions as F

from tapeline.llm import pii

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(t):
    out = []
    for k, (name, p) in enumerate(PATTERNS):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": name == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[name]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


TEXTS = [
    None, "", "plain words", "mail a.b@c.de, x@y.zz_w@q.rs and @none a@b", "🙂 é x@y.org 1.2.3.4", "1.2.3.4.5.6.7.8.9 and 256.1.1.1 and 001.02.0003.255", "card 4532 0151 1283 0366 and 4532-0151-1283-0367", "4532015112830366 4532015112830366", "4111111111111111x4111111111111111",
    "+1 (305) 555-7981 +12 +1234567890123456789 + 5", "+1-234-567-8901a@b.cc", "12 34  56", "9" * 5000, "1 " * 9000, "a" * 20_000 + "@b.co", "a." * 5000, "1." * 6000 + "1", "x@" + "y." * 4000 + "z", "+" * 3000, "+1" + "." * 3000, "a@b.c-d@e.f g@h.i", "4 5 3 2 0 1 5 1 1 2 8 3 0 3 6 6",
]


def test_base_equals_re(spark):
    rng = random.Random(7)
    texts = TEXTS + ["".join(rng.choice("0123456789 .-@+()aé_") for _ in range(rng.randint(0, 120))) for _ in range(500)] + ["".join(rng.choice(["1", "23", ".", " ", "-", "4532015112830366", "a@b.co", "+1 305 555 1234", "10.0.0.1"]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1)], "doc_id long, text string, spans int")
    rows = pii.digests(pii.find(df)).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        want = base(texts[r["doc_id"]])
        text = ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), texts[r["doc_id"]]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(x[1] == k for x in want) for k in range(4))
    assert pii.find(df.limit(0)).count() == 0


def test_disclosing_terms(spark):
    """A rare name that goes with one address is generalised or removed there; common words and other texts stay."""
    fill = "common words about the weather and other matters of the day"
    rows = [(i, f"{fill} please ask Wintermute about it at boss@corp.example today {fill}") for i in range(6)]
    rows += [(100 + i, f"{fill} number {i}") for i in range(200)] + [(900, f"Wintermute {fill}"), (901, "write to other@corp.example please"), (902, None)]
    df = spark.createDataFrame([(i, t, "s", -1) for i, t in rows], "doc_id long, text string, source string, n_chars long")
    got = {r["doc_id"]: r for r in pii.find(df).collect()}
    terms = {s["value"] for s in got[0]["spans"] if s["kind"] >= 4}
    assert "wintermute" in terms and not terms & {"common", "weather", "about"}
    for s in got[0]["spans"]:
        assert rows[0][1][s["start"] : s["stop"]].lower() == s["value"].lower()
    assert got[900]["spans"] == [] and [s["kind"] for s in got[901]["spans"]] == [0]
    clean = {r["doc_id"]: r for r in pii.sanitise(df).collect()}
    assert len(clean) == len(rows) and "Wintermute" not in clean[0]["text"] and "[EMAIL]" in clean[0]["text"] and "boss@" not in clean[0]["text"] and clean[0]["n_chars"] == len(clean[0]["text"])
    assert clean[100]["text"] == rows[6][1] and clean[100]["n_chars"] == -1 and clean[902]["text"] is None and clean[901]["text"] == "write to [EMAIL] please"


def test_overlaps_merge(spark):
    df = spark.createDataFrame([(1, "x +4532015112830366 y")], "doc_id long, text string")
    r = pii.sanitise(df).first()["text"]
    assert "4532" not in r and r.startswith("x ") and r.endswith(" y")
    assert pii.sanitise(df.select("doc_id", F.lit(None).cast("string").alias("text"))).first()["text"] is None


def test_sparse_entities_have_terms(spark):
    """A value held by one or two documents is told by a term that goes with it; the prior keeps commoner terms."""
    fill = "common words about the weather and other matters of the day"
    rows = [(i, f"{fill} {i}") for i in range(2000)]
    rows += [(5000, "ask Wintermute at one@corp.example today"), (5001, "Neuromancer 10.1.2.3 today"), (5002, "Neuromancer 10.1.2.3 today")] + [(6000 + i, "today") for i in range(40)]
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id >= 5000").collect()}
    told = {i: [s["value"] for s in spans if s["kind"] >= 4] for i, spans in got.items()}
    assert told[5000] == ["wintermute"] and told[5001] == told[5002] == ["neuromancer"] and not any(told[6000 + i] for i in range(40))


def test_terms_at_a_distance(spark):
    """Terms count, and are masked, anywhere in a document with the entity, behind other spans too."""
    fill = "common words about the weather and other matters of the day " * 10
    rows = [(i, f"{fill} {i}") for i in range(2000)]
    rows += [(5000 + i, f"Wintermute {fill} a@b.example {fill} x{i}@corp.example {fill} wintermute's boss@corp.example WINTERMUTE") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find(df).where("doc_id >= 5000").collect()}
    for i in range(6):
        text = rows[2000 + i][1]
        assert [text[s["start"] : s["stop"]] for s in got[5000 + i] if s["kind"] >= 4] == ["Wintermute", "wintermute", "WINTERMUTE"]
    clean = pii.sanitise(df).where("doc_id = 5000").first()["text"]
    assert "wintermute" not in clean.lower() and clean.count("weather") == 30


def test_many_hits_in_one_text(spark):
    """40,000 addresses in a text: spans and the sanitised text are right and there within seconds."""
    import time

    text = " ".join(f"a{i}@corp{i % 7}.example" for i in range(40_000))
    df = spark.createDataFrame([(1, text), (2, "x@y.zz " * 3 + "é🙂 " * 700 + "q@r.st")], "doc_id long, text string")
    df.select(F.size(pii.base_spans(F.lit("a@b.cc")))).collect()
    began = time.time()
    r = {x["doc_id"]: x["spans"] for x in df.select("doc_id", pii.base_spans(F.col("text")).alias("spans")).collect()}
    clean = {x["doc_id"]: x["t"] for x in df.select("doc_id", pii.sanitised(F.col("text"), pii.base_spans(F.col("text"))).alias("t")).collect()}
    assert time.time() - began < 60
    assert [(s["start"], s["stop"]) for s in r[1]] == [m.span() for m in re.finditer(r"\S+", text)] and clean[1] == " ".join(["[EMAIL]"] * 40_000)
    assert clean[2] == "[EMAIL] " * 3 + "é🙂 " * 700 + "[EMAIL]"


def test_terms_equal_brute_force(spark):
    """Which terms of which documents are masked, against shares of information counted by hand."""
    import math
    from collections import Counter

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.choice([4, 5])))
    common, rare = [word() for _ in range(60)], [word() + "zz" for _ in range(80)]
    entities = ["a@b.example", "10.0.0.7", "c.d@e.example", "10.1.2.3", "+1 305 555 1234"]
    rows = [(i, " ".join([rng.choice(common) for _ in range(12)] + [rng.choice(rare) for _ in range(rng.randint(0, 2))] + ([rng.choice(entities)] if i % 9 == 0 else []))) for i in range(3000)]
    rows += [(5000 + i, f"about Wintermute {entities[0]} and {rng.choice(common)}") for i in range(4)]
    holds, words, n = {}, {}, len(rows)
    for d, t in rows:
        spans = base(t)
        holds[d] = {t[a:b] for a, _, b in spans}
        clear = list(t)
        for a, _, b in spans:
            clear[a:b] = " " * (b - a)
        words[d] = {w.lower() for w in re.findall(r"[^\W\d_]{4,}", "".join(clear))}
    n_e, n_t = Counter(e for h in holds.values() for e in h), Counter(w for ws in words.values() for w in ws)
    n_te = Counter((e, w) for d in holds for e in holds[d] for w in words[d])

    def share(e, w):
        p = min(1.0, (n_te[e, w] + pii.PRIOR * n_e[e] / n) / (n_t[w] + pii.PRIOR))
        return 1 + math.log(p) / -math.log(n_e[e] / n)

    want = {d: {(w, max(share(e, w) for e in holds[d]) >= pii.REMOVE) for w in words[d] if any(share(e, w) >= pii.GENERALISE for e in holds[d])} for d in holds}
    got = {r["doc_id"]: {(s["value"], s["kind"] == 5) for s in r["spans"] if s["kind"] >= 4} for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and sum(map(len, want.values())) > 4
