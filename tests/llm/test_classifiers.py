import random

import pytest
from pyspark.sql import functions as F

from tapeline.llm import langid, quality, rules, urls

WORDS = {"en": "the of and to in that is was for on with as his they be at".split(), "de": "der die und in den von zu das mit sich des auf für ist im nicht".split(), "fr": "le la les de et à en un une du des que est pour qui dans".split()}
SCHEMA = "doc_id long, text string, lang string, source string"


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "er", "ung"][: 3 + 2 * (lang == "de")]) for _ in range(n))


def documents(n=400, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((i, prose(rng, lang, rng.randint(20, 200)), lang, f"host{i % 7}.{lang}"))
    return rows


def test_language_id_held_out(spark):
    train = documents()
    odd = [(1000, None, "en", "host0.en"), (1001, "", None, None), (1002, prose(random.Random(1), "de", 80), "fr", "host1.de"), (1003, prose(random.Random(2), "fr", 80), None, None), (1004, "漢字仮名交じり文の文章です。" * 30, None, "host0.en"), (1005, "ab", "en", "host0.en"), (1006, "%%% ### $$$ 12 *** " * 30, "en", "host0.en")]
    held = [(2000 + i, t, None, s) for i, t, _, s in documents(150, 9)]
    truth = {2000 + i: lang for i, _, lang, _ in documents(150, 9)}
    df = spark.createDataFrame(train + odd + held, SCHEMA).repartition(4).withColumn("kept", F.lit("clash"))
    got = {r["doc_id"]: r for r in langid.identify_documents(df).collect()}
    assert sum(got[i]["language"] == lang for i, lang in truth.items()) >= 0.98 * len(truth)
    assert got[1002]["language"] == "de" and got[1003]["language"] == "fr" and got[1004]["language"] == "und"
    assert [got[i]["kept"] for i in (1000, 1001, 1002, 1003, 1004, 1006)] == [False, False, True, True, False, False]
    assert langid.keep_identified(df).count() == len(train) + len(odd) + len(held) - sum(not r["kept"] for r in got.values())
    assert langid.identify_documents(df.limit(0)).count() == 0
    assert [r["language"] for r in langid.identify_documents(spark.createDataFrame([(1, "x y z", None, None)], SCHEMA)).collect()] == ["und"]


def test_pages_use_markup_and_address(spark):
    rng, rows = random.Random(3), []
    for i in range(200):
        lang = ("en", "de")[i % 2]
        rows.append((i, f"https://site{i % 5}.example.{'com' if lang == 'en' else 'de'}/a", f'<!DOCTYPE html><html lang="{lang}"><head><script>var x = "der die das";</script></head><body><p>{prose(rng, lang, 60)}</p></body></html>'))
    rows += [(900, "https://site1.example.de/x", '<html lang="de"><p>in</p></html>'), (901, None, None)]
    got = {r["doc_id"]: r for r in langid.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i]["language"] == ("en", "de")[i % 2] for i in range(200))
    assert got[900]["language"] == "de" and got[900]["kept"] and not got[901]["kept"]


def test_every_declared_language_is_modelled(spark):
    """70 languages, each with letters of its own; codes are compared by their primary subtag."""
    rows = []
    for k in range(70):
        letters = [chr(0x4E00 + 40 * k + j) for j in range(40)]
        for j in range(3 if k else 2):
            rng = random.Random(1000 * k + j)
            code = "l" + chr(97 + k // 26) + chr(97 + k % 26)
            rows.append((10 * k + j, "".join(rng.choice(letters) for _ in range(300)), [code, code.upper(), f" {code}-XY"][j], "host"))
    got = {r["doc_id"]: r for r in langid.identify_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i]["language"] == declared.strip().lower()[:3] and got[i]["kept"] and got[i]["declared"] == declared for i, _, declared, _ in rows)


def test_pages_query_covers_the_table(spark, sf):
    from tapeline.llm import queries

    out = queries.queries()["op4_language_id_pages"](spark, sf).collect()
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert sorted(r["page_id"] for r in out) == sorted(r["page_id"] for r in pages.collect()) and all(r["declared"] for r in out)


def quality_rows(n=600, seed=5):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        good = i % 4 != 0
        text = prose(rng, "en", rng.randint(60, 150))
        if not good:
            text = " ".join(w.upper() + rng.choice(["%%%", "###", "$$$"]) for w in text.split())
        rows.append((i, text, "en", ("bad.example/spam" if not good and i % 8 == 0 else "good.example/blog") if i % 3 else "lone" + str(i)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality_classifier_held_out(spark):
    rows, labels = quality_rows()
    df = spark.createDataFrame(rows + [(-1, None, None, None), (-2, "", "en", "x"), (5, rows[5][1], "en", "dup")], SCHEMA)
    out = quality.classify(df, spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id long, quality int, toxic int").union(spark.createDataFrame([(0, 0, 0), (4, 0, 0), (8, 0, 0), (12, 0, 0), (16, 0, 0)], "doc_id long, quality int, toxic int"))).collect()
    held = {r["doc_id"]: r for r in out if r["doc_id"] is not None and r["doc_id"] >= 20 and r["doc_id"] % 2 == 0}
    truth = {i: bool(q) for i, q, _ in labels}
    assert sum(r["kept"] == truth[i] for i, r in held.items()) >= 0.95 * len(held)
    assert {r["kept"] for r in out if r["doc_id"] in (-1, -2)} == {False} and len(out) == len(rows) + 3
    site = {r["path"]: r["path_posterior"] for r in out}
    assert site["spam"] < site["blog"]
    # calibrated out of fold: probabilities of held-out texts are about as right as they say
    sure = [max(r["doc_probability"], 1 - r["doc_probability"]) for r in held.values()]
    assert sum((r["doc_probability"] >= 0.5) == truth[i] for i, r in held.items()) / len(held) >= sum(sure) / len(sure) - 0.1
    pages = df.withColumnRenamed("doc_id", "page_id")
    other = quality.classify(pages.where("page_id >= 0"), spark.createDataFrame(labels, "page_id long, quality int, toxic int"), "page_id", train=pages).collect()
    assert {bool(r["kept"]) for r in other if r["path"] == "spam"} == {False} and len({r["path_posterior"] for r in other if r["path"] == "blog"}) == 1
    none = quality.classify(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.where("kept").count() == len(rows) + 1
    assert quality.classify(df.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def base_counts(t):
    import re
    from collections import Counter

    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    cover = {j for i, x in enumerate(tri) if n[x] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)


def ngram_buckets(t):
    """Buckets of a text's n-grams, by another implementation of the hash."""
    import regex
    import xxhash

    mask = (1 << rules.BITS) - 1
    one = [xxhash.xxh64_intdigest(x.encode(), seed=42) & mask for x in regex.findall(r"[\p{L}\p{N}]++|[^\p{L}\p{N}\x20\x09-\x0D]++", t or "")]
    return one + [xxhash_int(b, xxhash_int(a, 42)) & mask for a, b in zip(one, one[1:])]


def xxhash_int(n, seed):
    """XXH64 of four bytes, little-endian."""
    import xxhash

    return xxhash.xxh64_intdigest(n.to_bytes(4, "little"), seed=seed)


def test_quality_rules_by_brute_force(spark):
    """Scores, threshold and verdicts from counts by hand."""
    import math
    from collections import Counter
    from statistics import pstdev

    rows, labels = quality_rows()
    odd = [(20_000, None), (20_001, ""), (20_002, " \n"), (20_003, "one"), (20_004, "caf\u00e9 42 ... \U0001f600 x"), (20_005, "tail of words " * 3000)]
    df = spark.createDataFrame(rows + [(i, t, None, None) for i, t in odd], SCHEMA)
    got = {r["doc_id"]: r for r in rules.judge(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    of = {i: ngram_buckets(t) for i, t, *_ in rows + odd}
    good = {i for i, q, _ in labels if q == 1}
    target, raw = Counter(b for i in good for b in of[i]), Counter(b for x in of.values() for b in x)
    size = 1 << rules.BITS
    nt, nr = sum(target.values()) + size * rules.SMOOTH, sum(raw.values()) + size * rules.SMOOTH
    ratio = lambda b: math.log((target[b] + rules.SMOOTH) / nt) - math.log((raw[b] + rules.SMOOTH) / nr)
    score = {i: sum(map(ratio, x)) / len(x) if x else 0.0 for i, x in of.items()}
    g, b = [score[i] for i in good], [score[i] for i, q, _ in labels if q == 0]
    mean, dev = lambda v: sum(v) / len(v), lambda v: pstdev(v) + 1e-9
    limit = min(mean(g) - rules.SPARE * pstdev(g) - 1e-9, (mean(g) * dev(b) + mean(b) * dev(g)) / (dev(g) + dev(b)))
    for i, r in got.items():
        assert abs(r["score"] - score[i]) < 1e-6 and abs(r["threshold"] - limit) < 1e-6, i
        assert r["kept"] == (not r["base_failed"] and score[i] >= limit) or abs(score[i] - limit) < 1e-6, i
    assert len(got) == len(rows) + len(odd)


def test_quality_rules_learn_from_every_label(spark):
    """30,000 labelled documents, none left out; of several labels of an id the least counts, repeated documents count each."""
    import math
    from collections import Counter
    from statistics import pstdev

    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(WORDS["de" if i % 5 == 0 else "en"]) for _ in range(rng.randint(1, 4)))) for i in range(30_000)]
    label = {i: int(i % 5 != 0) for i, _ in rows}
    rows += [(7, "second text of 7"), (10, "second text of 10"), (None, "no id"), (30_001, "no label"), (30_002, "label null"), (30_003, "both labels"), (30_004, None)]
    given = [*label.items(), (30_002, None), (30_003, 1), (30_003, 0), (30_003, None), (30_004, 1), (7, 1), (None, 0), (40_000, 1)]
    label |= {30_003: 0, 30_004: 1}
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(given, "doc_id long, quality int")
    got = rules.judge(docs, labels).collect()
    of = [(i, ngram_buckets(t)) for i, t in rows]
    target, raw = Counter(b for i, x in of if label.get(i) == 1 for b in x), Counter(b for _, x in of for b in x)
    nt, nr = sum(target.values()) + (1 << rules.BITS) * rules.SMOOTH, sum(raw.values()) + (1 << rules.BITS) * rules.SMOOTH
    ratio = lambda b: math.log((target[b] + rules.SMOOTH) / nt) - math.log((raw[b] + rules.SMOOTH) / nr)
    score = [(i, sum(map(ratio, x)) / len(x) if x else 0.0) for i, x in of]
    g, b = ([s for i, s in score if label.get(i) == v] for v in (1, 0))
    mean, dev = lambda v: sum(v) / len(v), lambda v: pstdev(v) + 1e-9
    limit = min(mean(g) - rules.SPARE * pstdev(g) - 1e-9, (mean(g) * dev(b) + mean(b) * dev(g)) / (dev(g) + dev(b)))
    assert len({r["threshold"] for r in got}) == 1 and abs(got[0]["threshold"] - limit) < 1e-6
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert len(got) == len(rows)
    for (i, s), (j, t) in zip(sorted(score, key=order), sorted(((r["doc_id"], r["score"]) for r in got), key=order)):
        assert i == j and abs(s - t) < 1e-6, i


def test_quality_rules(spark):
    rows, labels = quality_rows()
    odd = [None, "", " \n\t", "one", "a b c " * 40, "x\ny\nx\n \n\nx", "é|<> " * 60, "a\x0bb\x0cc\u00a0d", "t " * 2, "word " * 5000 + "end"]
    df = spark.createDataFrame(rows + [(10_000 + i, t, None, None) for i, t in enumerate(odd)], SCHEMA).withColumn("words", F.lit(1))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in rules.judge(df, lab).collect()}
    for i, t, *_ in rows + [(10_000 + i, t) for i, t in enumerate(odd)]:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base_counts(t), i
        assert r["kept"] <= (not r["base_failed"])
    assert all(got[i]["kept"] == bool(q) or got[i]["base_failed"] for i, q, _ in labels)
    alone = rules.judge(df, lab.limit(0)).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in alone)
    assert rules.judge(df.limit(0), lab).count() == 0


def url_rows():
    rng, rows = random.Random(8), []
    for i in range(300):
        host = rng.choice(["news.example.net", "blog.paper.example.org", "M.Shop.example.com"]) if i % 5 else rng.choice(["casino-win.example.net", "www.cheap-pills.example.org"])
        rows.append((i, f"https://{host}/{rng.choice(['fr', 'it', 'nl'])}/{rng.randint(1, 999)}?q=/de/1"))
    return rows


URL_CASES = {
    1000: ("http://A.example.com/en/12#x", "a.example.com", "/en/12", "com/en/", "block"), 1001: ("http://example.com/en/7", "example.com", "/en/7", "example.com/en/7", "allow"), 1002: ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
    1003: ("ftp://x.example.net/de/81?y", "x.example.net", "/de/81", "example.net/de/8", "block"), 1004: ("https://other.net/de/8", "other.net", "/de/8", "net/de/", "allow"), 1005: ("https://com?/en/", "com", "", None, None), 1006: (None, "", "", None, "allow"),
    1007: ("no address", "", "", None, "allow"), 1008: ("", "", "", None, "allow"), 1009: ("x://h/p://q", "h", "/p://q", None, None), 1010: ("https://best-casino.example.net/it/5", "best-casino.example.net", "/it/5", None, "block"), 1011: ("https://É.ORG/es/É", "É.org", "/es/É", "org/es/", "block"),
}


def test_url_filter(spark):
    """Rules by cases; labelled URLs teach the models, which then block the other URLs like them, and no others."""
    cases = URL_CASES
    df = spark.createDataFrame(url_rows() + [(i, c[0]) for i, c in cases.items()] + [url_rows()[0]], "page_id long, url string").withColumn("host", F.lit("clash"))
    bad = lambda u: "casino" in u or "pills" in u
    labelled = spark.createDataFrame([(u, "block" if bad(u) else "allow") for i, u in url_rows() if i % 2] + [(f"https://casino{k}-win.example.net/it/{k}", "block") for k in range(12)] + [(None, "block"), ("x", "block"), ("https://a.b/", None)], "url string, verdict string")
    out = urls.judge(df, labelled=labelled).collect()
    got = {r["page_id"]: r for r in out}
    assert len(out) == 300 + len(cases) + 1
    for i, (_, host, path, rule, verdict) in cases.items():
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule) and (verdict is None or got[i]["verdict"] == verdict), (i, got[i])
    assert all(got[i]["verdict"] == ("block" if bad(u) else "allow") for i, u in url_rows() if got[i]["rule"] is None)
    assert out[0]["held_out_false"] <= urls.SPARE and out[0]["held_out_caught"] > 0
    assert urls.judge(df.limit(0)).count() == 0
    assert {r["verdict"] for r in urls.judge(df.where("page_id < 300"), rules=()).collect()} == {"allow"}


def markov(rows, order=urls.ORDER):
    """rows (chars, weight, rejected) -> a function that gives a text's mean log-ratio."""
    import math
    from collections import defaultdict

    grams, follow = [defaultdict(int), defaultdict(int)], [defaultdict(dict), defaultdict(dict)]
    for chars, n, side in rows:
        for i in range(len(chars) - order):
            w = chars[i : i + order + 1]
            for k in range(order + 1):
                g = w[order - k :]
                grams[side][g] += n
                follow[side][g[:-1], k][g[-1]] = 1
    total = [defaultdict(int), defaultdict(int)]
    for side in (0, 1):
        for g, n in grams[side].items():
            total[side][g[:-1], len(g) - 1] += n

    def p(w, side):
        out = 1 / len(urls.ALPHABET)
        for k in range(order + 1):
            g = w[order - k :]
            n, t = total[side][g[:-1], k], len(follow[side][g[:-1], k])
            out = (grams[side][g] + t * out) / (n + t) if n else out
        return out

    def score(chars):
        ws = [chars[i : i + order + 1] for i in range(len(chars) - order)]
        return sum(math.log(p(w, 1)) - math.log(p(w, 0)) for w in ws) / len(ws)

    return score


def test_urls_equal_brute_force(spark):
    """Scores, threshold and verdicts that the rules teach, by hand."""
    import hashlib
    import math
    import re
    from urllib.parse import quote

    rng = random.Random(4)
    hosts = [f"{rng.choice(['a', 'bb', 'm.c'])}{k}.{rng.choice(['example.com', 'example.net', 'other.org'])}" for k in range(14)]
    rows = [(i, f"https://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randint(1, 99)}{rng.choice(['', '?q=Ö', '#x', '?page=2&ref=x'])}") for i in range(400)]
    rows += [(1000 + i, c[0]) for i, c in enumerate(URL_CASES.values())]
    out = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}

    def chars(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        text = "".join(c if c.isascii() else quote(c) for c in rest).lower()
        return "^" * urls.ORDER + re.sub(r"[^a-z0-9./_%?=&#-]", "~", text) + "$" if rest else None

    seen = {}
    for i, u in rows:
        if c := chars(u):
            seen.setdefault(c, [out[i]["host"], 0, 0])
            seen[c][1] += 1
            seen[c][2] |= int(out[i]["rule"] is not None and out[i]["verdict"] == "block")
    half = {c: ord(hashlib.md5(v[0].encode()).hexdigest()[0]) % 2 for c, v in seen.items()}
    model = [markov([(c, v[1], v[2]) for c, v in seen.items() if half[c] != k]) for k in (0, 1)]
    held = [(model[half[c]](c), v[1], v[2]) for c, v in seen.items()]
    every = sum(n for _, n, r in held if not r)
    at = next(k for k in range(2000) if sum(n for s, n, r in held if not r and math.ceil(s / urls.STEP) > k) / every <= urls.SPARE)
    assert out[0]["threshold"] == pytest.approx(at * urls.STEP)
    for i, u in rows:
        c = chars(u)
        s = model[half[c]](c) if c else 0.0
        assert out[i]["score"] == pytest.approx(s, abs=2e-6)
        if out[i]["rule"] is None:
            assert out[i]["verdict"] == ("block" if c and s > at * urls.STEP else "allow")


def test_window_scores_by_hand(spark):
    import math

    counts = {"^^^a": (3, 1), "^^ab": (2, 0), "^^ac": (1, 1), "xyza": (1, 0)}
    got = {r["window"]: r["ratio"] for r in urls.window_scores(spark.createDataFrame([(w, *c) for w, c in counts.items()], "window string, accepted long, rejected long")).collect()}

    def p(window, side):
        out = 1 / len(urls.ALPHABET)
        for k in range(urls.ORDER + 1):
            gram = window[urls.ORDER - k :]
            same = {}
            for w, c in counts.items():
                g = w[urls.ORDER - k :]
                if g[:-1] == gram[:-1]:
                    same[g] = same.get(g, 0) + c[side]
            n, t = sum(same.values()), sum(v > 0 for v in same.values())
            out = (same.get(gram, 0) + t * out) / (n + t) if n else out
        return out

    for w, r in got.items():
        assert r == pytest.approx(math.log(p(w, 1)) - math.log(p(w, 0)))
