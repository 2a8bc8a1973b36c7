"""URL filters: host and path rules, and a character language-model ratio. DataFrame functions only.

Two variable-order Markov models, of accepted and of rejected URLs, give each character a probability after its last
ORDER characters. Orders are interpolated by Witten-Bell smoothing down to a uniform alphabet, so a context counts as
much as it was seen. A URL's score is the mean over its characters of the log-ratio rejected : accepted. One above the
threshold is blocked.

Training classes are what is given: the verdicts of a table of labelled URLs, or else those of the rules, where a URL that
no rule blocks counts as accepted. The threshold is calibrated on scores of hosts that the scoring model has not seen:
hosts fall into two halves by hash, each half is scored by the models of the other, and the threshold is the least, in steps of
STEP and not under 0, above which at most SPARE of the accepted URLs lie. The result names the shares of
accepted and rejected URLs above it (`held_out_false`, `held_out_caught`). Where the rules teach, these scores decide, too, as each URL without a rule has itself taught
what is accepted; where a table does, models of both halves decide.

The text of the model is all behind `://` in lower case, the query included; other than ASCII characters are percent-encoded, those still outside
a fixed ALPHABET fold to `~`: the windows of ORDER + 1 characters are a table of at most len(ALPHABET) ** (ORDER + 1) rows, whatever the
input. It is broadcast up to BROADCAST_ROWS rows and joined by shuffle beyond.

Cases: a null URL, or one without `://`, has an empty host and path, fits no rule and has no evidence (score 0,
allowed). A rule fits its host and all subdomains if the path starts with the rule's; the longest rule wins. Where one
class is empty, every URL without a rule is allowed and both shares are null.
Repeated rows are judged alike; other columns, whatever their names, are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import looked_up, written

#: Characters of the models, in order; `^` stands before a URL, `$` ends it, `~` is any other character.
ALPHABET = "^$~abcdefghijklmnopqrstuvwxyz0123456789-./_%?=&#"
ORDER = 3

#: Share of accepted URLs that may lie above the threshold, its steps, the largest score told apart, window ratios that are broadcast at most.
SPARE, STEP, TOP_SCORE, BROADCAST_ROWS = 0.005, 0.01, 20.0, 500_000

#: The rules of the query: host, path, verdict.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))

#: Counts of a window by class and model: model 0 judges the first half and knows the other, model 2 knows both.
SIDES = ("accepted_0", "rejected_0", "accepted_1", "rejected_1", "accepted_2", "rejected_2")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first `://`: the host up to / ? # with A-Z lower-cased, then the path up to ? or #."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, lower), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_match(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits. The rules are a handful of literals."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    name = verdict = F.lit(None).cast("string")
    for h, p, v in reversed(ordered):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def model_text(url: Column) -> Column:
    """Start marks, all behind `://` folded to the alphabet, an end mark; null without any."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.nullif(F.substr(url, at + 3), F.lit("")))
    encoded = F.array_join(F.transform(F.regexp_extract_all(rest, F.lit(r"(?s)."), F.lit(0)), lambda c: F.when(F.rlike(c, F.lit(r"^[\x00-\x7F]$")), c).otherwise(F.url_encode(c))), "")
    ascii_only = F.when(F.rlike(rest, F.lit(r"[^\x00-\x7F]")), encoded).otherwise(rest)
    inner = "".join(c for c in ALPHABET if c not in "^$~-")
    return F.concat(F.lit("^" * ORDER), F.regexp_replace(F.lower(ascii_only), f"[^{inner}-]", "~"), F.lit("$"))


def windows(urls: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each character of each URL: `window` is the character behind its context."""
    spots = F.sequence(F.lit(1), F.length("chars") - ORDER)
    return urls.select(*keys, F.explode(F.transform(spots, lambda i: F.substr(F.col("chars"), i, F.lit(ORDER + 1)))).alias("window"))


def probabilities(counted: DataFrame, sides: tuple[str, ...]) -> DataFrame:
    """counted (window, a count for each side) -> (window, p_ of each side): that of the last character after the others."""
    table = counted.withColumns({f"p_{s}": F.lit(1.0 / len(ALPHABET)) for s in sides})
    for order in range(ORDER + 1):
        gram = F.substr(F.col("window"), F.lit(ORDER + 1 - order))
        grams = counted.groupBy(gram.alias("gram")).agg(*[F.sum(s).alias(s) for s in sides])
        context = F.substr(F.col("gram"), F.lit(1), F.lit(order))
        totals = grams.groupBy(context.alias("context")).agg(*[F.sum(s).alias(f"n_{s}") for s in sides], *[F.count_if(F.col(s) > 0).alias(f"t_{s}") for s in sides])
        grams = grams.withColumn("context", context).join(totals, "context").drop("context")
        table = table.drop(*sides).withColumn("gram", gram).join(grams, "gram").drop("gram")
        smoothed = {f"p_{s}": F.when(F.col(f"n_{s}") > 0, (F.col(s) + F.col(f"t_{s}") * F.col(f"p_{s}")) / (F.col(f"n_{s}") + F.col(f"t_{s}"))).otherwise(F.col(f"p_{s}")) for s in sides}
        table = table.withColumns(smoothed).drop(*[f"{x}_{s}" for x in "nt" for s in sides])
    return table.select("window", *[f"p_{s}" for s in sides])


def window_scores(counted: DataFrame, of: tuple[str, ...] = ("",)) -> DataFrame:
    """counted (window, accepted, rejected, each with the endings in `of`) -> (window, ratio...): log p(rejected) - log p(accepted) of the last character."""
    p = probabilities(counted, tuple(f"{s}{x}" for x in of for s in ("accepted", "rejected")))
    return p.select("window", *[(F.log(f"p_rejected{x}") - F.log(f"p_accepted{x}")).alias(f"ratio{x}") for x in of])


def threshold(scored: DataFrame) -> tuple[float, float | None, float | None]:
    """Threshold, and shares of held-out accepted and rejected URLs above it. Scores come to the driver as at most 2 TOP_SCORE / STEP + 1 counts."""
    place = F.ceil(F.least(F.greatest("held_out", F.lit(-TOP_SCORE)), F.lit(TOP_SCORE)) / STEP).alias("step")
    tally = scored.where("training").groupBy(place).agg(F.sum(F.col("n") * (1 - F.col("rejected"))).alias("a"), F.sum(F.col("n") * F.col("rejected")).alias("r")).collect()
    every = {k: sum(x[k] for x in tally) for k in "ar"}
    if not every["a"] or not every["r"]:
        return float("inf"), None, None
    above = lambda k, at: sum(x[k] for x in tally if x["step"] > at) / every[k]
    at = next(c for c in sorted({0} | {max(0, x["step"]) for x in tally}) if above("a", c) <= SPARE)
    return at * STEP, above("a", at), above("r", at)


def judge(pages: DataFrame, ident: str = "page_id", url: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """One row per URL: page_id, host, path, rule, score, verdict, threshold, held_out_false, held_out_caught.

    labelled: (url, verdict) of URLs to learn from, of any number; where a URL has several verdicts, it is blocked.
    """

    def parsed(rows: DataFrame, link: Column, *more: Column) -> DataFrame:
        host, path = host_and_path(link.cast("string"))
        return rows.select(*more, F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), model_text(link.cast("string")).alias("chars"))

    name, verdict = rule_match(F.col("host"), F.col("path"), rules)
    rows = parsed(pages, F.col(url), F.col(ident).alias("page_id")).withColumns({"rule": name, "by_rule": verdict})
    # equal addresses are counted and scored once
    urls = rows.where("chars is not null").groupBy("chars").agg(F.min("host").alias("host"), F.max((F.coalesce(F.col("by_rule") == "block", F.lit(False))).cast("int")).alias("rejected"), F.count("*").alias("n"))
    if labelled is None:
        urls = urls.withColumn("training", F.lit(True))
    else:
        known = parsed(labelled, F.col("url"), F.col("verdict")).where("chars is not null and verdict is not null").groupBy("chars").agg(F.min("host").alias("h"), F.max((F.col("verdict") == "block").cast("int")).alias("r"), F.count("*").alias("k"))
        joined = urls.drop("rejected").join(known, "chars", "full")
        urls = joined.select("chars", F.coalesce("host", "h").alias("host"), F.coalesce("r", F.lit(0)).alias("rejected"), F.coalesce("k", "n").alias("n"), F.col("k").isNotNull().alias("training"))
    # halves of hosts by the first digit of a digest, which other engines have too
    half = (F.ascii(F.substr(F.md5("host"), F.lit(1), F.lit(1))) % 2).alias("half")
    urls = written(urls.select("chars", "rejected", "n", "training", half), "url-chars")
    weight = lambda side, k: F.when(F.col("rejected") == int(side == "rejected"), F.when(F.lit(k == 2) | (F.col("half") != k), F.col("n")))
    models = ("_0", "_1") if labelled is None else ("_0", "_1", "_2")
    counts = [F.coalesce(F.sum(weight(s[:-2], int(s[-1]))), F.lit(0)).alias(s) for s in SIDES if s[-2:] in models]
    # windows of URLs that don't train are there too, with counts of 0
    counted = windows(urls, ["rejected", F.when(F.col("training"), F.col("n")).otherwise(0).alias("n"), "half"]).groupBy("window").agg(*counts)
    ratios = written(window_scores(written(counted, "url-windows"), models), "url-ratios")
    if ratios.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        ratios = F.broadcast(ratios)
    scored = windows(urls, ["chars", "rejected", "n", "training", "half"]).join(ratios, "window")
    own = F.when(F.col("half") == 0, F.col("ratio_0")).otherwise(F.col("ratio_1"))
    scored = written(scored.groupBy("chars", "rejected", "n", "training").agg(F.avg(own).alias("held_out"), F.avg(own if labelled is None else F.col("ratio_2")).alias("score")), "url-scores")
    limit, false, caught = threshold(scored)
    total = scored.agg(F.sum("n")).first()[0] or 0
    found = looked_up(rows.where("chars is not null"), scored.select("chars", "n", "score"), ["chars"], "n", total / 1000).unionByName(rows.where("chars is null").withColumns({"n": F.lit(0).cast("long"), "score": F.lit(0.0)}))
    method = F.when((F.col("score") > F.lit(limit)) & F.col("chars").isNotNull(), "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.round("score", 6).alias("score"), F.coalesce("by_rule", method).alias("verdict"), F.lit(limit).alias("threshold"), F.lit(false).cast("double").alias("held_out_false"), F.lit(caught).cast("double").alias("held_out_caught"))
