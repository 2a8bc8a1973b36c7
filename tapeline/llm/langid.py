"""Language ID by Bayesian evidence fusion.

Text: mean log-likelihood of byte trigrams without digits per language, counted over every text with a declared language, as if of
at most EFFECTIVE independent trigrams; a uniform model over buckets, less a margin, stands for no known language (`und`).
Numbers and keys in a short text thus don't make it unknown. Declared
language: its probability given the language, from soft counts over the corpus. Address: the prior over languages
of a host, shrunk to that of its address suffix, and that to the corpus's, all from soft counts by grouped
aggregation. The posterior multiplies the three.

Cases: a null or empty text, or one of digits and symbols without letters, has flat text evidence and is rejected. A null declaration, host or suffix is a value of
its own. Declarations are compared by their primary subtag in lower
case (`EN` and `en-US` are `en`), and every one has a model: 128 KB of broadcast for each. Texts in no known language come out as
`und` and are rejected, as are those whose best posterior is under `least`. Repeated rows are judged alike. An
empty table, or one without declarations, knows no language, so its rows are `und`. Other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import log_softmax, row_key, written
from tapeline.llm.grams import BITS, class_log_probabilities, scored

#: Trigrams that count as independent; strengths of the suffix's and the host's prior; by how much a text
#: must fit worse than chance, in nats per trigram, before no known language is likelier.
EFFECTIVE, SUFFIX_STRENGTH, HOST_STRENGTH, UND_MARGIN = 60, 20.0, 20.0, 1.0


def html_language(html: Column) -> Column:
    """The language that a page declares, null if none."""
    return F.lower(F.nullif(F.regexp_extract(html, r"(?is)<html[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1), F.lit("")))


def html_text(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1))


def suffix_of(host: Column) -> Column:
    """The last label of a host name, empty if it has only one."""
    return F.when(F.contains(host, F.lit(".")), F.substring_index(host, ".", -1)).otherwise(F.lit(""))


def language_code(declared: Column) -> Column:
    """The primary subtag of a declared language in lower case, empty if none."""
    return F.coalesce(F.lower(F.regexp_extract(declared, r"^\s*([^\s_-]+)", 1)), F.lit(""))


def identify(docs: DataFrame, ident: Column, text: Column, declared: Column, host: Column, least: float = 0.5) -> DataFrame:
    """One row per document: doc_id, content (a key of its text), declared, language, posterior, text_language, kept."""
    rows = docs.select(ident.cast("long").alias("doc_id"), text.cast("string").alias("text"), declared.cast("string").alias("declared"), F.coalesce(host.cast("string"), F.lit("")).alias("host"))
    rows = rows.withColumn("content", row_key("text", "declared", "host"))
    rows = rows.withColumn("known", language_code(F.col("declared")))
    languages = sorted(r["known"] for r in rows.where("known <> ''").select("known").distinct().collect())
    if not languages:
        return rows.select("doc_id", "content", "declared", F.lit("und").alias("language"), F.lit(1.0).alias("posterior"), F.lit("und").alias("text_language"), F.lit(False).alias("kept"))
    table = class_log_probabilities(rows.select(F.col("known").alias("label"), "text"), languages, smooth=0.1)
    score = written(scored(rows, "text", table).withColumn("suffix", suffix_of(F.col("host"))), "langid-scores")

    n = len(languages) + 1
    flat = F.array_repeat(F.lit(-math.log(n)), n)
    with_und = F.concat("mean_ll", F.array(F.lit(-BITS * math.log(2.0) - UND_MARGIN)))
    score = score.withColumn("seen", F.when(F.col("n_grams") > 0, log_softmax(F.transform(with_und, lambda x: x * F.least("n_grams", F.lit(EFFECTIVE))))).otherwise(flat))
    soft = F.array(*[F.sum(F.exp(F.col("seen")[i])) for i in range(n)])
    by_host = score.groupBy("host", "suffix", "known").agg(soft.alias("soft"), F.count("*").alias("rows"))
    by_host = written(by_host, "langid-hosts")
    add = lambda: F.array(*[F.sum(F.col("soft")[i]) for i in range(n)])
    every = by_host.agg(add().alias("soft"), F.sum("rows").alias("rows")).first()
    prior = [(x + 1.0) / (every["rows"] + n) for x in (every["soft"] or [0.0] * n)] if every["rows"] else [1.0 / n] * n

    suffixes = by_host.groupBy("suffix").agg(add().alias("soft"), F.sum("rows").alias("rows"))
    suffixes = suffixes.select("suffix", F.array(*[(F.col("soft")[i] + SUFFIX_STRENGTH * prior[i]) / (F.col("rows") + SUFFIX_STRENGTH) for i in range(n)]).alias("suffix_prior"))
    hosts = by_host.groupBy("host", "suffix").agg(add().alias("soft"), F.sum("rows").alias("rows")).join(suffixes, "suffix")
    hosts = hosts.select("host", F.array(*[F.log((F.col("soft")[i] + HOST_STRENGTH * F.col("suffix_prior")[i]) / (F.col("rows") + HOST_STRENGTH)) for i in range(n)]).alias("host_prior"))

    # what is declared, given the language: a row for each language and one for none
    told = {r["known"]: r["soft"] for r in by_host.groupBy("known").agg(add().alias("soft")).collect()}
    whole = [sum(s[i] for s in told.values()) for i in range(n)]
    ratio = {d: [math.log((s[i] + 0.5) / (whole[i] + 0.5 * len(told))) for i in range(n)] for d, s in told.items()}
    said = rows.sparkSession.createDataFrame(list(ratio.items()), "known string, said array<double>")

    names = F.array(*[F.lit(x) for x in [*languages, "und"]])
    fused = score.join(hosts, "host").join(F.broadcast(said), "known", "left").withColumn("said", F.coalesce("said", flat))
    fused = fused.withColumn("post", log_softmax(F.zip_with(F.zip_with("seen", "said", lambda a, b: a + b), "host_prior", lambda a, b: a + b)))
    fused = fused.withColumns({"top": F.array_max("post"), "text_top": F.array_max("seen")})
    fused = fused.withColumns({"language": F.element_at(names, F.array_position("post", F.col("top")).cast("int")), "text_language": F.when(F.col("n_grams") > 0, F.element_at(names, F.array_position("seen", F.col("text_top")).cast("int"))).otherwise("und"), "posterior": F.exp("top")})
    kept = (F.col("n_grams") > 0) & (F.col("language") != "und") & (F.col("posterior") >= least)
    return fused.select("doc_id", "content", "declared", "language", "posterior", "text_language", kept.alias("kept"))


def identify_documents(docs: DataFrame, **how) -> DataFrame:
    return identify(docs, F.col("doc_id"), F.col("text"), F.col("lang"), F.col("source"), **how)


def identify_pages(pages: DataFrame, **how) -> DataFrame:
    return identify(pages, F.col("page_id"), html_text(F.col("html")), html_language(F.col("html")), host_of(F.col("url")), **how)


def keep_identified(docs: DataFrame, **how) -> DataFrame:
    """docs without those that identify_documents rejects. Only the rejected keys meet the documents, so few rejections move no text."""
    out = identify_documents(docs, **how).where(~F.col("kept")).select(F.col("doc_id").alias("__d"), F.col("content").alias("__c")).distinct()
    out = written(out, "langid-rejected")
    own = docs.select("*", F.struct(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("declared"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host")).alias("__own"))
    own = own.withColumn("__content", row_key("__own.text", "__own.declared", "__own.host"))
    return own.join(out, F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.col("__content") == F.col("__c")), "left_anti").select(*docs.columns)
