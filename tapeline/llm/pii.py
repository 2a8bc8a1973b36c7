"""Personal data, and terms that disclose it. DataFrame functions only.

Base: e-mail and IP addresses, card and phone numbers by pattern. On top, information-theoretic sanitisation: each
base value is a protected entity e. Documents are counted over the whole corpus: n(e) with the entity, n(t) with the
term, n(t, e) with both anywhere in the text. A term's pointwise mutual information with the
entity, as a share of the entity's information -log n(e)/N, is 1 + log(p) / -log(n(e) / N), where p is the probability of the
entity given the term. It is shrunk to independence by PRIOR documents, p = (n(t, e) + PRIOR n(e) / N) / (n(t) + PRIOR), so a
sparse pair counts for less but no pair is left out for being rare. From GENERALISE on, every occurrence of the term in the
documents with that entity is generalised to a placeholder, from REMOVE on removed. In documents without the entity the
term stays.

As n(t, e) <= n(e), a term passes for an entity only if n(t) is at most a bound by n(e) (most_frequent): commoner terms are
left before terms and entities are paired, which changes no result. Entities of the same documents have the same
counts and are paired as one group, so a text full of values of its own has one group. Frequent keys are looked up by broadcast.

Offsets are prefix sums over blocks and texts are cut in chunks (arrays.py), so a text full of hits takes little more time than
as long a text without. Patterns use possessive repeats and start only where a run of their characters starts, so neither the stack
nor the time grows with the square of a long run.

Cases: a null or empty text has no spans. Rows that repeat an id and a text have equal spans, and count as one
document in the corpus. Positions are code points, ends exclusive. Overlapping spans of several kinds all stay; the
sanitised text merges them. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.llm.arrays import chunks, let, piece, running_max, running_sum
from tapeline.llm.common import looked_up, row_key, written

KINDS = ("email", "ip", "card", "phone", "term", "removed")
PLACEHOLDERS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "removed": ""}

#: Letters of a term at least, documents that the prior of a pair counts as, shares of information.
LETTERS, PRIOR, GENERALISE, REMOVE = 4, 3, 0.8, 0.95

#: A key in more than this share of the documents is looked up by broadcast; there are at most as many as 1 / share x a document's keys.
FREQUENT = 1e-3

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: A whole run of digits with single separators, if it has 12 to 19 digits.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = rf"\p{{L}}{{{LETTERS},}}+"


def located(text: Column, pattern: str) -> Column:
    """Matches as array<struct<start, stop, value>>: what lies between them is split off and measured."""
    gaps = F.transform(F.split(text, F.lit(pattern), -1), F.length)

    def placed(found: Column, between: Column) -> Column:
        steps = F.transform(found, lambda h, i: F.get(between, i) + F.length(h))
        return let(running_sum(steps), lambda ahead: F.transform(found, lambda h, i: F.struct((F.get(ahead, i) + F.get(between, i)).alias("start"), (F.get(ahead, i) + F.get(between, i) + F.length(h)).alias("stop"), h.alias("value"))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: let(gaps, lambda between: placed(found, between)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _good_ip(value: Column) -> Column:
    """Every part, without leading zeros, is a number up to 255."""
    return F.forall(F.split(value, r"\."), lambda p: F.rlike(p, F.lit(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, stop, value>> by start, then kind (its number in KINDS)."""
    nothing = F.expr("cast(array() as array<struct<start:int,kind:int,stop:int,value:string>>)")

    def spans(kind: str, pattern: str, maybe: Column, good) -> Column:
        hits = F.filter(located(text, pattern), lambda s: good(s["value"]))
        made = F.transform(hits, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["stop"].alias("stop"), s["value"].alias("value")))
        return F.when(maybe, made).otherwise(nothing)

    digits = lambda v: F.length(_digits(v))
    return F.sort_array(F.concat(
        spans("email", EMAIL, F.contains(text, F.lit("@")), lambda v: F.lit(True)),
        spans("ip", IP, F.rlike(text, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")), _good_ip),
        spans("card", CARD, F.rlike(text, F.lit(CARD)), lambda v: F.call_function("luhn_check", _digits(v))),
        spans("phone", PHONE, F.rlike(text, F.lit(r"\+[0-9]")), lambda v: digits(v).between(9, 15)),
    ))


def rewritten(text: Column, spans: Column, instead) -> Column:
    """text with instead(span, end of what was rewritten before it) in place of each span; spans by start."""

    def pieces(parts: Column, ends: Column) -> Column:
        before = F.transform(spans, lambda s, i: F.concat(piece(parts, F.get(ends, i), F.greatest(s["start"], F.get(ends, i))), instead(s, F.get(ends, i))))
        last = F.array_max(F.transform(spans, lambda s: s["stop"]))
        return F.concat(F.array_join(before, ""), piece(parts, last, F.length(text)))

    ends = running_max(F.transform(spans, lambda s: s["stop"]))
    return F.when(F.size(spans) > 0, let(chunks(text), lambda parts: let(ends, lambda e: pieces(parts, e)))).otherwise(text)


def outside(text: Column, spans: Column) -> Column:
    """text with what lies in spans blanked; positions stay."""
    return rewritten(text, spans, lambda s, end: F.repeat(F.lit(" "), F.greatest(s["stop"] - F.greatest(s["start"], end), F.lit(0))))


def words_of(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def occurrences(text: Column, masked: Column, gone: Column) -> Column:
    """Spans, as in base_spans, of every occurrence of the masked terms; those in gone are removed."""
    hits = F.filter(F.transform(located(text, TERM), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), F.lower(x["value"]).alias("term"))), lambda x: F.array_contains(masked, x["term"]))
    kind = lambda x: F.when(F.array_contains(gone, x["term"]), KINDS.index("removed")).otherwise(KINDS.index("term"))
    return F.transform(hits, lambda x: F.struct(x["start"].alias("start"), kind(x).alias("kind"), x["stop"].alias("stop"), x["term"].alias("value")))


def span_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def most_frequent(n_e: Column, documents: int) -> Column:
    """The largest n(t) of a term that can pass for an entity in n_e documents, were it in all of them; one more for rounding."""
    base = n_e / F.lit(float(documents))
    return (n_e + PRIOR * base) * F.pow(base, F.lit(GENERALISE - 1)) - PRIOR + 1


def disclosing_terms(found: DataFrame) -> DataFrame:
    """(key, masked, gone): per document the terms above the threshold for any of its entities. found: (key, spans, words)."""
    documents = max(2, found.count())
    frequent = documents * FREQUENT
    held = written(found.where(F.size("spans") > 0).select("key", F.array_distinct(F.transform("spans", lambda s: s["value"])).alias("entities"), "words").dropDuplicates(["key"]), "pii-held")
    holds = held.select("key", F.explode("entities").alias("entity"))
    same = [F.bit_xor(F.xxhash64("key", F.lit(i))).alias(f"same_{i}") for i in range(2)]
    entities = written(holds.groupBy("entity").agg(F.count("*").alias("n_e"), *same), "pii-entities")
    group = ["n_e", "same_0", "same_1"]
    groups = looked_up(holds, entities, ["entity"], "n_e", frequent).groupBy("key").agg(F.collect_set(F.struct(*group)).alias("groups"))

    terms = written(found.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("n_t")), "pii-terms")
    most = entities.agg(F.max(most_frequent(F.col("n_e"), documents)).alias("most")).first()["most"] or 0.0
    rare = looked_up(held.select("key", F.explode("words").alias("term")), terms, ["term"], "n_t", frequent, F.col("n_t") <= most)
    pairs = rare.join(groups, "key").select("key", "term", "n_t", F.explode(F.filter("groups", lambda g: F.col("n_t") <= most_frequent(g["n_e"], documents))).alias("g"))
    pairs = written(pairs.select("key", "term", "n_t", "g.*"), "pii-pairs")
    both = pairs.groupBy(*group, "term", "n_t").agg(F.count("*").alias("n_te"))
    base = F.col("n_e") / F.lit(float(documents))
    given = F.least((F.col("n_te") + PRIOR * base) / (F.col("n_t") + PRIOR), F.lit(1.0))
    share = 1 + F.log(given) / F.greatest(-F.log(base), F.lit(1e-9))
    told = written(both.withColumn("share", share).where(F.col("share") >= GENERALISE).select(*group, "term", "n_te", (F.col("share") >= REMOVE).alias("removed")), "pii-told")
    spots = looked_up(pairs, told, [*group, "term"], "n_te", frequent)
    return spots.groupBy("key").agg(F.collect_set("term").alias("masked"), F.collect_set(F.when(F.col("removed"), F.col("term"))).alias("gone"))


def found_spans(docs: DataFrame, ident: str, text: str, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, content, key, spans, words, clear), written once, with the columns in keep as `row`."""
    whole = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row") if keep else F.lit(None).alias("row")
    texts = docs.select(F.col(ident).alias("doc_id"), row_key(text).alias("content"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), whole)
    key = F.concat(F.col("content").cast("string"), F.coalesce(F.concat(F.lit(":"), F.col("doc_id").cast("string")), F.lit("")))
    based = texts.withColumn("key", key).withColumn("spans", base_spans(F.col("text"))).withColumn("clear", outside(F.col("text"), F.col("spans")))
    out = ["doc_id", "content", "key", "spans", words_of(F.col("clear")).alias("words"), F.when(F.size("spans") > 0, F.col("clear")).alias("clear")]
    return written(based.select(*out, *(["row"] if keep else [])), "pii-found")


def all_spans() -> Column:
    """Base spans and those of the terms of `masked`, in order."""
    return F.when(F.col("masked").isNull(), F.col("spans")).otherwise(F.sort_array(F.concat("spans", occurrences(F.col("clear"), F.col("masked"), F.col("gone")))))


def find(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, content (a key of its text), base and spans (arrays as in base_spans)."""
    found = found_spans(docs, ident, text)
    out = ["doc_id", "content", F.col("spans").alias("base")]
    told = found.where(F.size("spans") > 0).join(disclosing_terms(found), "key", "left")
    return found.where(F.size("spans") == 0).select(*out, "spans").unionByName(told.select(*out, all_spans().alias("spans")))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term."""
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    extra = (F.size("spans") - F.size("base")).cast("long").alias("n_term")
    return found.select("doc_id", *[n(k) for k in KINDS[:4]], F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"), extra)


def sanitised(text: Column, spans: Column) -> Column:
    """text with each span's placeholder; a span that starts within an earlier one adds none."""
    holders = F.array(*[F.lit(PLACEHOLDERS[k]) for k in KINDS])
    return rewritten(text, spans, lambda s, end: F.when(s["start"] >= end, F.get(holders, s["kind"])).otherwise(F.lit("")))


def sanitise(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the text sanitised, and n_chars, if there, with it; every other column, and every row without spans, as it was.

    Only rows with spans meet the terms found for them; all other texts stay where they are.
    """
    found = found_spans(docs, ident, text, docs.columns)
    told = found.where(F.size("spans") > 0).join(disclosing_terms(found).withColumnRenamed("key", "__told"), F.col("key") == F.col("__told"), "left")
    # the spans are computed once: they are named in many places of the rewritten text
    told = told.withColumn("__new", let(all_spans(), lambda spans: sanitised(F.col(f"row.`{text}`").cast("string"), spans)))
    new = lambda c: F.col("__new").alias(c) if c == text else F.length("__new").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c)
    return found.where(F.size("spans") == 0).select("row.*").unionByName(told.select(*[new(c) for c in docs.columns]))
