"""Queries of the training-data operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm import bpe, langid, matroska, minhash, mixing, pii, quality, rules, urls, warc
from tapeline.llm.common import read_table, written


def _tokenizer() -> tuple[str, str]:
    """Vocabulary file and pattern: parameters, never copied here."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt over all cores where the files give fewer splits than cores, as a few large row groups do; else as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_dealt(read_table(spark, sf_dir, "documents").select("doc_id", "text")), *_tokenizer(), digests_only=True)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.mix(read_table(spark, sf_dir, "documents")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(read_table(spark, sf_dir, "documents")).drop("content")


def op4_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of op4's evidence: documents have no markup and no address, pages have both."""
    return langid.identify_pages(read_table(spark, sf_dir, "pages")).drop("content").withColumnRenamed("doc_id", "page_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_dealt(read_table(spark, sf_dir, "documents").select("doc_id", "text")), read_table(spark, sf_dir, "labels"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop("content")


def op6_quality_classifier_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host and path level at work: pages have both, and the model comes from the labelled documents."""
    pages = read_table(spark, sf_dir, "pages")
    rows = pages.select("page_id", langid.html_text(F.col("html")).alias("text"), F.substring_index("url", "://", -1).alias("source"))
    train = read_table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "page_id")
    labels = read_table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "page_id")
    return quality.classify(rows, labels, "page_id", train=train).drop("content").withColumnRenamed("doc_id", "page_id")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(read_table(spark, sf_dir, "documents"), k=3, threshold=(85, 100))
    return found.select("doc_id", "n_shingles", "component_id", "kept", "class_size")


def op8_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_digests(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archives = written(warc.write_archives(warc.with_revisits(pages, "page_id", "html")), "warc")
    return warc.read_archives(archives).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset", "stored_bytes")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(read_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_byte_bpe": op1_byte_bpe, "op2_url_filter": op2_url_filter, "op3_source_mixing": op3_source_mixing, "op4_language_id": op4_language_id, "op4_language_id_pages": op4_language_id_pages, "op5_quality_rules": op5_quality_rules, "op6_quality_classifier": op6_quality_classifier, "op6_quality_classifier_pages": op6_quality_classifier_pages, "op7_minhash": op7_minhash, "op8_matroska": op8_matroska, "op9_warc": op9_warc, "op10_pii": op10_pii}


#: Shingles, links by counted overlaps, and their closure; copies are counted by equal sets.
NEAR_DUPLICATES = r"""
with recursive words as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
sets as (select doc_id, list_sort(list_distinct(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end)) as sh from words),
grams as (select doc_id, len(sh) as n, unnest(sh) as g from sets),
pairs as (select x.doc_id as a, y.doc_id as b, any_value(x.n) as n_a, any_value(y.n) as n_b, count(*) as c from grams x join grams y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
links as (select a, b from pairs where 100 * c >= 85 * (n_a + n_b - c)),
reach as (select doc_id as d, doc_id as r from sets union select reach.d, links.b from reach join links on links.a = reach.r),
least_of as (select d, min(r) as component_id from reach group by d)
select s.doc_id, cast(len(sh) as bigint) as n_shingles, component_id, s.doc_id = component_id as kept, case when len(sh) = 0 then 1 else count(*) over (partition by sh) end as class_size
from sets s join least_of on d = s.doc_id
"""


def _url_models() -> str:
    """Rules, then the Markov models of both halves and of all, order by order; the same steps as urls.judge."""
    sides, n = urls.SIDES[:4], urls.ORDER + 1
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urls.RULES)
    inner = "".join(c for c in urls.ALPHABET if c not in "^$~-")
    weigh = lambda s: f"sum(case when r = {int(s.startswith('rejected'))} and half <> {s[-1]} then n else 0 end) as {s}"
    parts = [
        "links as (select page_id, case when strpos(url, '://') > 0 then nullif(substr(url, strpos(url, '://') + 3), '') end as rest from pages)",
        "parsed as (select page_id, rest, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from links)",
        f"rules(h, p, v) as (values {rules})",
        "ruled as (select page_id, rest, host, path, (select h || p from rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) order by length(h || p) desc limit 1) as rule from parsed)",
        f"""folded as (select page_id, host, path, rule, v as by_rule, '{'^' * urls.ORDER}' || regexp_replace(lower(case when regexp_matches(rest, '[^\\x00-\\x7F]') then array_to_string(list_transform(regexp_extract_all(rest, '(?s).'), lambda c: case when regexp_matches(c, '^[\\x00-\\x7F]$') then c else url_encode(c) end), '') else rest end), '[^{inner}-]', '~', 'g') || '$' as chars from ruled left join rules on rule = h || p)""",
        "urls as (select chars, max(case when by_rule = 'block' then 1 else 0 end) as r, count(*) as n, ascii(substr(md5(min(host)), 1, 1)) % 2 as half from folded where chars is not null group by chars)",
        f"spots as (select chars, r, n, half, substr(chars, i, {n}) as w from (select *, unnest(range(1, length(chars) - {urls.ORDER} + 1)) as i from urls))",
        f"counted as (select w, {', '.join(map(weigh, sides))} from spots group by w)",
        f"q0 as (select w, {', '.join(f'1.0::double / {len(urls.ALPHABET)} as p_{s}' for s in sides)} from counted)",
    ]
    for k in range(n):
        parts += [
            f"g{k} as (select substr(w, {n - k}) as g, {', '.join(f'sum({s})::double as {s}' for s in sides)} from counted group by 1)",
            f"t{k} as (select substr(g, 1, {k}) as c, {', '.join(f'sum({s}) as n_{s}, count_if({s} > 0)::double as t_{s}' for s in sides)} from g{k} group by 1)",
            f"q{k + 1} as (select w, {', '.join(f'case when n_{s} > 0 then ({s} + t_{s} * p_{s}) / (n_{s} + t_{s}) else p_{s} end as p_{s}' for s in sides)} from q{k} join g{k} on g = substr(w, {n - k}) join t{k} on c = substr(g, 1, {k}))",
        ]
    ratio = lambda i: f"ln(p_rejected_{i}) - ln(p_accepted_{i})"
    parts += [
        f"scored as (select chars, r, n, avg(case when half = 0 then {ratio(0)} else {ratio(1)} end) as score from spots join q{n} using (w) group by chars, r, n)",
        f"steps as (select cast(ceil(least(greatest(score, -{urls.TOP_SCORE}), {urls.TOP_SCORE}) / {urls.STEP}) as bigint) as step, sum(case when r = 0 then n else 0 end) as a, sum(case when r = 1 then n else 0 end) as b from scored group by 1)",
        "sums as (select sum(a) as a, sum(b) as b from steps)",
        "tails as (select c.c, coalesce(sum(s.a), 0) / (select a from sums) as a, coalesce(sum(s.b), 0) / (select b from sums) as b from (select distinct greatest(0, step) as c from steps union select 0) c left join steps s on s.step > c.c group by c.c)",
        f"best as (select * from tails where (select a > 0 and b > 0 from sums) and a <= {urls.SPARE} order by c limit 1)",
        f"level as (select coalesce((select c from best) * {urls.STEP}, 'infinity'::double) as t, (select a from best) as a, (select b from best) as b)",
    ]
    return "with " + ",\n".join(parts) + """
select page_id, host, path, rule, round(coalesce(score, 0.0), 6) as score, coalesce(by_rule, case when coalesce(score > t, false) then 'block' else 'allow' end) as verdict, t as threshold, a::double as held_out_false, b::double as held_out_caught
from folded left join scored using (chars), level"""


def oracle_sql() -> dict[str, str]:
    """The other operators fit models, schedules or byte formats; their tests use brute force and round trips."""
    return {"op2_url_filter": _url_models(), "op7_minhash": NEAR_DUPLICATES}
