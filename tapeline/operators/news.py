"""Headline digests: the first entries of each ticker, in order, whatever their shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_NEWS, ENTRIES = "No recent headlines available.", 5


def headline(entry: Column) -> Column:
    """`- [publisher] title` of one entry, null if it is no object or has no title; nested content comes first."""
    nested = entry["content"].isNotNull()
    title = F.when(nested, entry["content"]["title"]).otherwise(entry["title"])
    who = F.when(nested, entry["content"]["provider"]["displayName"]).otherwise(entry["publisher"])
    return F.when(entry["is_object"] & (title != ""), F.concat(F.lit("- ["), F.when(who != "", who).otherwise("Unknown"), F.lit("] "), title))


def digest_array(entries: Column) -> Column:
    """The limit comes before the filter, so bad entries use up places."""
    lines = F.filter(F.transform(F.slice(entries, 1, ENTRIES), headline), lambda x: x.isNotNull())
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(F.lit(NO_NEWS))


def digest(entries: DataFrame) -> DataFrame:
    """entries (ticker, nth, is_object, title, publisher, content) -> (ticker, news_summary).

    Only each ticker's first entries are gathered; the ranking is cut before the exchange.
    """
    first = entries.withColumn("rank", F.row_number().over(Window.partitionBy("ticker").orderBy("nth"))).where(F.col("rank") <= ENTRIES)
    listed = first.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("nth", "is_object", "title", "publisher", "content"))).alias("entries"))
    return listed.select("ticker", digest_array(F.col("entries")).alias("news_summary"))
