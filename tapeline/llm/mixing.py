"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents are shuffled by hash and laid end to end, once per epoch, as a stream of words that is cut
into equal blocks. Slot j of the schedule falls at the golden-ratio point frac(j / phi); the cumulated targets map
it to a source, and the slot's rank among that source's slots names the block it takes.

No group is gathered in one task: word offsets within a source and ranks within a source are prefix sums over
bounded hash or slot ranges first and within a range second. Rows over single tasks are one per source.

Cases: a null text has no words; documents without words are in no block and are taken 0 times. A null source is a
source of its own, behind the others. Repeated rows count each. An empty table gives an empty mix. Other columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.llm.common import WORD, row_key, row_name, written

#: Documents of a hash range, slots of a slot range, cells of the unit interval, blocks of a mean source, limits of a block.
RANGE_DOCS, RANGE_SLOTS, CELLS, MEAN_BLOCKS, LEAST_BLOCK, MOST_BLOCK = 5000, 1 << 14, 1 << 12, 4096, 8, 4096

#: 2^32 divided by the golden ratio, the odd integer next to it (fixed value).
GOLDEN = 2654435769


@dataclass
class Mix:
    """sized: a row per document; sources: one per source with its target; pieces: what each slot takes."""

    sized: DataFrame
    sources: DataFrame
    pieces: DataFrame
    block_words: int


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """totals (source, source_size) with rank, weight and target: shares by weight, none above `most` times its size.

    Sources are ordered by size per weight. While the common level over those left would pass a source's limit, it
    stops there and the level rises; the first that doesn't pass fixes the level of all behind it.
    """
    every, by_source = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.orderBy(F.col("source").asc_nulls_last())
    filled = Window.orderBy(F.col("limit") / F.col("weight"), F.col("rank"))
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    ranked = totals.withColumn("rank", F.row_number().over(by_source))
    ranked = ranked.withColumns({"weight": F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1).cast("long"), "limit": F.col("source_size") * most})
    left = ranked.withColumns({
        "left_size": F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0)),
        "left_weight": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    level = left.withColumn("own_level", F.col("left_size") / F.col("left_weight"))
    fits = F.when(F.col("own_level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), F.col("rank"), F.col("own_level").alias("level")))
    level = level.withColumn("level", F.min(fits).over(every)["level"])
    return level.select("source", "source_size", "rank", "weight", F.when(F.col("level") * F.col("weight") > F.col("limit"), F.col("limit").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def golden_point(j: Column) -> Column:
    """frac(j / phi) in 32 bits, by halves so that nothing overflows."""
    high, low = F.shiftright(j, 16), j.bitwiseAND(0xFFFF)
    return (((high * GOLDEN).bitwiseAND(0xFFFF) * 65536 + low * GOLDEN).bitwiseAND(0xFFFFFFFF)) / F.lit(float(1 << 32))


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """(slot, rank, block): the source of each slot and how many of that source's slots came before it."""
    spark = sources.sparkSession
    share = Window.orderBy("rank")
    ends = sources.withColumn("__all", F.sum("target").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ends = ends.select("rank", (F.coalesce(F.sum("target").over(share.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) / F.col("__all")).alias("low"), (F.sum("target").over(share) / F.col("__all")).alias("high"), (F.col("rank") == F.max("rank").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("last"))
    ends = ends.withColumn("high", F.when(F.col("last"), 2.0).otherwise(F.col("high"))).where("high > low")
    cells = ends.select("rank", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * CELLS).cast("long"), F.floor(F.least(F.col("high"), F.lit(1.0)) * CELLS).cast("long"))).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * CELLS).cast("long"))
    placed = points.join(cells, "cell").where("u >= low and u < high").select("slot", "rank", F.floor(F.col("slot") / RANGE_SLOTS).alias("range"))
    ahead = placed.groupBy("rank", "range").count()
    ahead = ahead.select("rank", "range", (F.sum("count").over(Window.partitionBy("rank").orderBy("range")) - F.col("count")).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("rank", "range").orderBy("slot"))
    return placed.withColumn("within", within).join(ahead, ["rank", "range"]).select("slot", "rank", (F.col("ahead") + F.col("within") - 1).alias("block"))


def mix(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: int = 7) -> Mix:
    """The whole mix. A piece is words [word_from, word_to) of a document's epoch, in the block that a slot takes."""
    one = docs.select(F.col(ident).alias("doc_id"), F.col(source).alias("source"), row_key(text, source).alias("content"), word_count(F.col(text)).alias("size"))
    one = one.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "content").orderBy("content")))
    sized = written(one, "mix-sized")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    sources = written(source_targets(totals.select("source", "source_size"), weights, share, epochs).join(totals.select(F.col("source").alias("__s"), "docs"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s"), "mix-sources")
    found = sources.agg(F.sum("target"), F.count("*")).first()
    words, n = found[0] or 0.0, found[1]
    block = int(max(LEAST_BLOCK, min(MOST_BLOCK, -(-words // (MEAN_BLOCKS * max(1, n))))))
    slots = schedule(sources, int(-(-words // block)))

    placed = sized.where("size > 0").join(sources.select(F.col("source").alias("__s"), "rank", "docs"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s", "source")
    placed = placed.withColumn("epoch", F.explode(F.array(*map(F.lit, range(epochs)))))
    placed = placed.withColumn("at", F.xxhash64(F.lit(seed), "epoch", "doc_id", "content", "copy"))
    ranges = F.ceil(F.col("docs") / RANGE_DOCS)
    placed = placed.withColumn("range", F.floor(F.shiftrightunsigned("at", 33) / F.lit(float(1 << 31)) * ranges).cast("long"))
    ahead = placed.groupBy("rank", "epoch", "range").agg(F.sum("size").alias("words"))
    ahead = ahead.select("rank", "epoch", "range", (F.sum("words").over(Window.partitionBy("rank").orderBy("epoch", "range")) - F.col("words")).alias("ahead"))
    inner = Window.partitionBy("rank", "epoch", "range").orderBy("at", "doc_id", "content", "copy").rowsBetween(Window.unboundedPreceding, -1)
    laid = placed.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(ahead, ["rank", "epoch", "range"])
    laid = laid.withColumn("start", F.col("ahead") + F.col("inside"))
    cut = laid.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    cut = cut.withColumns({"word_from": F.greatest(F.lit(0), F.col("block") * block - F.col("start")), "word_to": F.least(F.col("size"), (F.col("block") + 1) * block - F.col("start"))})
    pieces = cut.join(slots, ["rank", "block"]).select("slot", "rank", "block", "doc_id", "content", "copy", "epoch", "word_from", "word_to")
    return Mix(sized, sources, pieces, block)


def taken_words(m: Mix) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken."""
    taken = m.pieces.groupBy("doc_id", "content", "copy").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("taken"))
    taken = taken.select(F.col("doc_id").alias("__d"), F.col("content").alias("__c"), F.col("copy").alias("__k"), "taken")
    joined = m.sized.join(m.sources.select(F.col("source").alias("__s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    joined = joined.join(taken, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("content") == F.col("__c")) & (F.col("copy") == F.col("__k")), "left")
    return joined.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """docs with whole documents instead of pieces: one copy for each epoch whose first word a slot takes.

    Within each copy the columns are those of docs. Documents without words are in no copy.
    """
    m = mix(docs, ident, text, source, **how)
    copies = m.pieces.where("word_from = 0").select(F.col("doc_id").alias("__d"), F.col("content").alias("__c"), "copy", "epoch")
    key = lambda c: F.concat(F.col(c).cast("string"), F.coalesce(F.concat(F.lit(":"), F.col("__d").cast("string")), F.lit("")))
    times = copies.withColumn("__key", key("__c")).groupBy("__key").agg(F.count("*").alias("__n"))
    joined = docs.withColumn("__key", row_name(ident, text, source)).join(times, "__key")
    # rows that repeat share what their group takes: the first rows get one more where it doesn't divide evenly
    nth = F.row_number().over(Window.partitionBy("__key").orderBy("__key"))
    whole = F.count("*").over(Window.partitionBy("__key"))
    joined = joined.withColumns({"__nth": nth, "__all": whole})
    n = F.floor((F.col("__n") + F.col("__all") - F.col("__nth")) / F.col("__all")).cast("int")
    return joined.withColumn("__times", F.explode(F.array_repeat(F.lit(1), n))).select(*docs.columns)
