"""Near duplicates: universal hash minima, bands, verification on full sets, connected components.

Documents with equal shingle sets form a class first, so copies cost one row each. Classes that share a band are
candidates. A band's members are not paired with each other but with one pivot, the member that shares most bands, so a group of
near copies costs a pair per member and band. Members of a band that are not connected then are joined exactly: each emits the
rarest of its shingles, as many as one of any linked pair must share, and meets those of other components that have one
in common early enough for the overlap that a link needs. So nothing is capped and no link of a band is lost. A link needs intersection / union >= threshold on
the full sets. Components come from large-star and small-star.

Bands are chosen so that a pair at the threshold is missed with a probability of at most MISS.

Cases: a document without words has an empty set, is linked with nothing and stays. One with fewer words than a
shingle has is one shingle. Very long texts are read whole, 1,024 shingles at a time. Repeated rows are one class. A null id is never a component's id unless all its ids are
null. Extra columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.llm.common import hinted_broadcasts_only, looked_up, pruned_by_keys, row_key, row_name, scratch, small_batches, written
from tapeline.llm.components import stars

#: Chance to miss a pair at the threshold, hash functions at most, bits of the hashed counts that order shingles by rarity.
MISS, MOST_HASHES, COUNT_BITS = 1e-6, 160, 18

#: Share of the classes from which a band's or shingle's members are looked up by broadcast (there are at most bands / share such
#: bands); slots of a hub's pairs; members of a shingle in a cell.
FREQUENT, SLOTS, PER_CELL = 1e-3, 256, 512

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
MIX = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float) -> tuple[int, int]:
    """Bands and rows: the most selective rows for which few enough pairs at the threshold are missed."""
    best = None
    for rows in range(1, 17):
        bands = next((b for b in range(1, MOST_HASHES // rows + 1) if (1 - threshold**rows) ** b <= MISS), None)
        if bands:
            best = (bands, rows)
    if not best:
        raise ValueError(f"a threshold of {threshold} needs more than {MOST_HASHES} hash functions to miss at most {MISS} of its pairs")
    return best


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of k-word shingles; A-Z lower-cased; all words as one shingle if fewer than k."""
    words = (text or "").encode("utf-8").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    n = len(words)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    width = min(n, k)
    h = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        h ^= own[i : n - width + 1 + i]
        h *= MIX
        h ^= h >> np.uint64(29)
    return np.unique(h)


class Signer:
    """Minima of many functions (a x + b) mod 2^64, a odd, and their bands."""

    def __init__(self, bands: int, rows: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(1, 1 << 63, bands * rows, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, np.uint64)[:, None] * np.uint64(2)
        self.salt = rng.integers(0, 1 << 63, bands, np.uint64)
        self.room = np.empty((bands * rows, 1024), np.uint64)

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(hashes), 1024):
            part = hashes[i : i + 1024]
            room = self.room[:, : len(part)]
            np.multiply(self.a, part, out=room)
            room += self.b
            np.minimum(out, room.min(axis=1), out=out)
        return out >> np.uint64(32)

    def band_keys(self, hashes: np.ndarray) -> np.ndarray:
        sig = self.minima(hashes).reshape(self.bands, self.rows)
        h = self.salt.copy()
        for r in range(self.rows):
            h ^= sig[:, r]
            h *= MIX
            h ^= h >> np.uint64(31)
        return h.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    signer = Signer(bands, rows)
    for batch in batches:
        sizes, nodes, keys = [], [], []
        for value in batch.column(2):
            h = shingle_hashes(value.as_py(), k)
            sizes.append(len(h))
            nodes.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
            keys.append(signer.band_keys(h) if len(h) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "content", "n_shingles", "node", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [shingle_hashes(v.as_py(), k).tobytes() for v in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["node", "shingles"])


def _links(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for x, y in zip(batch.column(2), batch.column(3)):
            a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = np.concatenate((a, b))
            both.sort()
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            good.append(den * common >= num * (len(both) - common))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << COUNT_BITS, np.int64)
    for batch in batches:
        for v in batch.column(0):
            total += np.bincount(_slots(np.frombuffer(v.as_buffer(), np.uint64)), minlength=1 << COUNT_BITS)
    (at,) = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["slot", "n"])


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def _prefixes(batches: Iterator[pa.RecordBatch], counts, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """The rarest n - ceil(threshold n) + 1 shingles of each set, in one order for all sets."""
    rarity = counts.value
    for batch in batches:
        rows, hashes, places = [], [], []
        for i, v in enumerate(batch.column(3)):
            h = np.frombuffer(v.as_buffer(), np.uint64)
            first = np.lexsort((h, rarity[_slots(h)]))[: len(h) - -(-num * len(h) // den) + 1]
            rows.append(np.full(len(first), i))
            places.append(np.arange(len(first)))
            hashes.append(h[first].view(np.int64))
        at = pa.array(np.concatenate(rows)) if rows else pa.array([], pa.int64())
        kept = [batch.column(k).take(at) for k in range(3)]
        flat = [pa.array(np.concatenate(x)) if x else pa.array([], pa.int64()) for x in (hashes, places)]
        yield pa.RecordBatch.from_arrays([*kept, *flat], names=["node", "n", "label", "shingle", "place"])


def signatures(docs: DataFrame, k: int, bands: int, rows: int, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, content, n_shingles, node, bands): node is the 128-bit digest of the full set."""
    small_batches(docs.sparkSession)
    one = docs.select(F.col(ident).cast("long").alias("doc_id"), row_key(text).alias("content"), F.col(text).cast("string").alias("text"))
    return one.mapInArrow(partial(_sign, k=k, bands=bands, rows=rows), "doc_id long, content long, n_shingles long, node binary, bands array<long>")


def near_duplicates(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100), ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, content (a key of its text), n_shingles, class_size, component_id, kept."""
    num, den = threshold
    spark = docs.sparkSession
    with hinted_broadcasts_only(spark), scratch(spark):
        sig = written(signatures(docs, k, *bands_for(num / den), ident, text), "minhash-signatures")
        # one signature per class: the bands of equal sets are equal
        classes = written(sig.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "content")).alias("first"), F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"), F.count("*").alias("class_size"), F.first("bands").alias("bands")), "minhash-classes")
        links = _connected(docs, classes, k, num, den, ident, text)
        label = classes.select("node", "doc_id", "class_size").join(links.select(F.col("u").alias("node"), "v"), "node", "left").withColumn("label", F.coalesce("v", "node"))
        frequent = max(1, classes.count() * FREQUENT)
        least = label.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("members"))
        found = written(looked_up(label, least, ["label"], "members", frequent).select("node", "class_size", "component_id"), "minhash-found", lasting=True)
        sig = written(sig.drop("bands"), "minhash-rows", lasting=True)
    rows = sig.select("doc_id", "content", "n_shingles", "node")
    empty = rows.where("node is null").withColumns({"class_size": F.lit(1).cast("long"), "component_id": F.col("doc_id")})
    # a class of copies may hold a third of all rows
    out = looked_up(rows.where("node is not null"), found, ["node"], "class_size", max(1, sig.count() * FREQUENT)).unionByName(empty)
    return out.select("doc_id", "content", "n_shingles", "class_size", "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _connected(docs: DataFrame, classes: DataFrame, k: int, num: int, den: int, ident: str, text: str) -> DataFrame:
    """Stars (u, v) over nodes from links that were verified."""
    small_batches(docs.sparkSession)
    member = classes.select("node", "n", F.explode(F.array_distinct("bands")).alias("band"))
    tag = F.xxhash64("node")
    bands = member.groupBy("band").agg(F.count("*").alias("members"), F.bit_xor(tag).alias("x"), F.sum(tag.bitwiseAND(0xFFFFFFFFFFF)).alias("s")).where("members > 1")
    # bands with the same members count once
    bands = written(bands.groupBy("members", "x", "s").agg(F.min("band").alias("band")).select("band", "members"), "minhash-bands")
    frequent = max(1, classes.count() * FREQUENT)
    with pruned_by_keys(docs.sparkSession):
        member = written(looked_up(member, bands, ["band"], "members", frequent, F.col("members") > 1), "minhash-members")
    wanted = member.groupBy("node").agg(F.sum("members").alias("shared"))
    wanted = written(wanted.join(classes.select("node", F.col("first.doc_id").alias("d"), F.col("first.content").alias("c")), "node"), "minhash-wanted")
    with pruned_by_keys(docs.sparkSession):
        sets = written(_shingled(docs, wanted.where("shared > 0"), k, ident, text), "minhash-sets")
    # from here on nodes sort by how many they share bands with, the most first: a family's hub is its bands' least, and its centre
    name = F.concat(F.unhex(F.lpad(F.hex(F.lit((1 << 62) - 1) - F.col("shared")), 16, "0")), F.col("node"))
    member = member.join(wanted.select("node", name.alias("name")), "node")
    member = written(member.select(F.col("name").alias("node"), "n", "band", "members"), "minhash-named")

    pivots = member.groupBy("band").agg(F.min(F.struct("node", "n")).alias("p"), F.max("members").alias("members"))
    pivots = written(pivots.select("band", "members", F.col("p.node").alias("pivot"), F.col("p.n").alias("n_p")), "minhash-pivots")
    near = (F.col("n") * den >= F.col("n_p") * num) & (F.col("n_p") * den >= F.col("n") * num)
    pairs = looked_up(member.drop("members"), pivots, ["band"], "members", frequent).where(near & (F.col("node") != F.col("pivot")))
    pairs = written(_ordered(pairs, "pivot", "node"), "minhash-pairs")
    now = stars(_verified(pairs, sets, num, den), "minhash-stars")

    rest = written(_unresolved(member, now, frequent), "minhash-rest")
    if rest.limit(1).count() == 0:
        return _unnamed(now)
    own = rest.withColumn("id", bare("node")).join(sets.withColumnRenamed("node", "id"), "id").select("node", "n", "label", "shingles")
    own = written(own, "minhash-rest-sets")
    seen = own.select("shingles").mapInArrow(_counts, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << COUNT_BITS, np.int64)  # a fixed number of counts, whatever the input
    counts[seen["slot"].to_numpy()] = seen["n"].to_numpy()
    rarity = docs.sparkSession.sparkContext.broadcast(counts)
    prefix = written(own.mapInArrow(partial(_prefixes, counts=rarity, num=num, den=den), "node binary, n long, label binary, shingle long, place long"), "minhash-prefixes")
    # a shingle within one component brings no link
    several = prefix.groupBy("shingle").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("rows")).where("a <> b").select("shingle", "rows")
    prefix = written(looked_up(prefix, written(several, "minhash-shingles"), ["shingle"], "rows", frequent), "minhash-prefixes")
    # both sides of a shingle are dealt to as many cells as it has rows over PER_CELL, so that its pairs are many tasks' work
    cells = F.greatest(F.lit(1), F.ceil(F.col("rows") / PER_CELL)).cast("int")
    left = prefix.withColumn("cell", F.pmod(F.xxhash64("node"), cells).cast("int"))
    right = prefix.select("shingle", F.col("node").alias("pivot"), F.col("n").alias("n_p"), F.col("label").alias("label_p"), F.col("place").alias("place_p"), F.explode(F.sequence(F.lit(0), cells - 1)).alias("cell"))
    # what both hold from their first common shingle on must make up the overlap that a link needs
    enough = F.least(F.col("n") - F.col("place"), F.col("n_p") - F.col("place_p")) * (num + den) >= num * (F.col("n") + F.col("n_p"))
    met = _ordered(left.join(right, ["shingle", "cell"]).where((F.col("node") < F.col("pivot")) & (F.col("label") != F.col("label_p")) & near & enough), "pivot", "node")
    fresh = _verified(written(met.join(pairs, ["u", "v"], "left_anti"), "minhash-pairs"), sets, num, den)
    return _unnamed(stars(now.union(fresh), "minhash-stars"))


def bare(name: str) -> Column:
    """The digest in a name."""
    return F.expr(f"substring({name}, 9)")


def _unnamed(edges: DataFrame) -> DataFrame:
    return edges.select(bare("u").alias("u"), bare("v").alias("v"))


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def _unresolved(member: DataFrame, now: DataFrame, frequent: float) -> DataFrame:
    """(node, n, label) of bands of three or more that hold more than one component: not all their pairs were compared."""
    labelled = member.where("members > 2").join(now.select(F.col("u").alias("node"), F.col("v").alias("__v")), "node", "left").withColumn("label", F.coalesce("__v", "node")).drop("__v")
    labelled = written(labelled, "minhash-labelled")
    several = labelled.groupBy("band").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.max("members").alias("members")).where("a <> b").select("band", "members")
    return looked_up(labelled.drop("members"), written(several, "minhash-several"), ["band"], "members", frequent).select("node", "n", "label").distinct()


def _shingled(docs: DataFrame, wanted: DataFrame, k: int, ident: str, text: str) -> DataFrame:
    """(node, shingles): the full sets of wanted (node, d, c), one text each."""
    texts = docs.select(row_name(ident, text).alias("key"), F.col(text).cast("string").alias("text"))
    key = F.concat(F.col("c").cast("string"), F.coalesce(F.concat(F.lit(":"), F.col("d").cast("string")), F.lit("")))
    texts = texts.join(wanted.select("node", key.alias("key")), "key").select("key", "node", "text")
    # rows that repeat an id and a text give a set once; they are together already
    nth = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    return texts.withColumn("nth", nth).where("nth = 1").select("node", "text").mapInArrow(partial(_sets, k=k), "node binary, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose full sets overlap enough. A hub's pairs are dealt to SLOTS slots, each with one copy of its set."""
    named = pairs.select("u", "v", bare("u").alias("i"), bare("v").alias("j"), F.pmod(F.xxhash64("v"), F.lit(SLOTS)).cast("int").alias("slot"))
    right = named.join(sets.select(F.col("node").alias("j"), F.col("shingles").alias("b")), "j").select("u", "v", "slot", "i", "b")
    left = named.select("i", "slot").distinct().join(sets.select(F.col("node").alias("i"), F.col("shingles").alias("a")), "i")
    return right.join(left, ["i", "slot"]).select("u", "v", "a", "b").mapInArrow(partial(_links, num=num, den=den), "u binary, v binary")


def keep_one_each(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100), ident: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group, the one with the least id; rows that repeat its id and text are dropped too.

    Keys of what goes, and of rows that repeat, meet the documents in one join that deals each text once, at every size alike: the
    keys grow with the documents, so they are not broadcast.
    """
    found = near_duplicates(docs, k, threshold, ident, text).select("kept", F.concat(F.col("content").cast("string"), F.coalesce(F.concat(F.lit(":"), F.col("doc_id").cast("string")), F.lit(""))).alias("__key"))
    special = written(found.groupBy("__key").agg(F.min("kept").alias("__kept"), F.count("*").alias("n")).where("not __kept or n > 1").drop("n"), "minhash-dropped")
    own = docs.withColumn("__key", row_name(ident, text)).join(special.hint("merge"), "__key", "left").where("coalesce(__kept, true)")
    # rows that repeat an id and a text are together already
    nth = F.row_number().over(Window.partitionBy("__key").orderBy("__key"))
    return own.withColumn("__nth", nth).where("__nth = 1").select(*docs.columns)
