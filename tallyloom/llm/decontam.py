"""Benchmark decontamination by SimHash over item-sized windows, in DataFrame functions only.

Every window of an item's size can only be similar to an item of that size if most of its shingles are such items'
shingles, of whichever of them. All windows that hold enough of these get a SimHash fingerprint, weighted by how often a
shingle occurs; starting at such a shingle (or ending with the document) loses none, since moving a window onto its
first shared shingle never lowers its similarity. Which item a window resembles is found by the fingerprint: items are
indexed by their size and by each of the blocks into which their fingerprint is cut, one more than the radius, so that
any two within the radius agree in a block (multi-index Hamming search). What is within the radius is verified by the
exact weighted Jaccard similarity of the shingles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import broadcast_within, cut
from tallyloom.llm.secretscan import let

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Differing bits up to which fingerprints count as near. At a similarity of 0.8 some 10 of 64 bits differ, give or take 3.
RADIUS = 22
#: Item shingles up to which they are broadcast (some 24 bytes each), items' blocks (some 40), items with their shingle
#: lists (some 400), and keys of the documents that hold windows (some 24).
BROADCAST_SHINGLES = 1_000_000
BROADCAST_BLOCKS = 500_000
BROADCAST_ITEMS = 20_000
BROADCAST_DOCUMENTS = 200_000
_BETWEEN = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _BETWEEN), lambda w: w != "")


def shingles_of(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order; none for fewer words."""
    one = lambda w, i: F.xxhash64(*[F.element_at(w, i + j) for j in range(size)])
    every = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: one(w, i))
    return let(words, lambda w: F.when(F.size(w) >= size, every(w)).otherwise(F.array().cast("array<bigint>")))


def simhash(shingles: Column) -> Column:
    """The 64-bit fingerprint: a bit is set if it is set in over half of the shingles, repeats included."""
    ones = lambda b: F.size(F.filter(shingles, lambda h: F.getbit(h, b) == 1))
    bit = lambda b: F.when(2 * ones(b) > F.size(shingles), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(bit(b)))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two lists of shingles, each counted as often as it occurs."""
    times = lambda values, x: F.size(F.filter(values, lambda y: y == x))
    shared = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(times(a, x), times(b, x)))
    return let(shared, lambda s: s / (F.size(a) + F.size(b) - s))


def _edges(count: int) -> list[tuple[int, int]]:
    """Where each of ``count`` blocks of nearly equal length begins, and its mask."""
    edges = [64 * i // count for i in range(count + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:])]


def _blocks(fingerprint: Column, count: int) -> Column:
    """``array<struct<block, value>>``: the fingerprint's bits in ``count`` runs."""
    cut_out = lambda a, mask: F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit(mask))
    return F.array(*[F.struct(F.lit(i).alias("block"), cut_out(a, mask).alias("value")) for i, (a, mask) in enumerate(_edges(count))])


def _first_agreeing(differing: Column, count: int) -> Column:
    """The first block in which no bit differs."""
    return F.coalesce(*[F.when(F.shiftrightunsigned(differing, a).bitwiseAND(F.lit(mask)) == 0, i) for i, (a, mask) in enumerate(_edges(count))])


def _starts(places: Column, total: Column, window: Column, least: Column) -> Column:
    """Where windows begin that hold at least ``least`` of the sorted ``places``, among ``total`` shingles."""
    last = total - window
    enough = lambda j: F.element_at(places, F.least(F.size(places), (j + least).cast("int")))
    inner = F.filter(places, lambda p, j: (p <= last) & (j + least <= F.size(places)) & (enough(j) < p + window))
    at_end = (F.size(places) >= least) & (F.element_at(places, F.greatest(F.lit(1), (F.size(places) - least + 1).cast("int"))) >= last)
    return F.array_distinct(F.concat(inner, F.when(at_end, F.array(last)).otherwise(F.array().cast("array<int>"))))


def _windows(rows: DataFrame, items: DataFrame, size: int, similarity: float) -> DataFrame:
    """``(doc_id, print, length, start, window)``: the windows that may resemble an item of ``length`` shingles."""
    shingled = rows.select("doc_id", "print", shingles_of(words_of(F.col("text")), size).alias("all"))
    places = shingled.select("doc_id", "print", F.size("all").alias("total"), F.posexplode("all").alias("place", "shingle"))
    listed, _ = broadcast_within(items.select(F.size("item").alias("length"), F.explode(F.array_distinct("item")).alias("shingle")).distinct(), BROADCAST_SHINGLES)
    met = places.join(listed, "shingle").groupBy("doc_id", "print", "length").agg(F.first("total").alias("total"), F.array_sort(F.collect_set("place")).alias("places"))
    window = F.least("total", "length")
    least = F.ceil((window + F.col("length")) * (similarity / (1 + similarity)) - 1e-9)
    held = cut(met.select("doc_id", "print", "length", window.alias("window"), F.explode(_starts(F.col("places"), F.col("total"), window, least)).alias("start")))
    wanted, _ = broadcast_within(held.select("doc_id", "print").distinct(), BROADCAST_DOCUMENTS)
    same = rows["doc_id"].eqNullSafe(wanted["doc_id"]) & (rows["print"] == wanted["print"])
    texts = rows.join(wanted, same, "left_semi").dropDuplicates(["doc_id", "print"])
    whole = texts.select(F.col("doc_id").alias("d"), F.col("print").alias("p"), shingles_of(words_of(F.col("text")), size).alias("all"))
    sliced = held.join(whole, held["doc_id"].eqNullSafe(whole["d"]) & (held["print"] == whole["p"]))
    return sliced.select("doc_id", "print", "length", "start", F.slice("all", F.col("start") + 1, F.col("window")).alias("window"))


def _near(marked: DataFrame, prints: DataFrame, radius: int) -> DataFrame:
    """``(number, named, distance)`` of all windows and items of their size whose fingerprints are within ``radius``.

    A pair agrees in one block at least; where it agrees in several, the first one counts.
    """
    posted = prints.select("named", "kind", "length", "item_print", F.explode(_blocks(F.col("item_print"), radius + 1)).alias("at"))
    sought = marked.select("number", "kind", "length", "window_print", F.explode(_blocks(F.col("window_print"), radius + 1)).alias("at"))
    met = sought.join(broadcast_within(posted, BROADCAST_BLOCKS)[0], ["kind", "length", "at"])
    differing = F.col("window_print").bitwiseXOR(F.col("item_print"))
    near = met.where((F.bit_count(differing) <= radius) & (_first_agreeing(differing, radius + 1) == F.col("at.block")))
    return near.select("number", "named", F.bit_count(differing).cast("int").alias("distance"))


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    *,
    shingle_words: int = SHINGLE_WORDS,
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document and item found in it: ``doc_id, print, item_id, similarity, start, words, distance``.

    ``start`` is the first word of the most similar window (of those that begin with a shingle of an item of that size
    or end with the document; the first one where several are as similar), ``words`` its length. A text shorter than
    the item is one window; a text of any length has all its windows. Items of fewer than ``shingle_words`` words are
    one shingle. Items and texts that are null or without words match nothing; repeated items count once for each id.
    Rows of one id and text give the same result once; ``print`` (a hash of the text) tells texts of one id apart. A
    null document id is kept, a null item id is left out. Empty tables give no rows. Other columns are not read,
    whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("print", F.xxhash64(F.coalesce("text", F.lit(""))))
    named = items.select(F.col(item_col).alias("item_id"), words_of(F.col(item_text_col)).alias("words")).where(F.col("item_id").isNotNull())
    named = cut(named.where(F.size("words") > 0).dropDuplicates(["item_id", "words"]).withColumn("size", F.least(F.size("words"), F.lit(shingle_words))))
    parts, indexed = [], []
    for size in sorted(r["size"] for r in named.select("size").distinct().collect()):  # at most shingle_words of them
        own = cut(named.where(F.col("size") == size).select("item_id", shingles_of(F.col("words"), size).alias("item")))
        parts.append(_windows(rows, own, size, similarity).withColumn("kind", F.lit(size)))
        indexed.append(own.withColumn("kind", F.lit(size)))
    if not parts:
        kind = rows.schema["doc_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, print long, item_id long, similarity double, start int, words int, distance int")
    union = lambda dfs: reduce(DataFrame.unionByName, dfs)

    listed = cut(union(indexed).withColumns({"which": F.xxhash64("item"), "length": F.size("item")}))
    prints = listed.select("kind", "length", F.struct("item_id", "which").alias("named"), simhash(F.col("item")).alias("item_print")).distinct()
    marked = cut(union(parts).withColumns({"window_print": simhash(F.col("window")), "number": F.monotonically_increasing_id()}))
    near = _near(marked, prints, radius).select("number", "named.item_id", "named.which", "distance")
    shingles, _ = broadcast_within(listed.select("item_id", "which", "kind", "item"), BROADCAST_ITEMS)
    both = marked.join(near, "number").join(shingles, ["item_id", "which", "kind"])
    verified = both.select("*", weighted_similarity(F.col("window"), F.col("item")).alias("similarity")).where(F.col("similarity") >= similarity)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), (F.size("window") + F.col("kind") - 1).alias("words"), "distance")).alias("best")
    return verified.groupBy("doc_id", "print", "item_id").agg(best).select(
        "doc_id", "print", "item_id", "best.similarity", (-F.col("best.back")).alias("start"), "best.words", "best.distance"
    )
