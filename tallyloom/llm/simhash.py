"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint is eight positional bytes. Fingerprints that differ in at most two bits share at least six of them, the
guaranteed minimum. The inverted index posts each fingerprint under all 28 choices of six positional bytes, so that two
fingerprints meet exactly if they share six, in as many lists as there are such choices. For each pair that meets the
positions of its lists are tallied; pairs of six or more are verified by their differing bits.

A posting list holds one fingerprint for every value of the two other bytes at most. One of more than ``list_limit`` is
posted once more: each of its fingerprints under the values within one bit of its two other bytes (17 rows). Two are
within two bits exactly if some value is within one bit of both, so the (at most 17) fingerprints that meet there are
linked to the least of them, which keeps the components exact with rows in proportion to the list.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import cut, frugal, small_batches, split_words, text_slices
from tallyloom.llm.components import connected_components
from tallyloom.operators.skew import join_uneven

SEED = 42
RADIUS = 2
#: Positional bytes that two fingerprints within the radius share at least.
LEAST_SHARED_BYTES = 8 - RADIUS
#: Entries up to which a posting list is paired off; longer lists are posted once more.
LIST_LIMIT = 32
#: Shingles hashed at once, so that a very long text takes bounded memory.
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """The text's 64-bit SimHash, unsigned. Fewer words than a shingle: the whole sequence is the shingle; no words: 0."""
    words = split_words(text)
    words = [w.lower() for w in words]
    if not words:
        return 0
    count = max(1, len(words) - shingle_words + 1)
    votes = np.zeros(64, dtype=np.int64)
    for start in range(0, count, CHUNK):
        size = min(CHUNK, count - start)
        part = words[start : start + size + shingle_words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(shingle_words)))) if len(words) >= shingle_words else [b" ".join(words)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=size)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > count, bitorder="little").view("<u8")[0])


def _fingerprints(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                prints = np.array([fingerprint(t.as_py(), shingle_words) for t in part.column(1)], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(prints.view(np.int64))], ["doc_id", "print", "fp"])

    return run


def fingerprints(docs: DataFrame, *, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, print, fp)``: every document's fingerprint as a signed long, and a hash of its text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("print"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("print", T.LongType()), T.StructField("fp", T.LongType())])
    small_batches(rows.sparkSession)
    return rows.mapInArrow(frugal(_fingerprints(shingle_words)), schema)


#: The pairs of positions that a posting leaves out, the mask of the other six bytes, and these positions as bits.
_LEFT_OUT = [(i, j) for i in range(8) for j in range(i + 1, 8)]


def _signed(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("long")


def _byte(value: Column, i: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, 8 * i).bitwiseAND(F.lit(0xFF))


def postings(prints: DataFrame) -> DataFrame:
    """``(fp, choice, six)``: every fingerprint under each choice of six positional bytes."""
    choices = [F.struct(F.lit(n).alias("choice"), F.col("fp").bitwiseAND(_signed(~(0xFF << 8 * i | 0xFF << 8 * j) & (1 << 64) - 1)).alias("six")) for n, (i, j) in enumerate(_LEFT_OUT)]
    return prints.select("fp", F.explode(F.array(*choices)).alias("p")).select("fp", "p.choice", "p.six")


def fingerprint_links(prints: DataFrame, list_limit: int = LIST_LIMIT) -> DataFrame:
    """``(u, v)`` links whose components are those of all pairs of ``fp`` within two differing bits; ``fp`` is distinct."""
    lists = postings(prints).groupBy("choice", "six").agg(F.collect_list("fp").alias("fps"))  # at most 65,536 each
    lists = cut(lists.where(F.size("fps") > 1))
    positions = F.element_at(F.array(*[F.lit(0xFF & ~(1 << i | 1 << j)) for i, j in _LEFT_OUT]), F.col("choice") + 1)

    short = lists.where(F.size("fps") <= list_limit).select(positions.alias("shared"), "fps")
    met = short.select("shared", F.explode("fps").alias("u"), "fps").select("shared", "u", F.explode("fps").alias("v")).where("u > v")
    tallied = met.groupBy("u", "v").agg(F.bit_or("shared").alias("shared")).where(F.bit_count("shared") >= LEAST_SHARED_BYTES)
    near = tallied.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)

    low = F.element_at(F.array(*[F.lit(i) for i, _ in _LEFT_OUT]), F.col("choice") + 1)
    high = F.element_at(F.array(*[F.lit(j) for _, j in _LEFT_OUT]), F.col("choice") + 1)
    flips = F.array(F.lit(0), *[F.lit(1 << i) for i in range(16)])
    crowded = lists.where(F.size("fps") > list_limit).select("choice", "six", low.alias("low"), high.alias("high"), F.explode("fps").alias("fp"))
    own = (_byte(F.col("fp"), F.col("low")) * 256 + _byte(F.col("fp"), F.col("high"))).cast("int")
    around = crowded.withColumn("own", own).select("choice", "six", "fp", F.explode(F.transform(flips, lambda bit: F.col("own").bitwiseXOR(bit))).alias("value"))
    centres = around.groupBy("choice", "six", "value").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)  # at most 17 each
    hubs = centres.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).where("u != v")
    return near.select("u", "v").unionByName(hubs)


def near_duplicates(docs: DataFrame, *, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text", list_limit: int = LIST_LIMIT) -> DataFrame:
    """One row per document: ``doc_id, print, fp, component, component_id``.

    ``component_id`` is the smallest id that links of at most two bits reach, ``component`` the group's own number and
    ``print`` a hash of the text, which tells rows of one id apart.

    Texts are compared by their words in lower case (A-Z). A null, empty or blank text has fingerprint 0 and is linked
    like any other; a text of any length is read whole. A null id is kept; its component is named by the smallest id
    that is not null (null if none is). Repeated rows stay. An empty table gives no rows; other columns are not read,
    whatever their names.
    """
    prints = cut(fingerprints(docs, shingle_words=shingle_words, id_col=id_col, text_col=text_col))
    rows = prints.count()
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("held")))
    joined = connected_components(fingerprint_links(distinct.select("fp"), list_limit))
    linked = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = linked.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members"))
    by_fingerprint = join_uneven(linked.select("fp", "held", "component"), named, "component", "members", rows)
    return join_uneven(prints, by_fingerprint, "fp", "held", rows).select("doc_id", "print", "fp", "component", "component_id")
