"""Exact deduplication: compressed radix tries over whole texts find who owns each.

Every task first inserts its own rows' texts into a trie, so that a text leaves it once, however many copies it has.
These texts are dealt by their length and content hash into partitions, and each partition's trie, whose terminal nodes
hold the owner's id and the copies, compares whole byte strings: two texts of one hash have two terminals. A trie that
outgrows its bound gives up its largest subtrees, whose texts go on to the next pass over more partitions; so memory is
bounded whatever the table. Rows then find their text's owner by its SHA-256, which is part of the result.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections.abc import Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import cut, frugal, small_batches, text_slices
from tallyloom.operators.skew import join_uneven

#: Bytes of text, with TERMINAL_BYTES for each terminal, that one trie holds.
TRIE_BYTES, TERMINAL_BYTES = 48 << 20, 600
#: Bytes of the content hash in a key; the length takes eight more.
HASH_BYTES = 8

#: An id, null for none, the rows that have it, and all rows of the text.
Owner = tuple[int | None, int, int]


def merged(a: Owner, b: Owner, largest: bool) -> Owner:
    """The owner of two lots of copies: the larger or smaller id, any id before none."""
    if a[0] == b[0]:
        return a[0], a[1] + b[1], a[2] + b[2]
    wins = b[0] is None or a[0] is not None and (a[0] > b[0]) == largest
    best = a if wins else b
    return best[0], best[1], a[2] + b[2]


class Node:
    """What follows the parent's bytes, the children by their first byte, and the owner if a text ends here."""

    __slots__ = ("children", "edge", "gone", "key", "owner")

    def __init__(self, edge: bytes, owner: Owner | None = None, key: bytes | None = None) -> None:
        self.edge, self.owner, self.key = edge, owner, key
        self.children: dict[int, Node] = {}
        self.gone = False


class Trie:
    """A compressed radix trie of byte strings. ``insert`` says no to a string under a subtree that was given up."""

    def __init__(self, largest: bool) -> None:
        self.root, self.largest, self.size, self.texts, self.stubs = Node(b""), largest, 0, 0, 0

    def insert(self, text: bytes, owner: Owner, key: bytes) -> bool:
        node, at = self.root, 0
        while True:
            if node.gone:
                return False
            if at == len(text):
                break
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                self.size += len(child.edge) + TERMINAL_BYTES
                node, at = child, len(text)
                break
            edge = child.edge
            if not text.startswith(edge, at):
                child = self._split(node, child, text, at)
            node, at = child, at + len(child.edge)
        if node.owner is None:
            node.owner, node.key = owner, key
            self.texts += 1
        else:
            node.owner = merged(node.owner, owner, self.largest)
        return True

    @staticmethod
    def _split(node: Node, child: Node, text: bytes, at: int) -> Node:
        """A new node above ``child`` for the bytes that its edge shares with ``text``; they are halved to find how many."""
        edge, low, high = child.edge, 1, min(len(child.edge), len(text) - at)
        while low < high:
            middle = (low + high + 1) // 2
            if text.startswith(edge[:middle], at):
                low = middle
            else:
                high = middle - 1
        upper = Node(edge[:low])
        child.edge = edge[low:]
        upper.children[child.edge[0]] = child
        node.children[upper.edge[0]] = upper
        return upper

    @staticmethod
    def terminals(node: Node, above: bytes) -> Iterator[tuple[bytes, Node]]:
        """Every text from ``node`` down, and its terminal; ``above`` are the bytes before it."""
        waiting = [(node, above)]
        while waiting:
            node, above = waiting.pop()
            text = above + node.edge
            if node.owner is not None:
                yield text, node
            waiting.extend((child, text) for child in node.children.values())

    def _weights(self) -> dict[int, int]:
        """What each node takes with all below it, by the node's ``id()``."""
        order, waiting = [], [self.root]
        while waiting:
            order.append(node := waiting.pop())
            waiting.extend(node.children.values())
        found: dict[int, int] = {}
        for node in reversed(order):
            found[id(node)] = len(node.edge) + TERMINAL_BYTES + sum(found[id(c)] for c in node.children.values())
        return found

    def give_up(self, most: int, for_good: bool) -> Iterator[tuple[bytes, Node]]:
        """The texts of the largest subtrees of at most half of the trie, until it takes ``most`` bytes or holds one text.

        They leave the trie; ``for_good``, texts under them are turned away from then on.
        """
        weights = self._weights()
        whole = weights[id(self.root)]
        serial = itertools.count()
        heap = [(-weights[id(c)], next(serial), self.root, c, b"") for c in self.root.children.values() if not c.gone]
        heapq.heapify(heap)
        self.size = whole
        while heap and self.size > most and self.texts > 1:
            weight, _, parent, node, above = heapq.heappop(heap)
            below = [c for c in node.children.values() if not c.gone]
            if -2 * weight > whole and below:
                text = above + node.edge
                for child in below:
                    heapq.heappush(heap, (-weights[id(child)], next(serial), node, child, text))
                continue
            for given in list(self.terminals(node, above)):
                self.texts -= 1
                yield given
            self.size += weight
            if for_good:
                node.children, node.owner, node.gone = {}, None, True
                self.size += len(node.edge) + TERMINAL_BYTES
                self.stubs += len(node.edge) + TERMINAL_BYTES
            else:
                del parent.children[node.edge[0]]
        if self.stubs > most:  # what tells the subtrees that left fills the trie: it closes
            yield from list(self.everything())
            self.root, self.size, self.texts, self.stubs = Node(b""), 0, 0, 0
            self.root.gone = True

    def everything(self) -> Iterator[tuple[bytes, Node]]:
        return self.terminals(self.root, b"")


def content_key(text: bytes, hash_bytes: int) -> bytes:
    """The text's length and content hash, by which it is dealt."""
    return len(text).to_bytes(8, "big") + xxhash.xxh3_64_digest(text)[:hash_bytes]


def _normalised(part: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    """Ids and texts with A-Z in lower case; ``bytes.lower`` touches no other byte, and a null text is empty."""
    for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
        yield doc_id, text.encode().lower() if text else b""


class _Rows:
    """Collects rows of the given columns and hands them on as batches of limited size."""

    def __init__(self, schema: pa.Schema, most_bytes: int = 4 << 20) -> None:
        self.schema, self.most, self.rows, self.size = schema, most_bytes, [], 0

    def add(self, *row) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += 64 + sum(len(v) for v in row if isinstance(v, bytes))
        if self.size >= self.most:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = zip(*self.rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
        self.rows, self.size = [], 0


_OWNER = [("owner", pa.int64()), ("ties", pa.int64()), ("n", pa.int64())]
_TEXT_ROWS = pa.schema([("key", pa.binary()), ("text", pa.binary()), *_OWNER])
_OWNER_ROWS = pa.schema([("key", pa.binary()), ("text", pa.binary()), ("digest", pa.binary()), *_OWNER])
_OWNER_COLUMNS = "owner long, ties long, n long"


def _local(largest: bool, hash_bytes: int, trie_bytes: int):
    """Each task's distinct texts and their owners so far; a full trie passes a subtree on early, and may meet its texts again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = Trie(largest), _Rows(_TEXT_ROWS)
        for batch in batches:
            for part in text_slices(batch, "text"):
                for doc_id, text in _normalised(part):
                    trie.insert(text, (doc_id, 1, 1), content_key(text, hash_bytes))
                    if trie.size > trie_bytes:
                        for given, node in trie.give_up(trie_bytes // 2, for_good=False):
                            yield from out.add(node.key, given, *node.owner)
        for given, node in trie.everything():
            yield from out.add(node.key, given, *node.owner)
        yield from out.rest()

    return run


def _owners(largest: bool, trie_bytes: int):
    """The owner of each text of a partition, by the text's digest; texts that the trie gave up come as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = Trie(largest), _Rows(_OWNER_ROWS)
        for batch in batches:
            for part in text_slices(batch, "text"):
                for key, text, *owner in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if not trie.insert(text, tuple(owner), key):
                        yield from out.add(key, text, None, *owner)
                    if trie.size > trie_bytes:
                        for given, node in trie.give_up(trie_bytes // 2, for_good=True):
                            yield from out.add(node.key, given, None, *node.owner)
        for given, node in trie.everything():
            yield from out.add(None, None, hashlib.sha256(given).digest(), *node.owner)
        yield from out.rest()

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's id and digest, the columns that come along, and a number that no other row has."""
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        for part in text_slices(batch, "text"):
            digests = [hashlib.sha256(text).digest() for _, text in _normalised(part)]
            rows = pa.array(range(row, row + part.num_rows), pa.int64())
            row += part.num_rows
            yield pa.RecordBatch.from_arrays([rows, part.column(0), pa.array(digests, pa.binary()), *part.columns[2:]], ["row", "doc_id", "digest", *part.schema.names[2:]])


def text_owners(docs: DataFrame, *, largest: bool, hash_bytes: int = HASH_BYTES, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """``digest, owner, ties, n`` of each distinct text of ``docs (doc_id, text)``, written to the checkpoint folder.

    ``digest`` is the text's SHA-256, ``n`` its rows, and ``ties`` those of them that have the owner's id.
    """
    waiting = docs.mapInArrow(frugal(_local(largest, hash_bytes, trie_bytes)), f"key binary, text binary, {_OWNER_COLUMNS}").repartition("key")
    found = None
    while True:
        told = cut(waiting.mapInArrow(frugal(_owners(largest, trie_bytes)), f"key binary, text binary, digest binary, {_OWNER_COLUMNS}"))
        settled = told.where(F.col("key").isNull()).drop("key", "text")
        found = settled if found is None else found.unionByName(settled)
        left = told.where(F.col("key").isNotNull()).agg(F.count("*"), F.sum(F.length("text") + TERMINAL_BYTES)).first()
        if not left[0]:
            return found
        # all of a text's rows have one key, so they meet again, dealt anew into parts of half a trie's bound
        parts = max(2, -(-2 * left[1] // trie_bytes))
        waiting = told.where(F.col("key").isNotNull()).drop("digest").repartition(parts, F.col("key"), F.lit(parts))


def dedup_exact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", columns: Sequence[str] = (), hash_bytes: int = HASH_BYTES, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row of ``docs``, and ``columns`` of it in a struct ``own``.

    Texts are equal if their bytes are once A-Z are in lower case; a null text is empty. Of equal texts the row with the
    ``keep`` ("largest" or "smallest") id stays, any id before a null one; of several such rows one stays, the first in
    the order in which they were read. An empty table gives no rows. Other columns than those named aren't read, so
    their names can't clash. A very long text stands in a trie alone.

    A text leaves each task once and has one row in the table of owners. Rows are joined to that by the text's SHA-256,
    keys of very many rows by ``join_uneven``. The checkpoint folder takes some 50 bytes a row and the named columns.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep is 'largest' or 'smallest', not {keep!r}")
    small_batches(docs.sparkSession)
    own = [F.struct(*columns).alias("own")] if columns else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *own)
    owners = text_owners(rows.select("doc_id", "text"), largest=keep == "largest", hash_bytes=hash_bytes, trie_bytes=trie_bytes)
    kinds = "".join(f", own {kind}" for name, kind in rows.dtypes if name == "own")
    read = cut(rows.mapInArrow(frugal(_digests), f"row long, doc_id long, digest binary{kinds}"))

    total, ties = owners.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("ties"), F.lit(1))).first()
    held = owners.withColumn("held", F.col("n"))
    is_owner = F.col("doc_id").eqNullSafe(F.col("owner"))
    if ties > 1:
        several = join_uneven(read.select("row", "doc_id", "digest"), held.where("ties > 1").drop("ties", "n"), "digest", "held", total)
        first = several.where(is_owner).groupBy("digest").agg(F.min("row").alias("first"))
        held = cut(held.join(first, "digest", "left"))
    else:
        held = held.withColumn("first", F.lit(None).cast("long"))
    joined = join_uneven(read, held.drop("ties"), "digest", "held", total)
    return joined.select(
        "doc_id",
        F.col("owner").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.when(F.col("first").isNull(), is_owner).otherwise(F.col("row") == F.col("first")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *(["own"] if columns else []),
    )
