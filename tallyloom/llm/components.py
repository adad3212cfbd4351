"""Connected components of a link table, as alternating large-star and small-star passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import cut
from tallyloom.operators.skew import join_uneven

#: Links up to which the nodes' least neighbours are broadcast (at most two rows a link, some 16 bytes each).
BROADCAST_LINKS = 200_000
#: Links of a partition (16 bytes each): a few links aren't dealt to as many tasks as the documents are.
LINKS_PER_PART = 50_000


def by_size(links: DataFrame, n: int) -> DataFrame:
    """``links``, of which there are ``n``, in no more partitions than their number asks for; one partition is not shuffled by later steps."""
    return links.coalesce(max(1, -(-n // LINKS_PER_PART)))


def _joined(rows: DataFrame, least: DataFrame, links: int) -> DataFrame:
    """``rows`` with their node's least neighbour. A star's centre is one key of many rows, so it is never shuffled by."""
    return rows.join(F.broadcast(least.drop("held")), "u") if links <= BROADCAST_LINKS else join_uneven(rows, least, "u", "held", 2 * links)


def _rows(links: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """A row ``(u, v)`` of each of the ``pairs`` of columns, by one scan."""
    return links.select(F.inline(F.array(*(F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs))))


def _large_star(links: DataFrame, n: int) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest node around it. A node's links are never gathered: its least neighbour is an aggregate, joined back."""
    both = _rows(links, ("u", "v"), ("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"), F.count_if(F.col("v") > F.col("u")).alias("held"))
    return _joined(both.where(F.col("v") > F.col("u")), least, n).select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(links: DataFrame, n: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, move to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("held"))
    return _rows(_joined(down, least, n), ("v", "least"), ("u", "least")).where("u != v")


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``links (u, v)``; a component is named by its smallest node.

    Links to itself are dropped; repeated links count once; an empty table gives no rows. Each round is written to
    the shared checkpoint folder. The rounds grow with the logarithm of the longest path.
    """
    now = cut(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return _rows(by_size(now, state[0]), ("u", "v"), ("v", "v")).distinct().toDF("node", "component")
        before, now = state, by_size(now, state[0])
        now = cut(_small_star(_large_star(now, state[0]), state[0]).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
