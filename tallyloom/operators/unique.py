"""Cases drawn until all of them differ."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.shared import cut


def unique_cases(cases: DataFrame, make: Callable[[DataFrame], DataFrame], key: str, rounds: int = 100) -> DataFrame:
    """``make(cases)`` with every ``key`` once: cases that lose their key to a smaller one are made again, with ``attempt`` one up.

    ``cases`` holds ``case``; ``make`` sees ``case, attempt`` and adds ``key`` (and more). Each round joins the new keys
    against all accepted ones and is cut by a checkpoint; a round handles what the last one left, which shrinks fast.
    """
    waiting, accepted, before = cases.withColumn("attempt", F.lit(0)), None, cases.count()
    for _ in range(rounds):
        made = cut(make(waiting))
        made = made if accepted is None else made.withColumn("_key", F.col(key)).join(accepted.select(F.col(key).alias("_key")), "_key", "left_anti").drop("_key")
        firsts = made.groupBy(key).agg(F.min("case").alias("case"))
        new = cut(made.join(firsts, [key, "case"]))
        accepted = new if accepted is None else accepted.unionByName(new)
        left = cut(waiting.join(new.select("case"), "case", "left_anti").withColumn("attempt", F.col("attempt") + 1))
        now = left.count()
        if not now:
            return accepted
        waiting, before = left, now
    raise ValueError(f"{before} cases are not unique after {rounds} draws")
