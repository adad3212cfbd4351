"""URL filters: host and path rules, and for the rest the ratio of two character language models.

URLs that a rule allows or blocks train one smoothed variable-order Markov model each: the probability of a character
after three others, backed off through shorter contexts. A URL that no rule fits is judged by the length-normalised
difference of its log-likelihoods against a threshold calibrated on the allowed ones. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import broadcast_within, cut

#: Rules as verdict, host and path; the longest that fits wins.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Characters of an n-gram: three of context and the one that follows.
ORDER = 4
#: How many observations the shorter context's estimate weighs, and the characters that are alike before any are seen.
PRIOR, ALPHABET = 4.0, 256
#: The share of allowed URLs that may lie below the threshold.
FALSE_BLOCKS = 0.01
#: Log-ratios are summed as whole numbers of this fraction, so that the order of summing doesn't matter.
SCALE = 1_000_000
#: N-grams up to which the model is broadcast (some 60 bytes each); a larger one is joined by n-gram.
BROADCAST_GRAMS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_START, _END = "\x02", "\x03"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path; both empty for a null or a URL without ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    known = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(known, parts, 1), _UPPER, _LOWER), F.regexp_extract(known, parts, 2)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """``(verdict, rule)`` of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule_host + rule_path).alias("rule"))).otherwise(out)
    return out


def gram_ratios(grams: DataFrame) -> DataFrame:
    """``(gram, ratio)`` from ``(gram, allowed, blocked)`` counts: the scaled log-ratio of its last character.

    A position has one n-gram of full order, so the counts of shorter ones and of contexts are sums over it.
    """
    totals = grams.agg(F.sum("allowed"), F.sum("blocked")).first()
    model = None
    for size in range(1, ORDER + 1):
        tails = grams.groupBy(F.right("gram", F.lit(size)).alias("tail")).agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b"))
        if model is None:
            joined = tails.withColumns({"ta": F.lit(totals[0] or 0), "tb": F.lit(totals[1] or 0), "pa": F.lit(1 / ALPHABET), "pb": F.lit(1 / ALPHABET)})
        else:
            context = F.substring(F.right("gram", F.lit(size)), 1, size - 1).alias("context")
            contexts = grams.groupBy(context).agg(F.sum("allowed").alias("ta"), F.sum("blocked").alias("tb"))
            shorter = model.withColumnsRenamed({"tail": "shorter"})
            joined = tails.withColumns({"context": F.substring("tail", 1, size - 1), "shorter": F.right("tail", F.lit(size - 1))}).join(contexts, "context").join(shorter, "shorter")
        model = joined.select(
            "tail",
            ((F.col("a") + PRIOR * F.col("pa")) / (F.col("ta") + PRIOR)).alias("pa"),
            ((F.col("b") + PRIOR * F.col("pb")) / (F.col("tb") + PRIOR)).alias("pb"),
        )
    return model.select(F.col("tail").alias("gram"), F.round((F.ln("pa") - F.ln("pb")) * SCALE).cast("long").alias("ratio"))


def judge_urls(
    pages: DataFrame,
    *,
    rules: Sequence[tuple[str, str, str]] = RULES,
    false_blocks: float = FALSE_BLOCKS,
    id_col: str = "page_id",
    url_col: str = "url",
    broadcast_grams: int = BROADCAST_GRAMS,
) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, score``.

    ``score`` is the log-likelihood difference per character (above 0: more like allowed URLs). Where no rule fits,
    scores below the threshold are blocked; the threshold leaves at most ``false_blocks`` of the allowed URLs below
    it. Without allowed or blocked URLs to learn from, such pages are allowed. A null URL, and one without ``://``,
    has an empty host and path and is judged like any other. Repeated rows and null ids stay; an empty table gives no
    rows.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    ruled = rows.withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("text", F.concat("host", "path"))
    texts = cut(
        ruled.groupBy("text").agg(
            F.count(F.when(F.col("fit.verdict") == "allow", 1)).alias("allowed"),
            F.count(F.when(F.col("fit.verdict") == "block", 1)).alias("blocked"),
        )
    )
    padded = F.concat(F.lit(_START * (ORDER - 1)), "text", F.lit(_END))
    at = texts.select("text", "allowed", "blocked", padded.alias("padded")).select("*", F.explode(F.sequence(F.lit(1), F.length("padded") - ORDER + 1)).alias("i"))
    places = at.select("text", "allowed", "blocked", F.substr("padded", F.col("i"), F.lit(ORDER)).alias("gram"))
    ratios = cut(gram_ratios(cut(places.groupBy("gram").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")))))
    model, _ = broadcast_within(ratios, broadcast_grams)
    total = places.select("text", "gram").join(model, "gram").groupBy("text").agg((F.sum("ratio") / F.count("*") / SCALE).alias("score"))
    scored = cut(texts.join(total, "text"))

    bins = scored.where("allowed > 0").groupBy(F.floor(F.col("score") * 1000).alias("bin")).agg(F.sum("allowed").alias("n")).orderBy("bin").collect()
    trained = scored.agg(F.sum("allowed"), F.sum("blocked")).first()
    threshold, below = float("-inf"), 0
    if trained[0] and trained[1]:
        for row in bins:  # at most a few tens of thousand: scores are bounded by the smoothing
            below += row.n
            if below > false_blocks * trained[0]:
                threshold = row.bin / 1000
                break
    method = F.when(F.col("score") < threshold, "block").otherwise("allow")
    return (
        ruled.join(scored.select("text", "score"), "text")
        .select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"), "score")
    )
