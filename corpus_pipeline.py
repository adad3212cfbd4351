"""A training corpus from documents in five stages, each applying one corpus operator.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before it kept. All stages but the last
return the columns of ``docs``. ``run`` applies them to the ``documents`` table, writing each stage's rows to the
shared folder before the next reads them.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.binpack import read_tokens, write_tokens
from tallyloom.llm.common import broadcast_within, cut, shared_dir, unused
from tallyloom.llm.decontam import contaminated
from tallyloom.llm.mixing import mix_sources
from tallyloom.llm.similar import similar_documents
from tallyloom.llm.toxicity import fit, score_documents

#: Scores from which a document is toxic.
TOXIC_FROM = 0.7
#: Ids of byte_bpe_50k.json.
VOCABULARY = 50_257
#: Rows of (document, decision) up to which they are broadcast to the documents (some 20 bytes each).
BROADCAST_DECISIONS = 500_000


def _with(docs: DataFrame, decisions: DataFrame, how: str = "inner") -> tuple[DataFrame, list[Column]]:
    """``docs`` joined to ``decisions`` by the id and a hash of the text (``doc_id, print``), so that decisions on texts
    that share an id stay apart; and the columns of ``docs`` in the joined table."""
    print_ = unused("_print", docs.columns)
    keyed = docs.withColumn(print_, F.xxhash64(F.coalesce("text", F.lit(""))))
    named, _ = broadcast_within(decisions.withColumnsRenamed({c: f"decided_{c}" for c in decisions.columns}), BROADCAST_DECISIONS)
    same = keyed["doc_id"].eqNullSafe(named["decided_doc_id"]) & (keyed[print_] == named["decided_print"])
    return keyed.join(named, same, how), [keyed[c] for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below ``TOXIC_FROM``. The model learns from the labelled rows of ``docs``.

    Null and empty texts have a score like any other, equal rows the same one; an empty table gives no rows. A text of
    any length is scored over all its windows.
    """
    score = unused("_score", docs.columns)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model, keep=docs.columns, score_col=score).where(F.col(score) < TOXIC_FROM).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, a similarity of 0.8 or more), the one of the
    smallest id (of rows that share it, one).

    Null, empty and blank texts are one group. A group of null ids alone keeps one of its rows.
    """
    first = similar_documents(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    rows = first.groupBy("component", "doc_id", "print").agg(F.count("*").alias("rows"))
    kept = rows.groupBy("component").agg(F.min_by(F.struct("doc_id", "print", "rows"), "print").alias("k")).select("k.*")
    chosen, columns = _with(docs, cut(kept))
    once = chosen.where("decided_rows > 1").select(columns).dropDuplicates(["doc_id", "text"])
    return chosen.where("decided_rows = 1").select(columns).unionByName(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; null and empty texts hold none, and equal rows go or stay together."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    clean, columns = _with(docs, found.select("doc_id", "print").distinct(), "left_anti")
    return clean.select(columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; one that the mix leaves out goes.

    Null and empty texts have no words and are repeated with their whole source only. Rows of one id and text share the
    copies that the mix takes of them, each as many as any other or one more.
    """
    times = mix_sources(docs).groupBy("doc_id", "print").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    joined, columns = _with(docs, times)
    own, each = unused("_own", docs.columns), unused("_each", docs.columns)
    among = F.row_number().over(Window.partitionBy("decided_doc_id", "decided_print").orderBy(F.xxhash64(*columns)))
    share = F.floor(F.col("decided_copies") / F.col("decided_rows")) + (among <= F.col("decided_copies") % F.col("decided_rows")).cast("long")
    single = joined.where("decided_rows = 1").select(*columns, F.col("decided_copies").alias(own))
    equal = joined.where("decided_rows > 1").select(*columns, share.alias(own))
    taken = single.unionByName(equal).where(F.col(own) > 0)
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), own)).alias(each)).drop(each)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as packed token ids; returns what is read back of every document: id, start, tokens, checksum.

    A null or empty text is the end id alone; repeated rows are documents of their own; null ids come last.
    """
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    write_tokens(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), vocabulary=VOCABULARY)
    return read_tokens(spark, folder)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("token_output", pack),
]

#: The network, the components and the knapsack cannot be written in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{number}-{name}")
            docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
