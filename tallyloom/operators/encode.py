"""Text to vectors through a port: length-sorted batches, right padding, the state of each row's last token."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.prepare import longest_first
from tallyloom.operators.score import encode_cached
from tallyloom.operators.shared import cut

#: A model: token ids and mask (rows, longest) to states (rows, longest, dimensions). It must not look to the right of a token.
Model = Callable[[np.ndarray, np.ndarray], np.ndarray]


def last_states(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The state of each row's last token that the mask keeps; a row without one is an error."""
    if not mask.any(axis=1).all():
        raise ValueError("a row has no tokens")
    last = mask.shape[1] - 1 - np.argmax(mask[:, ::-1], axis=1)
    return states[np.arange(len(states)), last]


def batch_plan(rows: DataFrame, ident: str, tokens: str, batch_rows: int) -> DataFrame:
    """``rows`` with ``n_tokens, batch, place, padded_to``: batches of rows in order of length, longest first.

    ``padded_to`` is the length of the batch's longest row. Rows are placed by counts of lengths, not by sorting them.
    """
    sized = rows.withColumn("n_tokens", F.size(tokens))
    placed = longest_first(sized, F.col("n_tokens"), ident, batch_rows)
    widest = placed.groupBy("batch").agg(F.max("n_tokens").alias("padded_to"))
    return placed.join(widest, "batch")


def counters(plan: DataFrame) -> DataFrame:
    """``rows, longest, forwards, valid_tokens, padding_tokens`` of a batch plan; nothing is encoded for it."""
    return plan.agg(
        F.count("*").alias("rows"),
        F.max("n_tokens").alias("longest"),
        F.count_distinct("batch").alias("forwards"),
        F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("long").alias("valid_tokens"),
        F.coalesce(F.sum(F.col("padded_to") - F.col("n_tokens")), F.lit(0)).cast("long").alias("padding_tokens"),
    )


def _encode(model: Model):
    def forward(idents: list, tokens: list[np.ndarray], longest: int) -> pa.RecordBatch:
        ids = np.zeros((len(tokens), longest), dtype=np.int64)
        mask = np.zeros(ids.shape, dtype=bool)
        for i, own in enumerate(tokens):
            ids[i, : len(own)], mask[i, : len(own)] = own, True
        pooled = last_states(model(ids, mask), mask)
        if not np.isfinite(pooled).all():
            raise ValueError("a vector isn't finite")
        return pa.RecordBatch.from_arrays([pa.array(idents), pa.array(pooled.astype(np.float32).tolist(), pa.list_(pa.float32()))], ["ident", "features"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, idents, tokens, longest = None, [], [], 0
        for batch in batches:  # tokens stay in Arrow's arrays; a model's batch is copied from them
            for i, (number, ident, padded) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("batch", "ident", "padded_to")))):
                if tokens and held != number:
                    yield forward(idents, tokens, longest)
                    idents, tokens = [], []
                idents.append(ident)
                tokens.append(batch.column("tokens")[i].values.to_numpy())
                held, longest = number, padded
            tokens = [own.copy() for own in tokens]
        if tokens:
            yield forward(idents, tokens, longest)

    return run


def encode_rows(rows: DataFrame, tokens: Column, model: Model, *, ident: str = "row_sha256", max_tokens: int, batch_rows: int = 8) -> tuple[DataFrame, DataFrame]:
    """``ident, features`` of every row, and the counters of the work.

    Rows of more than ``max_tokens`` tokens, or without any, are an error that says how many there are: no text is cut.
    Batches go whole to a task. ``model`` sees right-padded batches; as it never looks to the right, a row's vector doesn't
    depend on the rows it is padded with. Ids must differ. An empty table gives no rows and zero counters.
    """
    plan = cut(batch_plan(rows.select(F.col(ident), tokens.alias("tokens")), ident, "tokens", batch_rows))
    told = plan.agg(F.count_if(F.col("n_tokens") > max_tokens).alias("long"), F.count_if(F.col("n_tokens") < 1).alias("none")).first()
    if told["long"] or told["none"]:
        raise ValueError(f"{told['long']} rows have more than {max_tokens} tokens, {told['none']} have none")
    kind = rows.schema[ident].dataType.simpleString()
    dealt = plan.select("batch", F.col(ident).alias("ident"), "tokens", "padded_to").repartition("batch").sortWithinPartitions("batch", "ident")
    vectors = dealt.mapInArrow(_encode(model), f"ident {kind}, features array<float>").withColumnRenamed("ident", ident)
    return vectors, counters(plan)


def encode_missing(rows: DataFrame, tokens: Column, model: Model, cache: str, fingerprint: str, *, max_tokens: int, batch_rows: int = 8) -> tuple[DataFrame, DataFrame]:
    """``row_sha256, features`` of every row, of which only those that the cache misses are encoded; and the work's counters.

    ``rows`` holds ``row_sha256`` and ``text``, which ``tokens`` reads.
    """
    found: list[DataFrame] = []

    def encoder(misses: DataFrame) -> DataFrame:
        vectors, counted = encode_rows(misses, tokens, model, max_tokens=max_tokens, batch_rows=batch_rows)
        found.append(counted)
        return vectors

    out = encode_cached(rows, cache, fingerprint, encoder)
    return out, found[0]


def word_ids(text: Column | str, vocabulary: int) -> Column:
    """A text's words as ids, by a hash: 1 up to ``vocabulary``. A stand-in for a tokenizer."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > 0)
    return F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % vocabulary + 1).cast("int"))


def recurrent_states(dimensions: int, decay: float = 0.5) -> Model:
    """A small deterministic model: a token's state is its own vector and ``decay`` times the state before it."""
    steps = 2 * np.arange(dimensions) + 1

    def model(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        own = (ids[:, :, None] * steps % 1009) / 1009.0
        out = np.zeros_like(own)
        state = np.zeros((len(ids), dimensions))
        for t in range(ids.shape[1]):
            state = own[:, t] + decay * state
            out[:, t] = state
        return out

    return model
