"""Linear heads of the three question types, trained by mini-batches of AdamW over candidates' vectors.

The questions of an epoch are put in an order by a hash of seed, epoch and id, cut into steps and written to the shared
folder by step, so that a step reads its own questions only. Its gradient is summed within the tasks, question lengths
together in one product, and between them by Spark, in a fixed order; the driver holds the weights and their moments. After each
step the state can be saved; a run that was stopped goes on from there to the same weights.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.fit import best_epoch
from tallyloom.operators.split import hash_ranks
from tallyloom.schema import BINARY, CHOICE, ORDINAL
from tallyloom.sources.snapshots import Snapshots

TYPES = (BINARY, CHOICE, ORDINAL)
BETAS, EPSILON = (0.9, 0.999), 1e-8
#: Questions of a step that one task writes and reads.
TASK_QUESTIONS = 20_000


@dataclass(frozen=True)
class TrainParams:
    """``select_on`` "validation" takes the first epoch of least validation NLL, "train" the last one."""

    epochs: int = 10
    questions_per_step: int = 64
    learning_rate: float = 1e-3
    weight_decay: float = 0.01
    rps_weight: float = 0.0
    type_weights: dict[str, float] = field(default_factory=lambda: dict.fromkeys(TYPES, 1.0))
    select_on: str = "validation"
    seed: int = 0
    save_every: int = 1

    def __post_init__(self) -> None:
        if min(self.epochs, self.questions_per_step, self.save_every) < 1 or self.select_on not in ("validation", "train"):
            raise ValueError(f"not trainable: {self}")


@dataclass
class State:
    """Where a run stands: the weights (types x dimensions and the bias), their moments, and the next step."""

    weights: np.ndarray
    mean: np.ndarray
    square: np.ndarray
    updates: int = 0
    epoch: int = 1
    step: int = 0
    losses: list[float] = field(default_factory=list)
    history: list[dict] = field(default_factory=list)
    best: np.ndarray | None = None
    best_nll: float = math.inf

    def as_json(self) -> dict:
        return {k: v.tolist() if isinstance(v, np.ndarray) else (None if v == math.inf else v) if k == "best_nll" else v for k, v in vars(self).items()}

    @classmethod
    def from_json(cls, told: dict) -> State:
        arrays = {k: None if told[k] is None else np.array(told[k]) for k in ("weights", "mean", "square", "best")}
        return cls(**{**told, **arrays, "best_nll": math.inf if told["best_nll"] is None else told["best_nll"]})


@dataclass
class Trained:
    """``heads`` (question_type, weights, bias), the history table and the epoch that was taken."""

    heads: DataFrame
    history: DataFrame
    epoch: int
    weights: np.ndarray


def losses_and_pulls(kind: str, z: np.ndarray, target: np.ndarray, rps_weight: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """NLL, loss, and the loss's derivative by each logit, for the logits (questions, candidates) of one length."""
    if kind == BINARY:
        p = np.exp(-np.logaddexp(0, -z))
        nll = np.logaddexp(0, z[:, 0]) - target * z[:, 0]
        return nll, nll, p - target[:, None]
    high = z.max(axis=1, keepdims=True)
    log_p = z - high - np.log(np.exp(z - high).sum(axis=1, keepdims=True))
    p, own = np.exp(log_p), (np.arange(len(z)), target)
    nll, pull = -log_p[own], p.copy()
    pull[own] -= 1
    if kind == CHOICE or not rps_weight:
        return nll, nll, pull
    levels = z.shape[1]
    miss = np.cumsum(p, axis=1)[:, :-1] - (target[:, None] <= np.arange(levels - 1))
    back = np.zeros_like(p)
    back[:, :-1] = np.cumsum((2 * miss / (levels - 1))[:, ::-1], axis=1)[:, ::-1]
    pull += rps_weight * p * (back - (p * back).sum(axis=1, keepdims=True))
    return nll, nll + rps_weight * (miss**2).sum(axis=1) / (levels - 1), pull


def _by_length(batch: pa.RecordBatch, dimensions: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """The questions of a batch by type and number of candidates: vectors (questions, candidates, dimensions) and targets."""
    kinds, vectors = np.array(batch.column("question_type").to_pylist(), dtype=object), batch.column("vectors")
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = vectors.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    targets = batch.column("target_index").to_numpy(zero_copy_only=False).astype(np.int64)
    for kind in TYPES:
        for size in np.unique(sizes[kinds == kind]).tolist():
            at = np.flatnonzero((kinds == kind) & (sizes == size))
            yield kind, flat[starts[at][:, None] + np.arange(size)], targets[at]


def _gradient(weights: np.ndarray, params: TrainParams):
    """One row per weight and task: the sum of weighted losses' derivatives; the losses themselves at place -1."""
    dimensions = weights.shape[1] - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slope, total, part = np.zeros_like(weights), 0.0, 0
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for kind, x, target in _by_length(batch, dimensions):
                head, scale = TYPES.index(kind), params.type_weights[kind]
                _, loss, pull = losses_and_pulls(kind, x @ weights[head, :-1] + weights[head, -1], target, params.rps_weight)
                total += scale * float(loss.sum())
                slope[head, :-1] += scale * np.einsum("nk,nkd->d", pull, x)
                slope[head, -1] += scale * float(pull.sum())
        places = np.arange(-1, slope.size)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), part)), pa.array(places), pa.array(np.append(total, slope.ravel()))], ["part", "place", "value"])

    return run


def _summed(rows: DataFrame, weights: np.ndarray, params: TrainParams) -> tuple[float, np.ndarray]:
    """Loss and gradient summed over ``rows``; tasks' sums are added in the order of their partitions."""
    told = rows.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(_gradient(weights, params), "part long, place long, value double")
    ordered = F.array_sort(F.collect_list(F.struct("part", "value")))  # one value a task of the step
    total = F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x["value"])
    values = np.zeros(weights.size + 1)
    for r in told.groupBy("place").agg(total.alias("value")).collect():
        values[r.place + 1] = r.value
    return float(values[0]), values[1:].reshape(weights.shape)


def mean_nll(questions: DataFrame, weights: np.ndarray) -> dict[str, float | None]:
    """Mean NLL of all questions and of each type (None for a type without any)."""
    dimensions = weights.shape[1] - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(len(TYPES)), np.zeros(len(TYPES), dtype=np.int64)
        for batch in batches:
            for kind, x, target in _by_length(batch, dimensions):
                head = TYPES.index(kind)
                sums[head] += losses_and_pulls(kind, x @ weights[head, :-1] + weights[head, -1], target, 0.0)[0].sum()
                counts[head] += len(target)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(TYPES))), pa.array(sums), pa.array(counts)], ["head", "nll", "n"])

    told = {r["head"]: (r["nll"], r["n"]) for r in questions.select("question_type", "vectors", "target_index").mapInArrow(run, "head long, nll double, n long").groupBy("head").agg(F.sum("nll").alias("nll"), F.sum("n").alias("n")).collect()}
    n = sum(c for _, c in told.values())
    out: dict[str, float | None] = {"all": sum(s for s, _ in told.values()) / n if n else None}
    return out | {kind: told[i][0] / told[i][1] if told.get(i, (0, 0))[1] else None for i, kind in enumerate(TYPES)}


def adamw(state: State, slope: np.ndarray, heads: np.ndarray, params: TrainParams) -> None:
    """One step of AdamW on the weights of ``heads``; the decay is apart from the gradient."""
    state.updates += 1
    state.mean[heads] = BETAS[0] * state.mean[heads] + (1 - BETAS[0]) * slope[heads]
    state.square[heads] = BETAS[1] * state.square[heads] + (1 - BETAS[1]) * slope[heads] ** 2
    step = state.mean[heads] / (1 - BETAS[0] ** state.updates)
    spread = np.sqrt(state.square[heads] / (1 - BETAS[1] ** state.updates)) + EPSILON
    state.weights[heads] = state.weights[heads] * (1 - params.learning_rate * params.weight_decay) - params.learning_rate * step / spread


def epoch_steps(questions: DataFrame, params: TrainParams, epoch: int, folder: str) -> tuple[DataFrame, int]:
    """The epoch's questions with their ``step``, read back from ``folder`` by step, and the number of steps.

    The order is that of a hash of seed, epoch and id. The folder is used as it is if it was written to the end.
    """
    spark = questions.sparkSession
    path = f"{folder}/epoch-{epoch:05d}"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        key = F.sha2(F.concat_ws(":", F.lit(params.seed), F.lit(epoch), F.col("id").cast("string")), 256)
        ranked, _ = hash_ranks(questions, key)
        step = F.floor(F.col("_rank") / params.questions_per_step).cast("long")
        salt = F.floor(F.col("_rank") % params.questions_per_step / TASK_QUESTIONS)
        dealt = ranked.select("id", "question_type", "vectors", "target_index", step.alias("step"), salt.alias("_salt")).repartition("step", "_salt")
        dealt.drop("_salt").sortWithinPartitions("step", "id").write.mode("overwrite").partitionBy("step").parquet(path)
    written = spark.read.schema("id string, question_type string, vectors array<array<double>>, target_index int, step long").parquet(path)
    return written, written.select(F.max("step")).first()[0] + 1


def check_questions(questions: DataFrame) -> tuple[int, int, list[str]]:
    """The vectors' dimensions, the number of questions and the types present; a ``ValueError`` tells what can't be trained on."""
    rows, size = F.col("vectors"), F.size("vectors")
    target = F.col("target_index")
    told = questions.agg(
        F.count("*").alias("n"),
        F.min(F.size(F.element_at(rows, 1))).alias("dimensions"),
        F.array_sort(F.collect_set("question_type")).alias("types"),
        F.count_if(F.col("id").isNull()).alias("ids that are null"),
        F.count_if(~F.coalesce(F.col("question_type").isin(*TYPES), F.lit(False))).alias("unknown types"),
        F.count_if(F.coalesce((F.col("question_type") == BINARY) != (size == 1), F.lit(True)) | F.coalesce(size < 1, F.lit(True))).alias("wrong numbers of candidates"),
        F.count_if(F.coalesce((target < 0) | (target >= F.when(F.col("question_type") == BINARY, 2).otherwise(size)), F.lit(True))).alias("targets out of range"),
    ).first().asDict()
    n, dimensions, types = told.pop("n"), told.pop("dimensions"), told.pop("types")
    sound = F.forall(rows, lambda v: v.isNotNull() & (F.size(v) == F.lit(dimensions)) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    told["vectors of other lengths or without numbers"] = questions.where(~F.coalesce(sound, F.lit(False))).count()
    if wrong := {k: v for k, v in told.items() if v}:
        raise ValueError(f"questions can't be trained on: {wrong}")
    if not n:
        raise ValueError("no questions to train on")
    return dimensions, n, types


def _plain(questions: DataFrame) -> DataFrame:
    return questions.select(F.col("id").cast("string").alias("id"), "question_type", F.col("vectors").cast("array<array<double>>").alias("vectors"), F.col("target_index").cast("int").alias("target_index"))


def data_digest(questions: DataFrame) -> str:
    """A digest of all questions that their order doesn't change: their hashes' sum, and their number."""
    row = questions.agg(F.count("*"), F.sum(F.xxhash64("id", "question_type", F.to_json("vectors"), "target_index").cast("decimal(38,0)"))).first()
    return hashlib.sha256(json.dumps([str(v) for v in row]).encode()).hexdigest()


def train_heads(questions: DataFrame, params: TrainParams, *, validation: DataFrame | None = None, folder: str, resume: bool = False, stop_after: int | None = None) -> Trained | None:
    """Train a head for each type in ``questions (id, question_type, vectors, target_index)``; the other heads stay zero.

    A step's loss is the mean over its questions of the type's weight times the NLL, plus ``rps_weight`` times the ranked
    probability score of ordinal ones. Weights start at zero, which doesn't matter for a convex loss. Ids should differ;
    questions of one id have no fixed order between them. Null or malformed questions are an error, and so is an empty
    table or a gradient that isn't finite. Columns other than the four are ignored.

    Epochs and snapshots are written to ``folder``, which driver and tasks share. With ``resume`` the run goes on after
    the last step that a snapshot holds, if parameters and questions are the same (else a ``ValueError``).
    ``stop_after`` ends it after as many steps, with its snapshot saved and None returned.
    """
    if params.select_on == "validation" and validation is None:
        raise ValueError("choosing the epoch by validation needs validation questions")
    spark = questions.sparkSession
    rows, held = _plain(questions), None if validation is None else _plain(validation)
    dimensions, n, types = check_questions(rows)
    if held is not None and check_questions(held)[0] != dimensions:
        raise ValueError("validation vectors have another length")
    heads = np.array([TYPES.index(t) for t in types])
    key = {"params": asdict(params), "data": data_digest(rows), "validation": None if held is None else data_digest(held)}
    kept = Snapshots(spark, f"{folder}/snapshots", hashlib.sha256(json.dumps(key, sort_keys=True).encode()).hexdigest())
    shape = (len(TYPES), dimensions + 1)
    told = kept.latest() if resume else None
    state = State.from_json(told) if told else State(np.zeros(shape), np.zeros(shape), np.zeros(shape))
    if not resume:
        kept.begin()
        orders = f"{folder}/orders-{uuid.uuid4().hex}"
        kept.note({"orders": orders})
    else:
        orders = kept.noted()["orders"]

    done = 0
    while state.epoch <= params.epochs:
        ordered, steps = epoch_steps(rows, params, state.epoch, orders)
        while state.step < steps:
            of_step = ordered.where(F.col("step") == state.step)
            size = min(params.questions_per_step, n - state.step * params.questions_per_step)
            loss, slope = _summed(of_step, state.weights, params)
            slope /= size
            if not np.isfinite(slope).all():
                raise ValueError(f"the gradient isn't finite in epoch {state.epoch}, step {state.step}")
            adamw(state, slope, heads, params)
            state.losses.append(loss / size)
            state.step += 1
            done += 1
            if done == stop_after or (state.step % params.save_every == 0 and state.step < steps):
                kept.save(state.as_json())
            if done == stop_after:
                return None
        record = {"epoch": state.epoch, "steps": steps, "train_loss": sum(state.losses) / len(state.losses), "train_nll": mean_nll(rows, state.weights), "validation_nll": None if held is None else mean_nll(held, state.weights)}
        state.history.append(record)
        score = record["validation_nll"]["all"] if params.select_on == "validation" else -float(state.epoch)
        if score < state.best_nll:
            state.best_nll, state.best = score, state.weights.copy()
        state.epoch, state.step, state.losses = state.epoch + 1, 0, []
        kept.save(state.as_json())
    return _result(spark, state, types, params)


def _result(spark: SparkSession, state: State, types: list[str], params: TrainParams) -> Trained:
    heads = spark.createDataFrame([(t, state.best[TYPES.index(t), :-1].tolist(), float(state.best[TYPES.index(t), -1])) for t in types], "question_type string, weights array<double>, bias double")
    flat = [(r["epoch"], r["steps"], r["train_loss"], *(r["train_nll"][k] for k in ("all", *TYPES)), *((r["validation_nll"] or {}).get(k) for k in ("all", *TYPES))) for r in state.history]
    names = ", ".join(f"{side}_nll_{k} double" for side in ("train", "validation") for k in ("all", *TYPES))
    history = spark.createDataFrame(flat, f"epoch int, steps long, train_loss double, {names}")
    chosen = best_epoch(history.select("epoch", F.col("validation_nll_all").alias("nll"))).first()["epoch"] if params.select_on == "validation" else params.epochs
    return Trained(heads, history, chosen, state.best)


def binary_questions(df: DataFrame, ident: str, vector: str, label: str) -> DataFrame:
    """Labelled vectors as binary questions of one candidate each, for the head of yes or no alone."""
    return df.select(F.col(ident).cast("string").alias("id"), F.lit(BINARY).alias("question_type"), F.array(F.col(vector)).cast("array<array<double>>").alias("vectors"), F.col(label).cast("int").alias("target_index"))
