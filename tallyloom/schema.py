"""Explicit schemas of the decision data, and the limits that validation enforces."""

from __future__ import annotations

from pyspark.sql import types as T

# Version, names, limits and patterns of the data contract.
SCHEMA_VERSION = 1
#: Question types: yes/no, one of several options, one of several ordered levels.
BINARY, CHOICE, ORDINAL = "binary", "choice", "ordinal"
TYPES = (BINARY, CHOICE, ORDINAL)
LANGUAGES = ("es", "en")
SOURCES = ("synthetic_rule", "human", "llm_distillation", "fixture")
REVIEWS = ("unreviewed", "reviewed", "rejected")
CHOICE_OPTIONS, ORDINAL_LEVELS = (2, 8), (2, 5)
MAX_INSTRUCTIONS, MAX_CRITERION, MAX_STATE, MAX_DEPTH = 2000, 500, 20_000, 8
IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9._:\-]{0,127}$"
IMAGE_REFERENCE = r"^images/[0-9a-f]{64}\.(png|jpg|jpeg)$"
MAX_IMAGE_BYTES, MAX_IMAGE_PIXELS = 5 * 1024 * 1024, 16_000_000
SPLITS = ("train", "validation", "calibration", "test")
SPLIT_RATIOS = {"validation": 0.1, "calibration": 0.1, "test": 0.1}

OPTION = T.StructType([T.StructField("id", T.StringType()), T.StructField("description", T.StringType())])
QUESTION = T.StructType(
    [T.StructField("type", T.StringType()), T.StructField("instructions", T.StringType()), T.StructField("options", T.ArrayType(OPTION)), T.StructField("levels", T.ArrayType(T.StringType()))]
)
TARGET = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("class_id", T.StringType()), T.StructField("level_index", T.IntegerType())])
PROVENANCE = T.StructType(
    [T.StructField(n, T.LongType() if n == "seed" else T.StringType()) for n in ("source", "generator_version", "label_method", "template_id", "seed", "model", "model_revision", "prompt_id", "review_status")]
)
#: ``state`` is the canonical text; ``state_kind`` tells text, object and array apart.
EXAMPLE = T.StructType(
    [T.StructField("schema_version", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("id", "group_id", "task_family", "language", "state", "state_kind", "image_path")]
    + [T.StructField("question", QUESTION), T.StructField("target", TARGET), T.StructField("provenance", PROVENANCE)]
)
ROW = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "group_id", "question_type")]
    + [T.StructField("candidate_index", T.IntegerType()), T.StructField("candidate_id", T.StringType()), T.StructField("n_candidates", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("text", "image", "row_sha256")]
)
PREDICTION = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "group_id", "task_family", "language", "type")]
    + [T.StructField("target_index", T.IntegerType()), T.StructField("input_sha256", T.StringType()), T.StructField("target_description", T.StringType())]
    + [T.StructField("row_logits", T.ArrayType(T.DoubleType())), T.StructField("nll", T.DoubleType()), T.StructField("correct", T.BooleanType())]
)
