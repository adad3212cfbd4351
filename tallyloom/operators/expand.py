"""Questions to candidate rows: canonical option order, fixed template, row hashes, target positions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import escape, normalize_all
from tallyloom.schema import BINARY, CHOICE, ORDINAL


@dataclass(frozen=True)
class Template:
    """The versioned frame of a row. Changing any part of it needs a new ``version``, which enters every row hash."""

    version: str = "text-v1"
    tag: str = "evaluation"
    image_placement: str = "image-before-text"
    tasks: dict[str, str] = field(
        default_factory=lambda: {
            BINARY: "From the state alone, decide whether the question is answered by yes.",
            CHOICE: "From the state alone, decide whether the candidate is the right option for the question.",
            ORDINAL: "From the state alone, decide whether the level shown is the right one for the question.",
        }
    )


DEFAULT = Template()


def canonical_options(options: Column) -> Column:
    """Options by normalised description, then id: the same for any order in which they were given."""
    keys = normalize_all(F.transform(options, lambda o: o["description"]))
    ordered = F.array_sort(F.zip_with(keys, options, lambda k, o: F.struct(k.alias("key"), o["id"].alias("id"), o["description"].alias("description"))))
    return F.transform(ordered, lambda o: F.struct(o["id"].alias("id"), o["description"].alias("description")))


def row_hash(text: Column, image: Column, template: Template = DEFAULT) -> Column:
    plain = F.concat_ws("\n", F.lit(template.version), text)
    return F.sha2(F.when(image.isNull(), plain).otherwise(F.concat_ws("\n", F.lit(template.version), F.lit(template.image_placement), image, text)), 256)


def _element(name: str, index: Column, text: Column) -> Column:
    return F.concat(F.lit(f'<{name} index="'), index.cast("string"), F.lit('">'), escape(text), F.lit(f"</{name}>"))


def expand(examples: DataFrame, template: Template = DEFAULT, *, images: str = "keep") -> DataFrame:
    """Candidate rows of ``examples`` (schema ``EXAMPLE``): one of a binary question, K of a choice, M of an ordinal one.

    Every row carries the whole list of options or levels. Only state, question and image enter a row's text and hash.
    ``images="omit"`` drops the image, a control that leaves the text as it is.
    """
    if images not in ("keep", "omit"):
        raise ValueError("images is keep or omit")
    q = F.col("question")
    image = F.col("image_path") if images == "keep" else F.lit(None).cast("string")
    options = examples.withColumns({"_options": canonical_options(F.coalesce(q["options"], F.array().cast("array<struct<id:string,description:string>>"))), "_image": image})
    candidates = (
        F.when(q["type"] == CHOICE, F.transform("_options", lambda o: F.struct(o["id"].alias("id"), o["description"].alias("text"))))
        .when(q["type"] == ORDINAL, F.transform(q["levels"], lambda d: F.struct(F.lit(None).cast("string").alias("id"), d.alias("text"))))
        .otherwise(F.array(F.struct(F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("text"))))
    )
    rows = options.withColumn("_all", candidates).select("*", F.posexplode("_all").alias("_i", "_c"))
    choice, ordinal = q["type"] == CHOICE, q["type"] == ORDINAL
    listed = lambda name: F.array_join(F.transform("_all", lambda c, i: _element(name, i, c["text"])), "\n")
    body = (
        F.when(choice, F.concat_ws("\n", F.lit("<options>"), listed("option"), F.lit("</options>"), _element("candidate", F.col("_i"), F.col("_c.text"))))
        .when(ordinal, F.concat_ws("\n", F.lit("<rubric>"), listed("level"), F.lit("</rubric>"), _element("evaluated-level", F.col("_i"), F.col("_c.text"))))
    )
    task = F.lit(None).cast("string")
    for name, sentence in template.tasks.items():
        task = F.when(q["type"] == name, F.lit(sentence)).otherwise(task)
    text = F.concat_ws(
        "\n",
        F.lit(f'<{template.tag} version="{template.version}">'), F.lit("<state>"), escape(F.col("state")), F.lit("</state>"),
        F.concat(F.lit('<question type="'), q["type"], F.lit('">')), F.lit("<instructions>"), escape(q["instructions"]), F.lit("</instructions>"),
        body, F.lit("</question>"), F.concat(F.lit("<task>"), task, F.lit("</task>")), F.lit(f"</{template.tag}>"),
    )
    return rows.withColumn("text", text).select(
        "id",
        "group_id",
        q["type"].alias("question_type"),
        F.when(q["type"] != BINARY, F.col("_i")).alias("candidate_index"),
        F.col("_c.id").alias("candidate_id"),
        F.size("_all").alias("n_candidates"),
        "text",
        F.col("_image").alias("image"),
        row_hash(F.col("text"), F.col("_image"), template).alias("row_sha256"),
    )


def target_index(examples: DataFrame) -> DataFrame:
    """``id, target_index``: the label, the class's place in canonical order, or the level; null if it isn't there."""
    q, t = F.col("question"), F.col("target")
    place = F.array_position(F.transform(canonical_options(q["options"]), lambda o: o["id"]), t["class_id"]) - 1
    index = F.when(q["type"] == BINARY, t["label"]).when(q["type"] == CHOICE, F.when(place >= 0, place)).otherwise(t["level_index"])
    return examples.select("id", index.cast("int").alias("target_index"))


def labels(examples: DataFrame) -> DataFrame:
    """``id, label, description, semantic_key``: the raw label, its text, and a key that ids and option order don't change."""
    q, t = F.col("question"), F.col("target")
    chosen = F.get(F.filter(q["options"], lambda o: o["id"] == t["class_id"]), F.lit(0))["description"]
    level = F.get(q["levels"], t["level_index"])
    raw = F.coalesce(t["label"].cast("string"), t["class_id"], t["level_index"].cast("string"))
    text = F.when(q["type"] == BINARY, t["label"].cast("string")).when(q["type"] == CHOICE, chosen).otherwise(level)
    return examples.select("id", raw.alias("label"), text.alias("description"), F.concat_ws(":", q["type"], F.get(normalize_all(F.array(text)), F.lit(0))).alias("semantic_key"))


def input_hashes(examples: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """``id, model_input, serialized_input``: hashes of the raw question and state, and of the ordered candidate rows."""
    raw = examples.select("id", F.sha2(F.to_json(F.struct("state", "state_kind", "image_path", "question"), {"ignoreNullFields": "false"}), 256).alias("model_input"))
    rows = expand(examples, template).groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("candidate_index", F.lit(0)), "row_sha256"))).alias("r"))
    return raw.join(rows.select("id", F.sha2(F.array_join("r.row_sha256", "\n"), 256).alias("serialized_input")), "id")
