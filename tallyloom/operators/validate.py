"""Rules on single records, duplicate and contradiction checks, and dataset statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom import schema as S
from tallyloom.functions.text import normalize_all
from tallyloom.operators.skew import join_uneven
from tallyloom.operators.expand import input_hashes, labels


def _blank(text: Column) -> Column:
    return text.isNull() | (F.length(F.regexp_replace(text, r"(?U)\s+", "")) == 0)


def _text_rule(text: Column, most: int) -> Column:
    return _blank(text) | (F.length(text) > most)


def _distinct(texts: Column) -> Column:
    return F.size(F.array_distinct(normalize_all(texts))) == F.size(texts)


def record_errors() -> Column:
    """Codes of the rules that a record (schema ``EXAMPLE``) breaks, in a fixed order; none for a valid one."""
    q, t, p = F.col("question"), F.col("target"), F.col("provenance")
    kind = q["type"]
    texts = F.transform(q["options"], lambda o: o["description"])
    within = lambda values, bounds: F.coalesce(F.size(values).between(*bounds), F.lit(False))
    only = lambda name: F.coalesce(F.array_size(F.filter(F.array(t["label"].cast("string"), t["class_id"], t["level_index"].cast("string")), lambda x: x.isNotNull())) == 1, F.lit(False)) & t[name].isNotNull()
    path = F.replace(F.col("image_path"), F.lit("\\"), F.lit("/"))
    bad_path = F.col("image_path").isNotNull() & ((F.length("image_path") == 0) | path.startswith("/") | F.col("image_path").contains(":") | F.array_contains(F.split(path, "/"), ".."))
    rules: list[tuple[str, Column]] = [
        ("schema_version", ~F.col("schema_version").eqNullSafe(S.SCHEMA_VERSION)),
        *((name, ~F.coalesce(F.col(name).rlike(S.IDENTIFIER), F.lit(False))) for name in ("id", "group_id", "task_family")),
        ("language", ~F.coalesce(F.col("language").isin(*S.LANGUAGES), F.lit(False))),
        ("state", _text_rule(F.col("state"), S.MAX_STATE) | (F.col("state_kind").isin("object", "array") & F.col("state").isin("{}", "[]"))),
        ("image_path", bad_path),
        ("question_type", ~F.coalesce(kind.isin(*S.TYPES), F.lit(False))),
        ("instructions", _text_rule(q["instructions"], S.MAX_INSTRUCTIONS)),
        ("options", (kind == S.CHOICE) & ~within(q["options"], S.CHOICE_OPTIONS)),
        ("option_text", (kind == S.CHOICE) & F.exists(q["options"], lambda o: _text_rule(o["description"], S.MAX_CRITERION) | ~F.coalesce(o["id"].rlike(S.IDENTIFIER), F.lit(False)))),
        ("option_repeated", (kind == S.CHOICE) & (~_distinct(texts) | (F.size(F.array_distinct(F.transform(q["options"], lambda o: o["id"]))) != F.size(q["options"])))),
        ("levels", (kind == S.ORDINAL) & ~within(q["levels"], S.ORDINAL_LEVELS)),
        ("level_text", (kind == S.ORDINAL) & F.exists(q["levels"], lambda d: _text_rule(d, S.MAX_CRITERION))),
        ("level_repeated", (kind == S.ORDINAL) & ~_distinct(q["levels"])),
        ("target_kind", ~F.when(kind == S.BINARY, only("label")).when(kind == S.CHOICE, only("class_id")).when(kind == S.ORDINAL, only("level_index")).otherwise(True)),
        ("target_label", (kind == S.BINARY) & ~t["label"].isin(0, 1)),
        ("target_class", (kind == S.CHOICE) & ~F.exists(q["options"], lambda o: o["id"] == t["class_id"])),
        ("target_level", (kind == S.ORDINAL) & ~t["level_index"].between(F.lit(0), F.size(q["levels"]) - 1)),
        ("provenance", ~F.coalesce(p["source"].isin(*S.SOURCES), F.lit(False)) | _blank(p["generator_version"]) | _blank(p["label_method"])),
        ("review_status", p["review_status"].isNotNull() & ~p["review_status"].isin(*S.REVIEWS)),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(code)) for code, broken in rules]), lambda c: c.isNotNull())


def classify_duplicates(df: DataFrame, key: str, label: str, group: str, ident: str) -> DataFrame:
    """One row per row whose ``key`` others share: ``key, ident, n, kind, level``. Rows of a null key count as sharing it.

    Different labels, and equal labels in different groups, are errors; within one group a warning. A key's rows are
    counted, not gathered, so a key may hold any share of the table.
    """
    grouped = df.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(F.coalesce(F.col(label).cast("string"), F.lit("\0"))).alias("l"), F.count_distinct(group).alias("g"))
    kind = F.when(F.col("l") > 1, "labels").when(F.col("g") > 1, "groups").otherwise("within_group")
    named = F.struct(F.col(key)).alias("_key")  # so that a null key is a key
    shared = grouped.where("n > 1").select(named, "n", kind.alias("kind"), F.when(kind == "within_group", "warning").otherwise("error").alias("level"), F.col("n").alias("_held"))
    rows = df.select(key, ident, named)
    return join_uneven(rows, shared, "_key", "_held", df.count()).select(key, ident, "n", "kind", "level")


def dataset_checks(examples: DataFrame) -> DataFrame:
    """``check, level, key, id``: repeated ids; equal inputs and equal serialisations by what differs; single-class types."""
    named = labels(examples).join(input_hashes(examples), "id").join(examples.select("id", "group_id", F.col("question.type").alias("type")), "id")
    repeated = examples.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated_id").alias("check"), F.lit("error").alias("level"), F.lit(None).cast("string").alias("key"), "id")
    raw = classify_duplicates(named, "model_input", "label", "group_id", "id").select(F.concat(F.lit("same_input_"), "kind").alias("check"), "level", F.col("model_input").alias("key"), "id")
    alike = named.groupBy("serialized_input").agg(F.count_distinct("model_input").alias("_inputs")).where("_inputs > 1").select("serialized_input")
    same = classify_duplicates(named.join(alike, "serialized_input", "left_semi"), "serialized_input", "semantic_key", "group_id", "id")
    single = named.groupBy("type").agg(F.count_distinct("description").alias("n")).where("n = 1").select(F.concat(F.lit("single_class_"), "type").alias("check"), F.lit("warning").alias("level"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("id"))
    return repeated.unionByName(raw).unionByName(same.select(F.concat(F.lit("same_serialisation_"), "kind").alias("check"), "level", F.col("serialized_input").alias("key"), "id")).unionByName(single)


def counts_by(df: DataFrame, **columns: str | Column) -> DataFrame:
    """``statistic, value, n``: rows by each of the named columns."""
    pairs = F.array(*[F.struct(F.lit(name).alias("statistic"), (F.col(c) if isinstance(c, str) else c).cast("string").alias("value")) for name, c in columns.items()])
    return df.select(F.explode(pairs).alias("s")).groupBy("s.statistic", "s.value").agg(F.count("*").alias("n"))


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    """Histogram of the groups' sizes: ``size, groups``."""
    return df.groupBy(group).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def contrasting_groups(df: DataFrame, group: str, kind: str, label: str) -> DataFrame:
    """``groups`` in which some type has more than one label, of ``total`` groups."""
    seen = df.groupBy(group, kind).agg((F.count_distinct(label) > 1).alias("c")).groupBy(group).agg(F.bool_or("c").alias("c"))
    return seen.agg(F.count_if("c").alias("groups"), F.count("*").alias("total"))


def dataset_statistics(examples: DataFrame) -> DataFrame:
    """All counts of a dataset as ``statistic, value, n``."""
    named = examples.join(labels(examples).select("id", "description"), "id").withColumn("type", F.col("question.type"))
    counted = counts_by(named, type="type", language="language", task_family="task_family", label=F.concat_ws(":", "type", "description"))
    sizes = group_sizes(named, "group_id").select(F.lit("questions_per_group").alias("statistic"), F.col("size").cast("string").alias("value"), F.col("groups").alias("n"))
    contrast = contrasting_groups(named, "group_id", "type", "description").select(F.lit("groups_with_contrasting_labels").alias("statistic"), F.lit(None).cast("string").alias("value"), F.col("groups").alias("n"))
    totals = named.agg(F.count("*").alias("examples"), F.count_distinct("group_id").alias("groups"), F.count("image_path").alias("with_image"), F.count_distinct("image_path").alias("distinct_images"))
    flat = totals.select(F.explode(F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(c).alias("n")) for c in totals.columns])).alias("s")).select("s.statistic", F.lit(None).cast("string").alias("value"), "s.n")
    return counted.unionByName(sizes).unionByName(contrast).unionByName(flat)
