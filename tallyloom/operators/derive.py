"""Control datasets derived from others: widened and balanced options, swapped states, triplets, altered questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.generate import CATEGORIES, DISTRACTORS, REAL_KINDS, option_id, true_category, uniform
from tallyloom.operators.split import hash_ranks
from tallyloom.schema import CHOICE_OPTIONS


def _text(category: Column) -> Column:
    out = F.lit(None).cast("string")
    for name in CATEGORIES["en"]:
        out = F.when(category == name, F.when(F.col("language") == "es", CATEGORIES["es"][name]).otherwise(CATEGORIES["en"][name])).otherwise(out)
    return out


def _category(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for texts in CATEGORIES.values():
        for name, t in texts.items():
            out = F.when(text == t, name).otherwise(out)
    return out


def _shuffled(names: Column, seed: int, tag: str) -> Column:
    keyed = F.array_sort(F.transform(names, lambda c: F.struct(F.xxhash64(F.lit(seed), F.lit(tag), "id", c).alias("h"), c.alias("c"))))
    return F.transform(keyed, lambda s: s["c"])


def _options(seed: int, tag: str, names: Column) -> Column:
    return F.transform(names, lambda c: F.struct(option_id(seed, tag, F.col("id"), c).alias("id"), _text(c).alias("description")))


def _replace(df: DataFrame, options: Column, class_id: Column | None = None) -> DataFrame:
    out = df.withColumn("question", F.col("question").withField("options", options))
    return out if class_id is None else out.withColumn("target", F.col("target").withField("class_id", class_id))


def _fault_questions(df: DataFrame) -> DataFrame:
    return df.where((F.col("task_family") == "fault_type") & F.col("question.options").isNotNull())


def _widen(df: DataFrame, addable: Column, seed: int, tag: str, target: int, strict: bool) -> DataFrame:
    if not CHOICE_OPTIONS[0] <= target <= CHOICE_OPTIONS[1]:
        raise ValueError(f"target is within {CHOICE_OPTIONS}")
    need = F.greatest(F.lit(0), target - F.size("question.options"))
    drawn = F.slice(_shuffled(F.col("_addable"), seed, tag), F.lit(1), need)
    rows = df.withColumn("_addable", addable)
    if strict:
        few = F.size("_addable") < need
        drawn = F.when(few, F.raise_error(F.lit("not enough categories for the target"))).otherwise(drawn)
    return _replace(rows, F.concat("question.options", _options(seed, tag, drawn))).drop("_addable")


def widen_by_label(df: DataFrame, seed: int, target: int = 8) -> DataFrame:
    """Fault-type questions with options added up to ``target``, chosen by the label.

    Kept as an example of a leak: where the label is ``other``, no real category can be added, so the number of options
    gives the answer away. Use ``widen_by_facts``.
    """
    rows = _fault_questions(df)
    present = F.transform("question.options", lambda o: _category(o["description"]))
    chosen = F.get(F.filter("question.options", lambda o: o["id"] == F.col("target.class_id")), F.lit(0))["description"]
    real = F.when(_category(chosen) == "other", F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, REAL_KINDS)))
    return _widen(rows, F.array_except(F.concat(real, F.array(*map(F.lit, DISTRACTORS))), present), seed, "by-label", target, strict=False)


def widen_by_facts(df: DataFrame, facts: DataFrame, seed: int, target: int = 8) -> DataFrame:
    """The same with any absent category but the true one of the case's ``facts (group_id, facts)``; always reaches ``target``."""
    rows = _fault_questions(df.drop("facts")).join(facts.select("group_id", "facts"), "group_id")
    present = F.transform("question.options", lambda o: _category(o["description"]))
    every = F.array(*map(F.lit, CATEGORIES["en"]))
    return _widen(rows, F.array_except(F.array_except(every, present), F.array(true_category(F.col("facts")))), seed, "by-facts", target, strict=True)


def balanced_pairs(df: DataFrame, facts: DataFrame, seed: int, other_rate: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """The same questions with 4 and with 8 options: none, other and two real categories; then the four distractors too.

    Where there is a fault, ``other_rate`` of the pairs leave its category out and are labelled ``other``.
    """
    rows = _fault_questions(df.drop("facts")).join(facts.select("group_id", "facts"), "group_id")
    true = true_category(F.col("facts"))
    other = (true != "none") & (uniform(seed, F.col("id"), "other") < other_rate)
    rest = _shuffled(F.array_except(F.array(*map(F.lit, REAL_KINDS)), F.array(true)), seed, "balanced")
    kinds = F.when((true == "none") | other, F.slice(rest, 1, 2)).otherwise(F.concat(F.array(true), F.slice(rest, 1, 1)))
    four = F.concat(F.array(F.lit("none"), F.lit("other")), kinds)
    label = option_id(seed, "balanced", F.col("id"), F.when(other, "other").otherwise(true))
    made = rows.withColumns({"_four": four, "_label": label})
    small = _replace(made, _options(seed, "balanced", F.col("_four")), F.col("_label"))
    large = _replace(made, _options(seed, "balanced", F.concat("_four", F.array(*map(F.lit, DISTRACTORS)))), F.col("_label"))
    return small.drop("_four", "_label"), large.drop("_four", "_label")


def donors(df: DataFrame, group: str, seed: int) -> DataFrame:
    """``group, donor``: each group's successor in hash order, the last one's the first. No group is its own donor.

    The order is dealt into 4096 hash ranges: a range's last group takes the first of the next range that has any.
    """
    keyed = df.select(group).distinct().withColumn("_h", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string")), 256)).withColumn("_p", F.substring("_h", 1, 3))
    firsts = keyed.groupBy("_p").agg(F.min_by(F.col(group), F.col("_h")).alias("_first"), F.count("*").alias("_n"))
    rows = sorted(firsts.collect())  # at most 4096
    if sum(r["_n"] for r in rows) < 2:
        raise ValueError("at least two groups are needed")
    follows = [(r["_p"], rows[(i + 1) % len(rows)]["_first"]) for i, r in enumerate(rows)]
    kind = df.schema[group].dataType.simpleString()
    after = df.sparkSession.createDataFrame(follows, f"_p string, _next {kind}")
    successor = F.lead(group).over(Window.partitionBy("_p").orderBy("_h"))
    return keyed.join(F.broadcast(after), "_p").select(group, F.coalesce(successor, F.col("_next")).alias("donor"))


def swap_states(df: DataFrame, seed: int, *, group: str = "group_id", state: str = "state") -> DataFrame:
    """Every group's states replaced by its donor's first one; options and labels stay. A control, never for training."""
    first = df.groupBy(group).agg(F.min_by(F.col(state), F.col("id")).alias("_state")).withColumnRenamed(group, "donor")
    swapped = df.join(donors(df, group, seed), group).join(first, "donor")
    return swapped.withColumn(state, F.col("_state")).select(df.columns)


def triplets(df: DataFrame, facts: DataFrame, seed: int) -> DataFrame:
    """Fault-type triplets: one question over three states, of which it is answered by a real kind, by other, by none.

    Roles are dealt without replacement: a state serves once. For every language and real kind, a state of that kind is
    paired by slot with one of another kind (whose answer is ``other``) and one without a fault. Ids end in ``-real``,
    ``-other`` and ``-none``.
    """
    first = Window.partitionBy("group_id").orderBy("id")
    rows = _fault_questions(df.drop("facts")).join(facts.select("group_id", "facts"), "group_id").withColumn("_r", F.row_number().over(first)).where("_r = 1")
    order = F.xxhash64(F.lit(seed), F.lit("triplet"), "group_id")
    faulty = rows.where(F.col("facts.fault") != "absent").withColumn("_kind", F.col("facts.fault_kind"))
    # A kind's states are dealt by turns: even ones are the real case of their kind, odd ones the other case of the next kind.
    turn = F.row_number().over(Window.partitionBy("language", "_kind").orderBy(order, "group_id")) - 1
    dealt = faulty.withColumn("_turn", turn).withColumn("_slot", F.floor(F.col("_turn") / 2))
    following = F.lit(None).cast("string")
    for a, b in zip(REAL_KINDS, (*REAL_KINDS[1:], REAL_KINDS[0])):
        following = F.when(F.col("_kind") == a, b).otherwise(following)
    real = dealt.where("_turn % 2 = 0").select("language", "_kind", "_slot", "question", F.col("group_id").alias("_g"), F.col("state").alias("_real"))
    other = dealt.where("_turn % 2 = 1").select("language", following.alias("_kind"), "_slot", F.col("state").alias("_other"))
    both = real.join(other, ["language", "_kind", "_slot"])
    place = F.row_number().over(Window.partitionBy("language").orderBy("_g")) - 1
    none = rows.where(F.col("facts.fault") == "absent").withColumn("_place", F.row_number().over(Window.partitionBy("language").orderBy(order, "group_id")) - 1)
    whole = both.withColumn("_place", place).join(none.select("language", "_place", F.col("state").alias("_none")), ["language", "_place"])
    whole = whole.withColumns({"id": F.concat(F.lit("triplet-"), "_g"), "options": F.array(F.col("_kind"), F.lit("other"), F.lit("none"))})
    roles = F.array(
        F.struct(F.lit("real").alias("role"), F.col("_real").alias("state"), F.col("_kind").alias("answer")),
        F.struct(F.lit("other").alias("role"), F.col("_other").alias("state"), F.lit("other").alias("answer")),
        F.struct(F.lit("none").alias("role"), F.col("_none").alias("state"), F.lit("none").alias("answer")),
    )
    long = whole.withColumn("_role", F.explode(roles))
    made = long.select(
        F.concat_ws("-", "id", "_role.role").alias("id"), F.col("id").alias("triplet"), "_role.role", "language", "_role.state", "_role.answer",
        F.col("question.instructions").alias("instructions"), _options(seed, "triplet", F.col("options")).alias("_o"), "options",
    )
    kept = F.transform(F.arrays_zip("options", "_o"), lambda z: F.struct(option_id(seed, "triplet", F.col("triplet"), z["options"]).alias("id"), z["_o"]["description"].alias("description")))
    return made.withColumns({"question_options": kept, "class_id": option_id(seed, "triplet", F.col("triplet"), F.col("answer"))}).drop("_o", "options")


def rename_options(df: DataFrame, seed: int) -> DataFrame:
    """Options under new ids and in another order, with the label's id; candidate rows must not change."""
    fresh = lambda i: option_id(seed, "rename", F.col("id"), i)
    shuffled = F.array_sort(F.transform("question.options", lambda o: F.struct(fresh(o["id"]).alias("id"), o["description"].alias("description"))))
    return _replace(df, shuffled, F.when(F.col("target.class_id").isNotNull(), fresh(F.col("target.class_id"))))


def reverse_rubric(df: DataFrame) -> DataFrame:
    """Ordinal questions with their levels, and label, turned round."""
    q = F.col("question")
    out = df.where(F.col("question.type") == "ordinal").withColumn("target", F.col("target").withField("level_index", F.size(q["levels"]) - 1 - F.col("target.level_index")))
    return out.withColumn("question", q.withField("levels", F.reverse(q["levels"])))


def drop_distractor(df: DataFrame, seed: int) -> DataFrame:
    """Choices of more than two options without one that isn't the label, chosen by hash."""
    others = F.filter("question.options", lambda o: o["id"] != F.col("target.class_id"))
    gone = F.get(F.array_sort(F.transform(others, lambda o: F.struct(F.xxhash64(F.lit(seed), "id", o["id"]).alias("h"), o["id"].alias("id")))), F.lit(0))["id"]
    rows = df.where((F.col("question.type") == "choice") & (F.size("question.options") > 2)).withColumn("_gone", gone)
    return _replace(rows, F.filter("question.options", lambda o: o["id"] != F.col("_gone"))).drop("_gone")


def request_battery(df: DataFrame, group: str, question_id: str, question: str, *, requests: int | None = None, most: int = 8) -> DataFrame:
    """A group's questions as requests of at most ``most``: ``group, part, questions`` (a map); repeated in turn up to ``requests``.

    All questions are asked: what one request can't hold goes to the group's next ``part`` (from 0). Questions are
    dealt in the order of their ids' MD5, by its first two digits, then by id, and numbered within those digits, so that
    a large group is not sorted in one task.
    """
    deal = F.substring(F.md5(F.col(question_id).cast("string")), 1, 2)
    rows = df.select(group, question_id, question).withColumn("_deal", deal)
    earlier = Window.partitionBy(group).orderBy("_deal").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(group, "_deal").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(group, "_deal").orderBy(question_id, question)) - 1
    placed = rows.withColumn("_within", within).join(before.withColumnsRenamed({group: "_group", "_deal": "_same"}), F.col(group).eqNullSafe(F.col("_group")) & (F.col("_deal") == F.col("_same")))
    dealt = placed.withColumn("part", F.floor((F.col("_before") + F.col("_within")) / most))
    listed = F.array_sort(F.collect_list(F.struct(F.col(question_id).alias("k"), F.col(question).alias("v"))))
    made = dealt.groupBy(group, "part").agg(F.map_from_entries(listed).alias("questions"))
    if requests is None:
        return made
    numbered, n = hash_ranks(made, F.sha2(F.concat_ws(":", F.col(group).cast("string"), "part"), 256))
    turns = df.sparkSession.range(requests).select(F.col("id").alias("request"), (F.col("id") % max(1, n)).alias("_rank"))
    return turns.join(numbered, "_rank").drop("_rank")


def donor_accuracy(predictions: DataFrame, original: DataFrame, donor: DataFrame) -> DataFrame:
    """Accuracy of predictions on swapped states against the kept label and against the donor's: ``n, original, donor``."""
    joined = predictions.alias("p").join(original.alias("o"), "id").join(donor.alias("d"), "id")
    return joined.agg(F.count("*").alias("n"), F.avg((F.col("p.prediction") == F.col("o.label")).cast("double")).alias("original"), F.avg((F.col("p.prediction") == F.col("d.label")).cast("double")).alias("donor"))
