"""The decision operators as queries over the driver tables.

The tables stand in for decision data: documents are states, their source and language groups and families, labels
binary targets, embeddings representations, order priorities an ordinal rubric, events requests. Logits are closed
formulas, so that SQL can repeat them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import prob
from tallyloom.functions.text import escape, hashed_grams
from tallyloom.operators import derive, fit, generate, metrics, prepare, resample, score, split, validate
from tallyloom.operators.expand import canonical_options, expand
from tallyloom.streaming import decide as serving

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r(c: str, digits: int = 6) -> Column:
    return F.round(F.col(c), digits).alias(c)


def _rounded(df: DataFrame, *keep: str) -> DataFrame:
    floats = {c for c, kind in df.dtypes if kind == "double"}
    return df.select(*(_r(c) if c in floats and c not in keep else F.col(c) for c in df.columns))


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with labels and two closed-form logits."""
    d, l = _t(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), _t(spark, sf, "labels")  # noqa: E741
    z = F.greatest(F.lit(-6.0), F.least(F.lit(6.0), (F.col("n_chars") - 2000) / 1000.0))
    return d.join(l, "doc_id").withColumns({"z": z, "z2": z / 2 + 0.5})


def _spread(key: Column, size: Column) -> Column:
    """A closed-form distribution of ``size`` values."""
    raw = F.transform(F.sequence(F.lit(0), size - 1), lambda j: (1 + (key * 7 + j * 13) % 11).cast("double"))
    return F.element_at(F.transform(F.array(raw), lambda w: F.transform(w, lambda x: x / prob.total(w))), 1)


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    m = (3 + F.col("o_custkey") % 3).cast("int")
    return _t(spark, sf, "orders").select("o_orderkey", m.alias("levels")).select("o_orderkey", _spread(F.col("o_orderkey"), F.col("levels")).alias("p"), (F.col("o_orderkey") % F.col("levels")).cast("int").alias("t"))


def _by_hash(df: DataFrame, ident: str) -> DataFrame:
    """Rows, not groups, dealt to three splits: a split that leaks, to be found out."""
    digit = F.substring(F.md5(F.col(ident).cast("string")), 1, 1)
    return df.withColumn("split", F.when(digit < "8", "train").when(digit < "c", "validation").otherwise("test"))


def duplicate_inputs(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("input"))
    return validate.classify_duplicates(d, "input", "lang", "source", "doc_id")


def contradictory_labels(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("input")).join(_t(spark, sf, "labels"), "doc_id")
    return validate.classify_duplicates(d, "input", "quality", "source", "doc_id").where("kind = 'labels'").select("input", "doc_id", "n")


def duplicates_across_groups(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("input"))
    return validate.classify_duplicates(d.withColumn("one", F.lit(1)), "input", "one", "source", "doc_id").where("kind = 'groups'").select("input", "doc_id", "n")


def dataset_stats(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", "lang", "source").join(_t(spark, sf, "labels"), "doc_id", "left")
    return validate.counts_by(d, language="lang", source="source", quality="quality", toxic="toxic")


def group_size_histogram(spark, sf):
    return validate.group_sizes(_t(spark, sf, "conversations"), "conv_id")


def contrasting_groups(spark, sf):
    return validate.contrasting_groups(_labelled(spark, sf), "source", "lang", "quality")


def group_split(spark, sf):
    return split.assign_groups(_t(spark, sf, "conversations").select("conv_id"), "conv_id", 0)


def split_summary(spark, sf):
    o = _t(spark, sf, "orders").select("o_custkey", "o_orderstatus")
    return split.split_summary(o, split.assign_groups(o, "o_custkey", 7), "o_custkey", "o_orderstatus")


def exact_leakage(spark, sf):
    d = _by_hash(_t(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("input")), "doc_id")
    return split.shared_keys(d, "input")


def template_overlap(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", F.concat_ws(":", "lang", "source", F.floor(F.col("n_chars") / 100)).alias("template"))
    return split.shared_keys(_by_hash(d, "doc_id"), "template")


def near_duplicates(spark, sf):
    return split.near_duplicate_rows(_t(spark, sf, "documents"), "doc_id", "text")


def exclude_overlap(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("input"), F.col("n_chars").alias("grp"))
    toxic = d.join(_t(spark, sf, "labels").where("toxic = 1"), "doc_id", "left_semi")
    return split.exclude_overlap(d, toxic, "grp", "input").select("doc_id", "grp")


def expand_ordinal(spark, sf):
    null = F.lit(None).cast("string")
    o = _t(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_custkey").cast("string").alias("group_id"),
        F.concat(F.lit("status <"), "o_orderstatus", F.lit(">")).alias("state"),
        null.alias("image_path"),
        F.struct(F.lit("ordinal").alias("type"), F.lit("How urgent?").alias("instructions"), F.lit(None).cast("array<struct<id:string,description:string>>").alias("options"), F.array(*map(F.lit, PRIORITIES)).alias("levels")).alias("question"),
    )
    return expand(o).select("id", "candidate_index", "n_candidates", "row_sha256")


def expand_choice_order(spark, sf):
    n = _t(spark, sf, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("description"))).alias("o"))
    return n.select("n_regionkey", F.posexplode(canonical_options(F.col("o"))).alias("candidate_index", "c")).select("n_regionkey", "candidate_index", F.col("c.id").alias("candidate_id"))


def escape_pages(spark, sf):
    return _t(spark, sf, "pages").select("page_id", F.sha2(escape(F.col("html")), 256).alias("escaped_sha256"))


def conversation_state(spark, sf):
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("said"))))
    c = _t(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    return c.select("conv_id", F.size("t").cast("long").alias("turns"), F.sha2(F.array_join("t.said", "\n"), 256).alias("state_sha256"))


def hashed_bow(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", hashed_grams(F.col("text")).alias("f"))
    return d.select("doc_id", F.size("f").cast("long").alias("features"), F.aggregate("f", F.lit(0).cast("long"), lambda s, x: s + x).alias("bucket_sum"))


def standardize(spark, sf):
    return _rounded(score.moments(_t(spark, sf, "embeddings"), "embedding"))


def _heads(spark, sf):
    """One linear head per class, from its mean vector: as many rows as classes."""
    e = _t(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    means = e.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("c")).select("label", F.col("c.m").alias("weights"))


def _class_logits(spark, sf):
    rows = sorted(_heads(spark, sf).collect())
    logit = [prob.dot(F.col("embedding"), w := F.array(*[F.lit(float(x)) for x in r.weights])) - prob.dot(w, w) / 2 for r in rows]
    return _t(spark, sf, "embeddings").select("vec_id", "label", F.array(*logit).alias("row_logits"))


def centroid_logits(spark, sf):
    z = _class_logits(spark, sf)
    return z.select("vec_id", F.posexplode("row_logits").alias("candidate_index", "logit")).select("vec_id", "candidate_index", _r("logit", 5))


def softmax_answer(spark, sf):
    z = _class_logits(spark, sf).withColumn("p", prob.softmax(F.col("row_logits"), 0.05))
    return z.select("vec_id", prob.argmax(F.col("p")).alias("choice"), F.round(F.array_max("p"), 5).alias("p_top"), F.round(prob.concentration(F.col("p")), 5).alias("confidence"))


def binary_metrics(spark, sf):
    return _rounded(metrics.binary_metrics(_labelled(spark, sf), "z", "quality", by=["lang"]))


def family_breakdown(spark, sf):
    return _rounded(metrics.binary_metrics(_labelled(spark, sf), "z", "toxic", by=["lang", "source"]).select("lang", "source", "n", "positives", "nll", "brier", "accuracy"))


def reliability(spark, sf):
    d = _labelled(spark, sf).withColumn("p", prob.sigmoid(F.col("z")))
    return _rounded(metrics.reliability(d, "p", "quality"))


def pairwise(spark, sf):
    return _rounded(metrics.within_group_pairwise(_labelled(spark, sf), "source", "z", "quality"))


def choice_metrics_by_k(spark, sf):
    k = (3 + F.col("vec_id") % 6).cast("int")
    e = _t(spark, sf, "embeddings").select("vec_id", "label", k.alias("size")).select(_spread(F.col("vec_id"), F.col("size")).alias("p"), (F.col("label") % F.col("size")).cast("int").alias("t"))
    return _rounded(metrics.choice_metrics(e, "p", "t"))


def ordinal_metrics_by_m(spark, sf):
    return _rounded(metrics.ordinal_metrics(_ranked(spark, sf), "p", "t"))


def cumulative_ece(spark, sf):
    events = metrics.cumulative_events(_ranked(spark, sf), "p", "t")
    return _rounded(metrics.calibration_error(events, "p", "y").withColumn("k", F.lit(0)).join(events.agg(F.count("*").alias("events")).withColumn("k", F.lit(0)), "k").drop("k"))


def prior_baseline(spark, sf):
    return _rounded(fit.prior_baseline(_t(spark, sf, "labels"), "quality"))


def level_prior(spark, sf):
    return _rounded(fit.level_prior(_ranked(spark, sf).withColumn("m", F.size("p")), "m", "t"))


def uniform_baseline(spark, sf):
    u = fit.uniform_logits(_ranked(spark, sf).withColumn("m", F.size("p")), "m")
    nll = -prob.at(prob.log_softmax(F.col("row_logits")), F.col("t"))
    return _rounded(u.groupBy("m").agg(F.count("*").alias("n"), F.avg(nll).alias("nll")))


def temperature_grid(spark, sf):
    d = _labelled(spark, sf).select(F.lit("binary").alias("kind"), F.array("z").alias("row_logits"), F.col("quality").alias("t"))
    return _rounded(fit.temperature_grid(d, "row_logits", "t", "kind", [0.25, 0.5, 1.0, 2.0, 4.0, 8.0]), "temperature")


def bootstrap_hash(spark, sf):
    d = _labelled(spark, sf)
    rows = d.select("source", prob.binary_nll(F.col("z"), F.col("quality")).alias("nll"), ((F.col("z") >= 0) == (F.col("quality") == 1)).cast("double").alias("right"), F.lit(1.0).alias("one"))
    return _rounded(resample.bootstrap(rows, "source", {"nll": ("nll", "one"), "accuracy": ("right", "one")}, resample.hashed_draws(rows, "source", 200)))


def compare_models(spark, sf):
    d = _labelled(spark, sf)
    side = lambda z: d.select(F.col("doc_id").alias("id"), F.col("source").alias("group_id"), F.col("lang").alias("type"), F.col("quality").alias("target_index"), prob.binary_nll(F.col(z), F.col("quality")).alias("nll"), ((F.col(z) >= 0) == (F.col("quality") == 1)).alias("correct"))
    rows = resample.paired(side("z"), side("z2"))
    return _rounded(rows.groupBy("type").agg(F.count("*").alias("n"), F.avg("nll_a").alias("nll_a"), F.avg("nll_b").alias("nll_b"), F.avg("d_nll").alias("d_nll"), F.avg("d_correct").alias("d_correct")))


def swap_states(spark, sf):
    return derive.donors(_t(spark, sf, "conversations").select("conv_id"), "conv_id", 5)


def triplet_accuracy(spark, sf):
    e = _t(spark, sf, "events").select(F.floor(F.col("event_id") / 3).alias("triplet"), F.element_at(F.array(*map(F.lit, ("real", "other", "none"))), (F.col("event_id") % 3 + 1).cast("int")).alias("role"), (F.col("value") > 1).alias("correct"))
    whole = e.groupBy("triplet").count().where("count = 3").select("triplet")
    return _rounded(resample.triplet_accuracy(e.join(whole, "triplet", "left_semi"), "triplet", "role", "correct"))


def option_cue(spark, sf):
    names = F.array(*map(F.lit, PRIORITIES))
    others = [F.element_at(names, (F.col(c) % len(PRIORITIES) + 1).cast("int")) for c in ("o_custkey", "o_orderkey")]
    orders = _t(spark, sf, "orders").select("o_orderpriority", F.array("o_orderpriority", *others).alias("options"))
    return _rounded(resample.option_cue(orders, "options", "o_orderpriority"))


def mutual_information(spark, sf):
    return _rounded(resample.mutual_information(_t(spark, sf, "orders"), "o_orderstatus", "o_orderpriority"))


def latency_summary(spark, sf):
    return _rounded(metrics.latency_summary(_t(spark, sf, "events"), "value", by=["event_type"]))


def status_counts(spark, sf):
    e = _t(spark, sf, "events").select(F.when(F.col("value") > 2, "queue_full").otherwise("ok").alias("status"), F.col("event_type").alias("error"))
    return metrics.status_counts(e, "status", "error")


def throughput(spark, sf):
    e = _t(spark, sf, "events").agg(F.count("*").alias("requests"), F.sum("value").alias("total"), (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("us"))
    return _rounded(e.select("requests", "total", (F.col("requests") * 1e6 / F.col("us")).alias("per_second")))


def request_battery(spark, sf):
    e = _t(spark, sf, "events").select("user_id", F.format_string("q%012d", "event_id").alias("q"), "event_type")
    b = derive.request_battery(e, "user_id", "q", "event_type")
    return b.select("user_id", "part", F.size("questions").cast("long").alias("questions"), F.array_min(F.map_keys("questions")).alias("first_question"))


def _requests(events: DataFrame) -> DataFrame:
    question = F.struct(F.lit("choice").alias("type"), F.lit("Which?").alias("instructions"), F.array(F.lit("click"), F.lit("view"), F.lit("other")).alias("options"), F.lit(None).cast("array<string>").alias("levels"))
    return events.select(F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.col("props").alias("state"), F.create_map(F.lit("q"), question).alias("questions"))).alias("value"))


def batch_decide(spark, sf):
    return serving.decide(serving.parse_requests(_requests(_t(spark, sf, "events"))), serving.hashed_scorer).select("id", "question_id", "answer")


def stream_decide(spark, sf):
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{shared}/stream-{uuid.uuid4().hex}"
    path = f"{sf}/events.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern: a stream's plain path is a folder
    serving.decide_stream(_requests(source), serving.hashed_scorer, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("id", "question_id", "answer")


def predictions_struct(spark, sf):
    z = _class_logits(spark, sf).select(F.col("vec_id").cast("string").alias("id"), F.lit("choice").alias("question_type"), "row_logits", F.transform("row_logits", lambda x, i: F.concat(F.lit("c"), i.cast("string"))).alias("candidate_ids"), F.lit(None).cast("array<string>").alias("levels"), F.col("label").cast("int").alias("target_index"))
    return score.predictions(z, {"choice": 0.05}).select("id", "target_index", F.round("nll", 6).alias("nll"), "correct", F.col("answer.choice").alias("choice"))


def contradictory_templates(spark, sf):
    """Documents of one language and length, to the hundred characters, stand in for one template."""
    d = _t(spark, sf, "documents").select("doc_id", "source", F.concat_ws(":", "lang", F.floor(F.col("n_chars") / 100)).alias("input")).join(_t(spark, sf, "labels"), "doc_id")
    return validate.classify_duplicates(d, "input", "quality", "source", "doc_id").where("kind = 'labels'").select("input", "doc_id", "n")


def _judged(spark, sf):
    """Labelled documents as predictions of two models: long rows ``model, id, group_id, type, nll, correct, prediction``."""
    d = _labelled(spark, sf)
    side = lambda z: d.select(F.lit(z).alias("model"), F.col("doc_id").alias("id"), F.col("source").alias("group_id"), F.col("lang").alias("type"), F.col("quality").alias("target_index"), prob.binary_nll(F.col(z), F.col("quality")).alias("nll"), ((F.col(z) >= 0) == (F.col("quality") == 1)).alias("correct"), (F.col(z) >= 0).alias("prediction"))
    return side("z"), side("z2")


def compare_models_intervals(spark, sf):
    a, b = _judged(spark, sf)
    return _rounded(resample.compare_models(a, b, types=("en", "es"), draws=resample.hashed_draws(a, "group_id", 100)))


def compare_model_set(spark, sf):
    a, b = _judged(spark, sf)
    c = a.withColumns({"model": F.lit("flat"), "nll": F.lit(0.5), "correct": F.col("target_index") == 1})
    return _rounded(resample.compare_model_set(a.unionByName(b).unionByName(c), "z", draws=resample.hashed_draws(a, "group_id", 100)))


def bootstrap_spread(spark, sf):
    d = _labelled(spark, sf)
    aggregates = {"z_deviation": F.stddev_pop("z"), "longest": F.max("n_chars"), "mean_z": F.avg("z")}
    return _rounded(resample.bootstrap_any(d, "source", aggregates, resample.hashed_draws(d, "source", 50)))


def _triplets(spark, sf, above: float):
    e = _t(spark, sf, "events").select(F.floor(F.col("event_id") / 3).alias("triplet"), F.element_at(F.array(*map(F.lit, resample.ROLES)), (F.col("event_id") % 3 + 1).cast("int")).alias("role"), (F.col("value") > above).alias("correct"))
    return e.join(e.groupBy("triplet").count().where("count = 3").select("triplet"), "triplet", "left_semi")


def triplet_intervals(spark, sf):
    t = _triplets(spark, sf, 3)
    return _rounded(resample.triplet_intervals(t, "triplet", "role", "correct", draws=resample.hashed_draws(t, "triplet", 40)))


def compare_triplets(spark, sf):
    a, b = _triplets(spark, sf, 3), _triplets(spark, sf, 2)
    return _rounded(resample.compare_triplets(a, b, "triplet", "role", "correct", draws=resample.hashed_draws(a, "triplet", 40)))


def restricted_prior(spark, sf):
    names = F.array(*map(F.lit, PRIORITIES))
    orders = _t(spark, sf, "orders").select("o_orderpriority", F.array("o_orderpriority", F.element_at(names, (F.col("o_orderkey") % len(PRIORITIES) + 1).cast("int"))).alias("options"))
    return _rounded(resample.restricted_prior_accuracy(orders, "options", "o_orderpriority"))


def mean_nll_by_type(spark, sf):
    return _rounded(metrics.mean_nll_by_type(_judged(spark, sf)[0], ("en", "es", "none such")))


def robustness(spark, sf):
    a, b = _judged(spark, sf)
    return _rounded(score.robustness(a, b))


def reload_difference(spark, sf):
    z = _class_logits(spark, sf).withColumn("id", F.col("vec_id"))
    again = z.withColumn("row_logits", F.transform("row_logits", lambda x: x + (F.col("vec_id") % 7) * 1e-5))
    return _rounded(score.reload_difference(z, again))


def answer_violations(spark, sf):
    null = lambda kind: F.lit(None).cast(kind)
    answer = F.struct(F.lit("binary").alias("type"), F.col("z").alias("p"), null("string").alias("choice"), null("map<string,double>").alias("probabilities"), null("array<double>").alias("level_probabilities"), null("double").alias("score"))
    return score.answer_violations(_labelled(spark, sf).withColumns({"answer": answer, "candidate_ids": null("array<string>")})).select("doc_id", _r("z"))


def inspect_errors(spark, sf):
    rows = _judged(spark, sf)[0].withColumn("task_family", F.col("group_id"))
    return _rounded(score.inspect_errors(rows, correct_rows=0).select("id", "type", "task_family", "nll"))


def donor_accuracy(spark, sf):
    d = _labelled(spark, sf).withColumnRenamed("doc_id", "id")
    named = lambda label: d.select("id", F.col(label).alias("label"))
    return _rounded(derive.donor_accuracy(d.select("id", (F.col("z") >= 0).cast("int").alias("prediction")), named("quality"), named("toxic")))


def batching_tolerance(spark, sf):
    d = _labelled(spark, sf).withColumn("p", prob.sigmoid(F.col("z"))).withColumn("q", F.col("p") + (F.col("doc_id") % 5) / 1000.0)
    d = d.withColumns({"nll_p": prob.binary_nll(F.col("z"), F.col("quality")), "nll_q": prob.binary_nll(F.col("z") + 0.01, F.col("quality")), "yes_p": F.col("p") >= 0.5, "yes_q": F.col("q") >= 0.5})
    return _rounded(metrics.batching_tolerance(d, "p", "q", "nll_p", "nll_q", "yes_p", "yes_q", seconds_a=9.0, seconds_b=4.0))


def step_summary(spark, sf):
    return _rounded(metrics.step_summary(_t(spark, sf, "events").withColumn("clipped", F.col("value") > 2), "value", "clipped"))


def peaks(spark, sf):
    return _rounded(metrics.peaks(_t(spark, sf, "events"), ["value", "event_id", "user_id"]))


def order_value_ranks(spark, sf):
    return metrics.nearest_rank(_t(spark, sf, "orders"), "o_totalprice", (0.01, 0.25, 0.5, 0.99), ["o_orderstatus"])


def encode_cached(spark, sf):
    """Texts whose hash begins with 0 to 7 are encoded by a first run; the second must take those from the cache."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{shared}/cache-{uuid.uuid4().hex}"
    rows = _t(spark, sf, "documents").select(F.sha2("text", 256).alias("row_sha256"), "text")
    encoder = lambda sign: lambda misses: misses.select("row_sha256", (F.length("text") * sign).alias("features"))
    score.encode_cached(rows.where(F.col("row_sha256") < "8"), folder, "f", encoder(-1))
    return score.encode_cached(rows, folder, "f", encoder(1))


def vector_functions(spark, sf):
    v = F.col("embedding")
    hot = prob.one_hot((F.col("vec_id") % 64).cast("int"), F.size(v))
    last = prob.last_valid(F.transform(v, lambda x: (x > 0.1).cast("int")))
    return _t(spark, sf, "embeddings").select("vec_id", F.round(prob.l1(v), 5).alias("l1"), F.round(prob.l2(v), 5).alias("l2"), F.round(prob.cosine(v, hot), 5).alias("cosine"), last.alias("last_valid"), F.round(F.element_at(prob.top_k(v, 3), 3).cast("double"), 5).alias("third"))


def scalar_functions(spark, sf):
    x, step = F.least(F.col("value"), F.lit(20.0)), (F.col("event_id") % 100).cast("int")
    made = _t(spark, sf, "events").select("event_id", prob.softplus(x).alias("softplus"), prob.inverse_softplus(prob.softplus(x)).alias("inverse"), prob.logit(prob.sigmoid(x / 4)).alias("logit"), prob.warmup_decay(step, 10, 100).alias("rate"), prob.bin_index(prob.sigmoid(x / 4)).alias("bin"))
    return _rounded(made)


def rule_labels(spark, sf):
    """Facts drawn from order keys by remainders, and every rule's label."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    drawn = lambda name, by: F.element_at(F.array(*[F.lit(v) for v, _ in generate.FACTS[name]]), (by % len(generate.FACTS[name]) + 1).cast("int")).alias(name)
    facts = F.struct(drawn("refund", k), drawn("charge", c), drawn("fault", k + c), drawn("fault_kind", c), drawn("access", k * 2 + c))
    y = 4 + k % 197
    o = _t(spark, sf, "orders").select("o_orderkey", facts.alias("f"), (c % (y + 1)).alias("x"), y.alias("y"), (3 + k % 3).alias("m"), (c % 101).alias("v"))
    f = F.col("f")
    return o.select(
        "o_orderkey", *(generate.binary_rule(F.lit(kind), f).alias(kind) for kind in generate.BINARY_KINDS), generate.team_rule(f).alias("team"), generate.severity_rule(f).alias("severity"),
        generate.true_category(f).alias("category"), generate.impact_level(F.col("x"), F.col("y"), F.col("m")).alias("impact"), generate.panel_level(F.col("v")).alias("panel"),
    )


def first_of_types(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", F.col("lang").alias("type"), "n_chars")
    return prepare.first_rows(prepare.of_types(d, ("en", "es"), "type"), 500, ["n_chars", "doc_id"])


def too_long_rows(spark, sf):
    kept, long = prepare.split_by_length(_t(spark, sf, "documents").select("doc_id", "lang", "n_chars"), F.col("n_chars"), 2000)
    return long.select("lang", "_length").groupBy("lang").agg(F.count("*").alias("rejected"), F.max("_length").cast("long").alias("longest")).join(kept.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "full_outer")


def longest_first(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", "n_chars")
    return prepare.longest_first(d, F.col("n_chars"), "doc_id", 16).select("doc_id", "batch", "place")


_NAMES = (
    duplicate_inputs, contradictory_labels, duplicates_across_groups, dataset_stats, group_size_histogram, contrasting_groups, group_split, split_summary, exact_leakage, template_overlap,
    near_duplicates, exclude_overlap, expand_ordinal, expand_choice_order, escape_pages, conversation_state, hashed_bow, standardize, centroid_logits, softmax_answer, binary_metrics, family_breakdown,
    reliability, pairwise, choice_metrics_by_k, ordinal_metrics_by_m, cumulative_ece, prior_baseline, level_prior, uniform_baseline, temperature_grid, bootstrap_hash, compare_models, swap_states,
    triplet_accuracy, option_cue, mutual_information, latency_summary, status_counts, throughput, request_battery, batch_decide, stream_decide, predictions_struct,
    contradictory_templates, compare_models_intervals, compare_model_set, bootstrap_spread, triplet_intervals, compare_triplets, restricted_prior, mean_nll_by_type, robustness, reload_difference,
    answer_violations, inspect_errors, donor_accuracy, batching_tolerance, step_summary, peaks, order_value_ranks, encode_cached, vector_functions, scalar_functions, rule_labels, first_of_types,
    too_long_rows, longest_first,
)
QUERIES = {f.__name__: f for f in _NAMES}
