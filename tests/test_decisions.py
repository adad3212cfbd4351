"""Expansion, validation, splits, scoring, fitting, generators, derivations, streaming."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom import schema as S
from tallyloom.functions.text import escape, hashed_grams, normalize_text, shingles
from tallyloom.operators import derive, fit, generate, score, split, validate
from tallyloom.operators.expand import expand, input_hashes, target_index
from tallyloom.streaming import decide as serving


@pytest.fixture(scope="module")
def cases(spark):
    return generate.generate_mixed(spark, 120, 11).cache()


@pytest.fixture(scope="module")
def examples(cases):
    return cases.drop("facts")


@pytest.fixture(scope="module")
def facts(cases):
    return cases.select("group_id", "facts").dropDuplicates(["group_id"])


def _question(spark, kind, options=None, levels=None, state="s <b> & c", image=None):
    row = (1, "q1", "g1", "f", "en", state, "text", image, (kind, "Ask > it", options, levels), (1 if kind == "binary" else None, "b" if options else None, 1 if levels else None), ("fixture", "1", "hand", None, None, None, None, None, None))
    return spark.createDataFrame([row], S.EXAMPLE)


def test_text_functions(spark):
    df = spark.createDataFrame([("ﬁne  STRASSE\tx",), ("Straße & <b>",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(normalize_text("t")).collect()] == ["fine strasse x", "strasse & <b>", None, ""]
    assert df.select(escape(F.col("t"))).collect()[1][0] == "Straße &amp; &lt;b&gt;"
    assert [r[0] for r in df.select(shingles(F.col("t"), 3)).collect()] == [["fine strasse x"], ["strasse & <b>"], None, []]
    words = "one two_2 one".split()
    grams = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    want = sorted({int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % 2**14 for g in grams})
    assert spark.createDataFrame([("One two_2, one!",)], "t string").select(hashed_grams(F.col("t"))).first()[0] == want


def test_row_counts_escaping_and_hash(spark):
    rows = expand(_question(spark, "choice", [("b", "Beta <x>"), ("a", "alpha")])).collect()
    assert [(r.candidate_index, r.candidate_id, r.n_candidates) for r in rows] == [(0, "a", 2), (1, "b", 2)]
    assert "Beta &lt;x&gt;" in rows[1].text and "s &lt;b&gt; &amp; c" in rows[1].text and "Ask &gt; it" in rows[1].text
    assert rows[0].row_sha256 == hashlib.sha256(("text-v1\n" + rows[0].text).encode()).hexdigest()
    assert expand(_question(spark, "binary")).count() == 1
    assert [r.candidate_index for r in expand(_question(spark, "ordinal", None, ["z", "a", "m"])).collect()] == [0, 1, 2]


def test_options_order_and_ids_do_not_change_rows(spark):
    a = expand(_question(spark, "choice", [("b", "Beta"), ("a", "alpha")])).select("text")
    b = expand(_question(spark, "choice", [("x", "alpha"), ("b", "Beta")])).select("text")
    assert a.collect() == b.collect()
    swapped = expand(_question(spark, "ordinal", None, ["a", "b"])).select("text").exceptAll(expand(_question(spark, "ordinal", None, ["b", "a"])).select("text"))
    assert swapped.count() == 2  # levels are never sorted


def test_omitting_an_image_keeps_the_text(spark):
    q = _question(spark, "binary", image="images/x.png")
    keep, omit = expand(q).first(), expand(q, images="omit").first()
    assert keep.text == omit.text and keep.row_sha256 != omit.row_sha256 and omit.image is None


def test_generated_examples_are_valid(examples):
    assert examples.select(validate.record_errors().alias("e")).where("size(e) > 0").count() == 0
    assert target_index(examples).where("target_index IS NULL").count() == 0
    assert examples.select("state", "group_id").distinct().count() == 120


def test_generator_does_not_depend_on_partitions(spark, cases):
    again = generate.generate_mixed(spark, 120, 11).repartition(7)
    assert again.exceptAll(cases).count() == 0


def test_other_rate_does_not_depend_on_facts(spark):
    rows = generate.generate_mixed(spark, 4000, 3, 1, only="choice", version=4).where("task_family = 'fault_type' AND facts.fault != 'absent'")
    label = F.filter("question.options", lambda o: o["id"] == F.col("target.class_id"))[0]["description"]
    other = label.isin(generate.CATEGORIES["es"]["other"], generate.CATEGORIES["en"]["other"])
    for r in rows.groupBy("facts.fault_kind").agg(F.avg(other.cast("double")).alias("r")).collect():
        assert 0.12 < r.r < 0.28


@pytest.mark.parametrize(("x", "y", "m", "want"), [(0, 9, 3, 0), (9, 9, 3, 2), (1, 9, 3, 1), (0, 8, 4, 0), (3, 8, 4, 1), (4, 8, 4, 2), (8, 8, 4, 3), (2, 8, 5, 1), (4, 8, 5, 2), (5, 8, 5, 3), (8, 8, 5, 4)])
def test_impact_levels(spark, x, y, m, want):
    assert spark.range(1).select(generate.impact_level(F.lit(x), F.lit(y), F.lit(m))).first()[0] == want


def test_duplicates_are_classified(spark):
    rows = [("k1", 0, "g", "1"), ("k1", 1, "g", "2"), ("k2", 0, "g", "3"), ("k2", 0, "h", "4"), ("k3", 0, "g", "5"), ("k3", 0, "g", "6"), ("k4", 0, "g", "7")]
    found = validate.classify_duplicates(spark.createDataFrame(rows, "k string, y int, g string, id string"), "k", "y", "g", "id")
    want = {"1": ("k1", "labels", "error"), "3": ("k2", "groups", "error"), "5": ("k3", "within_group", "warning")}
    assert {r.id: (r.k, r.kind, r.level) for r in found.collect()} == want | {str(int(i) + 1): v for i, v in want.items()}


def test_semantic_duplicates(spark):
    a = _question(spark, "choice", [("b", "Beta"), ("a", "alpha")])
    b = _question(spark, "choice", [("b", "alpha"), ("a", "Beta")]).withColumns({"id": F.lit("q2"), "group_id": F.lit("g2")})
    hashes = input_hashes(a.unionByName(b))
    assert hashes.select("serialized_input").distinct().count() == 1 and hashes.select("model_input").distinct().count() == 2
    checks = {r["check"] for r in validate.dataset_checks(a.unionByName(b)).collect()}
    assert "same_serialisation_labels" in checks  # the same id names another option


def test_group_split(spark):
    df = spark.createDataFrame([(f"g{i}",) for i in range(40)], "g string")
    got = {r.g: r.split for r in split.assign_groups(df.repartition(5), "g", 0).collect()}
    order = sorted(got, key=lambda g: hashlib.sha256(f"0:{g}".encode()).hexdigest())
    want = dict(zip(order, ["validation"] * 4 + ["calibration"] * 4 + ["test"] * 4 + ["train"] * 28))
    assert got == want
    with pytest.raises(ValueError):
        split.assign_groups(df.limit(3), "g", 0)


def test_leakage_and_near_duplicates(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [("train", "a", text), ("test", "b", text + " more"), ("test", "c", "nothing like it at all"), ("validation", "d", text)]
    df = spark.createDataFrame(rows, "split string, g string, t string")
    assert {(r.split_a, r.split_b): r.shared for r in split.shared_keys(df, "t").collect()} == {("train", "validation"): 1}
    pairs, total = split.near_duplicate_states(df, "split", "g", "t")
    assert total == 3 and {(r.group_a, r.group_b) for r in pairs.collect()} == {("b", "a"), ("b", "d"), ("a", "d")}


def test_near_duplicate_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    texts = []
    for i in range(60):
        base = [f"w{rng.integers(30)}" for _ in range(25)]
        texts += [" ".join(base), " ".join(base[:-1] + ["x"]), " ".join(base[: rng.integers(1, 25)])]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {(r.a, r.b) for r in split.near_duplicate_pairs(df, "id", "t").collect()}
    sets, first = {}, {}
    for i, t in enumerate(texts):
        w = t.split()
        first.setdefault(t, i)
        sets[first[t]] = {tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert got == want


def test_exclude_overlap_drops_groups(spark):
    df = spark.createDataFrame([("g", "x"), ("g", "y"), ("h", "z")], "g string, k string")
    assert [r.g for r in split.exclude_overlap(df, df.where("k = 'x'"), "g", "k").collect()] == ["h"]


def test_manifest_checks(spark):
    e = spark.createDataFrame([("1", "g", "h1"), ("2", "k", "h2")], "id string, group_id string, input_sha256 string")
    m = e.withColumn("split", F.when(F.col("id") == "1", "train").otherwise("test"))
    split.check_split(e, m)
    for bad in (m.limit(1), m.unionByName(m), m.withColumn("group_id", F.lit("z")), m.withColumn("input_sha256", F.lit("z"))):
        with pytest.raises(ValueError):
            split.check_split(e, bad)
    with pytest.raises(ValueError):
        split.read_split(m, ["test"])


def test_derivations(spark, examples, facts):
    wide = derive.widen_by_facts(examples, facts, 1)
    assert {r[0] for r in wide.select(F.size("question.options")).distinct().collect()} == {8}
    small, large = derive.balanced_pairs(examples, facts, 1)
    for df, k in ((small, 4), (large, 8)):
        assert {r[0] for r in df.select(F.size("question.options")).distinct().collect()} == {k}
        assert df.select(validate.record_errors().alias("e")).where("size(e) > 0").count() == 0
        assert target_index(df).where("target_index IS NULL").count() == 0
    swapped = derive.swap_states(examples, 3).alias("s").join(examples.alias("e"), "id")
    assert swapped.where("s.state = e.state").count() == 0 and swapped.count() == examples.count()
    choices = examples.where("question.type = 'choice'")
    assert expand(derive.rename_options(choices, 5)).select("row_sha256").exceptAll(expand(choices).select("row_sha256")).count() == 0
    turned = derive.reverse_rubric(derive.reverse_rubric(examples))
    assert turned.exceptAll(examples.where("question.type = 'ordinal'")).count() == 0
    fewer = derive.drop_distractor(choices, 1)
    assert target_index(fewer).where("target_index IS NULL").count() == 0


def test_triplets_use_each_state_once(examples, facts):
    rows = derive.triplets(examples, facts, 1).collect()
    assert rows and len({r.state for r in rows}) == len(rows) and len(rows) % 3 == 0
    for r in rows:
        assert r.class_id in {o.id for o in r.question_options} and r.id.endswith(r.role)


def test_standardizer_uses_population_moments(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "v array<double>")
    fitted = score.moments(df, "v")
    assert {r.dim: (r["mean"], r["std"]) for r in fitted.collect()} == {0: (2.0, 1.0), 1: (5.0, 1e-6)}
    assert [r.standardized for r in score.standardize(df, "v", fitted).collect()] == [[-1.0, 0.0], [1.0, 0.0]]
    assert score.standardize(df, "v", None).first().standardized == [1.0, 5.0]


def test_cache_encodes_only_misses(spark, tmp_path):
    seen = []

    def encoder(rows):
        seen.append(rows.count())
        return score.hashed_encoder(rows)

    rows = spark.createDataFrame([("h1", "a b"), ("h2", "c d"), ("h1", "a b")], "row_sha256 string, text string")
    path = str(tmp_path / "cache")
    first = score.encode_cached(rows, path, "f1", encoder)
    assert first.count() == 2
    more = rows.unionByName(spark.createDataFrame([("h3", "e")], rows.schema))
    assert score.encode_cached(more, path, "f1", encoder).count() == 3
    score.encode_cached(rows, path, "f2", encoder)
    assert seen == [2, 1, 2]


def test_answers_and_invariants(spark):
    rows = [
        ("binary", [0.0], ["x"], None, 1),
        ("choice", [1.0, 1.0, 0.0], ["a", "b", "c"], None, 0),
        ("ordinal", [0.0, 0.0], [None, None], ["lo", "hi"], 1),
    ]
    df = spark.createDataFrame(rows, "question_type string, row_logits array<double>, candidate_ids array<string>, levels array<string>, target_index int")
    out = {r.question_type: r for r in score.predictions(df).collect()}
    assert out["binary"].answer.p == 0.5 and out["binary"].correct
    assert out["choice"].answer.choice == "a" and out["choice"].correct  # a tie goes to the first
    assert out["ordinal"].answer.score == 0.5 and out["ordinal"].answer.legend == ["lo", "hi"]
    assert score.answer_violations(score.predictions(df)).count() == 0


def test_temperature_recovers_the_truth(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(int)
    rows = [("binary", [float(2 * a)], int(b)) for a, b in zip(z, y)]
    zc = rng.normal(0, 1, (3000, 4))
    pc = np.exp(zc) / np.exp(zc).sum(axis=1, keepdims=True)
    rows += [("choice", [float(v / 2) for v in a], int(rng.choice(4, p=p))) for a, p in zip(zc, pc)]
    rows += [("ordinal", [0.0, 1.0], 1)] * 29
    df = spark.createDataFrame(rows, "question_type string, row_logits array<double>, target_index int").cache()
    t = fit.fit_temperatures(df)
    assert t["binary"]["temperature"] == pytest.approx(2, abs=0.15) and t["choice"]["temperature"] == pytest.approx(0.5, abs=0.05)
    assert t["ordinal"]["temperature"] == 1.0 and not t["ordinal"]["calibrated"]
    assert all(v["nll_after"] <= v["nll_before"] + 1e-9 for v in t.values())


def test_conditional_logit_finds_the_minimum(spark):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(200):
        x = rng.normal(size=(3, 2))
        p = np.exp(x @ np.array([1.5, -1.0]))
        rows.append(([[float(v) for v in r] for r in x], int(rng.choice(3, p=p / p.sum()))))
    df = spark.createDataFrame(rows, "x array<array<double>>, t int").repartition(3)
    w = fit.conditional_logit(df, "x", "t", 2, ridge=0.001, dense=True)

    def slope(w):
        g = 2 * 0.001 * w
        for x, t in rows:
            x = np.array(x)
            p = np.exp(x @ w)
            p /= p.sum()
            p[t] -= 1
            g = g + p @ x / len(rows)
        return g

    assert np.abs(slope(w)).max() < 1e-4 and w[0] > 0.8 and w[1] < -0.4


def test_baselines(spark):
    df = spark.createDataFrame([("binary", 1, 1), ("binary", 1, 0), ("binary", 1, 1), ("choice", 3, 0), ("ordinal", 3, 2), ("ordinal", 3, 2)], "question_type string, n_candidates int, target_index int")
    got = {(r.question_type, r.n_candidates): r.row_logits for r in fit.baseline_logits(df, df.unionByName(spark.createDataFrame([("ordinal", 4, 0)], df.schema))).collect()}
    assert got["binary", 1] == pytest.approx([np.log(3 / 2)])
    assert got["choice", 3] == [0, 0, 0] and got["ordinal", 4] == [0, 0, 0, 0]
    assert got["ordinal", 3] == pytest.approx([0, 0, np.log(3)])


def test_bow_logistic_separates(spark):
    df = spark.createDataFrame([("good fine", 1), ("fine nice", 1), ("bad poor", 0), ("poor awful", 0)] * 5, "t string, y int").withColumn("f", hashed_grams(F.col("t")))
    rows = fit.bow_logits(fit.bow_logistic(df, "f", "y"), df, "f").collect()
    assert all((r.logit > 0) == (r.y == 1) for r in rows)


def _body(**changes):
    return json.dumps({"id": "r", "state": "hello", "questions": {"q": {"type": "binary", "instructions": "?"}}} | changes)


def test_requests_and_errors(spark):
    many = {f"q{i}": {"type": "binary", "instructions": "?"} for i in range(9)}
    bodies = {
        None: _body(),
        "invalid_json": '{"id": NaN}',
        "empty_state": _body(state=" "),
        "question_count": _body(questions=many),
        "invalid_question": _body(questions={"q": {"type": "choice", "instructions": "?", "options": ["one"]}}),
        "body_too_large": "x" * (serving.MAX_BODY + 1),
    }
    df = spark.createDataFrame([(b,) for b in bodies.values()], "value string")
    assert [r.error for r in serving.parse_requests(df).collect()] == list(bodies)
    assert serving.warm_up(spark, serving.hashed_scorer)


def test_stream_equals_batch_and_questions_are_independent(spark, tmp_path):
    q = {"a": {"type": "choice", "instructions": "?", "options": ["x", "y"]}, "b": {"type": "ordinal", "instructions": "?", "levels": ["1", "2", "3"]}}
    bodies = [(_body(id=f"r{i}", state=f"s{i}", questions=q),) for i in range(20)]
    df = spark.createDataFrame(bodies, "value string")
    df.write.text(str(tmp_path / "in"))
    stream = spark.readStream.text(str(tmp_path / "in"))
    serving.decide_stream(stream, serving.hashed_scorer, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    batch = serving.decide(serving.parse_requests(df), serving.hashed_scorer)
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(batch).count() == 0 and batch.count() == 40
    alone = spark.createDataFrame([(_body(id="r3", state="s3", questions={"b": q["b"]}),)], "value string")
    got = serving.decide(serving.parse_requests(alone), serving.hashed_scorer).first()
    assert got == batch.where("id = 'r3' AND question_id = 'b'").first()
    assert serving.usage(batch).first().expanded_rows == 100


def test_request_battery_keeps_all_questions(spark):
    rows = [("hot", f"q{i:03d}") for i in range(45)] + [("small", "q1"), ("small", "q2"), (None, "q3")]
    df = spark.createDataFrame(rows, "g string, q string").withColumn("text", F.upper("q"))
    made = derive.request_battery(df, "g", "q", "text").collect()
    assert sorted((r.g, k, v) for r in made for k, v in r.questions.items() if r.g) == sorted((g, q, q.upper()) for g, q in rows if g)
    assert sorted((r.part, len(r.questions)) for r in made if r.g == "hot") == [(i, 8) for i in range(5)] + [(5, 5)]
    assert [len(r.questions) for r in made if r.g is None] == [1]
    turns = derive.request_battery(df, "g", "q", "text", requests=20).collect()
    assert sorted(r.request for r in turns) == list(range(20)) and len({(r.g, r.part) for r in turns}) == 8


def test_near_duplicates_shuffle_shingles_packed(spark):
    """Texts without a common shingle: what is shuffled stays below what a row per shingle would take."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"{w:x}" for w in rng.integers(0, 1 << 40, 600)) for _ in range(400)]
    texts += [texts[7] + " more", texts[7]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(4).localCheckpoint()
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext.setJobGroup("shuffled", "shuffled")
    try:
        found = {r.id: (r.rep, r.links) for r in split.near_duplicate_rows(df, "id", "t").collect()}
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = {s for j in tracker.getJobIdsForGroup("shuffled") for s in tracker.getJobInfo(j).stageIds}
    written = sum(store.stageAttempt(s, 0, False, None, False, None)._1().shuffleWriteBytes() for s in stages)
    assert {i for i, (_, links) in found.items() if links} == {7, 400, 401} and found[401] == (7, 1)
    text, shingles = sum(map(len, texts)), 400 * 598
    assert written < text + 8 * shingles


def test_a_body_is_parsed_once(spark):
    bodies = ['{"id": "a", "state": "s", "questions": {"q": {"type": "binary", "instructions": "?"}}}', '{"id": "a", "id": "b"}', None, "x" * (serving.MAX_BODY + 1)]
    requests = serving.parse_requests(spark.createDataFrame([(b,) for b in bodies], "value string"))
    assert [r.error for r in requests.collect()] == [None, "invalid_json", "invalid_json", "body_too_large"]
    plan = serving.decide(requests, serving.hashed_scorer)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1 and plan.count("from_json") == 1


def test_buckets_are_sorted_without_a_lambda(spark):
    rows = spark.createDataFrame([("b a b c",), ("",), (None,)], "t string").select(hashed_grams(F.col("t")).alias("f"))
    assert "array_sort" not in rows._jdf.queryExecution().optimizedPlan().toString()
    (some,), (none,), (null,) = rows.collect()
    assert some == sorted(set(some)) and len(some) == 6 and none == [] and null is None


def test_near_duplicates_of_texts_that_share_nothing(spark):
    for texts in ([], ["", None, " "], ["one two three four", "five six seven"], ["one two", "", "one two"]):
        df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
        assert {(r.id, r.links) for r in split.near_duplicate_rows(df, "id", "t").collect()} == {(i, 0) for i in range(len(texts))}
