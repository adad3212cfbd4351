"""More queries over the driver tables, for operators that write, train, encode, draw and refuse; their SQL stands beside them."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import prob
from tallyloom.operators import derive, encode, panels, resample, score, split, train, verify
from tallyloom.operators.shared import shared_folder
from tallyloom.schema import BINARY, CHOICE, ORDINAL
from tallyloom.sources import png, records
from tallyloom.streaming import decide as serving
from tallyloom.streaming import served


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Bootstrap by numpy's draws ------------------------------------------------------------------------------------------

DRAW_SEED, DRAW_REPS = 11, 40


def bootstrap_numpy(spark, sf):
    """The mean balance of customers, resampled by nation with numpy's own draws."""
    rows = _t(spark, sf, "customer").withColumn("one", F.lit(1.0))
    found = resample.bootstrap(rows, "c_nationkey", {"balance": ("c_acctbal", "one")}, reps=DRAW_REPS, seed=DRAW_SEED)
    return found.select("metric", *(F.round(c, 6).alias(c) for c in ("point", "low", "high")), "defined_reps")


def _pcg_sql(seed: int, steps: int) -> str:
    """The generator's outputs as SQL: a 128-bit linear congruence in four 32-bit limbs, its halves folded and rotated."""
    state = np.random.PCG64(seed).state["state"]
    limbs = lambda x: [x >> 32 * i & 0xFFFFFFFF for i in range(4)]
    s, c = limbs(state["state"]), limbs(state["inc"])
    m = limbs(0x2360ED051FC65DA44385DF649FCCF645)  # fixed value: the generator's multiplier
    product = [" + ".join(f"s{j} * {m[i - j]}::HUGEINT" for j in range(i + 1)) for i in range(4)]
    carried = [f"({product[0]} + {c[0]})"]
    for i in range(1, 4):
        carried.append(f"({product[i]} + {c[i]} + {carried[-1]} // 4294967296)")
    return f"""
stream(i, s0, s1, s2, s3) AS (
  SELECT 0, {", ".join(f"{x}::HUGEINT" for x in s)}
  UNION ALL
  SELECT i + 1, {", ".join(f"{x} % 4294967296" for x in carried)} FROM stream WHERE i < {steps}
), folded AS (
  SELECT i, xor((s3 * 4294967296 + s2)::UBIGINT, (s1 * 4294967296 + s0)::UBIGINT)::HUGEINT AS x,
         (2::DOUBLE ** (s3 // 67108864))::HUGEINT AS turn
  FROM stream WHERE i > 0
), outputs AS (SELECT i, x // turn + (x % turn) * (18446744073709551616::HUGEINT // turn) AS v FROM folded
), words AS (
  SELECT 2 * i AS spot, v % 4294967296 AS w FROM outputs UNION ALL SELECT 2 * i + 1, v // 4294967296 FROM outputs
)"""


_BOOTSTRAP_SQL = f"""
WITH RECURSIVE {_pcg_sql(DRAW_SEED, 25 * DRAW_REPS // 2 + 20)}, totals AS (
  SELECT c_nationkey, sum(c_acctbal) AS s, count(*) AS n, row_number() OVER (ORDER BY c_nationkey) - 1 AS rank
  FROM customer GROUP BY c_nationkey
), k AS (SELECT count(*)::HUGEINT AS n FROM totals
), drawn AS (
  SELECT w * n // 4294967296 AS rank, (row_number() OVER (ORDER BY spot) - 1) // n AS rep
  FROM words, k WHERE w * n % 4294967296 >= 4294967296 % n
), reps AS (
  SELECT rep, sum(s) / sum(n) AS value FROM drawn JOIN totals USING (rank) WHERE rep < {DRAW_REPS} GROUP BY rep
)
SELECT 'balance' AS metric, round((SELECT sum(s) / sum(n) FROM totals), 6) AS point, round(quantile_cont(value, 0.025), 6) AS low,
       round(quantile_cont(value, 0.975), 6) AS high, count(*) AS defined_reps
FROM reps
"""

# One step of training ------------------------------------------------------------------------------------------------

RATE, RPS = 0.1, 0.5
WEIGHTS = {BINARY: 1.0, CHOICE: 0.5, ORDINAL: 2.0}


def train_one_step(spark, sf):
    """A step over all vectors, as yes-or-no, four-way and three-level questions over their quarters; the heads it leads to."""
    part = lambda i: F.slice("embedding", 1 + 16 * i, 16).cast("array<double>")
    kinds = ((BINARY, 1, 2), (CHOICE, 4, 4), (ORDINAL, 3, 3))
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("question_type"), F.array(*map(part, range(n))).alias("vectors"), (F.col("label") % m).cast("int").alias("target_index")) for k, n, m in kinds])).alias("q")
    questions = _t(spark, sf, "embeddings").select("vec_id", asked).select(F.concat_ws("-", "q.question_type", "vec_id").alias("id"), "q.*")
    params = train.TrainParams(epochs=1, questions_per_step=1 << 30, learning_rate=RATE, weight_decay=0.0, rps_weight=RPS, type_weights=WEIGHTS, select_on="train")
    done = train.train_heads(questions, params, folder=_folder(spark, "train"))
    told = done.history.select(F.explode(F.create_map(*[x for k in WEIGHTS for x in (F.lit(k), F.col(f"train_nll_{k}"))])).alias("question_type", "nll_after"), F.round("train_loss", 5).alias("loss"))
    weights = done.heads.select("question_type", F.posexplode(F.concat("weights", F.array("bias"))).alias("dim", "weight"))
    return weights.join(told, "question_type").select("question_type", "dim", F.round("weight", 4).alias("weight"), F.round("nll_after", 4).alias("nll_after"), "loss")


_TRAIN_SQL = f"""
WITH x AS MATERIALIZED (
  SELECT vec_id, label, c, d, CASE WHEN d < 16 THEN embedding[16 * c + d + 1]::DOUBLE ELSE 1 END AS v
  FROM embeddings, range(4) AS cs(c), range(17) AS ds(d)
), n AS (SELECT 3 * count(*) AS n FROM embeddings
), pulls AS (
  SELECT '{BINARY}' AS t, vec_id, 0 AS c, {WEIGHTS[BINARY]} * (0.5 - label % 2) AS g FROM embeddings
  UNION ALL SELECT '{CHOICE}', vec_id, c, {WEIGHTS[CHOICE]} * (0.25 - (c = label % 4)::INT) FROM embeddings, range(4) AS cs(c)
  UNION ALL
  SELECT '{ORDINAL}', vec_id, c, {WEIGHTS[ORDINAL]} * (1.0 / 3 - (c = t)::INT + {RPS} / 3 * (CASE c WHEN 0 THEN m0 + m1 WHEN 1 THEN m1 ELSE 0 END - (m0 + 2 * m1) / 3))
  FROM (SELECT vec_id, label % 3 AS t, 1.0 / 3 - (label % 3 <= 0)::INT AS m0, 2.0 / 3 - (label % 3 <= 1)::INT AS m1 FROM embeddings), range(3) AS cs(c)
), slopes AS (SELECT t, d, sum(g * v) / any_value(n) AS g FROM pulls JOIN x USING (vec_id, c), n GROUP BY t, d
), heads AS MATERIALIZED (SELECT t, d, -{RATE} * g / (abs(g) + 1e-8) AS w FROM slopes
), z AS MATERIALIZED (
  SELECT t, vec_id, any_value(label) AS label, c, sum(w * v) AS z FROM heads JOIN x USING (d)
  WHERE c < CASE t WHEN '{BINARY}' THEN 1 WHEN '{CHOICE}' THEN 4 ELSE 3 END GROUP BY t, vec_id, c
), nll AS (
  SELECT t, avg(nll) AS nll FROM (
    SELECT t, CASE t WHEN '{BINARY}' THEN ln(1 + exp(max(z))) - (any_value(label) % 2) * max(z)
      WHEN '{CHOICE}' THEN ln(sum(exp(z))) - max(z) FILTER (c = label % 4) ELSE ln(sum(exp(z))) - max(z) FILTER (c = label % 3) END AS nll
    FROM z GROUP BY t, vec_id) GROUP BY t
), loss AS (
  SELECT avg({WEIGHTS[BINARY]} * ln(2) + {WEIGHTS[CHOICE]} * ln(4) + {WEIGHTS[ORDINAL]} * (ln(3) + {RPS} / 2 * (power(1.0 / 3 - (label % 3 <= 0)::INT, 2) + power(2.0 / 3 - (label % 3 <= 1)::INT, 2)))) / 3 AS loss
  FROM embeddings
)
SELECT t AS question_type, d::INT AS dim, round(w, 4) AS weight, round(nll, 4) AS nll_after, round(loss, 5) AS loss
FROM heads JOIN nll USING (t), loss
"""

# Split manifests -----------------------------------------------------------------------------------------------------


def _split_rows(spark, sf):
    """Documents in groups of equal text in lower case, so that neither inputs nor serializations leak."""
    d = _t(spark, sf, "documents").select(F.format_string("d%08d", "doc_id").alias("id"), F.sha2(F.lower("text"), 256).alias("group_id"), F.sha2("text", 256).alias("input_sha256"))
    return d.withColumns({"serialized_sha256": F.col("group_id"), "image_sha256": F.lit(None).cast("string")})


def split_plan_digest(spark, sf):
    """The digest of a plan: every customer's split, by customer."""
    assigned = split.assign_groups(_t(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("g")), "g", 7)
    n = assigned.count()
    return spark.createDataFrame([(n, verify.plan_digest(assigned, "g"))], "customers long, digest string")


_PLAN_SQL = """
WITH g AS (SELECT DISTINCT o_custkey::VARCHAR AS g FROM orders
), ranked AS (
  SELECT g, row_number() OVER (ORDER BY sha256('7:' || g)) - 1 AS r, greatest(1, round_even(0.1 * count(*) OVER (), 0))::BIGINT AS s FROM g
), lines AS (
  SELECT g, g || ':' || CASE WHEN r < s THEN 'validation' WHEN r < 2 * s THEN 'calibration' WHEN r < 3 * s THEN 'test' ELSE 'train' END AS line FROM ranked
)
SELECT count(*) AS customers, sha256(string_agg(line, chr(10) ORDER BY g)) AS digest FROM lines
"""


def split_leaks(spark, sf):
    """What a split of documents by row, not by group, lets leak."""
    digit = F.substring(F.md5(F.substring("id", 2, 8).cast("int").cast("string")), 1, 1)
    named = F.when(digit < "8", "train").when(digit < "a", "validation").when(digit < "c", "calibration").otherwise("test")
    found = verify.leaks(_split_rows(spark, sf).withColumn("split", named))
    return spark.createDataFrame([(*k, n) for k, n in found.items()], "what string, split_a string, split_b string, n long")


_LEAKS_SQL = """
WITH rows AS (
  SELECT sha256(lower(text)) AS g, sha256(text) AS i, substr(md5(doc_id::VARCHAR), 1, 1) AS digit FROM documents
), named AS (
  SELECT g, i, CASE WHEN digit < '8' THEN 'train' WHEN digit < 'a' THEN 'validation' WHEN digit < 'c' THEN 'calibration' ELSE 'test' END AS split,
         CASE WHEN digit < '8' THEN 0 WHEN digit < 'a' THEN 1 WHEN digit < 'c' THEN 2 ELSE 3 END AS place
  FROM rows
), keys AS (
  SELECT DISTINCT 'group' AS what, g AS key, split, place FROM named UNION ALL SELECT DISTINCT 'serialization', g, split, place FROM named
  UNION ALL SELECT DISTINCT 'input', i, split, place FROM named
)
SELECT a.what, a.split AS split_a, b.split AS split_b, count(*) AS n
FROM keys a JOIN keys b ON a.what = b.what AND a.key = b.key AND a.place < b.place GROUP BY ALL
"""


def split_loaded(spark, sf):
    """A manifest that is written and read again with all its checks: groups and documents of each split."""
    examples, path = _split_rows(spark, sf), _folder(spark, "split")
    verify.make_split(spark, examples, 3, path)
    parts = verify.load_split(spark, examples, path, ("train", "validation", "calibration", "test"), allow_test=True)
    counted = [d.agg(F.lit(s).alias("split"), F.count("*").alias("examples"), F.count_distinct("group_id").alias("groups")) for s, d in parts.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(counted[3])


_LOADED_SQL = """
WITH rows AS (SELECT sha256(lower(text)) AS g FROM documents), g AS (SELECT DISTINCT g FROM rows
), ranked AS (
  SELECT g, row_number() OVER (ORDER BY sha256('3:' || g)) - 1 AS r, greatest(1, round_even(0.1 * count(*) OVER (), 0))::BIGINT AS s FROM g
), named AS (
  SELECT g, CASE WHEN r < s THEN 'validation' WHEN r < 2 * s THEN 'calibration' WHEN r < 3 * s THEN 'test' ELSE 'train' END AS split FROM ranked
)
SELECT split, count(*) AS examples, count(DISTINCT g) AS groups FROM rows JOIN named USING (g) GROUP BY split
"""

# Panels --------------------------------------------------------------------------------------------------------------


def panel_pixels(spark, sf):
    """Panels of suppliers' facts, drawn, encoded and decoded again: the dots of each bar's colour."""
    key = F.col("s_suppkey")
    facts = _t(spark, sf, "supplier").select(key.alias("panel"), F.array(*[(3 + (key * m + a) % 95).cast("int") for m, a in ((7, 5), (11, 50), (13, 80))]).alias("values"), (key % len(panels.STYLES)).cast("int").alias("style"))

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                image = png.encode(panels.draw_panel({"names": ["A", "B", "C"], "values": r["values"], "threshold": None, "style": r["style"]}))
                pixels = png.decode(image, 1 << 20).astype(np.int64) @ np.array([65536, 256, 1])
                bars = panels._colours(panels.STYLES[r["style"]][5], 3)[3:].astype(np.int64) @ np.array([65536, 256, 1])
                rows += [(r["panel"], i, int((pixels == c).sum())) for i, c in enumerate(bars)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64()))], ["panel", "bar", "dots"])

    return facts.repartition(8).mapInArrow(run, "panel long, bar int, dots long")


_PANEL_SQL = f"""
WITH styles AS (
  SELECT unnest(range({len(panels.STYLES)})) AS style, unnest({[s[0] == "up" for s in panels.STYLES]}) AS up, unnest({[s[1] for s in panels.STYLES]}) AS share
), drawn AS (
  SELECT s_suppkey AS panel, i::INT AS bar, up, share, 3 + (s_suppkey * [7, 11, 13][i + 1] + [5, 50, 80][i + 1]) % 95 AS value,
         (CASE WHEN up THEN {panels.WIDTH} ELSE {panels.HEIGHT} END - 80) // 3 AS slot,
         CASE WHEN up THEN {panels.HEIGHT} ELSE {panels.WIDTH} END - 60 AS reach
  FROM supplier JOIN styles ON s_suppkey % {len(panels.STYLES)} = style, range(3) AS r(i)
)
SELECT panel, bar, (floor(slot * share)::BIGINT * (reach * value // 100))::BIGINT AS dots FROM drawn
"""

# Scores, losses and encoding -----------------------------------------------------------------------------------------


def linear_logits(spark, sf):
    """Every vector's logit from the head of its label's parity; heads are a table."""
    weights = [[((d * (3 + 2 * h)) % 11 - 5) / 10.0 for d in range(64)] for h in (0, 1)]
    heads = spark.createDataFrame([(h, weights[h], 0.25 - h) for h in (0, 1)], "parity int, weights array<double>, bias double")
    rows = _t(spark, sf, "embeddings").withColumn("parity", (F.col("label") % 2).cast("int"))
    return score.linear_logits(rows, "embedding", heads, "parity").select("vec_id", F.round("logit", 5).alias("logit"))


_LINEAR_SQL = """
SELECT vec_id, round(sum(x * ((d * (3 + 2 * (label % 2))) % 11 - 5) / 10.0) + 0.25 - any_value(label % 2), 5) AS logit
FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS d FROM embeddings) GROUP BY vec_id
"""


def question_losses(spark, sf):
    """The training loss of three- to five-level questions over orders: NLL and half of the ranked probability score."""
    m, key = (3 + F.col("o_custkey") % 3).cast("int"), F.col("o_orderkey")
    z = F.transform(F.sequence(F.lit(0), m - 1), lambda j: ((key * 7 + j * 13) % 11 / 4.0).cast("double"))
    rows = _t(spark, sf, "orders").select("o_orderkey", z.alias("z"), (key % m).cast("int").alias("t"))
    loss = lambda kind: score.question_loss(F.lit(kind), F.col("z"), F.col("t"), 0.5)
    return rows.select("o_orderkey", F.round(loss(ORDINAL), 5).alias("ordinal"), F.round(loss(CHOICE), 5).alias("choice"))


_LOSS_SQL = """
WITH z AS (
  SELECT o_orderkey AS k, 3 + o_custkey % 3 AS m, o_orderkey % (3 + o_custkey % 3) AS t, j, (o_orderkey * 7 + j * 13) % 11 / 4.0 AS z
  FROM orders, unnest(range(5)) AS u(j) WHERE j < 3 + o_custkey % 3
), p AS (SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY k) AS p FROM z
), f AS (SELECT *, sum(p) OVER (PARTITION BY k ORDER BY j) AS f FROM p)
SELECT k AS o_orderkey, round(-ln(max(p) FILTER (j = t)) + 0.5 * sum(power(f - (t <= j)::INT, 2)) FILTER (j < m - 1) / (any_value(m) - 1), 5) AS ordinal,
       round(-ln(max(p) FILTER (j = t)), 5) AS choice
FROM f GROUP BY k
"""


def encode_pooled(spark, sf):
    """Documents through the small recurrent model: the state of the last word, in batches of like length."""
    rows = _t(spark, sf, "documents").select("doc_id", encode.word_ids("text", 5000).alias("ids")).where(F.size("ids") > 0)
    vectors, _ = encode.encode_rows(rows, F.col("ids"), encode.recurrent_states(3), ident="doc_id", max_tokens=1 << 20, batch_rows=16)
    return vectors.select("doc_id", *(F.round(F.get("features", F.lit(d)).cast("double"), 5).alias(f"f{d}") for d in range(3)))


_ENCODE_SQL = """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: len(w) > 0) AS w FROM documents
), long AS (SELECT doc_id, len(w) AS n, unnest(w) AS w, unnest(range(len(w))) AS spot FROM words
), ids AS (SELECT doc_id, n - 1 - spot AS back, ('0x' || substr(md5(w), 1, 8))::BIGINT % 5000 + 1 AS id FROM long)
SELECT doc_id, round(sum((id % 1009) / 1009.0 * 0.5 ** back)::REAL::DOUBLE, 5) AS f0, round(sum((id * 3 % 1009) / 1009.0 * 0.5 ** back)::REAL::DOUBLE, 5) AS f1,
       round(sum((id * 5 % 1009) / 1009.0 * 0.5 ** back)::REAL::DOUBLE, 5) AS f2
FROM ids WHERE back < 200 GROUP BY doc_id
"""


def encode_counters(spark, sf):
    """What encoding all documents in batches of 16 would take."""
    rows = _t(spark, sf, "documents").select("doc_id", encode.word_ids("text", 5000).alias("ids"))
    return encode.counters(encode.batch_plan(rows, "doc_id", "ids", 16))


_COUNTERS_SQL = """
WITH sizes AS (
  SELECT len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: len(w) > 0)) AS n, doc_id FROM documents
), placed AS (SELECT n, (row_number() OVER (ORDER BY n DESC, doc_id) - 1) // 16 AS batch FROM sizes
), widest AS (SELECT batch, max(n) AS w FROM placed GROUP BY batch)
SELECT count(*) AS rows, max(n)::INT AS longest, count(DISTINCT batch) AS forwards, sum(n)::BIGINT AS valid_tokens, sum(w - n)::BIGINT AS padding_tokens
FROM placed JOIN widest USING (batch)
"""

# What is refused -----------------------------------------------------------------------------------------------------


def request_errors(spark, sf):
    """Requests made from events, six in seven with a fault of their own: how many get which code."""
    key, said = F.col("event_id"), F.col("event_type")
    ask = lambda q: F.concat(F.lit('{"id": "'), key.cast("string"), F.lit('", "state": "'), said, F.lit('", "questions": '), F.lit(q), F.lit("}"))
    bodies = [
        ask('{"q": {"type": "binary", "instructions": "Is it?"}}'),
        F.concat(F.lit("{"), said),
        F.concat(F.lit('{"id": "'), key.cast("string"), F.lit('", "state": " ", "questions": {"q": {"type": "binary", "instructions": "?"}}}')),
        ask("{}"),
        ask('{"q": {"type": "essay", "instructions": "?"}}'),
        ask('{"q": {"type": "choice", "instructions": "?", "options": ["one"]}}'),
        ask('{"q": {"type": "ordinal", "instructions": " ", "levels": ["a", "b"]}}'),
    ]
    body = bodies[0]
    for i, other in enumerate(bodies[1:], 1):
        body = F.when(key % 7 == i, other).otherwise(body)
    parsed = serving.parse_requests(_t(spark, sf, "events").select(body.alias("value")))
    return parsed.groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count("*").alias("requests"))


_REQUEST_SQL = """
SELECT CASE event_id % 7 WHEN 0 THEN 'none' WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'empty_state' WHEN 3 THEN 'question_count' ELSE 'invalid_question' END AS error,
       count(*) AS requests
FROM events GROUP BY 1
"""


def record_rejects(spark, sf):
    """Records made from documents, five in six with a fault, written as lines and read back: codes and how often."""
    key = F.col("doc_id")
    question = F.lit('{"type": "noul", "instructions": "Is it?"}')
    record = lambda **c: F.concat(F.lit('{"schema_version": 1, "id": "d'), key.cast("string"), c.get("id", F.lit('"')), F.lit(', "group_id": "g", "task_family": "f", "language": '), c.get("language", F.lit('"en"')), F.lit(', "state": "s", "question": '), question, F.lit(', "target": '), c.get("target", F.lit('{"label": 1}')), F.lit(', "provenance": {"source": "fixture", "generator_version": "1", "label_method": "m"}'), c.get("more", F.lit("")), F.lit("}"))
    lines = [record(), record(id=F.lit(' x"')), record(language=F.lit('"xx"')), record(target=F.lit('{"label": 2}')), record(more=F.lit(', "extra": 1')), F.concat(record(), F.lit("}"))]
    line = lines[0]
    for i, other in enumerate(lines[1:], 1):
        line = F.when(key % 6 == i, other).otherwise(line)
    path = _folder(spark, "lines")
    _t(spark, sf, "documents").select(line.alias("value")).write.text(path)
    good, rejects = records.read_examples(spark, path)
    told = rejects.select(F.explode("errors").alias("code")).unionByName(good.select(F.lit("none").alias("code")))
    return told.groupBy("code").agg(F.count("*").alias("records"))


_RECORD_SQL = """
SELECT ['none', 'id', 'language', 'target_label', 'unknown_extra', 'not_json'][doc_id % 6 + 1] AS code, count(*) AS records FROM documents GROUP BY 1
"""


def served_totals(spark, sf):
    """A stream of suppliers' requests, every fourth of them twice and every ninth without a state: its accounts."""
    key = F.col("s_suppkey")
    body = F.concat(F.lit('{"id": "'), key.cast("string"), F.lit('", "state": "'), F.when(key % 9 == 0, "").otherwise(F.col("s_name")), F.lit('", "questions": {"a": {"type": "binary", "instructions": "?"}, "b": {"type": "choice", "instructions": "?", "options": ["x", "y", "z"]}}}'))
    folder = _folder(spark, "served")
    rows = _t(spark, sf, "supplier").select(F.explode(F.array_repeat(body, F.when(key % 4 == 0, 2).otherwise(1).cast("int"))).alias("value"))
    rows.write.text(f"{folder}/in")
    query = served.serve_stream(spark.readStream.text(f"{folder}/in"), serving.hashed_scorer, f"{folder}/out", f"{folder}/state")
    query.awaitTermination()
    return served.totals(spark, f"{folder}/out").drop("batches")


_SERVED_SQL = """
SELECT count(*) + count(*) FILTER (s_suppkey % 4 = 0) AS received, count(*) FILTER (s_suppkey % 4 = 0) AS repeated, count(*) FILTER (s_suppkey % 9 = 0) AS refused,
       count(*) FILTER (s_suppkey % 9 <> 0) AS answered, 2 * count(*) FILTER (s_suppkey % 9 <> 0) AS questions, 4 * count(*) FILTER (s_suppkey % 9 <> 0) AS expanded_rows
FROM supplier
"""


def reversed_rubric(spark, sf):
    """Orders' priorities as an ordinal question, turned round."""
    levels = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    level = (F.substring("o_orderpriority", 1, 1).cast("int") - 1).cast("int")
    question = F.struct(F.lit(ORDINAL).alias("type"), F.array(*map(F.lit, levels)).alias("levels"))
    rows = _t(spark, sf, "orders").select("o_orderkey", question.alias("question"), F.struct(level.alias("level_index")).alias("target"))
    turned = derive.reverse_rubric(rows)
    return turned.select("o_orderkey", F.get("question.levels", F.lit(0)).alias("lowest"), "target.level_index", prob.at(F.col("question.levels"), F.col("target.level_index")).alias("said"))


_REVERSED_SQL = """
SELECT o_orderkey, '5-LOW' AS lowest, 5 - substr(o_orderpriority, 1, 1)::INT AS level_index, o_orderpriority AS said FROM orders
"""

_BOTH = {
    bootstrap_numpy: _BOOTSTRAP_SQL, train_one_step: _TRAIN_SQL, split_plan_digest: _PLAN_SQL, split_leaks: _LEAKS_SQL, split_loaded: _LOADED_SQL, panel_pixels: _PANEL_SQL,
    linear_logits: _LINEAR_SQL, question_losses: _LOSS_SQL, encode_pooled: _ENCODE_SQL, encode_counters: _COUNTERS_SQL, request_errors: _REQUEST_SQL, record_rejects: _RECORD_SQL,
    served_totals: _SERVED_SQL, reversed_rubric: _REVERSED_SQL,
}
QUERIES = {f.__name__: f for f in _BOTH}
ORACLES = {f.__name__: sql for f, sql in _BOTH.items()}
