"""DuckDB SQL for the decision queries."""

from __future__ import annotations

from tallyloom.operators.expand import DEFAULT
from tallyloom.plans.queries import PRIORITIES

_LABELLED = """
labelled AS (
  SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic,
         greatest(-6.0::DOUBLE, least(6.0::DOUBLE, (n_chars - 2000)::DOUBLE / 1000)) AS z
  FROM documents d JOIN labels l USING (doc_id)
), scored AS (
  SELECT *, 1 / (1 + exp(-z)) AS p,
         CASE WHEN quality = 1 THEN greatest(-z, 0) + ln(1 + exp(-abs(z))) ELSE greatest(z, 0) + ln(1 + exp(-abs(z))) END AS nll,
         CASE WHEN toxic = 1 THEN greatest(-z, 0) + ln(1 + exp(-abs(z))) ELSE greatest(z, 0) + ln(1 + exp(-abs(z))) END AS nll_toxic
  FROM labelled
)"""

_RANKED = """
weights AS (
  SELECT o_orderkey AS key, 3 + o_custkey % 3 AS m, o_orderkey % (3 + o_custkey % 3) AS t, j,
         (1 + (o_orderkey * 7 + j * 13) % 11)::DOUBLE AS w
  FROM orders, unnest(range(5)) AS u(j) WHERE j < 3 + o_custkey % 3
), probs AS (SELECT key, m, t, j, w / sum(w) OVER (PARTITION BY key) AS p FROM weights
), cumulated AS (SELECT *, sum(p) OVER (PARTITION BY key ORDER BY j) AS f FROM probs
)"""

_CLASSES = """
long AS (SELECT vec_id, label, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings
), heads AS (SELECT label AS head, dim, avg(x) AS w FROM long GROUP BY 1, 2
), bias AS (SELECT head, -sum(w * w) / 2 AS b FROM heads GROUP BY 1
), logits AS (
  SELECT vec_id, any_value(l.label) AS label, head, sum(x * w) + any_value(b) AS logit
  FROM long l JOIN heads h USING (dim) JOIN bias USING (head) GROUP BY vec_id, head
), numbered AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY head) - 1 AS idx FROM logits
)"""

_SPLIT3 = """CASE WHEN substr(md5(doc_id::VARCHAR), 1, 1) < '8' THEN 'train'
  WHEN substr(md5(doc_id::VARCHAR), 1, 1) < 'c' THEN 'validation' ELSE 'test' END"""


def _duplicates(table: str, label: str, where: str, columns: str) -> str:
    return f"""
WITH rows AS ({table}), grouped AS (
  SELECT input, count(*) AS n,
         CASE WHEN count(DISTINCT {label}) > 1 THEN 'labels' WHEN count(DISTINCT source) > 1 THEN 'groups' ELSE 'within_group' END AS kind
  FROM rows GROUP BY input HAVING count(*) > 1
)
SELECT {columns} FROM grouped JOIN rows USING (input) {where}"""


def _assign(groups: str, group: str, seed: int) -> str:
    return f"""
groups AS (SELECT DISTINCT {group} FROM {groups}
), ranked AS (
  SELECT {group}, row_number() OVER (ORDER BY sha256('{seed}:' || {group}::VARCHAR)) - 1 AS r,
         greatest(1, round_even(0.1 * count(*) OVER (), 0))::BIGINT AS s FROM groups
), assigned AS (
  SELECT {group}, CASE WHEN r < s THEN 'validation' WHEN r < 2 * s THEN 'calibration' WHEN r < 3 * s THEN 'test' ELSE 'train' END AS split FROM ranked
)"""


def _shared(rows: str, key: str) -> str:
    return f"""
WITH rows AS ({rows}), keys AS (SELECT DISTINCT {key} AS k, split FROM rows)
SELECT a.split AS split_a, b.split AS split_b, count(*) AS shared
FROM keys a JOIN keys b ON a.k = b.k AND a.split < b.split GROUP BY 1, 2"""


def _binary(by: str, y: str, nll: str) -> str:
    return f"""
WITH {_LABELLED}, bins AS (
  SELECT {by}, grouping({by}) AS g, least(floor(p * 15), 14) AS bin, count(*) AS n, avg(p) AS mean_p, avg({y}::DOUBLE) AS freq
  FROM scored GROUP BY GROUPING SETS ((bin), ({by}, bin))
), gaps AS (SELECT {by}, g, sum(n * abs(mean_p - freq)) / sum(n) AS ece FROM bins GROUP BY {by}, g
), counted AS (
  SELECT {by}, grouping({by}) AS g, count(*) AS n, sum({y})::BIGINT AS positives, avg({y}::DOUBLE) AS prevalence, avg({nll}) AS nll,
         avg((p - {y}) * (p - {y})) AS brier, avg(((p >= 0.5) = ({y} = 1))::INT::DOUBLE) AS accuracy,
         count(*) FILTER (p >= 0.5 AND {y} = 1) AS tp, count(*) FILTER (p >= 0.5 AND {y} = 0) AS fp, count(*) FILTER (p < 0.5 AND {y} = 1) AS fn
  FROM scored GROUP BY GROUPING SETS ((), ({by}))
)
SELECT c.{by}, {_BINARY_COLUMNS}
FROM counted c JOIN gaps e ON c.g = e.g AND c.{by} IS NOT DISTINCT FROM e.{by}"""


_BINARY_COLUMNS = """c.n, c.positives, round(prevalence, 6) AS prevalence, round(c.nll, 6) AS nll, round(c.brier, 6) AS brier, round(ece, 6) AS ece,
  round(accuracy, 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS "precision", round(tp / nullif(tp + fn, 0), 6) AS recall,
  CASE WHEN tp + fp > 0 AND tp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) END AS f1"""


def _expand_sql() -> str:
    """The template's text, put together by concatenation."""
    t = DEFAULT
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    levels = "\n".join(f'<level index="{i}">{esc(p)}</level>' for i, p in enumerate(PRIORITIES))
    head = f'<{t.tag} version="{t.version}">\n<state>\n'
    middle = f'\n</state>\n<question type="ordinal">\n<instructions>\nHow urgent?\n</instructions>\n<rubric>\n{levels}\n</rubric>\n<evaluated-level index="'
    tail = f'</evaluated-level>\n</question>\n<task>{t.tasks["ordinal"]}</task>\n</{t.tag}>'
    names = ", ".join(f"'{p}'" for p in PRIORITIES)
    q = lambda s: "'" + s.replace("'", "''") + "'"
    return f"""
SELECT o_orderkey::VARCHAR AS id, i::INT AS candidate_index, 5 AS n_candidates,
       sha256({q(t.version)} || chr(10) || {q(head)} || 'status &lt;' || o_orderstatus || '&gt;' || {q(middle)} || i::VARCHAR || '">' || ([{names}])[i + 1] || {q(tail)}) AS row_sha256
FROM orders, unnest(range(5)) AS u(i)"""


_NLL2 = "greatest(CASE WHEN quality = 1 THEN -(z / 2 + 0.5) ELSE z / 2 + 0.5 END, 0) + ln(1 + exp(-abs(z / 2 + 0.5)))"
#: Two models' judgements of one document in one row.
_JUDGED = f"""{_LABELLED}, judged AS (
  SELECT doc_id AS id, source AS group_id, lang AS type, quality, toxic, z, p, nll AS nll_a, {_NLL2} AS nll_b,
         ((z >= 0) = (quality = 1))::INT::DOUBLE AS correct_a, ((z / 2 + 0.5 >= 0) = (quality = 1))::INT::DOUBLE AS correct_b,
         z >= 0 AS yes_a, z / 2 + 0.5 >= 0 AS yes_b FROM scored
)"""


def _intervals(ctes: str, reps: int, columns: str = "metric") -> str:
    """Group-bootstrap intervals of means over ``long`` (g, metric, value, ...), the last of ``ctes``; an undefined value is null."""
    return f"""
WITH {ctes}, groups AS (SELECT g, row_number() OVER (ORDER BY sha256(g::VARCHAR)) - 1 AS i FROM (SELECT DISTINCT g FROM long)
), size AS (SELECT count(*) AS n FROM groups
), draws AS (
  SELECT rep, ('0x' || substr(md5(rep::VARCHAR || ':' || slot::VARCHAR), 1, 8))::BIGINT % (SELECT n FROM size) AS i
  FROM range({reps}) r(rep), range((SELECT n FROM size)) s(slot)
), sums AS (SELECT g, {columns}, sum(value) AS s, count(value) AS n FROM long GROUP BY ALL
), reps AS (SELECT rep, {columns}, sum(s) / nullif(sum(n), 0) AS value FROM draws JOIN groups USING (i) JOIN sums USING (g) GROUP BY ALL
), spread AS (
  SELECT {columns}, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high, count(*) AS defined_reps
  FROM reps WHERE value IS NOT NULL GROUP BY ALL
), points AS (SELECT {columns}, round(sum(s) / nullif(sum(n), 0), 6) AS point FROM sums GROUP BY ALL)"""


_SPREAD = "SELECT p.*, low, high, coalesce(defined_reps, 0) AS defined_reps FROM points p LEFT JOIN spread s ON "


def _triplet_sql(above: float) -> str:
    hit = lambda i: f"max((value > {above})::INT::DOUBLE) FILTER (event_id % 3 = {i})"
    return f"""(SELECT event_id // 3 AS g, {hit(0)} AS "real", {hit(1)} AS other, {hit(2)} AS "none" FROM events GROUP BY 1 HAVING count(*) = 3)"""


def _triplet_values(table: str) -> str:
    return f"""(SELECT g, unnest(['real', 'other', 'none', 'accuracy', 'all_correct']) AS metric,
  unnest(["real", other, "none", ("real" + other + "none") / 3, least("real", other, "none")]) AS value FROM {table})"""


_DECIDED = """
WITH c AS (
  SELECT event_id, i, ['click', 'view', 'other'][i] AS name, ('0x' || substr(md5(props || chr(10) || 'Which?' || chr(10) || ['click', 'view', 'other'][i]), 1, 8))::BIGINT % 4001 AS z
  FROM events, unnest([1, 2, 3]) AS u(i))
SELECT event_id::VARCHAR AS id, 'q' AS question_id, arg_max(name, (z, -i)) AS answer FROM c GROUP BY event_id"""

_DOCS = "SELECT doc_id, lang, source, sha256(text) AS input FROM documents"

ORACLES: dict[str, str] = {
    "duplicate_inputs": _duplicates(_DOCS, "lang", "", "input, doc_id, n, kind, CASE WHEN kind = 'within_group' THEN 'warning' ELSE 'error' END AS level"),
    "contradictory_labels": _duplicates("SELECT doc_id, source, sha256(text) AS input, quality FROM documents JOIN labels USING (doc_id)", "quality", "WHERE kind = 'labels'", "input, doc_id, n"),
    "duplicates_across_groups": _duplicates(_DOCS, "1", "WHERE kind = 'groups'", "input, doc_id, n"),
    "dataset_stats": """
WITH d AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT 'language' AS statistic, lang AS value, count(*) AS n FROM d GROUP BY 2
UNION ALL SELECT 'source', source, count(*) FROM d GROUP BY 2
UNION ALL SELECT 'quality', quality::VARCHAR, count(*) FROM d GROUP BY 2
UNION ALL SELECT 'toxic', toxic::VARCHAR, count(*) FROM d GROUP BY 2""",
    "group_size_histogram": "SELECT size, count(*) AS groups FROM (SELECT count(*) AS size FROM conversations GROUP BY conv_id) GROUP BY size",
    "contrasting_groups": """
WITH g AS (SELECT source, lang, count(DISTINCT quality) > 1 AS c FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2),
s AS (SELECT source, bool_or(c) AS c FROM g GROUP BY 1)
SELECT count(*) FILTER (c) AS groups, count(*) AS total FROM s""",
    "group_split": f"WITH {_assign('conversations', 'conv_id', 0)} SELECT * FROM assigned",
    "split_summary": f"""WITH {_assign('orders', 'o_custkey', 7)}
SELECT split, o_orderstatus, count(DISTINCT o_custkey) AS groups, count(*) AS examples FROM orders JOIN assigned USING (o_custkey) GROUP BY 1, 2""",
    "exact_leakage": _shared(f"SELECT sha256(text) AS input, {_SPLIT3} AS split FROM documents", "input"),
    "template_overlap": _shared(f"SELECT lang || ':' || source || ':' || (n_chars // 100)::VARCHAR AS template, {_SPLIT3} AS split FROM documents", "template"),
    "near_duplicates": r"""
WITH reps AS (SELECT text, min(doc_id) AS rep FROM documents GROUP BY text
), words AS (SELECT rep, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') AS w FROM reps
), sets AS (
  SELECT rep, unnest(list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s FROM words WHERE len(w) > 0
), hashed AS (SELECT rep, hash(s) AS s FROM sets
), sizes AS (SELECT rep, count(*) AS n FROM hashed GROUP BY rep
), met AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM hashed a JOIN hashed b ON a.s = b.s AND a.rep < b.rep GROUP BY 1, 2
), near AS (SELECT a, b FROM met JOIN sizes x ON met.a = x.rep JOIN sizes y ON met.b = y.rep WHERE c::DOUBLE / (x.n + y.n - c) >= 0.8
), links AS (SELECT rep, count(*) AS links FROM (SELECT a AS rep FROM near UNION ALL SELECT b FROM near) GROUP BY 1)
SELECT d.doc_id AS id, r.rep, coalesce(l.links, 0) AS links FROM documents d JOIN reps r USING (text) LEFT JOIN links l ON r.rep = l.rep""",
    "exclude_overlap": """
WITH d AS (SELECT doc_id, n_chars AS grp, sha256(text) AS input FROM documents
), ref AS (SELECT DISTINCT input FROM d JOIN labels USING (doc_id) WHERE toxic = 1
), hit AS (SELECT DISTINCT grp FROM d JOIN ref USING (input))
SELECT doc_id, grp FROM d WHERE grp NOT IN (SELECT grp FROM hit)""",
    "expand_ordinal": _expand_sql(),
    "expand_choice_order": "SELECT n_regionkey, (row_number() OVER (PARTITION BY n_regionkey ORDER BY lower(n_name), n_nationkey::VARCHAR) - 1)::INT AS candidate_index, n_nationkey::VARCHAR AS candidate_id FROM nation",
    "escape_pages": "SELECT page_id, sha256(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped_sha256 FROM pages",
    "conversation_state": "SELECT conv_id, count(*) AS turns, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS state_sha256 FROM conversations GROUP BY conv_id",
    "hashed_bow": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+') AS w FROM documents
), g AS (SELECT doc_id, unnest(list_distinct(w || list_transform(range(1, greatest(1, len(w))), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM w
), b AS (SELECT DISTINCT doc_id, ('0x' || substr(md5(g), 1, 8))::BIGINT % 16384 AS b FROM g
), f AS (SELECT doc_id, count(*) AS features, sum(b)::BIGINT AS bucket_sum FROM b GROUP BY 1)
SELECT d.doc_id, coalesce(features, 0) AS features, coalesce(bucket_sum, 0) AS bucket_sum FROM documents d LEFT JOIN f USING (doc_id)""",
    "standardize": "SELECT dim::INT AS dim, round(avg(x), 6) AS mean, round(greatest(stddev_pop(x), 1e-6), 6) AS std FROM (SELECT unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY dim",
    "centroid_logits": f"WITH {_CLASSES} SELECT vec_id, idx::INT AS candidate_index, round(logit, 5) AS logit FROM numbered",
    "softmax_answer": f"""
WITH {_CLASSES}, e AS (SELECT vec_id, idx, exp((logit - max(logit) OVER (PARTITION BY vec_id)) / 0.05::DOUBLE) AS e FROM numbered
), p AS (SELECT vec_id, idx, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e)
SELECT vec_id, arg_max(idx, p)::INT AS choice, round(max(p), 5) AS p_top,
       round(least(1, greatest(0, 1 + sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln(count(*)))), 5) AS confidence FROM p GROUP BY vec_id""",
    "binary_metrics": _binary("lang", "quality", "nll"),
    "family_breakdown": f"""
WITH {_LABELLED}
SELECT lang, source, count(*) AS n, sum(toxic)::BIGINT AS positives, round(avg(nll_toxic), 6) AS nll, round(avg((p - toxic) * (p - toxic)), 6) AS brier,
       round(avg(((p >= 0.5) = (toxic = 1))::INT::DOUBLE), 6) AS accuracy
FROM scored GROUP BY GROUPING SETS ((), (lang), (lang, source))""",
    "reliability": f"""
WITH {_LABELLED}, b AS (SELECT least(floor(p * 15), 14)::INT AS bin, count(*) AS n, avg(p) AS mean_p, avg(quality::DOUBLE) AS frequency FROM scored GROUP BY 1)
SELECT r.bin::INT AS bin, coalesce(n, 0) AS n, round(mean_p, 6) AS mean_p, round(frequency, 6) AS frequency FROM range(15) r(bin) LEFT JOIN b ON r.bin = b.bin""",
    "pairwise": f"""
WITH {_LABELLED}, pairs AS (
  SELECT CASE WHEN a.z > b.z THEN 1.0 WHEN a.z = b.z THEN 0.5 ELSE 0.0 END::DOUBLE AS win
  FROM scored a JOIN scored b ON a.source = b.source AND a.quality = 1 AND b.quality = 0)
SELECT count(*) AS pairs, round(sum(win) / nullif(count(*), 0), 6) AS pairwise_accuracy FROM pairs""",
    "choice_metrics_by_k": """
WITH weights AS (
  SELECT vec_id, 3 + vec_id % 6 AS k, label % (3 + vec_id % 6) AS t, j, (1 + (vec_id * 7 + j * 13) % 11)::DOUBLE AS w
  FROM embeddings, unnest(range(8)) AS u(j) WHERE j < 3 + vec_id % 6
), probs AS (SELECT *, w / sum(w) OVER (PARTITION BY vec_id) AS p FROM weights
), q AS (
  SELECT vec_id, any_value(k) AS k, -ln(max(p) FILTER (j = t)) AS nll, sum((p - (j = t)::INT) * (p - (j = t)::INT)) AS brier,
         (arg_max(j, (w, -j)) = any_value(t))::INT::DOUBLE AS correct, max(p) AS conf, 1 + sum(p * ln(p)) / ln(count(*)) AS conc
  FROM probs GROUP BY vec_id
), bins AS (
  SELECT k, grouping(k) AS g, least(floor(conf * 15), 14) AS bin, count(*) AS n, avg(conf) AS mp, avg(correct) AS f FROM q GROUP BY GROUPING SETS ((bin), (k, bin))
), gaps AS (SELECT k, g, sum(n * abs(mp - f)) / sum(n) AS ece FROM bins GROUP BY k, g
), c AS (
  SELECT k, grouping(k) AS g, count(*) AS n, avg(nll) AS nll, avg(brier) AS brier_sum, avg(correct) AS accuracy, avg(conc) AS mean_concentration, avg(ln(k)) AS uniform_nll
  FROM q GROUP BY GROUPING SETS ((), (k)))
SELECT c.k::VARCHAR AS k, n, round(nll, 6) AS nll, round(brier_sum, 6) AS brier_sum, round(accuracy, 6) AS accuracy, round(mean_concentration, 6) AS mean_concentration,
       round(uniform_nll, 6) AS uniform_nll, round(ece, 6) AS ece FROM c JOIN gaps ON c.g = gaps.g AND c.k IS NOT DISTINCT FROM gaps.k""",
    "ordinal_metrics_by_m": f"""
WITH {_RANKED}, q AS (
  SELECT key, any_value(m) AS m, -ln(max(p) FILTER (j = t)) AS nll,
         sum(CASE WHEN j < m - 1 THEN (f - (t <= j)::INT) * (f - (t <= j)::INT) ELSE 0 END) / (any_value(m) - 1) AS rps,
         abs(sum(j * p) - any_value(t)) AS mae, (arg_max(j, (p, -j)) = any_value(t))::INT::DOUBLE AS correct, 1 + sum(p * ln(p)) / ln(count(*)) AS conc
  FROM cumulated GROUP BY key)
SELECT m::VARCHAR AS m, count(*) AS n, round(avg(nll), 6) AS nll, round(avg(rps), 6) AS rps, round(avg(mae), 6) AS mae, round(avg(mae / (q.m - 1)), 6) AS mae_norm,
       round(avg(correct), 6) AS accuracy, round(avg(conc), 6) AS mean_concentration, round(avg(ln(q.m)), 6) AS uniform_nll
FROM q GROUP BY GROUPING SETS ((), (m))""",
    "cumulative_ece": f"""
WITH {_RANKED}, e AS (SELECT least(1.0, greatest(0.0, f)) AS p, (t <= j)::INT AS y FROM cumulated WHERE j < m - 1
), b AS (SELECT least(floor(p * 15), 14) AS bin, count(*) AS n, avg(p) AS mp, avg(y::DOUBLE) AS f FROM e GROUP BY 1)
SELECT round(sum(n * abs(mp - f)) / sum(n), 6) AS ece, sum(n)::BIGINT AS events FROM b""",
    "prior_baseline": """
WITH c AS (SELECT count(*) FILTER (quality = 1) AS positives, count(quality) AS n FROM labels)
SELECT positives, n, round((positives + 1) / (n + 2), 6) AS p, round(ln(((positives + 1) / (n + 2)) / (1 - (positives + 1) / (n + 2))), 6) AS logit FROM c""",
    "level_prior": """
WITH o AS (SELECT 3 + o_custkey % 3 AS m, o_orderkey % (3 + o_custkey % 3) AS level FROM orders
), g AS (SELECT DISTINCT m, unnest(range(m)) AS level FROM (SELECT DISTINCT m FROM o)
), c AS (SELECT m, level, count(*) AS c FROM o GROUP BY 1, 2)
SELECT g.m::INT AS m, g.level::INT AS level, coalesce(c, 0) AS count, round(ln(coalesce(c, 0) + 1), 6) AS logit FROM g LEFT JOIN c USING (m, level)""",
    "uniform_baseline": "SELECT (3 + o_custkey % 3)::INT AS m, count(*) AS n, round(avg(ln(3 + o_custkey % 3)), 6) AS nll FROM orders GROUP BY 1",
    "temperature_grid": f"""
WITH {_LABELLED}, g AS (SELECT unnest([0.25, 0.5, 1.0, 2.0, 4.0, 8.0])::DOUBLE AS temperature
), s AS (SELECT temperature, z / temperature AS s, quality FROM scored, g)
SELECT 'binary' AS kind, temperature, count(*) AS n, round(avg(greatest(CASE WHEN quality = 1 THEN -s ELSE s END, 0) + ln(1 + exp(-abs(s)))), 6) AS nll FROM s GROUP BY temperature""",
    "bootstrap_hash": f"""
WITH {_LABELLED}, keys AS (SELECT source, row_number() OVER (ORDER BY sha256(source)) - 1 AS i FROM (SELECT DISTINCT source FROM scored)
), size AS (SELECT count(*) AS n FROM keys
), draws AS (
  SELECT rep, ('0x' || substr(md5(rep::VARCHAR || ':' || slot::VARCHAR), 1, 8))::BIGINT % (SELECT n FROM size) AS i
  FROM range(200) r(rep), range((SELECT n FROM size)) s(slot)
), sums AS (SELECT source, sum(nll) AS nll, sum(((z >= 0) = (quality = 1))::INT::DOUBLE) AS hit, count(*)::DOUBLE AS one FROM scored GROUP BY 1
), reps AS (SELECT rep, sum(nll) / sum(one) AS nll, sum(hit) / sum(one) AS accuracy FROM draws JOIN keys USING (i) JOIN sums USING (source) GROUP BY rep)
SELECT 'nll' AS metric, round((SELECT sum(nll) / sum(one) FROM sums), 6) AS point, round(quantile_cont(nll, 0.025), 6) AS low, round(quantile_cont(nll, 0.975), 6) AS high, count(*) AS defined_reps FROM reps
UNION ALL SELECT 'accuracy', round((SELECT sum(hit) / sum(one) FROM sums), 6), round(quantile_cont(accuracy, 0.025), 6), round(quantile_cont(accuracy, 0.975), 6), count(*) FROM reps""",
    "compare_models": f"""
WITH {_LABELLED}, pair AS (
  SELECT lang AS type, nll AS nll_a, greatest(CASE WHEN quality = 1 THEN -(z / 2 + 0.5) ELSE z / 2 + 0.5 END, 0) + ln(1 + exp(-abs(z / 2 + 0.5))) AS nll_b,
         ((z >= 0) = (quality = 1))::INT::DOUBLE AS ca, ((z / 2 + 0.5 >= 0) = (quality = 1))::INT::DOUBLE AS cb FROM scored)
SELECT type, count(*) AS n, round(avg(nll_a), 6) AS nll_a, round(avg(nll_b), 6) AS nll_b, round(avg(nll_b - nll_a), 6) AS d_nll, round(avg(cb - ca), 6) AS d_correct FROM pair GROUP BY type""",
    "swap_states": """
WITH g AS (SELECT conv_id, sha256('5:' || conv_id::VARCHAR) AS h FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT conv_id, coalesce(lead(conv_id) OVER (ORDER BY h), first_value(conv_id) OVER (ORDER BY h)) AS donor FROM g""",
    "triplet_accuracy": """
WITH t AS (
  SELECT event_id // 3 AS t, max((value > 1)::INT) FILTER (event_id % 3 = 0) AS a, max((value > 1)::INT) FILTER (event_id % 3 = 1) AS b, max((value > 1)::INT) FILTER (event_id % 3 = 2) AS c
  FROM events GROUP BY 1 HAVING count(*) = 3)
SELECT count(*) AS triplets, round(avg(a), 6) AS real, round(avg(b), 6) AS other, round(avg(c), 6) AS "none", round(avg((a * b * c)::DOUBLE), 6) AS all_correct FROM t""",
    "option_cue": f"""
WITH names AS (SELECT [{", ".join(f"'{p}'" for p in PRIORITIES)}] AS p
), o AS (SELECT list_sort(list_distinct([o_orderpriority, p[o_custkey % 5 + 1], p[o_orderkey % 5 + 1]])) AS s, o_orderpriority AS l FROM orders, names
), freq AS (SELECT l, count(*) AS f FROM o GROUP BY l
), present AS (SELECT s, unnest(s) AS l FROM (SELECT DISTINCT s FROM o)
), guess AS (SELECT s, arg_max(l, (coalesce(f, 0), l)) AS g FROM present LEFT JOIN freq USING (l) GROUP BY s
), mode AS (SELECT s, max(n) AS hit FROM (SELECT s, l, count(*) AS n FROM o GROUP BY 1, 2) GROUP BY s
), sums AS (SELECT count(*) AS n, count(DISTINCT o.s) AS signatures, count(*) FILTER (l = g) AS prior FROM o JOIN guess ON o.s = guess.s)
SELECT n, signatures, round(prior / n, 6) AS prior_accuracy, round((SELECT sum(hit) FROM mode) / n, 6) AS mode_accuracy, round(((SELECT sum(hit) FROM mode) - prior) / n, 6) AS gain FROM sums""",
    "mutual_information": """
WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS c FROM orders GROUP BY 1, 2
), s AS (SELECT *, sum(c) OVER (PARTITION BY a) AS ca, sum(c) OVER (PARTITION BY b) AS cb, sum(c) OVER () AS n FROM c)
SELECT any_value(n)::BIGINT AS n, round(sum(c / n * log2(c::DOUBLE * n / (ca * cb))), 6) AS bits FROM s""",
    "latency_summary": """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(max(value) FILTER (i = round_even(0.5 * (n - 1), 0)), 6) AS p50,
       round(max(value) FILTER (i = round_even(0.95 * (n - 1), 0)), 6) AS p95, round(max(value), 6) AS max FROM r GROUP BY event_type""",
    "status_counts": """
WITH c AS (SELECT CASE WHEN value > 2 THEN 'queue_full' ELSE 'ok' END AS status, event_type AS error, count(*) AS requests FROM events GROUP BY 1, 2)
SELECT status, error, requests, (sum(requests) OVER ())::BIGINT AS total FROM c""",
    "throughput": "SELECT count(*) AS requests, round(sum(value), 6) AS total, round(count(*) * 1e6 / (epoch_us(max(ts)) - epoch_us(min(ts))), 6) AS per_second FROM events",
    "request_battery": """
WITH q AS (SELECT user_id, 'q' || lpad(event_id::VARCHAR, 12, '0') AS q FROM events
), r AS (SELECT user_id, q, (row_number() OVER (PARTITION BY user_id ORDER BY substr(md5(q), 1, 2), q) - 1) // 8 AS part FROM q)
SELECT user_id, part, count(*) AS questions, min(q) AS first_question FROM r GROUP BY 1, 2""",
    "batch_decide": _DECIDED,
    "stream_decide": _DECIDED,
    "contradictory_templates": _duplicates("SELECT doc_id, source, lang || ':' || (n_chars // 100)::VARCHAR AS input, quality FROM documents JOIN labels USING (doc_id)", "quality", "WHERE kind = 'labels'", "input, doc_id, n"),
    "compare_models_intervals": _intervals(f"""{_JUDGED}, long AS (
  SELECT group_id AS g, unnest(['a.nll_all', 'b.nll_all', 'b_minus_a.nll_all', 'b_minus_a.accuracy_all', 'b_minus_a.en.nll', 'b_minus_a.en.accuracy', 'b_minus_a.es.nll', 'b_minus_a.es.accuracy']) AS metric,
         unnest([nll_a, nll_b, nll_b - nll_a, correct_b - correct_a, if(type = 'en', nll_b - nll_a, NULL), if(type = 'en', correct_b - correct_a, NULL), if(type = 'es', nll_b - nll_a, NULL), if(type = 'es', correct_b - correct_a, NULL)]) AS value
  FROM judged)""", 100) + _SPREAD + "p.metric = s.metric",
    "compare_model_set": _intervals(f"""{_JUDGED}, models AS (
  SELECT id, group_id, unnest([type, 'all']) AS type, nll_a, correct_a, unnest([nll_a, nll_a]) AS nll, unnest([correct_a, correct_a]) AS correct, 'z' AS model FROM judged
  UNION ALL SELECT id, group_id, unnest([type, 'all']), nll_a, correct_a, nll_b, correct_b, 'z2' FROM judged
  UNION ALL SELECT id, group_id, unnest([type, 'all']), nll_a, correct_a, 0.5, (quality = 1)::INT::DOUBLE, 'flat' FROM judged
), long AS (
  SELECT group_id AS g, model, type, unnest(['nll', 'accuracy', 'nll_minus_reference', 'accuracy_minus_reference']) AS metric,
         unnest([nll, correct, nll - nll_a, correct - correct_a]) AS value FROM models)""", 100, "model, type, metric")
    + _SPREAD + "p.model = s.model AND p.type = s.type AND p.metric = s.metric WHERE p.model <> 'z' OR p.metric NOT LIKE '%reference'",
    "bootstrap_spread": f"""
WITH {_LABELLED}, full_rows AS (SELECT s.*, n_chars FROM scored s JOIN documents USING (doc_id)
), groups AS (SELECT source, row_number() OVER (ORDER BY sha256(source)) - 1 AS i FROM (SELECT DISTINCT source FROM full_rows)
), size AS (SELECT count(*) AS n FROM groups
), draws AS (
  SELECT rep, ('0x' || substr(md5(rep::VARCHAR || ':' || slot::VARCHAR), 1, 8))::BIGINT % (SELECT n FROM size) AS i
  FROM range(50) r(rep), range((SELECT n FROM size)) s(slot)
), reps AS (SELECT rep, stddev_pop(z) AS a, max(n_chars)::DOUBLE AS b, avg(z) AS c FROM draws JOIN groups USING (i) JOIN full_rows USING (source) GROUP BY rep
), l AS (SELECT unnest(['z_deviation', 'longest', 'mean_z']) AS metric, unnest([a, b, c]) AS value FROM reps
), p AS (SELECT unnest(['z_deviation', 'longest', 'mean_z']) AS metric, unnest([stddev_pop(z), max(n_chars)::DOUBLE, avg(z)]) AS point FROM full_rows)
SELECT metric, round(any_value(point), 6) AS point, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high, count(*) AS defined_reps FROM l JOIN p USING (metric) GROUP BY metric""",
    "triplet_intervals": _intervals(f"long AS {_triplet_values(_triplet_sql(3))}", 40) + _SPREAD + "p.metric = s.metric",
    "compare_triplets": _intervals(f"""ab AS (
  SELECT g, metric, x.value AS a, y.value AS b FROM {_triplet_values(_triplet_sql(3))} x JOIN {_triplet_values(_triplet_sql(2))} y USING (g, metric)
), long AS (SELECT g, metric, b - a AS value FROM ab)""", 40)
    + " SELECT p.metric, round(avg(a), 6) AS a, round(avg(b), 6) AS b, any_value(point) AS b_minus_a, any_value(low) AS low, any_value(high) AS high, any_value(defined_reps) AS defined_reps FROM points p JOIN spread USING (metric) JOIN ab USING (metric) GROUP BY p.metric",
    "restricted_prior": f"""
WITH names AS (SELECT [{", ".join(f"'{p}'" for p in PRIORITIES)}] AS p
), o AS (SELECT o_orderpriority AS l, p[o_orderkey % 5 + 1] AS other FROM orders, names
), f AS (SELECT l, count(*) AS f FROM o GROUP BY l
), g AS (SELECT o.l, CASE WHEN (coalesce(b.f, 0), other) > (a.f, o.l) THEN other ELSE o.l END AS guess FROM o JOIN f a ON o.l = a.l LEFT JOIN f b ON o.other = b.l)
SELECT count(*) AS n, round(avg((l = guess)::INT::DOUBLE), 6) AS accuracy FROM g""",
    "mean_nll_by_type": f"""
WITH {_JUDGED}, t AS (SELECT unnest(['all', 'en', 'es', 'none such']) AS type)
SELECT t.type, count(nll_a) AS n, round(avg(nll_a), 6) AS nll FROM t LEFT JOIN judged j ON t.type = j.type OR t.type = 'all' GROUP BY t.type""",
    "robustness": f"""
WITH {_JUDGED}, e AS (SELECT unnest([type, 'all']) AS type, correct_a, correct_b, nll_a, nll_b, (yes_a = yes_b)::INT::DOUBLE AS same FROM judged)
SELECT type, count(*) AS n, round(avg(correct_a), 6) AS accuracy_before, round(avg(correct_b), 6) AS accuracy_after, round(avg(nll_a), 6) AS nll_before, round(avg(nll_b), 6) AS nll_after, round(avg(same), 6) AS unchanged FROM e GROUP BY type""",
    "reload_difference": "SELECT count(*) AS questions, round(max(vec_id % 7) * 1e-5::DOUBLE, 6) AS max_difference, max(vec_id % 7) * 1e-5::DOUBLE <= 1e-4 AS within FROM embeddings",
    "answer_violations": f"WITH {_LABELLED} SELECT doc_id, round(z, 6) AS z FROM scored WHERE z NOT BETWEEN 0 AND 1",
    "inspect_errors": f"WITH {_JUDGED} SELECT id, type, group_id AS task_family, round(nll_a, 6) AS nll FROM judged WHERE correct_a = 0",
    "donor_accuracy": f"WITH {_JUDGED} SELECT count(*) AS n, round(avg((yes_a = (quality = 1))::INT::DOUBLE), 6) AS original, round(avg((yes_a = (toxic = 1))::INT::DOUBLE), 6) AS donor FROM judged",
    "batching_tolerance": f"""
WITH {_LABELLED}, d AS (
  SELECT abs(p - (p + (doc_id % 5)::DOUBLE / 1000)) AS d, (p >= 0.5) <> (p + (doc_id % 5)::DOUBLE / 1000 >= 0.5) AS changed, nll,
         greatest(CASE WHEN quality = 1 THEN -(z + 0.01) ELSE z + 0.01 END, 0) + ln(1 + exp(-abs(z + 0.01))) AS nll_q FROM scored
), a AS (SELECT max(d) AS m, quantile_cont(d, 0.95) AS p95, median(d) AS med, count(*) FILTER (changed) AS c, avg(nll_q) - avg(nll) AS dn FROM d)
SELECT round(m, 6) AS max_dp, round(p95, 6) AS p95_dp, round(med, 6) AS median_dp, c AS decision_changes, round(dn, 6) AS delta_nll, 2.25::DOUBLE AS speed_up, m <= 0.02 AND c = 0 AND dn <= 0.005 AS passes FROM a""",
    "step_summary": """
WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events)
SELECT count(*) AS steps, round(median(value), 6) AS median, round(max(value) FILTER (i = floor(0.95 * (n - 1))), 6) AS p95, round(sum(value), 6) AS total, round(avg((value > 2)::INT::DOUBLE), 6) AS clipped_fraction FROM r""",
    "peaks": "SELECT round(max(value), 6) AS value, max(event_id) AS event_id, max(user_id) AS user_id FROM events",
    "order_value_ranks": """
WITH r AS (SELECT o_orderstatus, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderstatus, max(v) FILTER (i = round_even(0.01 * (n - 1), 0)) AS q1, max(v) FILTER (i = round_even(0.25 * (n - 1), 0)) AS q25,
       max(v) FILTER (i = round_even(0.5 * (n - 1), 0)) AS q50, max(v) FILTER (i = round_even(0.99 * (n - 1), 0)) AS q99 FROM r GROUP BY 1""",
    "encode_cached": "SELECT sha256(text) AS row_sha256, (any_value(length(text)) * if(sha256(text) < '8', -1, 1))::INT AS features FROM documents GROUP BY 1",
    "vector_functions": """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l2 FROM e)
SELECT vec_id, round(list_sum(list_transform(v, lambda x: abs(x))), 5) AS l1, round(l2, 5) AS l2, round(v[vec_id % 64 + 1] / l2, 5) AS cosine,
       list_max(list_filter(range(64), lambda i: v[i + 1] > 0.1))::INT AS last_valid, round(list_reverse_sort(v)[3], 5) AS third FROM n""",
    "scalar_functions": """
WITH e AS (SELECT event_id, least(value, 20.0::DOUBLE) AS x, event_id % 100 AS s FROM events)
SELECT event_id, round(greatest(x, 0) + ln(1 + exp(-abs(x))), 6) AS softplus, round(x, 6) AS inverse, round(x / 4, 6) AS logit,
       round(CASE WHEN s < 10 THEN (s + 1)::DOUBLE / 10 ELSE (100 - s)::DOUBLE / 90 END, 6) AS rate, least(floor(15 / (1 + exp(-x / 4))), 14)::INT AS bin FROM e""",
    "rule_labels": """
WITH o AS (
  SELECT o_orderkey, ['requested', 'declined', 'past', 'absent'][o_orderkey % 4 + 1] AS refund, ['double', 'denied', 'absent'][o_custkey % 3 + 1] AS charge,
         ['active', 'resolved', 'absent'][(o_orderkey + o_custkey) % 3 + 1] AS fault, ['network', 'performance', 'data', 'application'][o_custkey % 4 + 1] AS kind,
         ['locked', 'ok', 'absent'][(o_orderkey * 2 + o_custkey) % 3 + 1] AS access, o_custkey % (5 + o_orderkey % 197) AS x, 4 + o_orderkey % 197 AS y, 3 + o_orderkey % 3 AS m, o_custkey % 101 AS v
  FROM orders)
SELECT o_orderkey, (refund = 'requested')::INT AS refund, (charge = 'double')::INT AS double, (fault = 'active')::INT AS fault, (access = 'locked')::INT AS locked,
       (charge = 'double' AND refund = 'requested')::INT AS escalate,
       CASE WHEN charge = 'double' OR refund = 'requested' THEN 0 WHEN access = 'locked' THEN 1 WHEN fault = 'active' THEN 2 ELSE 3 END AS team,
       CASE fault WHEN 'active' THEN 2 WHEN 'resolved' THEN 1 ELSE 0 END AS severity, CASE WHEN fault = 'absent' THEN 'none' ELSE kind END AS category,
       CASE WHEN x = 0 THEN 0 WHEN x = y THEN m - 1 WHEN m = 3 THEN 1 WHEN m = 4 THEN if(x * 2 < y, 1, 2) WHEN x * 4 <= y THEN 1 WHEN x * 2 <= y THEN 2 ELSE 3 END::INT AS impact,
       ((v > 25)::INT + (v > 50)::INT + (v > 75)::INT)::INT AS panel FROM o""",
    "first_of_types": "SELECT doc_id, lang AS type, n_chars FROM documents WHERE lang IN ('en', 'es') ORDER BY n_chars, doc_id LIMIT 500",
    "too_long_rows": """
WITH g AS (SELECT lang, count(*) FILTER (n_chars > 2000) AS rejected, max(n_chars) FILTER (n_chars > 2000) AS longest, count(*) FILTER (n_chars <= 2000) AS kept FROM documents GROUP BY lang)
SELECT lang, nullif(rejected, 0) AS rejected, longest::BIGINT AS longest, nullif(kept, 0) AS kept FROM g""",
    "longest_first": """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS r FROM documents)
SELECT doc_id, r // 16 AS batch, (r % 16)::INT AS place FROM r""",
    "predictions_struct": f"""
WITH {_CLASSES}, e AS (SELECT vec_id, label, idx, logit, (logit - max(logit) OVER (PARTITION BY vec_id)) / 0.05::DOUBLE AS s FROM numbered
), p AS (SELECT vec_id, any_value(label) AS label, arg_max(idx, logit) AS best, ln(sum(exp(s))) - max(s) FILTER (idx = label) AS nll FROM e GROUP BY vec_id)
SELECT vec_id::VARCHAR AS id, label::INT AS target_index, round(nll, 6) AS nll, best = label AS correct, 'c' || best::VARCHAR AS choice FROM p""",
}
