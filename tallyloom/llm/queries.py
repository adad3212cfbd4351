"""The queries over the corpus operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm.alignment import align
from tallyloom.llm.binpack import read_tokens, write_tokens
from tallyloom.llm.common import shared_dir
from tallyloom.llm.codebooks import encode_vectors
from tallyloom.llm.decontam import contaminated
from tallyloom.llm.exact import dedup_exact
from tallyloom.llm.licences import scan_licences
from tallyloom.llm.lines import dedup_lines
from tallyloom.llm.mixing import mix_sources
from tallyloom.llm.repetition import repetition
from tallyloom.llm.secretscan import scan_secrets
from tallyloom.llm.simhash import near_duplicates
from tallyloom.llm.toxicity import fit, score_documents
from tallyloom.llm.urls import judge_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=3)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), vocabulary=corpus_pipeline.VOCABULARY)
    return read_tokens(spark, folder)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "start", "words", "distance")


def op5_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(_table(spark, sf_dir, "documents"), min_docs=5, min_chars=40)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_quality_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = repetition(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat")


def op7_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_random")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    scored = score_documents(documents, fit(documents, _table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= corpus_pipeline.TOXIC_FROM).cast("int").alias("predicted"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(_table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_scan_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "line", "family", F.round("probability", 6).alias("probability"), F.round("agreement", 6).alias("agreement"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_vectors(_table(spark, sf_dir, "embeddings"), columns=["label"])
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_exact(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op13_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_simhash_groups": op2_simhash_groups,
    "op3_pack_tokens": op3_pack_tokens,
    "op4_decontaminate": op4_decontaminate,
    "op5_dedup_lines": op5_dedup_lines,
    "op6_quality_repeats": op6_quality_repeats,
    "op7_scan_secrets": op7_scan_secrets,
    "op8_toxicity": op8_toxicity,
    "op9_url_filter": op9_url_filter,
    "op10_scan_licences": op10_scan_licences,
    "op11_vector_codes": op11_vector_codes,
    "op12_dedup_exact": op12_dedup_exact,
    "op13_align_tokens": op13_align_tokens,
    "pipeline": corpus_pipeline.run,
}

_OP5_SQL = """
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place
  FROM documents
), keyed AS (
  SELECT doc_id, line, place,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM split
), gone AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.line, k.place, coalesce(k.doc_id < g.last, false) AS dropped
  FROM keyed k LEFT JOIN gone g ON k.key = g.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_OP9_SQL = r"""
WITH parsed AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path
  FROM pages
), ruled AS (
  SELECT *, host || path AS text,
    CASE WHEN ('.' || host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN ('.' || host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN ('.' || host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN ('.' || host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN ('.' || host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parsed
), texts AS (
  SELECT text, count(*) FILTER (rule IN ('com/', 'www.example.com/en/'))::DOUBLE AS allowed,
         count(*) FILTER (rule IN ('example.com/en/', 'net/es/', 'net/fr/'))::DOUBLE AS blocked
  FROM ruled GROUP BY text
), padded AS (
  SELECT *, repeat(chr(2), 3) || text || chr(3) AS p FROM texts
), places AS (
  SELECT text, allowed, blocked, substring(p, i, 4) AS gram
  FROM (SELECT *, unnest(range(1, length(p) - 2)) AS i FROM padded)
), grams AS (SELECT gram, sum(allowed) AS a, sum(blocked) AS b FROM places GROUP BY gram
), t1 AS (SELECT right(gram, 1) AS tail, sum(a) AS a, sum(b) AS b FROM grams GROUP BY 1
), p1 AS (
  SELECT tail, (a + 4.0 * (1.0::DOUBLE / 256)) / ((SELECT sum(a) FROM grams) + 4.0) AS pa,
         (b + 4.0 * (1.0::DOUBLE / 256)) / ((SELECT sum(b) FROM grams) + 4.0) AS pb FROM t1
), t2 AS (SELECT right(gram, 2) AS tail, sum(a) AS a, sum(b) AS b FROM grams GROUP BY 1
), c2 AS (SELECT substring(right(gram, 2), 1, 1) AS context, sum(a) AS ta, sum(b) AS tb FROM grams GROUP BY 1
), p2 AS (
  SELECT t.tail, (a + 4.0 * pa) / (ta + 4.0) AS pa, (b + 4.0 * pb) / (tb + 4.0) AS pb
  FROM t2 t JOIN c2 ON substring(t.tail, 1, 1) = c2.context JOIN p1 ON right(t.tail, 1) = p1.tail
), t3 AS (SELECT right(gram, 3) AS tail, sum(a) AS a, sum(b) AS b FROM grams GROUP BY 1
), c3 AS (SELECT substring(right(gram, 3), 1, 2) AS context, sum(a) AS ta, sum(b) AS tb FROM grams GROUP BY 1
), p3 AS (
  SELECT t.tail, (a + 4.0 * pa) / (ta + 4.0) AS pa, (b + 4.0 * pb) / (tb + 4.0) AS pb
  FROM t3 t JOIN c3 ON substring(t.tail, 1, 2) = c3.context JOIN p2 ON right(t.tail, 2) = p2.tail
), c4 AS (SELECT substring(gram, 1, 3) AS context, sum(a) AS ta, sum(b) AS tb FROM grams GROUP BY 1
), model AS (
  SELECT g.gram, round((ln((a + 4.0 * pa) / (ta + 4.0)) - ln((b + 4.0 * pb) / (tb + 4.0))) * 1000000)::BIGINT AS ratio
  FROM grams g JOIN c4 ON substring(g.gram, 1, 3) = c4.context JOIN p3 ON right(g.gram, 3) = p3.tail
), scored AS (
  SELECT text, any_value(allowed) AS allowed, any_value(blocked) AS blocked,
         sum(ratio)::DOUBLE / count(*) / 1000000 AS score
  FROM places JOIN model USING (gram) GROUP BY text
), bins AS (
  SELECT floor(score * 1000) AS bin, sum(allowed) AS n FROM scored WHERE allowed > 0 GROUP BY 1
), cut AS (
  SELECT min(bin) / 1000 AS threshold
  FROM (SELECT bin, sum(n) OVER (ORDER BY bin) AS below FROM bins)
  WHERE below > 0.01 * (SELECT sum(allowed) FROM scored) AND (SELECT sum(blocked) FROM scored) > 0
)
SELECT r.page_id, r.host, r.path, r.rule,
       CASE WHEN r.rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN r.rule IS NOT NULL THEN 'block'
            WHEN s.score < (SELECT threshold FROM cut) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled r JOIN scored s USING (text)
"""

_OP12_SQL = """
WITH rows AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), groups AS (
  SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY text
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256
FROM rows JOIN groups USING (text)
"""



def _op11_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Full scans, with a common table for each round's codes and codebooks."""
    tables = [f"""
kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v,
         row_number() OVER (ORDER BY vec_id) - 1 AS rank
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), places AS MATERIALIZED (
  SELECT vec_id, rank, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS part
  FROM kept, range({parts}) AS r(p)
), book0 AS MATERIALIZED (SELECT p, rank AS e, part AS entry FROM places WHERE rank < {entries})"""]
    for r in range(rounds + 1):
        tables.append(f"""
code{r} AS MATERIALIZED (
  SELECT vec_id, p, any_value(part) AS part, min({{d: d, e: e}}) AS best
  FROM (SELECT vec_id, places.p, part, e,
               list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM places JOIN book{r} USING (p))
  GROUP BY vec_id, p)""")
        if r < rounds:
            tables.append(f"""
book{r + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(n.entry, b.entry) AS entry
  FROM book{r} b LEFT JOIN (
    SELECT p, e, list(floor(s / n)::BIGINT ORDER BY i) AS entry
    FROM (SELECT p, best.e AS e, i, sum(part[i])::DOUBLE AS s, count(*) AS n
          FROM code{r}, generate_series(1, len(part)) AS g(i) GROUP BY ALL)
    GROUP BY p, e) n USING (p, e))""")
    return f"""WITH {", ".join(tables)}, coded AS (
  SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error
  FROM code{rounds} GROUP BY vec_id
), summed AS (
  SELECT label, sum(error)::BIGINT AS label_error FROM coded JOIN kept USING (vec_id) GROUP BY label
)
SELECT vec_id, code, error, label_error,
       (SELECT sha256(string_agg(list_aggregate(entry, 'string_agg', ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id) JOIN summed ON kept.label IS NOT DISTINCT FROM summed.label
"""


ORACLES: dict[str, str] = {"op11_vector_codes": _op11_sql(), "op5_dedup_lines": _OP5_SQL, "op9_url_filter": _OP9_SQL, "op12_dedup_exact": _OP12_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
