"""The pipeline: every stage against a brute-force decision on its own input, and the queries' registration."""

import re
import uuid
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tallyloom.llm import queries
from tallyloom.llm.toxicity import fit, score_texts
from tests.llm.conftest import AWKWARD, SMALL
from tests.llm.test_decontam import slow
from tests.llm.test_similar import slow_components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output as lists of rows, all written and read again."""
    root, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SMALL).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        out.append((before, docs))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_names_and_columns(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "mixing", "token_output"]
    for before, after in stages[:-1]:
        assert after.columns == before.columns
    assert set(queries.QUERIES) >= {"pipeline", "op1_mix_sources", "op10_scan_licences"} and len(queries.QUERIES) == 11


def test_toxic_documents_go(spark, stages):
    before, after = stages[0]
    rows = texts(before)
    model = fit(before, spark.read.parquet(f"{SMALL}/labels.parquet"))
    scores = score_texts(model, pa.array(list(rows.values()), pa.string()))
    sure = {d: s for d, s in zip(rows, scores) if abs(s - corpus_pipeline.TOXIC_FROM) > 1e-6}
    kept = texts(after)
    assert {d for d, s in sure.items() if s < corpus_pipeline.TOXIC_FROM} == set(kept) & set(sure)


def test_one_of_each_group_stays(stages):
    before, after = stages[1]
    rows = texts(before)
    ids = sorted(rows)
    groups = slow_components([(d, rows[d]) for d in ids])
    assert sorted(texts(after)) == sorted(set(groups))


def test_contaminated_documents_go(spark, stages):
    before, after = stages[2]
    rows = texts(before)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert set(rows) - set(texts(after)) == {d for d, _ in slow(rows.items(), items)}


def test_sources_come_near_their_targets(stages):
    before, after = stages[3]
    size = {r.doc_id: len(WORDS.findall(r.text or "")) for r in before.collect()}
    source = {r.doc_id: r.source for r in before.collect()}
    taken = Counter(r.doc_id for r in after.collect())
    assert all(c <= 2 for c in taken.values())
    total = sum(size.values())
    got = sum(size[d] * c for d, c in taken.items())
    assert abs(got - 1.5 * total) <= len(set(source.values())) * max(size.values())


def test_equal_rows_share_their_copies(spark):
    rows = [(i // 4, "word " * (1 + i // 4 % 5), "hot" if i % 40 else "cold") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = Counter((r.doc_id, r.source) for r in corpus_pipeline.mix(spark, docs, SMALL).collect())
    words = sum(len(t.split()) for _, t, _ in rows)
    assert abs(sum((1 + d % 5) * n for (d, _), n in taken.items()) - 1.5 * words) <= 10
    for d in range(100):
        assert sum(taken[d, s] for s in ("hot", "cold")) in range(4, 9)


def test_tokens_are_the_last_input(stages):
    before, after = stages[4]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, expected = 0, []
    for r in sorted(before.collect(), key=lambda r: (r.doc_id, r.text or "")):
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        expected.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, after.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1]) == expected


def test_run_gives_the_stages_rows(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(tuple, stages[-1][1].collect()))


@pytest.mark.parametrize("rows", [AWKWARD, []])
def test_awkward_rows_and_an_empty_table(spark, tmp_path, rows):
    folder = f"{tmp_path}/{uuid.uuid4().hex}"
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'en' AS lang", "length(text) AS n_chars", "'x' AS _print", "1 AS component_id", "2 AS _copies", "3 AS _rows")
    documents.write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == documents.columns
        docs.count()
    assert corpus_pipeline.run(spark, folder).count() == docs.count()
