"""Licence scans: the n-gram tables against loops, and planted notices among ordinary lines."""

import random

import numpy as np
import pytest

from tallyloom.llm.licences import FAMILIES, TEMPLATES, Vocabulary, fit, scan_licences, words_of
from tallyloom.llm.queries import op10_scan_licences

MIDDLE = "/root/testdata/sf0.01"


def test_grams_against_loops():
    texts = [words_of(t) for f in FAMILIES for t in TEMPLATES[f]]
    v = Vocabulary.build(texts)
    listed = {}
    for text in texts:
        for size in (1, 2, 3):
            for i in range(len(text) - size + 1):
                listed.setdefault(tuple(text[i : i + size]))
    assert v.features == len(listed) + 1
    rng = random.Random(4)
    pool = [w for t in texts for w in t] + [b"unheard"]
    units = [[rng.choice(pool) for _ in range(rng.randrange(0, 9))] + rng.choice(texts)[:5] for _ in range(60)]
    numbers = np.array([v.words.get(w, 0) for u in units for w in u], dtype=np.int32)
    owner = np.repeat(np.arange(len(units)), [len(u) for u in units])
    features, owners, pairs = v.grams(numbers, owner)
    for i, unit in enumerate(units):
        n = [sum(tuple(unit[k : k + size]) in listed for k in range(len(unit) - size + 1)) for size in (1, 2, 3)]
        assert (owners == i).sum() == sum(n)
        assert (owners[pairs] == i).sum() == n[1]
    assert len(np.unique(features)) <= v.features


@pytest.fixture(scope="module")
def planted(spark):
    """One notice per family and template, changed a little, each in a document of ordinary lines."""
    documents = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    model = fit(documents)
    plain = [" ".join(f"ordinary{(i * 7 + j) % 50}" for j in range(12)) for i in range(20)]
    rows, where = [], {}
    for family in FAMILIES:
        for k, template in enumerate(TEMPLATES[family]):
            for form in (template, template.upper(), f"  * {template}  "):
                line = len(rows) % 7
                where[len(rows)] = (family, line)
                rows.append((len(rows), "\n".join([*plain[:line], form, *plain[line:]])))
    misses = ["All rights reserved.", "The licence of the car was lost on the way to the museum.", "Permission was given to leave early.", "This program is about the weather of the week."]
    rows += [(10_000 + i, t) for i, t in enumerate(misses * 3)]
    out = scan_licences(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    return where, out, model


def test_planted_notices_are_found(planted):
    where, out, _ = planted
    found = {(r.doc_id, r.line): r.family for r in out}
    right = [found.get((d, line)) == family for d, (family, line) in where.items()]
    assert np.mean(right) >= 0.95, [where[d] for d, ok in enumerate(right) if not ok]
    assert not [k for k in found if k[0] >= 10_000 or where[k[0]][1] != k[1]]
    assert all(0.5 <= r.probability <= 1 for r in out)


def test_the_query_finds_whole_notices(spark):
    """Every line that is a template, whole, has its family; nothing is found where no licence word stands."""
    out = op10_scan_licences(spark, MIDDLE).collect()
    found = {(r.doc_id, r.line): r.family for r in out}
    rows = {r.doc_id: (r.text or "").split("\n") for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    whole = {tuple(words_of(t)): f for f in FAMILIES for t in TEMPLATES[f]}
    expected = {(d, i): whole[key] for d, lines in rows.items() for i, line in enumerate(lines) if (key := tuple(words_of(line))) in whole}
    assert expected and {k: found.get(k) for k in expected} == expected
    known = {w for t in whole for w in t}
    assert all(sum(w in known for w in words_of(rows[d][i])) >= 2 for d, i in found)


def _wrapped(words, width):
    return "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))


def test_notices_inside_long_lines_and_wrapped_ones(spark, planted):
    """Every whole notice of 12 words or more is found amid 2,000 words of one line, and over lines of 6 or 10 words: where
    it begins, or in a line of it that is a notice's part by itself."""
    _, _, model = planted
    rng = random.Random(6)
    ordinary = "the of and to a in is for that on with was as it by from at this which or an be".split() + [f"plain{i}" for i in range(60)]
    said = lambda n: " ".join(rng.choice(ordinary) for _ in range(n))
    rows, where = [], {}
    for family in FAMILIES:
        for template in TEMPLATES[family]:
            if len(template.split()) >= 12:
                wrapped = len(_wrapped(template.split(), 6).split("\n"))
                for text, line in ((f"{said(rng.randrange(1000))} {template} {said(1000)}", 0), (f"{said(30)}\n\n{said(9)}\n{_wrapped(template.split(), 6)}\n{said(9)}", 3), (f"{said(700)}\n{_wrapped(template.split(), 10)}", 1)):
                    where[len(rows)] = (family, range(line, line + (wrapped if line else 1)))
                    rows.append((len(rows), text))
    rows += [(10_000 + i, said(3000)) for i in range(10)] + [(10_100 + i, _wrapped(said(3000).split(), 9)) for i in range(10)]
    out = scan_licences(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    found = {}
    for r in out:
        found.setdefault(r.doc_id, set()).add((r.family, r.line))
    missed = [(where[d], sorted(found.get(d, set()))) for d in where if not any(f == where[d][0] and k in where[d][1] for f, k in found.get(d, set()))]
    assert len(missed) <= 0.05 * len(where), missed
    assert not [d for d in found if d >= 10_000]
    assert len(out) == len({(r.doc_id, r.family, r.line) for r in out})


def test_windows_against_loops(planted):
    """The windows' finds are those of a loop over every block's windows."""
    import pyarrow as pa

    from tallyloom.llm.licences import LEAST_HELD, LEAST_PROBABILITY, STEP, UNKNOWN, WINDOW, _in_lines, _in_windows, _units

    _, _, model = planted
    rng = random.Random(9)
    pool = [t for f in FAMILIES for t in TEMPLATES[f]]
    texts = []
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 5)):
            words += [rng.choice(["of", "the", "plain", "software", "is"]) for _ in range(rng.randrange(0, 120))] + rng.choice(pool).split()
        texts.append("".join(w + rng.choice([" "] * 12 + ["\n", "\n\n"]) for w in words))
    split = _units(pa.array(texts), model.vocabulary)
    lines = _in_lines(model, *split)
    expected = set()
    for t, text in enumerate(texts):
        block, blocks = [], []
        for number, line in enumerate([*text.split("\n"), ""]):
            if own := words_of(line):
                block += [(number, w) for w in own]
            elif block:
                blocks.append(block)
                block = []
        for block in blocks:
            if len(block) <= WINDOW and block[0][0] == block[-1][0]:
                continue
            coded = np.array([model.vocabulary.words.get(w, 0) for _, w in block], dtype=np.int32)
            features, place, pairs = model.vocabulary.grams(coded, np.zeros(len(coded), dtype=np.int64), np.arange(len(coded)))
            count = max(0, -(-(len(block) - WINDOW) // STEP)) + 1
            seen = set()
            for k in range(count):
                inside = (place >= k * STEP) & (place < k * STEP + WINDOW)
                if not (inside & pairs).any():
                    continue
                chance = model.probabilities(features[inside], np.zeros(inside.sum(), dtype=np.int64), 1)[0]
                family = int(chance[:UNKNOWN].argmax())
                if chance[family] < max(LEAST_PROBABILITY, chance[UNKNOWN]) or family in seen:
                    continue
                around = pairs & (place >= max(0, k - 1) * STEP) & (place < min(k + 1, count - 1) * STEP + WINDOW)
                held, template = model.best_template(family, set(features[around].tolist()))
                if held >= LEAST_HELD:
                    seen.add(family)
                    if not any(r[0] == t and r[2] == family and block[0][0] <= r[1] <= block[-1][0] for r in lines):
                        places = sorted(set(place[around & np.isin(features, template)].tolist()))
                        begin = max(places, key=lambda p: (sum(p <= q < p + len(template) for q in places), -p))
                        expected.add((t, block[begin][0], family))
    assert expected and {r[:3] for r in _in_windows(model, *split, lines)} == expected


def test_the_sample_is_the_rows_of_least_hashes(spark, monkeypatch):
    """Whatever bound the rows are first cut by, also where copies of one row are many."""
    from pyspark.sql import functions as F

    from tallyloom.llm import licences

    monkeypatch.setattr(licences, "train", lambda lines: lines)
    df = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 1000, "same").otherwise(F.concat(F.lit("a\nb"), "id")).alias("text"))
    marks = df.select("doc_id", "text", F.xxhash64(F.lit(licences.SEED), F.col("doc_id").cast("string"), "text").alias("m")).collect()
    for size in (5, 40, 2000):
        least = sorted(marks, key=lambda r: (r.m, r.doc_id))[:size]
        expected = sorted((str(r.doc_id), r.text.split("\n")) for r in least)
        assert licences.fit(df, sample_documents=size) == [line for _, lines in expected for line in lines]


def test_awkward_rows_and_an_empty_table(planted, awkward, nothing):
    _, _, model = planted
    assert scan_licences(awkward, model).count() == 0
    assert scan_licences(nothing).count() == 0
    assert scan_licences(awkward).count() == 0
