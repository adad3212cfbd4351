"""Versions of the generator: unique states, label rules, options that don't tell, and what each version adds."""

import json
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.text import canonical_json
from tallyloom.operators import generate as G
from tallyloom.operators.validate import record_errors

CASES = 1500


@pytest.fixture(scope="module", params=[1, 4, 5])
def made(request, spark):
    return request.param, G.generate_mixed(spark, CASES, 7, 4, version=request.param).cache()


def category(description):
    [name] = [n for names in G.CATEGORIES.values() for n, text in names.items() if text == description]
    return name


def test_examples_are_valid_and_states_unique(made):
    version, df = made
    assert df.count() == 4 * CASES == df.select("id").distinct().count()
    assert df.where(F.size(record_errors()) > 0).count() == 0
    assert df.select("group_id").distinct().count() == df.select("state").distinct().count() == CASES
    assert df.select("provenance.generator_version").distinct().collect() == [(f"mixed-{version}",)]


def test_json_states_are_canonical_and_hold_the_impact(made):
    rows = made[1].dropDuplicates(["group_id"]).collect()
    told = [r for r in rows if r.state_kind == "object"]
    assert 0.25 < len(told) / len(rows) < 0.35
    for r in told:
        state = json.loads(r.state)
        assert canonical_json(state) == r.state and state["channel"] in G.CHANNELS
        assert (state.get("affected_users"), state.get("total_users")) == ((r.facts.impact.x, r.facts.impact.y) if r.facts.impact else (None, None))
    assert len({s for r in rows for s in (r.state.split(".")[0],)}) > CASES / 10


def test_labels_follow_from_facts(made):
    version, df = made
    kinds, turned = Counter(), Counter()
    for r in df.collect():
        f, q, t = r.facts, r.question, r.target
        kinds[q.type] += 1
        refund, double, locked = f.refund == "requested", f.charge == "double", f.access == "locked"
        if q.type == "binary":
            assert t.label == int({"refund": refund, "double": double, "fault": f.fault == "active", "locked": locked, "escalate": refund and double}[r.task_family])
        elif r.task_family == "team":
            [said] = [o.description for o in q.options if o.id == t.class_id]
            assert said == G._TEAMS[r.language][0 if refund or double else 1 if locked else 2 if f.fault == "active" else 3]
        elif r.task_family == "fault_type":
            names = {o.id: category(o.description) for o in q.options}
            true = "none" if f.fault == "absent" else f.fault_kind
            assert 3 <= len(names) == len(set(names.values())) <= 6
            assert names[t.class_id] == (true if true in names.values() else "other")
            assert ("other clause" if version == 5 else "") == ("other clause" if q.instructions.endswith(G._OTHER_CLAUSE[r.language]) else "")
        else:
            back = r.provenance.label_method.endswith("_turned")
            turned[back] += 1
            levels = q.levels[::-1] if back else q.levels
            level = len(levels) - 1 - t.level_index if back else t.level_index
            assert tuple(levels) == G._RUBRICS[r.language]["severity" if r.task_family == "severity" else len(levels)]
            if r.task_family == "severity":
                assert level == {"absent": 0, "resolved": 1, "active": 2}[f.fault]
            else:
                x, y, m = f.impact.x, f.impact.y, len(levels)
                assert level == (0 if x == 0 else m - 1 if x == y else 1 if m == 3 else (1 if x / y < 0.5 else 2) if m == 4 else sum(x / y > b for b in (0, 0.25, 0.5)))
        clause = G._ACCESS_CLAUSE[r.language] in q.instructions
        assert clause == (version >= 3 and r.task_family in G.FAULT_FAMILIES)
    n = sum(kinds.values())
    assert abs(kinds["binary"] / n - 0.4) < 0.1 and kinds["choice"] > 0.2 * n and kinds["ordinal"] > 0.2 * n  # of a case's four, no kind twice
    assert (not turned[True]) if version == 1 else abs(turned[True] / sum(turned.values()) - 0.5) < 0.07


def test_what_the_number_of_options_tells(made):
    """From version 4 on, the share of ``other`` among faulty cases is that of no size in particular."""
    version, df = made
    rows = df.where("task_family = 'fault_type' AND facts.fault != 'absent'").collect()
    by_size = defaultdict(list)
    for r in rows:
        [said] = [category(o.description) for o in r.question.options if o.id == r.target.class_id]
        by_size[len(r.question.options)].append(said == "other")
    shares = {k: sum(v) / len(v) for k, v in by_size.items()}
    if version == 4:
        assert all(abs(s - G.OTHER_RATE) < 0.12 for s in shares.values())
    if version == 5:  # of eight categories, size - 2 are drawn
        assert all(abs(s - (1 - (k - 2) / 8)) < 0.15 for k, s in shares.items())


def test_options_of_version_5_dont_depend_on_the_facts(spark):
    rows = G.generate_mixed(spark, 3000, 5, 2, only="choice", version=5).where("task_family = 'fault_type'").collect()
    seen = defaultdict(Counter)
    for r in rows:
        names = {category(o.description) for o in r.question.options}
        assert {"none", "other"} <= names
        for n in names - {"none", "other"}:
            seen[r.facts.fault == "absent"][n] += 1
    for absent, counts in seen.items():
        n = sum((r.facts.fault == "absent") == absent for r in rows)
        assert all(abs(c / n - 2.5 / 8) < 0.06 for c in counts.values()), (absent, counts)


def test_many_cases_collide_and_are_drawn_again(spark, monkeypatch):
    """With no reference numbers and one phrase each, states repeat; all are different in the end."""
    for pool in ("_LEADS", "_USERS", "_OPENERS", "_CLOSERS"):
        monkeypatch.setattr(G, pool, {k: v[-1:] for k, v in getattr(G, pool).items()})
    monkeypatch.setattr(G, "_REFERENCE", {"es": ("",), "en": ("",)})
    df = G.unique_states(spark, 20_000, 3)
    assert df.count() == 20_000 == df.select("state").distinct().count() == df.select("case").distinct().count()


def test_the_same_in_any_partitioning_and_wrong_arguments(spark):
    a = sorted(map(str, G.generate_mixed(spark, 50, 2, 3).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert sorted(map(str, G.generate_mixed(spark, 50, 2, 3).collect())) == a
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for cases, questions, version in ((0, 1, 5), (5, 0, 5), (5, 9, 5), (5, 1, 6)):
        with pytest.raises(ValueError, match="at least one case"):
            G.generate_mixed(spark, cases, 1, questions, version=version)
