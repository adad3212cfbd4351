"""Exact accounts of a served stream: kills between sink and commit, repeated requests, restarts."""

import json

import pytest

from tallyloom.streaming import served
from tallyloom.streaming.decide import hashed_scorer


def body(ident, state="text", **questions):
    asked = questions or {"q": {"type": "binary", "instructions": "Is it?"}}
    return json.dumps({"id": ident, "state": state, "questions": asked})


@pytest.fixture
def stream(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def put(name, bodies):
        (tmp_path / "in" / f"{name}.txt").write_text("\n".join(bodies) + "\n")

    def run(writer=None, sink="sink", checkpoint="state"):
        source = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
        query = served.serve_stream(source, hashed_scorer, str(tmp_path / sink), str(tmp_path / checkpoint), writer=writer)
        try:
            assert query.awaitTermination(60)
        finally:
            query.stop()
        return query.exception()

    return put, run, str(tmp_path / "sink")


def told(spark, sink):
    return served.totals(spark, sink).first().asDict()


@pytest.mark.parametrize("dies", ["before the sink", "between sink and account", "between account and commit"])
def test_a_killed_batch_is_counted_once(spark, stream, dies):
    put, run, sink = stream
    put("a", [body("1"), body("2"), "not json"])
    assert run() is None
    put("b", [body("3"), body("1"), body("4", state=" ")])
    whole, calls = served.write_batch(hashed_scorer, sink), []

    def writer(batch, number):
        calls.append(number)
        if dies == "between account and commit":
            whole(batch, number)
        elif dies == "between sink and account":
            batch.limit(1).write.mode("overwrite").parquet(f"{sink}/answers/batch={number}")
        raise OSError("killed")

    with pytest.raises(Exception, match="killed"):
        run(writer)
    if dies == "between sink and account":
        assert told(spark, sink)["batches"] == 1  # answers without an account don't count
    assert run() is None and calls == [1]
    assert told(spark, sink) == {"batches": 2, "received": 6, "repeated": 1, "refused": 2, "answered": 3, "questions": 3, "expanded_rows": 3}
    assert sorted(r.id for r in served.answers(spark, sink).collect()) == ["1", "2", "3"]
    assert {k: v for r in served.accounts(spark, sink).collect() for k, v in (r.errors or {}).items()} == {"invalid_json": 1, "empty_state": 1}
    assert run() is None and told(spark, sink)["received"] == 6  # nothing new


def test_repetitions_within_and_between_batches(spark, stream):
    put, run, sink = stream
    put("a", [body("1")] * 3 + [body("2", a={"type": "choice", "instructions": "?", "options": ["x", "y", "z"]}, b={"type": "binary", "instructions": "?"})])
    assert run() is None
    put("b", [body("1"), body("2"), json.dumps({"state": "no id", "questions": {"q": {"type": "binary", "instructions": "?"}}}), json.dumps({"state": "no id", "questions": {"q": {"type": "binary", "instructions": "?"}}})])
    assert run() is None
    assert told(spark, sink) == {"batches": 2, "received": 8, "repeated": 4, "refused": 0, "answered": 4, "questions": 5, "expanded_rows": 7}


def test_a_sink_belongs_to_one_stream(spark, stream):
    put, run, _ = stream
    put("a", [body("1")])
    assert run() is None
    with pytest.raises(ValueError, match="another stream"):
        run(checkpoint="elsewhere")
