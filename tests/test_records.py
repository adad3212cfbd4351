import base64
import hashlib
import json
from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom import schema as S
from tallyloom.sources import png, records, sinks


#: A valid record of each question type as a file has it, by our name of the type.
QUESTIONS = {
    S.BINARY: ({"type": "noul", "instructions": "Is it?"}, {"label": 0}),
    S.CHOICE: ({"type": "choice", "instructions": "Which?", "criteria": {"a": "First", "b": "Second"}}, {"class_id": "b"}),
    S.ORDINAL: ({"type": "score", "instructions": "How?", "criteria": ["low", "high"]}, {"level_index": 0}),
}
TEXTS = ("id", "group_id", "task_family", "language")


def example(kind=S.CHOICE, **changes):
    question, target = QUESTIONS[kind]
    raw = {"schema_version": S.SCHEMA_VERSION, **dict.fromkeys(TEXTS[:3], "one"), "language": S.LANGUAGES[0], "state": "text", "question": question, "target": target}
    return raw | {"provenance": {"source": S.SOURCES[0], "generator_version": "1", "label_method": "m"}} | changes


def nested(depth):
    return [nested(depth - 1)] if depth > 1 else [1]


def choice(n, text=lambda i: f"text {i}"):
    criteria = {f"o{i}": text(i) for i in range(n)}
    return {"question": {"type": "choice", "instructions": "?", "criteria": criteria}, "target": {"class_id": "o0"}}


def ordinal(n, text=lambda i: f"level {i}", level=0):
    return {"question": {"type": "score", "instructions": "?", "criteria": [text(i) for i in range(n)]}, "target": {"level_index": level}}


def asked(kind, **changes):
    return {"question": QUESTIONS[kind][0] | changes, "target": QUESTIONS[kind][1]}


def provenance(**changes):
    return {"provenance": example()["provenance"] | changes}


def within_bounds():
    """Every bounded field at both ends of what is allowed."""
    yield from ({name: "x" * n} for name in TEXTS[:3] for n in (1, 128))
    yield from ({"language": x} for x in S.LANGUAGES)
    yield from ({"state": x} for x in ("x", "x" * S.MAX_STATE, [0], {"k": None}, nested(S.MAX_DEPTH)))
    yield from (asked(kind, instructions="x" * n) for kind in QUESTIONS for n in (1, S.MAX_INSTRUCTIONS))
    yield from ({"target": {"label": x}, "question": QUESTIONS[S.BINARY][0]} for x in (0, 1))
    yield from (choice(n) for n in S.CHOICE_OPTIONS)
    yield from (ordinal(n, level=n - 1) for n in S.ORDINAL_LEVELS)
    yield choice(2, lambda i: "xy"[i] * S.MAX_CRITERION)
    yield from (provenance(source=x) for x in S.SOURCES)
    yield from (provenance(review_status=x, seed=5) for x in (None, *S.REVIEWS))


def beyond_bounds():
    """Every field missing, of another type, and just beyond each of its bounds, with the code that says so."""
    yield from ((name, None, f"missing_{name}") for name in ("schema_version", *TEXTS, "state", "question", "target", "provenance"))
    yield from ((name, value, f"type_{name}") for name in (*TEXTS, "image_path") for value in (7, [], True))
    yield from (("schema_version", value, "type_schema_version") for value in ("1", 1.0, True))
    yield from (("state", value, "type_state") for value in (7, True, None))
    yield from ((name, [], f"type_{name}") for name in ("question", "target", "provenance"))
    yield "more", 1, "unknown_more"
    yield from (("schema_version", value, "schema_version") for value in (S.SCHEMA_VERSION - 1, S.SCHEMA_VERSION + 1))
    yield from ((name, value, name) for name in TEXTS[:3] for value in ("", "x" * 129, "two words"))
    yield "language", "xx", "language"
    yield from (("state", value, "state") for value in ("", " \n", "x" * (S.MAX_STATE + 1), {}, []))
    yield "state", nested(S.MAX_DEPTH + 1), "state_depth"
    yield from (("image_path", value, "image_path") for value in ("", "/root.png", "up/../x.png", "drive:x.png", "up\\..\\x.png"))
    for kind in QUESTIONS:
        yield from ((asked(kind, instructions=value), None, "instructions") for value in ("", "\t", "x" * (S.MAX_INSTRUCTIONS + 1)))
        yield asked(kind, instructions=3), None, "type_instructions"
        yield asked(kind, other=3), None, "unknown_question_other"
        yield asked(kind, type="essay"), None, "question_type"
    yield from ((choice(n), None, "options") for n in (S.CHOICE_OPTIONS[0] - 1, S.CHOICE_OPTIONS[1] + 1))
    yield from ((ordinal(n), None, "levels") for n in (S.ORDINAL_LEVELS[0] - 1, S.ORDINAL_LEVELS[1] + 1))
    yield from ((made(2, lambda i: ("x" * (S.MAX_CRITERION + 1), "y")[i]), None, code) for made, code in ((choice, "option_text"), (ordinal, "level_text")))
    yield from ((made(2, lambda i: ("Maße ", "MASSE")[i]), None, code) for made, code in ((choice, "option_repeated"), (ordinal, "level_repeated")))
    yield from ((asked(kind, criteria=5), None, "type_criteria") for kind in (S.CHOICE, S.ORDINAL))
    yield asked(S.BINARY, criteria={}), None, "unknown_question_criteria"
    for kind, (question, target) in QUESTIONS.items():
        others = [t for k, (_, t) in QUESTIONS.items() if k != kind]
        yield from (({"question": question, "target": t}, None, "target_kind") for t in ({}, *others, others[0] | target))
    yield from (({"question": QUESTIONS[S.BINARY][0], "target": {"label": x}}, None, code) for x, code in ((-1, "target_label"), (2, "target_label"), (True, "type_label"), (0.5, "type_label")))
    yield choice(2) | {"target": {"class_id": "o2"}}, None, "target_class"
    yield from ((ordinal(3, level=x), None, "target_level") for x in (-1, 3))
    yield "target", {"class_id": "b", "why": 1}, "unknown_target_why"
    yield from ((provenance(**{key: value}), None, "provenance") for key in ("source", "generator_version", "label_method") for value in ("", " "))
    yield from ((provenance(**{key: value}), None, f"type_provenance_{key}") for key, value in (("source", 1), ("seed", "1")))
    yield provenance(review_status="maybe"), None, "review_status"
    yield provenance(more=1), None, "unknown_provenance_more"


def _changed(case):
    what, value, code = case
    raw = example()
    if isinstance(what, dict):
        return raw | what
    if code.startswith("missing_"):
        del raw[what]
        return raw
    return raw | {what: value}


def test_records_are_accepted_and_rejected(spark, tmp_path):
    fine, wrong = list(within_bounds()), list(beyond_bounds())
    lines = [json.dumps(example() | change) for change in fine] + [json.dumps(_changed(case)) for case in wrong]
    forms = {"": "blank_line", "{": "not_json", "3": "not_an_object", '{"a": -Infinity}': "not_finite", '{"a": -1e400}': "not_finite", '{"a": {"b": 1, "b": 1}}': "repeated_key"}
    (tmp_path / "examples.jsonl").write_text("\n".join([*lines, *forms]) + "\n")
    good, rejects = records.read_examples(spark, str(tmp_path / "examples.jsonl"))
    found = {r.line: r.errors for r in rejects.collect()}
    assert not [(fine[n - 1], e) for n, e in found.items() if n <= len(fine)] and good.count() == len(fine)
    for i, case in enumerate(wrong, len(fine) + 1):
        assert case[2] in found[i], (case, found.get(i))
    assert [found[len(lines) + 1 + i] for i in range(len(forms))] == [[code] for code in forms.values()]
    with pytest.raises(ValueError, match="rejected lines"):
        records.load_examples(spark, str(tmp_path / "examples.jsonl"))


def test_json_state_is_canonical(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text(json.dumps(example(id="e1", state={"b": 1, "a": "ñ"})) + "\n" + json.dumps(example(id="e2", state="a\r\nb\rc")) + "\n")
    states = {r.id: r.state for r in records.load_examples(spark, str(tmp_path / "x.jsonl")).collect()}
    assert states == {"e1": '{"a": "ñ", "b": 1}', "e2": "a\nb\nc"}


def test_line_numbers_over_several_splits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"{i}\n" for i in range(1, 5001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = records.read_lines(spark, str(tmp_path / "a.txt"))
        assert rows.rdd.getNumPartitions() > 1 or rows.select("line").distinct().count() == 5000
        assert rows.where("cast(value AS long) != line").count() == 0 and rows.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _named(content, ending="png"):
    return f"images/{hashlib.sha256(content).hexdigest()}.{ending}"


def test_base64_and_images(spark):
    sound = png.encode(np.zeros((10, 20, 3), dtype=np.uint8))
    assert records.image_error(_named(sound), sound) is None
    assert records.image_error(_named(sound), b"GIF89a") == "format"
    assert records.image_error("images/0.png", sound) == "hash"
    assert records.image_error(_named(sound, "jpg"), sound) == "ending"
    assert records.image_error("x", sound.replace(b"IDAT", b"acTLIDAT")) == "animated"
    assert records.image_error("x", sound[:16] + (100_000).to_bytes(4) + (100_000).to_bytes(4) + sound[24:]) == "pixels"
    for broken in (sound[:-1], sound[:50] + bytes([sound[50] ^ 1]) + sound[51:], sound + b"x"):
        assert records.image_error(_named(broken), broken) == "damaged"
    jpg = b"\xff\xd8\xff\xc0\0\x11\x08" + (4).to_bytes(2) + (4).to_bytes(2) + bytes(20)
    assert records.image_error(_named(jpg, "jpg"), jpg) in ("undecoded", "damaged")
    df = spark.createDataFrame([(base64.b64encode(b"abc").decode(),), ("a*b",), (None,)], "t string")
    assert [r[0] for r in df.select(records.decode_base64(F.col("t"))).collect()] == [bytearray(b"abc"), None, None]
    assert df.select(records.decode_base64(F.col("t"), 2)).first()[0] is None


def test_images_are_decoded_in_the_tasks(spark, tmp_path):
    (tmp_path / "images").mkdir()
    sound = png.encode(np.arange(5 * 7 * 3, dtype=np.uint8).reshape(5, 7, 3))
    damaged = sound[:45] + bytes([sound[45] ^ 255]) + sound[46:]
    for content in (sound, damaged):
        (tmp_path / _named(content)).write_bytes(content)
    assert sorted((r.error or "") for r in records.read_images(spark, str(tmp_path / "images")).collect()) == ["", "damaged"]


def test_manifest_is_immutable(spark, tmp_path):
    path = str(tmp_path / "m.json")
    assert sinks.write_manifest(spark, {"a": 1, "created": "now"}, path)
    assert not sinks.write_manifest(spark, {"a": 1, "created": "later"}, path)
    with pytest.raises(FileExistsError):
        sinks.write_manifest(spark, {"a": 2}, path)


def test_dataset_sink_refuses_other_content(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("b", 1), ("a", 2)], "id string, v int")
    assert sinks.write_dataset(df, path)
    assert not sinks.write_dataset(df.repartition(3), path)
    with pytest.raises(FileExistsError):
        sinks.write_dataset(df.withColumn("v", F.lit(9)), path)


def test_heads_and_calibration(spark, tmp_path):
    heads = spark.createDataFrame([("binary", [0.5, 1.0], 0.1)], "question_type string, weights array<double>, bias double")
    sinks.save_heads(heads, str(tmp_path / "h"), {"base": "b1"})
    again, meta = sinks.load_heads(spark, str(tmp_path / "h"), base="b1", dimensions=2)
    assert again.collect() == heads.collect()
    with pytest.raises(ValueError):
        sinks.load_heads(spark, str(tmp_path / "h"), base="b2")
    sinks.save_calibration(spark, {"binary": 1.5}, meta, str(tmp_path / "c.json"))
    assert sinks.load_calibration(spark, str(tmp_path / "c.json"), meta) == {"binary": 1.5}
    with pytest.raises(ValueError):
        sinks.load_calibration(spark, str(tmp_path / "c.json"), {"heads_digest": "x"})


@dataclass
class Inner:
    steps: int = 1


@dataclass
class Config:
    name: str
    rate: float = 0.1
    inner: Inner = None


def test_config_is_closed_and_typed():
    assert records.load_config(Config, '{"name": "x", "rate": 1, "inner": {"steps": 3}}') == Config("x", 1, Inner(3))
    for bad in ('{"name": "x", "more": 1}', '{"name": 3}', '{"name": "x", "inner": {"steps": true}}'):
        with pytest.raises(ValueError):
            records.load_config(Config, bad)


def test_file_hashes(spark, tmp_path):
    (tmp_path / "examples.jsonl").write_bytes(b"abc")
    files = records.file_hashes(spark, str(tmp_path / "examples.jsonl"))
    records.check_declared(files, {"examples.jsonl": hashlib.sha256(b"abc").hexdigest()})
    with pytest.raises(ValueError):
        records.check_declared(files, {"examples.jsonl": "0"})


def test_parsed_records_come_in_runs():
    """However many lines a batch holds, few records and few characters of them stand in memory together."""
    import pandas as pd

    lines = ["{}"] * 1000 + ["x" * records.PARSED_CHARACTERS, "y" * 600_000, "z" * 600_000, None, ""]
    batch = pd.DataFrame({"path": "p", "line": range(len(lines)), "value": lines})
    made = list(records._parse(iter([batch, batch.iloc[:0]])))
    assert [n for b in made for n in b["line"]] == list(range(len(lines)))
    assert all(len(b) <= 256 and (len(b) == 1 or sum(len(v or "") for v in b["value"]) <= records.PARSED_CHARACTERS) for b in made)
    assert made[-1]["form_errors"].tolist()[-2:] == [["blank_line"], ["blank_line"]]
