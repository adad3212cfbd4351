"""Ordered digests, and split manifests against every kind of tampering."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import verify
from tallyloom.operators.verify import SplitError, dataset_digest, leaks, load_split, make_split, ordered_digest, plan_digest

SCHEMA = "id string, group_id string, input_sha256 string, serialized_sha256 string, image_sha256 string"


@pytest.fixture(scope="module")
def examples(spark):
    rows = [(f"e{i:03d}", f"g{i // 3}", f"in{i}", f"ser{i}", f"img{i // 3}" if i % 2 else None) for i in range(120)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.mark.parametrize("chunk", [1 << 20, 7])
def test_digest_of_a_sorted_list(spark, monkeypatch, chunk):
    monkeypatch.setattr(verify, "CHUNK", chunk)
    lines = ["b", "é", "", "a b:x", "a:x", "𐍈", "Z", "a:x"]
    df = spark.createDataFrame([(x, x) for x in lines], "o string, l string").repartition(4)
    assert ordered_digest(df, "o", "l") == hashlib.sha256("\n".join(sorted(lines)).encode()).hexdigest()
    assert ordered_digest(df.limit(0), "o", "l") == hashlib.sha256().hexdigest()
    assert ordered_digest(df.where("l = ''"), "o", "l") == hashlib.sha256().hexdigest()


def test_digest_of_many_lines(spark):
    n = 50_000
    df = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("k")).withColumn("l", F.concat("k", F.lit(":train")))
    told = "\n".join(f"{k}:train" for k in sorted(hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)))
    assert ordered_digest(df.repartition(8), "k", "l") == hashlib.sha256(told.encode()).hexdigest()


def test_plan_is_in_the_order_of_groups(spark):
    """``a b`` comes after ``a`` as a group, though its line comes first."""
    df = spark.createDataFrame([("a b", "test"), ("a", "train"), ("a!", "test")], "g string, split string")
    assert plan_digest(df, "g") == hashlib.sha256(b"a:train\na b:test\na!:test").hexdigest()


def test_written_and_read(spark, examples, tmp_path):
    path = str(tmp_path / "split")
    rows = make_split(spark, examples, 7, path)
    assert make_split(spark, examples, 7, path).count() == rows.count() == 120  # an equal one may be there
    with pytest.raises(FileExistsError):
        make_split(spark, examples, 8, path)
    header = json.loads((tmp_path / "split/split.json").read_text())
    groups = {r.group_id: r.split for r in rows.collect()}
    assert header["assignment_sha256"] == hashlib.sha256("\n".join(f"{g}:{groups[g]}" for g in sorted(groups)).encode()).hexdigest()
    plan = {"seed": 7, "assignment_sha256": header["assignment_sha256"]}
    parts = load_split(spark, examples, path, ["train", "test"], allow_test=True, planned=plan)
    assert {s: {r.group_id for r in d.collect()} for s, d in parts.items()} == {s: {g for g, x in groups.items() if x == s} for s in parts}
    with pytest.raises(SplitError, match="allow_test"):
        load_split(spark, examples, path, ["test"])
    with pytest.raises(SplitError, match="unknown"):
        load_split(spark, examples, path, ["all"])
    with pytest.raises(SplitError, match="seed"):
        load_split(spark, examples, path, ["train"], planned=plan | {"seed": 8})
    with pytest.raises(SplitError, match="than planned"):
        load_split(spark, examples, path, ["train"], planned=plan | {"assignment_sha256": "0"})
    with pytest.raises(SplitError, match="no manifest"):
        load_split(spark, examples, str(tmp_path / "none"), ["train"])


def _tampered(spark, tmp_path, examples, change_rows=None, change_header=None):
    path = tmp_path / "split"
    make_split(spark, examples, 7, str(path))
    if change_rows is not None:
        rows = spark.createDataFrame(change_rows(spark.read.parquet(f"{path}/rows")).collect(), f"{SCHEMA}, split string")
        rows.write.mode("overwrite").parquet(f"{path}/rows")
    if change_header is not None:
        header = json.loads((path / "split.json").read_text())
        change_header(header)
        (path / ".split.json.crc").unlink(missing_ok=True)
        (path / "split.json").write_text(json.dumps(header))
    return str(path)


def _of_id(column, value):
    return lambda rows: rows.withColumn(column, F.when(F.col("id") == "e000", value).otherwise(F.col(column)))


def _to_other_split(rows):
    return rows.withColumn("split", F.when(F.col("group_id") == "g0", F.when(F.col("split") == "train", "test").otherwise("train")).otherwise(F.col("split")))


def _swapped(rows):
    """Two groups of equal size change places, so that all counts stay."""
    a, b = (rows.where(F.col("split") == s).orderBy("group_id").first() for s in ("train", "test"))
    return rows.withColumn("split", F.when(F.col("group_id") == a.group_id, "test").when(F.col("group_id") == b.group_id, "train").otherwise(F.col("split")))


@pytest.mark.parametrize(
    ("change", "what"),
    [
        (lambda rows: rows.where("id != 'e000'"), "examples without a row"),
        (lambda rows: rows.union(rows.where("id = 'e000'").withColumn("id", F.lit("more"))), "rows without an example"),
        (lambda rows: rows.union(rows.where("id = 'e000'")), "repeated rows"),
        (_of_id("group_id", "other"), "another group_id"),
        (_of_id("input_sha256", "other"), "another input_sha256"),
        (_of_id("split", "elsewhere"), "unknown splits"),
        (_to_other_split, "other groups or examples"),
        (_swapped, "were changed"),
    ],
)
def test_changed_rows_are_refused(spark, examples, tmp_path, change, what):
    path = _tampered(spark, tmp_path, examples, change_rows=change)
    with pytest.raises(SplitError, match=what):
        load_split(spark, examples, path, ["train"])


@pytest.mark.parametrize(("key", "value", "what"), [("format", 2, "format"), ("splits", {"train": {}}, "other splits"), ("dataset_sha256", "0", "another dataset"), ("rows_sha256", "0", "were changed")])
def test_changed_headers_are_refused(spark, examples, tmp_path, key, value, what):
    path = _tampered(spark, tmp_path, examples, change_header=lambda h: h.update({key: value}))
    with pytest.raises(SplitError, match=what):
        load_split(spark, examples, path, ["train"])


def test_changed_examples_are_refused(spark, examples, tmp_path):
    path = _tampered(spark, tmp_path, examples)
    for other in (examples.where("id != 'e005'"), _of_id("image_sha256", "new")(examples)):
        assert dataset_digest(other) != dataset_digest(examples)
        with pytest.raises(SplitError, match="another dataset"):
            load_split(spark, other, path, ["train"])
    with pytest.raises(SplitError, match="repeated"):
        load_split(spark, examples.union(examples.limit(1)), path, ["train"])


@pytest.mark.parametrize("column", ["input_sha256", "serialized_sha256", "image_sha256"])
def test_leaks_are_refused(spark, examples, tmp_path, column):
    """One value in all groups: every pair of splits shares it."""
    leaky = examples.withColumn(column, F.when(F.col("id").endswith("0"), "same").otherwise(F.col(column)))
    with pytest.raises(SplitError, match="are in train and"):
        make_split(spark, leaky, 7, str(tmp_path / "s"))


def test_all_leaks_by_brute_force(spark):
    rows = [(f"i{i}", f"g{i % 5}", f"n{i % 4}", f"s{i % 3}", f"m{i % 7}" if i % 2 else None, ("train", "validation", "calibration", "test")[i % 11 % 4]) for i in range(40)]
    found = leaks(spark.createDataFrame(rows, f"{SCHEMA}, split string"))
    expected = {}
    for what, at in (("group", 1), ("input", 2), ("serialization", 3), ("image", 4)):
        sets = {s: {r[at] for r in rows if r[5] == s and r[at]} for s in ("train", "validation", "calibration", "test")}
        for i, a in enumerate(sets):
            for b in list(sets)[i + 1 :]:
                if n := len(sets[a] & sets[b]):
                    expected[what, a, b] = n
    assert found == expected
