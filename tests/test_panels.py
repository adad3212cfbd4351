"""PNG files of every kind against plain pixel loops; panels, their rules, images and splits."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.operators import panels as P
from tallyloom.operators.split import assign_groups
from tallyloom.operators.unique import unique_cases
from tallyloom.operators.validate import record_errors
from tallyloom.operators.verify import leaks, plan_digest
from tallyloom.sources import png


def paeth(a, b, c):
    p = a + b - c
    return min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]


def filtered(lines, kinds, step):
    """Lines of bytes with the filter of each applied, by loops over bytes."""
    out, above = b"", bytes(len(lines[0]) if lines else 0)
    for line, kind in zip(lines, kinds):
        row = bytearray([kind])
        for i, x in enumerate(line):
            a, b, c = (line[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            row.append((x - (0, a, b, (a + b) // 2, paeth(a, b, c))[kind]) % 256)
        out, above = out + bytes(row), line
    return out


def packed(samples, depth):
    bits = "".join(f"{s:0{depth}b}" for s in samples)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def made(samples, width, height, depth, colour, interlaced, kinds, palette=b"", parts=1):
    """A PNG file of ``samples[y][x]`` (tuples), written by loops."""
    n = png.SAMPLES[colour]
    step, data, at = max(1, n * depth // 8), b"", 0
    for x0, y0, dx, dy in png.PASSES if interlaced else ((0, 0, 1, 1),):
        rows = [[samples[y][x] for x in range(x0, width, dx)] for y in range(y0, height, dy)]
        lines = [packed([s for pixel in row for s in pixel], depth) for row in rows if row]
        data += filtered(lines, [kinds[(at + i) % len(kinds)] for i in range(len(lines))], step) if lines else b""
        at += len(lines)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    stream = zlib.compress(data)
    size = -(-len(stream) // parts)
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, int(interlaced)))
    body = b"".join(chunk(b"IDAT", stream[i : i + size]) for i in range(0, len(stream), size))
    return png.SIGNATURE + head + (chunk(b"PLTE", palette) if palette else b"") + body + chunk(b"IEND", b"")


@settings(max_examples=250, deadline=None)
@given(st.data())
def test_every_kind_of_file(data):
    colour = data.draw(st.sampled_from(sorted(png.SAMPLES)))
    depth = data.draw(st.sampled_from(png.DEPTHS[colour]))
    width, height = data.draw(st.integers(1, 13)), data.draw(st.integers(1, 11))
    rng = np.random.default_rng(data.draw(st.integers(0, 1 << 30)))
    samples = [[tuple(int(v) for v in rng.integers(0, 1 << depth, png.SAMPLES[colour])) for _ in range(width)] for _ in range(height)]
    palette = bytes(rng.integers(0, 256, 3 << depth, dtype=np.uint8)) if colour == 3 else b""
    kinds = data.draw(st.lists(st.integers(0, 4), min_size=1, max_size=6))
    content = made(samples, width, height, depth, colour, data.draw(st.booleans()), kinds, palette, data.draw(st.integers(1, 3)))

    def rgb(pixel):
        if colour == 3:
            return tuple(palette[3 * pixel[0] : 3 * pixel[0] + 3])
        eight = [s >> 8 if depth == 16 else s for s in pixel]
        if colour in (0, 4):
            return (eight[0] * 255 // ((1 << min(depth, 8)) - 1),) * 3
        return tuple(eight[:3])

    assert png.decode(content, 1000).tolist() == [[list(rgb(p)) for p in row] for row in samples]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 20), st.integers(1, 20), st.integers(0, 1 << 30))
def test_round_trip(width, height, seed):
    pixels = np.random.default_rng(seed).integers(0, 256, (height, width, 3), dtype=np.uint8)
    assert (png.decode(png.encode(pixels), 1000) == pixels).all() and png.encode(pixels) == png.encode(pixels.copy())


def test_damaged_files():
    sound = made([[(5,), (9,)], [(1,), (2,)]], 2, 2, 8, 0, False, [4])
    assert png.decode(sound, 4).shape == (2, 2, 3)
    for i in range(8, len(sound)):
        with pytest.raises(png.DamagedImage):
            png.decode(sound[:i] + bytes([sound[i] ^ 4]) + sound[i + 1 :], 1000)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head, end = chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 0, 0, 0, 0)), chunk(b"IEND", b"")
    for raw in (b"", bytes(5), bytes(7), b"\x05" + bytes(5), bytes(1 << 20)):  # short, long, an unknown filter, a bomb
        with pytest.raises(png.DamagedImage):
            png.decode(png.SIGNATURE + head + chunk(b"IDAT", zlib.compress(raw)) + end, 1000)
    for content in (b"", png.SIGNATURE, sound[:-12], sound + b"\0", made([[(3,)]], 1, 1, 2, 3, False, [0], b"\0\0\0")):
        with pytest.raises(png.DamagedImage):
            png.decode(content, 1000)
    with pytest.raises(png.DamagedImage, match="pixels"):
        png.decode(sound, 3)


@pytest.fixture(scope="module")
def made_panels(spark):
    found, digest = P.generate_panels(spark, 60, 3, 4, split_seed=9)
    return found.cache(), digest


def test_styles_of_splits_are_disjoint_and_the_plan_is_the_splits(spark, made_panels):
    found, digest = made_panels
    rows = found.select("group_id", "planned", "facts.style").collect()
    pools = {s: {r.style for r in rows if r.planned == s} for s in ("train", "validation", "calibration", "test")}
    assert all(pools.values()) and sum(map(len, pools.values())) == len(set().union(*pools.values()))
    assigned = assign_groups(found, "group_id", 9)
    assert {r.group_id: r.split for r in assigned.collect()} == {r.group_id: r.planned for r in rows}
    assert digest == plan_digest(assigned, "group_id")
    assert P.generate_panels(spark, 4, 3, 1, split_seed=None)[0].select("planned").distinct().collect() == [("transfer",)]


def test_images_are_content_addressed_and_show_the_facts(spark, made_panels):
    rows = made_panels[0].collect()
    assert len({r.image_path for r in rows}) == 60
    for r in rows:
        assert r.image_path == f"images/{hashlib.sha256(bytes(r.image)).hexdigest()}.png"
    for r in rows[:12]:
        pixels = png.decode(bytes(r.image), 1 << 20)
        assert pixels.shape == (P.HEIGHT, P.WIDTH, 3)
        bars = P._colours(P.STYLES[r.facts.style][5], len(r.facts["values"]))[3:]
        line = P._colours(P.STYLES[r.facts.style][5], 0)[2]
        up = P.STYLES[r.facts.style][0] == "up"
        near, far = 40, (P.HEIGHT if up else P.WIDTH) - 20
        for value, colour in zip(r.facts["values"], bars):
            at = np.argwhere((pixels == colour).all(axis=2))
            ends = (P.HEIGHT - 1 - at[:, 0].min()) if up else at[:, 1].max()
            assert ends + 1 == near + (far - near) * value // 100
        assert (pixels == line).all(axis=2).any() == (r.facts.threshold is not None)


def test_questions_follow_from_the_facts(made_panels):
    kinds = set()
    for r in made_panels[0].collect():
        value, threshold = dict(zip(r.facts.names, r.facts["values"])), r.facts.threshold
        assert P.fair(r.facts["values"]) and (threshold is None or min(abs(v - threshold) for v in value.values()) >= P.THRESHOLD_MARGIN)
        assert len(r.questions) == 4 and len({(q.kind, q.instructions) for q in r.questions}) == 4
        for q in r.questions:
            kinds.add(q.kind)
            named = [n for n in value if n in q.instructions.split() or f"{n}?" in q.instructions.split()]
            named.sort(key=q.instructions.index)
            if q.kind == "any_over":
                assert q.label == int(any(v > threshold for v in value.values()))
            elif q.kind == "one_over":
                assert q.label == int(value[named[0]] > threshold)
            elif q.kind == "compare":
                assert q.label == int(value[named[0]] > value[named[1]]) and abs(value[named[0]] - value[named[1]]) >= P.PAIR_MARGIN
            elif q.kind in ("top", "bottom"):
                chosen = {o.id: o.description for o in q.options}
                assert sorted(chosen.values()) == sorted(value) and len(chosen) == len(value)
                assert value[chosen[q.class_id]] == (max if q.kind == "top" else min)(value.values())
            else:
                level = sum(value[named[0]] > b for b in P.LEVEL_BOUNDS)
                assert q.level_index == (3 - level if q.method == "level_turned" else level)
    assert kinds == {k for ks in P.KINDS.values() for k in ks}


def test_examples_are_valid_and_leak_nothing(made_panels):
    examples = P.panel_examples(made_panels[0], 3)
    assert examples.count() == 240 and examples.select("id").distinct().count() == 240
    assert examples.where(F.size(record_errors()) > 0).count() == 0
    split = made_panels[0].select("group_id", F.col("planned").alias("split"), F.col("image_path").alias("image_sha256"), F.col("image_path").alias("input_sha256"), F.lit(None).cast("string").alias("serialized_sha256"))
    assert leaks(split) == {}


def test_the_same_in_any_partitioning(spark, made_panels):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = P.generate_panels(spark, 60, 3, 4, split_seed=9)[0]
        assert sorted(r.image_path for r in again.select("image_path").collect()) == sorted(r.image_path for r in made_panels[0].select("image_path").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_eligibility():
    facts = {"names": ["A", "B", "C"], "values": [10, 15, 40], "threshold": None}
    assert P.eligible("any_over", facts, set()) == [] == P.eligible("one_over", facts, set())
    assert set(P.eligible("compare", facts, set())) == {("A", "C"), ("C", "A"), ("B", "C"), ("C", "B")}
    assert P.eligible("compare", facts, {("compare", "A", "C"), ("compare", "B", "C")}) == []
    assert P.eligible("top", facts, {("top",)}) == [] and P.eligible("bottom", facts, {("top",)}) == [()]
    assert P.eligible("level", facts, {("level", "A")}) == [("B",), ("C",)]
    assert P.eligible("any_over", facts | {"threshold": 25}, set()) == [()]
    with pytest.raises(ValueError, match="fewer"):
        P.choose_questions({"names": ["A", "B"], "values": [10, 15], "threshold": None}, "en", P.Stream("x"), "i", 9)


def test_unique_cases_draws_again(spark):
    """Ten keys for ten cases, drawn by hashes: collisions in the first rounds, all different in the end."""
    calls = []

    def make(cases):
        calls.append(1)
        return cases.withColumn("key", F.pmod(F.xxhash64("case", "attempt"), F.lit(10)))

    rows = unique_cases(spark.range(10).withColumnRenamed("id", "case"), make, "key").collect()
    assert sorted(r.key for r in rows) == list(range(10)) == sorted(r.case for r in rows) and len(calls) > 1
    with pytest.raises(ValueError, match="not unique"):
        unique_cases(spark.range(11).withColumnRenamed("id", "case"), make, "key", rounds=3)


def test_images_written_once_by_the_tasks(spark, made_panels, tmp_path):
    twice = made_panels[0].limit(5).unionByName(made_panels[0].limit(5))
    told = P.write_images(twice, str(tmp_path)).collect()
    files = {f"images/{p.name}": p.read_bytes() for p in (tmp_path / "images").iterdir()}
    assert len(told) == len(files) == 5
    assert all(name == f"images/{hashlib.sha256(content).hexdigest()}.png" for name, content in files.items())
