"""Bar panels: facts with margins, images drawn from them, and questions that only the image answers.

A panel's group is dealt to a split before anything is drawn: its style comes from that split's own pool, so that no
style is seen in two splits. Facts are drawn by hashes of (seed, split, case, attempt); a panel whose facts another one
has already is drawn again, by anti-joins against all accepted ones. Images are rasterised in the tasks and named by
their content.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.split import assign_groups
from tallyloom.operators.unique import unique_cases
from tallyloom.operators.verify import plan_digest
from tallyloom.schema import BINARY, CHOICE, ORDINAL
from tallyloom.sources import png

# Size of the image, margins in units of the axis between what questions tell apart, the level's bounds
# (in ``generate``), and the weights of question types.
WIDTH, HEIGHT = 480, 360
LEVEL_BOUNDS = (25, 50, 75)
LEVEL_MARGIN, THRESHOLD_MARGIN, EXTREME_MARGIN, PAIR_MARGIN = 5, 8, 10, 12
LOW, HIGH, THRESHOLDS, MAY_HAVE_THRESHOLD = 3, 97, (12, 92), 0.7
KINDS = {BINARY: ("any_over", "one_over", "compare"), CHOICE: ("top", "bottom"), ORDINAL: ("level",)}
TYPE_WEIGHTS = {BINARY: 0.4, CHOICE: 0.3, ORDINAL: 0.3}

NAMES = ("CHAT", "DISK", "FEED", "LOGIN", "MAPS", "PRINT", "VIDEO")
#: Styles of each split: orientation, width of a bar in its slot, lengths of the threshold's dashes and gaps, grid,
#: and the seed that its colours are made from. No style is in two pools.
POOLS = {
    "train": (("up", 0.5, 8, 6, True, 1), ("up", 0.7, 12, 4, False, 2), ("right", 0.5, 8, 6, True, 3), ("right", 0.6, 6, 6, False, 4)),
    "validation": (("up", 0.4, 4, 4, True, 5), ("right", 0.45, 10, 5, False, 6)),
    "calibration": (("up", 0.6, 3, 5, False, 7), ("right", 0.35, 5, 3, True, 8)),
    "test": (("up", 0.35, 14, 6, True, 9), ("right", 0.7, 7, 7, True, 10)),
    "transfer": (("up", 0.45, 9, 3, False, 11),),
}
STYLES = tuple(s for pool in POOLS.values() for s in pool)
#: Capital letters and digits, five rows of three dots each.
_GLYPHS = dict(zip(
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    ("010101111101101 110101110101110 011100100100011 110101101101110 111100110100111 111100110100100 011100101101011 101101111101101 111010010010111 "
     "001001001101010 101101110101101 100100100100111 101111111101101 110101101101101 010101101101010 110101110100100 010101101111011 110101110101101 "
     "011100010001110 111010010010010 101101101101111 101101101101010 101101111111101 101101010101101 101101010010010 111001010100111 "
     "111101101101111 010110010010111 110001010100111 110001010001110 101101111001001 111100110001110 011100111101111 111001010010010 111101111101111 111101111001110").split(),
    strict=True,
))
_STATES = {"es": ("Va adjunto el gráfico de la última hora.", "Este es el panel que vemos ahora.", "Mira la imagen del panel."), "en": ("The last hour's chart is attached.", "This is the panel we see now.", "See the image of the panel.")}
_ASK = {
    "es": {"any_over": "¿Hay alguna barra que pase de la raya?", "one_over": "¿Pasa {a} de la raya?", "compare": "¿Llega {a} más lejos que {b}?", "top": "¿Qué barra es la mayor?", "bottom": "¿Qué barra es la menor?", "level": "¿En qué cuarto del eje acaba {a}?"},
    "en": {"any_over": "Is there a bar that passes the line?", "one_over": "Does {a} pass the line?", "compare": "Does {a} reach further than {b}?", "top": "Which bar is the largest?", "bottom": "Which bar is the smallest?", "level": "In which quarter of the axis does {a} end?"},
}
_LEVELS = {"es": ("Primer cuarto", "Segundo cuarto", "Tercer cuarto", "Último cuarto"), "en": ("First quarter", "Second quarter", "Third quarter", "Last quarter")}

QUESTION = "struct<kind:string,type:string,instructions:string,options:array<struct<id:string,description:string>>,levels:array<string>,label:int,class_id:string,level_index:int,method:string>"


class Stream:
    """Numbers below a bound from hashes of a name; the same wherever they are drawn."""

    def __init__(self, *name) -> None:
        self.name, self.at = ":".join(map(str, name)), 0

    def below(self, n: int) -> int:
        self.at += 1
        return int.from_bytes(hashlib.sha256(f"{self.name}:{self.at}".encode()).digest()[:8], "big") % n

    def chance(self, p: float) -> bool:
        return self.below(1 << 40) < p * (1 << 40)

    def sample(self, items, k: int) -> list:
        left, out = list(items), []
        for _ in range(k):
            out.append(left.pop(self.below(len(left))))
        return out


def fair(values: list[int]) -> bool:
    """Whether no value is near a level's bound, and the largest and the smallest stand out."""
    low, *_, high = ordered = sorted(values)
    return all(abs(v - b) >= LEVEL_MARGIN for v in values for b in LEVEL_BOUNDS) and high - ordered[-2] >= EXTREME_MARGIN and ordered[1] - low >= EXTREME_MARGIN


def draw_facts(draw: Stream, pool: tuple) -> dict:
    """Three to five named bars, a threshold that no bar is near (or none), and a style of ``pool``.

    Half of the thresholds lie above all bars, where there is room.
    """
    k = 3 + draw.below(3)
    names = draw.sample(NAMES, k)
    values = [LOW + draw.below(HIGH - LOW + 1) for _ in range(k)]
    while not fair(values):
        values = [LOW + draw.below(HIGH - LOW + 1) for _ in range(k)]
    threshold = None
    if draw.chance(MAY_HAVE_THRESHOLD):
        top = max(values)
        above = draw.chance(0.5) and top + THRESHOLD_MARGIN <= THRESHOLDS[1]
        low, high = (top + THRESHOLD_MARGIN, THRESHOLDS[1]) if above else (THRESHOLDS[0], max(THRESHOLDS[0], top - THRESHOLD_MARGIN))
        free = [t for t in range(low, high + 1) if all(abs(v - t) >= THRESHOLD_MARGIN for v in values)]
        threshold = free[draw.below(len(free))] if free else None
    return {"names": names, "values": values, "threshold": threshold, "style": STYLES.index(pool[draw.below(len(pool))])}


def _colours(seed: int, n: int) -> np.ndarray:
    """Background, ink, threshold and ``n`` bar colours of a style; bars are neither as light nor as dark as the rest."""
    made = hashlib.sha256(f"colours:{seed}".encode()).digest()
    dark = seed % 4 == 3
    ground, ink = (np.array([24, 24, 32]), np.array([236, 236, 236])) if dark else (np.array([250, 248, 244]), np.array([28, 28, 28]))
    bars = [np.array([60 + made[(3 * i + j) % 32] % 140 for j in range(3)]) for i in range(n)]
    return np.array([ground, ink, np.array([214, 40, 200 if dark else 60]), *bars], dtype=np.uint8)


def _write(image: np.ndarray, text: str, x: int, y: int, colour: np.ndarray, scale: int = 2) -> None:
    for i, letter in enumerate(text):
        dots = np.array([c == "1" for c in _GLYPHS[letter]]).reshape(5, 3)
        dots = np.repeat(np.repeat(dots, scale, axis=0), scale, axis=1)
        left = x + i * 4 * scale
        image[y : y + 5 * scale, left : left + 3 * scale][dots] = colour


def draw_panel(facts: dict) -> np.ndarray:
    """The panel as RGB; the same facts give the same image. Bars, axis and threshold stand at value times a fixed scale."""
    way, share, dash, gap, grid, seed = STYLES[facts["style"]]
    names, values, threshold = facts["names"], facts["values"], facts["threshold"]
    ground, ink, line, *bars = _colours(seed, len(values))
    # drawn growing upwards over (along, value) and turned for bars that grow to the right
    up = way == "up"
    along, reach = (WIDTH, HEIGHT) if up else (HEIGHT, WIDTH)
    near, far, start, stop = 40, reach - 20, 60, along - 20
    plane = np.empty((reach, along, 3), dtype=np.uint8)
    plane[:] = ground
    at = lambda v: near + (far - near) * v // 100
    if grid:
        for tick in (25, 50, 75, 100):
            plane[at(tick), start:stop] = (ground.astype(int) + ink) // 2
    slot = (stop - start) // len(values)
    for i, v in enumerate(values):
        wide = int(slot * share)
        left = start + slot * i + (slot - wide) // 2
        plane[near : at(v), left : left + wide] = bars[i]
    plane[near - 2 : near, start:stop] = ink
    plane[near:far, start - 2 : start] = ink
    if threshold is not None:
        for left in range(start, stop, dash + gap):
            plane[at(threshold) - 1 : at(threshold) + 2, left : min(left + dash, stop)] = line
    image = np.ascontiguousarray(plane[::-1] if up else plane.transpose(1, 0, 2))
    for i, name in enumerate(names):
        middle = start + slot * i + slot // 2
        x, y = (middle - 4 * len(name), HEIGHT - 28) if up else (2, middle - 5)
        _write(image, name, x, y, ink, 2 if up else 1)
    for tick in (0, 50, 100):
        x, y = (20, HEIGHT - 1 - at(tick) - 5) if up else (at(tick) - 6, HEIGHT - 12)
        _write(image, str(tick), max(0, x), max(0, y), ink)
    return image


def eligible(kind: str, facts: dict, used: set) -> list[tuple]:
    """What a question of ``kind`` may still ask about: bars, pairs, or the panel itself; nothing if it can't be asked."""
    names, value = facts["names"], dict(zip(facts["names"], facts["values"], strict=True))
    if kind in ("any_over", "one_over") and facts["threshold"] is None:
        return []
    if kind in ("one_over", "level"):
        return [(n,) for n in names if (kind, n) not in used]
    if kind == "compare":
        return [(a, b) for a in names for b in names if abs(value[a] - value[b]) >= PAIR_MARGIN and (kind, *sorted((a, b))) not in used]
    return [] if (kind,) in used else [()]


def ask(kind: str, about: tuple, facts: dict, language: str, draw: Stream, ident: str) -> dict:
    """A question of ``kind`` with its label by rule."""
    names, values, threshold = facts["names"], facts["values"], facts["threshold"]
    value = dict(zip(names, values, strict=True))
    said = _ASK[language][kind].format(**dict(zip("ab", about)))
    made = {"kind": kind, "instructions": said, "options": None, "levels": None, "label": None, "class_id": None, "level_index": None, "method": kind}
    if kind in KINDS[BINARY]:
        holds = max(values) > threshold if kind == "any_over" else value[about[0]] > (threshold if kind == "one_over" else value[about[1]])
        return made | {"type": BINARY, "label": int(holds)}
    if kind in KINDS[CHOICE]:
        order = draw.sample(names, len(names))
        ids = {n: "o" + hashlib.sha256(f"{ident}:{kind}:{n}".encode()).hexdigest()[:6] for n in order}
        answer = (max if kind == "top" else min)(names, key=value.get)
        return made | {"type": CHOICE, "options": [{"id": ids[n], "description": n} for n in order], "class_id": ids[answer]}
    levels, level = list(_LEVELS[language]), sum(value[about[0]] > b for b in LEVEL_BOUNDS)
    turned = draw.chance(0.5)
    if turned:
        levels, level = levels[::-1], len(levels) - 1 - level
    return made | {"type": ORDINAL, "levels": levels, "level_index": level, "method": "level_turned" if turned else "level"}


def choose_questions(facts: dict, language: str, draw: Stream, ident: str, n: int) -> list[dict]:
    """``n`` different questions: a type by weight, then a kind that can be asked, then what about."""
    used: set = set()
    out: list[dict] = []
    while len(out) < n:
        u, edge = draw.below(1 << 30) / (1 << 30), 0.0
        for name, weight in TYPE_WEIGHTS.items():
            edge += weight
            if u < edge:
                break
        kinds = [k for k in KINDS[name] if eligible(k, facts, used)]
        if not kinds:
            if not any(eligible(k, facts, used) for ks in KINDS.values() for k in ks):
                raise ValueError(f"a panel has fewer than {n} questions")
            continue
        kind = kinds[draw.below(len(kinds))]
        found = eligible(kind, facts, used)
        about = found[draw.below(len(found))]
        used.add((kind, *sorted(about)))
        out.append(ask(kind, about, facts, language, draw, f"{ident}:{len(out)}"))
    return out


_FACTS = "struct<names:array<string>,values:array<int>,threshold:int,style:int>"


def panel_facts(spark: SparkSession, panels: int, seed: int, *, split_seed: int | None = 0) -> tuple[DataFrame, str | None]:
    """``case, attempt, group_id, language, planned, facts, fact_key`` of ``panels`` different panels, and the plan's digest.

    The groups are dealt to splits as ``assign_groups`` will with ``split_seed``; with None all panels are ``transfer``.
    """
    base = spark.range(panels).select(F.col("id").alias("case"), F.format_string("panel-%d-%06d", F.lit(seed), F.col("id")).alias("group_id"), F.when(F.col("id") % 2 == 0, "es").otherwise("en").alias("language"))
    digest = None
    if split_seed is None:
        planned = base.withColumn("planned", F.lit("transfer"))
    else:
        assigned = assign_groups(base, "group_id", split_seed)
        planned, digest = base.join(assigned.withColumnRenamed("split", "planned"), "group_id"), plan_digest(assigned, "group_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            facts = [draw_facts(Stream("facts", seed, r["planned"], r["case"], r["attempt"]), POOLS[r["planned"]]) for r in rows]
            keys = [hashlib.sha256(f"{r['language']}:{f}".encode()).hexdigest() for r, f in zip(rows, facts)]
            kind = pa.struct([("names", pa.list_(pa.string())), ("values", pa.list_(pa.int32())), ("threshold", pa.int32()), ("style", pa.int32())])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(facts, kind), pa.array(keys)], [*batch.schema.names, "facts", "fact_key"])

    columns = "case long, attempt int, group_id string, language string, planned string"
    make = lambda cases: cases.select("case", "attempt", "group_id", "language", "planned").mapInArrow(run, f"{columns}, facts {_FACTS}, fact_key string")
    return unique_cases(planned, make, "fact_key"), digest


def generate_panels(spark: SparkSession, panels: int, seed: int, questions: int = 3, *, split_seed: int | None = 0) -> tuple[DataFrame, str | None]:
    """``group_id, language, planned, facts, state, image_path, image, questions`` of different panels, and the plan's digest.

    The answers are in the image only. ``image`` is the PNG file, ``image_path`` its content's name.
    """
    if panels < 1 or not 1 <= questions <= 6:
        raise ValueError("at least one panel, of one to six questions")
    facts, digest = panel_facts(spark, panels, seed, split_seed=split_seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                rows = part.to_pylist()
                images = [png.encode(draw_panel(r["facts"])) for r in rows]
                draws = [Stream("questions", seed, r["planned"], r["case"]) for r in rows]
                states = [_STATES[r["language"]][d.below(3)] for r, d in zip(rows, draws)]
                asked = [choose_questions(r["facts"], r["language"], d, r["group_id"], questions) for r, d in zip(rows, draws)]
                paths = [f"images/{hashlib.sha256(i).hexdigest()}.png" for i in images]
                kept = ["group_id", "language", "planned", "facts"]
                option = pa.list_(pa.struct([("id", pa.string()), ("description", pa.string())]))
                question = pa.struct([("kind", pa.string()), ("type", pa.string()), ("instructions", pa.string()), ("options", option), ("levels", pa.list_(pa.string())), ("label", pa.int32()), ("class_id", pa.string()), ("level_index", pa.int32()), ("method", pa.string())])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(states), pa.array(paths), pa.array(images, pa.binary()), pa.array(asked, pa.list_(question))], [*kept, "state", "image_path", "image", "questions"])

    schema = f"group_id string, language string, planned string, facts {_FACTS}, state string, image_path string, image binary, questions array<{QUESTION}>"
    return facts.select("case", "group_id", "language", "planned", "facts").mapInArrow(run, schema), digest


def panel_examples(panels: DataFrame, seed: int) -> DataFrame:
    """One row a question, in the schema of examples."""
    null = F.lit(None).cast("string")
    asked = panels.select("*", F.posexplode("questions").alias("_n", "_q"))
    q = F.col("_q")
    return asked.select(
        F.lit(1).alias("schema_version"), F.concat_ws("-", "group_id", q["kind"], "_n").alias("id"), "group_id", F.concat(F.lit("panel_"), q["kind"]).alias("task_family"), "language", "state", F.lit("text").alias("state_kind"), "image_path",
        F.struct(q["type"].alias("type"), q["instructions"].alias("instructions"), q["options"].alias("options"), q["levels"].alias("levels")).alias("question"),
        F.struct(q["label"].alias("label"), q["class_id"].alias("class_id"), q["level_index"].alias("level_index")).alias("target"),
        F.struct(F.lit("synthetic_rule").alias("source"), F.lit("panels-1").alias("generator_version"), q["method"].alias("label_method"), F.concat_ws("-", F.lit("style"), "facts.style", "language").alias("template_id"), F.lit(seed).cast("long").alias("seed"), null.alias("model"), null.alias("model_revision"), null.alias("prompt_id"), null.alias("review_status")).alias("provenance"),
    )


def write_images(panels: DataFrame, folder: str) -> DataFrame:
    """Write every image of ``panels`` once to ``folder`` under its content's name, from the tasks; returns ``image_path, bytes``."""
    files, base = pafs.FileSystem.from_uri(folder)
    files.create_dir(f"{base}/images")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            paths, images = (c.to_pylist() for c in batch.columns)
            for path, image in zip(paths, images):
                part = f"{root}/{path}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(image)
                store.move(part, f"{root}/{path}")  # the same content, whoever comes first
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(i) for i in images], pa.int64())], ["image_path", "bytes"])

    return panels.select("image_path", "image").dropDuplicates(["image_path"]).mapInArrow(run, "image_path string, bytes long")
