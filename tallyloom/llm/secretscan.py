"""Secret scans: fixed patterns, and a battery of randomness tests over the other encoded strings.

Strings of encoding characters are classed by the narrowest alphabet that holds them. Chi-squared uniformity over the
alphabet, a runs test around its middle and lag-one serial correlation each give the probability of a string at least
as irregular under uniform randomness. The three are combined, and within every class of encoding and length the
strings that are not random are rejected under false-discovery control over the whole table. What isn't rejected is
reported. DataFrame functions only; positions are in code points.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of the base kinds, in the order in which spans of one start are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Strings that the battery tests.
ENCODED = r"[A-Za-z0-9+/_=-]{20,}"
LEAST_ASSIGNED = 8


@dataclass(frozen=True)
class Encoding:
    name: str
    pattern: str
    alphabet: str


#: Letters from common to rare, so that words are uneven over the cells; random strings are even in any order.
LETTERS = "etaoinsrhldcumfpgwybvkxjqz"
#: Encodings from narrow to wide; a string has the first that it fits. Those of one case need letters and digits, the
#: others both cases: letters of one case alone, or digits alone, are too often words and numbers and aren't tested.
ENCODINGS = (
    Encoding("hex", r"^(?=[^a-f]*[a-f])(?=[^0-9]*[0-9])[0-9a-f]+$", "0123456789abcdef"),
    Encoding("hex", r"^(?=[^A-F]*[A-F])(?=[^0-9]*[0-9])[0-9A-F]+$", "0123456789ABCDEF"),
    Encoding("base32", r"^(?=[^A-Z]*[A-Z])(?=[^2-7]*[2-7])[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    Encoding("base32", r"^(?=[^a-z]*[a-z])(?=[^2-7]*[2-7])[a-z2-7]+=*$", LETTERS + "234567"),
    Encoding("base36", r"^(?=[^a-z]*[a-z])(?=[^0-9]*[0-9])[a-z0-9]+=*$", LETTERS + "0123456789"),
    Encoding("base36", r"^(?=[^A-Z]*[A-Z])(?=[^0-9]*[0-9])[A-Z0-9]+=*$", LETTERS.upper() + "0123456789"),
    Encoding("base64", r"^(?=[^A-Z]*[A-Z])(?=[^a-z]*[a-z])[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    Encoding("base64", r"^(?=[^A-Z]*[A-Z])(?=[^a-z]*[a-z])[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Cells of the chi-squared test; where an alphabet divides into them unevenly, each expects its share of the symbols.
CELLS = 8
#: Upper ends of the length classes, and the share of false rejections within a class.
LENGTHS = (24, 32, 48, 64, 128)
FALSE_DISCOVERIES = 0.05
#: Probabilities are compared in steps of a tenth of a power of ten, down to this many steps.
STEPS = 300
#: Lengths that are summed as one block when positions are accumulated.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; inside a lambda an expression would be computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _positions(lengths: Column) -> Column:
    """Sums of all lengths before each, in blocks, so that a text with many matches costs little more than their number."""
    zero = F.lit(0).cast("long")
    total = lambda part: F.aggregate(part, zero, lambda s, x: s + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / BLOCK).cast("int")), lambda b: total(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))
    before = lambda sums: F.transform(sums, lambda x, b: total(F.slice(sums, F.lit(1), b)))
    within = lambda k: total(F.slice(lengths, k - k % BLOCK + 1, k % BLOCK))
    return let(blocks, lambda sums: let(before(sums), lambda base: F.transform(lengths, lambda x, k: F.element_at(base, F.floor(k / BLOCK).cast("int") + 1) + within(k))))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost matches that don't overlap, as ``array<struct<start, end, found>>``; ``found`` is the group's text."""

    def build(whole: Column, gaps: Column, found: Column) -> Column:
        lengths = F.transform(whole, lambda m, k: (F.length(F.element_at(gaps, k + 1)) + F.length(m)).cast("long"))
        span = lambda s, k: F.struct(s.alias("start"), (s + F.length(F.element_at(whole, k + 1))).alias("end"), F.element_at(found, k + 1).alias("found"))
        return let(lengths, lambda sizes: let(_positions(sizes), lambda at: F.transform(at, lambda p, k: span(p + F.length(F.element_at(gaps, k + 1)), k))))

    every = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    return let(every(0), lambda whole: let(F.split(text, pattern, -1), lambda gaps: let(every(group), lambda found: build(whole, gaps, found)) if group else build(whole, gaps, whole)))


def _none() -> Column:
    return F.array().cast("array<struct<start:bigint,end:bigint,found:string>>")


def _matches_if(text: Column, quick: Column, pattern: str, group: int = 0) -> Column:
    return F.when(quick, matches(text, pattern, group)).otherwise(_none())


def _spans(found: Column, kind: str, rank: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _upper(z: Column) -> Column:
    """The normal distribution's upper tail, by a logistic approximation (within 0.0002)."""
    return 1 / (1 + F.exp(F.least(F.lit(700.0), 1.5976 * z + 0.070566 * z * z * z)))


def _encoding(token: Column) -> Column:
    """``struct<name, alphabet, body>`` or null."""
    body = F.regexp_replace(token, "=+$", "")
    out = F.lit(None).cast("struct<name:string,alphabet:string,body:string>")
    for e in reversed(ENCODINGS):
        out = F.when(token.rlike(e.pattern), F.struct(F.lit(e.name).alias("name"), F.lit(e.alphabet).alias("alphabet"), body.alias("body"))).otherwise(out)
    return out


def randomness(token: Column) -> Column:
    """``struct<class, step>`` of a string that has an encoding, else null.

    ``step`` grows as the combined probability falls: ten for each power of ten, 0 for a probability of one.
    """
    digits = lambda e: F.filter(F.transform(F.split(e["body"], ""), lambda c: F.instr(e["alphabet"], c) - 1), lambda c: c >= 0)
    judged = lambda e: let(digits(e), lambda codes: let(F.length(e["alphabet"]), lambda size: _class_and_step(e, codes, size)))
    return let(_encoding(token), lambda e: F.when(e.isNotNull(), judged(e)))


def _class_and_step(encoding: Column, codes: Column, size: Column) -> Column:
    n = F.size(codes).cast("double")
    freedom = CELLS - 1
    symbols = lambda cell: F.ceil((cell + 1) * size / CELLS) - F.ceil(cell * size / CELLS)
    cells = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda cell: F.struct(F.size(F.filter(codes, lambda c: F.floor(c * CELLS / size) == cell)).cast("double").alias("held"), (n * symbols(cell) / size).alias("expected")))
    chi = F.aggregate(cells, F.lit(0.0), lambda s, c: s + (c["held"] - c["expected"]) * (c["held"] - c["expected"]) / c["expected"])
    uniform = _upper((F.cbrt(chi / freedom) - (1 - 2 / (9 * freedom))) / (2 / (9 * freedom)) ** 0.5)

    neighbours = F.sequence(F.lit(2), F.size(codes))
    ups = F.size(F.filter(codes, lambda c: c >= size / 2)).cast("double")
    changes = F.size(F.filter(neighbours, lambda i: (F.element_at(codes, i) >= size / 2) != (F.element_at(codes, i - 1) >= size / 2))).cast("double")
    middle = lambda u: 2 * u * (n - u) / n + 1
    spread = lambda m: F.greatest(F.sqrt(F.abs((m - 1) * (m - 2)) / (n - 1)), F.lit(1e-9))
    runs = let(ups, lambda u: F.when((u == 0) | (u == n), F.lit(0.0)).otherwise(let(middle(u), lambda m: 2 * _upper(F.abs(changes + 1 - m) / spread(m)))))

    centre = (size - 1) / 2
    products = F.aggregate(neighbours, F.lit(0.0), lambda s, i: s + (F.element_at(codes, i) - centre) * (F.element_at(codes, i - 1) - centre))
    serial = 2 * _upper(F.abs(products / ((size * size - 1) / 12)) / F.sqrt(n - 1))

    combined = F.least(F.lit(1.0), 3 * F.least(uniform, runs, serial))
    step = F.least(F.lit(STEPS), F.floor(-10 * F.log10(F.greatest(combined, F.lit(1e-30))))).cast("int")
    length = reduce(lambda rest, top: F.when(F.length(encoding["body"]) <= top, F.lit(f"{top:03d}")).otherwise(rest), reversed(LENGTHS), F.lit("more"))
    return F.struct(F.concat_ws(":", encoding["name"], length).alias("class"), step.alias("step"))


def rejection_steps(tested: DataFrame, false_discoveries: float) -> dict[str, int]:
    """For each class the least step that is rejected, from ``(class, step)`` of all its strings.

    Benjamini and Hochberg's rule over a histogram: at most ``STEPS`` + 1 rows a class reach the driver.
    """
    out: dict[str, int] = {}
    totals: dict[str, int] = {}
    rows = tested.groupBy("class", "step").agg(F.count("*").alias("n")).collect()
    for row in rows:
        totals[row["class"]] = totals.get(row["class"], 0) + row.n
    seen: dict[str, int] = {}
    for row in sorted(rows, key=lambda r: -r.step):
        name = row["class"]
        seen[name] = seen.get(name, 0) + row.n
        if 10 ** (-row.step / 10) <= false_discoveries * seen[name] / totals[name]:
            out[name] = row.step
    return out


def scan_secrets(docs: DataFrame, *, false_discoveries: float = FALSE_DISCOVERIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_assign, n_access, n_hex, n_random, base_spans, spans``.

    ``base_spans`` and ``spans`` list ``kind:start:end`` by start, then kind (assign, access, hex, random), joined by
    commas. A random span touches no base span. A null or empty text has none. Repeated rows and null ids stay, and
    each row's strings count in the false-discovery control. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    tested = rows.where(text.rlike(ENCODED)).select(F.explode(F.regexp_extract_all("text", F.lit(ENCODED), F.lit(0))).alias("token"))
    judged = tested.select(randomness(F.col("token")).alias("r")).where("r IS NOT NULL").select("r.class", "r.step")
    rejected = rejection_steps(judged, false_discoveries)

    def is_random(token: Column) -> Column:
        least = lambda r: reduce(lambda rest, item: F.when(r["class"] == item[0], F.lit(item[1])).otherwise(rest), sorted(rejected.items()), F.lit(STEPS + 1))
        return let(randomness(token), lambda r: F.coalesce(r["step"] < least(r), F.lit(False)))

    assigned = F.filter(_matches_if(text, text.rlike("(?i)passw|secret|token|api_?key"), ASSIGN, 2), lambda m: F.length(m["found"]) >= LEAST_ASSIGNED)
    access = _matches_if(text, text.contains("AKIA"), ACCESS)
    digests = _matches_if(text, text.rlike(HEX), HEX)
    encoded = _matches_if(text, text.rlike(ENCODED), ENCODED)

    def touching(spans: Column, m: Column) -> Column:
        return F.exists(spans, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))

    base = F.concat(_spans(assigned, "assign", 0), _spans(access, "access", 1), _spans(digests, "hex", 2))
    others = lambda spans: F.filter(encoded, lambda m: ~touching(spans, m) & is_random(m["found"]))
    found = let(base, lambda spans: F.struct(spans.alias("base"), _spans(others(spans), "random", 3).alias("random")))
    count = lambda kind: F.size(F.filter("found.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", found.alias("found")).select(
        "doc_id",
        *map(count, ("assign", "access", "hex")),
        F.size("found.random").cast("long").alias("n_random"),
        _joined(F.col("found.base")).alias("base_spans"),
        _joined(F.concat("found.base", "found.random")).alias("spans"),
    )
