"""Synthetic cases: facts drawn by seeded hashes, states rendered from them, questions labelled by fixed rules.

Every draw is a hash of (seed, case, name), so a case depends on nothing else and any executor makes the same one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.text import lower_first
from tallyloom.operators.unique import unique_cases
from tallyloom.schema import BINARY, CHOICE, ORDINAL

# Facts with their weights, bounds of panel levels, and the names of families and categories that
# datasets hold. Wording is our own.
FACTS = {
    "refund": (("requested", 0.35), ("declined", 0.2), ("past", 0.15), ("absent", 0.3)),
    "charge": (("double", 0.35), ("denied", 0.15), ("absent", 0.5)),
    "fault": (("active", 0.45), ("resolved", 0.25), ("absent", 0.3)),
    "fault_kind": (("network", 0.25), ("performance", 0.25), ("data", 0.25), ("application", 0.25)),
    "access": (("locked", 0.3), ("ok", 0.15), ("absent", 0.55)),
}
TYPE_WEIGHTS = ((BINARY, 0.4), (CHOICE, 0.3), (ORDINAL, 0.3))
LEVEL_BOUNDS = (25, 50, 75)
OTHER_RATE, OPTION_RANGE, JSON_RATE = 0.2, (3, 6), 0.3
CHANNELS, TIERS = ("email", "chat", "web_form"), ("standard", "premium")
BINARY_KINDS = ("refund", "double", "fault", "locked", "escalate")
REAL_KINDS = ("network", "performance", "data", "application")
CATEGORIES = {
    "es": {"network": "Conexión o red", "performance": "Lentitud", "data": "Datos dañados o perdidos", "application": "Error de una función", "none": "Sin avería", "other": "Otra clase de avería", "billing": "Error de facturación", "hardware": "Equipo físico", "security": "Intrusión", "training": "Duda de uso"},
    "en": {"network": "Connection or network", "performance": "Slowness", "data": "Damaged or lost data", "application": "Error of a feature", "none": "No fault", "other": "Another kind of fault", "billing": "Billing error", "hardware": "Physical equipment", "security": "Intrusion", "training": "Question about use"},
}
DISTRACTORS = ("billing", "hardware", "security", "training")
_SENTENCES = {
    "es": {"refund.requested": "Pido que se me devuelva lo pagado.", "refund.declined": "No pido ninguna devolución.", "refund.past": "Hace un año recibí una devolución por otra compra.", "charge.double": "El mismo importe aparece cobrado dos veces.", "charge.denied": "El cobro es correcto y aparece una vez.", "fault.active.network": "La conexión se corta ahora mismo.", "fault.active.performance": "Ahora todo tarda minutos.", "fault.active.data": "Ahora faltan registros.", "fault.active.application": "Una función falla ahora.", "fault.resolved.network": "La conexión se cortó y ya funciona.", "fault.resolved.performance": "Iba lento y ya va bien.", "fault.resolved.data": "Faltaban registros y ya están.", "fault.resolved.application": "Una función falló y ya funciona.", "access.locked": "No logro entrar en la cuenta.", "access.ok": "Entro en la cuenta sin dificultad."},
    "en": {"refund.requested": "I ask to get back what I paid.", "refund.declined": "I do not ask for any refund.", "refund.past": "A year ago I got a refund for something else.", "charge.double": "The same amount was charged two times.", "charge.denied": "The charge is right and appears once.", "fault.active.network": "The connection keeps dropping right now.", "fault.active.performance": "Everything takes minutes right now.", "fault.active.data": "Records are missing right now.", "fault.active.application": "A feature is failing right now.", "fault.resolved.network": "The connection dropped and works again.", "fault.resolved.performance": "It was slow and is fine again.", "fault.resolved.data": "Records were missing and are back.", "fault.resolved.application": "A feature failed and works again.", "access.locked": "I cannot get into the account.", "access.ok": "I get into the account without trouble."},
}
_ASK = {
    "es": {"refund": "¿Se reclama el dinero de una compra?", "double": "¿Hay un cobro repetido?", "fault": "¿Hay ahora una avería?", "locked": "¿Está el cliente sin acceso?", "escalate": "¿Hay cobro repetido y petición de devolución a la vez?", "fault_type": "¿Qué clase de avería se describe?", "team": "¿Qué equipo corresponde?", "impact": "¿A qué parte de los usuarios afecta?", "severity": "¿Cómo de grave es la avería?"},
    "en": {"refund": "Is the money for a purchase asked back?", "double": "Is there a repeated charge?", "fault": "Is there a fault now?", "locked": "Is the customer without access?", "escalate": "Are there both a repeated charge and a request for a refund?", "fault_type": "Which kind of fault is described?", "team": "Which team applies?", "impact": "What part of the users is affected?", "severity": "How severe is the fault?"},
}
#: Ways to lead into a sentence, to give the share of users, to name the case, to open and to close.
_LEADS = {"es": ("", "Os cuento:", "Por aclararlo,", "Además,"), "en": ("", "Note this:", "To be clear,", "Also,")}
_USERS = {"es": ("Usuarios afectados del total:", "De los usuarios, afecta a", "Afectados / todos:"), "en": ("Users affected of all:", "Of the users, it affects", "Affected / all:")}
_REFERENCE = {"es": ("Mi expediente es el", "La referencia es", "Pedido número"), "en": ("My file is", "The reference is", "Order number")}
_OPENERS = {"es": ("", "Hola,", "Buenas tardes.", "Al equipo de soporte,"), "en": ("", "Hello,", "Good afternoon.", "Dear support team,")}
_CLOSERS = {"es": ("", "Un saludo.", "Quedo a la espera.", "Gracias de antemano."), "en": ("", "Best regards.", "I await your answer.", "Thanks in advance.")}
_ACCESS_CLAUSE = {"es": "No poder entrar en la cuenta no cuenta como avería.", "en": "Being unable to get into the account is not a fault."}
_OTHER_CLAUSE = {"es": "Si la clase descrita no está entre las opciones, elige la de otra clase.", "en": "If the kind described is not among the options, choose the one for another kind."}
_TEAMS = {"es": ("Facturación", "Cuentas", "Técnica", "General"), "en": ("Billing", "Accounts", "Technical", "General")}
_RUBRICS = {
    "es": {"severity": ("Sin avería", "Avería pasada", "Avería presente"), 3: ("Nadie", "Una parte", "Todos"), 4: ("Nadie", "Menos de la mitad", "La mitad o más", "Todos"), 5: ("Nadie", "Hasta un cuarto", "Hasta la mitad", "Más de la mitad", "Todos")},
    "en": {"severity": ("No fault", "Past fault", "Present fault"), 3: ("Nobody", "A part", "Everybody"), 4: ("Nobody", "Less than half", "Half or more", "Everybody"), 5: ("Nobody", "Up to a quarter", "Up to half", "More than half", "Everybody")},
}


def uniform(seed: int, *keys: Column | str) -> Column:
    """In [0, 1), from a hash of the seed and the keys."""
    parts = [F.lit(k) if isinstance(k, str) else k for k in keys]
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) / float(1 << 53)


def pick(u: Column, options) -> Column:
    """The option that a uniform draw falls on."""
    edge, out = 1.0, None
    for value, weight in reversed(options):
        out = F.lit(value) if out is None else F.when(u < edge, value).otherwise(out)
        edge -= weight
    return out


def binary_rule(kind: Column, facts: Column) -> Column:
    """1 where the fact that a binary question asks about holds."""
    double, refund = facts["charge"] == "double", facts["refund"] == "requested"
    holds = F.when(kind == "refund", refund).when(kind == "double", double).when(kind == "fault", facts["fault"] == "active").when(kind == "locked", facts["access"] == "locked").when(kind == "escalate", double & refund)
    return holds.cast("int")


def team_rule(facts: Column) -> Column:
    """The first team that applies: billing, accounts, technical, else general; as an index."""
    return F.when((facts["charge"] == "double") | (facts["refund"] == "requested"), 0).when(facts["access"] == "locked", 1).when(facts["fault"] == "active", 2).otherwise(3)


def severity_rule(facts: Column) -> Column:
    return F.when(facts["fault"] == "active", 2).when(facts["fault"] == "resolved", 1).otherwise(0)


def impact_level(x: Column, y: Column, m: Column) -> Column:
    """Level of x of y users on a rubric of 3, 4 or 5 levels: the ends are nobody and everybody. Other rubrics fail the query."""
    r = x / y
    inner = F.when(m == 3, 1).when(m == 4, F.when(r < 0.5, 1).otherwise(2)).when(m == 5, F.when(r <= 0.25, 1).when(r <= 0.5, 2).otherwise(3))
    known = x.isNull() | m.isNull() | m.isin(3, 4, 5)
    return F.when(~known, F.raise_error(F.lit("impact rubrics have 3, 4 or 5 levels")).cast("int")).when(x == 0, 0).when(x == y, m - 1).otherwise(inner).cast("int")


def panel_level(value: Column) -> Column:
    """How many of the fixed bounds a panel's value is above."""
    return sum(((value > b).cast("int") for b in LEVEL_BOUNDS[1:]), (value > LEVEL_BOUNDS[0]).cast("int"))


def true_category(facts: Column) -> Column:
    """The fault's kind, or ``none`` without a fault."""
    return F.when(facts["fault"] == "absent", "none").otherwise(facts["fault_kind"])


def with_facts(base: DataFrame, seed: int) -> DataFrame:
    """``case, attempt, group_id, language, facts`` of ``base (case, attempt)``; a case without any fact is drawn again at once."""
    attempt = lambda a: F.struct(*[pick(uniform(seed, F.col("case"), F.col("attempt"), name, str(a)), FACTS[name]).alias(name) for name in ("refund", "charge", "fault", "access")])
    some = lambda f: (f["refund"] != "absent") | (f["charge"] != "absent") | (f["fault"] != "absent") | (f["access"] != "absent")
    tries = base.withColumn("f", F.get(F.filter(F.array(*map(attempt, range(8))), some), F.lit(0)))  # all eight empty: odds of 1e-13
    u = lambda name: uniform(seed, F.col("case"), F.col("attempt"), name)
    faulty = F.col("f.fault") != "absent"
    y = (4 + F.floor(u("users") * 197)).cast("int")
    part = pick(u("share"), (("zero", 0.2), ("all", 0.2), ("partial", 0.6)))
    x = F.when(part == "zero", 0).when(part == "all", y).otherwise((1 + F.floor(u("affected") * (y - 1))).cast("int"))
    impact = F.when(faulty & (u("impact") < 0.7), F.struct(x.alias("x"), y.alias("y")))
    facts = F.struct("f.refund", "f.charge", "f.fault", F.when(faulty, pick(u("kind"), FACTS["fault_kind"])).alias("fault_kind"), "f.access", impact.alias("impact"))
    language = F.when(F.col("case") % 2 == 0, "es").otherwise("en")
    return tries.select("case", "attempt", F.format_string("case-%d-%06d", F.lit(seed), "case").alias("group_id"), language.alias("language"), facts.alias("facts"))


def _by_language(values: dict[str, str]) -> Column:
    return F.when(F.col("language") == "es", values["es"]).otherwise(values["en"])


def _drawn(options: tuple, u: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (F.floor(u * len(options)) + 1).cast("int"))


def _phrase(seed: int, pool: dict[str, tuple], name: str) -> Column:
    """One of the language's phrases."""
    u = uniform(seed, F.col("case"), F.col("attempt"), name)
    return F.when(F.col("language") == "es", _drawn(pool["es"], u)).otherwise(_drawn(pool["en"], u))


def _after(first: Column, rest: Column) -> Column:
    """``rest`` after ``first``, if that isn't empty; after a comma it goes on in lower case."""
    return F.concat_ws(" ", F.nullif(first, F.lit("")), F.when(first.endswith(","), lower_first(rest)).otherwise(rest))


def said(seed: int) -> Column:
    """The facts in words: each said in one of several ways, in a drawn order."""
    facts, parts = F.col("facts"), []
    known = [(fact, F.concat_ws(".", F.lit(fact), facts[fact]), facts[fact] != "absent") for fact in ("refund", "charge", "access")]
    known.append(("fault", F.concat_ws(".", F.lit("fault"), facts["fault"], facts["fault_kind"]), facts["fault"] != "absent"))
    for fact, key, holds in known:
        text = _lookup({f"{language}.{k}": text for language, texts in _SENTENCES.items() for k, text in texts.items()}, F.concat_ws(".", "language", key))
        parts.append(F.when(holds, _after(_phrase(seed, _LEADS, f"lead.{fact}"), text)))
    users = F.format_string("%d / %d.", facts["impact"]["x"], facts["impact"]["y"])
    parts.append(F.when(facts["impact"].isNotNull() & ~F.col("_json"), F.concat_ws(" ", _phrase(seed, _USERS, "users"), users)))
    number = F.floor(10_000 + uniform(seed, F.col("case"), F.col("attempt"), "number") * 90_000).cast("string")
    parts.append(F.concat(_phrase(seed, _REFERENCE, "reference"), F.lit(" "), number, F.lit(".")))
    order = [F.struct(uniform(seed, F.col("case"), F.col("attempt"), f"order.{i}").alias("u"), p.alias("s")) for i, p in enumerate(parts)]
    return F.array_join(F.transform(F.array_sort(F.filter(F.array(*order), lambda x: x["s"].isNotNull())), lambda x: x["s"]), " ")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def render_states(cases: DataFrame, seed: int, version: int) -> DataFrame:
    """``cases`` (with facts) with ``state, state_kind``: a text, or for three in ten a record in canonical JSON.

    The message stands between an opening and a close; from version 2 on it goes on in lower case after a comma.
    """
    u = lambda name: uniform(seed, F.col("case"), F.col("attempt"), name)
    rows = cases.withColumn("_json", u("json") < JSON_RATE).withColumns({"_said": said(seed), "_opener": _phrase(seed, _OPENERS, "opener"), "_close": _phrase(seed, _CLOSERS, "close")})
    opened = _after(F.col("_opener"), F.col("_said")) if version > 1 else F.concat_ws(" ", F.nullif("_opener", F.lit("")), F.col("_said"))
    rows = rows.withColumn("_said", F.concat_ws(" ", opened, F.nullif("_close", F.lit(""))))
    rows = rows.withColumn("_quoted", F.to_json(F.array("_said")))
    impact = F.col("facts.impact")
    fields = [
        F.when(impact.isNotNull(), F.format_string('"affected_users": %d', impact["x"])),
        F.format_string('"channel": "%s"', _drawn(CHANNELS, u("channel"))),
        F.format_string('"customer_tier": "%s"', _drawn(TIERS, u("tier"))),
        F.concat(F.lit('"message": '), F.substring("_quoted", F.lit(2), F.length("_quoted") - 2)),
        F.when(impact.isNotNull(), F.format_string('"total_users": %d', impact["y"])),
    ]
    record = F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))
    return rows.withColumns({"state": F.when(F.col("_json"), record).otherwise(F.col("_said")), "state_kind": F.when(F.col("_json"), "object").otherwise("text")}).drop("_said", "_json", "_opener", "_close", "_quoted")


def unique_states(spark: SparkSession, cases: int, seed: int, version: int = 5) -> DataFrame:
    """``case, attempt, group_id, language, facts, state, state_kind`` of ``cases`` cases, no two of one state.

    A case whose state another has already is drawn anew, facts and words, as often as it takes.
    """
    base = spark.range(cases).withColumnRenamed("id", "case")
    make = lambda waiting: render_states(with_facts(waiting.select("case", "attempt"), seed), seed, version).withColumn("state_key", F.sha2("state", 256))
    return unique_cases(base, make, "state_key").drop("state_key")


def _ask(kind: Column, names) -> Column:
    return reduce(lambda rest, n: F.when(kind == n, _by_language({k: a[n] for k, a in _ASK.items()})).otherwise(rest), names, F.lit(None).cast("string"))


def option_id(seed: int, *keys: Column | str) -> Column:
    """An opaque option id, ``o`` and six hexadecimal digits."""
    return F.concat(F.lit("o"), F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.lit(k) if isinstance(k, str) else k.cast("string") for k in keys]), 256), 1, 6))


def _by_draw(seed: int, names: Column, what: str) -> Column:
    """``names`` in an order drawn for the question."""
    return F.transform(F.array_sort(F.transform(names, lambda c: F.struct(F.xxhash64(F.lit(seed), F.lit(what), "case", "attempt", "kind", c).alias("h"), c.alias("c")))), lambda s: s["c"])


def _names(*names: str) -> Column:
    return F.array(*map(F.lit, names))


def _without(names: Column, *gone: Column) -> Column:
    return F.filter(names, lambda c: ~F.exists(F.array(*gone), lambda g: g == c))


def shared_options(seed: int, size: Column, u: Column) -> tuple[Column, Column]:
    """Versions 1 to 3: the true category and others; where there is a fault, for some the true one is left out for ``other``.

    There are four categories beside ``other`` when the true one is left out, so sizes beyond five tell the label: kept
    as it was.
    """
    true = true_category(F.col("facts"))
    left_out = (true != "none") & (u < OTHER_RATE)
    every = _names(*REAL_KINDS, "none")
    rest = _by_draw(seed, F.when(left_out, _without(every, true)).otherwise(_without(F.concat(every, _names("other")), true)), "shared")
    label = F.when(left_out, "other").otherwise(true)
    return F.concat(F.array(label), F.slice(rest, F.lit(1), size - 1)), label


def wide_options(seed: int, size: Column, u: Column) -> tuple[Column, Column]:
    """Version 4: distractors make up any size, so that ``other`` is as likely for each."""
    true = true_category(F.col("facts"))
    left_out = (true != "none") & (u < OTHER_RATE)
    wrong = _without(_names(*REAL_KINDS, "none", *DISTRACTORS), true)
    label = F.when(left_out, "other").otherwise(true)
    rest = _by_draw(seed, F.when(left_out, wrong).otherwise(F.concat(wrong, _names("other"))), "wide")
    return F.concat(F.array(label), F.slice(rest, F.lit(1), size - 1)), label


def blind_options(seed: int, size: Column, u: Column) -> tuple[Column, Column]:
    """Version 5: ``none``, ``other`` and categories drawn without a look at the facts; the label follows from both."""
    true = true_category(F.col("facts"))
    chosen = F.concat(_names("none", "other"), F.slice(_by_draw(seed, _names(*REAL_KINDS, *DISTRACTORS), "blind"), F.lit(1), size - 2))
    return chosen, F.when(F.array_contains(chosen, true), true).otherwise("other")


@dataclass(frozen=True)
class Version:
    """What a version of the generator does: rubrics that may be turned, the clause on access, and its options of faults."""

    turned: bool
    clause: bool
    options: Callable[[int, Column, Column], tuple[Column, Column]]


VERSIONS = {1: Version(False, False, shared_options), 2: Version(True, False, shared_options), 3: Version(True, True, shared_options), 4: Version(True, True, wide_options), 5: Version(True, True, blind_options)}
#: Kinds of questions by type; a case asks a kind once.
QUESTION_KINDS = {BINARY: BINARY_KINDS, CHOICE: ("fault_type", "team"), ORDINAL: ("impact", "severity")}
FAULT_FAMILIES = ("fault", "fault_type", "severity")


def _asked(cases: DataFrame, seed: int, questions: int, only: str | None) -> DataFrame:
    """Each case's kinds of questions, without repetition: a type's weight is shared by its kinds."""
    keys = []
    for name, weight in TYPE_WEIGHTS:
        kinds = QUESTION_KINDS[name]
        if only in (None, name):
            keys += [F.when((F.col("facts.impact").isNotNull() | (F.lit(k) != "impact")), F.struct((-F.ln(F.greatest(uniform(seed, F.col("case"), F.col("attempt"), f"ask.{k}"), F.lit(1e-300))) * len(kinds) / weight).alias("key"), F.lit(name).alias("type"), F.lit(k).alias("kind"))) for k in kinds]
    return cases.select("*", F.posexplode(F.slice(F.array_sort(F.array_compact(F.array(*keys))), 1, questions)).alias("number", "_q")).select("*", F.col("_q.type").alias("type"), F.col("_q.kind").alias("kind")).drop("_q")


def generate_mixed(spark: SparkSession, cases: int, seed: int, questions: int = 3, *, only: str | None = None, version: int = 5) -> DataFrame:
    """Examples (schema ``EXAMPLE``) with ``facts``: ``questions`` different ones a case, by weight (or all of type ``only``).

    No two cases have one state. ``version`` 1 to 5 is a row of ``VERSIONS``. From version 2 on, half of the rubrics are
    turned, with their labels. A case that has fewer kinds than ``questions`` is an error.
    """
    known = sum(len(k) for t, k in QUESTION_KINDS.items() if only in (None, t)) - (only in (None, ORDINAL))
    if cases < 1 or not 1 <= questions <= known or version not in VERSIONS:
        raise ValueError(f"at least one case, of 1 to {known} questions, in a version of {sorted(VERSIONS)}")
    of = VERSIONS[version]
    rows = _asked(unique_states(spark, cases, seed, version), seed, questions, only)
    u = lambda name: uniform(seed, F.col("case"), F.col("attempt"), F.col("kind"), name)
    facts, language, kind = F.col("facts"), F.col("language"), F.col("kind")
    size = (OPTION_RANGE[0] + F.floor(u("size") * (OPTION_RANGE[1] - OPTION_RANGE[0] + 1))).cast("int")
    cats, label = of.options(seed, size, u("other"))
    turned = (u("turned") < 0.5) if of.turned else F.lit(False)
    rows = rows.withColumns({"_cats": _by_draw(seed, cats, "order"), "_label": label, "_m": (3 + F.floor(u("levels") * 3)).cast("int"), "_turned": turned & (F.col("type") == ORDINAL)})
    text = lambda c: reduce(lambda rest, name: F.when(c == name, _by_language({k: v[name] for k, v in CATEGORIES.items()})).otherwise(rest), CATEGORIES["en"], F.lit(None).cast("string"))
    ident = lambda c: option_id(seed, F.col("case"), F.col("attempt"), F.col("kind"), c)
    fault = F.transform("_cats", lambda c: F.struct(ident(c).alias("id"), text(c).alias("description")))
    teams = F.transform(F.array(*map(F.lit, range(4))), lambda i: F.struct(ident(i).alias("id"), F.when(language == "es", F.element_at(F.array(*map(F.lit, _TEAMS["es"])), i + 1)).otherwise(F.element_at(F.array(*map(F.lit, _TEAMS["en"])), i + 1)).alias("description")))
    options = F.when(kind == "fault_type", fault).when(kind == "team", teams)
    class_id = F.when(kind == "fault_type", ident(F.col("_label"))).when(kind == "team", ident(team_rule(facts)))
    rubric = lambda key: F.when(language == "es", F.array(*map(F.lit, _RUBRICS["es"][key]))).otherwise(F.array(*map(F.lit, _RUBRICS["en"][key])))
    levels = F.when(kind == "severity", rubric("severity")).when(F.col("_m") == 3, rubric(3)).when(F.col("_m") == 4, rubric(4)).otherwise(rubric(5))
    level = F.when(kind == "severity", severity_rule(facts)).otherwise(impact_level(facts["impact"]["x"], facts["impact"]["y"], F.col("_m")))
    ordinal = F.col("type") == ORDINAL
    rows = rows.withColumns({"_levels": F.when(ordinal, F.when(F.col("_turned"), F.reverse(levels)).otherwise(levels)), "_level": F.when(ordinal, F.when(F.col("_turned"), F.size(levels) - 1 - level).otherwise(level))})
    null = F.lit(None).cast("string")
    instructions = _ask(kind, ("fault_type", "team", "impact", "severity", *BINARY_KINDS))
    if of.clause:
        instructions = F.when(kind.isin(*FAULT_FAMILIES), F.concat_ws(" ", instructions, _by_language(_ACCESS_CLAUSE))).otherwise(instructions)
    if of.options is blind_options:
        instructions = F.when(kind == "fault_type", F.concat_ws(" ", instructions, _by_language(_OTHER_CLAUSE))).otherwise(instructions)
    method = F.concat(kind, F.when(kind == "impact", F.concat(F.lit("_m"), F.col("_m").cast("string"))).otherwise(""), F.when(F.col("_turned"), "_turned").otherwise(""))
    return rows.select(
        F.lit(1).alias("schema_version"),
        F.concat_ws("-", "group_id", "kind").alias("id"),
        "group_id",
        kind.alias("task_family"),
        "language",
        "state",
        "state_kind",
        null.alias("image_path"),
        F.struct(F.col("type").alias("type"), instructions.alias("instructions"), options.alias("options"), F.col("_levels").alias("levels")).alias("question"),
        F.struct(F.when(F.col("type") == BINARY, binary_rule(kind, facts)).alias("label"), class_id.alias("class_id"), F.col("_level").cast("int").alias("level_index")).alias("target"),
        F.struct(F.lit("synthetic_rule").alias("source"), F.lit(f"mixed-{version}").alias("generator_version"), method.alias("label_method"), F.concat_ws("-", "language", "state_kind").alias("template_id"), F.lit(seed).cast("long").alias("seed"), null.alias("model"), null.alias("model_revision"), null.alias("prompt_id"), null.alias("review_status")).alias("provenance"),
        "facts",
    )


def generate_binary(spark: SparkSession, cases: int, seed: int, questions: int = 5) -> DataFrame:
    return generate_mixed(spark, cases, seed, questions, only=BINARY)
