"""Probability and array expressions. Undefined results are null, never 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Probabilities below this count as this in a categorical log-likelihood.
FLOOR = 1e-300
BINS = 15


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def softplus(z: Column) -> Column:
    """ln(1 + e^z) without overflow."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def inverse_softplus(y: Column) -> Column:
    return F.ln(F.expm1(y))


def binary_nll(z: Column, y: Column) -> Column:
    return F.when(y == 1, softplus(-z)).otherwise(softplus(z))


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def softmax(z: Column, temperature: float | Column = 1.0) -> Column:
    """Of the whole group's logits, shifted by their maximum."""
    bind = lambda v, body: F.element_at(F.transform(F.array(v), body), 1)
    scaled = F.transform(z, lambda x: x / temperature)
    raised = lambda s: bind(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top)))
    return bind(scaled, lambda s: bind(raised(s), lambda e: bind(total(e), lambda t: F.transform(e, lambda x: x / t))))


def log_softmax(z: Column) -> Column:
    bind = lambda v, body: F.element_at(F.transform(F.array(v), body), 1)
    return bind(F.array_max(z), lambda top: bind(F.ln(total(F.transform(z, lambda x: F.exp(x - top)))) + top, lambda norm: F.transform(z, lambda x: x - norm)))


def argmax(values: Column) -> Column:
    """Index of the first largest element, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def at(values: Column, index: Column) -> Column:
    return F.element_at(values, index + 1)


def choice_nll(p: Column, target: Column) -> Column:
    return -F.ln(F.greatest(at(p, target), F.lit(FLOOR)))


def brier_sum(p: Column, target: Column) -> Column:
    """Squared errors summed over the classes, not divided by their number."""
    return F.aggregate(F.transform(p, lambda x, i: F.pow(x - F.when(i == target, 1.0).otherwise(0.0), F.lit(2))), F.lit(0.0), lambda s, x: s + x)


def concentration(p: Column) -> Column:
    """1 - entropy / ln K within [0, 1]; 0 ln 0 is 0."""
    entropy = -F.aggregate(p, F.lit(0.0), lambda s, x: s + F.when(x > 0, x * F.ln(x)).otherwise(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - entropy / F.ln(F.size(p).cast("double"))))


def cumulative(p: Column) -> Column:
    """Sums up to each element but the last: probabilities of the cumulative events."""
    return F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x, i: F.aggregate(F.slice(p, F.lit(1), i + 1), F.lit(0.0), lambda s, y: s + y))


def rps(p: Column, target: Column) -> Column:
    """Ranked probability score: squared cumulative errors over M - 1."""
    squared = F.transform(cumulative(p), lambda c, i: F.pow(c - F.when(target <= i, 1.0).otherwise(0.0), F.lit(2)))
    return total(squared) / (F.size(p) - 1)


def expectation(p: Column) -> Column:
    return F.aggregate(F.transform(p, lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)


def bin_index(p: Column, bins: int = BINS) -> Column:
    """Of equal bins of [0, 1]; 1 falls in the last."""
    return F.least(F.floor(p * bins).cast("int"), F.lit(bins - 1))


def is_distribution(p: Column, tolerance: float = 1e-6) -> Column:
    """Finite, and summing to 1."""
    return F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.abs(total(p) - 1) <= tolerance)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l1(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return safe_div(dot(a, b), l2(a) * l2(b))


def one_hot(index: Column, size: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.when(i == index, 1.0).otherwise(0.0))


def last_valid(mask: Column) -> Column:
    """The largest index whose mask is 1; null if there is none."""
    return F.array_max(F.filter(F.transform(mask, lambda m, i: F.when(m == 1, i)), lambda i: i.isNotNull()))


def warmup_decay(step: Column, warmup: int, steps: int) -> Column:
    """Learning-rate factor: linear warm-up, then linear decay to 0."""
    rising = (step + 1) / max(1, warmup)
    falling = F.greatest(F.lit(0.0), (steps - step) / max(1, steps - warmup))
    return F.when(step < warmup, rising).otherwise(falling)


def top_k(values: Column, k: int) -> Column:
    return F.slice(F.reverse(F.array_sort(values)), 1, k)
