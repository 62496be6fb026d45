"""Vector and training-schedule functions as Column expressions."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column, floor: float = 1e-9) -> Column:
    n = F.greatest(norm(v), F.lit(floor))
    return F.transform(as_double(v), lambda x: x / n)


def cosine(a: Column, b: Column, floor: float = 1e-9) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(floor)) * F.greatest(norm(b), F.lit(floor)))


def to_unit(s: Column) -> Column:
    """A cosine of -1..1 as 0..1."""
    return (s + 1) / 2


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def fuse(cos: Column, sparse: Column, alpha: float) -> Column:
    """Dense and sparse score in one, both brought to 0..1."""
    return (1 - alpha) * to_unit(cos) + alpha * clip(F.coalesce(sparse, F.lit(0.0)), 0.0, 1.0)


def project_to_ball(v: Column, radius: float) -> Column:
    s = F.least(F.lit(1.0), F.lit(radius) / F.greatest(norm(v), F.lit(1e-12)))
    return F.transform(as_double(v), lambda x: x * s)


def warmup_rate(step: Column, base: float, warmup: int, total: int) -> Column:
    """Linear rise to the base rate, then linear fall to 0."""
    return F.when(step < warmup, base * step / max(1, warmup)).otherwise(base * F.greatest(F.lit(0.0), (total - step) / max(1, total - warmup)))


def ramp_radius(step: Column, gamma: Column, start: float, top: float, warmup: int) -> Column:
    """Linear ramp, then top * tanh(gamma), at least 1e-6."""
    return F.greatest(F.lit(1e-6), F.when(step < warmup, start + (top - start) * step / max(1, warmup)).otherwise(top * F.tanh(gamma)))


def balance(gamma: Column, low: float, high: float) -> Column:
    return clip(1 / F.greatest(gamma, F.lit(1e-8)), low, high)


def ema(values: Column, beta: float) -> Column:
    """Exponential mean of an ordered array, starting from its first value."""
    return F.aggregate(F.slice(values, 2, 2_000_000_000), F.get(values, F.lit(0)), lambda acc, x: beta * acc + (1 - beta) * x)


def greedy_match(predicted: Column, reference: Column) -> Column:
    """Struct (precision, recall, f1) of two arrays of token vectors: each token by its nearest of the other side; nulls and empty sides give 0."""
    near = lambda xs, ys: F.aggregate(F.transform(xs, lambda x: F.array_max(F.transform(ys, lambda y: cosine(x, y)))), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) / F.size(xs)
    ok = (F.coalesce(F.size(predicted), F.lit(0)) > 0) & (F.coalesce(F.size(reference), F.lit(0)) > 0)
    p, r = F.when(ok, near(predicted, reference)).otherwise(0.0), F.when(ok, near(reference, predicted)).otherwise(0.0)
    return F.struct(p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def perplexity(mean_loss: Column) -> Column:
    return F.exp(mean_loss)


