"""Columns over arrays of numbers: softmax, confidence, answers, calibration buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of a fitted temperature.
TEMP_MIN, TEMP_MAX = 0.5, 5.0


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def argmax(a: Column) -> Column:
    """Index of the first maximum."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def softmax(z: Column, t: Column | float = 1.0, floor: float | None = None) -> Column:
    """exp((z - max z) / t), normalised; ``floor`` is the least temperature that divides."""
    t = F.lit(t) if isinstance(t, float) else t
    t = F.greatest(F.lit(floor), t) if floor else t
    e = F.transform(z, lambda x: F.exp((x - F.array_max(z)) / t))
    return F.transform(e, lambda x: x / total(e))


def entropy(p: Column, clip: float) -> Column:
    return -total(F.transform(p, lambda x: x * F.ln(F.least(F.greatest(x, F.lit(clip)), F.lit(1.0)))))


def confidence(p: Column) -> Column:
    """1 - H / ln k in [0, 1]; a single option is certain."""
    k = F.size(p)
    return F.when(k < 2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - entropy(p, 1e-12) / F.ln(k))))


def top_two(p: Column) -> Column:
    return F.slice(F.sort_array(p, asc=False), 1, 2)


def head_features(p: Column) -> Column:
    """Largest probability, margin, entropy / ln max(k, 2) with its own floor, k / 255."""
    k = F.size(p)
    best = top_two(p)
    return F.struct(F.get(best, 0).alias("top1"), (F.get(best, 0) - F.coalesce(F.get(best, 1), F.lit(0.0))).alias("margin"), (entropy(p, 1e-9) / F.ln(F.greatest(k, F.lit(2)))).alias("entropy"), (k / 255.0).alias("options"))


def nll(p: Column, label: Column) -> Column:
    return -F.ln(F.greatest(F.get(p, label), F.lit(1e-9)))


def log_loss(z: Column, label: Column, t: Column) -> Column:
    """-log softmax(z / t)[label], without a floor."""
    m = F.array_max(z)
    return F.ln(total(F.transform(z, lambda x: F.exp((x - m) / t)))) - (F.get(z, label) - m) / t


def brier(p: Column, label: Column) -> Column:
    return total(F.transform(p, lambda x, i: F.pow(x - F.when(i == label, 1.0).otherwise(0.0), F.lit(2.0))))


def expectation(p: Column) -> Column:
    return total(F.transform(p, lambda x, i: x * i))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def kl(p: Column, q: Column) -> Column:
    """KL(p || q), terms with p = 0 left out."""
    return total(F.zip_with(p, q, lambda x, y: F.when(x > 0, x * (F.ln(x) - F.ln(F.greatest(y, F.lit(1e-12))))).otherwise(0.0)))


def clamp_temperature(t: Column) -> Column:
    """Text or number to a usable temperature; what is not a finite number is 1."""
    x = t.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 1.0).otherwise(F.least(F.lit(TEMP_MAX), F.greatest(F.lit(TEMP_MIN), x)))


def option_bucket(kind: Column, k: Column) -> Column:
    size = F.when(k <= 2, "2").when(k <= 5, "3-5").when(k <= 10, "6-10").otherwise("11+")
    return F.concat_ws(":", kind, size)


def rotations(options: Column) -> Column:
    """All rotations of an array, itself first."""
    n = F.size(options)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda r: F.concat(F.slice(options, r + 1, n), F.slice(options, F.lit(1), r)))


def strided(frames: Column) -> Column:
    """Frames left after three convolutions of stride 2."""
    once = lambda n: F.when(n > 0, F.floor((n - 1) / 2) + 1).otherwise(0)
    return once(once(once(frames)))


def warmup_cosine(step: Column, warmup: int, steps: int) -> Column:
    """Linear warm-up to 1, then half a cosine to 0."""
    rest = (step - warmup) / F.lit(float(max(1, steps - warmup)))
    return F.when(step < warmup, (step + 1) / F.lit(float(warmup))).otherwise(0.5 * (1 + F.cos(F.lit(3.141592653589793) * F.least(F.lit(1.0), rest))))
