"""Scalar functions over probabilities, supports, numbers and dates, as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_sigmoid(x: Column) -> Column:
    """1 / (1 + e**-x) without overflow on either side."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def expanded(logits: Column) -> Column:
    """One logit stands for [0, z]; more stay as they are."""
    return F.when(F.size(logits) == 1, F.array(F.lit(0.0), F.get(logits, F.lit(0)))).otherwise(logits)


def softmax(logits: Column, temperature: float | Column = 1.0) -> Column:
    top = F.array_max(logits)
    weights = F.transform(logits, lambda x: F.exp((x - top) / temperature))
    return F.transform(weights, lambda w: w / total(weights))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def compensated_sum(values: Column) -> Column:
    """Neumaier's sum: what each addition loses is kept and added at the end."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def add(acc: Column, x: Column) -> Column:
        s = acc["s"] + x
        lost = F.when(F.abs(acc["s"]) >= F.abs(x), (acc["s"] - s) + x).otherwise((x - s) + acc["s"])
        return F.struct(s.alias("s"), (acc["c"] + lost).alias("c"))

    return F.aggregate(values, zero, add, lambda acc: acc["s"] + acc["c"])


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def normalized_entropy(p: Column) -> Column:
    """- sum p ln p / ln K, 0 ln 0 = 0; 0 for a support of one."""
    bits = F.transform(p, lambda x: F.when(x > 0, -x * F.ln(x)).otherwise(0.0))
    return F.when(F.size(p) > 1, clamp(total(bits) / F.ln(F.greatest(F.size(p), F.lit(2)).cast("double")), 0.0, 1.0)).otherwise(F.lit(0.0))


def argmax_first(values: Column) -> Column:
    """The position (from 0) of the largest value; of ties the first."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def expected_rank(p: Column) -> Column:
    return F.aggregate(F.transform(p, lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)


def expected_number(p: Column, support: Column) -> Column:
    """The mean of the support's numbers, scaled first so that large ones can't overflow."""
    scale = F.greatest(F.array_max(F.transform(support, lambda v: F.abs(v))), F.lit(1e-300))
    return total(F.zip_with(p, support, lambda x, v: x * (v / scale))) * scale


def log_loss(p: Column, target: Column) -> Column:
    return -F.ln(F.greatest(F.get(p, target), F.lit(1e-300)))


def spherical_loss(p: Column, target: Column) -> Column:
    """1 - p_y / |p|."""
    return 1 - F.get(p, target) / F.sqrt(total(F.transform(p, lambda x: x * x)))


def ranked_probability_score(p: Column, target: Column) -> Column:
    """Mean squared difference of the cumulative distributions over the K - 1 thresholds; 0 for K = 1."""
    at = F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1)))
    steps = F.transform(at, lambda k: F.pow(total(F.slice(p, F.lit(1), k)) - F.when(target < k, 1.0).otherwise(0.0), 2))
    return F.when(F.size(p) > 1, total(steps) / (F.size(p) - 1)).otherwise(F.lit(0.0))


def brier(p: Column, target: Column, normalized: bool = True) -> Column:
    """|p - one-hot|**2, halved where normalized."""
    squares = total(F.transform(p, lambda x: x * x))
    return (squares - 2 * F.get(p, target) + 1) / (2 if normalized else 1)


def calibration_bin(confidence: Column, bins: int = 15) -> Column:
    return F.least(F.lit(bins - 1), F.floor(confidence * bins)).cast("int")


def whole_days(later: Column, earlier: Column) -> Column:
    """Elapsed whole days, rounded down."""
    return F.floor((F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 86400).cast("long")


def ratio_count(n: Column, ratio: float) -> Column:
    """Round half up."""
    return F.floor(n * ratio + 0.5).cast("long")


def hash_percent(key: Column, below: int) -> Column:
    """Whether the first eight hex digits of a digest fall below a percentage."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % 100 < below


def digest_seed(material: Column) -> Column:
    """A 60-bit seed from a digest of labelled text."""
    return F.conv(F.substring(F.sha2(material, 256), 1, 15), 16, 10).cast("long")


def pseudonym(salt: str, value: Column, length: int = 24) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt), F.lit(":"), value.cast("string")), 256), 1, length)


def decimal_places(text: Column) -> Column:
    """Digits after the point in the shortest spelling."""
    fraction = F.regexp_extract(text, r"\.([0-9]*?)0*$", 1)
    return F.length(fraction)


def one_step(text: Column) -> Column:
    """The smallest step a threshold's spelling resolves."""
    return F.pow(F.lit(10.0), -decimal_places(text))


def decimal_grid(low: str, high: str, step: str) -> list[str]:
    """Every value of an exact decimal grid in its canonical spelling, on the driver; at most 100,000."""
    from decimal import Decimal

    a, b, s = Decimal(low), Decimal(high), Decimal(step)
    if s <= 0 or b < a or (b - a) % s or (b - a) / s >= 100_000:
        raise ValueError("a grid needs a positive step that reaches its end within 100,000 values")
    return [spelled(a + i * s) for i in range(int((b - a) / s) + 1)]


def spelled(value) -> str:
    text = format(value, "f")
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return "0" if text in ("-0", "") else text


def canonical_decimal(text: Column) -> Column:
    """Whether a text is a decimal in canonical spelling."""
    return text.rlike(r"^(?:0|-?(?:0\.[0-9]*[1-9]|[1-9][0-9]*(?:\.[0-9]*[1-9])?))$")


def token_estimate(characters: Column, per_token: float = 4.0) -> Column:
    return F.ceil(characters / per_token).cast("long")


def price(tokens_in: Column, tokens_out: Column, per_million_in: float, per_million_out: float) -> Column:
    return (tokens_in * per_million_in + tokens_out * per_million_out) / 1e6


def duration_seconds(text: Column) -> Column:
    """'90s', '15m', '12h', '7d', '2w' in seconds; null for anything else."""
    n, unit = F.regexp_extract(text, r"^([0-9]+)([smhdw])$", 1), F.regexp_extract(text, r"^([0-9]+)([smhdw])$", 2)
    size = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).when(unit == "w", 604800)
    return F.when(unit != "", n).cast("long") * size


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))


def ieee_hex(x: Column) -> Column:
    """The sixteen hex digits of a double's bits; -0 keeps its sign."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), x).cast("long")
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def same_bits(a: Column, b: Column) -> Column:
    """Identity of numbers: -0 differs from 0."""
    return ieee_hex(a) == ieee_hex(b)
