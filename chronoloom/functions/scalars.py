"""Scalar and array expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def leaky_relu(x: Column, slope: float = 0.01) -> Column:
    return F.when(x >= 0, x).otherwise(x * slope)


def inverse_sqrt(degree: Column) -> Column:
    """degree ** -1/2, 0 where the degree is 0."""
    return F.when(degree > 0, 1 / F.sqrt(degree)).otherwise(F.lit(0.0))


def floor_to(x: Column, step: float) -> Column:
    return F.floor(x / F.lit(step)) * F.lit(step)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def replace_zeros(a: Column, fill: float) -> Column:
    return a if fill == 0 else F.transform(a, lambda x: F.when(x == 0, F.lit(fill)).otherwise(x))


def temporal_weight(edge_year: Column, year: Column) -> Column:
    """1 / (distance in years + 1)."""
    return 1 / (F.abs(edge_year - year) + 1)


def time_position(position: Column, n_years: Column | int) -> Column:
    """Position of a year among n_years, scaled to [0, 1)."""
    return position / (n_years if isinstance(n_years, Column) else F.lit(n_years))


def duration_text(seconds: Column) -> Column:
    """12.3s, 4m05s or 1h02m, by magnitude."""
    s = F.floor(seconds).cast("long")
    return F.when(seconds < 60, F.format_string("%.1fs", seconds)).when(seconds < 3600, F.format_string("%dm%02ds", F.floor(s / 60).cast("long"), s % 60)).otherwise(F.format_string("%dh%02dm", F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long")))


def layer_norm(a: Column, eps: float = 1e-5) -> Column:
    """Mean and scale are bound as fields: an expression that a lambda takes
    from outside is evaluated for each element."""
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    var = lambda v, m: F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(v)
    centre = F.transform(F.array(a), lambda v: F.struct(v.alias("v"), mean(v).alias("m")))
    scaled = F.transform(centre, lambda s: F.struct(s["v"].alias("v"), s["m"].alias("m"), F.sqrt(var(s["v"], s["m"]) + eps).alias("d")))
    return F.get(F.transform(scaled, lambda s: F.transform(s["v"], lambda x: (x - s["m"]) / s["d"])), F.lit(0))


def one_of(col: Column, values: list) -> Column:
    """Chained equality, for short lists."""
    return reduce(lambda a, b: a | b, [col == v for v in values], F.lit(False))


def bin_index(x: Column, edges: list[float], include_lowest: bool = False) -> Column:
    """Index of the right-closed bin (edges[i], edges[i+1]]; null outside. The
    first bin also takes its left edge if include_lowest."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        low = (x >= edges[i]) if include_lowest and i == 0 else (x > edges[i])
        out = F.when(low & (x <= edges[i + 1]), F.lit(i)).otherwise(out)
    return out
