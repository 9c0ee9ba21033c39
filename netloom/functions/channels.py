"""Bit-flip and phase-flip channels on real 2x2 states, in closed form.

A state is a population ``q`` and a coherence ``c``: [[q, c], [c, 1 - q]].
"""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

CHANNELS = ("bit", "phase")
DEFAULT_GRID = [i / 10 for i in range(11)]
EPS = 1e-15


def check_grid(p_values) -> list:
    if not p_values or not all(0 <= p <= 1 for p in p_values):
        raise ValueError("every p must lie in [0, 1]")
    return [float(p) for p in p_values]


def pure_coherence(q: Column) -> Column:
    """Coherence of a pure state with population ``q``."""
    return F.sqrt(q * (F.lit(1.0) - q))


def spread(q: Column, c: Column, p: Column, channel: str) -> Column:
    """Difference of the two eigenvalues after the channel."""
    population = (2 * q - 1) * (2 * q - 1)
    coherence = 4 * c * c
    keep = (1 - 2 * p) * (1 - 2 * p)
    if channel == "bit":
        return F.sqrt(keep * population + coherence)
    if channel == "phase":
        return F.sqrt(population + keep * coherence)
    raise ValueError(f"unknown channel {channel!r}")


def noisy_population(q: Column, p: Column, channel: str) -> Column:
    return q + p * (1 - 2 * q) if channel == "bit" else q


def noisy_coherence(c: Column, p: Column, channel: str) -> Column:
    return c if channel == "bit" else c * (1 - 2 * p)


def _logarithm(x: Column, base: float) -> Column:
    if abs(base - 2) < 1e-8:
        return F.log2(x)
    if abs(base - math.e) < 1e-8:
        return F.ln(x)
    return F.ln(x) / F.lit(math.log(base))


def von_neumann(low: Column, high: Column, base: float = 2, eps: float = EPS) -> Column:
    """Entropy of two eigenvalues; an eigenvalue of at most ``eps`` adds nothing."""
    part = lambda v: F.when(v > eps, -v * _logarithm(v, base)).otherwise(0.0)
    return part(low) + part(high)


def spread_entropy(g: Column, base: float = 2, eps: float = EPS) -> Column:
    """Entropy of a trace-1 state whose eigenvalues differ by ``g``."""
    return von_neumann((1 - g) / 2, (1 + g) / 2, base, eps)


def matrix_entropy(r00, r01, r11, base: float = 2, normalize: bool = False,
                   eps: float = EPS) -> Column:
    """Entropy of the symmetric matrix [[r00, r01], [r01, r11]].

    ``normalize`` divides the matrix by its trace first (a zero trace gives 0).
    """
    trace = r00 + r11
    if normalize:
        safe = F.when(F.abs(trace) <= 1e-8, F.lit(None)).otherwise(trace)
        r00, r01, r11 = r00 / safe, r01 / safe, r11 / safe
        trace = r00 + r11
    gap = F.sqrt((r00 - r11) * (r00 - r11) + 4 * r01 * r01)
    low, high = (trace - gap) / 2, (trace + gap) / 2
    if normalize:
        clip = lambda v: F.when(v <= eps, F.lit(0.0)).otherwise(v)
        total = clip(low) + clip(high)
        return F.coalesce(von_neumann(clip(low) / total, clip(high) / total, base, eps), F.lit(0.0))
    return von_neumann(low, high, base, eps)


def purity(g: Column) -> Column:
    return (1 + g * g) / 2


def fidelity_squared(q, c, q2, c2) -> Column:
    """Squared Uhlmann fidelity of two real 2x2 states."""
    overlap = q * q2 + (1 - q) * (1 - q2) + 2 * c * c2
    det = lambda a, b: F.greatest(a * (1 - a) - b * b, F.lit(0.0))
    squared = overlap + 2 * F.sqrt(det(q, c) * det(q2, c2))
    return F.least(F.greatest(squared, F.lit(0.0)), F.lit(1.0))
