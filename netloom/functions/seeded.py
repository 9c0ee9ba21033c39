"""Seeded uniforms that depend only on (seed, tag, row id), never on partitioning."""

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = 13
_RANGE = float(16**_DIGITS)
# A prime: sums of two multiples modulo it are pairwise independent, and products fit a BIGINT.
PRIME = 2**31 - 1


def _number(key: Column) -> Column:
    digits = F.substring(F.md5(key), 1, _DIGITS)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(_RANGE)


def uniform(seed, tag: str, row_id) -> Column:
    """Uniform double in [0, 1): leading 52 bits of ``md5('seed:tag:id')``."""
    row_id = F.col(row_id) if isinstance(row_id, str) else row_id
    return _number(F.concat(F.lit(f"{seed}:{tag}:"), row_id.cast("string")))


def row_state(seed, row_id) -> list:
    """Two numbers below PRIME, from the leading and the following 60 bits of ``md5('seed:id')``."""
    row_id = F.col(row_id) if isinstance(row_id, str) else row_id
    digest = F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")))
    part = lambda start: F.conv(F.substring(digest, start, 15), 16, 10).cast("bigint") % F.lit(PRIME)
    return [part(1), part(16)]


def _factors(tag: str) -> tuple:
    digest = hashlib.md5(tag.encode()).hexdigest()
    return tuple(1 + int(digest[i : i + 15], 16) % (PRIME - 1) for i in (0, 15))


def uniforms(tags: list, x, y) -> Column:
    """Array of one uniform in [0, 1) per tag, from the two numbers of a row: one digest for all.

    The numbers are items of an array: as plain columns they would be put into the function over
    the tags, and their digests taken once per tag.
    """
    factors = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in map(_factors, tags)])
    prime = F.lit(PRIME).cast("bigint")
    draws = lambda s: F.transform(
        factors, lambda f: ((s["x"] * f["a"]) % prime + (s["y"] * f["b"]) % prime) % prime / F.lit(float(PRIME))
    )
    return F.get(F.transform(F.array(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))), draws), F.lit(0))


def exponential(u: Column, mean: float) -> Column:
    """Exponential draw with the given mean."""
    return F.lit(-float(mean)) * F.log1p(-u)


def gaussian(u: Column, v: Column) -> Column:
    """Standard normal draw from two uniforms (Box-Muller)."""
    return F.sqrt(F.lit(-2.0) * F.log1p(-u)) * F.cos(F.lit(6.283185307179586) * v)


def integer(u: Column, low: int, high: int) -> Column:
    """Uniform integer in ``low .. high - 1``."""
    return F.lit(low).cast("bigint") + F.floor(u * F.lit(float(high - low))).cast("bigint")


def choice(u: Column, values: list) -> Column:
    """One of ``values``, each equally likely."""
    options = F.array(*[F.lit(v) for v in values])
    return F.get(options, integer(u, 0, len(values)).cast("int"))
