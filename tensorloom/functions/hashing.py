"""Seeded, engine-neutral hashes as Column expressions.

md5 is used because its value is the same in every SQL engine, so an ordering,
a coin flip or a noise draw can be reproduced outside Spark.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 1 << 32


def digest(*parts: Column | str | int) -> Column:
    """md5 hex of the ``:``-joined parts (plain values become literals)."""
    return F.md5(F.concat_ws(":", *[_part(p) for p in parts]))


def word(hex_digest: Column, index: int = 0) -> Column:
    """The index-th 32-bit word (0..3) of a hex digest as a non-negative long."""
    value = F.conv(F.substring(hex_digest, 8 * index + 1, 8), 16, 10).cast("long")
    return F.coalesce(value, F.lit(0).cast("long"))  # never null, so joins add no recomputing null filter


def hash32(*parts: Column | str | int) -> Column:
    """First 32 bits of :func:`digest`."""
    return word(digest(*parts))


def unit(word32: Column) -> Column:
    """Map a 32-bit word to the open interval (0, 1)."""
    return (word32.cast("double") + F.lit(0.5)) / F.lit(float(WORD))


def coin(p: float, *parts: Column | str | int) -> Column:
    """Deterministic Bernoulli(p) draw."""
    return unit(hash32(*parts)) < F.lit(float(p))


def gaussian(*parts: Column | str | int) -> Column:
    """Deterministic standard normal draw (Box-Muller on two words of one digest)."""
    d = digest(*parts)
    radius = F.sqrt(F.lit(-2.0) * F.ln(unit(word(d, 0))))
    return radius * F.cos(F.lit(2.0 * math.pi) * unit(word(d, 1)))


def _part(p: Column | str | int) -> Column:
    return p.cast("string") if isinstance(p, Column) else F.lit(str(p))
