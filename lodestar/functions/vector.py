"""Vector arithmetic as Catalyst expressions.

The float versions accumulate in 32 bits from left to right, so a score does not depend
on how Spark splits the input; the double version is for callers who want precision.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)).cast("float") for x in vector])


def _zero(kind: str) -> Column:
    return F.lit(0.0).cast(kind)


def dot_product(a: Column, b: Column) -> Column:
    """Sequential 32-bit sum of products."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), _zero("float"), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot_product(v, v)).cast("float")


def score(probe: Sequence[float], vector: Column, norm: Column) -> Column:
    """32-bit cosine of a driver-side probe and a stored vector with its stored norm; 0 if either is zero."""
    denom = F.lit(float(norm_of(probe))).cast("float") * norm
    return F.coalesce((dot_product(literal(probe), vector) / F.nullif(denom, _zero("float"))).cast("float"), _zero("float"))


def norm_of(probe: Sequence[float]) -> np.float32:
    """The norm of a driver-side vector, rounded at every step as the engine does."""
    total = np.float32(0)
    with np.errstate(all="ignore"):
        for x in np.asarray(probe, np.float32):
            total = np.float32(total + x * x)
        return np.sqrt(total, dtype=np.float32)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine with 64-bit accumulators; 0 if either vector is zero. Search does not use it."""
    wide = lambda v: F.transform(v, lambda x: x.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(wide(x), wide(y), lambda p, q: p * q), _zero("double"), lambda s, p: s + p)
    denom = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce((dot(a, b) / F.nullif(denom, _zero("double"))).cast("float"), _zero("float"))
