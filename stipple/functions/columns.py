"""Small column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column, nan: float, posinf: float, neginf: float) -> Column:
    """Replace NaN and infinities; null passes through."""
    return (
        F.when(F.isnan(x), F.lit(float(nan)))
        .when(x == F.lit(math.inf), F.lit(float(posinf)))
        .when(x == F.lit(-math.inf), F.lit(float(neginf)))
        .otherwise(x)
    )


def standard(x: Column) -> Column:
    """Metadata text: string, trimmed, upper case."""
    return F.upper(F.trim(x.cast("string")))


def title_case(x: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the rest.

    Differs from ``initcap``, which only starts words after white space, so
    ``rad51ap1`` becomes ``Rad51Ap1`` here.
    """
    marks = F.regexp_replace(F.lower(x), r"(?<![\p{L}])(\p{L})", "\u0001$1")
    parts = F.split(marks, "\u0001")
    rest = F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p))),
    )
    return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))


def direction(x: Column, eps: float = 0.005) -> Column:
    return F.when(x > eps, "up").when(x < -eps, "down").otherwise("none")


def shift_call(padj: Column, effect: Column, alpha: float = 0.05) -> Column:
    sig = padj < alpha
    return (
        F.when(sig & (effect > 0), "enriched")
        .when(sig & (effect < 0), "depleted")
        .otherwise("not significant")
    )


def vec_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two array columns."""
    sq = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda s, x: s + x))


def uniform(seed: int, *cols: Column | str) -> Column:
    """Number in [0, 1) from a hash: same rows, same draw, however partitioned."""
    h = F.xxhash64(F.lit(seed), *cols)
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))
