"""Similarity of names, birth dates and portrait histograms, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docverify.functions.checks import empty


def compare_names(a: Column, b: Column) -> Column:
    """struct(similarity, kind); not symmetric. A word of a counts 1 if b has it, 0.7 if one is the other's initial."""
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.upper(c), r"[^A-Z\s]", " "), r"\s+", " "))
    left, right = (F.filter(F.split(clean(c), " "), lambda w: w != "") for c in (a, b))

    def initial(w: Column) -> Column:
        return F.exists(
            right,
            lambda v: ((F.length(w) == 1) & F.startswith(v, w)) | ((F.length(v) == 1) & F.startswith(w, v)),
        )

    points = F.aggregate(
        left, F.lit(0), lambda n, w: n + F.when(F.array_contains(right, w), 10).when(initial(w), 7).otherwise(0)
    )
    longest = F.greatest(F.size(left), F.size(right), F.lit(1))
    score = F.floor(points * 10 / longest + 0.5).cast("int")
    missing = empty(a) | empty(b)
    exact = clean(a) == clean(b)
    return F.struct(
        F.when(missing, 0).when(exact, 100).otherwise(F.least(F.lit(100), score)).alias("similarity"),
        F.when(missing, "MISSING").when(exact, "EXACT").when(score >= 90, "HIGH").when(score >= 60, "PARTIAL")
        .otherwise("MISMATCH").alias("kind"),
    )


def compare_births(a: Column, b: Column) -> Column:
    """EXACT, TRANSPOSITION (day and month), MISMATCH or MISSING; dates are compared as strings."""
    x, y = F.trim(a), F.trim(b)
    p, q = F.split(x, r"[/\-.]"), F.split(y, r"[/\-.]")
    swapped = (
        (F.size(p) == 3) & (F.size(q) == 3) & (F.get(p, 2) == F.get(q, 2))
        & (F.get(p, 0) == F.get(q, 1)) & (F.get(p, 1) == F.get(q, 0))
    )
    return (
        F.when(empty(a) | empty(b), "MISSING").when(x == y, "EXACT").when(swapped, "TRANSPOSITION").otherwise("MISMATCH")
    )


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda u, v: u.cast("double") * v), F.lit(0.0), lambda s, v: s + v
    )
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def compare_portraits(a: Column, b: Column) -> Column:
    """struct(similarity, status) of two histograms; 75 and UNAVAILABLE where one is missing."""
    pct = F.floor(F.coalesce(cosine(a, b), F.lit(0.5)) * 100 + 0.5).cast("int")
    missing = a.isNull() | b.isNull()
    return F.struct(
        F.when(missing, 75).otherwise(pct).alias("similarity"),
        F.when(missing, "UNAVAILABLE").when(pct >= 80, "HIGH_SIMILARITY").when(pct >= 55, "MODERATE_SIMILARITY")
        .otherwise("LOW_SIMILARITY").alias("status"),
    )
