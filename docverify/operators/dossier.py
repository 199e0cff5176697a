"""Consistency of the documents of one applicant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docverify.functions import names as N

SLOTS = ("a", "b", "c")


def slots(docs: DataFrame, applicant: str, order: str, columns: list[str]) -> DataFrame:
    """One row an applicant: n_docs and a struct of columns for the first, second and third document.

    The window and the grouping share one shuffle by applicant; what a group
    keeps is three rows, however many documents it has.
    """
    w = Window.partitionBy(applicant)
    ranked = (
        docs.withColumn("__place", F.row_number().over(w.orderBy(order)))
        .withColumn("__n", F.count(F.lit(1)).over(w))
        .where(F.col("__place") <= len(SLOTS))
    )
    row = F.struct(*columns)
    return ranked.groupBy(applicant).agg(
        F.max("__n").alias("n_docs"),
        *[F.max(F.when(F.col("__place") == i + 1, row)).alias(s) for i, s in enumerate(SLOTS)],
    )


def verdict(a: Column, b: Column, c: Column, n_docs: Column) -> Column:
    """C4: struct of an applicant's score from the slots' name, dob and hist.

    The portrait of the third document isn't compared. The flag of differing
    birth dates names the pair that differs (AB before AC).
    """
    ab, ac = N.compare_names(a["name"], b["name"])["similarity"], N.compare_names(a["name"], c["name"])["similarity"]
    mean = F.when(c.isNull(), ab).otherwise(F.floor((ab + ac) / 2 + 0.5).cast("int"))
    same_ab = N.compare_births(a["dob"], b["dob"]) == "EXACT"
    same_ac = c.isNull() | (N.compare_births(a["dob"], c["dob"]) == "EXACT")
    photo = N.compare_portraits(a["hist"], b["hist"])
    enough = n_docs >= 2
    score = F.greatest(
        F.lit(0),
        100
        - F.when(mean < 60, 35).when(mean < 85, 10).otherwise(0)
        - F.when(same_ab & same_ac, 0).otherwise(40)
        - F.when(photo["status"] == "LOW_SIMILARITY", 25).otherwise(0),
    )
    flags = F.array_compact(
        F.array(
            F.when(mean < 60, "NAME_DISCREPANCY").when(mean < 85, "NAME_PARTIAL"),
            F.when(~same_ab, "DOB_AB").when(~same_ac, "DOB_AC"),
            F.when(photo["status"] == "LOW_SIMILARITY", "PORTRAIT"),
        )
    )
    return F.struct(
        F.when(enough, score).otherwise(100).alias("score"),
        F.when(~enough, "INSUFFICIENT_DOCUMENTS").when(score < 50, "HIGH").when(score < 80, "MEDIUM").otherwise("LOW").alias("risk"),
        F.when(~enough, F.lit(None)).when(score < 50, "ESCALATE").when(score < 80, "MANUAL_REVIEW").otherwise("ACCEPT").alias("action"),
        F.when(enough, mean).alias("name_similarity"), F.when(enough, same_ab & same_ac).alias("dob_match"),
        F.when(enough, photo["similarity"]).alias("portrait_similarity"), F.when(enough, flags).alias("flags"),
    )


def address_alignment(a: Column, b: Column) -> Column:
    """struct(same_pin, shared_words) of two addresses; it takes nothing from a score."""
    pin = lambda c: F.nullif(F.regexp_extract(c, "[1-9][0-9]{5}", 0), F.lit(""))
    parts = lambda c: F.array_remove(F.array_distinct(F.split(F.upper(c), "[^A-Z]+")), "")
    return F.struct(
        F.coalesce(pin(a) == pin(b), F.lit(False)).alias("same_pin"),
        F.sort_array(F.array_intersect(parts(a), parts(b))).alias("shared_words"),
    )
