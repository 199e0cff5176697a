"""All record rules of a document in one projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docverify.functions import checks, mrz
from docverify.functions.bind import let
from docverify.functions.checks import empty


def surname_of(name: Column) -> Column:
    words = F.split(F.trim(name), r"\s+")
    return F.when(F.size(words) > 1, F.element_at(words, -1))


def rules(doc_type: Column, number: Column, name: Column, dob: Column, line1: Column, line2: Column, as_of: Column) -> Column:
    """struct(status, checked, passed, failed, aadhaar, pan, passport, mrz, visible, birth).

    A rule applies by the document's type or by the shape of its number; where
    it doesn't its struct is null. A difference between printed fields and the
    zone fails the document but doesn't count as a failed rule.
    """
    kind, trimmed = F.upper(F.coalesce(doc_type, F.lit(""))), F.trim(number)
    as_passport = kind.contains("PASSPORT") | F.coalesce(trimmed.rlike("^[A-Z][0-9]{7,8}$"), F.lit(False))
    with_zone = as_passport & ~empty(line1) & ~empty(line2)
    as_aadhaar = kind.contains("AADHAAR") | F.coalesce(
        (F.length(F.regexp_replace(number, "[^0-9]", "")) == 12) | number.rlike("^[xX*]"), F.lit(False)
    )
    as_pan = kind.contains("PAN") | F.coalesce(trimmed.rlike("(?i)^[A-Z]{5}[0-9]{4}[A-Z]$"), F.lit(False))
    with_dob = ~empty(dob)
    parts = {
        "aadhaar": F.when(as_aadhaar, checks.aadhaar(number)), "pan": F.when(as_pan, checks.pan(number, surname_of(name))),
        "passport": F.when(as_passport, checks.passport_number(number)), "mrz": F.when(with_zone, mrz.parse(line1, line2, as_of)),
        "birth": F.when(with_dob, checks.birth_date(dob, as_of)),
    }

    def compared(p: Column) -> Column:
        visible = F.when(p["mrz"].isNotNull(), mrz.compare_visible(number, dob, name, p["mrz"]))
        return let(visible, lambda v: composite(p, v))

    def composite(p: Column, visible: Column) -> Column:
        asked = sum((p[n].isNotNull().cast("int") for n in parts), F.lit(0))
        passed = sum((F.coalesce(p[n]["valid"], F.lit(False)).cast("int") for n in parts), F.lit(0))
        differs = F.coalesce(visible["status"] != "MATCH", F.lit(False))
        return F.struct(
            F.when(asked == 0, "UNKNOWN").when((passed < asked) | differs, "FAIL").otherwise("PASS").alias("status"),
            asked.alias("checked"), passed.alias("passed"), (asked - passed).alias("failed"),
            *[p[n].alias(n) for n in parts], visible.alias("visible"),
        )

    return let(F.struct(*[c.alias(n) for n, c in parts.items()]), compared)
