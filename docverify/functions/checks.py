"""Checks of identity numbers and dates, as column expressions.

Each returns a struct with `valid` and a `reason` code. "Now" is always a date
given as as_of. Nulls and empty strings are missing values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docverify.functions import lookups as L
from docverify.functions.bind import let, numbers


def _fold(digits: Column, count: int, shift: int) -> Column:
    """Verhoeff's running product over the digits from the last to the first."""
    d, p = numbers(L.VERHOEFF_D), numbers(L.VERHOEFF_P)

    def over(back: Column) -> Column:
        def step(c: Column, i: Column) -> Column:
            digit = F.ascii(F.substring(back, i + 1, F.lit(1))) - 48
            return F.get(d, c * 10 + F.get(p, F.pmod(i + shift, F.lit(8)) * 10 + digit))

        return F.aggregate(F.sequence(F.lit(0), F.lit(count - 1)), F.lit(0), step)

    return let(F.reverse(digits), over)


def empty(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def aadhaar(number: Column) -> Column:
    """V1: struct(valid, clean_number, is_masked, reason) of a 12-digit or masked number."""

    def judged(clean: Column) -> Column:
        digits = clean.rlike("^[0-9]{12}$")
        reason = (
            F.when(empty(number), "MISSING")
            .when(F.trim(number).rlike(r"^[xX*]{4}\s?[xX*]{4}\s?[0-9]{4}$"), "MASKED")
            .when(~digits, F.when(F.length(clean) != 12, "LENGTH").otherwise("NOT_DIGITS"))
            .when(F.substring(clean, 1, 1).isin("0", "1"), "FIRST_DIGIT")
            .when(_fold(clean, 12, 0) == 0, "OK")
            .otherwise("CHECKSUM")
        )
        return let(reason, lambda r: shown(clean, r))

    def shown(clean: Column, reason: Column) -> Column:
        spaced = F.concat_ws(" ", F.substring(clean, 1, 4), F.substring(clean, 5, 4), F.substring(clean, 9, 4))
        text = (
            F.when(reason == "MISSING", "")
            .when(reason == "MASKED", F.upper(F.trim(number)))
            .when(reason.isin("OK", "CHECKSUM"), spaced)
            .otherwise(clean)
        )
        return F.struct(
            reason.isin("MASKED", "OK").alias("valid"), text.alias("clean_number"), (reason == "MASKED").alias("is_masked"),
            reason.alias("reason"),
        )

    return let(F.regexp_replace(number, r"[\s-]", ""), judged)


def verhoeff_digit(prefix: Column) -> Column:
    """V2: the check digit of 11 digits (other than digits and of another length: null)."""
    inverse = numbers(L.VERHOEFF_INV)
    return let(
        F.regexp_replace(prefix, "[^0-9]", ""),
        lambda digits: F.when(F.length(digits) == 11, F.get(inverse, _fold(digits, 11, 1)).cast("string")),
    )


def pan(number: Column, surname: Column) -> Column:
    """V3: struct(valid, clean_pan, entity, surname_matches, reason); the surname is reported and never fails."""

    def judged(clean: Column) -> Column:
        entity = F.substring(clean, 4, 1)
        reason = (
            F.when(empty(number), "MISSING")
            .when(~clean.rlike("^[A-Z]{5}[0-9]{4}[A-Z]$"), "SHAPE")
            .when(~F.lit(L.PAN_ENTITIES).contains(entity), "ENTITY")
            .otherwise("OK")
        )
        differs = (entity == "P") & (F.substring(F.upper(F.trim(surname)), 1, 1) != F.substring(clean, 5, 1))
        matches = empty(F.trim(surname)) | ~differs
        return let(
            reason,
            lambda r: F.struct(
                (r == "OK").alias("valid"), F.coalesce(clean, F.lit("")).alias("clean_pan"), F.when(r == "OK", entity).alias("entity"),
                F.when(r == "OK", matches).alias("surname_matches"), r.alias("reason"),
            ),
        )

    return let(F.regexp_replace(F.upper(F.trim(number)), r"\s", ""), judged)


def passport_number(number: Column) -> Column:
    """V4: struct(valid, clean_number, reason)."""
    clean = F.regexp_replace(F.upper(F.trim(number)), r"\s", "")
    reason = F.when(empty(number), "MISSING").when(clean.rlike("^[A-Z][0-9]{7,8}$"), "OK").otherwise("SHAPE")
    return F.struct((reason == "OK").alias("valid"), F.coalesce(clean, F.lit("")).alias("clean_number"), reason.alias("reason"))


_DMY = r"^([0-3]?[0-9])[/\-.]([0-1]?[0-9])[/\-.]([0-9]{4})$"
_YMD = r"^([0-9]{4})[/\-.]([0-1]?[0-9])[/\-.]([0-3]?[0-9])$"


def birth_date(text: Column, as_of: Column) -> Column:
    """V5: struct(valid, clean_dob, age, is_adult, reason) of D/M/Y or Y/M/D.

    Years before 100 are taken as written, so they fail as older than 120.
    """
    raw = F.trim(text)
    pieces = F.split(raw, r"[/\-.]")

    def read(p: Column) -> Column:
        day, month, year = (F.get(p, i).try_cast("int") for i in range(3))
        return F.struct(day.alias("day"), month.alias("month"), year.alias("year"))

    def judged(d: Column) -> Column:
        day, month, year = d["day"], d["month"], d["year"]
        leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
        days = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
        had = (F.month(as_of) * 100 + F.dayofmonth(as_of)) >= (month * 100 + day)
        age = F.year(as_of) - year - F.when(had, 0).otherwise(1)
        today = F.year(as_of) * 10000 + F.month(as_of) * 100 + F.dayofmonth(as_of)
        reason = (
            F.when(empty(text), "MISSING")
            .when(year.isNull(), "FORMAT")
            .when(~month.between(1, 12), "MONTH")
            .when(~day.between(1, days), "DAY")
            .when(year * 10000 + month * 100 + day > today, "FUTURE")
            .when(age > 120, "AGE")
            .otherwise("OK")
        )
        two = lambda c: F.lpad(c.cast("string"), 2, "0")
        written = F.concat_ws("/", two(day), two(month), year.cast("string"))
        return let(
            reason,
            lambda r: F.struct(
                (r == "OK").alias("valid"), F.when(r == "OK", written).otherwise(F.coalesce(raw, F.lit(""))).alias("clean_dob"),
                F.when(r.isin("OK", "AGE"), age).alias("age"), F.when(r == "OK", age >= 18).alias("is_adult"), r.alias("reason"),
            ),
        )

    ordered = F.when(raw.rlike(_DMY), pieces).when(raw.rlike(_YMD), F.reverse(pieces))
    return let(let(ordered, read), judged)


def mask(number: Column) -> Column:
    """an identifier with all but a few characters hidden; other lengths than 8, 10 and 12 stay as they are."""
    clean = F.regexp_replace(number, r"[\s-]", "")
    n = F.length(clean)
    return (
        F.when(empty(number), "----")
        .when(n == 12, F.concat(F.lit("XXXX XXXX "), F.substring(clean, 9, 4)))
        .when(n == 10, F.concat(F.substring(clean, 1, 4), F.lit("XXXX"), F.substring(clean, 10, 1)))
        .when(n == 8, F.concat(F.substring(clean, 1, 2), F.lit("XXXX"), F.substring(clean, 7, 2)))
        .otherwise(number)
    )
