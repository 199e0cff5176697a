"""Machine readable zones of passports (ICAO 9303, TD3) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docverify.functions.bind import let, numbers
from docverify.functions.checks import empty


#: Values by ASCII code: digits as they are, A 10 to Z 35 in either case, all else 0.
_VALUES = [c - 48 if 48 <= c <= 57 else (c | 32) - 87 if 97 <= c | 32 <= 122 and c >= 65 else 0 for c in range(128)]


def check_digit(text: Column) -> Column:
    """V6: the 7-3-1 check digit as a string; other characters than digits and letters count as 0; null gives null."""
    weights, values = numbers([7, 3, 1]), numbers(_VALUES)

    def total(t: Column) -> Column:
        def step(sum_: Column, i: Column) -> Column:
            value = F.get(values, F.ascii(F.substring(t, i + 1, F.lit(1))))
            return sum_ + F.coalesce(value, F.lit(0)) * F.get(weights, i % 3)

        places = F.when(F.length(t) > 0, F.sequence(F.lit(0), F.length(t) - 1)).when(F.length(t) == 0, F.array().cast("array<int>"))
        return (F.aggregate(places, F.lit(0), step) % 10).cast("string")

    return let(text, total)


def checked(field: Column, digit: Column) -> Column:
    return let(
        check_digit(field), lambda e: F.struct((e == digit).alias("valid"), e.alias("expected"), digit.alias("actual"))
    )


def short_date(text: Column, as_of: Column, expiry: bool = False) -> Column:
    """V8: YYMMDD as DD/MM/YYYY, the century by as_of; null unless six digits."""
    return let(text, lambda t: _short_date(t, as_of, expiry))


def _short_date(text: Column, as_of: Column, expiry: bool) -> Column:
    yy = F.substring(text, 1, 2).try_cast("int")
    century, now = F.floor(F.year(as_of) / 100) * 100, F.year(as_of) % 100
    if expiry:
        year = F.when(yy >= now - 10, century + yy).otherwise(century + 100 + yy)
    else:
        year = F.when(yy <= now, century + yy).otherwise(century - 100 + yy)
    shown = F.concat_ws("/", F.substring(text, 5, 2), F.substring(text, 3, 2), year.cast("string"))
    return F.when(text.rlike("^[0-9]{6}$"), shown)


def expired(date: Column, as_of: Column) -> Column:
    """V9: whether DD/MM/YYYY is on or before as_of; months and days past their ends roll over, null is not expired."""
    part = lambda i: F.get(F.split(date, "/"), i).try_cast("int")
    end = F.date_add(F.add_months(F.make_date(part(2), F.lit(1), F.lit(1)), part(1) - 1), part(0) - 1)
    return F.coalesce(end <= as_of, F.lit(False))


def _line(c: Column) -> Column:
    return F.rpad(F.upper(F.regexp_replace(c, r"\s", "")), 44, "<")


def parse(line1: Column, line2: Column, as_of: Column) -> Column:
    """V7: the zone's fields and check digits; null fields and valid false where a line is missing."""
    there = ~(empty(line1) | empty(line2))
    plain = lambda c: F.regexp_replace(c, "<", "")
    spaced = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "<", " "))

    def first(l: Column) -> Column:
        a, b = l["a"], l["b"]
        at = lambda i, n=1: F.substring(b, i, n)
        names = F.split(F.substring(a, 6, 39), "<<")
        sex = F.when(at(21) == "M", "MALE").when(at(21) == "F", "FEMALE").otherwise("UNSPECIFIED")
        parts = {
            "doc_type": plain(F.substring(a, 1, 2)), "country": plain(F.substring(a, 3, 3)), "surname": spaced(F.get(names, 0)),
            "given_names": spaced(F.get(names, 1)), "passport_number": plain(at(1, 9)), "nationality": plain(at(11, 3)),
            "dob": short_date(at(14, 6), as_of), "sex": sex, "expiry_date": short_date(at(22, 6), as_of, expiry=True),
            "cd_number": checked(at(1, 9), at(10)), "cd_birth": checked(at(14, 6), at(20)), "cd_expiry": checked(at(22, 6), at(28)),
            "cd_composite": checked(F.concat(at(1, 10), at(14, 7), at(22, 22)), at(44)),
        }
        return let(F.struct(*[c.alias(n) for n, c in parts.items()]), lambda p: whole(p, list(parts)))

    def whole(p: Column, names: list[str]) -> Column:
        valid = p["cd_number"]["valid"] & p["cd_birth"]["valid"] & p["cd_expiry"]["valid"] & p["cd_composite"]["valid"]
        more = {"is_expired": expired(p["expiry_date"], as_of), "full_name": F.trim(F.concat_ws(" ", p["given_names"], p["surname"]))}
        return F.struct(
            F.when(there, valid).otherwise(False).alias("valid"),
            *[F.when(there, c).alias(n) for n, c in more.items()], *[F.when(there, p[n]).alias(n) for n in names],
        )

    return let(F.struct(_line(line1).alias("a"), _line(line2).alias("b")), first)


def words(name: Column, longer_than: int) -> Column:
    return F.filter(F.split(F.trim(F.upper(name)), r"\s+"), lambda w: F.length(w) > longer_than)


def compare_visible(number: Column, dob: Column, name: Column, zone: Column) -> Column:
    """struct(status, discrepancies, deduction) of printed fields against a parsed zone."""
    clean = lambda c: F.upper(F.regexp_replace(c, r"\s", ""))
    found = F.array_compact(
        F.array(
            F.when(~empty(number) & (clean(number) != clean(zone["passport_number"])), "PASSPORT_NUMBER"),
            F.when(~empty(dob) & ~empty(zone["dob"]) & (F.trim(dob) != zone["dob"]), "DOB"),
            F.when(
                ~empty(name) & ~empty(zone["full_name"]) & ~F.arrays_overlap(words(name, 1), words(zone["full_name"], 1)), "NAME"
            ),
            F.when(zone["is_expired"], "EXPIRED"),
        )
    )
    usable = F.coalesce(zone["valid"], F.lit(False))
    return let(
        found,
        lambda f: F.struct(
            F.when(~usable, "UNAVAILABLE").when(F.size(f) > 0, "MISMATCH").otherwise("MATCH").alias("status"),
            F.when(~usable, F.array(F.lit("MRZ"))).otherwise(f).alias("discrepancies"),
            F.when(~usable, 25).otherwise(F.least(F.lit(35), 20 * F.size(f))).alias("deduction"),
        ),
    )
