"""Fields of a document from its text, as column expressions over one row (no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docverify.functions import lookups as L
from docverify.functions.bind import let


def lines(text: Column) -> Column:
    """The trimmed, non-empty lines."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), "\r", ""), "\n")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def keyword_type(text: Column) -> Column:
    """E2 before numbers are looked at."""
    return (
        F.when(text.rlike(L.PASSPORT_WORDS), "PASSPORT")
        .when(text.rlike(L.AADHAAR_WORDS), "AADHAAR")
        .when(text.rlike(L.PAN_WORDS), "PAN")
        .otherwise("UNKNOWN")
    )


def mrz_lines(text: Column) -> Column:
    """struct(line1, line2), null without a first line; the second is the next run of 44 characters after the first's end."""

    def both(first: Column) -> Column:
        rest = F.substring(text, F.instr(text, first) + F.length(first), F.length(text))
        return F.when(
            first.isNotNull(), F.struct(first.alias("line1"), F.coalesce(_found(rest, L.MRZ_ANY), F.lit("")).alias("line2"))
        )

    return let(_found(text, L.MRZ_FIRST), both)


def id_number(text: Column) -> Column:
    """E4 and the rest of E2: struct(doc_type, id_number, is_masked)."""
    by_words = F.when(text.rlike(L.MRZ_FIRST), "PASSPORT").otherwise(keyword_type(text))

    def first(kind: Column) -> Column:
        found = {
            "passport": F.when(kind == "PASSPORT", _found(text, L.PASSPORT_NO)), "masked": _found(text, L.MASKED_NO),
            "digits": F.regexp_replace(_found(text, L.AADHAAR_NO), r"\s", ""), "pan": _found(text, L.PAN_NO),
        }
        return let(F.struct(kind.alias("kind"), *[c.alias(n) for n, c in found.items()]), shown)

    def shown(f: Column) -> Column:
        passport, masked, digits, pan = f["passport"], f["masked"], f["digits"], f["pan"]
        spaced = F.concat(F.substring(digits, 1, 4), F.lit(" "), F.substring(digits, 5, 4), F.lit(" "), F.substring(digits, 9, 4))
        kind = (
            F.when(passport.isNotNull(), f["kind"])
            .when(masked.isNotNull() | digits.isNotNull(), "AADHAAR")
            .when(pan.isNotNull(), "PAN")
            .otherwise(f["kind"])
        )
        number = F.coalesce(passport, F.concat(F.lit("XXXX XXXX "), masked), spaced, pan, F.lit(""))
        return F.struct(
            kind.alias("doc_type"), number.alias("id_number"), (passport.isNull() & masked.isNotNull()).alias("is_masked")
        )

    return let(by_words, first)


def _slashed(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, r"[\-. ]", "/"), F.lit(""))


def dob(text: Column) -> Column:
    """E5: the labelled date, else the first date."""
    return _slashed(F.coalesce(_found(text, L.BIRTH_DATE), _found(text, L.ANY_DATE)))


def expiry(text: Column) -> Column:
    """The labelled expiry date."""
    return _slashed(_found(text, L.EXPIRY_DATE))


def gender(text: Column) -> Column:
    """E7. The Devanagari words count wherever they stand, not between word breaks."""
    return (
        F.when(text.rlike(L.MALE), "MALE")
        .when(text.rlike(L.FEMALE), "FEMALE")
        .when(text.rlike(L.TRANSGENDER), "TRANSGENDER")
        .otherwise("")
    )


def plausible_name(line: Column) -> Column:
    """E8. What costs least is tested first."""

    def sized(clean: Column) -> Column:
        return F.when(F.length(clean).between(5, 35), let(F.filter(F.split(clean, " "), lambda w: F.length(w) > 1), worded)).otherwise(False)

    def worded(words: Column) -> Column:
        return (
            F.size(words).between(2, 4)
            & F.forall(words, lambda w: w.rlike("(?i)[aeiou]"))
            & ~F.arrays_overlap(F.transform(words, F.upper), F.lit(L.STOP_WORDS))
        )

    clean = F.trim(F.regexp_replace(F.regexp_replace(line, r"[^A-Za-z\s]", " "), r"\s+", " "))
    return F.coalesce(let(clean, sized), F.lit(False))


def name(text: Column) -> Column:
    """The first plausible line within two of an anchor word, else the first plausible line. A line is tested once."""

    def best(own: Column) -> Column:
        return let(F.transform(own, lambda x: F.when(plausible_name(x), x)), lambda names: nearest(own, names))

    def nearest(own: Column, names: Column) -> Column:
        around = lambda i: F.array(*[F.get(names, i + k) for k in (-2, -1, 1, 2)])
        near = F.transform(own, lambda x, i: F.when(x.rlike(L.NAME_ANCHOR), around(i)).otherwise(F.array().cast("array<string>")))
        anchored = F.when(F.exists(names, lambda n: n.isNotNull()), F.array_compact(F.concat(F.flatten(near), names)))
        return F.coalesce(F.get(anchored, 0), F.lit(""))

    return let(lines(text), best)


def confidence(base: Column, number: Column, birth: Column, name_: Column) -> Column:
    """E10."""
    b = F.coalesce(base, F.lit(0.85))
    full = (number != "") & (birth != "") & (name_ != "")
    some = (number != "") | (birth != "") | (name_ != "")
    return F.round(F.when(~some, 0.30).when(full, F.greatest(F.lit(0.85), b)).otherwise(b), 2)
