"""Joins with QR payloads and the trusted registry, and the comparisons after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docverify.functions.bind import let
from docverify.functions.checks import empty
from docverify.functions.mrz import words


#: Numbers of which only the last digits are shown.
MASKED = "[xX*]{4}"


def qr_key(number: Column) -> Column:
    return F.regexp_replace(F.coalesce(number, F.lit("")), "[^0-9]", "")


def registry_key(number: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(number, F.lit("")), r"[\s-]", ""))


_SCALARS = ("bigint", "int", "string", "double", "date", "boolean")


def _usable(key: Column, number: Column) -> Column:
    """The key of a number that names somebody: null for blank and masked ones."""
    return F.when(~F.coalesce(number, F.lit("")).rlike(MASKED), F.nullif(key, F.lit("")))


def _keyed(df: DataFrame, key: Column, number: Column) -> DataFrame:
    """df with clean_id. Blank and masked numbers get a key of their row's own, which no record has, so that they don't meet in one task."""
    own = F.concat(F.lit("\x00"), F.xxhash64(*[c for c, kind in df.dtypes if kind in _SCALARS]).cast("string"))
    return df.withColumn("clean_id", F.coalesce(_usable(key, number), own))


def _keyed_join(df: DataFrame, table: DataFrame, key: Column, number: Column) -> DataFrame:
    joined = _keyed(df, key, number).join(table, "clean_id", "left")
    return joined.select(*df.columns, *[c for c in table.columns if c != "clean_id"])


def attach_qr(df: DataFrame, payloads: DataFrame, number: str = "id_number") -> DataFrame:
    """Df with payload (null where none is known)."""
    return _keyed_join(df, payloads.select("clean_id", "payload"), qr_key(F.col(number)), F.col(number))


def parse_payload(payload: Column) -> Column:
    """struct(uid, name, dob, gender) of an XML payload's attributes, or of a JSON one's fields; null fields where it is neither."""
    names = ("uid", "name", "dob", "gender")
    is_json = F.startswith(F.ltrim(payload), F.lit("{"))
    as_json = F.from_json(payload, ", ".join(f"{n} string" for n in names))
    as_xml = F.from_xml(payload, ", ".join(f"_{n} string" for n in names), {"ignoreNamespace": "true"})
    of_xml = let(as_xml, lambda x: F.struct(*[F.nullif(x[f"_{n}"], F.lit("")).alias(n) for n in names]))
    return F.when(payload.isNotNull(), F.when(is_json, as_json).otherwise(of_xml))


def _share_word(a: Column, b: Column) -> Column:
    return F.arrays_overlap(words(F.coalesce(a, F.lit("")), 2), words(F.coalesce(b, F.lit("")), 2))


def compare_qr(doc_type: Column, number: Column, name: Column, dob: Column, qr: Column) -> Column:
    """struct(status, discrepancies, deduction); documents other than AADHAAR match by default."""
    last = lambda c: F.substring(F.regexp_replace(c, "[^0-9]", ""), -4, 4)
    found = F.array_compact(
        F.array(
            F.when(~empty(dob) & ~empty(qr["dob"]) & (F.trim(dob) != F.trim(qr["dob"])), "DOB"),
            F.when(~empty(name) & ~empty(qr["name"]) & ~_share_word(name, qr["name"]), "NAME"),
            F.when((last(number) != "") & (last(qr["uid"]) != "") & (last(number) != last(qr["uid"])), "NUMBER"),
        )
    )

    def judged(f: Column) -> Column:
        differs = (doc_type == "AADHAAR") & qr.isNotNull() & (F.size(f) > 0)
        status = F.when(doc_type != "AADHAAR", "MATCH").when(qr.isNull(), "UNAVAILABLE").when(differs, "MISMATCH").otherwise("MATCH")
        return F.struct(
            status.alias("status"), F.when(differs, f).otherwise(F.array().cast("array<string>")).alias("discrepancies"),
            F.when(differs, 30).otherwise(0).alias("deduction"),
        )

    return let(found, judged)


def attach_registry(df: DataFrame, records: DataFrame, number: str = "id_number") -> DataFrame:
    """Df with reg_name, reg_dob and lookup (AUTHENTICATED or NOT_FOUND_IN_SANDBOX)."""
    joined = _keyed_join(df, records.select("clean_id", "reg_name", "reg_dob", F.lit(True).alias("__there")), registry_key(F.col(number)), F.col(number))
    return joined.withColumn("lookup", F.when(F.col("__there"), "AUTHENTICATED").otherwise("NOT_FOUND_IN_SANDBOX")).drop("__there")


def not_found(df: DataFrame, records: DataFrame, number: str = "id_number") -> DataFrame:
    """J4's report: rows of df without a record, with reason: BLANK, MASKED, or NOT_FOUND where a number was looked up in vain."""
    missing = _keyed(df, registry_key(F.col(number)), F.col(number)).join(records.select("clean_id"), "clean_id", "left_anti")
    masked = F.coalesce(F.col(number), F.lit("")).rlike(MASKED)
    reason = F.when(masked, "MASKED").when(registry_key(F.col(number)) == "", "BLANK").otherwise("NOT_FOUND")
    return missing.select(*df.columns, reason.alias("reason"))


def compare_registry(name: Column, dob: Column, lookup: Column, reg_name: Column, reg_dob: Column) -> Column:
    """struct(status, name_match, dob_match); the dates match where either is empty."""
    same_name = _share_word(name, reg_name)
    same_dob = empty(F.trim(dob)) | empty(F.trim(reg_dob)) | (F.trim(dob) == F.trim(reg_dob))
    there = lookup == "AUTHENTICATED"
    return F.struct(
        F.when(~there, "UNAVAILABLE").when(same_name & same_dob, "MATCH").otherwise("MISMATCH").alias("status"),
        F.when(there, same_name).alias("name_match"), F.when(there, same_dob).alias("dob_match"),
    )
