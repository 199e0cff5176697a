"""Extraction of fields from text: one narrow projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docverify.functions import text as T
from docverify.functions.bind import let


def extract(df: DataFrame, text_col: str = "raw_text", base: Column | None = None) -> DataFrame:
    """Df with a struct `fields` (doc_type, id_number, is_masked, name, dob, expiry, gender, mrz, confidence, is_detected)."""

    def read(text: Column) -> Column:
        found = F.struct(T.id_number(text).alias("id"), T.name(text).alias("name"), T.dob(text).alias("dob"))
        return let(found, lambda f: fields(text, f))

    def fields(text: Column, f: Column) -> Column:
        number, name, dob = f["id"]["id_number"], f["name"], f["dob"]
        return F.struct(
            f["id"]["doc_type"].alias("doc_type"), number.alias("id_number"), f["id"]["is_masked"].alias("is_masked"),
            name.alias("name"), dob.alias("dob"), T.expiry(text).alias("expiry"), T.gender(text).alias("gender"),
            T.mrz_lines(text).alias("mrz"),
            T.confidence(F.lit(0.85) if base is None else base, number, dob, name).alias("confidence"),
            ((number != "") | (dob != "") | (name != "")).alias("is_detected"),
        )

    return df.withColumn("fields", let(F.translate(F.coalesce(F.col(text_col), F.lit("")), "\r", ""), read))
