"""Fusion of all evidence into a score, a verdict and its reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docverify.functions import lookups as L
from docverify.functions.bind import let

_CAP = L.LAYER_CAPS


def fuse(df: DataFrame) -> DataFrame:
    """Df with penalties, coverage, signals, trust_score, risk, action and reasons.

    Reads rules (struct of V11), has_local, uniform, tile_std, noise, edge,
    quality_pass, layout_pass, layout_score, qr_status, ocr_confidence,
    ref_status and feedback (map of code to verdict, or null). Missing evidence
    takes nothing from the score, but that a missing confidence counts 0.80.
    """
    said = lambda code: F.coalesce(F.try_element_at("feedback", F.lit(code)), F.lit(""))
    on = lambda c: F.coalesce(c, F.lit(False))
    alive = lambda code, c: on(c) & (said(code) != "REJECTED") if code in L.OVERRIDABLE else on(c)
    bad = lambda part: F.col("rules")[part].isNotNull() & ~F.col("rules")[part]["valid"]
    conf = F.coalesce(F.nanvl(F.col("ocr_confidence"), F.lit(None)), F.lit(0.80))
    raised: dict[str, tuple[str, Column, Column, bool]] = {
        "RULE_AADHAAR_CHECKSUM_FAIL": ("rules", bad("aadhaar") & ~F.col("rules.aadhaar.is_masked"), F.lit(30.0), True),
        "RULE_PAN_FORMAT_INVALID": ("rules", bad("pan"), F.lit(25.0), True),
        "RULE_PASSPORT_INVALID_FORMAT": ("rules", bad("passport"), F.lit(25.0), True),
        "RULE_PASSPORT_MRZ_CHECKSUM_FAIL": ("rules", bad("mrz"), F.lit(30.0), True),
        "RULE_PASSPORT_VISIBLE_MISMATCH": ("rules", F.col("rules.visible.status") != "MATCH", F.lit(30.0), True),
        "RULE_DOB_INVALID": ("rules", bad("birth"), F.lit(15.0), False),
        "FORENSICS_LOCAL_ELA_SPIKE": ("forensics", F.col("has_local"), F.least(F.lit(20.0), F.col("tile_std") * 4 + 10), True),
        "FORENSICS_UNIFORM_COMPRESSION": ("forensics", ~on(F.col("has_local")) & F.col("uniform"), F.lit(3.0), False),
        "FORENSICS_NOISE_DISCONTINUITY": ("forensics", F.col("noise"), F.lit(10.0), True),
        "FORENSICS_EDGE_SPLICING": ("forensics", F.col("edge") > 0.4, F.lit(10.0), True),
        "TEMPLATE_LAYOUT_ANOMALY": ("template", ~F.col("layout_pass"), 15 * (1 - F.col("layout_score") / 100), False),
        "QR_OCR_DOB_MISMATCH": ("cross_check", F.col("qr_status") == "MISMATCH", F.lit(15.0), True),
        "OCR_LOW_CONFIDENCE": ("ocr", conf < 0.60, 10 * (1 - conf), False),
        "REF_DATA_MISMATCH": ("reference", F.col("ref_status") == "MISMATCH", F.lit(5.0), True),
    }
    answered = on(F.col("ref_status").isin("MATCH", "MISMATCH"))
    coverage = {k: F.when(answered, v).otherwise(0) if k == "reference" else F.lit(v) for k, v in _CAP.items()}
    texts = F.create_map(*[F.lit(x) for kv in L.REASONS.items() for x in kv])
    overridden = lambda c: F.coalesce(F.try_element_at("feedback", c), F.lit("")) != ""

    def weighed(lit: Column) -> Column:
        penalty = {
            layer: F.least(
                F.lit(float(cap)),
                sum((F.when(lit[k], p).otherwise(0.0) for k, (own, _, p, _) in raised.items() if own == layer), F.lit(0.0)),
            ).alias(layer)
            for layer, cap in _CAP.items()
        }
        signals = sum((lit[k].cast("int") for k, r in raised.items() if r[3]), F.lit(0))
        return let(F.struct(F.struct(*penalty.values()).alias("penalties"), signals.alias("signals")), lambda w: summed(lit, w))

    def summed(lit: Column, w: Column) -> Column:
        score = F.greatest(F.lit(0.0), 100 - sum((w["penalties"][k] for k in _CAP), F.lit(0.0)))
        pct = 95 + F.when(answered, 5).otherwise(0)
        poor = ~F.coalesce("quality_pass", F.lit(True)) | (pct < 50)
        base = F.struct(score.alias("score"), pct.alias("pct"), poor.alias("poor"))
        return let(base, lambda t: judged(lit, w, t))

    def judged(lit: Column, w: Column, t: Column) -> Column:
        clear, worst = (t["score"] >= 85) & (w["signals"] == 0), (t["score"] < 55) | (w["signals"] >= 2)
        none = ~F.greatest(*[lit[k] for k in raised])
        action = F.when(t["poor"], "MANUAL_REVIEW").when(clear, "ACCEPT").when(worst, "ESCALATE").otherwise("MANUAL_REVIEW")
        extra = F.array(F.when(t["poor"], "INSUFFICIENT_EVIDENCE"), F.when(~t["poor"] & clear & none, "CLEAN_VERIFICATION"))
        codes = F.array_compact(F.concat(F.array(*[F.when(lit[k], k) for k in raised]), extra))
        return F.struct(
            w["penalties"].alias("penalties"), F.struct(*[c.alias(k) for k, c in coverage.items()]).alias("coverage"),
            w["signals"].alias("signals"), t["pct"].alias("coverage_pct"),
            F.round(F.when(t["poor"], F.least(t["score"], F.lit(65.0))).otherwise(t["score"]), 1).alias("trust_score"),
            F.when(t["poor"], "MEDIUM").when(clear, "LOW").when(worst, "HIGH").otherwise("MEDIUM").alias("risk"),
            action.alias("action"), codes.alias("codes"),
        )

    flags = F.struct(*[alive(k, c).alias(k) for k, (_, c, _, _) in raised.items()])
    reason = lambda c: F.struct(c.alias("code"), texts[c].alias("description"), overridden(c).alias("is_overridden"))
    return (
        df.withColumn("__fused", let(flags, weighed))
        .select(*df.columns, "__fused.*")
        .withColumn("reasons", F.transform("codes", reason))
    )


def evidence_table(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """a row a case and layer: cap, earned, penalty."""
    each = [
        F.struct(
            F.lit(k).alias("layer"), F.greatest(F.lit(0.0), F.col("coverage")[k] - F.col("penalties")[k]).alias("earned"),
            F.col("penalties")[k].alias("penalty"),
        )
        for k in _CAP
    ]
    return scored.select(key, F.explode(F.array(*each)).alias("e")).select(key, "e.*")


def severity(code: Column) -> Column:
    """danger, warning or success, by the marks in a code's name; danger goes first."""
    return F.when(code.rlike("|".join(L.DANGER_MARKS)), "danger").when(code.rlike("|".join(L.WARNING_MARKS)), "warning").otherwise("success")


def graded_reasons(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, code, severity, actionable); a reviewer can give a verdict on any code that names an anomaly."""
    return scored.select(key, F.explode("codes").alias("code")).select(
        key, "code", severity(F.col("code")).alias("severity"), (~F.col("code").isin(L.NOT_ACTIONABLE)).alias("actionable")
    )


def queue_status(action: Column) -> Column:
    return F.when(action == "ACCEPT", "accept").when(action == "ESCALATE", "escalate").otherwise("review")


def review_queue(scored: DataFrame, status: str | None = None, newest: str = "doc_id", top: int | None = None) -> DataFrame:
    """F8: (doc_id, status, score, risk) of one status or all.

    With `top` the newest so many of each status: tasks keep as many of their
    own, and only these meet. Without it rows come as they are, for a table:
    who shows them orders them.
    """
    rows = scored.select("doc_id", queue_status(F.col("action")).alias("status"), F.floor(F.col("trust_score") + 0.5).alias("score"), "risk", F.col(newest).alias("__newest"))
    rows = rows.where(F.col("status") == status) if status else rows
    if top:
        place = F.row_number().over(Window.partitionBy("status").orderBy(F.desc("__newest")))
        rows = rows.withColumn("__place", place).where(F.col("__place") <= top)
    return rows.select("doc_id", "status", "score", "risk")
