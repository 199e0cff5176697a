"""The workloads: scoring documents, dossiers, rings and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docverify.functions.checks import mask
from docverify.operators import crosscheck, dossier, evaluate, fusion, images, links
from docverify.operators.extraction import extract
from docverify.operators.validation import rules
from docverify.plans.storage import written
from docverify.sources.keyed import KeyedTable
from docverify.streaming.feedback import latest_verdicts, upserted, verdict_map


def flat_fields(extracted: DataFrame) -> DataFrame:
    """Extracted fields as the columns that scoring reads."""
    f = F.col("fields")
    return extracted.select(
        "*", f["doc_type"].alias("doc_type"), f["id_number"].alias("id_number"), f["name"].alias("name"), f["dob"].alias("dob"),
        F.coalesce(f["mrz"]["line1"], F.lit("")).alias("line1"), F.coalesce(f["mrz"]["line2"], F.lit("")).alias("line2"),
        f["confidence"].alias("ocr_confidence"),
    ).drop("fields")


def cross_checked(fields: DataFrame, payloads: DataFrame, registry: DataFrame) -> DataFrame:
    """Fields with qr_status and ref_status."""
    with_qr = crosscheck.attach_qr(fields, payloads)
    printed = [F.col(c) for c in ("doc_type", "id_number", "name", "dob")]
    parsed = with_qr.withColumn("__qr", crosscheck.parse_payload(F.col("payload")))
    compared = parsed.withColumn("qr_status", crosscheck.compare_qr(*printed, F.col("__qr"))["status"]).drop("payload", "__qr")
    found = crosscheck.attach_registry(compared, registry)
    status = crosscheck.compare_registry(*[F.col(c) for c in ("name", "dob", "lookup", "reg_name", "reg_dob")])["status"]
    return found.withColumn("ref_status", status).drop("lookup", "reg_name", "reg_dob")


def score(fields: DataFrame, payloads: DataFrame, registry: DataFrame, feedback: DataFrame | None, as_of: Column, key: str = "doc_id") -> DataFrame:
    """documents with fields and image evidence, scored.

    feedback, where given, holds (case_id, feedback map). The joins are by
    cleaned number (twice) and by case; all else is one projection.
    """
    return judged(ruled(fields, payloads, registry, as_of), feedback, key)


def ruled(fields: DataFrame, payloads: DataFrame, registry: DataFrame, as_of: Column) -> DataFrame:
    """The part of scoring that needs no image: fields with qr_status, ref_status and rules."""
    checked = cross_checked(fields, payloads, registry)
    return checked.withColumn("rules", rules(*[F.col(c) for c in ("doc_type", "id_number", "name", "dob", "line1", "line2")], as_of))


def judged(known: DataFrame, feedback: DataFrame | None, key: str = "doc_id") -> DataFrame:
    """The rest of scoring: ruled documents with image evidence, fused."""
    checked = images.check_layout(known)
    if feedback is None:
        said = checked.withColumn("feedback", F.lit(None).cast("map<string,string>"))
    else:
        said = checked.join(feedback.withColumnRenamed("case_id", key), key, "left")
    return fusion.fuse(said)


def score_texts(texts: DataFrame, evidence: DataFrame, payloads: DataFrame, registry: DataFrame, events: DataFrame | None, as_of: Column) -> DataFrame:
    """From raw text and image evidence to scores; events are the reviewers' verdicts so far."""
    fields = flat_fields(extract(texts, base=F.col("base_confidence"))).join(evidence, "doc_id")
    return score(fields, payloads, registry, None if events is None else verdict_map(latest_verdicts(events)), as_of)


def scan_evidence(measured: DataFrame) -> DataFrame:
    """The image evidence that scoring reads, one row an image, from images.measure: no shuffle.

    The places of photo and zone are those of the document's frame, as no detector gives others.
    """
    m = measured.select(
        "image_id", "width", "height", "boxes", images.tile_summary(F.col("tiles")).alias("t"), images.noise_verdict(F.col("noise_ratio")).alias("n"),
        images.quality_verdict(*[F.col(c) for c in ("width", "height", "lap_variance", "illumination")]).alias("q"),
    )
    return m.select(
        "image_id", "width", "height", F.coalesce("t.localized", F.lit(False)).alias("has_local"), F.coalesce("t.uniform", F.lit(False)).alias("uniform"),
        F.col("t.sigma").alias("tile_std"), F.col("n.mismatch").alias("noise"), F.col("n.edge").alias("edge"), F.col("q.quality_pass").alias("quality_pass"),
        F.floor(F.col("width") * 0.05).alias("photo_x"), F.floor(F.col("height") * 0.2).alias("photo_y"), F.floor(F.col("height") * 0.8).alias("mrz_y"),
        images.forensic_risk(F.col("t.localized"), F.col("t.uniform"), F.col("n.mismatch"), F.col("n.edge"), F.col("q.quality_pass")).alias("forensic"),
        images.regions(F.col("boxes"), F.col("t.localized")).alias("regions"),
    )


def score_scans(
    fields: DataFrame, measured: DataFrame, payloads: DataFrame, registry: DataFrame, feedback: DataFrame | None, as_of: Column
) -> DataFrame:
    """F12 with its image stage: fields (with image_id) scored with what was measured of their images.

    The join is by image id, of one narrow row an image; pixels don't travel.
    A document without a readable image is left out: it has nothing to judge.
    """
    return score(fields.join(scan_evidence(measured), "image_id"), payloads, registry, feedback, as_of)


def dossiers(docs: DataFrame) -> DataFrame:
    """Applicants with their verdict; docs has applicant_id, doc_id, name, dob and hist."""
    rows = dossier.slots(docs, "applicant_id", "doc_id", ["doc_id", "name", "dob", "hist"])
    return rows.withColumn("verdict", dossier.verdict(F.col("a"), F.col("b"), F.col("c"), F.col("n_docs")))


def ring_report(found: DataFrame) -> DataFrame:
    """ring_id, n_cases, n_entities and worst severity of each cluster of linked cases."""
    members = links.clusters(found)
    shared = links.suspicious_links(found).where("is_suspicious").join(members, "case_id")
    rank = F.when(F.col("entity_type") == "photo", 3).when(F.col("entity_type") == "pattern", 2).otherwise(1)
    severity = F.element_at(F.array(*[F.lit(links.SEVERITY[k]) for k in ("address", "pattern", "photo")]), F.max(rank))
    return shared.groupBy("ring_id").agg(
        F.count_distinct("case_id").alias("n_cases"), F.count_distinct("entity_type", "entity_id").alias("n_entities"),
        severity.alias("severity"),
    )


def evaluation(scored: DataFrame, labels: DataFrame, strict: bool = False) -> DataFrame:
    """Metrics of scored documents with labels (doc_id, truth, expected_action, expected_risk)."""
    return evaluate.metrics(scored.select("doc_id", "risk", "action").join(labels, "doc_id"), strict)


def audit_certificates(scored: DataFrame, as_of: Column, role: str = "Operator") -> DataFrame:
    """What is kept of a decision, a row a case.

    Reads what score_scans gives and doc_hash, the SHA-256 of the scan's file
    (tables.scan_hashes), which travels with the case. The number is masked;
    points are what each layer earned, statuses what it found.
    """
    earned = [
        F.greatest(F.lit(0.0), F.col("coverage")[k] - F.col("penalties")[k]).alias(f"{k}_points")
        for k in ("rules", "forensics", "template", "cross_check", "ocr")
    ]
    return scored.select(
        "doc_id", "doc_hash", "doc_type", "name", mask(F.col("id_number")).alias("masked_id"), "dob", *earned,
        F.col("rules.status").alias("rules_status"), F.col("forensic.risk").alias("forensics_status"),
        F.when(F.col("layout_pass"), "PASS").otherwise("ANOMALY").alias("template_status"),
        F.when(F.col("penalties.cross_check") > 0, "MISMATCH").otherwise("MATCH").alias("cross_check_status"),
        F.floor(F.coalesce(F.nanvl("ocr_confidence", F.lit(None)), F.lit(0.80)) * 100 + 0.5).alias("ocr_percent"),
        "trust_score", F.concat_ws(" / ", "risk", "action").alias("verdict"), as_of.alias("issued_on"), F.lit(role).alias("operator_role"),
    )


def issue_certificates(certificates: DataFrame, path: str) -> KeyedTable:
    """Writes certificates to the table at path; a case that is certified again has its new certificate only."""
    table = KeyedTable(certificates.sparkSession, path, certificates.schema, ("doc_id",))
    table.upsert(certificates)
    return table


def score_scan_stream(
    scans: DataFrame, fields: DataFrame, payloads: DataFrame, registry: DataFrame, as_of: Column, path: str
) -> DataFrame:
    """ST1 from pixels: a stream of images (image_id, height, width, data) to verdicts on the cases (fields) they show.

    A batch's pixels are measured once; what is measured meets the cases by
    image id. What the cases show without their images is worked out once a run,
    when the first image comes, and stored: payloads and registry are those of
    then. Verdicts go to a table with a row a case, which is returned; run
    again with the same path, it goes on with images that have come since.
    """
    known, stored = ruled(fields, payloads, registry, as_of), []
    known = known.select("image_id", "doc_id", "doc_type", "ocr_confidence", "qr_status", "ref_status", "rules")

    def verdicts(evidence: DataFrame) -> DataFrame:
        if not stored and not evidence.isEmpty():
            stored.append(written(known, "stream-cases"))
        scored = judged((stored[0] if stored else known).join(evidence, "image_id"), None)
        return scored.select("doc_id", "trust_score", "risk", "action", "codes", "regions")

    return upserted(scan_evidence(images.measure(scans)), ["doc_id"], path, mode="append", change=verdicts)
