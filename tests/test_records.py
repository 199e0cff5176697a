"""Golden rows and branches of the record checks, cross-checks, dossiers, rings, fusion and metrics."""

import pytest
from pyspark.sql import functions as F

from docverify.functions import checks, mrz, names
from docverify.functions import text as T
from docverify.operators import evaluate, fusion, images, links
from docverify.operators.components import connected_components
from docverify.operators.crosscheck import compare_qr, parse_payload
from docverify.operators.validation import rules



def now():
    return F.lit("2024-01-31").cast("date")


LINE1, LINE2 = "P<INDGUPTA<<ANSH<<<<<<<<<<<<<<<<<<<<<<<<<<<<", "Z2345678<6IND0208150M3201093<<<<<<<<<<<<<<08"


def run(spark, values, make, kind="string"):
    table = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in table.orderBy("i").select(make(F.col("v"))).collect()]


def test_aadhaar(spark):
    given = [None, "", "XXXX XXXX 1234", "**** **** 1234", "12345678901", "12345678901A", "012345678901", "112345678901",
             "543210987652", "345678901234", "987654321099", "5432-1098 7652"]
    got = [r["reason"] for r in run(spark, given, checks.aadhaar)]
    assert got == ["MISSING", "MISSING", "MASKED", "MASKED", "LENGTH", "NOT_DIGITS", "FIRST_DIGIT", "FIRST_DIGIT",
                   "OK", "CHECKSUM", "CHECKSUM", "OK"]


def test_verhoeff_catches_changes_and_swaps(spark):
    prefix = [f"{23456789012 + 7919 * i:011d}" for i in range(40)]
    whole = [p + d for p, d in zip(prefix, run(spark, prefix, checks.verhoeff_digit), strict=True)]
    assert all(r["valid"] for r in run(spark, whole, checks.aadhaar))
    bad = [w[:k] + str((int(w[k]) + 1) % 10) + w[k + 1 :] for w in whole for k in range(1, 12)]
    bad += [w[:k] + w[k + 1] + w[k] + w[k + 2 :] for w in whole for k in range(1, 11) if w[k] != w[k + 1]]
    assert not any(r["valid"] for r in run(spark, bad, checks.aadhaar))


def test_pan(spark):
    got = run(spark, [None, "ABC", "AAAZM9999K", "AAAPS1234K", "AAAPX1234K", "AAACX1234K", " aaaps 1234k "], lambda v: checks.pan(v, F.lit("SHARMA")))
    assert [(r["reason"], r["surname_matches"]) for r in got] == [
        ("MISSING", None), ("SHAPE", None), ("ENTITY", None), ("OK", True), ("OK", False), ("OK", True), ("OK", True)
    ]


def test_passport_number(spark):
    got = run(spark, ["A123456", "A1234567", "A12345678", "A123456789", "a1234567", None], checks.passport_number)
    assert [r["valid"] for r in got] == [False, True, True, False, True, False]


def test_birth_dates(spark):
    given = {
        None: "MISSING", "15/08/2002": "OK", "2002-08-15": "OK", "5.8.2002": "OK", "01/13/2000": "MONTH", "31/04/2000": "DAY",
        "29/02/2000": "OK", "29/02/2001": "DAY", "29/02/1900": "DAY", "01/02/2024": "FUTURE", "31/01/2024": "OK", "30/01/1903": "AGE",
        "31/01/1904": "OK", "text": "FORMAT", "01/01/0050": "AGE", "00/01/2000": "DAY",
    }
    got = run(spark, list(given), lambda v: checks.birth_date(v, now()))
    assert [r["reason"] for r in got] == list(given.values())
    assert [r["age"] for r in run(spark, ["31/01/2006", "01/02/2006"], lambda v: checks.birth_date(v, now()))] == [18, 17]


def test_mrz(spark):
    ok = run(spark, [LINE2], lambda v: mrz.parse(F.lit(LINE1), v, now()))[0]
    assert (ok["valid"], ok["full_name"], ok["dob"], ok["expiry_date"], ok["is_expired"]) == (True, "ANSH GUPTA", "15/08/2002", "09/01/2032", False)
    for k in (2, 14, 22, 35):
        changed = LINE2[:k] + "B" + LINE2[k + 1 :]
        assert not run(spark, [changed], lambda v: mrz.parse(F.lit(LINE1), v, now()))[0]["valid"]
    assert run(spark, ["30/01/2024", "31/01/2024", "01/02/2024", "31/13/2023", None], lambda v: mrz.expired(v, now())) == [True, True, False, True, False]
    assert run(spark, ["240101", "250101", "12a101", ""], lambda v: mrz.short_date(v, now())) == ["01/01/2024", "01/01/1925", None, None]
    assert run(spark, ["", None, "<<"], mrz.check_digit) == ["0", None, "0"]


def test_text(spark):
    assert run(spark, ["VIKRAM SHARMA", "INCOME TAX", "BCDF GHJK", "A B", None, "ONE TWO THREE FOUR FIVE"], T.plausible_name) == [
        True, False, False, False, False, False
    ]
    text = "Father\nRAM LAL\nKAVYA DAS\nDOB 01-02-1990\nMERA NAAM\n2345 6789 0123"
    assert run(spark, [text, "", None], T.name) == ["RAM LAL", "", ""]
    assert run(spark, [text, "no date", None], T.dob) == ["01/02/1990", "", ""]
    assert run(spark, ["लिंग पुरुष", "F", "male", "transgender", ""], T.gender) == ["MALE", "FEMALE", "MALE", "TRANSGENDER", ""]


def test_names_and_births(spark):
    pair = lambda a, b, f=names.compare_names: run(spark, [a], lambda v: f(v, F.lit(b)))[0]
    assert pair("V SHARMA", "VIKRAM SHARMA")["similarity"] == 85
    assert pair("SHARMA VIKRAM", "VIKRAM SHARMA")["kind"] == "HIGH"
    assert pair("A B", "A C D")["similarity"] == 33 and pair("", "X")["kind"] == "MISSING" and pair("आ", "ब")["kind"] == "EXACT"
    births = lambda a, b: pair(a, b, names.compare_births)
    assert [births("01/02/2000", x) for x in ("01/02/2000", "02/01/2000", "01/02/2001", "01-02-2000", "")] == [
        "EXACT", "TRANSPOSITION", "MISMATCH", "MISMATCH", "MISSING"
    ]


def test_payload_and_qr(spark):
    xml, json = '<P uid="1" name="A BCD" dob="01/01/2000" gender="M"/>', '{"uid":"1","name":"A BCD","dob":"01/01/2000"}'
    assert [r and r["name"] for r in run(spark, [xml, json, None], parse_payload)] == ["A BCD", "A BCD", None]
    got = run(spark, [xml, None], lambda v: compare_qr(F.lit("AADHAAR"), F.lit("9992"), F.lit("X Y"), F.lit("02/01/2000"), parse_payload(v)))
    assert [(r["status"], r["discrepancies"]) for r in got] == [("MISMATCH", ["DOB", "NAME", "NUMBER"]), ("UNAVAILABLE", [])]


# id, truth, expected action and risk, type, name, number, dob, zone, has_local, uniform, noise, edge, quality, qr, confidence
GOLDEN = [
    ("TC-01", "GENUINE", "AADHAAR", "ANSH GUPTA", "5432 1098 7652", "15/08/2002", "", False, False, False, 0.05, True, "MATCH", 0.94, 100.0, "ACCEPT"),
    ("TC-02", "TAMPERED", "AADHAAR", "ROHIT PATEL", "3456 7890 1234", "01/01/2000", "", True, False, False, 0.05, True, "MISMATCH", 0.94, 35.0, "ESCALATE"),
    ("TC-03", "TAMPERED", "AADHAAR", "ANSH GUPTA", "5432 1098 7652", "15/08/2002", "", True, False, True, 0.75, True, "MATCH", 0.94, 75.0, "ESCALATE"),
    ("TC-04", "TAMPERED", "AADHAAR", "VIKRAM SHARMA", "9876 5432 1099", "12/04/1995", "", False, False, False, 0.05, True, "MATCH", 0.94, 70.0, "MANUAL_REVIEW"),
    ("TC-05", "GENUINE", "PAN", "VIKRAM SHARMA", "AAAPS1234K", "12/04/1995", "", False, False, False, 0.05, True, "MATCH", 0.94, 100.0, "ACCEPT"),
    ("TC-06", "TAMPERED", "PAN", "RAJESH MEHTA", "AAAZM9999K", "05/10/1988", "", False, False, False, 0.05, True, "MATCH", 0.94, 75.0, "MANUAL_REVIEW"),
    ("TC-07", "GENUINE", "AADHAAR", "ANSH GUPTA", "5432 1098 7652", "15/08/2002", "", False, True, False, 0.05, True, "MATCH", 0.94, 97.0, "ACCEPT"),
    ("TC-08", "UNREADABLE", "UNKNOWN", "", "", "", "", False, False, False, 0.05, False, "MATCH", 0.30, 65.0, "MANUAL_REVIEW"),
    ("TC-09", "GENUINE", "PASSPORT", "ANSH GUPTA", "Z2345678", "15/08/2002", LINE2, False, False, False, 0.05, True, "MATCH", 0.94, 100.0, "ACCEPT"),
    ("TC-10", "TAMPERED", "PASSPORT", "ANSH GUPTA", "Z2345678", "01/01/2000", LINE2, True, False, False, 0.05, True, "MATCH", 0.94, 50.0, "ESCALATE"),
]


@pytest.fixture(scope="module")
def golden(spark):
    kinds = "case_id string, truth string, doc_type string, name string, id_number string, dob string, line2 string, has_local boolean, uniform boolean, noise boolean, edge double, quality_pass boolean, qr_status string, ocr_confidence double, want double, want_action string"
    rows = spark.createDataFrame(GOLDEN, kinds).withColumn("line1", F.when(F.col("line2") != "", LINE1).otherwise(""))
    ready = (
        rows.withColumn("tile_std", F.when(F.col("has_local"), 4.2).otherwise(1.1))
        .withColumn("layout_pass", F.lit(True)).withColumn("layout_score", F.lit(100)).withColumn("ref_status", F.lit("UNAVAILABLE"))
        .withColumn("rules", rules(*[F.col(c) for c in ("doc_type", "id_number", "name", "dob", "line1", "line2")], now()))
    )
    return ready


def test_golden_rows(golden):
    got = fusion.fuse(golden.withColumn("feedback", F.lit(None).cast("map<string,string>"))).collect()
    assert [(r["case_id"], r["trust_score"], r["action"]) for r in sorted(got, key=lambda r: r["case_id"])] == [(g[0], g[-2], g[-1]) for g in GOLDEN]
    codes = {r["case_id"]: r["codes"] for r in got}
    assert codes["TC-02"] == ["RULE_AADHAAR_CHECKSUM_FAIL", "FORENSICS_LOCAL_ELA_SPIKE", "QR_OCR_DOB_MISMATCH"]
    assert codes["TC-08"] == ["OCR_LOW_CONFIDENCE", "INSUFFICIENT_EVIDENCE"] and codes["TC-01"] == ["CLEAN_VERIFICATION"]


def test_rejected_codes_are_cancelled(golden):
    said = F.create_map(F.lit("FORENSICS_LOCAL_ELA_SPIKE"), F.lit("REJECTED"), F.lit("RULE_AADHAAR_CHECKSUM_FAIL"), F.lit("CONFIRMED"))
    got = {r["case_id"]: r for r in fusion.fuse(golden.withColumn("feedback", said)).collect()}
    assert got["TC-02"]["trust_score"] == 55.0 and got["TC-02"]["codes"] == ["RULE_AADHAAR_CHECKSUM_FAIL", "QR_OCR_DOB_MISMATCH"]
    assert got["TC-02"]["reasons"][0]["is_overridden"] is True


def test_metrics(golden):
    scored = fusion.fuse(golden.withColumn("feedback", F.lit(None).cast("map<string,string>")))
    expected = F.when(F.col("truth") == "TAMPERED", "ESCALATE").when(F.col("case_id").isin("TC-07", "TC-08"), "MANUAL_REVIEW").otherwise("ACCEPT")
    risk = F.when(expected == "ESCALATE", "HIGH").when(expected == "ACCEPT", "LOW").otherwise("MEDIUM")
    rows = scored.select("truth", "risk", "action", expected.alias("expected_action"), risk.alias("expected_risk"))
    m = evaluate.metrics(rows).first()
    assert (m["tp"], m["tn"], m["fp"], m["fn"], m["safeguard"], m["as_expected"], m["accuracy"]) == (5, 4, 0, 0, 1, 7, 100.0)
    assert evaluate.metrics(rows, strict=True).first()["recall"] == 60.0
    assert evaluate.metrics(rows.limit(0)).first()["accuracy"] == 100.0


def test_masks(spark):
    assert run(spark, ["5432 1098 7652", "AAAPS1234K", "Z2345678", "123456789", "", None], checks.mask) == [
        "XXXX XXXX 7652", "AAAPXXXXK", "Z2XXXX78", "123456789", "----", "----"
    ]


def test_rings(spark):
    seeds = [("01", "photo", "A"), ("03", "photo", "A"), ("02", "pattern", "D"), ("03", "pattern", "D"), ("02", "photo", "B"), ("06", "photo", "B"), ("02", "address", "2"), ("09", "address", "")]
    rows = spark.createDataFrame(seeds, "c string, t string, e string")
    pick = lambda k: F.when(F.col("t") == k, F.col("e"))
    found = links.links(rows, "c", photo=pick("photo"), address=pick("address"), pattern=pick("pattern"))
    assert {(r["entity_id"], r["n_cases"]) for r in links.shared_entities(found).collect()} == {("A", 2), ("B", 2), ("D", 2)}
    assert {tuple(r) for r in links.clusters(found).collect()} == {(c, "01") for c in ("01", "02", "03", "06")}
    hot = spark.createDataFrame([(i, "address", "H") for i in range(300)], "case_id long, entity_type string, entity_id string")
    assert links.case_pairs(hot).where("not all_pairs").count() == links.case_pairs(hot).count() == 299 and links.clusters(hot).where("ring_id = 0").count() == 300


def test_components_do_not_depend_on_order(spark):
    edges = [(i, i + 1) for i in range(60) if i % 20 != 19] + [(99, 99), (5, 5), (3, 2)]
    want = {(i, i // 20 * 20) for i in range(61) if i < 60} | {(99, 99)}
    for table in (edges, [(b, a) for a, b in reversed(edges)] * 2):
        got = {tuple(r) for r in connected_components(spark.createDataFrame(table, "a long, b long")).collect()}
        assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_image_invariants():
    import numpy as np

    flat = np.full((64, 96, 3), 128, np.uint8)
    assert images.quality(images.gray(flat))["lap_variance"] == pytest.approx(0, abs=1e-6)
    assert images.error_level(flat).max() <= 1
    noisy = np.random.default_rng(0).integers(0, 256, (64, 96, 3)).astype(np.uint8)
    once = images.jpeg_round_trip(noisy)
    assert images.error_level(once).mean() < images.error_level(noisy).mean()
    assert images.noise_ratio(images.gray(flat)) == 1.0


def test_second_zone_line_follows_the_first(spark):
    before = "X" * 44
    texts = [f"{before}\n{LINE1}\n{LINE2}", f"{LINE1}\nshort", f"{before}", f"{LINE1}\n{LINE1}", f"{LINE2}\n{LINE1}", None]
    got = run(spark, texts, lambda v: T.mrz_lines(F.coalesce(v, F.lit(""))))
    assert [g and tuple(g) for g in got] == [(LINE1, LINE2), (LINE1, ""), None, (LINE1, LINE1), (LINE1, ""), None]


def test_severity_of_codes(spark):
    # fixed values: what each code is shown as
    want = {
        "RULE_AADHAAR_CHECKSUM_FAIL": "danger", "RULE_PAN_FORMAT_INVALID": "success", "RULE_PASSPORT_INVALID_FORMAT": "success",
        "RULE_PASSPORT_MRZ_CHECKSUM_FAIL": "danger", "RULE_PASSPORT_VISIBLE_MISMATCH": "danger", "RULE_DOB_INVALID": "success",
        "FORENSICS_LOCAL_ELA_SPIKE": "danger", "FORENSICS_UNIFORM_COMPRESSION": "warning", "FORENSICS_NOISE_DISCONTINUITY": "success",
        "FORENSICS_EDGE_SPLICING": "danger", "TEMPLATE_LAYOUT_ANOMALY": "warning", "QR_OCR_DOB_MISMATCH": "danger",
        "OCR_LOW_CONFIDENCE": "warning", "REF_DATA_MISMATCH": "danger", "INSUFFICIENT_EVIDENCE": "warning", "CLEAN_VERIFICATION": "success",
    }
    scored = spark.createDataFrame([(1, list(want))], "doc_id long, codes array<string>")
    got = {r["code"]: (r["severity"], r["actionable"]) for r in fusion.graded_reasons(scored).collect()}
    assert got == {k: (v, k not in ("CLEAN_VERIFICATION", "INSUFFICIENT_EVIDENCE")) for k, v in want.items()}


def test_layout_without_a_size(spark):
    rows = [("PAN", 0, 100, 5, 45, None), ("PAN", 158, 0, 15, 5, None), ("PASSPORT", None, None, 5, 5, 70), ("PAN", 158, 100, 15, 30, None)]
    df = spark.createDataFrame(rows, "doc_type string, width int, height int, photo_x int, photo_y int, mrz_y int")
    got = images.check_layout(df).collect()
    assert [(g["layout_score"], g["aspect_ratio"]) for g in got] == [(100, None), (100, None), (100, None), (100, 1.58)]


def test_masked_numbers_go_round_the_joins(spark):
    from docverify.operators.crosscheck import attach_qr

    df = spark.createDataFrame([(1, "XXXX XXXX 1234"), (2, "543210987652"), (3, ""), (4, None)], "doc_id long, id_number string")
    payloads = spark.createDataFrame([("1234", "wrong"), ("543210987652", "right")], "clean_id string, payload string")
    assert {r["doc_id"]: r["payload"] for r in attach_qr(df, payloads).collect()} == {1: None, 2: "right", 3: None, 4: None}


def test_boxes_of_outlier_tiles(spark):
    # golden rows: a pair of tiles, one that the seed's reach leaves out, one at the lower edge
    tiles = [(x, y, m) for x, y, m in ((1, 1, 9.0), (3, 1, 12.0), (5, 1, 8.0), (7, 8, 30.0))]
    boxes = [tuple(b.values()) for b in images.grouped_boxes(tiles, 240, 240)]
    rows = spark.createDataFrame([(1, boxes)], "image_id long, boxes array<struct<x:int,y:int,w:int,h:int,max_error:double,region:string>>")
    got = sorted(tuple(r) for r in images.flagged_regions(images.outlier_boxes(rows)).collect())
    assert got == [
        (1, 0, 18, 18, 84, 36, 12.0, "TEXT", 0.95), (1, 1, 114, 18, 36, 36, 8.0, "TEXT", 0.8), (1, 2, 162, 186, 36, 36, 30.0, "ID_NUMBER", 0.95),
    ]
    own = rows.select(images.regions(F.col("boxes"), F.lit(True)).alias("r"), images.regions(F.col("boxes"), F.lit(None).cast("boolean")).alias("none")).first()
    assert [(r["region"], r["bbox"], r["risk"], r["reason"]) for r in own["r"]] == [
        ("TEXT", [18, 18, 84, 36], 0.95, "ELA 12.00 in TEXT"), ("TEXT", [114, 18, 36, 36], 0.8, "ELA 8.00 in TEXT"), ("ID_NUMBER", [162, 186, 36, 36], 0.95, "ELA 30.00 in ID_NUMBER"),
    ]
    assert own["none"] == [] and images.grouped_boxes([], 10, 10) == []


def test_large_pictures_are_named_by_the_fitted_size(spark):
    """The lowest tiles of a picture of 1,800 x 1,000, measured at 900 x 500, are the number's region."""
    import numpy as np

    r = np.random.default_rng(1)
    picture = np.full((1000, 1800, 3), 120, np.uint8)
    picture[910:1000, 100:400] = r.integers(0, 256, (90, 300, 3))
    rows = spark.createDataFrame([(1, 1000, 1800, picture.tobytes())], "image_id long, height int, width int, data binary")
    got = images.measure(rows).first()
    assert (got["width"], got["height"], got["fit_width"], got["fit_height"]) == (1800, 1000, 900, 500)
    assert got["boxes"] and {b["region"] for b in got["boxes"]} == {"ID_NUMBER"}
    assert all(b["x"] + b["w"] <= 900 and b["y"] + b["h"] <= 500 for b in got["boxes"])


@pytest.mark.parametrize("size", [(901, 3), (1000, 1), (2, 1801), (950, 1425)])
def test_fitting_is_bilinear(size):
    import numpy as np

    picture = np.random.default_rng(2).integers(0, 256, (*size, 3)).astype(np.uint8)
    got = images.fitted(picture)
    h, w, (nh, nw) = *size, got.shape[:2]
    assert max(nh, nw) == 900 and abs(nh - h * 900 / max(size)) <= 1 and abs(nw - w * 900 / max(size)) <= 1
    for y, x in ((0, 0), (nh - 1, nw - 1), (nh // 2, nw // 3), (nh // 3, nw // 2)):
        v, u = max(0.0, (y + 0.5) * h / nh - 0.5), max(0.0, (x + 0.5) * w / nw - 0.5)
        y0, x0 = int(v), int(u)
        y1, x1, fy, fx = min(y0 + 1, h - 1), min(x0 + 1, w - 1), v - int(v), u - int(u)
        exact = (1 - fy) * ((1 - fx) * picture[y0, x0] + fx * picture[y0, x1].astype(float)) + fy * ((1 - fx) * picture[y1, x0] + fx * picture[y1, x1].astype(float))
        assert np.abs(got[y, x] - exact).max() <= 0.5 + 1e-6
    assert images.fitted(got) is got


def test_tile_summary_equals_the_grouping(spark):
    import random

    r = random.Random(3)
    rows = [(i, 240, 240, [(x, y, r.choice([1.0, 2.0, 30.0]) if i % 2 else r.uniform(7, 8)) for y in range(4) for x in range(5)]) for i in range(8)]
    measured = spark.createDataFrame(rows, "image_id long, width int, height int, tiles array<struct<tx:int,ty:int,mean:double>>")
    grouped = {g["image_id"]: (round(g["mu"], 9), round(g["sigma"], 9), g["n_outliers"], g["uniform"], g["localized"])
               for g in images.tile_verdicts(images.tile_outliers(images.tile_table(measured))).collect()}
    own = measured.select("image_id", images.tile_summary(F.col("tiles")).alias("t")).collect()
    assert {o["image_id"]: (round(o["t"]["mu"], 9), round(o["t"]["sigma"], 9), *o["t"][2:]) for o in own} == grouped


def test_bitmaps_are_read_back(spark, tmp_path):
    from docverify.sources.tables import read_scans, write_scans

    rows = [(1, 2, 3, bytes(range(18))), (2, 1, 5, bytes(15)), (3, 3, 4, bytes(range(36)))]
    images_ = spark.createDataFrame(rows, "image_id long, height int, width int, data binary")
    folder = f"file://{tmp_path}/scans"
    assert write_scans(images_, folder) == 3
    (tmp_path / "scans/broken.bmp").write_bytes(b"BM no image")
    got = {r["origin"].rsplit("/", 1)[1]: (r["height"], r["width"], bytes(r["data"])) for r in read_scans(spark, folder).collect()}
    assert got == {f"{i}.bmp": (h, w, d) for i, h, w, d in rows}


def test_certificates_are_one_a_case(spark, tmp_path):
    from docverify.plans import jobs

    def certificates(*found):
        return spark.createDataFrame(found, "doc_id long, doc_hash string, verdict string")

    path = f"file://{tmp_path}/certified"
    jobs.issue_certificates(certificates((1, "a", "x"), (2, "b", "y")), path)
    jobs.issue_certificates(certificates((2, "b", "z"), (3, None, None)), path)
    table = jobs.issue_certificates(certificates((2, "b", "z"), (3, None, None)), path)
    assert sorted(tuple(r) for r in table.read().collect()) == [(1, "a", "x"), (2, "b", "z"), (3, None, None)]


def test_registry_report_of_what_was_not_found(spark):
    from docverify.operators.crosscheck import attach_registry, not_found

    df = spark.createDataFrame([(1, "XXXX XXXX 1234", "n"), (2, "5432-1098 7652", "n"), (3, " - ", None), (4, None, None), (5, "abc 1", "n"), (6, "zz", "n")], "doc_id long, id_number string, clean_id string")
    records = spark.createDataFrame([("543210987652", "A", "B"), ("ABC1", "C", "D"), (None, "E", "F"), ("", "G", "H")], "clean_id string, reg_name string, reg_dob string")
    source = df.drop("clean_id")
    assert {r.doc_id: r.reason for r in not_found(source, records).collect()} == {1: "MASKED", 3: "BLANK", 4: "BLANK", 6: "NOT_FOUND"}
    assert {r.doc_id: r.reg_name for r in attach_registry(source, records).collect()} == {1: None, 2: "A", 3: None, 4: None, 5: "C", 6: None}


def test_shared_entities_with_a_hot_one(spark):
    """An entity with a tenth of all rows: names and numbers are counted without a set in one task."""
    from docverify.operators import links

    found = spark.range(20_000).selectExpr("id AS case_id", "'address' AS entity_type", "if(id % 10 = 0, 'HOT', concat('e', id div 3)) AS entity_id")
    people = spark.range(20_000).selectExpr("id AS case_id", "if(id % 4 = 0, ' ', concat('n', id % 1500)) AS name", "if(id % 7 = 0, null, cast(id % 900 AS string)) AS id_number")
    got = {r.entity_id: (r.n_cases, r.n_names, r.n_ids) for r in links.shared_entities(found, people).collect()}
    rows = [(i, "HOT" if i % 10 == 0 else f"e{i // 3}", None if i % 4 == 0 else f"n{i % 1500}", None if i % 7 == 0 else str(i % 900)) for i in range(20_000)]
    want = {}
    for _, e, name, number in rows:
        n, names, numbers = want.setdefault(e, (0, set(), set()))
        want[e] = (n + 1, names | {name}, numbers | {number})
    assert got == {e: (n, len(a - {None}), len(b - {None})) for e, (n, a, b) in want.items() if n > 1}
    plan = links.shared_entities(found, people)._jdf.queryExecution().toString()
    assert "Expand" not in plan and "collect_set" not in plan


def test_review_queue_keeps_the_newest_of_each_status(spark):
    scored = spark.range(1000).selectExpr("id AS doc_id", "element_at(array('ACCEPT', 'ESCALATE', 'MANUAL_REVIEW'), cast(id % 3 + 1 AS int)) AS action", "50.5 AS trust_score", "'LOW' AS risk")
    queue = fusion.review_queue(scored, top=4)
    got = sorted((r.status, r.doc_id) for r in queue.collect())
    assert got == sorted([("accept", i) for i in (999, 996, 993, 990)] + [("escalate", i) for i in (997, 994, 991, 988)] + [("review", i) for i in (998, 995, 992, 989)])
    plan = queue._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "rangepartitioning" not in plan
    assert fusion.review_queue(scored, "escalate").count() == 333


def test_pictures_are_dealt_out(spark, tmp_path):
    """However few bytes their keys have, pictures are drawn and measured in several tasks; histograms alone equal those that are measured."""
    from docverify.sources import fixtures

    spark.range(400).selectExpr("id AS s_suppkey").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    for table in (fixtures.pictures, fixtures.strips):
        at = table(spark, str(tmp_path)).select("image_id", F.spark_partition_id().alias("task")).groupBy("task").count().collect()
        assert sum(r["count"] for r in at) == 400 and max(r["count"] for r in at) <= 200
    some = fixtures.pictures(spark, str(tmp_path)).where("image_id < 40")
    odd = spark.createDataFrame([(90, 2, 2, b"1"), (91, 0, 0, b""), (92, None, 1, b"123"), (93, 1, 1, None)], "image_id long, height int, width int, data binary")
    want = {r.image_id: r.hist for r in images.measure(some.union(odd)).collect()}
    assert {r.image_id: r.hist for r in images.histograms(some.union(odd)).collect()} == want and len(want) == 40
