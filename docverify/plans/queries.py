"""The registered queries: one for each operator, over tables derived from the given ones."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docverify.functions import checks, mrz, names
from docverify.functions import lookups as L
from docverify.functions import text as T
from docverify.operators import crosscheck, dossier, evaluate, fusion, images, links
from docverify.operators.extraction import extract
from docverify.operators.validation import rules
from docverify.plans import jobs
from docverify.plans import oracles as O
from docverify.plans.storage import new_path, written
from docverify.sources import fixtures as X
from docverify.sources import tables
from docverify.streaming import feedback as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
C = F.col


def _now():
    return F.lit(X.AS_OF).cast("date")


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that checks it."""

    def named(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return named


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- sources and sinks


@query(
    O.chain(O.PIXELS)
    + """SELECT i AS image_id, h AS height, w AS width, sha256(unhex(string_agg(printf('%02x%02x%02x', b, g, r), '' ORDER BY y, x))) AS doc_hash
  FROM px JOIN sizes USING (i) GROUP BY i, w, h"""
)
def s1_scans(spark, sf_dir):
    """Pictures as image files, one a supplier, read back by the image reader."""
    return _scans(spark, _scan_files(spark, sf_dir)).select("image_id", "height", "width", F.sha2("data", 256).alias("doc_hash"))


def _scan_files(spark, sf_dir):
    folder = new_path(spark, "scans")
    tables.write_scans(X.pictures(spark, sf_dir), folder)
    return folder


def _image_id():
    return F.regexp_extract("origin", r"(-?[0-9]+)\.bmp$", 1).cast("long").alias("image_id")


def _scans(spark, folder):
    return tables.read_scans(spark, f"{folder}/*.bmp").select(_image_id(), "height", "width", "data")


@query("SELECT page_id, sha256(html) AS doc_hash FROM pages")
def s2_fingerprint(spark, sf_dir):
    return tables.fingerprint(_read(spark, sf_dir, "pages").select("page_id", "html"), "html").select("page_id", "doc_hash")


@query(O.chain(O.CASES) + "SELECT doc_id, a AS applicant_id, doc_type, name, id_number, dob, expiry, line1, line2 FROM cases")
def s3_read_cases(spark, sf_dir):
    path = new_path(spark, "cases")
    X.cases(spark, sf_dir).select("doc_id", C("a").alias("applicant_id"), *tables.CASES.replace(" long", "").replace(" string", "").split(", ")[2:]).write.parquet(path)
    return tables.read_table(spark, path, tables.CASES)


@query(O.chain(O.FEEDBACK) + "SELECT event_id, ts, case_id, signal_code, verdict FROM said")
def s4_feedback_json(spark, sf_dir):
    path = new_path(spark, "feedback")
    tables.write_feedback(X.feedback(spark, sf_dir), path)
    return tables.read_feedback(spark, path)


def s5_audit(spark, sf_dir):
    """Certificates of cases with the hash of their picture's file, written twice and read back: the second run leaves one a case."""
    folder = _scan_files(spark, sf_dir)
    hashes = tables.scan_hashes(spark, f"{folder}/*.bmp").select(_image_id(), "doc_hash")
    scored = _scores_of(spark, sf_dir, _scan_records(spark, sf_dir).join(hashes, "image_id"), folder)
    certificates = written(jobs.audit_certificates(scored, _now()), "certificates")
    path = new_path(spark, "certified")
    jobs.issue_certificates(certificates.withColumn("verdict", F.lit("of an earlier run")), path)
    return jobs.issue_certificates(certificates, path).read()


# --- extraction


def _texts(spark, sf_dir):
    return X.ocr_text(spark, sf_dir)


def _fields(spark, sf_dir):
    return extract(_texts(spark, sf_dir), base=C("base_confidence")).select("doc_id", "fields.*")


_EXTRACTED = O.chain(O.CASES, O.TEXTS, O.EXTRACTED)


@query(_EXTRACTED + "SELECT doc_id, array_to_string(lines, '|') AS lines, len(lines) AS n_lines FROM extracted")
def e1_lines(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", T.lines(C("raw_text")).alias("l")).select(
        "doc_id", F.array_join("l", "|").alias("lines"), F.size("l").alias("n_lines")
    )


@query(_EXTRACTED + "SELECT doc_id, by_words AS keyword_type, doc_type FROM extracted")
def e2_doc_type(spark, sf_dir):
    return _texts(spark, sf_dir).select(
        "doc_id", T.keyword_type(C("raw_text")).alias("keyword_type"), T.id_number(C("raw_text"))["doc_type"].alias("doc_type")
    )


@query(_EXTRACTED + "SELECT doc_id, line1, line2 FROM extracted WHERE mrz1 IS NOT NULL")
def e3_mrz_lines(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", T.mrz_lines(C("raw_text")).alias("m")).where("m is not null").select("doc_id", "m.*")


@query(_EXTRACTED + "SELECT doc_id, id_number, is_masked FROM extracted")
def e4_id_number(spark, sf_dir):
    found = T.id_number(C("raw_text"))
    return _texts(spark, sf_dir).select("doc_id", found["id_number"].alias("id_number"), found["is_masked"].alias("is_masked"))


@query(_EXTRACTED + "SELECT doc_id, dob FROM extracted")
def e5_dob(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", T.dob(C("raw_text")).alias("dob"))


@query(_EXTRACTED + "SELECT doc_id, expiry FROM extracted")
def e6_expiry(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", T.expiry(C("raw_text")).alias("expiry"))


@query(_EXTRACTED + "SELECT doc_id, gender FROM extracted")
def e7_gender(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", T.gender(C("raw_text")).alias("gender"))


@query(
    _EXTRACTED
    + f"SELECT doc_id, q AS line, coalesce({O._PLAUSIBLE}, false) AS plausible FROM (SELECT doc_id, unnest(lines) AS q FROM extracted)"
)
def e8_plausible(spark, sf_dir):
    rows = _texts(spark, sf_dir).select("doc_id", F.explode(T.lines(C("raw_text"))).alias("line"))
    return rows.withColumn("plausible", T.plausible_name(C("line")))


@query(_EXTRACTED + "SELECT doc_id, name FROM extracted")
def e9_name(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", T.name(C("raw_text")).alias("name"))


@query(_EXTRACTED + "SELECT doc_id, ocr_confidence AS confidence, is_detected FROM extracted")
def e10_confidence(spark, sf_dir):
    return _fields(spark, sf_dir).select("doc_id", "confidence", "is_detected")


@query(
    _EXTRACTED
    + "SELECT doc_id, doc_type, id_number, is_masked, name, dob, expiry, gender, line1, line2, ocr_confidence AS confidence, is_detected FROM extracted"
)
def e11_extract(spark, sf_dir):
    f = _fields(spark, sf_dir)
    lines = [F.coalesce(f["mrz"][c], F.lit("")).alias(c) for c in ("line1", "line2")]
    return f.select("doc_id", "doc_type", "id_number", "is_masked", "name", "dob", "expiry", "gender", *lines, "confidence", "is_detected")


# --- validation


def _cases(spark, sf_dir):
    return X.cases(spark, sf_dir)


_FROM_CASES = "records AS (SELECT doc_id, doc_type, name, id_number, dob, line1, line2, short_expiry, short_birth, uid11, expiry, h FROM cases)"
_RULED = O.chain(O.CASES, _FROM_CASES, O.rules("records", "ruled"))


@query(
    _RULED
    + """SELECT doc_id, a_reason IN ('OK', 'MASKED') AS valid, a_reason = 'MASKED' AS is_masked, a_reason AS reason,
  CASE a_reason WHEN 'MISSING' THEN '' WHEN 'MASKED' THEN upper(trim(id_number)) WHEN 'OK' THEN concat_ws(' ', clean[1:4], clean[5:8], clean[9:12])
    WHEN 'CHECKSUM' THEN concat_ws(' ', clean[1:4], clean[5:8], clean[9:12]) ELSE clean END AS clean_number FROM ruled"""
)
def v1_aadhaar(spark, sf_dir):
    return _cases(spark, sf_dir).select("doc_id", checks.aadhaar(C("id_number")).alias("r")).select("doc_id", "r.*")


@query(O.chain(O.CASES) + f"SELECT doc_id, {O.verhoeff('uid11')} AS digit, {O.verhoeff('id_body')} AS own_digit FROM cases")
def v2_check_digit(spark, sf_dir):
    return _cases(spark, sf_dir).select(
        "doc_id", checks.verhoeff_digit(C("uid11")).alias("digit"),
        F.when(F.length("id_body") == 11, checks.verhoeff_digit(C("id_body"))).alias("own_digit"),
    )


@query(
    _RULED
    + """SELECT doc_id, p_reason = 'OK' AS valid, tight AS clean_pan, CASE WHEN p_reason = 'OK' THEN substr(tight, 4, 1) END AS entity,
  CASE WHEN p_reason = 'OK' THEN surname_ IS NULL OR substr(tight, 4, 1) <> 'P' OR upper(substr(surname_, 1, 1)) = substr(tight, 5, 1) END AS surname_matches,
  p_reason AS reason FROM ruled"""
)
def v3_pan(spark, sf_dir):
    from docverify.operators.validation import surname_of

    return _cases(spark, sf_dir).select("doc_id", checks.pan(C("id_number"), surname_of(C("name"))).alias("r")).select("doc_id", "r.*")


@query(_RULED + "SELECT doc_id, n_reason = 'OK' AS valid, tight AS clean_number, n_reason AS reason FROM ruled")
def v4_passport_number(spark, sf_dir):
    return _cases(spark, sf_dir).select("doc_id", checks.passport_number(C("id_number")).alias("r")).select("doc_id", "r.*")


@query(
    _RULED
    + """SELECT doc_id, b_reason = 'OK' AS valid, b_reason AS reason, CASE WHEN b_reason IN ('OK', 'AGE') THEN age_ END AS age,
  CASE WHEN b_reason = 'OK' THEN age_ >= 18 END AS is_adult,
  CASE WHEN b_reason = 'OK' THEN concat_ws('/', lpad(CAST(dd AS STRING), 2, '0'), lpad(CAST(mm AS STRING), 2, '0'), CAST(yy AS STRING)) ELSE trim(dob) END AS clean_dob
  FROM ruled"""
)
def v5_birth_date(spark, sf_dir):
    return _cases(spark, sf_dir).select("doc_id", checks.birth_date(C("dob"), _now()).alias("r")).select("doc_id", "r.*")


@query(O.chain(O.CASES) + f"SELECT doc_id, {O.icao('h')} AS digit, {O.icao('h')} = substr(line2, 10, 1) AS valid FROM cases WHERE line2 <> ''")
def v6_icao(spark, sf_dir):
    field = F.concat("passport_no", F.lit("<"))
    r = mrz.checked(field, F.substring("line2", 10, 1))
    return _cases(spark, sf_dir).where("line2 <> ''").select("doc_id", r["expected"].alias("digit"), r["valid"].alias("valid"))


@query(
    _RULED
    + """SELECT doc_id, z_valid AS valid, z_number AS passport_number, z_surname AS surname, z_given AS given_names, z_name AS full_name, z_dob AS dob,
  z_expiry AS expiry_date, 'MALE' AS sex, cd_number, cd_birth, cd_expiry, cd_whole AS cd_composite FROM ruled WHERE zoned"""
)
def v7_mrz(spark, sf_dir):
    z = _cases(spark, sf_dir).where("line2 <> ''").select("doc_id", mrz.parse(C("line1"), C("line2"), _now()).alias("z"))
    digits = [C(f"z.{n}.valid").alias(n) for n in ("cd_number", "cd_birth", "cd_expiry", "cd_composite")]
    plain = ("valid", "passport_number", "surname", "given_names", "full_name", "dob", "expiry_date", "sex")
    return z.select("doc_id", *[f"z.{n}" for n in plain], *digits)


@query(O.chain(O.CASES) + f"SELECT doc_id, {O.short_date('short_birth', False)} AS birth, {O.short_date('short_expiry', True)} AS expiry FROM cases")
def v8_short_dates(spark, sf_dir):
    return _cases(spark, sf_dir).select(
        "doc_id", mrz.short_date(C("short_birth"), _now()).alias("birth"), mrz.short_date(C("short_expiry"), _now(), True).alias("expiry")
    )


@query(_RULED + "SELECT doc_id, z_expired AS is_expired FROM ruled WHERE zoned")
def v9_expired(spark, sf_dir):
    date = mrz.short_date(F.substring("line2", 22, 6), _now(), True)
    return _cases(spark, sf_dir).where("line2 <> ''").select("doc_id", mrz.expired(date, _now()).alias("is_expired"))


@query(
    _RULED
    + "SELECT doc_id, v_status AS status, v_deduction AS deduction, CASE WHEN z_valid THEN array_to_string(differs, ',') ELSE 'MRZ' END AS discrepancies FROM ruled WHERE zoned"
)
def v10_visible(spark, sf_dir):
    r = mrz.compare_visible(C("id_number"), C("dob"), C("name"), mrz.parse(C("line1"), C("line2"), _now()))
    found = _cases(spark, sf_dir).where("line2 <> ''").select("doc_id", r.alias("r"))
    return found.select("doc_id", "r.status", "r.deduction", F.array_join("r.discrepancies", ",").alias("discrepancies"))


@query(
    _RULED
    + """SELECT doc_id, r_status AS status, n_checked AS checked, n_passed AS passed, n_checked - n_passed AS failed,
  as_aadhaar AS aadhaar_applies, as_pan AS pan_applies, as_passport AS passport_applies, with_zone AS mrz_applies FROM ruled"""
)
def v11_rules(spark, sf_dir):
    r = rules(*[C(c) for c in ("doc_type", "id_number", "name", "dob", "line1", "line2")], _now())
    found = _cases(spark, sf_dir).select("doc_id", r.alias("r"))
    applies = [C(f"r.{k}").isNotNull().alias(f"{k}_applies") for k in ("aadhaar", "pan", "passport", "mrz")]
    return found.select("doc_id", "r.status", "r.checked", "r.passed", "r.failed", *applies)


# --- cross-checks


def _records(spark, sf_dir):
    return _cases(spark, sf_dir).select(
        "doc_id", C("a").alias("applicant_id"), "doc_type", "name", "id_number", "dob", "expiry", "line1", "line2", F.expr(f"struct({_struct(X.EVIDENCE_SQL)}) AS e")
    ).select("*", "e.*").drop("e").withColumnRenamed("base_confidence", "ocr_confidence")


def _struct(text: str) -> str:
    return " ".join(text.split())


_CROSSED = O.chain(O.CASES, O.RECORDS, O.TRUTH, O.crossed("records"))


@query(_CROSSED + "SELECT doc_id, uid IS NOT NULL AS decoded FROM crossed")
def j1_attach_qr(spark, sf_dir):
    return crosscheck.attach_qr(_records(spark, sf_dir), X.qr_payloads(spark, sf_dir)).select("doc_id", C("payload").isNotNull().alias("decoded"))


@query(O.chain(O.TRUTH) + "SELECT clean_id, uid, q_name AS name, q_dob AS dob, 'M' AS gender FROM qr")
def j2_parse_payload(spark, sf_dir):
    return X.qr_payloads(spark, sf_dir).select("clean_id", crosscheck.parse_payload(C("payload")).alias("q")).select("clean_id", "q.*")


@query(
    _CROSSED
    + """SELECT doc_id, qr_status AS status, CASE WHEN qr_status = 'MISMATCH' THEN array_to_string(q_differs, ',') ELSE '' END AS discrepancies,
  CASE WHEN qr_status = 'MISMATCH' THEN 30 ELSE 0 END AS deduction FROM crossed"""
)
def j3_compare_qr(spark, sf_dir):
    rows = crosscheck.attach_qr(_records(spark, sf_dir), X.qr_payloads(spark, sf_dir))
    r = crosscheck.compare_qr(C("doc_type"), C("id_number"), C("name"), C("dob"), crosscheck.parse_payload(C("payload")))
    return rows.select("doc_id", r.alias("r")).select("doc_id", "r.status", F.array_join("r.discrepancies", ",").alias("discrepancies"), "r.deduction")


@query(
    _CROSSED
    + "SELECT doc_id, CASE WHEN known THEN 'AUTHENTICATED' ELSE 'NOT_FOUND_IN_SANDBOX' END AS lookup, reg_name, reg_dob FROM crossed"
)
def j4_attach_registry(spark, sf_dir):
    return crosscheck.attach_registry(_records(spark, sf_dir), X.registry(spark, sf_dir)).select("doc_id", "lookup", "reg_name", "reg_dob")


@query(
    _CROSSED
    + """SELECT doc_id, id_number, CASE WHEN regexp_matches(id_number, '[xX*]{4}') THEN 'MASKED' WHEN regexp_replace(id_number, '[\\s-]', '', 'g') = '' THEN 'BLANK' ELSE 'NOT_FOUND' END AS reason
FROM crossed WHERE NOT known"""
)
def j4_not_found(spark, sf_dir):
    return crosscheck.not_found(_records(spark, sf_dir), X.registry(spark, sf_dir)).select("doc_id", "id_number", "reason")


@query(
    _CROSSED
    + "SELECT doc_id, ref_status AS status, CASE WHEN known THEN same_name END AS name_match, CASE WHEN known THEN same_dob END AS dob_match FROM crossed"
)
def j5_compare_registry(spark, sf_dir):
    rows = crosscheck.attach_registry(_records(spark, sf_dir), X.registry(spark, sf_dir))
    r = crosscheck.compare_registry(*[C(c) for c in ("name", "dob", "lookup", "reg_name", "reg_dob")])
    return rows.select("doc_id", r.alias("r")).select("doc_id", "r.*")


# --- dossiers


def _dossier_docs(spark, sf_dir):
    """Cases with a histogram: the shape of an applicant's portrait, another one for every 17th document."""
    owner = F.when(C("doc_id") % 17 == 0, C("a") + 5).otherwise(C("a"))
    hist = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: ((k + 1) * (owner % 97 + 3) * 7 % 101).cast("int"))
    return _cases(spark, sf_dir).select(C("a").alias("applicant_id"), "doc_id", "name", "dob", hist.alias("hist"))


_OWNER = "(CASE WHEN doc_id % 17 = 0 THEN a + 5 ELSE a END)"
_SLOTS = f"""
dd AS (SELECT a AS applicant_id, doc_id, name, dob, list_transform(range(0, 16), lambda k: (k + 1) * ({_OWNER} % 97 + 3) * 7 % 101) AS hist,
  row_number() OVER (PARTITION BY a ORDER BY doc_id) AS place, count(*) OVER (PARTITION BY a) AS n_docs FROM cases),
slots AS (SELECT applicant_id, max(n_docs) AS n_docs, max(CASE WHEN place = 1 THEN doc_id END) AS a_id, max(CASE WHEN place = 2 THEN doc_id END) AS b_id,
  max(CASE WHEN place = 3 THEN doc_id END) AS c_id,
  max(CASE WHEN place = 1 THEN name END) AS a_name, max(CASE WHEN place = 2 THEN name END) AS b_name, max(CASE WHEN place = 3 THEN name END) AS c_name,
  max(CASE WHEN place = 1 THEN dob END) AS a_dob, max(CASE WHEN place = 2 THEN dob END) AS b_dob, max(CASE WHEN place = 3 THEN dob END) AS c_dob,
  max(CASE WHEN place = 1 THEN hist END) AS a_hist, max(CASE WHEN place = 2 THEN hist END) AS b_hist FROM dd GROUP BY applicant_id)
"""


def _similar(a: str, b: str) -> str:
    clean = lambda e: f"trim(regexp_replace(regexp_replace(upper({e}), '[^A-Z\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    ws = lambda e: f"list_filter(string_split({clean(e)}, ' '), lambda u: u <> '')"
    one = (
        f"CASE WHEN list_contains({ws(b)}, w) THEN 10 WHEN len(list_filter({ws(b)}, lambda v: (length(w) = 1 AND starts_with(v, w)) OR (length(v) = 1 AND starts_with(w, v)))) > 0 THEN 7 ELSE 0 END"
    )
    return (
        f"CASE WHEN {a} = '' OR {b} = '' THEN 0 WHEN {clean(a)} = {clean(b)} THEN 100 ELSE "
        f"least(100, floor(coalesce(list_sum(list_transform({ws(a)}, lambda w: {one})), 0) * 10.0 / greatest(len({ws(a)}), len({ws(b)}), 1) + 0.5)) END"
    )


def _births(a: str, b: str) -> str:
    p = lambda e, i: f"string_split_regex({e}, '[/\\-.]')[{i}]"
    return (
        f"CASE WHEN {a} = '' OR {b} = '' THEN 'MISSING' WHEN {a} = {b} THEN 'EXACT' WHEN {p(a, 3)} = {p(b, 3)} AND {p(a, 1)} = {p(b, 2)} AND {p(a, 2)} = {p(b, 1)} "
        "THEN 'TRANSPOSITION' ELSE 'MISMATCH' END"
    )


@query(O.chain(O.CASES, _SLOTS) + "SELECT applicant_id, n_docs, a_id, b_id, c_id FROM slots")
def j6_slots(spark, sf_dir):
    rows = dossier.slots(_dossier_docs(spark, sf_dir), "applicant_id", "doc_id", ["doc_id", "name"])
    return rows.select("applicant_id", "n_docs", *[C(f"{s}.doc_id").alias(f"{s}_id") for s in "abc"])


@query(
    O.chain(O.CASES)
    + f"""SELECT doc_id, CAST(s AS INT) AS similarity, CASE WHEN s >= 90 AND NOT same THEN 'HIGH' WHEN same THEN 'EXACT' WHEN s >= 60 THEN 'PARTIAL' ELSE 'MISMATCH' END AS kind,
  CAST(t AS INT) AS reverse_similarity FROM (SELECT doc_id, {_similar("name", "concat_ws(' ', given, surname)")} AS s,
    {_similar("concat_ws(' ', surname, substr(given, 1, 1))", "name")} AS t, name = concat_ws(' ', given, surname) AS same FROM cases)"""
)
def c1_names(spark, sf_dir):
    full = F.concat_ws(" ", "given", "surname")
    r, t = names.compare_names(C("name"), full), names.compare_names(F.concat_ws(" ", C("surname"), F.substring("given", 1, 1)), C("name"))
    return _cases(spark, sf_dir).select("doc_id", r.alias("r"), t["similarity"].alias("reverse_similarity")).select("doc_id", "r.*", "reverse_similarity")


@query(O.chain(O.CASES) + f"SELECT doc_id, {_births('dob', 'true_dob')} AS status FROM cases")
def c2_births(spark, sf_dir):
    return _cases(spark, sf_dir).select("doc_id", names.compare_births(C("dob"), C("true_dob")).alias("status"))


@query(
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS u, list_transform(list_reverse(embedding), lambda x: CAST(x AS DOUBLE)) AS w FROM embeddings),
s AS (SELECT vec_id, CAST(floor(list_inner_product(u, w) / (sqrt(list_inner_product(u, u)) * sqrt(list_inner_product(w, w))) * 100 + 0.5) AS INT) AS similarity FROM v)
SELECT vec_id, similarity, CASE WHEN similarity >= 80 THEN 'HIGH_SIMILARITY' WHEN similarity >= 55 THEN 'MODERATE_SIMILARITY' ELSE 'LOW_SIMILARITY' END AS status FROM s"""
)
def c3_portraits(spark, sf_dir):
    r = names.compare_portraits(C("embedding"), F.reverse("embedding"))
    return _read(spark, sf_dir, "embeddings").select("vec_id", r.alias("r")).select("vec_id", "r.*")


_VERDICTS = f"""
w1 AS (SELECT *, CASE WHEN c_name IS NULL THEN {_similar("a_name", "b_name")} ELSE floor(({_similar("a_name", "b_name")} + {_similar("a_name", "c_name")}) / 2 + 0.5) END AS mean,
  {_births("a_dob", "b_dob")} = 'EXACT' AS same_ab, c_dob IS NULL OR {_births("a_dob", "c_dob")} = 'EXACT' AS same_ac,
  floor(list_inner_product(a_hist, b_hist) / (sqrt(list_inner_product(a_hist, a_hist)) * sqrt(list_inner_product(b_hist, b_hist))) * 100 + 0.5) AS photo FROM slots),
w2 AS (SELECT *, greatest(0, 100 - CASE WHEN mean < 60 THEN 35 WHEN mean < 85 THEN 10 ELSE 0 END - CASE WHEN same_ab AND same_ac THEN 0 ELSE 40 END
  - CASE WHEN photo < 55 THEN 25 ELSE 0 END) AS points FROM w1),
verdicts AS (SELECT applicant_id, n_docs, CASE WHEN n_docs < 2 THEN 100 ELSE points END AS score,
  CASE WHEN n_docs < 2 THEN 'INSUFFICIENT_DOCUMENTS' WHEN points < 50 THEN 'HIGH' WHEN points < 80 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
  CASE WHEN n_docs < 2 THEN NULL WHEN points < 50 THEN 'ESCALATE' WHEN points < 80 THEN 'MANUAL_REVIEW' ELSE 'ACCEPT' END AS action,
  CASE WHEN n_docs >= 2 THEN CAST(mean AS INT) END AS name_similarity, CASE WHEN n_docs >= 2 THEN same_ab AND same_ac END AS dob_match,
  CASE WHEN n_docs >= 2 THEN concat_ws(',', CASE WHEN mean < 60 THEN 'NAME_DISCREPANCY' WHEN mean < 85 THEN 'NAME_PARTIAL' END,
    CASE WHEN NOT same_ab THEN 'DOB_AB' WHEN NOT same_ac THEN 'DOB_AC' END, CASE WHEN photo < 55 THEN 'PORTRAIT' END) END AS flags FROM w2)
"""


@query(O.chain(O.CASES, _SLOTS, _VERDICTS) + "SELECT * FROM verdicts")
def c4_dossier(spark, sf_dir):
    r = jobs.dossiers(_dossier_docs(spark, sf_dir))
    plain = [f"verdict.{c}" for c in ("score", "risk", "action", "name_similarity", "dob_match")]
    return r.select("applicant_id", "n_docs", *plain, F.array_join("verdict.flags", ",").alias("flags"))


@query("SELECT risk, count(*) AS applicants, sum(n_docs) AS documents FROM (" + O.chain(O.CASES, _SLOTS, _VERDICTS) + "SELECT * FROM verdicts) GROUP BY risk")
def w2_dossier_report(spark, sf_dir):
    return c4_dossier(spark, sf_dir).groupBy("risk").agg(F.count(F.lit(1)).alias("applicants"), F.sum("n_docs").alias("documents"))


@query(
    """WITH p AS (SELECT vec_id, sha256(array_to_string(list_transform(embedding, lambda x: CAST(CAST(floor(x * 8) AS INT) AS STRING)), ',')) AS print FROM embeddings)
SELECT vec_id, print, count(*) OVER (PARTITION BY print) AS n_same FROM p"""
)
def c5_exact_portraits(spark, sf_dir):
    coarse = F.transform("embedding", lambda x: F.floor(x * 8).cast("int"))
    return links.exact_portraits(_read(spark, sf_dir, "embeddings").select("vec_id", coarse.alias("hist"))).select("vec_id", "print", "n_same")


@query(
    """WITH given AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS u FROM embeddings),
p AS (SELECT * FROM given UNION ALL SELECT -1 - vec_id, list_transform(u, lambda x, j: x * (1 + CASE WHEN j % 2 = 1 THEN 0.05 ELSE -0.05 END)) FROM given WHERE vec_id % 10 = 3),
n AS (SELECT vec_id, u, sqrt(list_inner_product(u, u)) AS norm FROM p)
SELECT l.vec_id AS a, r.vec_id AS b, round(list_inner_product(l.u, r.u) / (l.norm * r.norm), 6) AS similarity FROM n l JOIN n r ON l.vec_id < r.vec_id
WHERE list_inner_product(l.u, r.u) >= 0.95 * l.norm * r.norm"""
)
def c5_near_portraits(spark, sf_dir):
    """Near portraits among the vectors and slightly changed copies of every tenth."""
    return links.near_portraits(X.portraits(spark, sf_dir), 0.95).withColumn("similarity", F.round("similarity", 6))


@query(
    """WITH RECURSIVE given AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS u FROM embeddings),
p AS (SELECT * FROM given UNION ALL SELECT -1 - vec_id, list_transform(u, lambda x, j: x * (1 + CASE WHEN j % 2 = 1 THEN 0.05 ELSE -0.05 END)) FROM given WHERE vec_id % 10 = 3),
n AS (SELECT vec_id, u, sqrt(list_inner_product(u, u)) AS norm FROM p),
near AS (SELECT l.vec_id AS a, r.vec_id AS b FROM n l JOIN n r ON l.vec_id <> r.vec_id WHERE list_inner_product(l.u, r.u) >= 0.95 * l.norm * r.norm),
reach AS (SELECT vec_id AS a, vec_id AS b FROM p UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b)
SELECT a AS vec_id, min(b) AS group_id FROM reach GROUP BY a"""
)
def c5_portrait_groups(spark, sf_dir):
    """Groups of near portraits, among the vectors and slightly changed copies of every tenth."""
    return links.portrait_groups(X.portraits(spark, sf_dir)).select(C("id").alias("vec_id"), "group_id")


def _addresses(spark, sf_dir):
    pin = lambda k: (100000 + (C("a") * 37 + k) % 900000).cast("string")
    one = F.concat_ws(" ", F.lit("12, MG Road,"), "surname", F.lit("Nagar"), pin(0))
    two = F.concat_ws(" ", F.lit("Flat 3 MG Road"), "given", F.lit("Nagar -"), F.when(C("doc_id") % 3 == 0, pin(1)).otherwise(pin(0)))
    return _cases(spark, sf_dir).select("doc_id", one.alias("one"), two.alias("two"))


_ADDRESS = """
ad AS (SELECT doc_id, concat_ws(' ', '12, MG Road,', surname, 'Nagar', CAST(100000 + (a * 37) % 900000 AS STRING)) AS one,
  concat_ws(' ', 'Flat 3 MG Road', given, 'Nagar -', CAST(100000 + (a * 37 + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) % 900000 AS STRING)) AS two FROM cases)
"""


@query(
    O.chain(O.CASES, _ADDRESS)
    + """SELECT doc_id, regexp_extract(one, '[1-9][0-9]{5}') = regexp_extract(two, '[1-9][0-9]{5}') AS same_pin,
  array_to_string(list_sort(list_filter(list_distinct(list_intersect(string_split_regex(upper(one), '[^A-Z]+'), string_split_regex(upper(two), '[^A-Z]+'))), lambda w: w <> '')), ',') AS shared_words FROM ad"""
)
def c6_addresses(spark, sf_dir):
    r = dossier.address_alignment(C("one"), C("two"))
    return _addresses(spark, sf_dir).select("doc_id", r["same_pin"].alias("same_pin"), F.array_join(r["shared_words"], ",").alias("shared_words"))


# --- rings


def _links(spark, sf_dir):
    """Photographs with planted reuse, addresses with one hot one, patterns."""
    rows = _cases(spark, sf_dir)
    n = _read(spark, sf_dir, "orders").count()
    photo = F.when(C("doc_id") % 40 == 0, C("doc_id") % 200).otherwise((C("doc_id") * 31) % (3 * n) + 1000)
    address = F.when(C("nk") == 0, F.lit("HOT")).otherwise(C("a").cast("string"))
    pattern = F.when(C("doc_id") % 6 == 0, (C("doc_id") % 997).cast("string"))
    return links.links(rows, "doc_id", photo=photo, address=address, pattern=pattern)


_LINKS = """
li AS (SELECT DISTINCT case_id, entity_type, entity_id FROM (
  SELECT doc_id AS case_id, 'photo' AS entity_type, CAST(CASE WHEN doc_id % 40 = 0 THEN doc_id % 200 ELSE (doc_id * 31) % (3 * (SELECT count(*) FROM orders)) + 1000 END AS STRING) AS entity_id FROM cases
  UNION ALL SELECT doc_id, 'address', CASE WHEN nk = 0 THEN 'HOT' ELSE CAST(a AS STRING) END FROM cases
  UNION ALL SELECT doc_id, 'pattern', CAST(doc_id % 997 AS STRING) FROM cases WHERE doc_id % 6 = 0)),
sh AS (SELECT entity_type, entity_id, count(*) AS n_cases, min(case_id) AS first_case, max(case_id) AS last_case FROM li GROUP BY entity_type, entity_id HAVING count(*) > 1)
"""
_LINKED = O.chain(O.CASES, _LINKS)


@query(_LINKED + "SELECT * FROM li")
def g1_links(spark, sf_dir):
    return _links(spark, sf_dir)


@query(
    _LINKED
    + """SELECT entity_type, entity_id, count(*) AS n_cases, count(DISTINCT nullif(trim(name), '')) AS n_names, count(DISTINCT nullif(trim(id_number), '')) AS n_ids
FROM li JOIN cases ON doc_id = case_id GROUP BY ALL HAVING count(*) > 1"""
)
def g2_shared(spark, sf_dir):
    people = _cases(spark, sf_dir).select(C("doc_id").alias("case_id"), "name", "id_number")
    return links.shared_entities(_links(spark, sf_dir), people)


@query(
    _LINKED
    + """SELECT entity_type, entity_id, n_cases, first_case, last_case, CASE entity_type WHEN 'photo' THEN 'CRITICAL' WHEN 'pattern' THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  concat_ws(' ', 'Shared', entity_type, entity_id) AS title FROM sh"""
)
def g3_rings(spark, sf_dir):
    return links.rings(_links(spark, sf_dir))


@query(_LINKED + "SELECT li.*, sh.n_cases IS NOT NULL AS is_suspicious FROM li LEFT JOIN sh USING (entity_type, entity_id)")
def g4_suspicious(spark, sf_dir):
    return links.suspicious_links(_links(spark, sf_dir))


@query(
    _LINKED
    + f"""SELECT l.case_id AS a, r.case_id AS b, entity_type, entity_id, n_cases <= {links.PAIRED} AS all_pairs FROM li l JOIN li r USING (entity_type, entity_id) JOIN sh USING (entity_type, entity_id)
  WHERE l.case_id < r.case_id AND (n_cases <= {links.PAIRED} OR l.case_id = first_case)"""
)
def g5_pairs(spark, sf_dir):
    return links.case_pairs(_links(spark, sf_dir))


_REACH = (
    "WITH RECURSIVE "
    + ",\n".join(p.strip().rstrip(",") for p in (O.CASES, _LINKS))
    + """, ed AS (SELECT DISTINCT case_id, first_case FROM li JOIN sh USING (entity_type, entity_id)),
both_ AS (SELECT case_id AS u, first_case AS v FROM ed UNION SELECT first_case, case_id FROM ed),
reach(u, v) USING KEY (u) AS (SELECT u, least(u, min(v)) FROM both_ GROUP BY u
  UNION SELECT b.u, min(r.v) FROM both_ b JOIN reach r ON b.v = r.u JOIN recurring.reach o ON o.u = b.u WHERE r.v < o.v GROUP BY b.u)"""
)


@query(_REACH + " SELECT u AS case_id, v AS ring_id FROM reach")
def g6_clusters(spark, sf_dir):
    return links.clusters(_links(spark, sf_dir))


@query(
    O.chain(O.CASES, O.RECORDS, O.TRUTH, O.crossed("records"), O.LAYOUT, O.rules("laid", "ruled"), O.scored(False), _LINKS)
    + """SELECT entity_type, entity_id, count(DISTINCT case_id) AS degree,
  CASE WHEN coalesce(bool_or(action = 'ESCALATE'), false) OR count(DISTINCT case_id) > 1 THEN 'flagged' ELSE 'normal' END AS status
  FROM li LEFT JOIN scored ON case_id = doc_id GROUP BY entity_type, entity_id"""
)
def g7_entities(spark, sf_dir):
    return links.entity_status(_links(spark, sf_dir), _scored(spark, sf_dir).select(C("doc_id").alias("case_id"), "action"))


@query(
    _REACH
    + """, me AS (SELECT u AS case_id, v AS ring_id FROM reach)
SELECT ring_id, count(DISTINCT case_id) AS n_cases, count(DISTINCT (entity_type, entity_id)) AS n_entities,
  CASE max(CASE entity_type WHEN 'photo' THEN 3 WHEN 'pattern' THEN 2 ELSE 1 END) WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
FROM li JOIN sh USING (entity_type, entity_id) JOIN me USING (case_id) GROUP BY ring_id"""
)
def w3_ring_report(spark, sf_dir):
    return jobs.ring_report(_links(spark, sf_dir))


# --- images


def _measured(spark, sf_dir):
    return images.measure(X.pictures(spark, sf_dir))


_PIXELS = O.chain(O.PIXELS)
_TILED = O.chain(O.PIXELS, O.ERRORS, O.TILES)


@query(_PIXELS + "SELECT image_id, round(avg(v), 6) AS mean_gray FROM gray GROUP BY image_id")
def i1_gray(spark, sf_dir):
    return _measured(spark, sf_dir).select("image_id", F.round("mean_gray", 6).alias("mean_gray"))


@query(
    O.chain(O.PIXELS, O.QUALITY)
    + """SELECT image_id, floor(lap + 0.5) AS blur_score, blurry AS is_blurry, low AS is_low_res, uneven AS is_uneven, round(light, 2) AS illumination,
  greatest(10, floor(100 - CASE WHEN low THEN 35 ELSE 0 END - CASE WHEN blurry THEN least(45, (65 - lap) * 1.2) ELSE 0 END - CASE WHEN uneven THEN 20 ELSE 0 END + 0.5)) AS quality_score,
  NOT low AND NOT blurry AND NOT uneven AS quality_pass FROM ql"""
)
def i2_quality(spark, sf_dir):
    m = _measured(spark, sf_dir)
    return m.select("image_id", images.quality_verdict(*[C(c) for c in ("width", "height", "lap_variance", "illumination")]).alias("q")).select("image_id", "q.*")


@query(O.chain(O.PIXELS, O.ERRORS) + "SELECT image_id, CAST(round(sum(v * 3)) AS BIGINT) AS total_error, round(max(v), 4) AS max_error FROM errors GROUP BY image_id")
def i3_error_level(spark, sf_dir):
    return _errors(_measured(spark, sf_dir))


def _errors(measured: DataFrame) -> DataFrame:
    total = F.round(C("ela_mean") * 3 * C("fit_width") * C("fit_height")).cast("long")  # of three colours: a whole number
    return measured.select("image_id", total.alias("total_error"), F.round("ela_max", 4).alias("max_error"))


_STRIPS = O.chain(O.STRIPS, O.ERRORS)


@query(_STRIPS + "SELECT image_id, CAST(round(sum(v * 3)) AS BIGINT) AS total_error, round(max(v), 4) AS max_error FROM errors GROUP BY image_id")
def i3_fitted_errors(spark, sf_dir):
    """Pictures longer than an image is measured at."""
    return _errors(images.measure(X.strips(spark, sf_dir)))


@query(_TILED + "SELECT image_id, tx, ty, round(mean, 6) AS mean FROM tl")
def i4_tiles(spark, sf_dir):
    return images.tile_table(_measured(spark, sf_dir)).select("image_id", "tx", "ty", F.round("mean", 6).alias("mean"))


@query(
    _TILED
    + "SELECT image_id, round(mu, 6) AS mu, round(sigma, 6) AS sigma, n_outliers, uniform, n_outliers >= 2 AND NOT uniform AS localized FROM tv"
)
def i5_outliers(spark, sf_dir):
    r = images.tile_verdicts(images.tile_outliers(images.tile_table(_measured(spark, sf_dir))))
    return r.select("image_id", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"), "n_outliers", "uniform", "localized")


@query(_TILED + "SELECT image_id, round(mu, 6) AS mu, round(sigma, 6) AS sigma, n_outliers, uniform, n_outliers >= 2 AND NOT uniform AS localized FROM tv")
def i5_summary(spark, sf_dir):
    """I5 within the image's row."""
    r = _measured(spark, sf_dir).select("image_id", images.tile_summary(C("tiles")).alias("t")).where("t is not null").select("image_id", "t.*")
    return r.withColumns({c: F.round(c, 6) for c in ("mu", "sigma")})


@query(O.chain(O.PIXELS, O.ERRORS, O.TILES, O.BOXES) + "SELECT * FROM bo")
def i6_boxes(spark, sf_dir):
    return images.flagged_regions(images.outlier_boxes(_measured(spark, sf_dir)))


@query(O.chain(O.STRIPS, O.ERRORS, O.TILES, O.BOXES) + "SELECT * FROM bo")
def i6_fitted_boxes(spark, sf_dir):
    """Boxes of pictures longer than an image is measured at: sizes and places are of the fitted picture."""
    return images.flagged_regions(images.outlier_boxes(images.measure(X.strips(spark, sf_dir))))


@query(
    O.chain(O.PIXELS, O.NOISE)
    + "SELECT image_id, round(ratio, 2) AS ratio, round(CASE WHEN ratio > 4.5 THEN least(0.85, (ratio - 3) * 0.15) ELSE 0.0 END, 2) AS edge, ratio > 4.0 AS mismatch FROM rt"
)
def i7_noise(spark, sf_dir):
    return _measured(spark, sf_dir).select("image_id", images.noise_verdict(C("noise_ratio")).alias("n")).select("image_id", "n.*")


@query(
    O.chain(
        O.PIXELS,
        """bx AS (SELECT image_id, count_if(v < 60) AS dark, count_if(v > 190) AS light FROM (
    SELECT *, CAST(floor(w * 0.65) AS INT) AS x0, CAST(floor(h * 0.15) AS INT) AS y0, CAST(floor(w * 0.32) AS INT) AS bw, CAST(floor(h * 0.55) AS INT) AS bh FROM gray)
  WHERE x >= x0 AND x < x0 + bw AND y >= y0 AND y < y0 + bh AND ((y - y0) * bw + x - x0) % 4 = 0 GROUP BY image_id)""",
        "sr AS (SELECT image_id, dark / greatest(1, dark + light) AS share FROM bx)",
    )
    + "SELECT image_id, share > 0.25 AND share < 0.75 AS has_qr, CASE WHEN share > 0.25 AND share < 0.75 THEN 0.9 ELSE 0.2 END AS confidence FROM sr"
)
def i8_qr_presence(spark, sf_dir):
    return _measured(spark, sf_dir).select("image_id", "has_qr", C("qr_confidence").alias("confidence"))


@query(_PIXELS + "SELECT image_id, CAST(least(15, floor(v / 16)) AS INT) AS bin, count(*) AS n FROM gray WHERE (y * w + x) % 4 = 0 GROUP BY 1, 2")
def i9_histogram(spark, sf_dir):
    return _measured(spark, sf_dir).select("image_id", F.posexplode("hist").alias("bin", "n")).where("n > 0")


_HISTS = """
hp AS (SELECT image_id, CAST(least(15, floor(v / 16)) AS INT) AS bin, count(*) AS n FROM gray WHERE (y * w + x) % 4 = 0 GROUP BY 1, 2),
hn AS (SELECT image_id, sqrt(sum(n * n)) AS norm FROM hp GROUP BY image_id)
"""


@query(
    O.chain(O.PIXELS, _HISTS)
    + """SELECT image_id, s AS similarity, CASE WHEN s >= 80 THEN 'HIGH_SIMILARITY' WHEN s >= 55 THEN 'MODERATE_SIMILARITY' ELSE 'LOW_SIMILARITY' END AS status FROM (
  SELECT l.image_id, CAST(floor(coalesce((SELECT sum(a.n * b.n) FROM hp a JOIN hp b ON a.bin = b.bin WHERE a.image_id = l.image_id AND b.image_id = r.image_id), 0)
    / (l.norm * r.norm) * 100 + 0.5) AS INT) AS s FROM hn l JOIN hn r ON r.image_id = l.image_id - 1)"""
)
def c3_histograms(spark, sf_dir):
    """Portraits compared by the histograms of their pixels: each picture with the one before it."""
    hists = written(images.histograms(X.pictures(spark, sf_dir)), "histograms")  # read twice
    before = hists.select((C("image_id") + 1).alias("image_id"), C("hist").alias("other"))
    r = names.compare_portraits(C("hist"), C("other"))
    return hists.join(before, "image_id").select("image_id", r.alias("r")).select("image_id", "r.*")


@query(
    O.chain(O.CASES, O.RECORDS)
    + """SELECT doc_id, s AS risk_score, CASE WHEN s >= 0.65 THEN 'HIGH' WHEN s >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS risk, CASE WHEN quality_pass THEN 0.9 ELSE 0.45 END AS confidence
  FROM (SELECT doc_id, quality_pass, round(least(0.98, 0.05 + CASE WHEN has_local THEN 0.55 WHEN uniform THEN 0.15 ELSE 0 END + CASE WHEN noise THEN 0.25 ELSE 0 END
    + CASE WHEN edge > 0.4 THEN 0.2 ELSE 0 END), 2) AS s FROM records)"""
)
def i10_forensic_risk(spark, sf_dir):
    r = images.forensic_risk(*[C(c) for c in ("has_local", "uniform", "noise", "edge", "quality_pass")])
    return _records(spark, sf_dir).select("doc_id", r.alias("r")).select("doc_id", "r.*")


@query(
    O.chain(O.CASES, O.RECORDS, O.TRUTH, O.crossed("records"), O.LAYOUT)
    + "SELECT doc_id, layout_score, layout_score >= 70 AS layout_pass, round(width * 1.0 / height, 2) AS aspect_ratio FROM laid"
)
def i11_layout(spark, sf_dir):
    return images.check_layout(_records(spark, sf_dir)).select("doc_id", "layout_score", "layout_pass", "aspect_ratio")


# --- fusion


def _scored(spark, sf_dir, said=None):
    return jobs.score(_records(spark, sf_dir), X.qr_payloads(spark, sf_dir), X.registry(spark, sf_dir), said, _now())


def _scored_with_feedback(spark, sf_dir):
    return _scored(spark, sf_dir, S.verdict_map(S.latest_verdicts(X.feedback(spark, sf_dir))))


_SCORED, _SCORED_FB = O.scored_records(), O.scored_records(True)
_POINTS = {"rules": "p_rules", "forensics": "p_forensics", "template": "p_template", "cross_check": "p_cross", "ocr": "p_ocr", "reference": "p_reference"}


@query(_SCORED + "SELECT doc_id, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in _POINTS.items()) + " FROM scored")
def f1_penalties(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", *[F.round(f"penalties.{k}", 6).alias(k) for k in _POINTS])


@query(_SCORED + "SELECT doc_id, coverage_pct FROM scored")
def f2_coverage(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", "coverage_pct")


@query(_SCORED + "SELECT doc_id, trust_score, risk, action, signals FROM scored")
def f3_verdict(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", "trust_score", "risk", "action", "signals")


@query(_SCORED + "SELECT doc_id, array_to_string(codes, ',') AS codes FROM scored")
def f4_reasons(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", F.array_join(F.transform("reasons", lambda r: r["code"]), ",").alias("codes"))


@query(_SCORED_FB + "SELECT doc_id, trust_score, risk, action, array_to_string(codes, ',') AS codes FROM scored")
def f5_override(spark, sf_dir):
    return _scored_with_feedback(spark, sf_dir).select("doc_id", "trust_score", "risk", "action", F.array_join("codes", ",").alias("codes"))


@query(
    "SELECT doc_id, layer, round(greatest(0, cap - penalty), 6) AS earned, round(penalty, 6) AS penalty FROM ("
    + _SCORED
    + "SELECT doc_id, unnest(["
    + ", ".join(f"'{k}'" for k in _POINTS)
    + "]) AS layer, unnest(["
    + ", ".join(_POINTS.values())
    + "]) AS penalty, unnest([30, 25, 15, 15, 10, CASE WHEN ref_status IN ('MATCH', 'MISMATCH') THEN 5 ELSE 0 END]) AS cap FROM scored)"
)
def f6_evidence(spark, sf_dir):
    r = fusion.evidence_table(_scored(spark, sf_dir))
    return r.select("doc_id", "layer", F.round("earned", 6).alias("earned"), F.round("penalty", 6).alias("penalty"))


@query(
    """SELECT doc_id, code, CASE
    WHEN contains(code, 'FAIL') OR contains(code, 'LOCAL_ELA') OR contains(code, 'SPLICING') OR contains(code, 'MISMATCH') THEN 'danger'
    WHEN contains(code, 'COMPRESSION') OR contains(code, 'EVIDENCE') OR contains(code, 'CONFIDENCE') OR contains(code, 'TEMPLATE') THEN 'warning'
    ELSE 'success' END AS severity, code <> 'CLEAN_VERIFICATION' AND code <> 'INSUFFICIENT_EVIDENCE' AS actionable FROM ("""
    + _SCORED
    + "SELECT doc_id, unnest(codes) AS code FROM scored)"
)
def f7_severity(spark, sf_dir):
    return fusion.graded_reasons(_scored(spark, sf_dir))


_QUEUE = "SELECT doc_id, CASE action WHEN 'ACCEPT' THEN 'accept' WHEN 'ESCALATE' THEN 'escalate' ELSE 'review' END AS status, floor(trust_score + 0.5) AS score, risk FROM scored"


@query(_SCORED + f"SELECT * FROM ({_QUEUE}) WHERE status = 'escalate' ORDER BY doc_id DESC LIMIT 100")
def f8_queue(spark, sf_dir):
    """The newest hundred escalated cases: a top-k report."""
    return fusion.review_queue(_scored(spark, sf_dir), "escalate", top=100)


@query(
    O.chain(O.CASES)
    + r"""SELECT doc_id, CASE WHEN id_number = '' THEN '----' WHEN length(c) = 12 THEN concat('XXXX XXXX ', right(c, 4)) WHEN length(c) = 10 THEN concat(left(c, 4), 'XXXX', right(c, 1))
  WHEN length(c) = 8 THEN concat(left(c, 2), 'XXXX', right(c, 2)) ELSE id_number END AS masked FROM (SELECT *, regexp_replace(id_number, '[\s-]', '', 'g') AS c FROM cases)"""
)
def f9_mask(spark, sf_dir):
    return _cases(spark, sf_dir).select("doc_id", checks.mask(C("id_number")).alias("masked"))


def _labels(scored: DataFrame) -> DataFrame:
    d = C("doc_id")
    truth = F.when(d % 53 == 0, "UNREADABLE").when((d % 11 == 0) | (d % 17 == 0) | (d % 37 == 0), "TAMPERED").otherwise("GENUINE")
    action = F.when(truth == "TAMPERED", "ESCALATE").when(truth == "GENUINE", "ACCEPT").otherwise("MANUAL_REVIEW")
    risk = F.when(truth == "TAMPERED", "HIGH").when(truth == "GENUINE", "LOW").otherwise("MEDIUM")
    return scored.select("doc_id", truth.alias("truth"), action.alias("expected_action"), risk.alias("expected_risk"))


_LABELLED = """SELECT *, CASE truth WHEN 'TAMPERED' THEN CASE WHEN risk = 'LOW' AND action = 'ACCEPT' THEN 'FN' ELSE 'TP' END
    WHEN 'GENUINE' THEN CASE WHEN risk = 'HIGH' OR action = 'ESCALATE' THEN 'FP' ELSE 'TN' END ELSE 'SAFEGUARD' END AS bucket,
  CASE truth WHEN 'TAMPERED' THEN CASE WHEN risk = 'HIGH' OR action = 'ESCALATE' THEN 'TP' ELSE 'FN' END
    WHEN 'GENUINE' THEN CASE WHEN risk = 'HIGH' OR action = 'ESCALATE' THEN 'FP' ELSE 'TN' END ELSE 'SAFEGUARD' END AS strict_bucket FROM (
  SELECT doc_id, risk, action, CASE WHEN doc_id % 53 = 0 THEN 'UNREADABLE' WHEN doc_id % 11 = 0 OR doc_id % 17 = 0 OR doc_id % 37 = 0 THEN 'TAMPERED' ELSE 'GENUINE' END AS truth FROM scored)"""


@query(_SCORED + f"SELECT doc_id, bucket, strict_bucket FROM ({_LABELLED})")
def f10_buckets(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    rows = scored.select("doc_id", "risk", "action").join(_labels(_read(spark, sf_dir, "orders").select(C("o_orderkey").alias("doc_id"))), "doc_id")
    args = (C("truth"), C("risk"), C("action"))
    return rows.select("doc_id", evaluate.bucket(*args).alias("bucket"), evaluate.bucket(*args, strict=True).alias("strict_bucket"))


def _metrics_sql(bucket: str, scored: str) -> str:
    return (
        scored
        + f""", la AS ({_LABELLED}),
n AS (SELECT count_if({bucket} = 'TP') AS tp, count_if({bucket} = 'TN') AS tn, count_if({bucket} = 'FP') AS fp, count_if({bucket} = 'FN') AS fn,
  count_if({bucket} = 'SAFEGUARD') AS safeguard, count_if(CASE truth WHEN 'TAMPERED' THEN risk = 'HIGH' OR action = 'ESCALATE' WHEN 'GENUINE' THEN risk = 'LOW' OR action = 'ACCEPT'
    ELSE risk = 'MEDIUM' OR action = 'MANUAL_REVIEW' END) AS as_expected FROM la),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 1) AS p, coalesce(tp / nullif(tp + fn, 0), 1) AS c FROM n)
SELECT tp, tn, fp, fn, safeguard, as_expected, round((tp + tn) / (tp + tn + fp + fn) * 100, 1) AS accuracy, round(p * 100, 1) AS precision, round(c * 100, 1) AS recall,
  round(coalesce(tn / nullif(tn + fp, 0), 1) * 100, 1) AS specificity, round(coalesce(2 * p * c / nullif(p + c, 0), 0) * 100, 1) AS f1,
  round(coalesce(fp / nullif(fp + tn, 0), 0) * 100, 1) AS false_positive_rate FROM r"""
    )


def _orders_labels(spark, sf_dir):
    return _labels(_read(spark, sf_dir, "orders").select(C("o_orderkey").alias("doc_id")))


@query(_metrics_sql("bucket", _SCORED.rstrip()))
def f11_metrics(spark, sf_dir):
    return jobs.evaluation(_scored(spark, sf_dir), _orders_labels(spark, sf_dir))


@query(_metrics_sql("strict_bucket", O.scored_texts().rstrip()))
def w4_strict_metrics(spark, sf_dir):
    return jobs.evaluation(_full(spark, sf_dir), _orders_labels(spark, sf_dir), strict=True)


def _evidence(spark, sf_dir):
    return _cases(spark, sf_dir).select("doc_id", F.expr(f"struct({_struct(X.EVIDENCE_SQL)}) AS e")).select("doc_id", "e.*").drop("base_confidence")


def _full(spark, sf_dir):
    return jobs.score_texts(
        _texts(spark, sf_dir), _evidence(spark, sf_dir), X.qr_payloads(spark, sf_dir), X.registry(spark, sf_dir), X.feedback(spark, sf_dir), _now()
    )


_FULL = O.scored_texts()


@query(_FULL + "SELECT doc_id, trust_score, risk, action, array_to_string(codes, ',') AS codes FROM scored")
def f12_full_score(spark, sf_dir):
    return _full(spark, sf_dir).select("doc_id", "trust_score", "risk", "action", F.array_join("codes", ",").alias("codes"))


@query(_FULL + f"SELECT * FROM ({_QUEUE}) QUALIFY row_number() OVER (PARTITION BY status ORDER BY doc_id DESC) <= 100")
def w1_review_queue(spark, sf_dir):
    """The newest hundred cases of each status: a top-k report."""
    return fusion.review_queue(_full(spark, sf_dir), top=100)


_SCANNED = O.chain(
    O.CASES, O.PIXELS, O.ERRORS, O.TILES, O.QUALITY, O.NOISE, O.SCANNED, O.TRUTH, O.crossed("records"), O.LAYOUT, O.rules("laid", "ruled"), O.scored(False)
)


_LITTLE = "printf('%02x%02x%02x%02x', ({n}) & 255, ({n}) >> 8 & 255, ({n}) >> 16 & 255, ({n}) >> 24 & 255)"
#: The files of pictures, whose rows have a multiple of four bytes: a bitmap's head, then the rows from the last to the first.
_FILES = (
    """files AS (SELECT i AS image_id, sha256(unhex(concat('424d', """
    + _LITTLE.format(n="54 + 3 * w * h")
    + """, '00000000', '36000000', '28000000', """
    + _LITTLE.format(n="w") + ", " + _LITTLE.format(n="h")
    + """, '01001800', '00000000', """
    + _LITTLE.format(n="3 * w * h")
    + """, '130b0000', '130b0000', '00000000', '00000000', string_agg(printf('%02x%02x%02x', b, g, r), '' ORDER BY y DESC, x)))) AS doc_hash
  FROM px JOIN sizes USING (i) GROUP BY i, w, h)"""
)
query(
    _SCANNED.rstrip()
    + ",\n"
    + _FILES
    + f""" SELECT doc_id, doc_hash, doc_type, name, CASE WHEN id_number = '' THEN '----' WHEN length(c) = 12 THEN concat('XXXX XXXX ', right(c, 4))
    WHEN length(c) = 10 THEN concat(left(c, 4), 'XXXX', right(c, 1)) WHEN length(c) = 8 THEN concat(left(c, 2), 'XXXX', right(c, 2)) ELSE id_number END AS masked_id, dob,
  greatest(0.0, 30 - p_rules) AS rules_points, greatest(0.0, 25 - p_forensics) AS forensics_points, greatest(0.0, 15 - p_template) AS template_points,
  greatest(0.0, 15 - p_cross) AS cross_check_points, greatest(0.0, 10 - p_ocr) AS ocr_points, r_status AS rules_status,
  CASE WHEN f >= 0.65 THEN 'HIGH' WHEN f >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS forensics_status, CASE WHEN layout_score >= 70 THEN 'PASS' ELSE 'ANOMALY' END AS template_status,
  CASE WHEN p_cross > 0 THEN 'MISMATCH' ELSE 'MATCH' END AS cross_check_status, floor(ocr_confidence * 100 + 0.5) AS ocr_percent,
  trust_score, concat_ws(' / ', risk, action) AS verdict, {O.NOW} AS issued_on, 'Operator' AS operator_role
FROM (SELECT *, regexp_replace(id_number, '[\\s-]', '', 'g') AS c, round(least(0.98, greatest(0.02, 0.05 + CASE WHEN has_local THEN 0.55 WHEN uniform THEN 0.15 ELSE 0 END
    + CASE WHEN noise THEN 0.25 ELSE 0 END + CASE WHEN edge > 0.4 THEN 0.20 ELSE 0 END)), 2) AS f FROM scored) JOIN files ON image_id = doc_id % (SELECT count(*) FROM supplier)"""
)(s5_audit)


@query(_SCANNED + "SELECT doc_id, trust_score, risk, action, array_to_string(codes, ',') AS codes FROM scored")
def w5_scan_scores(spark, sf_dir):
    """From image files to verdicts: each case with the evidence of its picture."""
    scored = _scan_scores(spark, sf_dir)
    return scored.select("doc_id", "trust_score", "risk", "action", F.array_join("codes", ",").alias("codes"))


@query(
    _SCANNED.rstrip()
    + ",\n"
    + O.BOXES.strip()
    + """ SELECT doc_id, trust_score, coalesce(regions, '') AS regions FROM scored LEFT JOIN (
  SELECT image_id, string_agg(concat_ws(',', region, x, y, w, h, printf('%.3f', risk), concat('ELA ', printf('%.2f', max_error), ' in ', region)), ';' ORDER BY box) AS regions
  FROM bo JOIN tv USING (image_id) WHERE n_outliers >= 2 AND NOT uniform GROUP BY image_id) r ON image_id = doc_id % (SELECT count(*) FROM supplier)"""
)
def i10_scan_regions(spark, sf_dir):
    """Scored cases with the flagged regions of their pictures."""
    shown = F.transform(
        "regions", lambda r: F.concat_ws(",", r["region"], r["bbox"].cast("array<string>"), F.format_number(r["risk"], 3), r["reason"])
    )
    return _scan_scores(spark, sf_dir).select("doc_id", "trust_score", F.array_join(shown, ";").alias("regions"))


def _scan_scores(spark, sf_dir):
    return _scores_of(spark, sf_dir, _scan_records(spark, sf_dir), _scan_files(spark, sf_dir))


def _scores_of(spark, sf_dir, records, folder):
    return jobs.score_scans(records, images.measure(_scans(spark, folder)), X.qr_payloads(spark, sf_dir), X.registry(spark, sf_dir), None, _now())


def _scan_records(spark, sf_dir):
    n = _read(spark, sf_dir, "supplier").count()
    return _cases(spark, sf_dir).select(
        "doc_id", C("a").alias("applicant_id"), "doc_type", "name", "id_number", "dob", "line1", "line2", (C("doc_id") % n).alias("image_id"),
        F.when(C("doc_id") % 59 == 0, 0.5).otherwise(0.94).alias("ocr_confidence"),
    )


# --- streams


@query(_FULL.replace(O.FEEDBACK.strip(), O.FEEDBACK.strip() + ", none_ AS (SELECT 1)").replace(O.scored(True).strip(), O.scored(False).strip()) + "SELECT doc_id, trust_score, risk, action FROM scored")
def st1_score_stream(spark, sf_dir):
    texts = X.ocr_text(spark, sf_dir).join(_evidence(spark, sf_dir), "doc_id")
    path = new_path(spark, "arrivals")
    texts.write.parquet(path)
    arriving = spark.readStream.schema(texts.schema).parquet(path)
    fields = jobs.flat_fields(extract(arriving, base=C("base_confidence")))
    payloads, registry = X.qr_payloads(spark, sf_dir), X.registry(spark, sf_dir)
    scored = jobs.score(fields, payloads, registry, None, _now())
    return S.appended(scored.select("doc_id", "trust_score", "risk", "action"), new_path(spark, "scored"))


@query(_SCANNED + "SELECT doc_id, trust_score, risk, action, array_to_string(codes, ',') AS codes FROM scored")
def st1_scan_stream(spark, sf_dir):
    """Image files as a stream, from pixels to verdicts."""
    arriving = tables.scan_stream(spark, _scan_files(spark, sf_dir)).select(_image_id(), "height", "width", "data")
    payloads, registry = X.qr_payloads(spark, sf_dir), X.registry(spark, sf_dir)
    scored = jobs.score_scan_stream(arriving, _scan_records(spark, sf_dir), payloads, registry, _now(), new_path(spark, "scanned"))
    return scored.select("doc_id", "trust_score", "risk", "action", F.array_join("codes", ",").alias("codes"))


def _event_stream(spark, sf_dir):
    """Events as a stream of verdicts."""
    schema = _read(spark, sf_dir, "events").schema
    most = _read(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0] or 1
    return X.as_feedback(S.stream_table(spark, f"{sf_dir}/events.parquet", schema), most)


@query(O.chain(O.FEEDBACK) + "SELECT case_id, signal_code, verdict FROM latest")
def st2_latest_verdict(spark, sf_dir):
    return S.latest_verdicts(X.feedback(spark, sf_dir)).select("case_id", "signal_code", "verdict")


@query(O.chain(O.FEEDBACK) + "SELECT case_id, signal_code, verdict FROM latest")
def st2_latest_verdict_stream(spark, sf_dir):
    return S.streamed_verdicts(_event_stream(spark, sf_dir), new_path(spark, "verdicts")).select("case_id", "signal_code", "verdict")


@query(
    O.chain(O.FEEDBACK)
    + """SELECT case_id, signal_code, arg_max(verdict, (ts, event_id)) AS verdict FROM said WHERE event_id % 50 <> 7 GROUP BY ALL"""
)
def st2_closing_stream(spark, sf_dir):
    """Verdicts with state that ends when a case is closed; every fiftieth event is a closure."""
    events = _event_stream(spark, sf_dir).withColumn("signal_code", F.when(C("event_id") % 50 == 7, S.CLOSED).otherwise(C("signal_code")))
    found = S.verdicts_until_closed(events, keep=timedelta(days=3650), late="3650 days")
    latest = S.upserted(found, ["case_id", "signal_code"], new_path(spark, "closing"))
    return latest.select("case_id", "signal_code", "verdict")


@query(_SCORED_FB + "SELECT doc_id, trust_score, risk, action FROM scored WHERE doc_id IN (SELECT case_id FROM latest)")
def st3_rescore(spark, sf_dir):
    def again(said: DataFrame) -> DataFrame:
        touched = said.select(C("case_id").alias("doc_id"))
        records = _records(spark, sf_dir).join(touched, "doc_id", "left_semi")
        scored = jobs.score(records, X.qr_payloads(spark, sf_dir), X.registry(spark, sf_dir), said, _now())
        return scored.select("doc_id", "trust_score", "risk", "action")

    return S.rescored(_event_stream(spark, sf_dir), again, new_path(spark, "rescored"))


@query("SELECT DISTINCT sha256(concat_ws('|', CAST(user_id AS STRING), event_type)) AS doc_hash FROM events")
def st4_first_uploads(spark, sf_dir):
    schema = _read(spark, sf_dir, "events").schema
    events = S.stream_table(spark, f"{sf_dir}/events.parquet", schema, files_at_once=1000)
    return S.appended(S.first_uploads(_uploads(events, "user_id", "event_type"), late="3650 days").select("doc_hash"), new_path(spark, "uploads"))


def _uploads(events: DataFrame, *parts) -> DataFrame:
    return events.select("ts", F.sha2(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]), 256).alias("doc_hash"))


@query(
    """WITH e AS (SELECT event_id, ts, sha256(concat_ws('|', CAST(event_id % 301 AS STRING), CAST(user_id AS STRING), event_type)) AS doc_hash FROM events)
SELECT DISTINCT doc_hash FROM e WHERE event_id % 3 < 2
  OR epoch_us(ts) > (SELECT epoch_us(max(ts)) // 1000 * 1000 FROM e WHERE event_id % 3 = 0) - 86400000000::BIGINT"""
)
def st4_late_uploads(spark, sf_dir):
    """Uploads that arrive in three turns, a day allowed: what is late in the third by the first turn's clock doesn't come out."""
    folder = new_path(spark, "arriving")
    events, files = _read(spark, sf_dir, "events"), []
    for turn in range(3):
        events.where(C("event_id") % 3 == turn).write.mode("append").parquet(folder)
        files.append(len(spark.read.parquet(folder).inputFiles()))
    arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files[0]).parquet(folder)
    hashed = _uploads(arriving, C("event_id") % 301, "user_id", "event_type")
    return S.appended(S.first_uploads(hashed, late="1 day").select("doc_hash"), new_path(spark, "uploads")).distinct()
