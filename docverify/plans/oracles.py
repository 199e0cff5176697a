"""The SQL that checks the queries, for DuckDB: parts are common tables, each query selects from the last."""

from __future__ import annotations

from docverify.functions import lookups as L
from docverify.operators.images import JPEG_CHROMA, JPEG_LUMA
from docverify.sources.fixtures import AS_OF, BASE_SQL, EVIDENCE_SQL, HEIGHT_SQL, LARGEST, PIXEL_SQL, STRIP, STRIP_SQL, WIDTH_SQL

NOW = f"DATE '{AS_OF}'"
_D, _P, _INV = (str(v) for v in (L.VERHOEFF_D, L.VERHOEFF_P, L.VERHOEFF_INV))


def fold(e: str, n: int, shift: int) -> str:
    digit = f"TRY_CAST(substr(reverse({e}), CAST(i + 1 AS INT), 1) AS INT)"
    places = f"list_transform(range(0, {n}), lambda i: {_P}[CAST(((i + {shift}) % 8) * 10 + {digit} + 1 AS INT)])"
    return f"list_reduce(list_prepend(0, {places}), lambda c, x: {_D}[CAST(c * 10 + x + 1 AS INT)])"


def verhoeff(e: str) -> str:
    return f"CASE WHEN length({e}) = 11 THEN CAST({_INV}[{fold(e, 11, 1)} + 1] AS STRING) END"


def icao(e: str) -> str:
    ch = f"upper(substr({e}, CAST(i + 1 AS INT), 1))"
    value = f"CASE WHEN {ch} BETWEEN '0' AND '9' THEN ascii({ch}) - 48 WHEN {ch} BETWEEN 'A' AND 'Z' THEN ascii({ch}) - 55 ELSE 0 END"
    total = f"list_sum(list_transform(range(0, length({e})), lambda i: ({value}) * [7, 3, 1][CAST(i % 3 + 1 AS INT)]))"
    return f"CAST(CAST({total} AS BIGINT) % 10 AS STRING)"


def short_date(e: str, expiry: bool) -> str:
    yy = f"TRY_CAST(substr({e}, 1, 2) AS INT)"
    year = (
        f"CASE WHEN {yy} >= 14 THEN 2000 + {yy} ELSE 2100 + {yy} END" if expiry else f"CASE WHEN {yy} <= 24 THEN 2000 + {yy} ELSE 1900 + {yy} END"
    )
    return f"CASE WHEN regexp_full_match({e}, '[0-9]{{6}}') THEN concat(substr({e}, 5, 2), '/', substr({e}, 3, 2), '/', CAST({year} AS STRING)) END"


def words(e: str, n: int) -> str:
    return f"list_filter(string_split_regex(trim(upper(coalesce({e}, ''))), '\\s+'), lambda w: length(w) > {n})"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


CASES = f"""
base AS ({BASE_SQL.format(orders="orders", customer="customer")}),
m AS (SELECT *, concat(passport_no, '<') AS h FROM base),
m2 AS (SELECT *, concat(h, {icao("h")}) AS h1, concat(short_birth, {icao("short_birth")}) AS b1,
  concat(short_expiry, {icao("short_expiry")}) AS u1, concat(repeat('<', 14), '0') AS tail FROM m),
m3 AS (SELECT *, concat(h1, b1, u1, tail) AS whole FROM m2),
cases AS (SELECT *,
  CASE WHEN doc_type = 'AADHAAR' AND length(id_body) = 11
    THEN concat(id_body, CAST((CAST({verhoeff("id_body")} AS INT) + CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END) % 10 AS STRING))
    ELSE id_body END AS id_number,
  CASE WHEN doc_type = 'PASSPORT' THEN concat(h1, 'IND', b1, 'M', u1, tail,
    CAST((CAST({icao("whole")} AS INT) + CASE WHEN doc_id % 31 = 0 THEN 1 ELSE 0 END) % 10 AS STRING)) ELSE '' END AS line2
  FROM m3)
"""

_DMY, _YMD = r"^([0-3]?[0-9])[/\-.]([0-1]?[0-9])[/\-.]([0-9]{4})$", r"^([0-9]{4})[/\-.]([0-1]?[0-9])[/\-.]([0-3]?[0-9])$"


def _part(a: int, b: int) -> str:
    return (
        f"TRY_CAST(CASE WHEN regexp_matches(trim(dob), '{_DMY}') THEN regexp_extract(trim(dob), '{_DMY}', {a}) "
        f"WHEN regexp_matches(trim(dob), '{_YMD}') THEN regexp_extract(trim(dob), '{_YMD}', {b}) END AS INT)"
    )


def rules(source: str, out: str) -> str:
    """Tables up to `out`: source with every rule's results and the composite."""
    checks = {
        "cd_number": ("substr(b, 1, 9)", "substr(b, 10, 1)"), "cd_birth": ("substr(b, 14, 6)", "substr(b, 20, 1)"),
        "cd_expiry": ("substr(b, 22, 6)", "substr(b, 28, 1)"),
        "cd_whole": ("concat(substr(b, 1, 10), substr(b, 14, 7), substr(b, 22, 22))", "substr(b, 44, 1)"),
    }
    digits = ", ".join(f"{icao(f)} = {d} AS {n}" for n, (f, d) in checks.items())
    return rf"""
{out}_1 AS (SELECT *, regexp_replace(id_number, '[\s-]', '', 'g') AS clean,
    regexp_replace(upper(trim(id_number)), '\s', '', 'g') AS tight, {_part(1, 3)} AS dd, {_part(2, 2)} AS mm, {_part(3, 1)} AS yy,
    rpad(regexp_replace(upper(line1), '\s', '', 'g'), 44, '<') AS a, rpad(regexp_replace(upper(line2), '\s', '', 'g'), 44, '<') AS b,
    line1 <> '' AND line2 <> '' AS zoned, string_split_regex(trim(name), '\s+') AS parts FROM {source}),
{out}_2 AS (SELECT *,
    CASE WHEN id_number = '' THEN 'MISSING'
      WHEN regexp_full_match(trim(id_number), '[xX*]{{4}}\s?[xX*]{{4}}\s?[0-9]{{4}}') THEN 'MASKED'
      WHEN length(clean) <> 12 THEN 'LENGTH' WHEN NOT regexp_full_match(clean, '[0-9]{{12}}') THEN 'NOT_DIGITS'
      WHEN substr(clean, 1, 1) IN ('0', '1') THEN 'FIRST_DIGIT'
      WHEN {fold("clean", 12, 0)} = 0 THEN 'OK' ELSE 'CHECKSUM' END AS a_reason,
    CASE WHEN id_number = '' THEN 'MISSING' WHEN NOT regexp_full_match(tight, '[A-Z]{{5}}[0-9]{{4}}[A-Z]') THEN 'SHAPE'
      WHEN NOT contains('{L.PAN_ENTITIES}', substr(tight, 4, 1)) THEN 'ENTITY' ELSE 'OK' END AS p_reason,
    CASE WHEN len(parts) > 1 THEN parts[-1] END AS surname_,
    CASE WHEN id_number = '' THEN 'MISSING' WHEN regexp_full_match(tight, '[A-Z][0-9]{{7,8}}') THEN 'OK' ELSE 'SHAPE' END AS n_reason,
    CASE WHEN mm = 2 THEN CASE WHEN (yy % 4 = 0 AND yy % 100 <> 0) OR yy % 400 = 0 THEN 29 ELSE 28 END
      WHEN mm IN (4, 6, 9, 11) THEN 30 ELSE 31 END AS days,
    2024 - yy - CASE WHEN 131 >= mm * 100 + dd THEN 0 ELSE 1 END AS age_,
    CASE WHEN zoned THEN {short_date("substr(b, 14, 6)", False)} END AS z_dob,
    CASE WHEN zoned THEN {short_date("substr(b, 22, 6)", True)} END AS z_expiry,
    CASE WHEN zoned THEN replace(substr(b, 1, 9), '<', '') END AS z_number,
    CASE WHEN zoned THEN trim(replace(split_part(substr(a, 6, 39), '<<', 1), '<', ' ')) END AS z_surname,
    CASE WHEN zoned THEN trim(replace(split_part(substr(a, 6, 39), '<<', 2), '<', ' ')) END AS z_given, {digits} FROM {out}_1),
{out}_3 AS (SELECT *,
    CASE WHEN dob = '' THEN 'MISSING' WHEN yy IS NULL THEN 'FORMAT' WHEN mm NOT BETWEEN 1 AND 12 THEN 'MONTH'
      WHEN dd NOT BETWEEN 1 AND days THEN 'DAY' WHEN yy * 10000 + mm * 100 + dd > 20240131 THEN 'FUTURE'
      WHEN age_ > 120 THEN 'AGE' ELSE 'OK' END AS b_reason,
    zoned AND cd_number AND cd_birth AND cd_expiry AND cd_whole AS z_valid, trim(concat_ws(' ', z_given, z_surname)) AS z_name,
    coalesce(CAST(make_date(CAST(split_part(z_expiry, '/', 3) AS INT), 1, 1) + to_months(CAST(split_part(z_expiry, '/', 2) AS INT) - 1)
      + to_days(CAST(split_part(z_expiry, '/', 1) AS INT) - 1) AS DATE) <= {NOW}, false) AS z_expired FROM {out}_2),
{out}_4 AS (SELECT *,
    list_filter([CASE WHEN id_number <> '' AND tight_(id_number) <> z_number THEN 'PASSPORT_NUMBER' END,
      CASE WHEN dob <> '' AND z_dob <> '' AND trim(dob) <> z_dob THEN 'DOB' END,
      CASE WHEN name <> '' AND z_name <> '' AND NOT list_has_any({words("name", 1)}, {words("z_name", 1)}) THEN 'NAME' END,
      CASE WHEN z_expired THEN 'EXPIRED' END], lambda x: x IS NOT NULL) AS differs,
    contains(doc_type, 'PASSPORT') OR regexp_full_match(trim(id_number), '[A-Z][0-9]{{7,8}}') AS as_passport,
    contains(doc_type, 'AADHAAR') OR length(regexp_replace(id_number, '[^0-9]', '', 'g')) = 12 OR regexp_matches(id_number, '^[xX*]') AS as_aadhaar,
    contains(doc_type, 'PAN') OR regexp_full_match(trim(id_number), '(?i)[A-Z]{{5}}[0-9]{{4}}[A-Z]') AS as_pan, dob <> '' AS with_dob FROM {out}_3),
{out}_5 AS (SELECT *, as_passport AND zoned AS with_zone,
    CASE WHEN NOT z_valid THEN 'UNAVAILABLE' WHEN len(differs) > 0 THEN 'MISMATCH' ELSE 'MATCH' END AS v_status,
    CASE WHEN NOT z_valid THEN 25 ELSE least(35, 20 * len(differs)) END AS v_deduction,
    CAST(as_passport AS INT) + CAST(as_aadhaar AS INT) + CAST(as_pan AS INT) + CAST(with_dob AS INT) + CAST(as_passport AND zoned AS INT) AS n_checked,
    CAST(as_passport AND n_reason = 'OK' AS INT) + CAST(as_aadhaar AND a_reason IN ('OK', 'MASKED') AS INT) + CAST(as_pan AND p_reason = 'OK' AS INT)
      + CAST(with_dob AND b_reason = 'OK' AS INT) + CAST(as_passport AND zoned AND z_valid AS INT) AS n_passed FROM {out}_4),
{out} AS (SELECT *, CASE WHEN n_checked = 0 THEN 'UNKNOWN' WHEN n_passed < n_checked OR (with_zone AND v_status <> 'MATCH') THEN 'FAIL'
    ELSE 'PASS' END AS r_status FROM {out}_5)
""".replace("tight_(id_number)", "upper(regexp_replace(id_number, '\\s', '', 'g'))")


TEXTS = r"""
texts AS (SELECT doc_id, CASE WHEN doc_id % 59 = 0 THEN 0.5 ELSE 0.94 END AS base_confidence,
  CASE doc_type WHEN 'AADHAAR' THEN concat_ws(chr(10), 'Government of India', 'Unique Identification Authority of India', name,
      concat('DOB: ', shown), CASE WHEN doc_id % 2 = 0 THEN 'FEMALE' ELSE 'MALE' END, id_number)
    WHEN 'PAN' THEN concat_ws(chr(10), 'INCOME TAX DEPARTMENT', name, 'Date of Birth', shown, 'Permanent Account Number', id_number)
    ELSE concat_ws(chr(10), 'REPUBLIC OF INDIA PASSPORT', 'Surname and given names', concat('  ', name), concat('Date of Birth ', shown),
      concat('Date of Expiry ', expiry), id_number, line1, line2) END AS raw
  FROM (SELECT *, CASE WHEN doc_id % 5 = 0 THEN replace(dob, '/', '-') ELSE dob END AS shown FROM cases))
"""

_PLAUSIBLE = (
    "len(list_filter(string_split(trim(regexp_replace(regexp_replace(q, '[^A-Za-z\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: length(w) > 1)) BETWEEN 2 AND 4"
    " AND NOT list_has_any(list_filter(string_split(upper(trim(regexp_replace(regexp_replace(q, '[^A-Za-z\\s]', ' ', 'g'), '\\s+', ' ', 'g'))), ' '), lambda w: length(w) > 1), "
    + str(L.STOP_WORDS)
    + ") AND length(trim(regexp_replace(regexp_replace(q, '[^A-Za-z\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) BETWEEN 5 AND 35"
    " AND len(list_filter(string_split(trim(regexp_replace(regexp_replace(q, '[^A-Za-z\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: length(w) > 1 AND NOT regexp_matches(w, '(?i)[aeiou]'))) = 0"
)


def _find(pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract(raw, {quoted(pattern)}, {group}), '')"


EXTRACTED = rf"""
x1 AS (SELECT *, list_filter(list_transform(string_split(raw, chr(10)), lambda l: trim(l)), lambda l: l <> '') AS lines,
    {_find(L.MRZ_FIRST)} AS mrz1, {_find(L.PASSPORT_NO)} AS pass_no, {_find(L.MASKED_NO)} AS mask_no,
    regexp_replace({_find(L.AADHAAR_NO)}, '\s', '', 'g') AS uid_no, {_find(L.PAN_NO)} AS pan_no,
    CASE WHEN regexp_matches(raw, {quoted(L.PASSPORT_WORDS)}) THEN 'PASSPORT' WHEN regexp_matches(raw, {quoted(L.AADHAAR_WORDS)}) THEN 'AADHAAR'
      WHEN regexp_matches(raw, {quoted(L.PAN_WORDS)}) THEN 'PAN' ELSE 'UNKNOWN' END AS by_words,
    coalesce(regexp_replace(coalesce({_find(L.BIRTH_DATE)}, {_find(L.ANY_DATE)}), '[\-. ]', '/', 'g'), '') AS dob,
    coalesce(regexp_replace({_find(L.EXPIRY_DATE)}, '[\-. ]', '/', 'g'), '') AS expiry,
    CASE WHEN regexp_matches(raw, {quoted(L.MALE)}) THEN 'MALE' WHEN regexp_matches(raw, {quoted(L.FEMALE)}) THEN 'FEMALE'
      WHEN regexp_matches(raw, {quoted(L.TRANSGENDER)}) THEN 'TRANSGENDER' ELSE '' END AS gender FROM texts),
x2 AS (SELECT *, CASE WHEN mrz1 IS NOT NULL THEN 'PASSPORT' ELSE by_words END AS kind,
    coalesce(regexp_extract(substr(raw, strpos(raw, mrz1) + length(mrz1)), '(?i)([A-Z0-9<]{{44}})', 1), '') AS mrz2,
    list_concat(flatten(list_transform(range(1, len(lines) + 1), lambda i: CASE WHEN regexp_matches(lines[i], {quoted(L.NAME_ANCHOR)})
      THEN [CASE WHEN i > 2 THEN lines[i - 2] END, CASE WHEN i > 1 THEN lines[i - 1] END, lines[i + 1], lines[i + 2]] ELSE [] END)), lines) AS candidates
  FROM x1),
x3 AS (SELECT *, CASE WHEN kind = 'PASSPORT' THEN pass_no END AS own_pass,
    coalesce(list_filter(candidates, lambda q: q IS NOT NULL AND {_PLAUSIBLE})[1], '') AS name FROM x2),
x4 AS (SELECT *,
    CASE WHEN own_pass IS NOT NULL THEN kind WHEN mask_no IS NOT NULL OR uid_no IS NOT NULL THEN 'AADHAAR' WHEN pan_no IS NOT NULL THEN 'PAN' ELSE kind END AS doc_type,
    coalesce(own_pass, 'XXXX XXXX ' || mask_no, substr(uid_no, 1, 4) || ' ' || substr(uid_no, 5, 4) || ' ' || substr(uid_no, 9, 4), pan_no, '') AS id_number,
    own_pass IS NULL AND mask_no IS NOT NULL AS is_masked FROM x3),
extracted AS (SELECT *, coalesce(mrz1, '') AS line1, CASE WHEN mrz1 IS NULL THEN '' ELSE mrz2 END AS line2,
    round(CASE WHEN id_number = '' AND dob = '' AND name = '' THEN 0.30 WHEN id_number <> '' AND dob <> '' AND name <> ''
      THEN greatest(0.85, base_confidence) ELSE base_confidence END, 2) AS ocr_confidence,
    id_number <> '' OR dob <> '' OR name <> '' AS is_detected FROM x4)
"""

TRUTH = f"""
truth AS (SELECT *, concat(uid11, {verhoeff("uid11")}) AS uid, concat_ws(' ', given, surname) AS full_name FROM (
  {BASE_SQL.format(orders="(SELECT c_custkey AS o_custkey, c_custkey AS o_orderkey FROM customer)", customer="customer")}) WHERE a % 5 <> 0),
qr AS (SELECT uid AS clean_id, uid, full_name AS q_name, true_dob AS q_dob FROM truth),
registry AS (SELECT clean_id, arg_min(full_name, a) AS reg_name, arg_min(true_dob, a) AS reg_dob FROM (
  SELECT a, full_name, true_dob, unnest([uid, pan, passport_no]) AS clean_id FROM truth) GROUP BY clean_id)
"""

FEEDBACK = """
said AS (SELECT event_id, ts, event_id % (SELECT max(o_orderkey) FROM orders) AS case_id,
  ['FORENSICS_LOCAL_ELA_SPIKE', 'FORENSICS_NOISE_DISCONTINUITY', 'RULE_AADHAAR_CHECKSUM_FAIL', 'RULE_PAN_FORMAT_INVALID'][length(event_type) % 4 + 1] AS signal_code,
  CASE WHEN value > 100 THEN 'CONFIRMED' ELSE 'REJECTED' END AS verdict FROM events),
latest AS (SELECT case_id, signal_code, arg_max(verdict, (ts, event_id)) AS verdict FROM said GROUP BY case_id, signal_code)
"""


def crossed(source: str) -> str:
    """Tables up to `crossed`: source with QR and registry statuses."""
    last = lambda e: f"right(regexp_replace({e}, '[^0-9]', '', 'g'), 4)"
    return rf"""
c1 AS (SELECT s.*, q.uid, q.q_name, q.q_dob, r.reg_name, r.reg_dob, r.clean_id IS NOT NULL AS known FROM {source} s
  LEFT JOIN qr q ON nullif(regexp_replace(s.id_number, '[^0-9]', '', 'g'), '') = q.clean_id
  LEFT JOIN registry r ON nullif(upper(regexp_replace(s.id_number, '[\s-]', '', 'g')), '') = r.clean_id),
c2 AS (SELECT *, list_filter([CASE WHEN dob <> '' AND trim(dob) <> q_dob THEN 'DOB' END,
    CASE WHEN name <> '' AND NOT list_has_any({words("name", 2)}, {words("q_name", 2)}) THEN 'NAME' END,
    CASE WHEN {last("id_number")} <> '' AND {last("id_number")} <> {last("uid")} THEN 'NUMBER' END], lambda x: x IS NOT NULL) AS q_differs,
    list_has_any({words("name", 2)}, {words("reg_name", 2)}) AS same_name, dob = '' OR trim(dob) = reg_dob AS same_dob FROM c1),
crossed AS (SELECT *, CASE WHEN doc_type <> 'AADHAAR' THEN 'MATCH' WHEN uid IS NULL THEN 'UNAVAILABLE' WHEN len(q_differs) > 0 THEN 'MISMATCH' ELSE 'MATCH' END AS qr_status,
    CASE WHEN NOT known THEN 'UNAVAILABLE' WHEN same_name AND same_dob THEN 'MATCH' ELSE 'MISMATCH' END AS ref_status FROM c2)
"""


LAYOUT = """
laid AS (SELECT *, 100 - CASE WHEN abs(CAST(width AS DOUBLE) / height - CASE doc_type WHEN 'PASSPORT' THEN 1.42e0 ELSE 1.58e0 END)
      > CASE doc_type WHEN 'PAN' THEN 0.16e0 ELSE 0.18e0 END THEN 20 ELSE 0 END
    - CASE WHEN CAST(photo_x AS DOUBLE) / width > CASE doc_type WHEN 'PAN' THEN 0.30e0 ELSE 0.32e0 END + 0.10e0 THEN 25 ELSE 0 END
    - CASE WHEN doc_type = 'PASSPORT' AND CAST(mrz_y AS DOUBLE) / height < 0.70e0 THEN 30 ELSE 0 END AS layout_score FROM crossed)
"""

_SAID = {"RULE_AADHAAR_CHECKSUM_FAIL": "f_aadhaar", "RULE_PAN_FORMAT_INVALID": "f_pan", "FORENSICS_LOCAL_ELA_SPIKE": "f_local", "FORENSICS_NOISE_DISCONTINUITY": "f_noise"}


def scored(with_feedback: bool) -> str:
    """Tables up to `scored` from `ruled` (with layout, statuses and evidence)."""
    said = ", ".join(f"max(CASE WHEN signal_code = '{k}' THEN verdict END) AS {v}" for k, v in _SAID.items())
    table = (
        f"fb AS (SELECT case_id, {said} FROM latest GROUP BY case_id),"
        if with_feedback
        else "fb AS (SELECT CAST(NULL AS BIGINT) AS case_id, " + ", ".join(f"CAST(NULL AS STRING) AS {v}" for v in _SAID.values()) + "),"
    )
    live = lambda c: f"coalesce({c}, '') <> 'REJECTED'"
    codes = {
        "RULE_AADHAAR_CHECKSUM_FAIL": f"as_aadhaar AND a_reason NOT IN ('OK', 'MASKED') AND {live('f_aadhaar')}",
        "RULE_PAN_FORMAT_INVALID": f"as_pan AND p_reason <> 'OK' AND {live('f_pan')}",
        "RULE_PASSPORT_INVALID_FORMAT": "as_passport AND n_reason <> 'OK'",
        "RULE_PASSPORT_MRZ_CHECKSUM_FAIL": "with_zone AND NOT z_valid", "RULE_PASSPORT_VISIBLE_MISMATCH": "with_zone AND v_status <> 'MATCH'",
        "RULE_DOB_INVALID": "with_dob AND b_reason <> 'OK'", "FORENSICS_LOCAL_ELA_SPIKE": f"has_local AND {live('f_local')}",
        "FORENSICS_UNIFORM_COMPRESSION": "NOT has_local AND uniform", "FORENSICS_NOISE_DISCONTINUITY": f"noise AND {live('f_noise')}",
        "FORENSICS_EDGE_SPLICING": "edge > 0.4", "TEMPLATE_LAYOUT_ANOMALY": "layout_score < 70", "QR_OCR_DOB_MISMATCH": "qr_status = 'MISMATCH'",
        "OCR_LOW_CONFIDENCE": "ocr_confidence < 0.60", "REF_DATA_MISMATCH": "ref_status = 'MISMATCH'",
    }
    quiet = ("RULE_DOB_INVALID", "FORENSICS_UNIFORM_COMPRESSION", "TEMPLATE_LAYOUT_ANOMALY", "OCR_LOW_CONFIDENCE")
    listed = ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in codes.items())
    signals = " + ".join(f"CAST({c} AS INT)" for k, c in codes.items() if k not in quiet)
    cost = lambda k, v: f"CASE WHEN {codes[k]} THEN {v} ELSE 0 END"
    return f"""
{table}
s1 AS (SELECT r.*, fb.* EXCLUDE (case_id) FROM ruled r LEFT JOIN fb ON r.doc_id = fb.case_id),
s2 AS (SELECT *, list_filter([{listed}], lambda x: x IS NOT NULL) AS raised, {signals} AS signals,
    CAST(least(30, {cost("RULE_AADHAAR_CHECKSUM_FAIL", 30)} + {cost("RULE_PAN_FORMAT_INVALID", 25)} + {cost("RULE_PASSPORT_INVALID_FORMAT", 25)}
      + {cost("RULE_PASSPORT_MRZ_CHECKSUM_FAIL", 30)} + {cost("RULE_PASSPORT_VISIBLE_MISMATCH", 30)} + {cost("RULE_DOB_INVALID", 15)}) AS DOUBLE) AS p_rules,
    CAST(least(25, {cost("FORENSICS_LOCAL_ELA_SPIKE", "least(20, tile_std * 4 + 10)")} + {cost("FORENSICS_UNIFORM_COMPRESSION", 3)}
      + {cost("FORENSICS_NOISE_DISCONTINUITY", 10)} + {cost("FORENSICS_EDGE_SPLICING", 10)}) AS DOUBLE) AS p_forensics,
    CAST({cost("TEMPLATE_LAYOUT_ANOMALY", "15 * (1 - layout_score / 100.0)")} AS DOUBLE) AS p_template,
    CAST({cost("QR_OCR_DOB_MISMATCH", 15)} AS DOUBLE) AS p_cross, CAST({cost("OCR_LOW_CONFIDENCE", "10 * (1 - ocr_confidence)")} AS DOUBLE) AS p_ocr,
    CAST({cost("REF_DATA_MISMATCH", 5)} AS DOUBLE) AS p_reference,
    95 + CASE WHEN ref_status IN ('MATCH', 'MISMATCH') THEN 5 ELSE 0 END AS coverage_pct FROM s1),
s3 AS (SELECT *, greatest(0, 100 - (p_rules + p_forensics + p_template + p_cross + p_ocr + p_reference)) AS points FROM s2),
scored AS (SELECT *, round(CASE WHEN NOT quality_pass THEN least(points, 65) ELSE points END, 1) AS trust_score,
    CASE WHEN NOT quality_pass THEN 'MEDIUM' WHEN points >= 85 AND signals = 0 THEN 'LOW' WHEN points < 55 OR signals >= 2 THEN 'HIGH' ELSE 'MEDIUM' END AS risk,
    CASE WHEN NOT quality_pass THEN 'MANUAL_REVIEW' WHEN points >= 85 AND signals = 0 THEN 'ACCEPT' WHEN points < 55 OR signals >= 2 THEN 'ESCALATE' ELSE 'MANUAL_REVIEW' END AS action,
    list_concat(raised, CASE WHEN NOT quality_pass THEN ['INSUFFICIENT_EVIDENCE'] WHEN points >= 85 AND signals = 0 AND len(raised) = 0 THEN ['CLEAN_VERIFICATION'] ELSE [] END) AS codes
  FROM s3)
"""


def chain(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(p.strip().rstrip(",") for p in parts) + "\n"


RECORDS = f"records AS (SELECT doc_id, applicant_id_ AS applicant_id, doc_type, name, id_number, dob, expiry, line1, line2, base_confidence AS ocr_confidence, has_local, uniform, tile_std, noise, edge, quality_pass, width, height, photo_x, photo_y, mrz_y FROM (SELECT *, a AS applicant_id_, {EVIDENCE_SQL} FROM cases))"
FULL = f"full_text AS (SELECT e.doc_id, e.doc_type, e.name, e.id_number, e.dob, e.line1, e.line2, e.ocr_confidence, v.* EXCLUDE (doc_id, base_confidence) FROM extracted e JOIN (SELECT doc_id, {EVIDENCE_SQL} FROM cases) v USING (doc_id))"


def scored_records(with_feedback: bool = False) -> str:
    parts = [CASES, RECORDS, TRUTH, crossed("records"), LAYOUT, rules("laid", "ruled")]
    return chain(*parts, *([FEEDBACK] if with_feedback else []), scored(with_feedback))


def scored_texts() -> str:
    return chain(CASES, TEXTS, EXTRACTED, FULL, TRUTH, crossed("full_text"), LAYOUT, rules("laid", "ruled"), FEEDBACK, scored(True))


PIXELS = f"""
sizes AS (SELECT i, {WIDTH_SQL} AS w, {HEIGHT_SQL} AS h FROM (SELECT s_suppkey AS i FROM supplier)),
spots AS (SELECT i, w, h, y, x FROM sizes, range({LARGEST[1]}) ty(y), range({LARGEST[0]}) tx(x) WHERE y < h AND x < w),
colours AS (SELECT i, y, x, k, {PIXEL_SQL} AS p FROM spots, range(3) tk(k)),
px AS (SELECT i, y, x, max(CASE WHEN k = 0 THEN p END) AS b, max(CASE WHEN k = 1 THEN p END) AS g, max(CASE WHEN k = 2 THEN p END) AS r FROM colours GROUP BY i, y, x),
gray AS (SELECT i AS image_id, w, h, y, x, 0.299e0 * r + 0.587e0 * g + 0.114e0 * b AS v FROM px JOIN sizes USING (i))
"""

#: I3 from the standard's formulas: colours to luma and chroma, cosine transform of 8 x 8 blocks, quantisation at 90, and back.
_TABLES = {k: [max(1, (t * 20 + 50) // 100) for t in table] for k, table in (("y", JPEG_LUMA), ("c", JPEG_CHROMA))}
ERRORS = f"""
cosines AS (SELECT u, t, cos((2 * t + 1) * u * pi() / 16) / 2 * CASE WHEN u = 0 THEN 1 / sqrt(2e0) ELSE 1 END AS c FROM range(8) tu(u), range(8) tt(t)),
wide AS (SELECT i, y, x, b, g, r FROM px UNION ALL SELECT i, y, x + d, b, g, r FROM px JOIN sizes USING (i), range(1, 8) t(d) WHERE x = w - 1 AND x + d < (w + 7) // 8 * 8),
whole AS (SELECT * FROM wide UNION ALL SELECT i, y + d, x, b, g, r FROM wide JOIN sizes USING (i), range(1, 8) t(d) WHERE y = h - 1 AND y + d < (h + 7) // 8 * 8),
planes AS (SELECT i, k, y // 8 AS brow, x // 8 AS bcol, y % 8 AS yy, x % 8 AS xx,
    CASE k WHEN 0 THEN 0.299e0 * r + 0.587e0 * g + 0.114e0 * b - 128 WHEN 1 THEN -0.168736e0 * r - 0.331264e0 * g + 0.5e0 * b
      ELSE 0.5e0 * r - 0.418688e0 * g - 0.081312e0 * b END AS v FROM whole, range(3) tk(k)),
f1 AS (SELECT i, k, brow, bcol, yy, u AS ux, sum(v * c) AS v FROM planes JOIN cosines ON t = xx GROUP BY ALL),
f2 AS (SELECT i, k, brow, bcol, u AS uy, ux, sum(v * c) AS v FROM f1 JOIN cosines ON t = yy GROUP BY ALL),
coded AS (SELECT i, k, brow, bcol, uy, ux, round_even(round(v, 6) / q, 0) * q AS v FROM (SELECT *,
    CASE WHEN k = 0 THEN {_TABLES["y"]}[uy * 8 + ux + 1] ELSE {_TABLES["c"]}[uy * 8 + ux + 1] END AS q FROM f2)),
b1 AS (SELECT i, k, brow, bcol, uy, t AS xx, sum(v * c) AS v FROM coded JOIN cosines ON u = ux GROUP BY ALL),
b2 AS (SELECT i, k, brow * 8 + t AS y, bcol * 8 + xx AS x, sum(v * c) AS v FROM b1 JOIN cosines ON u = uy GROUP BY ALL),
back AS (SELECT i, y, x, max(CASE WHEN k = 0 THEN v END) + 128 AS l, max(CASE WHEN k = 1 THEN v END) AS cb, max(CASE WHEN k = 2 THEN v END) AS cr FROM b2 GROUP BY ALL),
errors AS (SELECT i AS image_id, y, x, (abs(b - least(255, greatest(0, round_even(round(l + 1.772e0 * cb, 6), 0))))
    + abs(g - least(255, greatest(0, round_even(round(l - 0.344136e0 * cb - 0.714136e0 * cr, 6), 0))))
    + abs(r - least(255, greatest(0, round_even(round(l + 1.402e0 * cr, 6), 0))))) / 3 AS v FROM px JOIN back USING (i, y, x))
"""
TILES = """
tl AS (SELECT image_id, x // 24 AS tx, y // 24 AS ty, avg(e.v) AS mean FROM errors e JOIN sizes ON i = image_id WHERE x < w // 24 * 24 AND y < h // 24 * 24 GROUP BY ALL),
ou AS (SELECT *, avg(mean) OVER (PARTITION BY image_id) AS mu, stddev_pop(mean) OVER (PARTITION BY image_id) AS sigma FROM tl),
ov AS (SELECT *, mean > mu + 2.3 * sigma AND mean > 4.5 AS is_outlier FROM ou),
tv AS (SELECT image_id, max(mu) AS mu, max(sigma) AS sigma, count_if(is_outlier) AS n_outliers, max(mu) > 6.0 AND max(sigma) < 2.5 AS uniform FROM ov GROUP BY image_id)
"""
#: A box a step, of the first tile left and all within two tiles of it.
BOXES = """
bl0 AS (SELECT image_id, any_value(w) AS w, any_value(h) AS h, list({'tx': tx, 'ty': ty, 'm': mean} ORDER BY ty, tx) AS rest FROM ov JOIN sizes ON i = image_id WHERE is_outlier GROUP BY image_id),
bx AS (SELECT image_id, w, h, -1 AS box, [] :: STRUCT(tx BIGINT, ty BIGINT, m DOUBLE)[] AS own, rest FROM bl0
  UNION ALL SELECT image_id, w, h, box + 1, list_filter(rest, lambda t: abs(t.tx - rest[1].tx) <= 2 AND abs(t.ty - rest[1].ty) <= 2),
    list_filter(rest, lambda t: abs(t.tx - rest[1].tx) > 2 OR abs(t.ty - rest[1].ty) > 2) FROM bx WHERE len(rest) > 0),
be AS (SELECT image_id, w AS iw, h AS ih, box, unnest(own) AS t FROM bx),
bp AS (SELECT image_id, iw, ih, box, greatest(0, min(t.tx) * 24 - 6) AS x, greatest(0, min(t.ty) * 24 - 6) AS y,
    (max(t.tx) - min(t.tx) + 1) * 24 + 12 AS fw, (max(t.ty) - min(t.ty) + 1) * 24 + 12 AS fh, round(max(t.m), 2) AS max_error FROM be GROUP BY image_id, iw, ih, box),
bo AS (SELECT image_id, box, x, y, least(iw - x, fw) AS w, least(ih - y, fh) AS h, max_error,
    CASE WHEN x / iw < 0.40 AND y / ih < 0.70 AND least(ih - y, fh) > 40 THEN 'PORTRAIT' WHEN y / ih > 0.40 AND y / ih < 0.75 THEN 'DETAILS' WHEN y / ih >= 0.75 THEN 'ID_NUMBER' ELSE 'TEXT' END AS region,
    round(least(0.95, max_error / 20 + 0.4), 3) AS risk FROM bp)
"""
#: Strips as they are after fitting: bilinear between the centres of pixels, in whole numbers; sizes and px as PIXELS has them.
STRIPS = f"""
strip AS (SELECT s_suppkey AS i, CASE WHEN s_suppkey % 2 = 0 THEN {STRIP[0]} ELSE {STRIP[1]} END AS w0, CASE WHEN s_suppkey % 2 = 0 THEN {STRIP[1]} ELSE {STRIP[0]} END AS h0 FROM supplier),
sizes AS (SELECT i, w0, h0, (2 * w0 * 900 + {STRIP[0]}) // (2 * {STRIP[0]}) AS w, (2 * h0 * 900 + {STRIP[0]}) // (2 * {STRIP[0]}) AS h FROM strip),
drawn AS (SELECT i, y, x, k, {STRIP_SQL} AS p FROM strip, range({STRIP[0]}) ty(y), range({STRIP[0]}) tx(x), range(3) tk(k) WHERE y < h0 AND x < w0),
across AS (SELECT i, nx, q.x, q.f FROM (SELECT i, w0, w, nx, greatest((2 * nx + 1) * w0 - w, 0) AS spot FROM sizes, range(900) t(nx) WHERE nx < w),
  LATERAL (SELECT unnest([{{'x': spot // (2 * w), 'f': 2 * w - spot % (2 * w)}}, {{'x': least(spot // (2 * w) + 1, w0 - 1), 'f': spot % (2 * w)}}]) AS q)),
down AS (SELECT i, ny, q.y, q.f FROM (SELECT i, h0, h, ny, greatest((2 * ny + 1) * h0 - h, 0) AS spot FROM sizes, range(900) t(ny) WHERE ny < h),
  LATERAL (SELECT unnest([{{'y': spot // (2 * h), 'f': 2 * h - spot % (2 * h)}}, {{'y': least(spot // (2 * h) + 1, h0 - 1), 'f': spot % (2 * h)}}]) AS q)),
low AS (SELECT d.i, d.ny, x, k, sum(p * d.f) AS p FROM drawn JOIN down d ON d.i = drawn.i AND d.y = drawn.y GROUP BY ALL),
fit AS (SELECT a.i, ny AS y, a.nx AS x, k, CAST((sum(p * a.f) + 2 * any_value(w) * any_value(h)) // (4 * any_value(w) * any_value(h)) AS BIGINT) AS p
  FROM low JOIN across a ON a.i = low.i AND a.x = low.x JOIN sizes ON sizes.i = a.i GROUP BY ALL),
px AS (SELECT i, y, x, max(CASE WHEN k = 0 THEN p END) AS b, max(CASE WHEN k = 1 THEN p END) AS g, max(CASE WHEN k = 2 THEN p END) AS r FROM fit GROUP BY i, y, x)
"""
QUALITY = """
lp AS (SELECT image_id, w, h, y, x, lag(v) OVER (PARTITION BY image_id, x ORDER BY y) + lead(v) OVER (PARTITION BY image_id, x ORDER BY y)
  + lag(v) OVER (PARTITION BY image_id, y ORDER BY x) + lead(v) OVER (PARTITION BY image_id, y ORDER BY x) - 4 * v AS l FROM gray),
bl AS (SELECT image_id, w, h, avg(l * l) - avg(l) * avg(l) AS lap FROM lp WHERE y BETWEEN 1 AND h - 2 AND x BETWEEN 1 AND w - 2 GROUP BY image_id, w, h),
qu AS (SELECT image_id, min(q) / max(q) AS light FROM (SELECT image_id, y >= h // 2, x >= w // 2, avg(v) AS q FROM gray GROUP BY 1, 2, 3) GROUP BY image_id),
ql AS (SELECT image_id, w, h, lap, light, w < 400 OR h < 250 AS low, lap < 65 AS blurry, light < 0.45 AS uneven FROM bl JOIN qu USING (image_id))
"""
NOISE = """
zn AS (SELECT image_id, avg(v * v) - avg(v) * avg(v) AS s FROM gray WHERE y < h // 3 * 3 AND x < w // 3 * 3 GROUP BY image_id, y // (h // 3), x // (w // 3)),
rt AS (SELECT image_id, CASE WHEN min(s) > 0 THEN max(s) / min(s) ELSE 1.0 END AS ratio FROM zn GROUP BY image_id)
"""
#: Cases with the evidence of their applicant's picture: what RECORDS has, but measured.
SCANNED = """
records AS (SELECT doc_id, a AS applicant_id, doc_type, name, id_number, dob, expiry, line1, line2, CASE WHEN doc_id % 59 = 0 THEN 0.5 ELSE 0.94 END AS ocr_confidence,
  n_outliers >= 2 AND NOT uniform AS has_local, uniform, sigma AS tile_std, ratio > 4.0 AS noise, round(CASE WHEN ratio > 4.5 THEN least(0.85, (ratio - 3) * 0.15) ELSE 0.0 END, 2) AS edge,
  NOT low AND NOT blurry AND NOT uneven AS quality_pass, ql.w AS width, ql.h AS height, floor(ql.w * 0.05) AS photo_x, floor(ql.h * 0.2) AS photo_y, floor(ql.h * 0.8) AS mrz_y
  FROM cases JOIN tv ON tv.image_id = doc_id % (SELECT count(*) FROM supplier) JOIN rt USING (image_id) JOIN ql USING (image_id))
"""
