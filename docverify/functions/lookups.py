"""Fixed values that results depend on: tables, word lists, weights and texts."""

# Verhoeff's multiplication table of the dihedral group D5, row by row.
VERHOEFF_D = [
    0, 1, 2, 3, 4, 5, 6, 7, 8, 9,
    1, 2, 3, 4, 0, 6, 7, 8, 9, 5,
    2, 3, 4, 0, 1, 7, 8, 9, 5, 6,
    3, 4, 0, 1, 2, 8, 9, 5, 6, 7,
    4, 0, 1, 2, 3, 9, 5, 6, 7, 8,
    5, 9, 8, 7, 6, 0, 4, 3, 2, 1,
    6, 5, 9, 8, 7, 1, 0, 4, 3, 2,
    7, 6, 5, 9, 8, 2, 1, 0, 4, 3,
    8, 7, 6, 5, 9, 3, 2, 1, 0, 4,
    9, 8, 7, 6, 5, 4, 3, 2, 1, 0,
]
# Verhoeff's permutations, row by row.
VERHOEFF_P = [
    0, 1, 2, 3, 4, 5, 6, 7, 8, 9,
    1, 5, 7, 6, 2, 8, 3, 0, 9, 4,
    5, 8, 0, 3, 7, 9, 6, 1, 4, 2,
    8, 9, 1, 6, 0, 4, 3, 5, 2, 7,
    9, 4, 5, 3, 1, 2, 6, 8, 7, 0,
    4, 2, 8, 6, 5, 7, 3, 9, 0, 1,
    2, 7, 9, 3, 8, 0, 6, 4, 1, 5,
    7, 0, 4, 6, 9, 1, 3, 2, 5, 8,
]
# Verhoeff's inverses.
VERHOEFF_INV = [0, 4, 3, 2, 1, 5, 6, 7, 8, 9]

# Letters of a PAN's holder kind.
PAN_ENTITIES = "PCHFATBLJG"

# Words that no name line has.
STOP_WORDS = [
    "GOVERNMENT", "INDIA", "AUTHORITY", "ENROLMENT", "ENROLLMENT", "ADDRESS",
    "UNIQUE", "IDENTIFICATION", "AADHAAR", "ADHAAR", "DEPARTMENT", "INCOME",
    "TAX", "MERA", "DOWNLOAD", "SIGNATURE", "VALID", "ISSUE", "ISSUED",
    "ELECTRONICALLY", "GENERATED", "INFORMATION", "SERVICES", "MOBILE",
    "UPDATE", "VERIFY", "VERIFICATION", "SECURE", "PHONE", "APP",
    "NATIONWIDE", "CITIZENSHIP", "PROOF", "ONLINE", "OFFLINE", "SCANNING",
    "REPUBLIC", "PRINTED", "DIGITALLY", "AUTHENTICATION", "DISTRICT", "STATE",
    "PINCODE", "CARD", "NUMBER", "YEAR", "MONTH", "PEHCHAN", "IDENTITY",
    "FATHER", "HUSBAND", "NAME", "DATE", "BIRTH", "DOB", "MALE", "FEMALE",
    "PASSPORT", "TYPE", "NATIONALITY",
]

# Patterns of the fields in a document's text.
AADHAAR_WORDS = "(?i)aadhaar|uidai|unique identification|आधार"
PAN_WORDS = "(?i)income tax|permanent account|incometax|govt of india.*pan"
PASSPORT_WORDS = "(?i)republic of india.*passport|passport.*republic of india|p<ind"
MRZ_FIRST = "(?i)(P<IND[A-Z<]{39})"
MRZ_ANY = "(?i)([A-Z0-9<]{44})"
PASSPORT_NO = r"\b([A-Z][0-9]{7,8})\b"
MASKED_NO = r"[xX*]{4}\s?[xX*]{4}\s?([0-9]{4})"
AADHAAR_NO = r"\b([2-9][0-9]{3}\s?[0-9]{4}\s?[0-9]{4})\b"
PAN_NO = r"\b([A-Z]{5}[0-9]{4}[A-Z])\b"
_DATE = r"([0-3]?[0-9][/\-.][0-1]?[0-9][/\-.][12][0-9]{3})"
BIRTH_DATE = "(?i)(?:DOB|D0B|Date of Birth|जन्म)[^0-9]{0,12}" + _DATE
ANY_DATE = r"\b" + _DATE + r"\b"
EXPIRY_DATE = "(?i)(?:Date of Expiry|Expiry Date|Validity)[^0-9]{0,12}" + _DATE
MALE = r"(?i)\b(MALE|M)\b|" + "पुरुष"
FEMALE = r"(?i)\b(FEMALE|F)\b|" + "महिला"
TRANSGENDER = r"(?i)\bTRANSGENDER\b"
NAME_ANCHOR = r"(?i)\b(DOB|D0B|Date of Birth|S/O|D/O|W/O|Father|Husband|Surname|Given Name)\b"

# Width / height of a document, how far it may be off, and the corridor of the photo's corner.
TEMPLATES = [
    ("AADHAAR", 1.58, 0.18, 0.03, 0.18, 0.32, 0.68),
    ("PAN", 1.58, 0.16, 0.04, 0.16, 0.30, 0.64),
    ("PASSPORT", 1.42, 0.18, 0.03, 0.18, 0.32, 0.74),
]
TEMPLATE_FIELDS = "doc_type string, aspect double, tolerance double, x_min double, y_min double, x_max double, y_max double"

# The most each evidence layer can take from the score.
LAYER_CAPS = {"rules": 30, "forensics": 25, "template": 15, "cross_check": 15, "ocr": 10, "reference": 5}

#: Reason codes in the order they are raised, and what they mean.
REASONS = {
    "RULE_AADHAAR_CHECKSUM_FAIL": "The 12-digit number fails its check digit.",
    "RULE_PAN_FORMAT_INVALID": "The PAN has a wrong shape or holder letter.",
    "RULE_PASSPORT_INVALID_FORMAT": "The passport number has a wrong shape.",
    "RULE_PASSPORT_MRZ_CHECKSUM_FAIL": "A check digit of the machine readable zone is wrong.",
    "RULE_PASSPORT_VISIBLE_MISMATCH": "Printed fields differ from the machine readable zone.",
    "RULE_DOB_INVALID": "The birth date can't be.",
    "FORENSICS_LOCAL_ELA_SPIKE": "Compression errors stand out in one place.",
    "FORENSICS_UNIFORM_COMPRESSION": "The whole image was compressed again; no sign of forgery.",
    "FORENSICS_NOISE_DISCONTINUITY": "Noise differs between parts of the image.",
    "FORENSICS_EDGE_SPLICING": "Edges are sharper than a camera makes them.",
    "TEMPLATE_LAYOUT_ANOMALY": "The layout is not that of the document's kind.",
    "QR_OCR_DOB_MISMATCH": "Printed fields differ from the QR payload.",
    "OCR_LOW_CONFIDENCE": "The text was read with little confidence.",
    "REF_DATA_MISMATCH": "Fields differ from the trusted registry.",
    "INSUFFICIENT_EVIDENCE": "The image is too poor to decide on.",
    "CLEAN_VERIFICATION": "Every check passed.",
}
# What marks a code as danger or as warning, and codes that a reviewer gives no verdict on.
DANGER_MARKS = ["FAIL", "LOCAL_ELA", "SPLICING", "MISMATCH"]
WARNING_MARKS = ["COMPRESSION", "EVIDENCE", "CONFIDENCE", "TEMPLATE"]
NOT_ACTIONABLE = ["CLEAN_VERIFICATION", "INSUFFICIENT_EVIDENCE"]
#: Codes that a reviewer's REJECTED cancels.
OVERRIDABLE = [
    "RULE_AADHAAR_CHECKSUM_FAIL", "RULE_PAN_FORMAT_INVALID", "FORENSICS_LOCAL_ELA_SPIKE",
    "FORENSICS_NOISE_DISCONTINUITY", "FORENSICS_EDGE_SPLICING",
]
