"""Identity tables that Spark derives from orders, customer, events and embeddings.

The base text is evaluated alike by Spark and by the SQL that checks it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docverify.functions import checks, mrz
from docverify.plans.storage import written

AS_OF = "2024-01-31"

#: Where a dict, derived tables are written to the shared folder once a session and read from there: for timing what is done with them.
STORE: dict | None = None


def derived(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def table(spark: SparkSession, sf_dir: str) -> DataFrame:
        if STORE is None:
            return f(spark, sf_dir)
        if (f.__name__, sf_dir) not in STORE:
            files = max(16, 2 * spark.sparkContext.defaultParallelism)
            STORE[f.__name__, sf_dir] = written(f(spark, sf_dir).repartition(files), f"derived-{f.__name__}")
        return STORE[f.__name__, sf_dir]

    return table

#: Documents with what their applicant's truth is; planted faults go by doc_id.
BASE_SQL = """
WITH applicant AS (
  SELECT c_custkey AS a, c_nationkey AS nk,
    split_part('ANSH,ROHIT,VIKRAM,RAJESH,PRIYA,ANITA,KAVYA,MEERA,ARJUN,DEEPAK,SUNITA,NEHA', ',', CAST(c_custkey % 12 + 1 AS INT)) AS given,
    split_part('GUPTA,PATEL,SHARMA,MEHTA,VERMA,IYER,KHAN,REDDY,DAS,JOSHI,NAIR,BOSE', ',', CAST(CAST(floor(c_custkey / 12) AS BIGINT) % 12 + 1 AS INT)) AS surname,
    DATE '1950-01-01' + CAST(c_custkey * 37 % 18000 AS INT) AS birth,
    concat(CAST(2 + c_custkey % 8 AS STRING), lpad(CAST((c_custkey * 7919 + 12345) % 10000000000 AS STRING), 10, '0')) AS uid11,
    concat(chr(CAST(65 + c_custkey % 26 AS INT)), lpad(CAST(c_custkey * 101 % 10000000 AS STRING), 7, '0')) AS passport_no
  FROM {customer}),
t AS (SELECT *,
    concat(lpad(CAST(day(birth) AS STRING), 2, '0'), '/', lpad(CAST(month(birth) AS STRING), 2, '0'), '/', CAST(year(birth) AS STRING)) AS true_dob,
    concat(lpad(CAST(month(birth) AS STRING), 2, '0'), '/', lpad(CAST(day(birth) AS STRING), 2, '0'), '/', CAST(year(birth) AS STRING)) AS swapped_dob,
    concat(substr(CAST(year(birth) AS STRING), 3, 2), lpad(CAST(month(birth) AS STRING), 2, '0'), lpad(CAST(day(birth) AS STRING), 2, '0')) AS short_birth,
    concat('AAAP', substr(surname, 1, 1), lpad(CAST(a % 10000 AS STRING), 4, '0'), chr(CAST(65 + a % 26 AS INT))) AS pan
  FROM applicant),
d AS (
  SELECT o_orderkey AS doc_id, t.*,
    CASE o_orderkey % 3 WHEN 0 THEN 'AADHAAR' WHEN 1 THEN 'PAN' ELSE 'PASSPORT' END AS doc_type,
    CASE WHEN o_orderkey % 7 = 0 THEN concat(substr(given, 1, 1), '. ', surname) ELSE concat(given, ' ', surname) END AS name,
    CASE WHEN o_orderkey % 23 = 0 THEN ''
         WHEN o_orderkey % 3 = 0 AND o_orderkey % 29 = 0 THEN concat('XXXX XXXX ', substr(uid11, 8, 4))
         WHEN o_orderkey % 3 = 0 THEN uid11
         WHEN o_orderkey % 3 = 1 AND o_orderkey % 19 = 0 THEN concat('AAAZ', substr(pan, 5))
         WHEN o_orderkey % 3 = 1 THEN pan ELSE passport_no END AS id_body,
    CASE WHEN o_orderkey % 11 = 0 THEN '01/01/2000' WHEN o_orderkey % 13 = 0 THEN swapped_dob ELSE true_dob END AS dob,
    DATE '2021-01-01' + CAST(o_orderkey * 13 % 5000 AS INT) AS until
  FROM {orders} JOIN t ON o_custkey = a)
SELECT *,
  concat(lpad(CAST(day(until) AS STRING), 2, '0'), '/', lpad(CAST(month(until) AS STRING), 2, '0'), '/', CAST(year(until) AS STRING)) AS expiry,
  concat(substr(CAST(year(until) AS STRING), 3, 2), lpad(CAST(month(until) AS STRING), 2, '0'), lpad(CAST(day(until) AS STRING), 2, '0')) AS short_expiry,
  CASE WHEN doc_type = 'PASSPORT' THEN rpad(concat('P<IND', surname, '<<', given), 44, '<') ELSE '' END AS line1
FROM d
"""

#: Evidence of the image layers by integer arithmetic.
EVIDENCE_SQL = """
  doc_id % 37 = 0 AS has_local, doc_id % 41 = 0 AS uniform, (10 + doc_id % 30) / 10.0 AS tile_std,
  doc_id % 43 = 0 AS noise, CASE WHEN doc_id % 47 = 0 THEN 0.75 ELSE 0.05 END AS edge,
  doc_id % 53 <> 0 AS quality_pass, CASE WHEN doc_id % 61 = 0 THEN 1000 ELSE 1580 END AS width, 1000 AS height,
  CASE WHEN doc_id % 67 = 0 THEN 900 ELSE 150 END AS photo_x, 300 AS photo_y,
  CASE WHEN doc_id % 71 = 0 THEN 500 ELSE 800 END AS mrz_y, CASE WHEN doc_id % 59 = 0 THEN 0.5 ELSE 0.94 END AS base_confidence
"""


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@derived
def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: what it shows, and its applicant's truth."""
    base = spark.sql(BASE_SQL, orders=_read(spark, sf_dir, "orders"), customer=_read(spark, sf_dir, "customer"))
    digit = (checks.verhoeff_digit(F.col("id_body")).cast("int") + F.when(F.col("doc_id") % 17 == 0, 1).otherwise(0)) % 10
    number = F.when(
        (F.col("doc_type") == "AADHAAR") & (F.length("id_body") == 11), F.concat("id_body", digit.cast("string"))
    ).otherwise(F.col("id_body"))
    a, b, c = F.concat("passport_no", F.lit("<")), F.col("short_birth"), F.col("short_expiry")
    head = F.concat(a, mrz.check_digit(a))
    birth, until = F.concat(b, mrz.check_digit(b)), F.concat(c, mrz.check_digit(c))
    tail = F.lit("<" * 14 + "0")
    composite = mrz.check_digit(F.concat(head, birth, until, tail)).cast("int") + F.when(F.col("doc_id") % 31 == 0, 1).otherwise(0)
    line2 = F.concat(head, F.lit("IND"), birth, F.lit("M"), until, tail, (composite % 10).cast("string"))
    return base.withColumn("id_number", number).withColumn(
        "line2", F.when(F.col("doc_type") == "PASSPORT", line2).otherwise("")
    )


@derived
def ocr_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, raw_text, base_confidence): the cases as text."""
    c = cases(spark, sf_dir)
    dob = F.when(F.col("doc_id") % 5 == 0, F.regexp_replace("dob", "/", "-")).otherwise(F.col("dob"))
    sex = F.when(F.col("doc_id") % 2 == 0, "FEMALE").otherwise("MALE")
    join = lambda *parts: F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    text = (
        F.when(
            F.col("doc_type") == "AADHAAR",
            join(
                "Government of India", "Unique Identification Authority of India", F.col("name"), F.concat(F.lit("DOB: "), dob),
                sex, F.col("id_number"),
            ),
        )
        .when(
            F.col("doc_type") == "PAN",
            join("INCOME TAX DEPARTMENT", F.col("name"), "Date of Birth", dob, "Permanent Account Number", F.col("id_number")),
        )
        .otherwise(
            join(
                "REPUBLIC OF INDIA PASSPORT", "Surname and given names", F.concat(F.lit("  "), F.col("name"), F.lit("\r")),
                F.concat(F.lit("Date of Birth "), dob), F.concat(F.lit("Date of Expiry "), F.col("expiry")), F.col("id_number"),
                F.col("line1"), F.col("line2"),
            )
        )
    )
    base = F.when(F.col("doc_id") % 59 == 0, 0.5).otherwise(0.94)
    return c.select("doc_id", text.alias("raw_text"), base.alias("base_confidence"))


@derived
def qr_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clean_id, payload): XML, or JSON for every seventh applicant; none for every fifth."""
    base = _truth(spark, sf_dir)
    xml = F.concat(
        F.lit('<PrintLetterBarcodeData uid="'), "uid", F.lit('" name="'), "full_name", F.lit('" dob="'), "true_dob", F.lit('" gender="M"/>')
    )
    json = F.to_json(F.struct("uid", F.col("full_name").alias("name"), F.col("true_dob").alias("dob"), F.lit("M").alias("gender")))
    return base.select(F.col("uid").alias("clean_id"), F.when(F.col("a") % 7 == 0, json).otherwise(xml).alias("payload"))


@derived
def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clean_id, reg_name, reg_dob): one row a number, of the applicant with the smallest key."""
    base = _truth(spark, sf_dir)
    numbers = F.explode(F.array("uid", "pan", "passport_no")).alias("clean_id")
    rows = base.select(numbers, "a", "full_name", "true_dob")
    return rows.groupBy("clean_id").agg(
        F.min_by("full_name", "a").alias("reg_name"), F.min_by("true_dob", "a").alias("reg_dob")
    )


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _read(spark, sf_dir, "customer")
    one = customer.selectExpr("c_custkey AS o_custkey", "c_custkey AS o_orderkey")
    base = spark.sql(BASE_SQL, orders=one, customer=customer).where("a % 5 <> 0")
    return base.withColumn("uid", F.concat("uid11", checks.verhoeff_digit(F.col("uid11")))).withColumn(
        "full_name", F.concat_ws(" ", "given", "surname")
    )


@derived
def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, case_id, signal_code, verdict) of reviewers, from events."""
    most = _read(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0] or 1
    return as_feedback(_read(spark, sf_dir, "events"), most)


def as_feedback(events: DataFrame, most: int) -> DataFrame:
    codes = ["FORENSICS_LOCAL_ELA_SPIKE", "FORENSICS_NOISE_DISCONTINUITY", "RULE_AADHAAR_CHECKSUM_FAIL", "RULE_PAN_FORMAT_INVALID"]
    return events.select(
        "event_id", "ts", (F.col("event_id") % most).alias("case_id"),
        F.get(F.array(*map(F.lit, codes)), F.length("event_type") % 4).alias("signal_code"),
        F.when(F.col("value") > 100, "CONFIRMED").otherwise("REJECTED").alias("verdict"),
    )


def _picture_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the pictures, dealt out: a key is some bytes to Spark, which would draw a million pictures in one task."""
    keys = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long"))
    return keys.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Width and height of a picture: every tenth is large enough to be judged.
WIDTH_SQL, HEIGHT_SQL = "CASE WHEN i % 10 = 0 THEN 400 ELSE 120 END", "CASE WHEN i % 10 = 0 THEN 256 ELSE 72 END"
LARGEST = (400, 256)
#: A picture's pixel in colour k (0 blue, 1 green, 2 red): two bright tiles for every ninth, a smooth
#: picture with a busy patch of two tiles for one in four, a busy picture else.
PIXEL_SQL = """
  CASE WHEN i % 9 = 0 AND x BETWEEN 24 AND 71 AND y BETWEEN 24 AND 47 THEN 255
       WHEN i % 4 = 2 AND x BETWEEN 24 AND 71 AND y BETWEEN 24 + 24 * (i // 4 % 2) AND 47 + 24 * (i // 4 % 2) THEN (37 * x + 59 * y + 101 * k) % 256
       WHEN i % 4 = 2 THEN ((x + y) // 4 + 13 * i + 40 * k) % 200
       ELSE ((3 + i % 5) * x + (5 + i % 7) * y + 13 * i + 40 * k) % 200 END
"""


@derived
def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, height, width, data): a picture of each supplier, by the formula of PIXEL_SQL."""
    import numpy as np
    import pyarrow as pa

    def drawn(batches):
        for batch in batches:
            for i in (i for i in batch.column(0).to_pylist() if i is not None):
                w, h = LARGEST if i % 10 == 0 else (120, 72)
                y, x, k = (n.astype(np.int32) for n in np.ogrid[0:h, 0:w, 0:3])
                across = (x >= 24) & (x <= 71)
                if i % 4 == 2:
                    low = 24 + 24 * (i // 4 % 2)
                    patch = across & (y >= low) & (y <= low + 23)
                    p = np.where(patch, (37 * x + 59 * y + 101 * k) % 256, ((x + y) // 4 + 13 * i % 200 + 40 * k) % 200)
                else:
                    p = ((3 + i % 5) * x + (5 + i % 7) * y + 13 * i % 200 + 40 * k) % 200
                p = np.where(across & (y >= 24) & (y <= 47), 255, p) if i % 9 == 0 else p
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i], pa.int64()), pa.array([h], pa.int32()), pa.array([w], pa.int32()),
                        pa.array([p.astype(np.uint8).tobytes()], pa.binary()),
                    ],
                    ["image_id", "height", "width", "data"],
                )

    return _picture_keys(spark, sf_dir).mapInArrow(drawn, "image_id long, height int, width int, data binary")


#: Strips that are longer than an image is measured at, lying and standing by turns.
STRIP = (1000, 28)
STRIP_SQL = """
  CASE WHEN (CASE WHEN i % 2 = 0 THEN x ELSE y END) // 60 % 15 = i % 15 AND i % 3 < 2 THEN (37 * x + 59 * y + 101 * k) % 256
       ELSE ((x + y) // 4 + 13 * i % 200 + 40 * k) % 200 END
"""


@derived
def strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, height, width, data): a long picture of each supplier, by the formula of STRIP_SQL."""
    import numpy as np
    import pyarrow as pa

    def drawn(batches):
        for batch in batches:
            for i in (i for i in batch.column(0).to_pylist() if i is not None):
                w, h = STRIP if i % 2 == 0 else STRIP[::-1]
                y, x, k = (n.astype(np.int32) for n in np.ogrid[0:h, 0:w, 0:3])
                busy = ((x if i % 2 == 0 else y) // 60 % 15 == i % 15) & (i % 3 < 2)
                p = np.where(busy, (37 * x + 59 * y + 101 * k) % 256, ((x + y) // 4 + 13 * i % 200 + 40 * k) % 200)
                columns = [[i], [h], [w], [p.astype(np.uint8).tobytes()]]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["image_id", "height", "width", "data"])

    return _picture_keys(spark, sf_dir).mapInArrow(drawn, "image_id long, height int, width int, data binary")


@derived
def portraits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, embedding): the given vectors, and of every tenth a copy that differs a little, under an id of its own."""
    given = _read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    near = given.where("vec_id % 10 = 3").select(
        (-1 - F.col("vec_id")).alias("vec_id"), F.transform("embedding", lambda x, j: x * (1 + F.when(j % 2 == 0, 0.05).otherwise(-0.05))).alias("embedding")
    )
    return given.unionByName(near)
