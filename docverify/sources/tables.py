"""Readers and writers with explicit schemas."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASES = "doc_id long, applicant_id long, doc_type string, name string, id_number string, dob string, expiry string, line1 string, line2 string"
_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
FEEDBACK = "event_id long, ts timestamp_ntz, case_id long, signal_code string, verdict string"


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    """Images decoded on the executors: origin, height, width, data (BGR); files that aren't images are left out."""
    image = spark.read.format("image").option("dropInvalid", True).load(path)
    return image.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")


_IMAGE = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def scan_stream(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    """S1 as a stream: images as their files arrive, decoded as read_scans does."""
    image = spark.readStream.format("image").schema(_IMAGE).option("dropInvalid", True).option("maxFilesPerTrigger", files_at_once).load(path)
    return image.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")


def scan_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(origin, doc_hash): S2 of the files themselves, whatever they hold."""
    return fingerprint(read_bytes(spark, path), "content").select(F.col("path").alias("origin"), "doc_hash")


def bitmap(height: int, width: int, data: bytes) -> bytes:
    """A BMP file of 24-bit pixels (blue, green, red, row by row from the top)."""
    rows = np.frombuffer(data, np.uint8).reshape(height, width * 3)[::-1]
    body = np.pad(rows, ((0, 0), (0, -width * 3 % 4))).tobytes()
    head = struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def write_scans(images: DataFrame, folder: str) -> int:
    """Write images (image_id, height, width, data) as files <image_id>.bmp; returns how many.

    Tasks write their own images; a second attempt writes the same files again.
    """

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        store.create_dir(base, recursive=True)
        for batch in batches:
            for image_id, h, w, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_output_stream(f"{base}/{image_id}.bmp", compression=None) as out:
                    out.write(bitmap(h, w, data))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows = images.select("image_id", "height", "width", "data")
    return rows.mapInArrow(files, "n long").agg(F.sum("n")).first()[0] or 0


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def fingerprint(df: DataFrame, column: str, name: str = "doc_hash") -> DataFrame:
    """Df with the SHA-256 of a column's bytes; null stays null."""
    return df.withColumn(name, F.sha2(F.col(column).cast("binary"), 256))


def read_table(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """S3: a table of cases, registry records or payloads with a fixed schema (parquet or json)."""
    return spark.read.schema(schema).format(kind).load(path)


def write_feedback(feedback: DataFrame, path: str) -> None:
    """reviewers' verdicts as JSON, a folder a day."""
    feedback.withColumn("day", F.to_date("ts")).write.partitionBy("day").option("timestampNTZFormat", _MICROS).json(path)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEEDBACK).option("timestampNTZFormat", _MICROS).json(path).drop("day")
