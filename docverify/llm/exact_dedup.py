"""Exact duplicates by content sort, with DataFrame operations only.

Normalised texts are dealt by sampled splitters (repartitionByRange) on their
first characters and, where many share those, a checksum: splitters stay short
however long the texts are. Each range is sorted externally so that equal
texts are adjacent, and the window over equal texts compares neighbours in full. A text that many rows share is
first split by a salt; the winners of its splits meet in a second, small sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docverify.plans.storage import written

#: Deleted before comparing.
BLANKS = r"[\x20\x09-\x0D]+"
#: Characters of a text in the splitters.
HEAD = 24
#: A text with more rows than this, and than rows / MAX_HOT, is split.
HOT_ROWS = 256
#: At most so many texts can be hot, so their table may be broadcast.
MAX_HOT = 20_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def _runs(docs: DataFrame, id_col: str, text_col: str, hot_rows: int, carry: bool) -> DataFrame:
    """Every row at its place in its run of equal texts; with carry, the first of each run with its input row.

    A hot text has a run for each salt (salt >= 0), any other text one (salt -1).
    """
    text = F.coalesce(F.col("row")[text_col], F.lit("")) if carry else None
    source = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *([F.struct(*docs.columns).alias("row")] if carry else []),
    )
    keyed = source.withColumn("norm", normalised(F.col("text"))).withColumn("tag", F.xxhash64("norm"))
    least_hot = max(hot_rows, -(-docs.count() // MAX_HOT))
    hot = (
        keyed.groupBy("tag")
        .count()
        .where(F.col("count") > least_hot)
        .select("tag", F.ceil(F.col("count") / least_hot).alias("splits"))
    )
    salted = (
        keyed.join(F.broadcast(hot), "tag", "left")  # at most MAX_HOT rows, by least_hot
        .withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("splits")), F.lit(-1).cast("long")))
        .select(
            "doc_id", F.substring("norm", 1, HEAD).alias("head"), "tag", "salt", F.char_length("text").alias("points"),
            "row" if carry else "norm",
        )
    )
    dealt = salted.repartitionByRange("head", "tag", "salt")
    if carry:  # a row travels with its own text only
        dealt = dealt.withColumn("norm", normalised(text))
    run = Window.partitionBy("head", "tag", "norm", "salt")
    first = run.orderBy(F.desc("points"), F.asc_nulls_last("doc_id"))
    placed = (
        dealt.withColumn("place", F.row_number().over(first))
        .withColumn("run_keep", F.first("doc_id").over(first))
        .withColumn("run_points", F.first("points").over(first))
        .withColumn("run_size", F.count(F.lit(1)).over(run))
        .withColumn("text_sha256", F.sha2("norm", 256))
        .withColumn("hot_norm", F.when((F.col("place") == 1) & (F.col("salt") >= 0), F.col("norm")))
        .drop("norm", "head", "tag", "points")
    )
    return written(placed.where("place = 1") if carry else placed, "exact-runs")


def _merged(runs: DataFrame) -> DataFrame:
    """The winner of each hot text, at each of its runs: the second sort, one row a run."""
    whole = Window.partitionBy("head", "hot_norm")
    best = whole.orderBy(F.desc("run_points"), F.asc_nulls_last("run_keep"), "salt")
    return (
        runs.where("salt >= 0 and place = 1")
        .withColumn("head", F.substring("hot_norm", 1, HEAD))
        .repartitionByRange("head")
        .withColumn("won", F.row_number().over(best) == 1)
        .withColumn("keep_id", F.first("run_keep").over(best))
        .withColumn("group_size", F.sum("run_size").over(whole))
        .select("text_sha256", "salt", "won", "keep_id", "group_size")
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their texts are, after BLANKS are deleted; a null text
    counts as empty. The row with the most code points in its original text
    stays, on a tie the one with the smallest id (null ids last); of rows that
    repeat an id and a text one stays. keep_id is null only where a group has
    no id. Other columns are ignored. An empty table gives an empty result.
    """
    runs = _runs(docs, id_col, text_col, hot_rows, carry=False)
    cold = runs.where("salt < 0").select(
        "doc_id", F.col("run_keep").alias("keep_id"), F.col("run_size").alias("group_size"),
        (F.col("place") == 1).alias("kept"), "text_sha256",
    )
    warm = (
        runs.where("salt >= 0")
        .select("doc_id", "place", "salt", "text_sha256")
        .join(_merged(runs), ["text_sha256", "salt"])
        .select("doc_id", "keep_id", "group_size", (F.col("won") & (F.col("place") == 1)).alias("kept"), "text_sha256")
    )
    return cold.unionByName(warm)


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows of docs that exact_duplicates keeps, with all their columns."""
    runs = _runs(docs, id_col, text_col, hot_rows, carry=True)
    cold = runs.where("salt < 0").select("row.*")
    won = _merged(runs).where("won").select("text_sha256", "salt")
    return cold.unionByName(runs.where("salt >= 0").join(won, ["text_sha256", "salt"], "left_semi").select("row.*"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
r AS (
  SELECT doc_id, norm, row_number() OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS place,
    first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
