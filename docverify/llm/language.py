"""Language by compression: the language whose dictionary packs a text best.

Each language has a raw-content Zstandard dictionary cut from a bounded sample
of its training texts. A text's letters are compressed in pieces with every
dictionary; the language with the smallest sum is its prediction, rejected
where the runner-up comes close.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a language's dictionary, and the texts that it is cut from, about.
DICTIONARY_BYTES = 96 << 10
SAMPLE_TEXTS = 400
#: Characters of a training text in a dictionary at most, so that no text fills it alone.
SAMPLE_CHARS = 4_000
#: Bytes of all dictionaries together: with many languages each gets an equal, smaller share.
ALL_BYTES = 19 << 20
#: Languages whose counts may be broadcast.
FEW_LANGUAGES = 50_000
#: Bytes compressed at a time: a text's own beginning shouldn't stand in for the dictionary.
PIECE = 1 << 11
LEVEL = 7
#: Bytes saved over the runner-up, as a share of the smallest sum, below which a prediction is rejected.
MARGIN = 0.01
UNKNOWN = "und"


def split_of(doc_id: Column) -> Column:
    """Remainder of the id's checksum; 1 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def letters(text: Column) -> Column:
    """Lower-case letters with their marks, all else as single spaces; empty without a letter."""
    kept = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{M}]+", " "))
    return F.when(text.rlike(r"\p{L}"), kept).otherwise("")


def dictionaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A dictionary for each language of the training rows, the commonest language first.

    Cut from about SAMPLE_TEXTS distinct texts a language, chosen by a hash of
    the text, and of a longer text from SAMPLE_CHARS characters at a place that
    the hash gives. What comes to the driver is bounded by ALL_BYTES, however
    many languages there are.
    """
    known = docs.where(
        F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.coalesce(split_of(F.col(id_col)) != 1, F.lit(False))
    ).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = known.groupBy("lang").count()
    order = [r["lang"] for r in counts.orderBy(F.desc("count"), "lang").collect()]
    # a row a language: broadcast where they are few enough, so that texts stay where they are until they are drawn
    counts = F.broadcast(counts) if len(order) <= FEW_LANGUAGES else counts
    most = max(1 << 10, min(DICTIONARY_BYTES, ALL_BYTES // max(1, len(order))))
    share = F.least(F.lit(1.0), F.lit(2.0 * SAMPLE_TEXTS) / F.col("count"))
    hashed = F.xxhash64("text")
    inside = F.pmod("hash", F.greatest(F.lit(1), F.length("letters") - SAMPLE_CHARS + 1)).cast("int")
    upto = Window.partitionBy("lang").orderBy("hash", "text")
    drawn = (
        known.join(counts, "lang")
        .where(F.pmod(hashed, F.lit(1 << 32)) < share * (1 << 32))
        .select("lang", hashed.alias("hash"), letters(F.col("text")).alias("letters"))
        .select("lang", "hash", F.substring("letters", inside + 1, F.lit(SAMPLE_CHARS)).alias("text"))
        .where(F.length("text") > 1)
        .distinct()
        .withColumn("place", F.row_number().over(upto))
        .withColumn("before", F.coalesce(F.sum(F.octet_length("text")).over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .where((F.col("place") <= SAMPLE_TEXTS) & (F.col("before") < most))
    )
    found: dict[str, bytes] = {}
    for r in drawn.orderBy("lang", F.desc("place")).collect():
        found[r["lang"]] = (found.get(r["lang"], b"") + b" " + r["text"].strip().encode())[-most:]
    least = min(map(len, found.values()), default=0)
    # equal sizes: no language gains from having seen more; the commonest first, which wins ties
    return {k: found[k][-max(least, most // 8) :] for k in order if k in found}


class Classifier:
    def __init__(self, contents: dict[str, bytes]) -> None:
        self.languages = list(contents)
        self.packers = []
        for content in contents.values():
            packed = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            packed.precompute_compress(level=LEVEL)
            self.packers.append(zstandard.ZstdCompressor(dict_data=packed, write_content_size=False).compress)

    def sizes(self, text: str) -> list[int]:
        data = text.encode("utf-8")
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        return [sum(len(pack(p)) for p in pieces) for pack in self.packers]

    def predict(self, text: str) -> tuple[str, float, bool]:
        """(language, score, rejected) of a text of letters and spaces."""
        text = text.strip()
        if not text or not self.packers:
            return UNKNOWN, 0.0, True
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        best = sizes[order[0]]
        score = 1 / sum(math.exp(-(s - best)) for s in sizes)
        close = len(order) > 1 and sizes[order[1]] - best < max(1, MARGIN * best)
        return self.languages[order[0]], score, close


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, rejected.

    Texts that are null or have no letter (marks alone are none), and all texts
    where no language could be learned, get `und` with score 0. rejected says
    that the runner-up came within MARGIN; lang_pred is then the closest
    language all the same, on a tie the commoner one. A text is compressed
    whole, in pieces, however long. Null ids are never training rows and aren't
    held out. Repeated rows come back repeated and count once in a dictionary;
    an empty table gives no rows; other columns are ignored.
    """
    contents = dictionaries(docs, id_col, text_col, lang_col)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(contents)
        for batch in batches:
            found = [model.predict(t) for t in batch.column(2).to_pylist()]
            lang, score, close = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    source = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(split_of(F.col(id_col)) == 1, F.lit(False)).alias("held_out"),
        letters(F.col(text_col)).alias("letters"),
    )
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(predicted, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
