"""Byte-level BPE over a global shuffle of distinct words.

Documents are split into pre-tokens at their positions. Within a block of a
few MB of text each distinct pre-token gets a number, and a document keeps the
numbers in order: one packed row a block instead of one row a position. The
distinct pre-tokens of all blocks are dealt by their own hash, so that equal
ones of all blocks meet and are encoded once; the ids go back to the blocks,
where each document is put together again by position. Decoding joins ids with
the token-byte table, which is as large as the vocabulary and no larger.
"""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docverify.llm.memory import release
from docverify.llm.pretokens import Numbers, splitter
from docverify.plans.storage import written

#: Characters of text in a block, except that a document isn't divided.
BLOCK_CHARS = 4_000_000
#: Documents a word bucket stands for: buckets grow with the table.
DOCS_PER_BUCKET = 1_000
MIN_BUCKETS = 64

@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


def pack(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit integers as compressed byte planes."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _pack_words(words: list[str], numbers: np.ndarray) -> bytes:
    encoded = [w.encode("utf-8") for w in words]
    head = pack(np.diff(numbers, prepend=0))
    sizes = pack(np.fromiter(map(len, encoded), np.uint32, len(encoded)))
    body = zstandard.ZstdCompressor(level=3).compress(b"".join(encoded))
    return struct.pack("<II", len(head), len(sizes)) + head + sizes + body


def _unpack_words(data: bytes) -> tuple[bytes, list[bytes]]:
    """The packed numbers, as they are, and the words."""
    n, m = struct.unpack_from("<II", data)
    sizes, body = unpack(data[8 + n : 8 + n + m]), zstandard.ZstdDecompressor().decompress(data[8 + n + m :])
    ends = np.cumsum(sizes).tolist()
    return data[8 : 8 + n], [body[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def gathered(flat: np.ndarray, ends: np.ndarray, place: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of documents, one after another, and where each document's begin, with the end of the last.

    flat[ends[k] : ends[k + 1]] are the ids of pre-token k; place has the
    pre-tokens of the documents in order, `many` of them each.
    """
    start, size = ends[place], ends[place + 1] - ends[place]
    upto = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(upto[-1]) + np.repeat(start - upto[:-1], size)
    return flat[at], upto[np.concatenate([[0], np.cumsum(many)])]


def _blocks(batches: Iterator[pa.RecordBatch], block_chars: int) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(doc_id)
            texts.append(text or "")
            size += len(texts[-1])
            if size >= block_chars:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def encode(
    docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id",
    text_col: str = "text", block_chars: int = BLOCK_CHARS, stored: bool = False,
) -> DataFrame:
    """(doc_id, ids array<int>): every whole text by the ranks in a .tiktoken file, without special tokens.

    One row per input row, repeated rows and null ids included; a null text
    counts as empty and gives no ids. Other columns are ignored.

    Blocks of texts are known by their place, in the branch of texts and in the
    branch of words, and again where an executor was lost: the input must have
    the same rows in the same order whenever it is read. With `stored` the
    caller says that docs comes from files as it is; else it is written first.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    source = source if stored else written(source, "bpe-source")
    id_type = source.schema["doc_id"].dataType.simpleString()
    buckets = max(MIN_BUCKETS, source.count() // DOCS_PER_BUCKET)
    id_arrow = _arrow_list(docs, id_col)
    parts = pa.schema(
        [("key", pa.int64()), ("block", pa.int64()), ("doc_ids", id_arrow), ("sizes", pa.binary()), ("data", pa.binary())]
    )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, pieces = TaskContext.get().partitionId() << 32, splitter(pattern)
        for number, (ids, texts) in enumerate(_blocks(batches, block_chars)):
            block, known, places, sizes = task + number, Numbers(), [], []
            for text in texts:
                own = np.fromiter(map(known.__getitem__, pieces(text)), np.uint32)
                places.append(own)
                sizes.append(len(own))
            joined = np.concatenate(places)
            words = list(known)
            often = np.argsort(-np.bincount(joined, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[often] = np.arange(len(words), dtype=np.uint32)
            rows = [(block, block, ids, pack(np.array(sizes, np.uint32)), pack(rank[joined]))]
            own: dict[int, list[int]] = {}
            for n, i in enumerate(often.tolist()):
                own.setdefault(zlib.crc32(words[i].encode("utf-8")) % buckets, []).append(n)
            by_rank = [words[i] for i in often.tolist()]
            for bucket, numbers in own.items():
                packed = _pack_words([by_rank[n] for n in numbers], np.array(numbers, np.uint32))
                rows.append((-1 - bucket, block, None, None, packed))
            columns = zip(zip(*rows, strict=True), parts, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in columns], schema=parts)
            del known, places, joined, by_rank, words, own, rows, columns
            release()

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, bucket, known = _encoding(ranks_path, pattern), None, {}
        for batch in batches:
            keys, blocks, out = batch.column("key").to_pylist(), batch.column("block").to_pylist(), []
            for key, data in zip(keys, batch.column("data").to_pylist(), strict=True):
                if key >= 0:
                    out.append(None)
                    continue
                if key != bucket:
                    bucket, known = key, {}
                numbers, words = _unpack_words(data)
                found = []
                for w in words:
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = encoding.encode_ordinary(w.decode("utf-8"))
                    found.append(ids)
                sizes = pack(np.fromiter(map(len, found), np.uint32, len(found)))
                flat = pack(np.fromiter(chain.from_iterable(found), np.uint32))
                out.append(struct.pack("<II", len(numbers), len(sizes)) + numbers + sizes + flat)
            kept = [i for i, x in enumerate(out) if x is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([blocks[i] for i in kept], pa.int64()), pa.array([out[i] for i in kept], pa.binary())],
                ["key", "ids"],
            )
            del keys, blocks, out
            release()

    result = pa.schema([("doc_id", id_arrow.value_type), ("ids", pa.list_(pa.int32()))])

    def together(texts: pa.Table, words: pa.Table) -> pa.Table:
        texts = texts.filter(pa.compute.greater_equal(texts.column("key"), 0))
        if not texts.num_rows:
            return result.empty_table()
        numbers, sizes, flats = [], [], []
        for data in words.column("ids").to_pylist():
            n, m = struct.unpack_from("<II", data)
            numbers.append(np.cumsum(unpack(data[8 : 8 + n]).astype(np.int64)))
            sizes.append(unpack(data[8 + n : 8 + n + m]).astype(np.int64))
            flats.append(unpack(data[8 + n + m :]))
        number, size, flat = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (numbers, sizes, flats))
        del numbers, sizes, flats
        length, start = np.zeros((2, len(number)), np.int64)
        length[number], start[number] = size, np.cumsum(size) - size
        found = []
        for row in texts.select(["doc_ids", "sizes", "data"]).to_pylist():
            places, tokens = unpack(row["data"]), unpack(row["sizes"])
            many = length[places]
            ends = np.cumsum(many)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[places] - (ends - many), many)
            upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(tokens.astype(np.int64))])]
            ids = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(flat[at].astype(np.int32)))
            found.append(pa.Table.from_arrays([pa.array(row["doc_ids"], id_arrow.value_type), ids], schema=result))
        del number, size, flat, length, start
        release()
        return pa.concat_tables(found)

    # both sides read one exchange: rows >= 0 are blocks, rows below are word buckets
    dealt = source.mapInArrow(split, f"key long, block long, doc_ids array<{id_type}>, sizes binary, data binary").repartition("key")
    word_ids = dealt.sortWithinPartitions("key").mapInArrow(of_words, "key long, ids binary")
    return dealt.groupBy("key").cogroup(word_ids.groupBy("key")).applyInArrow(
        together, f"doc_id {id_type}, ids array<int>"
    )


def _arrow_list(docs: DataFrame, column: str) -> pa.ListType:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.list_(to_arrow_type(docs.schema[column].dataType))


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """encoded with a column decoded (binary): the bytes of each row's ids; null ids give null.

    An id that the file doesn't hold raises.
    """

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _ranks(ranks_path)
        table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        at = table.__getitem__
        for batch in batches:
            for start in range(0, batch.num_rows, 200):  # few rows as Python objects at a time
                rows = batch.slice(start, 200)
                ids = (x.values for x in rows.column("ids"))
                values = [None if x is None else b"".join(map(at, x.to_numpy().tolist())) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(values, pa.binary())], [*batch.schema.names, "decoded"]
                )
            release()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(bytes_of, f"{schema}, decoded binary")


def digests(docs: DataFrame, ranks_path: str, **options) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode() and decode()."""
    both = decode(encode(docs, ranks_path, **options), ranks_path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
