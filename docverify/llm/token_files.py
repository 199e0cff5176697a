"""Token ids in files by static range asymmetric numeral coding (rANS).

One frequency table over the whole corpus is shared by all blocks. A block
holds whole documents; its ids are dealt to lanes whose coder states are
interleaved in one stream, so that a step codes one id of each lane at once.
Every CHECKPOINT steps a block keeps the lanes' states and the place in the
stream, from where decoding can start; each block has a checksum of its states
and stream and one of its ids.

A file is MAGIC, the checksum of its table, then blocks in order:
  lengths (u32 x 5: head, ids, sizes, states, stream), head (struct HEAD),
  ids and sizes of documents (zstd), states of each checkpoint (u64), stream (u32).
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docverify.llm.bpe import gathered, pack, unpack
from docverify.llm.files import read_stream, write_once
from docverify.llm.pretokens import Numbers, splitter
from docverify.plans.storage import new_path, written

MAGIC = b"RANSIDS1"
TABLE = "table.bin"
HEAD = struct.Struct("<qqqIIII")  # part, block, start; ids, documents, checksums of states with stream and of ids
SCALE = 20
LOW = np.uint64(1 << 31)
LANES = 4096
CHECKPOINT = 32
#: Ids in a block, except that a document isn't divided.
BLOCK_IDS = 1 << 18
#: Consecutive blocks in a file at most.
FILE_BLOCKS = 16
END_ID = 0
#: Pre-tokens whose ids a worker remembers: the first ones, which common ones are among.
MEMO = 1_200_000
#: Bytes of ids of whole texts that a worker remembers, the last ones: copies of a text come out of it.
TEXT_MEMO = 24 << 20
#: Characters tokenized at a time.
SLICE_CHARS = 1_000_000


@dataclass(frozen=True)
class Table:
    """Frequencies that add up to 1 << SCALE, each id that occurs at least 1."""

    freq: np.ndarray

    @staticmethod
    def of_counts(counts: np.ndarray) -> Table:
        total, size = counts.sum(), 1 << SCALE
        if total == 0:
            return Table(np.zeros(len(counts), np.uint32))
        if np.count_nonzero(counts) > size:
            raise ValueError(f"more than {size} ids occur")
        freq = np.where(counts > 0, np.maximum(1, np.floor(counts * (size / total))), 0).astype(np.int64)
        over = int(freq.sum() - size)
        # the commonest ids give or take the difference
        order = np.argsort(-freq, kind="stable")
        while over:
            for i in order:
                step = min(over, int(freq[i]) - 1, max(1, over // 8)) if over > 0 else over
                if step:
                    freq[i] -= step
                    over -= step
                if not over:
                    break
        return Table(freq.astype(np.uint32))

    def data(self) -> bytes:
        return pack(self.freq)

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.freq.astype(np.uint64))])[:-1].astype(np.uint64)

    @property
    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq)


def rans_encode(ids: np.ndarray, freq: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(states, places, stream): coder states and stream places at every CHECKPOINT steps, from the first."""
    x = np.full(LANES, LOW, np.uint64)
    steps = -(-len(ids) // LANES)
    stream, states, places, count = [], [], [], 0
    f_all, c_all = freq[ids].astype(np.uint64), starts[ids]
    limit_all = f_all << np.uint64(63 - SCALE)
    word, scale = np.uint64(32), np.uint64(SCALE)
    for s in range(steps - 1, -1, -1):
        a, b = s * LANES, min(len(ids), (s + 1) * LANES)
        f, own = f_all[a:b], x[: b - a]
        full = own >= limit_all[a:b]
        if full.any():
            out = own[full]
            stream.append(out.astype(np.uint32))
            count += len(out)
            own[full] = out >> word
        q = own // f
        own[:] = (q << scale) + (own - q * f) + c_all[a:b]
        if s % CHECKPOINT == 0:
            states.append(x.copy())
            places.append(count)
    joined = np.concatenate(stream[::-1]) if stream else np.zeros(0, np.uint32)
    return np.array(states[::-1], np.uint64).reshape(-1, LANES), count - np.array(places[::-1], np.int64), joined


def rans_decode(states, places, stream, n: int, freq, starts, slots, checkpoint: int = 0) -> np.ndarray:
    """The ids from a checkpoint to the end."""
    steps, first = -(-n // LANES), checkpoint * CHECKPOINT
    out = np.empty(n - first * LANES, np.uint32)
    if not n:
        return out
    x, p = states[checkpoint].copy(), int(places[checkpoint])
    mask, scale, word = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
    words = stream.astype(np.uint64)
    for s in range(first, steps):
        a, b = s * LANES, min(n, (s + 1) * LANES)
        own = x[: b - a]
        low = own & mask
        got = slots[low]
        out[a - first * LANES : b - first * LANES] = got
        own[:] = freq[got] * (own >> scale) + low - starts[got]
        short = np.flatnonzero(own < LOW)
        if len(short):
            own[short] = (own[short] << word) | words[p : p + len(short)]
            p += len(short)
    return out


def block_bytes(part: int, block: int, start: int, doc_ids: list, sizes: np.ndarray, ids: np.ndarray, freq, starts) -> list[bytes]:
    states, places, stream = rans_encode(ids, freq, starts)
    known = np.array([i is not None for i in doc_ids], np.uint8)
    numbers = np.array([i or 0 for i in doc_ids], "<i8")
    zip_ = zstandard.ZstdCompressor(level=3).compress
    body = [
        zip_(known.tobytes() + np.diff(numbers, prepend=np.int64(0)).tobytes()), pack(sizes),
        places.astype("<u4").tobytes() + states.astype("<u8").tobytes(), stream.astype("<u4").tobytes(),
    ]
    head = HEAD.pack(part, block, start, len(ids), len(doc_ids), zlib.crc32(body[3], zlib.crc32(body[2])), zlib.crc32(ids.astype("<u4").tobytes()))
    return [struct.pack("<5I", len(head), *map(len, body)), head, *body]


def read_blocks(stream, table: Table, crc: int) -> Iterator[tuple[int, int, int, list, np.ndarray, np.ndarray]]:
    """(part, block, start, doc ids, sizes, ids) of each block; raises where a checksum or a length is wrong."""
    if stream.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    if struct.unpack("<I", stream.read(4))[0] != crc:
        raise ValueError("the file was written with another table")
    freq, starts, slots = table.freq.astype(np.uint64), table.starts, table.slots
    while lengths := stream.read(20):
        if len(lengths) != 20:
            raise ValueError("the file ends within a block")
        parts = []
        for want in struct.unpack("<5I", lengths):
            parts.append(stream.read(want))
            if len(parts[-1]) != want:
                raise ValueError("the file ends within a block")
        part, block, start, n, docs, crc_stream, crc_ids = HEAD.unpack(parts[0])
        if zlib.crc32(parts[4], zlib.crc32(parts[3])) != crc_stream:
            raise ValueError(f"checksum of the states and the stream of block {block} is wrong")
        raw = zstandard.ZstdDecompressor().decompress(parts[1])
        numbers = np.cumsum(np.frombuffer(raw[docs:], "<i8")).tolist()
        doc_ids = [i if k else None for i, k in zip(numbers, raw[:docs], strict=True)]
        marks = -(-(-(-n // LANES)) // CHECKPOINT)
        places = np.frombuffer(parts[3][: 4 * marks], "<u4")
        states = np.frombuffer(parts[3][4 * marks :], "<u8").reshape(marks, LANES)
        ids = rans_decode(states, places, np.frombuffer(parts[4], "<u4"), n, freq, starts, slots)
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc_ids:
            raise ValueError(f"checksum of the ids of block {block} is wrong")
        yield part, block, start, doc_ids, unpack(parts[2]), ids


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> dict[int, str]:
    """The character by which byte-level tokenizers write each byte: itself where it shows, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(others)}


_LETTERS = _byte_letters()


class Ids:
    """Ids of texts by a tokenizer file whose pre-tokenizer is byte-level, as whole texts would give.

    Texts are split by the pattern and their pre-tokens numbered, so that each
    distinct one goes through the tokenizer's model about once a worker; a text
    with the string of a special token is encoded whole.
    """

    def __init__(self, path: str, memo: int = MEMO) -> None:
        self.tokenizer = _tokenizer(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = splitter(public_tokenizers.PATTERN)
        self.numbers, self.memo = Numbers(), memo
        # ids of all numbered pre-tokens one after another, and where each one's end
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        # ids of the last whole texts, by their checksum
        self.texts: dict[bytes, bytes] = {}
        self.held = 0

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of single pre-tokens, one after another, and how many each has, by the tokenizer's model."""
        model, space, flat, sizes = self.tokenizer.model.tokenize, _LETTERS[0x20], [], []
        for w in words:
            # of what shows in ASCII only the space has another letter
            plain = w.isascii() and w.isprintable()
            found = model(w.replace(" ", space) if plain else w.encode().decode("latin-1").translate(_LETTERS))
            flat += [t.id for t in found]
            sizes.append(len(found))
        return np.array(flat, np.uint32), np.array(sizes, np.int64)

    def of(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        keys = [xxhash.xxh3_128_digest(t.encode()) for t in texts]
        new = {k: t for k, t in zip(keys, texts, strict=True) if k not in self.texts}
        known = {k: self.texts[k] for k in keys if k in self.texts} | dict(zip(new, self._of(list(new.values())), strict=True))
        for k in new:
            self.texts[k] = known[k]
            self.held += len(known[k])
        while self.held > TEXT_MEMO:
            self.held -= len(self.texts.pop(next(iter(self.texts))))
        return [known[k] for k in keys]

    def _of(self, texts: list[str]) -> list[bytes]:
        pieces = [self.split(t) for t in texts]
        before = len(self.numbers)
        many = np.fromiter(map(len, pieces), np.int64, len(pieces))
        place = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(pieces)), np.int64, int(many.sum()))
        fresh = list(islice(self.numbers, before, None))
        flat, ends = self.flat, self.ends
        if fresh:
            new, sizes = self._words(fresh)
            flat, ends = np.concatenate([flat, new]), np.concatenate([ends, ends[-1] + np.cumsum(sizes)])
            kept = max(before, min(len(self.numbers), self.memo))
            self.flat, self.ends = flat[: ends[kept]], ends[: kept + 1]
            for word in fresh[kept - before :]:
                del self.numbers[word]
        raw, upto = gathered(flat, ends, place, many)
        raw, upto = raw.astype("<u4").tobytes(), (4 * upto).tolist()
        out = [raw[a:b] for a, b in zip(upto[:-1], upto[1:], strict=True)]
        for i, t in enumerate(texts):
            if any(x in t for x in self.specials):
                out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        return out


@lru_cache(maxsize=1)
def _ids(path: str) -> Ids:
    """One for all tasks of a worker."""
    return Ids(path)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    for batch in batches:
        ids, texts, size = [], [], 0
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t or "")
            size += len(texts[-1])
            if size >= SLICE_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def tokenized(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks in ascending order of ids (null first): part, block, inner (ids before it in its part), doc_ids, sizes, ids (unsigned, of two bytes where they fit), n, seen.

    A part's last row has no ids but in `seen` how often it has each id of the vocabulary.
    """
    lists = pa.list_(pa.int64())
    schema = pa.schema(
        [("part", pa.int64()), ("block", pa.int64()), ("inner", pa.int64()), ("doc_ids", lists), ("sizes", lists)]
        + [("ids", pa.binary()), ("n", pa.int64()), ("seen", pa.binary())]
    )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tokens, number = TaskContext.get().partitionId(), _ids(tokenizer_path), 0
        doc_ids, sizes, parts, n, inner, seen = [], [], [], 0, 0, np.zeros(0, np.int64)

        def row(*values):
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((part, *values), schema, strict=True)], schema=schema)

        def closed() -> pa.RecordBatch:
            nonlocal seen
            ids = np.frombuffer(b"".join(parts), "<u4")
            own = np.bincount(ids, minlength=len(seen))
            own[: len(seen)] += seen
            seen = own
            narrow = ids.astype("<u2") if len(own) <= 1 << 16 else ids
            return row(number, inner, doc_ids, sizes, narrow.tobytes(), n, None)

        end = np.array([END_ID], "<u4").tobytes()
        for own, texts in _slices(batches):
            for i, ids in zip(own, tokens.of(texts), strict=True):
                doc_ids.append(i)
                sizes.append(len(ids) // 4 + 1)
                parts += [ids, end]
                n += sizes[-1]
                if n >= BLOCK_IDS:
                    yield closed()
                    doc_ids, sizes, parts, n, inner, number = [], [], [], 0, inner + n, number + 1
        if doc_ids:
            yield closed()
        if len(seen):
            yield row(None, None, None, None, None, 0, seen.tobytes())

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return (
        source.repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id")
        .mapInArrow(
            blocks, "part long, block long, inner long, doc_ids array<long>, sizes array<long>, ids binary, n long, seen binary"
        )
    )


def id_counts(blocks: DataFrame) -> DataFrame:
    """(id, n): one row for each id of the vocabulary that occurs."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for seen in batch.column(0).to_pylist():
                own = np.frombuffer(seen, np.int64).copy()
                short, long = sorted((own, total), key=len)
                long[: len(short)] += short
                total = long
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    seen = blocks.where("seen is not null").select("seen")
    return seen.mapInArrow(counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs' ids, each document closed by END_ID, to files in folder; returns the list of files.

    (file, part, block, start, n_ids, bytes), in ascending order of ids by
    (part, block). Null ids come first, a null text counts as empty (its only
    id is END_ID), repeated rows stay; other columns are ignored. What comes to
    the driver is one count for each id of the vocabulary.
    """
    blocks = written(tokenized(docs, tokenizer_path, id_col, text_col), "token-blocks")
    counts = id_counts(blocks).collect()
    freq = np.zeros(max((r["id"] for r in counts), default=0) + 1, np.int64)
    for r in counts:
        freq[r["id"]] = r["n"]
    table = Table.of_counts(freq)
    write_once(folder, TABLE, [table.data()])
    crc = zlib.crc32(table.data())
    per_part = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a task of the range sort
    bases = per_part.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, starts = table.freq.astype(np.uint64), table.starts
        for run in _runs(batches):
            body, name = [MAGIC, struct.pack("<I", crc)], f"ids-{run[0]['part']:08d}-{run[0]['block']:08d}.rans"
            for r in run:
                ids, sizes = np.frombuffer(r["ids"], f"<u{len(r['ids']) // r['n']}"), np.array(r["sizes"], np.uint32)
                body += block_bytes(r["part"], r["block"], r["base"] + r["inner"], r["doc_ids"], sizes, ids, freq, starts)
            size, n = write_once(folder, name, body), sum(r["n"] for r in run)
            first = {"file": name, "part": run[0]["part"], "block": run[0]["block"], "start": run[0]["base"] + run[0]["inner"]}
            yield pa.RecordBatch.from_pylist([first | {"n_ids": n, "bytes": size}])

    return written(
        blocks.where("seen is null").drop("seen").join(F.broadcast(bases), "part").mapInArrow(
            files, "file string, part long, block long, start long, n_ids long, bytes long"
        ),
        "token-files",
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of consecutive blocks of a part, FILE_BLOCKS at most."""
    run: list[dict] = []
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            if run and (len(run) == FILE_BLOCKS or (r["part"], r["block"]) != (run[-1]["part"], run[-1]["block"] + 1)):
                yield run
                run = []
            run.append(r)
    if run:
        yield run


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, ids binary) of every document in the files of the list; ids are u32, little-endian."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with read_stream(folder, TABLE) as f:
            data = f.read()
        table, crc = Table(unpack(data)), zlib.crc32(data)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with read_stream(folder, name) as f:
                    for _, _, start, doc_ids, sizes, ids in read_blocks(f, table, crc):
                        ends = np.cumsum(sizes.astype(np.int64))
                        raw = ids.astype("<u4").tobytes()
                        own = [raw[4 * (e - s) : 4 * e] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(doc_ids, pa.int64()), pa.array(start + ends - sizes, pa.int64()), pa.array(own, pa.binary())],
                            ["doc_id", "start", "ids"],
                        )

    return files.select("file").mapInArrow(read, "doc_id long, start long, ids binary")


def token_file_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from files written to the shared folder and read back."""
    folder = new_path(docs.sparkSession, "token-archive")
    files = write_token_files(docs, tokenizer_path, folder, id_col, text_col)
    return read_token_files(files, folder).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
