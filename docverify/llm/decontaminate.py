"""Benchmark decontamination: a broadcast hash set of test windows, scanned against the windows of every document.

Words are runs of ASCII letters and digits and of all characters from U+0080;
A-Z are lower-cased. A window is n consecutive words of a benchmark item; an
item with fewer words, but not none, is one window. Tasks hash all words of a
block of documents at once, windows from the words' hashes, and look them up
in a bitmap, then among the test hashes, then as words: a hash alone is never
a hit. Hits are spans of words, which can be removed, or their documents.

The set is broadcast while its measured bytes are within a bound. A larger one
stays distributed: tasks get a bitmap of fixed size, and the windows that pass
it are joined with the test windows as words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docverify.plans.storage import written

#: Words of a window.
WINDOW = 10
#: Largest set of test windows, in bytes of words and item ids, that is broadcast.
BROADCAST_BYTES = 48 << 20
#: Bits of a hash that the bitmap of a larger set has places for (2^26 bits: 8 MB).
FILTER_BITS = 26
#: Bytes of text that are taken at a time; a longer text is taken alone.
BLOCK = 2 << 20
#: Bytes whose running sums are held at a time.
STRETCH = 1 << 18

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Odd, so that it has an inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _STEP
    return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


class Words:
    """The words of a block of texts: starts and ends in data (lower-cased), the text each is of, and hashes."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        """bounds: where the texts begin in data, and its end."""
        self.data, firsts, lasts = _LOWER[data], bounds[:-1], bounds[1:]
        inside = _WORD[self.data]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        for at, of in ((firsts[firsts < len(data)], begins), (lasts[lasts > 0] - 1, stops)):
            of[at] = inside[at]  # no word reaches from a text into the next
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.text = np.searchsorted(lasts, self.starts, "right")
        self.per_text = np.bincount(self.text, minlength=len(firsts))
        self.hashes = self._hashes()

    def _hashes(self) -> np.ndarray:
        out, i = np.empty(len(self.starts), np.uint64), 0
        while i < len(out):
            low = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, low + STRETCH, "right")))
            high = self.ends[j - 1]
            powers, inverse = _powers(max(STRETCH, 1 << int(high - low - 1).bit_length()))
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(self.data[low:high] * powers[: high - low], out=sums[1:])
            a, b = self.starts[i:j] - low, self.ends[i:j] - low
            out[i:j] = _mixed((sums[b] - sums[a]) * inverse[a])
            i = j
        return out

    def windows(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of m words, and whether each is within one text."""
        n = len(self.starts) - m + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, bool)
        out = np.zeros(n, np.uint64)
        for k in range(m):
            out = out * _STEP + self.hashes[k : k + n]
        return _mixed(out), self.text[:n] == self.text[m - 1 :]

    def words(self, at: int, m: int) -> str:
        data = self.data
        found = (data[a:b].tobytes() for a, b in zip(self.starts[at : at + m], self.ends[at : at + m], strict=True))
        return b" ".join(found).decode()


def blocks(texts: pa.Array) -> Iterator[tuple[int, int, Words, np.ndarray]]:
    """(first row, end row, their words, bounds) of blocks of at most BLOCK bytes, or one longer text."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
        bounds = offsets[i : j + 1] - offsets[i]
        yield i, j, Words(data[offsets[i] : offsets[j]], bounds), bounds
        i = j


def _texts(batch: pa.RecordBatch, column: int | str) -> pa.Array:
    """A null text has no words; its place holds no bytes that count."""
    return batch.column(column).fill_null("")


def test_windows(items: DataFrame, n: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(m, hash, words, item): the distinct windows of items, of m words each; item is the id as a string."""

    def windows(batches):
        for batch in batches:
            for i, j, words, _ in blocks(_texts(batch, 1)):
                out, ids, first = {}, batch.column(0), 0
                for row, count in zip(range(i, j), words.per_text, strict=True):
                    m = min(n, int(count))
                    for at in range(first, first + int(count) - m + 1) if m else ():
                        out[words.words(at, m), ids[row].as_py()] = at, m
                    first += int(count)
                hashes = {m: words.windows(m)[0].view(np.int64) for m in {m for _, m in out.values()}}
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([m for _, m in out.values()], pa.int32()), pa.array([hashes[m][at] for at, m in out.values()], pa.int64()),
                        pa.array([w for w, _ in out], pa.string()), pa.array([x for _, x in out], pa.string()),
                    ],
                    names=["m", "hash", "words", "item"],
                )

    source = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return source.mapInArrow(windows, "m int, hash long, words string, item string").distinct()


class TestSet:
    """Test windows as a hash set: a bitmap of the hashes' first bits, the sorted hashes, and the words with their items."""

    __test__ = False

    def __init__(self, rows: list):
        self.items: dict[str, set] = {}
        hashes: dict[int, set] = {}
        for m, value, words, item in rows:
            hashes.setdefault(m, set()).add(value & _MASK)
            self.items.setdefault(words, set()).add(item)
        self.bits = min(24, max(16, (512 * len(rows)).bit_length()))
        self.hashes = {m: np.array(sorted(found), np.uint64) for m, found in hashes.items()}
        self.maps: dict[int, np.ndarray] = {}

    def hits(self, words: Words) -> Iterator[tuple[int, int, set]]:
        """(first word, number of words, items) of each window that is a test window."""
        for m, known in self.hashes.items():
            if m not in self.maps:  # built where it is used, so that it doesn't travel
                self.maps[m] = np.zeros(1 << self.bits, bool)
                self.maps[m][known >> np.uint64(64 - self.bits)] = True
            found, whole = words.windows(m)
            at = np.flatnonzero(self.maps[m][found >> np.uint64(64 - self.bits)] & whole)
            at = at[known[np.minimum(np.searchsorted(known, found[at]), len(known) - 1)] == found[at]]
            for i in at.tolist():
                if (items := self.items.get(words.words(i, m))) is not None:
                    yield i, m, items


def _covered(words: Words, hits: list) -> np.ndarray:
    edges = np.zeros(len(words.starts) + 1, np.int64)
    for i, m, *_ in hits:
        edges[i] += 1
        edges[i + m] -= 1
    return np.cumsum(edges[:-1]) > 0


def _runs(words: Words, covered: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, first byte, end byte) of each longest run of hit words."""
    at = np.flatnonzero(covered)
    if not len(at):
        return []
    new = np.flatnonzero((np.diff(at) > 1) | (np.diff(words.text[at]) > 0)) + 1
    firsts, lasts = at[np.r_[0, new]], at[np.r_[new - 1, len(at) - 1]]
    return list(zip(words.text[firsts].tolist(), words.starts[firsts].tolist(), words.ends[lasts].tolist(), strict=True))


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


#: What scanning finds of a text; spans are of words: first word and number of words.
FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("items_sha256", T.StringType()),
])


def _found_rows(words: Words, hits: list, rows: int) -> Iterator[tuple[int, int, list[str], str]]:
    """n_words, n_hit, items and their digest of each of the block's texts."""
    hit = np.bincount(words.text[_covered(words, hits)], minlength=rows)
    items: dict[int, set] = {}
    for i, _, found in hits:
        items.setdefault(int(words.text[i]), set()).update(found)
    for row in range(rows):
        own = sorted(x for x in items.get(row, ()) if x is not None)
        yield int(words.per_text[row]), int(hit[row]), own, _digest(own)


def _cut(words: Words, hits: list, bounds: np.ndarray, raw: list[bytes | None]) -> None:
    """Removes the runs of hit words, and what stands between their words, from the block's texts."""
    for text, a, b in reversed(_runs(words, _covered(words, hits))):
        low = int(bounds[text])
        raw[text] = raw[text][: a - low] + raw[text][b - low :]


def _test_set(windows: DataFrame, bound: int):
    """The broadcast set, or None if it is larger than the bound."""
    cost = F.length("words") + F.coalesce(F.length("item"), F.lit(0)) + 64
    if (windows.agg(F.sum(cost)).first()[0] or 0) > bound:
        return None
    return windows.sparkSession.sparkContext.broadcast(TestSet([tuple(r) for r in windows.collect()]))


def _joined_hits(texts: DataFrame, windows: DataFrame, bits: int) -> DataFrame:
    """(key, hits: array of at, m; items): texts (key, text) against a set too large to broadcast."""
    spark = texts.sparkSession
    place = F.shiftrightunsigned("hash", 64 - bits)
    packed = windows.groupBy("m", F.shiftright(place, 6).alias("cell")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))).alias("mask")
    )
    maps: dict[int, np.ndarray] = {}
    for m, cell, mask in packed.toLocalIterator():  # at most 2^(bits - 6) rows for each of the n lengths
        maps.setdefault(m, np.zeros(1 << (bits - 6), np.uint64))[cell] = mask & _MASK
    shared = spark.sparkContext.broadcast(maps)

    def passing(batches):
        for batch in batches:
            for i, _, words, _ in blocks(_texts(batch, 1)):
                firsts = np.r_[0, np.cumsum(words.per_text)]
                for m, cells in shared.value.items():
                    found, whole = words.windows(m)
                    at = found >> np.uint64(64 - bits)
                    in_map = (cells[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)
                    hits = np.flatnonzero(in_map.astype(bool) & whole)
                    text = words.text[hits]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(text + i)), pa.array(hits - firsts[text], pa.int64()),
                            pa.array(np.full(len(hits), m, np.int32)), pa.array([words.words(x, m) for x in hits.tolist()], pa.string()),
                        ],
                        names=["key", "at", "m", "words"],
                    )

    seen = texts.mapInArrow(passing, "key binary, at long, m int, words string").distinct()
    hits = written(seen.join(windows.select("m", "words", "item"), ["m", "words"]), "window-hits")
    spans = hits.groupBy("key").agg(F.collect_set(F.struct("at", "m")).alias("spans"))
    items = hits.groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return spans.join(items, "key")


def _key(text):
    """Texts that are equal have equal hits, so a row is known by its text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class _Joined:
    """Hits of the rows of a batch, from the join, in the form that TestSet gives."""

    def __init__(self, spans: pa.Array, items: pa.Array):
        self.spans, self.items = spans, items

    def hits(self, words: Words, first: int) -> Iterator[tuple[int, int, set]]:
        begins = np.r_[0, np.cumsum(words.per_text)]
        for row in range(len(words.per_text)):
            items = set(self.items[first + row].as_py() or ())
            for span in self.spans[first + row].as_py() or ():
                yield int(begins[row]) + span["at"], span["m"], items


def _with_hits(docs: DataFrame, items: DataFrame, text_col: str, n: int, bound: int, bits: int, item_col: str, item_text_col: str):
    """docs as struct row, text, and where the set isn't broadcast the joined hits; a function (batch, block) -> hits."""
    windows = written(test_windows(items, n, item_col, item_text_col), "test-windows")
    known = _test_set(windows, bound)
    source = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    if known is not None:
        return source, lambda batch, i, words: known.value.hits(words)
    keyed = source.withColumn("key", _key(F.col("text")))
    hits = _joined_hits(keyed.select("key", "text"), windows, bits)
    joined = keyed.join(hits, "key", "left").select("row", "text", "spans", "items")
    return joined, lambda batch, i, words: _Joined(batch.column("spans"), batch.column("items")).hits(words, i)


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WINDOW, bound: int = BROADCAST_BYTES,
    bits: int = FILTER_BITS, item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items.

    n_hit counts the words inside any occurrence of a window of n words of an
    item (of all its words, if it has fewer); items are the ids, as strings, of
    those with occurring windows, sorted; items_sha256 is of the ids joined by
    commas. A null or blank text has no words and no hits. An item without an
    id marks words, but isn't counted or listed; items that share an id are one.
    Repeated rows each get a row. Empty tables give no hits or no rows.
    """
    source, find = _with_hits(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), items, "text", n, bound, bits, item_col, item_text_col)

    def scan(batches):
        for batch in batches:
            rows = []
            for i, j, words, _ in blocks(_texts(batch, "text")):
                rows += _found_rows(words, list(find(batch, i, words)), j - i)
            found = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string()), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("row").flatten()[0], *found], names=["doc_id", *FOUND.names])

    out = source.mapInArrow(scan, T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *FOUND]))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "items"
    )


def decontaminated(
    docs: DataFrame, items: DataFrame, text_col: str = "text", spans_only: bool = True, n: int = WINDOW, bound: int = BROADCAST_BYTES,
    bits: int = FILTER_BITS, item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """docs, with all their columns, without what the items' windows hit.

    With spans_only the runs of hit words go, with what stands between their
    words; other characters stay as they are, and a document that was nothing
    else keeps an empty or blank text. Else documents with a hit go. Rows
    without a hit are returned unchanged, null texts included.
    """
    source, find = _with_hits(docs, items, text_col, n, bound, bits, item_col, item_text_col)
    names = docs.columns
    at = names.index(text_col)

    def clean(batches):
        for batch in batches:
            row, texts = batch.column("row"), batch.column("text").to_pylist()
            stay = np.ones(len(texts), bool)
            for i, j, words, bounds in blocks(_texts(batch, "text")):
                if not (hits := list(find(batch, i, words))):
                    continue
                raw = [x if x is None else x.encode() for x in texts[i:j]]
                _cut(words, hits, bounds, raw)
                texts[i:j] = [x if x is None else x.decode() for x in raw]
                stay[i + np.unique(words.text[[x[0] for x in hits]])] = False
            columns = row.flatten()
            if spans_only:
                columns[at] = pa.array(texts, pa.string())
            out = pa.RecordBatch.from_arrays(columns, names=names)
            yield out if spans_only else out.filter(pa.array(stay))

    return source.mapInArrow(clean, docs.schema)


ORACLE = r"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS words
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM item WHERE len(w) > 0)),
doc AS (
  SELECT row_number() OVER () AS r, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
placed AS (
  SELECT r, m, p, array_to_string(w[p : p + m - 1], ' ') AS words
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM doc, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m)),
hit AS (SELECT r, p, m, item FROM placed JOIN windows USING (m, words)),
covered AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + m)) AS q FROM (SELECT DISTINCT r, p, m FROM hit)) GROUP BY r),
listed AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)
"""
