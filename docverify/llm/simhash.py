"""SimHash near-duplicates through an index on byte positions.

A 64-bit fingerprint is eight bytes at fixed positions. Fingerprints that
differ in at most three bits differ in at most three bytes, so they share at
least five positional bytes. The inverted index holds each distinct
fingerprint under each of the 56 sets of five positions with its five bytes;
two entries that meet under a key have reached the guaranteed five matches.
The tally of shared bytes says which set is the pair's first, so that each
pair comes out once, and the differing bits are then counted in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docverify.llm.memory import release
from docverify.operators.components import connected_components
from docverify.operators.contraction import MORE_LEADERS, apart, few_pairs, leaders_of, merged, shared_keys
from docverify.plans.storage import written

SHINGLE_WORDS = 3
MAX_BITS = 3
POSITIONS = 8
#: Bytes that two linked fingerprints surely share.
SHARED = POSITIONS - MAX_BITS
SEED = 42
#: Shingles hashed at a time; bounds the memory that a long text needs.
CHUNK = 1 << 16

# near_duplicates: words in a shingle and the Jaccard similarity of its links
NEAR_WORDS = 5
SIMILARITY = 0.8
#: Positional bytes of its print, and sets of SHARED positions in its index.
WIDE = 128
BANDS = 16
#: Shared bytes of 128 that a pair at a similarity of 0.8 reaches but for one in 10,000 (102 are expected, deviation 4.5).
LEAST_SHARED = 84
#: Shingles that are permuted at a time.
ROWS = 2048

_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 64, (2, WIDE), np.uint64)
_FLIP, _TURN = _DRAWN[0], _DRAWN[1] | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _shingle_hashes(found: list[bytes], words: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles of words, CHUNK at a time; of the whole sequence if it is shorter than a shingle."""
    for start in range(0, max(1, len(found) - words + 1), CHUNK):
        part = found[start : start + CHUNK + words - 1]
        grams = zip(*(part[i:] for i in range(words)), strict=False) if len(part) >= words else [part]
        yield np.array([xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in grams], dtype=">u8")


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash of the whole text; 0 without words."""
    found = (text or "").encode("utf-8").translate(_LOWER).split()
    if not found:
        return 0
    total, ones = 0, np.zeros(64, np.int64)
    for digests in _shingle_hashes(found, words):
        bits = np.unpackbits(digests.view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(digests)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp long) for every row; the text is read whole."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["doc_id", "fp"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(hashes, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _mask(positions) -> int:
    return _signed(sum(0xFF << (8 * p) for p in positions))


def similar_fingerprints(distinct: DataFrame, fp: str = "fp") -> DataFrame:
    """(a, b), a < b, for all pairs of distinct fingerprints that differ in at most MAX_BITS bits."""
    sets = list(combinations(range(POSITIONS), SHARED))
    # dealt out before rows become 56 times as many: their size says too little to Spark
    spread = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), fp)
    entries = spread.select(
        F.col(fp).alias("fp"),
        F.posexplode(F.array(*[F.col(fp).bitwiseAND(F.lit(_mask(s))) for s in sets])).alias("set", "key"),
    )
    # positions before a set's last that it leaves out: all must differ, or an earlier set is the pair's first
    skipped = [[p for p in range(s[-1]) if p not in s] for s in sets]
    at = [
        F.array(*[F.lit(_mask([left[i]]) if i < len(left) else -1).cast("long") for left in skipped])
        for i in range(MAX_BITS)
    ]
    # a broadcast would pass the entries through the driver, as their size is taken for that of the fingerprints
    left, right = entries.alias("l").hint("merge"), entries.alias("r").hint("merge")
    differs = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    first = None
    for masks in at:
        own = differs.bitwiseAND(F.get(masks, F.col("l.set"))) != 0
        first = own if first is None else first & own
    return left.join(
        right,
        (F.col("l.set") == F.col("r.set"))
        & (F.col("l.key") == F.col("r.key"))
        & (F.col("l.fp") < F.col("r.fp"))
        & (F.bit_count(differs) <= MAX_BITS)
        & first,
    ).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))


def simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, n_links.

    component_id is the smallest id that links reach. Equal fingerprints are
    one class, so copies are never paired with each other; n_links counts
    linked classes. Null and wordless texts have fingerprint zero and link like
    any other; a class whose ids are all null has a null component. Repeated
    rows come back repeated; other columns are ignored.
    """
    prints = written(fingerprints(docs, id_col, text_col, words), "simhash")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    pairs = written(similar_fingerprints(classes.select("fp")), "simhash-pairs")
    roots = connected_components(pairs)
    degree = (
        pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).groupBy("node").count()
    )
    linked = roots.join(degree, "node").select(F.col("node").alias("fp"), "root", F.col("count").alias("n_links"))
    labelled = classes.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = labelled.groupBy("root").agg(F.min("least_id").alias("component_id"))
    groups = labelled.join(least, "root").select("fp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return prints.join(groups, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links"
    )


def similarity_print(text: str | None, words: int = NEAR_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(WIDE bytes as WIDE / 8 longs, sorted distinct hashes of the shingles as longs).

    Both are of the whole text; without words, zeros and no hashes.
    """
    found = (text or "").encode("utf-8").translate(_LOWER).split()
    if not found:
        return np.zeros(WIDE // 8, np.int64), np.zeros(0, np.int64)
    least, kept = np.full(WIDE, np.iinfo(np.uint64).max, np.uint64), []
    for digests in _shingle_hashes(found, words):
        distinct = np.unique(digests.astype(np.uint64))
        kept.append(distinct)
        for start in range(0, len(distinct), ROWS):
            part = distinct[start : start + ROWS, None]
            np.minimum(least, ((part ^ _FLIP) * _TURN).min(axis=0), out=least)
    prints = (least * _MIX >> np.uint64(56)).astype(np.uint8)
    return prints.view(np.int64), np.unique(np.concatenate(kept)).view(np.int64)


def _with_prints(docs: DataFrame, words: int) -> DataFrame:
    """docs (doc_id, text) as doc_id, fp (array of longs), shingles (how many) and same (checksum of their set)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                found = [similarity_print(t, words) for t in part.column(1).to_pylist()]
                same = pa.array([xxhash.xxh3_128_digest(h.tobytes()) for _, h in found], pa.binary())
                fp = pa.array([f for f, _ in found], pa.list_(pa.int64()))
                many = pa.array([len(h) for _, h in found], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), fp, many, same], ["doc_id", "fp", "shingles", "same"])
            batch = part = found = None
            release()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {id_type}, fp array<bigint>, shingles long, same binary")


def _with_hashes(docs: DataFrame, words: int) -> DataFrame:
    """docs (doc_id, text) as node and hashes: the shingle set to verify by."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                values = [similarity_print(t, words)[1] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values, pa.list_(pa.int64()))], ["node", "hashes"])
            batch = part = values = None
            release()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rows, f"node {id_type}, hashes array<bigint>")


def _shared_bytes(a: str, b: str):
    """How many positional bytes two wide prints share."""

    def differing(u, v):
        x = u.bitwiseXOR(v)
        for by in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, by))
        return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))

    return F.lit(WIDE) - F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda total, n: total + n)


def _keys(fp) -> Column:
    """The key of each band: its SHARED positional bytes."""

    def byte(position: int):
        return F.shiftright(fp[position // 8], 8 * (position % 8)).bitwiseAND(F.lit(0xFF).cast("long"))

    keys = []
    for band in range(BANDS):
        key = F.lit(0).cast("long")
        for position in range(band * SHARED, (band + 1) * SHARED):
            key = F.shiftleft(key, 8).bitwiseOR(byte(position))
        keys.append(key)
    return F.array(*keys)


def _index(classes: DataFrame) -> DataFrame:
    """(band, key, node, least) of classes (node, fp): entries whose key holds at least two nodes."""
    entries = classes.select("node", F.posexplode(_keys(F.col("fp"))).alias("band", "key"))
    return shared_keys(written(entries, "near-entries"), "near-index")


def _tallied(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs that share at least LEAST_SHARED positional bytes."""
    prints = classes.select("node", "fp")
    for c in ("a", "b"):
        pairs = pairs.join(prints.select(F.col("node").alias(c), F.col("fp").alias(f"f{c}")), c)
    return pairs.where(_shared_bytes("fa", "fb") >= LEAST_SHARED).select("a", "b")


def _verified(tallied: DataFrame, hashes: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose shingle sets are similar."""
    for c in ("a", "b"):
        tallied = tallied.join(hashes.select(F.col("node").alias(c), F.col("hashes").alias(f"h{c}")), c)
    both = F.size(F.array_intersect("ha", "hb"))
    alike = both >= F.lit(similarity) * (F.size("ha") + F.size("hb") - both)
    return tallied.where(alike).select("a", "b").distinct()


def _crowd(many: DataFrame, classes: DataFrame, hashes: DataFrame) -> DataFrame:
    """(node, fp, keys, shingles, own) of the nodes of full keys; own: how many of its shingles no other of these nodes has."""
    nodes = many.select("node").distinct()
    alone = (
        hashes.join(nodes, "node", "left_semi")
        .select("node", F.explode("hashes").alias("shingle"))
        .groupBy("shingle")
        .agg(F.min("node").alias("node"), F.max("node").alias("last"))
        .where("node = last")
        .groupBy("node")
        .agg(F.count(F.lit(1)).alias("own"))
    )
    known = classes.select("node", "fp", "shingles").join(nodes, "node", "left_semi").join(alone, "node", "left")
    return written(known.withColumn("own", F.coalesce("own", F.lit(0))).withColumn("keys", _keys(F.col("fp"))), "near-crowd")


def _led(many: DataFrame, crowd: DataFrame, leaders: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(a, b) of leaders and nodes of another root that may be similar; the entries that have partners left.

    A key has `leaders` parts and in each a leader, the node with most links.
    Two nodes share no more shingles than either has beyond its own; pairs
    that can't be similar then, and those below the tally, don't leave the join.
    Nor does a pair under other keys than the first that its nodes share.
    """
    most = lambda n, own: n - own
    needs = lambda n, m: F.lit(similarity / (1 + similarity) - 1e-12) * (n + m)
    full = many.join(crowd, "node")
    # a partner has no fewer shingles than the key's smallest node, nor than similarity allows
    smallest = many.join(crowd.select("node", "shingles"), "node").groupBy("band", "key").agg(F.min("shingles").alias("smallest"))
    n, own = F.col("shingles"), F.col("own")
    partner = F.greatest(F.col("smallest"), F.ceil(F.lit(similarity - 1e-12) * n))
    full = full.join(smallest, ["band", "key"]).where(most(n, own) >= needs(n, partner))
    full = written(full.select("band", "key", "node", "root", "degree", "fp", "keys", "shingles", "own"), "near-full")
    chosen = leaders_of(full, leaders)
    led = full.join(chosen, ["band", "key", "node"]).select(
        F.col("band").alias("led_band"), F.col("key").alias("led_key"), F.col("node").alias("leader"), F.col("root").alias("led_by"), F.col("fp").alias("print"),
        F.col("shingles").alias("count"), F.col("own").alias("alone"), F.col("keys").alias("theirs"),
    )
    first = F.array_position(F.zip_with("keys", "theirs", lambda x, y: x == y), True) == F.col("band") + 1
    overlap = F.least(most(n, own), most(F.col("count"), F.col("alone")))
    met = full.join(
        led,
        (F.col("band") == F.col("led_band")) & (F.col("key") == F.col("led_key")) & (F.col("root") != F.col("led_by"))
        & (overlap >= needs(n, F.col("count"))) & first & (_shared_bytes("fp", "print") >= LEAST_SHARED),
    )
    pairs = met.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b"))
    return pairs, full.select("band", "key", "node").join(chosen, ["band", "key", "node"], "left_anti")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = NEAR_WORDS, similarity: float = SIMILARITY
) -> DataFrame:
    """(doc_id, component_id) for each distinct non-null id; component_id is the smallest id that links reach.

    Documents link when the sets of their shingles have a Jaccard similarity of
    at least `similarity`. Plain SimHash bits are too noisy for this (at 0.8,
    two 64-bit fingerprints differ in 9 bits at the median, so that no byte
    need agree). The positional bytes are those of a min-hash print instead:
    each is a byte of the smallest shingle under the position's permutation,
    and agrees with a probability equal to the similarity. The inverted index
    holds BANDS sets of SHARED positions; pairs that meet are tallied over all
    WIDE positions, and those that reach LEAST_SHARED are verified on their
    shingle sets. Pairs at 0.8 are missed with a probability of 0.2 %, at 0.9
    of less than one in a million.

    Every pair that meets is compared, ruled out, or joined by other links:
    each node is first compared with the smallest it meets; from then on only
    nodes that no link connects are. A key with few such pairs a node compares
    them all; a fuller one compares leaders, those with most links first, with
    its other nodes and goes on without them, each time with MORE_LEADERS times
    as many, and without nodes that have too many shingles of their own to be
    like any other. A group of copies so takes a comparison or two a document;
    what is left is a crowd that meets, might be alike by its counts, and isn't.

    Texts with equal shingle sets are one class and not paired. Null and
    wordless texts are one class. Rows that share an id are one document.
    An empty table gives no rows; other columns are ignored.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    prints = written(_with_prints(source, words), "near-prints")
    classes = written(prints.groupBy("same", "fp", "shingles").agg(F.min("doc_id").alias("node")), "near-classes")
    named = prints.select("doc_id", "same").join(classes.select("same", "node"), "same").select("doc_id", "node").distinct()
    named = written(named, "near-named")
    index = _index(classes.select("node", "fp"))
    first = index.where("node > least").groupBy("node").agg(F.min("least").alias("a")).select("a", F.col("node").alias("b"))
    involved = index.select(F.col("node").alias("doc_id")).distinct()
    hashes = _with_hashes(source.join(involved, "doc_id", "left_semi"), words)
    hashes = written(hashes, "near-hashes")
    tried = written(first, "near-pairs")
    links = written(_verified(_tallied(tried, classes), hashes, similarity), "near-links")
    roots, leaders, crowd = merged(None, links), 1, None
    while True:
        few, many = apart(index, roots, links)
        met = few_pairs(few).select("a", "b")
        met = _tallied(met.distinct().join(tried, ["a", "b"], "left_anti"), classes)
        more = not many.isEmpty()
        if more:
            crowd = crowd or _crowd(many, classes, hashes)
            led, index = _led(many, crowd, leaders, similarity)
            met = met.union(led.distinct().join(tried, ["a", "b"], "left_anti"))
        met = written(met.distinct(), "near-pairs")
        if not met.isEmpty():
            tried = tried.union(met)
            new = written(_verified(met, hashes, similarity), "near-links")
            if not new.isEmpty():
                links, roots = links.union(new), merged(roots, new)
        if not more:
            break
        leaders *= MORE_LEADERS
    # rows that share an id are one document
    own = named.groupBy("doc_id").agg(F.min("node").alias("least"))
    split = named.join(own, "doc_id").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    split = written(split, "near-split")
    roots = roots if split.isEmpty() else merged(roots, split)
    return own.join(roots, own["least"] == roots["node"], "left").select(
        "doc_id", F.coalesce("root", "least").alias("component_id")
    )


def without_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = NEAR_WORDS, similarity: float = SIMILARITY
) -> DataFrame:
    """docs with one document, that of the smallest id, of each component of near_duplicates; columns as they were.

    Rows that share an id stay or go together; rows without an id stay.
    """
    groups = near_duplicates(docs, id_col, text_col, words, similarity)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
