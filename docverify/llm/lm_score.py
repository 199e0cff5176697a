"""Cross-entropy difference of two character n-gram models.

The target model is counted over the documents labelled as good, the
background model over all documents; both have the same order, smoothing and
vocabulary (the characters of the corpus). A document's score is the mean,
over its characters, of the target model's loss less the background model's:
the lower, the more it is like the target.

Documents are dealt to blocks by their id. A block's distinct n-grams are
counted there, the models are made from all blocks' counts by joins and
groupings, and each block gets back the losses of the n-grams it holds. No
model is held whole by a task or the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docverify.plans.storage import written

ORDER = 4
#: Bits of a character in an n-gram's code; ids: 0 before the text, 1 other characters.
BITS = 16
START, OTHER = 0, 1
#: The commonest characters that get an id; bounded by the width of a code.
ALPHABET = (1 << BITS) - 2
#: Characters of text in a block, about.
BLOCK_CHARS = 4_000_000


def _points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le"), "<u4")


def alphabet(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Id of each code point: the vocabulary both models share. A table of Unicode's size at most."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = np.bincount(_points(text))
                total[: len(own)] += own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["point", "n"])

    counts = (
        docs.select(text_col)
        .mapInArrow(counted, "point long, n long")
        .groupBy("point")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "point")
        .limit(ALPHABET)
        .collect()
    )
    ids = np.full(0x110000, OTHER, np.uint64)
    for i, r in enumerate(counts):
        ids[r["point"]] = i + 2
    return ids


def codes(text: str | None, ids: np.ndarray, order: int) -> np.ndarray:
    """The code of the n-gram that ends at each character."""
    own = ids[_points(text)]
    padded = np.concatenate([np.full(order - 1, START, np.uint64), own])
    out = np.zeros(len(own), np.uint64)
    for k in range(order):
        out = (out << np.uint64(BITS)) | padded[k : k + len(own)]
    return out


def _last(code: Column, k: int) -> Column:
    """The last k characters of a code."""
    return code if k * BITS >= 64 else code.bitwiseAND(F.lit((1 << (k * BITS)) - 1).cast("long"))


def losses(grams: DataFrame, order: int, vocabulary: int) -> DataFrame:
    """(gram, loss_t, loss_b) from (gram, n_t, n_b): interpolated Witten-Bell smoothing, order by order."""
    models = ("t", "b")
    total = grams.agg(*[F.coalesce(F.sum(f"n_{m}"), F.lit(0)).alias(m) for m in models]).first()
    level = None
    for k in range(1, order + 1):
        own = grams.groupBy(_last(F.col("gram"), k).alias("g")).agg(*[F.sum(f"n_{m}").alias(f"c_{m}") for m in models])
        if k == 1:
            level = own.select(
                "g", *[((F.col(f"c_{m}") + 1) / F.lit(float(total[m] + vocabulary))).alias(f"p_{m}") for m in models]
            )
            continue
        own = own.withColumn("h", F.shiftrightunsigned("g", BITS)).withColumn("lower", _last(F.col("g"), k - 1))
        context = own.groupBy("h").agg(
            *[F.sum(f"c_{m}").alias(f"h_{m}") for m in models],
            *[F.sum((F.col(f"c_{m}") > 0).cast("long")).alias(f"kinds_{m}") for m in models],
        )
        below = level.select(F.col("g").alias("lower"), *[F.col(f"p_{m}").alias(f"q_{m}") for m in models])
        mixed = [
            F.when(F.col(f"h_{m}") == 0, F.col(f"q_{m}"))
            .otherwise(
                (F.col(f"c_{m}") + F.col(f"kinds_{m}") * F.col(f"q_{m}")) / (F.col(f"h_{m}") + F.col(f"kinds_{m}"))
            )
            .alias(f"p_{m}")
            for m in models
        ]
        level = written(own.join(context, "h").join(below, "lower").select("g", *mixed), f"lm-order{k}")
    return level.select(F.col("g").alias("gram"), *[(-F.log(f"p_{m}")).alias(f"loss_{m}") for m in models])


def score(
    docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per input row: doc_id, n_tokens, loss_target, loss_background, score.

    targets holds the ids (column id_col) of the target documents; repeated or
    unknown ids change nothing. A null or empty text has no tokens and null
    losses and score. A null id is never a target. Without targets the target
    model is uniform. Repeated rows count and come out repeated; other columns
    are ignored. Rows of one id with more text than a block are dealt over
    several; rows that repeat an id and a text stay together.
    """
    if order * BITS > 64:
        raise ValueError(f"order {order} doesn't fit a code")
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sizes = written(source.groupBy("doc_id").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1).alias("chars")), "lm-sizes")
    blocks = max(1, -(-(sizes.agg(F.sum("chars")).first()[0] or 0) // block_chars))
    # an id with more text than a block is dealt in parts, by its texts
    hot = written(sizes.where(F.col("chars") > block_chars).select(F.col("doc_id").alias("hot_id"), F.ceil(F.col("chars") / block_chars).alias("parts")), "lm-hot")
    block = lambda part: F.pmod(F.xxhash64("doc_id", part), F.lit(blocks)).alias("block")
    own_part = F.coalesce(F.pmod(F.xxhash64("text"), "parts"), F.lit(0).cast("long"))
    dealt = source.join(hot, F.col("doc_id").eqNullSafe(F.col("hot_id")), "left").select(block(own_part), "doc_id", "text")
    good = targets.select(F.col(id_col).alias("doc_id")).where("doc_id is not null").distinct().join(hot, F.col("doc_id") == F.col("hot_id"), "left")
    each_part = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    wanted = good.select("doc_id", each_part).select(block(F.col("part")), "doc_id").distinct()
    ids = alphabet(source)

    def counted(own: pa.Table, good: pa.Table) -> pa.Table:
        names = ["block", "gram", "n_t", "n_b"]
        if not own.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names=names)
        good_ids = set(good.column("doc_id").to_pylist())
        doc_ids = own.column("doc_id").to_pylist()
        found = [codes(t.as_py(), ids, order) for t in own.column("text")]
        target = np.repeat(np.array([i in good_ids for i in doc_ids], bool), [len(c) for c in found])
        grams, place = np.unique(np.concatenate(found), return_inverse=True)
        n_b = np.bincount(place, minlength=len(grams))
        n_t = np.bincount(place[target], minlength=len(grams))
        number = own.column("block")[0].as_py()
        columns = [np.full(len(grams), number, np.int64), grams.view(np.int64), n_t.astype(np.int64), n_b.astype(np.int64)]
        return pa.table([pa.array(c) for c in columns], names=names)

    counts = written(
        dealt.groupBy("block")
        .cogroup(wanted.groupBy("block"))
        .applyInArrow(counted, "block long, gram long, n_t long, n_b long"),
        "lm-counts",
    )
    corpus = written(counts.groupBy("gram").agg(F.sum("n_t").alias("n_t"), F.sum("n_b").alias("n_b")), "lm-grams")
    model = losses(corpus, order, int(ids.max()) + 1)
    replies = counts.select("block", "gram").join(model, "gram")

    def scored(own: pa.Table, known: pa.Table) -> pa.Table:
        gram = known.column("gram").to_numpy().view(np.uint64)
        by = np.argsort(gram)
        gram, loss = gram[by], [known.column(c).to_numpy()[by] for c in ("loss_t", "loss_b")]
        n, means = [], ([], [])
        for text in own.column("text"):
            found = codes(text.as_py(), ids, order)
            n.append(len(found))
            at = np.searchsorted(gram, found)
            for mean, values in zip(means, loss, strict=True):
                mean.append(float(values[at].mean()) if len(found) else None)
        arrays = [own.column("doc_id").combine_chunks(), pa.array(n, pa.int64()), *(pa.array(m, pa.float64()) for m in means)]
        return pa.table(arrays, names=["doc_id", "n_tokens", "loss_target", "loss_background"])

    return (
        dealt.groupBy("block")
        .cogroup(replies.groupBy("block"))
        .applyInArrow(scored, f"doc_id {kind}, n_tokens long, loss_target double, loss_background double")
        .withColumn("score", F.col("loss_target") - F.col("loss_background"))
    )
