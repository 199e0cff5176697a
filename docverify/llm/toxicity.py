"""Toxicity by weak supervision.

Words and word beginnings that toxic training rows favour become a lexicon;
its groups, and a few fixed patterns, are the voters. A generative label model
learns from votes alone how often each voter fires on toxic and on clean text
(accuracies) and which voters repeat each other (correlations). The labels it
infers train a linear classifier over the lexicon and the patterns, which
scores every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docverify.plans.storage import written

#: Labelled training rows that the models are fitted on, about; more are sampled by a hash of the id.
FIT_ROWS = 20_000
#: Lexicon entries, best first.
LEXICON = 800
#: Voters that share the lexicon out.
GROUPS = 24
#: Share of the toxic documents that an entry must stand in, how many at least, and the toxic share among its documents;
#: documents that are near copies of each other count as one together.
SUPPORT, LEAST, PURITY = 0.005, 2, 0.8
#: What a document without near copies weighs; whole numbers, so that sums don't depend on their order.
UNIT = 5040
THRESHOLD = 0.7
STEMS = (4, 5, 6, 7, 8)

_WORD = re.compile(r"[^\W\d_]+")
#: Pattern voters: name -> expression searched in the whole text.
PATTERNS = {
    "shouting": re.compile(r"(?:\b[A-ZÀ-Þ]{3,}\b\W+){3}"),
    "exclaims": re.compile(r"!{2,}"),
    "masked": re.compile(r"\w[*@#$%]{2,}\w"),
    "second_person": re.compile(r"\b(?:you are|you're|du bist|tu es|eres)\b", re.IGNORECASE),
    "echo": re.compile(r"\b(\w{4,})\W+\1\W+\1\b", re.IGNORECASE),
}


def split_of(doc_id: Column) -> Column:
    """Remainder of the id's checksum; 1 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def features_of(text: str) -> set[str]:
    """The words of a text, lower case, and the beginnings of the longer ones (with a trailing *)."""
    words = set(_WORD.findall(text.lower()))
    found = set(words)
    for n in STEMS:
        found.update(w[:n] + "*" for w in words if len(w) >= n)
    return found


def _sketch(text: str) -> tuple[int, int]:
    """Two minima over five-word shingles: near copies mostly share at least one."""
    words = text.lower().split()
    grams = [" ".join(g).encode() for g in zip(*(words[i:] for i in range(5)), strict=False)] or [" ".join(words).encode()]
    return tuple(min(xxhash.xxh64_intdigest(g, s) for g in grams) >> 1 for s in (1, 2))


@dataclass(frozen=True)
class ToxicityModel:
    """Fixed once fitted; small enough to travel with each task."""

    entries: dict[str, int]
    weights: np.ndarray
    bias: float

    @cached_property
    def by_length(self) -> dict[int, set[str]]:
        """The entries by the length of their beginning; whole words under 0."""
        found = {n: {e[:-1] for e in self.entries if len(e) == n + 1 and e.endswith("*")} for n in STEMS}
        return {n: own for n, own in found.items() if own} | {0: {e for e in self.entries if not e.endswith("*")}}

    def hits(self, text: str) -> set[str]:
        """The entries that a text has: features_of(text) & entries, without making all its features."""
        words = set(_WORD.findall(text.lower()))
        found = set()
        for n, own in self.by_length.items():
            if n:
                found.update(s + "*" for s in own.intersection([w[:n] for w in words if len(w) >= n]))
            else:
                found |= words & own
        return found

    def vector(self, text: str) -> dict[int, float]:
        """Sparse features: entries present, patterns, and how many entries there are."""
        hits = self.hits(text)
        base = len(self.entries)
        x = {self.entries[h]: 1.0 for h in hits}
        for i, pattern in enumerate(PATTERNS.values()):
            if pattern.search(text):
                x[base + i] = 1.0
        if hits:
            x[base + len(PATTERNS)] = float(np.log1p(len(hits)))
        return x

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.weights[i] * v for i, v in self.vector(text or "").items())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def votes(model: ToxicityModel, text: str) -> np.ndarray:
    """One 0/1 vote of each lexicon group and pattern."""
    out = np.zeros(GROUPS + len(PATTERNS), np.uint8)
    for h in model.hits(text):
        out[model.entries[h] % GROUPS] = 1
    for i, pattern in enumerate(PATTERNS.values()):
        out[GROUPS + i] = pattern.search(text) is not None
    return out


def label_model(
    v: np.ndarray, prior: float, weights: np.ndarray | None = None, rounds: int = 60
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of toxic for each row of votes; firing rates (2 x voters); residual correlations.

    Expectation maximisation over a class with the given prior and voters that
    are independent given it; what correlation is left within the classes then
    divides each voter's evidence by the number of voters it counts for.
    weights says what each row counts for (1 by default).
    """
    n, k = v.shape
    v = v.astype(float)
    u = np.ones(n) if weights is None else weights.astype(float)
    p = np.where(v[:, :GROUPS].sum(axis=1) >= 2, 0.9, 0.05)
    share = np.ones(k)
    correlation = np.zeros((k, k))
    rates = np.zeros((2, k))
    for r in range(rounds):
        for y, w in enumerate((u * (1 - p), u * p)):
            rates[y] = (w @ v + 0.5 * (u @ v) / max(u.sum(), 1e-9) + 1e-3) / (w.sum() + 0.5 + 2e-3)
        if r == rounds // 2:
            rest = v - ((1 - p)[:, None] * rates[0] + p[:, None] * rates[1])
            total = max(u.sum(), 1e-9)
            deviation = np.sqrt(np.maximum((u @ rest**2) / total - ((u @ rest) / total) ** 2, 0)) + 1e-9
            correlation = (rest.T @ (u[:, None] * rest) / total) / np.outer(deviation, deviation)
            np.fill_diagonal(correlation, 0)
            share = 1 / (1 + np.clip(correlation, 0, 1).sum(axis=1))
        fired, silent = np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0]))
        z = np.log(prior / (1 - prior)) + (v * (fired * share) + (1 - v) * (silent * share)).sum(axis=1)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return p, rates, correlation


def fit_linear(
    rows: list[dict[int, float]], labels: np.ndarray, size: int, weights: np.ndarray | None = None, l2: float = 0.02, steps: int = 400
):
    """Weights and bias of a logistic regression on soft labels, by accelerated gradient steps."""
    u = np.ones(len(rows)) if weights is None else weights.astype(float)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.fromiter((i for r in rows for i in r), np.int64)
    val = np.fromiter((x for r in rows for x in r.values()), float)
    w, b = np.zeros(size), 0.0
    grad2, grad2_b = np.full(size, 1e-8), 1e-8
    n = max(u.sum(), 1e-9)
    balance = u * np.where(labels > 0.5, n / (2 * max(u @ labels, 1)), n / (2 * max(u @ (1 - labels), 1)))
    for _ in range(steps):
        z = b + np.bincount(at, val * w[col], minlength=len(rows))
        e = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
        g, gb = np.bincount(col, val * e[at], minlength=size) / n + l2 * w / n, e.sum() / n
        grad2 += g * g
        grad2_b += gb * gb
        w -= 0.3 * g / np.sqrt(grad2)
        b -= 0.3 * gb / np.sqrt(grad2_b)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Fit on about FIT_ROWS labelled training rows; what comes to the driver is bounded by FIT_ROWS and LEXICON.

    Rows without label, id or text don't count; of several labels of an id the
    largest does. Documents that share a sketch weigh as much as one. Without a
    toxic training row the lexicon is empty and every score is low. Columns
    besides the id, the text and the label are ignored.
    """
    known = (
        labels.select(F.col(id_col).alias("__id"), F.col("toxic").alias("label"))
        .where(F.col("__id").isNotNull() & F.col("label").isNotNull() & (split_of(F.col("__id")) != 1))
        .groupBy("__id")
        .agg(F.max("label").cast("int").alias("label"))
    )
    many = known.count()
    bound = int(min(1.0, FIT_ROWS / max(many, 1)) * (1 << 32))
    chosen = known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 32)) < bound)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).where("text is not null")

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_sketch(t) for t in batch.column(0).to_pylist()]
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["text", "label", "a", "b"]
            )

    drawn = written(
        texts.join(F.broadcast(chosen), "__id")  # about FIT_ROWS ids
        .select("text", "label")
        .mapInArrow(sketched, "text string, label int, a long, b long"),
        "toxicity-drawn",
    )
    sizes = [drawn.groupBy(c).agg(F.count(F.lit(1)).alias(f"n_{c}")) for c in ("a", "b")]
    alike = F.greatest("n_a", "n_b")
    sample = written(
        drawn.join(sizes[0], "a").join(sizes[1], "b").select(
            "text", "label", F.greatest(F.lit(1), F.floor(F.lit(UNIT) / alike)).cast("long").alias("weight")
        ),
        "toxicity-sample",
    )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, y, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = toxic if y == 1 else clean
                for x in features_of(text):
                    own[x] += w
        # a feature without a toxic document in this part can't be left out: it may have one elsewhere
        names = sorted(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([toxic[x] for x in names], pa.int64()), pa.array([clean[x] for x in names], pa.int64())],
            ["feature", "toxic", "clean"],
        )

    weights = sample.groupBy("label").agg(F.sum("weight").alias("weight")).collect()
    bad = sum(r["weight"] for r in weights if r["label"] == 1)
    total = sum(r["weight"] for r in weights)
    support = max(LEAST * UNIT, SUPPORT * bad)
    best = (
        sample.mapInArrow(counted, "feature string, toxic long, clean long")
        .groupBy("feature")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where((F.col("toxic") >= support) & (F.col("toxic") >= PURITY * (F.col("toxic") + F.col("clean"))))
        .orderBy(F.desc("toxic"), "clean", "feature")
        .limit(LEXICON)
    )
    entries = {r["feature"]: i for i, r in enumerate(best.collect())}
    size = len(entries) + len(PATTERNS) + 1
    blank = ToxicityModel(entries, np.zeros(size), 0.0)

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            x = [blank.vector(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(2),
                    pa.array([votes(blank, t).tobytes() for t in texts], pa.binary()),
                    pa.array([list(r) for r in x], pa.list_(pa.int32())),
                    pa.array([list(r.values()) for r in x], pa.list_(pa.float64())),
                ],
                ["weight", "votes", "at", "x"],
            )

    found = sample.mapInArrow(voted, "weight long, votes binary, at array<int>, x array<double>")
    rows = [r for r in found.groupBy("votes", "at", "x").agg(F.sum("weight").alias("weight")).collect()]
    rows.sort(key=lambda r: (bytes(r["votes"]), r["at"], r["x"]))  # a rerun adds up in the same order
    if not rows or not entries:
        return ToxicityModel({}, np.zeros(len(PATTERNS) + 1), -4.0)
    cast = np.frombuffer(b"".join(r["votes"] for r in rows), np.uint8).reshape(len(rows), -1)
    counts = np.array([r["weight"] for r in rows], float) / UNIT
    prior = float(np.clip(bad / max(total, 1), 0.01, 0.5))
    posterior, _, _ = label_model(cast, prior, counts)
    w, b = fit_linear([dict(zip(r["at"], r["x"], strict=True)) for r in rows], posterior, size, counts)
    return ToxicityModel(entries, w, float(b))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row; only the whole text counts, a null one as empty."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([model.score(t) for t in batch.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), values], ["doc_id", "score"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(scored, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score at least threshold; columns and their order as they were.

    A null or empty text scores by the bias alone. A row is judged by its own
    whole text, so repeated rows stay or go together; an empty table stays so.
    """
    names, at = docs.columns, docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema).select(*names)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (score >= THRESHOLD).

    Null ids are no training rows and not held out. A null text counts as
    empty and scores by the bias alone. Texts are read whole, however long.
    Repeated rows come back repeated with the same score. An empty table gives
    no rows. Other columns of docs and labels are ignored, also where they are
    named alike.
    """
    model = fit(docs, labels, id_col, text_col)
    return score(docs, model, id_col, text_col).select(
        "doc_id",
        F.coalesce(split_of(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
