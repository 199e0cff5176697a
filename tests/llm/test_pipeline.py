import hashlib
import random
from collections import Counter

import public_tokenizers

import corpus_pipeline
from docverify.llm import bpe, mixing, toxicity
from docverify.plans.storage import written
from tests.llm.test_operators import _components, order

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), "test-stage")
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[1] <= counts[0] and counts[2] <= counts[1] and counts[3] <= counts[2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == counts[4]


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "test-stage")
        assert docs.count() == 0


def _rows():
    """Documents with copies, near copies, toxic cues of the labels, nulls, repeats, a very long text; extra columns that clash."""
    r = random.Random(6)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "klmnp"]
    out = []
    for i in range(40):
        w = [r.choice(words) for _ in range(60)]
        out.append((1000 + i, " ".join(w), "en", f"s{i % 3}"))
        if i % 4 == 0:  # near copies: two words changed
            w[5] = w[40] = "changed"
            out.append((2000 + i, " ".join(w), "en", "s1"))
        if i % 5 == 0:  # an exact copy but for white space
            out.append((3000 + i, "  ".join(out[-1][1].split(" ")) + "\n", "en", "s2"))
    out += [(4000, "trash idiot pathetic worthless clown stupid disgusting " * 6, "en", "s0"), (4001, None, None, None), (4002, "", "en", "s0")]
    out += [(4003, " ".join(r.choice(words) for _ in range(60_000)), "en", "s1"), (None, "without an id", "en", "s2"), (None, None, None, None)]
    out += [out[0], out[1]]
    return [(*x, len(x[1] or ""), 1, 0.5) for x in out]


def test_stages_against_brute_force(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, toxic int, component_id double")
    documents = spark.read.parquet(f"{SF}/documents.parquet").unionByName(docs.drop("toxic", "component_id"))
    stages = dict(corpus_pipeline.STAGES)
    taken = lambda df: order(tuple(r)[:4] for r in df.collect())

    model = toxicity.fit(documents, labels)
    got = written(stages["toxicity"](spark, documents, SF), "test-stage")
    left = [tuple(r) for r in documents.collect() if model.score(r["text"]) < toxicity.THRESHOLD]
    assert taken(got) == order(r[:4] for r in left)

    got = written(stages["exact_dedup"](spark, docs, SF), "test-stage")
    assert got.columns == docs.columns
    best = {}
    for r in rows:
        norm = "".join(c for c in r[1] or "" if c not in " \t\n\r\x0b\x0c")
        rank = (-len(r[1] or ""), r[0] is None, r[0] or 0)
        best[norm] = min(best.get(norm, (rank, r)), (rank, r), key=lambda x: x[0])
    left = [r for _, r in best.values()]
    assert order(g[0:1] for g in taken(got)) == order(r[0:1] for r in left)

    known = [r for r in left if r[0] is not None]
    root = _components([r[1] for r in known])
    first = {}
    for r, c in zip(known, root, strict=True):
        first[c] = min(first.get(c, r[0]), r[0])
    got = written(stages["simhash"](spark, got, SF), "test-stage")
    assert order(g[0:1] for g in taken(got)) == order([*((x,) for x in first.values()), *((None,) for r in left if r[0] is None)])

    size = lambda t: len((t or "").split())
    before = got.collect()
    mixed = mixing.mix_sources(got).collect()
    after = written(stages["mixing"](spark, got, SF), "test-stage")
    assert after.columns == docs.columns
    times = Counter(tuple(r)[:4] for r in after.collect())
    assert set(times) <= {tuple(r)[:4] for r in before} and max(times.values()) <= 2
    want = {m["doc_id"]: m["taken"] for m in mixed if m["doc_id"] is not None}
    assert all(times[k] * size(k[1]) == want[k[0]] for k in (tuple(r)[:4] for r in before) if k[0] is not None)

    encoding = bpe._encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    want = []
    for r in after.collect():
        ids = encoding.encode_ordinary(r["text"] or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want.append((r["doc_id"], len(ids), digest, hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert order(map(tuple, stages["byte_bpe"](spark, after, SF).collect())) == order(want)
