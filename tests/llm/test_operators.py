"""Each operator against a brute-force version, with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard

from docverify.llm import bpe, exact_dedup, image_copies, language, mixing, simhash, token_files, toxicity, warc
from docverify.plans.storage import new_path, written

ODD = " \t\n\r\x0b\x0c\x1c\x85\xa0　'sdtmlreVABéß漢字01²½!?,.<|>-_🙂́"
SCHEMA = "doc_id long, text string, lang string, source string, tag long, salt string, n long, key string"


def rows_of(n=80, seed=3):
    r = random.Random(seed)
    words = ["alpha", "beta", "the", "of", "Ümlaut", "漢字", "x1", "don't"]
    out = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 30))), "en", f"s{i % 3}") for i in range(n)]
    out += [(n + i, "".join(r.choice(ODD) for _ in range(r.randint(0, 40))), None, None) for i in range(n)]
    out += [(900, None, "en", None), (901, "", "en", "s0"), (902, " \n", "fr", "s1"), (903, None, None, "s1")]
    out += [(910 + i, "same text  here" + " " * (i % 3), "en", "s0") for i in range(40)] + [(910, "same text  here", "en", "s0")]
    out += [(None, "no id", "en", "s2"), (None, None, None, None), (990, "long " * 30_000, "en", "s2")]
    return [(*x, 7, "clash", 1, "k") for x in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


# --- 1


def test_mix_meets_targets(docs):
    got = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(5)).collect()
    assert order(map(tuple, got)) == order(map(tuple, again))
    assert len(got) == len(rows_of())
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    total = sum(r["size"] for r in got)
    sizes = {s: sum(r["size"] for r in v) for s, v in by.items()}
    names = sorted((s for s in by if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, full = {}, set()
    while True:  # share again what capped sources leave
        left = 1.5 * total - sum(2 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        target = {s: 2.0 * sizes[s] for s in full} | {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if target[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    for s, v in by.items():
        assert {r["source_size"] for r in v} == {sizes[s]}
        assert v[0]["target"] == pytest.approx(target[s])
        assert abs(sum(r["taken"] for r in v) - target[s]) <= max(r["size"] for r in v) + 1e-6
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in v)


def test_mix_applies(docs, empty):
    mix = mixing.mix_sources(docs)
    out = mixing.apply_mix(docs, mix)
    assert out.columns == docs.columns
    assert out.count() == sum(r["times"] for r in mix.collect())
    assert mixing.mix_sources(empty).count() == 0


def test_pivotal_rounding_keeps_expectations(spark):
    got = defaultdict(int)
    base = spark.createDataFrame([(i, "w " * (1 + i % 4), f"s{i % 2}") for i in range(400)], "doc_id long, text string, source string")
    for r in mixing.mix_sources(base, share=0.9, weights=(1, 1), max_repeat=2).collect():
        got[r["size"]] += r["times"] / 100
    want = {1: 1.125, 3: 1.125, 2: 0.75, 4: 0.75}  # target / size of the sources
    assert all(abs(v - want[k]) < 0.15 for k, v in got.items())


# --- 2


def test_language(spark, empty):
    r = random.Random(1)
    parts = {"xx": ["thing", "over", "with", "and"], "yy": ["être", "voilà", "çale", "où"]}
    rows = [(i, " ".join(r.choice(parts[k]) for _ in range(30)), k, "s") for i in range(300) for k in [("xx", "yy")[i % 2]]]
    rows += [(1000, None, "xx", "s"), (1001, "12 !?", "xx", "s"), (None, "thing over", "xx", "s"), (1002, "", None, None)]
    got = language.languages(spark.createDataFrame([(*x, 1, "c", 1, "k") for x in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {g["doc_id"]: g for g in got}
    for i, _, k, _ in rows[:300]:
        assert by[i]["lang_pred"] == k and 0 <= by[i]["score"] <= 1
        assert by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert all(by[i]["lang_pred"] == "und" for i in (1000, 1001, 1002))
    assert by[None]["lang_pred"] == "xx" and by[None]["held_out"] is False
    assert language.languages(empty).count() == 0


def test_language_against_plain_compression(spark):
    """Every prediction again from the dictionaries, one text and one piece at a time."""
    r = random.Random(2)
    parts = {"aa": ["thing", "over", "with"], "bb": ["être", "voilà", "où"], "cc": ["über", "nicht", "auch"]}
    rows = [(i, " ".join(r.choice(parts[k]) for _ in range(r.randint(1, 60))), k) for i in range(240) for k in [("aa", "bb", "cc")[i % 3]]]
    # a language seen in long texts only, marks without a letter, a very long text, a tie, repeated rows
    rows += [(300 + i, " ".join(r.choice(["ngoma", "kila", "pole"]) for _ in range(3000)), "dd") for i in range(12)]
    rows += [(400, "\u0301\u0302", "aa"), (401, "over " * 60_000, None), (402, "q", None), (403, "q", None), (7, rows[7][1], rows[7][2])]
    docs = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, lang string, lang_pred string")
    contents = language.dictionaries(docs)
    assert set(contents) == {"aa", "bb", "cc", "dd"}
    packers = {}
    for k, content in contents.items():
        raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packers[k] = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=raw, write_content_size=False)
    got = order((g["doc_id"], g["lang_pred"]) for g in language.languages(docs).collect())
    want = []
    for i, t, _ in rows:
        kept = "".join(c if c.isalpha() or c in "\u0301\u0302" else " " for c in t)
        data = " ".join(kept.split()).lower().encode() if any(c.isalpha() for c in t) else b""
        sizes = {k: sum(len(p.compress(data[a : a + language.PIECE])) for a in range(0, len(data), language.PIECE)) for k, p in packers.items()}
        best = min(sizes, key=lambda k: (sizes[k], list(contents).index(k)))
        want.append((i, best if data else "und"))
    assert got == order(want)
    assert dict(got)[300] == "dd"


# --- 3


def test_images_cropped_and_edited(spark):
    r = np.random.default_rng(5)
    rows = []
    for i in range(12):
        a = np.kron(r.integers(0, 256, (10, 10)), np.ones((9, 9))).astype(np.uint8)
        cut = np.ascontiguousarray(np.clip(a[13:, 5:] * 0.7 + 30, 0, 255).astype(np.uint8))
        turned = np.ascontiguousarray(np.rot90(a))
        rows += [(10 * i, *a.shape, a.tobytes()), (10 * i + 1, *cut.shape, cut.tobytes()), (10 * i + 2, *turned.shape, turned.tobytes())]
        rows += [(10 * i + 3, *a.shape, a.tobytes())]
    rows += [(990, 5, 5, None), (991, 0, 0, b""), (992, 9, 9, b"\0" * 81), (993, 3, 3, b"12"), (None, 5, 5, b"\1" * 25)]
    got = image_copies.image_copies(spark.createDataFrame(rows, "image_id long, height int, width int, pixels binary")).collect()
    assert len(got) == len(rows)
    classes = {g["image_id"]: g["class_id"] for g in got}
    for i in range(12):
        assert {classes[10 * i + k] for k in range(4)} == {10 * i}
    assert [classes[i] for i in (990, 991, 992, 993)] == [990, 991, 992, 993]


def test_images_against_all_pairs(spark, monkeypatch):
    """A large group of noisy copies, edited ones and others, by the same comparison of all pairs."""
    from docverify.operators import contraction

    monkeypatch.setattr(contraction, "FEW", 1)  # fuller keys have leaders
    r = np.random.default_rng(9)
    drawn = [np.kron(r.integers(30, 220, (9, 9)), np.ones((8, 8))) for _ in range(12)]
    pictures = [*drawn, *(np.clip(drawn[0] + r.normal(0, 2, drawn[0].shape), 0, 255) for _ in range(25))]
    pictures += [d[5:, 6:] * 0.8 + 20 for d in drawn[3:9]]
    rows = [(i, *p.shape, np.ascontiguousarray(p.astype(np.uint8)).tobytes(), "clash") for i, p in enumerate(pictures)]
    rows += [rows[4], rows[4]]
    images = spark.createDataFrame(rows, "image_id long, height int, width int, pixels binary, class_id string")
    known = {k["image_id"]: k["features"] for k in image_copies.features(images).collect()}
    root = list(range(len(pictures)))
    for b in range(len(pictures)):
        for a in range(b):
            if image_copies.consensus(known[a], known[b]) >= image_copies.MIN_CONSENSUS:
                x, y = sorted((root[a], root[b]))
                root = [x if z == y else z for z in root]
    got = image_copies.image_copies(images).collect()
    assert order([g["image_id"], g["class_id"]] for g in got) == order([r[0], root[r[0]]] for r in rows)
    assert len(set(root)) == 12 and image_copies.image_copies(images.limit(0)).count() == 0


def test_image_links_without_a_shared_key(spark, monkeypatch):
    """Descriptors that differ in few bits, some of them in every table's key, and all pairs over several blocks."""
    r = np.random.default_rng(4)
    flipped = np.zeros(256, np.uint8)
    flipped[[k[0] for k in image_copies._KEYED]] = 1
    flip = np.packbits(flipped).view("<u8")
    rows = []
    for i in range(40):
        words = r.integers(0, 1 << 63, (image_copies.MIN_CONSENSUS + i % 2, 4)).astype("<u8")
        places = np.column_stack([r.integers(0, 60, (len(words), 2)), np.ones(len(words)), np.zeros(len(words))]).astype("<f4")
        for image_id, w in ((2 * i, words), (2 * i + 1, words ^ flip if i % 4 else words[1:] ^ flip)):
            p = places[-len(w) :]
            rows.append((image_id, p.tobytes() + w.tobytes(), image_copies.table_keys(w).tolist()))
    known = {i: f for i, f, _ in rows}
    assert not set(rows[2][2]) & set(rows[3][2])
    want = {(a, b) for b in known for a in range(b) if image_copies.consensus(known[a], known[b]) >= image_copies.MIN_CONSENSUS}
    assert (2, 3) in want and (0, 1) not in want and len(want) == 30
    found = spark.createDataFrame(rows, "image_id long, features binary, keys array<long>")
    for images, tile in ((4096, 16), (10, 3)):
        monkeypatch.setattr(image_copies, "BLOCK_IMAGES", images)
        monkeypatch.setattr(image_copies, "TILE_IMAGES", tile)
        monkeypatch.setattr(image_copies, "TILE_CORNERS", tile * 5)
        linked, roots = image_copies.links(found)
        assert {(x["a"], x["b"]) for x in linked.collect()} == want
        assert {(x["node"], x["root"]) for x in roots.collect()} == {(i, a) for a, b in want for i in (a, b)}


def test_image_index_leaves_no_near_descriptor_out(spark, monkeypatch):
    """Corners at exactly MAX_DIFFERENT bits, spread over all words and parts or heaped; one more bit makes no match."""
    monkeypatch.setattr(image_copies, "TILE_CORNERS", 500)
    r, n, rows = np.random.default_rng(6), image_copies.MIN_CONSENSUS, []
    for i in range(60):
        words = r.integers(0, 1 << 63, (n, 4)).astype("<u8")
        bits = np.unpackbits(words.view(np.uint8), axis=1)
        for k in range(n):
            few = image_copies.MAX_DIFFERENT + (i % 3 == 2 and k == 0)
            bits[k, r.permutation(256)[:few] if i % 2 else (np.arange(few) + 5 * i) % 256] ^= 1
        places = np.column_stack([r.integers(0, 60, (n, 2)), np.ones(n), np.zeros(n)]).astype("<f4").tobytes()
        for image_id, w in ((2 * i, words), (2 * i + 1, np.packbits(bits, axis=1).view("<u8"))):
            rows.append((image_id, places + w.tobytes(), image_copies.table_keys(w).tolist()))
    found = spark.createDataFrame(rows, "image_id long, features binary, keys array<long>")
    got = image_copies.apart_links(found, spark.createDataFrame([(0, 0), (1, 0)], "node long, root long")).collect()
    assert {(g["a"], g["b"]) for g in got} == {(2 * i, 2 * i + 1) for i in range(1, 60) if i % 3 != 2}
    assert {g["consensus"] for g in got} == {n}


def test_all_links_of_a_group_of_images_count(spark):
    """n_links is the number of all classes that a class links to, within a group of copies too."""
    r = np.random.default_rng(9)
    drawn = [np.kron(r.integers(30, 220, (9, 9)), np.ones((8, 8))) for _ in range(3)]
    pictures = [*drawn, *(np.clip(drawn[0] + r.normal(0, 2, drawn[0].shape), 0, 255) for _ in range(25)), drawn[1][5:, 6:] * 0.8 + 20]
    rows = [(i, *p.shape, np.ascontiguousarray(p.astype(np.uint8)).tobytes()) for i, p in enumerate(pictures)]
    images = spark.createDataFrame([*rows, (99, *rows[0][1:])], "image_id long, height int, width int, pixels binary")
    known = {k["image_id"]: k["features"] for k in image_copies.features(images).collect()}
    pairs = [(a, b) for b in range(len(rows)) for a in range(b) if image_copies.consensus(known[a], known[b]) >= image_copies.MIN_CONSENSUS]
    got = {g["image_id"]: g["n_links"] for g in image_copies.image_copies(images).collect()}
    assert got == {i: sum(i % 99 in pair for pair in pairs) for i in [*range(len(rows)), 99]} and got[0] == 25


def test_images_are_dealt_once(spark, monkeypatch):
    """What is shuffled doesn't grow with the pairs of blocks."""
    monkeypatch.setattr(image_copies, "BLOCK_IMAGES", 5)
    found = spark.range(40).selectExpr("id AS image_id", "cast('' AS binary) AS features")
    plan = image_copies.apart_links(found)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "explode" not in plan


def test_image_copies_stored(spark, monkeypatch):
    """Images are dealt to few tasks, and neither keys nor pairs that are no links are written."""
    assert image_copies.apart_blocks(56_411, 12) == 4 and image_copies.apart_blocks(100, 12) == 2
    labels = []
    monkeypatch.setattr(image_copies, "written", lambda df, label: labels.append(label) or written(df, label))
    vectors = spark.createDataFrame([(i, [float((i * k) % 11) for k in range(1, 17)]) for i in range(12)], "vec_id long, embedding array<double>")
    image_copies.image_copies(image_copies.images_of_vectors(vectors)).count()
    assert labels == ["image-ids", "image-features", "links"]


# --- 4


def test_exact_dedup(docs, empty):
    rows = rows_of()
    norm = {}
    groups = defaultdict(list)
    for i, t, *_ in rows:
        n = "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
        groups[n].append((-len(t or ""), i is None, i or 0, i))
        norm[n] = hashlib.sha256(n.encode()).hexdigest()
    for hot in (4, 256):
        got = exact_dedup.exact_duplicates(docs, hot_rows=hot).collect()
        want = sorted((norm[n], min(g)[3], len(g)) for n, g in groups.items() for _ in g)
        key = lambda r: (r[0], r[1] or 0)
        assert sorted(((r["text_sha256"], r["keep_id"], r["group_size"]) for r in got), key=key) == sorted(want, key=key)
        kept = [r for r in got if r["kept"]]
        assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)
        whole = exact_dedup.distinct_documents(docs, hot_rows=hot)
        assert whole.columns == docs.columns
        assert order([r["doc_id"]] for r in whole.collect()) == order([r["doc_id"]] for r in kept)
    assert exact_dedup.exact_duplicates(empty).count() == 0


# --- 5


def brute_fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, empty):
    r = random.Random(2)
    base = [r.choice("abcdefgh") + str(r.randint(0, 99)) for _ in range(150)]
    rows = rows_of(20)
    for i in range(60):
        w = list(base)
        for _ in range(i % 4):
            w[r.randrange(150)] = "changed"
        rows.append((2000 + i, " ".join(w), None, None, 1, "c", 1, "k"))
    got = simhash.simhash_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    prints = [(x[0], brute_fingerprint(x[1])) for x in rows]
    distinct = sorted({f for _, f in prints})
    parent = {f: f for f in distinct}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    want = [(i, f"{f:016x}", least.get(root(f))) for i, f in prints]
    assert order((g["doc_id"], g["fingerprint"], g["component_id"]) for g in got) == order(want)
    assert simhash.simhash_duplicates(empty).count() == 0


def test_byte_index_finds_every_close_pair(spark):
    r = random.Random(4)
    seeds = [r.getrandbits(64) for _ in range(40)]
    fps = sorted({s ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for s in seeds for _ in range(6)})
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    got = simhash.similar_fingerprints(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()
    want = {tuple(sorted((signed(a), signed(b)))) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
    assert sorted(map(tuple, got)) == sorted(want)


def test_byte_index_is_not_broadcast(spark):
    """An entry for each set of positions isn't sent through the driver, however small the fingerprints' own table is."""
    plan = simhash.similar_fingerprints(spark.range(1000).selectExpr("xxhash64(id) AS fp"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_near_duplicates_go(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(i, text, "en", "s", 1, "c", 1, "k") for i in (5, 3, 9)] + [(None, text, "en", "s", 1, "c", 1, "k"), (1, "other", "en", "s", 1, "c", 1, "k")]
    left = simhash.without_near_duplicates(spark.createDataFrame(rows, SCHEMA), words=5)
    assert order([r["doc_id"]] for r in left.collect()) == order([[1], [3], [None]])


def _components(texts, similarity=0.8):
    """Root of each text by all pairs of five-word shingle sets."""

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) and root[a] != root[b]:
                x, y = root[a], root[b]
                root = [min(x, y) if z in (x, y) else z for z in root]
    return root


def test_near_duplicates_against_all_pairs(spark):
    r = random.Random(7)
    words = lambda n: [r.choice("abcdefgh") + str(r.randint(0, 999)) for _ in range(n)]
    texts = ["", None, " ", "One two", "one TWO", "one two three"]
    for _ in range(12):
        base = words(r.choice([30, 200, 900]))
        for _ in range(r.choice([2, 40])):
            w = list(base)
            for _ in range(r.randrange(1 + len(w) // 20)):
                w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    rows = [(i, t, None, None, 1, "c", 1, "k") for i, t in enumerate(texts)]
    root = _components(texts)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {g["doc_id"]: g["component_id"] for g in simhash.near_duplicates(docs).collect()}
    assert got == dict(enumerate(root))
    assert sorted(x["doc_id"] for x in simhash.without_near_duplicates(docs).collect()) == sorted(set(root))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_in_crowds(spark):
    """Two large groups that one link joins, and a crowd around a text that mostly isn't similar enough."""
    r = random.Random(11)
    one = [f"a{i}" for i in range(170)]
    chain = [list(one)]
    for step in range(1, 3):  # one edit a step; the ends are not similar, each step is
        chain.append([*chain[-1][: 30 * step], *(f"s{step}x{i}" for i in range(9)), *chain[-1][30 * step + 9 :]])
    texts = []
    for group, many in ((chain[0], 60), (chain[1], 1), (chain[2], 60)):
        for i in range(many):
            texts.append(" ".join([*group, f"end{len(texts)}"]) if many > 1 else " ".join(group))
    base = [f"b{i}" for i in range(150)]
    for i in range(150):
        w = list(base)
        for k in range(r.choice([1, 2, 3, 4, 5, 6, 8])):
            w[r.randrange(len(w))] = f"new{i}x{k}"
        texts.append(" ".join(w))
    r.shuffle(texts)
    rows = [(i, t, None, None, 1, "c", 1, "k") for i, t in enumerate(texts)]
    got = {g["doc_id"]: g["component_id"] for g in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == dict(enumerate(_components(texts)))


def test_near_duplicates_of_repeated_ids(spark):
    """Rows that share an id are one document, so they join what each of them is like."""
    a, b = " ".join(f"a{i}" for i in range(100)), " ".join(f"b{i}" for i in range(100))
    rows = [(5, a), (5, b), (3, a), (2, b + " more"), (None, a), (9, "alone")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, component_id string")
    got = {g["doc_id"]: g["component_id"] for g in simhash.near_duplicates(docs).collect()}
    assert got == {2: 2, 3: 2, 5: 2, 9: 9}
    assert order([r["doc_id"]] for r in simhash.without_near_duplicates(docs).collect()) == order([[2], [9], [None]])


# --- 6


def test_bpe_round_trip(docs, empty):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoding = bpe._encoding(path, public_tokenizers.PATTERN)
    want = []
    for i, t, *_ in rows_of():
        ids = encoding.encode_ordinary(t or "")
        text = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want.append((i, len(ids), text, hashlib.sha256((t or "").encode()).hexdigest()))
    assert order(map(tuple, bpe.digests(docs, path).collect())) == order(want)
    assert bpe.digests(empty, path).count() == 0


def test_splitter_equals_the_pattern():
    import regex

    from docverify.llm.pretokens import splitter

    r = random.Random(4)
    full, quick = regex.compile(public_tokenizers.PATTERN).findall, splitter(public_tokenizers.PATTERN)
    every = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000))]
    texts = [" a".join(every[i : i + 211]) for i in range(0, len(every), 211)]
    for _ in range(500):
        pool = r.choice([every, every[:0x300], every[:0xD800], list(" \n\t'sa1é²Ⅷ\x1c\x85\u2028\u3000x")])
        texts.append("".join(r.choice(pool) for _ in range(r.randrange(60))))
    assert all(quick(t) == full(t) for t in texts)
    odd = r"(?i:'s)|\p{Lu}+|\s+"  # more than the quick way knows
    assert splitter(odd)("A'S bC") == regex.findall(odd, "A'S bC")


def test_bpe_small_blocks(docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    whole, small = bpe.encode(docs, path), bpe.encode(docs, path, block_chars=300)
    assert order((r[0], tuple(r[1])) for r in whole.collect()) == order((r[0], tuple(r[1])) for r in small.collect())


def test_bpe_where_rows_come_in_another_order(spark, docs):
    """Both branches, and a task that runs again, see the same rows, though the input deals them anew each time."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import LongType

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    @F.udf(LongType())
    def dealt(_):
        return random.SystemRandom().randrange(1 << 60)

    shuffled = docs.withColumn("deal", dealt.asNondeterministic()("n")).repartition(3, "deal").sortWithinPartitions("deal").drop("deal")
    want = order((r[0], tuple(r[1])) for r in bpe.encode(docs, path).collect())
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        for _ in range(2):
            assert order((r[0], tuple(r[1])) for r in bpe.encode(shuffled, path, block_chars=300).collect()) == want
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


# --- 8


def test_warc(spark):
    rows = [(1, "http://a/ b\r\n", "x" * 200), (2, None, "x" * 200), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (5, "u", None)]
    rows += [(6, "é", "ü漢" * 60), (7, "z", "ü漢" * 60), (7, "z", "ü漢" * 60), (None, "z", "x" * 200), (8, "big", "<p>" * 500_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    got = order(map(tuple, warc.round_trip(pages).collect()))
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == data and j is not None]
        first = min(same, default=None)
        again = len(data) >= 100 and first is not None and i != first
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == order(want)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_reader_rejects():
    import io

    good = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert warc.parse(good)["payload"] == b"payload"
    for bad in (good[:-1], good.replace(b"payload\r\n", b"paYload\r\n"), good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"Date")):
        with pytest.raises(ValueError):
            warc.parse(bad)
    lead = struct.pack("<II", warc.DICTIONARY_FRAME, 0)
    frame = zstandard.ZstdCompressor().compress(good)
    assert list(warc.read_records(io.BytesIO(lead + frame * 3))) == [good] * 3
    for bad in (frame, lead + frame[:-5], b""):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.read_records(io.BytesIO(bad)))


# --- 9


def test_token_files(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = token_files._tokenizer(path)
    folder = new_path(docs.sparkSession, "tokens")
    files = token_files.write_token_files(docs, path, folder)
    got = sorted((r["start"], r["doc_id"], bytes(r["ids"])) for r in token_files.read_token_files(files, folder).collect())
    rows = sorted(rows_of(), key=lambda r: (r[0] is not None, r[0] or 0))
    want = {i: [] for i, *_ in rows}
    for i, t, *_ in rows:
        want[i].append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
    at = 0
    for (start, i, ids), row in zip(got, rows, strict=True):
        assert (start, i) == (at, row[0]) and ids in want[i]
        at += len(ids) // 4
    assert token_files.token_file_digests(empty, path).count() == 0


def test_special_string_as_whole_text():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["a  <|endoftext|> b", "<|endoftext|>", "plain  text\n\n x"]
    whole = [np.array(token_files._tokenizer(path).encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert token_files.Ids(path).of(texts) == whole


def test_ids_beyond_the_memo():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [" ".join(f"w{i * k % 97}x" for i in range(60)) for k in range(1, 9)]
    whole = [np.array(token_files._tokenizer(path).encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    ids = token_files.Ids(path, memo=10)
    assert [ids.of([t])[0] for t in texts] == whole and len(ids.numbers) == 10


def test_ids_of_single_pretokens():
    """Every ASCII character alone, after a space and in a word, and others: as the tokenizer's own byte letters give."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = token_files.Ids(path)
    words = [f"{a}{chr(c)}{b}" for c in range(128) for a, b in (("", ""), (" ", ""), ("a", "b"))] + [" é", "ñandú", "日本", " 😀", "  ", ""]
    letters = [w.encode().decode("latin-1").translate(token_files._LETTERS) for w in words]
    want = [[t.id for t in token_files._tokenizer(path).model.tokenize(w)] for w in letters]
    flat, sizes = ids._words(words)
    assert sizes.tolist() == [len(w) for w in want] and flat.tolist() == sum(want, [])


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 400_000])
def test_rans_round_trip_from_every_checkpoint(n):
    ids = (np.random.default_rng(n).pareto(1.0, n) * 3).clip(0, 50_000).astype(np.uint32)
    table = token_files.Table.of_counts(np.bincount(ids, minlength=3))
    assert table.freq.sum() in (0, 1 << token_files.SCALE)
    freq, starts = table.freq.astype(np.uint64), table.starts
    coded = token_files.rans_encode(ids, freq, starts)
    for k in range(max(1, len(coded[0]))):
        back = token_files.rans_decode(*coded, n, freq, starts, table.slots, k)
        assert (back == ids[k * token_files.CHECKPOINT * token_files.LANES :]).all()


def test_damaged_block_is_found():
    import io

    ids = np.arange(5000, dtype=np.uint32) % 7
    table = token_files.Table.of_counts(np.bincount(ids))
    body = b"".join(token_files.block_bytes(0, 0, 0, [1], np.array([5000]), ids, table.freq.astype(np.uint64), table.starts))
    head = token_files.MAGIC + struct.pack("<I", 5)
    (found,) = token_files.read_blocks(io.BytesIO(head + body), table, 5)
    assert (found[5] == ids).all() and found[3] == [1]
    for bad in (head + body[:-1], head + body[:-9] + bytes([body[-9] ^ 1]) + body[-8:], b"x" + head + body):
        with pytest.raises(ValueError):
            list(token_files.read_blocks(io.BytesIO(bad), table, 5))


# --- 10


def test_toxicity(spark, empty):
    r = random.Random(8)
    plain, bad = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)], ["nastyone", "nastytwo", "vileness"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        w = [r.choice(plain) for _ in range(40)] + ([r.choice(bad) for _ in range(4)] if toxic else [])
        r.shuffle(w)
        rows.append((i, " ".join(w), "en", "s", 1, "c", 1, "k"))
        labels.append((i, 1, int(toxic)))
    rows += [(5000, None, None, None, 1, "c", 1, "k"), (5001, "", None, None, 1, "c", 1, "k"), (None, "x", None, None, 1, "c", 1, "k")]
    docs = spark.createDataFrame(rows, SCHEMA)
    table = spark.createDataFrame([*labels, (3, 1, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, table).collect()
    assert len(got) == len(rows)
    by = {g["doc_id"]: g for g in got}
    held = [(by[i]["predicted"], y) for i, _, y in labels if by[i]["held_out"]]
    assert len(held) > 200 and sum(p == y for p, y in held) / len(held) > 0.97
    assert all(0 <= g["score"] <= 1 for g in got) and by[5000]["predicted"] == by[5001]["predicted"] == 0
    model = toxicity.fit(docs, table)
    assert toxicity.keep_clean(docs, model).count() == sum(g["predicted"] == 0 for g in got)
    assert toxicity.toxicity(empty, table).count() == 0
    assert toxicity.toxicity(docs, table.limit(0)).where("predicted = 1").count() == 0


def test_toxicity_of_odd_rows(spark):
    """Few toxic rows, near copies with different labels, clashing columns, repeats, a very long text."""
    r = random.Random(5)
    plain = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    rows = [(i, " ".join(r.choice(plain) for _ in range(30)) + (" vileness nasty" if i % 9 == 0 else "")) for i in range(90)]
    rows += [(200, rows[0][1]), (201, rows[1][1]), (9, rows[9][1]), (300, "worda " * 40_000), (301, "vileness nasty " * 20_000)]
    docs = spark.createDataFrame([(i, t, 1, 0.5, 7) for i, t in rows], "doc_id long, text string, toxic int, label double, weight int")
    labels = [(i, 1, int(i % 9 == 0)) for i in range(90)] + [(200, 1, 0), (201, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model, again = toxicity.fit(docs, table), toxicity.fit(docs.repartition(5), table.repartition(3))
    assert model.entries == again.entries and model.bias == again.bias and (model.weights == again.weights).all()
    got = toxicity.toxicity(docs, table).collect()
    assert len(got) == len(rows)
    # the score again, from the definition: patterns and entries that a text has, one by one
    by_id = {}
    for i, t in rows:
        found = {e: model.weights[n] for e, n in model.entries.items() if e in toxicity.features_of(t)}
        z = model.bias + sum(found.values()) + sum(
            model.weights[len(model.entries) + k] for k, p in enumerate(toxicity.PATTERNS.values()) if p.search(t)
        )
        z += model.weights[-1] * np.log1p(len(found)) if found else 0
        by_id[i] = 1 / (1 + np.exp(-z))
    assert all(abs(g["score"] - by_id[g["doc_id"]]) < 1e-9 for g in got)
    # with few toxic rows the scores still tell them apart
    held = [(by_id[i], i % 9 == 0) for i in range(90) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert min(z for z, bad in held if bad) > max(z for z, bad in held if not bad)
    assert by_id[301] > max(z for z, bad in held if not bad)


def test_label_model_finds_accuracy_and_copies():
    r = np.random.default_rng(0)
    y = r.random(6000) < 0.2
    k = toxicity.GROUPS + len(toxicity.PATTERNS)
    v = np.zeros((6000, k), np.uint8)
    for j in range(6):
        v[:, j] = np.where(y, r.random(6000) < 0.5 + 0.05 * j, r.random(6000) < 0.02)
    v[:, 6] = v[:, 0]  # a voter that repeats another
    p, rates, correlation = toxicity.label_model(v, 0.2)
    assert ((p > 0.5) == y).mean() > 0.97
    assert np.allclose(rates[1, 1:6], 0.55 + 0.05 * np.arange(5), atol=0.06)
    assert correlation[0, 6] > 0.9 and abs(correlation[1, 2]) < 0.2
