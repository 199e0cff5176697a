"""Decontamination, the prefix trie and spelling variants against brute force, with odd rows and small bounds."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docverify.llm import decontaminate, prefix_trie, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


# --- 11

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOC = "doc_id long, text string, item_id long, words string, spans string, n_hit long"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def bench_rows():
    r = random.Random(5)
    vocab = ["One", "two", "THREE", "vier", "Fünf", "漢字", "x1", "sept", "Ω"]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([3, 9, 10, 11, 25])))) for i in range(30)]
    return rows + [(50, rows[0][1]), (51, None), (52, ""), (53, " - "), (None, "no id of this item"), (54, "short"), (2, rows[3][1]), (2, rows[3][1])]


def doc_rows():
    r, items = random.Random(7), [t for _, t in bench_rows() if t]
    out = [(i, " ".join(r.choice(["a", "b", "two", "vier", "x1", "Fünf"]) for _ in range(r.randint(0, 40)))) for i in range(40)]
    for i in range(60):  # items, whole or cut, within other words, in other case and with other breaks
        item = r.choice(items).split(" ")
        part = item[r.randint(0, 2) :]
        out.append((100 + i, f"lead{i}, {r.choice([' ', chr(10), ' -- ']).join(part).upper()}. after"))
    out += [(200, None), (201, ""), (202, " \x00\x7f"), (None, items[0]), (None, None), (203, items[0]), (203, items[0])]
    out += [(204, "Short!" * 3), (205, "a " * 30_000 + items[1] + " b" * 30_000), (206, "x" * 700_000 + " short " + items[2])]
    return [(*x, 1, "clash", None, 9) for x in out]


def contamination_by_hand(docs, items, n=10):
    windows = defaultdict(set)
    for i, text in items:
        w = words(text)
        for p in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[p : p + n])].add(i)
    lengths, out = {len(w) for w in windows}, []
    for doc_id, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for m in lengths:
            for p in range(len(w) - m + 1):
                if (own := windows.get(tuple(w[p : p + m]))) is not None:
                    hit |= set(range(p, p + m))
                    found |= own
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return order(out)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(bench_rows(), "item_id long, text string")


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(doc_rows(), DOC).repartition(3)


@pytest.mark.parametrize("bound", [decontaminate.BROADCAST_BYTES, 0])
def test_contamination(spark, texts, bench, bound):
    got = decontaminate.contamination(texts, bench, bound=bound, bits=12).drop("items").collect()
    assert order(got) == contamination_by_hand(doc_rows(), bench_rows())
    none = decontaminate.contamination(texts, bench.limit(0), bound=bound, bits=12).collect()
    assert len(none) == len(doc_rows()) and not any(r.contaminated for r in none)
    assert decontaminate.contamination(texts.limit(0), bench, bound=bound, bits=12).count() == 0


def test_small_blocks_find_the_same(spark, bench, monkeypatch):
    """Blocks of few bytes, sums over few bytes: the same hits (in this process, as workers have the usual bounds)."""
    known = decontaminate.TestSet([tuple(r) for r in decontaminate.test_windows(bench).collect()])
    texts = pa.array([t or "" for _, t, *_ in doc_rows() if t is None or len(t) < 5000])

    def found():
        out = []
        for i, _, words, _ in decontaminate.blocks(texts.slice(3)):
            firsts = [0, *words.per_text.cumsum().tolist()]
            out += sorted((i + int(words.text[at]), at - firsts[words.text[at]], m) for at, m, _ in known.hits(words))
        return out

    usual = found()
    monkeypatch.setattr(decontaminate, "BLOCK", 50)
    monkeypatch.setattr(decontaminate, "STRETCH", 16)
    assert usual and found() == usual


@pytest.mark.parametrize("bound", [decontaminate.BROADCAST_BYTES, 0])
def test_decontaminated(texts, bench, bound):
    by_hand = Counter(r[0] for r in contamination_by_hand(doc_rows(), bench_rows()) if not r[5])
    clean = decontaminate.decontaminated(texts, bench, spans_only=False, bound=bound, bits=12)
    assert clean.columns == texts.columns
    assert Counter(r.doc_id for r in clean.collect()) == by_hand
    cut = decontaminate.decontaminated(texts, bench, bound=bound, bits=12).collect()
    assert len(cut) == len(doc_rows())
    before = {r[0]: r[1] for r in doc_rows() if r[0] is not None}
    counts = {r[0]: r for r in contamination_by_hand(doc_rows(), bench_rows()) if r[0] is not None}
    for r in cut:
        assert (r.item_id, r["words"], r.spans, r.n_hit) == (1, "clash", None, 9)
        if r.doc_id in counts:
            _, n_words, n_hit, *_ = counts[r.doc_id]
            assert r.text == before[r.doc_id] if not n_hit else len(words(r.text)) == n_words - n_hit
    assert {r.text for r in cut if r.doc_id == 204} == {"!"}  # hit words next to each other go with what parts them


# --- 12


def turn_rows():
    r = random.Random(11)
    says = ["hi", "hello", "", None, "a b", "漢字 🙂", "ok"]
    rows = []
    for c in [*range(0, 60), *range(100, 130), *range(207, 220), *range(300, 330)]:  # 200-206 are absent
        n = r.choice([1, 2, 3, 4, 6, 9])
        rows += [(c, t, r.choice(["user", "assistant", None]) if t > 3 else "user", r.choice(says[:3])) for t in range(n)]
    rows += [(5, None, "system", "first"), (5, None, None, None), (6, 0, "user", "tie"), (6, 0, "user", "tie"), (6, 0, "b", "tie")]
    rows += [(300, t, "user", f"turn {t % 7}") for t in range(50, 400)] + [(None, 1, "user", "nobody"), (None, None, None, None)]
    return [(*x, 3, "clash", 1) for x in rows]


TURN = "conv_id long, turn long, role string, text string, depth long, saved string, n long"


def trie_by_hand(rows, rule=True):
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rule else 0
        rebuilt[c] = own.get(c - c % 100, [])[:h] + v[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, v in sorted(rebuilt.items()):
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
        ends[tuple(v)].append(c)
    kids, leaves, saved = Counter(), Counter(), Counter()
    for path in members:
        if path:
            kids[path[:-1]] += 1
    for path, m in members.items():
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(m) - 1) * len(path[-1][1]) if path else 0
            leaves[path[:d]] += path not in kids
    return order(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
        for p, m in members.items()
    )


def test_prefix_trie(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRIDE", 5)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    turns = spark.createDataFrame(turn_rows(), TURN).repartition(3)
    conv = F.col("conv_id")
    got = prefix_trie.prefix_trie(turns, prefix_trie.rule_base(conv), prefix_trie.rule_head(conv))
    assert order(got.drop("turn_conv", "turn_place").collect()) == trie_by_hand(turn_rows())
    assert prefix_trie.prefix_trie(turns.limit(0)).count() == 0


def test_prefix_trie_over_many_ranges(spark, monkeypatch):
    """A conversation in several ranges of the sort, without rebuilding; nodes name their last turn."""
    rows = [(7, t, "user", f"t{t}") for t in range(300)] + [(8, t, "user", f"t{t}") for t in range(0, 300, 1)] + [(9, None, "user", "same")] * 200
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix_trie.prefix_trie(turns).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert order(tuple(r)[:8] for r in got) == trie_by_hand(rows, rule=False)
    assert all((r.turn_conv, r.turn_place) == (r.conv_id, r.depth) for r in got if r.depth)


def test_prefix_trie_starts_anew_where_fingerprints_collide(spark, monkeypatch):
    """With primes this small different prefixes meet; no attempt can prove its nodes, and none is returned."""
    rows = [(c, t, "user", f"{c * (t > 1)} {t}") for c in range(40) for t in range(4)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    tried, real = [], prefix_trie._prefixes

    def first_poor(ordered, bases):
        tried.append(bases)
        monkeypatch.setattr(prefix_trie, "PRIMES", (5, 5, 5) if len(tried) == 1 else (2147483647, 2147483629, 2147483587))
        return real(ordered, [2, 2, 2] if len(tried) == 1 else bases)

    monkeypatch.setattr(prefix_trie, "_prefixes", first_poor)
    monkeypatch.setattr(prefix_trie.random.Random, "randrange", lambda self, low, high: 2 if len(tried) == 0 else 1234567 + int(self.random() * 1000))
    got = prefix_trie.prefix_trie(turns).drop("turn_conv", "turn_place").collect()
    assert len(tried) == 2 and order(got) == trie_by_hand(rows, rule=False)


# --- 13

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def spelling_rows():
    r = random.Random(2)
    stems = ["alphabet", "betagamma", "straße", "élégante", "ÀÉÎõüÿab", "commons", "comnons", "letters×", "ababababab"]
    out = []
    for i in range(150):
        own = []
        for _ in range(r.randint(0, 40)):
            w = list(stems[min(int(r.expovariate(0.7)), len(stems) - 1)])
            if r.random() < 0.15:
                k = r.randrange(len(w))
                w[k : k + r.choice([0, 1])] = r.choice(["", "x", "É", "b", "ab"])
            own.append("".join(w).title() if r.random() < 0.2 else "".join(w))
        out.append((i, r.choice([" ", ", ", "-1-"]).join(own)))
    out += [(900, None), (901, ""), (None, "Alphabet alphabeta alphabet"), (None, None), (902, "alphabet " * 500), (902, "alphabet " * 500)]
    out += [(903, "q" * 3000 + " " + "q" * 3001), (904, "q" * 3000 + " " + "q" * 3001), (905, "ñandúes Ñandúes " * 20)]
    out += [(1000, "rootword " * 3000 + "rootworx " * 150 + "rootwoxx " * 6)]
    return [(*x, "word", 1, 2) for x in out]


def spelling_by_hand(rows):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        if len(a) > len(b):
            a, b = b, a
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, count = {}, {}
    for w in n:
        own = [x for x in n if x != w and abs(len(x) - len(w)) < 2 and near(w, x)]
        count[w] = len(own)
        best = min(own, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return order((w, form[w], root(w), n[w], count[w], n.get(form[w])) for w in n)


@pytest.mark.parametrize("bounds", [{}, {"cell": 6, "queries": 5, "groups": 3}, {"cell": 2, "queries": 3, "groups": 1}])
def test_spelling(spark, monkeypatch, bounds):
    if bounds:
        for name, value in (("LEAF", 1), ("PAIR_BYTES", 64), ("HELD", 10), ("PIECE", 50)):
            monkeypatch.setattr(spelling, name, value)
    docs = spark.createDataFrame(spelling_rows(), "doc_id long, text string, word string, n long, near long").repartition(3)
    expected = spelling_by_hand(spelling_rows())
    assert sum(r[1] is not None for r in expected) > 20 and any(r[1] != r[2] for r in expected if r[1])
    assert order(spelling.spelling_variants(docs, **bounds).collect()) == expected


def test_spelling_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, "short words only")], "doc_id long, text string")
    assert spelling.spelling_variants(docs).count() == 0
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_trie_search_depth_first(monkeypatch):
    """Nodes of one word at most are leaves, so that the budget is spent on the way down."""
    import numpy as np

    monkeypatch.setattr(spelling, "LEAF", 1)
    monkeypatch.setattr(spelling, "PAIR_BYTES", 64)
    r, group_of = random.Random(4), np.arange(256, dtype=np.uint8) % 5
    vocab = {n: sorted({"".join(r.choice("abcdéf") for _ in range(n)) for _ in range(600)}) for n in (4, 5, 6)}
    held = vocab[5]
    counts = [r.randint(1, 3) for _ in held]
    trie = spelling._Trie(held, counts, group_of, 5)
    for n, asking in vocab.items():
        letters = spelling.letters_of(asking)
        n_near, first = trie.search(letters, spelling.vectors_of(letters, group_of, 5))
        index = {w: i for i, w in enumerate(held)}
        for word, found, best in zip(asking, n_near.tolist(), first.tolist(), strict=True):
            if n == 5:
                near = {word[:i] + c + word[i + 1 :] for i in range(n) for c in "abcdéf"} - {word}
            elif n == 6:
                near = {word[:i] + word[i + 1 :] for i in range(n)}
            else:
                near = {word[:i] + c + word[i:] for i in range(n + 1) for c in "abcdéf"}
            own = [index[x] for x in near if x in index]
            assert found == len(own)
            if own:
                assert trie.best[best] == min(own, key=lambda i: (-counts[i], held[i]))
