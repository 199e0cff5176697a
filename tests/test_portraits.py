"""Groups of near portraits, where thousands are alike."""

import numpy as np

from docverify.operators import contraction, links


def test_thousands_of_alike_portraits(spark, monkeypatch):
    """Pairs stay linear in a group of 5,000 that all meet; groups equal those of all pairs."""
    r = np.random.default_rng(3)
    base = np.abs(r.normal(size=16))
    vectors = [base + r.normal(size=16) * 0.01 * base for _ in range(5000)]  # alike
    chain = [base[::-1] * (1 + 0.12 * k * (np.arange(16) % 2)) for k in range(12)]  # each near to the next, the ends are not
    vectors += [*chain, *r.normal(size=(300, 16)), *vectors[:20]]
    rows = [(i, [float(x) for x in v], "clash") for i, v in enumerate(vectors)] + [(90001, None, ""), (90002, [], ""), (90003, [0.0] * 16, ""), (None, [1.0] * 16, ""), (0, rows_of(vectors[0]), "")]
    portraits = spark.createDataFrame(rows, "vec_id long, embedding array<double>, group_id string")
    seen, real = [], contraction.written

    def counted(df, label):
        out = real(df, label)
        if label == "pairs":
            seen.append(out.count())
        return out

    monkeypatch.setattr(contraction, "written", counted)
    got = links.portrait_groups(portraits).collect()
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    root = np.full(len(vectors), -1)
    for i in range(len(vectors)):
        if root[i] < 0:
            edge = [i]
            while edge:
                root[edge] = i
                edge = np.flatnonzero(near[edge].any(0) & (root < 0)).tolist()
    want = sorted([(i, int(root[i])) for i in range(len(vectors))] + [(0, 0), (90001, 90001), (90002, 90002), (90003, 90003)])
    assert sorted((g.id, g.group_id) for g in got) == want
    assert sum(seen) < 20 * len(vectors)  # of 12.5 million pairs
    assert links.portrait_groups(portraits.limit(0)).count() == 0


def rows_of(v):
    return [float(x) for x in v]


def test_no_near_pair_is_missed(spark, monkeypatch):
    """3,000 pairs just over the least cosine, copies and a chain, in several blocks and tiles: all are found, as by brute force."""
    from docverify.operators import allpairs

    monkeypatch.setattr(allpairs, "TILE_ROWS", 100)
    r = np.random.default_rng(8)
    one = r.normal(size=(3000, 24))
    away = r.normal(size=(3000, 24))
    one /= np.linalg.norm(one, axis=1)[:, None]
    away -= (away * one).sum(1)[:, None] * one
    away /= np.linalg.norm(away, axis=1)[:, None]
    cosines = 0.95 + r.uniform(1e-7, 0.001, 3000)
    other = cosines[:, None] * one + np.sqrt(1 - cosines**2)[:, None] * away
    vectors = np.concatenate([one, 3 * other, one[:5], one[0] * (1 + 0.3 * np.arange(8)[:, None] * (np.arange(24) % 2))])
    odd = [(90001, None), (90002, []), (90003, [0.0] * 24), (90004, [1e300] * 24), (90005, [1.0] * 7), (90006, [1.0] * 6 + [1.1]), (None, [1.0] * 24), (90007, [float("nan")] * 24)]
    portraits = spark.createDataFrame([(i, rows_of(v)) for i, v in enumerate(vectors)] + odd, "vec_id long, embedding array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    first = np.sort(np.unique(unit, axis=0, return_index=True)[1])
    near = [(int(first[i]), int(first[j])) for i, j in zip(*np.nonzero(np.triu(unit[first] @ unit[first].T >= 0.95, 1)), strict=True)]
    got = links.near_portraits(portraits).collect()
    assert sorted((g.a, g.b) for g in got) == sorted([*near, (90005, 90006)]) and len(near) >= 3000
    assert all(abs(g.similarity - unit[g.a] @ unit[g.b]) < 1e-12 for g in got if g.a < 90000)
    many = {i: 0 for i in first.tolist()}
    for pair in near:
        for i in pair:
            many[i] += 1
    groups = {g.id: g for g in links.portrait_groups(portraits).collect()}
    assert all(groups[i].n_links == n for i, n in many.items())  # all of a portrait's links, not only those that were needed
    assert all(groups[i].group_id == groups[j].group_id == min(i, j, groups[i].group_id) for i, j in near)
    assert [groups[i].group_id for i in (90001, 90002, 90003, 90004, 90005, 90006, 90007, 3000 + 3000)] == [90001, 90002, 90003, 90004, 90005, 90005, 90007, 0]
    assert links.near_portraits(portraits.limit(0)).count() == 0


def test_a_crowd_of_portraits_writes_no_pairs(spark, monkeypatch):
    """What is written is a few rows a portrait, of a crowd that is alike and of one that shares keys but isn't."""
    r = np.random.default_rng(9)
    alike = 1 + 0.01 * r.normal(size=(1500, 16))
    not_alike = 1 + 0.6 * r.normal(size=(1500, 16))
    portraits = spark.createDataFrame([(i, rows_of(v)) for i, v in enumerate([*alike, *not_alike])], "vec_id long, embedding array<double>")
    seen, real = [], links.written

    def counted(df, label):
        out = real(df, label)
        seen.append(out.count())
        return out

    monkeypatch.setattr(links, "written", counted)
    monkeypatch.setattr(contraction, "written", counted)
    got = {g.id: g for g in links.portrait_groups(portraits).collect()}
    assert {got[i].group_id for i in range(1500)} == {0} and got[7].n_links >= 1499
    assert sum(seen) <= 12 * 3000
