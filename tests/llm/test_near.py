import itertools
import random

import numpy as np
import regex

from rollmeter.llm import nearjoin
from rollmeter.llm.graph import components


def word_sets(text):
    w = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, threshold=0.8):
    sets = [word_sets(t) for _, t in rows]
    n = [0] * len(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x == y or len(x & y) >= threshold * len(x | y) - 1e-9:
            n[a] += 1
            n[b] += 1
            root[find(max(a, b))] = find(min(a, b))
    group = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        group[r] = min(group.get(r, d), d)
    return sorted((d, group[find(i)], n[i]) for i, (d, _) in enumerate(rows))


def corpus(seed, n):
    r = random.Random(seed)
    rows, i = [], 0
    while len(rows) < n:
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([1, 3, 6, 40, 90]))]
        for _ in range(r.choice([1, 1, 1, 2, 5, 12])):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                words[r.randrange(len(words))] = f"x{r.randrange(9999)}"
            rows.append((i, r.choice([" ", "\n", ", "]).join(words)))
            i += 1
    return rows + [(i, None), (i + 1, ""), (i + 2, " .. ")]


def test_equals_brute_force(spark):
    rows = corpus(1, 150)
    df = spark.createDataFrame([(i, t, "x", t) for i, t in rows], "doc_id long, text string, key string, n_links string")
    got = nearjoin.near_join(df).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == brute(rows)


def test_large_groups_go_through_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearjoin, "BLOCK_CLASSES", 5)
    monkeypatch.setattr(nearjoin, "NODE_CLASSES", 7)
    monkeypatch.setattr(nearjoin, "SMALL_NODE", 3)
    r = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(30):
        words = list(base)
        words[r.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    got = nearjoin.near_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.class_id, x.n_links) for x in got) == brute(rows)


def test_one_of_each_keeps_columns_and_repeated_rows_once(spark):
    rows = corpus(2, 40)
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    kept = {r.doc_id for r in nearjoin.one_of_each(df).collect()}
    assert kept == {g for _, g, _ in brute(rows)}
    twice = nearjoin.one_of_each(df.union(df)).collect()
    assert sorted(r.doc_id for r in twice) == sorted(kept) and twice[0].asDict().keys() == {"doc_id", "text", "source"}
    assert nearjoin.one_of_each(df.limit(0)).count() == 0


def test_recall_in_large_nodes():
    """Classes of one node: families of near copies around one stem, whose members are linked at 0.8 and above."""
    r, trees, recalls = random.Random(11), nearjoin.TREES, []
    stem = [f"s{k}" for k in range(150)]
    texts = []
    for f in range(60):
        base = list(stem)
        for _ in range(25):
            base[r.randrange(150)] = f"f{f}x{r.randrange(99)}"
        for _ in range(12):
            words = list(base)
            for _ in range(r.choice([1, 2, 3, 4])):
                words[r.randrange(150)] = f"y{r.randrange(10**6)}"
            texts.append(" ".join(words))
    sets = nearjoin.Sets.of(texts)
    low = sets.minima(trees * nearjoin.DEPTH)
    sig = (nearjoin.mix(low) & np.uint64(255)).astype(np.uint8)
    every = [sets.names[a:b] for a, b in zip(sets.first, sets.first[1:])]
    link = nearjoin.linked(sets.sizes, sets.sizes, nearjoin.overlaps(every, None).astype(np.int64), 0.8)
    pairs = np.argwhere(np.triu(link, 1))
    assert len(pairs) > 500
    need = nearjoin.needed(sets.sizes, 0.8, nearjoin.RECALL)
    for tree in range(trees):
        group = list(range(len(texts)))

        def find(x):
            while group[x] != x:
                x = group[x]
            return x

        for a, b in nearjoin.matched(sig, tree, need, nearjoin.depth()):
            group[find(a)] = find(b)
        recalls.append(np.mean([find(a) == find(b) for a, b in pairs]))
    assert min(recalls) > 0.999


def test_least_link_and_needed_prefixes():
    def slow(n):
        every = [c / (n + m - c) for m in range(1, 3 * n) for c in range(min(n, m) + 1) if not n == m == c]
        return min((s for s in every if s >= 0.8 - 1e-9), default=None)

    for n in range(1, 40):
        assert nearjoin.least_link(n) == slow(n)
    need = nearjoin.needed(np.array([0, 1, 3, 4, 6, 7, 500]), 0.8, nearjoin.RECALL)
    assert need.tolist()[:3] == [0, 0, 0] and need[3] == need[-1] == nearjoin.depth() <= need[4] <= need[5]


def test_pairs_at_exactly_the_threshold_are_links(spark):
    words = [f"w{k}" for k in range(14)]  # ten shingles; the first eight words have four of them, the first thirteen nine
    rows = [(1, " ".join(words[:12])), (2, " ".join(words)), (3, " ".join(words[:9])), (4, " ".join(words[:8])), (None, "only this"), (None, "only this")]
    got = nearjoin.near_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    links = {(r.doc_id, r.class_id): r.n_links for r in got}  # 8 of 10 shingles; 4 of 5
    assert links == {(1, 1): 1, (2, 1): 1, (3, 3): 1, (4, 3): 1, (None, None): 1}


def test_near_join_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, _key0 string")
    assert nearjoin.near_join(df).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f", "k"), (1, "a b c d e f", "k"), (1, "other words", "k")], df.schema)
    kept = nearjoin.one_of_each(twice).collect()
    assert sorted(r.text for r in kept) == ["a b c d e f", "other words"] and kept[0]._key0 == "k"


def test_depth_reaches_the_recall():
    d = nearjoin.depth()
    assert 1 - (1 - 0.8**d) ** nearjoin.TREES >= nearjoin.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** nearjoin.TREES


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + k: 100 for k in range(30)}}


def test_overlaps():
    a = [np.array([1, 2, 3], np.uint64), np.array([], np.uint64)]
    assert nearjoin.overlaps(a, [np.array([3, 2, 9], np.uint64)]).tolist() == [[2], [0]]


def test_texts_whose_power_sums_cancel_are_no_copies(spark):
    one = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    rows = [(1, one), (2, one.translate(str.maketrans("ab", "ba"))), (3, one)]
    got = nearjoin.near_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == [(1, 1, 1), (2, 2, 0), (3, 1, 1)]
