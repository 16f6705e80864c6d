import random
import re
from itertools import combinations

import numpy as np
import pytest

from groundwork.llm import jaccard
from groundwork.llm.components import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), find(i)) for i in sets)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 40))
    base = [[word() for _ in range(rng.randint(3, 150))] for _ in range(12)]
    line = [word() for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(rng.choice(base)) if rng.random() < 0.8 else [word() for _ in range(rng.randint(1, 60))]
        for _ in range(rng.choice([0, 0, 1, 2, 4, 6])):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            at = rng.randrange(len(w))
            w[at:at] = line
        rows.append((i * 7 % 1009, " ".join(x.upper() if rng.random() < 0.1 else x for x in w)))
    return [*rows, (2000, None), (2001, ""), (2002, " \n"), (2003, "A b"), (2004, "a B"), (2005, "a b c"), (2006, rows[0][1]), (2007, "É x y z w v"), (2008, "é x y z w v")]


@pytest.mark.parametrize("seed,block", [(1, 2048), (2, 16)])
def test_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, class string, size int")
    got = jaccard.jaccard_components(df).select("doc_id", "n_shingles", "component_id")
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_empty(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = [np.unique(rng.choice(base, rng.integers(20, 33))) for _ in range(60)] + [np.unique(base[k : k + 24]) for k in range(40)]
    bits = np.stack([jaccard._fold(jaccard.signature(s), 1) for s in sets])
    sizes = np.array([len(s) for s in sets])
    tree = jaccard.SignatureTree(bits, sizes, np.arange(len(sets)))
    found = {(int(a), int(b)) for i, j, _ in jaccard.tree_pairs(tree, tree, 75, True) for a, b in zip(i, j)}
    for a, b in combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            assert (a, b) in found


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(500, 500), (7, 3)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_links_equal_brute_force(spark):
    base = [f"w{i}" for i in range(60)]
    group = [(5000 + k, " ".join([*base[: 60 - k % 7], *(f"own{k}x{i}" for i in range(k % 5))])) for k in range(40)]
    rows = corpus(4) + group + [(6000, group[3][1]), (6001, group[3][1])]
    sets = {i: shingles(t) for i, t in rows}
    want = dict.fromkeys(sets, 0)
    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            want[a] += 1
            want[b] += 1
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), links=True).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == want and max(want.values()) > 30
