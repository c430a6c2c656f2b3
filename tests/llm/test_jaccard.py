"""The Jaccard join and connected components against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from lorebase.llm import jaccard
from lorebase.llm.components import components
from lorebase.sources.tables import table


def brute(rows):
    """doc_id, set size and component per row, from the definition."""
    sets, parent = [], {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x20\x09-\x0d]+", low)
        s = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        sets.append((i, s))
        if i is not None:
            parent[i] = i
    holders = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        for t in s if i is not None else ():
            holders[t].append(k)
    for ks in holders.values():
        for a in ks:
            for b in ks[ks.index(a) + 1:]:
                (i, s), (j, t) = sets[a], sets[b]
                if find(i) != find(j) and 100 * len(s & t) >= 75 * len(s | t):
                    x, y = sorted((find(i), find(j)))
                    parent[y] = x
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def corpus():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    common = prose(40)
    rows, bases = [], [prose(rng.randint(20, 150)) for _ in range(12)]
    for k, base in enumerate(bases):
        for _ in range(60 if k == 0 else rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy))
    rows += [" ".join(prose(30) + common + prose(60)) for _ in range(40)] + [" ".join(common + prose(4)) for _ in range(10)]
    rows += [None, "", " \n", "one two", "ONE\tTwo", "one two three four five", "É a b c d", "é a b c d", "a a a a a a a", " ".join(prose(30_000))]
    rows = [(i, t) for i, t in enumerate(rows)]
    rng.shuffle(rows)
    return [*rows, (None, rows[0][1]), rows[3], (rows[5][0], rows[9][1]), (rows[11][0], None)]


@pytest.mark.parametrize("tile", [512, 7])
def test_join_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE_DOCS", tile)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, component_id string").repartition(6)
    assert sorted((tuple(r) for r in jaccard.join(df).collect()), key=str) == brute(rows)


def test_join_of_the_table_and_of_nothing(spark, sf):
    docs = table(spark, sf, "documents")
    assert sorted((tuple(r) for r in jaccard.join(docs).collect()), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert jaccard.join(docs.limit(0)).count() == 0


def test_tiles_equal_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(30):
        base = rng.choice(400, 60, replace=False)
        sets = [np.unique(np.where(rng.random(60) < 0.1, rng.integers(0, 400, 60), base)).astype(np.uint64) for _ in range(24)]
        for alone in (True, False):
            side = np.zeros(24, dtype=int) if alone else rng.integers(0, 2, 24)
            got = jaccard.open_tile(np.arange(24), sets, side, alone)
            label = list(range(24))
            for i in range(24):
                for j in range(i):
                    s, t = set(sets[i].tolist()), set(sets[j].tolist())
                    if (alone or side[i] != side[j]) and 100 * len(s & t) >= 75 * len(s | t) and label[i] != label[j]:
                        a, b = sorted((label[i], label[j]))
                        label = [a if x == b else x for x in label]
            assert sorted(got) == [(i, x) for i, x in enumerate(label) if i != x]


def test_full_bloom_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOOM_BITS", 11)
    monkeypatch.setattr(jaccard, "BLOOM_CHUNKS", 4)
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in jaccard.join(df).collect()), key=str) == brute(rows)


def test_components(spark):
    rng = random.Random(9)
    chain = [(i, i + 1) for i in range(100, 160)]
    pairs = chain + [(200, k) for k in range(201, 260)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(30)] + [(5, 5), (None, 4)]
    rng.shuffle(pairs)
    got = dict(tuple(r) for r in components(spark.createDataFrame(pairs, "u long, v long")).collect())
    near = defaultdict(set)
    for u, v in pairs:
        if u is not None and u != v:
            near[u].add(v)
            near[v].add(u)
    want = {}
    for start in sorted(near):
        todo = [start] if start not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    assert got == want
