import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from duolith.llm import ngram_join as J
from duolith.llm.components import components


def grams(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, threshold=0.8):
    """By place: (class_id, set_id, n_links); rows: id, text; ids are distinct."""
    sets = defaultdict(list)
    for i, t in rows:
        sets[grams(t)].append(i)
    ids = {s: min(m) for s, m in sets.items() if s}
    near = defaultdict(set)
    for a, b in combinations(ids, 2):
        if len(a & b) >= threshold * len(a | b) - 1e-9:
            near[a].add(b)
            near[b].add(a)
    out = {}
    for s in ids:
        seen, todo = {s}, [s]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        for i in sets[s]:
            out[i] = (min(ids[x] for x in seen), ids[s], len(near[s]))
    return out | {i: (i, i, 0) for i, t in rows if not grams(t)}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randrange(3, 200))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            t = list(base)
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append(" ".join(t))
    base = [rng.choice(words) for _ in range(120)]
    for i in range(150):  # a group of near copies, most of them linked
        t = list(base)
        for _ in range(rng.randrange(0, 3)):
            t[rng.randrange(120)] = f"edit{i}"
        rows.append(" ".join(t))
    rows += [" ".join(base)] * 60 + [None, "", " \n", "a b", "a b", "a  b", "a b c", "x " * 50_000, "x " * 50_001]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [512, 16])
def test_against_brute_force(spark, rows, block):
    df = spark.createDataFrame([(i, t, "c", "c", 0) for i, t in rows], "doc_id long, text string, rep string, root string, text_hash int").repartition(5)
    got = {r.doc_id: (r.class_id, r.set_id, r.n_links) for r in J.join(df, block=block).collect()}
    assert got == brute(rows)
    kept = J.drop_near_copies(df, block=block)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c, *_ in got.values()})


def test_repeated_and_null_ids(spark):
    t = " ".join(f"w{i}" for i in range(50))
    rows = [(1, t), (1, t), (1, "something else entirely is here now"), (None, t + " more"), (2, None), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = J.join(df).collect()
    assert sorted((str(r.doc_id), r.class_id, r.n_links) for r in got) == [("1", 1, 0), ("1", 1, 1), ("1", 1, 1), ("2", 2, 0), ("2", 2, 0), ("None", 1, 1)]
    assert sorted(str(r.doc_id) for r in J.drop_near_copies(df).collect()) == ["1", "1", "2", "2"]
    assert J.join(df.limit(0)).count() == 0 and J.drop_near_copies(df.limit(0)).count() == 0


def test_minhash_estimates_the_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.8, 0.95):
        errors = []
        for _ in range(40):
            n = 400
            common = int(round(2 * n * share / (1 + share)))
            every = rng.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64)
            v = J.minhash([every[:n], every[n - common :]])
            errors.append((v[0] == v[1]).mean() - share)
        assert abs(np.mean(errors)) < 0.03


def test_posterior_limits():
    least = J.least_matches(0.8, 1e-9)
    assert least[0] == 0 or least[0] < J.STEP * 0.4
    assert list(least) == sorted(least) and least[-1] < 0.8 * J.BANDS * J.ROWS
    assert J.least_matches(0.8, 1e-3)[-1] > least[-1]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for e in edges if e[0] != e[1] for x in e}
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {x: find(x) for x in linked}
    assert components(df.limit(0)).count() == 0
