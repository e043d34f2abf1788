import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from duolith.llm.source_mix import WEIGHTS, apportion, mix, mixed, n_words, targets


def brute_targets(sizes):
    """Reshare until no target is above twice the size. sizes: in the order of the sources."""
    total, closed = 1.5 * sum(sizes), set()
    weights = [WEIGHTS[i % 3] for i in range(len(sizes))]
    while True:
        left = total - sum(2 * sizes[i] for i in closed)
        open_weight = sum(w for i, w in enumerate(weights) if i not in closed)
        got = [2.0 * s if i in closed else left * weights[i] / open_weight for i, s in enumerate(sizes)]
        above = {i for i, s in enumerate(sizes) if got[i] > 2 * s + 1e-9 and i not in closed}
        if not above:
            return got
        closed |= above


def test_targets_against_resharing(spark):
    rng = random.Random(1)
    for n in (1, 2, 3, 7, 20):
        sizes = [rng.choice([0, 3, 50, 1000, rng.randrange(1, 100_000)]) for _ in range(n)]
        if not sum(sizes):
            continue
        df = spark.createDataFrame([(f"s{i:02d}", s) for i, s in enumerate(sizes)], "source string, source_size long")
        got = {r.source: r.target for r in targets(df).collect()}
        assert [got[f"s{i:02d}"] for i in range(n)] == pytest.approx(brute_targets(sizes))


def test_apportionment_against_highest_quotients(spark):
    rng = random.Random(2)
    for n, seats in ((1, 5), (4, 0), (5, 3), (6, 1000), (40, 17), (40, 900)):
        votes = [rng.choice([0, 1, 7, 7, 900, rng.randrange(1, 100_000)]) for _ in range(n)]
        votes[0] = votes[0] or 1
        ranked = sorted(((-v / (2 * k + 1), i) for i, v in enumerate(votes) if v for k in range(seats)))[:seats]
        want = Counter(i for _, i in ranked)
        df = spark.createDataFrame([(0, i, v, seats) for i, v in enumerate(votes)], "g int, i int, v long, s long")
        got = {r.i: r.n for r in apportion(df, "v", "s", ["g"], ["i"], "n").collect()}
        assert got == {i: want[i] for i in range(n)}


def test_words(spark):
    texts = [None, "", " \n", "a", " a", "a ", "\ta\x0bb  c\n", "  x", "a\x1cb"]
    got = [r.n for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(n_words(F.col("t")).alias("n")).collect()]
    assert got == [0, 0, 0, 1, 1, 1, 3, 2, 1]


@pytest.fixture
def docs(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{i}.{k}" for k in range(rng.randrange(0, 90))), rng.choice(["a", "a", "a", "a", "b", "c", None]), 1, "c") for i in range(600)]
    rows += [(7000, None, "b", 0, "c"), (7001, " ", "empty", 0, "c"), (8000, "x " * 30_000, "c", 0, "c"), (9003, "again and again", "b", 0, "c"), (9003, "again and again", "b", 0, "c"), (None, "no id", None, 0, "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, row string").repartition(5)


@pytest.mark.parametrize("shard_words", [1_000_000, 700])
def test_takes_come_near_the_targets(docs, shard_words):
    rows = mix(docs, shard_words=shard_words).collect()
    assert len(rows) == docs.count()
    source = {r.doc_id: r.source for r in docs.collect()}
    sums, want = defaultdict(int), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.passes * r.size + r.cut_words and r.cut_words <= r.size
        sums[source[r.doc_id]] += r.taken
        want[source[r.doc_id]] = r.target
    sizes = {source[r.doc_id]: r.source_size for r in rows}
    order = ["a", "b", "c", "empty", None]
    assert [want[s] for s in order] == pytest.approx(brute_targets([sizes[s] for s in order]))
    for s in order:
        assert abs(sums[s] - want[s]) <= 0.02 * want[s] + 16, s
    again = {(r.doc_id, r.size): r.taken for r in mix(docs.repartition(3), shard_words=shard_words).collect()}
    assert again == {(r.doc_id, r.size): r.taken for r in rows}


def test_the_mix_has_the_words_that_the_plan_takes(docs):
    out = mixed(docs)
    assert out.columns == docs.columns
    plan = defaultdict(int)
    for r in mix(docs).collect():
        plan[r.doc_id] += r.taken
    got = defaultdict(int)
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text)
    for r in out.collect():
        got[r.doc_id] += len(r.text.split())
        assert any((r.text in (t or "") * 2) for t in texts[r.doc_id])
    assert dict(got) == {k: v for k, v in plan.items() if v}


def test_rows_that_agree_are_told_apart(spark):
    rows = [(1, " ".join(f"{k}.{j}" for j in range(40)), s, 0) for k in range(12) for s in "ab"] + [(i, " ".join(f"{i}.{j}" for j in range(25)), "b", 0) for i in range(50, 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(3)
    taken = sum(r.taken for r in mix(df).collect())
    out = mixed(df).collect()
    assert sum(len(r.text.split()) for r in out) == taken
    whole = Counter(r.text for r in out if r.doc_id == 1 and len(r.text.split()) == 40 and r.source == "b")
    assert max(whole.values(), default=0) <= 2


def test_empty_tables(spark):
    schema = "doc_id long, text string, source string, n_chars long"
    for rows in ([], [(1, None, "a", 0), (2, "", None, 0)]):
        df = spark.createDataFrame(rows, schema)
        assert [r.taken for r in mix(df).collect()] == [0] * len(rows) and mixed(df).count() == 0
