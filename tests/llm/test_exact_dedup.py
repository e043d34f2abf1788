import re
from collections import Counter, defaultdict

from duolith.llm.exact_dedup import drop_copies, exact_dedup, frequent, misra_gries

SCHEMA = "doc_id long, text string, digest string, row long"


def brute(rows):
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append((doc_id is None, doc_id if doc_id is not None else 0, i))
    out = []
    for text, members in groups.items():
        first = min(members)
        out += [(None if none else d, None if first[0] else first[1], len(members)) for none, d, _ in members]
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rows = [(1, "a b"), (2, "a\n\tb"), (3, " a b"), (4, None), (5, ""), (6, "x" * 300_000), (7, "x" * 300_000), (8, "a b"), (8, "a b"), (None, "q"), (9, "q"), (None, "z"), (10, "a b")]
    rows += [(100 + i, "hot") for i in range(200)]
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], SCHEMA).repartition(5)
    for share, counters in ((1 / 4096, 8192), (0.2, 10)):
        got = exact_dedup(df, share=share, counters=counters).collect()
        assert sorted([(r.doc_id, r.keep_id, r.group_size) for r in got], key=str) == brute(rows)
        assert sum(r.kept for r in got) == len({g for g in [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]})
    kept = drop_copies(df)
    assert kept.columns == df.columns
    assert sorted(Counter(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept.collect()).values())[-1] == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_dedup(df).count() == 0 and drop_copies(df).count() == 0


def test_misra_gries_is_low_by_its_bound_at_most():
    values = [i % 7 for i in range(700)] + [0] * 300 + list(range(10, 300))
    counts = Counter()
    for i in range(0, len(values), 50):
        counts = misra_gries(counts, Counter(values[i : i + 50]), 9)
    for v, n in Counter(values).items():
        assert n - len(values) / 10 <= counts.get(v, 0) <= n


def test_frequent_digests_are_all_found(spark):
    df = spark.createDataFrame([(bytes([i % 200 if i % 3 else 0]),) for i in range(3000)], "k binary").repartition(4)
    assert b"\0" in {bytes(r.k) for r in frequent(df, "k", 3000, 0.2, 20).collect()}
