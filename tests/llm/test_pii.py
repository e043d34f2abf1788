import hashlib
import random
import re

import numpy as np

from duolith.llm.pii import BASE, KINDS, base_spans, candidates, estimate, find_pii, fit, luhn, query, train

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fits(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(x) <= 255 for x in s.split(".")),
        "card": lambda: 13 <= len(d) <= 19 and luhn(d),
        "phone": lambda: 9 <= len(d) <= 15,
    }[kind]()


def brute(text):
    return [(KINDS.index(k), *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if fits(k, m[0])]


def test_base_against_brute_force():
    rng = random.Random(7)
    pieces = ["a@b.co", "x@", "@", ".", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+", "é", " ", "-", "12", "a.b", "\n", "0001", "٣"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14)))
        assert base_spans(text) == brute(text), repr(text)


def test_luhn():
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def test_long_texts_take_linear_time():
    for text in ("a" * 2_000_000, "1" * 2_000_000, "a@" * 500_000, "1." * 500_000, "+1" * 500_000, "+1" + " " * 1_000_000, "1 " * 500_000, "a@b" + "-" * 1_000_000, "James " * 200_000, "AB12" * 300_000):
        candidates(text, base_spans(text))


def test_estimation_finds_the_reliabilities():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.3
    right = np.array([0.95, 0.8, 0.65, 0.9])
    votes = np.where(rng.random((20000, 4)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, odds, posterior = estimate(patterns, counts.astype(float))
    assert abs(share - 0.3) < 0.03
    got = odds[:, 1, 2] / (odds[:, 1, 2] + odds[:, 1, 0])
    assert np.abs(got - right).max() < 0.04
    w = train((patterns == 1).astype(int), posterior, counts.astype(float))
    assert (w[:4] > 0).all()


def test_without_candidates_nothing_is_accepted():
    assert fit([]).max() == 0


def test_table(spark, tmp_path):
    rng = random.Random(2)
    number = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    rows = [(i, f"Please call tel (0{number(2)}) {number(3)} {number(4)} or mail a{i}@b.com and thanks") for i in range(60)]
    rows += [(100 + i, f"see order 0{number(2)} {number(3)} {number(4)} = {number(2)} done") for i in range(60)]
    rows += [(200, None), (201, ""), (202, "My ssn 123-45-6789, iban DE89370400440532013000, born 01.02.1980, Mr. James Miller, a@b.com"), (202, "+1 (743) 555-3824"), (None, "plain words only"), (203, "y y " * 100_000 + " a@b.com")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, found string, votes int")
    got = find_pii(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append([(s.kind, s.start, s.end) for s in r.spans])
    phones = lambda ids: sum(any(k == "national" for k, *_ in by[i][0]) for i in ids)
    assert phones(range(60)) == 60 and phones(range(100, 160)) == 0
    assert by[None] == [[]] and by[200] == [[]] and by[201] == [[]]
    assert {k for k, *_ in sum(by[202], [])} >= {"email", "phone", "id", "iban", "birth"}
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for r in query(spark, str(tmp_path)).collect():
        texts = [t or "" for d, t in rows if d == r.doc_id]
        want = [(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in brute(t)).encode()).hexdigest(), *(sum(KINDS[k] == n for k, *_ in brute(t)) for n in BASE)) for t in texts]
        assert (r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) in want
    assert find_pii(df.limit(0)).count() == 0


def test_names_are_proposed_without_a_list():
    found = lambda t: [t[a:b] for k, a, b, *_ in candidates(t, base_spans(t)) if KINDS[k] == "name"]
    assert found("ask Dr. Hans Mueller now") == ["Dr. Hans Mueller"]
    assert found("ask John Michael Smith now") == ["John Michael Smith"]
    assert found("Contact Zorvan O'Quill-Brack, or Dear Élise Müller.") == ["Zorvan O'Quill-Brack", "Élise Müller"]
    assert found("one Word alone, ALL CAPS HERE, Mr. Nobody") == ["Mr. Nobody"]


def test_names_are_told_by_their_surroundings(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    name = lambda: f"{word().capitalize()} {word().capitalize()}"
    given = ["James", "Mary", "Hans", "Petra", "Jean", "Carmen"]
    rows = [(i, f"{word()} {word()}, contact {rng.choice(given)} {word().capitalize()}, mail {word()}@{word()}.com") for i in range(80)]
    rows += [(100 + i, f"{word()} {word()}, contact {name()}, mail {word()}@{word()}.com") for i in range(40)]
    rows += [(200 + i, f"{word()} the {name()} {word()} {word()} and {name()} {word()}") for i in range(300)]
    got = {r.doc_id: sum(s.kind == "name" for s in r.spans) for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 1 for i in range(80))
    assert sum(got[100 + i] for i in range(40)) >= 36  # in no gazetteer
    assert sum(got[200 + i] for i in range(300)) == 0


def test_estimation_against_plain_loops():
    """Expectation-maximisation row by row, without the table of counts."""
    from math import exp, log

    rng = random.Random(3)
    rows = [tuple(rng.choice((-1, 0, 1, 1 if i % 3 else -1)) for _ in range(3)) for i in range(400)]
    patterns, counts = np.unique(np.array(rows), axis=0, return_counts=True)
    share, odds, posterior = estimate(patterns, counts.astype(float), rounds=8)
    prior = {0: (4, 2, 1), 1: (1, 2, 4)}
    p = {c: [[x / 7 for x in prior[c]] for _ in range(3)] for c in (0, 1)}
    s = 0.5
    for _ in range(8):
        post = []
        for r in rows:
            logs = [log(q) + sum(log(p[c][j][v + 1]) for j, v in enumerate(r)) for c, q in ((0, 1 - s), (1, s))]
            post.append(1 / (1 + exp(logs[0] - logs[1])))
        s = (sum(post) + 1) / (len(rows) + 2)
        for c in (0, 1):
            for j in range(3):
                seen = [sum((x if c else 1 - x) for x, r in zip(post, rows) if r[j] == v) + prior[c][v + 1] for v in (-1, 0, 1)]
                p[c][j] = [x / sum(seen) for x in seen]
    assert abs(share - s) < 1e-9
    assert np.abs(odds[:, 1] - np.array(p[1])).max() < 1e-9 and np.abs(odds[:, 0] - np.array(p[0])).max() < 1e-9
    by = {tuple(x): v for x, v in zip(patterns.tolist(), posterior.tolist())}
    assert max(abs(by[r] - x) for r, x in zip(rows, post)) < 1e-9
