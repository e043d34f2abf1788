"""The pipeline against plain Python over a small table."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations
from math import floor

import pytest

import corpus_pipeline
from duolith.llm.bpe import Codec, default_tokenizer
from duolith.llm.source_mix import BLOCK_WORDS, SEED

W = re.compile(r"[^\x20\x09-\x0D]+")


def norm(line):
    return " ".join(W.findall(line)).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000"))


def quality(rows):
    texts = defaultdict(set)
    for _, t, s in rows:
        texts[s].add(t)
    bad = {}
    for s, ts in texts.items():
        n = Counter(x for t in ts for x in {norm(x) for x in t.split("\n") if W.search(x)})
        bad[s] = {x for x, c in n.items() if c >= max(10, 0.1 * len(ts))}
    out = []
    for i, t, s in rows:
        words = W.findall(t)
        windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        marked = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
        kept = "\n".join(x for x in t.split("\n") if not (W.search(x) and norm(x) in bad[s]))
        if len(words) >= 20 and 100 * len(marked) <= 30 * len(words) and len(W.findall(kept)) >= 0.3 * len(words):
            out.append((i, kept, s))
    return out


def exact(rows):
    seen = {}
    for r in sorted(rows):
        seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r)
    return list(seen.values())


def near(rows):
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    sets = {r[0]: grams(W.findall(r[1])) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return [r for r in rows if find(r[0]) == r[0]]


def draw(bound, *key):
    return int(hashlib.md5(":".join(map(str, key)).encode()).hexdigest()[:12], 16) % bound


def mix(rows):
    sources = sorted({s for _, _, s in rows if s is not None}) + [None] * any(s is None for _, _, s in rows)
    size = {r[0]: len(W.findall(r[1])) for r in rows}
    sums = [sum(size[r[0]] for r in rows if r[2] == s) for s in sources]
    weights, closed = [(5, 2, 1)[i % 3] for i in range(len(sources))], set()
    while True:
        left, w = 1.5 * sum(sums) - sum(2 * sums[i] for i in closed), sum(x for i, x in enumerate(weights) if i not in closed)
        target = [2 * x if i in closed else left * weights[i] / w for i, x in enumerate(sums)]
        above = {i for i, x in enumerate(sums) if i not in closed and target[i] > 2 * x}
        if not above:
            break
        closed |= above
    seats = round(sum(target) / BLOCK_WORDS)
    won = Counter(i for *_, i in sorted((-t / (2 * k + 1), i) for i, t in enumerate(target) for k in range(seats))[:seats])
    out = []
    for i, s in enumerate(sources):  # one shard each
        n = max(1, floor(sums[i] / BLOCK_WORDS + 0.5))
        passes, rest = divmod(min(won[i], 2 * n), n)
        at = draw(n, SEED, i, 0)
        edge = lambda k: k * sums[i] // n  # noqa: B023, E731
        taken = set(range(edge(at), edge(min(at + rest, n)))) | set(range(edge(max(at + rest - n, 0))))
        start = 0
        for r in sorted((r for r in rows if r[2] == s), key=lambda r: (hashlib.md5(f"{SEED}:{r[0]}".encode()).hexdigest(), r[0])):
            pieces = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", r[1])
            mine = [k - start in range(len(pieces)) and k in taken for k in range(start, start + len(pieces))]
            out += [(r[0], r[1])] * passes
            if all(mine):
                out.append((r[0], r[1]))
            else:
                runs, run = [], []
                for p, m in zip(pieces, mine):
                    if m:
                        run.append(p)
                    elif run:
                        runs, run = [*runs, run], []
                out += [(r[0], re.sub(r"^[\x20\x09-\x0D]+", "", "".join(x))) for x in [*runs, run] if x]
            start += len(pieces)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    body = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    out = []
    for i in range(160):
        t = "\n".join(body(rng.randrange(4, 15)) for _ in range(rng.randrange(1, 14)))
        if i % 4 == 0:
            t += "\nAll rights reserved by 1 or 2"
        out.append((t, rng.choice(["a", "b", "b", "b", "c", None])))
    for _ in range(30):
        t, s = rng.choice(out)
        out.append((rng.choice([t, t.replace("\n", "  "), t.replace(" ", " x", 1)]), s))
    out += [("\n".join(["dup line of words here"] * 30), "a"), ("short text", "b"), ("", "c"), (" ".join(["word"] * 50), "c")]
    return [(i, *r) for i, r in enumerate(out)]


def test_stages_against_brute_force(spark, rows, tmp_path):
    df = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows] + [(9999, None, "en", "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    docs, want = spark.read.parquet(f"{tmp_path}/documents.parquet"), rows
    for k, ((_, stage), brute) in enumerate(zip(corpus_pipeline.STAGES, (quality, exact, near))):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == df.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs, before = spark.read.parquet(f"{tmp_path}/{k}"), want
        want = brute(want)
        assert 0 < len(want) < len(before)
        got = docs.collect()
        assert sorted((r.doc_id, r.text, str(r.source)) for r in got) == sorted((i, t, str(s)) for i, t, s in want)
        assert all(r.n_chars == len(r.text) for r in got)
    out = corpus_pipeline.mixed(spark, docs, str(tmp_path))
    assert out.columns == df.columns
    got = out.collect()
    want = mix(want)
    assert sorted((r.doc_id, r.text) for r in got) == sorted(want)
    codec = Codec(default_tokenizer())
    ids = lambda t: codec.tokenizer.encode(t, add_special_tokens=False).ids
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in final) == sorted((i, len(ids(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in want)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_quality_takes_lines_that_few_in_a_hundred_share(spark):
    body = lambda i: " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}{chr(97 + k)}" for k in range(25))
    rows = [(i, body(i) + "\nSeen here and there" * (i < 24) + "\nRarely seen" * (30 <= i < 39), "en", "a", 0) for i in range(1200)]
    got = {r.doc_id: r.text for r in corpus_pipeline.quality(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()}
    assert len(got) == 1200
    assert not any("here and there" in t for t in got.values())
    assert sum("Rarely" in t for t in got.values()) == 9
