import random
import re
import time
from collections import Counter
from itertools import combinations, product
from math import ceil

import pytest
from pyspark.sql import functions as F

from duolith.llm.url_filter import MIN_CONFIDENCE, MIN_SUPPORT, RULES, filter_urls, mine


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def items(host, path):
    path = re.sub("[A-Z]", lambda m: m[0].lower(), path)
    return {"h:" + w for w in host.split(".") if w} | {"p:" + w for w in re.findall(r"[a-z0-9\x80-\U0010ffff]+", path)}


def rule(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def rules_of(labelled, most=99):
    """All rules, redundant ones too."""
    single, n, total = Counter(), Counter(), Counter()
    for its, label in labelled:
        single.update((t, label) for t in its)
    least = max(1, ceil(len(labelled) * MIN_SUPPORT))
    often = {t for (t, _), k in single.items() if k >= least}
    for its, label in labelled:
        its = sorted(its & often)
        for size in range(1, min(most, len(its)) + 1):
            for c in combinations(its, size):
                total[c] += 1
                n[c, label] += 1
    return {k: (v / total[k[0]], v) for k, v in n.items() if v >= least and v / total[k[0]] >= MIN_CONFIDENCE}


def restated(key):
    return any(key[1] == r.verdict and set(key[0]) <= set(r.tokens()) for r in RULES)


def brute(urls):
    parsed = [split(u) for u in urls]
    ruled = [rule(*p) for p in parsed]
    labelled = [(items(*p), r.verdict) for p, r in zip(parsed, ruled) if r]
    rules = rules_of(labelled)
    useful = {k: v for k, v in rules.items() if k in pruned(rules) and not restated(k)}
    out = []
    for p, r in zip(parsed, ruled):
        fired = [(*v, label) for (c, label), v in useful.items() if set(c) <= items(*p)]
        out.append((*p, r and r.name, r.verdict if r else max(fired)[2] if fired else "allow"))
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    urls = [None, "", "no scheme.com/en/", "://", "http://", "http://COM/", "http://a.com", "http://xcom/en/", "http://WWW.Example.com/en/x?y#z", "http://m.www.example.com/en/", "http://example.com/EN/", "http://net/es/", "x://é.org/ñ/é%20A", "http://a.org/" + "w/" * 20_000]
    parts = [["", "m.", "blog.", "www."], ["aa", "bb", "example", "spam"], [".com", ".net", ".org"], ["", "/", "/en/", "/es/", "/fr/", "/de/"], ["x1", "shop", "news/7", "a-b_c", ""], ["", "?q=http://z", "#t"]]
    urls += ["https://" + "".join(map(rng.choice, parts)) for _ in range(400)]
    urls += ["http://hot.org/en/1"] * 150
    df = spark.createDataFrame([(i, u, "c", "c") for i, u in enumerate(urls)], "page_id long, url string, rule string, items string").repartition(4)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df).collect()}
    want = brute(urls)
    assert [got[i] for i in range(len(urls))] == want
    assert {v for *_, r, v in want if r is None} == {"allow", "block"}


def test_repeated_rows_and_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (None, None)], "page_id long, url string")
    assert sorted(r.verdict for r in filter_urls(df).collect()) == ["allow"] * 3
    assert filter_urls(df.limit(0)).count() == 0


def test_redundant_rules_are_pruned(spark):
    df = spark.createDataFrame([(["a", "b"], "block")] * 8 + [(["b", "c"], "allow")] * 8, "items array<string>, label string")
    got = {(tuple(sorted(r.antecedent)), r.label) for r in mine(df).collect()}
    assert got == {(("a",), "block"), (("c",), "allow")}
    assert mine(df).where(F.col("confidence") < MIN_CONFIDENCE).count() == 0


def expanded(rules):
    """All sets of tokens that fire a rule with one token for each place."""
    return {(tuple(sorted(c)), r.label): round(r.confidence, 9) for r in rules for c in product(*r.alike)}


def pruned(rules):
    return {k: round(c, 9) for k, (c, _) in rules.items() if not any(k[1] == q[1] and set(q[0]) < set(k[0]) and d >= c for q, (d, _) in rules.items())}


@pytest.mark.parametrize("most", [None, 1, 2, 3])
def test_rules_of_any_length_against_brute_force(spark, most):
    rng = random.Random(6)
    rows = []
    for _ in range(300):
        its = {t for t in "abcdef" if rng.random() < 0.5}
        if rng.random() < 0.3:
            its |= {"t1", "t2", "t3"}  # a template
        label = "block" if {"a", "b", "c"} <= its or "f" in its and "t1" in its else "allow"
        rows.append((sorted(its), label if rng.random() < 0.95 else "allow"))
    got = expanded(mine(spark.createDataFrame(rows, "items array<string>, label string"), max_tokens=most).collect())
    want = pruned(rules_of([(set(i), label) for i, label in rows], most=most or 99))
    # sets with two tokens of one template are redundant
    assert got == {k: v for k, v in want.items()}
    assert most is not None or max(len(k) for k, _ in got) >= 3


def test_long_templates_are_mined_in_seconds(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(200)]
    rows = [(words + [f"x{rng.randrange(3)}"], rng.choice(["block", "allow", "allow"])) for _ in range(400)]
    rows = [(i, "block" if "x1" in i else label) for i, label in rows]
    began = time.perf_counter()
    got = expanded(mine(spark.createDataFrame(rows, "items array<string>, label string")).collect())
    assert time.perf_counter() - began < 60
    short = [({"w0"} | {t for t in i if t[0] == "x"}, label) for i, label in rows]
    want = pruned(rules_of(short))
    assert {k: v for k, v in got.items() if all(t in ("w0", "x0", "x1", "x2") for t in k[0])} == want and (("x1",), "block") in got
    many = [(sorted(rng.sample(words, 190)), rng.choice(["block", "allow"])) for _ in range(60)]
    assert mine(spark.createDataFrame(many, "items array<string>, label string"), max_tokens=2, min_support=0.5).count() == 0


def test_labels_of_ones_own(spark):
    good = [(f"http://{h}.org/{w}/{i}", "allow") for i, h in enumerate("abcdefgh") for w in ("news", "docs")]
    bad = [(f"http://{h}.org/casino/{w}{i}", "block") for i, h in enumerate("abcdefgh") for w in ("win", "bonus")]
    labels = spark.createDataFrame(good + bad + [(None, "block"), ("http://x.org/", None)], "url string, label string")
    held_out = [(i, f"http://{h}.net/casino/{i}" if i % 2 else f"http://{h}.net/docs/{i}") for i, h in enumerate("uvwxyz")]
    got = {r.page_id: (r.verdict, r.mined_rule) for r in filter_urls(spark.createDataFrame(held_out, "page_id long, url string"), labels=labels).collect()}
    assert got == {i: ("block", "p:casino") if i % 2 else ("allow", "p:docs") for i in range(6)}


def test_what_an_explicit_rule_says_is_not_mined_again(spark):
    urls = [f"http://example.com/en/{i}" for i in range(30)] + ["http://other.org/en/x", "http://other.org/shop/x"] + [f"http://spam.net/es/shop/{i}" for i in range(9)]
    rows = filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert {r.page_id: r.verdict for r in rows if r.rule is None} == {30: "allow", 31: "block"}
    assert next(r for r in rows if r.page_id == 30).mined_rule is None
