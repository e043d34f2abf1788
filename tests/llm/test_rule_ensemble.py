import random
import zlib

import pytest
from pyspark.sql import functions as F

from duolith.llm.rule_ensemble import STATISTICS, Rule, RuleEnsemble, classify, fit, statistics, train


def text(rng, good):
    words = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(20, 120))]
    if good:
        return " ".join(words).capitalize() + "."
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(w + "###" for w in words)
    return " ".join(f"{w.upper()}!!" for w in words) if kind == 1 else " ".join(w for w in words[:8] for _ in range(9))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    truth = {i: rng.random() < 0.8 for i in range(600)}
    rows = [(i, text(rng, g), "x", 9.0) for i, g in truth.items()] + [(9000, None, "x", 1.0), (9001, "", "x", 1.0), (None, "some text", "x", 1.0), (5, "repeated id", "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, words double").repartition(4)
    labels = spark.createDataFrame([(i, int(g), 0) for i, g in truth.items() if i % 3] + [(1, None, 0), (None, 1, 0), (7777, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels, truth


def test_held_out_accuracy(tables):
    docs, labels, truth = tables
    rows = classify(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    known = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(known) > 100 and sum(r.predicted == truth[r.doc_id] for r in known) >= 0.97 * len(known)
    again = {(r.doc_id, r.score) for r in classify(docs.repartition(2), labels).collect()}
    assert again == {(r.doc_id, r.score) for r in rows}


def test_labels_of_held_out_rows_change_nothing(tables):
    docs, labels, _ = tables
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (train(docs.select("doc_id", "text"), x.select("doc_id", F.col("quality").alias("label"))) for x in (labels, flipped))
    assert a == b and 0 < len(a.rules) < 100


def test_expression_is_the_sum_of_its_rules(spark):
    model = RuleEnsemble(((Rule((("upper", 0.5, float("inf")), ("words", -float("inf"), 10.0))), 2.0), (Rule((("words", 10.0, 20.0),)), -1.0)), 0.5)
    df = spark.createDataFrame([(0.9, 5.0), (0.9, 15.0), (0.1, 5.0), (0.1, 30.0)], "upper double, words double")
    got = [r.s for r in df.select(model.score().alias("s")).collect()]
    from math import exp

    assert got == pytest.approx([1 / (1 + exp(-z)) for z in (2.5, -0.5, 0.5, 0.5)])


def test_statistics():
    s = {k: list(v) for k, v in statistics(["AB cd cd!\ncd é |".encode(), b"", b"x\nx\n"]).items()}
    assert set(s) == set(STATISTICS)
    assert s["words"] == [6, 0, 2] and s["upper"][0] == 2 / 8 and s["pipes"][0] == 1 / 6 and s["repeated"] == [0, 0, 1 / 2]
    assert s["dup_lines"] == [0, 0, 0.5] and s["distinct"][0] == 5 / 6


def test_little_to_learn_from(spark, tables):
    docs, labels, _ = tables
    for some in (labels.limit(0), labels.where("quality = 1")):
        scores = {r.score for r in classify(docs, some).collect()}
        assert len(scores) == 1 and 0.5 <= scores.pop() < 1
    assert classify(docs.limit(0), labels).count() == 0
    assert fit(spark.createDataFrame([], ", ".join(f"{s} double" for s in STATISTICS) + ", label double")).rules == ()


def test_scores_against_brute_force(tables):
    """Every score from the rules by hand, on statistics of each text by itself."""
    from math import exp

    docs, labels, _ = tables
    model = train(docs.select("doc_id", "text"), labels.select("doc_id", F.col("quality").alias("label")))
    want = []
    for r in docs.collect():
        s = {k: float(v[0]) for k, v in statistics([(r.text or "").encode()]).items()}
        total = model.intercept + sum(w for rule, w in model.rules if all(low < s[name] <= high for name, low, high in rule.parts))
        want.append((str(r.doc_id), round(1 / (1 + exp(-total)), 9)))
    got = [(str(r.doc_id), round(r.score, 9)) for r in classify(docs, labels).collect()]
    assert sorted(got) == sorted(want) and len(set(got)) > 5


def test_statistics_against_plain_python():
    import re

    rng = random.Random(8)
    for _ in range(80):
        t = "".join(rng.choice(["a", "Bc", "ñ", " ", " ", "\n", "#", "|", "!", "7", ".", "ab ab", "\t"]) for _ in range(rng.randrange(0, 200)))
        words, lines = re.findall(r"[^ \t\n\v\f\r]+", t), [x for x in t.split("\n") if re.search(r"[^ \t\n\v\f\r]", x)]
        letters, upper = len(re.findall("[A-Za-z]", t)), len(re.findall("[A-Z]", t))
        spaces = len(re.findall(r"[ \t\n\v\f\r]", t))
        per = lambda n, of: n / max(of, 1)
        want = {
            "words": len(words), "word_length": per(len(t) - spaces, len(words)), "short_words": per(sum(len(w.encode()) <= 3 for w in words), len(words)), "distinct": per(len(set(words)), len(words)),
            "repeated": per(sum(a == b for a, b in zip(words, words[1:])), len(words)), "upper": per(upper, letters), "digits": per(t.count("7"), len(t)), "symbols": per(t.count("#"), len(words)),
            "bangs": per(t.count("!"), len(words)), "pipes": per(t.count("|"), len(words)), "stops": per(t.count("."), len(words)), "dup_lines": per(len(lines) - len(set(lines)), len(lines)),
            "line_words": per(len(words), len(lines)), "other": per(len(t) - spaces - letters, len(t)),
        }
        assert {k: float(v[0]) for k, v in statistics([t.encode()]).items()} == pytest.approx(want), repr(t)


def test_at_most_so_many_rows_are_fit_on(spark, tables):
    docs, labels, _ = tables
    many = docs.where("doc_id = 7").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(500))).alias("k")).select("doc_id", F.concat(F.lit("text "), F.repeat(F.lit("word "), F.col("k"))).alias("text"))
    model = train(docs.select("doc_id", "text").unionByName(many), labels.select("doc_id", F.col("quality").alias("label")), max_labelled=50)
    assert isinstance(model, RuleEnsemble)
