import random
import re

import pytest
from pyspark.sql import functions as F

from duolith.llm.quality_rules import clean, judge, repeat_words, statistics

SCHEMA = "doc_id long, text string, source string, n_chars long, host string, bad string"
W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = W.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    marked = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if W.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


def test_statistics_against_brute_force():
    rng = random.Random(5)
    texts = ["", "\n\n \t", "é\x85ü x #*$", "a " * 30]
    texts += ["".join(rng.choice(["a", "bb", "ñ", " ", " ", "\n", "#", "\x0b"]) for _ in range(rng.randrange(1, 400))) for _ in range(60)]
    got = statistics([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert tuple(int(got[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute(t), repr(t)


def test_windows_stay_inside_documents():
    import numpy as np

    words = [b"w%d" % i for i in range(8)] * 2
    assert repeat_words(words, np.repeat([0, 1], 8), 2).tolist() == [0, 0]


@pytest.fixture
def docs(spark):
    body = lambda i: " ".join("w" + chr(97 + k % 26) * (k // 26 + 1) + chr(97 + i % 26) * (i // 26 + 1) for k in range(40))
    rows = [(i, f"Shared  LINE number {i % 10}\n{body(i)}", "a") for i in range(12)]
    rows += [(50, "shared line number 3 \n" * 9 + " ".join(f"few{k}" for k in range(4)), "a")]
    rows += [(60 + i, body(99), "a") for i in range(30)]  # copies count once
    rows += [(100, None, "a"), (101, "", None), (102, body(5), None), (102, body(5), None), (None, body(7), "b")]
    return spark.createDataFrame([(*r, len(r[1] or ""), "clash", "clash") for r in rows], "doc_id long, text string, source string, n_chars long, host string, bad string").repartition(3)


def test_shared_lines_go_and_depleted_documents_too(docs):
    got = {(r.doc_id, r.n_words): r for r in judge(docs).collect()}
    assert len(got) == docs.distinct().count()
    assert got[(0, 44)].removed_words == 4 and got[(0, 44)].kept
    depleted = next(r for (d, _), r in got.items() if d == 50)
    assert depleted.base_failed is True or not depleted.kept
    assert all(got[(60 + i, 40)].kept and got[(60 + i, 40)].removed_words == 0 for i in range(30))
    assert not got[(100, 0)].kept and not got[(101, 0)].kept and got[(102, 40)].kept and got[(None, 40)].kept
    out = clean(docs)
    assert out.columns == docs.columns
    kept = {r.doc_id: r for r in out.collect()}
    assert "hared" not in kept[3].text and kept[3].n_chars == len(kept[3].text)
    assert out.where("doc_id = 102").count() == 2 and kept[60].text == docs.where("doc_id = 60").first().text


def test_depleted_without_repeats(spark):
    shared = [" ".join(f"line{chr(97 + k)}word{chr(97 + j)}" for j in range(12)) for k in range(3)]
    rows = [(i, "\n".join([*shared, *(f"{chr(97 + i)} own {chr(97 + k)} a b c d" for k in range(20))]), "s") for i in range(20)] + [(99, "\n".join([*shared, "own few"]), "s")]
    got = {r.doc_id: r for r in judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[99].base_failed and not got[99].kept and got[99].removed_words == 36
    assert all(got[i].kept for i in range(20))


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert judge(df).count() == 0 and clean(df).select(F.col("n_chars")).count() == 0
