import hashlib
import random

import numpy as np
import pytest

from duolith.llm.bpe import Codec, decode, default_tokenizer, digests, encode

pytest.importorskip("public_tokenizers")
PIECES = ["a", "b", "the", "ing", " ", "  ", "\n", "'s", "'", "'ll", "'re", "'ve", "'m", "'d", "'t", "l", "v", "r", "e", "1", "23", ".", "é", "日本", "🎉", "\u0301", "<|endoftext|>", "<|endof", "\t", "\u00a0", "\u3000", "\x85", "\x1c", "\r", "ß", "!!!", "x" * 40, "1" * 30, "ab" * 25, "é" * 30, "\x00", "\r\n"]
SPACES = [" ", "\x85", "\u3000", "\r", "\n", "\t", "\u00a0", "a", "1"]
CUES = ["'", "l", "'ll", "'r", "e", "!", " ", "s", "v"]


def plain(codec, text):
    return codec.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("leaf,reach", [(16, 2), (5, 1), (64, 8), (8, 1), (2, 1), (30, 64)])
def test_trees_are_exact(leaf, reach):
    codec, rng = Codec(default_tokenizer(), leaf, reach), random.Random(leaf)
    for i in range(1200):
        if i % 4 < 3:
            text = "".join(rng.choice((PIECES, SPACES, CUES)[i % 4]) for _ in range(rng.randrange(0, 60)))
        else:  # one word that is longer than the pieces
            text = "".join(rng.choice(rng.choice(["abehtnr", "0123", "éßa", " ", "!?."])) for _ in range(1)) * rng.randrange(1, 60) + "".join(rng.choice("abehtnr") for _ in range(rng.randrange(0, 400)))
        got = codec.encode_batch([text])
        assert got[0] == plain(codec, text), repr(text)
        assert codec.decode_batch(got) == [text]
    assert codec.joins > 1000


def test_contractions_at_the_middle_of_long_texts():
    codec, rng = Codec(default_tokenizer()), random.Random(5)
    text = "a" * 4094 + "'l" + "l" + "b" * 4095
    assert codec.encode_batch([text])[0] == plain(codec, text)
    for i in range(40):
        text = "".join(rng.choice((PIECES, SPACES, CUES)[i % 3]) for _ in range(9000))
        assert codec.encode_batch([text])[0] == plain(codec, text)


def test_white_space_that_is_split_before_its_last_character():
    text = " \x85\u3000\r \x85a b1\u3000"
    codec = Codec(default_tokenizer(), 8, 1)
    assert codec.encode_batch([text])[0] == plain(codec, text)


def test_ordinary_long_texts_are_trees():
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()]
    codec = Codec(default_tokenizer())
    got = codec.encode_batch(texts)
    assert codec.joins >= sum(len(t) > 4096 for t in texts) > 0
    assert got == [plain(codec, t) for t in texts]


def test_another_splitter_is_left_alone(tmp_path):
    import json

    with open(default_tokenizer(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["use_regex"] = False
    (tmp_path / "other.json").write_text(json.dumps(spec), encoding="utf-8")
    codec = Codec(str(tmp_path / "other.json"), 8, 1)
    text = "one two  three\nfour " * 9
    assert not codec.splits and codec.encode_batch([text])[0] == plain(codec, text) and codec.joins == 0
    assert codec.decode_batch(codec.encode_batch([text])) == [text]


def test_decoding_of_any_ids():
    codec, rng = Codec(default_tokenizer()), random.Random(9)
    for _ in range(300):
        ids = [rng.randrange(codec.tokenizer.get_vocab_size()) for _ in range(rng.randrange(0, 40))]
        assert codec.decode_batch([ids]) == [codec.tokenizer.decode(ids, skip_special_tokens=False)]


def test_long_unsplit_texts():
    codec, rng = Codec(default_tokenizer(), 1 << 12), random.Random(0)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(150_000))
    for text in (letters, "a" * 100_000, "日" * 50_000, " " * 100_000, "one two three " * 10_000, "\n" * 9_999 + "x" * 9_999):
        assert codec.encode_batch([text])[0] == plain(codec, text)
        assert codec.decode_batch(codec.encode_batch([text])) == [text]


def test_table(spark):
    texts = [None, "", "hello world", "hello world", "<|endoftext|> a<|endoftext|>", "é" * 5000 + " tail\n", "word " * 20_000]
    df = spark.createDataFrame([(i, t, "c", "c") for i, t in enumerate(texts)] + [(None, "x", "c", "c")], "doc_id long, text string, ids string, n_tokens string")
    codec = Codec(default_tokenizer())
    got = {r.doc_id: r for r in digests(df, leaf=1000).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        ids = plain(codec, t or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = decode(encode(df), out="back").collect()
    assert all(r.back == (r.text or "") and r.n_tokens == "c" for r in back)
    over = decode(encode(df)).collect()  # in place of the texts
    assert sorted(r.text for r in over) == sorted(t or "" for t in [*texts, "x"])
    assert digests(df.limit(0)).count() == 0 and encode(df.limit(0)).count() == 0
