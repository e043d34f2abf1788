"""BPE encoding and decoding with a public tokenizer, by tree concatenation.

A text longer than a leaf is halved, wherever the middle falls, until its parts
are short. The leaves are encoded each by itself, and neighbours are joined
from the leaves up. At a join only a window is encoded again: from the last
sure word end of the left half, to some characters right of the join, growing
until the window has a boundary in common with the right half's own encoding.
From there on both are the encoding of the same rest, so the result is exactly
that of the whole text.

In a leaf, a word ends for certain where a blank or a line feed follows a
character that is no white space. What stands between such places repeats, so
a worker encodes each such piece once and looks it up again.

Why it is exact. The splitter of a byte-level BPE reads words from left to
right, and to know where a word ends it looks at two characters behind it at
most: at one to see that a run of letters, digits or other signs is over, or
that the last of several blanks belongs to the next word, and at two to tell an
apostrophe from 'll, 're and 've. So
- a word that ends with two characters or more behind it in a part ends there in
  the whole text too, if it starts where a word of the whole text starts;
- what follows a word boundary is encoded as if the text began there.
Inside one word that is longer than a window there is no such boundary. Merges
are then joined by tokens: a sequence of tokens is the encoding of its word if
each two neighbours are the encoding of theirs. If the window is one word and
gives one token of each side again at the same place, all neighbours in the
joined sequence stand side by side in the encoding of the left half, of the
window or of the right half. The place must not lie behind the start of the
window's last character, since the last of several blanks is a word of its own
where other text follows.

A tokenizer with another splitter, or with special tokens that take in white
space, is used on whole texts.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import aside, ddl, map_texts, read

#: Texts of more characters are encoded as a tree with parts of so many at most.
LEAF = 1 << 12
#: Pieces that a worker remembers, and characters of the longest of them.
REMEMBERED, SHORT = 1 << 18, 64
#: Pieces that are encoded in a row.
ROW = 512
#: Characters right of a join in the first window; each next window has twice as many.
REACH = 64


#: White space of any kind before a blank or line feed; pieces where there is none; where pieces begin.
_IRREGULAR = re.compile(r"\s[ \n]")
_PIECE = re.compile(r"[ \n]?[^ \n]+")
_INNER = re.compile(rf"[ \n]\S{{1,{SHORT - 1}}}")
_BEFORE = re.compile(r"(?<=\S)(?=[ \n])")
#: A leaf's inner parts that are longer than this tell their own word ends.
_LONG = SHORT


def default_tokenizer() -> str:
    """The file of the tokenizer of the contract."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_characters() -> dict[str, int]:
    """The byte of each character that a byte-level vocabulary writes: visible Latin-1 characters are themselves, the other bytes follow
    from U+0100 on in their order. Fixed by the format."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def known_splitter(spec: dict) -> bool:
    """Whether words end as the docstring says: the byte-level splitter alone, and special tokens without white space."""
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    model = spec.get("model") or {}
    merges = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix"))
    added = spec.get("added_tokens") or []
    apart = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")) and not re.search(r"\s", t["content"]) for t in added)
    return bool(plain and merges and apart and not spec.get("normalizer"))


class Codec:
    """A byte-level BPE tokenizer of the tokenizers library, encoding long texts as trees.

    joins counts the joins that were made.
    """

    def __init__(self, path: str, leaf: int = LEAF, reach: int = REACH):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.splits = known_splitter(json.load(f))
        self.leaf, self.reach, self.joins = leaf, reach, 0
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.ids: dict[str, bytes] = {}
        self.long: dict[str, np.ndarray] = {}
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        # the bytes that each token stands for, and how many they are
        of = byte_characters()
        self.raw = [b""] * self.tokenizer.get_vocab_size()
        for name, i in self.tokenizer.get_vocab().items():
            self.raw[i] = bytes(map(of.__getitem__, name)) if all(c in of for c in name) else name.encode()
        self.bytes = np.fromiter(map(len, self.raw), np.int64, len(self.raw))

    def split(self, text: str) -> list[str]:
        """Pieces that are encoded each by itself: a blank or line feed after other than white space begins one."""
        if not _IRREGULAR.search(text) and sum(map(len, found := _PIECE.findall(text))) == len(text):
            return found
        return [p for p in _BEFORE.split(text) if p]

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces for `ids`, and for the long ones note where words end."""
        if len(self.ids) > REMEMBERED:
            self.forget()
        new = [p for p in pieces if p not in self.ids]
        # those that begin and end as pieces inside a text do are encoded many in a row: where one begins, the last one's tokens end
        rows = [p for p in new if _INNER.fullmatch(p)]
        alone = [*{*new}.difference(rows)]
        for i in range(0, len(rows), ROW):
            row = rows[i : i + ROW]
            text = "".join(row)
            if any(s in text for s in self.special):
                alone += row
                continue
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            ends = np.cumsum(self.bytes[ids])
            raw, cuts = np.array(ids, "<u4").tobytes(), (4 * np.searchsorted(ends, np.cumsum([len(p.encode()) for p in row])) + 4).tolist()
            self.ids.update(zip(row, map(raw.__getitem__, map(slice, [0, *cuts], cuts))))
        short = [p for p in alone if len(p) <= _LONG]
        for p, e in zip(short, self.tokenizer.encode_batch_fast(short, add_special_tokens=False), strict=True):
            self.ids[p] = np.array(e.ids, "<u4").tobytes()
        several = [p for p in alone if len(p) > _LONG]
        for p, node in zip(several, self.nodes(several), strict=True):
            self.ids[p], self.long[p] = node.ids.astype("<u4").tobytes(), node.word_ends

    def forget(self) -> None:
        self.ids.clear()
        self.long.clear()

    def forget_long(self) -> None:
        """Long pieces hardly ever come again."""
        for p in self.long:
            del self.ids[p]
        self.long.clear()

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(x, "<u4").tolist() for x in self.encode_raw(texts)]

    def encode_raw(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not self.splits:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        # each text is a list of parts, special tokens and trees; each tree a list of leaves, each leaf a list of pieces
        parts = [self.parts(t) if len(t) > self.leaf else [[t]] for t in texts]
        split = [[p if isinstance(p, int) else [self.split(leaf) for leaf in p] for p in ps] for ps in parts]
        self.learn({x for ps in split for p in ps if not isinstance(p, int) for leaf in p for x in leaf})
        out = []
        for ps, ss in zip(parts, split, strict=True):
            made = []
            for p, s in zip(ps, ss, strict=True):
                if isinstance(p, int):
                    made.append(np.array([p], "<u4").tobytes())
                elif len(p) == 1:
                    made += map(self.ids.__getitem__, s[0])
                else:
                    made.append(self.tree(p, [self.leaf_node(x) for x in s]))
            out.append(b"".join(made))
        self.forget_long()
        return out

    def parts(self, text: str) -> list[int | list[str]]:
        """The leaves of each stretch between special tokens, which end a word for certain, and the ids of those."""
        out: list[int | list[str]] = []
        at = 0
        while True:
            places = [(k, -len(s), s) for s in self.special if (k := text.find(s, at)) >= 0]
            stretch = text[at : min(places)[0]] if places else text[at:]
            if stretch:
                out.append(self.leaves(stretch))
            if not places:
                return out
            k, _, s = min(places)
            out.append(self.special[s])
            at = k + len(s)

    def leaves(self, text: str) -> list[str]:
        """Parts of at most `leaf` characters, by halving."""
        bounds = [0, len(text)]
        while any(b - a > self.leaf for a, b in zip(bounds, bounds[1:])):
            bounds = sorted({*bounds, *((a + b) // 2 for a, b in zip(bounds, bounds[1:]))})
        return [text[a:b] for a, b in zip(bounds, bounds[1:])]

    def leaf_node(self, pieces: list[str]) -> Node:
        """A leaf's encoding from its pieces: a word ends where a piece does, and inside long pieces where they say."""
        raw = [self.ids[p] for p in pieces]
        ids = np.frombuffer(b"".join(raw), "<u4").astype(np.int64)
        word_ends = np.zeros(len(ids), bool)
        lasts = np.cumsum([len(r) // 4 for r in raw])
        word_ends[lasts - 1] = True
        for p, n in zip(pieces, lasts.tolist()):
            if (inner := self.long.get(p)) is not None:
                word_ends[n - len(inner) : n] = inner
        return Node(ids, np.cumsum(self.bytes[ids]), word_ends)

    def tree(self, texts: list[str], nodes: list[Node]) -> bytes:
        """The ids of the texts as one, joined two at a time."""
        while len(nodes) > 1:
            pairs = range(0, len(nodes) - 1, 2)
            nodes = [join(self, texts[k], nodes[k], texts[k + 1], nodes[k + 1]) for k in pairs] + nodes[len(nodes) - len(nodes) % 2 :]
            texts = [texts[k] + texts[k + 1] for k in pairs] + texts[len(texts) - len(texts) % 2 :]
        return nodes[0].ids.astype("<u4").tobytes()

    def nodes(self, texts: list[str]) -> list[Node]:
        """Texts encoded as they are, with all word ends."""
        out = []
        for e in self.tokenizer.encode_batch(texts, add_special_tokens=False):
            ids, words = np.array(e.ids, np.int64), np.array([-1 if w is None else w for w in e.word_ids], np.int64)
            out.append(Node(ids, np.cumsum(self.bytes[ids]), np.append(words[1:] != words[:-1], True)[: len(ids)]))
        return out

    def decode_raw(self, ids: bytes) -> str:
        """The text of ids: the bytes of their tokens one after the other, which the library's decoder joins, too. Where they aren't
        UTF-8 it decides."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        try:
            if self.splits:
                return b"".join(map(self.raw.__getitem__, numbers)).decode()
        except (UnicodeDecodeError, IndexError):
            pass
        return self.tokenizer.decode(numbers, skip_special_tokens=False)

    def decode_batch(self, ids: list[list[int]]) -> list[str]:
        return [self.decode_raw(np.array(x, "<u4").tobytes()) for x in ids]


@dataclass
class Node:
    """The encoding of a part of a text: ids, the byte where each token ends, and whether a word is known to end there."""

    ids: np.ndarray
    ends: np.ndarray
    word_ends: np.ndarray


def join(codec: Codec, left_text: str, left: Node, right_text: str, right: Node) -> Node:
    """The encoding of left_text + right_text, from the encodings of both."""
    codec.joins += 1
    size = int(left.ends[-1])
    # words of the left half with two characters behind them end there in the whole
    words = np.flatnonzero(left.word_ends & (left.ends <= size - len(left_text[-2:].encode()))) if len(left_text) > 2 else []
    kept = int(words[-1]) + 1 if len(words) else 0
    word = int(left.ends[kept - 1]) if kept else 0
    reach = codec.reach
    while True:
        ahead = right_text[:reach]
        everything = len(ahead) == len(right_text) and 4 * reach >= size
        if everything or size - word <= 4 * reach:
            found = _by_words(codec, tail(left_text, size - word), left, kept, ahead, right, len(ahead) == len(right_text))
        else:
            found = _by_tokens(codec, left_text, size, left, word, ahead, right, 4 * reach)
        if found is not None:
            return found
        reach *= 2


def tail(text: str, n: int) -> str:
    """The last n bytes, which begin with a character; no more of the text is encoded than may be needed."""
    return text[max(0, len(text) - n) :].encode()[-n:].decode() if n else ""


def _by_words(codec: Codec, last: str, left: Node, kept: int, ahead: str, right: Node, complete: bool) -> Node | None:
    """A window from the last sure word end of the left half up to a word end that it shares with the right half."""
    window = codec.nodes([last + ahead])[0]
    if complete:
        return _concat(left, kept, window, len(window.ids), right, len(right.ids))
    # words of the window with two characters behind them are words of the whole; so are those of the right half from there on
    at = len(last.encode())
    most = at + len(ahead[:-2].encode())
    mine = window.ends[window.word_ends & (window.ends > at) & (window.ends <= most)] - at
    shared = np.intersect1d(mine, right.ends[right.word_ends])
    if not len(shared):
        return None
    n, k = np.searchsorted(window.ends, shared[0] + at), np.searchsorted(right.ends, shared[0])
    return _concat(left, kept, window, int(n) + 1, right, int(k) + 1)


def _by_tokens(codec: Codec, left_text: str, size: int, left: Node, word: int, ahead: str, right: Node, back: int) -> Node | None:
    """A window inside one word that began far to the left and goes on to the right, with a token of each half in it."""
    raw = left_text[max(0, len(left_text) - 2 * back) :].encode()
    base = size - len(raw)  # the byte where raw begins
    first = int(np.searchsorted(left.ends, size - back))
    starts = lambda k: int(left.ends[k - 1]) if k else 0
    while first < len(left.ids) and (starts(first) < base or raw[starts(first) - base] & 0xC0 == 0x80):
        first += 1  # a token that starts before raw or inside a character
    start = starts(first)
    if first >= len(left.ids) or start <= word:
        return None
    window = codec.nodes([raw[start - base :].decode() + ahead])[0]
    if np.count_nonzero(window.word_ends) != 1 or window.ids[0] != left.ids[first]:
        return None  # a word ends in the window, or it doesn't begin with the left half's token
    ends = window.ends - (size - start)
    most = len(ahead[:-1].encode())
    shared = np.intersect1d(ends[:-1], right.ends[:-1])
    for s in shared[(shared > 0) & (shared <= most)]:
        i, k = int(np.searchsorted(ends, s)) + 1, int(np.searchsorted(right.ends, s)) + 1
        if window.ids[i] == right.ids[k]:
            return _concat(left, first, window, i, right, k, inside=True)
    return None


def _concat(left: Node, kept: int, window: Node, n: int, right: Node, k: int, inside: bool = False) -> Node:
    """Tokens of the left half before kept, of the window before n, of the right half from k on. inside: no word ends in the window."""
    start = int(left.ends[kept - 1]) if kept else 0
    middle = start + (int(window.ends[n - 1]) if n else 0)
    shift = middle - (int(right.ends[k - 1]) if k else 0)
    return Node(
        np.concatenate([left.ids[:kept], window.ids[:n], right.ids[k:]]),
        np.concatenate([left.ends[:kept], window.ends[:n] + start, right.ends[k:] + shift]),
        np.concatenate([left.word_ends[:kept], np.zeros(n, bool) if inside else window.word_ends[:n], right.word_ends[k:]]),
    )


@lru_cache(maxsize=2)
def codec(path: str, leaf: int = LEAF) -> Codec:
    """One for each worker process."""
    return Codec(path, leaf)


def encode(docs: DataFrame, *, text: str = "text", path: str | None = None, out: str = "ids", leaf: int = LEAF) -> DataFrame:
    """docs with the ids of each text as `out`, which takes the place of a column of that name.

    Null counts as empty and has no ids; the tokenizer's file must be at the path on the executors. Texts of any length are encoded
    in one task each, repeated rows each by itself; an empty table gives no rows.
    """
    path = path or default_tokenizer()
    full, names = aside(docs)
    made = map_texts(full, lambda texts: {"ids": codec(path, leaf).encode_batch(texts)}, "ids array<int>", text=names[text], keep=ddl(full, *names.values()), done=lambda: codec(path, leaf).forget())
    return made.select(*(F.col(names[c]).alias(c) for c in docs.columns if c != out), F.col("ids").alias(out))


def decode(docs: DataFrame, *, ids: str = "ids", path: str | None = None, out: str = "text") -> DataFrame:
    """docs with the text of each list of ids as `out`, which takes the place of a column of that name. Null counts as no ids, which
    give an empty text; null ids are left out. Repeated rows are each decoded; an empty table gives no rows."""
    path = path or default_tokenizer()
    full, names = aside(docs)

    @F.pandas_udf("string")
    def texts(lists):
        import pandas as pd

        return pd.Series(codec(path).decode_batch([[] if x is None else list(x) for x in lists]))

    made = full.withColumn("decoded", texts(F.filter(F.coalesce(F.col(names[ids]), F.array().cast("array<int>")), lambda x: x.isNotNull())))
    return made.select(*(F.col(names[c]).alias(c) for c in docs.columns if c != out), F.col("decoded").alias(out))


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256 and decoded_sha256, of each text encoded and decoded again.

    Null counts as empty. Ids are hashed as little-endian unsigned 32-bit integers, the decoded text in UTF-8. Repeated
    rows are each encoded; an empty table gives no rows; other columns are ignored.
    """
    path = path or default_tokenizer()

    def fn(texts: list[str]) -> dict[str, list]:
        c = codec(path, leaf)
        ids = c.encode_raw(texts)
        return {
            "n_tokens": [len(x) // 4 for x in ids],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(c.decode_raw(x).encode()).hexdigest() for x in ids],
        }

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_texts(rows, fn, DIGESTS, keep=ddl(rows, "doc_id"), done=lambda: codec(path, leaf).forget())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
