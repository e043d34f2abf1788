"""Quality rules: statistics of each text, and lines that many documents of a host share.

Lines are normalised and hashed. For each host (the source of a document) the
distinct documents with each line are counted; lines above the limit are
boilerplate and removed, and documents of which too little is left are
rejected. Documents with equal texts count once, else a group of copies would
make boilerplate of its own text.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import aside, cut, ddl, map_texts, read, whole

#: A line is boilerplate if at least this share of the host's distinct documents have it, and MIN_DOCS of them.
LINE_SHARE = 0.01
MIN_DOCS = 10
#: A document is depleted if less than this share of its words is left.
LEFT = 0.3
MIN_WORDS = 20
REPEATED = 30
WINDOW = 8

_SPACE, _SYMBOL, _INNER = 1, 2, 4
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t\n\v\f\r")] = _SPACE
_KIND[list(b"#*$%&|<>")] = _SYMBOL
_KIND[0x80:0xC0] = _INNER  # bytes of a character after its first
#: Normalised lines: A-Z in lower case, digits as 0.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")


def line_hash(words: list[bytes]) -> int:
    """Of a line's words, as normalised."""
    return xxhash.xxh3_64_intdigest(b" ".join(words).translate(_FOLD)) - (1 << 63)


def repeat_words(words: list[bytes], doc: np.ndarray, docs: int, window: int = WINDOW) -> np.ndarray:
    """For each document, its words that stand in a window of words found twice or more in it. doc: of each word."""
    n = len(words)
    if n < window:
        return np.zeros(docs, np.int64)
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    with np.errstate(over="ignore"):
        m = n - window + 1
        key = doc[:m].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(window):
            key = (key ^ h[k : k + m]) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
    at = np.flatnonzero(doc[:m] == doc[window - 1 :])
    key = key[at]
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    starts = at[order[twice]]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=docs)


def statistics(texts: list[bytes]) -> dict[str, list]:
    """Statistics of each text; the hashes of its distinct normalised lines, and how many words the lines of each hash have."""
    docs = len(texts)
    kinds = _KIND[np.frombuffer(b"".join(texts), np.uint8)]
    sizes = np.fromiter(map(len, texts), np.int64, docs)
    of = np.repeat(np.arange(docs), sizes)
    per = lambda kind: np.bincount(of[kinds == kind], minlength=docs)
    every, counts, dup, hashes, held = [], [], [], [], []
    for t in texts:
        known, words_of, lines, n = {}, {}, 0, 0
        for line in t.split(b"\n"):
            words = line.split()
            if not words:
                continue
            lines += 1
            n += len(words)
            every += words
            h = known.get(line)
            if h is None:
                known[line] = h = line_hash(words)
            words_of[h] = words_of.get(h, 0) + len(words)
        counts.append(n)
        dup.append(lines - len(known))
        hashes.append(list(words_of))
        held.append(list(words_of.values()))
    counts = np.array(counts, np.int64)
    return {
        "n_words": counts,
        "word_chars": sizes - per(_INNER) - per(_SPACE),
        "n_symbols": per(_SYMBOL),
        "n_dup_lines": dup,
        "n_repeat_words": repeat_words(every, np.repeat(np.arange(docs), counts), docs),
        "lines": hashes,
        "line_words": held,
    }


def without(texts: list[bytes], gone: list[list[int] | None]) -> dict[str, list]:
    """The texts without the lines of the hashes; null where there are none to take out."""
    out: list[str | None] = []
    for t, hashes in zip(texts, gone, strict=True):
        drop = frozenset(hashes or ())
        out.append(b"\n".join(x for x in t.split(b"\n") if not ((words := x.split()) and line_hash(words) in drop)).decode() if drop else None)
    return {"clean_text": out}


_STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>"
#: What tells a text of a host from others: two 64-bit hashes.
_TEXT = ["mark", "mark_too"]


def marked(rows: DataFrame, text: str) -> DataFrame:
    body = whole(text)
    return rows.withColumn("mark", F.xxhash64(body)).withColumn("mark_too", F.xxhash64(F.lit(1), body))


def same_text(host: str) -> Column:
    """The join of rows with their host's text: marks of the rows against those under other names."""
    return reduce(Column.__and__, [F.col(m) == F.col(f"_{m}") for m in _TEXT], F.col(host).eqNullSafe(F.col("_host")))


def boilerplate(distinct: DataFrame, share: float = LINE_SHARE, min_docs: int = MIN_DOCS) -> DataFrame:
    """bad_host, bad_line: the hashes of each host's lines above the limit. distinct: host and lines of each text of a host.

    Each line stands in the share of the host's documents at least, so a host has at most (mean lines of a document) / share.
    """
    every = F.explode(F.concat("lines", F.array(F.lit(None).cast("long")))).alias("line")  # a null for each document, to count them
    counts = cut(distinct.select("host", every).groupBy("host", "line").agg(F.count("*").alias("n")).where((F.col("n") >= min_docs) | F.col("line").isNull()))
    totals = counts.where("line IS NULL").select(F.col("host").alias("bad_host"), F.col("n").alias("docs"))
    many = counts.where("line IS NOT NULL").join(totals, F.col("host").eqNullSafe(F.col("bad_host"))).where(F.col("n") >= F.col("docs") * share)
    return many.select("bad_host", F.col("line").alias("bad_line"))


def measured(rows: DataFrame, share: float, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """The statistics of each row (doc_id, host, text), one look at the texts, and for each text of a host with lines above the limit
    removed_words and gone, the hashes of those lines."""
    marks = marked(rows, "text")
    known = cut(map_texts(marks, statistics, _STATISTICS, keep=ddl(marks, "doc_id", "host", *_TEXT), raw=True))
    # texts are told apart by their marks, so that only hashes of lines are shuffled, and no text
    distinct = cut(known.groupBy("host", *_TEXT).agg(F.first("lines").alias("lines"), F.first("line_words").alias("line_words")))
    bad = boilerplate(distinct, share, min_docs)
    lines = distinct.select("host", *_TEXT, F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select("host", *_TEXT, "l.lines", "l.line_words")
    found = lines.join(bad, F.col("host").eqNullSafe(F.col("bad_host")) & (F.col("lines") == F.col("bad_line")))
    removed = found.groupBy("host", *_TEXT).agg(F.sum("line_words").alias("removed_words"), F.collect_list("lines").alias("gone"))
    return known, removed.select(F.col("host").alias("_host"), *(F.col(m).alias(f"_{m}") for m in _TEXT), "removed_words", "gone")


def verdict(known: DataFrame, removed: DataFrame, left: float) -> DataFrame:
    """known with removed_words, gone, base_failed and kept."""
    joined = known.join(removed, same_text("host"), "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEATED)
    enough = (F.col("n_words") - F.col("removed_words")) >= F.col("n_words") * left
    return joined.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & enough)


def judge(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", share: float = LINE_SHARE, min_docs: int = MIN_DOCS, left: float = LEFT) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, removed_words.

    A null text counts as empty: it has no words and so fails the base. A null host is a host of its own. Repeated rows
    are each judged; an empty table gives no rows; other columns of docs are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"))
    judged = verdict(*measured(rows, share, min_docs), left)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def clean(docs: DataFrame, *, text: str = "text", host: str = "source", size: str = "n_chars", share: float = LINE_SHARE, min_docs: int = MIN_DOCS, left: float = LEFT) -> DataFrame:
    """The documents that the rules keep, without their lines above the limit; `size`, if docs has it, is counted anew where lines went.

    Null and empty texts fail the base, so they go; repeated rows all stay or all go. An empty table gives no rows; all columns of
    docs are kept, whatever their names.
    """
    full, names = aside(docs)
    rows = docs.select(F.lit(0).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"))
    known, removed = measured(rows, share, min_docs)
    # the verdict is the same for all rows of a host with one text
    texts = known.groupBy("host", *_TEXT).agg(F.first("n_words").alias("n_words"), F.first("n_repeat_words").alias("n_repeat_words"))
    kept = verdict(texts, removed, left).where("kept").select(F.col("host").alias("_host"), *(F.col(m).alias(f"_{m}") for m in _TEXT), "removed_words", "gone")
    joined = marked(full, names[text]).join(cut(kept), same_text(names[host]))
    made = map_texts(joined, without, "clean_text string", text=names[text], args=("gone",), keep=ddl(joined, *names.values(), "removed_words"), raw=True)
    went = F.col("removed_words") > 0
    new = {text: F.when(went, F.col("clean_text")).otherwise(F.col(names[text]))}
    if size in docs.columns:
        new[size] = F.when(went, F.length("clean_text").cast(dict(docs.dtypes)[size])).otherwise(F.col(names[size]))
    return made.select(*(new.get(c, F.col(names[c])).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS MATERIALIZED (
  SELECT r, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d
), windows AS (
  SELECT r, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS win
  FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW})
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest(range({WINDOW})) AS k) GROUP BY r
), lines AS MATERIALIZED (
  SELECT r, source, text, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    translate(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS norm
  FROM (SELECT r, source, text, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dups AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY r
), hosts AS (
  SELECT source, count(DISTINCT text) AS docs FROM d GROUP BY source
), bad AS (
  SELECT l.source, norm FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
  GROUP BY l.source, norm, docs HAVING count(DISTINCT text) >= greatest({MIN_DOCS}, docs * {LINE_SHARE}::DOUBLE)
), removed AS (
  SELECT r, sum(n)::BIGINT AS removed_words FROM lines l JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND l.norm = b.norm GROUP BY r
), stats AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words
  FROM w LEFT JOIN covered USING (r) LEFT JOIN dups USING (r) LEFT JOIN removed USING (r)
), judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEATED} * n_words AS base_failed FROM stats
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (n_words - removed_words) >= n_words * {LEFT}::DOUBLE AS kept, removed_words
FROM judged
"""
