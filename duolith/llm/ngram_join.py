"""N-gram Jaccard join with Bayesian pruning of the candidates.

Texts with the same set of n-grams are one class. MinHash values of the
classes, in bands, bring candidates together. A pair's values are compared
some at a time; the matches so far give a Beta posterior of the similarity,
and pairs that reach the threshold with a probability below the tolerance are
dropped. What is left is verified on the sets themselves.

A bucket of a band may hold any number of classes. Its members are dealt to
blocks, a task compares two blocks, and gives back for each member the number
of its links and, as a forest, who hangs together: rows grow with the members
and not with the pairs. A pair is compared in the first band only in which it
meets, so that links are counted once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, aside, cut, ddl, map_texts, one_of_each, read, release, small_batches
from .components import components

N = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
#: MinHash values compared at a time, and the posterior probability below which a pair is dropped.
STEP = 16
TOLERANCE = 1e-9
#: Members of a block of a bucket, and n-grams of all of them (32 MB), so that a task holds two such blocks at most.
BLOCK, BLOCK_GRAMS = 2048, 1 << 22
_RNG = np.random.default_rng(20240917)
_A = _RNG.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def shingles(text: bytes, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of words; of all words together if there are fewer than n; none without words."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        m = max(1, len(h) - n + 1)
        key = np.full(m, len(h) if len(h) < n else n, np.uint64)
        for k in range(min(n, len(h))):
            key = (key ^ h[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
            key *= np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(32)
    return np.unique(key)


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS * ROWS values for each set; sets mustn't be empty."""
    starts = np.cumsum([0, *map(len, sets[:-1])])
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32) ^ np.concatenate(sets).astype(np.uint32)
    out = np.empty((len(sets), len(_A)), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(len(_A)):
            mixed = (values ^ _B[k]) * _A[k]
            mixed ^= mixed >> np.uint32(16)
            mixed *= np.uint32(0x7FEB352D)
            out[:, k] = np.minimum.reduceat(mixed, starts)
    return out


def band_hashes(values: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each row of values and band, of the band's values."""
    v = values.reshape(len(values), BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(v.shape[:2], 0x243F6A8885A308D3, np.uint64) + np.arange(BANDS, dtype=np.uint64)
        for r in range(ROWS):
            h = (h ^ v[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
    return h.view(np.int64)


@lru_cache
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For each number of compared values, STEP at a time, the matches that a pair must have to stay.

    With a uniform prior and m of n matches, the similarity is Beta(m + 1, n - m + 1), and reaches t with the probability
    that of n + 1 trials of chance t at most m succeed.
    """
    out = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        reaches = np.cumsum([comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(n + 1)])
        out.append(int(np.searchsorted(reaches, tolerance)))
    return tuple(out)


def pruned(x: np.ndarray, others: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Places in others (rows of MinHash values) that stay after comparing them with x step by step."""
    at, matches = np.arange(len(others)), np.zeros(len(others), np.int64)
    for i, m in enumerate(least):
        part = slice(i * STEP, (i + 1) * STEP)
        matches = matches + (others[at, part] == x[part]).sum(1)
        stay = matches >= m
        at, matches = at[stay], matches[stay]
        if not len(at):
            break
    return at


class Members:
    """Members of a block: ids, MinHash values with their bands, and sets if given."""

    def __init__(self, ids: list[int], values: list[bytes], sets: list[bytes] | None = None):
        self.ids = np.array(ids, np.int64)
        self.values = np.frombuffer(b"".join(values), "<u4").reshape(len(ids), BANDS * ROWS)
        self.bands = band_hashes(self.values)
        self.sets = [np.frombuffer(s, "<u8") for s in sets] if sets is not None else []
        self.sizes = np.array([len(s) for s in self.sets], np.int64)


def survivors(a: Members, b: Members, band: int, same: bool, least: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """For each member of a the members of b, by place, that the Bayesian comparison leaves, of the pairs that meet first in this band."""
    for i in range(len(a.ids)):
        others = np.arange(i + 1 if same else 0, len(b.ids))
        if band and len(others):
            others = others[~(b.bands[others, :band] == a.bands[i, :band]).any(1)]
        if len(others):
            others = others[pruned(a.values[i], b.values[others], least)]
        if len(others):
            yield i, others


def alive(a: Members, b: Members, band: int, same: bool, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Which members of a and of b are in a pair that survives."""
    in_a, in_b = np.zeros(len(a.ids), bool), np.zeros(len(b.ids), bool)
    for i, others in survivors(a, b, band, same, least):
        in_a[i] = True
        in_b[others] = True
    return (in_a | in_b, in_a | in_b) if same else (in_a, in_b)


def links(a: Members, b: Members, band: int, same: bool, threshold: float, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Verified links between two blocks: how many each member of a and of b has, and by ids a forest that spans them."""
    n_a, n_b = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := parent.get(x, x)) != x:
            parent[x] = x = parent.get(y, y)
        return x

    every = np.concatenate(b.sets) if b.sets else np.zeros(0, np.uint64)
    vocabulary, codes = np.unique(every, return_inverse=True)
    ends = np.cumsum(b.sizes)
    starts = ends - b.sizes
    forest = []
    for i, others in survivors(a, b, band, same, least):
        at = np.minimum(np.searchsorted(vocabulary, a.sets[i]), len(vocabulary) - 1)
        mine = np.zeros(len(vocabulary), np.int64)
        mine[at[vocabulary[at] == a.sets[i]]] = 1
        if len(others) * 4 > len(b.ids):
            common = np.add.reduceat(mine[codes], starts)[others]
        else:
            common = np.array([mine[codes[starts[j] : ends[j]]].sum() for j in others])
        others = others[common >= threshold * (a.sizes[i] + b.sizes[others] - common) - 1e-9]
        n_a[i] += len(others)
        n_b[others] += 1
        for y in b.ids[others].tolist():
            u, v = find(int(a.ids[i])), find(y)
            if u != v:
                parent[max(u, v)] = min(u, v)
                forest.append((int(a.ids[i]), y))
    return n_a, n_b, forest


def profiles(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, text_hash, grams, key (the digest of the set of n-grams) and values (MinHash values as bytes), both null without words. docs: doc_id, text."""

    def fn(texts: list[bytes]) -> dict[str, list]:
        sets = [shingles(t, n) for t in texts]
        filled = [i for i, s in enumerate(sets) if len(s)]
        values: list = [None] * len(texts)
        if filled:
            for i, v in zip(filled, minhash([sets[i] for i in filled]), strict=True):
                values[i] = v.astype("<u4").tobytes()
        return {"grams": [len(s) for s in sets], "key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], "values": values}

    rows = docs.withColumn("text_hash", F.xxhash64("text"))
    return map_texts(rows, fn, "grams int, key binary, values binary", keep=ddl(rows, "doc_id", "text_hash"), raw=True)


def bands(leads: DataFrame) -> DataFrame:
    """rep, grams, band, hash: a row for each class and band. leads: rep, grams, values."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = np.frombuffer(b"".join(batch.column("values").to_pylist()), "<u4").reshape(batch.num_rows, -1)
                rep, grams = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), BANDS) for c in ("rep", "grams"))
                band = np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(grams), pa.array(band), pa.array(band_hashes(values).ravel())], names=["rep", "grams", "band", "hash"])

    return leads.select("rep", "grams", "values").mapInArrow(fn, "rep long, grams int, band int, hash long")


def buckets(entries: DataFrame) -> DataFrame:
    """band, hash, n, all_grams: buckets of two members or more; of those with the same members the one of the first band.

    Equal members are told by their number, the least and sums of two hashes. A pair's first common band is never left out
    so: a bucket with the same members in an earlier band would have the pair, too.
    """
    sums = [F.sum(F.xxhash64("rep", F.lit(i)) % (1 << 40)).alias(f"h{i}") for i in range(2)]
    found = entries.groupBy("band", "hash").agg(F.count("*").alias("n"), F.min("rep").alias("low"), F.sum("grams").alias("all_grams"), *sums).where("n > 1")
    return found.groupBy("n", "all_grams", "low", "h0", "h1").agg(F.min(F.struct("band", "hash")).alias("b")).select("b.band", "b.hash", "n", "all_grams")


def dealt(members: DataFrame, block: int) -> DataFrame:
    """rep, band, hash, mine, p, q: the pairs of blocks p <= q of its bucket that each member (rep, band, hash, n, all_grams) takes part in. mine: its block."""
    k = F.ceil(F.greatest(F.col("n") / block, F.col("all_grams") / BLOCK_GRAMS)).cast("int")
    mine = F.pmod(F.xxhash64("rep", F.lit(7)), F.col("k")).cast("int")
    placed = members.withColumn("k", k).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return placed.select("rep", "band", "hash", "mine", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"))


def by_block_pair(rows: DataFrame, fn: Callable[[int, bool, tuple, list[dict], list[dict]], Iterator[tuple]], schema: str) -> DataFrame:
    """Apply fn to the members of each pair of blocks, one pair at a time: to the band, whether it is one block with itself,
    the key and the members of both."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    keys = ["band", "hash", "p", "q"]
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for at in range(0, b.num_rows, 256) for r in b.slice(at, 256).to_pylist())
        made: list[tuple] = []
        for key, group in groupby(rows, key=lambda r: tuple(r[k] for k in keys)):
            members = list(group)
            same = key[2] == key[3]
            made += fn(key[0], same, key, [r for r in members if r["mine"] == key[2]], [r for r in members if r["mine"] == key[3]])
            if len(made) >= 1 << 14:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), out)], schema=out)
                made = []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), out)], schema=out)
        release()

    return small_batches(rows).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def similar(rows: DataFrame, n: int, threshold: float, block: int, tolerance: float) -> DataFrame:
    """doc_id, text_hash, root, set_id, class_id, n_links of each row. rows: doc_id, text."""
    least = least_matches(threshold, tolerance)
    every = cut(profiles(rows, n))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    leads = every.where("key IS NOT NULL").groupBy("key").agg(F.min(order).alias("lead"), F.first("values").alias("values"), F.first("grams").alias("grams"))
    leads = cut(leads.select("key", "lead.doc_id", "lead.text_hash", "values", "grams", F.monotonically_increasing_id().alias("rep")))
    entries = bands(leads)
    kept = cut(buckets(entries))
    members = dealt(entries.select("rep", "band", "hash").join(kept, ["band", "hash"]), block)

    def living(band: int, same: bool, key: tuple, a: list[dict], b: list[dict]) -> Iterator[tuple]:
        x, y = (Members([r["rep"] for r in m], [r["values"] for r in m]) for m in (a, b))
        in_x, in_y = alive(x, y, band, same, least)
        yield from ((*key, key[2], int(r)) for r in x.ids[in_x])
        if not same:
            yield from ((*key, key[3], int(r)) for r in y.ids[in_y])

    values = leads.select("rep", "values")
    left = cut(by_block_pair(members.join(values, "rep"), living, "band int, hash long, p int, q int, mine int, rep long"))
    wanted = left.select("rep").distinct().join(leads.select("rep", F.col("doc_id").alias("lead_id"), F.col("text_hash").alias("lead_hash")), "rep")
    wanted = cut(wanted)
    texts = rows.withColumn("text_hash", F.xxhash64("text")).join(wanted, F.col("doc_id").eqNullSafe(F.col("lead_id")) & (F.col("text_hash") == F.col("lead_hash")))
    texts = texts.groupBy("rep").agg(F.first("text").alias("text"))  # of rows that repeat id and text, one
    sets = map_texts(texts.select("rep", "text"), lambda ts: {"grams": [shingles(t, n).tobytes() for t in ts]}, "grams binary", keep="rep long", raw=True)
    full = left.join(sets, "rep").join(values, "rep")

    def linking(band: int, same: bool, key: tuple, a: list[dict], b: list[dict]) -> Iterator[tuple]:
        x, y = (Members([r["rep"] for r in m], [r["values"] for r in m], [r["grams"] for r in m]) for m in (a, b))
        n_x, n_y, forest = links(x, y, band, same, threshold, least)
        yield from ((int(r), None, int(c)) for m, c_m in ((x, n_x), (y, n_y)) for r, c in zip(m.ids, c_m) if c)
        yield from ((u, v, 0) for u, v in forest)

    found = cut(by_block_pair(full, linking, "rep long, other long, n long"))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n_links"))
    roots = components(found.where("other IS NOT NULL"), "rep", "other").select(F.col("node").alias("rep"), "root")
    linked = leads.select("rep", "key", F.col("doc_id").alias("set_id")).join(counts, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    linked = cut(linked)
    firsts = linked.groupBy("root").agg(F.min("set_id").alias("class_id"))
    info = linked.join(firsts, "root").select(F.col("key").alias("lead_key"), "root", "set_id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    # a key may be a large share of the rows; the other side has each key once
    return every.select("doc_id", "text_hash", "key").join(info, F.col("key") == F.col("lead_key"), "left").select(
        "doc_id", "text_hash", "root",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("set_id")).alias("set_id"),
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, block: int = BLOCK, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per input row: doc_id, class_id, set_id, n_links.

    Texts are linked if the Jaccard similarity of their sets of n-grams of words reaches the threshold. class_id is the
    smallest id of what hangs together by links, set_id the smallest id of the texts with the same set, n_links the number
    of other sets that the text's set is linked to. A text of fewer than n words has one gram of all of them; a text without
    words, null too, is linked to none. Rows that repeat an id are texts of their own; of null ids others are preferred for
    class_id. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return similar(rows, n, threshold, block, tolerance).select("doc_id", "class_id", "set_id", "n_links")


def drop_near_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, block: int = BLOCK, tolerance: float = TOLERANCE) -> DataFrame:
    """docs, with all its columns, with one row of each class of near copies, that of the smallest id (null last); rows without words,
    null and empty texts too, stay. Of rows that repeat an id and its text one stays. An empty table gives no rows."""
    full, names = aside(docs)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    every = similar(rows, n, threshold, block, tolerance)
    same = every.where("root IS NOT NULL").groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("twins"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "twins")
    first = same.groupBy("root").agg(F.min(order).alias("k"))
    first = cut(first.select(F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash"), F.col("k.twins").alias("twins")))
    body = F.coalesce(F.col(names[text]), F.lit(""))
    keyed = full.withColumn("text_hash", F.xxhash64(body))
    found = keyed.join(first, F.col(names[doc_id]).eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    columns = list(names.values())
    kept = one_of_each(found, first, ["_id", "_hash"], "twins", columns)
    empty = full.where(F.length(F.regexp_replace(F.coalesce(F.col(names[text]), F.lit("")), SPACES, "")) == 0)
    return kept.unionByName(empty.select(*columns)).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents"))


SQL = rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents
), grams AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < {N} THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + {N - 1}], ' ') END AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - {N - 2}))) AS i FROM d WHERE len(w) > 0)
), sets AS MATERIALIZED (
  SELECT doc_id, set_key, grams, min(doc_id) OVER (PARTITION BY set_key) AS set_id
  FROM (SELECT doc_id, md5(string_agg(gram, chr(10) ORDER BY gram)) AS set_key, count(*) AS grams FROM grams GROUP BY doc_id)
), leads AS MATERIALIZED (
  SELECT g.doc_id, gram, grams FROM grams g JOIN sets s ON g.doc_id = s.doc_id AND s.doc_id = s.set_id
), links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM leads a JOIN leads b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.grams, b.grams HAVING count(*) >= {THRESHOLD}::DOUBLE * (a.grams + b.grams - count(*)) - 1e-9
), reach AS (
  SELECT a AS node, a AS other FROM links UNION SELECT node, b FROM reach JOIN links ON other = a
), classes AS (SELECT node, min(other) AS class_id FROM reach GROUP BY node
), counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT d.doc_id, coalesce(class_id, set_id, d.doc_id) AS class_id, coalesce(set_id, d.doc_id) AS set_id, coalesce(n_links, 0) AS n_links
FROM d LEFT JOIN sets s USING (doc_id) LEFT JOIN classes c ON set_id = node LEFT JOIN counts n ON set_id = a
"""
