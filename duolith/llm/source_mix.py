"""Mixing sources to target weights by Sainte-Lague apportionment.

The words of a source are dealt, in blocks of an equal number of words, to
shards of bounded size. Sources get blocks by the highest quotients of their
targets, the shards of a source again by the highest quotients of their words:
integer quotas. In a shard the documents stand in a seeded order; the quota
takes whole passes over its blocks, and for the rest a run of consecutive
blocks from a seeded start, so that all documents but the few at the ends of
runs are taken whole. DataFrame operations throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, WORDS, aside, cut, read, running, whole

WEIGHTS = (5, 2, 1)
#: The mix has this share of all words.
SHARE = 1.5
#: No source and no document is taken more often.
MOST = 2
BLOCK_WORDS = 16
#: A shard has about so many words, so no window over it outgrows a task.
SHARD_WORDS = 1_000_000
#: And about so many documents at most.
SHARD_DOCS = 20_000
SEED = 20240917


def n_words(text: Column) -> Column:
    """The number of words, 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def draw(bound: Column, *key: Column) -> Column:
    """An integer from 0 to bound - 1 that only the seed and the key decide."""
    text = F.concat_ws(":", *[F.coalesce(k.cast("string"), F.lit("null")) for k in key])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long"), bound)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sources (source, source_size) with the place by code point, the weight and the target of each.

    A target is the smaller of most times the size and the weight times a level at which all targets reach the share of all
    words: what resharing the excess again and again comes to. With the sources by size per weight, those up to some place
    are at their limit; the level is that of the first place whose next source isn't.
    """
    place = running(sources, [F.col("source").isNull(), F.col("source")], {"_n": F.lit(1)}).withColumn("place", F.col("_n") - 1).drop("_n")
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(F.col("place"), F.lit(len(weights))).cast("int")).cast("long")
    ranked = place.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
    sums = running(ranked, [F.col("limit") / F.col("weight"), F.col("place")], {"_limits": F.col("limit"), "_weights": F.col("weight")})
    words, all_weights = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = (F.lit(words * share) - (F.col("_limits") - F.col("limit"))) / (F.lit(all_weights) - (F.col("_weights") - F.col("weight")))
    fits = sums.withColumn("level", level).where(F.col("level") * F.col("weight") <= F.col("limit"))
    first = fits.agg(F.min(F.struct(F.col("limit") / F.col("weight"), "place", "level")).alias("m")).first()["m"]
    most_of = F.col("limit").cast("double")
    return ranked.withColumn("target", most_of if first is None else F.least(most_of, F.lit(first["level"]) * F.col("weight"))).drop("limit")


def apportion(parties: DataFrame, votes: str, seats: str, group: list[str], order: list[str], out: str) -> DataFrame:
    """parties with `out`: how many of the group's seats each gets, Sainte-Lague: the highest quotients votes / (2 k + 1) win.

    A party's seats differ from its share q of n seats among p parties by less than q * p / (2 n) + 1, since each of p
    roundings moves the divisor by half a seat at most. So only the quotients in that range are ranked; there are fewer than
    5 a party on average, however many seats.
    """
    v, s = F.col(votes).cast("double"), F.col(seats).cast("double")
    sums = parties.groupBy(*group).agg(F.sum(v).alias("_all"), F.count("*").alias("_p"))
    q = F.when(F.col("_all") > 0, v * s / F.col("_all")).otherwise(0.0)
    slack = F.ceil(F.when(s > 0, q * F.col("_p") / (2 * s)).otherwise(0.0)).cast("long") + 1
    low = F.greatest(F.lit(0).cast("long"), F.floor(q) - slack)
    bounded = cut(parties.join(sums, group).withColumn("_low", low).withColumn("_high", F.floor(q) + slack + 1))
    given = bounded.groupBy(*group).agg(F.sum("_low").alias("_given"))
    seats_of = bounded.join(given, group).where(v > 0).select(*group, *order, (F.col(seats) - F.col("_given")).alias("_open"), v.alias("_votes"), F.explode(F.sequence("_low", "_high")).alias("_seat"))
    quotients = seats_of.withColumn("_quotient", F.col("_votes") / (2 * F.col("_seat") + 1))
    # ranks within the groups from one numbering of all quotients, so that no group has to fit a task
    numbered = cut(running(quotients, [*map(F.col, group), -F.col("_quotient"), *map(F.col, order), F.col("_seat")], {"_n": F.lit(1)}))
    starts = numbered.groupBy(*group).agg(F.min("_n").alias("_first"))
    won = numbered.join(starts, group).where(F.col("_n") - F.col("_first") < F.col("_open")).groupBy(*group, *order).agg(F.count("*").alias("_won"))
    joined = bounded.join(won, [*group, *order], "left")
    return joined.withColumn(out, F.col("_low") + F.coalesce("_won", F.lit(0))).select(*parties.columns, out)


def overlap(start: Column, end: Column, a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(end, b) - F.greatest(start, a))


def quotas(sized: DataFrame, block: int, shard_words: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The sources with their targets and shard counts, and the shards with their blocks, quotas and seeded starts. sized: doc_id, source, size."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    shards = F.ceil(F.greatest(F.lit(1.0), F.col("source_size") / shard_words, F.col("docs") / SHARD_DOCS)).cast("long")
    sources = cut(targets(sources).withColumn("shards", shards))
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    seats = sources.withColumn("all", F.lit(0)).withColumn("seats", F.lit(round(total / block)).cast("long"))
    given = apportion(seats, "target", "seats", ["all"], ["place"], "blocks").select("place", "blocks")
    return sources, cut(given)


def shard_of(shards: Column, seed: int) -> Column:
    """By id and text, so that rows that repeat an id, or have none, are spread, too."""
    return draw(shards, F.lit(seed), F.col("doc_id"), F.col("mark"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken, passes, cut_from, cut_words, row, mark (MD5 of the text).

    A document is taken `passes` times whole, and once more cut_words of its words from the word cut_from on (from the
    start again after its end); taken is the sum. Null texts and texts of white space have no words and are not taken. A
    null source is one of its own, the last. Rows that repeat an id are documents of their own. An empty table gives no rows.
    """
    sized = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.md5(whole(text)).alias("mark"), F.monotonically_increasing_id().alias("row")))
    sources, given = quotas(sized, block, shard_words, seed)
    named = sources.join(given, "place").select(F.col("source").alias("_source"), "place", "source_size", "target", "shards", "blocks")
    placed = sized.join(named, F.col("source").eqNullSafe(F.col("_source"))).withColumn("shard", shard_of(F.col("shards"), seed))
    placed = cut(placed.select("doc_id", "source", "row", "mark", "size", "place", "source_size", "target", "shard", "blocks"))
    shards = placed.groupBy("place", "shard").agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks"))
    shards = apportion(shards, "shard_size", "blocks", ["place"], ["shard"], "quota")
    n = F.greatest(F.lit(1).cast("long"), F.round(F.col("shard_size") / block).cast("long"))
    shards = shards.withColumn("n", n).withColumn("quota", F.least(F.col("quota"), MOST * F.col("n")))
    passes, rest = F.floor(F.col("quota") / F.col("n")), F.pmod(F.col("quota"), F.col("n"))
    at = draw(F.col("n"), F.lit(seed), F.col("place"), F.col("shard"))
    edge = lambda k: F.floor(k * F.col("shard_size") / F.col("n")).cast("long")  # noqa: E731  the first word of block k
    shards = shards.select("place", "shard", passes.alias("passes"), edge(at).alias("from"), edge(F.least(at + rest, F.col("n"))).alias("to"), edge(F.greatest(at + rest - F.col("n"), F.lit(0))).alias("wrapped"))
    order = Window.partitionBy("place", "shard").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "doc_id")), "doc_id", "size", "row")
    ends = placed.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("size"))
    both = ends.join(shards, ["place", "shard"])
    first, second = overlap(F.col("start"), F.col("end"), F.col("from"), F.col("to")), overlap(F.col("start"), F.col("end"), F.lit(0).cast("long"), F.col("wrapped"))
    cut_words = first + second
    return both.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("passes") * F.col("size") + cut_words).alias("taken"),
        "passes",
        F.when(first > 0, F.greatest(F.col("start"), F.col("from")) - F.col("start")).otherwise(0).cast("long").alias("cut_from"),
        cut_words.alias("cut_words"),
        "row",
        "mark",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, *, text: str = "text", size: str = "n_chars", **options) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each whole pass over a document, and one for each part of its text
    that is taken beyond; `size`, if docs has it, is counted anew for parts.

    Null and empty texts have no words and aren't in the mix. Rows that repeat id, source and text are numbered and each taken as
    the plan says. An empty table gives no rows; names of other columns can't clash.
    """
    full, names = aside(docs)
    doc_id, source = names[options.get("doc_id", "doc_id")], names[options.get("source", "source")]
    # rows are found again by id, source and text
    plan = mix(docs, text=text, **options)
    of = Window.partitionBy("doc_id", "source", "mark")
    plan = plan.withColumn("nth", F.row_number().over(of.orderBy("row"))).withColumn("twins", F.count("*").over(of)).where("taken > 0")
    plan = cut(plan.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.unhex("mark").alias("_mark"), F.col("size").alias("words"), F.col("nth").alias("_nth"), "twins", "passes", "cut_from", "cut_words"))
    keyed = full.withColumn("mark", F.unhex(F.md5(whole(names[text]))))
    same = F.col(doc_id).eqNullSafe(F.col("_id")) & F.col(source).eqNullSafe(F.col("_source")) & (F.col("mark") == F.col("_mark"))
    found = keyed.join(plan.where("twins = 1"), same)
    if plan.where("twins > 1").head(1):
        several = plan.where("twins > 1")
        twins = keyed.join(several.select("_id", "_source", "_mark").distinct(), same, "left_semi")
        twins = twins.withColumn("nth", F.row_number().over(Window.partitionBy(doc_id, source, "mark").orderBy(F.lit(0))))
        found = found.unionByName(twins.join(several, same & (F.col("nth") == F.col("_nth"))).drop("nth"))
    body = F.col(names[text])
    # words with the white space before them; few documents are cut, those at the ends of runs
    pieces = F.regexp_extract_all(body, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    ahead = F.least(F.col("cut_words"), F.col("words") - F.col("cut_from")).cast("int")
    again = (F.col("cut_words") - ahead).cast("int")
    piece = lambda at, n: F.regexp_replace(F.array_join(F.slice(pieces, at, n), ""), rf"^{SPACES}", "")
    part = F.filter(F.array(piece((F.col("cut_from") + 1).cast("int"), ahead), piece(F.lit(1), again)), lambda x: x != "")
    entire = F.col("cut_words") == F.col("words")
    parts = F.when(F.col("cut_words") == 0, F.array().cast("array<string>")).when(entire, F.array(body)).otherwise(part)
    rows = found.withColumn("piece", F.explode(F.concat(F.array_repeat(body, F.col("passes").cast("int")), parts)))
    new = {text: F.col("piece")}
    if size in docs.columns:
        new[size] = F.when(F.col("piece") == body, F.col(names[size])).otherwise(F.length("piece").cast(dict(docs.dtypes)[size]))
    return rows.select(*(new.get(c, F.col(names[c])).alias(c) for c in docs.columns))


_WEIGHT = f"[{', '.join(map(str, WEIGHTS))}][1 + place % {len(WEIGHTS)}]"
_DRAW = "(('0x' || substr(md5(concat_ws(':', {})), 1, 12))::BIGINT % {})"
SQL = rf"""
WITH RECURSIVE sized AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, source, md5(coalesce(text, '')) AS mark, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS MATERIALIZED (
  SELECT *, {_WEIGHT}::DOUBLE AS weight FROM (
    SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source)
), share AS (
  -- reshare what is left by weight among the open sources, and close those at twice their size, until none is
  SELECT 0 AS step, place, weight, {MOST}.0::DOUBLE * source_size AS most, false AS closed, {SHARE}::DOUBLE * sum(source_size) OVER () AS total FROM sources
  UNION ALL
  SELECT step + 1, place, weight, most, closed OR most < (total - full_words) * weight / open_weight, total FROM (
    SELECT *, sum(CASE WHEN closed THEN most ELSE 0 END) OVER () AS full_words, sum(CASE WHEN closed THEN 0 ELSE weight END) OVER () AS open_weight
    FROM share)
  WHERE step < (SELECT count(*) FROM sources)
), last AS (
  SELECT place, CASE WHEN closed THEN most ELSE (total - sum(CASE WHEN closed THEN most ELSE 0 END) OVER ()) / sum(CASE WHEN closed THEN 0 ELSE weight END) OVER () * weight END AS target
  FROM share WHERE step = (SELECT count(*) FROM sources)
), seats AS (SELECT round(sum(target) / {BLOCK_WORDS})::BIGINT AS seats FROM last
), won AS (
  SELECT place, count(*) AS blocks FROM (
    SELECT place, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, place) AS rank FROM (SELECT place, target, unnest(range(0, (SELECT seats FROM seats))) AS k FROM last WHERE target > 0))
  WHERE rank <= (SELECT seats FROM seats) GROUP BY place
), named AS MATERIALIZED (
  SELECT source, place, source_size, target, coalesce(blocks, 0) AS blocks,
    ceil(greatest(1.0, source_size / {SHARD_WORDS}, docs / {SHARD_DOCS}))::BIGINT AS shards
  FROM sources JOIN last USING (place) LEFT JOIN won USING (place)
), placed AS MATERIALIZED (
  SELECT r, doc_id, size, place, source_size, target, blocks, {_DRAW.format(f"{SEED}, coalesce(doc_id::VARCHAR, 'null'), mark", 'shards')} AS shard
  FROM sized s JOIN named n ON s.source IS NOT DISTINCT FROM n.source
), shards AS (
  SELECT place, shard, sum(size)::BIGINT AS words, greatest(1, round(sum(size) / {BLOCK_WORDS}))::BIGINT AS n, any_value(blocks) AS blocks FROM placed GROUP BY ALL
), quota AS (
  SELECT place, shard, count(*) AS quota FROM (
    SELECT place, shard, blocks, row_number() OVER (PARTITION BY place ORDER BY words / (2 * k + 1) DESC, shard) AS rank
    FROM (SELECT *, unnest(range(0, blocks)) AS k FROM shards WHERE words > 0)) WHERE rank <= blocks GROUP BY place, shard
), runs AS (
  SELECT *, q // n AS passes, q % n AS rest, {_DRAW.format(f"{SEED}, place, shard", 'n')} AS run
  FROM (SELECT place, shard, words, n, least(coalesce(quota, 0), {MOST} * n) AS q FROM shards LEFT JOIN quota USING (place, shard))
), edges AS (
  SELECT place, shard, passes, floor(run * words / n)::BIGINT AS a, floor(least(run + rest, n) * words / n)::BIGINT AS b, floor(greatest(run + rest - n, 0) * words / n)::BIGINT AS c FROM runs
), ends AS (
  SELECT *, sum(size) OVER (PARTITION BY place, shard ORDER BY md5(concat_ws(':', {SEED}, doc_id)), doc_id, size, r ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM placed
)
SELECT doc_id, size, source_size, target,
  (passes * size + greatest(0, least(stop, b) - greatest(stop - size, a)) + greatest(0, least(stop, c) - (stop - size)))::BIGINT AS taken
FROM ends JOIN edges USING (place, shard)
"""
