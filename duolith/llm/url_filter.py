"""URL filters: explicit rules, and association rules mined from labelled URLs.

The tokens of a URL (labels of its host, words of its path) are the items of a
transaction, its label one item more. FP-growth mines the frequent itemsets;
rules from tokens to a label stay if their support and confidence reach the
limits and no rule on fewer of the tokens is as good. An inverted index from
token to rules matches them: a rule fires on a URL if it is found by all of
its tokens. DataFrame operations throughout.

Two things are taken out before the mining, without a change to what the rules
say: tokens that occur in the same labelled URLs are one item (templates give
many of them), and a token that is sure of its label by itself needs no
company, since a longer rule can't be surer.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read

MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class PathRule:
    """A verdict on a host with its subdomains, where the path starts so."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def tokens(self) -> list[str]:
        """The tokens of the host and the path."""
        words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", self.path.translate(str.maketrans(_UPPER, _LOWER)))
        return sorted({f"h:{x}" for x in self.host.split(".") if x} | {f"p:{x}" for x in words})


# Fixed values of the contract.
RULES = (
    PathRule("com", "/", "allow"),
    PathRule("example.com", "/en/", "block"),
    PathRule("www.example.com", "/en/", "allow"),
    PathRule("net", "/es/", "block"),
    PathRule("net", "/fr/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first :// up to / ? # or the end, A-Z in lower case, and then up to ? # or the end; empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[PathRule, ...] = RULES) -> Column:
    """The struct (name, verdict) of the longest rule that fits, or null."""
    by_length = sorted(rules, key=lambda r: (-len(r.host), -len(r.path)))
    fits = [F.when(((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path), F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))) for r in by_length]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<name: string, verdict: string>")


def tokens(host: Column, path: Column) -> Column:
    """h: and each label of the host, p: and each run of a-z, 0-9 and non-ASCII characters of the path in lower case; distinct."""
    words = lambda c, pattern, mark: F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda w: F.concat(F.lit(mark), w))
    return F.array_distinct(F.concat(words(host, r"[^.]+", "h:"), words(F.translate(path, _UPPER, _LOWER), r"[a-z0-9\x{80}-\x{10FFFF}]+", "p:")))


_MARK = "label="


def itemsets(baskets: DataFrame, least: int, max_tokens: int | None) -> DataFrame:
    """antecedent (sorted), label, n, total: sets of two items or more that with the label are in `least` baskets, and how many have the
    set. baskets: items (sorted), label.

    Without max_tokens one FP-growth gives sets of all sizes. Their number is exponential in the items that are together in
    `least` baskets; with max_tokens sets up to that size only are made, basket by basket, at most (items of a basket) ** max_tokens.
    """
    if max_tokens is None:
        n = baskets.count()
        if not n:
            return baskets.select(F.col("items").alias("antecedent"), "label", F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("total"))
        marked = baskets.select(F.concat("items", F.array(F.concat(F.lit(_MARK), F.col("label")))).alias("items"))
        found = cut(FPGrowth(itemsCol="items", minSupport=max(0.0, (least - 0.5) / n), minConfidence=1.0).fit(marked).freqItemsets)
        sets = found.select(F.array_sort(F.filter("items", lambda x: ~x.startswith(_MARK))).alias("antecedent"), F.get(F.filter("items", lambda x: x.startswith(_MARK)), F.lit(0)).alias("of"), "freq")
        sets = sets.where(F.size("antecedent") > 1)
        totals = sets.where("of IS NULL").select("antecedent", F.col("freq").alias("total"))
        return sets.where("of IS NOT NULL").join(totals, "antecedent").select("antecedent", F.substring("of", len(_MARK) + 1, 1 << 30).alias("label"), F.col("freq").alias("n"), "total")
    grown = F.transform("items", lambda x: F.array(x))
    sizes = []
    for _ in range(max_tokens - 1):
        longer = lambda c: F.transform(F.filter("items", lambda x: x > F.element_at(c, -1)), lambda x: F.concat(c, F.array(x)))
        grown = F.flatten(F.transform(grown, longer))
        sizes.append(grown)
    if not sizes:
        return itemsets(baskets.limit(0), least, None)
    counts = baskets.select("label", F.explode(F.concat(*sizes)).alias("antecedent")).groupBy("antecedent", "label").agg(F.count("*").alias("n"))
    counts = cut(counts)
    totals = counts.groupBy("antecedent").agg(F.sum("n").alias("total"))
    return counts.where(F.col("n") >= least).join(totals, "antecedent").select("antecedent", "label", "n", "total")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_tokens: int | None = None, known: tuple[PathRule, ...] = ()) -> DataFrame:
    """antecedent, alike, label, confidence, support: the pruned rules. labelled: items (array of tokens), label.

    antecedent names one token of each set of tokens that occur in the same labelled URLs, alike lists those sets: any token of a
    set stands for it. A token of a rule is in the share min_support of the URLs, so there are at most (mean tokens of a URL) /
    min_support of them. max_tokens: sets in a rule at most; None for any number. known: a mined rule whose tokens are all among
    those of a known rule with its verdict says no more than that rule where the labels come from it, and is left out at the end.
    """
    rows = cut(labelled.where("label IS NOT NULL").select(F.monotonically_increasing_id().alias("url"), F.array_distinct("items").alias("items"), "label"))
    n = rows.count()
    least = max(1, -(-n * min_support // 1))
    one = rows.select("url", "label", F.explode("items").alias("token"))
    prints = [F.bit_xor(F.xxhash64(F.lit(i), "url")).alias(f"x{i}") for i in range(2)]  # which URLs, in 128 bits
    by = one.groupBy("token", "label").agg(F.count("*").alias("n"), *prints)
    every = by.groupBy("token").agg(F.sum("n").alias("total"), F.max("n").alias("most"), *(F.bit_xor(f"x{i}").alias(f"x{i}") for i in range(2)), F.collect_list(F.struct("label", "n")).alias("labels"))
    spoken = F.array(*map(F.lit, sorted({t for r in known for t in r.tokens()}))).cast("array<string>")
    apart = F.when(F.array_contains(spoken, F.col("token")), F.col("token"))  # tokens of known rules stay by themselves
    sets = every.where(F.col("most") >= least).groupBy("total", "most", "x0", "x1", apart.alias("apart")).agg(F.min("token").alias("name"), F.array_sort(F.collect_list("token")).alias("alike"), F.first("labels").alias("labels"))
    sets = cut(sets.select("name", "alike", "total", "most", "labels"))
    single = sets.select(F.array("name").alias("antecedent"), "total", F.explode("labels").alias("l")).select("antecedent", "l.label", "l.n", "total").where(F.col("n") >= least)
    unsure = F.broadcast(sets.where("most < total").select(F.col("name").alias("token")))
    baskets = one.join(unsure, "token").groupBy("url", "label").agg(F.array_sort(F.collect_list("token")).alias("items")).where(F.size("items") > 1)
    several = itemsets(cut(baskets.select("items", "label")), int(least), max_tokens)
    rules = single.unionByName(several).withColumn("confidence", F.col("n") / F.col("total")).where(F.col("confidence") >= min_confidence)
    rules = cut(rules.select("antecedent", "label", "confidence", (F.col("n") / n if n else F.lit(0.0)).alias("support"), F.monotonically_increasing_id().alias("rule")))
    # a rule on some of the tokens that is as sure makes a rule redundant: the index leads from all of its tokens to the longer one
    parts = rules.select("rule", "label", "confidence", F.size("antecedent").alias("size"), F.explode("antecedent").alias("token"))
    a, b = parts.where("size > 1").alias("a"), parts.alias("b")
    inside = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.label") == F.col("b.label")) & (F.col("b.size") < F.col("a.size")) & (F.col("b.confidence") >= F.col("a.confidence")))
    redundant = inside.groupBy(F.col("a.rule").alias("rule"), F.col("b.rule").alias("by"), F.col("b.size").alias("size")).agg(F.count("*").alias("n")).where("n = size").select("rule").distinct()
    kept = rules.join(redundant, "rule", "left_anti")
    for r in known:
        own = F.array(*map(F.lit, r.tokens()))
        kept = kept.where(~((F.col("label") == r.verdict) & (F.size(F.array_except("antecedent", own)) == 0)))
    named = kept.select("rule", F.posexplode("antecedent").alias("at", "name")).join(sets.select("name", F.col("alike").alias("tokens")), "name")
    alike = named.groupBy("rule").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "tokens"))), lambda x: x["tokens"]).alias("alike"))
    return kept.join(alike, "rule").select("antecedent", "alike", "label", "confidence", "support")


def inverted_index(rules: DataFrame) -> DataFrame:
    """token, place, size, confidence, support, label, rule: a row for each token that stands for a place of a rule."""
    named = rules.withColumn("rule", F.concat_ws(" ", F.array_sort("antecedent")))
    places = named.select(F.posexplode("alike").alias("place", "tokens"), F.size("alike").alias("size"), "confidence", "support", "label", "rule")
    return places.select(F.explode("tokens").alias("token"), "place", "size", "confidence", "support", "label", "rule")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """key, best: for each distinct key of urls (key, items) on which rules fire, the one of highest confidence, then support.

    A rule fires if the index leads from tokens of the URL to all of its places.
    """
    found = urls.select("key", F.explode("items").alias("token")).join(inverted_index(rules), "token")
    places = found.groupBy("key", "rule", "label", "place").agg(F.first("size").alias("size"), F.first("confidence").alias("confidence"), F.first("support").alias("support"))
    fired = places.groupBy("key", "rule", "label").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("size", "confidence", "support"))).where("n = size")
    return fired.groupBy("key").agg(F.max(F.struct("confidence", "support", F.col("label"), "rule")).alias("best"))


def filter_urls(
    pages: DataFrame, *, page_id: str = "page_id", url: str = "url", rules: tuple[PathRule, ...] = RULES, default: str = "allow", labels: DataFrame | None = None,
    min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_tokens: int | None = None,
) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, mined_rule, confidence.

    URLs that an explicit rule fits have its verdict. Association rules are mined from labels (url, label), each row a labelled
    URL; without them from the URLs that explicit rules decide, and then a mined rule that only repeats tokens of an explicit
    rule with its verdict is left out, since the labels would say nothing else. Mined rules judge the other URLs, and `default`
    those on which none fires. A null URL or one without :// has an empty host and path and gets the default. Without labelled
    URLs nothing is mined. Equal URLs are matched once; each of their rows is returned. An empty table gives no rows; other
    columns are ignored. Of rules that fire with the same confidence and support the one of the greater label and tokens counts.
    Long URLs and ones with many tokens are taken whole; see mine for what bounds the rules.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).withColumn("host", host).withColumn("path", path)
    rows = rows.withColumn("fits", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("fits.name").alias("rule"), F.col("fits.verdict").alias("fixed"))
    tokenised = cut(rows.withColumn("items", tokens(F.col("host"), F.col("path"))))
    if labels is None:
        mined = mine(tokenised.where("fixed IS NOT NULL").select("items", F.col("fixed").alias("label")), min_support, min_confidence, max_tokens, rules)
    else:
        given = labels.select(F.col("url").alias("url"), F.col("label").cast("string").alias("label"))
        mined = mine(given.select(tokens(*host_and_path(F.col("url"))).alias("items"), "label"), min_support, min_confidence, max_tokens)
    key = F.concat_ws("/", "host", "path")
    left = tokenised.where("fixed IS NULL AND size(items) > 0").withColumn("key", key)
    best = match(left.groupBy("key").agg(F.first("items").alias("items")), mined)
    nothing = [F.lit(None).cast("string").alias("mined_rule"), F.lit(None).cast("double").alias("confidence")]
    judged = tokenised.where("fixed IS NOT NULL OR size(items) = 0").select("page_id", "host", "path", "rule", F.coalesce("fixed", F.lit(default)).alias("verdict"), *nothing)
    matched = left.join(best, "key", "left")
    return judged.unionByName(matched.select("page_id", "host", "path", "rule", F.coalesce("best.label", F.lit(default)).alias("verdict"), F.col("best.rule").alias("mined_rule"), F.col("best.confidence").alias("confidence")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


SQL = rf"""
WITH parsed AS MATERIALIZED (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
), ruled AS MATERIALIZED (
  SELECT *, CASE
      WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND prefix(path, '/en/') THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/en/') THEN 'example.com/en/'
      WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/') THEN 'com/'
      WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/es/') THEN 'net/es/'
      WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/fr/') THEN 'net/fr/' END AS rule,
    list_distinct(list_concat(list_transform(regexp_extract_all(host, '[^.]+'), lambda w: 'h:' || w),
      list_transform(regexp_extract_all(translate(path, '{_UPPER}', '{_LOWER}'), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+'), lambda w: 'p:' || w))) AS items
  FROM parsed
), labelled AS MATERIALIZED (
  SELECT row_number() OVER () AS r, items, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' ELSE 'block' END AS label FROM ruled WHERE rule IS NOT NULL
), size AS (SELECT count(*) AS n, ceil(count(*) * {MIN_SUPPORT}::DOUBLE) AS least FROM labelled
), one AS (SELECT r, label, unnest(items) AS token FROM labelled
), frequent AS (
  SELECT DISTINCT token FROM (SELECT token, count(*) AS k FROM one GROUP BY token, label), size WHERE k >= least
), baskets AS (
  SELECT r, label, list_sort(list(token)) AS items FROM one SEMI JOIN frequent USING (token) GROUP BY r, label
), sets AS (
  SELECT label, list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 1) AS tokens FROM (SELECT label, items, unnest(range(1, 1 << len(items))) AS m FROM baskets)
), counted AS (
  SELECT tokens, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY tokens) AS total FROM sets GROUP BY tokens, label
), rules AS MATERIALIZED (
  SELECT tokens, label, c.n, c.n::DOUBLE / total AS confidence FROM counted c, size s WHERE c.n >= s.least AND c.n::DOUBLE / total >= {MIN_CONFIDENCE}::DOUBLE
), useful AS (
  SELECT * FROM rules r WHERE NOT EXISTS (SELECT 1 FROM rules q WHERE q.label = r.label AND len(q.tokens) < len(r.tokens) AND list_has_all(r.tokens, q.tokens) AND q.confidence >= r.confidence)
  AND NOT ({" OR ".join(f"label = '{r.verdict}' AND list_has_all({r.tokens()!r}, tokens)" for r in RULES)})
), best AS (
  SELECT page_id, host, path, max(struct_pack(confidence := confidence, n := u.n, label := label)) AS best
  FROM (SELECT DISTINCT * FROM ruled WHERE rule IS NULL) p JOIN useful u ON list_has_all(items, tokens) GROUP BY page_id, host, path
)
SELECT p.page_id, p.host, p.path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' ELSE coalesce(best.label, 'allow') END AS verdict
FROM ruled p LEFT JOIN best b ON p.rule IS NULL AND p.page_id = b.page_id AND p.host = b.host AND p.path = b.path
"""
