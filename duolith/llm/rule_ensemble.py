"""Quality classifier: a sparse ensemble of rules over statistics of a text.

A random forest of shallow trees is fit to labelled documents; each path from
a root to a node is a conjunctive rule over the statistics. A logistic
regression with a lasso penalty on the rules leaves few with weight, and these
are compiled into one Spark column expression for the score.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ddl, map_texts, read

#: Labelled documents that the classifier is fit on at most: a hash of the id picks them.
MAX_LABELLED = 20_000
TREES, DEPTH, PENALTY, SEED = 20, 3, 0.002, 20240917
ACCEPT = 0.7
#: A document is held out of the fit if crc32 of its id as text leaves this remainder by FOLDS.
FOLDS, HELD_OUT = 4, 2

STATISTICS = ("words", "word_length", "short_words", "distinct", "repeated", "upper", "digits", "symbols", "bangs", "pipes", "stops", "dup_lines", "line_words", "other")
_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digits": b"0123456789", "symbols": b"#*$%&<>@^~=_+{}[]\\/", "bangs": b"!", "pipes": b"|", "stops": b".,;:?", "spaces": b" \t\n\v\f\r"}
_CODE = np.zeros(256, np.uint8)
for _i, _chars in enumerate(_KINDS.values(), 1):
    _CODE[list(_chars)] = _i
_CODE[0x80:0xC0] = len(_KINDS) + 1  # further bytes of a character


def statistics(texts: list[bytes]) -> dict[str, list]:
    """The statistics of each text; shares of an empty text are 0."""
    docs = len(texts)
    split = [t.split() for t in texts]
    n = np.fromiter(map(len, split), np.int64, docs)
    sizes = np.fromiter(map(len, texts), np.int64, docs)
    of, codes = np.repeat(np.arange(docs), sizes), _CODE[np.frombuffer(b"".join(texts), np.uint8)]
    table = np.bincount(of * (len(_KINDS) + 2) + codes, minlength=docs * (len(_KINDS) + 2)).reshape(docs, -1)
    per = {k: table[:, i] for i, k in enumerate(_KINDS, 1)}
    chars = sizes - table[:, -1]
    letters = per["upper"] + per["lower"]
    words = [w for ws in split for w in ws]
    doc = np.repeat(np.arange(docs), n)
    h = np.fromiter(map(hash, words), np.int64, len(words))
    same = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1])) + 1
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = [[x for x in t.split(b"\n") if x.split()] for t in texts]
    n_lines = np.fromiter(map(len, lines), np.int64, docs)
    distinct_lines = np.fromiter((len(set(x)) for x in lines), np.int64, docs)
    share = lambda a, b: a / np.maximum(b, 1)
    count = lambda at: np.bincount(at, minlength=docs)
    return {
        "words": n.astype(float),
        "word_length": share(chars - per["spaces"], n),
        "short_words": share(count(doc[lengths <= 3]), n),
        "distinct": share(np.fromiter((len(set(ws)) for ws in split), np.int64, docs), n),
        "repeated": share(count(doc[same]), n),
        "upper": share(per["upper"], letters),
        "digits": share(per["digits"], chars),
        "symbols": share(per["symbols"], n),
        "bangs": share(per["bangs"], n),
        "pipes": share(per["pipes"], n),
        "stops": share(per["stops"], n),
        "dup_lines": share(n_lines - distinct_lines, n_lines),
        "line_words": share(n, n_lines),
        "other": share(chars - per["spaces"] - letters, chars),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction: (statistic, low, high) holds if low < value <= high."""

    parts: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        tests = [t for s, low, high in self.parts for t in ([F.col(s) > low] if low > -np.inf else []) + ([F.col(s) <= high] if high < np.inf else [])]
        return reduce(Column.__and__, tests)

    def __str__(self) -> str:
        return " and ".join(f"{low:g} < {s} <= {high:g}" for s, low, high in self.parts)


@dataclass(frozen=True)
class RuleEnsemble:
    """Rules with their weights, and what is added to them."""

    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def score(self) -> Column:
        """The probability of label 1, as an expression over columns with the names of the statistics."""
        total = reduce(Column.__add__, [F.when(r.column(), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.rules], F.lit(self.intercept))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def paths(root) -> list[Rule]:
    """The rules of all nodes below a tree's root, in a JVM model."""
    out = []

    def walk(node, box: dict[str, tuple[float, float]]) -> None:
        if box:
            out.append(Rule(tuple((s, *box[s]) for s in STATISTICS if s in box)))
        if node.getClass().getSimpleName() == "InternalNode":
            name, at = STATISTICS[node.split().featureIndex()], node.split().threshold()
            low, high = box.get(name, (-np.inf, np.inf))
            walk(node.leftChild(), box | {name: (low, min(high, at))})
            walk(node.rightChild(), box | {name: (max(low, at), high)})

    walk(root, {})
    return out


def fit(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY, seed: int = SEED) -> RuleEnsemble:
    """labelled: the statistics and label (0.0 or 1.0). Without rows of both labels the score is their share, smoothed."""
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(counts) < 2:
        ones, n = counts.get(1.0, 0), sum(counts.values())
        return RuleEnsemble((), float(np.log((ones + 1) / (n - ones + 1))))
    assembled = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(labelled)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=5, seed=seed).fit(assembled)
    rules = list(dict.fromkeys(r for t in forest.trees for r in paths(t._call_java("rootNode"))))
    if not rules:
        return RuleEnsemble((), float(np.log((counts[1.0] + 1) / (counts[0.0] + 1))))
    fired = labelled.select("label", *(r.column().cast("double").alias(f"r{i}") for i, r in enumerate(rules)))
    vectors = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(fired).select("label", "features")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=200).fit(vectors.cache())
    vectors.unpersist()
    weights = lasso.coefficients.toArray()
    return RuleEnsemble(tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6), float(lasso.intercept))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", max_labelled: int = MAX_LABELLED) -> RuleEnsemble:
    """Fit to at most max_labelled labelled documents that aren't held out, picked by a hash of their ids. docs: doc_id and text; labels: doc_id and label.

    Rows without a label of 0 or 1 are left out; of several labels of a document the largest counts. Rows that repeat an id with the
    same statistics count once, those of different texts each; null and empty texts and very long ones count like others.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    order = F.md5(F.col("doc_id").cast("string"))
    picked = usable.groupBy("doc_id").agg(F.max("label").cast("double").alias("label")).orderBy(order, "doc_id").limit(max_labelled)
    rows = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "label", F.col(text).alias("text"))  # at most max_labelled ids
    known = cut(map_texts(rows, statistics, ", ".join(f"{s} double" for s in STATISTICS), keep=ddl(rows, "doc_id", "label"), raw=True))
    return fit(cut(known.distinct().orderBy(order, "doc_id", *STATISTICS).limit(max_labelled)))  # in one order, so that reruns agree


def classify(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", accept: float = ACCEPT, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1, higher: label 1 is likelier), predicted.

    Null counts as an empty text and is scored like one, and texts of any length are taken whole. Only the text goes into a score.
    Repeated rows are each scored alike; a score of just `accept` is predicted 1. An empty table gives no rows; other columns are
    ignored, whatever their names. See train for repeated labels and for documents that are labelled.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    model = train(rows, labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")), max_labelled=max_labelled)
    known = map_texts(rows, statistics, ", ".join(f"{s} double" for s in STATISTICS), keep=ddl(rows, "doc_id"), raw=True)
    scored = known.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= accept).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
