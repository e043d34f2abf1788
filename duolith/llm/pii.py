"""Personal data: fixed patterns, and further spans by weak supervision.

Loose patterns propose candidate spans. Labelers of three sorts (regex
checks, gazetteers, context) vote for, against or not at all. How often each
vector of votes occurs in the whole corpus is all that expectation-maximisation
needs to estimate the labelers' reliabilities; the posteriors then train the
final classifier, a logistic regression on the features of a span. Votes and
features are small integers, so the table of their counts is bounded by
3 ** labelers * 2 ** features, however large the corpus is.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ddl, map_texts, read

BASE = ("email", "ip", "card", "phone")
ADDED = ("national", "id", "iban", "birth", "name")
KINDS = BASE + ADDED
#: A candidate is added if the classifier gives it this probability.
ACCEPT = 0.7

# Fixed values of the contract. What starts in the middle of a run of digits would match nothing that its start doesn't.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

Span = tuple[int, int, int]  #: index in KINDS, start, end


def luhn(digits: str) -> bool:
    doubled = [d for c in digits[-2::-2] for d in divmod(2 * int(c), 10)]
    return (sum(doubled) + sum(map(int, digits[::-2]))) % 10 == 0


def emails(text: str) -> list[Span]:
    """Each @ with its local part, found backwards, so that a long run without an @ costs nothing."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((0, start, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)
    return out


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[Span]:
    """By kind as in BASE, then by start."""
    out = emails(text)
    if _DIGIT.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        out += [(2, *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# Candidates.
_NATIONAL = re.compile(r"(?<![\w+.-])\(?[0-9]{2,5}\)?[ ./-][0-9]{2,4}[ .-][0-9]{3,5}(?![\w-])")
_ID = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_BIRTH = re.compile(r"(?<![\w./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![\w/-])")

#: Gazetteers: common given names, titles, and the length of an IBAN by country.
GIVEN = frozenset("James John Robert Michael William David Richard Thomas Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Hans Peter Klaus Jürgen Wolfgang Ursula Monika Petra Sabine Jean Pierre Michel Philippe Nathalie Isabelle Françoise Jose Antonio Manuel Francisco Carmen Lucia Pilar Dolores".split())
TITLES = frozenset("Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Señor Señora".split())
IBAN_LENGTH = {"DE": 22, "FR": 27, "ES": 24, "GB": 22, "IT": 27, "NL": 18, "AT": 20, "BE": 16, "CH": 21, "PT": 25}
_CUE_WORDS = "name contact dear sincerely signed kontakt geehrte geehrter nom nombre attn".split()
_WORD = rf"(?!(?i:{'|'.join(_CUE_WORDS)})\b)[A-ZÀ-ÖØ-Þ](?:[a-zß-öø-ÿ]++|(?=['’][A-ZÀ-ÖØ-Þ]))(?:['’-][A-Za-zÀ-ÖØ-öø-ÿ]++)*+(?!\w)"
#: Runs of capitalised words, of two or more or behind a title, whether or not a gazetteer knows them.
_NAME = re.compile(rf"\b(?:(?:{'|'.join(sorted(TITLES))})\b\.? {_WORD}(?: {_WORD})*+|{_WORD}(?: {_WORD})++)")
PATTERNS = {"national": _NATIONAL, "id": _ID, "iban": _IBAN, "birth": _BIRTH, "name": _NAME}

#: Context before a span that speaks for its kind, and context that speaks against any.
CUES = {
    "national": re.compile(r"(?i)\b(?:tel|telephone|phone|call|fax|mobile|cell|telefon|handy|téléphone|teléfono)\b"),
    "id": re.compile(r"(?i)\b(?:ssn|social security|id number|national id|sozialversicherung\w*)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|account|konto|compte|cuenta|bank)\b"),
    "birth": re.compile(r"(?i)\b(?:born|birth|birthday|dob|geboren|geburtsdatum|né|née|nacido|nacida)\b"),
    "name": re.compile(r"(?i)\b(?:name|contact|dear|sincerely|signed|kontakt|sehr geehrte\w*|nom|nombre|attn)\b"),
}
AGAINST = re.compile(r"(?i)\b(?:isbn|issn|version|order|invoice|page|fig|figure|table|item|part|chapter|section|price|no)\b\W*$")
NEAR = 40


@dataclass(frozen=True)
class Candidate:
    text: str
    kind: str
    start: int
    end: int
    company: frozenset[int]  #: kinds of the base spans that start nearby

    @property
    def value(self) -> str:
        return self.text[self.start : self.end]

    @property
    def before(self) -> str:
        return self.text[max(0, self.start - NEAR) : self.start]


def regex_vote(c: Candidate) -> int:
    """Is the value valid for its kind?"""
    d = _digits(c.value)
    if c.kind == "iban":
        s = c.value.replace(" ", "")
        return 1 if int("".join(str(int(x, 36)) for x in s[4:] + s[:4])) % 97 == 1 else -1
    if c.kind == "id":
        return -1 if d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000" else 1
    if c.kind == "birth":
        a, b = sorted(int(x) for x in re.split("[./-]", c.value) if len(x) < 4)
        return 1 if 1 <= a <= 12 and 1 <= b <= 31 else -1
    if c.kind == "national":
        return 1 if 9 <= len(d) <= 12 else -1
    if c.kind == "name":
        return 0 if c.value.count(" ") < 5 else -1
    return 1


def gazetteer_vote(c: Candidate) -> int:
    if c.kind == "name":
        first, *more = c.value.split()
        return 1 if first.rstrip(".") in TITLES or first in GIVEN or more[-1] in GIVEN else -1
    if c.kind == "iban":
        return 1 if IBAN_LENGTH.get(c.value[:2]) == len(c.value.replace(" ", "")) else -1
    return 0


def cue_vote(c: Candidate) -> int:
    if AGAINST.search(c.before):
        return -1
    return 1 if c.kind in BASE or CUES[c.kind].search(c.before) else 0


def company_vote(c: Candidate) -> int:
    """Personal data stand together."""
    return 1 if c.company - {KINDS.index(c.kind)} else 0


def place_vote(c: Candidate) -> int:
    """Against what is part of a larger number, a sum or a list of numbers."""
    around = c.before[-3:] + " " + c.text[c.end : c.end + 3]
    return -1 if re.search(r"[0-9=*/%$€£]", around) else 0


LABELERS: tuple[Callable[[Candidate], int], ...] = (regex_vote, gazetteer_vote, cue_vote, company_vote, place_vote)
N_FEATURES = 13
_OPENS = re.compile(r"(?:\A|[.!?:;\n]\s*|\A\s*)\Z")
_CLOSES = re.compile(r"\s*(?:\Z|[\n,;)]|[.](?:\s|\Z))")


def features(c: Candidate, said: tuple[int, ...]) -> int:
    """Bits: the five added kinds, which base kinds have none of; with a cue, in company, known name, in a bad place; and what no
    labeler looks at: at the start of a sentence or line, before a comma or the end of one, long, of several parts."""
    _, gazetteer, cue, company, place = said
    bits = [c.kind == k for k in ADDED] + [cue > 0, company > 0, gazetteer > 0, place < 0 or cue < 0]
    bits += [bool(_OPENS.search(c.before[-4:])), bool(_CLOSES.match(c.text, c.end, c.end + 4)), c.end - c.start > 14, len(re.findall("[ ./-]", c.text[c.start : min(c.end, c.start + 99)])) > 1]
    return sum(b << i for i, b in enumerate(bits))


def votes(said: tuple[int, ...]) -> int:
    """The votes as digits to the base of three."""
    return sum((v + 1) * 3**i for i, v in enumerate(said))


class Around:
    """The base spans of a text by place, so that each look around costs no more than what is near."""

    def __init__(self, base: list[Span]):
        self.starts = [sorted(a for k, a, _ in base if k == i) for i in range(len(BASE))]
        self.spans = sorted((a, b) for _, a, b in base)
        self.reach = list(accumulate((b for _, b in self.spans), max))

    def overlaps(self, start: int, end: int) -> bool:
        i = bisect_left(self.spans, (end, 0))
        return i > 0 and self.reach[i - 1] > start

    def company(self, end: int) -> frozenset[int]:
        low, high = end - 2 * NEAR, end + 2 * NEAR
        return frozenset(i for i, s in enumerate(self.starts) if (at := bisect_left(s, low)) < len(s) and s[at] <= high)


def candidates(text: str, base: list[Span]) -> list[tuple[int, int, int, int, int]]:
    """kind, start, end, votes, features of the base spans and of what the loose patterns find beside them."""
    around = Around(base)
    found = [Candidate(text, KINDS[k], a, b, around.company(b)) for k, a, b in base]
    digits = _DIGIT.search(text)
    for kind, pattern in PATTERNS.items():
        if kind == "name" or digits:
            found += [Candidate(text, kind, *m.span(), around.company(m.end())) for m in pattern.finditer(text) if not around.overlaps(*m.span())]
    said = [tuple(v(c) for v in LABELERS) for c in found]
    return [(KINDS.index(c.kind), c.start, c.end, votes(v), features(c, v)) for c, v in zip(found, said, strict=True)]


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation-maximisation for one hidden class and labelers that are independent given it.

    patterns: votes in -1, 0, 1, a row each; counts: how often. Gives the share of the class, the probability of each
    vote by labeler and class, and the posterior of each row. Weak priors keep a labeler better than chance.
    """
    labelers = patterns.shape[1]
    prior = np.zeros((labelers, 2, 3))
    prior[:, 0], prior[:, 1] = (4, 2, 1), (1, 2, 4)  # pseudo-counts: class 0 votes against, class 1 for
    share, odds = 0.5, prior / prior.sum(2, keepdims=True)
    index = patterns + 1
    posterior = np.full(len(patterns), 0.5)
    for _ in range(rounds):
        log = np.log([1 - share, share])[None, :] + sum(np.log(odds[j][:, index[:, j]]).T for j in range(labelers))
        posterior = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        share = (weight[1].sum() + 1) / (counts.sum() + 2)
        for j in range(labelers):
            seen = np.stack([[weight[c][index[:, j] == v].sum() for v in range(3)] for c in range(2)]) + prior[j]
            odds[j] = seen / seen.sum(1, keepdims=True)
    return share, odds, posterior


def train(bits: np.ndarray, target: np.ndarray, counts: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic regression (bias last) on soft targets, by Newton's method."""
    x = np.hstack([bits, np.ones((len(bits), 1))]).astype(float)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (counts * (p - target)) + ridge * w
        h = (x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


def _bits(codes: np.ndarray) -> np.ndarray:
    return (codes[:, None] >> np.arange(N_FEATURES)) & 1


def fit(table: list[tuple[int, int, int]]) -> np.ndarray:
    """The probability of each feature code, from rows of votes, features and how often they occur together; without rows 0 throughout."""
    if not table:
        return np.zeros(1 << N_FEATURES)
    v, f, n = (np.array(x, np.int64) for x in zip(*sorted(table), strict=True))
    patterns = (v[:, None] // 3 ** np.arange(len(LABELERS))) % 3 - 1
    _, _, posterior = estimate(patterns, n.astype(float))
    w = train(_bits(f), posterior, n.astype(float))
    every = np.hstack([_bits(np.arange(1 << N_FEATURES)), np.ones((1 << N_FEATURES, 1))])
    return 1 / (1 + np.exp(-np.clip(every @ w, -30, 30)))


def find_pii(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """One row per input row: doc_id, and spans, an array of (kind, start, end, base) by kind and then by start, in code points
    with the end exclusive; base marks those of the fixed patterns.

    Null counts as empty; rows that repeat are each searched, and texts of any length are searched whole. A span whose probability is
    just `accept` is taken. An empty table gives no rows; other columns are ignored, whatever their names.
    """

    def fn(texts: list[str]) -> dict[str, list]:
        found = [candidates(t, base_spans(t)) for t in texts]
        return {"found": [[dict(zip(("kind", "start", "end", "votes", "code"), c, strict=True)) for c in cs] for cs in found]}

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = cut(map_texts(rows, fn, "found array<struct<kind: int, start: long, end: long, votes: int, code: int>>", keep=ddl(rows, "doc_id")))
    table = found.select(F.explode("found").alias("c")).groupBy("c.votes", "c.code").count().collect()  # 3 ** 5 * 2 ** 13 rows at most, whatever the corpus; kinds exclude each other, so far fewer
    scores = fit([tuple(r) for r in table])
    accepted = sorted({r["code"] for r in table if scores[r["code"]] >= accept})
    n = len(BASE)
    taken = F.filter("found", lambda c: (c["kind"] < n) | c["code"].isin(accepted))
    names = F.array(*map(F.lit, KINDS))
    return found.select("doc_id", F.transform(taken, lambda c: F.struct(F.get(names, c["kind"]).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), (c["kind"] < n).alias("base"))).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read(spark, sf_dir, "documents"))
    part = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(n, BASE),
        F.sha2(F.array_join(F.transform(F.filter("spans", lambda s: s["base"]), part), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", part), ",").alias("spans"),
    )
