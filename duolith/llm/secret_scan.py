"""Secret scans: fixed patterns, and windows of high entropy in long candidate strings.

Beside the patterns, each run of 20 or more characters that keys are made of
is a candidate of the narrowest class that holds it (hex digits, lower-case or
upper-case letters and digits, letters and digits, base64). Where it has
more than letters of one case and digits, its long runs of those are
candidates, too. A window slides over each; the counts of its characters, and
from them the sum of n log n, change by one character in and one out, so the
entropy of each window costs the same however wide it is. Windows at or above
the class's limit make a span, unless the allow-list knows the string. What the
patterns found is taken out of the spans.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from math import log2

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import aside, ddl, map_texts, read

KINDS = ("assign", "access", "hex", "entropy")

# Fixed values of the contract.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

#: A sign of equality may stand before a candidate, and pads it at its end.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,6}")
#: Runs in a candidate that are candidates themselves.
RUN = re.compile(r"[0-9a-z]{20,}|[0-9A-Z]{20,}")
WINDOW = 20


@dataclass(frozen=True)
class CharClass:
    """A class of candidate strings, the entropy in bits that a window must reach, the kinds of characters that it must have, and what is no key of it."""

    name: str
    fits: re.Pattern
    bits: float
    needs: tuple[re.Pattern, ...] = ()
    words: re.Pattern | None = None


_DIGIT, _UPPER, _LOWER = re.compile("[0-9]"), re.compile("[A-Z]"), re.compile("[a-z]")
#: Words and numbers, and words with a short number at the end.
_WORDS = re.compile(r"[+/_=-]*+(?:(?:[A-Za-z]++[0-9]{0,4}+|[0-9]++)(?:[+/_=-]++|\Z))*+")
CLASSES = (
    CharClass("hex", re.compile(r"[0-9a-fA-F]+={0,2}"), 3.0, (_DIGIT, re.compile("[a-fA-F]"))),
    CharClass("lower", re.compile(r"[0-9a-z]+={0,2}"), 3.4, (_DIGIT, _LOWER), _WORDS),
    CharClass("upper", re.compile(r"[0-9A-Z]+={0,6}"), 3.2, (_DIGIT, _UPPER), _WORDS),
    CharClass("alnum", re.compile(r"[0-9A-Za-z]+={0,2}"), 3.6, (_DIGIT, _UPPER, _LOWER)),
    CharClass("base64", re.compile(r"[A-Za-z0-9+/_=-]*[A-Z][A-Za-z0-9+/_=-]*"), 3.8, (_DIGIT, _UPPER, _LOWER)),
    CharClass("parts", re.compile(r"[A-Za-z0-9+/_=-]+"), 4.0, (_DIGIT, re.compile("[A-Za-z]")), _WORDS),
)


@dataclass(frozen=True)
class AllowList:
    """Strings that are no secrets although they look random."""

    exact: frozenset[str] = frozenset()
    patterns: tuple[re.Pattern, ...] = field(
        default=(
            re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),  # UUID
            re.compile(r"(.)\1*|(?i:0123456789abcdef)+[0-9]*|(?i:abcdefghijklmnopqrstuvwxyz)[0-9]*"),  # one character, alphabets
            re.compile(r"[0-9_/+=-]+"),  # numbers and dates
            re.compile(r"[A-Za-z]+([_/+-][A-Za-z]+|[_/+-][0-9]{1,4})*"),  # words, paths and slugs
        )
    )

    def __contains__(self, text: str) -> bool:
        return text in self.exact or any(p.fullmatch(text) for p in self.patterns)


def windows(text: str, bits: float, width: int = WINDOW) -> list[tuple[int, int]]:
    """The parts of text that windows with at least so many bits of entropy cover. A window's entropy is log2(w) - sum(n log2 n) / w."""
    width = min(width, len(text))
    most = width * (log2(width) - bits) + 1e-9  # of the sum
    term = [0.0, *(n * log2(n) for n in range(1, width + 2))]  # a character comes in before one goes out
    counts: dict[str, int] = {}
    total, found = 0.0, []
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += term[n + 1] - term[n]
        if i >= width:
            old = text[i - width]
            n = counts[old]
            counts[old] = n - 1
            total += term[n - 1] - term[n]
        if i >= width - 1 and total <= most:
            start = i - width + 1
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((start, i + 1))
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return spans + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def class_of(string: str) -> CharClass | None:
    """The narrowest class with the kinds of characters that the string has, unless the string is no key of it."""
    kind = next((k for k in CLASSES if k.fits.fullmatch(string) and all(p.search(string) for p in k.needs)), None)
    return None if kind is None or kind.words and kind.words.fullmatch(string) else kind


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def entropy_spans(text: str, known: list[tuple[int, int, str]], allow: AllowList) -> list[tuple[int, int, str]]:
    """Spans of high entropy, without what the known ones cover."""
    found = []
    for m in CANDIDATE.finditer(text):
        if m[0] in allow:
            continue
        strings = [(m.start(), m[0])] + [(m.start() + x.start(), x[0]) for x in RUN.finditer(m[0]) if x[0] != m[0] and x[0] not in allow]
        for start, string in strings:
            if kind := class_of(string):
                found += [(a + start, b + start) for a, b in windows(string, kind.bits)]
    out, covered = [], merged([(a, b) for a, b, _ in known])
    for a, b in merged(found):
        for x, y in covered[max(0, bisect_right(covered, (a, a)) - 1) :]:
            if x >= b:
                break
            if a < x:
                out.append((a, x, "entropy"))
            a = max(a, y)
        if a < b:
            out.append((a, b, "entropy"))
    return out


def scan(text: str, allow: AllowList) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and all spans, each by start and then by kind."""
    order = lambda s: (s[0], KINDS.index(s[2]))
    base = sorted(base_spans(text), key=order)
    return base, sorted(base + entropy_spans(text, base, allow), key=order)


def scan_secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", allow: AllowList = AllowList()) -> DataFrame:
    """One row per input row: doc_id, and secrets, an array of (kind, start, end, text) with code points and the end exclusive.

    base is true for spans of the fixed patterns. Null counts as empty; an empty table gives no rows; other columns are ignored.
    """

    def fn(texts: list[str]) -> dict[str, list]:
        out = []
        for t in texts:
            base, spans = scan(t, allow)
            fixed = set(base)
            out.append([{"kind": k, "start": a, "end": b, "text": t[a:b], "base": (a, b, k) in fixed} for a, b, k in spans])
        return {"secrets": out}

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_texts(rows, fn, "secrets array<struct<kind: string, start: long, end: long, text: string, base: boolean>>", keep=ddl(rows, "doc_id"))


def redact(docs: DataFrame, *, text: str = "text", mark: str = "[SECRET]", allow: AllowList = AllowList()) -> DataFrame:
    """docs with each secret in the text replaced by the mark; overlapping secrets by one. A null text becomes empty."""

    def fn(texts: list[str]) -> dict[str, list]:
        out = []
        for t in texts:
            parts, at = [], 0
            for a, b, _ in scan(t, allow)[1]:
                if a >= at:
                    parts += [t[at:a], mark]
                at = max(at, b)
            out.append("".join(parts) + t[at:] if parts else t)
        return {"redacted": out}

    full, names = aside(docs)
    made = map_texts(full, fn, "redacted string", text=names[text], keep=ddl(full, *names.values()))
    return made.select(*(F.col("redacted" if c == text else names[c]).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read(spark, sf_dir, "documents"))
    part = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    n = lambda kind: F.size(F.filter("secrets", lambda s: (s["kind"] == kind) & s["base"])).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(n, KINDS[:3]),
        F.sha2(F.array_join(F.transform(F.filter("secrets", lambda s: s["base"]), part), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("secrets", part), ",").alias("spans"),
    )
