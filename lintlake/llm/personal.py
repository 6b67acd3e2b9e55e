"""Personal data: exact patterns, and proposals judged by boosted trees.

Patterns with checks give the base spans.  High-recall generators propose
further spans, which may overlap: anything like an address, a number or a
credential.  Boosted trees judge each from its format and its surroundings.
They learn from cases of known truth, planted between the corpus' own words
(dates, ranges, decimals, book numbers, versions and hashes are the negatives),
and from the corpus' proposals: those that a strict check or a weak rule of words
before them confirms are positive, those of the same form without such words
are left out, and the rest are not.  No rule that labels is a feature.  Each
kind has a threshold, calibrated for a stated precision on documents kept apart.
A proposal is at most 64 characters on each side of an @ and in each part of a
host, 43 digits or so, or 256 characters of a credential; a longer run is
proposed in parts.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.boosting import Trees, sigmoid
from lintlake.llm.common import documents, drawn, map_rows
from lintlake.llm.personal_cases import planted

# The base patterns, in the order in which kinds are listed.
# An address is found from its @, and an ip starts where no digit is before, so that long runs are read once.
LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]+")
HOST_PART = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone", "contact", "number", "secret")

# Generators of proposals.
CONTACT = re.compile(r"[A-Za-z0-9._%+-]{2,64} ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{2,64}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{2,64}){0,4}")
NUMBER = re.compile(r"[+(]{0,2}[0-9](?:[ ().:/-]{0,2}[0-9]){6,40}")
SECRET = re.compile(r"[A-Za-z0-9+/_=-]{16,256}")
# A credential by strict check: a named value in quotes.
NAMED = re.compile(r"(?:token|secret|password|passwd|key|auth)\w{0,16} {0,2}[:=] {0,2}[\"']$", re.IGNORECASE)
# Weak rules: the form of an address, and what stands before a contact, a number and a value without quotes.
OBFUSCATED = re.compile(r"(?:\(at\)|\[at\]).*(?:\.|\(dot\)|\[dot\])")
REACH = re.compile(r"(?:mail|contact|write|reach)\w{0,4}\W{1,3}(?:\w{1,8}\W{1,2}){0,3}$", re.IGNORECASE)
CALL = re.compile(r"(?:tel|phone|call|fax|mobile|card|visa|account|iban)\w{0,6}\W{0,3}(?:[A-Za-z]{1,8}\W{1,2}){0,3}$", re.IGNORECASE)
UNQUOTED = re.compile(r"(?:token|secret|password|passwd|key|auth)\w{0,16} {0,2}[:=] {0,2}$", re.IGNORECASE)
_OWN_NAME = re.compile(r"\w{0,16}(?:token|secret|password|passwd|key|auth)\w{0,16}=[^=]", re.IGNORECASE)
# Words of the surroundings, by what they speak for.
_CONTEXT = tuple(re.compile(words, re.IGNORECASE) for words in (
    r"mail|contact|write|reach", r"\btel|phone|call|fax|mobile|card|visa|account|iban|ssn|passport",
    r"token|secret|passw|key|auth", r"commit|\bsha|md5|hash|\brev|isbn|version|release|\bno\b|item|date|\bon\b|since|between"))

# The trees are fitted on the proposals of about so many documents, at most twice as many, drawn by the hash of their id.
FIT_DOCUMENTS = 5_000
# Planted cases for each of them.
CASES = 4
PRECISION = 0.95
AROUND = 32


class Span(NamedTuple):
    start: int
    end: int
    kind: str


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    """Addresses, leftmost and non-overlapping; every character is read a bounded number of times."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        local = LOCAL_PART.match(text[free:at][::-1])
        host = HOST_PART.match(text, at + 1) if local else None
        if host:
            found.append(Span(at - local.end(), host.end(), "email"))
        free = host.end() if host else at + 1
        at = text.find("@", free)
    return found


class Cover:
    """Disjoint intervals in order."""

    def __init__(self, spans: list[Span] = ()):
        self.starts, self.ends = [], []
        for s in sorted(spans):
            if self.ends and s.start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], s.end)
            else:
                self.starts.append(s.start)
                self.ends.append(s.end)

    def meets(self, span: Span) -> bool:
        at = bisect.bisect_right(self.ends, span.start)
        return at < len(self.starts) and self.starts[at] < span.end

    def add(self, span: Span) -> None:
        """``span`` meets nothing yet."""
        at = bisect.bisect_left(self.starts, span.start)
        self.starts.insert(at, span.start)
        self.ends.insert(at, span.end)


def base_spans(text: str) -> list[Span]:
    """Confirmed matches of the four patterns, each kind by itself."""
    found = emails(text)
    if "." in text:
        for m in IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                found.append(Span(*m.span(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _digits(m.group())
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append(Span(*m.span(), "card"))
    if "+" in text:
        found += [Span(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def proposals(text: str) -> list[Span]:
    """Spans that may be personal data; they may overlap."""
    found = []
    if "@" in text or "(at)" in text or "[at]" in text:
        found += [Span(*m.span(), "contact") for m in CONTACT.finditer(text)]
    found += [Span(*m.span(), "number") for m in NUMBER.finditer(text)]
    for m in SECRET.finditer(text):
        word = m.group()
        if any(c.isdigit() for c in word) and any(c.isalpha() for c in word):
            found.append(Span(*m.span(), "secret"))
    return found


def describe(text: str, span: Span) -> tuple[float, ...]:
    """Format and surroundings of a proposal."""
    body = text[span.start:span.end]
    before, after = text[max(0, span.start - AROUND):span.start], text[span.end:span.end + 2]
    size = len(body)
    digits, letters = sum(c.isdigit() for c in body), sum(c.isalpha() for c in body)
    groups = [len(g) for g in re.findall("[0-9]+", body)]
    number = _digits(body)
    runs = [len(g) for g in re.findall("[A-Za-z]+", body)]
    year = [1000 <= int(g) <= 2099 for g in re.findall("[0-9]+", body) if len(g) == 4]
    return (
        float(KINDS.index(span.kind)), size, digits, letters, digits / size, letters / size, len(set(body)) / size,
        sum(c.isupper() for c in body), body.count("."), body.count(" "), body.count("-"), body.count("("),
        float(body[0] == "+"), body.count("@"), len(groups), max(groups, default=0), min(groups, default=0),
        sum(c in "0123456789abcdef" for c in body) / size, float("=" in before or ":" in before),
        float(before[-1:] in ("'", '"')), float(after[:1] in ("'", '"')), float(before[-1:].isalnum()),
        float(after[:1].isalnum()), float(before[-1:] == " "), float(12 <= len(number) <= 19 and _luhn(number)), len(number),
        body.count(":"), body.count("/"), body.count("_"), groups[0] if groups else 0, groups[-1] if groups else 0,
        sum(year), max(runs, default=0), float(body[0] == "0"), body.count("0") / size, float(number.startswith(("978", "979"))),
        *(float(len(words.findall(before[-24:]))) for words in _CONTEXT))


def confirmed(text: str, span: Span, base: Cover) -> bool | None:
    """Whether a strict check or a weak rule stands behind a proposal; None if it has the form only."""
    if base.meets(span):
        return True
    body, before = text[span.start:span.end], text[max(0, span.start - AROUND):span.start]
    if span.kind == "contact" and OBFUSCATED.search(body):
        return True if REACH.search(before) else None
    if span.kind == "number":
        digits = len(_digits(body))
        if digits <= 19 and CALL.search(before):
            return True
        grouped = len(re.findall("[0-9]+", body)) >= 3 and 9 <= digits <= 19
        return None if grouped or 12 <= digits <= 19 or body[0] in "+(" else False
    if span.kind == "secret":
        if UNQUOTED.search(before) or _OWN_NAME.match(body):
            return True
        if NAMED.search(before):
            return True if len(body) >= 20 else None
    return False


class Judge:
    """Trees and their calibration; without anything to learn from it accepts nothing."""

    def __init__(self):
        self.trees = None

    def fit(self, features: np.ndarray, labels: np.ndarray, apart: np.ndarray, precision: float = PRECISION) -> Judge:
        learn = ~apart
        if len(np.unique(labels[learn])) < 2 or len(np.unique(labels[apart])) < 2:
            return self
        self.trees = Trees().fit(features[learn], labels[learn])
        margin = self.trees.margin(features[apart])
        truth = labels[apart]
        # Platt's scaling by a few Newton steps on slope and offset.
        a, b = 1.0, 0.0
        for _ in range(20):
            p = sigmoid(a * margin + b)
            w = np.maximum(p * (1 - p), 1e-6)
            x = np.stack([margin, np.ones_like(margin)], axis=1)
            step = np.linalg.solve((x * w[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (truth - p) - 1e-3 * np.array([a - 1, b]))
            a, b = a + step[0], b + step[1]
        self.slope, self.offset = a, b
        p = sigmoid(a * margin + b)
        kinds = features[apart][:, 0].astype(int)
        self.thresholds = np.full(len(KINDS), 1.1)
        for kind in np.unique(kinds):
            order = np.argsort(-p[kinds == kind], kind="stable")
            right = np.cumsum(truth[kinds == kind][order]) / np.arange(1, len(order) + 1)
            good = np.flatnonzero(right >= precision)
            if len(good):
                self.thresholds[kind] = max(0.5, float(p[kinds == kind][order][good[-1]]))
        return self

    def accepts(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = sigmoid(self.slope * self.trees.margin(features) + self.offset)
        return p >= self.thresholds[features[:, 0].astype(int)], p


def labelled(text: str, seed: int, cases: int = CASES) -> list[tuple[tuple[float, ...], bool]]:
    """Features and truth of planted cases, and of the text's own proposals that rules decide."""
    cover = Cover(base_spans(text))
    known = [(describe(text, s), y) for s in proposals(text) if (y := confirmed(text, s, cover)) is not None]
    for around, start, end, kind, personal in planted(text, seed, AROUND, cases):
        cover = Cover(base_spans(around))
        for s in proposals(around):
            inside = min(end, s.end) - max(start, s.start)
            # A positive is a proposal of its kind for the whole value; what the base finds by itself is no case.
            if inside > 0 and not cover.meets(s) and (not personal or s.kind == kind and s.start <= start and s.end >= end):
                known.append((describe(around, s), personal))
    return known


def fit_judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_documents: int = FIT_DOCUMENTS) -> Judge:
    """Judge of proposals, learnt from about ``fit_documents`` documents, at most twice as many."""
    chosen = drawn(docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t")), "id", fit_documents)
    chosen = chosen.where(F.col("t").isNotNull()).select("id", "t", F.xxhash64("id", "t").alias("h"))

    def row(_, key, text, h):
        known = labelled(text, h)
        return h, [list(x) for x, _ in known], [float(y) for _, y in known]

    found = map_rows(chosen, row, "h long, x array<array<double>>, y array<double>").collect()
    found.sort(key=lambda r: r.h)
    features = np.array([x for r in found for x in r.x], np.float64)
    labels = np.array([y for r in found for y in r.y], np.float64)
    apart = np.array([r.h % 3 == 0 for r in found for _ in r.y], bool)
    return Judge().fit(features, labels, apart) if len(labels) else Judge()


def all_spans(text: str | None, judge: Judge) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans); accepted proposals overlap nothing else."""
    text = text or ""
    base = base_spans(text)
    if judge.trees is None:
        return base, base
    taken, cover = list(base), Cover(base)
    spans = [s for s in proposals(text) if not cover.meets(s)]
    if spans:
        good, p = judge.accepts(np.array([describe(text, s) for s in spans], np.float64))
        for _, s in sorted(((-q, s) for s, g, q in zip(spans, good, p) if g)):
            if not cover.meets(s):
                cover.add(s)
                taken.append(s)
    return base, sorted(taken, key=lambda s: (s.start, KINDS.index(s.kind)))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span replaced by its kind; overlapping spans become one."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at:s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame, judge: Judge, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of every text and the redacted text; positions are code points, ends exclusive.

    One narrow pass.  A null or empty text has no spans and stays as it is;
    repeated rows and null ids are kept; an empty table gives an empty result.
    Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def row(_, key, text):
        base, spans = all_spans(text, judge)
        counts = [sum(s.kind == k for s in base) for k in KINDS[:4]]
        return (key, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), redacted(text, spans))

    return map_rows(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), row,
        f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string",
    ).withColumnRenamed("id", id_col)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return personal_data(docs, fit_judge(docs)).drop("redacted")
