"""License notices, exact and with errors.

Texts become runs of lower-case words.  The base finds phrases whose words stand
consecutively.  The fuzzy search takes short notices and an error bound each.  A
notice with at most k errors, cut into k + 1 pieces, keeps one piece unchanged;
so exact searches of the pieces find every candidate, and the regex library
verifies the text around each with bounded errors.
"""

from __future__ import annotations

import bisect
import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.common import documents, map_rows

# Phrases and labels of the base.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Short notices of the fuzzy search: words, label, most errors.
NOTICES = (
    ("gnu general public license", "gpl", 3),
    ("gnu lesser general public license", "lgpl", 2),
    ("gnu affero general public license", "agpl", 2),
    ("licensed under the apache license version 2 0", "apache", 4),
    ("apache license version 2 0", "apache", 2),
    ("licensed under cc by", "cc-by", 2),
    ("creative commons attribution", "cc-by", 3),
    ("released under the mit license", "mit", 3),
    ("permission is hereby granted free of charge to any person", "mit", 5),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("mozilla public license", "mpl", 2),
    ("eclipse public license", "epl", 2),
    ("all rights reserved", "reserved", 2),
)
# Every byte that is no word byte after lower-casing becomes a space.
_TO_SPACES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normalised(text: str | None) -> tuple[str, int]:
    """Words joined by single spaces, with a space at both ends, and their number."""
    words = (text or "").encode().translate(_TO_SPACES).split(b" ")
    words = [w for w in words if w]
    return (b" " + b" ".join(words) + b" ").decode(), len(words)


def places(joined: str, words: str) -> list[int]:
    """Offsets of the spaces before ``words`` where these stand as whole words."""
    return _occurrences(joined, f" {words} ")


def _occurrences(joined: str, part: str) -> list[int]:
    found, at = [], joined.find(part)
    while at >= 0:
        found.append(at)
        at = joined.find(part, at + 1)
    return found


def pieces(words: str, errors: int) -> list[tuple[int, str]]:
    """The notice cut into ``errors + 1`` parts of nearly equal length, with their offsets."""
    cuts = [len(words) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:])]


def verifiers(notices=NOTICES) -> list:
    """Each notice with its pieces and its bounded-error pattern."""
    import regex

    return [
        (words, label, errors, pieces(words, errors), regex.compile(f"(?be)(?:{regex.escape(words)}){{e<={errors}}}"))
        for words, label, errors in notices]


def windows(joined: str, size: int, errors: int, parts: list[tuple[int, str]]) -> list[tuple[int, int]]:
    """Bounded windows that hold every match in which one of ``parts`` is unchanged.

    A match starts at most ``errors`` characters before or after the place that
    its unchanged part tells.  Windows that start within twice the errors of the
    first of them are one, so that no window is longer than the notice and five
    times the errors.
    """
    starts = sorted({at - offset - errors for offset, piece in parts for at in _occurrences(joined, piece)})
    out: list[tuple[int, int]] = []
    first = None
    for start in starts:
        end = min(len(joined), start + size + 3 * errors)
        if first is not None and start <= first + 2 * errors:
            out[-1] = (out[-1][0], end)
        else:
            first = start
            out.append((max(0, start), end))
    return out


def hits(pattern, joined: str, found: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """``(start, end, errors)`` of matches that do not overlap, the best first, then the leftmost.

    What a taken match leaves of a window is searched again.  Windows are bounded,
    so the time is in proportion to their number but for a logarithm.
    """
    queue: list[tuple[int, int, int, int, int]] = []

    def search(low: int, high: int) -> None:
        hit = pattern.search(joined, low, high) if low < high else None
        if hit and hit.end() > hit.start():
            heapq.heappush(queue, (sum(hit.fuzzy_counts), hit.start(), hit.end(), low, high))

    for low, high in found:
        search(low, high)
    taken: list[tuple[int, int, int]] = []
    while queue:
        errors, start, end, low, high = heapq.heappop(queue)
        at = bisect.bisect_left(taken, (start,))
        if at and taken[at - 1][1] > start:
            at -= 1
        if at < len(taken) and taken[at][0] < end:
            start, end = taken[at][:2]
        else:
            taken.insert(at, (start, end, errors))
        search(low, min(high, start))
        search(max(low, end), high)
    return taken


def fuzzy_spans(joined: str, compiled: list, spaces: Spaces) -> list[tuple[str, int, int, int]]:
    """``(label, first word, word after the last, errors)`` of every verified notice."""
    spans = set()
    for plain, label, errors, parts, pattern in compiled:
        for start, end, wrong in hits(pattern, joined, windows(joined, len(plain), errors, parts)):
            spans.add((label, spaces.word_at(start), spaces.word_at(max(start, end - 1)) + 1, wrong))
    return sorted(spans)


class Spaces:
    """Where the spaces of a joined text are, counted when first asked for."""

    def __init__(self, joined: str):
        self.joined, self.at = joined, None

    def before(self, offset: int) -> int:
        """The number of spaces before ``offset``."""
        if self.at is None:
            self.at = np.flatnonzero(np.frombuffer(self.joined.encode("utf-32-le"), np.uint32) == 32)
        return int(np.searchsorted(self.at, offset))

    def word_at(self, offset: int) -> int:
        return max(0, self.before(offset + 1) - 1)


def scan(text: str | None, compiled: list, phrases=PHRASES) -> tuple:
    joined, count = normalised(text)
    spaces = Spaces(joined)
    base = [(spaces.before(at), label) for words, label in phrases.items() for at in places(joined, words)]
    spans = fuzzy_spans(joined, compiled, spaces)
    labels = {label for _, label in base}
    near = {label for label, *_ in spans} | labels
    best = {label: 1.0 for label in labels}
    for label, _, _, errors in spans:
        best[label] = max(best.get(label, 0.0), 1.0 / (1 + errors))
    starts = [at for at, _ in base]
    return (
        count, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)),
        ",".join(sorted(near)), max(best.values(), default=0.0),
        [{"label": a, "first_word": b, "end_word": c, "errors": d} for a, b, c, d in spans])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices=NOTICES) -> DataFrame:
    """Notices of every text: exact places, labels, fuzzy spans and a score.

    ``score`` is 1 for an exact phrase and falls with the errors of the best
    fuzzy hit; 0 without any.  One narrow pass.  A null or empty text has no
    words and empty label lists; repeated rows and null ids are kept; an empty
    table gives an empty result.  Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")),
        lambda compiled, key, text: (key, *scan(text, compiled)),
        f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<label:string,first_word:long,end_word:long,errors:int>>",
        lambda: verifiers(notices),
    ).withColumnRenamed("id", id_col)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))
