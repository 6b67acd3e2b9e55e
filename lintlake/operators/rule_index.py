"""Large rule sets from a table: a literal index instead of one expression per rule.

Every expression has literals that a matching text must contain.  Eight bytes of
one of them are the rule's key, or four where none is that long; pieces that cover
all of its literals are its needs.  A pass over a text finds which of them it
holds; an equi-join of the needs that are held whole with the index gives the
candidate rules, and only their expressions are tried.  The plan does not grow with the rules, which stay a
table.
"""

from __future__ import annotations

import re
import sys
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions import text
from lintlake.functions.severity import AGENTS, SEVERITIES

# Workers get these functions by value, so they need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes of a key, in the order of preference.
GRAMS = (8, 4)
# Pieces of a rule's literals that are looked for.
MOST_NEEDS = 16
# The key that every text holds; rules without a usable literal carry it.
ANY_TEXT = -1
# Letters that a case-blind expression takes for an ASCII letter besides its own two cases.
_FOLDED = str.maketrans({"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"})


def folded(content: str) -> bytes:
    """Text in the form in which literals are looked for."""
    return content.translate(_FOLDED).lower().encode("utf-8", "replace")


def _runs(parsed, out: list[str]) -> str:
    """Literal runs that every match contains, in ``out``; returns the run that is still open at the end."""
    from re import _constants as op

    run = ""
    for kind, value in parsed:
        if kind is op.LITERAL:
            run += chr(value)
            continue
        out.append(run)
        run = ""
        if kind is op.SUBPATTERN and not (value[1] or value[2]):
            out.append(_runs(value[3], out))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] >= 1:
            out.append(_runs(value[2], out))
        elif kind is op.ATOMIC_GROUP:
            out.append(_runs(value, out))
    return run


def required_literals(pattern: str) -> list[str]:
    """Texts that stand in every match of the expression; none if that can't be told."""
    from re import _parser

    # These switch letter case, or blanks and comments, or quoting, in ways that are not followed here.
    if re.search(r"\\[QEGN]|&&|\(\?[a-zA-Z]*[xuUdL]", pattern):
        return []
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            parsed = _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError, ValueError):
        return []
    out: list[str] = []
    out.append(_runs(parsed, out))
    return [run for run in out if run]


def _ascii_literals(pattern: str) -> list[bytes]:
    return [folded(part) for literal in required_literals(pattern) for part in re.findall(r"[\x01-\x7f]+", literal)]


def literal_key(pattern: str) -> int:
    """The bytes by which a rule is found: those least like prose in its ASCII literals; else ``ANY_TEXT``."""
    literals = _ascii_literals(pattern)
    plain = b"etaoinsrhld cumfpgwybvkxjqz"
    weight = {byte: at for at, byte in enumerate(plain)}
    for size in GRAMS:
        grams = [raw[i:i + size] for raw in literals for i in range(len(raw) - size + 1)]
        if grams:
            return int.from_bytes(max(grams, key=lambda g: (sum(weight.get(b, len(plain)) for b in g), g)), "little")
    return ANY_TEXT


def literal_needs(pattern: str) -> list[int]:
    """The rule's key, then further pieces of its literals, so many that they cover them; all stand in every match."""
    needs = [literal_key(pattern)]
    if needs == [ANY_TEXT]:
        return []
    for raw in _ascii_literals(pattern):
        size = next((g for g in GRAMS if len(raw) >= g), None)
        if size:
            needs += [int.from_bytes(raw[i:i + size], "little") for i in [*range(0, len(raw) - size, size), len(raw) - size]]
    return list(dict.fromkeys(needs))[:MOST_NEEDS]


def indexed_rules(table: DataFrame) -> DataFrame:
    """The rule table with its keys: ``key, needs, regex`` and the labels of a finding.

    Missing optional fields take their defaults; a rule with an unknown reviewer
    or severity, or without an id or expression, is an error when it is read.
    """
    names = table.columns

    def field(name: str, default: str | None) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in names else F.lit(default)

    def position(name: str, values: list[str]) -> Column:
        place = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(name))
        wrong = F.raise_error(F.concat(F.lit("rule "), F.coalesce("rule_id", F.lit("without id")), F.lit(f": unknown {name}")))
        return F.when(place > 0, place - 1).otherwise(wrong.cast("long")).cast("int")

    @F.arrow_udf("long")
    def key_of(patterns: pa.Array) -> pa.Array:
        return pa.array([ANY_TEXT if p is None else literal_key(p) for p in patterns.to_pylist()], pa.int64())

    @F.arrow_udf("array<long>")
    def needs_of(patterns: pa.Array) -> pa.Array:
        return pa.array([[] if p is None else [_signed(n) for n in literal_needs(p)] for p in patterns.to_pylist()], pa.list_(pa.int64()))

    flags = field("flags", "")
    return table.select(
        "rule_id", "agent", position("agent", AGENTS).alias("agent_rank"), "category", "severity",
        position("severity", SEVERITIES).alias("sev_rank"), field("confidence", "MEDIUM").alias("confidence"),
        field("advice", "").alias("recommendation"), field("ref_primary", None).cast("string").alias("ref_primary"),
        field("ref_secondary", None).cast("string").alias("ref_secondary"),
        F.concat(F.lit("(?dU"), flags, F.lit(")"), F.col("pattern")).alias("regex"), key_of(F.col("pattern")).alias("key"),
        needs_of(F.col("pattern")).alias("needs"))


def _signed(number: int) -> int:
    return number - (1 << 64) if number >= 1 << 63 else number


def held_keys(content: str, wanted: np.ndarray) -> list[int]:
    """Which of the wanted keys, sorted, a text holds."""
    raw = np.frombuffer(folded(content), dtype=np.uint8).astype(np.uint64)
    held = [ANY_TEXT]
    grams, width = raw, 1
    while len(wanted) and len(grams) > width:
        # Neighbouring grams of one width make those of twice the width.
        grams = grams[:-width] | grams[width:] << np.uint64(8 * width)
        width *= 2
        if width in GRAMS:
            found = np.unique(grams)
            at = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
            held += found[wanted[at] == found].tolist()
        if width == max(GRAMS):
            break
    return held


class Needs:
    """Lists of keys, each list with a number, by the first key of each."""

    def __init__(self, lists: list[tuple[int, list[int]]]):
        first = sorted((x for x in lists if x[1]), key=lambda x: x[1][0] & (1 << 64) - 1)
        self.always = [number for number, keys in lists if not keys]
        self.numbers = np.array([number for number, _ in first], np.int64)
        self.wanted, at = np.unique(np.array([k for _, keys in first for k in keys], np.int64).astype(np.uint64), return_inverse=True)
        self.at = at.ravel()
        self.start = np.append(0, np.cumsum([len(keys) for _, keys in first])).astype(np.int64)
        leads = self.at[self.start[:-1]]
        # Where the lists that begin with a key stand.
        self.span = np.searchsorted(leads, np.arange(len(self.wanted) + 1))

    def held(self, content: str) -> list[int]:
        """The numbers of the lists of which a text holds all keys."""
        has = np.zeros(len(self.wanted), bool)
        keys = np.array(held_keys(content, self.wanted)[1:], np.uint64)
        places = np.searchsorted(self.wanted, keys)
        has[places] = True
        places = np.unique(places)
        lists = _ranges(self.span[places], self.span[places + 1])
        if len(lists):
            sizes = self.start[lists + 1] - self.start[lists]
            each = has[self.at[_ranges(self.start[lists], self.start[lists + 1])]]
            lists = lists[np.logical_and.reduceat(each, np.cumsum(sizes) - sizes)]
        return list(dict.fromkeys([*self.always, *self.numbers[lists].tolist()]))


def _ranges(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The whole numbers from each ``first`` to before its ``end``, one after the other."""
    sizes = end - first
    return np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


def candidates(corpus: DataFrame, index: DataFrame) -> DataFrame:
    """``repo, path, content`` and a rule of the index, for every rule whose needs the text holds.

    The distinct lists of needs, at most ``MOST_NEEDS`` longs for each rule, travel to the tasks.
    """
    numbered = index.withColumn("list", F.xxhash64("needs"))
    lists = [(r["list"], r["needs"]) for r in numbered.select("list", "needs").distinct().collect()]
    shared = corpus.sparkSession.sparkContext.broadcast(Needs(lists))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, content in enumerate(batch.column(2)):
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(i, 1) for c in batch.columns), pa.array([shared.value.held(content.as_py() or "")], pa.list_(pa.int64()))],
                    names=["repo", "path", "content", "lists"])

    files = corpus.select("repo", "path", "content")
    found = files.mapInArrow(held, "repo string, path string, content string, lists array<long>")
    return found.select("repo", "path", "content", F.explode("lists").alias("list")).join(numbered, "list").drop("list", "key", "needs")


def indexed_findings(corpus: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings of a rule table of any size: ``regex_findings`` without one expression per rule.

    ``rules`` has ``rule_id, agent, category, severity, pattern`` and optionally
    ``flags, confidence, advice, ref_primary, ref_secondary``.
    """
    found = candidates(corpus, indexed_rules(rules)).where(F.rlike("content", F.col("regex")))
    entries = F.arrays_zip(
        F.regexp_extract_all(F.col("content"), F.col("regex"), F.lit(0)).alias("match"),
        text.match_start_lines(F.col("content"), F.col("regex")).alias("line"))
    labels = ["rule_id", "agent", "agent_rank", "category", "severity", "sev_rank", "confidence", "recommendation",
              "ref_primary", "ref_secondary"]
    return found.select("repo", "path", *labels, F.posexplode(entries).alias("match_ordinal", "_m")).select(
        "repo", "path", *labels, "match_ordinal", F.col("_m.line").alias("line_number"),
        text.clip(text.evidence(F.col("_m.match")), text.FINDING_EVIDENCE_CAP).alias("evidence"))
