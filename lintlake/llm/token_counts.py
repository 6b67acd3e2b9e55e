"""Token counts by a compiled finite-state tokenizer.

Pair merging by piece score is compiled, as texts need it, into a
deterministic transducer.  Its input symbols are characters, and each
transition carries how many tokens it adds.

*State.*  After a prefix, the encoding of that prefix is known by its last
token and the count before it.  A later token can only start where the text
since then is the beginning of some piece.  A state therefore lists, for each
such open start, the text since then, the last token before it, and the count
there relative to the count now.  Pieces have bounded length, so the states are
finitely many.  Two tokens may stand side by side exactly if merging their
joined text gives the two back; that relation is compiled as it is met.

*Reset.*  No piece continues from a letter into a space mark, so the transition
on the first space mark after a word leads to one state from everywhere.  The
map of a chunk that begins there is constant: (exit state, count).  Maps of
words are remembered, and the maps of a text compose by a prefix sum.

*Chunks.*  A text of any length is cut anywhere into chunks.  The map of a
chunk keeps what precedes its first reset, to be run from whichever state
enters, and a constant part after it.  Composition is associative, so the maps
are combined pairwise, level by level, as in a parallel prefix scan.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.common import documents, map_rows, worker_cache

MARK = "▁"
# Bounds of what a worker remembers; beyond them it forgets and compiles anew.
WORDS_KEPT = 300_000
TRANSITIONS_KEPT = 700_000
LONGEST_KEPT_WORD = 48
CHUNK = 1 << 16
TOKEN_LIMIT = 4096

_WORDS = re.compile(f"{MARK}+[^{MARK}]*")


class ChunkMap(NamedTuple):
    """What a chunk does to any entry state: run ``head`` from it; after a reset
    (if the chunk has one) go on with ``count`` more tokens to state ``exit``."""

    head: str
    reset: bool
    count: int
    exit: int


class Transducer:
    """Deterministic transducer of one piece vocabulary with byte fallback."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.beginnings = {p[:n] for p in scores for n in range(1, len(p))}
        self.joined = {c for p in scores if len(p) > 1 for c in p}
        self.forget()

    def forget(self) -> None:
        self.size = 0
        self.beside: dict[tuple[str, str], bool] = {}
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.table: list[dict[str, tuple[int, int]]] = []
        self.start = self._id((("", None, 0),))

    def _id(self, state: tuple) -> int:
        known = self.ids.get(state)
        if known is None:
            known = self.ids[state] = len(self.states)
            self.states.append(state)
            self.table.append({})
        return known

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by repeated best merge, leftmost on ties."""
        parts, score = list(text), self.scores.get
        while True:
            best, at = None, 0
            for i in range(len(parts) - 1):
                value = score(parts[i] + parts[i + 1])
                if value is not None and (best is None or value > best):
                    best, at = value, i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def may_follow(self, last: str | None, piece: str) -> bool:
        key = (last or "", piece)
        known = self.beside.get(key)
        if known is None:
            known = self.beside[key] = self.merged(key[0] + piece) == ([last, piece] if last else [piece])
        return known

    def compiled(self, state: int, char: str) -> tuple[int, int]:
        """Adds the transition of ``state`` on ``char``: (next state, tokens added)."""
        if char not in self.joined:
            # Part of no longer piece: whatever precedes is settled.
            result = (self.start, 1 if char in self.scores else len(char.encode()))
        else:
            last, added, opened = None, 0, []
            for since, before, count in self.states[state]:
                grown = since + char
                if last is None and (grown in self.scores or not since) and self.may_follow(before, grown):
                    last = grown
                    added = count + (1 if grown in self.scores else len(char.encode()))
                if grown in self.beginnings:
                    opened.append((grown, before, count))
            moved = [(s, b, n - added) for s, b, n in opened]
            result = (self._id((*moved, ("", last, 0))), added)
        self.table[state][char] = result
        self.size += 1
        return result

    def run(self, state: int, text: str) -> tuple[int, int]:
        """State and tokens added after reading ``text`` from ``state``."""
        table, total = self.table, 0
        for char in text:
            step = table[state].get(char) or self.compiled(state, char)
            state = step[0]
            total += step[1]
        return state, total

    def chunk_map(self, chunk: str, after_word: bool) -> ChunkMap:
        """``after_word``: whether the chunk follows a character other than the mark."""
        found = re.search(f"(?<=[^{MARK}]){MARK}" if not after_word else f"(?:^|(?<=[^{MARK}])){MARK}", chunk)
        if not found:
            return ChunkMap(chunk, False, 0, self.start)
        state, count = self.start, 0
        words = _WORDS.findall(chunk, found.start())
        for word in words[:-1]:
            count += self.run(self.start, word)[1]
        state, last = self.run(self.start, words[-1])
        return ChunkMap(chunk[:found.start()], True, count + last, state)

    def compose(self, first: ChunkMap, second: ChunkMap) -> ChunkMap:
        if not first.reset:
            return second._replace(head=first.head + second.head)
        state, count = self.run(first.exit, second.head)
        if second.reset:
            return ChunkMap(first.head, True, first.count + count + second.count, second.exit)
        return ChunkMap(first.head, True, first.count + count, state)

    def scanned(self, maps: list[ChunkMap]) -> ChunkMap:
        """All maps composed, neighbours first, level by level."""
        while len(maps) > 1:
            maps = [reduce(self.compose, maps[i:i + 2]) for i in range(0, len(maps), 2)]
        return maps[0]

    def count_long(self, marked: str, chunk: int = CHUNK) -> int:
        """Tokens of a marked text by maps of chunks."""
        maps = [
            self.chunk_map(marked[i:i + chunk], i > 0 and marked[i - 1] != MARK) for i in range(0, len(marked), chunk)]
        whole = self.scanned(maps)
        return self.run(self.start, whole.head)[1] + whole.count


class WordMaps(dict):
    """Counts of the constant maps of words.

    A key is a word without its space mark, or begins with a line end, after
    which no mark stands: a character that no longer piece contains is a reset
    as well.
    """

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, word: str) -> int:
        _, count = self.transducer.run(self.transducer.start, word if word[:1] == "\n" else MARK + word)
        if len(word) <= LONGEST_KEPT_WORD:
            self[word] = count
        return count


class Counter:
    """Token counts of texts; remembers words in bounded memory."""

    def __init__(self, model: str):
        self.transducer = Transducer(vocabulary(model))
        self.words = WordMaps(self.transducer)
        self.joins_lines = "\n" in self.transducer.joined

    def tidy(self) -> None:
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        if self.transducer.size > TRANSITIONS_KEPT:
            self.transducer.forget()

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        self.tidy()
        if len(text) > CHUNK:
            return self.transducer.count_long(MARK + text.replace(" ", MARK))
        if "  " in text or text[0] == " " or text[-1] == " " or MARK in text or " \n" in text or self.joins_lines:
            return sum(map(self.marked_word, _WORDS.findall(MARK + text.replace(" ", MARK))))
        words = text.replace("\n", " \n").split(" ")
        counts = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        return int(np.cumsum(counts)[-1])

    def marked_word(self, word: str) -> int:
        if word[1:2] == "\n":
            return self.transducer.run(self.transducer.start, word)[1]
        return self.words[word[1:]]


def vocabulary(model: str) -> dict[str, float]:
    """Scores of the normal pieces of a sentencepiece model file.

    Only models that change no text and fall back to bytes are supported.
    """
    from sentencepiece import SentencePieceProcessor

    pieces = SentencePieceProcessor(model_file=model)
    if pieces.encode("a  Ⅸ ", out_type=str)[-1] != MARK or not pieces.is_byte(pieces.piece_to_id("<0x0A>")):
        raise ValueError("the model normalises its texts or has no byte fallback")
    ids = range(pieces.get_piece_size())
    scores = {
        pieces.id_to_piece(i): pieces.get_score(i) for i in ids
        if not (pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_byte(i) or pieces.is_unused(i))}
    if any(MARK in p[1:] and p.strip(MARK) for p in scores):
        raise ValueError("a piece goes on from a word into a space mark")
    return scores


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def counter(model: str | None = None) -> Counter:
    """This worker's counter of a model; by default of the public 32k one."""
    return worker_cache(f"counter:{model}", lambda: Counter(model or model_path()))


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = TOKEN_LIMIT, model: str | None = None,
) -> DataFrame:
    """Bytes and tokens of every text, without any added token.

    One narrow pass.  Null and empty texts have no bytes and no tokens; repeated
    rows give repeated rows; a null id stays null; an empty table gives an empty
    result.  Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    counted = map_rows(
        docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"),
                    F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n")),
        lambda c, i, t, n: (i, n, c.count(t)), f"id {kind}, n_bytes long, n_tokens long", lambda: counter(model))
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
