"""Spelling variants: words one edit apart, found by scans over sorted word lists.

Two words one edit apart share the first or the last half of the shorter one,
so words meet in blocks of equal halves.  A block is a sorted list; each word is
held against it by dynamic programming whose band is three cells wide.  Rows of
the edit matrix are kept for as long as neighbours in the list share a prefix,
and a prefix that already costs more than one edit skips all words below it.
"""

from __future__ import annotations

import re
import string
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.common import documents, stored

# What a word is, and when it counts.
LETTERS = "A-Za-zÀ-ÿ"
ERASED_IN = 199
LEAST_CHARS, LEAST_COUNT, FORM_RATIO = 6, 5, 5
# Words that a task counts before it hands them on.
WORDS_HELD = 200_000
# Words of a list; longer blocks are cut into several lists that meet pairwise.
LIST_WORDS = 2048
# Words that a task of the search places in its blocks, roughly.
WORDS_A_TASK = 8192

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_END = "\U0010ffff"


def text_words(name: str, text: str, least_chars: int) -> Iterator[tuple[str, int]]:
    """Lower-cased words of a text with their counts; some lose a letter, as crc32 of id and word decides."""
    runs = Counter(re.findall(f"[{LETTERS}]{{{least_chars},}}", text))
    lowered = Counter()
    for run, n in runs.items():
        lowered[run.lower() if run.isascii() else run.translate(_LOWER)] += n
    for run, n in lowered.items():
        h = zlib.crc32(f"{name}:{run}".encode())
        if h % ERASED_IN == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        if len(run) >= least_chars:
            yield run, n


def vocabulary(docs: DataFrame, id_col: str, text_col: str, least_chars: int, least_count: int) -> DataFrame:
    """``(word, n)`` of all words that are long and frequent enough."""
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()
        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for part in parts:
            for i in range(part.num_rows):
                name, text = (part.column(c)[i].as_py() for c in range(2))
                for word, n in text_words(name, text, least_chars):
                    held[word] += n
                if len(held) >= WORDS_HELD:
                    yield batch()
        yield batch()

    rows = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_col)
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def blocks(words: DataFrame, least_chars: int, list_words: int) -> DataFrame:
    """``(side, m, half, list, met, shown, n, listed, asked)``: words in the blocks where their neighbours are.

    ``m`` is the length of the shorter word of a pair.  On side 0 words with the
    same first ``m // 2`` characters meet, on side 1, where words are reversed,
    those with the same last ``m - m // 2``.  A block of more than
    ``list_words`` words is cut into lists; list ``list`` meets the words of
    list ``met``.
    """
    size = F.length("word")
    shorter = F.filter(F.array(size, size - 1), lambda m: m >= least_chars)
    half = F.floor(F.col("m") / 2).cast("int")

    def one(side: int, shown: str, length: Column) -> Column:
        return F.struct(F.lit(side).alias("side"), F.col(shown).alias("shown"), length.alias("h"))

    placed = (
        words.select("word", "n", F.explode(shorter).alias("m"), F.reverse("word").alias("back"))
        .select("n", "m", F.explode(F.array(one(0, "word", half), one(1, "back", F.col("m") - half))).alias("s"))
        .select("s.side", "m", F.col("s.shown").substr(F.lit(1), F.col("s.h")).alias("half"), "s.shown", "n"))
    key = ["side", "m", "half"]
    sizes = placed.groupBy(*key).agg(F.count("*").alias("words")).where("words > 1")
    lists = placed.join(sizes, key).withColumn("lists", F.ceil(F.col("words") / list_words).cast("int"))
    own = F.pmod(F.xxhash64("shown"), F.col("lists")).cast("int")

    def meeting(other: Column, mine: Column) -> Column:
        first, second = F.least(mine, other), F.greatest(mine, other)
        return F.struct(first.alias("list"), second.alias("met"), (first == mine).alias("listed"), (second == mine).alias("asked"))

    return (
        lists.withColumn("own", own)
        .withColumn("at", F.explode(F.transform(F.sequence(F.lit(0), F.col("lists") - 1), lambda o: meeting(o, F.col("own")))))
        .select(*key, "at.list", "at.met", "shown", "n", "at.listed", "at.asked"))


def shared_prefix(a: str, b: str) -> int:
    at = 0
    for x, y in zip(a, b):
        if x != y:
            break
        at += 1
    return at


def one_edit_apart(asked: str, words: list[str], shared: list[int], start: int, base: int) -> Iterator[int]:
    """Places in sorted ``words``, from ``start`` on, of words exactly one edit from ``asked``.

    ``shared[i]`` is the prefix that words ``i - 1`` and ``i`` share; all words
    and ``asked`` share their first ``base`` characters.  ``rows[d]`` holds the
    edits between a word's first ``d`` characters and the first ``d - 1``, ``d``
    and ``d + 1`` of ``asked``.
    """
    size, end = len(asked), len(words)
    rows = [(1 if base else 2, 0, 1)] * (base + 1)
    i, valid = start, base
    while i < end:
        word = words[i]
        del rows[valid + 1:]
        d, dead = valid, False
        low, mid, high = rows[d]
        while d < len(word):
            c = word[d]
            a = min(low + (not 0 < d <= size or c != asked[d - 1]), mid + 1)
            b = min(mid + (d >= size or c != asked[d]), high + 1, a + 1)
            e = min(high + (d + 1 >= size or c != asked[d + 1]), b + 1) if d + 2 <= size else 2
            low, mid, high = a, b if d + 1 <= size else 2, e
            d += 1
            rows.append((low, mid, high))
            if low > 1 and mid > 1 and high > 1:
                dead = True
                break
        if not dead and abs(size - len(word)) <= 1 and rows[d][size - len(word) + 1] == 1:
            yield i
        if dead:
            after = bisect_left(words, word[:d] + _END, i + 1)
        else:
            after = i + 1
        if after < end:
            valid = min(shared[after] if after == i + 1 else shared_prefix(word, words[after]), d)
        i = after


def block_pairs(listed: list[tuple[str, int]], asked: list[tuple[str, int]], side: int, m: int, same: bool) -> Iterator[tuple]:
    """``(word, n, other, other_n)`` of the pairs of one meeting, each pair in one block only."""
    words = [w for w, _ in listed]
    shared = [0] + [shared_prefix(a, b) for a, b in zip(words, words[1:])]
    half = m // 2
    base = half if side == 0 else m - half
    for i, (word, n) in enumerate(asked):
        # Words of one list meet once: each looks at those behind it.
        for at in one_edit_apart(word, words, shared, i + 1 if same else 0, base):
            other, other_n = listed[at]
            if min(len(word), len(other)) != m:
                continue
            a, b = (word, other) if side == 0 else (word[::-1], other[::-1])
            if side == 1 and a[:half] == b[:half]:
                continue
            yield a, n, b, other_n


def near_pairs(words: DataFrame, least_chars: int = LEAST_CHARS, list_words: int = LIST_WORDS) -> DataFrame:
    """``(word, n, other, other_n)``: every pair of words one edit apart, once."""
    def pairs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, listed, asked = None, [], []

        def met() -> pa.RecordBatch:
            found = list(block_pairs(listed, asked, key[0], key[1], key[3] == key[4])) if listed and asked else []
            columns = list(zip(*found)) or [()] * 4
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64()) * 2)], names=["word", "n", "other", "other_n"])

        for part in parts:
            for *at, shown, n, is_listed, is_asked in zip(*(c.to_pylist() for c in part.columns)):
                if at != key:
                    if key and len(listed) + len(asked) > 2:
                        yield met()
                    key, listed, asked = at, [], []
                if is_listed:
                    listed.append((shown, n))
                if is_asked:
                    asked.append((shown, n))
        if key:
            yield met()

    key = ["side", "m", "half", "list", "met"]
    # A stated number of parts, as the planner would judge by bytes and leave a few long tasks.
    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), words.count() // WORDS_A_TASK)
    ordered = blocks(words, least_chars, list_words).repartition(parts, *key).sortWithinPartitions(*key, "shown")
    return ordered.mapInArrow(pairs, "word string, n long, other string, other_n long")


def rooted(forms: DataFrame) -> DataFrame:
    """Adds ``root`` to ``(word, form, ...)``: where the chain of forms ends.

    Each round doubles the steps a word has gone; since counts grow by a factor
    at every step, chains and rounds are few.
    """
    links = stored(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(
            links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "roots")
        links = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return forms.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS,
    least_count: int = LEAST_COUNT, form_ratio: int = FORM_RATIO, list_words: int = LIST_WORDS,
) -> DataFrame:
    """One row per word: its usual form, the root of its forms, and how many words are one edit away.

    ``form`` is the most frequent word one edit away (of equals the first in
    code-point order) if it is ``form_ratio`` times as frequent, else null.
    Null and empty texts have no words; each row counts, also where rows repeat;
    a null id counts as an empty one in the rule that takes letters from words.
    No words, no rows.  Other columns are not read.  ``least_chars`` is 2 at least.
    """
    if least_chars < 2:
        raise ValueError("words need two characters at least")
    words = stored(vocabulary(docs, id_col, text_col, least_chars, least_count), "words")
    pairs = near_pairs(words, least_chars, list_words)

    def seen(word: str, n: str, other: str) -> Column:
        return F.struct(F.col(word).alias("word"), F.struct((-F.col(n)).alias("n"), F.col(other).alias("w")).alias("best"))

    both = pairs.select(F.explode(F.array(seen("word", "other_n", "other"), seen("other", "n", "word"))).alias("p")).select("p.*")
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("best").alias("best"))
    usual = -F.col("best.n") >= form_ratio * F.col("n")
    forms = stored(words.join(near, "word", "left").select(
        "word", F.when(usual, F.col("best.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(usual, -F.col("best.n")).alias("form_n")), "forms")
    return rooted(forms).select("word", "form", "root", "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))
