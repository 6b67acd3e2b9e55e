"""Benchmark passages in documents, by latent semantic retrieval.

Benchmark items become overlapping segments of a few dozen words, and segments
are taken in blocks.  A block's terms span a TF-IDF space.  One pass counts in how many
documents each term stands; a second one sketches the matrix of all corpus
passages: every task multiplies its passages with a random matrix and back, and
the sums give the leading singular vectors (single-pass Nystroem form of the
randomised SVD).  The block's own segments enter with equal weight, so the space
keeps what tells them apart.  The last pass projects overlapping passages of
every document and takes those whose cosine with a segment is high enough as
candidates; so are the places where some consecutive words of a segment stand,
however common these are.  Candidates are decided by the longest common
subsequence of words and by how much of the segment's end, its answer, is among
them, or by a run of consecutive words in common.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lintlake.llm.common import documents

SEGMENT_WORDS, SEGMENT_STRIDE = 64, 32
BLOCK_SEGMENTS = 512
# Blocks that one pass over the corpus serves; their models are a few MB each.
BLOCKS_AT_ONCE = 8
PASSAGE, STRIDE = 64, 16
# Terms in more than this share of the documents tell nothing apart, but each
# segment keeps the rarer half of its terms, however common they are.
COMMON, LEAST_TERMS, LEAST_IDF = 0.05, 0.5, 0.05
EXTRA_DIMENSIONS = 64
COSINE = 0.5
# Share of a segment's words in the common subsequence: enough alone, or with the answer.
LCS_ALONE, LCS_WITH_ANSWER = 0.8, 0.6
ANSWER_WORDS, ANSWER_SHARE = 8, 0.5
# So many consecutive words of a segment are enough, too.
RUN_WORDS = 13
# So many consecutive words of a segment make a place a candidate.
SEED_WORDS = 3
# Segments shorter than this must stand word by word.
SHORT = 8
_WORDS_AT_ONCE = 100_000
_TO_SPACES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_SPACES).split()


def segments_of(item: int, text: str | None) -> list[tuple[int, list[bytes]]]:
    """An item's words, or windows of them of which each overlaps the next by half at least."""
    words = words_of(text)
    more = len(words) - SEGMENT_WORDS
    if more <= 0:
        return [(item, words)] if words else []
    count = -(-more // SEGMENT_STRIDE)
    return [(item, words[a:a + SEGMENT_WORDS]) for a in (more * i // count for i in range(count + 1))]


def places_of(segment: list[bytes]) -> dict[bytes, int]:
    """Where each word stands in a segment, as bits of a number."""
    places: dict[bytes, int] = {}
    for i, w in enumerate(segment):
        places[w] = places.get(w, 0) | 1 << i
    return places


def common_length(places: dict[bytes, int], length: int, region: list[bytes], least: int = 0) -> int:
    """Length of the longest common subsequence with a region; 0 if fewer than ``least`` words are shared at all."""
    here = list(filter(None, map(places.get, region)))
    if len(here) < least:
        return 0
    full = (1 << length) - 1
    open_ = full
    for bits in here:
        bits &= open_
        if bits:
            open_ = ((open_ + bits) | (open_ - bits)) & full
    return length - open_.bit_count()


def has_run(segment: list[bytes], region: list[bytes]) -> bool:
    """Whether ``RUN_WORDS`` consecutive words of the segment stand in the region."""
    whole = b" " + b" ".join(region) + b" "
    return any(
        b" " + b" ".join(segment[i:i + RUN_WORDS]) + b" " in whole for i in range(len(segment) - RUN_WORDS + 1))


def verified(segment: list[bytes], places: dict[bytes, int], answer: dict[bytes, int], region: list[bytes]) -> float:
    """Share of the segment found in the region if that makes it a copy or a paraphrase, else 0."""
    size = len(segment)
    if size < SHORT:
        whole = b" " + b" ".join(region) + b" "
        return 1.0 if b" " + b" ".join(segment) + b" " in whole else 0.0
    share = common_length(places, size, region, min(RUN_WORDS, int(LCS_WITH_ANSWER * size))) / size
    if share >= LCS_ALONE or share * size >= RUN_WORDS and has_run(segment, region):
        return share
    if share >= LCS_WITH_ANSWER:
        length = len(segment[-ANSWER_WORDS:])
        if common_length(answer, length, region) >= ANSWER_SHARE * length:
            return share
    return 0.0


class Block:
    """Segments with their terms, and after fitting their latent space."""

    def __init__(self, segments: list[tuple[int, list[bytes]]]):
        self.segments = segments
        self.places = [(places_of(words), places_of(words[-ANSWER_WORDS:])) for _, words in segments]
        self.words = {w: i for i, w in enumerate(sorted({w for _, words in segments for w in words}))}
        self.terms = self.words
        self.seeds = [self._seeds(n) for n in range(1, SEED_WORDS + 1)]

    def _key(self, numbers: np.ndarray, n: int) -> np.ndarray:
        """One number for each ``n`` consecutive ones."""
        key, size = np.zeros(max(0, len(numbers) - n + 1), np.int64), len(numbers)
        for i in range(n):
            key = key * len(self.words) + numbers[i:size - n + 1 + i]
        return key

    def _seeds(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys of runs of ``n`` words, and the segment and offset of each; fewer words only of segments as short."""
        found = []
        for s, (_, words) in enumerate(self.segments):
            if n == min(SEED_WORDS, len(words)):
                key = self._key(np.array([self.words[w] for w in words], np.int64), n)
                found += [(k, s, i) for i, k in enumerate(key.tolist())]
        table = np.array(sorted(found), np.int64).reshape(-1, 3)
        return table[:, 0], table[:, 1], table[:, 2]

    def seeded(self, positions: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, segment, offset in it) of all runs of words that stand in a segment."""
        found = [(np.zeros(0, np.int64),) * 3]
        for n, (keys, segment, offset) in enumerate(self.seeds, 1):
            if len(keys) and len(numbers) >= n:
                here = np.flatnonzero(positions[n - 1:] - positions[:len(positions) - n + 1] == n - 1)
                key = self._key(numbers.astype(np.int64), n)[here]
                low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
                times = high - low
                which = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
                found.append((np.repeat(positions[here], times), segment[which], offset[which]))
        return tuple(map(np.concatenate, zip(*found)))

    def weigh(self, frequency: np.ndarray, total: int) -> None:
        """Inverse document frequencies; common terms leave the space unless too few of a segment's would stay."""
        idf = np.maximum(np.log((total + 1) / (frequency + 1)), LEAST_IDF)
        keep = frequency <= COMMON * total
        for _, words in self.segments:
            own = np.array(sorted({self.words[w] for w in words}), np.int64)
            own = own[np.argsort(frequency[own], kind="stable")]
            keep[own[:int(np.ceil(LEAST_TERMS * len(own)))]] = True
        kept = np.flatnonzero(keep)
        names = sorted(self.terms)
        self.terms = {names[i]: n for n, i in enumerate(kept)}
        self.inner = np.full(len(names), -1, np.int32)
        self.inner[kept] = np.arange(len(kept))
        self.idf = idf[kept]
        width = min(len(kept), len(self.segments) + EXTRA_DIMENSIONS)
        self.random = np.random.default_rng(5).standard_normal((len(kept), width)).astype(np.float32)

    def vectors(self) -> np.ndarray:
        out = np.zeros((len(self.segments), len(self.terms)))
        for row, (_, words) in enumerate(self.segments):
            for w in words:
                if w in self.terms:
                    out[row, self.terms[w]] += self.idf[self.terms[w]]
        return out

    def finish(self, sketch: np.ndarray, energy: float) -> None:
        """Singular vectors from the sketch of the corpus with the segments added at equal energy."""
        own = self.vectors()
        scale = energy / max(1e-12, float((own ** 2).sum())) if energy else 1.0
        random = self.random.astype(np.float64)
        whole = sketch + scale * (own.T @ (own @ random))
        core = random.T @ whole
        values, turn = np.linalg.eigh((core + core.T) / 2)
        good = values > max(values.max(initial=0), 0) * 1e-10
        # whole @ core^-1/2 has the singular vectors of the TF-IDF matrix.
        basis = np.linalg.svd(whole @ (turn[:, good] / np.sqrt(values[good])), full_matrices=False)[0]
        self.space = (self.idf[:, None] * basis).astype(np.float32)
        latent = own @ basis
        size = np.linalg.norm(latent, axis=1)
        self.latent = (latent / np.maximum(size, 1e-9)[:, None]).astype(np.float32)
        self.random = None


def _laid_out(texts: list, terms: dict[bytes, int], gap: int, step: int) -> Iterator[tuple[int, list, np.ndarray, np.ndarray, list[int]]]:
    """Texts a few at a time: (first, word lists, positions and numbers of known terms, where each text begins).

    Texts lie on one axis, with a gap between them that no passage spans.
    """
    first, lists, positions, numbers, starts, at = 0, [], [], [], [], 0
    for n, text in enumerate(texts):
        words = words_of(text)
        ids = np.fromiter(map(terms.get, words, repeat(-1)), np.int32, len(words))
        known = np.flatnonzero(ids >= 0)
        lists.append(words)
        positions.append(known + at)
        numbers.append(ids[known])
        starts.append(at)
        at += -(-len(words) // step) * step + gap
        if at > _WORDS_AT_ONCE:
            yield first, lists, np.concatenate(positions), np.concatenate(numbers), starts
            first, lists, positions, numbers, starts, at = n + 1, [], [], [], [], 0
    if lists:
        yield first, lists, np.concatenate(positions), np.concatenate(numbers), starts


def term_frequencies(texts: DataFrame, blocks: list[Block]) -> tuple[list[np.ndarray], int]:
    """In how many documents each term of each block stands, and the number of documents."""
    all_terms = sorted({w for b in blocks for w in b.terms})
    ids = {w: i for i, w in enumerate(all_terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(len(ids), np.int64), 0
        for batch in batches:
            for text in batch.column("t"):
                words = set(words_of(text.as_py()))
                rows += 1
                here = np.fromiter(map(ids.get, words, repeat(-1)), np.int64, len(words))
                counts[here[here >= 0]] += 1
        kept = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(kept, -1)), pa.array(np.append(counts[kept], rows))], names=["term", "n"])

    total, counts = 0, np.zeros(len(ids))
    # As many rows as the benchmark has terms.
    for r in texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if r["term"] < 0:
            total = r["n"]
        else:
            counts[r["term"]] = r["n"]
    return [counts[[ids[w] for w in sorted(b.terms)]] for b in blocks], total


def sketched(texts: DataFrame, block: Block) -> tuple[np.ndarray, float]:
    """The corpus passages' matrix, times its transpose, times the block's random matrix; and its energy."""
    terms, idf, random = block.terms, block.idf, block.random
    width = random.shape[1]
    weighted = (idf[:, None] * random).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, energy = np.zeros((len(terms), width)), 0.0
        for batch in batches:
            for _, _, positions, numbers, _ in _laid_out(batch.column("t").to_pylist(), terms, PASSAGE, PASSAGE):
                if not len(numbers):
                    continue
                passage = positions // PASSAGE
                starts = np.flatnonzero(np.diff(passage, prepend=-1))
                sums = np.add.reduceat(weighted[numbers], starts)
                which = np.cumsum(np.diff(passage, prepend=passage[0]) > 0)
                order = np.argsort(numbers, kind="stable")
                firsts = np.flatnonzero(np.diff(numbers[order], prepend=-1))
                there = numbers[order][firsts]
                total[there] += np.add.reduceat(sums[which[order]], firsts) * idf[there][:, None]
                pair, count = np.unique(which * np.int64(len(terms)) + numbers, return_counts=True)
                energy += float(((count * idf[pair % len(terms)]) ** 2).sum())
        kept = np.flatnonzero(np.abs(total).sum(axis=1))
        rows = [r.tolist() for r in total[kept].astype(np.float32)] + [[energy] + [0.0] * (width - 1)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(kept, -1)), pa.array(rows, pa.list_(pa.float32()))], names=["term", "v"])

    out, energy = np.zeros((len(terms), width)), 0.0
    if not len(terms):
        return out, energy
    sums = texts.mapInArrow(run, "term long, v array<float>").groupBy("term").agg(
        *(F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(width)))
    for r in sums.select("term", F.array(*(f"v{i}" for i in range(width))).alias("v")).collect():
        if r["term"] < 0:
            energy = r["v"][0]
        else:
            out[r["term"]] = r["v"]
    return out, energy


def fit_blocks(texts: DataFrame, segments: list[tuple[int, list[bytes]]]) -> list[list[Block]]:
    """Fitted blocks of all segments, grouped for passes over the corpus."""
    blocks = [Block(segments[i:i + BLOCK_SEGMENTS]) for i in range(0, len(segments), BLOCK_SEGMENTS)]
    if blocks:
        frequencies, total = term_frequencies(texts, blocks)
        for block, frequency in zip(blocks, frequencies):
            block.weigh(frequency, total)
            block.finish(*sketched(texts, block))
    return [blocks[i:i + BLOCKS_AT_ONCE] for i in range(0, len(blocks), BLOCKS_AT_ONCE)]


def _found(block: Block, texts: list, cosine: float) -> list[dict[int, tuple[float, float]]]:
    """Of each text: item to (share in common, cosine) of verified candidates."""
    out: list[dict[int, tuple[float, float]]] = [{} for _ in texts]
    for first, lists, positions, numbers, starts in _laid_out(texts, block.words, PASSAGE, STRIDE):
        pairs = []
        place, segment, offset = block.seeded(positions, numbers)
        inner = block.inner[numbers]
        positions, numbers = positions[inner >= 0], inner[inner >= 0]
        if len(numbers):
            # Passages that hold a known term; the first one is followed by those that overlap it.
            last = positions // STRIDE
            begin = np.unique(np.concatenate([last - k for k in range(PASSAGE // STRIDE)])) * STRIDE
            begin = begin[begin >= 0]
            sums = np.concatenate([np.zeros((1, block.space.shape[1]), np.float32), np.cumsum(block.space[numbers], axis=0)])
            low, high = np.searchsorted(positions, begin), np.searchsorted(positions, begin + PASSAGE)
            vectors = sums[high] - sums[low]
            size = np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)
            near = (vectors / size) @ block.latent.T
            w, s = np.nonzero(near >= cosine)
            doc = np.searchsorted(starts, begin[w], side="right") - 1
            pairs = sorted(zip(doc.tolist(), (-near[w, s]).tolist(), begin[w].tolist(), s.tolist()))
        for d, cos, at, s in pairs:
            item, words = block.segments[s]
            if item in out[first + d]:
                continue
            at -= starts[d]
            share = verified(words, *block.places[s], lists[d][max(0, at - STRIDE):at + PASSAGE + STRIDE])
            if share:
                out[first + d][item] = (share, -cos)
        # Seeds of one segment that are about equally shifted make one candidate.
        doc = np.searchsorted(starts, place, side="right") - 1
        shift = (place - np.array(starts, np.int64)[doc] - offset) // STRIDE
        seeds = np.unique(np.stack([doc, segment, shift], axis=1), axis=0)
        for d, s, at in seeds.tolist():
            item, words = block.segments[s]
            if item in out[first + d]:
                continue
            at *= STRIDE
            share = verified(words, *block.places[s], lists[d][max(0, at - STRIDE):at + len(words) + 2 * STRIDE])
            if share:
                out[first + d][item] = (share, 0.0)
    return out


def unsearched(rows: DataFrame) -> DataFrame:
    """``rows`` with the columns of a search that has found nothing."""
    return rows.withColumns({"items": F.array().cast("array<long>"), "share": F.lit(0.0), "cosine": F.lit(0.0)})


def searched(rows: DataFrame, blocks: list[Block], cosine: float = COSINE) -> DataFrame:
    """``rows``, of which ``t`` is searched, with ``items``, ``share`` and ``cosine`` of what some blocks find.

    What earlier blocks have found is kept.
    """
    new = ["items", "share", "cosine"]
    rows = rows if "items" in rows.columns else unsearched(rows)
    shared = rows.sparkSession.sparkContext.broadcast(blocks)
    schema = to_arrow_schema(rows.schema)
    others = [c for c in rows.columns if c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = batch.column("t").to_pylist()
                items, shares, cosines = (batch.column(c).to_pylist() for c in new)
                for block in shared.value:
                    for n, hits in enumerate(_found(block, texts, cosine)):
                        if hits:
                            items[n] = sorted({*items[n], *hits})
                            shares[n] = max(shares[n], *(s for s, _ in hits.values()))
                            cosines[n] = max(cosines[n], *(c for _, c in hits.values()))
                made = [pa.array(x, schema.field(f).type) for f, x in zip(new, (items, shares, cosines))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *made], names=[*others, *new])

    return rows.select(*others, *new).mapInArrow(run, rows.select(*others, *new).schema)


def segments_of_table(benchmark: DataFrame) -> list[tuple[int, list[bytes]]]:
    """All segments of a stated query set (item_id, text), in a fixed order."""
    rows = benchmark.where(F.col("item_id").isNotNull()).select("item_id", "text").distinct().orderBy("item_id", "text")
    return [s for r in rows.collect() for s in segments_of(r["item_id"], r["text"])]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", cosine: float = COSINE,
) -> DataFrame:
    """The benchmark items that stand in each document, word by word or paraphrased.

    ``benchmark`` (item_id, text) is a stated set of queries: it is read to the
    driver and goes to the tasks in blocks.  Null and empty texts hold nothing,
    null or empty items are found nowhere; repeated rows and null ids are kept;
    an empty table gives an empty result.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    for group in fit_blocks(rows.select("t"), segments_of_table(benchmark)):
        rows = searched(rows, group, cosine)
    rows = rows if "items" in rows.columns else unsearched(rows)
    return rows.select(
        F.col("id").alias(id_col), (F.size("items") > 0).alias("contaminated"), "items",
        F.col("share").alias("lcs_share"), "cosine")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
