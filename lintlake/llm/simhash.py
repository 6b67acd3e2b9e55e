"""Near duplicates by SimHash fingerprints and anchor points of a covering code.

Two fingerprints that differ in at most three bits differ in at most one bit
within one of their two halves.  The words of a perfect Hamming code on 31 bits
of a half are the anchors: every half lies within one bit (the covering radius)
of exactly one anchor, its home.  A fingerprint is replicated to every anchor
within two bits (covering radius plus the half's threshold), 16 at most, so
whoever is at most one bit away meets it at the home of either.  Only distinct
fingerprints are replicated.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.common import documents, map_rows, stored
from lintlake.llm.components import components

THRESHOLD = 3
SHINGLE_WORDS = 3
SEED = 42
# Fingerprints at home at an anchor that one task holds; more are split into blocks.
BLOCK = 4096
_HASHES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, words_in_shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Majority bits of the shingles' hashes as an unsigned number; 0 without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < words_in_shingle:
        shingles, total = iter([b" ".join(words)]), 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(words_in_shingle))))
        total = len(words) - words_in_shingle + 1
    ones = np.zeros(64, np.int64)
    for start in range(0, total, _HASHES_AT_ONCE):
        count = min(_HASHES_AT_ONCE, total - start)
        hashes = np.fromiter(map(xxh64_intdigest, islice(shingles, count), repeat(seed)), np.uint64, count)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)``, the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def row(_, key, text):
        value = fingerprint(text)
        return key, value - (1 << 64) if value >> 63 else value

    return map_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), row, f"id {kind}, fp long")


def _syndromes(halves: np.ndarray) -> np.ndarray:
    """Of words on 31 bits, bit i standing for position i + 1: the xor of the positions of ones."""
    out = np.zeros(len(halves), np.uint64)
    for i in range(31):
        out ^= (halves >> np.uint64(i) & np.uint64(1)) * np.uint64(i + 1)
    return out


def _bit(positions: np.ndarray) -> np.ndarray:
    """The word with a one at a position; zero for position 0."""
    positions = positions.astype(np.uint64)
    return np.where(positions > 0, np.uint64(1) << (np.maximum(positions, 1).astype(np.uint64) - np.uint64(1)), np.uint64(0))


def anchors(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(homes, all anchors within two bits with repeats, one row of 16 for each word)."""
    syndrome = _syndromes(halves)
    homes = halves ^ _bit(syndrome)
    found = [homes]
    pairs = []
    for s in range(32):
        mates = [(i, i ^ s) for i in range(1, 32) if 0 < i ^ s and i < i ^ s] if s else []
        pairs.append([mates[k] if k < len(mates) else (s, 0) for k in range(15)])
    table = np.array(pairs, np.uint64)[syndrome.astype(np.int64)]
    for k in range(15):
        found.append(halves ^ _bit(table[:, k, 0]) ^ _bit(table[:, k, 1]))
    return homes, np.stack(found, axis=1)


def _replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    low = np.uint64((1 << 31) - 1)
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for start in range(0, len(fps), 8192):
            part = fps[start:start + 8192]
            keys, whose, home = [], [], []
            for half, shift in ((0, 1), (1, 33)):
                homes, near = anchors(part >> np.uint64(shift) & low)
                mark = np.uint64(half << 40)
                keys += [homes | mark, near.reshape(-1) | mark]
                whose += [part, np.repeat(part, near.shape[1])]
                home += [np.ones(len(part), bool), np.zeros(near.size, bool)]
            key, fp, own = np.concatenate(keys), np.concatenate(whose), np.concatenate(home)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(own)], names=["anchor", "fp", "home"])


def _tied(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots (each the smallest of its set) after the sets of every a and b are joined."""
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            return root


def _close(homes: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links between two sets of fingerprints: (member, smallest member it is tied to)."""
    nodes = np.unique(np.concatenate([homes, others]))
    root = np.arange(len(nodes))
    left, right = np.searchsorted(nodes, homes), np.searchsorted(nodes, others)
    rows = max(1, (1 << 21) // max(1, len(others)))
    for start in range(0, len(homes), rows):
        i, j = np.nonzero(np.bitwise_count(homes[start:start + rows, None] ^ others[None, :]) <= THRESHOLD)
        root = _tied(root, left[start + i], right[j])
    moved = np.nonzero(root != np.arange(len(nodes)))[0]
    return nodes[moved], nodes[root[moved]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each run of equal (anchor, block), whose homes come first.

    Only the homes of one run are held; the rest streams by.
    """
    last, homes = None, []
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("anchor", "block")], axis=1)
        fps = batch.column("fp").to_numpy().view(np.uint64)
        own = batch.column("home").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(keys)]])
        firsts = np.add.reduceat(own.astype(np.int64), starts) if len(keys) else []
        out = []
        for a, b, n in zip(starts.tolist(), ends.tolist(), firsts):
            if a or last != tuple(keys[a].tolist()):
                homes = []
            if n:
                homes.append(fps[a:a + n])
            if homes and b - a > n:
                out.append(_close(np.unique(np.concatenate(homes)), np.unique(fps[a + n:b])))
        last = tuple(keys[-1].tolist()) if len(keys) else last
        if out:
            a, b = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def fingerprint_links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(a, b)``: links of at most three bits that span the same components as all such links.

    ``prints`` has distinct longs in ``fp``.  The homes of an anchor that is
    home to more than ``block`` fingerprints are split into blocks, and its
    replicas go to each of them.  A task holds the homes of one block at a time
    and streams the replicas, so neither its memory nor its output grows with
    the pairs.
    """
    met = prints.select("fp").mapInArrow(_replicas, "anchor long, fp long, home boolean")
    crowded = stored(
        met.where("home").groupBy("anchor").count().where(F.col("count") > block)
        .select("anchor", F.ceil(F.col("count") / block).alias("blocks")), "crowded")
    count = crowded.count()
    if count:
        # At most 2 / block rows for each fingerprint; beyond a million they are joined by a shuffle.
        met = met.join(F.broadcast(crowded) if count <= 1_000_000 else crowded, "anchor", "left")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        met = met.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn(
            "block", F.explode(F.when(F.col("home"), F.array(own)).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    else:
        met = met.withColumn("block", F.lit(0).cast("long"))
    dealt = met.select("anchor", "block", "fp", "home").repartition("anchor", "block").sortWithinPartitions(
        "anchor", "block", F.desc("home"))
    return dealt.mapInArrow(_compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Every document with its fingerprint and the smallest id it is linked to, directly or through others.

    A null or empty text has fingerprint zero and is linked like any other;
    equal texts always meet; repeated rows give repeated rows; a null id is
    kept, and a group of null ids only has a null component.  An empty table
    gives an empty result.  Other columns are not read.
    """
    prints = stored(fingerprints(docs, id_col, text_col), "prints")
    distinct = stored(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    roots = components(fingerprint_links(distinct, block))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
