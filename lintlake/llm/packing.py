"""Best-fit packing of documents into bins, with conflicts.

Bins are kept in the order of what is left in them.  Each carries a bitmap of
the sources and one of the duplicate clusters it holds.  A piece goes to the
fullest bin that has room and no conflict: the search starts at the tightest
bin with room and goes on to the next one until a compatible bin is found.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.common import documents, stored

# Length of a bin; lengths are UTF-8 bytes unless a column of lengths is given.
CAPACITY = 16_384
# A bin holds at most so many pieces of one source.
PER_SOURCE = 2
# Pieces that one task packs by itself.
PIECES_PER_GROUP = 8_192


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """``(bin, offset)`` of every piece, in the order given (longest first is best).

    ``clusters`` has -1 for pieces that conflict with none.  Source bits stand
    in ``per_source`` planes, filled one after the other.
    """
    room: list[tuple[int, int]] = []
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    out: list[tuple[int, int]] = []
    alike, finger = None, (0, 0)
    for length, source, cluster in zip(lengths, sources, clusters):
        planes = ((1 << per_source) - 1) << source * per_source
        bit = 1 << cluster if cluster >= 0 else 0
        # Bins that an equal piece could not use, or has just filled, stay unusable for this one.
        key = (length, source, cluster)
        at = bisect_left(room, max(finger, (length, -1)) if key == alike else (length, -1))
        while at < len(room):
            b = room[at][1]
            if not cluster_bits[b] & bit and source_bits[b] & planes != planes:
                break
            at += 1
        if at < len(room):
            left, b = room.pop(at)
            finger = (left, b)
        else:
            left, b = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
            finger = (capacity, b)
        # Without a cluster the same bin may take the next equal piece as well.
        alike = key if cluster >= 0 else None
        used = source_bits[b] & planes
        source_bits[b] |= (used | used << 1 | 1 << source * per_source) & planes
        cluster_bits[b] |= bit
        out.append((b, capacity - left))
        insort(room, (left - length, b))
    return out


def pieces_of(items: DataFrame, capacity: int) -> DataFrame:
    """``items`` (id, length, source, cluster) cut at the capacity; a row for each piece."""
    count = F.greatest(F.ceil(F.col("length") / capacity), F.lit(1)).cast("int")
    return (
        items.withColumn("n_pieces", count)
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
        .withColumn("start", F.col("piece").cast("long") * capacity)
        .withColumn("length", F.least(F.lit(capacity).cast("long"), F.col("length") - F.col("start"))))


def pack(
    items: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, pieces_per_group: int = PIECES_PER_GROUP,
) -> DataFrame:
    """A bin and an offset for every piece of every item.

    ``items`` has ``id``, ``length``, ``source`` and ``cluster``.  Pieces of one
    cluster never share a bin; a null cluster conflicts with none.  Pieces are
    dealt evenly to groups by the hash of their id, whatever their source or
    cluster, and each group is packed by itself, so a hot source or a large
    cluster is spread over all tasks.  An item longer than a bin is cut, and
    its pieces count as a cluster of their own if it has none.  Length zero
    still gets a place.
    """
    kind = items.schema["id"].dataType.simpleString()
    pieces = stored(
        pieces_of(items, capacity).withColumn(
            "cluster", F.coalesce("cluster", F.when(F.col("n_pieces") > 1, F.xxhash64(F.lit("item"), "id")))),
        "pieces")
    groups = max(1, -(-pieces.count() // pieces_per_group))

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(
            ["length", "cluster", "source", "id", "piece"], ascending=[False, True, True, True, True],
            kind="stable").reset_index(drop=True)
        clusters = frame["cluster"]
        shared = clusters.notna() & clusters.duplicated(keep=False)
        codes = pd.Series(-1, index=frame.index)
        codes[shared] = pd.factorize(clusters[shared])[0]
        sources = pd.factorize(frame["source"], use_na_sentinel=False)[0]
        places = best_fit(frame["length"].tolist(), sources.tolist(), codes.tolist(), capacity, per_source)
        return pd.DataFrame({
            "id": frame["id"], "piece": frame["piece"], "n_pieces": frame["n_pieces"], "start": frame["start"],
            "length": frame["length"], "bin": [(g << 32) + b for g, (b, _) in zip(frame["group"], places)],
            "offset": [o for _, o in places]})

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("id", "piece"), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(
        packed, f"id {kind}, piece int, n_pieces int, start long, length long, bin long, offset long")


def document_items(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Byte lengths, sources and clusters of equal texts (letter case and blanks aside) of documents."""
    plain = F.lower(F.regexp_replace(text_col, r"[\x20\x09-\x0D]+", " "))
    return docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("length"),
        F.col(source_col).cast("string").alias("source"),
        F.when(F.length(text_col) > 0, F.xxhash64(plain)).alias("cluster"))


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = CAPACITY,
) -> DataFrame:
    """Bins of whole documents.

    Null and empty texts take no room and conflict with none; a null source is
    a source of its own; repeated rows are a cluster, so they never share a bin;
    null ids are kept; an empty table gives an empty result.  Other columns are
    not read.
    """
    return pack(document_items(docs, id_col, text_col, source_col), capacity).withColumnRenamed("id", id_col)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
