"""Shards by balanced label propagation.

Texts are nodes, weighted by how many documents hold them.  Every passage, a
line or a sentence, that stands in two texts or more is a hub which links them.
Texts whose first hub is the same are a cluster, which moves as a whole.  In each
round hubs count the shards of their texts, every cluster looks for the shard
where most of its neighbours are, over all its hubs, each by one over its size,
and clusters move under quotas: what two shards want to exchange is exchanged,
and beyond that only free room is given.  A round that keeps less of the links
inside shards is not taken.  At last the documents are put in the order of shard, hub and text, and
that order is cut into eight runs whose sizes differ by one at most; so equal
texts stay together but for the seven cuts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintlake.llm.common import documents, stored

SHARDS = 8
ROUNDS = 8
# Room above an even share that a shard may fill while labels move.
SLACK = 0.02
# Lines and sentences shorter than this link nothing.
LINK_CHARS = 40
SENTENCES = r"\n|(?<=[.!?])[ \t]+|(?<=[。！？])"
# Parts in which the texts of a hub are dealt out; bits of one number.
PARTS = 64
# Rows that one task orders at once, about; larger hubs and texts are split.
ROWS_PER_BUCKET = 16_000
MOST_BUCKETS = 8_192


def passages(text: Column) -> Column:
    """Hashes of the distinct lines and sentences of a text, but for short ones."""
    both = F.concat(F.split(text, "\n"), F.split(text, SENTENCES))
    return F.array_distinct(F.transform(F.filter(both, lambda x: F.length(x) >= LINK_CHARS), lambda x: F.xxhash64(x)))


def _parts() -> Column:
    """The parts of a hub that hold texts, as bits; an aggregate over ``part``."""
    return F.bit_or(F.expr("shiftleft(1L, part)"))


def _each_part(mask: Column) -> Column:
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.getbit(mask, i) == 1))


def links(held: DataFrame) -> DataFrame:
    """``(node, hub, part)`` of every passage that two or more nodes of ``held`` (node, hubs) hold.

    A passage that very many texts hold is met in parts, each by a join of its own.
    """
    pairs = held.select("node", F.explode("hubs").alias("hub")).withColumn(
        "part", F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int"))
    shared = pairs.groupBy("hub").agg(F.min("node").alias("a"), F.max("node").alias("b"), _parts().alias("mask")).where("a < b")
    return pairs.join(shared.select("hub", _each_part(F.col("mask")).alias("part")), ["hub", "part"]).select(
        "node", "hub", "part").distinct()


def quotas(wants: dict[tuple[int, int], int], sizes: dict[int, int], shards: int, slack: float) -> dict[tuple[int, int], float]:
    """The share of each wish (from, to) that is granted.

    Opposite wishes are exchanged; what is left of a wish gets a share of the
    free room of its shard.
    """
    total = sum(sizes.values())
    granted = {k: min(v, wants.get(k[::-1], 0)) for k, v in wants.items()}
    for to in range(shards):
        room = max(0, int((1 + slack) * total / shards) - sizes.get(to, 0))
        rest = {k: wants[k] - granted[k] for k in wants if k[1] == to}
        for k, v in rest.items():
            granted[k] += min(v, room * v // max(1, sum(rest.values())))
    return {k: granted[k] / wants[k] for k in wants if wants[k]}


def clusters_of(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters of texts with one strongest hub, and how they hang on hubs.

    ``(h1, weight, node_parts)`` of each cluster, with the parts that hold its
    nodes, and ``(h1, hub, w, part, hub_part)`` of each cluster and hub, where
    ``w`` of the cluster's documents hold the hub's passage.
    """
    clusters = nodes.groupBy("h1").agg(F.sum("weight").alias("weight"), F.bit_or(F.expr("shiftleft(1L, node_part)")).alias("node_parts"))
    hangs = edges.join(nodes.select("node", "weight", "h1"), "node").groupBy("h1", "hub").agg(F.sum("weight").alias("w"))
    return clusters, hangs.withColumns({
        "part": F.pmod(F.xxhash64("h1"), F.lit(PARTS)).cast("int"), "hub_part": F.pmod(F.xxhash64("hub"), F.lit(PARTS)).cast("int")})


def _hub_counts(labels: DataFrame, hangs: DataFrame, shards: int) -> DataFrame:
    """Documents of each hub in each shard, and the parts that hold its clusters.

    A cluster with very many hubs is joined in parts.
    """
    spread = hangs.groupBy("h1").agg(F.bit_or(F.expr("shiftleft(1L, hub_part)")).alias("m")).join(labels.select("h1", "shard"), "h1").select(
        "h1", "shard", _each_part(F.col("m")).alias("hub_part"))
    return hangs.join(spread, ["h1", "hub_part"]).groupBy("hub").agg(
        *(F.sum(F.when(F.col("shard") == s, F.col("w")).otherwise(0)).alias(f"n{s}") for s in range(shards)),
        F.sum("w").alias("size"), _parts().alias("mask"))


def kept_together(counts: DataFrame, shards: int) -> float:
    """How much of the links lies inside shards: pairs of a hub in one shard, each hub by one over its size."""
    inside = reduce(lambda a, b: a + b, (F.col(f"n{s}") * F.col(f"n{s}") for s in range(shards)))
    return counts.agg(F.sum(inside / F.col("size"))).first()[0] or 0.0


def _propagated(labels: DataFrame, hangs: DataFrame, counts: DataFrame, shards: int, slack: float, round_: int, part: float) -> DataFrame:
    """One round over ``labels`` (h1, weight, node_parts, shard): ``part`` of the moves; a cluster moves as a whole."""
    told = counts.select("hub", _each_part(F.col("mask")).alias("part"), *((F.col(f"n{s}") / F.col("size")).alias(f"n{s}") for s in range(shards)), "size")
    near = hangs.join(told, ["hub", "part"]).groupBy("h1").agg(
        F.sum(F.col("w") * F.col("w") / F.col("size")).alias("own"), *(F.sum(F.col("w") * F.col(f"n{s}")).alias(f"n{s}") for s in range(shards)))
    seen = labels.join(near, "h1", "left").fillna(0.0, ["own", *(f"n{s}" for s in range(shards))])
    # A cluster is no neighbour of itself.
    around = [F.round(F.col(f"n{s}") - F.when(F.col("shard") == s, F.col("own")).otherwise(0.0), 9) for s in range(shards)]
    most = F.greatest(*around)
    here = reduce(lambda a, s: F.when(F.col("shard") == s, around[s]).otherwise(a), range(shards), F.lit(0.0))
    best = F.coalesce(*(F.when(around[s] == most, s) for s in range(shards)))
    wished = stored(seen.select(
        "h1", "weight", "node_parts", "shard", F.when(most > here, best).otherwise(F.col("shard")).alias("wish")), "wishes")
    table = wished.groupBy("shard", "wish").agg(F.sum("weight").alias("n")).collect()
    sizes: dict[int, int] = {}
    for r in table:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["n"]
    shares = quotas({(r["shard"], r["wish"]): r["n"] for r in table if r["shard"] != r["wish"]}, sizes, shards, slack)
    draw = F.pmod(F.xxhash64(F.lit(round_), "h1"), F.lit(1_000_000)) / 1_000_000
    share = reduce(
        lambda a, kv: F.when((F.col("shard") == kv[0][0]) & (F.col("wish") == kv[0][1]), kv[1]).otherwise(a),
        sorted(shares.items()), F.lit(0.0))
    return wished.select("h1", "weight", "node_parts", F.when(draw < share * part, F.col("wish")).otherwise(F.col("shard")).alias("shard"))


def propagated(labels: DataFrame, hangs: DataFrame, shards: int, rounds: int, slack: float = SLACK) -> DataFrame:
    """The best labels of all rounds; after one that keeps less together, half as many move from the best."""
    if not rounds:
        return labels
    counts = stored(_hub_counts(labels, hangs, shards), "hub-counts")
    best, part = kept_together(counts, shards), 1.0
    for round_ in range(rounds):
        moved = stored(_propagated(labels, hangs, counts, shards, slack, round_, part), "labels")
        moved_counts = stored(_hub_counts(moved, hangs, shards), "hub-counts")
        kept = kept_together(moved_counts, shards)
        if kept > best:
            labels, counts, best = moved, moved_counts, kept
        else:
            part /= 2
    return labels


def _positions(rows: DataFrame, total: int, rows_per_bucket: int) -> DataFrame:
    """``position`` from 0 in the order of shard, hub, text and id, without gaps.

    Rows fall into buckets that follow each other in that order.  A hub or a
    text with more rows than a bucket should hold has buckets of its own.
    """
    buckets = min(MOST_BUCKETS, max(1, total // (SHARDS * rows_per_bucket)))
    big_hub, big_node = F.col("hub_rows") > rows_per_bucket, F.col("weight") > rows_per_bucket
    parts = {
        "b1": F.pmod(F.xxhash64("h1"), F.lit(buckets)),
        "b2": F.when(big_hub, F.col("h1")).otherwise(0),
        "b3": F.when(big_hub, F.pmod(F.xxhash64("node"), F.ceil(F.col("hub_rows") / rows_per_bucket))).otherwise(0),
        "b4": F.when(big_node, F.col("node")).otherwise(0),
        "b5": F.when(big_node, F.pmod(F.xxhash64("id"), F.ceil(F.col("weight") / rows_per_bucket))).otherwise(0),
    }
    top, fine = ["label", "b1"], ["label", *parts]
    rows = stored(rows.withColumns(parts).drop("hub_rows", "weight"), "placed")
    counts = rows.groupBy(*fine).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*top).orderBy(*fine[2:]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # At most shards x MOST_BUCKETS rows, whatever the input.
    tops = rows.groupBy(*top).agg(F.count("*").alias("n")).withColumn(
        "top_before",
        F.coalesce(F.sum("n").over(Window.orderBy(*top).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    offsets = counts.withColumn("before", before).join(tops, top).select(
        *fine, (F.col("before") + F.col("top_before")).alias("offset"))
    within = F.row_number().over(Window.partitionBy(*fine).orderBy("h1", "node", "id")) - 1
    return rows.withColumn("within", within).join(offsets, fine).withColumn("position", F.col("offset") + F.col("within"))


def shards(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: int = SHARDS, rounds: int = ROUNDS,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Shard and slot of every document; the law is ``rows``: counts differ by one at most.

    A null text counts as an empty one; empty texts are equal texts; repeated
    rows get a slot each; a null id comes first in its text; an empty table gives
    an empty result.  Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = stored(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("node"), passages(text).alias("hubs"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(PARTS)).cast("int").alias("id_part")), "documents")
    total = base.count()
    edges = stored(links(base.select("node", "hubs")), "links")
    nodes = stored(base.groupBy("node").agg(F.count("*").alias("weight"), F.bit_or(F.expr("shiftleft(1L, id_part)")).alias("id_parts")).join(
        edges.groupBy("node").agg(F.min("hub").alias("h1")), "node", "left").withColumns({
            "h1": F.coalesce("h1", "node"), "node_part": F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int")}), "nodes")
    clusters, hangs = clusters_of(nodes, edges)
    hangs = stored(hangs, "hangs")
    labels = stored(clusters.withColumn("shard", F.pmod(F.xxhash64("h1"), F.lit(count)).cast("int")), "labels")
    labels = propagated(labels, hangs, count, rounds)
    # A hub with very many texts and a text with very many documents are joined in parts.
    told = labels.select("h1", F.col("shard").alias("label"), F.col("weight").alias("hub_rows"), _each_part(F.col("node_parts")).alias("node_part"))
    texts = nodes.join(told, ["h1", "node_part"]).select(
        "node", "weight", "hub_rows", "label", "h1", _each_part(F.col("id_parts")).alias("id_part"))
    placed = _positions(base.drop("hubs").join(texts, ["node", "id_part"]).drop("id_part"), total, rows_per_bucket)
    share, more = divmod(total, count)
    position, edge = F.col("position"), more * (share + 1)
    shard = F.when(position < edge, F.floor(position / (share + 1))).otherwise(
        more + F.floor((position - edge) / max(1, share))).cast("int")
    start = F.col("shard") * share + F.least("shard", F.lit(more))
    return placed.withColumn("shard", shard).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (position - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(documents(spark, sf_dir))
