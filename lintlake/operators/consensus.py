"""Consensus: reviewers that report the same line of the same file agree.

Where findings come straight from a corpus, a file is one row and its findings
one array, so agreement is settled inside the row and nothing is shuffled.  A
table of findings is grouped by location with hash aggregates over numbers;
texts are fetched for the winners only.  Severity filtering comes afterwards,
because filtering first would change who agrees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions import merge, reasoning
from lintlake.functions.constants import bound, computed_once, exploded
from lintlake.functions.severity import AGENTS, SEVERITIES, check_severity
from lintlake.operators.review import labelled

LOCATION = ["repo", "path", "line_number"]
# What decides which finding speaks for a location.
PRECEDENCE = ["sev_rank", "agent_rank", "rule_ordinal", "match_ordinal"]
# The order in which records at a location are merged.
MERGE_ORDER = ["agent_rank", "sev_rank", "rule_ordinal", "match_ordinal"]
# A merged record reads at most this many leading elements of any list that
# keeps repeats, so further repeats of one kind of finding cannot change it.
REPEATS_READ = max(merge.MAX_STEPS, merge.MAX_REASONS, merge.MAX_FACTORS, merge.MAX_TESTS)

TOLERANCE = 2


def _agent_bit() -> Column:
    bits = F.lit(0)
    for i, agent in enumerate(AGENTS):
        bits = F.when(F.col("agent") == agent, F.lit(1 << i)).otherwise(bits)
    return bits


def _agents_of(mask: Column) -> Column:
    """Reviewer names in the mask, alphabetically."""
    named = sorted((agent, 1 << i) for i, agent in enumerate(AGENTS))
    return F.array_compact(
        F.array(*[F.when(mask.bitwiseAND(F.lit(bit)) > 0, F.lit(agent)) for agent, bit in named])
    )


def _representative(columns: list[str]) -> Column:
    return F.min_by(F.struct(*columns), F.struct(*PRECEDENCE))


def _unpack(grouped: DataFrame, columns: list[str], *extra: str) -> DataFrame:
    fields = [F.col("_rep")[name].alias(name) for name in columns if name not in LOCATION]
    return grouped.select(
        *LOCATION,
        *fields,
        F.bit_count("_mask").cast("int").alias("consensus_level"),
        _agents_of(F.col("_mask")).alias("agreeing_agents"),
        "findings_merged",
        *extra,
    )


# Bits of the packed precedence below the sign: severity, reviewer, rule, match.
RULE_BITS, MATCH_BITS, AGENT_BITS = 26, 32, 2


def packed_precedence(sev_rank: Column, agent_rank: Column, rule_ordinal: Column, match_ordinal: Column) -> Column:
    """Precedence as one long that sorts like its parts: 3, 2, 26 and 32 bits."""
    packed = sev_rank.cast("long")
    for part, bits in ((agent_rank, AGENT_BITS), (rule_ordinal, RULE_BITS), (match_ordinal, MATCH_BITS)):
        packed = packed * (1 << bits) + part
    return packed


def consensus(findings: DataFrame) -> DataFrame:
    """One row per location: the most severe finding and who agrees on it.

    One shuffle by location.  What decides is packed in numbers, so grouping
    is a hash aggregate; its winners are then looked up among the findings of
    the same partition.  Of findings that tie, the one with the smallest hash
    speaks; rows that repeat it whole count, and give one row.
    """
    columns = [c for c in findings.columns if c not in LOCATION]
    at = ["_repo", "path", "line_number"]
    # Numbers are made behind the shuffle, so that both sides need the same rows and share it.
    keyed = findings.withColumn("_repo", F.coalesce("repo", F.lit(""))).repartition(*at).withColumns({
        "_packed": F.coalesce(packed_precedence(*map(F.col, PRECEDENCE)), F.lit((1 << 63) - 1)),
        "_hash": F.xxhash64(*findings.columns),
        "_bit": _agent_bit(),
    })
    best = keyed.groupBy(*at).agg(
        F.min("_packed").alias("_best"),
        F.min_by("_hash", F.col("_packed")).alias("_any"),
        F.bit_or("_bit").alias("_mask"),
        F.count("*").alias("findings_merged"),
    )
    # Differences, since further equal keys would ask for another shuffle.
    won = (F.col("_packed") - F.col("_best") == 0) & (F.col("_hash").bitwiseXOR(F.col("_any")) == 0)
    winners = keyed.join(best.hint("shuffle_hash"), at).where(won)
    return winners.select(
        "_repo", *LOCATION, *columns, F.bit_count("_mask").cast("int").alias("consensus_level"),
        _agents_of(F.col("_mask")).alias("agreeing_agents"), "findings_merged").distinct().drop("_repo")


def consensus_of_files(files: DataFrame, labels: list[dict[str, object]]) -> DataFrame:
    """``consensus`` of slim findings that are still with their file; no shuffle.

    ``files`` has one row per file, as ``file_findings`` leaves it.
    """
    ranks = [
        ((row["sev_rank"] << AGENT_BITS | row["agent_rank"]) << RULE_BITS | row["rule_ordinal"]) << MATCH_BITS for row in labels]
    rank = F.expr(f"array({', '.join(f'{r}L' for r in ranks)})")
    bit = F.expr(f"array({', '.join(str(1 << row['agent_rank']) for row in labels)})")

    def ordered(found: Column) -> Column:
        return F.array_sort(F.transform(found, lambda f: F.struct(
            f["line_number"].alias("line_number"),
            (F.get(rank, f["label"]) + f["match_ordinal"]).alias("packed"),
            F.get(bit, f["label"]).alias("bit"),
            f.alias("finding"))))

    def grouped(entries: Column) -> Column:
        """Neighbours of one line become one; the first speaks."""
        size = F.size(entries)

        def starts_line(i: Column) -> Column:
            return (i == 0) | (F.get(entries, i)["line_number"] != F.get(entries, i - 1)["line_number"])

        def one(starts: Column):
            def group(at: Column, nth: Column) -> Column:
                merged = F.coalesce(F.get(starts, nth + 1), size) - at
                mask = F.aggregate(F.slice(entries, at + 1, merged), F.lit(0), lambda m, e: m.bitwiseOR(e["bit"]))
                return F.struct(
                    F.get(entries, at)["finding"].alias("finding"), mask.alias("mask"), merged.cast("long").alias("merged"))

            return F.transform(starts, group)

        starts = F.filter(F.sequence(F.lit(0), size - 1), starts_line)
        return F.when(size > 0, bound(starts, one))

    spoken = files.select("repo", "path", exploded(bound(ordered(F.col("found")), grouped)).alias("_g")).select(
        "repo", "path", F.col("_g.finding").alias("_f"), F.col("_g.mask").alias("_mask"), F.col("_g.merged").alias("findings_merged"))
    rows = labelled(spoken, labels, "_f", "_mask", "findings_merged")
    columns = [c for c in rows.columns if c not in [*LOCATION, "_mask", "findings_merged"]]
    return rows.select(
        *LOCATION, *columns, F.bit_count("_mask").cast("int").alias("consensus_level"),
        _agents_of(F.col("_mask")).alias("agreeing_agents"), "findings_merged")


def consensus_within(findings: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Variant: findings whose lines lie within ``tolerance`` of their
    neighbours form one island.  ``line_number`` is the representative's line.

    Everything here happens inside a file, so one shuffle by file serves both
    groupings and the window.  Lines are collapsed first; a file, whose size is
    limited, is the largest group there is.
    """
    columns = [c for c in findings.columns if c not in LOCATION]
    lines = findings.repartition("repo", "path").groupBy(*LOCATION).agg(
        _representative(["line_number", *columns]).alias("_rep"),
        F.min(F.struct(*PRECEDENCE)).alias("_best"),
        F.bit_or(_agent_bit()).alias("_mask"),
        F.count("*").alias("findings_merged"),
    )
    by_line = Window.partitionBy("repo", "path").orderBy("line_number")
    gap = F.col("line_number") - F.lag("line_number").over(by_line)
    islands = lines.withColumn("_new", F.when(gap <= tolerance, 0).otherwise(1)).withColumn(
        "_island", F.sum("_new").over(by_line.rowsBetween(Window.unboundedPreceding, 0))
    )
    grouped = islands.groupBy("repo", "path", "_island").agg(
        F.min_by("_rep", F.struct("_best", "line_number")).alias("_rep"),
        F.bit_or("_mask").alias("_mask"),
        F.sum("findings_merged").alias("findings_merged"),
        F.min("line_number").alias("first_line"),
        F.max("line_number").alias("last_line"),
    )
    return _unpack(
        grouped.withColumn("line_number", F.col("_rep")["line_number"]), columns, "first_line", "last_line"
    )


def filter_min_severity(findings: DataFrame, min_severity: str = "MEDIUM") -> DataFrame:
    """Keep findings at least this severe; unknown severities drop out."""
    limit = SEVERITIES.index(check_severity(min_severity))
    return findings.where(F.col("sev_rank") <= limit)


ITEM_COLUMNS = [
    "agent", "agent_rank", "sev_rank", "rule_ordinal", "match_ordinal", "category", "severity", "confidence",
    "line_number", "evidence", "description", "recommendation", "ref_primary", "template_ix", "generated_at",
]


def with_templates(findings: DataFrame, generated_at: str) -> DataFrame:
    """Adds the template index; null where a finding gets no reasoning.

    ``generated_at`` is passed in, so that a run can be repeated exactly.
    """
    return findings.withColumns({
        "template_ix": F.when(
            F.col("severity").isin("CRITICAL", "HIGH"),
            reasoning.template_index(F.col("agent"), F.col("category"), F.col("evidence"))),
        "generated_at": F.lit(generated_at),
    })


def enrich(findings: DataFrame, generated_at: str, agents: list[str] | None = None) -> DataFrame:
    """Each finding with its reasoning record (null below HIGH, and for reviewers other than ``agents`` if given)."""
    marked = with_templates(findings, generated_at).withColumn("_item", F.struct(*ITEM_COLUMNS))
    wanted = F.col("template_ix").isNotNull()
    if agents is not None:
        wanted &= F.col("agent").isin(agents)
    cot = F.when(wanted, reasoning.record(F.col("_item")))
    return computed_once(marked, "cot", cot).drop("_item", "template_ix", "generated_at")


def consensus_with_reasoning(findings: DataFrame, generated_at: str) -> DataFrame:
    """Consensus whose rows carry a reasoning record, merged where reviewers agree.

    Every column that ``consensus`` returns is computed from all rows, as there.
    What travels through the one shuffle is the finding with a template index,
    not the record's text.  Only the list that feeds the merge is short: findings
    of one kind (rule, severity, template, signals) repeat one record, and no
    merge reads past the first ``REPEATS_READ`` of a list, so later repeats of a
    kind are not put into it.
    """
    marked = with_templates(findings, generated_at).repartition(*LOCATION)
    kind = [*LOCATION, "agent", "rule_id", "sev_rank", "template_ix", "_signals"]
    slim = marked.withColumn("_item", F.struct(*ITEM_COLUMNS)).withColumn(
        "_signals",
        F.when(F.col("template_ix").isNotNull(), F.array_join(reasoning.evidence_signals(F.col("_item")), "|"))
        .otherwise(F.lit("")),
    )
    # Window and grouping share the partitioning.
    nth = F.row_number().over(Window.partitionBy(*kind).orderBy("match_ordinal"))
    read = F.col("template_ix").isNotNull() & (F.col("_nth") <= REPEATS_READ)
    columns = [c for c in findings.columns if c not in LOCATION]
    extra = ["template_ix", "generated_at"]
    order = F.struct(*MERGE_ORDER)
    grouped = slim.withColumn("_nth", nth).groupBy(*LOCATION).agg(
        _representative([*columns, *extra]).alias("_rep"),
        F.bit_or(_agent_bit()).alias("_mask"),
        F.count("*").alias("findings_merged"),
        F.array_sort(F.collect_list(
            F.when(read, F.struct(order.alias("o"), F.col("_item").alias("item")))
        )).alias("_items"),
    )
    unpacked = _unpack(grouped, [*columns, *extra], "_items")
    with_records = computed_once(
        unpacked,
        "_records",
        F.transform(
            "_items",
            lambda x: F.struct(
                x["item"]["agent"].alias("agent"), x["o"].alias("o"), reasoning.record(x["item"]).alias("record"))),
    )
    mine = F.struct(*MERGE_ORDER)
    own = F.get(F.filter("_records", lambda r: r["o"] == mine), F.lit(0))["record"]
    merged = merge.merged_record(F.col("_records"), F.col("consensus_level"), F.col("agreeing_agents"))
    cot = F.when((F.col("consensus_level") >= 2) & (F.size("_records") >= 2), merged).otherwise(own)
    return computed_once(with_records, "cot", cot).drop("_items", "_records", "template_ix", "generated_at")
