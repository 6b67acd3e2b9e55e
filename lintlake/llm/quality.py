"""Quality by a generalised additive model with pairwise interactions.

Every feature of a text has a lookup table over its bins, and some pairs of
features have a table over both.  The tables are sums of shallow trees, boosted
in turn, one feature after the other, at a small rate.  A score is the sum of
the entries a text falls into, passed through the logistic function.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lintlake.llm.boosting import binned, cut_points, grid_tree, line_tree, sigmoid
from lintlake.llm.common import crc, documents, drawn

# The model is fitted on about so many labelled rows, at most twice as many, drawn by the hash of their id.
FIT_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 80, 40, 0.15

NAMES = (
    "words", "word_length", "distinct", "neighbours_alike", "top_word", "repeated_windows", "upper", "digits", "marks",
    "symbols", "pipes", "exclaims", "stops", "line_words", "repeated_lines", "foreign", "longest_word", "symbol_words",
)


def measures(text: str | None) -> tuple[float, ...]:
    """Features of a whole text, zero where it has nothing to measure."""
    data = (text or "").encode()
    words = data.lower().split()
    if not words:
        return (0.0,) * len(NAMES)
    n, size = len(words), max(1, len(data))
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    letters = max(1, int(seen[65:91].sum() + seen[97:123].sum()))
    tops = Counter(words)
    windows = list(zip(words, words[1:], words[2:]))
    lines = [line for line in data.split(b"\n") if line.strip()]
    symbols = int(seen[[35, 36, 37, 38, 42, 60, 62]].sum())
    return (
        float(np.log1p(n)), sum(map(len, words)) / n, len(tops) / n, sum(map(eq, words, words[1:])) / n,
        max(tops.values()) / n, 1 - len(set(windows)) / len(windows) if windows else 0.0, seen[65:91].sum() / letters,
        seen[48:58].sum() / size, (seen[44] + seen[58] + seen[59]) / n, symbols / size, seen[124] / n, seen[33] / n,
        seen[46] / n, n / len(lines), 1 - len(set(lines)) / len(lines), seen[128:].sum() / size,
        float(np.log1p(max(map(len, words)))), sum(w[-1] in b"#$%&*!|" for w in words) / n)


class AdditiveModel:
    """Lookup tables of single features and of pairs of features."""

    def fit(self, features: np.ndarray, labels: np.ndarray) -> AdditiveModel:
        mean = float(labels.mean()) if len(labels) else 0.5
        mean = min(max(mean, 1e-3), 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        width = features.shape[1]
        self.cuts = [cut_points(features[:, i], BINS) for i in range(width)]
        self.pair_cuts = [cut_points(features[:, i], PAIR_BINS) for i in range(width)]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int]] = []
        self.grids: list[np.ndarray] = []
        if len(np.unique(labels)) < 2:
            return self
        bins = binned(features, self.cuts)
        score = np.full(len(labels), self.start)
        for _ in range(ROUNDS):
            for f, table in enumerate(self.tables):
                p = sigmoid(score)
                g = np.bincount(bins[:, f], weights=labels - p, minlength=len(table))
                h = np.bincount(bins[:, f], weights=p * (1 - p), minlength=len(table))
                step = RATE * line_tree(g, h)
                table += step
                score += step[bins[:, f]]
        coarse = binned(features, self.pair_cuts)
        self.pairs = self._best_pairs(coarse, labels, score)
        shapes = [(len(self.pair_cuts[i]) + 1, len(self.pair_cuts[j]) + 1) for i, j in self.pairs]
        self.grids = [np.zeros(s) for s in shapes]
        for _ in range(PAIR_ROUNDS):
            for (i, j), grid in zip(self.pairs, self.grids):
                step = RATE * grid_tree(*self._sums(coarse, labels, score, i, j))[1]
                grid += step
                score += step[coarse[:, i], coarse[:, j]]
        return self

    def _sums(self, coarse, labels, score, i, j):
        p = sigmoid(score)
        shape = (len(self.pair_cuts[i]) + 1, len(self.pair_cuts[j]) + 1)
        cell = coarse[:, i] * shape[1] + coarse[:, j]
        return (np.bincount(cell, weights=w, minlength=shape[0] * shape[1]).reshape(shape)
                for w in (labels - p, p * (1 - p)))

    def _best_pairs(self, coarse, labels, score):
        gains = [(grid_tree(*self._sums(coarse, labels, score, i, j))[0], i, j)
                 for i, j in combinations(range(coarse.shape[1]), 2)]
        return [(i, j) for gain, i, j in sorted(gains, reverse=True)[:PAIRS] if gain > 0]

    def score(self, features: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        bins, coarse = binned(features, self.cuts), binned(features, self.pair_cuts)
        total = np.full(len(features), self.start)
        for f, table in enumerate(self.tables):
            total += table[bins[:, f]]
        for (i, j), grid in zip(self.pairs, self.grids):
            total += grid[coarse[:, i], coarse[:, j]]
        return sigmoid(total)


def _feature_rows(texts: list) -> np.ndarray:
    return np.array([measures(t) for t in texts], np.float64).reshape(-1, len(NAMES))


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    fit_rows: int = FIT_ROWS,
) -> AdditiveModel:
    """The model of labelled rows, about ``fit_rows`` of them, at most twice as many.

    Labels of rows held out (crc32 of the id modulo 3 is 1) are never read.
    The chosen labels are a bounded table, so they are broadcast to the texts.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (F.pmod(crc(id_col), F.lit(3)) != 1))
        .select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
        .groupBy("id").agg(F.max("y").alias("y")))
    chosen = drawn(known, "id", fit_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _feature_rows(batch.column("t").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), pa.array(rows.tolist(), pa.list_(pa.float64()))], names=["y", "x"])

    found = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "id")
        .select("y", "t").mapInArrow(run, "y int, x array<double>").toPandas())
    features = np.array(found["x"].tolist(), np.float64).reshape(-1, len(NAMES))
    order = np.lexsort([*features.T, found["y"]]) if len(found) else slice(None)
    return AdditiveModel().fit(features[order], found["y"].to_numpy(np.float64)[order])


def quality_scores(docs: DataFrame, model: AdditiveModel, columns: list[str], text_col: str = "text") -> DataFrame:
    """The given columns of every row and ``score``; one narrow pass."""
    source = docs.select(*columns, F.col(text_col).alias("__text"))
    out = source.select(*columns, F.lit(0.0).alias("score")).schema
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                scores = model.score(_feature_rows(part.column(part.num_columns - 1).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scores)], schema=schema)

    return source.mapInArrow(run, out)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score of every text and the label it predicts.

    Null and empty texts measure zero everywhere and get the score of that;
    repeated rows and null ids are kept (null ids are not held out); an empty
    table gives an empty result; without labels every score is one half.
    Neither labels nor other columns enter a score.
    """
    model = fit_quality(docs, labels, id_col, text_col)
    return quality_scores(docs, model, [id_col], text_col).select(
        id_col, F.coalesce(F.pmod(crc(id_col), F.lit(3)) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
