"""Scores of texts by a causal self-attention model on subword ids.

Three things are gathered from the whole training part of the corpus: how often
each word stands in it, from that how often each subword does, and the windows
of all subwords of every document.  The model is one layer of causal attention
over the ids themselves: every id has its own vector as an input, and as a
target its own path through a Huffman tree of the counts, whose nodes have a
vector each.  A subword's probability is the product of the choices on its path,
so all ids sum to one at the cost of a few nodes.  In training every task goes on
from the common parameters with its windows, and the results are averaged, for
some rounds; a vector is averaged over the tasks that met it.  The arithmetic is
done in the JVM (``vectors``) where the driver can compile for it, else in numpy.

A text is scored in blocks.  Each block of tokens attends to itself and to the
block before, so windows overlap and every token is scored exactly once; the
blocks of many texts are one batch under one mask.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.common import crc, documents, stored, worker_cache
from lintlake.llm.token_counts import model_path
from lintlake.llm.vectors import vectors

WIDTH = 16
# A small vocabulary, as for a model that is tried out.
CLASSES = 64
BLOCK = 16
WINDOW = 2 * BLOCK
# The two vectors after those of the vocabulary, and the id after the last subword's.
BEGIN, PAD, END = -2, -1, -1
ROUNDS, RATE, BATCH = 4, 0.02, 64
# The heaviest nodes, which most paths end in, are met by matrix products; the others one by one.
HEAVY = 128
# Words that stand most often, at most so many, are scored from a table sent to the tasks; the rest by a join.
TABLE_WORDS = 200_000
# Bounds of what a worker holds at once.
COUNTED_AT_ONCE = 300_000
BYTES_AT_ONCE = 4 << 20
BLOCKS_AT_ONCE = 256
# Windows of a task that are drawn from together.
WINDOWS_AT_ONCE = 10_000


def words_of(text: str | None) -> list[bytes]:
    """Words, with A to Z in lower case."""
    return (text or "").encode().lower().split()


def parts(batches: Iterable[pa.RecordBatch], most: int = BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The rows in their order, so many at a time that texts in ``t`` have about ``most`` bytes; a longer text is alone."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("t")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
            yield batch.slice(at, max(1, end - at))
            at += max(1, end - at)


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """What ``words_of`` finds in texts: the distinct words, the place among them of every word in turn, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = split.flatten().dictionary_encode()
    at, each = coded.indices.to_numpy(), split.value_lengths().to_numpy().astype(np.int64)
    # Blanks at the ends of a text leave empty words.
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty >= 0:
        each -= np.bincount(np.repeat(np.arange(len(each)), each)[at == empty], minlength=len(each))
        at = at[at != empty]
        at = at - (at > empty)
        coded = pa.DictionaryArray.from_arrays(
            pa.array([], pa.int32()), pa.concat_arrays([coded.dictionary[:empty], coded.dictionary[empty + 1:]]))
    return coded.dictionary.cast(pa.binary()), at, each


def word_counts(training: DataFrame) -> DataFrame:
    """``(word, n)`` over all texts in ``t``; summed in the tasks before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for part in parts(batches):
            words, at, _ = words_in(part.column("t"))
            held.append(pa.table({"word": words, "n": np.bincount(at, minlength=len(words)).astype(np.int64)}))
            rows += len(words)
            if rows > COUNTED_AT_ONCE:
                held = [_together(held)]
                rows = len(held[0])
                if 2 * rows > COUNTED_AT_ONCE:
                    yield from held[0].to_batches()
                    held, rows = [], 0
        if held:
            yield from _together(held).to_batches()

    return training.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _together(counts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(counts).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])


def _pieces(model: str):
    from sentencepiece import SentencePieceProcessor

    return worker_cache(f"pieces:{model}", lambda: SentencePieceProcessor(model_file=model))


def subword_counts(counts: DataFrame, model: str) -> np.ndarray:
    """How often each subword stands in the counted words; as many numbers as the vocabulary has."""
    size = _pieces(model).get_piece_size()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        pieces = _pieces(model)
        for batch in batches:
            ids = pieces.encode([w.decode() for w in batch.column("word").to_pylist()], num_threads=1)
            times = np.repeat(batch.column("n").to_numpy(), np.fromiter(map(len, ids), np.int64, len(ids)))
            np.add.at(total, np.fromiter(chain.from_iterable(ids), np.int64, len(times)), times)
        kept = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(total[kept])], names=["id", "n"])

    out = np.zeros(size)
    for r in counts.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


class Classes:
    """The vocabulary by falling counts: every subword, and the end as the last id, is a class of its own."""

    def __init__(self, counts: np.ndarray, ends: int):
        smooth = np.append(counts, ends) + 1.0
        order = np.argsort(-smooth, kind="stable")
        self.kind = np.empty(len(smooth), np.int32)
        self.kind[order] = np.arange(len(order), dtype=np.int32)
        self.weight = smooth[order]
        # Natural logarithm of an id's share of its class.
        self.share = np.zeros(len(smooth))


class Encoder:
    """Texts to the classes of their subwords."""

    MARK = "\u2581"

    def __init__(self, model: str, classes: Classes):
        self.pieces, self.classes = _pieces(model), classes
        self.marks = worker_cache(f"marks:{model}", lambda: np.array(
            [self.pieces.id_to_piece(i).count(self.MARK) for i in range(self.pieces.get_piece_size())]))
        # Subwords of frequent words, at most as many as are sent to the tasks.
        self.kept: dict[bytes, list[int]] = worker_cache(f"kept:{model}", dict)

    def text(self, words: list[bytes]) -> np.ndarray:
        """Classes of all subwords and the end.

        Subwords never span words, so words are encoded together.
        """
        ids = self.pieces.encode(b" ".join(words).decode()) if words else []
        ids.append(END)
        return self.classes.kind[ids]

    def texts(self, texts: pa.Array, words: list[bytes], at: np.ndarray, each: np.ndarray, keep: list[bool]) -> list[np.ndarray]:
        """``text`` of many texts, from what ``words_in`` finds in them: each distinct word is encoded once.

        A word that the library gives more than the one space mark before it, or
        none, may join its neighbours; a text with such a word is encoded whole.
        """
        ids = list(map(self.kept.get, words))
        new = [i for i, known in enumerate(ids) if known is None]
        for i, found in zip(new, self.pieces.encode([words[i].decode() for i in new], num_threads=1)):
            ids[i] = found
            if keep[i] and len(self.kept) < TABLE_WORDS:
                self.kept[words[i]] = found
        ids.append([END])
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int64, lengths.sum())
        marks = np.bincount(np.repeat(np.arange(len(ids)), lengths), weights=self.marks[flat], minlength=len(ids))
        ends = np.cumsum(each)
        joins = np.bincount(np.repeat(np.arange(len(each)), each)[(marks != 1)[at]], minlength=len(each))
        line = np.insert(at, ends, len(words))
        run = lengths[line]
        after = np.cumsum(run)
        place = np.repeat((np.cumsum(lengths) - lengths)[line] - (after - run), run) + np.arange(after[-1] if len(after) else 0)
        kinds = np.split(self.classes.kind[flat].take(place), after[ends + np.arange(len(each))][:-1])
        for i in np.flatnonzero(joins):
            kinds[i] = self.text(words_of(texts[i].as_py()))
        return kinds


class Tree:
    """A Huffman tree: what is weighed often has a short path.

    Path ``i`` is ``nodes[start[i]:start[i + 1]]``, with 1 for right and -1 for
    left in ``side``; ``bias`` has each node's logarithmic odds of going right.
    """

    def __init__(self, weight: np.ndarray):
        size = len(weight)
        heap = [(float(w), i) for i, w in enumerate(weight)]
        heapq.heapify(heap)
        parent, side = np.zeros(2 * size - 1, np.int64), np.zeros(2 * size - 1, np.int8)
        self.bias = np.zeros(size - 1, np.float32)
        for node in range(size - 1):
            (left, a), (right, b) = heapq.heappop(heap), heapq.heappop(heap)
            parent[[a, b]], side[[a, b]] = node + size, (-1, 1)
            self.bias[node] = np.log(right / left)
            heapq.heappush(heap, (left + right, node + size))
        paths, at = [], np.arange(size)
        leaf = np.arange(size)
        while len(at):
            inner = at != 2 * size - 2
            at, leaf = at[inner], leaf[inner]
            paths.append((leaf, parent[at] - size, side[at]))
            at = parent[at]
        leaves, nodes, sides = (np.concatenate(x) for x in zip(*paths))
        order = np.argsort(leaves, kind="stable")
        self.nodes, self.side = nodes[order].astype(np.int32), sides[order].astype(np.float32)
        self.start = np.append(0, np.cumsum(np.bincount(leaves, minlength=size)))

    def paths(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(owner, nodes, side, first)`` of the paths of all targets, one after the other."""
        lengths = self.start[targets + 1] - self.start[targets]
        first = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(targets)), lengths)
        at = np.arange(len(owner)) + (self.start[targets] - first).take(owner)
        return owner, self.nodes.take(at), self.side.take(at), first


def laid_out(kinds: bytes | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(inputs, targets)`` of a text: blocks with the block before, padded at both ends."""
    targets = np.frombuffer(kinds, np.uint8) if isinstance(kinds, bytes) else kinds
    blocks = -(-len(targets) // BLOCK)
    line = np.full(BLOCK * (blocks + 1), PAD, np.int32)
    line[BLOCK] = BEGIN
    line[BLOCK + 1:BLOCK + len(targets)] = targets[:-1]
    goal = np.full(BLOCK * blocks, PAD, np.int32)
    goal[:len(targets)] = targets
    return (np.lib.stride_tricks.sliding_window_view(line, WINDOW)[::BLOCK], goal.reshape(blocks, BLOCK))


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows and the sums of their values."""
    if not len(rows):
        return rows, values
    # Two bytes are sorted by radix.
    order = np.argsort(rows.astype(np.uint16) if rows.max() < 1 << 16 else rows, kind="stable")
    ordered = rows.take(order)
    first = _starts(ordered)
    return ordered[first], np.add.reduceat(values.take(order, 0), first, axis=0)


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))


def _ones(rows: np.ndarray) -> np.ndarray:
    """The rows with a last column of ones."""
    out = np.ones((len(rows), rows.shape[1] + 1), np.float32)
    out[:, :-1] = rows
    return out


class Attention:
    """One layer of causal attention over a vocabulary."""

    # Parameters of which a batch meets few rows: vectors of ids, and of nodes with their bias in the last place.
    MANY = ("embed", "out")
    SHAPES = {"place": (WINDOW, WIDTH), "query": (WIDTH, WIDTH), "key": (WIDTH, WIDTH), "value": (WIDTH, WIDTH)}
    # Query i of a block may look at position j of its window.
    MASK = np.arange(WINDOW)[None, :] <= BLOCK + np.arange(BLOCK)[:, None]

    def __init__(self, parameters: dict[str, np.ndarray], tree: Tree):
        self.p, self.tree = parameters, tree
        # In how many steps of training each row of a parameter took part.
        self.steps = {n: np.zeros(len(x), np.int64) for n, x in parameters.items()}

    @classmethod
    def fresh(cls, weight: np.ndarray) -> Attention:
        draw, tree = np.random.default_rng(11), Tree(weight)
        shapes = {"embed": (len(weight) + 2, WIDTH), "out": (len(weight) - 1, WIDTH + 1), **cls.SHAPES}
        p = {n: draw.standard_normal(s).astype(np.float32) * np.float32(0.1) for n, s in shapes.items()}
        p["out"][:, WIDTH] = tree.bias
        return cls(p, tree)

    def table(self) -> np.ndarray:
        """All parameters, one row after the other, with zeros behind the shorter rows."""
        return np.concatenate([np.pad(x, ((0, 0), (0, WIDTH + 1 - x.shape[1]))) for x in self.p.values()])

    def with_table(self, table: np.ndarray) -> Attention:
        """The same model with these parameters."""
        p, at = {}, 0
        for n, x in self.p.items():
            p[n] = table[at:at + len(x), :x.shape[1]].astype(np.float32)
            at += len(x)
        return Attention(p, self.tree)

    def _attend(self, inputs: np.ndarray):
        p = self.p
        x = p["embed"].take(inputs, 0)
        x += p["place"]
        xq = np.ascontiguousarray(x[:, BLOCK:])
        q = xq @ (p["query"] * np.float32(WIDTH ** -0.5))
        kv = x.reshape(-1, WIDTH) @ np.concatenate([p["key"], p["value"]], axis=1)
        k, v = (np.ascontiguousarray(m).reshape(x.shape) for m in (kv[:, :WIDTH], kv[:, WIDTH:]))
        a = q @ k.transpose(0, 2, 1)
        self._weigh(a, inputs, a.size == 0 or max(a.max(), -a.min()) < 60)
        a /= a @ np.ones((WINDOW, 1), np.float32)
        return x, xq, q, k, v, a, a @ v

    def _weigh(self, a: np.ndarray, inputs: np.ndarray, inner: bool) -> None:
        """Makes products of queries and keys weights that need only be divided by their sums; ``inner``: all are in +-60.

        Within that bound exponentials neither overflow nor vanish, so nothing need be subtracted first.
        """
        if not inner:
            a -= np.where(self.MASK & (inputs != PAD)[:, None, :], a, np.float32(-np.inf)).max(axis=2, keepdims=True)
            np.minimum(a, 0, out=a)
        np.exp(a, out=a)
        a *= self.MASK
        # Only a text's first block has padding among what its queries may see.
        first = np.flatnonzero(inputs[:, 0] == PAD)
        a[first] *= (inputs[first] != PAD)[:, None, :]

    def tables(self) -> dict[str, np.ndarray]:
        """Projections of every id and place; sums of two entries are what projecting the sums gives.

        Values have a last column of ones, which sums the weights of attention.
        """
        p, scale = self.p, np.float32(WIDTH ** -0.5)
        ones = lambda m, x: np.concatenate([m, np.full((len(m), 1), x, np.float32)], axis=1)
        t = {
            "q": p["embed"] @ p["query"] * scale, "q_place": p["place"][BLOCK:] @ p["query"] * scale,
            "k": p["embed"] @ p["key"], "k_place": p["place"] @ p["key"],
            "v": ones(p["embed"] @ p["value"], 1), "v_place": ones(p["place"] @ p["value"], 0),
        }
        longest = lambda n: np.abs(t[n]).max() + np.abs(t[f"{n}_place"]).max()
        t["inner"] = WIDTH * longest("q") * longest("k") < 60
        return t

    def log_probabilities(self, inputs: np.ndarray, targets: np.ndarray, tables: dict | None = None) -> np.ndarray:
        """Natural logarithm of each target's probability; 0 at padding."""
        p, t = self.p, tables or self.tables()
        own = inputs[:, BLOCK:]
        q = t["q"].take(own, 0)
        q += t["q_place"]
        k = t["k"].take(inputs, 0)
        k += t["k_place"]
        v = t["v"].take(inputs, 0)
        v += t["v_place"]
        a = q @ k.transpose(0, 2, 1)
        self._weigh(a, inputs, t["inner"])
        seen = a @ v
        h = p["embed"].take(own, 0)
        h += p["place"][BLOCK:]
        h += seen[:, :, :WIDTH] / seen[:, :, WIDTH:]
        goal = targets.ravel().astype(np.int64)
        real = np.flatnonzero(goal != PAD)
        out = np.zeros(len(goal), np.float32)
        if len(real):
            z, first = self._choices(_ones(h.reshape(-1, WIDTH).take(real, 0)), goal.take(real))[:2]
            out[real] = np.add.reduceat(np.minimum(z, 0) - np.log1p(np.exp(-np.abs(z))), first)
        return out.reshape(targets.shape)

    def _choices(self, h: np.ndarray, goal: np.ndarray):
        """Logarithmic odds of the right choice at every node of the targets' paths, and where paths start.

        ``h`` ends in ones.  Nodes are numbered by rising weight.  Then the
        steps of the paths to heavy nodes, as positions in the matrix of targets
        and heavy nodes, and those to others with their owners, nodes and parameters.
        """
        owner, nodes, side, first = self.tree.paths(goal)
        out = self.p["out"]
        light = max(0, len(out) - HEAVY)
        is_heavy = nodes >= light
        heavy, rest = np.flatnonzero(is_heavy), np.flatnonzero(~is_heavy)
        cell = owner.take(heavy) * (len(out) - light) + (nodes.take(heavy) - light)
        owner, nodes = owner.take(rest), nodes.take(rest)
        met = out.take(nodes, 0)
        z = np.empty(len(side), np.float32)
        z[heavy] = (h @ out[light:].T).ravel().take(cell)
        z[rest] = np.einsum("ij,ij->i", h.take(owner, 0), met)
        z *= side
        return z, first, side, light, (heavy, cell), (rest, owner, nodes, met)

    def gradient(self, inputs: np.ndarray, targets: np.ndarray) -> dict[str, np.ndarray]:
        whole = {}
        for n, (rows, g) in self.gradient_rows(inputs, targets).items():
            whole[n] = np.zeros_like(self.p[n])
            whole[n][rows] = g
        return whole

    def gradient_rows(self, inputs: np.ndarray, targets: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """For each parameter the rows that the batch meets and their gradients."""
        p = self.p
        x, xq, q, k, v, a, seen = self._attend(inputs)
        goal = targets.ravel().astype(np.int64)
        real = np.flatnonzero(goal != PAD)
        h = _ones((xq + seen).reshape(-1, WIDTH).take(real, 0))
        z, _, side, light, (heavy, cell), (rest, owner, nodes, met) = self._choices(h, goal.take(real))
        d = -side / (1 + np.exp(np.clip(z, -60, 60))) / np.float32(max(1, len(real)))
        out = p["out"][light:]
        dense = np.zeros(len(h) * len(out), np.float32)
        dense[cell] = d.take(heavy)
        dense = dense.reshape(len(h), len(out))
        heavy_met = np.flatnonzero(np.bincount(cell % max(1, len(out)), minlength=len(out)))
        d = d.take(rest)[:, None]
        nodes_met, g_out = _summed(nodes, d * h.take(owner, 0))
        dh = dense @ out
        if len(owner):
            first = _starts(owner)
            dh[owner[first]] += np.add.reduceat(d * met, first, axis=0)
        every = np.zeros((goal.size, WIDTH), np.float32)
        every[real] = dh[:, :WIDTH]
        dh = every.reshape(xq.shape)
        da = dh @ v.transpose(0, 2, 1)
        dv = a.transpose(0, 2, 1) @ dh
        da -= (dh * seen) @ np.ones((WIDTH, 1), np.float32)
        da *= a
        dq, dk = da @ k * np.float32(WIDTH ** -0.5), da.transpose(0, 2, 1) @ q
        rows = lambda m: m.reshape(-1, WIDTH)
        dx = rows(dk) @ p["key"].T
        dx += rows(dv) @ p["value"].T
        dx = dx.reshape(x.shape)
        dx[:, BLOCK:] += dh + dq @ p["query"].T
        g = {
            "place": dx.sum(axis=0), "query": rows(xq).T @ rows(dq), "key": rows(x).T @ rows(dk), "value": rows(x).T @ rows(dv)}
        return {
            "embed": _summed(inputs.ravel() % len(p["embed"]), rows(dx)),
            "out": (np.append(nodes_met, heavy_met + light), np.concatenate([g_out, (dense.T @ h)[heavy_met]])),
            **{n: (slice(None), m) for n, m in g.items()}}

    def train(self, inputs: np.ndarray, targets: np.ndarray, rate: float, seed: int, batch: int = BATCH) -> None:
        """One pass of Adam over the windows, in drawn order; a row moves in the steps that meet it."""
        order = np.random.default_rng(seed).permutation(len(inputs))
        # The small parameters, all of whose rows move in every step, are parts of one table.
        small = np.concatenate([self.p[n] for n in self.SHAPES])
        ends = np.cumsum([len(self.p[n]) for n in self.SHAPES])
        for n, end in zip(self.SHAPES, ends):
            self.p[n] = small[end - len(self.p[n]):end]
        tables = {**{n: self.p[n] for n in self.MANY}, "small": small}
        first = {n: np.zeros_like(x) for n, x in tables.items()}
        second = {n: np.zeros_like(x) for n, x in tables.items()}
        steps = {n: np.zeros(len(self.p[n]), np.int64) for n in self.MANY}
        at = np.arange(-(-len(order) // batch) + 1, dtype=np.float32)[:, None]
        scale, scale2 = 1 - np.float32(0.9) ** at, 1 - np.float32(0.99) ** at
        for number, start in enumerate(range(0, len(order), batch), 1):
            part = order[start:start + batch]
            met = self.gradient_rows(inputs.take(part, 0), targets.take(part, 0))
            for n in self.MANY:
                rows, g = met[n]
                step = steps[n].take(rows) + 1
                steps[n][rows] = step
                m = first[n].take(rows, 0) * np.float32(0.9) + np.float32(0.1) * g
                s = second[n].take(rows, 0) * np.float32(0.99) + np.float32(0.01) * g * g
                first[n][rows], second[n][rows] = m, s
                m /= scale.take(step, 0)
                s /= scale2.take(step, 0)
                tables[n][rows] = tables[n].take(rows, 0) - np.float32(rate) * m / (np.sqrt(s) + np.float32(1e-6))
            g, m, s = np.concatenate([met[n][1] for n in self.SHAPES]), first["small"], second["small"]
            m *= np.float32(0.9)
            m += np.float32(0.1) * g
            s *= np.float32(0.99)
            s += np.float32(0.01) * g * g
            small -= np.float32(rate) * (m / scale[number]) / (np.sqrt(s / scale2[number]) + np.float32(1e-6))
        for n in self.p:
            self.steps[n] += steps[n] if n in self.MANY else len(at) - 1

    def text(self, kinds: bytes | np.ndarray) -> float:
        return self.texts([kinds])[0]

    def texts(self, kinds: list[bytes] | list[np.ndarray], tables: dict | None = None) -> list[float]:
        """Summed logarithms of the targets of several texts, a bounded number of blocks at a time."""
        laid = [laid_out(k) for k in kinds]
        owner = np.repeat(np.arange(len(laid)), [len(x) for x, _ in laid])
        inputs = np.concatenate([x for x, _ in laid])
        targets = np.concatenate([t for _, t in laid])
        tables = tables or self.tables()
        each = np.concatenate([
            self.log_probabilities(inputs[i:i + BLOCKS_AT_ONCE], targets[i:i + BLOCKS_AT_ONCE], tables).sum(axis=1, dtype=np.float64)
            for i in range(0, len(inputs), BLOCKS_AT_ONCE)])
        return np.bincount(owner, weights=each, minlength=len(laid)).tolist()


def _stored_as(classes: Classes) -> type:
    """What a text's classes are stored as; windows, thrice as many numbers, are laid out where they are read."""
    return np.uint16 if len(classes.kind) <= 1 << 16 else np.int32


def windows_of(texts: Iterable[np.ndarray], most: int = WINDOWS_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Inputs and targets of all blocks of the texts in their order, ``most`` at a time and what is left."""
    waiting, held = [], 0
    for kinds in texts:
        x, y = laid_out(kinds)
        while len(x):
            taken = most - held
            waiting.append((x[:taken], y[:taken]))
            held += len(waiting[-1][0])
            x, y = x[taken:], y[taken:]
            if held == most:
                yield tuple(map(np.concatenate, zip(*waiting)))
                waiting, held = [], 0
    if waiting:
        yield tuple(map(np.concatenate, zip(*waiting)))


def training_windows(training: DataFrame, model: str, classes: Classes) -> DataFrame:
    """``(x, y)``, inputs and targets: every block of every training document, so each subword is a target once."""
    shared = training.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model, shared.value)
        for rows in windows_of(encoder.text(words_of(text.as_py())) for batch in batches for text in batch.column("t")):
            yield pa.RecordBatch.from_arrays([_lists(r) for r in rows], names=["x", "y"])

    return training.mapInArrow(run, "x array<int>, y array<int>")


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(
        pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(np.ascontiguousarray(rows).ravel()))


def _read(column: pa.Array, stored_as: type) -> Iterator[np.ndarray]:
    return (np.frombuffer(kinds.as_buffer(), stored_as) for kinds in column)


def train(texts: DataFrame, classes: Classes, rounds: int = ROUNDS) -> Attention:
    """Rounds of training in the tasks, over every block of the texts whose classes are in ``kinds``, and averaging of what they reach.

    Each row of the parameters is averaged by the steps that met it.
    """
    spark, model, stored_as = texts.sparkSession, Attention.fresh(classes.weight), _stored_as(classes)
    places, fast = [f"v{i}" for i in range(WIDTH + 1)], vectors(spark)
    moved_schema = f"row long, steps long, {', '.join(f'{v} double' for v in places)}"
    for round_ in range(rounds):
        shared, rate = None if fast else spark.sparkContext.broadcast(model), RATE / (1 + round_)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start = shared.value.table()
            own = shared.value.with_table(start)
            for x, y in windows_of(kinds for batch in batches for kinds in _read(batch.column("kinds"), stored_as)):
                own.train(x, y, rate, round_)
            steps = np.concatenate(list(own.steps.values()))
            met = np.flatnonzero(steps)
            moved = (own.table()[met].astype(np.float64) - start[met]) * steps[met, None]
            yield pa.RecordBatch.from_arrays(
                [pa.array(met), pa.array(steps[met]), *(pa.array(column) for column in np.ascontiguousarray(moved.T))],
                names=["row", "steps", *places])

        if fast:
            moves = fast.moves(texts, model, stored_as, rate, round_, BATCH, WINDOWS_AT_ONCE, moved_schema)
        else:
            moves = texts.mapInArrow(run, moved_schema)
        # As many rows as the model has.
        summed = moves.groupBy("row").agg(F.sum("steps").alias("steps"), *[F.sum(v).alias(v) for v in places]).toArrow()
        if not summed.num_rows:
            break
        table = model.table().astype(np.float64)
        moved = np.stack([summed.column(v).to_numpy() for v in places], axis=1)
        table[summed.column("row").to_numpy()] += moved / summed.column("steps").to_numpy()[:, None]
        model = model.with_table(table)
    return model


def frequent_words(counts: DataFrame, most: int = TABLE_WORDS) -> tuple[int, dict[bytes, int]]:
    """The words that stand at least ``least`` times, for the smallest power of two that leaves at most ``most``."""
    levels = {r["level"]: r["n"] for r in counts.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count("*").alias("n")).collect()}
    level, total = max(levels, default=0) + 1, 0
    while level > 0 and total + levels.get(level - 1, 0) <= most:
        level -= 1
        total += levels.get(level, 0)
    return 1 << level, {bytes(r["word"]): r["n"] for r in counts.where(F.col("n") >= 1 << level).collect()}


def scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, table_words: int = TABLE_WORDS,
) -> DataFrame:
    """Base and model scores of every whole text, as log10 probabilities.

    Rows whose crc32 of the id modulo 7 is 2 are held out of all learning; a
    null id is not held out.  A null or empty text has one token, its end;
    repeated rows count and are scored one by one; an empty table gives an empty
    result.  Other columns are not read.
    """
    spark = docs.sparkSession
    path = model or model_path()
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("t"),
        F.coalesce(F.pmod(crc(id_col), F.lit(7)) == 2, F.lit(False)).alias("held_out"))
    training = rows.where(~F.col("held_out")).select("t")
    counts = stored(word_counts(training), "words")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = training.count()
    tokens, distinct = sums["n"] + ends, sums["v"] + (1 if ends else 0)
    classes = Classes(subword_counts(counts, path), ends)
    least, table = frequent_words(counts, table_words)
    shared = spark.sparkContext.broadcast(({w: float(np.log10(n + 1)) for w, n in table.items()}, classes))
    stored_as = _stored_as(classes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, own = shared.value
        encoder = Encoder(path, own)
        key = TaskContext.get().partitionId() << 33
        for part in parts(batches):
            words, at, each = words_in(part.column("t"))
            listed = words.to_pylist()
            log = np.fromiter((logs.get(w, 0.0) for w in listed), np.float64, len(listed))
            owner = np.repeat(np.arange(len(each)), each)
            sums = lambda values: np.bincount(owner, weights=values[at], minlength=len(each))
            # Each rare word of each text, and how often it stands there.
            rare, times = np.unique((owner * len(words) + at)[log[at] == 0], return_counts=True)
            texts_of, words_at = np.divmod(rare, max(1, len(words)))
            kinds = encoder.texts(part.column("t"), listed, at, each, (log > 0).tolist())
            yield pa.RecordBatch.from_arrays([
                part.column("id"), part.column("held_out"), pa.array(np.arange(key + 1, key + 1 + len(each))),
                pa.array(each + 1), pa.array(sums(log > 0).astype(np.int64)), pa.array(sums(log).astype(np.float64)),
                pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(np.bincount(texts_of, minlength=len(each)))).astype(np.int32)),
                    pa.StructArray.from_arrays([words.take(pa.array(words_at)), pa.array(times)], names=["word", "n"])),
                pa.array([k.astype(stored_as).tobytes() for k in kinds], pa.binary())],
                names=["id", "held_out", "key", "n_tokens", "known", "logs", "rare", "kinds"])
            key += len(each)

    # Texts are encoded once, for training and for scores.
    base_columns = f"id {kind}, held_out boolean, key long, n_tokens long, known long, logs double"
    texts = stored(rows.mapInArrow(read, f"{base_columns}, rare array<struct<word:binary,n:long>>, kinds binary"), "texts")
    trained, fast = train(texts.where(~F.col("held_out")).select("kinds"), classes), vectors(spark)
    attention = None if fast else spark.sparkContext.broadcast(trained)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = attention.value
        tables = scorer.tables()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                natural = np.array(scorer.texts(list(_read(part.column("kinds"), stored_as)), tables))
                yield part.drop_columns(["kinds"]).append_column("score", pa.array(natural / np.log(10)))

    if fast:
        scored = texts.select("*", (fast.score("kinds", trained, stored_as) / float(np.log(10))).alias("score")).drop("rare", "kinds")
    else:
        scored = texts.drop("rare").mapInArrow(score, f"{base_columns}, score double")
    partial = stored(scored, "partial")
    rare = (
        texts.select("key", F.inline("rare").alias("word", "k"))
        .join(counts.where(F.col("n") < least), "word")
        .groupBy("key").agg(F.sum("k").alias("more_known"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("more_logs")))
    joined = partial.join(rare, "key", "left")
    end_known, end_log = (1, float(np.log10(ends + 1))) if ends else (0, 0.0)
    base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + end_log - F.col("n_tokens") * float(np.log10(tokens + distinct + 1))
    return joined.select(
        F.col("id").alias(id_col), "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0)) + end_known).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(documents(spark, sf_dir))

