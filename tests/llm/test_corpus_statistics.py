"""Whitening, line dedup and spelling variants against brute force and numpy."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintlake.llm import line_runs, variants, whitening
from lintlake.llm.tridiagonal import leading_eigenpairs
from tests.compare import duck, duck_rows, rows_of

SF = "/root/testdata/sf0.001"
INF, NAN = float("inf"), float("nan")


# --- whitening -------------------------------------------------------------

@pytest.mark.parametrize("kind", ["plain", "falling", "doubled", "equal"])
@pytest.mark.parametrize("side", [1, 2, 5, 40])
def test_leading_eigenpairs(side, kind):
    draw = np.random.default_rng(side)
    a = draw.standard_normal((3 * side, side))
    if kind == "falling":
        a *= np.logspace(0, -5, side)
    if kind == "doubled":
        a = np.repeat(a[:, :(side + 1) // 2], 2, axis=1)[:, :side]
    matrix = np.eye(side) * 2 if kind == "equal" else a.T @ a
    values, vectors = leading_eigenpairs(matrix, 16)
    norm = np.linalg.norm(matrix, 2)
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:16], rtol=0, atol=1e-13 * norm)
    assert np.abs(matrix @ vectors - vectors * values).max() <= 1e-13 * norm
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() <= 1e-12


def test_whitening_equals_numpy(spark):
    rows = whitening.op11_whitening(spark, SF).toPandas().sort_values(["vec_id", "component"])
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.floor(64 * np.stack(table.embedding).astype(float)).astype(int) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    white = (x - sums / n) @ vectors / np.sqrt(values)
    mine = rows.whitened.to_numpy().reshape(-1, 16)
    signs = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine - white * signs).max() < 1e-8
    assert rows.deviation.to_numpy().reshape(-1, 16).tolist() == np.repeat(((n * x - sums) ** 2).sum(axis=1)[:, None], 16, axis=1).tolist()
    assert np.allclose(rows.explained.to_numpy().reshape(-1, 16), values / np.trace(covariance), rtol=1e-9)
    assert set(rows.n) == {n} and rows.identity_error.nunique() == 1 and rows.identity_error.iloc[0] < 1e-9


def test_whitening_of_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, n string, x string, component string"
    rows = [(1, [0.0, 1.0, 2.0]), (2, [1.0, 1.0, 0.0]), (2, [1.0, 1.0, 0.0]), (None, [2.0, 1.0, 4.0]), (3, None), (4, [1.0, None, 2.0]),
            (5, [1.0, NAN, 2.0]), (6, [INF, 1.0, 2.0]), (7, []), (8, [1.0, 1.0]), (9, [3.0, 1.0, 1.0, 0.0])]
    table = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], schema)
    out = whitening.whitened_rows(table).collect()
    ids = Counter(r["vec_id"] for r in out)
    k = max(r["component"] for r in out)
    # [1, 1, 0] and [1, 1] are one vector; the last dimension never varies.
    assert ids == {1: k, 2: 2 * k, None: k, 7: k, 8: k, 9: k} and {r["n"] for r in out} == {5} and k == 3
    assert out[0]["identity_error"] < 1e-9
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    for frame in (table.limit(0), one, table.where("vec_id in (3, 4, 5, 6)")):
        assert whitening.whitened_rows(frame).collect() == []


def test_whitening_of_huge_entries(spark):
    table = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-5e11, 2.0]), (3, [0.5, 3.0])], "vec_id long, embedding array<double>")
    out = whitening.whitened_rows(table).collect()
    assert {r["vec_id"] for r in out} == {1, 2, 3} and all(r["deviation"] is None for r in out)


# --- line dedup ------------------------------------------------------------

def kept_lines(texts, least_chars, least_documents):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    lines = [(text or "").split("\n") for text in texts]
    counts = Counter(k for each in lines for k in {key(x) for x in each} if len(k) >= least_chars)
    return [(len(each), "\n".join(x for x in each if counts[key(x)] < least_documents)) for each in lines]


def test_lines_equal_sql(spark):
    frame = line_runs.op12_line_dedup(spark, SF)
    columns, rows = duck_rows(duck(SF), line_runs.OP12_SQL)
    assert rows_of(frame.columns, frame.collect()) == rows_of(columns, rows)


@pytest.mark.parametrize("batches,fanout,least_chars,least_documents", [(1, 2, 1, 3), (7, 2, 4, 5), (9, 3, 3, 10)])
def test_lines_of_copies_and_hot_keys(spark, monkeypatch, batches, fanout, least_chars, least_documents):
    # Few rows make a key hot, so both ways of meeting are taken.
    monkeypatch.setattr(line_runs, "HOT_PARTS", 30)
    draw = random.Random(batches)
    pool = ["", " ", "a", "Ünï", " MIXED case\t", "mixed Case", "日本語", *(f"line {i}" for i in range(40))]
    texts = ["\n".join(draw.choices(pool, k=draw.randint(1, 12))) for _ in range(120)]
    texts += ["one text\nof many copies\n" + texts[0]] * 150 + [None, "", "no newline at all"]
    frame = spark.createDataFrame([(i % 200, t, "clash", "clash") for i, t in enumerate(texts)], "doc_id long, text string, line string, salt string")
    rows = line_runs.without_frequent_lines(
        frame, least_chars=least_chars, least_documents=least_documents, batches=batches, fanout=fanout).collect()
    want = kept_lines(texts, least_chars, least_documents)
    assert Counter((r["doc_id"], r["n_lines"], r["kept"]) for r in rows) == Counter((i % 200, n, k) for i, (n, k) in enumerate(want))
    assert all(r["n_dropped"] == r["n_lines"] - (r["kept"].count("\n") + 1) for r in rows if r["kept"] and r["n_lines"] > r["n_dropped"])


def test_runs_count_across_levels(spark):
    runs = line_runs.LineRuns(spark, 6, 2)
    total = Counter()
    for batch in range(5):
        counts = {f"{k:016d}".encode(): 1 + k % 3 for k in range(batch, batch + 20)}
        total.update(counts)
        runs.add(spark.createDataFrame([(k, n) for k, n in counts.items()], "line binary, n long"))
        assert all(len(level) < 2 for level in runs.levels)
    assert {bytes(r["line"]) for r in runs.frequent().collect()} == {k for k, n in total.items() if n >= 6}
    runs.close()


# --- spelling variants -----------------------------------------------------

def edits_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = variants.shared_prefix(a, b)
    return a[at + 1:] == b[at + 1:] if len(a) == len(b) else a[at:] == b[at + 1:]


def test_scan_finds_all_and_only_neighbours():
    draw = random.Random(5)
    for _ in range(400):
        letters = draw.choice(["ab", "abc", "aé\U0001f600"])
        words = sorted({"".join(draw.choices(letters, k=draw.randint(1, 7))) for _ in range(draw.randint(1, 50))})
        shared = [0] + [variants.shared_prefix(a, b) for a, b in zip(words, words[1:])]
        asked = "".join(draw.choices(letters, k=draw.randint(1, 7)))
        found = [words[i] for i in variants.one_edit_apart(asked, words, shared, 0, 0)]
        assert found == [w for w in words if edits_one(asked, w)]


@pytest.mark.parametrize("list_words", [3, 2048])
def test_pairs_are_found_once(spark, list_words):
    draw = random.Random(list_words)
    words = sorted({"".join(draw.choices("abé", k=draw.randint(6, 9))) for _ in range(500)})
    frame = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    found = Counter(tuple(sorted((r["word"], r["other"]))) for r in variants.near_pairs(frame, 6, list_words).collect())
    assert found == Counter((a, b) for i, a in enumerate(words) for b in words[i + 1:] if edits_one(a, b))


def expected_variants(docs, least_chars=6, least_count=5):
    counts = Counter()
    for name, text in docs:
        runs = Counter("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""))
        for word, n in runs.items():
            h = zlib.crc32(f"{'' if name is None else name}:{word}".encode())
            if h % 199 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += n
    words = {w: n for w, n in counts.items() if len(w) >= least_chars and n >= least_count}
    letters = sorted(set("".join(words)))
    out = {}
    for w in words:
        near = {w[:i] + c + w[i + cut:] for i in range(len(w) + 1) for c in ["", *letters] for cut in (0, 1)} - {w}
        near = [x for x in near if x in words]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        out[w] = (best if best and words[best] >= 5 * words[w] else None, len(near))

    def root(w):
        return root(out[w][0]) if out[w][0] else w

    return sorted((w, f, root(w), words[w], k, words[f] if f else None) for w, (f, k) in out.items())


def test_variants_equal_brute_force(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows = sorted(tuple(r) for r in variants.op13_spelling_variants(spark, path).collect())
    want = expected_variants([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert rows == want and len(rows) > 5000 and sum(r[1] is not None for r in rows) > 100


def test_chains_of_forms(spark):
    docs = [(None, None), (1, ""), (1, "abcdefgh " * 5 + "abcdefgx " * 25 + "abcdefyx " * 125 + "abcdezyx " * 625), (1, "ABCDEZYX×÷ abcdezyx÷ " * 700),
            (2, "tie one: abcdeq abcdeq " + "abcdeq " * 4 + "abcder " * 30 + "abcdes " * 30), (3, "x" * 300_000 + " " + "y" * 7)]
    frame = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, word string")
    rows = sorted(tuple(r) for r in variants.spelling_variants(frame).collect())
    assert rows == expected_variants(docs)
    by = {r[0]: r for r in rows}
    assert by["abcdefgh"][2] in ("abcdezyx", "abcdezyx÷", "abcdezyx×÷") and by["abcdefgh"][1] == "abcdefgx"
    assert variants.spelling_variants(frame.limit(0)).collect() == []
    with pytest.raises(ValueError):
        variants.spelling_variants(frame, least_chars=1)


def test_texts_kept_are_what_is_hashed(spark):
    frame = spark.createDataFrame([(i, "shared\nown %d" % i) for i in range(10)] + [(10, None)], "doc_id long, text string")
    rows = line_runs.without_frequent_lines(frame).select("doc_id", F.sha2("kept", 256).alias("h")).collect()
    assert {r["h"] for r in rows} == {hashlib.sha256(t.encode()).hexdigest() for t in [*(f"own {i}" for i in range(10)), ""]}


def test_rounds_cut_fewer_links(spark):
    """Pairs of texts with a passage in common that lie in two shards: fewer with rounds than without, and not more with more."""
    from collections import defaultdict

    from lintlake.llm import sharding

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    held = docs.select("doc_id", F.xxhash64(text).alias("node"), sharding.passages(text).alias("hubs")).collect()

    def cut(rounds):
        shard = {r["doc_id"]: r["shard"] for r in sharding.shards(docs, rounds=rounds).collect()}
        hubs = defaultdict(dict)
        for r in held:
            for h in r["hubs"]:
                hubs[h].setdefault(r["node"], shard[r["doc_id"]])
        pairs = [(len(m) * (len(m) - 1) // 2, sum(v * (v - 1) // 2 for v in Counter(m.values()).values())) for m in hubs.values()]
        return 1 - sum(same for _, same in pairs) / sum(n for n, _ in pairs)

    none, few, more = cut(0), cut(1), cut(sharding.ROUNDS)
    assert few < none and more < none and more <= few + 0.02
