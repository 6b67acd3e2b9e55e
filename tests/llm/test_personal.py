"""The base against an independent scan, and the judge against planted truth."""

from __future__ import annotations

import hashlib
import random
import re
import time

import pytest

from lintlake.llm import personal
from lintlake.llm.personal_cases import planted

SF = "/root/testdata/sf0.01"
# The patterns as the contract has them.
CONTRACT = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def expected(text):
    spans = []
    for order, (kind, pattern) in enumerate(CONTRACT):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))
                    or kind == "card" and 12 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15)
            if good:
                spans.append((m.start(), order, kind, m.end()))
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(spans)]


@pytest.fixture(scope="module")
def judge(spark):
    return personal.fit_judge(spark.read.parquet(f"{SF}/documents.parquet"))


def test_base_equals_an_independent_scan(spark, judge):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in personal.personal_data(docs, judge).collect():
        spans = expected(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s.startswith(k) for s in spans) for k, _ in CONTRACT]
        assert set(spans) <= set(r["spans"].split(","))


@pytest.mark.parametrize("chars", ["a1.@-_ ", "12.", "12 -+(.", "@.a", "1.2@a%"])
def test_base_of_random_texts(chars):
    draw = random.Random(3)
    for _ in range(3000):
        text = "".join(draw.choice(chars) for _ in range(draw.randint(0, 40)))
        assert personal.joined(personal.base_spans(text)) == ",".join(expected(text)), text


@pytest.mark.parametrize("unit", ["7", "a", "ab12", "1.", "a@", "1-", "@a.b ", "+1 ", "1 0"])
def test_long_runs_take_linear_time(judge, unit):
    text = unit * (1_000_000 // len(unit)) + ".x @ (at) +"
    begun = time.process_time()
    personal.base_spans(text)
    assert time.process_time() - begun < 5
    begun = time.process_time()
    personal.all_spans(text[-100_000:], judge)
    assert time.process_time() - begun < 20


@pytest.mark.parametrize("value", [
    "2021-03-12 12:30:11", "1914-1918 1939-1945", "52.520008 13.404954", "1 000 000 000", "ISBN 978-3-16-148410-0",
    "version 10.20.30.400", "commit 3f786850e387550fdab836ed7e6dc881de23001b", "src/main_widget_case_2021", "12 @ 300"])
def test_lookalikes_are_left_alone(judge, value):
    text = f"There were some of them on the way, {value}, and so it went on."
    assert personal.all_spans(text, judge)[1] == []


def measured(spark, judge, seed=99):
    """Right, found and wanted of each added kind, over cases in other documents' surroundings."""
    tally = {}
    for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 7 = 3").select("doc_id", "text").collect():
        for around, start, end, kind, truth in planted(r["text"] or "", seed + r["doc_id"], personal.AROUND, 3):
            base, spans = personal.all_spans(around, judge)
            if any(b.start < end and start < b.end for b in base):
                continue
            hit = any(s.start < end and start < s.end for s in spans)
            right, found, wanted = tally.get(kind, (0, 0, 0))
            tally[kind] = (right + (hit and truth), found + hit, wanted + truth)
    return {kind: (right / max(1, found), right / max(1, wanted)) for kind, (right, found, wanted) in tally.items()}


def test_precision_and_recall_on_planted_truth(spark, judge):
    for kind, (precision, recall) in measured(spark, judge).items():
        print(kind, round(precision, 3), round(recall, 3))
        assert precision > 0.9 and recall > 0.8, kind
