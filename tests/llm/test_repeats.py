"""Repeated spans against every window in a dictionary."""

import random
import re

import pytest

from graphloom.llm import repeats

SCHEMA = "doc_id long, text string, n_words string, block int"


def plain(rows, k):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    starts = {}
    for (i, _), ws in zip(rows, words, strict=True):
        for j in range(len(ws) - k + 1):
            if i is not None:
                w = tuple(ws[j : j + k])
                starts[w] = min(starts.get(w, i), i)
    out = []
    for (i, _), ws in zip(rows, words, strict=True):
        gone = set()
        for j in range(len(ws) - k + 1):
            low = starts.get(tuple(ws[j : j + k]))
            if low is not None and (i is None or low < i):
                gone |= set(range(j, j + k))
        out.append((i, len(ws), len(gone), " ".join(w for j, w in enumerate(ws) if j not in gone)))
    return sorted(out, key=str)


def corpus(seed, n=60, alphabet=3):
    draw = random.Random(seed)
    shared = [[draw.choice("abcdefghij") for _ in range(draw.randint(3, 40))] for _ in range(6)]
    rows = []
    for i in range(n):
        ws = []
        for _ in range(draw.randint(0, 6)):
            ws += draw.choice(shared) if draw.random() < 0.6 else [draw.choice("xyzäé"[:alphabet]) for _ in range(draw.randint(0, 9))]
        rows.append((i if draw.random() < 0.95 else None, draw.choice([" ", "\n", "  \t"]).join(ws)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "one"), (5, rows[7][1]), (7, rows[7][1]), (n + 4, " ".join(["a"] * 3000)), (n + 5, " ".join(["a"] * 50))]


@pytest.mark.parametrize("seed,k", [(1, 3), (2, 5), (3, 5), (5, 2), (6, 13)])
def test_equals_every_window(spark, seed, k):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, repeats.without_repeats(df, k=k).collect()), key=str) == plain(rows, k)


def test_missed_branches_are_compared_by_window(spark, monkeypatch):
    """With 60 node bits the neighbours have three, so one branch in eight is missed: paths that share only a beginning or an end."""
    compared, by_window = [], repeats._windows
    monkeypatch.setattr(repeats, "_windows", lambda *a: compared.append(a) or by_window(*a))
    rows = []
    for i in range(40):
        shared = " ".join(f"s{i}_{j}" for j in range(8))
        tails = [" ".join(f"t{i}_{j}_{v}" for j in range(8)) for v in range(2)]
        for tail in [*tails, *tails] if i % 3 == 0 else tails:
            rows.append((len(rows), f"{shared} {tail}" if i % 2 else f"{tail} {shared}"))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert sorted(map(tuple, repeats.without_repeats(df, k=3, node_bits=60).collect()), key=str) == plain(rows, 3)
    assert compared


def test_several_blocks_and_a_long_text(spark, monkeypatch, docs):
    monkeypatch.setattr(repeats.B, "BLOCK_BYTES", 64)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, repeats.without_repeats(docs).collect()), key=str) == plain(rows, 13)


def test_empty(spark, empty):
    assert repeats.without_repeats(empty).count() == 0


def test_sources_are_the_smallest_documents(spark):
    same = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(9, same, "", 0), (4, f"x {same} y", "", 0), (6, f"{same} z", "", 0)], SCHEMA)
    spans, _ = repeats.repeated_spans(df)
    assert {r.source_id for r in spans.collect()} == {4} and sum(r.edges for r in spans.collect()) == 36
