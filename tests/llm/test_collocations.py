"""Automata against counts in dictionaries, and collocations against a plain version."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import automata, collocations
from graphloom.llm import blocks as B

SCHEMA = "doc_id long, text string, lang string, a string, score int"


def sequences(seed, n=400, m=4, words=6):
    draw = random.Random(seed)
    found = Counter(tuple(draw.choices(range(1, words), k=draw.randint(1, m))) for _ in range(n))
    rows = sorted((*s, *[0] * (m - len(s))) for s in found)
    return np.array(rows), np.array([found[tuple(x for x in r if x)] for r in rows]), found


def prefixes(found):
    out = Counter()
    for s, n in found.items():
        for i in range(1, len(s) + 1):
            out[s[:i]] += n
    return out


def padded(keys, m):
    return np.array([[*k, *[0] * (m - len(k))] for k in keys])


@pytest.mark.parametrize("seed", range(4))
def test_automaton_weighs_prefixes_and_merges_states(seed):
    rows, counts, found = sequences(seed)
    a = automata.Automaton.from_bytes(automata.build(rows, counts).to_bytes())
    want = prefixes(found)
    assert a.compose(padded(want, 4)).tolist() == list(want.values())
    assert a.compose(np.array([[9, 0, 0, 0], [1, 9, 0, 0], [1, 1, 1, 99], [0, 0, 0, 0]])).tolist() == [0, 0, 0, 0]
    assert len(a.sizes) < len(want) / 2
    states = [tuple(zip(a.label[s:e], a.weight[s:e], a.target[s:e], strict=True)) for s, e in zip(a.first[:-1], a.first[1:], strict=True)]
    assert states[0] == () and sum(not s for s in states) == 1


def test_automaton_of_nothing():
    a = automata.build(np.zeros((0, 3), np.int64), np.zeros(0, np.int64))
    assert a.compose(np.array([[1, 2, 0]])).tolist() == [0]


def test_union_sums_and_leaves_what_is_rare_but_for_borders():
    parts = [sequences(s, 150) for s in range(3)]
    border = np.array([[2, 3, 1, 0]])
    total = sum((prefixes(f) for _, _, f in parts), Counter())
    paths, weights, partial = automata.union([automata.build(r, c) for r, c, _ in parts], 12, border)
    got = {tuple(p): (w, b) for ps, ws, bs in zip(paths, weights, partial, strict=True) for p, w, b in zip(ps.tolist(), ws.tolist(), bs.tolist(), strict=True)}
    onborder = {(2,), (2, 3), (2, 3, 1)}
    assert got == {k: (n, k in onborder) for k, n in total.items() if n >= 12 or k in onborder}


def plain(rows, longest, least, inside, top):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for m in range(1, longest + 1):
                for i in range(len(ws) - m + 1):
                    f[lang, tuple(ws[i : i + m])] += 1
    cand = {k: c for k, c in f.items() if len(k[1]) > 1 and c >= least}
    gone = {(lang, p[i:j]) for (lang, p), c in cand.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * c >= inside * f[lang, p[i:j]]}
    out = {}
    for (lang, p), a in cand.items():
        if (lang, p) not in gone:
            s, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, ps in out.items() for i, (s, a, p, left, right) in enumerate(sorted(ps)[:top]))


def corpus(seed, n=150):
    draw = random.Random(seed)
    common = [["New", "york", "stock", "exchange"], ["ÉTÉ", "indien"], ["a", "b", "c", "d", "e", "f"], ["the"] * 4]
    rows = []
    for _ in range(n):
        ws = []
        for _ in range(draw.randint(0, 12)):
            ws += draw.choice(common) if draw.random() < 0.4 else draw.choices(["the", "a", "of", "x", "Y", "zz"], k=draw.randint(1, 4))
            if draw.random() < 0.3:
                ws.append(draw.choice([".", ",", "\n", "!?", "w:w"]))
        rows.append((draw.choice([" ", "  ", "\t"]).join(ws), draw.choice(["en", "en", "en", "fr", None, "und"])))
    return [*rows, (None, "en"), ("", "de"), (" \n.", None), ("the " * 5000, "xx"), *[("Same text, the same text", "en")] * 7]


@pytest.mark.parametrize("seed,longest,least,inside,top", [(1, 5, 5, 100, 2000), (2, 3, 2, 60, 40), (3, 4, 9, 100, 5)])
def test_collocations_equal_a_plain_version(spark, monkeypatch, seed, longest, least, inside, top):
    """In small blocks, shards and ranges, so that the most frequent word's contexts lie in several ranges."""
    monkeypatch.setattr(B, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(collocations, "SHARD", 300)
    monkeypatch.setattr(collocations, "RANGE", 400)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], SCHEMA).repartition(3)
    found = collocations.collocations(df, longest=longest, least=least, inside=inside, top=top)
    assert sorted(map(tuple, found.collect())) == plain(rows, longest, least, inside, top)


def test_nothing_frequent_and_no_rows(spark, docs, empty):
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(docs.where("doc_id = 8")).count() == 0
    assert collocations.collocations(docs, least=2).count() > 0
