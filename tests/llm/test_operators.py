"""Each operator against a plain version, on awkward rows and on empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm import jaccard, language_model, mixing, neighbours, packing, quality, queries, secrets, sharding, sketch, tokens
from graphloom.llm.common import table

from .conftest import ROWS

LOWER = {c: c + 32 for c in range(65, 91)}


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def shingles(t, k):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}


def test_op1_matches_brute_force(spark, sf_dir):
    own = {d: shingles(t, 4) for d, t in texts(spark, sf_dir).items()}
    top = {d: d for d in own}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(own)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(own[a] & own[b])
            if n and 100 * n >= 85 * (len(own[a]) + len(own[b]) - n):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    got = queries.op1_ngram_jaccard_join(spark, sf_dir).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(d, len(own[d]), root(d)) for d in ids}


def test_op1_awkward_rows(docs, empty):
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.join_components(docs, shingle=4, percent=85).collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6), (7, 7), (8, 8), (9, 8), (None, None)} <= got
    assert jaccard.join_components(empty).count() == 0


def test_op2_base_and_model(spark, sf_dir, docs, empty):
    own = texts(spark, sf_dir)
    got = {r["doc_id"]: r for r in queries.op2_lm_scoring(spark, sf_dir).collect()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in own}
    toks = {d: [*words(t), None] for d, t in own.items()}
    c = Counter(w for d, ws in toks.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    for d, ws in toks.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert language_model.score_texts(docs).count() == len(ROWS)
    assert language_model.score_texts(empty).count() == 0


def test_op2_rare_words_outside_the_trie(spark, sf_dir):
    whole = {r["doc_id"]: r for r in queries.op2_lm_scoring(spark, sf_dir).collect()}
    few = {r["doc_id"]: r for r in language_model.score_texts(table(spark, sf_dir, "documents"), top_words=50).collect()}
    assert all(few[d]["n_known"] == r["n_known"] and math.isclose(few[d]["base_score"], r["base_score"], rel_tol=1e-9) for d, r in whole.items())


def trigram_scores(own, held):
    """op2's model with plain dictionaries."""
    seqs = {d: [*words(t), None] for d, t in own.items()}
    c = Counter(w for d, s in seqs.items() if not held[d] for w in s)
    norm = sum(c.values()) + 0.1 * (len(c) + 1)
    two, three = defaultdict(Counter), defaultdict(Counter)
    for d, s in seqs.items():
        for u, v, w in zip(["<s>", *s], s, s[1:], strict=False):
            if not held[d]:
                two[v][w] += 1
                three[u, v][w] += 1

    def mixed(seen, w, lower):
        return (max(seen[w] - 0.75, 0) + 0.75 * len(seen) * lower) / sum(seen.values()) if seen else lower

    share = lambda w: (c[w] + 0.1) / norm
    return {d: math.log10(share(s[0])) + sum(math.log10(mixed(three[u, v], w, mixed(two[v], w, share(w)))) for u, v, w in zip(["<s>", *s], s, s[1:], strict=False)) for d, s in seqs.items()}


def zipf_texts(spark):
    rng = np.random.default_rng(5)
    own = {d: " ".join(f"w{min(int(x), 400)}" for x in rng.zipf(1.6, int(rng.integers(0, 80)))) for d in range(120)}
    return own, spark.createDataFrame(list(own.items()), "doc_id long, text string").repartition(3)


def assert_scores(frame, own, **how):
    want = trigram_scores(own, {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in own})
    for r in language_model.score_texts(frame, **how).collect():
        # each token's score is a sum of at most three codes
        assert abs(r["score"] - want[r["doc_id"]]) <= r["n_tokens"] * 1.6 / language_model.STEP


@pytest.mark.parametrize("part_tokens", [200, 1 << 21])
def test_op2_split_words_have_all_their_pairs(spark, part_tokens):
    own, frame = zipf_texts(spark)
    assert_scores(frame, own, part_tokens=part_tokens)


@pytest.mark.parametrize(("top_words", "part_tokens"), [(0, 1 << 21), (5, 200), (100, 200)])
def test_op2_rare_words_keep_their_ngrams(spark, top_words, part_tokens):
    own, frame = zipf_texts(spark)
    assert_scores(frame, own, top_words=top_words, part_tokens=part_tokens)


def test_op2_probabilities_sum_to_one(tmp_path):
    rng = np.random.default_rng(1)
    keys = np.unique((rng.integers(0, 5, 300) << 40 | rng.integers(0, 5, 300) << 20 | rng.integers(0, 8, 300)).astype(np.uint64))
    share = np.zeros(1 << 20)
    share[:8] = 1 / 8
    trie = language_model.Trie(keys, np.ones(len(keys), np.int64) * 2, share, tmp_path)
    for u, v in ((1, 2), (4, 4), (7, 2), (7, 7)):
        asked = np.array([v << 40 | u << 20 | w for w in range(8)], np.uint64)
        assert abs(sum(10.0 ** (-trie.score(asked) / language_model.STEP)) - 1) < 0.01


def test_elias_fano_finds_all():
    rng = np.random.default_rng(0)
    for top in (10, 10_000, 1 << 58):
        x = np.unique(rng.integers(0, top, 3000).astype(np.uint64))
        ef = language_model.EliasFano.build(x)
        at, hit = ef.find(x)
        assert hit.all() and (at == np.arange(len(x))).all()
        y = rng.integers(0, top, 3000).astype(np.uint64)
        assert (ef.find(y)[1] == np.isin(y, x)).all()


def test_op3_spans(docs, empty):
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.find_secrets(docs).collect()}
    text = ROWS[-1][1]
    want = [("assign", 0, text.index('" AKIA')), ("access", text.index("AKIA"), text.index("AKIA") + 20), ("hex", text.index("0123456789abcdef"), text.index("0123456789abcdef") + 20)]
    assert got[10] == want and got[4] == [] and got[1] == []
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert clean[10].count("[SECRET]") == 3 and clean[4] is None and clean[8] == "two words"
    assert secrets.find_secrets(empty).count() == 0


def test_op3_queries_are_necessary():
    assert secrets.trigram_query("abcd") == frozenset([frozenset(["abc", "bcd"])])
    assert secrets.trigram_query("(foo|bars)x") == frozenset([frozenset(["foo", "oox"]), frozenset(["bar", "ars", "rsx"])])
    assert frozenset() in secrets.trigram_query("[0-9a-f]{16,}")
    assert frozenset() not in secrets.trigram_query(secrets.BASE_RULES[0].pattern)


def test_op3_matches_duckdb(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM read_parquet('{sf_dir}/documents.parquet')")
    cols = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    got = queries.op3_secret_scans(spark, sf_dir).select(*cols).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(queries.OP3_SQL).select(*cols).fetchall() if hasattr(con.sql(queries.OP3_SQL), "fetchall") else [])


def test_op4_held_out_accuracy(spark, sf_dir, docs, empty):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf_dir, "labels").collect()}
    got = [r for r in queries.op4_quality_classifier(spark, sf_dir).collect() if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in got) >= 0.9 * len(got)
    scored = quality.score(docs, [0.1] * len(quality.NAMES), 0.0).collect()
    assert len(scored) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scored)
    assert quality.score(empty, [0.1] * len(quality.NAMES), 0.0).count() == 0
    assert quality.fit(docs, docs.select("doc_id", F.lit(1).alias("quality")))[0] == [0.0] * len(quality.NAMES)


def test_op4_learns_from_every_labelled_row(spark):
    """Of 45,000 labelled texts none is left out."""
    n = 45_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "Good words, all of them.").otherwise("bad bad bad |").alias("text"))
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality"))
    seen = []
    rows = quality.cut

    def spy(df):
        seen.append(rows(df))
        return seen[-1]

    quality.cut = spy
    try:
        weights, threshold = quality.fit(docs, labels)
    finally:
        quality.cut = rows
    assert seen[0].count() == n and seen[0].select("id").distinct().count() == n
    # the threshold is the quantile over all of them
    scores = [r["s"] for r in quality.with_features(docs).select(quality.linear("features", weights).alias("s")).collect()]
    assert abs(threshold - float(np.quantile(scores, 0.5))) < 1e-9
    one = spark.createDataFrame([(i * 1.0,) for i in (5, 1, 4, 2, 3)], "s double")
    assert [quality._quantile(one, q, 5) for q in (0.0, 0.25, 0.3, 1.0)] == [1.0, 2.0, pytest.approx(2.2), 5.0]


def test_op5_counts_as_the_library(spark, sf_dir, docs, empty):
    t = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    own = texts(spark, sf_dir)
    got = {r["doc_id"]: r for r in queries.op5_token_counts(spark, sf_dir).collect()}
    assert all(got[d]["n_tokens"] == len(t.encode(x, add_special_tokens=False)) and got[d]["n_bytes"] == len(x.encode()) for d, x in own.items())
    for r in tokens.count_tokens(docs, str(P.path("byte_bpe_50k.json")), chunk=3000, overlap=32).collect():
        text = next(x[1] or "" for x in ROWS if x[0] == r["doc_id"])
        assert r["n_tokens"] == len(t.encode(text, add_special_tokens=False))
    assert tokens.count_tokens(empty, str(P.path("byte_bpe_50k.json"))).count() == 0


@pytest.mark.parametrize("text", ["x" * 5000 + "中" * 700 + " a" * 900, "ab cd \x1c ef  \n\n gh " * 700, "don't <|endoftext|> stop, 12345!? " * 400])
def test_op5_splices(text):
    enc = tokens.encoder(str(P.path("byte_bpe_50k.json")))
    n = len(enc.inner.encode(text, add_special_tokens=False))
    assert all(tokens.count_spliced(enc.starts, text, chunk, lap) == n for chunk, lap in ((500, 8), (1000, 200)))
    assert enc.counts([text]) == [n]


def test_op6_edits_and_estimates(spark, sf_dir, docs, empty):
    own = sorted(texts(spark, sf_dir).items())
    got = {r["doc_id"]: r for r in queries.op6_fingerprints(spark, sf_dir).collect()}
    assert len(got) == len(own)
    for i, (d, t) in enumerate(own):
        nxt, k = own[(i + 1) % len(own)][1], len(t) // 4
        edited = t[: len(t) - k] + nxt[:k]
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[d]["n_chars"] == len(t)
        a, b = shingles(t, 5), shingles(edited, 5)
        assert abs(got[d]["near_edited"] - len(a & b) / max(1, len(a | b))) < 0.25
    assert sketch.fingerprints(docs).count() == len(ROWS) and sketch.fingerprints(empty).count() == 0
    parts = sketch.merge_sketches(queries.op6_fingerprints(spark, sf_dir).withColumn("g", F.lit(1)), "g").first()
    whole = np.unique(np.concatenate([sketch.from_text(r["fingerprint"]) for r in got.values()]))[: sketch.K]
    assert (sketch.from_text(parts["fingerprint"]) == whole).all()


def test_op7_targets(spark, sf_dir, docs, empty):
    got = queries.op7_mixing(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").collect()
    size = Counter()
    for r in got:
        size[r["source"]] += r["size"]
        assert r["taken"] <= 2 * r["size"]
    order, free = sorted(size), dict.fromkeys(sorted(size))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left = {}, 1.5 * sum(size.values())
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if unit * weight[s] > 2 * size[s]]
        for s in over or list(free):
            target[s] = 2.0 * size[s] if over else unit * weight[s]
            left -= target[s]
            free.pop(s)
    assert all(math.isclose(r["target"], target[r["source"]], rel_tol=1e-9) and r["source_size"] == size[r["source"]] for r in got)
    assert sorted(queries.op7_mixing(spark, sf_dir).collect()) == sorted(queries.op7_mixing(spark, sf_dir).collect())
    assert mixing.repetition(docs).count() == len(ROWS) and mixing.mix(empty).count() == 0
    assert mixing.mix(docs).columns == docs.columns
    # a source's words are a sum of independent coins: within five standard deviations of the target
    taken, spread = Counter(), Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        rate = r["target"] / r["source_size"] if r["source_size"] else 0.0
        spread[r["source"]] += r["size"] ** 2 * (rate % 1) * (1 - rate % 1)
    assert all(abs(taken[s] - target[s]) <= 5 * math.sqrt(spread[s]) + 1e-6 for s in taken)


def test_op7_keeps_columns_of_clashing_names(docs, spark):
    wide = docs.select("*", *(F.lit(c).alias(c) for c in ("source_size", "target", "copies", "_source", "_copy")))
    got = mixing.mix(wide)
    assert got.columns == wide.columns
    kept = {(r["doc_id"], r["size"]) for r in wide.collect()}
    for r in got.collect():
        assert (r["doc_id"], r["size"]) in kept and [r[c] for c in wide.columns[-5:]] == wide.columns[-5:]


def test_op3_keeps_columns_of_clashing_names(docs):
    wide = docs.select("*", *(F.lit(c).alias(c) for c in ("spans", "_spans", "_row", "_mask", "_text")))
    clean = secrets.redact(wide)
    assert clean.columns == wide.columns and all([r[c] for c in wide.columns[-5:]] == wide.columns[-5:] for r in clean.collect())
    found = secrets.find_secrets(wide).where("doc_id = 10").first()
    assert len(found["spans"]) == 3 and found["_row"] == "_row"


def test_op8_packs_all(spark, sf_dir, docs, empty):
    t = Tokenizer.from_file(str(P.path("word_bpe_49k.json")))
    for frame, own in ((table(spark, sf_dir, "documents"), list(texts(spark, sf_dir).items())), (docs, [(r[0], r[1] or "") for r in ROWS])):
        want = Counter()
        for d, x in own:
            ids = np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4")
            want.update((d, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048)))
        got = packing.pack(frame, str(P.path("word_bpe_49k.json"))).collect()
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
        by = {}
        for r in got:
            by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert all([o for o, _ in sorted(s)] == list(np.cumsum([0, *(n for _, n in sorted(s))])[:-1]) and sum(n for _, n in s) <= 2048 for s in by.values())
        lower = -(-sum(n for s in by.values() for _, n in s) // 2048)
        assert lower <= len(by) <= 1.01 * lower + 1
    assert packing.pack(empty, str(P.path("word_bpe_49k.json"))).count() == 0


def test_op8_plan_is_tight():
    counts = np.bincount(np.random.default_rng(3).integers(1, 600, 5000), minlength=2049)
    plan = packing.plan_patterns(counts, 2048)
    used = np.zeros(2049, np.int64)
    for p, n in plan:
        np.add.at(used, list(p), n)
    assert (used == counts).all()
    assert sum(n for _, n in plan) <= 1.01 * (counts * np.arange(2049)).sum() / 2048 + 1


def test_op9_balance_and_moves(spark, sf_dir, docs, empty):
    a, b = sharding.fill_table([f"s{i}" for i in range(10)], 10_007), sharding.fill_table([f"s{i}" for i in range(9)], 10_007)
    assert np.bincount(a).max() - np.bincount(a).min() <= 1
    assert ((a != b) & (a != 9)).mean() < 0.1
    rows = queries.op9_sharding(spark, sf_dir).collect()
    slots, names = sharding.fill_table([f"shard-{i:02d}" for i in range(16)]), [f"shard-{i:02d}" for i in range(16)]
    where = {r["doc_id"]: r["shard"] for r in rows}
    hashed = {r["doc_id"]: r["slot"] for r in table(spark, sf_dir, "documents").select("doc_id", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(len(slots))).alias("slot")).collect()}
    assert where.keys() == hashed.keys() and {d: names[slots[at]] for d, at in hashed.items()} == where
    got = sharding.place(docs, ["x", "y"], slots=101)
    assert got.count() == len(ROWS) and got.where("shard is null").count() == 0 and sharding.place(empty, ["x"], slots=7).count() == 0


def test_op10_matches_brute_force(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.1")
    rows = table(spark, sf_dir, "embeddings").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    got = {}
    for r in queries.op10_nearest_neighbours(spark, sf_dir).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    score = x @ x[ids % 20 == 0].T
    hits = 0
    for q, own in zip(ids[ids % 20 == 0], score.T, strict=True):
        best = [v for v in ids[np.lexsort((ids, -own))] if v != q][:20]
        assert [rank for rank, _, _ in sorted(got[q])] == list(range(1, 21))
        assert all(math.isclose(s, own[ids == v][0], rel_tol=1e-12) for _, v, s in got[q])
        hits += len(set(best) & {v for _, v, _ in got[q]})
    assert hits >= 0.95 * 20 * len(got) and set(got) == set(ids[ids % 20 == 0])
    exact = neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, epsilon=math.inf).collect()
    assert {(r["query_id"], r["vec_id"]) for r in exact} == {(q, v) for q, own in zip(ids[ids % 20 == 0], score.T, strict=True) for v in [v for v in ids[np.lexsort((ids, -own))] if v != q][:20]}


def test_op10_unusable_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [2.0, 1.0]), (6, [2.0, 1.0]), (7, [float("inf"), 0.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(got)] == [(0, 1, 5, 2.0), (0, 2, 6, 2.0)]
    assert neighbours.nearest(df.where("false"), F.lit(True)).count() == 0


def test_op10_doubles_ties_repeats_and_names(spark):
    close = [(i, [1.0 + i * 1e-12, 2.0], "x", "y", 1) for i in range(1, 60)]
    rows = [(0, [1.0, 0.0], "x", "y", 1), (0, [1.0, 0.0], "x", "y", 1), *close, (59, close[-1][1], "x", "y", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string, score string, id int").repartition(4)
    got = neighbours.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [59, *range(59, 40, -1)] and got[0]["score"] == 1.0 + 59e-12
    same = spark.createDataFrame([(i, [0.5, 0.5]) for i in range(9000, -1, -1)], "vec_id long, embedding array<double>").repartition(4)
    got = neighbours.nearest(same, F.col("vec_id").isin(5, 8000)).collect()
    assert {q: sorted(r["vec_id"] for r in got if r["query_id"] == q) for q in (5, 8000)} == {5: [i for i in range(21) if i != 5], 8000: list(range(20))}
    huge = spark.createDataFrame([(1, [1e300, 1.0]), (2, [2.0, 1.0]), (3, [1e200, 5.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in neighbours.nearest(huge, F.col("vec_id") == 2).orderBy("rank").collect()] == [(1, 2e300), (3, 2e200)]


def test_pipeline_stages(spark, sf_dir, docs):
    """Each stage on what the ones before it kept, against a plain version."""
    own = table(spark, sf_dir, "documents")
    good, one, clean, mixed, packed = (f for _, f in corpus_pipeline.STAGES)
    rows = lambda df: {r["doc_id"]: r for r in df.collect()}
    kept = good(spark, own, sf_dir).cache()
    # the classifier keeps the rows that it scores 0.5 or more, as they are
    weights, threshold = quality.fit(own, quality.training_labels(table(spark, sf_dir, "labels")))
    accepted = {r["doc_id"] for r in quality.score(own, weights, threshold).where("predicted = 1").collect()}
    assert rows(kept) == {d: r for d, r in rows(own).items() if d in accepted} and kept.columns == own.columns
    # of each group of texts that link by five words and 0.8, the smallest id
    sets = {d: shingles(r["text"], 5) for d, r in rows(kept).items()}
    top = {d: d for d in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    single = one(spark, kept, sf_dir).cache()
    assert rows(single) == {d: r for d, r in rows(kept).items() if root(d) == d}
    # each secret of the rules replaced, overlapping ones together
    spans = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in secrets.find_secrets(single).collect()}
    plain = {}
    for d, r in rows(single).items():
        out, at = "", 0
        for start, end in spans[d]:
            if start >= at:
                out += (r["text"] or "")[at:start] + "[SECRET]"
            at = max(at, end)
        plain[d] = out + (r["text"] or "")[at:]
    cleaned = clean(spark, single, sf_dir).cache()
    assert {d: (r["text"], r["n_chars"]) for d, r in rows(cleaned).items()} == {d: (t, len(t)) for d, t in plain.items()}
    # as often as the rates say
    often = {r["doc_id"]: r["copies"] for r in mixing.repetition(cleaned).collect()}
    repeated = mixed(spark, cleaned, sf_dir).cache()
    assert Counter(r["doc_id"] for r in repeated.collect()) == Counter({d: n for d, n in often.items() if n})
    # all tokens, once each
    t = Tokenizer.from_file(str(P.path("word_bpe_49k.json")))
    want = Counter()
    for d, n in often.items():
        want[d] += n * (len(t.encode(plain[d], add_special_tokens=False).ids) + 1)
    got = Counter()
    for r in packed(spark, repeated, sf_dir).collect():
        got[r["doc_id"]] += r["length"]
    assert got == Counter({d: n for d, n in want.items() if n})
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_pipeline_stages_on_awkward_rows(spark, sf_dir, docs, empty):
    wide = docs.withColumn("_row", F.lit("r")).withColumn("predicted", F.lit("p")).withColumn("target", F.lit("t")).withColumn("spans", F.lit("s"))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, wide, sf_dir)
        assert got.count() > 0, name
        if name != "best_fit_packing":
            assert got.columns == wide.columns and {(r["_row"], r["predicted"], r["target"], r["spans"]) for r in got.collect()} == {("r", "p", "t", "s")}, name
        assert stage(spark, empty, sf_dir).count() == 0, name
    single = [r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, wide, sf_dir).collect()]
    assert sorted(d or 0 for d in single) == [0, 1, 4, 5, 6, 7, 8, 10]
