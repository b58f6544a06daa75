"""Decisions belong to rows, not to ids; samples keep their bounds; classifiers against plain recomputation."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelmetrics.llm import common, exact_dedup, mixing, ngram_join, quality_embed, suffix_dedup, toxicity

from test_corpus_operators import brute_components, brute_removal

WIDE = 9_223_372_036_854_775_807


def letters(rng, n):
    return "".join(rng.choice("abcdefgh \n") for _ in range(n))


def test_repeats_are_removed_row_by_row(documents):
    """Ids that repeat with other texts, or are null, are documents like any others."""
    rng = random.Random(4)
    a, b, c = letters(rng, 900), letters(rng, 652), letters(rng, 220)
    rows = [(1, a[:300]), (1, c + b), (2, b), (4, a), (None, a), (None, c), (None, None), (5, "x" * 150), (5, "x" * 150), (6, a), (6, a)]
    want = brute_removal([(k, t) for k, (_, t) in enumerate(rows)], 200)
    got = suffix_dedup.remove_repeats(documents(rows, clash=True)).collect()
    found = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert found == Counter((rows[k][0], *v) for k, v in want.items())
    assert any(r.doc_id == 1 and (r.n_bytes, r.n_removed) == (300, 300) for r in got)


def test_near_copies_of_repeated_ids(documents):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(500)]
    made = lambda: [rng.choice(words) for _ in range(60)]
    one, two, three = made(), made(), made()
    near = lambda own: [*own[:59], "other"]
    rows = [(5, one), (5, two), (7, near(one)), (8, near(two)), (None, near(three)), (9, three), (9, near(near(three)[:58] + ["last"])), (None, two)]
    rows = [(k, " ".join(t)) for k, t in rows] + [(None, None), (3, "")]
    got = {(r.doc_id, r.tag): r for r in ngram_join.ngram_components(documents(rows, clash=True)).collect()}
    assert len(got) == len(rows)
    plain = brute_components(list(enumerate(t for _, t in rows)))
    of = documents(rows).select("doc_id", "text", ngram_join.text_tag(F.col("text")).alias("tag")).collect()
    tag = {(r.doc_id, r.text): got[(r.doc_id, r.tag)] for r in of}
    for k, (doc_id, text) in enumerate(rows):
        size, head = plain[k]
        members = [rows[m][0] for m in plain if plain[m][1] == head]
        known = [m for m in members if m is not None]
        row = tag[(doc_id, text)]
        assert row.n_shingles == size
        assert row.component_id == (min(known) if known else doc_id)
    # Two groups have the name 5, each with one leading row.
    assert sorted(r.component_id for r in got.values() if r.leads and r.n_shingles) == [5, 5, 9]


def test_wide_ids_and_the_index(spark, documents):
    rows = [(WIDE, "a"), (-WIDE - 1, "a"), (0, "b"), (9_000_000_000_000_000_000, "c"), (-9_000_000_000_000_000_000, "c"), (None, "c")]
    index = exact_dedup.DigestIndex(spark, "index_of_wide_ids", buckets=4)
    index.drop()
    got = exact_dedup.exact_duplicates(documents(rows), index, batches=3)
    index.drop()  # the verdicts no longer need it
    want = {"a": WIDE, "b": 0, "c": 9_000_000_000_000_000_000}
    sha = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    rows_ = got.collect()
    assert len(rows_) == 6 and all(r.keep_id == sha[r.text_sha256] and r.kept == (r.doc_id == r.keep_id) for r in rows_)


def test_second_batch_leaves_the_index_in_place(spark, documents):
    index = exact_dedup.DigestIndex(spark, "index_used_twice", buckets=4)
    index.drop()
    first = {r.doc_id: r.keep_id for r in exact_dedup.exact_duplicates(documents([(k, f"text {k % 40}") for k in range(80)]), index).collect()}
    assert all(v == k % 40 + 40 for k, v in first.items())
    again = exact_dedup.exact_duplicates(documents([(100, "text 3"), (101, "new"), (102, "new")]), index)
    assert {r.doc_id: (r.keep_id, r.kept) for r in again.collect()} == {100: (43, False), 101: (102, False), 102: (102, True)}
    assert index.read().count() == 41
    plan = index.unseen(exact_dedup.digests(documents([(7, "text 9")])))._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.index("Bucketed: true") - 2500 : plan.index("Bucketed: true")]
    assert "Exchange" not in side.rsplit("Sort ", 1)[-1]
    index.drop()


def test_one_of_equal_rows_stays(spark, documents, sf_dir):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    dedup = common.cut(stages["exact_dedup"](spark, documents([(1, "x"), (1, "x"), (None, "y"), (None, "y"), (2, "y z"), (None, "x")], clash=True), sf_dir), "t")
    assert sorted((r.doc_id, r.text) for r in dedup.where("doc_id IS NOT NULL").collect()) == [(1, "x"), (2, "y z")]
    assert [r.text for r in dedup.where("doc_id IS NULL").collect()] == ["y"]
    long = " ".join(f"w{k}" for k in range(40))
    near = common.cut(stages["near_dedup"](spark, documents([(5, long), (5, long.upper()), (5, long), (8, long), (None, long), (None, None), (6, "")]), sf_dir), "t")
    assert sorted(((r.doc_id, (r.text or "").lower()) for r in near.collect()), key=repr) == sorted([(5, long), (None, ""), (6, "")], key=repr)


def test_mix_counts_rows_without_ids(spark, documents, sf_dir):
    import corpus_pipeline

    rows = [(None, "w " * n, "a") for n in (10, 3, 200, 7, 7)] + [(1, "v " * 50, "a"), (1, "u " * 20, "b"), (2, "t " * 90, "b"), (2, "t " * 90, "b")]
    docs = documents(rows, clash=True)
    plan = Counter()
    for r in mixing.mix(docs).collect():
        plan[(r.doc_id, r.source, r.tag, r.size)] += r.copies
    mixed = common.cut(dict(corpus_pipeline.STAGES)["mixing"](spark, docs, sf_dir), "t")
    tag = F.xxhash64(F.coalesce("text", F.lit("")))
    got = {(r.doc_id, r.source, r.tag): r.n for r in mixed.groupBy("doc_id", "source", tag.alias("tag")).agg(F.count("*").alias("n")).collect()}
    assert got == {k[:3]: v for k, v in plan.items() if v}
    again = dict(corpus_pipeline.STAGES)["mixing"](spark, docs.repartition(5), sf_dir)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, mixed.collect()))


# --- samples and models ------------------------------------------------------------------------
def test_samples_keep_their_bounds(spark, documents):
    docs = documents([(1, f"text {k:03d}") for k in range(500)] + [(2, "b" * 400), (3, None), (4, "d" * 10)])
    labels = spark.createDataFrame([(k, k % 2) for k in (1, 2, 3, 4)] * 3, "doc_id long, toxic int")
    sample = common.labelled_sample(labels, "toxic", {0: 12, 1: 12}, F.lit(True))
    texts, marks = common.sample_texts(docs, sample)
    assert texts == [b"text 000", b"b" * 400, b"", b"d" * 10] and marks == [1, 0, 1, 0]
    few, _ = common.sample_texts(docs, sample, limit=100)
    assert set(few) <= {b"text 000", b"", b"d" * 10} and sum(map(len, few)) <= 100
    model = toxicity.train(docs, labels, max_toxic=1, max_clean=1)
    assert len(model.features) >= 0


def plain_buckets(text):
    data = b" " + b" ".join(text.split()) + b" "
    out = set()
    for n in toxicity.SIZES:
        for at in range(len(data) - n + 1):
            h = sum(data[at + j] * int(toxicity._STEP[j]) for j in range(n)) & 0xFFFFFFFF
            out.add((((h ^ n) * 2654435769) & 0xFFFFFFFF) >> (32 - toxicity.BITS))
    return out


def test_toxicity_equals_plain_recomputation():
    """Features, log-count ratios, the first training steps and scores, without arrays."""
    rng = random.Random(1)
    clean, bad = ["river", "stone", "Ünder", "green"], ["zonk", "blarg", "stone"]
    texts = [" ".join(rng.choice(bad if k % 3 == 0 else clean) for _ in range(6)) for k in range(30)]
    labels = [int(k % 3 == 0) for k in range(30)]
    bags = [plain_buckets(t.lower().encode()) for t in texts]
    for text, bag in zip(texts, bags):
        assert set(np.concatenate(toxicity.buckets(text.lower().encode())).tolist()) == bag
    n1, n0 = sum(labels), len(labels) - sum(labels)
    seen = {b: [sum(b in bag for bag, y in zip(bags, labels) if y == side) for side in (0, 1)] for b in set().union(*bags)}
    ratio = {b: np.log(((c1 + 0.5) / (n1 + 1)) / ((c0 + 0.5) / (n0 + 1))) for b, (c0, c1) in seen.items()}
    chosen = {b for b, (c0, c1) in seen.items() if c0 + c1 >= 3 and c1 != (c0 + c1) * n1 / (n0 + n1)}
    for epochs in (1, 2):
        weight, bias = dict.fromkeys(chosen, 0.0), 0.0
        m1, m2 = dict.fromkeys([*chosen, None], 0.0), dict.fromkeys([*chosen, None], 0.0)
        for step in range(1, epochs + 1):
            grad = {b: 1e-3 * weight[b] for b in chosen} | {None: 0.0}
            for bag, y in zip(bags, labels):
                z = bias + sum(ratio[b] * weight[b] for b in bag & chosen)
                gap = (1 / (1 + np.exp(-z)) - y) * (0.5 / n1 if y else 0.5 / n0)
                grad[None] += gap
                for b in bag & chosen:
                    grad[b] += gap * ratio[b]
            for b in grad:
                m1[b], m2[b] = 0.9 * m1[b] + 0.1 * grad[b], 0.999 * m2[b] + 0.001 * grad[b] ** 2
                move = 0.05 * (m1[b] / (1 - 0.9**step)) / (np.sqrt(m2[b] / (1 - 0.999**step)) + 1e-8)
                if b is None:
                    bias -= move
                else:
                    weight[b] -= move
        model = toxicity.fit([t.encode() for t in texts], labels, epochs=epochs)
        assert set(model.features.tolist()) == chosen
        score = model.scorer()
        for text, bag in zip(texts, bags):
            z = bias + sum(ratio[b] * weight[b] for b in bag & chosen)
            assert score(text) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_toxicity_trains_without_texts_on_the_driver(spark, sf_dir, monkeypatch):
    docs, labels = common.table(spark, sf_dir), common.table(spark, sf_dir, "labels")
    sample = common.labelled_sample(labels, "toxic", {1: 30, 0: 60}, ~common.held_out(F.col("doc_id"), 3, 1))
    twin = toxicity.fit(*common.sample_texts(docs, sample))
    monkeypatch.setattr(toxicity, "CHUNK", 100)

    def on_the_driver(text):
        raise AssertionError("a text is hashed on the driver")

    monkeypatch.setattr(toxicity, "buckets", on_the_driver)  # tasks import the module anew
    model = toxicity.train(docs, labels, max_toxic=30, max_clean=60)
    assert len(twin.features) > 100 and model.features.tolist() == twin.features.tolist()
    assert np.allclose(model.weights, twin.weights, atol=1e-9) and abs(model.bias - twin.bias) < 1e-9


def plain_features(text):
    """Hashed words and n-grams, with repeats."""
    words = text.split()
    if not words:
        return []
    out = []
    for w in words:
        h = sum(c * int(quality_embed._PLACE[k & 63]) for k, c in enumerate(w)) + 32 * int(quality_embed._PLACE[len(w) & 63])
        out.append((((h ^ 7) & 0xFFFFFFFF) * 2654435769 & 0xFFFFFFFF) >> (32 - quality_embed.BITS))
    data = b" " + b" ".join(words) + b" "
    for n in quality_embed.SIZES:
        for at in range(len(data) - n + 1):
            h = sum(data[at + j] * int(quality_embed._STEP[j]) for j in range(n)) & 0xFFFFFFFF
            out.append((((h ^ n) * 2654435769) & 0xFFFFFFFF) >> (32 - quality_embed.BITS))
    return out


def test_quality_embedding_equals_plain_recomputation():
    """Features and scores, and stochastic gradient steps against a numeric gradient of the loss."""
    for text in (b"", b"one", b"some words and \xc3\xa9 more words", b"x" * 100 + b" y"):
        found = list(quality_embed.features(text))
        assert sorted(np.concatenate(found).tolist() if found else []) == sorted(plain_features(text))
    texts, labels = [b"good words here", b"bad junk"], [1, 0]
    model = quality_embed.fit(texts, labels, epochs=1, rate=0.5, seed=3)
    rng = np.random.default_rng(3)
    dim = quality_embed.DIM
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << quality_embed.BITS, dim)).astype(np.float32).astype(np.float64)
    layer, bias, order = np.zeros((2, dim)), np.zeros(2), rng.permutation(2)
    for step, k in enumerate(order):
        bag = Counter(plain_features(texts[k]))
        total = sum(bag.values())
        mean = sum(vectors[b] * c for b, c in bag.items()) / total

        def loss(w, v, m):
            z = w @ m + v
            return float(np.log(np.exp(z).sum()) - z[labels[k]])

        pace, eps = 0.5 * (1 - step / 2) * 1.0, 1e-6
        slope = np.array([[(loss(layer + eps * np.eye(2)[[i]].T @ np.eye(dim)[[j]], bias, mean) - loss(layer, bias, mean)) / eps for j in range(dim)] for i in range(2)])
        lean = np.array([(loss(layer, bias + eps * np.eye(2)[i], mean) - loss(layer, bias, mean)) / eps for i in range(2)])
        pull = np.array([(loss(layer, bias, mean + eps * np.eye(dim)[j]) - loss(layer, bias, mean)) / eps for j in range(dim)])
        most = max(bag.values())
        # The vectors move against the layer as it was before this step or after it: the step uses the former.
        for b, c in bag.items():
            vectors[b] -= pace * (c / most) * 0.05 * pull
        layer, bias = layer - pace * slope, bias - pace * 0.1 * lean
    for text in (*texts, b"good junk"):
        bag = plain_features(text)
        z = sum(vectors[b] @ (layer[1] - layer[0]) for b in bag) / len(bag) + bias[1] - bias[0]
        assert model.score(text.decode()) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)
