"""Operators that compare documents with each other, against brute force, and the pipeline."""

import hashlib
import random
import re

import pytest

from reelmetrics.llm import common, exact_dedup, mixing, ngram_join, suffix_dedup, url_filter


def unions(ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    return find, join


def brute_components(rows, words=4, percent=85):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    find, join = unions(sets)
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                join(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(rng, n):
    words = [f"w{k}" for k in range(300)]
    bases = [[rng.choice(words) for _ in range(rng.choice([3, 8, 30, 80]))] for _ in range(12)]
    bases += [[rng.choice(words) for _ in range(100)]] * 8
    out = []
    for _ in range(n):
        own = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            own[rng.randrange(len(own))] = rng.choice(words)
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block,short,local", [(1 << 21, 32, 16), (4000, 3, 3)])
def test_ngram_components(documents, monkeypatch, block, short, local):
    texts = family(random.Random(5), 250) + [None, "", " \n", "one", "ONE", "one two", "É x", "é x"]
    hot = ngram_join.hot_tokens
    monkeypatch.setattr(ngram_join, "SHORT", short)
    monkeypatch.setattr(ngram_join, "hot_tokens", lambda sets: hot(sets, local, 50))
    rows = ngram_join.ngram_components(documents(texts, clash=True), block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(list(enumerate(texts)))


@pytest.mark.parametrize("block,short", [(1 << 21, 32), (1 << 21, 3), (400, 3)])
def test_ngram_components_of_groups_that_are_divided_again(documents, monkeypatch, block, short):
    texts = family(random.Random(6), 250) + [None, "", "one", "one two"]
    monkeypatch.setattr(ngram_join, "SHORT", short)
    monkeypatch.setattr(ngram_join, "FINER", 20)
    rows = ngram_join.ngram_components(documents(texts, clash=True), block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(list(enumerate(texts)))


def test_texts_that_share_a_common_line_are_not_one_group(documents, monkeypatch):
    rng = random.Random(4)
    line = " ".join(f"common{k}" for k in range(12))
    texts = [f"{line} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(10 + i % 40)) for i in range(400)]
    texts += [t + " end" for t in texts[:50:2]]
    sizes, search = [], ngram_join._search_groups
    monkeypatch.setattr(ngram_join, "FINER", 2000)
    monkeypatch.setattr(ngram_join, "_search_groups", lambda rows, *a: sizes.append(rows.groupBy("component").count().agg({"count": "max"}).first()[0]) or search(rows, *a))
    rows = ngram_join.ngram_components(documents(texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(list(enumerate(texts)))
    assert max(sizes) < 20


def test_ngram_without_rows_and_with_null_ids(documents):
    assert ngram_join.ngram_components(documents([])).count() == 0
    rows = ngram_join.ngram_components(documents([(None, "a b c d e"), (4, "a b c d e"), (None, "q r s t u"), (None, None)])).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == {(None, 4), (4, 4), (None, None)}


def test_search_is_exact_on_many_blocks():
    rng = random.Random(8)
    texts = family(rng, 120)
    sets = [ngram_join.shingle_set(t) for t in texts]
    import numpy as np

    find, join = unions(range(len(sets)))
    for a, b in ngram_join.search(np.arange(len(sets)), sets):
        join(a, b)
    want = brute_components(list(enumerate(texts)))
    assert {k: find(k) for k in range(len(sets))} == {k: v[1] for k, v in want.items()}


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 360)]
    find, join = unions({x for e in edges for x in e})
    for a, b in edges:
        join(a, b)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b) if any(x in e and e[0] != e[1] for e in edges)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_duplicates(spark, documents):
    rows = [(5, "a"), (9, "a"), (2, None), (3, ""), (4, "b"), (None, "b"), (None, "c"), (7, "A"), (9, "a")]
    index = exact_dedup.DigestIndex(spark, "index_of_tests", buckets=4)
    index.drop()
    got = sorted(map(tuple, exact_dedup.exact_duplicates(documents(rows, clash=True), index).collect()), key=repr)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [
        (5, 9, 3, False, sha("a")), (9, 9, 3, True, sha("a")), (9, 9, 3, True, sha("a")), (2, 3, 2, False, sha("")), (3, 3, 2, True, sha("")),
        (4, 4, 2, True, sha("b")), (None, 4, 2, False, sha("b")), (None, None, 1, True, sha("c")), (7, 7, 1, True, sha("A")),
    ]
    assert got == sorted(want, key=repr)
    # New data: what the index has stays, the rest is appended.
    more = exact_dedup.digests(documents([(50, "a"), (51, "new"), (52, "new")]))
    assert [r.keep_id for r in index.unseen(more).collect()] == [52]
    index.add(more)
    assert index.read().count() == 6 and index.unseen(more).count() == 0
    plan = index.unseen(more)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    index.drop()
    assert exact_dedup.exact_duplicates(documents([]), index).count() == 0
    index.drop()


def brute_removal(rows, size):
    count = {}
    for _, text in rows:
        data = (text or "").encode()
        for p in range(len(data) - size + 1):
            count[data[p : p + size]] = count.get(data[p : p + size], 0) + 1
    out = {}
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - size + 1):
            if count[data[p : p + size]] > 1:
                gone[p : p + size] = b"\1" * size
        runs = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out[i] = (len(data), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("size,gram,many,crowd,local,piece", [(200, 40, 64, 16384, 16, 1 << 19), (60, 12, 2, 6, 3, 256)])
def test_removed_repeats(documents, monkeypatch, size, gram, many, crowd, local, piece):
    rng = random.Random(3)
    made = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passages = [made(rng.randint(150, 600)) for _ in range(6)]
    texts = []
    for _ in range(120):
        text = made(rng.randint(0, 400))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages[:2] if rng.random() < 0.5 else passages)
            text += p[rng.randint(0, len(p) // 3) : len(p) - rng.randint(0, len(p) // 3)] + made(rng.randint(0, 60))
        texts.append(text)
    texts += [None, "", "a" * 900, "ab" * 300, "x" * 199, "y" * 200, "z" * 201, texts[0], texts[0]]
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    common_grams = suffix_dedup.common_grams
    monkeypatch.setattr(suffix_dedup, "common_grams", lambda f: common_grams(f, local, 1000))
    rows = suffix_dedup.remove_repeats(documents(texts, clash=True), size, gram).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute_removal(list(enumerate(texts)), size)


def test_removal_of_nothing(documents):
    assert suffix_dedup.remove_repeats(documents([])).count() == 0


def test_url_rules(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.net", "/en/x", "block"), ("Org", "/fr/", "allow"), (None, "/", "block"), ("a.org", None, "block")]
    urls = [
        "http://example.net/en/1", "https://a.EXAMPLE.net/en/x?q=/", "http://example.net", "http://x.net/?a", "http://y.org/fr/", "http://yorg/fr/",
        "http://org/fr/#x", "nothing", None, "", "http://net/a", "://net/", "http://examplexnet/en/", "http://example.net/en/1", "http:///p", "ftp://a.b.c.example.net/en/xyz",
    ]
    pages = spark.createDataFrame([(k, u, "h", 1) for k, u in enumerate(urls)] + [(0, urls[0], "h", 1), (None, "http://q.net/", "h", 1)], "page_id long, url string, host string, kind int")
    table = spark.createDataFrame(rules, "host string, path string, action string")

    def brute(url):
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h) + len(p), h, p, a) for h, p, a in rules if h and p and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[1] + best[2], best[3] if best else "allow"

    want = [(k, *brute(u)) for k, u in enumerate(urls)] + [(0, *brute(urls[0])), (None, *brute("http://q.net/"))]
    got = [tuple(r) for r in url_filter.judge_urls(pages, table).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r.verdict for r in url_filter.judge_urls(pages, table.limit(0), default="block").collect()} == {"block"}
    assert url_filter.judge_urls(pages.limit(0), table).count() == 0
    plan = url_filter.judge_urls(pages, table)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan


def water(sizes, weights):
    total, out, open_ = 1.5 * sum(sizes), {}, set(range(len(sizes)))
    while open_:
        level = (total - sum(out.values())) / sum(weights[k] for k in open_)
        full = {k for k in open_ if level * weights[k] > 2 * sizes[k]}
        if not full:
            return [out.get(k, level * weights[k]) for k in range(len(sizes))]
        out |= {k: 2.0 * sizes[k] for k in full}
        open_ -= full
    return [out[k] for k in range(len(sizes))]


def test_mixing(spark, documents):
    rng = random.Random(9)
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 5, 17, 40, 200])), rng.choice(["a", "b", "B", "é", None, "a"])) for k in range(400)]
    rows += [(400, None, "a"), (401, "w w", "lone"), (402, "", "void")]
    docs = documents(rows, clash=True)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    names = sorted({r[2] for r in rows if r[2] is not None}) + [None]
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == n) for n in names]
    targets = dict(zip(names, water(sizes, [(5.0, 2.0, 1.0)[k % 3] for k in range(len(names))])))
    taken = {}
    for r in got:
        assert r.target == pytest.approx(targets[r.source], abs=1e-6) and r.source_size == sizes[names.index(r.source)]
        assert 0 <= r.copies <= 2 and r.size == len((rows[r.doc_id][1] or "").split())
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
    assert all(abs(taken[n] - targets[n]) <= 1 for n in names if n != "lone")
    # The rates meet the targets and fall on one exponential curve a source.
    for n in names:
        own = [r for r in got if r.source == n]
        assert sum(r.rate * r.size for r in own) == pytest.approx(targets[n], rel=1e-6, abs=1e-6)
    again = {r.doc_id: r.copies for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.copies for r in got}
    assert mixing.mix(documents([])).count() == 0


def test_pipeline(spark, sf_dir, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, before = docs.columns, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        if name in ("toxicity", "exact_dedup", "near_dedup"):
            assert docs.exceptAll(before).isEmpty() and docs.count() > 0.7 * before.count()
        if name == "exact_dedup":
            assert docs.count() == docs.select("text").distinct().count() == before.select("text").distinct().count()
        if name == "near_dedup":
            rows = before.select("doc_id", "text").collect()
            groups = brute_components([tuple(r) for r in rows], 5, 80)
            assert {r.doc_id for r in docs.collect()} == {c for _, c in groups.values()}
        if name == "mixing":
            assert docs.groupBy("doc_id").count().where("count > 2").isEmpty() and docs.count() > before.count()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
    assert docs.count() == before.count()


def test_pipeline_stages_take_odd_input(spark, documents, sf_dir):
    import corpus_pipeline

    rows = [(1, None), (2, ""), (3, "a b c d e f g"), (4, "a b c d e f g"), (4, "a b c d e f g"), (None, "x y"), (6, "word " * 2000)]
    for docs in (documents(rows, clash=True), documents([])):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.cut(stage(spark, docs, sf_dir), "odd")
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
