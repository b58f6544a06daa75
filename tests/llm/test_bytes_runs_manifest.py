"""Byte-level BPE, periodic runs and the Merkle manifest against the library, brute force and SQL."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from reelmetrics.llm import byte_bpe, merkle, periodic_runs

public = pytest.importorskip("public_tokenizers")

ODD = ["", None, " ", "\n\n \t", "it's we'll  'd 12345 3.14", "naïve ÆØÅ 漢字かな交じり文 🙂👩‍👩‍👧 é", "a" * 3000, "\x00\x85 　x", "ere...ere 000000 !!!!!"]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = byte_bpe.read_ranks(public.path(byte_bpe.VOCABULARY))
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def texts():
    return pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()


# --- byte-level BPE ----------------------------------------------------------------------------
def test_byte_table_is_one_to_one():
    table = byte_bpe.byte_characters()
    assert len(set(table)) == 256 and table[ord("A")] == "A" and table[0x20] == "Ġ" and table[0x0A] == "Ċ"


def test_ids_and_round_trip_equal_the_library(reference, texts):
    tool = byte_bpe.ByteBpe()
    rng = random.Random(3)
    tokens = list(tool.bytes_of.values())
    joined = [b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 8))).decode(errors="replace") for _ in range(2000)]
    mixed = ["".join(rng.choice("ab e1.!'s\n\t -_=*é") for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    every = [t or "" for t in [*texts, *ODD]] + joined + mixed
    for text, parts in zip(every, tool.encode(every)):
        ids = [k for own, _ in parts for k in own.tolist()]
        assert ids == reference.encode_ordinary(text)
        assert tool.decode(ids) == text.encode()


def test_pieces_and_offsets(monkeypatch, reference, texts):
    monkeypatch.setattr(byte_bpe.pieces, "__defaults__", (40,))
    monkeypatch.setattr(byte_bpe, "CALL", 100)
    tool = byte_bpe.ByteBpe()
    some = [t or "" for t in [*texts[:100], *ODD]]
    assert any(len(list(byte_bpe.pieces(t))) > 3 for t in some)
    for text, parts in zip(some, tool.encode(some)):
        assert "".join(p for _, p in byte_bpe.pieces(text)) == text
        ids = [k for own, _ in parts for k in own.tolist()]
        assert ids == reference.encode_ordinary(text)
        starts, at = np.cumsum([0] + [len(c.encode()) for c in text]), 0
        for k, (first, end) in zip(ids, np.concatenate([p for _, p in parts]).tolist()):
            size = len(tool.bytes_of[k])
            assert (first, end) == (np.searchsorted(starts, at, "right") - 1, np.searchsorted(starts, at + size))
            at += size


def test_byte_bpe_over_rows(spark, documents, reference):
    docs = documents([*ODD, *ODD, "same text", "same text"], clash=True)
    got = {r["doc_id"]: r for r in byte_bpe.encode_digests(docs).collect()}
    lists = byte_bpe.encode(docs)
    back = {r["doc_id"]: r for r in byte_bpe.decode(lists.select("doc_id", "ids")).collect()}
    ids = {r["doc_id"]: r for r in lists.collect()}
    for row in docs.collect():
        text, own = row["text"] or "", got[row["doc_id"]]
        want = reference.encode_ordinary(text)
        assert ids[row["doc_id"]]["ids"] == want and own["n_tokens"] == len(want)
        assert own["ids_sha256"] == hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest()
        assert own["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert back[row["doc_id"]]["text"] == text and bytes(back[row["doc_id"]]["data"]) == text.encode()
        assert own["n_split"] == sum(reference.decode_single_token_bytes(k)[0] & 0xC0 == 0x80 for k in want)
    part = spark.createDataFrame([(1, ids[5]["ids"][:3]), (2, None)], "doc_id long, ids array<long>")
    out = {r["doc_id"]: r["text"] for r in byte_bpe.decode(part).collect()}
    assert out[2] == "" and out[1] == reference.decode_bytes(ids[5]["ids"][:3]).decode(errors="replace")
    assert byte_bpe.encode_digests(docs.limit(0)).count() == 0


# --- periodic runs -----------------------------------------------------------------------------
def brute_runs(words, least=periodic_runs.LEAST):
    """(start, length, period) by scanning every lag."""
    n, best = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, 2 * p):
                best.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in best.items())


def brute_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def sample_words(rng):
    kind, n = rng.randrange(8), rng.randint(0, 220)
    if kind == 0:
        return [rng.choice("ab") for _ in range(n)]
    if kind == 1:  # Fibonacci word
        a, b = "a", "ab"
        while len(b) < n:
            a, b = b, b + a
        return list(b[:n])
    if kind == 2:  # Thue-Morse word
        s = "a"
        while len(s) < n:
            s += s.translate(str.maketrans("ab", "ba"))
        return list(s[:n])
    if kind == 3:
        return [w for _ in range(4) for w in ([rng.choice("abc") for _ in range(rng.randint(1, 40))] * rng.randint(1, 5))[:90]]
    if kind == 4:  # two palindromic rows: a run for every odd period
        return list("ab" * rng.randint(1, 40) + "a" + "ab" * rng.randint(1, 40)) * rng.randint(1, 2)
    if kind == 5:
        words = list("aab" * rng.randint(1, 15) + rng.choice("abc")) * rng.randint(1, 5)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = "d"
        return words
    if kind == 6:
        inner = ["a"] * rng.randint(1, 12) + ["b"]
        return (inner * rng.randint(1, 6) + ["c"] * rng.randint(0, 2)) * rng.randint(1, 4) + inner * rng.randint(0, 3)
    words = [str(rng.randrange(30)) for _ in range(n)]
    p, a = rng.randint(1, max(1, n // 3)), rng.randrange(n + 1)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


@pytest.mark.parametrize("short, least", [(4, 2), (8, 5), (16, 12)])
def test_runs_equal_brute_force(short, least):
    rng = random.Random(short)
    for _ in range(150):
        texts = [sample_words(rng) for _ in range(rng.randint(1, 4))]
        for words, (n, runs, collapsed) in zip(texts, periodic_runs.search_texts([" ".join(w) for w in texts], least, short)):
            want = brute_runs(words, least)
            assert n == len(words) and runs == want
            assert collapsed == brute_collapsed(words, want)


def test_rows_of_equal_words_stay_cheap():
    """A text of one word has one run and no seeds; two palindromic rows have a run an odd period."""
    (n, runs, collapsed), (_, many, _) = periodic_runs.search_texts(["a " * 50_000, "ab" * 3 + " " + " ".join("ab" * 4000 + "a" + "ab" * 4000)])
    assert (n, runs, collapsed) == (50_000, [(0, 50_000, 1)], "a")
    assert len(many) > 3900 and all(length >= 2 * q for _, length, q in many)


def test_wrong_hashes_are_found_out():
    ids = np.array([1, 2, 3] * 6 + [9, 8, 7, 6])
    assert periodic_runs._checked(ids, 0, 18, 3, 12) == [(0, 18, 3)]
    assert periodic_runs._checked(ids, 0, 15, 3, 12) == [(0, 18, 3)]  # could be longer
    assert periodic_runs._checked(ids, 0, 20, 3, 12) == [(0, 18, 3)]  # is not periodic to its end
    assert periodic_runs._checked(ids, 0, 22, 4, 12) == []


def planted(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def expected_row(doc_id, text):
    words = planted(doc_id, text)
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest(listed), digest(brute_collapsed(words, runs)))


def run_rows(df):
    return sorted((tuple(r[:8]) for r in df.collect()), key=repr)


def test_periodic_query_on_a_table_and_odd_rows(spark, documents, tmp_path):
    rng = random.Random(5)
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    rows = [(r["doc_id"], r["text"]) for r in table if len((r["text"] or "").split()) < 700]
    rows += [(k, t) for k, t in enumerate(["", None, " \n", "a\x0bb\x0cc\x1cd\x85e", "x " * 40, "naïve 漢字 " * 30])]
    rows += [(None, "a b " * 20), (None, None), (7, "twice " * 20), (7, "twice " * 20), (-5, " ".join(sample_words(rng)))]
    rows += [(k, " ".join(str(rng.randrange(200)) for _ in range(rng.randint(1, 300)))) for k in range(100, 200)]
    documents(rows, clash=True).write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic_runs.op12(spark, str(tmp_path))
    assert got.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = sorted((expected_row(*r) for r in rows), key=repr)
    assert run_rows(got) == want and sum(r[1] > 0 for r in want) > 20
    small = periodic_runs.periodic_runs(spark.read.parquet(f"{tmp_path}/documents.parquet"), piece=50).select("doc_id", "n_words", "runs", "collapsed")
    whole = periodic_runs.periodic_runs(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert sorted(map(repr, small.collect())) == sorted(map(repr, whole.collect()))
    assert periodic_runs.periodic_runs(documents([]).limit(0)).count() == 0


# --- Merkle manifest ---------------------------------------------------------------------------
def brute_manifest(rows):
    """Rows (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) by plain recomputation."""
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

    def leaf(row, text):
        fields = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))

    def tree(hashes):
        levels = [hashes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
        return levels

    def ascend(levels, at, folded):
        proof = ""
        for level in levels[:-1]:
            low = at // 8 * 8
            before, after = "".join(level[low:at]), "".join(level[at + 1 : low + 8])
            folded, proof, at = sha(before + folded + after), proof + before + after, at // 8
        return folded, proof

    parts = {}
    for row in rows:
        text = row["text"]
        hit = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0
        lowered = text if text is None or not hit else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        parts.setdefault(row["lang"], []).append((row["doc_id"], leaf(row, text), leaf(row, lowered)))
    names = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    for name in names:
        parts[name].sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1]))
    trees = {name: tree([m[1] for m in parts[name]]) for name in names}
    top = tree([trees[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for at, (doc_id, own, now) in enumerate(parts[name]):
            folded, proof = ascend(trees[name], at, now)
            folded, more = ascend(top, k, folded)
            out.append((doc_id, own, trees[name][-1][0], top[-1][0], sha(proof + more), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def manifest_table(spark, rows):
    ddl = "doc_id long, text string, lang string, source string, n_chars long, place long, node string, total long, members string"
    full = [(*r, 1, "x", 2, "y") for r in rows]
    return spark.createDataFrame(full, ddl).repartition(3)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("sizes", [[1], [9], [1, 1], [70, 9, 1, 8, 2, 1, 1, 1, 1, 20]])
def test_manifest_equals_recomputation(spark, sizes):
    rows = [(1000 * p + k, f"Text {p} {k} ÀB", f"l{p}", None if k % 5 == 0 else "s", k) for p, n in enumerate(sizes) for k in range(n)]
    docs = manifest_table(spark, rows)
    got = as_rows(merkle.verify(docs))
    assert got == brute_manifest([r.asDict() for r in docs.collect()])
    assert {r[3] for r in got} == {got[0][3]} and len(got) == sum(sizes)


def test_manifest_takes_odd_rows(spark):
    rows = [(k, t, lang, s, n) for k, t, lang, s, n in [
        (None, "A", None, None, None), (None, None, None, "s", 1), (3, "", "", "", 0), (3, "", "", "", 0), (4, "Z" * 300_000, "=", "a:b", 5),
        (4, "z", "-", "a", 5), (9, None, "en:0:0", "x", 2), (9223372036854775807, "Max", "en", "x", 2), (-9223372036854775808, "Min", "en", "x", 2), (12, "ß", "é", "x", 2),
    ]]
    rows += [(77, "Equal", "en", "x", 5)] * 20
    docs = manifest_table(spark, rows)
    assert as_rows(merkle.verify(docs)) == brute_manifest([r.asDict() for r in docs.collect()])
    empty = merkle.verify(docs.limit(0))
    assert empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and empty.count() == 0


def test_manifest_equals_its_sql(spark, sf_dir, rows):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{sf_dir}/documents.parquet'")
    got = con.execute(merkle.SQL)
    names = [c[0] for c in got.description]
    want = sorted((tuple(r) for r in got.fetchall()), key=repr)
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    assert rows(merkle.op13(spark, sf_dir), *names) == want
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
    altered = {r[names.index("verified")] for r in want}
    assert altered == {True, False}


def test_a_changed_or_missing_row_breaks_the_root(spark):
    rows = [(k, f"Text {k}", "en", "s", k) for k in range(100)]
    root = lambda some: as_rows(merkle.verify(manifest_table(spark, some)))[0][3]
    first = root(rows)
    assert first == root(rows[::-1])
    assert first != root([*rows[:-1], (99, "Text 99", "en", "t", 99)])
