"""Operators that judge one text at a time: rules, personal data, classifiers, tokenizing."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelmetrics.llm import bpe, pii, quality_embed, quality_rules, toxicity
from reelmetrics.llm.common import held_out

ODD = [None, "", " \n\t", "word", "word " * 3000, "é" * 10, "a" * 70000, "one two three four\none two three four\n"]


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    marked = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)]


def test_statistics_match_brute_force():
    rng = random.Random(4)
    texts = [t for t in ODD if t is None or len(t) < 1000]
    texts += ["".join(rng.choice(["a", "b", "é", " ", "\n", "#", "\x0b", " ", "c d e "]) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    for text in texts:
        assert quality_rules.statistics(text)[0] == brute_statistics(text), text


def test_trees_keep_their_constraints_and_flatten_right():
    rng = np.random.default_rng(1)
    rows = rng.random((600, 3))
    y = ((rows[:, 0] + 0.3 * rng.random(600) < 0.6) & (rows[:, 1] > 0.2)).astype(int)
    trees = quality_rules.grow(rows, y, [-1, 1, 0])
    assert ((trees.score(rows) > 0.5) == y).mean() > 0.9
    for column, sign in ((0, -1), (1, 1)):
        base = rows[:50].copy()
        before = None
        for value in np.linspace(0, 1, 40):
            base[:, column] = value
            now = trees.score(base)
            assert before is None or (sign * (now - before) >= -1e-12).all()
            before = now
    assert quality_rules.grow(rows, np.ones(600), [0, 0, 0]).score(rows[:5]).min() > 0.99


def test_quality_rules_query(spark, sf_dir, documents):
    out = {r.doc_id: r for r in quality_rules.op2(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs[:60]:
        own, want = out[d.doc_id], brute_statistics(d.text)
        assert [own.n_words, own.word_chars, own.n_symbols, own.n_dup_lines, own.n_repeat_words] == want
        assert own.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (own.base_failed and own.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    right = [out[k].kept == (q == 1) for k, q in labels.items() if not out[k].base_failed]
    assert np.mean(right) > 0.9
    odd = quality_rules.document_statistics(documents(ODD, clash=True)).collect()
    assert {r.doc_id: r.n_words for r in odd} == {k: brute_statistics(t)[0] if t is None or len(t) < 1000 else len(t.split()) for k, t in enumerate(ODD)}
    assert quality_rules.document_statistics(documents([])).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15],
    }


def test_base_spans_match_the_patterns():
    rng, cues = random.Random(1), pii.automaton()
    for _ in range(20000):
        text = "".join(rng.choice("a.@+-01 23()9é4b%") for _ in range(rng.randint(0, 40)))
        found = pii.find_spans(text, cues)
        assert {k: found[k] for k in pii.BASE} == brute_spans(text), text


def test_further_spans():
    cues = pii.automaton()
    text = "See IBAN: DE89 3704 0044 0532 0130 00 and Account Number 12345678; http://bob:secret@host/x, account notes 5, iban XX00 1111 2222 3333"
    found = pii.find_spans(text, cues)
    assert [text[s:e] for s, e in found["account"]] == ["DE89 3704 0044 0532 0130 00", "12345678"]
    assert [text[s:e] for s, e in found["login"]] == ["bob:secret"]
    long = "1" * 200_000 + "@" + "a." * 100_000 + "+" * 1000
    assert pii.find_spans(long, cues)["card"] == []


def test_pii_rows(documents):
    texts = [*ODD, "mail a@b.co or 10.0.0.1, card 4111 1111 1111 1111, +1 (269) 555-3296"]
    rows = {r.doc_id: r for r in pii.find_personal_data(documents(texts, clash=True)).collect()}
    assert len(rows) == len(texts)
    last = rows[len(ODD)]
    assert (last.n_email, last.n_ip, last.n_card, last.n_phone) == (1, 1, 1, 1)
    assert last.spans == "email:5:11,ip:15:23,card:30:49,phone:51:68"
    assert last.base_sha256 == hashlib.sha256(last.spans.encode()).hexdigest()
    assert rows[0].base_sha256 == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("run,target,folds,fold,least", [(toxicity.op5, "toxic", 3, 1, 0.85), (quality_embed.op6, "quality", 5, 0, 0.8)])
def test_classifiers_on_held_out_rows(spark, run, target, folds, fold, least):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in run(spark, sf).collect()}
    labels = {r.doc_id: r[target] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % folds == fold) and 0 <= r.score <= 1 for k, r in rows.items())
    tested = [(rows[k].predicted, v) for k, v in labels.items() if rows[k].held_out]
    assert np.mean([p == v for p, v in tested]) >= least
    again = {r.doc_id: r.score for r in run(spark, sf).collect()}
    assert again == {k: r.score for k, r in rows.items()}


def test_classifiers_take_odd_input(spark, documents):
    docs = documents([*ODD, (None, "nothing"), (3, "repeated")], clash=True)
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(8)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    for mod, score in ((toxicity, toxicity.score_toxicity), (quality_embed, quality_embed.score_quality)):
        rows = score(docs, mod.train(docs, labels)).collect()
        assert len(rows) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in rows)
        none = mod.train(docs, labels.limit(0))
        assert all(r.score < 1e-9 for r in score(docs, none).collect())
        assert score(documents([]), none).count() == 0
    kept = toxicity.drop_toxic(docs, toxicity.train(docs, labels.limit(0)))
    assert kept.columns == docs.columns and kept.count() == len(ODD) + 2
    assert [r[0] for r in spark.range(3).select(held_out(F.col("id"), 3, 1)).collect()] == [zlib.crc32(str(k).encode()) % 3 == 1 for k in range(3)]


def test_long_texts_in_pieces(monkeypatch):
    text = ("some words stand here and idiots there. " * 50).encode()
    for mod, bags in ((toxicity, toxicity.buckets), (quality_embed, quality_embed.features)):
        whole = np.sort(np.concatenate(list(bags(text))))
        monkeypatch.setattr(mod, "PIECE", 64)
        parts = np.concatenate(list(bags(text)))
        if mod is toxicity:
            assert (np.sort(parts) == whole).all()
        else:
            assert set(parts) <= set(whole) | set(np.concatenate(list(bags(text))))


def test_bpe_equals_the_library(documents):
    tokenizer = bpe.load_tokenizer(bpe.vocabulary_path())
    rng = random.Random(2)
    parts = ["a", "B", "é", "́", " ", "\n", "<|endoftext|>", "'s", "'", "1", "ß", "İ", "Σ", " ", "\x1c", "한", "ㄱ", "</w>", "!", "\x01", "ﬁ", "x" * 50]
    for mean in (bpe.MEAN_CHUNK, 4):
        encoder = bpe.ChunkEncoder(tokenizer, store_bytes=20_000)
        cut = bpe.cut_points
        bpe.cut_points, kept = (lambda d, m=mean: cut(d, m)), bpe.cut_points
        try:
            for _ in range(4000):
                text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
                want = tokenizer.encode(text, add_special_tokens=False).ids
                got = encoder.encode(text.encode())
                assert np.frombuffer(b"".join(got), dtype="<u4").tolist() == want, text
                assert "".join(encoder.decode(got)) == tokenizer.decode(want, skip_special_tokens=False)
        finally:
            bpe.cut_points = kept
    rows = {r.doc_id: r for r in bpe.encode_documents(documents(ODD, clash=True)).collect()}
    for k, text in enumerate(ODD):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert rows[k].n_tokens == len(ids)
        assert rows[k].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert rows[k].decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(documents([])).count() == 0


def test_copied_passages_give_equal_chunks():
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(20000)).encode()
    cuts = [bpe.cut_points(b"x" * shift + passage) for shift in (0, 5, 77)]
    inner = [{c - s for c in own} for own, s in zip(cuts, (0, 5, 77))]
    assert len(inner[0] & inner[1] & inner[2]) >= len(inner[0]) - 1 > 5


def test_bpe_long_words_of_multi_byte_text(documents):
    """Paragraphs without blanks, longer than any prefix in bytes, on both sides of a cut."""
    tokenizer = bpe.load_tokenizer(bpe.vocabulary_path())
    rng = random.Random(7)
    texts = []
    for low, high in ((0x4E00, 0x9FA5), (0x3041, 0x3096), (0x0E01, 0x0E2E), (0x1F300, 0x1F5FF)):
        for size in (86, 200, 700):
            texts.append("\n\n".join("".join(chr(rng.randrange(low, high)) for _ in range(size)) for _ in range(40)))
    texts.append("\n\n".join("".join(rng.choice("ab\u4e2d") for _ in range(300)) + " word" * rng.randrange(3) for _ in range(60)))
    rows = {r.doc_id: r for r in bpe.encode_documents(documents(texts)).collect()}
    assert len(rows) == len(texts)
    for k, text in enumerate(texts):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert rows[k].n_tokens == len(ids)
        assert rows[k].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert rows[k].decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
