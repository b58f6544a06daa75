"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the bytes cuts every text where its content says so, so that copied passages give
equal chunks wherever they stand. What lies between a chunk's first and last white space is encoded
once a task and reused for every later chunk that has it; chunks that are new are put together from
the words the task has met before. A cut may fall inside a word: the piece from the last white space
before it to the first one after it is encoded anew, and the encoding of that piece with a word on
either side must agree with what was joined. If it does not, the whole text is encoded in one go.

Both stores are bounded in bytes and start afresh when full, which costs time, not results. Sharing
stays inside a task: sharing over the whole cluster would shuffle all texts and their ids.

A null text is the empty text and has no tokens. Repeated rows are encoded each. Very long texts are
hashed chunk by chunk. Columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from importlib import import_module

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import by_task, table
from .registry import query

MEAN_CHUNK = 2048
STORE_BYTES = 96 << 20
VOCABULARY = "word_bpe_49k.json"
#: A control character between blanks, to encode many words in one call and part their ids again.
MARK = b"\x01"
GAP = b" " + MARK + b" "
#: Words that are encoded in one text.
PART = 500
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Place of a public vocabulary file on this machine."""
    return import_module("public_tokenizers").path(name)


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def cut_points(data: bytes, mean: int = MEAN_CHUNK) -> list[int]:
    """Ends of content-defined chunks: where the hash of the last 16 bytes has a certain remainder."""
    if len(data) <= 16:
        return [len(data)]
    hashed, factor = np.frombuffer(data, dtype=np.uint8).astype(np.uint32) + np.uint32(1), 2654435769
    for width in (1, 2, 4, 8):
        hashed = hashed[width:] + hashed[:-width] * np.uint32(factor)
        factor = factor * factor & 0xFFFFFFFF
    ends = np.flatnonzero((hashed >> np.uint32(7)) % np.uint32(mean) == 0) + 16
    return [*ends[ends < len(data)].tolist(), len(data)]


class ChunkEncoder:
    """Ids of a text as little-endian 32-bit integers, and its decoded text, in pieces."""

    def __init__(self, tokenizer, store_bytes: int = STORE_BYTES):
        self.tokenizer, self.store_bytes = tokenizer, store_bytes
        self.words: dict[bytes, bytes] = {}
        self.chunks: dict[bytes, bytes] = {}
        self.agreed: set[tuple[bytes, bytes, bytes]] = set()
        self.word_size = self.chunk_size = 0
        self.mark = int(np.frombuffer(self.direct(GAP), dtype="<u4")[0])
        self.tokens = [tokenizer.id_to_token(k) or "" for k in range(tokenizer.get_vocab_size())]

    def direct(self, data: bytes) -> bytes:
        ids = self.tokenizer.encode(data.decode(), add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def learn(self, words: set[bytes]) -> None:
        """Encode the words that the store lacks, all at once."""
        if self.word_size > self.store_bytes:
            self.words, self.word_size = {}, 0
        new = list(words.difference(self.words))
        plain = [w for w in new if MARK not in w]
        parts = [plain[k : k + PART] for k in range(0, len(plain), PART)]
        got = self.tokenizer.encode_batch_fast([GAP.join(part).decode() for part in parts], add_special_tokens=False)
        for part, encoding in zip(parts, got):
            ids = np.array(encoding.ids, dtype="<u4")
            flat, ends = ids.tobytes(), (np.flatnonzero(ids == self.mark) * 4).tolist()
            ends.append(4 * len(ids))
            if len(ends) == len(part):  # else the tokenizer does not keep the mark apart
                self.words.update(zip(part, [flat[s:e] for s, e in zip([0, *[e + 4 for e in ends[:-1]]], ends)]))
                self.word_size += len(flat)
        self.words.update([(w, self.direct(w)) for w in new if w not in self.words])
        self.word_size += sum(map(len, new)) + 180 * len(new)

    def encode_words(self, words: list[bytes]) -> bytes:
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            self.learn(set(words))
            return b"".join(map(self.words.__getitem__, words))

    def prepare(self, texts: list[bytes]) -> None:
        """Learn the words of many texts in one call; texts beyond a store's worth are left for later."""
        words: set[bytes] = set()
        size = 0
        for data in texts:
            words.update(data.split())
            size += len(data)
            if size > self.store_bytes:
                break
        self.learn(words)

    def encode_chunk(self, core: bytes) -> bytes:
        ids = self.chunks.get(core)
        if ids is None:
            ids = self.encode_words(core.split())
            if self.chunk_size > self.store_bytes:
                self.chunks, self.chunk_size = {}, 0
            self.chunks[core] = ids
            self.chunk_size += len(core) + len(ids) + 180
        return ids

    def agrees(self, before: bytes, join: bytes, after: bytes) -> bool:
        """Whether the piece at a cut is encoded alike with its neighbours around it."""
        key = (before, join, after)
        if key not in self.agreed:
            if self.direct(b" ".join(key)) != self.encode_words([w for w in key if w]):
                return False
            if len(self.agreed) > 100_000:
                self.agreed = set()
            if sum(map(len, key)) < 1024:
                self.agreed.add(key)
        return True

    def encode(self, data: bytes) -> list[bytes]:
        out: list[bytes] = []
        start, pending, before = 0, b"", b""
        for end in cut_points(data):
            chunk, start = data[start:end], end
            first = _SPACE.search(chunk)
            if first is None:
                pending += chunk
                continue
            last = max(chunk.rfind(s) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            join, core = pending + chunk[: first.start()], chunk[first.start() : last]
            if join:
                after = (core.split(None, 1)[:1] or [b""])[0]
                if out and not self.agrees(before, join, after):
                    return [self.direct(data)]
                out.append(self.encode_words([join]))
            if core:
                out.append(self.encode_chunk(core))
            before, pending = (core.rsplit(None, 1)[-1:] or [b""])[0], chunk[last + 1 :]
        if pending:
            out.append(self.encode_words([pending]))
        return out

    def decode(self, pieces: list[bytes]) -> list[str]:
        """Text of the ids, in parts that follow one another."""
        ids = [np.frombuffer(p, dtype="<u4").tolist() for p in pieces if p]
        if self.tokenizer.decoder is None:  # decoding then sets blanks between the tokens
            parts = [" ".join(map(self.tokens.__getitem__, piece)) for piece in ids]
            return [part if n == 0 else " " + part for n, part in enumerate(parts)]
        return [self.tokenizer.decode([k for piece in ids for k in piece], skip_special_tokens=False)]


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row; ``path`` is a tokenizer file that
    every executor can read (by default the installed public vocabulary)."""

    def make():
        encoder = ChunkEncoder(load_tokenizer(path or vocabulary_path()))

        def fn(batch):
            rows = []
            texts = [(text or "").encode() for text in batch.column(1).to_pylist()]
            encoder.prepare(texts)
            for data in texts:
                ids, decoded, n = hashlib.sha256(), hashlib.sha256(), 0
                pieces = encoder.encode(data)
                for piece in pieces:
                    ids.update(piece)
                    n += len(piece) // 4
                for part in encoder.decode(pieces):
                    decoded.update(part.encode())
                rows.append((n, ids.hexdigest(), decoded.hexdigest()))
            n, ids, decoded = zip(*rows)
            return pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return fn

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return by_task(docs.select("doc_id", "text"), make, schema)


@query("op10_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir))
