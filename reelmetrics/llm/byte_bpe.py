"""Byte-level BPE with the tokenizers library over Arrow batches.

The library works on characters, so each of the 256 bytes stands for a printable character: printable
Latin-1 bytes for themselves, the others for characters from U+0100 on. A file of ranks (token bytes in
base64, rank) gives the vocabulary; the merges are all ways to put a token together from two others,
by the token's rank, which is what a rank file allows. Every match of the pattern is encoded by itself,
and one that is a token as a whole is that token.

The library reports for each token the characters it stands on. A token may hold a part of a
character's bytes; then several tokens report that character. Decoding turns token characters back
into bytes by the reversed table and joins the bytes before it reads characters, so split characters
come back whole.

Long texts go to the library in pieces that end before white space, where no match can run across;
a stretch without white space is one piece. Nulls are empty texts and have no tokens. Repeated rows
are encoded each. An empty table gives no rows. Columns other than id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from importlib import import_module

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .registry import query

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Characters of one piece of a text, and of the texts of one call (a longer text is a call alone).
PIECE = 1 << 18
CALL = 1 << 20
_CUT = re.compile(r"[^\s](?=[ \n])")


def byte_characters() -> list[str]:
    """The character that stands for each byte."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    table, further = [], 0x100
    for byte in range(256):
        table.append(chr(byte if byte in printable else further))
        further += byte not in printable
    return table


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, file)))}


class ByteBpe:
    """Tokenizer of a rank file: ids, their places in the text, and bytes of ids."""

    def __init__(self, path: str | None = None, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        public = None if path and pattern else import_module("public_tokenizers")
        ranks = read_ranks(path or public.path(VOCABULARY))
        chars = byte_characters()
        written = {token: "".join(map(chars.__getitem__, token)) for token in ranks}
        merges = [
            (written[token[:k]], written[token[k:]])
            for token in sorted(ranks, key=ranks.__getitem__)
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        ]
        model = models.BPE(vocab={written[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern or public.PATTERN), "removed", invert=True), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        back = {c: bytes([b]) for b, c in enumerate(chars)}
        self.bytes_of = {k: b"".join(map(back.__getitem__, token)) for token, k in self.tokenizer.get_vocab().items()}
        #: Whether a token's first byte continues a character.
        self.inside = np.zeros(max(self.bytes_of, default=0) + 1, dtype=bool)
        self.inside[[k for k, token in self.bytes_of.items() if 0x80 <= token[0] < 0xC0]] = True

    def encode(self, texts: list[str], places: bool = True) -> Iterator[list[tuple[np.ndarray, np.ndarray | None]]]:
        """For each text its pieces in order: (ids, (start, end) of the characters they stand on; None
        unless asked for)."""
        held: list[list[tuple[int, str]]] = []
        size = 0
        for text in texts:
            held.append(list(pieces(text)))
            size += len(text)
            if size >= CALL:
                yield from self._call(held, places)
                held, size = [], 0
        yield from self._call(held, places)

    def _call(self, held: list[list[tuple[int, str]]], places: bool) -> Iterator[list[tuple[np.ndarray, np.ndarray | None]]]:
        run = self.tokenizer.encode_batch if places else self.tokenizer.encode_batch_fast
        got = iter(run([piece for own in held for _, piece in own], add_special_tokens=False))
        for own in held:
            parts = []
            for (at, _), encoding in zip(own, got):
                parts.append((np.array(encoding.ids, dtype="<u4"), np.array(encoding.offsets, dtype=np.int64).reshape(-1, 2) + at if places else None))
            yield parts

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def pieces(text: str, size: int = PIECE) -> Iterator[tuple[int, str]]:
    """(start, piece) of a text; a piece ends at the text's end or before a blank or line end that
    follows another character."""
    at = 0
    while len(text) - at > size:
        found = _CUT.search(text, at + size)
        if not found:
            break
        yield at, text[at : found.end()]
        at = found.end()
    yield at, text[at:]


def split_characters(places: np.ndarray) -> int:
    """Characters that more than one token stands on."""
    shared = places[1:, 0] < places[:-1, 1]
    return len(np.unique(places[1:][shared, 0]))


def _batches(docs: DataFrame, make, fn, schema: str) -> DataFrame:
    def run(batches):
        tool = make()
        for batch in batches:
            if batch.num_rows:
                yield fn(tool, batch)

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids, first, end) for every row; ``first`` and ``end`` are the characters that a token
    stands on. ``path`` is a rank file that every executor can read (by default the installed one)."""

    def fn(tool: ByteBpe, batch):
        got = [[np.concatenate(c) for c in zip(*parts)] for parts in tool.encode([t or "" for t in batch.column(1).to_pylist()])]
        lists = [pa.array([own[0] for own in got], pa.list_(pa.int64()))] + [pa.array([own[1][:, k] for own in got], pa.list_(pa.int64())) for k in (0, 1)]
        return pa.record_batch([batch.column(0), *lists], ["doc_id", "ids", "first", "end"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _batches(docs.select("doc_id", "text"), lambda: ByteBpe(path, pattern), fn, f"doc_id {kind}, ids array<long>, first array<long>, end array<long>")


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, data, text) of rows (doc_id, ids): the bytes, and the text where they are UTF-8 (bytes
    of a character that is not whole become U+FFFD). Null ids are no ids."""

    def fn(tool: ByteBpe, batch):
        data = [tool.decode(ids or ()) for ids in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(data, pa.binary()), pa.array([d.decode(errors="replace") for d in data])], ["doc_id", "data", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return _batches(encoded.select("doc_id", "ids"), lambda: ByteBpe(path, pattern), fn, f"doc_id {kind}, data binary, text string")


def encode_digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_split) for every row, without the ids leaving
    the task; ``n_split`` counts the tokens that begin inside a character."""

    def fn(tool: ByteBpe, batch):
        rows = []
        for parts in tool.encode([t or "" for t in batch.column(1).to_pylist()], places=False):
            ids, decoded, n, split = hashlib.sha256(), hashlib.sha256(), 0, 0
            for own, _ in parts:
                ids.update(own.tobytes())
                decoded.update(tool.decode(own.tolist()))
                n += len(own)
                split += int(tool.inside[own].sum())
            rows.append((n, ids.hexdigest(), decoded.hexdigest(), split))
        n, ids, decoded, split = zip(*rows)
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded), pa.array(split, pa.int64())]
        return pa.record_batch(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_split"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long"
    return _batches(docs.select("doc_id", "text"), lambda: ByteBpe(path, pattern), fn, schema)


@query("op11_byte_bpe")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
