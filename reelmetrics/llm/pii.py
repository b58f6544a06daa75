"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs, the digits' neighbourhoods,
url schemes and identifier cues. From each anchor a local parser expands to the left and right,
validates what it finds and gives a span in code points. No parser looks further than the characters
its kind may consist of, so a very long text costs time in proportion to its length.

Base kinds, leftmost and non-overlapping within a kind: ``email``, ``ip`` (four parts of at most 255),
``card`` (13 to 19 digits, Luhn), ``phone`` (9 to 15 digits after a plus). Further kinds: ``account``
(after a cue such as "IBAN" or "account number": an IBAN whose check digits hold, or 6 to 17 digits)
and ``login`` (a url scheme followed by user:password@). A match that fails validation is dropped and
not tried again at another place. A null text has no spans. Repeated rows are searched each.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import by_task, table
from .registry import query

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "login")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://", "mongodb://", "redis://")
CUES = ("iban", "account number", "account no", "acct no", "account id", "kontonummer", "numéro de compte", "número de cuenta")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_RUN = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"[0-9][\x20().0-9-]+")
_LOGIN = re.compile(r"[A-Za-z0-9._~%-]+:[^\x00-\x20@/?#]+@")
_AFTER_CUE = re.compile(r"[\x20.:#=-]{1,6}")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{1,4}){3,8}")
_NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9]){5,16}(?![0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def iban_holds(text: str) -> bool:
    code = text.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def expand_email(text: str, at: int, after: int) -> tuple[int, int] | None:
    """The address around an at-sign that starts at ``after`` or later."""
    start = at
    while start > after and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, at + 1) if start < at else None
    return (start, domain.end()) if domain else None


def expand_digits(text: str):
    """Spans of ip and card around runs of digits."""
    ip, chain = [], []
    for run in _RUN.finditer(text):
        if chain and run.start() == chain[-1][1] + 1 and text[run.start() - 1] == ".":
            chain.append(run.span())
        else:
            chain = [run.span()]
        if len(chain) == 4:
            if all(len(part) <= 3 and int(part) <= 255 for part in (text[s:e].lstrip("0") or "0" for s, e in chain)):
                ip.append((chain[0][0], chain[-1][1]))
            chain = []
    card = []
    for found in _CARD.finditer(text):
        digits = found[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            card.append(found.span())
    return ip, card


def expand_phone(text: str, plus: int) -> tuple[tuple[int, int] | None, int]:
    """The number after a plus sign, and where the search for the next one may begin."""
    found = _PHONE.match(text, plus + 1)
    if not found:
        return None, plus
    end = found.end()
    while not "0" <= text[end - 1] <= "9":
        end -= 1
    if end < plus + 4:
        return None, plus
    digits = sum("0" <= c <= "9" for c in text[plus + 1 : end])
    return ((plus, end) if 9 <= digits <= 15 else None), end


def expand_account(text: str, end: int) -> tuple[int, int] | None:
    """The identifier after a cue that ends before ``end``."""
    gap = _AFTER_CUE.match(text, end)
    if not gap:
        return None
    iban = _IBAN.match(text, gap.end())
    if iban:
        stop = iban.end()
        while stop > iban.start() + 14:  # the last group may be the next word of the sentence
            if text[stop - 1] != " " and iban_holds(text[iban.start() : stop]):
                return iban.start(), stop
            stop -= 1
        return None
    number = _NUMBER.match(text, gap.end())
    return number.span() if number else None


def automaton():
    import ahocorasick

    cues = ahocorasick.Automaton()
    for sign in "@+":
        cues.add_word(sign, (sign, 1))
    for word in SCHEMES:
        cues.add_word(word, ("login", len(word)))
    for word in CUES:
        for form in {word, word.capitalize(), word.upper(), word.title()}:
            cues.add_word(form, ("account", len(form)))
    cues.make_automaton()
    return cues


def find_spans(text: str, cues) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, each kind in order of the text and free of overlaps."""
    found = {kind: [] for kind in KINDS}
    free = dict.fromkeys(KINDS, 0)  # where a kind's next span may begin
    for last, (kind, _) in cues.iter(text):
        span = None
        if kind == "@":
            kind, span = "email", expand_email(text, last, free["email"])
        elif kind == "+":
            kind = "phone"
            if last >= free["phone"]:
                span, free["phone"] = expand_phone(text, last)
        elif kind == "login":
            match = _LOGIN.match(text, last + 1)
            span = (last + 1, match.end() - 1) if match else None
        elif not text[last + 1 : last + 2].isalnum():
            span = expand_account(text, last + 1)
        if span and (kind == "phone" or span[0] >= free[kind]):
            found[kind].append(span)
            free[kind] = span[1]
    found["ip"], found["card"] = expand_digits(text)
    return found


def joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind in kinds for s, e in found[kind])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_account, n_login) for every row."""

    def make():
        cues = automaton()

        def fn(batch):
            rows = [find_spans(t or "", cues) for t in batch.column(1).to_pylist()]
            counts = [pa.array([len(r[kind]) for r in rows], pa.int64()) for kind in KINDS]
            digest = pa.array([hashlib.sha256(joined(r, BASE).encode()).hexdigest() for r in rows])
            spans = pa.array([joined(r, KINDS) for r in rows])
            return pa.record_batch(
                [batch.column(0), *counts[:4], digest, spans, *counts[4:]],
                ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", *(f"n_{k}" for k in KINDS[4:])],
            )

        return fn

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_account long, n_login long"
    return by_task(docs.select("doc_id", "text"), make, schema)


@query("op4_pii")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir))
