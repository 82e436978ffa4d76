"""Personal data by anchor expansion (operator 3).

One Aho-Corasick pass finds anchors: at-signs, schemes, plus signs, digits and
identifier cues.  At each anchor a small deterministic parser expands to the
left and right, fixes the boundaries and validates (Luhn, part sizes, digit
counts, IBAN check digits).  Kinds, in the order in which they are listed:

* ``email``, ``ip``, ``card``, ``phone``: leftmost, non-overlapping per kind; a
  match that fails its validation is dropped and not retried;
* added by the method: ``url`` (scheme with a host), ``iban`` (mod-97 valid,
  after its cue) and ``account`` (6 to 20 digits after an account cue).

Every text gives one row: null and empty texts have no spans, repeated rows
give repeated rows, an empty table an empty result.  Offsets are code points,
ends exclusive.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches_of, record, texts

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("url", "iban", "account")
ACCOUNT_CUES = ("account", "acct", "konto", "kontonummer", "compte", "cuenta")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HOST = re.compile(r"(?:[^\s/@\"'<>]+@)?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]{1,5})?(?:[/?#][^\s\"'<>]*)?")
_IBAN = re.compile(r"[\s:#.]{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{2,4}){3,8})")
_ACCOUNT = re.compile(r"(?:\x20?(?:no|nr|number|num)\b\.?)?[\s:#.]{0,4}([0-9](?:[\x20-]?[0-9]){5,19})(?![0-9])", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def iban_valid(code: str) -> bool:
    s = code[4:] + code[:4]
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def build_automaton():
    import ahocorasick
    a = ahocorasick.Automaton()
    for k in "0123456789":
        a.add_word(k, ("digit", 1))
    a.add_word("@", ("email", 1))
    a.add_word("+", ("phone", 1))
    a.add_word("://", ("url", 3))
    for cue in ("iban", "IBAN", "Iban"):
        a.add_word(cue, ("iban", 4))
    for cue in ACCOUNT_CUES:
        for form in {cue, cue.capitalize(), cue.upper()}:
            a.add_word(form, ("account", len(form)))
    a.make_automaton()
    return a


def find_spans(text: str, automaton) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of every span, by kind, then start."""
    out = []
    end = [0] * len(KINDS)  # where the last match of a kind ended
    run = -2                # last digit position: a digit right after it continues a run
    for last, (what, size) in automaton.iter(text):
        at = last - size + 1
        if what == "digit":
            fresh, run = at != run + 1, at
            if at >= end[1] and (fresh or at == end[1]):
                m = _IP.match(text, at)
                if m:
                    end[1] = m.end()
                    if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m.group().split(".")):
                        out.append((1, at, m.end()))
            if at >= end[2]:
                m = _CARD.match(text, at)
                if m:
                    end[2] = m.end()
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        out.append((2, at, m.end()))
        elif what == "email":
            start = at
            while start > end[0] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                m = _DOMAIN.match(text, at + 1)
                if m:
                    end[0] = m.end()
                    out.append((0, start, m.end()))
        elif what == "phone":
            if at >= end[3]:
                m = _PHONE.match(text, at)
                if m:
                    end[3] = m.end()
                    if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                        out.append((3, at, m.end()))
        elif what == "url":
            start = at
            while start > end[4] and text[start - 1] in _SCHEME:
                start -= 1
            while start < at and not text[start].isalpha():
                start += 1
            m = _HOST.match(text, at + 3) if start < at else None
            if m and m.end() > at + 3:
                end[4] = m.end()
                out.append((4, start, m.end()))
        elif what == "iban":
            m = _IBAN.match(text, last + 1)
            if m and m.start(1) >= end[5] and iban_valid(m.group(1).replace(" ", "")):
                end[5] = m.end(1)
                out.append((5, m.start(1), m.end(1)))
        elif at == 0 or not text[at - 1].isalnum():
            m = _ACCOUNT.match(text, last + 1)
            if m and m.start(1) >= end[6]:
                end[6] = m.end(1)
                out.append((6, m.start(1), m.end(1)))
    return sorted(set(out))


def _scan(batches):
    automaton = build_automaton()
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE_KINDS),
                        ("base_sha256", pa.string()), ("spans", pa.string())])
    for ids, rows in batches_of(batches, "doc_id", "text"):
        counts, shas, joined = [[] for _ in BASE_KINDS], [], []
        for text in rows:
            found = find_spans(text, automaton) if text else []
            named = [f"{KINDS[k]}:{s}:{e}" for k, s, e in found]
            n_base = sum(k < len(BASE_KINDS) for k, _, _ in found)
            for k, c in enumerate(counts):
                c.append(sum(x[0] == k for x in found))
            shas.append(hashlib.sha256(",".join(named[:n_base]).encode()).hexdigest())
            joined.append(",".join(named))
        yield record(schema, [ids, *counts, shas, joined])


def scan_personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of the base
    spans and all spans as ``kind:start:end``."""
    return texts(docs).mapInArrow(
        _scan, "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE_KINDS) + ", base_sha256 string, spans string")


def mask_personal_data(docs: DataFrame, mark: str = "[{kind}]") -> DataFrame:
    """``doc_id`` and the text with every span replaced by ``mark``."""
    def mask(batches):
        automaton = build_automaton()
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
        for ids, rows in batches_of(batches, "doc_id", "text"):
            done = []
            for text in rows:
                parts, at = [], 0
                for k, s, e in sorted(find_spans(text, automaton), key=lambda x: (x[1], -x[2])) if text else []:
                    if s >= at:
                        parts += [text[at:s], mark.format(kind=KINDS[k].upper())]
                        at = e
                done.append("".join(parts) + text[at:])
            yield record(schema, [ids, done])
    return texts(docs).mapInArrow(mask, "doc_id long, text string")
