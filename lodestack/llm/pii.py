"""Operator 3: personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in the whole text: at-signs, plus signs, digits, URL schemes and identifier
cues. From each anchor a deterministic parser looks only at the neighbouring characters that can belong to a match:

* ``email``: the run of local characters to the left of an at-sign and the longest dotted name to its right;
* ``ip`` and ``card``: the run of digits and separators around a digit, read from its left end;
* ``phone``: from a plus sign to the last digit of its run;
* ``secret`` (added): the value after a cue like ``password`` in any case and a sign of assignment, spaces and quotes
  around it allowed (after a colon only a value in quotes or with a digit), after ``bearer``, and key ids that start with
  ``AKIA``;
* ``url`` (added): a URL that carries credentials, ``scheme://user:password@host``;
* ``iban`` (added): two letters, two check digits and 11 to 30 characters that pass the mod 97 test.

Matches of a kind never overlap; a match that fails its test (parts over 255, Luhn, number of digits) is dropped and
reading goes on after it. Spans are code points, end exclusive. The first four kinds give just what the patterns of
``BASE`` find from left to right.

Cases: null texts are empty; empty texts have no spans; a text of any length is read once from left to right, in time
proportional to its length; repeated rows are rows like others; the digest of no span is that of an empty string; an
empty table gives an empty result; only ``doc_id`` and ``text`` are read, other columns may have any name.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of

KINDS = ("email", "ip", "card", "phone", "secret", "url", "iban")
BASE = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_VALUE = re.compile(r"[\"'`]?[ \t]{0,8}(:=|=>|==?|:)[ \t]{0,8}([\"'`]?)([^\s\"'`<>,;]{4,})")
_BEARER = re.compile(r"[ \t]{1,8}([A-Za-z0-9._~+/-]{16,}=*)")
_KEY_ID = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")
_USERINFO = re.compile(r"://[^\s/@:]+:[^\s/@]+@[^\s<>\"']+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_CUES = ("password", "passwd", "passphrase", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "secret_key", "private_key")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for d in _DIGITS:
        found.add_word(d, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    found.add_word("akia", ("key", 4))
    found.add_word("bearer", ("bearer", 6))
    for cue in _CUES:
        found.add_word(cue, ("cue", len(cue)))
    found.make_automaton()
    return found


def lowered(text: str) -> str:
    """The text in lower case, every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_ASCII_LOWER)


def _secret(anchor: str, text: str, at: int, last: int) -> tuple[int, int] | None:
    """Start and end of the secret that the anchor from ``at`` to ``last`` announces."""
    if anchor == "key":
        found = _KEY_ID.match(text, at)
        return found and found.span()
    if anchor == "bearer":
        found = _BEARER.match(text, last + 1)
        return found and found.span(1)
    found = _VALUE.match(text, last + 1)
    if not found or found[1] == ":" and not found[2] and not any(c in _DIGITS for c in found[3]):
        return None
    return found.span(3)


_ANCHORS = _automaton()


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def _mod97(code: str) -> bool:
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind's index, end)`` of all personal data in a text, sorted."""
    out: list[tuple[int, int, int]] = []
    done = dict.fromkeys(KINDS, 0)  # where the next match of a kind may start
    for last, (anchor, size) in _ANCHORS.iter(lowered(text)):
        at = last - size + 1
        if anchor == "digit":
            if at >= done["ip"]:
                _dotted(text, at, done, out)
            if at >= done["card"]:
                found = _NUMBER.match(text, at)
                done["card"] = found.end() if found else at + 1
                if found:
                    digits = found[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        out.append((at, 2, found.end()))
            if at >= done["iban"] and at >= 2 and text[at - 1].isupper() and text[at - 2].isupper() and (at == 2 or not text[at - 3].isalnum()):
                found = _IBAN.match(text, at - 2)
                if found and _mod97(found[0]):
                    out.append((at - 2, 6, found.end()))
                    done["iban"] = found.end()
        elif anchor == "at":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            found = _DOMAIN.match(text, at + 1) if start < at else None
            if found:
                out.append((start, 0, found.end()))
                done["email"] = found.end()
        elif anchor == "plus":
            found = _PHONE.match(text, at) if at >= done["phone"] else None
            if found:
                done["phone"] = found.end()
                if 9 <= sum(c in _DIGITS for c in found[0]) <= 15:
                    out.append((at, 3, found.end()))
        elif anchor == "scheme":
            found = _USERINFO.match(text, at) if at >= done["url"] else None
            start = at
            while start > done["url"] and (text[start - 1].isalnum() or text[start - 1] in "+.-"):
                start -= 1
            if found and start < at:
                out.append((start, 5, found.end()))
                done["url"] = found.end()
        elif at >= done["secret"]:
            found = _secret(anchor, text, at, last)
            if found:
                out.append((found[0], 4, found[1]))
                done["secret"] = found[1]
    return sorted(out)


def _dotted(text: str, at: int, done: dict, out: list) -> None:
    """An address that starts at the digit ``at``; without one, the digits up to the next point are passed over."""
    found = _IP.match(text, at)
    if found:
        done["ip"] = found.end()
        if all(map(_octet, found[0].split("."))):
            out.append((at, 1, found.end()))
        return
    stop = at
    while stop < len(text) and text[stop] in _DIGITS:
        stop += 1
    done["ip"] = stop


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def op3(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, counts of the base kinds, ``base_sha256`` of their spans, all ``spans``, ``n_other`` spans of
    the added kinds, ``has_pii`` if there is any span."""

    names = [*(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_other", "has_pii"]

    def one(text: str | None) -> tuple:
        found = spans(text or "")
        base = [x for x in found if x[1] < len(BASE)]
        kinds = [x[1] for x in base]
        digest = hashlib.sha256(joined(base).encode()).hexdigest()
        return (*(kinds.count(k) for k in range(len(BASE))), digest, joined(found), len(found) - len(base), bool(found))

    @F.arrow_udf("struct<n_email:long,n_ip:long,n_card:long,n_phone:long,base_sha256:string,spans:string,n_other:long,has_pii:boolean>")
    def run(texts: pa.Array) -> pa.Array:
        return rows_of(names, [pa.int64()] * len(BASE) + [pa.string()] * 2 + [pa.int64(), pa.bool_()], (one(t.as_py()) for t in texts))

    return docs.select("doc_id", run("text").alias("p")).select("doc_id", "p.*")
