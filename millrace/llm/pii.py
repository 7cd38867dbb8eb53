"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs,
schemes, plus signs, digits and identifier cues. From each anchor a
deterministic local parser expands to the boundaries of an e-mail address, an
IP address, a card, a phone number, a credential URL or an account, and
validates it (parts, digit counts, Luhn, mod 97). The rest of the text is never
looked at twice.

Base kinds are e-mail, ip, card and phone, leftmost and non-overlapping within
their kind; a match that fails its validation is dropped and its text is not
tried again. Added kinds: ``account`` (an IBAN by its check digits, or what
follows a cue such as "ssn" or "account number") and ``url`` (a scheme with user
data before an at-sign).

Defined results: a null or empty text has no spans; whole texts of any length
are read; rows that repeat are scanned each; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._shared import read_table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "url")
DIGITS = frozenset("0123456789")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | {"-"}
CALL = DIGITS | frozenset(" ().-")
USER = ALNUM | frozenset("._%+-~!$&'*;=:")
#: Cues after which an identifier with digits is an account; letters around a cue end it.
CUES = ("iban", "ssn", "social security number", "account number", "account no", "acct", "passport number", "passport no", "routing number", "tax id")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "postgres://", "postgresql://", "mysql://", "mongodb://", "redis://", "amqp://")

Span = tuple[int, int, int]


def anchors() -> ahocorasick.Automaton:
    """Patterns to (kind of anchor, length)."""
    a = ahocorasick.Automaton()
    for s in DIGITS:
        a.add_word(s, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word("://", ("scheme", 3))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            a.add_word(form, ("cue", len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = x * 2 - 9 if x > 4 else x * 2
        total += x
    return total % 10 == 0


def iban(code: str) -> bool:
    if not (15 <= len(code) <= 34 and code[:2].isalpha() and code[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _run(text: str, at: int, allowed: frozenset) -> int:
    """End of the run of ``allowed`` characters that begins at ``at``."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Expands an at-sign to (start, end); nothing before ``floor`` is taken."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    dotted = False
    while end < len(text) and text[end] == "." and (stop := _run(text, end + 1, LABEL)) > end + 1:
        dotted, end = True, stop
    return (start, end) if dotted else None


def addresses(text: str, start: int) -> tuple[list[tuple[int, int, bool]], int]:
    """Four-part addresses in the run of digits and single dots at ``start``; where the run ends."""
    parts, at = [], start
    while True:
        end = _run(text, at, DIGITS)
        parts.append((at, end))
        if end + 1 < len(text) and text[end] == "." and text[end + 1] in DIGITS:
            at = end + 1
        else:
            break
    found = []
    for i in range(0, len(parts) - 3, 4):
        four = parts[i : i + 4]
        fits = all(len(p := text[a:b].lstrip("0")) <= 3 and int(p or 0) <= 255 for a, b in four)
        found.append((four[0][0], four[3][1], fits))
    return found, end


def chain(text: str, start: int) -> int:
    """End of the digits at ``start``, each parted from the last by one space or hyphen at most."""
    at, n = start + 1, len(text)
    while at < n:
        if text[at] in DIGITS:
            at += 1
        elif text[at] in " -" and at + 1 < n and text[at + 1] in DIGITS:
            at += 2
        else:
            break
    return at


def phone(text: str, plus: int) -> int | None:
    """End of the number after a plus sign: its last digit, two characters on or more."""
    if plus + 1 >= len(text) or text[plus + 1] not in DIGITS:
        return None
    end = _run(text, plus + 2, CALL)
    while end > plus + 2 and text[end - 1] not in DIGITS:
        end -= 1
    return end if end > plus + 3 else None


def account(text: str, cue_start: int, cue_end: int) -> tuple[int, int] | None:
    """The identifier after a cue: separators, then 5 to 34 letters and digits in groups, 5 digits or more."""
    if (cue_start and text[cue_start - 1] in ALNUM) or (cue_end < len(text) and text[cue_end] in ALNUM):
        return None
    at = _run(text, cue_end, frozenset(" :#=.\t\"'"))
    if at == cue_end or at - cue_end > 6:
        return None
    end = start = at
    while end < len(text) and (text[end] in ALNUM or (text[end] in "- " and end + 1 < len(text) and text[end + 1] in DIGITS and end > start)):
        end += 1
    body = [c for c in text[start:end] if c in ALNUM]
    if not 5 <= len(body) <= 34 or sum(c in DIGITS for c in body) < 5:
        return None
    return start, end


def iban_at(text: str, digit: int) -> tuple[int, int] | None:
    """An IBAN whose check digits begin at ``digit``: two capitals before, groups of four after."""
    start = digit - 2
    if start < 0 or not (text[start : start + 2].isascii() and text[start : start + 2].isalpha() and text[start : start + 2].isupper()) or (start and text[start - 1] in ALNUM):
        return None
    end, body = start, ""
    while end < len(text) and len(body) < 34 and (text[end] in ALNUM or (text[end] == " " and end + 1 < len(text) and text[end + 1] in ALNUM and len(body) % 4 == 0)):
        if text[end] != " ":
            body += text[end]
        end += 1
        if len(body) >= 15 and (end == len(text) or text[end] not in ALNUM) and iban(body.upper()):
            return start, end
    return None


def credential_url(text: str, colon: int) -> tuple[int, int] | None:
    """A URL that carries user data: scheme, user, at-sign, host."""
    start = colon
    while start > 0 and text[start - 1] in ALNUM:
        start -= 1
    if text[start : colon + 3].lower() not in SCHEMES:
        return None
    end = _run(text, colon + 3, USER)
    if end == colon + 3 or end >= len(text) or text[end] != "@":
        return None
    host = _run(text, end + 1, LABEL | {"."})
    return (start, host) if host > end + 1 else None


def spans(text: str, automaton: ahocorasick.Automaton) -> list[Span]:
    """(start, kind index, end) of every span, by start and then kind."""
    out: list[Span] = []
    mail_end = ip_end = card_end = call_end = other_end = 0
    for last, (what, length) in automaton.iter(text):
        start = last - length + 1
        if what == "digit":
            if start >= ip_end and not (start and text[start - 1] in DIGITS):
                found, ip_end = addresses(text, start)
                out += [(a, 1, b) for a, b, fits in found if fits]
            if start >= card_end:
                card_end = chain(text, start)
                if card_end - start >= 14:
                    digits = "".join([c for c in text[start:card_end] if c in DIGITS])
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        out.append((start, 2, card_end))
            if start >= other_end and start >= 2 and (found := iban_at(text, start)):
                out.append((found[0], 4, found[1]))
                other_end = found[1]
        elif what == "at":
            if start >= mail_end and (found := email(text, start, mail_end)):
                out.append((found[0], 0, found[1]))
                mail_end = found[1]
        elif what == "plus":
            if start >= call_end and (end := phone(text, start)):
                call_end = end
                if 10 <= sum(c in DIGITS for c in text[start:end]) <= 15:
                    out.append((start, 3, end))
        elif what == "cue":
            if start >= other_end and (found := account(text, start, last + 1)):
                out.append((found[0], 4, found[1]))
                other_end = found[1]
        elif found := credential_url(text, start):
            out.append((found[0], 5, found[1]))
    return sorted(out)


def shown(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        for batch in batches:
            found = [spans(t.as_py() or "", automaton) for t in batch.column("text")]
            counts = [pa.array([sum(k == i for _, k, _ in f) for f in found], pa.int64()) for i in range(len(BASE))]
            base = [hashlib.sha256(shown([s for s in f if s[1] < len(BASE)]).encode()).hexdigest() for f in found]
            columns = [batch.column("doc_id"), *counts, pa.array(base, pa.string()), pa.array([shown(f) for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))
