"""Text expressions: names, stripping, sentinels, keys for clustering, masks, check digits."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def snake_case(name: str) -> str:
    """A column label in snake case: camel humps split, other characters to single underscores."""
    s = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name.strip())
    return re.sub(r"_+", "_", re.sub(r"\W+", "_", s)).strip("_").lower()


def unique_names(names: list[str]) -> list[str]:
    """Snake-case labels made unique by _2, _3, ...; an empty one becomes column_<position>."""
    wanted = [snake_case(n) or f"column_{i}" for i, n in enumerate(names)]
    taken, seen, out = set(wanted), {}, []
    for w in wanted:
        seen[w] = seen.get(w, 0) + 1
        name = w
        if seen[w] > 1:
            k = seen[w]
            while f"{w}_{k}" in taken:
                k += 1
            name = f"{w}_{k}"
            taken.add(name)
        out.append(name)
    return out


#: White space of any script: what Unicode gives the property White_Space.
WHITE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without white space (of any script) at either end."""
    return F.btrim(c, F.lit(WHITE))


def is_sentinel(stripped: Column, sentinels: tuple[str, ...]) -> Column:
    return F.lower(stripped).isin(*sentinels)


def fingerprint(c: Column) -> Column:
    """Sorted distinct lower-case words without punctuation."""
    words = F.split(F.regexp_replace(F.lower(strip(c)), r"(?U)[^\w\s]|_", ""), r"(?U)\s+")
    return F.array_join(F.array_sort(F.array_distinct(F.filter(words, lambda w: w != ""))), " ")


def ngram_key(c: Column, n: int = 2) -> Column:
    """Sorted distinct n-grams of the ASCII letters and digits; a shorter value is its own key."""
    s = F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    grams = F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: s.substr(i, F.lit(n)))
    return F.when(F.length(s) < n, s).otherwise(F.array_join(F.array_sort(F.array_distinct(grams)), ""))


def hmac_sha256(c: Column, salt: str, length: int = 16) -> Column:
    """Keyed hash by two nested SHA-256, as in RFC 2104."""
    key = salt.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    digest = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, c.cast("string").cast("binary")), 256))), 256)
    return F.substring(digest, 1, max(4, min(64, length)))


def partial_mask(c: Column, visible: int = 4, placeholder: str = "***") -> Column:
    s = c.cast("string")
    return F.when(c.isNull(), None).otherwise(F.lit(placeholder) if visible <= 0 else F.concat(F.lit(placeholder), s.substr(-visible, visible) if visible else F.lit("")))


#: Patterns of personal data that scrubbing replaces, in this order.
SCRUB = {
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "phone": r"(?<!\w)(?:\+?\d{1,3}[\s.\-]?)?(?:\(\d{3}\)|\d{3})[\s.\-]?\d{3}[\s.\-]?\d{4}(?!\w)",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b(?:\d[ \-]?){13,16}\b",
    "ip": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b",
}


def scrub(c: Column, names: tuple[str, ...], regexes: tuple[str, ...], placeholder: str) -> Column:
    safe = placeholder.replace("\\", "\\\\").replace("$", "\\$")
    for name in names:  # a text without the sign that each form needs isn't searched
        sign = c.contains("@") if name == "email" else c.rlike(r"\p{Nd}")
        c = F.when(sign, F.regexp_replace(c, "(?U)" + SCRUB[name], safe)).otherwise(c)
    for pattern in regexes:
        c = F.regexp_replace(c, "(?U)" + pattern, safe)
    return c


def gs1_valid(digits: Column) -> Column:
    """GS1 check digit: weights 3, 1, 3, ... from the right of the body."""
    body = F.reverse(digits.substr(F.lit(1), F.length(digits) - 1))
    weighted = F.transform(F.filter(F.split(body, ""), lambda d: d != ""), lambda d, i: d.cast("int") * F.when(i % 2 == 0, 3).otherwise(1))
    total = F.aggregate(weighted, F.lit(0), lambda a, x: a + x)
    return (F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10))) == digits.substr(-1, 1).cast("int")


def eidr_valid(c: Column) -> Column:
    """EIDR content id: prefix 10.5240, five groups of four hex digits, ISO 7064 Mod 37,2 check."""
    form = c.rlike(r"^10\.5240/[0-9A-Fa-f]{4}(-[0-9A-Fa-f]{4}){4}-[0-9A-Za-z]$")
    body = F.upper(F.regexp_replace(F.regexp_extract(c, r"^10\.5240/(.*)-.$", 1), "-", ""))
    letters = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ*"
    value = lambda ch: F.ascii(ch) - F.when(ch.rlike("[0-9]"), 48).otherwise(55)
    p = F.aggregate(F.filter(F.split(body, ""), lambda x: x != ""), F.lit(0), lambda a, x: F.pmod((a + value(x)) * 2, F.lit(37)))
    check = F.pmod(38 - p, F.lit(37))
    return form & (F.lit(letters).substr(check + 1, F.lit(1)) == F.upper(c.substr(-1, 1)))


def iso_date(c: Column) -> Column:
    """The date of a strict YYYY-MM-DD text, else null."""
    s = c.cast("string")
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(s, F.lit("yyyy-MM-dd")).cast("date"))


def iso_timestamp(c: Column) -> Column:
    """A timestamp of an ISO date, date-time or year-month text, else null."""
    s = c.cast("string")
    return F.when(s.rlike(r"^\d{4}-\d{2}(-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?)?$"), s.try_cast("timestamp"))


def partial_date(c: Column) -> Column:
    return c.cast("string").rlike(r"^\d{4}(-(0[1-9]|1[0-2]))?$")


def number(c: Column) -> Column:
    """A double of plain numeric text, else null (no type suffixes)."""
    s = c.cast("string")
    return F.when(s.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim(s).try_cast("double"))
