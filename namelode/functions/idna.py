"""Internationalized names to ASCII (UTS 46, non-transitional): characters are mapped by rule, labels encoded by Punycode.

The mapping is that of case-folded compatibility forms, from Python's own Unicode tables, so characters that are newer than
those count as unassigned. The fixed values below are the standard's exceptions.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the standard: what stays as it is, what ends a label, what is left out, and what is not allowed though it has a form.
KEPT = "ßς‌‍"
DOTS = ".。．｡"
LEFT_OUT = [(0xAD, 0xAD), (0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200B), (0x2060, 0x2064), (0x206A, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0100, 0xE01EF)]
REFUSED = [(0x1680, 0x1680), (0x2FF0, 0x2FFF), (0x31EF, 0x31EF), (0xFFFC, 0xFFFD)]
# Fixed values of RFC 3492.
BASE, T_MIN, T_MAX, SKEW, DAMP, FIRST_BIAS, FIRST_CODE = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"


def within(code: int, ranges: list[tuple[int, int]]) -> bool:
    return any(a <= code <= b for a, b in ranges)


@lru_cache(maxsize=10_000)
def mapped(c: str) -> str | None:
    """What stands for a character; none if it is not allowed."""
    code = ord(c)
    if c in KEPT:
        return c
    if c in DOTS:
        return "."
    if within(code, LEFT_OUT):
        return ""
    kind = unicodedata.category(c)
    if kind in ("Cn", "Co", "Cs", "Cf", "Zl", "Zp") or (kind == "Cc" and code >= 0x80) or within(code, REFUSED):
        return None
    if c == "ẞ":  # a capital of a character that is kept
        return "ß"
    form = unicodedata.normalize("NFD", c).casefold()
    form = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", form).casefold())
    return None if set(form) & set(DOTS) else form


def punycode(label: str) -> str:
    """The ASCII form of a label (RFC 3492), without its prefix.

    The plain characters come first. Each turn inserts all places of the next higher character; between two insertions the
    state (character, place) runs on, and how far it has run is written as a number of variable length, low digits first.
    """
    plain = [c for c in label if ord(c) < FIRST_CODE]
    out = plain + ["-"] * bool(plain)
    done, run, bias, last = len(plain), 0, FIRST_BIAS, FIRST_CODE - 1
    for code in sorted({ord(c) for c in label if ord(c) >= FIRST_CODE}):
        run += (code - last - 1) * (done + 1)
        for c in map(ord, label):
            if c < code:
                run += 1
            elif c == code:
                digits, rest = [], run
                for k in range(BASE, BASE * (len(label) + 40), BASE):
                    limit = min(max(k - bias, T_MIN), T_MAX)
                    if rest < limit:
                        break
                    rest, digit = divmod(rest - limit, BASE - limit)
                    digits.append(digit + limit)
                out += [DIGITS[d] for d in [*digits, rest]]
                bias = adapted(run, done + 1, done == len(plain))
                run, done = 0, done + 1
        run, last = run + 1, code
    return "".join(out)


def adapted(run: int, n: int, first: bool) -> int:
    """The bias for the next number, from how far the last one ran."""
    run = run // (DAMP if first else 2)
    run += run // n
    k = 0
    while run > (BASE - T_MIN) * T_MAX // 2:
        run //= BASE - T_MIN
        k += BASE
    return k + (BASE - T_MIN + 1) * run // (run + SKEW)


def to_ascii(name: str) -> str:
    """The ASCII form; the name itself where there is none."""
    if name.isascii():
        return name
    forms = [mapped(c) for c in name]
    if None in forms:
        return name
    labels = unicodedata.normalize("NFC", "".join(forms)).split(".")
    return ".".join(x if x.isascii() else f"xn--{punycode(x)}" for x in labels)


@F.pandas_udf(StringType())
def to_ascii_column(names: pd.Series) -> pd.Series:
    own = {x: to_ascii(x) for x in names.dropna().unique()}  # a batch has many names again
    return names.map(own, na_action="ignore")
