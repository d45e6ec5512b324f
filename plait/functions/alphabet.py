"""The base alphabet of 306 characters by rule: digits, then Latin letters by base, case and accents.

A letter belongs to it if it lies under U+0250 and its canonical decomposition starts with a to z. Within a base letter
all lower-case forms come before all upper-case ones, each run ordered by the sequence of accents. Digits and letters
have blocks of a 16-bit code space, which their members divide evenly in the order of their ranks.
"""

from __future__ import annotations

import unicodedata
from functools import cache

#: Accents from the lightest to the heaviest (combining characters).
ACCENTS = (0x301, 0x300, 0x306, 0x302, 0x30C, 0x30A, 0x308, 0x30B, 0x303, 0x307, 0x327, 0x328, 0x304, 0x30F, 0x311, 0x31B, 0x326)
#: Collation weights of 0, and of a to z.
ZERO = 8678
LETTERS = (9196, 9222, 9248, 9270, 9299, 9358, 9373, 9412, 9439, 9467, 9492, 9512, 9570, 9585, 9624, 9672, 9693, 9712, 9778, 9821, 9856, 9904, 9922, 9932, 9944, 9966)
#: Case weights, code blocks (first, last), reserved codes.
LOWER, UPPER = 2, 8
BLOCKS = {"digit": (0x1000, 0x2FFF), "letter": (0x4000, 0xFFFF)}
TERM, SPACE, HYPHEN, SEPARATOR, UNREAD = 0, 1, 2, "\x01", 2048
#: Characters outside the alphabet get this plus their code point.
OUTSIDE = 1024


@cache
def table() -> list[dict]:
    """char, base, case, accent, rank, code, type of every character of the alphabet, by rank."""
    found = [(str(i), ZERO + i, LOWER, (), "digit") for i in range(10)]
    for c in map(chr, range(0x41, 0x250)):
        letter, *marks = unicodedata.normalize("NFD", c)
        if unicodedata.category(c)[0] == "L" and letter.isascii() and letter.isalpha():
            accents = tuple(1 + ACCENTS.index(ord(m)) for m in marks)
            found.append((c, LETTERS[ord(letter.lower()) - ord("a")], LOWER if letter.islower() else UPPER, accents, "letter"))
    found.sort(key=lambda x: (x[1], x[2], x[3], x[0]))
    sizes = {k: sum(x[4] == k for x in found) for k in BLOCKS}
    seen, out = dict.fromkeys(BLOCKS, 0), []
    for rank, (c, base, case, accents, kind) in enumerate(found, 1):
        first, last = BLOCKS[kind]
        code = first + (last - first) // sizes[kind] * seen[kind]
        seen[kind] += 1
        out.append({"char": c, "base": base, "case": case, "accent": ".".join(map(str, accents)) or "0", "rank": rank, "code": code, "type": kind})
    return out


@cache
def codes() -> dict[str, int]:
    return {r["char"]: r["code"] for r in table()}


def base_letter(c: str) -> str:
    return unicodedata.normalize("NFD", c)[0].lower()


def letters(text: str) -> list[int]:
    """The code of each character of a spelling."""
    known = codes()
    return [SPACE if c == " " else HYPHEN if c == "-" else known[c] if c in known else known[c.lower()] if c.lower() in known else OUTSIDE + ord(c) for c in text]
