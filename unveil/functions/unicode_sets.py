"""Character sets derived by rule from Python's Unicode tables (not listed by hand)."""

from __future__ import annotations

import functools
import unicodedata

from unveil.functions import fixed


@functools.lru_cache(maxsize=1)
def nfkc_suspects() -> str:
    """Characters that can make a string differ from its NFKC form.

    Unicode's quick check: a string whose characters all have NFKC_QC=Yes
    and canonical combining class 0 is already in NFKC. This set is a
    superset of the rest: characters not NFKC-stable on their own (QC=No),
    every second element of a two-character canonical decomposition and the
    Hangul V/T jamo (QC=Maybe), and every character with a non-zero
    combining class. Derived from ``unicodedata``, the same tables the
    normalisation itself uses.
    """
    out = set()
    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        if unicodedata.combining(ch) or not unicodedata.is_normalized("NFKC", ch):
            out.add(cp)
            continue
        d = unicodedata.decomposition(ch)
        if d and not d.startswith("<"):
            parts = d.split()
            if len(parts) == 2:
                out.add(int(parts[1], 16))
    out.update(range(0x1161, 0x1176))  # Hangul vowel jamo
    out.update(range(0x11A8, 0x11C3))  # Hangul trailing jamo
    return "".join(chr(cp) for cp in sorted(out))


@functools.lru_cache(maxsize=1)
def carrier_class() -> str:
    """A Java character class that holds every character the stages C4 to C6 act on, and more.

    It leaves out the two runs of characters around ``a`` and U+00E9 that none
    of them acts on; a class of more runs takes longer to search than it
    saves. Text without one of its characters passes these stages unchanged.
    """
    acted_on = {ord(c) for c in fixed.ZERO_WIDTH_CHARS + fixed.INVISIBLE_CONTROL_CHARS + nfkc_suspects()}
    runs = []
    for inside in (ord("a"), 0xE9):
        lo = hi = inside
        while lo > 0 and lo - 1 not in acted_on:
            lo -= 1
        while hi + 1 not in acted_on:
            hi += 1
        runs.append(rf"\x{{{lo:X}}}-\x{{{hi:X}}}")
    return "[^" + "".join(runs) + "]"
