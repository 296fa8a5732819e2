"""Canary (T1-T5) as column expressions; all native, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from unveil.functions import fixed

NUL = chr(0)


def seed_hex(*parts: Column) -> Column:
    """Hex SHA-256 of the parts' UTF-8 bytes joined by one NUL byte.

    ``concat`` (not ``concat_ws``) so a null part yields a null seed rather
    than silently dropping out of the material.
    """
    pieces: list[Column] = []
    for i, p in enumerate(parts):
        if i:
            pieces.append(F.lit(NUL))
        pieces.append(p)
    return F.sha2(F.concat(*pieces), 256)


def seed_material(sender: Column, scope: Column, chain_id: Column, cleaned_text: Column) -> list[Column]:
    """Sender hex, contract (scope) hex, chain id, cleaned text -- in that order."""
    return [sender, scope, chain_id.cast("string"), cleaned_text]


def canary_word(seed: Column) -> Column:
    """Prefix + first N digest bytes, each mod |alphabet| into the alphabet."""
    alpha = F.lit(fixed.CANARY_ALPHABET)
    n = len(fixed.CANARY_ALPHABET)

    def letter(i: Column) -> Column:
        byte = F.conv(F.substring(seed, i * 2 + 1, 2), 16, 10).cast("int")
        return F.substring(alpha, (byte % n) + 1, 1)

    body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(fixed.CANARY_LENGTH - 1)), letter), "")
    return F.concat(F.lit(fixed.CANARY_PREFIX), body)


def trap_sentence(word: Column) -> Column:
    """T4."""
    head, tail = fixed.template_parts(fixed.TRAP_SENTENCE, "word")
    return F.concat(F.lit(head), word, F.lit(tail))


def canary_tripped(output: Column, word: Column) -> Column:
    """T5: exact, case-sensitive substring; null or empty output -> false."""
    return F.coalesce(output.contains(word) & (F.length(output) > 0), F.lit(False))
