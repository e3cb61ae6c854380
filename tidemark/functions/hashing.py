"""Reproducible hash splits and draws that any SQL engine can compute."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.constants import FOLDS


def digit_sum(text: Column) -> Column:
    """Sum of the hex digits of sha256(text)."""
    digits = F.sha2(text, 256)
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.lit(0), lambda s, i: s + F.instr(F.lit("0123456789abcdef"), F.substr(digits, i, F.lit(1))) - 1)


def sha256_mod5(text: Column) -> Column:
    """sha256(text), as one number, modulo 5: 16 is 1 modulo 5, so it is the sum of the hex digits modulo 5."""
    return (digit_sum(text) % FOLDS).cast("int")


def is_lockbox(client_id: Column) -> Column:
    return sha256_mod5(client_id) == 0


def fold_of(seed: Column | int, client_id: Column) -> Column:
    return sha256_mod5(F.concat(F.lit(seed).cast("string") if isinstance(seed, int) else seed.cast("string"), F.lit(":"), client_id))


def uniform(seed: int, key: Column, draw: str) -> Column:
    """A number in [0, 1) from the first 13 hex digits of sha256('seed:key:draw')."""
    text = F.concat(F.lit(f"{seed}:"), key.cast("string"), F.lit(f":{draw}"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def choice(u: Column, values) -> Column:
    """values[floor(u * n)]"""
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))
