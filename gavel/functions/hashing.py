"""Stable 64-bit ids from text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# FNV-1a 64 offset basis in two halves, and the low part of its prime 2^40 + 435.
BASIS_HIGH = 3421674724
BASIS_LOW = 2216829733
PRIME_LOW = 435

_MASK = 0xFFFFFFFF


def byte_characters(text: Column) -> Column:
    """The UTF-8 bytes of a text as characters of the same number, none for an empty text."""
    characters = F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "")
    return F.when(text != "", characters).otherwise(F.array().cast("array<string>"))


def fnv1a64(text: Column) -> Column:
    """FNV-1a as a signed BIGINT, in 32-bit halves so that ANSI mode never overflows."""

    def step(state: Column, character: Column) -> Column:
        mixed = state["lo"].bitwiseXOR(F.ascii(character).cast("bigint"))
        product = mixed * PRIME_LOW
        high = (
            state["hi"] * PRIME_LOW + F.shiftright(product, 32) + F.shiftleft(mixed, 8)
        ).bitwiseAND(F.lit(_MASK))
        return F.struct(high.alias("hi"), product.bitwiseAND(F.lit(_MASK)).alias("lo"))

    start = F.struct(
        F.lit(BASIS_HIGH).cast("bigint").alias("hi"), F.lit(BASIS_LOW).cast("bigint").alias("lo")
    )
    return F.aggregate(
        byte_characters(text),
        start,
        step,
        lambda state: F.shiftleft(state["hi"], 32).bitwiseOR(state["lo"]),
    )
