"""Functions of code and text columns, including the two string hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["prefix", "is_qr_extension", "is_qr_pay_type", "bkdr_hash", "hash_bucket", "uniform_draw", "last_char_is"]


def prefix(code: Column, n: int = 2) -> Column:
    return F.substring(code, 1, n)


def last_char_is(code: Column, char: str) -> Column:
    return (F.right(code, F.lit(1)) == char).cast("double")


def is_qr_extension(extension: Column, pos: int = 27, allowed: tuple[str, ...] = ("Y", "Z"), min_length: int = 28) -> Column:
    """Payment mark at a fixed position of a long extension field."""
    marked = (F.length(extension) >= min_length) & F.substring(extension, pos, 1).isin(*allowed)
    return F.coalesce(marked, F.lit(False)).cast("double")


def is_qr_pay_type(extension: Column) -> Column:
    """First character is a digit 1..9."""
    return F.coalesce(F.substring(extension, 1, 1).between("1", "9"), F.lit(False)).cast("double")


def _codes(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda ch: F.ascii(ch).cast("bigint"))


def bkdr_hash(text: Column, seed: int = 131, mask: int | None = None, empty: int = -1) -> Column:
    """Multiplicative string hash, 64-bit wrapping or cut to ``mask`` after every character.

    The wrapping form multiplies the two 32-bit halves separately, because plain bigint
    arithmetic raises on overflow in ANSI mode.
    """
    if mask is not None:
        def step(h, ch):
            return (h * seed + ch).bitwiseAND(F.lit(mask).cast("bigint"))
    else:
        low_bits = F.lit(0xFFFFFFFF).cast("bigint")

        def step(h, ch):
            low = h.bitwiseAND(low_bits) * seed + ch
            high = (F.shiftrightunsigned(h, 32) * seed + F.shiftrightunsigned(low, 32)).bitwiseAND(low_bits)
            return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(low_bits))

    folded = F.aggregate(_codes(text), F.lit(0).cast("bigint"), step)
    return F.when(text == "", F.lit(empty).cast("bigint")).otherwise(folded)


def hash_bucket(id_col: Column, seed: int | str = 0, buckets: int = 10_000) -> Column:
    """Bucket of a row id: the same id always falls into the same bucket, on any engine that has md5."""
    digest = F.md5(F.concat(id_col.cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.lit(buckets)


def uniform_draw(*parts: Column) -> Column:
    """Repeatable uniform number in [0, 1) from the given columns."""
    span = 1 << 53
    return F.pmod(F.xxhash64(*parts), F.lit(span)).cast("double") / F.lit(float(span))
