"""Portable hash used for every shuffle, split, sample and swap.

H(s) = first 8 hex digits of md5(s) as an unsigned 32-bit integer. It is
deterministic across runs, engines (DuckDB spells it
``cast('0x'||substr(md5(s),1,8) as bigint)``) and partition counts, which
replaces the reference's unseeded ``random`` calls.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HASH_SPACE = 1 << 32  # H is uniform on [0, 2^32)


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def portable_hash(*parts, sep: str = "|") -> Column:
    """H(concat_ws(sep, parts...)) as bigint; parts are columns or names."""
    cols = [_col(p).cast("string") for p in parts]
    s = cols[0] if len(cols) == 1 else F.concat_ws(sep, *cols)
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def hash_of(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def seeded_order_key(seed: str | int, *id_cols) -> Column:
    """Hash order of ``seed:id`` (D1): a reproducible permutation key."""
    cols = [F.lit(str(seed))] + [_col(c).cast("string") for c in id_cols]
    return hash_of(F.concat_ws(":", *cols))


def hash_choice(arr: Column, key: Column) -> Column:
    """D6 random choice: element of ``arr`` picked by a hash key."""
    return F.element_at(arr, (F.pmod(key, F.size(arr)) + 1).cast("int"))
