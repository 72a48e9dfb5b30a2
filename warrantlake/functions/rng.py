"""Draws from a hash: the same in every engine, partitioning and retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 2**52


def draw(*parts: Column | str) -> Column:
    """A long in [0, 2^52) from the md5 of the parts, joined by ``|``."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in columns])), 1, 13), 16, 10).cast("long")


def pick(n: Column, *parts: Column | str) -> Column:
    """A long in [0, n)."""
    return draw(*parts) % n


def uniform(*parts: Column | str) -> Column:
    return draw(*parts) / F.lit(float(SPAN))


def draw_sql(*parts: str) -> str:
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(('0x' || substr(md5({text}), 1, 13)) AS BIGINT)"
