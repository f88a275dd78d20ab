"""Counter-based uniforms: a function of their key, whatever the order of tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*key: Column | int | str) -> Column:
    """In (0, 1), from the first 52 bits of the md5 of the key's parts joined by '|'."""
    text = F.concat_ws("|", *[(k if isinstance(k, Column) else F.lit(k)).cast("string") for k in key])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4503599627370496.0)


def uniform_sql(*key: str) -> str:
    """The same in DuckDB's SQL."""
    text = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in key)
    return f"((('0x' || substr(md5({text}), 1, 13))::BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE"
