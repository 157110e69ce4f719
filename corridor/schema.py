"""Preconditions and choices that are made from a DataFrame's schema when the plan is built."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """df, if it has the columns; otherwise a ValueError that names the missing ones."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def floats(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]


def matching(df: DataFrame, pattern: str) -> list[str]:
    """Columns whose names match a regular expression."""
    return [c for c in df.columns if re.search(pattern, c)]


def narrowed(df: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    """Doubles as floats, without columns whose names contain one of ``drop``; for sinks."""
    kept = [c for c in df.columns if not any(x in c for x in drop)]
    wide = {f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)}
    return df.select(*[F.col(c).cast("float").alias(c) if c in wide else F.col(c) for c in kept])


def over(keys: str | Sequence[str], order: str | Sequence[str | Column] = ()):
    """Window over keys, ordered; a name that starts with '-' is descending."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, (str, Column)) else list(order)
    w = Window.partitionBy(*keys)
    cols = [(F.col(o[1:]).desc() if o.startswith("-") else F.col(o)) if isinstance(o, str) else o for o in order]
    return w.orderBy(*cols) if cols else w
