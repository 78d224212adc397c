"""Small join helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def with_suffix_on_clash(
    right: DataFrame, left_columns: Sequence[str], keys: Sequence[str], suffix: str
) -> DataFrame:
    """Rename the non-key columns of ``right`` that ``left_columns`` already uses."""
    clashes = set(left_columns) - set(keys)
    return right.withColumnsRenamed({c: f"{c}{suffix}" for c in right.columns if c in clashes})
