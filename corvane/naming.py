"""Names for columns that are added and dropped again."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df lacks, for columns added and dropped again."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name
