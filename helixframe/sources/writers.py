"""Writers for the reference's hand-off files.

File order is not row order in a distributed write, so every writer keeps
``row_id`` (or writes it as the first column) instead of relying on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sink_headerless(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV without header (keep ``row_id`` among the columns to restore order)."""
    df.write.mode(mode).option("header", False).csv(path)


def sink_indexed(df: DataFrame, path: str, key: str = "row_id", mode: str = "overwrite") -> None:
    """Headered CSV with the original row position as the first column."""
    cols = [key] + [c for c in df.columns if c != key]
    df.select(*cols).write.mode(mode).option("header", True).csv(path)


def fasta_records(df: DataFrame, key: str = "row_id", seq: str = "sequence", description: Column | None = None,
                  wrap: int | None = None) -> DataFrame:
    """S10 records: '>' + id (+ description), newline, the sequence without
    embedded newlines (optionally wrapped every ``wrap`` letters)."""
    s = F.regexp_replace(F.col(seq), "\n", "")
    if wrap:
        s = F.regexp_replace(s, f"(.{{{wrap}}})(?=.)", "$1\n")
    head = F.concat(F.lit(">"), F.col(key).cast("string"))
    if description is not None:
        head = F.concat(head, F.lit(" "), description)
    return df.select(F.concat(head, F.lit("\n"), s).alias("value"))


def sink_fasta(df: DataFrame, path: str, mode: str = "overwrite", **kw) -> None:
    """Write the records as text (one record = two or more lines)."""
    fasta_records(df, **kw).write.mode(mode).text(path)
