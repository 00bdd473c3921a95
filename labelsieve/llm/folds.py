"""Rows that a model may learn from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """True for rows of the fold that is kept for testing; a null id is held out."""
    remainder = F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds
    return F.coalesce(remainder == fold, F.lit(True))
