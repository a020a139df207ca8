"""Keys by which decisions go back to the rows that they are about."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_key(*columns: str) -> Column:
    """128-bit digest (32 hex digits) of the columns as text, each with its length; null is unlike any text."""
    marked = []
    for name in columns:
        text = F.col(name).cast("string")
        marked.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text), F.lit(":"), text)))
    return F.md5(F.concat(*marked).cast("binary"))
