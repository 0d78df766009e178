"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it where ``df`` has such a column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def whole_text(text: Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(text, F.lit(""))


def unsigned_share(h: Column) -> Column:
    """A number strictly between 0 and 1 from a 64-bit hash."""
    return (F.shiftrightunsigned(h, 11) + F.lit(0.5)) / F.lit(float(2 ** 53))


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` and the fields that ``ddl`` names."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])
