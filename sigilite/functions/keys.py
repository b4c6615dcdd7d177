"""Null-safe key encoding: every key value, null included, becomes one non-null string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_key(col: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit("~"))


def decode_key(col: Column) -> Column:
    return F.when(col == "~", F.lit(None).cast("string")).otherwise(col.substr(F.lit(2), F.length(col)))
