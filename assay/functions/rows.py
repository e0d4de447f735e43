"""Small helpers that shape DataFrames."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def literal_rows(
    spark: SparkSession, schema: str, rows: Sequence[Sequence[Any]]
) -> DataFrame:
    """A DataFrame of constants the optimizer can see; no Python worker reads it.

    The rows travel as one JSON text, whose parsing the optimizer folds away.
    """
    names = T.StructType.fromDDL(schema).names
    packed = [dict(zip(names, row, strict=True)) for row in rows]
    parsed = F.from_json(F.lit(json.dumps(packed)), f"array<struct<{schema}>>")
    return spark.range(0, 1, 1, 1).select(F.inline(parsed))
