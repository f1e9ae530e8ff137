"""Sources cut into chunks (B37): each cut depends on the one before, so a helper walks a text once, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructType

CHARS, LINES = 4000, 120


def _cut(text: str) -> list[tuple[str, int, int, bool]]:
    out, at, line, continued = [], 0, 1, False
    while at < len(text) or not out:
        end = at
        for _ in range(LINES):
            end = text.find("\n", end, at + CHARS) + 1
            if not end:
                end = min(at + CHARS, len(text))
                break
        piece = text[at:end]
        breaks, closed = piece.count("\n"), piece.endswith("\n")
        out.append((piece, line, max(line, line + breaks - closed), continued))
        at, line, continued = end, line + breaks, not closed
    return out


_CHUNK = StructType().add("source", StringType()).add("line_start", LongType()).add("line_end", LongType()).add("continued", BooleanType())


@F.pandas_udf(ArrayType(_CHUNK))
def _chunks(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.map(lambda x: None if x is None else _cut(x))


def chunks(text: Column) -> Column:
    """At most 4000 code points and 120 line breaks each, with lines and whether the line began in the chunk before; an empty text is one chunk."""
    return _chunks(text)
