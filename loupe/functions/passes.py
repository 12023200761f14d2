"""Passes over Arrow batches that turn an artifact into rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
_ROWS_AT_ONCE = 10_000


def parsed(artifacts: DataFrame, column: str, parse: Callable[[object], Iterator[tuple]], schema: str) -> DataFrame:
    """(artifact_path, ...): the rows that ``parse`` makes of each artifact's ``column``; an error is a row with its name."""
    names = ["artifact_path", *(part.split()[0] for part in schema.split(", ")), "error"]

    def made(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows: list[tuple] = []
            for path, value in zip(batch.column("artifact_path"), batch.column(column), strict=True):
                path = path.as_py()
                try:
                    rows += [(path, *r, None) for r in parse(value.as_py())]
                except Exception as e:  # an artifact that can't be read is a finding, not a failed scan
                    rows.append((path, *[None] * (len(names) - 2), type(e).__name__))
                if len(rows) > _ROWS_AT_ONCE:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    full = "artifact_path string, " + schema + ", error string"
    arrow = pa.schema([(p.split()[0], _KINDS[p.split()[1]]) for p in full.split(", ")])
    return artifacts.select("artifact_path", column).mapInArrow(made, full)


def problems(rows: DataFrame) -> DataFrame:
    """A diagnostic for each artifact that a pass couldn't read to its end: its findings are missing, not absent."""
    code = F.when(F.col("error") == "OverflowError", "scan_limit_exceeded").otherwise("corrupt_artifact")
    return rows.where("error is not null").select("artifact_path", code.alias("code"), F.col("error").alias("message"), F.lit("high").alias("severity")).distinct()
