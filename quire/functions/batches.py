"""Arrow maps over (id, text) rows whose memory follows the texts, not Spark's batches."""

from __future__ import annotations

import gc
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SLICE_BYTES = 1 << 20  # of text that becomes Python objects at a time; a longer text is alone


_settled: list[int] = []


def settle() -> None:
    """Takes what a worker has loaded out of the collector's sight, once: trees of pages set it off often, and it would look at all modules again."""
    if _settled != [os.getpid()]:
        _settled[:] = [os.getpid()]
        gc.collect()
        gc.freeze()


def sizes(column: pa.Array) -> list[int]:
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return pc.fill_null(pc.binary_length(column), 0).to_pylist()
    return [0] * len(column)


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about ``most`` bytes of text."""
    for batch in batches:
        total, at = 0, 0
        lengths = [sum(x) for x in zip(*(sizes(c) for c in batch.columns))]
        for i, n in enumerate(lengths):
            if i > at and total + n > most:
                yield batch.slice(at, i - at)
                total, at = 0, i
            total += n
        if at < len(lengths):
            yield batch.slice(at)


def rows_of(docs: DataFrame, id_col: str, text: str | list[str], schema: str, of: Callable[..., Iterable[dict]], name: str | None = None, kind: str = "bigint") -> DataFrame:
    """The rows that ``of(id, *texts)`` makes of each row of docs: a narrow map.  Ids are cast to kind; ``of`` gets the columns named by text."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    columns = [text] if isinstance(text, str) else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in slices(batches):
            rows: list[dict] = []
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                rows += of(*values)
                if len(rows) >= 1 << 14:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return docs.select(F.col(id_col).cast(kind).alias(name or id_col), *columns).mapInArrow(run, schema)
