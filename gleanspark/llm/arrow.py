"""Small helpers for operators that run Python on Arrow batches inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Rows of one output batch, and the characters of text handled at a time.
OUT_ROWS = 20_000
CHUNK_CHARS = 4_000_000


def map_columns(
    df: DataFrame, columns: Sequence[str], schema: str, make: Callable[[], Callable]
) -> DataFrame:
    """``mapInArrow`` over ``columns`` only. ``make()`` runs once a task and gives a
    function from column lists to a list of output columns."""
    out = to_arrow_schema(T._parse_datatype_string(schema), prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in slices(batch):
                got = step(*part.columns)
                rows = pa.table(
                    [a if isinstance(a, (pa.Array, pa.ChunkedArray)) else pa.array(a, f.type) for a, f in zip(got, out)],
                    schema=out,
                )
                yield from rows.to_batches(max_chunksize=OUT_ROWS)

    return df.select(*columns).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes, so that long texts do not pile up; a row stays whole."""
    if batch.num_rows < 2 or batch.nbytes <= most:
        if batch.num_rows:
            yield batch
        return
    half = batch.num_rows // 2
    yield from slices(batch.slice(0, half), most)
    yield from slices(batch.slice(half), most)
