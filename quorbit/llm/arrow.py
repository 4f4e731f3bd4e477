"""Row functions over Arrow batches, with small output batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Bytes of text after which an output batch ends.
BATCH_BYTES = 4 << 20


def arrow_schema(schema: str) -> pa.Schema:
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    return to_arrow_schema(kind)


def map_texts(df: DataFrame, rows: Callable[[list, list], Iterable[tuple]], schema: str, slice_bytes: int = BATCH_BYTES) -> DataFrame:
    """Applies ``rows(keys, texts)`` to slices of a two-column (key, text) frame.

    Slices hold about ``slice_bytes`` of text, or one longer text. ``rows`` yields
    tuples of ``schema``.
    """
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in slices(batch, slice_bytes):
                made = list(rows(keys, texts))
                columns = list(zip(*made, strict=True)) or [()] * len(out)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most: int = BATCH_BYTES) -> Iterator[tuple[list, list]]:
    sizes = pc.binary_length(batch.column(1)).fill_null(0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.column(0).slice(start, i - start).to_pylist(), batch.column(1).slice(start, i - start).to_pylist()
            start, held = i, 0
        held += n + 1
    if sizes:
        yield batch.column(0).slice(start).to_pylist(), batch.column(1).slice(start).to_pylist()
