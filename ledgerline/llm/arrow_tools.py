"""Arrow batches in and out of Python, in bounded pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Text bytes that an operator works on at a time, within an Arrow batch: what a
#: worker holds follows from this and from its longest text.
PIECE_BYTES = 1_000_000


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A column of texts as UTF-8, null kept."""
    held = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(held.type) or pa.types.is_large_binary(held.type) else pa.binary()
    return held.cast(kind).to_pylist()


def pieces(batch: pa.RecordBatch, name: str = "text", most: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """The batch in slices of about ``most`` bytes of text, one row at least; only
    a slice's texts are Python objects."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(sizes):
        # A long text is a piece of its own.
        if i > start and size + n > most:
            piece = batch.slice(start, i - start)
            yield piece, texts(piece, name)
            start, size = i, 0
        size += n
    if start < len(sizes):
        piece = batch.slice(start)
        yield piece, texts(piece, name)


def map_texts(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch, list[bytes | None]], pa.RecordBatch | None]], schema: str, most: int = PIECE_BYTES) -> DataFrame:
    """``make()``'s function over every piece of ``df``, of about ``most`` bytes of
    its column ``text``; ``make`` runs once per task, so what it holds lives as long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for piece, held in pieces(batch, most=most):
                out = work(piece, held)
                if out is not None and out.num_rows:
                    yield out
        # The worker lives on; what its pool holds unused goes back.
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)
