"""Arrow plumbing shared by the operators that work on blocks of texts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone.llm.shared import fresh

BLOCK_CHARS = 2_000_000  # characters handled at once; a longer text is a block of its own


def give_back() -> None:
    """Return what a worker has freed to the system: it stays alive between tasks and would hold it beside the next one's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def text_blocks(texts: list[str | None], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) of consecutive blocks with about ``limit`` characters; null texts become empty."""
    first, block, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text or ""
        if block and size + len(text) > limit:
            yield first, block
            first, block, size = i, [], 0
        block.append(text)
        size += len(text)
    if block:
        yield first, block


def arrow_blocks(column: pa.Array, limit: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """The same from a column of an Arrow batch; only one block at a time becomes Python strings."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    first = total = 0
    for i, n in enumerate(sizes):
        if i > first and total + n > limit:
            yield first, [t or "" for t in column.slice(first, i - first).to_pylist()]
            first, total = i, 0
        total += n
    if sizes:
        yield first, [t or "" for t in column.slice(first).to_pylist()]


def add_columns(df: DataFrame, text_col: str, new: dict[str, T.DataType], make: Callable[[], Callable[[list[str]], list[list]]], keep: list[str] | None = None, limit: int = BLOCK_CHARS) -> DataFrame:
    """``df`` (or its columns ``keep``) with columns computed from whole texts, block by block, without a shuffle.

    ``make`` runs once per task and returns a function from the texts of a block to one list per new column. A
    column of ``df`` that has the name of a new one is replaced."""
    columns = [c for c in (df.columns if keep is None else keep) if c not in new]
    src = df.select(*[df[c] for c in columns], df[text_col].alias(fresh(df, "__text")))
    out = T.StructType([df.schema[c] for c in columns] + [T.StructField(n, t) for n, t in new.items()])
    added = to_arrow_schema(T.StructType(out.fields[len(columns) :]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        work = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            kept = batch.select(range(len(columns)))
            for first, block in arrow_blocks(batch.column(len(columns)), limit):
                part = kept.slice(first, len(block)).columns
                made = [v if isinstance(v, pa.Array) else pa.array(v, type=f.type) for v, f in zip(work(block), added, strict=True)]
                yield pa.RecordBatch.from_arrays([*part, *made], names=[f.name for f in out.fields])
            del batch, kept, block, part, made
            give_back()

    return src.mapInArrow(run, out)
