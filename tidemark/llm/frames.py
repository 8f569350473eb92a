"""Running a numpy function over the text column of a DataFrame, Arrow batch by batch."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.text import slices
from tidemark.session import ship_package


def release_memory() -> None:
    """Give freed memory back to the system, so that an idle Python worker stays small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not a glibc system
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, releasing memory after the last batch of a partition."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return wrapped


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the input has {df.columns}")


def with_text_columns(df: DataFrame, text: str, fn: Callable[[pa.RecordBatch], dict[str, pa.Array]], fields: list[tuple[str, T.DataType]], keep: list[str] | None = None, drop_text: bool = False) -> DataFrame:
    """df's columns (or those in keep) plus the columns that fn makes of each batch.

    A column of df with the name of a new one is replaced. With drop_text the text
    column itself is not returned, so it does not travel back to the JVM. Rows are
    neither dropped nor reordered.
    """
    ship_package(df.sparkSession)
    new = [name for name, _ in fields]
    names = list(dict.fromkeys(keep if keep is not None else df.columns))
    carried = [c for c in names if c not in new and not (drop_text and c == text)]
    inner = df.select(*[f"`{c}`" for c in carried], df[text].alias("__text"))
    schema = T.StructType([inner.schema[c] for c in carried] + [T.StructField(n, t) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                made = fn(part)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(carried))] + [made[n] for n in new], names=carried + new)

    return inner.mapInArrow(tidy(run), schema)
