"""Helpers for Arrow-batch maps: small chunks in, column lists out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

from .jsontext import clean

CHUNK = 512


def array(values: list | pa.Array, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values
    try:
        return pa.array(values, kind)
    except UnicodeEncodeError:
        return pa.array(_cleaned(values), kind)


def _cleaned(value: object) -> object:
    if type(value) is str:
        return clean(value)
    if type(value) is dict:
        return {k: _cleaned(v) for k, v in value.items()}
    if type(value) in (list, tuple):
        return [_cleaned(v) for v in value]
    return value


def column_map(fn: Callable[..., list[list]], schema: pa.Schema, chunk: int = CHUNK):
    """A function for ``mapInArrow``: ``fn`` gets the columns of a chunk as lists and
    returns the output columns as lists or arrays, in the order of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                columns = fn(*(c.to_pylist() for c in part.columns))
                if columns and columns[0]:
                    yield pa.RecordBatch.from_arrays(
                        [array(c, f.type) for c, f in zip(columns, schema)], schema=schema
                    )

    return run
