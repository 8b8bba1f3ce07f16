"""Ordered folds: semantics in which the state depends on what was kept before, which windows cannot express.

Rows are dealt by key and sorted within partitions; a task streams them and holds the state of one key, so a key of any
length needs no more memory than a short one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def _fold(batches: Iterable[pa.RecordBatch], keys: int, start: Callable, step: Callable, finish: Callable, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    key, state, out = None, None, []

    def rows() -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if state is None or row[:keys] != key:
                if state is not None:
                    out.extend((*key, *x) for x in finish(state))
                key, state = row[:keys], start()
            state, made = step(state, *row[keys:])
            out.extend((*key, *x) for x in made)
        if out:
            yield rows()
            out = []
    if state is not None:
        out.extend((*key, *x) for x in finish(state))
        if out:
            yield rows()


def nothing(state) -> tuple:
    return ()


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], values: list[str], start: Callable, step: Callable, schema: str, finish: Callable = nothing) -> DataFrame:
    """For each key: state = start(); for each row in order: state, rows = step(state, *values); at last finish(state).
    The rows of both are put out behind the keys; `schema` names all columns."""
    spark = df.sparkSession
    full: StructType = _parse_datatype_string(schema) if spark else None
    dealt = df.select(*keys, *values, *[c for c in order if c not in keys + values]).repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, *values)
    return dealt.mapInArrow(partial(_fold, keys=len(keys), start=start, step=step, finish=finish, schema=to_arrow_schema(full)), full)
