"""Whole groups in streams of Arrow batches: many small groups a call instead of one Python call a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def boundaries(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Starts of the runs of equal keys and the number of rows; nulls are a value."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for k in keys:
        codes = np.asarray(pc.dictionary_encode(t[k].combine_chunks(), null_encoding="encode").indices)
        new[1:] |= codes[1:] != codes[:-1]
    return np.append(np.flatnonzero(new), t.num_rows)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, boundaries) with complete groups only; a group that goes on in the next batch waits for it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([*held, b])
        cut = boundaries(t, keys)
        if len(cut) > 2:
            yield t.slice(0, int(cut[-2])), cut[:-1]
            held = t.slice(int(cut[-2])).combine_chunks().to_batches()
        else:
            held = t.to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield t, boundaries(t, keys)


def map_groups(df: DataFrame, keys: list[str], order: list, work: Callable[[pa.Table, np.ndarray], pa.Table], schema) -> DataFrame:
    """work(table, boundaries) over rows dealt by key and sorted by key and `order`."""
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cut in whole_groups(batches, keys):
            yield from work(t, cut).combine_chunks().to_batches()

    return dealt.mapInArrow(run, schema)


def map_rows(df: DataFrame, keys: list[str], order: list, work: Callable[[list[tuple]], list[tuple]], columns: str) -> DataFrame:
    """For each group, its keys and `columns` (a schema) with the tuples that work makes of its rows, tuples in order.

    For algorithms that go through a group row by row; a task still reads whole groups from batches, not one a call.
    """
    kinds = StructType([df.schema[k] for k in keys] + StructType.fromDDL(columns).fields)
    wanted = to_arrow_schema(kinds)
    rest = [c for c in df.columns if c not in keys]

    def run(t: pa.Table, cut: np.ndarray) -> pa.Table:
        heads = [t[k].to_pylist() for k in keys]
        rows = list(zip(*(t[c].to_pylist() for c in rest), strict=True))
        out = [(*(h[s] for h in heads), *r) for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True) for r in work(rows[s:e])]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(wanted)], schema=wanted)

    return map_groups(df, keys, order, run, kinds)


def column(t: pa.Table, name: str) -> np.ndarray:
    return np.asarray(t[name].combine_chunks())
