"""Ordered walks over large groups: partitions sorted by group and place are read once, batch by batch.

A group is one task's work, but never in memory as a whole: a walk holds one frame of it and what it
carries from frame to frame.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def in_order(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Rows dealt by group and sorted by place inside each partition."""
    return df.repartition(group).sortWithinPartitions(group, *order)


def frames_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, object, list[tuple]]]:
    """(group, frame, the further columns of its rows) of sorted rows whose first columns are group and frame."""
    at, rows = None, []
    for batch in batches:
        for group, frame, *rest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if rows and at != (group, frame):
                yield *at, rows
                rows = []
            at = group, frame
            rows.append(tuple(rest))
    if rows:
        yield *at, rows


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
