"""Rows of Arrow batches by runs of a key, for what goes through sorted rows in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each key, for batches that are sorted by keys; without keys all rows."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = [batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for k in keys]
        change = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1).tolist()] if keys else [0]
        for begin, end in zip(change, [*change[1:], batch.num_rows], strict=True):
            key = tuple(batch.column(k)[begin].as_py() for k in keys)
            if key != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(begin, end - begin))
    if held:
        yield now, pa.Table.from_batches(held)


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole runs of a key, with the places where runs begin and the number of rows: many small runs at once, for batches that are
    sorted by keys. Without keys all rows are one run."""

    def begins(table: pa.Table) -> list[int]:
        codes = [table.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for k in keys]
        return [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1).tolist()] if keys else [0]

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = begins(pa.Table.from_batches([batch]))[-1]
        same = bool(held) and all(held[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in keys)
        if held and (last or not same):
            table = pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()
            yield table, [*begins(table), table.num_rows]
            held = []
        elif last:
            table = pa.Table.from_batches([batch.slice(0, last)]).combine_chunks()
            yield table, [*begins(table), table.num_rows]
        held.append(batch.slice(last))
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, [*begins(table), table.num_rows]
