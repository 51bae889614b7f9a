"""Changes of monitored targets as a stream, with a state per target."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, StringType, StructType

# Executors need not have this package: its code travels with the function.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def changes(snapshots: DataFrame, target: str, order: str, fields: list[str], expire_ms: int | None = None) -> DataFrame:
    """Each streamed snapshot (target, order, fields) with ``changed``: the names of the
    fields that differ from the target's snapshot before, ``initial_snapshot`` for the first.

    The state of a target is its last snapshot.  Snapshots of a target must arrive in
    order from batch to batch; within a batch they are sorted.  One that is older than
    the last is late and left out.  A target without a snapshot for ``expire_ms`` is
    forgotten, and its next one is an initial one.  A null target is a target."""
    kept = StructType([snapshots.schema[order], *[snapshots.schema[f] for f in fields]])
    out = StructType([snapshots.schema[c] for c in (target, order, *fields)]).add("changed", ArrayType(StringType()))

    def plain(values: Iterator) -> tuple:
        return tuple(None if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v else v for v in values)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = sorted((plain(r) for p in parts for r in p[[order, *fields]].itertuples(index=False, name=None)), key=lambda r: r[0])
        last = plain(state.get) if state.exists else None
        found = []
        for row in rows:
            if last is not None and row[0] < last[0]:
                continue
            told = ["initial_snapshot"] if last is None else [f for f, a, b in zip(fields, last[1:], row[1:]) if a != b]
            found.append((key[0], *row, told))
            last = row
        if last is not None:
            state.update(last)
        if expire_ms:
            state.setTimeoutDuration(expire_ms)
        if found:
            yield pd.DataFrame({c: pd.Series([r[i] for r in found], dtype=object) for i, c in enumerate((target, order, *fields, "changed"))})

    return snapshots.select(target, order, *fields).groupBy(target).applyInPandasWithState(
        run, out, kept, "append", GroupStateTimeout.ProcessingTimeTimeout if expire_ms else GroupStateTimeout.NoTimeout)
