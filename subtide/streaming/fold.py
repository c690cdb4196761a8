"""One step function, two runs: sorted partitions for tables, keyed state for streams.

A machine has ``start() -> state``, ``step(state, row) -> rows`` and ``close(state) -> rows``; the state is a
dict of JSON values that ``step`` changes in place, and a row is a dict of the input's columns. A machine with
deadlines also has ``deadline(state)``, the time in milliseconds at which it wants to be woken (or None), and
``expire(state, at) -> rows``; a state that has ``ended`` is dropped, and the next row begins another.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any, Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


class Machine(Protocol):
    schema: str

    def start(self) -> dict: ...
    def step(self, state: dict, row: dict) -> list[tuple]: ...
    def close(self, state: dict) -> list[tuple]: ...


class Timed(Machine, Protocol):
    def deadline(self, state: dict) -> int | None: ...
    def expire(self, state: dict, at: int) -> list[tuple]: ...


def drained(machine: Machine, state: dict | None, rows: list[dict], at: str, now: int | None) -> tuple[list[tuple], dict | None]:
    """The machine's rows over rows in order and up to the time ``now``, with the deadlines that fall between; a deadline comes before a row of its time."""
    out: list[tuple] = []

    def wake(upto: int) -> None:
        nonlocal state
        while state is not None and (due := machine.deadline(state)) is not None and due <= upto:
            out.extend(machine.expire(state, due))
            state = None if state.get("ended") else state

    for row in rows:
        wake(row[at])
        state = machine.start() if state is None else state
        out += machine.step(state, row)
        state = None if state.get("ended") else state
    if now is not None:
        wake(now)
    return out, state


def fold(rows: DataFrame, key: str, order: list[str], machine: Machine, until: int | None = None) -> DataFrame:
    """The machine's rows for each key, over its rows in order.

    With ``until``, a time in milliseconds, the machine has deadlines: the first column of ``order`` is the time
    of a row, deadlines up to ``until`` are met, and nothing is closed at the end.

    Partitions are sorted by Spark and read as a stream, so a task holds one batch and one state, however long
    a session is. Rows without key are left out; rows with equal order values go by their other columns.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType.fromDDL(f"{key} {rows.schema[key].dataType.simpleString()}, {machine.schema}")
    arrow, names = to_arrow_schema(schema), [f.name for f in schema]
    ties = [c for c in rows.columns if c != key and c not in order and rows.schema[c].dataType.typeName() not in ("array", "map", "variant")]

    def timed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if row[key] != current:
                    out += [(current, *r) for r in drained(machine, state, [], order[0], until)[0]]
                    current, state = row[key], None
                found, state = drained(machine, state, [row], order[0], None)
                out += [(current, *r) for r in found]
            yield _batch(out, names, arrow)
        yield _batch([(current, *r) for r in drained(machine, state, [], order[0], until)[0]], names, arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if state is None or row[key] != current:
                    if state is not None:
                        out += [(current, *r) for r in machine.close(state)]
                    current, state = row[key], machine.start()
                out += [(current, *r) for r in machine.step(state, row)]
            yield _batch(out, names, arrow)
        if state is not None:
            yield _batch([(current, *r) for r in machine.close(state)], names, arrow)

    dealt = rows.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order, *ties)
    return dealt.mapInArrow(run if until is None else timed, schema)


def _batch(rows: list[tuple], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)


def stream_fold(rows: DataFrame, key: str, order: list[str], machine: Machine, idle_ms: int | None = None) -> DataFrame:
    """The same over a streaming DataFrame: rows of a micro-batch are put in order, the state lasts between batches.

    With ``idle_ms`` a session closes after that time without rows (processing time).
    """
    schema = StructType.fromDDL(f"{key} {rows.schema[key].dataType.simpleString()}, {machine.schema}")
    names = [f.name for f in schema]

    def run(keys: tuple[Any, ...], frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(group.get[0]) if group.exists else machine.start()
        if group.hasTimedOut:
            group.remove()
            yield pd.DataFrame([(keys[0], *r) for r in machine.close(state)], columns=names)
            return
        whole = (row for frame in frames for row in frame.to_dict("records"))
        out = [(keys[0], *r) for row in sorted(whole, key=lambda r: [r[c] for c in order]) for r in machine.step(state, row)]
        group.update((json.dumps(state),))
        if idle_ms is not None:
            group.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=names)

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.where(F.col(key).isNotNull()).groupBy(key).applyInPandasWithState(run, schema, "state string", "append", timeout)
