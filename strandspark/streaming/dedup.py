"""Deduplication of a stream of hits sorted by start: a chain is decided when a later start closes it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.dedup import greedy

_OUT = "key string, start long, end long, priority double, arrival long"
_STATE = "starts array<long>, ends array<long>, priorities array<double>, arrivals array<long>, top long, last long"


def _closed(rows: list[tuple]) -> list[tuple]:
    rows = sorted(rows, key=lambda r: (-r[2], r[3]))
    return [rows[i] for i in greedy((r[0], r[1]) for r in rows)]


def _step(key, frames, state: GroupState, idle: int | None):
    chain, top, last, out = [], -1, -1, []
    if state.exists:
        s, e, p, a, top, last = state.get
        chain = list(zip(s, e, p, a, strict=True))
    if state.hasTimedOut:
        out = _closed(chain)
        state.remove()
    else:
        rows = sorted((r for f in frames for r in f[["start", "end", "priority", "arrival"]].itertuples(index=False, name=None)), key=lambda r: (r[0], r[3]))
        for r in rows:
            if r[0] < last:
                raise ValueError(f"ranges of {key[0]} are not sorted by start: {r[0]} after {last}")
            if chain and r[0] > top:
                out += _closed(chain)
                chain, top = [], -1
            chain.append(tuple(r))
            top, last = max(top, r[1]), r[0]
        s, e, p, a = zip(*chain, strict=True)
        state.update((list(map(int, s)), list(map(int, e)), list(map(float, p)), list(map(int, a)), int(top), int(last)))
        if idle is not None:
            state.setTimeoutDuration(idle * 1000)
    yield pd.DataFrame([(key[0], *r) for r in out], columns=["key", "start", "end", "priority", "arrival"])


def dedup_stream(stream: DataFrame, *, idle: int | None = None) -> DataFrame:
    """A stream of ``key, start, end, priority, arrival`` -> the rows kept, as their chains close.

    idle: after so many seconds without rows of a key its open chain is decided
    too, which needs a trigger that goes on; without it (None) an open chain
    waits in the state for a later start, and an ``availableNow`` trigger ends.
    """
    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    return stream.groupBy("key").applyInPandasWithState(lambda key, frames, state: _step(key, frames, state, idle), _OUT, _STATE, "append", timeout)
