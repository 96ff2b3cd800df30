"""Stateful processors: rows of one unit in time order, in bounded pieces.

Spark starts a processor on the driver too, in a process that may not find this package, so that the classes travel by value.
"""

from __future__ import annotations

import itertools
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql.streaming import StatefulProcessor

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class InOrder(StatefulProcessor):
    """Rows of one unit in time order, whatever their number: when a batch holds several pieces of a unit, they are put away
    by time slice in the state store, then the slices are taken one by one. No more than one piece or one slice of one unit is
    in memory.

    ``step(key, ts, id, value)`` gets one slice's sorted arrays and returns output columns after the key.
    """

    def __init__(self, key: str, ts: str, ident: str, value: str, slice_us: int):
        self.key, self.ts, self.ident, self.value, self.slice_us = key, ts, ident, value, slice_us

    def init(self, handle) -> None:
        self.slices = handle.getMapState("slices", "slice long, piece long", "ts array<long>, id array<long>, value array<double>")

    def handleInputRows(self, key, rows, timerValues):
        rows = iter(rows)
        first, second = next(rows, None), next(rows, None)
        if first is None:
            return
        if second is None:  # all of the unit's rows are one bounded piece already
            yield from self._taken(key, [self._arrays(first)])
            return
        held = set()
        for piece, pdf in enumerate(itertools.chain([first, second], rows)):
            ts, ident, value = self._arrays(pdf)
            at = ts // self.slice_us
            for s in np.unique(at).tolist():
                own = at == s
                self.slices.updateValue((s, piece), (ts[own].tolist(), ident[own].tolist(), value[own].tolist()))
                held.add((s, piece))
        for s, keys in itertools.groupby(sorted(held), key=lambda k: k[0]):
            parts = []
            for k in keys:
                parts.append(self.slices.getValue(k))
                self.slices.removeKey(k)
            yield from self._taken(key, parts)

    def _arrays(self, pdf):
        return (pdf[self.ts].astype("datetime64[us]").astype("int64").to_numpy(), pdf[self.ident].to_numpy(),
                pdf[self.value].to_numpy().astype(float))

    def _taken(self, key, parts):
        ts, ident, value = (np.concatenate([np.asarray(p[i]) for p in parts]) for i in range(3))
        by = np.lexsort((ident, ts))
        cols = self.step(ts[by], ident[by], value[by])
        if len(cols[self.ident]):
            yield pd.DataFrame({self.key: [key[0]] * len(cols[self.ident]), **cols})

    def close(self) -> None:
        pass


class Changes(InOrder):
    def init(self, handle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "on_now boolean, last_us long")

    def step(self, ts, ident, value):
        flag = value != 0
        on_now, last = self.last.get() if self.last.exists() else (None, None)
        late = ts < last if last is not None else np.zeros(len(ts), dtype=bool)
        kept = np.flatnonzero(~late)
        event = np.full(len(ts), None, dtype=object)
        event[late] = "LATE"
        if len(kept):
            before = np.concatenate([[flag[kept[0]] if on_now is None else on_now], flag[kept[:-1]]])
            turned = kept[flag[kept] != before]
            event[turned] = np.where(flag[turned], "START-UP", "SHUTDOWN")
            self.last.update((bool(flag[kept[-1]]), int(ts[kept[-1]])))
        some = event != None  # noqa: E711
        return {self.ident: ident[some], "event": event[some]}


class Trigger(InOrder):
    def __init__(self, key, ts, ident, value, slice_us, short, long, on, off):
        super().__init__(key, ts, ident, value, slice_us)
        self.short, self.long, self.on, self.off = short, long, on, off

    def init(self, handle) -> None:
        super().init(handle)
        self.state = handle.getValueState("trigger", "recent array<double>, active boolean")

    def step(self, ts, ident, value):
        recent, active = self.state.get() if self.state.exists() else ([], False)
        line = np.concatenate([np.asarray(recent, dtype=float), value])
        marks, ids = [], []
        if len(line) >= self.long:
            means = [np.lib.stride_tricks.sliding_window_view(line, n).mean(axis=1) for n in (self.short, self.long)]
            base = means[1]
            ratio = np.divide(means[0][self.long - self.short:], base, out=np.zeros_like(base), where=base != 0)
            at = np.arange(self.long - 1, len(line)) - len(recent)
            for i, x in zip(at[at >= 0].tolist(), ratio[at >= 0].tolist()):
                if (x >= self.on) if not active else (x < self.off):
                    active = not active
                    marks.append("on" if active else "off")
                    ids.append(ident[i])
        self.state.update((line[-(self.long - 1):].tolist() if self.long > 1 else [], bool(active)))
        return {self.ident: np.array(ids, dtype=np.int64), "mark": np.array(marks, dtype=object)}
