"""Operators with state of their own: samples put in order, filtered and kept, with event-time timers.

A sample later than its neighbours but within the watermark still takes its place; what a sample waits for
is final once the watermark has passed the sample. After a silence of ``silence`` seconds of event time a
key's state ends, so keys that stop sending cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..dims import SAMPLE_RATE
from ..functions import kernels

#: Timers and lists need this state store; the operators here set it for the session if it has another. Streams
#: that were started before keep the one in their checkpoint.
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
DELAY = "10 seconds"
SILENCE = 3600.0


def _output(stream: DataFrame, keys: Sequence[str], columns: str) -> str:
    types = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    return ", ".join([*[f"{k} {types[k]}" for k in keys], columns])


def _keyed(stream: DataFrame, keys: Sequence[str], delay: str) -> DataFrame:
    stream.sparkSession.conf.set(*_PROVIDER)
    return stream.withWatermark("ts", delay).select(*keys, "sample_idx", "uv", "ts", F.unix_millis("ts").alias("ms")).groupBy(*keys)


class _Timed(StatefulProcessor):
    """One timer for the silence after the last sample, and one for what waits."""

    def __init__(self, keys: Sequence[str], silence: float):
        self.keys, self.silence_ms = list(keys), int(silence * 1000)

    def _set_timers(self, wanted: list[int]) -> None:
        held = set(self.handle.listTimers())
        for ms in held - set(wanted):
            self.handle.deleteTimer(ms)
        for ms in set(wanted) - held:
            self.handle.registerTimer(ms)

    def _rows(self, key: tuple, **columns) -> pd.DataFrame:
        return pd.DataFrame({**dict(zip(self.keys, key)), **columns})

    def close(self) -> None:
        pass


class _Notch(_Timed):
    """Filter values, the next index and the samples that wait for one before them."""

    def __init__(self, keys: Sequence[str], freq: float, q: float, fs: float, first: int, silence: float):
        super().__init__(keys, silence)
        self.block = kernels.BlockFilter(*kernels.notch_biquad(freq, q, fs))
        self.first = first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "z1 double, z2 double, following bigint, last_ms bigint")
        self.waiting = handle.getListState("waiting", "idx bigint, x double, ms bigint")

    def _pass(self, key: tuple, new: list[pd.DataFrame], watermark: int) -> Iterator[pd.DataFrame]:
        z1, z2, following, last_ms = self.place.get() if self.place.exists() else (0.0, 0.0, self.first, 0)
        z = np.array([z1, z2])
        held = list(self.waiting.get()) if self.waiting.exists() else []
        old = pd.DataFrame([tuple(r) for r in held], columns=["idx", "x", "ms"])
        for part in new or [old.iloc[:0]]:
            rows = pd.concat([old, part]) if len(old) else part
            rows = rows[rows["idx"] >= following].drop_duplicates("idx").sort_values("idx")
            idx, x, ms = (rows[c].to_numpy() for c in ("idx", "x", "ms"))
            last_ms = max(last_ms, int(ms.max())) if len(ms) else last_ms
            starts = np.flatnonzero(np.diff(idx, prepend=idx[:1] - 2) != 1)
            done = 0
            for a, b in zip(starts, [*starts[1:], len(idx)]):
                if idx[a] != following:
                    if ms[a] > watermark:
                        break
                    z = np.zeros(2)  # what is missing before it will not come: a new stretch
                y, z = self.block.run(x[a:b].astype(float), z)
                following, done = int(idx[b - 1]) + 1, b
                yield self._rows(key, sample_idx=idx[a:b], uv=y)
            old = rows.iloc[done:]
        if len(old):
            self.waiting.put([tuple(r) for r in old[["idx", "x", "ms"]].itertuples(index=False, name=None)])
        elif held:
            self.waiting.clear()
        self.place.update((float(z[0]), float(z[1]), following, last_ms))
        self._set_timers([last_ms + self.silence_ms] + ([int(old["ms"].iloc[0])] if len(old) else []))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # one Arrow batch after another, so a key's share of a micro-batch is never held whole but for what waits
        parts = [p.rename(columns={"sample_idx": "idx", "uv": "x"})[["idx", "x", "ms"]] for p in rows]
        yield from self._pass(key, parts, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        yield from self._pass(key, [], watermark)
        if self.place.exists() and self.place.get()[3] + self.silence_ms <= watermark:
            self.place.clear()
            self.waiting.clear()
            self._set_timers([])


def stateful_notch(
    stream: DataFrame, keys: Sequence[str], freq: float = 60.0, q: float = 30.0, fs: float = SAMPLE_RATE,
    delay: str = DELAY, first: int = 0, silence: float = SILENCE,
) -> DataFrame:
    """(keys, sample_idx, uv): causal notch whose state survives from one micro-batch to the next.

    Rows may arrive in any order within the watermark; a row goes out once those before it are there, from index
    ``first`` on, or once the watermark says that they will not come. A gap starts a new stretch, as in the batch form. Blocks
    of samples are filtered by a matrix, not one by one.
    """
    out = _output(stream, keys, "sample_idx bigint, uv double")
    return _keyed(stream, keys, delay).transformWithStateInPandas(_Notch(keys, freq, q, fs, first, silence), out, "append", "eventtime")


class _Latest(_Timed):
    """The last samples by index, as arrays."""

    def __init__(self, keys: Sequence[str], keep: int, silence: float):
        super().__init__(keys, silence)
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tail = handle.getValueState("tail", "idx array<bigint>, x array<double>, last_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        idx, x, last_ms = self.tail.get() if self.tail.exists() else ([], [], 0)
        idx, x = np.asarray(idx, np.int64), np.asarray(x, float)
        for pdf in rows:  # trimmed per Arrow batch
            idx = np.concatenate([idx, pdf["sample_idx"].to_numpy()])
            x = np.concatenate([x, pdf["uv"].to_numpy()])
            last_ms = max(last_ms, int(pdf["ms"].max()))
            idx, order = np.unique(idx, return_index=True)
            late = np.searchsorted(idx, idx[-1] - self.keep, "right")
            idx, x = idx[late:], x[order[late:]]
        self.tail.update((idx.tolist(), x.tolist(), last_ms))
        self._set_timers([last_ms + self.silence_ms])
        yield self._rows(key, last_idx=[int(idx[-1])], idx=[idx.tolist()], x=[x.tolist()])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.tail.exists() and self.tail.get()[2] + self.silence_ms <= timerValues.getCurrentWatermarkInMs():
            self.tail.clear()
        return iter(())


def latest_seconds(
    stream: DataFrame, keys: Sequence[str], seconds: float = 30.0, fs: float = SAMPLE_RATE, delay: str = DELAY, silence: float = SILENCE
) -> DataFrame:
    """(keys, last_idx, idx, x): the last N seconds of each key after every micro-batch, late samples in their places.

    State holds at most N seconds.
    """
    out = _output(stream, keys, "last_idx bigint, idx array<bigint>, x array<double>")
    return _keyed(stream, keys, delay).transformWithStateInPandas(_Latest(keys, int(seconds * fs), silence), out, "append", "eventtime")
