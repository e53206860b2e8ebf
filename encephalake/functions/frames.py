"""Halo frames: many windows of all channels cut out of one row, after one exchange.

A frame holds the samples of consecutive windows once, and the few that its last windows reach beyond
it. Windows are slices of the frame's matrix, so a window costs no rows, however much windows overlap,
and whatever is computed of a window (spectra, coherence, shape) comes from the same slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A frame covers about so many samples of each channel, and so many windows are worked on at a time.
FRAME = 2048
SLAB = 256
_ROWS = 20_000


@dataclass
class Frame:
    """All channels of consecutive windows: ``x`` and ``held`` (is the sample there) are C x samples."""

    keys: tuple
    first: int  # number of the first window
    channels: np.ndarray
    x: np.ndarray
    held: np.ndarray
    w: int
    hop: int

    def slabs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window numbers, n x C x w values, the same of presence) for some windows at a time."""
        count = (self.x.shape[1] - self.w) // self.hop + 1
        x = np.moveaxis(sliding_window_view(self.x, self.w, axis=1)[:, :: self.hop], 0, 1)
        held = np.moveaxis(sliding_window_view(self.held, self.w, axis=1)[:, :: self.hop], 0, 1)
        for a in range(0, count, SLAB):
            some = held[a : a + SLAB].any(axis=(1, 2))
            if some.any():
                yield self.first + a + np.flatnonzero(some), x[a : a + SLAB][some], held[a : a + SLAB][some]

    def matrices(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(window number, channels, C x w) of the windows whose present channels miss no sample."""
        for wins, x, held in self.slabs():
            present, whole = held.any(axis=2), held.all(axis=2)
            for i in np.flatnonzero((present == whole).all(axis=1)):
                yield int(wins[i]), self.channels[whole[i]], x[i][whole[i]]


def windows_a_frame(w: int, hop: int) -> int:
    """At least as long as what the last window reaches beyond, so a sample is in two frames at most."""
    return max(1, -(-max(FRAME, w - hop) // hop))


def halo_frames(
    samples: DataFrame, w: int, hop: int, keys: Sequence[str] = ("session_id",), channel: str | None = "channel_idx",
    pos: str = "sample_idx", value: str = "uv",
) -> DataFrame:
    """(keys, frame, g): the samples of each frame's windows, all channels together (one group each without ``channel``).

    Only the samples that reach into the frame before are there twice. A group holds montage size times
    frame length, whatever the recording's length. Windows are counted from index 0.
    """
    length, reach = windows_a_frame(w, hop) * hop, w - hop
    at, frame = F.pmod(F.col(pos), F.lit(length)), F.floor(F.col(pos) / length).cast("bigint")
    rows = samples.where(F.pmod(F.col(pos), F.lit(hop)) < w) if hop > w else samples
    before = F.when((at < reach) & (frame > 0), frame - 1) if reach > 0 else F.lit(None).cast("bigint")
    line = F.lit(0) if channel is None else F.col(channel)
    rows = rows.where(F.col(pos) >= 0).select(*keys, line.cast("int").alias("c"), F.col(pos).alias("_p"), F.col(value).cast("double").alias("v"), F.explode(F.array_compact(F.array(frame, before))).alias("frame"))
    sample = F.struct("c", (F.col("_p") - F.col("frame") * length).cast("int").alias("p"), "v")
    return rows.groupBy(*keys, "frame").agg(F.collect_list(sample).alias("g"))


def over_frames(frames: DataFrame, keys: Sequence[str], w: int, hop: int, columns: str, function: Callable[[Frame], Iterator[dict]]) -> DataFrame:
    """(keys, ``columns``): the rows that ``function`` makes of each frame, as dicts of equally long columns."""
    keys, per = list(keys), windows_a_frame(w, hop)
    key_fields = [frames.schema[k] for k in keys]
    schema = T.StructType([*key_fields, *T.DataType.fromDDL(columns).fields])
    arrow = to_arrow_schema(schema)
    length = (per - 1) * hop + w

    def frame_of(key: tuple, number: int, c: np.ndarray, p: np.ndarray, v: np.ndarray) -> Frame:
        channels, row = np.unique(c, return_inverse=True)
        inside = p < length
        times = np.zeros((len(channels), length), np.int32)
        np.add.at(times, (row[inside], p[inside]), 1)
        x = np.zeros((len(channels), length))
        x[row[inside], p[inside]] = v[inside]
        return Frame(key, number * per, channels, x, times == 1, w, hop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            groups = batch.column(len(keys) + 1)
            ends, flat = groups.offsets.to_numpy(), groups.values
            c, p, v = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            numbers = batch.column(len(keys)).to_pylist()
            names = list(zip(*[batch.column(i).to_pylist() for i in range(len(keys))]))
            for i in range(batch.num_rows):
                one = slice(ends[i], ends[i + 1])
                for made in function(frame_of(names[i], numbers[i], c[one], p[one], v[one])):
                    size = len(next(iter(made.values())))
                    if not size:
                        continue
                    data = [pa.array([k] * size, arrow.field(j).type) for j, k in enumerate(names[i])]
                    data += [made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type) for f in list(arrow)[len(keys) :]]
                    parts.append(pa.RecordBatch.from_arrays(data, schema=arrow))
                    rows += size
                if rows >= _ROWS:
                    yield together(parts)
                    parts, rows = [], 0
        if parts:
            yield together(parts)

    return frames.select(*keys, "frame", "g").mapInArrow(run, schema)


def together(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
