"""Phase of channels too long to transform in one task.

The imaginary part of the analytic signal is a circular convolution of the
channel with a known kernel.  It is evaluated with a power-of-two transform of
size rows x cols that is split the classical way: transforms of ``rows`` points
per column, a twiddle factor, a transpose (one shuffle), transforms of ``cols``
points.  Both inputs are real, so half of the first transform's rows say all.
A task handles a slab of columns or of rows, of ``area`` entries whatever the
length; the transposes shuffle tiles of slabs, not entries.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.layout import gapless

#: Entries of a slab: 1 MB of numbers.
AREA = 1 << 17
#: Chunks that ``cut`` works on at a time.
_SOME = 512


def hilbert_kernel(d: np.ndarray, n: int) -> np.ndarray:
    """Kernel of the discrete Hilbert transform of period n at offsets d."""
    d = np.mod(d, n)
    safe = np.where(d == 0, 1, d)
    angle = np.pi * safe / n
    if n % 2 == 0:
        h = np.where(d % 2 == 1, 2.0 / n / np.tan(angle), 0.0)
    else:
        h = (1.0 / np.tan(angle) - np.where(d % 2 == 0, 1.0, -1.0) / np.sin(angle)) / n
    return np.where(d == 0, 0.0, h)


def with_stretches(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks of ``chunk_arrays`` with the size of their key (``_n``) and the stretches their gapless runs belong to.

    ``_stretch`` counts the key's stretches up to that of the chunk's first run, which begins at ``_from``; the stretch
    of its last run ends at ``_to``. A key's chunks meet as small rows only, without their samples.
    """
    schema = T.StructType([*(chunks.schema[k] for k in keys), *T.DataType.fromDDL("chunk long, _held long, _a long, _z long, _more long, _tail long, _head long").fields])
    arrow = to_arrow_schema(schema)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many samples and gaps a chunk has, its first and last place, where its last run begins and its first run ends."""
        for batch in batches:
            held, at = pc.list_value_length(batch.column("p")).to_numpy().astype(np.int64), batch.column("p").flatten().to_numpy()
            stop = np.cumsum(held)
            begin = stop - held
            jump = np.diff(at, prepend=at[:1]) != 1
            jump[begin] = False
            cuts = np.flatnonzero(jump)
            before, after = np.searchsorted(cuts, begin), np.searchsorted(cuts, stop)
            cuts, more = np.append(cuts, 0), after - before
            tail, head = np.where(more > 0, cuts[after - 1], begin), np.where(more > 0, cuts[before], stop) - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys) + 1)), *map(pa.array, (held, at[begin], at[stop - 1], more, at[tail], at[head]))], schema=arrow)

    runs = chunks.select(*keys, "chunk", "p").mapInArrow(ends, schema)
    key = Window.partitionBy(*keys)
    order, back = key.orderBy("chunk"), key.orderBy(F.desc("chunk"))
    earlier, later = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (order, back))
    runs = runs.withColumn("_fresh", F.coalesce(F.col("_a") - F.lag("_z").over(order) != 1, F.lit(True)))
    runs = runs.withColumn("_over", F.coalesce(F.lead("_a").over(order) - F.col("_z") != 1, F.lit(True)))
    # a chunk that is one run through and through only passes on where the stretch begins and ends
    runs = runs.withColumn("_begins", F.when((F.col("_more") > 0) | F.col("_fresh"), F.col("_tail")))
    runs = runs.withColumn("_ends", F.when((F.col("_more") > 0) | F.col("_over"), F.col("_head")))
    runs = runs.withColumn("_fresh_n", F.col("_fresh").cast("long")).withColumn("_begun", F.col("_more") + F.col("_fresh_n"))
    told = runs.select(
        *keys, "chunk", F.sum("_held").over(key).alias("_n"),
        (F.coalesce(F.sum("_begun").over(earlier), F.lit(0)) + F.col("_fresh_n")).alias("_stretch"),
        F.when(F.col("_fresh"), F.col("_a")).otherwise(F.last("_begins", ignorenulls=True).over(earlier)).alias("_from"),
        F.when(F.col("_over"), F.col("_z")).otherwise(F.last("_ends", ignorenulls=True).over(later)).alias("_to"),
    )
    return chunks.join(told, [*keys, "chunk"])


def _shape(n: int) -> tuple[int, int]:
    """Rows and columns of the transform of n samples: the power of two at or above 2 n, at least 4."""
    bits = max(2, (2 * n - 1).bit_length())
    return 1 << (bits // 2), 1 << (bits - bits // 2)


def _twiddle(k: np.ndarray, c: np.ndarray, size: int) -> np.ndarray:
    """exp(-2 pi i k c / size) of all pairs, with the product reduced exactly."""
    return np.exp(-2j * np.pi * (np.outer(k, c) % size) / size)


def split_phase(chunks: DataFrame, keys: Sequence[str], area: int = AREA) -> DataFrame:
    """(keys, sample_idx, b) of the stretches found by ``with_stretches``, in slabs of ``area`` entries (16 at least).

    A sample without a value leaves its stretch without a phase.
    """
    keys = list(keys)
    key_fields = [chunks.schema[k] for k in keys]
    own = [*keys, "stretch", "start", "n"]

    def fields(ddl: str) -> T.StructType:
        return T.StructType([*key_fields, *T.DataType.fromDDL(ddl).fields])

    pieces = fields("stretch long, start long, n long, slab int, at long, v binary")
    columns = fields("stretch long, start long, n long, tile int, slab int, z binary, g binary, x binary")
    rows = fields("stretch long, start long, n long, slab int, tile int, z binary, x binary")
    phases = fields("sample_idx long, b double")

    def slab(n: int) -> tuple[int, int, int, int]:
        """Rows, columns, columns a slab, rows a tile."""
        n_rows, n_cols = _shape(n)
        return n_rows, n_cols, min(n_cols, max(1, area // n_rows)), max(1, area // n_cols)

    def table(schema: T.StructType, key: Sequence, made: Sequence) -> pa.Table:
        """Rows that share the first columns."""
        arrow = to_arrow_schema(schema)
        shared = [pa.repeat(pa.scalar(k, f.type), len(made[0])) for k, f in zip(key, arrow)]
        return pa.Table.from_arrays([*shared, *(pa.array(c, f.type) for c, f in zip(made, list(arrow)[len(key) :]))], schema=arrow)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The samples of each stretch, cut where the columns of a slab end."""
        arrow = to_arrow_schema(pieces)
        for some in (b.slice(a, _SOME) for b in batches for a in range(0, b.num_rows, _SOME)):
            made, of = [], []
            told = zip(*(some.column(c).to_pylist() for c in ("_stretch", "_from", "_to")))
            for row, (stretch, begin, end) in enumerate(told):
                at, v = (some.column(c)[row : row + 1].flatten().to_numpy(zero_copy_only=False) for c in ("p", "x"))
                runs = gapless(at)
                for i, run in enumerate(runs):
                    start = begin if i == 0 else int(at[run.start])
                    n = (end if i == len(runs) - 1 else int(at[run.stop - 1])) - start + 1
                    _, n_cols, w, _ = slab(n)
                    first = int(at[run.start]) - start
                    last = first + run.stop - run.start
                    for q in (first, *range((first // w + 1) * w, last, w)):
                        one = slice(run.start + q - first, run.start + min(last, (q // w + 1) * w) - first)
                        made.append((stretch + i, start, n, q % n_cols // w, q, v[one].tobytes()))
                        of.append(row)
            known = [some.column(k).take(pa.array(of, pa.int64())) for k in keys]
            yield pa.RecordBatch.from_arrays([*known, *(pa.array(c, f.type) for c, f in zip(zip(*made), list(arrow)[len(keys) :]))], schema=arrow)

    def over_columns(key: tuple, samples: pa.Table) -> pa.Table:
        """Transforms of a slab's columns, of the signal and of the kernel, and the samples themselves, as tiles."""
        *same, number = [k.as_py() for k in key]
        n = same[-1]
        n_rows, n_cols, w, height = slab(n)
        size, c = n_rows * n_cols, np.arange(number * w, (number + 1) * w)
        x = np.zeros((n_rows, w))
        for at, v in zip(samples["at"].to_pylist(), samples["v"].to_pylist()):
            v = np.frombuffer(v)
            x[at // n_cols, at % n_cols - c[0] :][: len(v)] = v
        d = np.arange(n_rows)[:, None] * n_cols + c
        d = np.where(d >= size // 2, d - size, d)
        g = np.where(np.abs(d) < n, hilbert_kernel(d, n), 0.0)
        turn = _twiddle(np.arange(n_rows // 2 + 1), c, size)
        z, g = np.fft.rfft(x, axis=0) * turn, np.fft.rfft(g, axis=0) * turn
        parts = [slice(k, k + height) for k in range(0, len(z), height)]
        x = x[: len(z)]
        return table(columns, same, (range(len(parts)), [number] * len(parts), *([a[p].tobytes() for p in parts] for a in (z, g, x))))

    def over_rows(key: tuple, tiles: pa.Table) -> pa.Table:
        """The rows of a tile, multiplied by the kernel's and transformed back."""
        *same, number = [k.as_py() for k in key]
        n_rows, n_cols, w, height = slab(same[-1])
        k = np.arange(number * height, min((number + 1) * height, n_rows // 2 + 1))
        slabs = tiles["slab"].to_pylist()
        z, g = (np.empty((len(k), n_cols), complex) for _ in range(2))
        for i, a, b in zip(slabs, tiles["z"].to_pylist(), tiles["g"].to_pylist()):
            z[:, i * w : (i + 1) * w], g[:, i * w : (i + 1) * w] = (np.frombuffer(raw, complex).reshape(len(k), w) for raw in (a, b))
        y = np.fft.ifft(np.fft.fft(z) * np.fft.fft(g)) * _twiddle(k, np.arange(n_cols), n_rows * n_cols).conj()
        return table(rows, same, (slabs, [number] * len(slabs), [y[:, i * w : (i + 1) * w].tobytes() for i in slabs], tiles["x"].combine_chunks()))

    def back(key: tuple, tiles: pa.Table) -> pa.Table:
        """The columns of a slab transformed back: the imaginary parts, beside the samples."""
        *same, start, n, number = [k.as_py() for k in key]
        n_rows, n_cols, w, height = slab(n)
        z, x = np.empty((n_rows // 2 + 1, w), complex), np.empty((n_rows // 2 + 1, w))
        for i, a, b in zip(tiles["tile"].to_pylist(), tiles["z"].to_pylist(), tiles["x"].to_pylist()):
            z[i * height : (i + 1) * height], x[i * height : (i + 1) * height] = np.frombuffer(a, complex).reshape(-1, w), np.frombuffer(b).reshape(-1, w)
        at = np.arange(n_rows // 2)[:, None] * n_cols + np.arange(number * w, (number + 1) * w)
        here = at < n
        y, x = np.fft.irfft(z, n_rows, axis=0)[: n_rows // 2][here], x[: n_rows // 2][here]
        b = np.arctan2(y, x)
        b = np.where(b < 0, b + 2 * np.pi, b)
        return table(phases, same[:-1], (at[here] + start, pa.array(b, from_pandas=True)))

    cut_up = chunks.select(*keys, "p", "x", "_stretch", "_from", "_to").mapInArrow(cut, pieces)
    turned = cut_up.groupBy(*own, "slab").applyInArrow(over_columns, columns)
    multiplied = turned.groupBy(*own, "tile").applyInArrow(over_rows, rows)
    return multiplied.groupBy(*own, "slab").applyInArrow(back, phases)
