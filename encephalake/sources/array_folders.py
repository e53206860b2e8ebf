"""Folders of ``raw_data.npy`` and ``metadata.json`` as a Spark data source, read and written in parts.

``spark.read.format("array_folders").load(root)`` gives long samples. Planning lists names and lengths
only; small folders share a task, a long recording is cut by columns, and every task reads the metadata and
the byte ranges it needs. Equality filters on session and channel and bounds on the sample index are
taken over with the option ``pushdown``, which ``spark.sql.python.filterPushdown.enabled`` must allow: other rows of the matrix, other columns
and the data of other sessions are then not read.

The metadata name the matrix rows that are channels (``eeg_channel_indices``). ``timestamp_channel`` is the row
of the board's time in seconds; if any folder has one, the schema has ``t_sec``. ``start_sample`` is
the index of the first column (0 if missing), ``data_file`` the array (``raw_data.npy`` if missing). With
``missing: "nan"`` a value that is no number is a sample that the recording lacks.
"""

from __future__ import annotations

import fnmatch
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from ..dims import SAMPLE_RATE

FORMAT = "array_folders"
META, DATA = "metadata.json", "raw_data.npy"
#: Bytes of arrays that a task reads, about.
TASK_BYTES = 64 << 20
#: Samples of each channel in a written folder.
PART = 1 << 16
_ROWS = 1 << 16
_BASE = "session_id string, channel string, channel_idx int, sample_idx bigint, uv double"


def _store(uri: str):
    from pyarrow import fs

    if uri.startswith("file:") or "://" in uri:
        return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    return fs.LocalFileSystem(), uri


def _listed(uri: str):
    """(store, [(folder, data file name, bytes)]) of the folders below ``uri``, which may be a pattern."""
    from pyarrow import fs

    store, path = _store(uri)
    path = path.rstrip("/")
    parts = path.split("/")
    wild = next((i for i, p in enumerate(parts) if any(c in p for c in "*?[")), None)
    root = path if wild is None else "/".join(parts[:wild])
    files: dict[str, dict[str, int]] = {}
    for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
        if info.type == fs.FileType.File:
            folder, _, name = info.path.rpartition("/")
            files.setdefault(folder, {})[name] = info.size
    found = []
    for folder, names in sorted(files.items()):
        inside = wild is None or any(fnmatch.fnmatchcase("/".join(folder.split("/")[:n]), path) for n in range(wild, len(folder.split("/")) + 1))
        if META in names and inside:
            found.append((folder, sum(size for name, size in names.items() if name.endswith(".npy"))))
    return store, found


def _metadata(store, folder: str) -> dict:
    with store.open_input_stream(f"{folder}/{META}") as f:
        return json.loads(f.read())


@dataclass
class Wanted:
    """What pushed filters leave: sets of values (None is any) and bounds of the sample index."""

    session_id: set | None = None
    channel: set | None = None
    channel_idx: set | None = None
    first: int = 0
    last: int | None = None

    def take(self, f: ds.Filter) -> bool:
        """Take a filter over if it is one of those that can be."""
        if isinstance(f, ds.IsNotNull):
            return len(f.attribute) == 1 and f.attribute[0] in ("session_id", "channel", "channel_idx", "sample_idx")
        if len(getattr(f, "attribute", ())) != 1:
            return False
        name = f.attribute[0]
        if name in ("session_id", "channel", "channel_idx") and isinstance(f, (ds.EqualTo, ds.In)):
            values = set(f.value) if isinstance(f, ds.In) else {f.value}
            old = getattr(self, name)
            setattr(self, name, values if old is None else old & values)
            return True
        if name == "sample_idx" and isinstance(f, (ds.EqualTo, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual)):
            if isinstance(f, (ds.EqualTo, ds.GreaterThan, ds.GreaterThanOrEqual)):
                self.first = max(self.first, f.value + isinstance(f, ds.GreaterThan))
            if isinstance(f, (ds.EqualTo, ds.LessThan, ds.LessThanOrEqual)):
                bound = f.value - isinstance(f, ds.LessThan)
                self.last = bound if self.last is None else min(self.last, bound)
            return True
        return False


class ArrayFolders(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        store, folders = _listed(self.options["path"])
        timed = any("timestamp_channel" in _metadata(store, folder) for folder, _ in folders[:16])
        return _BASE + (", t_sec double" if timed else "")

    def reader(self, schema) -> ds.DataSourceReader:
        kind = FilteringReader if self.options.get("pushdown", "false") == "true" else ArrayReader
        return kind(self.options["path"], schema.fieldNames(), int(self.options.get("taskBytes", TASK_BYTES)))


@dataclass
class Pieces(ds.InputPartition):
    """(folder, piece number, number of pieces) for one task."""

    pieces: list[tuple[str, int, int]]


class ArrayReader(ds.DataSourceReader):
    def __init__(self, path: str, names: list[str], task_bytes: int):
        self.path, self.names, self.task_bytes = path, names, task_bytes
        self.wanted = Wanted()

    def partitions(self):
        out, held, room = [], [], self.task_bytes
        for folder, size in _listed(self.path)[1]:
            count = max(1, -(-size // self.task_bytes))
            if held and (count > 1 or size > room):
                out.append(Pieces(held))
                held, room = [], self.task_bytes
            if count > 1:
                out += [Pieces([(folder, i, count)]) for i in range(count)]
            else:
                held.append((folder, 0, 1))
                room -= size
        return out + ([Pieces(held)] if held or not out else [])

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        store = _store(self.path)[0]
        for folder, piece, count in partition.pieces:
            yield from self._folder(store, folder, piece, count)

    def _folder(self, store, folder: str, piece: int, count: int) -> Iterator[pa.RecordBatch]:
        meta, wanted = _metadata(store, folder), self.wanted
        session = meta["session_id"]
        if wanted.session_id is not None and session not in wanted.session_id:
            return
        names = meta.get("channel_names") or []
        numbers = meta.get("channel_numbers") or range(len(meta["eeg_channel_indices"]))
        lines = [(n, names[i] if i < len(names) else f"CH{n + 1}", row) for i, (n, row) in enumerate(zip(numbers, meta["eeg_channel_indices"]))]
        lines = [x for x in lines if wanted.channel_idx is None or x[0] in wanted.channel_idx]
        lines = [x for x in lines if wanted.channel is None or x[1] in wanted.channel]
        start, times = meta.get("start_sample", 0), meta.get("timestamp_channel")
        with store.open_input_file(f"{folder}/{meta.get('data_file', DATA)}") as f:
            version = np.lib.format.read_magic(f)
            read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            (_, columns), fortran, dtype = read(f)
            if fortran:
                raise ValueError(f"{folder}: expected a row-major array")
            base = f.tell()
            first = max(columns * piece // count, wanted.first - start)
            stop = columns * (piece + 1) // count
            stop = stop if wanted.last is None else min(stop, wanted.last + 1 - start)

            def part(row: int, a: int, b: int) -> np.ndarray:
                f.seek(base + (row * columns + a) * dtype.itemsize)
                return np.frombuffer(f.read((b - a) * dtype.itemsize), dtype=dtype).astype(float)

            for a in range(first, stop, _ROWS):
                b = min(a + _ROWS, stop)
                seconds = part(times, a, b) if times is not None and "t_sec" in self.names else None
                for idx, name, row in lines:
                    values = part(row, a, b)
                    at = np.flatnonzero(~np.isnan(values)) if meta.get("missing") == "nan" else np.arange(b - a)
                    if not len(at):
                        continue
                    made = {
                        "session_id": pa.array([session] * len(at), pa.string()),
                        "channel": pa.array([name] * len(at), pa.string()),
                        "channel_idx": pa.array(np.full(len(at), idx, np.int32)),
                        "sample_idx": pa.array(start + a + at.astype(np.int64)),
                        "uv": pa.array(values[at]),
                        "t_sec": pa.nulls(len(at), pa.float64()) if seconds is None else pa.array(seconds[at]),
                    }
                    yield pa.RecordBatch.from_arrays([made[n] for n in self.names], self.names)


class FilteringReader(ArrayReader):
    """Spark refuses a reader that takes filters where its setting does not allow them."""

    def pushFilters(self, filters):
        return [f for f in filters if not self.wanted.take(f)]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrayFolders)


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Long samples of all array folders below ``path`` (a folder or a pattern); filters are pushed if the session allows it."""
    register(spark)
    options.setdefault("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    return spark.read.format(FORMAT).options(**options).load(path)


def write(samples: DataFrame, root: str, fs: float = SAMPLE_RATE, part: int = PART, board_id: int = -1) -> DataFrame:
    """Write long samples as array folders, ``part`` samples of all channels each; (session_id, part, folder, total_samples) of what was written.

    A task holds one part of one session, so a long recording is written by many. The array has a name of its
    own and the metadata that name it come last: a folder without metadata, or an array that no metadata
    name (of a task that was lost or ran twice), is never read. ``t_sec``, if there, is the timestamp row.
    """
    timed = "t_sec" in samples.columns

    def save(key, pdf):
        session, number = key
        first = int(number) * part
        line = pdf.drop_duplicates("channel_idx").sort_values("channel_idx")
        rows = {c: i for i, c in enumerate(line["channel_idx"].tolist())}
        at = (pdf["sample_idx"] - first).to_numpy()
        matrix = np.full((len(rows) + timed, int(at.max()) + 1), np.nan)
        matrix[pdf["channel_idx"].map(rows).to_numpy(), at] = pdf["uv"].to_numpy()
        if timed:
            matrix[len(rows), at] = pdf["t_sec"].to_numpy()
        store, path = _store(root)
        folder = f"{path}/{session}/part-{int(number):06d}"
        store.create_dir(folder, recursive=True)
        name = f"raw_data-{uuid.uuid4().hex}.npy"
        with store.open_output_stream(f"{folder}/{name}") as f:
            np.lib.format.write_array(f, np.ascontiguousarray(matrix), allow_pickle=False)
        meta = {
            "session_id": session, "board_id": board_id, "sample_rate": fs, "eeg_channel_indices": list(rows.values()), "channel_names": line["channel"].tolist(), "channel_numbers": list(rows),
            "total_channels": matrix.shape[0], "total_samples": matrix.shape[1], "duration_sec": matrix.shape[1] / fs, "start_sample": first, "data_file": name, "missing": "nan",
        }
        if timed:
            meta["timestamp_channel"] = len(rows)
        with store.open_output_stream(f"{folder}/{META}") as f:
            f.write(json.dumps(meta).encode())
        return pd.DataFrame([(session, number, folder, matrix.shape[1])], columns=["session_id", "part", "folder", "total_samples"])

    columns = ["session_id", "channel", "channel_idx", "sample_idx", "uv"] + ["t_sec"] * timed
    parts = samples.select(*columns, F.floor(F.col("sample_idx") / part).cast("bigint").alias("part"))
    return parts.groupBy("session_id", "part").applyInPandas(save, "session_id string, part bigint, folder string, total_samples bigint")
