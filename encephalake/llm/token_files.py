"""Token-id files in Simple-8b words, written in ascending id order and read back in parallel.

A file holds documents one after another. Ids are renumbered by falling frequency in the file (the rank
table is stored), cut into blocks of ``BLOCK`` ids and packed greedily into 64-bit words: the top four
bits select how many values of which width the other sixty hold; a value of more than sixty bits takes an
escape word and stands whole in a list. Offsets of words and escapes per block let a reader decode any
block alone, and all words of one selector at once. Layout, little-endian:

    "S8B1", block size u32, documents, ids, ranks, blocks, words, escapes (u64 each),
    document ids i64, document lengths u64, rank table u64, word offsets u64, escape offsets u64, words u64, escapes u64

Documents are range-partitioned and sorted by id (rows of one id keep the order of the table, so no id is
too large for a task); a task writes files of ``FILE_IDS`` ids or one document, under names of its own, so
that a lost or repeated task leaves no half file in the manifest. Null text is an empty document, whose
only id is the end id. A null id sorts first. An empty table gives an empty manifest.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_list, file_system, fresh_path, partitions, slices, written
from .tokens import TextEncoder, encoder

BLOCK = 1024
FILE_IDS = 1 << 22
END_ID = 0
#: Fixed values of the word format: selector -> (values in a word, bits of each); selector 0 is the escape.
SELECTORS = {15: (120, 0), 1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 7: (8, 7), 8: (7, 8),
             9: (6, 10), 10: (5, 12), 11: (4, 15), 12: (3, 20), 13: (2, 30), 14: (1, 60), 0: (1, 64)}
_BY_WIDTH = sorted(SELECTORS, key=lambda s: SELECTORS[s][1])
_COUNT = np.array([SELECTORS[s][0] for s in range(16)], np.int64)
_MAGIC = b"S8B1"
_HEAD = "<4sI6Q"
_NO_ID = -(1 << 63)


def pack_words(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, word offset of each block, escapes, escape offset of each block) of unsigned values."""
    blocks = -(-len(values) // BLOCK)
    padded = np.zeros((blocks, BLOCK), np.uint64)
    padded.ravel()[: len(values)] = values
    limits = np.array([(1 << SELECTORS[s][1]) - 1 for s in _BY_WIDTH[:-1]], np.uint64)
    need = np.searchsorted(limits, padded).astype(np.int8)  # place in _BY_WIDTH of the narrowest width that holds the value
    size = np.full(blocks, BLOCK, np.int64)
    size[-1:] = len(values) - BLOCK * (blocks - 1)
    here = np.arange(BLOCK, dtype=np.int16)
    best = np.full((blocks, BLOCK), len(_BY_WIDTH) - 1, np.int8)
    widest = int(need.max()) if blocks else 0
    for width in range(min(widest, len(_BY_WIDTH) - 2), -1, -1):
        wider = np.where(need > width, here, np.int16(BLOCK + 240))  # past the block all is padding
        reach = np.minimum.accumulate(wider[:, ::-1], axis=1)[:, ::-1] - here
        best[reach >= SELECTORS[_BY_WIDTH[width]][0]] = width
    at, open_, starts, chosen, owner = np.zeros(blocks, np.int64), np.arange(blocks), [], [], []
    while len(open_):
        width = best[open_, at[open_]]
        starts.append(open_ * BLOCK + at[open_])
        chosen.append(width)
        owner.append(open_)
        at[open_] += _COUNT[np.array(_BY_WIDTH)[width]]
        open_ = open_[at[open_] < size[open_]]
    start, width, block = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, chosen, owner))
    order = np.argsort(start, kind="stable")
    start, width, block = start[order], width[order], block[order]
    words = np.zeros(len(start), np.uint64)
    flat = np.concatenate([padded.ravel(), np.zeros(240, np.uint64)])
    block_end = (block + 1) * BLOCK
    for place, selector in enumerate(_BY_WIDTH):
        rows = np.flatnonzero(width == place)
        count, bits = SELECTORS[selector]
        if selector and len(rows):
            word = np.full(len(rows), selector << 60, np.uint64)
            for j in range(count if bits else 0):
                inside = start[rows] + j < block_end[rows]
                word |= np.where(inside, flat[start[rows] + j], 0).astype(np.uint64) << np.uint64(j * bits)
            words[rows] = word
    escaped = width == len(_BY_WIDTH) - 1
    offsets = np.searchsorted(block, np.arange(blocks + 1)).astype(np.uint64)
    escapes = np.concatenate([[0], np.cumsum(escaped)])[offsets.astype(np.int64)].astype(np.uint64)
    return words, offsets, flat[start[escaped]], escapes


def unpack_words(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, total: int) -> np.ndarray:
    """The values of whole consecutive blocks; ``offsets`` count from the first word given."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = _COUNT[selector]
    before = np.cumsum(count) - count
    first = offsets[:-1].astype(np.int64)
    block = np.repeat(np.arange(len(first)), np.diff(offsets).astype(np.int64))
    start = before - before[first][block] + block * BLOCK if len(words) else before
    end = np.minimum((block + 1) * BLOCK, total)
    out = np.zeros(total, np.uint64)
    for name, (values, bits) in SELECTORS.items():
        rows = np.flatnonzero(selector == name)
        if not len(rows) or not bits:
            continue
        if name == 0:
            out[start[rows]] = escapes
            continue
        mask = np.uint64((1 << bits) - 1)
        for j in range(values):
            to = start[rows] + j
            inside = to < end[rows]
            out[to[inside]] = (words[rows[inside]] >> np.uint64(j * bits)) & mask
    return out


def encode_file(documents: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A whole file; ``ids`` are the documents' ids one after another."""
    often = np.bincount(ids)
    table = np.argsort(-often, kind="stable")[: np.count_nonzero(often)]
    rank = np.zeros(len(often), np.uint64)
    rank[table] = np.arange(len(table), dtype=np.uint64)
    words, offsets, escapes, escape_offsets = pack_words(rank[ids])
    head = struct.pack(_HEAD, _MAGIC, BLOCK, len(documents), len(ids), len(table), len(offsets) - 1, len(words), len(escapes))
    parts = (documents.astype("<i8"), lengths.astype("<u8"), table.astype("<u8"), offsets.astype("<u8"), escape_offsets.astype("<u8"), words.astype("<u8"), escapes.astype("<u8"))
    return head + b"".join(p.tobytes() for p in parts)


def decode_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, lengths, ids) of a file."""
    magic, block, documents, total, ranks, blocks, words, escapes = struct.unpack_from(_HEAD, data)
    if magic != _MAGIC or block != BLOCK:
        raise ValueError("not a token file of this format")
    at, parts = struct.calcsize(_HEAD), []
    for kind, size in (("<i8", documents), ("<u8", documents), ("<u8", ranks), ("<u8", blocks + 1), ("<u8", blocks + 1), ("<u8", words), ("<u8", escapes)):
        parts.append(np.frombuffer(data, kind, size, at))
        at += 8 * size
    keys, lengths, table, offsets, _, packed, loose = parts
    return keys, lengths.astype(np.int64), table[unpack_words(packed, offsets, loose, total).astype(np.int64)]


def write_files(docs: DataFrame, tokenizer: str, folder: str, key: str = "doc_id", text: str = "text", end: int = END_ID, file_ids: int = FILE_IDS, kind: type = TextEncoder) -> DataFrame:
    """Write token files below ``folder``; the manifest (part, number, path, documents, ids) as a table."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        encode = encoder(tokenizer, kind).encode
        held: list[tuple[list[int], np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal number
            keys, lengths, ids = (np.concatenate([h[i] for h in held]) for i in range(3))
            name = f"part-{part:06d}-{number:04d}-{uuid.uuid4().hex}.s8b"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(encode_file(keys, lengths, ids))
            row = [[part], [number], [f"{folder}/{name}"], [len(keys)], [len(ids)]]
            number += 1
            held.clear()
            types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], ["part", "number", "path", "documents", "ids"])

        for batch in slices(batches, 1, min(2 << 20, 4 * file_ids)):
            ids, lengths = encode([t.decode("utf-8", "replace") for t in byte_list(batch.column(1))], end)
            held.append((np.array([_NO_ID if k is None else k for k in batch.column(0).to_pylist()], np.int64), lengths, ids))
            if sum(len(h[2]) for h in held) >= file_ids:
                yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("_row"))
    ordered = rows.repartitionByRange("doc_id", "_row").sortWithinPartitions("doc_id", "_row").drop("_row")
    return written(ordered.mapInArrow(write, "part int, number int, path string, documents long, ids long"), "manifest")


def read_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, inner = file_system(path)
                with store.open_input_stream(inner) as source:
                    keys, lengths, ids = decode_file(source.read())
                ends = np.cumsum(lengths)
                plain = ids.astype("<u4")
                sums = np.array([zlib.crc32(plain[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist())], np.int64)
                names = pa.array(keys.copy(), mask=keys == _NO_ID)
                yield pa.RecordBatch.from_arrays([names, pa.array(base + ends - lengths), pa.array(lengths), pa.array(sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # ids before a file: those of earlier parts (a row per writing task), then of earlier files of the part
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("_ids")).select("part", F.coalesce(F.sum("_ids").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("_inside", F.coalesce(F.sum("ids").over(inside), F.lit(0))).join(parts, "part")
    spread = placed.select("path", (F.col("_base") + F.col("_inside")).alias("base")).repartition(max(1, 3 * partitions(manifest.sparkSession)))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", kind: type = TextEncoder) -> DataFrame:
    """Write ``docs`` to a fresh folder of the shared one and read it back."""
    return read_files(write_files(docs, tokenizer, fresh_path(docs.sparkSession, "tokens"), key, text, kind=kind))
