"""WARC archives: written by tasks, read back in byte ranges whose record boundaries are verified as a chain.

Reading. A file is cut into ranges. Each task finds every ``WARC/1.`` in its range, parses the header that
follows and emits a candidate: its offset, its successor's offset (from Content-Length) and where its chain
leaves the range. A record's payload may hold the same magic with a valid header, so a candidate counts only
if the chain from the start of its file leads to it: pointer jumping over the exits (the jump table joined
with itself, so rounds grow with the logarithm of the ranges) marks the one true entry of every range. From
the entries the records are read; everything else is rejected.

Writing. A response record per row, with the payload in an HTTP block; of equal payloads of at least
``MIN_REVISIT`` bytes only the row with the smallest id carries it, the others are revisit records that
refer to it. Null payload: empty. Null url: no target header; line breaks in a url are escaped. A null id
loses to any other and has an empty name. Urls, headers and payloads may be of any length; further columns are not read. Rows repeated with id and payload are equal responses. Files are
closed at ``FILE_BYTES``, under names of their own, so that a repeated task leaves no half file in the
manifest. An empty table gives no files and no records.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_list, file_system, fresh_path, join_by_count, partitions, slices, written

MIN_REVISIT = 100
FILE_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
#: Fixed values of the format.
MAGIC = b"WARC/1."
_BREAK = b"\r\n"
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_HEADER_STEP = 1 << 16
_NAME = "urn:page:"


def record(kind: str, name: str, block: bytes, date: str, more: dict[str, str]) -> bytes:
    """One whole WARC record."""
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<{name}>", "WARC-Date": date, **more, "Content-Length": str(len(block))}
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode() + block + _BREAK + _BREAK


def _page_record(page, url, payload: bytes, digest: str, first, revisit: bool, date: str) -> bytes:
    name = _NAME + ("" if page is None else str(page))
    more = {} if url is None else {"WARC-Target-URI": url.replace("\r", "%0D").replace("\n", "%0A")}
    more |= {"WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http; msgtype=response"}
    if revisit:
        more |= {"WARC-Refers-To": f"<{_NAME}{first}>", "WARC-Profile": _PROFILE}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record("revisit" if revisit else "response", name, http if revisit else http + payload, date, more)


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write archives below ``folder``; the manifest (path, bytes) as a table."""
    whole = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("page"), F.col(url).cast("string").alias("url"), whole.alias("payload"), F.sha2(whole, 256).alias("digest"))
    large = F.octet_length("payload") >= MIN_REVISIT
    groups = rows.where(large).groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("copies"))
    copied = written(groups.where("copies > 1 and first is not null"), "copied")
    marked = join_by_count(rows, copied, "digest", "copies", copied.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0])
    revisit = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    marked = marked.select("page", "url", "payload", "digest", "first", revisit.alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, store, root = TaskContext.get().partitionId(), *file_system(folder)
        store.create_dir(root, recursive=True)
        out, size, name = None, 0, ""

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64())], ["path", "bytes"])

        for batch in slices(batches, 2):
            columns = [c.to_pylist() for c in batch.columns]
            columns[2] = byte_list(batch.column(2))
            for row in zip(*columns):
                if out is None:
                    name = f"part-{part:06d}-{uuid.uuid4().hex}.warc"
                    out, data = store.open_output_stream(f"{root}/{name}"), record("warcinfo", f"urn:file:{name}", b"format: WARC File Format 1.0\r\n", date, {"Content-Type": "application/warc-fields"})
                    out.write(data)
                    size = len(data)
                data = _page_record(*row, date)
                out.write(data)
                size += len(data)
                if size >= file_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return written(marked.mapInArrow(write, "path string, bytes long"), "archives")


def parse_header(data: bytes, at: int) -> tuple[int, dict[str, str]] | None:
    """(where the block starts, fields) of the header at ``at``; None if there is none, or no length.

    Lines are read one by one, so what is no header is given up at its first line without a colon.
    """
    stop = data.find(_BREAK, at)
    if stop < 0 or not data.startswith(MAGIC, at) or not data[at + len(MAGIC) : stop].isdigit():
        return None
    fields = {}
    while True:
        start, stop = stop + len(_BREAK), data.find(_BREAK, stop + len(_BREAK))
        if stop < 0:
            return None
        if stop == start:
            break
        name, colon, value = data[start:stop].partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    return (stop + len(_BREAK), fields) if length.isascii() and length.isdigit() else None


def _candidates(source, low: int, high: int, size: int) -> list[tuple[int, int]]:
    """(offset, successor) of everything in the range that reads like a record's head."""
    source.seek(low)
    data = source.read(min(size, high + _HEADER_STEP) - low)
    found, at = [], data.find(MAGIC)
    while 0 <= at < high - low:
        # a record's header, however long, ends with an empty line; so does a record, so no more than one is read for it
        step, seen = _HEADER_STEP, at
        while data.find(_BREAK + _BREAK, seen) < 0 and low + len(data) < size:
            step, seen = 2 * step, max(at, len(data) - 3)
            data += source.read(step)
        head = parse_header(data, at)
        if head is not None:
            found.append((low + at, low + head[0] + int(head[1]["content-length"]) + 4))
        at = data.find(MAGIC, at + 1)
    return found


def _leaving(found: list[tuple[int, int]], high: int) -> list[tuple[int, int]]:
    """(offset, where its chain leaves the range, or stops)."""
    exits: dict[int, int] = {}
    for offset, successor in reversed(found):
        exits[offset] = exits.get(successor, successor) if successor < high else successor
    return sorted(exits.items())


def candidates(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, bytes, at, leaves) of every candidate of every range."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, low in zip(*(c.to_pylist() for c in batch.columns)):
                store, inner = file_system(path)
                high = min(size, low + range_bytes)
                with store.open_input_file(inner) as source:
                    rows = _leaving(_candidates(source, low, high, size), high)
                columns = [[path] * len(rows), [size] * len(rows), [r[0] for r in rows], [r[1] for r in rows]]
                types = (pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["path", "bytes", "at", "leaves"])

    ranges = archives.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("low"))
    return _spread(ranges).mapInArrow(scan, "path string, bytes long, at long, leaves long")


def _spread(rows: DataFrame) -> DataFrame:
    """Rows that each stand for a piece of a file, dealt evenly."""
    return rows.repartition(max(1, 3 * partitions(rows.sparkSession)))


def entries(found: DataFrame, archives: DataFrame, strict: bool = True) -> DataFrame:
    """(path, bytes, at): the start of each file and every place where its chain enters a range.

    A chain that stops before its file's end is an error; if not ``strict``, the rest of such a file is left out.
    """
    found = written(found, "candidates")
    targets = found.select("path", F.col("leaves").alias("at")).distinct()
    jumps = found.join(targets, ["path", "at"], "left_semi").unionByName(found.where("at = 0"))
    jumps = written(jumps.select("path", "at", "leaves").distinct(), "jumps")
    reached = written(found.where("at = 0").select("path", "bytes", "at").distinct(), "reached")
    count = reached.count()
    while True:
        further = reached.join(jumps, ["path", "at"]).where(F.col("leaves") < F.col("bytes")).select("path", "bytes", F.col("leaves").alias("at"))
        reached = written(reached.unionByName(further).distinct(), "reached")
        before, count = count, reached.count()
        if count == before:
            starts = archives.where("bytes > 0").select("path", "bytes", F.lit(0).cast("long").alias("at"))
            places = found.select("path", "at").distinct()
            # an exit need not be a record: a broken chain ends there
            broken = reached.unionByName(starts).where("at < bytes").join(places, ["path", "at"], "left_anti").head(1) if strict else []
            if broken:
                raise ValueError(f"{broken[0].path}: no record at byte {broken[0].at} of {broken[0].bytes}, where the chain from the file's start leads")
            return reached.join(places, ["path", "at"], "left_semi")
        twice = jumps.select("path", F.col("at").alias("leaves"), F.col("leaves").alias("after"))
        doubled = jumps.join(twice, ["path", "leaves"], "left").select("path", "at", F.coalesce("after", "leaves").alias("leaves"))
        jumps = written(doubled, "jumps")


_RECORD = (
    "path string, offset long, record_type string, record_id string, target_uri string, refers_to_id string, "
    "payload_bytes long, payload_digest string, payload binary, truncated boolean"
)


def _records(source, at: int, high: int, size: int, payloads: bool) -> Iterator[tuple]:
    """Records of the chain from ``at`` up to the end of the range."""
    while at < high:
        source.seek(at)
        data = source.read(_HEADER_STEP)
        while data.find(_BREAK + _BREAK) < 0 and at + len(data) < size:
            data += source.read(len(data))
        head = parse_header(data, 0)
        if head is None:  # the chain was followed to its end before, and ends here only if it need not be whole
            return
        start, fields = head
        length = int(fields["content-length"])
        block = data[start : start + length]
        if len(block) < length:
            block += source.read(length - len(block))
        cut_off = at + start + length + 4 > size
        body, announced = block, None
        if fields.get("content-type", "").startswith("application/http"):
            http, _, body = block.partition(_BREAK + _BREAK)
            announced = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(_BREAK)) if k.strip().lower() == b"content-length"), None)
        kind = fields.get("warc-type")
        revisit = kind == "revisit"
        digest = fields.get("warc-payload-digest", "").removeprefix("sha256:") if revisit else hashlib.sha256(body).hexdigest()
        count = announced if revisit and announced is not None else len(body)
        yield at, kind, fields.get("warc-record-id", "").strip("<>"), fields.get("warc-target-uri"), fields.get("warc-refers-to", "").strip("<>") or None, count, digest, body if payloads else None, cut_off
        at += start + length + 4


def read_archives(archives: DataFrame, payloads: bool = True, range_bytes: int = RANGE_BYTES, strict: bool = True) -> DataFrame:
    """Every record of (path, bytes), by verified boundaries. A revisit has the size and digest it announces.

    ``truncated`` marks a last record that its file cuts off; a file whose chain breaks elsewhere is an error if ``strict``.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.bool_())
        names = [x.split()[0] for x in _RECORD.split(", ")]
        for batch in batches:
            for path, size, at in zip(*(c.to_pylist() for c in batch.columns)):
                store, inner = file_system(path)
                with store.open_input_file(inner) as source:
                    rows = [(path, *r) for r in _records(source, at, min(size, (at // range_bytes + 1) * range_bytes), size, payloads)]
                columns = list(zip(*rows)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    places = entries(candidates(archives, range_bytes), archives, strict).select("path", "bytes", "at")
    return _spread(places).mapInArrow(read, _RECORD)


def page_of(name):
    """The row id in a record's name."""
    return F.nullif(F.regexp_replace(name, "^" + _NAME, ""), F.lit("")).cast("long")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) from archives written for ``pages``."""
    found = read_archives(write_archives(pages, fresh_path(spark, "warc")), payloads=False).where("record_type != 'warcinfo'")
    return found.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to_id")).alias("refers_to"))


ORACLE = """
with d as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end as first_id from d)
select page_id, payload_bytes, payload_digest,
       case when first_id is not null and page_id is distinct from first_id then 'revisit' else 'response' end as record_type,
       case when page_id is distinct from first_id then first_id end as refers_to
from f
"""
