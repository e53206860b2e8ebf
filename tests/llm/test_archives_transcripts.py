"""WARC archives and transcripts."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from encephalake.llm import transcripts, warc
from encephalake.llm.common import fresh_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages():
    nested = warc.record("response", "urn:page:99", b"x" * 50, "d", {}).decode()
    rows = [(i, f"http://a/{i}", (nested * 3 if i % 3 == 0 else "y" * (i % 250)) + ("z" if i % 2 else ""), "p", i) for i in range(200)]
    rows += [(None, None, None, None, None), (7, "u\r\nv", "q" * 500, "p", 1), (5, None, "q" * 500, "p", 1), (5, None, "q" * 500, "p", 1), (None, "n", "q" * 500, "p", 1)]
    return [*rows, (1000, "big", "WARC/1.0\r\n" * 20_000, "p", 1), (1001, "é", "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 50, "p", 1)]


def plain(rows):
    digest = [hashlib.sha256((r[2] or "").encode()).hexdigest() for r in rows]
    size = [len((r[2] or "").encode()) for r in rows]
    first = {}
    for r, d in zip(rows, digest):
        if r[0] is not None:
            first[d] = min(first.get(d, r[0]), r[0])
    out = []
    for r, d, n in zip(rows, digest, size):
        to = first.get(d) if n >= 100 and r[0] != first.get(d) else None
        out.append((r[0], n, d, "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


SCHEMA = "page_id long, url string, html string, payload string, digest int"


def test_round_trip(spark, pages):
    docs = spark.createDataFrame(pages, SCHEMA)
    assert sorted((tuple(r) for r in warc.round_trip(spark, docs).collect()), key=repr) == plain(pages)
    assert warc.round_trip(spark, docs.limit(0)).count() == 0


@pytest.mark.parametrize("size", [700, 5000])
def test_small_ranges_and_files(spark, pages, size):
    archives = warc.write_archives(spark.createDataFrame(pages, SCHEMA), fresh_path(spark, "warc"), file_bytes=40_000)
    found = warc.read_archives(archives, range_bytes=size).where("record_type != 'warcinfo'").toPandas()
    assert Counter(zip(found.payload_digest, found.payload_bytes)) == Counter((p[2], p[1]) for p in plain(pages))
    assert not found.truncated.any()
    responses = found[found.record_type == "response"]
    assert all(hashlib.sha256(p).hexdigest() == d for p, d in zip(responses.payload, responses.payload_digest))


def test_chain_against_a_walk(spark, pages):
    """Reachable offsets are those of reading each file from its start."""
    archives = warc.write_archives(spark.createDataFrame(pages, SCHEMA), fresh_path(spark, "warc"), file_bytes=30_000)
    found = warc.read_archives(archives, range_bytes=900).toPandas()
    candidates = warc.candidates(archives, 900).count()
    for path, own in found.groupby("path"):
        store, inner = warc.file_system(path)
        data, at, offsets = store.open_input_stream(inner).read(), 0, []
        while at < len(data):
            offsets.append(at)
            start, fields = warc.parse_header(data, at)
            at = start + int(fields["content-length"]) + 4
        assert sorted(own.offset) == offsets
    assert candidates > len(found)  # magic inside payloads was seen and rejected


def test_truncated_file(spark):
    archives = warc.write_archives(spark.createDataFrame([(1, "u", "a" * 300), (2, "v", "b" * 300)], "page_id long, url string, html string").coalesce(1), fresh_path(spark, "warc"))
    path, size = archives.first()
    store, inner = warc.file_system(path)
    data = store.open_input_stream(inner).read()
    with store.open_output_stream(inner) as out:
        out.write(data[:-100])
    short = spark.createDataFrame([(path, size - 100)], "path string, bytes long")
    found = warc.read_archives(short).orderBy("offset").toPandas()
    assert found.truncated.tolist() == [False, False, True]


def test_long_headers(spark):
    """A url of any length: beyond ranges, with magic in it, and the records after it."""
    rows = [(i, f"http://a/{i}", f"page {i} " * 30) for i in range(100)]
    rows[40] = (40, "http://a/" + "x" * 1_300_000, "long " * 30)
    rows[70] = (70, "WARC/1.0 " * 20_000 + "end", "magic " * 30)
    archives = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), fresh_path(spark, "warc"))
    for size in (50_000, warc.RANGE_BYTES):
        found = warc.read_archives(archives, range_bytes=size).where("record_type = 'response'").toPandas()
        assert sorted(zip(found.record_id, found.target_uri.map(len))) == sorted((f"urn:page:{r[0]}", len(r[1])) for r in rows)


@pytest.mark.parametrize("size", [200, 4 << 20])
def test_broken_chain_is_an_error(spark, size):
    rows = [(i, "u", f"{i}" * 300) for i in range(9)]
    archives = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), fresh_path(spark, "warc"))
    path, count = archives.first()
    store, inner = warc.file_system(path)
    data = store.open_input_stream(inner).read()
    at = data.find(b"Content-Length", data.find(b"urn:page:5"))
    with store.open_output_stream(inner) as out:
        out.write(data[:at] + b"Xontent" + data[at + 7 :])
    with pytest.raises(ValueError, match="no record at byte"):
        warc.read_archives(archives, range_bytes=size)
    assert warc.read_archives(archives, range_bytes=size, strict=False).count() == 1 + 5


# transcripts


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    first, moves, emit = rng.random(3), rng.random((3, 3)), rng.random((5, 3))
    paths = np.stack(np.meshgrid(*[range(3)] * 5, indexing="ij"), -1).reshape(-1, 5)
    score = first[paths[:, 0]] + emit[np.arange(5), paths].sum(1) + moves[paths[:, :-1], paths[:, 1:]].sum(1)
    assert transcripts.viterbi(first, moves, emit).tolist() == paths[score.argmax()].tolist()
    tables = [transcripts.best_scores(first, moves, e) for e in (emit[:2], emit[2:3], emit[3:])]
    found = transcripts.borders(np.array([4, 6, 9]), tables)
    assert [f[2] for f in found] == paths[score.argmax()][[1, 2, 4]].tolist()


def plain_turns(model, lines):
    """Turns without the library's own rendering: a new one at each opening state or other role, one marker cut off at most."""
    states = transcripts.viterbi(model.first, model.moves, model.scores(lines))
    turns = []
    for line, state in zip(lines, states):
        role, opens = transcripts.STATES[state]
        opens = opens or not turns or turns[-1][0] != role
        text = line
        for spelling in transcripts.SPELLINGS[role] if opens else ():
            for marker in (f"[{spelling}]: ", f"**{spelling}**: ", f"{spelling}: "):
                if line.startswith(marker):
                    text = line[len(marker) :].lstrip()
        if opens:
            turns.append((role, [text]))
        else:
            turns[-1][1].append(text)
    return [f"<|{role}|>\n" + "\n".join(x) + "\n<|end|>" for role, x in turns]


def test_false_markers_stay_text():
    """Only a marker of the role that opens a turn there is cut off."""
    at = {s: i for i, s in enumerate(transcripts.STATES)}
    lines = ["User: which?", "A: first option", "Q: second option", "Assistant: both", "User: says who", "plain"]
    states = [at["user", True], at["user", False], at["user", False], at["assistant", True], at["assistant", False], at["user", True]]
    got = transcripts.fragments(lines, np.array(states))
    assert [(t, r, x) for t, r, x, _ in got] == [(1, "user", "which?\nA: first option\nQ: second option"), (2, "assistant", "both\nUser: says who"), (3, "user", "plain")]
    other = transcripts.fragments(["User: hm"], np.array([at["assistant", True]]))
    assert other[0][2] == "User: hm"


@pytest.mark.parametrize("merge", [1, 40])
def test_turns_against_one_run(spark, merge):
    """Conversations in one task each, and few that go on over many tasks."""
    turns = spark.read.parquet(SF + "/conversations.parquet")
    turns = turns.withColumn("conv_id", (F.col("conv_id") / merge).cast("long")).withColumn("turn", F.col("turn") + 100 * F.monotonically_increasing_id())
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lines = transcripts.raw_lines(turns)
        model = transcripts.train(lines)
        got = transcripts.parse(lines.drop("role"), model).toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert not got.duplicated(["conversation", "turn"]).any()
    for key, own in lines.toPandas().sort_values(["conversation", "turn", "line_no"]).groupby("conversation"):
        mine = got[got.conversation == key].sort_values("turn")
        assert mine.rendered.tolist() == plain_turns(model, own.line.tolist())
        assert mine.turn.tolist() == list(range(len(mine)))


def test_accuracy_on_held_out_conversations(spark):
    turns = spark.read.parquet(SF.replace("0.001", "0.01") + "/conversations.parquet")
    lines = transcripts.raw_lines(turns)
    model = transcripts.train(lines.where(~transcripts.held_out()))
    rows = lines.where(transcripts.held_out()).toPandas().sort_values(["conversation", "turn", "line_no"])
    right = total = 0
    for _, own in rows.groupby("conversation"):
        states = transcripts.viterbi(model.first, model.moves, model.scores(own.line.tolist()))
        right += sum(transcripts.STATES[s][0] == r for s, r in zip(states, own.role))
        total += len(own)
    assert total > 100 and right / total > 0.9


def test_markers():
    assert transcripts.split_marker("[User]: hi") == ("user", "hi")
    assert transcripts.split_marker("**Assistant**:  a: b") == ("assistant", "a: b")
    assert transcripts.split_marker("Quite: no") == (None, "Quite: no")


def test_odd_turns(spark):
    rows = [(1, 0, "user", "hi?"), (1, 0, "user", "hi?"), (1, None, None, None), (None, 1, "user", "a\n\nb"), (2, 5, "assistant", ""), (3, 1, "nobody", "x" * 50_000)]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, line string")
    got = transcripts.recover(spark, turns).toPandas()
    assert set(got.conv_id.dropna()) == {1, 2, 3} and got.conv_id.isna().any() and got.role.isin(transcripts.ROLES).all()
    assert transcripts.recover(spark, turns.limit(0)).count() == 0
