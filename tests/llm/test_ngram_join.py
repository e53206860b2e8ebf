"""The Jaccard join against all pairs, its bounds and odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest

from encephalake.llm import ngram_join

SF = "/root/testdata/sf0.001"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain(rows):
    """(id, n_shingles, component) over all pairs."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    ids = [k for k, _ in rows]
    lowest = {r: min([ids[k] for k in range(len(rows)) if root[k] == r and ids[k] is not None], default=None) for r in set(root)}
    return sorted(((ids[k], len(sets[k]), lowest[root[k]]) for k in range(len(rows))), key=repr)


def found(spark, rows, **options):
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, node int")
    return sorted((tuple(r) for r in ngram_join.similar_documents(spark, docs, **options).collect()), key=repr)


def copies(count, group, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows, base = [], []
    for i in range(count):
        if i % group == 0:
            base = rng.choices(words, k=rng.choice([8, 40, 150, 700]))
        text = list(base)
        for _ in range(rng.randint(0, 1 + len(base) // 30)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((1000 - i, " ".join(text) + (" this line is at the end of many of the texts" if i % 3 else "")))
    return rows


ODD = [(2000, None), (2001, ""), (2002, " \n"), (2003, "one two"), (2004, "ONE  two"), (2005, "one two three"), (None, "one two"), (None, "alone here"), (2003, "one two")]


@pytest.mark.parametrize("group, tile, phases", [(8, 512, ngram_join.PHASES), (90, 512, ngram_join.PHASES), (90, 7, ((1, 1, True), (1, 1, False), (None, None, False))), (180, 5, ((None, None, False),))])
def test_all_pairs(spark, monkeypatch, group, tile, phases):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "PHASES", phases)
    rows = copies(180, group, group) + ODD
    want = plain(rows)
    assert found(spark, rows) == want and len({r[2] for r in want}) < 150


def test_large_group_with_edits_of_a_few_is_not_all_pairs(spark, monkeypatch):
    """Two copies each share an edit, so their rarest shingles are not the group's; the last phase still gets few pairs."""
    base, rows, met = [f"w{i}" for i in range(200)], [], []
    for i in range(200):
        text = list(base)
        text[random.Random(i // 2).randrange(5, 195)] = f"edit{i // 2}"
        rows.append((i, " ".join([*text, f"own{i}"])))
    bounded = ngram_join._bounded
    monkeypatch.setattr(ngram_join, "_bounded", lambda pairs, *rest: met.append(pairs.count()) or bounded(pairs, *rest))
    got = found(spark, rows)
    assert {r[2] for r in got} == {0} and sum(met) < 2000


def test_pair_of_a_tile_is_left_out_of_the_next(spark):
    """Of 30 shared shingles, a pair leaves the tile of the first one only."""
    from pyspark.sql import functions as F

    rows = [(k, node, 40, k, node, node * 1000 + k if k < 1 else k - 1, node * 1000 + k if k < 2 else k - 2) for k in range(30) for node in (500, 501, 502)]
    tiles = spark.createDataFrame(rows, "key long, node long, n long, place long, root long, before long, earlier long")
    sig = ngram_join.signature(np.arange(40, dtype=np.uint64))
    tiles = tiles.withColumns({"n": F.lit(400).cast("long"), "band": F.lit(-1).cast("long"), "lo": F.lit(0).cast("long"), "hi": F.lit(0).cast("long"), "block": F.lit(0).cast("long"), "visits": F.lit(False), "sig": F.lit(bytearray(sig))})
    pairs = ngram_join._candidates(tiles.repartition(30, "key"), None, ngram_join.Limit(0.8))
    assert sorted(tuple(r) for r in pairs.collect()) == [(500, 501), (500, 502), (501, 502)]
    late = ngram_join._candidates(tiles.where("key >= 2"), None, ngram_join.Limit(0.8))
    assert late.isEmpty()


def test_limit_is_included(spark):
    base = [f"w{i}" for i in range(13)]  # nine shingles, the cut copy has eight of them and another text seven
    rows = [(1, " ".join(base)), (2, " ".join(base[:12])), (3, " ".join(f"v{i}" for i in range(14))), (4, " ".join(f"v{i}" for i in range(12)))]
    rows += [(5, " ".join(f"u{i}" for i in range(14))), (6, " ".join(f"u{i}" for i in range(11)))]
    assert found(spark, rows) == plain(rows) == [(1, 9, 1), (2, 8, 1), (3, 10, 3), (4, 8, 3), (5, 10, 5), (6, 7, 6)]


def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(SF + "/documents.parquet").select("doc_id", "text").collect()]
    want = plain(rows)
    assert found(spark, rows) == want and len({r[2] for r in want}) < len({t for _, t in rows})


def test_candidates_are_compared(spark):
    rows = copies(60, 6, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = [r[0] for r in ngram_join.facts(docs, "doc_id", "text", 5, False).where("common is null").select("mark").distinct().collect()]
    pairs = spark.createDataFrame([(marks[0], m) for m in marks], "a long, b long")
    got = ngram_join.near_sets(spark, docs, candidates=pairs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows)


def test_empty_texts_may_link(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (4, " ")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.near_sets(spark, docs, link_empty=True).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1}


def test_empty_table(spark):
    assert found(spark, []) == []


def test_signature_bounds_overlap():
    rng = np.random.default_rng(5)
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 1200).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 1000))) for _ in "ab")
        flat = ngram_join.signature(a) + ngram_join.signature(b)
        lengths = np.array([len(ngram_join.signature(x)) for x in (a, b)])
        differ = ngram_join.differing_bits(np.frombuffer(flat, np.uint8), np.array([0, lengths[0]]), lengths, np.array([0]), np.array([1]))[0]
        assert len(np.intersect1d(a, b)) <= (len(a) + len(b) - differ) // 2


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.9, 1.0])
def test_limits(similarity):
    limit = ngram_join.Limit(similarity)
    for a in range(1, 60):
        assert limit.prefix(a) == a - min(i for i in range(a + 1) if i >= round(similarity * a, 9)) + 1
        for b in range(1, 60):
            least = min((i for i in range(a + b + 1) if i >= round(similarity * (a + b - i), 9)))
            assert int(limit.overlap(a + b)) == least


@pytest.mark.parametrize("n", [40, 300, 900, 1800, 3000, 9000])
def test_tile_signatures_tell_unlike_sets_apart(n):
    """Sets that share a fifth of their elements are left out by what a tile holds, however long the texts are."""
    rng = np.random.default_rng(n)
    limit, both = ngram_join.Limit(0.8), rng.integers(0, 1 << 63, n // 5).astype(np.uint64)
    tags = []
    for _ in range(6):
        own = np.unique(np.concatenate([both, rng.integers(0, 1 << 63, n - n // 5).astype(np.uint64)]))
        sig = ngram_join.signature(own)
        tags.append(ngram_join.folded(sig, ngram_join.tile_bits(len(own))))
    lengths = np.array([len(x) for x in tags])
    a, b = np.triu_indices(len(tags), 1)
    differ = ngram_join.differing_bits(np.frombuffer(b"".join(tags), np.uint8), np.cumsum(lengths) - lengths, lengths, a, b)
    assert ((2 * n - differ) // 2 < limit.overlap(2 * n)).all()
