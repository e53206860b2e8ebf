"""Exact duplicates and SimHash near-duplicates."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
import xxhash

from encephalake.llm import components, exact_dedup, simhash

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, digest int, fp string, kept string"


def odd_rows():
    return [
        (3, "a b  c", 1, "x", None),
        (1, "abc", 1, "x", None),
        (2, "a b\tc ", 1, "x", None),
        (2, "a b\tc ", 1, "x", None),
        (None, "a  b\n c", 1, "x", None),
        (7, None, None, None, None),
        (8, "", 1, "x", None),
        (9, " \n", 1, "x", None),
        (10, "x " * 50_000, 1, "x", None),
        (11, "été", 1, "x", None),
    ]


def plain_exact(rows):
    groups = {}
    for key, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), key is None, key or 0, key))
    out = []
    for key, text in rows:
        normal = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        keep = min(groups[normal])[3]
        out.append((key, keep, len(groups[normal]), key == keep, hashlib.sha256(normal.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), ODD)
    got = sorted((tuple(r) for r in exact_dedup.deduplicate(spark, docs).collect()), key=repr)
    assert got == plain_exact([r[:2] for r in odd_rows()])
    assert exact_dedup.deduplicate(spark, docs.limit(0)).count() == 0


def test_index_outlives_its_batches(spark):
    index = exact_dedup.open_index(spark, buckets=3)
    first = spark.createDataFrame([(1, "a b"), (2, "ab")], "doc_id long, text string")
    second = spark.createDataFrame([(0, "a  b"), (5, "new")], "doc_id long, text string")
    exact_dedup.ingest(spark, index, exact_dedup.digests(first))
    again = exact_dedup.open_index(spark, name=f"{index.name}_again", path=index.path, buckets=3)
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.ingest(spark, again, exact_dedup.digests(second)).collect()}
    assert got == {0: (1, False), 5: (5, True)}
    assert spark.table(again.name).count() == 2


def test_hot_digest_is_broadcast_and_the_rest_shuffled(spark, monkeypatch):
    from encephalake.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    rows = [(i, "same" if i % 3 else f"text {i // 6}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in exact_dedup.deduplicate(spark, docs).collect()), key=repr)
    assert got == plain_exact(rows)


def test_native_plan(spark):
    plan = exact_dedup.deduplicate(spark, spark.read.parquet(SF + "/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# SimHash


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def plain_components(rows):
    """{position: smallest id} by breadth-first search over all pairs."""
    prints = [plain_fingerprint(t) for _, t in rows]
    label = [None] * len(rows)
    for i in range(len(rows)):
        if label[i] is None:
            group, todo = {i}, [i]
            while todo:
                a = todo.pop()
                for b in range(len(rows)):
                    if b not in group and (prints[a] ^ prints[b]).bit_count() <= 2:
                        group.add(b)
                        todo.append(b)
            ids = [rows[g][0] for g in group if rows[g][0] is not None]
            for g in group:
                label[g] = min(ids, default=None)
    return sorted(((k, f"{p:016x}", c) for (k, _), p, c in zip(rows, prints, label)), key=repr)


def near(spark, rows, schema="doc_id long, text string"):
    found = simhash.near_duplicates(spark, spark.createDataFrame(rows, schema))
    return sorted((tuple(r) for r in found.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def test_simhash_odd_rows(spark):
    rows = odd_rows() + [(20, "ONE two", 1, "x", None), (21, "one\vTWO", 1, "x", None)]
    assert near(spark, rows, ODD) == plain_components([r[:2] for r in rows])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(spark, empty).count() == 0


def test_simhash_chains_of_near_copies(spark, monkeypatch):
    random.seed(5)
    words = [random.choice(["ab", "cd", "ef", "gh", "ij", "kl"]) + str(random.randint(0, 99)) for _ in range(400)]
    rows = []
    for i in range(120):
        words[random.randrange(len(words))] = f"w{i}"
        rows.append((500 - i, " ".join(words)))
    rows += [(i, f"other text number {i} with words") for i in range(30)]
    want = plain_components(rows)
    assert len({w[2] for w in want}) < 100
    assert near(spark, rows) == want
    monkeypatch.setattr(simhash, "SHARD", 1)  # every shard splits again
    assert near(spark, rows) == want


def test_tree_finds_what_a_scan_finds():
    random.seed(2)
    base = random.getrandbits(64)
    values = [base ^ sum(1 << random.randrange(64) for _ in range(random.randint(0, 6))) for _ in range(400)]
    tree = simhash.Tree(values)
    for v in values[:60]:
        assert sorted(tree.within(v, 2)) == [i for i, x in enumerate(values) if (x ^ v).bit_count() <= 2]


def test_masks_leave_few_bits():
    masks = [0]
    for free in (32, 16, 8):
        masks = [k for m in masks for k in simhash._finer(m)]
        assert {64 - m.bit_count() for m in masks} == {free}


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    random.seed(3)
    pairs = {"chain": [(i, i + 1) for i in range(60)], "star": [(0, i) for i in range(1, 60)], "random": [(random.randrange(80), random.randrange(80)) for _ in range(60)]}[shape]
    parent = {x: x for p in pairs for x in p if p[0] != p[1]}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    got = components.components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == {x: top(x) for x in parent}
