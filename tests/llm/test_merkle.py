"""The Merkle manifest against a plain tree."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from encephalake.llm import merkle

SF = "/root/testdata/sf0.001"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_tree(nodes, fan=3):
    """The root, and for each node its siblings level by level as (before, after)."""
    proofs, over = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        following, above = [], []
        for start in range(0, len(nodes), fan):
            run = nodes[start : start + fan]
            for k in range(len(run)):
                for leaf in over[start + k]:
                    proofs[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            following.append(digest(*run))
            above.append([leaf for k in range(len(run)) for leaf in over[start + k]])
        nodes, over = following, above
    return nodes[0], proofs


def plain_audit(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    held = {s: sorted([(r[0] is not None, r[0] or 0, plain_leaf(r), r) for r in rows if r[1] == s], key=lambda x: x[:3]) for s in sources}
    made = {s: plain_tree([x[2] for x in held[s]]) for s in sources}
    root, upper = plain_tree([made[s][0] for s in sources])
    out = []
    for s, above in zip(sources, upper):
        for (_, _, leaf, row), proof in zip(held[s], made[s][1]):
            whole = proof + above
            node = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                node = (*row[:4], row[4].replace("\n", ""))
            node = plain_leaf(node)
            for before, after in whole:
                node = digest(before, node, after)
            out.append((row[0], leaf, made[s][0], root, digest(*[a + b for a, b in whole]), node, node == root))
    return sorted(out, key=repr)


def audited(spark, rows):
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, size int")
    return sorted((tuple(r) for r in merkle.audit(spark, docs).collect()), key=repr)


def made(count, sources, seed):
    rng = random.Random(seed)
    names = [None, "", "b", "B", "é", "z\U0001f600"] + [f"s{i}" for i in range(sources)]
    return [(i, rng.choice(names + ["hot"] * len(names)), rng.choice(["en", None]), i, rng.choice(["a\nb", "x", None, "", "é\n"])) for i in range(count)]


@pytest.mark.parametrize("count, sources, levels", [(200, 3, 7), (300, 40, 1), (120, 0, 2), (1, 0, 1), (500, 1, 1)])
def test_plain_tree(spark, monkeypatch, count, sources, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle.manifest, "__defaults__", (merkle.FAN, levels))
    rows = made(count, sources, count)
    assert audited(spark, rows) == plain_audit(rows)


@pytest.mark.parametrize("held", [0, 3])
def test_many_sources_are_not_broadcast(spark, monkeypatch, held):
    monkeypatch.setattr(merkle, "_WITNESSES", held)
    monkeypatch.setattr(merkle._small, "__defaults__", (held,))
    rows = made(150, 12, 5)
    assert audited(spark, rows) == plain_audit(rows)


def test_odd_rows(spark):
    rows = [(1, "a", "en", 3, "x\ny"), (1, "a", "en", 3, "x\ny"), (None, "a", None, None, None), (None, "a", None, None, "t\n"), (1, "a", "de", 3, "other")]
    assert audited(spark, rows) == plain_audit(rows)


def test_empty_table(spark):
    assert audited(spark, []) == []


def test_given_documents(spark):
    docs = spark.read.parquet(SF + "/documents.parquet")
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in merkle.audit(spark, docs).collect()), key=repr)
    assert got == plain_audit(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got)


@pytest.mark.parametrize("fan, count", [(2, 17), (3, 1), (3, 3), (3, 4), (3, 28), (5, 31)])
def test_frontier(fan, count):
    nodes = [digest(str(i)) for i in range(count)]
    frontier = merkle.Frontier(fan)
    for i, node in enumerate(nodes):
        frontier.append(node)
        # what is known so far is a prefix of the full witness: digests before a node are never changed
        assert all(len(w) >= 1 for w in frontier.witnesses[: i + 1])
    root, proofs = plain_tree(nodes, fan)
    assert frontier.finish() == root
    assert [[tuple(level) for level in w] for w in frontier.witnesses] == proofs
