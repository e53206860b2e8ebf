"""The near-copy stage against all pairs."""

from __future__ import annotations

import random

import pytest

from encephalake.llm import ngram_join, stages

SF = "/root/testdata/sf0.001"


def plain_sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def plain_kept(rows):
    """Ids that stay: the smallest of each component over all pairs."""
    sets = [plain_sets(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    return sorted({min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in set(root)})


def kept(spark, rows):
    docs = spark.createDataFrame([(k, t, "en") for k, t in rows], "doc_id long, text string, lang string")
    return sorted(r.doc_id for r in stages.near(spark, docs, SF).collect())


def copies(count, group, seed):
    random.seed(seed)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(count):
        if i % group == 0:
            base = random.choices(words, k=random.choice([8, 40, 150]))
        text = list(base)
        for _ in range(random.randint(0, 1 + len(base) // 30)):
            text[random.randrange(len(text))] = random.choice(words)
        rows.append((1000 - i, " ".join(text) + (" this line is at the end of many of the texts" if i % 3 else "")))
    return rows


@pytest.mark.parametrize("group, phases", [(8, ngram_join.PHASES), (90, ngram_join.PHASES), (90, ((None, 1, True), (None, 1, False), (None, None, False)))])
def test_stage_is_all_pairs(spark, monkeypatch, group, phases):
    monkeypatch.setattr(ngram_join, "PHASES", phases)
    rows = copies(180, group, group)
    rows += [(2000, None), (2001, ""), (2002, " "), (2003, "one two"), (2004, "ONE  two"), (2005, "one two three")]
    want = plain_kept(rows)
    assert kept(spark, rows) == want and len(want) < 150


def test_limit_is_included(spark):
    base = [f"w{i}" for i in range(13)]  # nine shingles, the cut copy has eight of them and another text seven
    rows = [(1, " ".join(base)), (2, " ".join(base[:12])), (3, " ".join(f"v{i}" for i in range(14))), (4, " ".join(f"v{i}" for i in range(12)))]
    rows += [(5, " ".join(f"u{i}" for i in range(14))), (6, " ".join(f"u{i}" for i in range(11)))]
    assert plain_kept(rows) == [1, 3, 5, 6] == kept(spark, rows)


def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(SF + "/documents.parquet").select("doc_id", "text").collect() if r.doc_id is not None]
    want = plain_kept(rows)
    assert kept(spark, rows) == want and len(want) < len({t for _, t in rows})
