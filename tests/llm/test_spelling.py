"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from encephalake.llm import spelling

SF = "/root/testdata/sf0.001"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[at:] == b[at + 1 :] or (len(a) == len(b) and a[at + 1 :] == b[at + 1 :])


def plain_counts(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII)
            check = zlib.crc32(f"{doc}:{run}".encode())
            if check % 199 == 0:
                run = run[: check % len(run)] + run[check % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def plain(counts):
    forms, rows = {}, {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= 5 * n else None
        rows[w] = len(near)
    out = []
    for w in counts:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, counts[w], rows[w], counts.get(forms[w])))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def test_words_of_few_letters(spark):
    rng = random.Random(4)
    counts = {"".join(rng.choices("abé", k=rng.randint(1, 9))): rng.choice([5, 6, 30, 31, 200, 1200]) for _ in range(260)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = rows_of(spelling.variants(df))
    assert got == plain(counts) and any(r[2] != r[1] and r[1] for r in got)


def test_level_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BROADCAST_ROWS", 0)
    rng = random.Random(9)
    counts = {"".join(rng.choices("xyz", k=rng.randint(6, 8))): rng.randint(5, 300) for _ in range(150)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows_of(spelling.variants(df)) == plain(counts)


def test_given_documents(spark):
    docs = spark.read.parquet(SF + "/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(spelling.group_variants(spark, docs)) == plain(plain_counts(rows))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "Straße STRASSE " * 6), (4, "Ÿÿ×abcde abcdef-abcdefg " * 5), (None, "abcdeg " * 7), (3, "abcdex " * 2), (3, "abcdex " * 3), (5, "long" * 400 + " " + "x")]
    docs = spark.createDataFrame([(k, t, "w") for k, t in rows], "doc_id long, text string, word string")
    assert rows_of(spelling.group_variants(spark, docs)) == plain(plain_counts(rows))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.group_variants(spark, docs).collect() == []
