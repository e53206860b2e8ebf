"""Quality classifier, quality rules and language identification."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from encephalake.llm import language_id, quality_classifier, quality_rules

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, kept string, score int, `_text` string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, columns with clashing names."""
    rows = [
        (1, "the cat and the dog are in the house. " * 20, "en", "x", 1, "y"),
        (1, "the cat and the dog are in the house. " * 20, "en", "x", 1, "y"),
        (2, None, "en", None, None, None),
        (3, "", None, "x", 1, "y"),
        (None, "le chat et le chien sont dans la maison. " * 2000, "fr", "x", 1, None),
        (4, "### $$$ 123", None, "x", 1, "y"),
        (5, " \t\r\n\x0b\x0c", "fr", "x", 1, "y"),
    ]
    return spark.createDataFrame(rows, ODD)


# quality classifier


def test_classifier_learns_ordered_grades():
    rng = np.random.default_rng(0)
    words = {0: b"bad", 1: b"soso", 2: b"good"}
    grades = rng.integers(0, 3, 600)
    noise = [b"w%d" % i for i in range(30)]
    texts = [b" ".join([words[g], *rng.choice(noise, 5)]) for g in grades]
    features = quality_classifier.Features()
    model = quality_classifier.fit([features.of(t) for t in texts], grades)
    assert (np.diff(model.thresholds) > 0).all()
    weight = {g: model.weights[quality_classifier.slot(w)] for g, w in words.items()}
    assert weight[0] < weight[1] < weight[2]
    score = np.array([float(model.weights[s] @ v) for s, v in map(features.of, texts)])
    tails = model.tails(score)
    assert (np.diff(tails, axis=1) <= 0).all() and ((tails > 0.5).sum(axis=1) == grades).mean() > 0.98


def test_classifier_features_against_plain_python():
    text = b"Loud LOUD, word word 12 a!! #b#  \n word"
    slots, values = quality_classifier.Features().of(text)
    words = text.split()
    want = {quality_classifier.slot(w.lower().strip(quality_classifier.EDGES)): 1.0 for w in words}
    shares = {b"symbol": 1, b"upper": 1, b"repeat": 1, b"digit": 1, b"shout": 1}
    for name, count in shares.items():
        want[quality_classifier.slot(b"\x00shape " + name)] = 4.0 * count / len(words)
    assert dict(zip(slots.tolist(), values.tolist())) == pytest.approx(want)


def test_classifier_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (4, 0, 0), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.classify(spark, odd, labels).toPandas()
    assert len(got) == 7 and set(got.columns) == {"doc_id", "expected_grade", "p_tail", "selected"}
    assert not got[got.doc_id.isin([2, 3, 5])].selected.any()
    assert got[got.doc_id == 1].expected_grade.nunique() == 1
    none = quality_classifier.classify(spark, odd, labels.limit(0)).toPandas()
    assert none.expected_grade.isna().all() and none[none.doc_id == 1].selected.all() and not none[none.doc_id == 2].selected.any()
    assert quality_classifier.classify(spark, odd.limit(0), labels).count() == 0


def test_classifier_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet"), spark.read.parquet(SF.replace("0.001", "0.01") + "/labels.parquet")
    fold = "pmod(xxhash64(doc_id), 4) = 0"
    model = quality_classifier.train(docs, labels.where("not " + fold))
    got = quality_classifier.rate(docs, model, "text", ["doc_id"]).join(labels.where(fold), "doc_id").toPandas()
    assert got[got.quality == 0].selected.mean() < 0.1
    assert got[(got.quality == 1) & (got.toxic == 0)].selected.mean() > 0.9


# quality rules


def plain_counts(text):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    words, windows, lines, seen = word.findall(text), Counter(), 0, set()
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])] += 1
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    for line in text.split("\n"):
        if word.search(line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), lines, len(inside)


def test_rules_counts_against_plain_python(spark):
    docs = spark.read.parquet(SF + "/documents.parquet")
    got = quality_rules.judge(spark, docs).toPandas().set_index("doc_id")
    for row in docs.collect():
        mine = got.loc[row.doc_id]
        want = plain_counts(row.text or "")
        assert tuple(mine[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]]) == want
        assert mine.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (mine.kept and mine.base_failed)
    junk = {r.doc_id for r in docs.collect() if sum(map((r.text or "").count, "#$%&")) > 0.05 * len(r.text or "x")}
    assert junk and not got.loc[list(junk)].kept.any()
    assert got[~got.base_failed].kept.mean() > 0.85


def test_rules_odd_rows(spark, odd):
    got = quality_rules.judge(spark, odd).toPandas()
    assert len(got) == 7 and got[got.doc_id == 2].n_words.item() == 0 and got[got.doc_id == 5].base_failed.item()
    assert got[got.doc_id == 1].kept.nunique() == 1
    assert quality_rules.judge(spark, odd.limit(0)).count() == 0
    unknown = quality_rules.judge(spark, odd.where("text is null or lang is null")).toPandas()
    assert unknown.word_distance.isna().all() and not unknown.kept.any()


def test_distance():
    p, q = np.array([0.5, 0.5, 0]), np.array([0, 0.5, 0.5])
    assert quality_rules.distance(p, p) == 0 and quality_rules.distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1
    assert quality_rules.distance(p, q) == pytest.approx(math.sqrt(0.5))


# language identification


def plain_bits(counts, size, symbols):
    """PPM method C with exclusion, one symbol at a time; counts[context][symbol]."""
    total = 0.0
    for i, s in enumerate(symbols):
        excluded, mass, chance = set(), 1.0, 0.0
        for k in range(min(language_id.ORDER, i), -1, -1):
            here = {a: n for a, n in counts.get(tuple(symbols[i - k : i]), {}).items() if a not in excluded}
            if not here:
                continue
            n, d = sum(here.values()), len(here)
            if s in here:
                chance, mass = mass * here[s] / (n + d), 0
                break
            mass *= d / (n + d)
            excluded |= set(here)
        if mass:
            chance = mass / (size - len(excluded))
        total -= math.log2(chance)
    return total


def test_code_lengths_against_plain_python(spark):
    texts = {"aa": ["abracadabra abra cadabra " * 3, "bar barb arab"], "bb": ["mississippi miss sip pim " * 3, "abba"]}
    rows = [(i, t, lang) for lang, ts in texts.items() for i, t in enumerate(ts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    both = Counter()
    counts = {lang: {} for lang in texts}
    for lang, ts in texts.items():
        for t in ts:
            data = t.encode()
            for k in range(language_id.ORDER + 1):
                for i in range(k, len(data)):
                    context = tuple(data[i - k : i])
                    counts[lang].setdefault(context, Counter())[data[i]] += 1
                    both[context] += 1
    for lang in counts:
        counts[lang] = {c: n for c, n in counts[lang].items() if not c or both[c] >= language_id.MIN_COUNT}
    for text in ("abra miss", "zzz abx", "b", "arab sip pim abba mississippi"):
        got = language_id.code_lengths(model, [b"", text.encode(), b"x"])[1]
        want = [plain_bits(counts[lang], model.size, list(text.encode())) for lang in model.languages]
        assert got == pytest.approx(want, rel=1e-5)


def test_long_texts_are_read_in_blocks(spark, monkeypatch):
    docs = spark.read.parquet(SF + "/documents.parquet")
    model = language_id.train(docs)
    texts = [r.text.encode() for r in docs.limit(20).collect()]
    whole = language_id.code_lengths(model, texts)
    monkeypatch.setattr(language_id, "_BLOCK", 777)
    assert language_id.code_lengths(model, texts) == pytest.approx(whole, rel=1e-6)


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(SF + "/documents.parquet")
    got = language_id.predict(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()


def test_language_odd_rows(spark, odd):
    got = language_id.predict(spark, odd).toPandas()
    assert len(got) == 7 and set(got[got.doc_id.isin([2, 3, 4, 5])].lang_pred) == {"und"}
    assert got[got.doc_id.isna()].held_out.tolist() == [False]
    assert language_id.predict(spark, odd.limit(0)).count() == 0
    nothing = language_id.predict(spark, odd.where("lang is null")).toPandas()
    assert set(nothing.lang_pred) == {"und"} and (nothing.score == 0).all()


def test_fit_needs_little_beside_its_values(monkeypatch):
    """A fit's arrays take a few numbers for each feature value of the sample, without those that sorting them takes."""
    import tracemalloc

    monkeypatch.setattr(quality_classifier, "STEPS", 1)
    rng = np.random.default_rng(1)
    examples = [(rng.integers(0, 1 << quality_classifier.HASH_BITS, 400), np.ones(400)) for _ in range(8000)]
    tracemalloc.start()
    quality_classifier.fit(examples, np.arange(8000) % 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 * 8000 * 400
