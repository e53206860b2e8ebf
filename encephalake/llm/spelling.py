"""Spelling variants: words one edit apart, found by walking a frontier of states down a trie of all words.

The trie is a table of edges (depth, parent, letter, child); a node is the prefix it stands for. A state
(word, position, node, edits) says that the word's first letters lead to the node with so many edits.
Words without an edit are at their own prefixes. From there a replacement follows an edge of another
letter and a deletion stays at the node; the frontier of one-edit states then follows, level by level, the
edges of the word's own letters, by joins with the edge table of that depth. States that end at the end of
their word in a node that is a word are neighbours. Being near is mutual: replacements by later letters
and deletions find every pair once from one side, insertions are the deletions seen from the other.

Every level is written to the shared folder. A level's edges are broadcast only if they were counted to be
few; there are at most as many as letters to the power of the depth, so hot nodes near the root never meet
in one task, and Spark splits skewed joins below. A word has few neighbours (its length times the letters),
so nothing else grows. Forms point to words that occur five times as often, so chains of them are short;
roots follow by pointer jumping.

A text's runs of A-Z, a-z and U+00C0 to U+00FF are its words; only A-Z is lower-cased. With ``noise``, a run
of a document whose checksum that number divides loses a letter. Null and empty texts have no words, the
longest text is read whole, repeated rows count as often as they occur, a null id is the text ``None`` in the checksum.
An empty table gives an empty result. Only id and text are read, so further columns may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, byte_list, slices, written

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
NOISE = 199
_HELD = 200_000


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", noise: int | None = NOISE, length: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words long and frequent enough over all texts."""
    run = re.compile(RUN)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in slices(batches, 1):
            for doc, body in zip(batch.column(0).to_pylist(), byte_list(batch.column(1))):
                found = Counter(run.findall(body.lower().decode()))
                if noise is None:
                    for word, n in found.items():
                        if len(word) >= length:
                            held[word] += n
                    continue
                start = zlib.crc32(f"{doc}:".encode())
                for word, n in found.items():
                    # a shorter word stays too short
                    if (size := len(word)) >= length:
                        check = zlib.crc32(word.encode(), start)
                        if not check % noise:
                            cut = check % size
                            word = word[:cut] + word[cut + 1 :]
                            if size == length:
                                continue
                        held[word] += n
            if len(held) >= _HELD:
                yield out()
                held = Counter()
        yield out()

    counts = docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(tally, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


def edges_of(words: DataFrame) -> DataFrame:
    """The trie: (depth, parent, letter, child) for every distinct prefix of ``words(word)``."""
    depths = words.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("depth"))
    child = F.substring(F.col("word"), F.lit(1), F.col("depth") + 1)
    nodes = depths.select("depth", child.alias("child")).distinct()
    return nodes.select("depth", F.substring(F.col("child"), F.lit(1), F.col("depth")).alias("parent"), F.substring(F.col("child"), F.col("depth") + 1, F.lit(1)).alias("letter"), "child")


def _letter(position) -> F.Column:
    return F.substring(F.col("word"), position + 1, F.lit(1))


def neighbours(words: DataFrame) -> DataFrame:
    """Distinct pairs (word, near), both ways, of the words one edit apart in ``words(word)``, which are distinct."""
    words = written(words.select("word"), "words")
    edges = written(edges_of(words).repartition("depth", "parent"), "edges")
    sizes = {r.depth: r.n for r in edges.groupBy("depth").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many rows as letters in the longest word

    def at(depth: int) -> DataFrame:
        level = edges.where(F.col("depth") == depth).select("parent", "letter", "child")
        return F.broadcast(level) if sizes[depth] <= BROADCAST_ROWS else level

    ends = None
    frontier = None  # one-edit states (word, position, node), all at one position
    longest = max(sizes, default=-1) + 1
    for position in range(longest + 1):
        if frontier is not None:
            over = F.length("word") == position
            done = frontier.where(over).select("word", F.col("node").alias("near"))
            ends = done if ends is None else ends.unionByName(done)
            frontier = frontier.where(~over)
        if position == longest:
            break
        states = words.where(F.length("word") > position).select("word", F.substring(F.col("word"), F.lit(1), F.lit(position)).alias("parent"), _letter(F.lit(position)).alias("own"))
        replaced = states.join(at(position), "parent").where(F.col("letter") > F.col("own")).select("word", F.col("child").alias("node"))
        # of equal letters in a row any deletion gives the same word: the last one is deleted
        deleted = states.where(F.col("own") != _letter(F.lit(position + 1))).select("word", F.col("parent").alias("node"))
        moved = replaced.unionByName(deleted)
        if frontier is not None:
            # the frontier has nodes of two depths: replacements are as deep as the position, deletions one less
            own = frontier.withColumn("letter", _letter(F.lit(position)))
            for depth in (position, position - 1):
                here = own.where(F.length("node") == depth).select("word", F.col("node").alias("parent"), "letter")
                moved = moved.unionByName(here.join(at(depth), ["parent", "letter"]).select("word", F.col("child").alias("node")))
        frontier = written(moved, "frontier")
    if ends is None:
        return words.select("word", F.col("word").alias("near")).limit(0)
    found = ends.join(words.select(F.col("word").alias("near")), "near", "left_semi").select("word", "near")
    return found.unionByName(found.select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct()


def variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of ``counts(word, n)``.

    The form is the near word that occurs most (ties: the first in code-point order), if at least ``ratio``
    times as often. The root is where the forms lead in the end, the word itself if it has none.
    """
    counts = written(counts.select("word", "n"), "counts")
    pairs = written(neighbours(counts), "pairs").join(counts.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    rows = counts.join(best, "word", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    rows = written(rows, "forms")
    jumps = written(rows.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        # each round doubles how far a root is ahead
        ahead = jumps.select(F.col("word").alias("_w"), F.col("root").alias("_next"))
        joined = jumps.join(ahead, F.col("root") == F.col("_w"), "left")
        if joined.where("_next is not null").isEmpty():
            break
        jumps = written(joined.select("word", F.coalesce("_next", "root").alias("root")), "roots")
    return rows.join(jumps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The variants of the words of ``docs``."""
    return variants(word_counts(docs, key, text))


_TABLE = """table256 as (select list(c order by i) t from (
  select i, list_reduce(list_concat([i], range(8)), lambda x, y: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end) c
  from (select unnest(range(256)) i)))"""
ORACLE = f"""
with recursive {_TABLE},
runs as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) run from documents),
counted as (select doc_id, run, count(*) n from runs where length(run) >= {LEAST_LENGTH} group by all),
bytes as (select *, hex(encode(doc_id || ':' || run)) h from counted),
checks as (select run, n, xor(4294967295, list_reduce(list_concat([4294967295::bigint],
    list_transform(range(0, length(h) // 2), lambda i: (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1)),
    lambda x, y: xor(x // 256, t[xor(x % 256, y) + 1]))) h from bytes, table256),
words as (select case when h % {NOISE} = 0 then run[:(h % length(run))::bigint] || run[(h % length(run))::bigint + 2:] else run end word, n from checks),
v as (select word, sum(n)::bigint n from words where length(word) >= {LEAST_LENGTH} group by 1 having sum(n) >= {LEAST_COUNT}),
cuts as (select word, i, word[:i] || word[i + 2:] short from (select word, unnest(range(length(word))) i from v)),
near as (select a.word, b.word near from cuts a join cuts b on a.i = b.i and a.short = b.short and a.word <> b.word
  union select a.word, a.short from cuts a join v on v.word = a.short
  union select a.short, a.word from cuts a join v on v.word = a.short),
best as (select near.word, count(*) n_near, arg_min(near, (-v.n, near)) form, max(v.n) form_n from near join v on v.word = near.near group by 1),
f as (select v.word, n, coalesce(n_near, 0) n_near, case when form_n >= {RATIO} * n then form end form, case when form_n >= {RATIO} * n then form_n end form_n
  from v left join best using (word)),
walk(word, here, step) as (select word, word, 0 from f union all select walk.word, f.form, step + 1 from walk join f on f.word = walk.here where f.form is not null)
select word, form, root, n, n_near, form_n from f join (select word, arg_max(here, step) root from walk group by 1) using (word)
"""
