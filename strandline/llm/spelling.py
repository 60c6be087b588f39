"""Spelling variants: the vocabulary joined with itself on its trie, by sets of active nodes.

The vocabulary is sorted into ranges, each a slice of its trie: the subtrees of some prefixes. A task reads a slice's words in order, with the path of the present word as a stack. Each node u on
it has the set of its active nodes, those of the slice at a distance of one: of a child u + c these are v + c for the active v of u, its siblings, u itself, and its own children. A word's
active nodes that end a word are near it, so every pair within a slice is found from both sides.

Two near words part at the node x where their paths do, and what differs is just the next code point of one of them or of both. Words of two slices part at a node that both slices have on their
edges, a prefix of their first or their last word. From these open nodes active nodes are handed on as rows: for each open node on its path a word gives what it still has to match, the rest of
it after the next code point and the rest of it whole, by hashes that run along the word. Equal rests below one node from different slices meet in a join; the strings decide. A join's key has a
word for each next code point at most, whatever the vocabulary, and a word gives as many rows as it shares code points with the ends of its slice.

Slices hold about `slice_chars` code points of words, which a task keeps as a trie. Counting a word that is a large share of all takes partial sums before the shuffle.

Defined results: null or empty texts have no words; a null id is written as nothing; words of any length are taken whole; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import ascii_lower, table

#: Fixed value: the letters of a run.
LETTERS = r"A-Za-zÀ-ÿ"
#: A hash that runs along a word is a sum of its code points, mixed, times powers of this, modulo 2 ** 64.
BASE = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = 7, least: int = 2, drop_every: int = 31) -> DataFrame:
    """word, n: the runs of letters of all texts, of `shortest` code points and `least` occurrences or more.

    Of a run whose crc32 with its document's id `drop_every` divides, the code point that the crc32 points at is left out, as in a slip of the pen.
    """
    lowered = ascii_lower(F.coalesce(F.col(text).cast("string"), F.lit("")))
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("of"), F.explode(F.regexp_extract_all(lowered, F.lit(f"[{LETTERS}]{{{shortest},}}"), 0)).alias("run"))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.withColumn("h", F.crc32(F.concat_ws(":", "of", "run"))).select(F.when(F.col("h") % drop_every == 0, slipped).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


class Node:
    __slots__ = ("below", "word")

    def __init__(self):
        self.below: dict[str, Node] = {}
        self.word: int = -1


def shared(a: str, b: str) -> int:
    """How many code points two words begin with alike."""
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def near_within(words: list[str]) -> Iterator[tuple[int, int]]:
    """(i, j) of sorted distinct words at a distance of one, both ways round: active nodes carried down their trie."""
    root = Node()
    for k, w in enumerate(words):
        node = root
        for c in w:
            below = node.below
            node = below.get(c)
            if node is None:
                node = below[c] = Node()
        node.word = k
    # The path of the present word: each node with its active nodes.
    path: list[tuple[Node, set[Node]]] = [(root, set(root.below.values()))]
    before = ""
    for k, w in enumerate(words):
        del path[shared(before, w) + 1 :]
        for c in w[len(path) - 1 :]:
            above, active = path[-1]
            node = above.below[c]
            reached = {v.below[c] for v in active if c in v.below}
            reached.update(v for b, v in above.below.items() if b != c)
            reached.update(node.below.values())
            reached.add(above)
            reached.discard(node)
            path.append((node, reached))
        for v in path[-1][1]:
            if v.word >= 0:
                yield k, v.word
        before = w


def powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, BASE, np.uint64))))


INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def open_rests(word: str, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """For the nodes at depths 0 to upto on a word's path: keys of the node and the rest after the next code point (none for the word's own end), and of the node and the whole rest."""
    codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    codes = (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    codes ^= codes >> np.uint64(29)
    n = len(word)
    scale = powers(n)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * scale[:n], dtype=np.uint64)))
    back = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, INVERSE, np.uint64))))
    rest = (sums[n] - sums) * back  # of the code points from each place on
    nodes = sums * np.uint64(0x94D049BB133111EB) + np.arange(n + 1, dtype=np.uint64)
    depth = np.arange(upto + 1)
    inner = depth[depth < n]
    mixed = lambda x, r: ((x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + r).view(np.int64)
    return mixed(nodes[inner], rest[inner + 1]), mixed(nodes[depth], rest[depth])


def slices(words: DataFrame, parts: int) -> DataFrame:
    """Of words (w, word): pairs a, b within a slice (key null), and what its open nodes hand on: word a of slice part, key, and whether a code point is skipped."""
    schema = "part int, key long, skips boolean, a long, b long"

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids, own = [], []
        for batch in batches:
            ids.append(batch.column("w").to_numpy())
            own += batch.column("word").to_pylist()
        if not own:
            return
        w = np.concatenate(ids)

        def out(keys: np.ndarray | None, skips: np.ndarray | None, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
            none = lambda kind: pa.nulls(len(a), kind)
            columns = [pa.array(np.full(len(a), part, np.int32)), none(pa.int64()) if keys is None else pa.array(keys), none(pa.bool_()) if skips is None else pa.array(skips), pa.array(a), none(pa.int64()) if b is None else pa.array(b)]
            return pa.RecordBatch.from_arrays(columns, names=["part", "key", "skips", "a", "b"])

        pairs = near_within(own)
        while some := list(itertools.islice(pairs, 50_000)):
            i, j = np.array(some).T
            yield out(None, None, w[i], w[j])
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting = 0
        for k, word in enumerate(own):
            skips, rests = open_rests(word, max(shared(word, own[0]), shared(word, own[-1])))
            keys = np.concatenate((skips, rests))
            held.append((keys, np.arange(len(keys)) < len(skips), np.full(len(keys), w[k])))
            waiting += len(keys)
            if waiting > 50_000 or k == len(own) - 1:
                yield out(*(np.concatenate(x) for x in zip(*held, strict=True)), None)
                held, waiting = [], 0

    return words.select("w", "word").repartitionByRange(parts, "word").sortWithinPartitions("word").mapInArrow(of, schema)


def near_pairs(words: DataFrame, parts: int) -> DataFrame:
    """a, b: all pairs of words (w, word) at a distance of one, both ways round."""
    found = written(slices(words, parts), "slices")
    opened = found.where("key IS NOT NULL").select("key", "part", "skips", "a")
    other = opened.select("key", F.col("part").alias("other_part"), F.col("skips").alias("other_skips"), F.col("a").alias("b"))
    met = opened.where("skips").join(other, "key").where("part <> other_part AND (NOT other_skips OR a < b)").select("a", "b").distinct()
    text = lambda c: words.select(F.col("w").alias(c), F.col("word").alias(f"word_{c}"))
    across = met.join(text("a"), "a").join(text("b"), "b").where(F.levenshtein("word_a", "word_b", 1) == 1).select("a", "b")
    across = across.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.a", "p.b")
    return found.where("key IS NULL").select("a", "b").unionByName(across)


def rooted(links: DataFrame, longest: int) -> DataFrame:
    """word, root of links (word, form) whose chains have `longest` links at most: each round doubles how far a word sees."""
    seen = written(links.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max(0, math.ceil(math.log2(max(1, longest))))):
        further = seen.select(F.col("word").alias("root"), F.col("root").alias("next"))
        seen = written(seen.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return seen


def variants(words: DataFrame, times: int = 10, slice_chars: int = 200_000) -> DataFrame:
    """word, n, n_near, form, form_n, root of a vocabulary (word, n): how many words are near, the near word of largest n (the first of equals in code-point order) if its n is at least
    `times` the word's, and the word at the end of the forms."""
    words = written(words.select("word", "n", F.monotonically_increasing_id().alias("w")), "vocabulary")
    size = words.agg(F.sum(F.length("word")).alias("chars"), F.max("n").alias("most")).first()
    parts = max(1, math.ceil((size["chars"] or 0) / slice_chars))
    others = words.select(F.col("w").alias("b"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    told = near_pairs(words, parts).join(others, "b").groupBy(F.col("a").alias("w")).agg(F.count("*").alias("n_near"), best)
    out = words.join(told, "w", "left").withColumn("fits", -F.col("best.less") >= times * F.col("n"))
    out = out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("fits"), F.col("best.other")).alias("form"), F.when(F.col("fits"), -F.col("best.less")).alias("form_n"))
    out = written(out, "forms")
    roots = rooted(out.where("form IS NOT NULL"), int(math.log(max(size["most"] or 1, 1), times)) + 1)
    return out.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling_variants(spark, sf_dir) -> DataFrame:
    return variants(vocabulary(table(spark, sf_dir, "documents"))).select("word", "form", "root", "n", "n_near", "form_n")


#: crc32 by a table that DuckDB makes by the rule.
CRC_SQL = """
bits AS (SELECT x AS k, x AS v, 0 AS round FROM (SELECT unnest(range(256)) AS x) UNION ALL SELECT k, xor(v >> 1, (v & 1) * 3988292384), round + 1 FROM bits WHERE round < 8),
tab AS (SELECT list(v ORDER BY k) AS tab FROM bits WHERE round = 8),
"""


def crc_sql(text: str) -> str:
    """crc32 of the UTF-8 of text, of code points under 2048; the query has the row of tab in scope."""
    each = "CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END"
    return f"xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split({text}, ''), lambda c: {each}))::BIGINT[], lambda acc, b: xor(acc >> 8, tab[CAST(1 + (xor(acc, b) & 255) AS BIGINT)])), 4294967295)"


SQL = rf"""
WITH RECURSIVE {CRC_SQL}
runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  WHERE len(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, times, {crc_sql("doc_id || ':' || run")} AS h FROM runs, tab),
slipped AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word, times FROM hashed),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM slipped WHERE len(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
cuts AS (SELECT word, substr(word, 1, k) AS head, substr(word, k + 2) AS rest, substr(word, k + 1, 1) AS c FROM (SELECT word, unnest(range(len(word))) AS k FROM words)),
near AS (
  SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.head = b.head AND a.rest = b.rest AND a.c <> b.c
  UNION SELECT c.word, w.word FROM cuts c JOIN words w ON w.word = c.head || c.rest
  UNION SELECT w.word, c.word FROM cuts c JOIN words w ON w.word = c.head || c.rest),
best AS (
  SELECT near.word, count(*) OVER (PARTITION BY near.word) AS n_near, other, o.n AS other_n FROM near JOIN words o ON o.word = other
  QUALIFY row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, encode(other)) = 1),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS got, 0 AS steps FROM words UNION ALL SELECT w.word, f.form, steps + 1 FROM walk w JOIN forms f ON f.word = w.got WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN (SELECT word, arg_max(got, steps) AS root FROM walk GROUP BY word) USING (word)
"""
