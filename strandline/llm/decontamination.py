"""Benchmark decontamination by an FM-index for each shard of the training documents.

A partition's documents are gathered into shards of about shard_words words. Each shard is indexed over words; the benchmark's windows are searched backward
through the ranks of a wavelet matrix, all at once; the suffixes found are located by sampled suffix positions; and the places, merged, are the spans to
remove. No document moves: shards are made and searched where the rows are read, so there is no shuffle, and
a lost executor's partitions are simply read again.

The benchmark is the stated query set. Its distinct windows are counted first and taken in blocks of at most block_windows;
a block is what is broadcast. With one block, shards are indexed and searched in one go; with more, they are indexed once, as
a table of (documents, index) rows, of which each block reads the indexes only and gives its hits; these are joined with the documents once.

Words are runs of digits, a-z after lower-casing A-Z, and characters above 0x7F. A benchmark item's windows are its runs of
`window` words; a shorter item is one window.

Defined results: null or empty text has no words, no hits and stays as it is; repeated rows each get a row; null or empty benchmark texts have
no windows; an empty table or benchmark gives no hits; a document of over shard_words words is a shard of its own. Items with a null item_id are searched
like others: together they count as one item of n_items, which has no part in items_sha256. Other columns stay as they are, and where one is called _n_words,
_spans or _items the new one gets underscores after that name: they are always the last three.
"""

from __future__ import annotations

import pickle
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .common import table, unused
from .fmindex import FMIndex

TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")


def tokens(text: bytes | None) -> list[bytes]:
    return TOKEN.findall(text.lower()) if text else []


def windows_of(benchmark: DataFrame, window: int) -> DataFrame:
    """phrase (words, joined by spaces), items (distinct item_ids that have it) and unnamed (whether an item without item_id has it)."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for item, text in zip(f["item_id"], f["text"], strict=True):
                w = [x.decode() for x in tokens(text.encode() if isinstance(text, str) else None)]
                rows += [(item, " ".join(w[i : i + window])) for i in range(max(1, len(w) - window + 1)) if w]
            yield pd.DataFrame(rows, columns=["item_id", "phrase"])

    cut_up = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).mapInPandas(cut, "item_id string, phrase string")
    return cut_up.groupBy("phrase").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.bool_or(F.col("item_id").isNull()).alias("unnamed"))


def in_order(items: set[str | None]) -> list[str | None]:
    """Sorted, None last."""
    return sorted(items, key=lambda i: (i is None, i or ""))


class Phrases:
    """A block of windows: its distinct words, and by length the windows as rows of places among these."""

    def __init__(self, rows: list):
        place: dict[bytes, int] = {}
        by_length = defaultdict(list)
        for r in rows:
            w = r["phrase"].encode().split(b" ")
            by_length[len(w)].append(([place.setdefault(x, len(place)) for x in w], [*r["items"], None] if r["unnamed"] else r["items"]))
        self.words = list(place)
        self.groups = [(m, np.array([p for p, _ in g], np.int64), [i for _, i in g]) for m, g in sorted(by_length.items())]


class Shard:
    """Documents' words, numbered as they come."""

    def __init__(self):
        self.number: defaultdict[bytes, int] = defaultdict(count(1).__next__)
        self.documents: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes | None) -> None:
        w = tokens(text)
        self.documents.append(np.fromiter(map(self.number.__getitem__, w), np.int32, len(w)))
        self.size += len(w) + 1

    def index(self) -> FMIndex:
        return FMIndex(self.documents, len(self.number))


def hits(index: FMIndex, number: dict, phrases: Phrases) -> tuple[list[list[tuple[int, int]]], list[set[str | None]]]:
    """For each document of the index: merged spans of words, and the items found in it."""
    n_docs = len(index.starts) - 1
    change = np.zeros(index.n + 1, np.int64)
    items: list[set[str | None]] = [set() for _ in range(n_docs)]
    own = np.array([number.get(w, 0) for w in phrases.words], np.int64)
    for length, rows, names in phrases.groups:
        which, low, high = index.search(own[rows])
        if not len(which):
            continue
        times = high - low
        flat = np.repeat(low - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
        places, which = index.locate(flat), np.repeat(which, times)
        np.add.at(change, places, 1)
        np.add.at(change, places + length, -1)
        document = np.searchsorted(index.starts, places, side="right") - 1
        for d, p in np.unique(np.stack([document, which], axis=1), axis=0):
            items[d].update(names[p])
    on = np.concatenate(([0], (np.cumsum(change) > 0).view(np.int8), [0]))
    edges = np.flatnonzero(np.diff(on)).reshape(-1, 2)  # a separator is in no span, so no span leaves its document
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n_docs)]
    for d, (a, b) in zip(np.searchsorted(index.starts, edges[:, 0], side="right") - 1, edges, strict=True):
        s = index.starts[d]
        spans[d].append((int(a - s), int(b - s)))
    return spans, items


def removed(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without the words of spans and what lies between them."""
    at = [m.span() for m in TOKEN.finditer(text.lower())]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])


def shards(batches: Iterator[pa.RecordBatch], shard_words: int) -> Iterator[tuple[pa.Table, Shard]]:
    """The rows of a partition in shards. Batches are cut where a shard is full."""
    parts, shard = [], Shard()
    for batch in batches:
        text, begin = batch.column("text").cast(pa.large_binary()), 0
        for k in range(len(text)):
            shard.add(text[k].as_py())
            if shard.size >= shard_words:
                yield pa.Table.from_batches([*parts, batch.slice(begin, k + 1 - begin)]), shard
                parts, shard, begin = [], Shard(), k + 1
        if begin < len(text):
            parts.append(batch.slice(begin))
    if parts:
        yield pa.Table.from_batches(parts), shard


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def blocks(phrases: DataFrame, block_windows: int) -> list[DataFrame]:
    """phrases in blocks of about block_windows by hash: the whole if that is few enough."""
    n = max(1, -(-phrases.count() // block_windows))
    return [phrases] if n == 1 else [phrases.where(F.pmod(F.xxhash64("phrase"), F.lit(n)) == k) for k in range(n)]


def judge(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """docs with _n_words, _spans (merged, of words) and _items (item_ids found, sorted; a null last for items without one), the last three columns."""
    found = [T.StructField(unused(docs.columns, c), t) for c, t in (("_n_words", T.LongType()), ("_spans", SPANS), ("_items", T.ArrayType(T.StringType())))]

    def answered(rows: pa.Table, n_words, spans, items) -> Iterator[pa.RecordBatch]:
        more = [pa.array(n_words, pa.int64()), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], SPANS_ARROW), pa.array([in_order(i) for i in items], pa.list_(pa.string()))]
        for field, column in zip(found, more, strict=True):
            rows = rows.append_column(field.name, column)
        yield from rows.to_batches()

    return searched(docs, benchmark, T.StructType([*docs.schema.fields, *found]), answered, **parameters)


def searched(docs: DataFrame, benchmark: DataFrame, schema: T.StructType, answered, window: int = 10, shard_words: int = 1_000_000, block_windows: int = 500_000) -> DataFrame:
    """What answered gives, as schema has it, of a shard's rows with their numbers of words, spans and items: made in the task that has the shard."""
    sc = docs.sparkSession.sparkContext
    phrases = written(windows_of(benchmark, window), "windows")
    parts = blocks(phrases, block_windows)
    if len(parts) == 1:
        sent = sc.broadcast(Phrases(phrases.collect()))

        def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, shard in shards(batches, shard_words):
                yield from answered(rows, [len(d) for d in shard.documents], *hits(shard.index(), shard.number, sent.value))

        return docs.mapInArrow(at_once, schema)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, shard in shards(batches, shard_words):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as writer:
                writer.write_table(rows)
            packed = pickle.dumps((shard.index(), dict(shard.number)))
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([[len(d) for d in shard.documents]], pa.list_(pa.int64())), pa.array([packed], pa.binary())], names=["rows", "sizes", "index"])

    # Written once, with documents and index in columns of their own: each block reads the indexes only, and gives a row for each shard in which it has hits.
    index = written(docs.mapInArrow(indexed, "rows binary, sizes array<long>, index binary").withColumn("shard", F.monotonically_increasing_id()), "fmindex")
    hit = T.StructType([T.StructField("shard", T.LongType()), T.StructField("document", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])
    found_in = []
    for part in parts:
        sent = sc.broadcast(Phrases(part.collect()))

        def placed(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard, packed in zip(batch.column("shard").to_pylist(), batch.column("index"), strict=True):
                    rows = [(d, [{"start": a, "end": b} for a, b in s], in_order(i)) for d, (s, i) in enumerate(zip(*hits(*pickle.loads(packed.as_py()), sent.value), strict=True)) if s or i]
                    columns = [pa.array([shard] * len(rows), pa.int64()), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), SPANS_ARROW, pa.list_(pa.string()))))]
                    yield pa.RecordBatch.from_arrays(columns, names=hit.names)

        found_in.append(written(index.select("shard", "index").mapInArrow(placed, hit), "hits"))
    every = found_in[0]
    for more in found_in[1:]:
        every = every.unionByName(more)
    # Of a document at most one row a block; of a shard at most as many documents as shard_words allows.
    by_shard = every.groupBy("shard").agg(F.collect_list(F.struct("document", "spans", "items")).alias("hits"))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                spans, items = [[] for _ in row["sizes"]], [set() for _ in row["sizes"]]
                for h in row["hits"] or ():
                    spans[h["document"]] += [(x["start"], x["end"]) for x in h["spans"]]
                    items[h["document"]].update(h["items"])
                yield from answered(pa.ipc.open_stream(row["rows"]).read_all(), row["sizes"], [merged(s) for s in spans], items)

    return index.select("shard", "rows", "sizes").join(by_shard, "shard", "left").drop("shard").mapInArrow(opened, schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """spans in order, those that touch joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """docs with the spans found cut from their texts; a document of which no word is left goes. Texts are cut in the worker that found the spans, those with spans only: no second worker has them too."""

    def cut(rows: pa.Table, n_words, spans, items) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in rows.to_batches():
            n, own = n_words[at : at + len(batch)], spans[at : at + len(batch)]
            at += len(batch)
            hit = [k for k, s in enumerate(own) if s]
            if hit:
                mask = np.zeros(len(batch), bool)
                mask[hit] = True
                column, texts = batch.schema.get_field_index("text"), batch.column("text")
                texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([removed(texts[k].as_py().encode(), own[k]).decode() for k in hit], texts.type))
                left = [not s or m > sum(b - a for a, b in s) for m, s in zip(n, own, strict=True)]
                batch = batch.set_column(column, batch.schema.field(column), texts).filter(pa.array(left))
            yield batch

    return searched(docs, benchmark, docs.schema, cut, **parameters)


def op10_decontamination(spark, sf_dir) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return judged.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item, w, least(len(w), 10) AS m, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0),
phrases AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM bi),
lengths AS (SELECT DISTINCT m FROM phrases),
di AS (SELECT row, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, lengths WHERE len(w) >= m),
hits AS (SELECT d.row, d.m, d.i, p.item FROM di d JOIN phrases p ON p.m = d.m AND p.phrase = array_to_string(d.w[d.i:d.i + d.m - 1], ' ')),
per_word AS (SELECT row, count(DISTINCT at_word) AS n_hit FROM (SELECT row, unnest(range(i, i + m)) AS at_word FROM hits) GROUP BY row),
per_item AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN per_word USING (row) LEFT JOIN per_item USING (row)
"""
