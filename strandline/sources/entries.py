"""JSON objects of many entries, read in splits that are cut anywhere.

A file is one object or several, {"name": {...}, ...}, however its lines are broken. Where a split begins, nobody knows how deep in braces it is: so each split's rise or fall in depth is summed
first, and a sum over the splits before gives its depth at the start (a row a split). Then each split is read once, in order: what stands from the end of one entry to the end of the next is an
entry. The piece before a split's first end and the one after its last end are put together with those of its neighbours, two rows a split at most.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A whole string, or a brace outside of strings.
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]')
STRING = r'"(?:[^"\\]|\\.)*"'


def splits(spark: SparkSession, *paths: str) -> DataFrame:
    """file, block, value: lines in order."""
    return spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def depths(lines: DataFrame) -> DataFrame:
    """file, block, depth: in how many braces a split begins."""
    bare = F.regexp_replace("value", STRING, "")
    rise = F.length(F.regexp_replace(bare, r"[^{]", "")) - F.length(F.regexp_replace(bare, r"[^}]", ""))
    sums = lines.groupBy("file", "block").agg(F.sum(rise).alias("rise"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("file", "block", F.coalesce(F.sum("rise").over(before), F.lit(0)).cast("int").alias("depth"))


class Cutter:
    """Cuts one split's lines into entries."""

    def __init__(self, depth: int):
        self.depth, self.held, self.closed = depth, [], False

    def line(self, text: str) -> Iterator[tuple[str, str]]:
        """(kind, text) that this line completes: entry, head (what stands before the split's first end) or stray (outside of any object)."""
        begin = 0
        for m in TOKEN.finditer(text):
            if m[0] == "{":
                self.depth += 1
                if self.depth == 1:
                    yield from self.stray(text[begin : m.start()])
                    begin = m.end()
            elif m[0] == "}":
                self.depth -= 1
                if self.depth == 1:
                    yield self.end("".join([*self.held, text[begin : m.end()]]))
                    begin = m.end()
                elif self.depth <= 0:
                    # The object's end: what stands before it belongs to no entry, a comma at most.
                    yield self.end("".join([*self.held, text[begin : m.start()]]), last=True)
                    begin, self.depth = m.end(), 0
        if self.depth:
            self.held.append(text[begin:] + "\n")
        else:
            yield from self.stray(text[begin:])

    def end(self, text: str, last: bool = False) -> tuple[str, str]:
        kind = "entry" if self.closed else "head"
        self.held, self.closed = [], True
        return (kind if kind == "head" or not last else "rest"), text

    def stray(self, text: str) -> Iterator[tuple[str, str]]:
        self.held, self.closed = [], True
        if text.strip():
            yield "stray", text


def cut(lines: DataFrame) -> DataFrame:
    """file, block, nth, kind, text of each split: entry, stray, rest (before an object's end), and the pieces that a split shares with its neighbours: head, tail, and through for a split
    without an end."""
    starts = F.broadcast(depths(lines))  # a row a split

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cutter, nth, out = None, Cutter(0), 0, []

        def told(kind: str, text: str) -> None:
            nonlocal nth
            out.append((*now, nth, kind, text))
            nth += 1

        def over() -> None:
            if now is not None and (cutter.held or not cutter.closed):
                told("tail" if cutter.closed else "through", "".join(cutter.held))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["file", "block", "nth", "kind", "text"])
            out.clear()
            return batch

        for batch in batches:
            for file, block, value, depth in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value", "depth")), strict=True):
                if (file, block) != now:
                    over()
                    now, cutter, nth = (file, block), Cutter(depth), 0
                    cutter.closed = depth == 0
                for kind, text in cutter.line(value):
                    told(kind, text)
            if out:
                yield flush()
        over()
        if out:
            yield flush()

    return lines.join(starts, ["file", "block"]).mapInArrow(of, "file string, block long, nth long, kind string, text string")


def entries(pieces: DataFrame) -> DataFrame:
    """file, text, reason of what cut gives: whole entries (reason null), and what is none."""
    whole = pieces.where("kind IN ('entry', 'rest', 'stray')").select("file", "text", "kind")
    shared = pieces.where("kind IN ('head', 'tail', 'through')")
    # A head ends what the tail before it began: both have as many ends before them.
    order = Window.partitionBy("file").orderBy("block", "nth")
    ends = F.sum(F.when(F.col("kind") == "head", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    own = shared.withColumn("group", F.coalesce(ends, F.lit(0)))
    part = F.array_sort(F.collect_list(F.struct("block", "nth", "text")))
    joined = own.groupBy("file", "group").agg(F.array_join(F.transform(part, lambda p: p["text"]), "").alias("text"), F.bool_or(F.col("kind") == "head").alias("ended"))
    joined = joined.select("file", "text", F.when(F.col("ended"), "entry").otherwise("open").alias("kind"))
    rows = whole.unionByName(joined).withColumn("text", F.regexp_replace("text", r"^[\s,]+|\s+$", "")).where("text <> ''")
    reason = F.when(F.col("kind") == "open", "the file ends within an entry").when(F.col("kind") == "stray", "outside of an object").when(~F.endswith("text", F.lit("}")), "no entry")
    return rows.select("file", "text", reason.alias("reason"))
