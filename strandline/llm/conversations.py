"""Prefix trie of conversations: who begins alike, and what a cache of shared beginnings saves.

Every turn becomes a unit of 20 bytes, the md5 of its role and text and the bytes of its text; a conversation is the row of its units, so that units compare as turns do and texts never move.
Equal conversations are one path, counted before the shuffle. Paths are sorted into ranges over the whole table; a task reads its range in order and compares each path with the one before: the
longest common prefix (LCP) says how many open nodes stay on the stack, the others are closed into rows, with what their subtrees hold. A node that is on the path of a range's first or last
conversation may go on in a neighbouring range: the task gives out what it has of it as an open node. Where one range's last and the next one's first path have an LCP of d, the open nodes to
depth d are the same ones: their counts are added up, children counted twice, saved bytes that a second range couldn't know of, and ends that turn out to be no leaves are set right. Only a row
a range, its two ends, is sorted in one task for that.

The ids that end at a node are hashed in order in one stream: packed into strings in many tasks, which one task then reads chunk after chunk, never holding them together.

Defined results: a null role or text is empty; a null conv_id belongs to no conversation; turns of equal number stand by role, then by the turn's md5; repeated rows are repeated turns;
an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .common import table
from .spelling import CRC_SQL, crc_sql

#: Bytes of a unit: md5 and length.
UNIT = 20
NOTHING = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame, stems: int = 5, longest: int = 9) -> DataFrame:
    """conv_id, path of conversations (conv_id, turn, role, text): the first h turns of conversation c - c % stems, then its own after its first h, where h is crc32(c) % longest."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    unit = F.concat(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)), F.lower(F.lpad(F.hex(F.octet_length(text).cast("long")), 8, "0")))
    stem = F.col("conv_id") - F.col("conv_id") % stems
    turns = conversations.where("conv_id IS NOT NULL").select(stem.alias("stem"), "conv_id", F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", role.alias("role"), unit.alias("unit")).alias("t"))
    # One shuffle, by stem: a conversation's turns are together where its stem's are, as are the few conversations of a stem.
    own = turns.repartition("stem").groupBy("stem", "conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["unit"]).alias("units"))
    families = own.groupBy("stem").agg(F.collect_list(F.struct("conv_id", "units")).alias("of"))
    first = F.get(F.filter("of", lambda c: c["conv_id"] == F.col("stem")), F.lit(0))["units"]
    each = families.select(F.coalesce(first, F.array().cast("array<string>")).alias("first"), F.explode("of").alias("c")).select("first", "c.conv_id", "c.units")
    h = (F.crc32(F.col("conv_id").cast("string")) % longest).cast("int")
    units = F.concat(F.slice("first", F.lit(1), h), F.slice("units", h + 1, F.size("units")))
    return each.select("conv_id", F.unhex(F.array_join(units, "")).alias("path"))


def ends(paths: DataFrame) -> DataFrame:
    """fp, low, n, ends_sha256 of rows (fp, conv_id): of each fp the smallest id, their number, and the SHA-256 of all, ascending and joined by commas."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of equal fp, in order, as strings of up to 50,000 ids."""
        fp, ids = None, []
        row = lambda: pa.RecordBatch.from_arrays([pa.array([fp], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([",".join(map(str, ids))])], names=["fp", "first", "n", "ids"])
        for batch in batches:
            out = []
            for f, i in zip(batch.column("fp").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if f != fp or len(ids) == 50_000:
                    if ids:
                        out.append(row())
                    fp, ids = f, []
                ids.append(i)
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if ids:
            yield row()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp, low, n, state = None, 0, 0, hashlib.sha256()
        names = ["fp", "low", "n", "ends_sha256"]
        done: list[list] = [[], [], [], []]

        def close() -> None:
            for column, value in zip(done, (fp, low, n, state.hexdigest()), strict=True):
                column.append(value)

        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(done, (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=names)
        for batch in batches:
            for f, first, k, ids in zip(*(batch.column(c).to_pylist() for c in ("fp", "first", "n", "ids")), strict=True):
                if f != fp:
                    if fp is not None:
                        close()
                    fp, low, n, state = f, first, 0, hashlib.sha256()
                state.update(("," if n else "").encode() + ids.encode())
                n += k
            yield flush()
            done = [[], [], [], []]
        if fp is not None:
            close()
            yield flush()

    strings = paths.repartitionByRange("fp", "conv_id").sortWithinPartitions("fp", "conv_id").mapInArrow(packed, "fp binary, first long, n long, ids string")
    return strings.repartition("fp").sortWithinPartitions("fp", "first").mapInArrow(hashed, "fp binary, low long, n long, ends_sha256 string")


class Open:
    """A node on the stack."""

    __slots__ = ("bytes", "children", "ends", "key", "leaves", "low", "n", "saved", "waiting", "edge")

    def __init__(self, key: bytes, size: int, edge: bool):
        self.key, self.bytes, self.edge = key, size, edge  # edge: on the path of the range's first conversation
        self.n = self.children = self.leaves = self.saved = 0
        self.low: int | None = None
        self.ends: str | None = None
        self.waiting: list[tuple] = []  # closed children, until it is known who this is


def common_units(a: bytes, b: bytes) -> int:
    """The LCP of two paths, in units."""
    low, high = 0, min(len(a), len(b)) // UNIT
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low * UNIT : mid * UNIT] == b[low * UNIT : mid * UNIT] else (low, mid - 1)
    return low


def child_key(key: bytes, unit: bytes) -> bytes:
    return hashlib.blake2b(key + unit, digest_size=16).digest()


NODE = "part int, kind string, key binary, above binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, path binary"
COLUMNS = [c.split()[0] for c in NODE.split(", ")]
TYPES = [{"int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "long": pa.int64()}[c.split()[1]] for c in NODE.split(", ")]


def sweep(rows: Iterator[tuple[bytes, int, int, str]], part: int) -> Iterator[tuple]:
    """Rows of NODE from sorted distinct paths (path, low, n, ends): kind node for closed nodes, open for those on the path of the first or the last, first and last for these paths.
    A closed node right below an open one has its key as `above`, and no parent_conv_id yet."""
    stack: list[Open] = []
    before: bytes | None = None

    def close() -> Iterator[tuple]:
        node, depth = stack.pop(), len(stack)
        if not node.children:
            node.leaves += 1
        node.saved += (node.n - 1) * node.bytes
        above = stack[-1] if stack else None
        if above is not None:
            above.n += node.n
            above.low = node.low if above.low is None else min(above.low, node.low)
            above.children += 1
            above.leaves += node.leaves
            above.saved += node.saved
        return node, depth, above

    def told(node: Open, depth: int, kind: str, above: bytes | None, parent: int | None) -> tuple:
        return (part, kind, node.key if kind == "open" else None, above, node.low, depth, parent, node.n, node.children, node.leaves, node.saved, node.ends, None)

    for path, low, n, sha in rows:
        keep = -1 if before is None else common_units(before, path)
        if before is None:
            yield (part, "first", None, None, *[None] * 8, path)
        while len(stack) > keep + 1:
            node, depth, above = close()
            if node.edge:
                yield told(node, depth, "open", above.key if above else None, None)
                continue
            for child, at in node.waiting:
                yield told(child, at, "node", None, node.low)
            node.waiting = []
            if above.edge:
                yield told(node, depth, "node", above.key, None)
            else:
                above.waiting.append((node, depth))
        if not stack:
            stack.append(Open(b"", 0, True))
        for k in range(len(stack) - 1, len(path) // UNIT):
            unit = path[k * UNIT : (k + 1) * UNIT]
            stack.append(Open(child_key(stack[-1].key, unit), int.from_bytes(unit[16:], "big"), before is None))
        node = stack[-1]
        node.n += n
        node.low = low if node.low is None else min(node.low, low)
        node.ends = sha
        before = path
    if before is None:
        return
    yield (part, "last", None, None, *[None] * 8, before)
    while stack:
        node, depth, above = close()
        for child, at in node.waiting:
            yield told(child, at, "node", node.key, None)
        yield told(node, depth, "open", above.key if above else None, None)


def swept(classes: DataFrame) -> DataFrame:
    """NODE rows of paths (path, low, n, ends_sha256), sorted over the whole table."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("path", "low", "n", "ends_sha256")), strict=True)

        held: list[tuple] = []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), TYPES, strict=True)], names=COLUMNS)
        for row in sweep(rows(), part):
            held.append(row)
            if len(held) == 8192:
                yield flush()
                held = []
        if held:
            yield flush()

    return classes.select("path", "low", "n", "ends_sha256").repartitionByRange("path").sortWithinPartitions("path").mapInArrow(of, NODE)


def corrections(found: DataFrame) -> DataFrame:
    """key, n_children, n_leaves, saved_tokens to add to open nodes where ranges meet."""
    first = found.where("kind = 'first'").select("part", F.col("path").alias("first"))
    last = found.where("kind = 'last'").select("part", F.col("path").alias("last"))
    # A row a range: its ends, in order of the first ones.
    ranges = first.join(last, "part").withColumn("next", F.lead("first").over(Window.orderBy("first"))).where("next IS NOT NULL").select("last", "next")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for last, after in zip(batch.column("last").to_pylist(), batch.column("next").to_pylist(), strict=True):
                d = common_units(last, after)
                units = [last[k * UNIT : (k + 1) * UNIT] for k in range(d)]
                keys = [b""]
                for u in units:
                    keys.append(child_key(keys[-1], u))
                # Each shared node below the root was a child in both ranges and lost one count of its bytes too many; a last path that the next one goes on from was no leaf.
                below, saved = 0, [0] * (d + 1)
                for k in range(d, -1, -1):
                    below += int.from_bytes(units[k - 1][16:], "big") if k else 0
                    saved[k] = below
                leaf = -1 if len(last) == d * UNIT else 0
                children = [-1] * d + [0]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(children, pa.int64()), pa.array([leaf] * (d + 1), pa.int64()), pa.array(saved, pa.int64())], names=["key", "n_children", "n_leaves", "saved_tokens"])

    return ranges.mapInArrow(of, "key binary, n_children long, n_leaves long, saved_tokens long")


def trie(conversations: DataFrame, stems: int = 5, longest: int = 9) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = written(rebuilt(conversations, stems, longest).withColumn("fp", F.unhex(F.md5("path"))), "paths")
    distinct = paths.groupBy("fp").agg(F.first("path").alias("path"))
    classes = distinct.join(ends(paths.select("fp", "conv_id")), "fp")
    found = written(swept(classes), "swept")
    opened = found.where("kind = 'open'")
    numbers = ["n_children", "n_leaves", "saved_tokens"]
    parts = opened.select("key", "above", "conv_id", "depth", "n_convs", *numbers, "ends_sha256")
    none = {c: F.lit(None).cast(t) for c, t in (("above", "binary"), ("conv_id", "long"), ("depth", "long"), ("n_convs", "long"), ("ends_sha256", "string"))}
    parts = parts.unionByName(corrections(found).withColumns(none))
    whole = parts.groupBy("key").agg(F.max("above").alias("above"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *(F.sum(c).alias(c) for c in ("n_convs", *numbers)), F.max("ends_sha256").alias("ends_sha256"))
    whole = written(whole, "open_nodes")
    low = whole.select(F.col("key").alias("above"), F.col("conv_id").alias("parent"))
    # A closed node's parent that was open is looked up by range, so that a parent of many children is spread over the ranges that have them.
    by_range = opened.select("part", F.col("key").alias("above")).join(low, "above")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", *numbers, "ends_sha256"]
    closed = found.where("kind = 'node'").join(by_range, ["part", "above"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "parent"))
    out = closed.select(*columns).unionByName(whole.join(low, "above", "left").withColumn("parent_conv_id", F.col("parent")).select(*columns))
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))


def op11_conversation_trie(spark, sf_dir) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


SQL = f"""
WITH RECURSIVE {CRC_SQL}
turns AS (
  SELECT conv_id, list(unit ORDER BY turn NULLS FIRST, role, md5(len(role) || ':' || role || text)) AS units FROM (
    SELECT conv_id, turn, role, text, {{'r': role, 't': text}} AS unit FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)) GROUP BY conv_id),
stemmed AS (SELECT t.conv_id, t.units, coalesce(s.units, []) AS stem, {crc_sql("CAST(t.conv_id AS VARCHAR)")} % 9 AS h FROM turns t LEFT JOIN turns s ON s.conv_id = t.conv_id - t.conv_id % 5, tab),
built AS (SELECT conv_id, list_concat(stem[1:h], units[h + 1:]) AS units FROM stemmed),
prefixes AS (SELECT conv_id, d, len(units) AS whole, md5(CAST(units[1:d] AS VARCHAR) || d) AS key, md5(CAST(units[1:d - 1] AS VARCHAR) || (d - 1)) AS above, strlen(units[d].t) AS bytes FROM (SELECT *, unnest(range(0, len(units) + 1)) AS d FROM built)),
nodes AS (
  SELECT key, d, min(conv_id) AS conv_id, CASE WHEN d > 0 THEN any_value(above) END AS above, count(*) AS n_convs, coalesce(any_value(bytes), 0) AS bytes,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = whole), '')) AS ends_sha256 FROM prefixes GROUP BY key, d),
children AS (SELECT above AS key, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (key)),
under AS (SELECT key AS top, key, 0 AS steps FROM nodes UNION ALL SELECT u.top, n.key, steps + 1 FROM under u JOIN nodes n ON n.above = u.key),
sums AS (SELECT top AS key, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE bytes END) AS BIGINT) AS saved_tokens FROM under u JOIN full_nodes USING (key) GROUP BY top)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256 FROM full_nodes n LEFT JOIN nodes p ON p.key = n.above JOIN sums s ON s.key = n.key
"""
