"""N-gram Jaccard join by signature trees: near duplicates among whole texts, exactly.

Documents link when the Jaccard similarity of their sets of word shingles is at least `threshold` percent. A text's words are lowered in A-Z
only; a text of fewer words is one shingle; without words the set is empty and links with nothing. Texts of equal sets are one class.

1. Order. Shingles are hashed to 64 bits. A sketch of fixed size counts all documents' shingles by hash; shingles of crowded
   buckets come last in the order. Any order gives the same links: this one keeps common passages out of the prefixes.
2. Blocks. Two linked sets share a shingle among the first n - ceil(threshold * n) + 1 of each. A block is the classes that have one shingle in
   their prefix; blocks of one class go.
3. Heads. Each class is compared with its blocks' smallest and largest class, so that a large group of copies is one component before
   trees are made: a few pairs a member, however large the group is.
4. Trees. Blocks that still hold several components become signature trees: members ordered by component and size, nodes of eight below
   nodes of eight, each node with the OR of its members' token bitmaps and its range of sizes. Two descents at once from the
   root drop node pairs of one component, of sizes too far apart, or whose maximum possible overlap (common bits, and tokens that share bits) is
   too small. Bitmaps have half of a set's shingles and are as wide as it is large; those of sets that differ in width are folded. A block of over `block` members (fewer
   where bitmaps are wide) is cut into parts by size, one tree for each two parts whose sizes may link and that aren't of one component. What comes out of a tree is a forest over the
   members that may link: a row less than it has members at most, not a row a pair. The components of all forests are clusters: no link leaves one.
5. Proof. The members of clusters come once more, with their whole sets, read anew from their texts. A tree over wider bitmaps gives the
   pairs of a cluster, each is compared by its sets, and pairs that links of the cluster have joined already are passed over; so a cluster gives fewer links than
   it has members. Clusters whose sets have over `held` shingles together are cut into parts in the same way. Links of both rounds make the components.

No task makes a row a pair. A member of a block within `block` is one row; one of a larger block is a row for each part of sizes near its own, so these grow
with the number of members of sizes within the threshold over `block`. Pairs just below the threshold are compared inside tasks.

Defined results: null or empty text has 0 shingles and is its own component; repeated rows are copies and each get a row; rows with one doc_id
and several texts count as one document that has the links of each; a row without doc_id has links too, and its component is the smallest doc_id of
those that have one, else null; doc_id is of any type that has an order; an empty table gives no rows; other columns are not looked at, and
keep_one gives them back as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import written
from .common import table, unused
from ..operators.components import components

MIX = np.uint64(0x9E3779B97F4A7C15)
FINISH = np.uint64(0xBF58476D1CE4E5B9)
#: Widths of the bitmaps in blocks: of half of a set's shingles (those whose hash says so), in half as many bits as it has shingles, so that the longest texts' bitmaps aren't full.
NARROW, MAX_WIDE = 512, 8192
#: Width of the bitmaps over whole sets.
TREE_BITS = 2048


class WordHashes(dict):
    """64-bit hashes of words; forgets when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_hashes(text: str | None, hashes: WordHashes, size: int) -> np.ndarray:
    """Hashes of the text's shingles, in order, repeated ones too."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(size, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = (h * MIX) ^ w[j : len(w) - k + 1 + j]
        h ^= h >> np.uint64(29)
    h *= FINISH
    h ^= h >> np.uint64(32)
    return h


#: Only shingles with a hash under this can come into a prefix, but for few: the sketch counts these.
COUNTED = np.uint64(int(0.3 * 2**64))


def crowded(docs: DataFrame, size: int, buckets: int) -> np.ndarray:
    """Level of each bucket of hashes: 0, or more the more shingles over the usual number fall in it. Counts all texts; of fixed size."""
    last = np.uint64(buckets - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, hashes = np.zeros(buckets, np.int64), WordHashes()
        for batch in batches:
            for t in batch.column("text"):
                h = shingle_hashes(t.as_py(), hashes, size)
                np.add.at(total, (h[h < COUNTED] & last).astype(np.int64), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    n = np.zeros(buckets, np.float64)
    sums = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most `buckets` rows
    n[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    usual = np.median(n)
    over = np.maximum((n - usual) / (3 * np.sqrt(usual) + 8), 1e-9)
    return np.where(over > 1, np.minimum(15, 1 + np.floor(np.log2(np.maximum(over, 1)))), 0).astype(np.uint8)


def bitmap(h: np.ndarray, width: int) -> np.ndarray:
    flags = np.zeros(width, bool)
    flags[(h & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").view(np.int64)


def width_of(n: int, least: int) -> int:
    """The power of two from n on, within least and MAX_WIDE."""
    return min(MAX_WIDE, max(least, 1 << max(0, n - 1).bit_length()))


def fingerprint(h: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(h.tobytes())


LONGS = T.ArrayType(T.LongType())
LONG_LISTS = pa.list_(pa.int64())


def signatures(docs: DataFrame, size: int, threshold: int, buckets: int) -> DataFrame:
    """doc_id, th, n, fp (of the set), prefix, bits, wide for each row of docs (doc_id, th, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(crowded(docs, size, buckets))
    last = np.uint64(buckets - 1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, hashes = sent.value, WordHashes()
        for batch in batches:
            n, fp, prefix, bits, wide = [], [], [], [], []
            for t in batch.column("text"):
                h = np.unique(shingle_hashes(t.as_py(), hashes, size))
                n.append(len(h))
                if not len(h):
                    for x in (fp, prefix, bits, wide):
                        x.append(None)
                    continue
                p = len(h) + (-threshold * len(h)) // 100 + 1
                order = (level[(h & last).astype(np.int64)].astype(np.uint64) << np.uint64(60)) | (h >> np.uint64(4))
                first = np.sort(np.partition(order, p - 1)[:p]) if p < len(order) else np.sort(order)
                fp.append(fingerprint(h))
                prefix.append(first.view(np.int64))
                bits.append(bitmap(h[(h >> np.uint64(40)) & np.uint64(1) == 0], width_of(len(h) // 2, NARROW)))
                wide.append(bitmap(h, width_of(len(h), 64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), *(pa.array(x, LONG_LISTS) for x in (prefix, bits, wide))],
                names=["doc_id", "th", "n", "fp", "prefix", "bits", "wide"],
            )

    schema = T.StructType([docs.schema["doc_id"], T.StructField("th", T.LongType()), T.StructField("n", T.LongType()), T.StructField("fp", T.BinaryType()), *(T.StructField(c, LONGS) for c in ("prefix", "bits", "wide"))])
    return docs.select("doc_id", "th", "text").mapInArrow(sign, schema)


def whole_sets(named: DataFrame, docs: DataFrame, size: int, send_rows: int) -> DataFrame:
    """c, h (the sorted hashes of the set) for each class of named (c, doc_id, th): read anew from the texts of docs (doc_id, th, text)."""
    # Which texts to read: sent to the tasks if that is few rows, else joined by shuffle.
    wanted = named.select("c", F.col("doc_id").alias("rep"), F.col("th").alias("rep_th"))
    wanted = F.broadcast(wanted) if named.count() <= send_rows else wanted
    texts = docs.join(wanted, (F.col("th") == F.col("rep_th")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("c", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            h = [np.unique(shingle_hashes(t.as_py(), hashes, size)).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(h, LONG_LISTS)], names=["c", "h"])

    return written(texts.mapInArrow(sets, T.StructType([T.StructField("c", T.LongType()), T.StructField("h", LONGS)])).dropDuplicates(["c"]), "sets")


def outside(a: Column, b: Column) -> Column:
    """Bits of a that b hasn't; the wider of the two is folded to the other's width."""
    fold = lambda x, to: F.when(F.size(x) > F.size(to), F.zip_with(F.slice(x, 1, F.size(to)), F.slice(x, F.size(to) + 1, F.size(to)), lambda p, q: p.bitwiseOR(q))).otherwise(x)
    return F.aggregate(F.zip_with(fold(a, b), fold(b, a), lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0).cast("long"), lambda s, x: s + x)


def proved(pairs: DataFrame, reps: DataFrame, docs: DataFrame, size: int, threshold: int, send_rows: int) -> DataFrame:
    """The pairs (a, b) of classes that link: by bitmaps as wide as the sets first, then by the sets."""
    side = lambda c: reps.select(F.col("c").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(f"w_{c}"))
    need = lambda x: F.lit(100 + threshold) * x >= F.lit(threshold) * (F.col("n_a") + F.col("n_b"))
    may = (
        pairs.join(side("a"), "a").join(side("b"), "b")
        .where((100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")))
        .where(need(F.least(F.col("n_a") - outside(F.col("w_a"), F.col("w_b")), F.col("n_b") - outside(F.col("w_b"), F.col("w_a")))))
        .select("a", "b")
    )
    may = written(may, "may")
    named = written(may.select(F.col("a").alias("c")).union(may.select("b")).distinct().join(reps.select("c", "doc_id", "th"), "c"), "named")
    whole = whole_sets(named, docs, size, send_rows)
    of = lambda c: whole.select(F.col("c").alias(c), F.col("h").alias(f"h_{c}"))
    common = F.size(F.array_intersect("h_a", "h_b"))
    return written(may.join(of("a"), "a").join(of("b"), "b").where(100 * common >= threshold * (F.size("h_a") + F.size("h_b") - common)).select("a", "b"), "links")


def counted_bits(p: np.ndarray, x: np.ndarray, q: np.ndarray, y: np.ndarray, without: bool = False, slice_rows: int = 65_536) -> np.ndarray:
    """Bits that rows x of p have, and rows y of q too (or, without, have not), in slices: as many pairs as there are take little memory."""
    out = np.empty(len(x), np.int64)
    for i in range(0, len(x), slice_rows):
        s = slice(i, i + slice_rows)
        other = q[y[s]]
        out[s] = np.bitwise_count(p[x[s]] & (~other if without else other)).sum(axis=1, dtype=np.int64)
    return out


def tree_pairs(n: np.ndarray, component: np.ndarray, bits: np.ndarray, threshold: int, slice_pairs: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members of a block, of different components, that may link: by descending a signature tree twice at once, a bounded slice of node pairs at a time."""
    order = np.lexsort((n, component))
    n, component, bits = n[order], component[order], bits[order]
    extra = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    levels = [(bits, n, n, component, component, extra)]
    while len(levels[-1][1]) > 1:
        ors, low, high, c_low, c_high, most = levels[-1]
        at = np.arange(0, len(low), 8)
        levels.append((np.bitwise_or.reduceat(ors, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(c_low, at), np.maximum.reduceat(c_high, at), np.maximum.reduceat(most, at)))
    todo = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    k, j = np.divmod(np.arange(64), 8)
    while todo:
        level, x, y = todo.pop()
        if not level:
            on = x != y
            x, y = x[on], y[on]
            overlap = np.minimum(n[x] - counted_bits(bits, x, bits, y, True), n[y] - counted_bits(bits, y, bits, x, True))
            on = (100 + threshold) * overlap >= threshold * (n[x] + n[y])
            if on.any():
                yield order[x[on]], order[y[on]]
            continue
        if len(x) > slice_pairs:
            todo.append((level, x[slice_pairs:], y[slice_pairs:]))
            x, y = x[:slice_pairs], y[:slice_pairs]
        ors, low, high, c_low, c_high, most = levels[level - 1]
        x, y = (x[:, None] * 8 + k).ravel(), (y[:, None] * 8 + j).ravel()
        on = (x <= y) & (y < len(low))
        x, y = x[on], y[on]
        on = ~((c_low[x] == c_high[y]) & (c_high[x] == c_low[y]) & (c_low[x] == c_high[x]))
        on &= (100 * high[x] >= threshold * low[y]) & (100 * high[y] >= threshold * low[x])
        x, y = x[on], y[on]
        overlap = counted_bits(ors, x, ors, y) + np.minimum(most[x], most[y])
        on = (100 + threshold) * overlap >= threshold * (low[x] + low[y])
        if on.any():
            todo.append((level - 1, x[on], y[on]))


#: What says in which tree a row is: its block or cluster, and the two parts of that.
KEY = ("block", "p", "q")
#: Of a row beside: its own part, class, size and component.
OWN = ("part", "c", "n", "root")


class Blocks:
    """Rows of whole blocks, in order of KEY. Labels say which rows are joined so far: at first those of one component, or, if not by_component, none."""

    def __init__(self, rows: pa.Table, by_component: bool):
        column = lambda c: rows.column(c).to_numpy().astype(np.int64)
        keys = np.stack([column(c) for c in KEY], axis=1)
        self.part, self.c, self.n, self.root = (column(c) for c in OWN)
        self.label = np.unique(self.root, return_inverse=True)[1] if by_component else np.arange(len(rows))
        self.across = keys[:, 1] != keys[:, 2]
        self.edges = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(rows)]))
        self.sizes = np.diff(self.edges)
        self.group = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def pairs(self, maps: dict[int, tuple[np.ndarray, np.ndarray]], threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows that may link, of different components and labels, and are this tree's: of its two parts. A block is left once all its rows are joined.

        maps has, by width, the bitmaps of rows that are so wide, or twice as wide and folded, and the place of each row's bitmap (or -1).
        """
        n, few = self.n, self.sizes[self.group] <= 32
        native = np.full(len(n), min(maps), np.int64)
        for width, (_, at) in sorted(maps.items()):
            native[at >= 0] = width  # the widest that a row has is its own

        def mine(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            on = (self.root[x] != self.root[y]) & (self.label[x] != self.label[y]) & (~self.across[x] | (self.part[x] != self.part[y]))
            return x[on], y[on]

        # Small blocks are trees of a single node: members are compared with those that follow, all blocks at once.
        for d in range(1, min(32, len(n))):
            x = np.flatnonzero(few[:-d] & (self.group[:-d] == self.group[d:]))
            if not len(x):
                break
            x, y = mine(x, x + d)
            on = 100 * np.minimum(n[x], n[y]) >= threshold * np.maximum(n[x], n[y])
            x, y = x[on], y[on]
            width = np.minimum(native[x], native[y])
            for w in np.unique(width):
                bits, at = maps[w]
                u, v = x[width == w], y[width == w]
                overlap = np.minimum(n[u] - counted_bits(bits, at[u], bits, at[v], True), n[v] - counted_bits(bits, at[v], bits, at[u], True))
                on = (100 + threshold) * overlap >= threshold * (n[u] + n[v])
                yield u[on], v[on]
        for g in np.flatnonzero(self.sizes > 32):
            begin, end = self.edges[g], self.edges[g + 1]
            for w, (bits, at) in maps.items():
                rows = np.flatnonzero(at[begin:end] >= 0) + begin
                if not (native[rows] == w).any():
                    continue
                for x, y in tree_pairs(n[rows], self.root[rows], bits[at[rows]], threshold):
                    x, y = mine(rows[x], rows[y])
                    on = (native[x] == w) | (native[y] == w)
                    yield x[on], y[on]
                    if (self.label[begin:end] == self.label[begin]).all():
                        break

    def forest(self, maps: dict[int, tuple[np.ndarray, np.ndarray]], threshold: int, links=lambda x, y: y) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (a, b) of classes that join all rows of a block that linking pairs join, and no more than are needed for that. links(x, y): those of y that link with x."""
        a, b = [], []
        for xs, ys in self.pairs(maps, threshold):
            order = np.argsort(xs, kind="stable")
            xs, ys = xs[order], ys[order]
            begins = np.flatnonzero(np.diff(xs, prepend=-1))
            for x, y in zip(xs[begins].tolist(), np.split(ys, begins[1:]), strict=True) if len(xs) else ():
                y = y[self.label[y] != self.label[x]]
                if not len(y):
                    continue
                y = links(x, y)
                if not len(y):
                    continue
                joined, at = np.unique(self.label[y], return_index=True)
                a += [self.c[x]] * len(at)
                b += self.c[y[at]].tolist()
                block = self.label[self.edges[self.group[x]] : self.edges[self.group[x] + 1]]
                block[np.isin(block, joined)] = self.label[x]
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return np.minimum(a, b), np.maximum(a, b)


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in tables that hold whole blocks only."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held)
        keys = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in KEY], axis=1)
        last = int(np.argmax((keys == keys[-1]).all(axis=1)))  # the last block may go on in the next batch
        if last:
            yield rows.slice(0, last)
        held = rows.slice(last).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def dealt(rows: DataFrame, totals: DataFrame, threshold: int, limit: int) -> DataFrame:
    """rows (block, c, n, root, weight, ...) of the blocks of totals (block, total) with their part, and a row for each two parts (p, q) in which they are compared.

    A block of a total weight within limit is one part. Others are cut by size, sizes of over limit by component, so that parts are ranges of sizes; a component
    of over a quarter of limit has parts of its own. Parts meet only if their sizes may link and they aren't of one component, and a
    row goes only where its own size may link. So a row comes once for each part of sizes near its own.
    """
    zero = F.lit(0).cast("long")
    whole = rows.join(totals.where(F.col("total") <= limit).select("block"), "block").withColumns({c: zero for c in ("part", "p", "q")})
    large = written(rows.join(totals.where(F.col("total") > limit).select("block"), "block"), "large")
    cells = large.groupBy("block", "n", "root").agg(F.sum("weight").alias("w"))
    before = lambda *order: Window.partitionBy("block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # A row a component of over a quarter of limit: few, and numbered from -1 down.
    own = cells.where(F.col("w") > limit / 4).withColumn("parts", F.ceil(F.col("w") / limit).cast("long"))
    own = own.withColumn("first", F.coalesce(F.sum("parts").over(before("n", "root")), zero)).drop("w")
    # A row a size.
    sizes = cells.where(F.col("w") <= limit / 4).groupBy("block", "n").agg(F.sum("w").alias("w"))
    sizes = sizes.withColumn("begin", F.coalesce(F.sum("w").over(before("n")), zero))
    at = F.when(F.col("parts").isNotNull(), -1 - F.col("first") - F.pmod(F.xxhash64("c"), F.col("parts"))).otherwise(F.floor((F.col("begin") + F.pmod(F.xxhash64("root"), F.col("w"))) / limit))
    placed = written(large.join(own, ["block", "n", "root"], "left").join(sizes, ["block", "n"], "left").withColumn("part", at.cast("long")).drop("parts", "first", "w", "begin"), "placed")
    parts = placed.groupBy("block", "part").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("root").alias("r_low"), F.max("root").alias("r_high"))
    a, b = parts.alias("a"), parts.alias("b")
    meets = (F.col("a.part") <= F.col("b.part")) & (100 * F.col("a.high") >= threshold * F.col("b.low")) & (100 * F.col("b.high") >= threshold * F.col("a.low"))
    one = (F.col("a.r_low") == F.col("b.r_high")) & (F.col("b.r_low") == F.col("a.r_high")) & (F.col("a.r_low") == F.col("a.r_high"))
    met = written(a.join(b, (F.col("a.block") == F.col("b.block")) & meets & ~one).select("a.block", F.col("a.part").alias("p"), F.col("b.part").alias("q"), *(F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("low", "high"))), "met")
    of = lambda part, other: met.select("block", F.col(part).alias("part"), "p", "q", F.col(f"low_{other}").alias("low"), F.col(f"high_{other}").alias("high"))
    both = of("p", "b").union(of("q", "a").where("p <> q"))
    near = (100 * F.col("n") >= threshold * F.col("low")) & (100 * F.col("high") >= threshold * F.col("n"))
    return whole.unionByName(placed.join(both, ["block", "part"]).where(near).drop("low", "high"))


def forests(rows: DataFrame, body) -> DataFrame:
    """Pairs (a, b) that body(table of whole blocks) gives for rows."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in whole_blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in body(blocks)], names=["a", "b"])

    return rows.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(search, "a long, b long").distinct()


def candidates(live: DataFrame, found: DataFrame, reps: DataFrame, threshold: int, block: int) -> DataFrame:
    """Pairs (a, b) of a forest over the classes that may link, in a block, with one of another component so far."""
    tied = written(live.select(F.col("token").alias("block"), "c", "n").join(found.select(F.col("v").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c")), "tied")
    # Bytes: a bitmap's by the size of its set, and as much as the narrowest for the rest.
    tied = tied.withColumn("weight", NARROW // 8 + F.greatest(F.lit(NARROW // 8), F.least(F.lit(MAX_WIDE // 8), (F.col("n") / 8).cast("long"))))
    mixed = written(tied.groupBy("block").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.sum("weight").alias("total")).where("low <> high").select("block", "total"), "mixed")
    rows = dealt(tied, mixed, threshold, block * NARROW // 4).join(reps.select("c", "bits"), "c").select(*KEY, *OWN, "bits")

    def may_link(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        bits = rows.column("bits").combine_chunks()
        # Joined by what may link only: a member whose component has another member in the cluster still needs a pair of its own.
        return Blocks(rows, by_component=False).forest(by_width(bits.flatten().to_numpy().view(np.uint64), np.asarray(bits.offsets).astype(np.int64)), threshold)

    return written(forests(rows, may_link), "candidates")


def by_width(flat: np.ndarray, edges: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each width, the bitmaps flat[edges[i]:edges[i + 1]] of rows i of that width, and those twice as wide, folded; and each row's place among these, or -1."""
    edges = edges - edges[0]
    words, out = np.diff(edges), {}
    for w in np.unique(words):
        own, twice = np.flatnonzero(words == w), np.flatnonzero(words == 2 * w)
        maps = flat[edges[twice][:, None] + np.arange(2 * w)]
        at = np.full(len(words), -1, np.int64)
        at[own], at[twice] = np.arange(len(own)), len(own) + np.arange(len(twice))
        out[int(w) * 64] = np.concatenate((flat[edges[own][:, None] + np.arange(w)], maps[:, :w] | maps[:, w:])), at
    return out


def bitmaps(flat: np.ndarray, edges: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps of the sets flat[edges[i]:edges[i + 1]]."""
    out = np.empty((len(edges) - 1, width // 64), np.uint64)
    for i in range(0, len(out), 1024):
        to = min(i + 1024, len(out))
        h = flat[edges[i] : edges[to]]
        flags = np.zeros((to - i, width), bool)
        flags[np.repeat(np.arange(to - i), np.diff(edges[i : to + 1])), (h & (width - 1)).astype(np.int64)] = True
        out[i:to] = np.packbits(flags, axis=1, bitorder="little").view(np.uint64)
    return out


def proved_forest(blocks: Blocks, flat: np.ndarray, edges: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """The forest of links by the whole sets flat[edges[i]:edges[i + 1]] of rows i."""
    ids = np.unique(flat, return_inverse=True)[1]
    on = np.zeros(len(ids), bool)

    def links(x: int, y: np.ndarray, slice_rows: int = 512) -> np.ndarray:
        own = ids[edges[x] : edges[x + 1]]
        on[own] = True
        common = np.empty(len(y), np.int64)
        for i in range(0, len(y), slice_rows):
            of = y[i : i + slice_rows]
            common[i : i + slice_rows] = np.add.reduceat(on[np.concatenate([ids[edges[k] : edges[k + 1]] for k in of])], np.concatenate(([0], np.cumsum(blocks.n[of])[:-1])), dtype=np.int64)
        on[own] = False
        return y[100 * common >= threshold * (blocks.n[x] + blocks.n[y] - common)]

    return blocks.forest({TREE_BITS: (bitmaps(flat, edges, TREE_BITS), np.arange(len(edges) - 1))}, threshold, links)


def linked(pairs: DataFrame, found: DataFrame, reps: DataFrame, docs: DataFrame, size: int, threshold: int, held: int, send_rows: int) -> DataFrame:
    """Links (a, b) that join what links join in the clusters of candidates' pairs: proved by whole sets."""
    clusters = components(pairs).select(F.col("v").alias("c"), F.col("root").alias("block"))
    named = written(clusters.join(reps.select("c", "doc_id", "th", "n"), "c").join(found.select(F.col("v").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c")), "named")
    whole = whole_sets(named.select("c", "doc_id", "th"), docs, size, send_rows)
    totals = named.groupBy("block").agg(F.sum("n").alias("total"))
    rows = dealt(named.withColumn("weight", F.col("n")), totals, threshold, held).select(*KEY, *OWN).join(whole, "c").select(*KEY, *OWN, "h")

    def prove(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        h = rows.column("h").combine_chunks()
        edges = np.asarray(h.offsets).astype(np.int64)
        return proved_forest(Blocks(rows, by_component=True), h.flatten().to_numpy(), edges - edges[0], threshold)

    return written(forests(rows, prove), "more_links")


def heads_of(live: DataFrame) -> DataFrame:
    """Pairs (a, b) of each class and the smallest and the largest member of its blocks: two a row of live at most, however large a block is."""
    pairs = live.select(F.col("head").alias("a"), F.col("c").alias("b")).union(live.select(F.col("c").alias("a"), F.col("tail").alias("b")))
    return pairs.where("a <> b").distinct()


def same_document(some: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes whose rows have one doc_id: a star for each doc_id of several texts."""
    several = some.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.xxhash64("fp")).alias("low"), F.max(F.xxhash64("fp")).alias("high")).where("low <> high").select("doc_id")
    of = written(some.select("doc_id", "fp").join(several, "doc_id").distinct().join(reps.select("fp", "c"), "fp").select("doc_id", "c"), "several")
    return of.join(of.groupBy("doc_id").agg(F.min("c").alias("a")), "doc_id").where("a <> c").select("a", F.col("c").alias("b"))


def join(
    docs: DataFrame, size: int = 5, threshold: int = 80, buckets: int = 1 << 18, block: int = 32_768, held: int = 4_000_000, send_rows: int = 100_000, by_document: bool = True
) -> DataFrame:
    """doc_id, th (hash of the text), n (size of the set), fp, rep (the smallest doc_id of the same set), root (the smallest doc_id reachable) and
    component (one number for all that is reachable, null where n is 0) for each row of docs. Without by_document, rows of one doc_id with different texts are not taken for one document."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    signed = written(signatures(docs, size, threshold, buckets), "signed")
    some = signed.where("n > 0")
    place = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    classes = some.groupBy("fp").agg(place.alias("place"), *(F.first(c).alias(c) for c in ("n", "prefix", "bits", "wide")))
    reps = written(classes.select(F.monotonically_increasing_id().alias("c"), "place.doc_id", "place.th", "fp", "n", "prefix", "bits", "wide"), "reps")
    tokens = reps.select("c", "n", F.explode("prefix").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("c").alias("head"), F.max("c").alias("tail")).where("df > 1")
    live = written(tokens.join(shared, "token"), "live")
    links = proved(written(heads_of(live), "heads"), reps, docs, size, threshold, send_rows)
    if by_document:
        links = links.unionByName(same_document(some, reps))
    found = components(links)
    pairs = candidates(live, found, reps, threshold, block)
    if not pairs.isEmpty():
        more = linked(pairs, found, reps, docs, size, threshold, held, send_rows)
        if not more.isEmpty():
            found = components(links.unionByName(more))
    named = reps.select("fp", "c", F.col("doc_id").alias("rep")).join(found.withColumnRenamed("v", "c"), "c", "left").select("fp", "rep", F.coalesce("root", "c").alias("component"))
    named = named.join(named.groupBy("component").agg(F.min("rep").alias("root")), "component")
    out = signed.select("doc_id", "th", "n", "fp").join(named, "fp", "left")
    own = F.col("n") == 0
    return out.select("doc_id", "th", "n", "fp", *(F.when(own, F.col("doc_id")).otherwise(F.col(c)).alias(c) for c in ("rep", "root")), "component")


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """docs without all but one row of each group that links hold together: that of the smallest doc_id, rows without one last.

    Rows without a word link with nothing and all stay; so do rows of one doc_id whose texts don't link.
    """
    columns = docs.columns
    doc, text, times = (unused(columns, c) for c in ("kept_doc", "kept_text", "times"))
    rows = join(docs, by_document=False, **parameters).where("n > 0").groupBy("component", "doc_id", "th").agg(F.count("*").alias("times"))
    kept = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "times")).alias("k"))
    kept = written(kept.select(F.col("k.doc_id").alias(doc), F.col("k.th").alias(text), F.col("k.times").alias(times)), "kept")
    matches = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(text))
    wordless = ~F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    once = docs.join(kept.where(F.col(times) == 1), matches, "left").where(wordless | F.col(times).isNotNull()).select(*columns)
    again = docs.join(kept.where(F.col(times) > 1), matches).dropDuplicates([doc, text]).select(*columns)
    return once.unionByName(again)


def op3_near_duplicates(spark, sf_dir) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", F.col("n").alias("n_shingles"), F.col("root").alias("component_id"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
cut AS (SELECT row, doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0),
shingles AS (SELECT DISTINCT row, doc_id, array_to_string(words[i:i + 4], ' ') AS shingle FROM cut),
sizes AS (SELECT row, doc_id, count(*) AS n, md5(string_agg(shingle, '  ' ORDER BY shingle)) AS set FROM shingles GROUP BY row, doc_id),
classes AS (SELECT set, any_value(n) AS n, min(row) AS row FROM sizes GROUP BY set),
own AS (SELECT c.set, c.n, s.shingle FROM classes c JOIN shingles s USING (row)),
pairs AS (SELECT a.set AS a, b.set AS b FROM own a JOIN own b ON a.shingle = b.shingle AND a.set < b.set GROUP BY a.set, b.set, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
nodes AS (SELECT DISTINCT set, CAST(doc_id AS VARCHAR) AS doc FROM sizes),
edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs UNION SELECT x.set, y.set FROM nodes x JOIN nodes y ON x.doc = y.doc AND x.set <> y.set),
reach AS (SELECT set AS a, set AS b FROM classes UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
roots AS (SELECT r.a AS set, min(s.doc_id) AS root FROM reach r JOIN sizes s ON s.set = r.b GROUP BY r.a)
SELECT w.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, CASE WHEN s.n IS NULL THEN w.doc_id ELSE root END AS component_id
FROM w LEFT JOIN sizes s USING (row) LEFT JOIN roots USING (set)
"""
