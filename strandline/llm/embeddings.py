"""Near-duplicate vectors by counting collisions on many lines.

Every vector is projected on `tables` random lines, and each line's values are sorted. Two vectors collide on a line if they are within a window of each other, centred on either; a pair
that collides on enough lines is verified by its cosine in double precision. One line alone tells strangers from neighbours by a factor of 3 at most, so its windows would hold a fixed
share of all rows: each line's order is cut by the signs of `bits` more lines of its own, about log2 of the number of vectors, and windows stay within a cell.

Calibration: for two vectors of the least cosine that links, signs and values on lines of normal components are independent, so a line has them collide with a known probability p and their
collisions are binomial. There are as many lines as make 7 collisions expected; the count asked for is the largest that such a pair reaches with probability `recall` or more. Pairs of a larger
cosine reach it more often. Every vector is in every line's order; nothing is sampled or capped.

Equal vectors are one class, which goes through the search once. A row has its vector along, so that the task of a cell counts a pair's collisions on all lines by itself, verifies it, and
gives it out only on the first line where it collides: pairs are never shuffled to be counted. A cell of over `block` members is dealt into parts; each two parts meet in a task of their
own, so its rows are copied once a part: n * n / block of them for n members, as many as comparing all of them in pieces of that size needs.

Defined results: a vector that is null, empty, zero or holds a null or non-finite component links with nothing, nor do vectors of different lengths; repeated rows each get a row and link
with each other; a row without an id counts as a vector of its own; an empty table gives no rows; other columns stay as they are, and where one is called _links or _component the new one
gets underscores after that name: they are always the last two.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components
from ..session import written
from .common import table, unused

KEY = ["dim", "line", "cell", "p", "q"]


class Lines:
    """The lines of vectors of one length: `tables` of them, each with `bits` lines whose signs cut it."""

    def __init__(self, tables: int, bits: int, window: float, seed: int):
        self.tables, self.bits, self.window, self.seed = tables, bits, window, seed
        self.known: dict[int, np.ndarray] = {}

    def places(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[row, line]: cells, and values on the line."""
        dim = unit.shape[1]
        if dim not in self.known:
            self.known[dim] = np.random.default_rng([self.seed, dim]).standard_normal((dim, self.tables * (self.bits + 1)))
        on = (unit @ self.known[dim]).reshape(len(unit), self.tables, self.bits + 1)
        return (on[:, :, 1:] > 0) @ (1 << np.arange(self.bits, dtype=np.int64)), on[:, :, 0]


def tail(n: int, p: float, least: int) -> float:
    """Probability of `least` or more of n, each with probability p."""
    return 1 - sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(least))


def calibrated(vectors: int, cosine: float, recall: float, cell: int, seed: int) -> tuple[Lines, int]:
    """Lines for so many vectors, and the collisions to ask for."""
    bits = min(40, max(0, math.ceil(math.log2(max(1, vectors) / cell))))
    apart = math.sqrt(2 - 2 * cosine)
    window = 2 * apart
    p = (1 - math.acos(cosine) / math.pi) ** bits * math.erf(window / apart / math.sqrt(2))
    tables = math.ceil(7 / p)
    least = max((t for t in range(1, tables + 1) if tail(tables, p, t) >= recall), default=1)
    return Lines(tables, bits, window, seed), least


def stored(vectors: DataFrame, embedding: str) -> str:
    """How components are kept: as the table has them, single or double."""
    return "f4" if isinstance(vectors.schema[embedding].dataType.elementType, T.FloatType) else "f8"


def fingerprints(vectors: DataFrame, embedding: str, carried: list[str], name: str = "fp", with_vector: bool = False) -> DataFrame:
    """The carried columns, a hash of the vector under `name` (null for one that links with nothing) and, if asked for, the vector's bytes as x."""
    kept = stored(vectors, embedding)
    schema = T.StructType([*(vectors.schema[c] for c in carried), T.StructField(name, T.BinaryType()), *([T.StructField("x", T.BinaryType())] if with_vector else [])])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(embedding)
            fps, xs = [None] * len(lists), [None] * len(lists)
            for k in range(len(lists)):
                if not lists[k].is_valid:
                    continue
                values = lists[k].values
                if not len(values) or values.null_count:
                    continue
                x = values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # one zero of both signs
                if np.isfinite(x).all() and x.any():
                    xs[k] = x.astype(kept).tobytes()
                    fps[k] = hashlib.blake2b(xs[k], digest_size=16).digest()
            columns = [batch.column(c) for c in carried] + [pa.array(fps, pa.binary())] + ([pa.array(xs, pa.binary())] if with_vector else [])
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return vectors.select(*dict.fromkeys((*carried, embedding))).mapInArrow(of, schema)


def units(x: pa.Array, kept: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and their unit vectors in double precision, for each length."""
    sizes = np.diff(np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1])
    out = []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        v = np.frombuffer(b"".join(x[int(k)].as_py() for k in rows), kept).reshape(len(rows), -1).astype(np.float64)
        v = v / np.abs(v).max(axis=1, keepdims=True)
        out.append((rows, v / np.sqrt((v * v).sum(axis=1, keepdims=True))))
    return out


def placed(classes: DataFrame, lines: Lines, kept: str, with_vector: bool) -> DataFrame:
    """dim, line, cell, c and, if asked for, x: a row for each class (c, x) and line."""
    schema = "dim int, line int, cell long, c long" + (", x binary" if with_vector else "")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                x, c = part.column("x"), part.column("c").to_numpy()
                for rows, unit in units(x, kept):
                    cells, _ = lines.places(unit)
                    again = np.repeat(rows, lines.tables)
                    columns = [pa.array(np.full(len(again), unit.shape[1], np.int32)), pa.array(np.tile(np.arange(lines.tables, dtype=np.int32), len(rows))), pa.array(cells.ravel()), pa.array(c[again])]
                    names = ["dim", "line", "cell", "c"]
                    if with_vector:
                        columns, names = [*columns, x.take(pa.array(again))], [*names, "x"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return classes.select("c", "x").mapInArrow(of, schema)


def whole_cells(batches: Iterator[pa.RecordBatch], rows: int = 8192) -> Iterator[pa.Table]:
    """Rows in tables of about `rows` that hold whole cells only; rows come sorted by KEY."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        if sum(map(len, held)) < rows:
            continue
        some = pa.Table.from_batches(held)
        keys = np.stack([some.column(k).to_numpy().astype(np.int64) for k in KEY], axis=1)
        last = int(np.argmax((keys == keys[-1]).all(axis=1)))  # the last cell may go on in the next batch
        if last:
            yield some.slice(0, last)
        held = some.slice(last).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def search(cells: pa.Table, lines: Lines, least: int, cosine: float, kept: str, pairs: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (a, b) of whole cells, each from the first line on which its two collide."""
    cells = cells.combine_chunks()
    keys = np.stack([cells.column(k).to_numpy().astype(np.int64) for k in KEY], axis=1)
    group = np.cumsum((np.diff(keys, axis=0, prepend=keys[:1] - 1) != 0).any(axis=1))
    c, line, part = cells.column("c").to_numpy(), keys[:, 1], cells.column("part").to_numpy()
    across = keys[:, 3] != keys[:, 4]
    for rows, unit in units(cells.column("x").chunk(0), kept):
        own, values = lines.places(unit)
        z = values[np.arange(len(rows)), line[rows]]
        order = np.lexsort((z, group[rows]))
        far = 4 * (np.abs(z).max() + lines.window)
        along = group[rows][order] * far + z[order]
        end = np.searchsorted(along, along + lines.window, side="right")
        times = end - np.arange(len(order)) - 1
        edges = np.concatenate(([0], np.cumsum(times)))
        begin = 0
        while begin < len(order):
            stop = max(begin + 1, int(np.searchsorted(edges, edges[begin] + pairs, side="right")) - 1)
            n = times[begin:stop]
            first = np.repeat(np.arange(begin, stop), n)
            second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
            i, j = order[first], order[second]
            meet = ~across[rows[i]] | (part[rows[i]] != part[rows[j]])
            i, j = i[meet], j[meet]
            hit = (own[i] == own[j]) & (np.abs(values[i] - values[j]) <= lines.window)
            here = line[rows[i]]
            hit[np.arange(len(i)), here] = True
            some = (hit.sum(axis=1) >= least) & (hit.argmax(axis=1) == here)
            i, j = i[some], j[some]
            near = np.einsum("kd,kd->k", unit[i], unit[j]) >= cosine
            a, b = c[rows[i[near]]], c[rows[j[near]]]
            yield np.minimum(a, b), np.maximum(a, b)
            begin = stop


def links_of(classes: DataFrame, lines: Lines, least: int, cosine: float, block: int, kept: str) -> DataFrame:
    """a, b: classes (c, x) of a cosine of at least `cosine`."""
    rows, cell = placed(classes, lines, kept, True), ["dim", "line", "cell"]
    large = written(placed(classes, lines, kept, False).groupBy(*cell).agg(F.count("*").alias("n")).where(F.col("n") > block), "large_cells")
    zero = F.lit(0).cast("long")
    if large.isEmpty():
        rows = rows.withColumns({k: zero for k in ("part", "p", "q")})
    else:
        parts = F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("long")
        rows = rows.join(large, cell, "left").withColumn("part", F.pmod(F.xxhash64("c"), parts)).withColumn("other", F.explode(F.sequence(zero, parts - 1)))
        rows = rows.withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other")}).drop("other", "n")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells in whole_cells(batches):
            for a, b in search(cells, lines, least, cosine, kept):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(found, "a long, b long").distinct()


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", embedding: str = "embedding", cosine: float = 0.9, recall: float = 0.99, cell: int = 256, block: int = 16_384, seed: int = 11) -> DataFrame:
    """vectors with _links, how many other rows each links with, and _component, the smallest id reachable by links, the last two columns."""
    with_vector = fingerprints(vectors, embedding, [id_column], with_vector=True).where("fp IS NOT NULL")
    classes = with_vector.groupBy("fp").agg(F.min(id_column).alias("low"), F.count("*").alias("copies"), F.first("x").alias("x"))
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "vectors")
    lines, least = calibrated(classes.count(), cosine, recall, cell, seed)
    links = written(links_of(classes, lines, least, cosine, block, stored(vectors, embedding)), "vector_links")
    sizes = classes.select("c", "copies")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(sizes.withColumnRenamed("c", "b"), "b").groupBy("a").agg(F.sum("copies").alias("others")).withColumnRenamed("a", "c")
    rooted = components(links).withColumnRenamed("v", "c")
    told = classes.select("fp", "c", "low", "copies").join(linked, "c", "left").join(rooted, "c", "left").withColumn("root", F.coalesce("root", "c"))
    lows = told.groupBy("root").agg(F.min("low").alias("component"))
    told = told.join(lows, "root").select("fp", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"), "component")
    names = unused(vectors.columns, "_links"), unused(vectors.columns, "_component")
    fp = unused([*vectors.columns, *names], "fp")
    rows = fingerprints(vectors, embedding, vectors.columns, fp).join(told.select(F.col("fp").alias(fp), F.col("links").alias(names[0]), F.col("component").alias(names[1])), fp, "left")
    own = F.when(F.col(fp).isNull(), F.col(id_column)).otherwise(F.col(names[1]))
    return rows.select(*vectors.columns, F.coalesce(F.col(names[0]), F.lit(0)).cast("long").alias(names[0]), own.alias(names[1]))


def op13_embedding_duplicates(spark, sf_dir) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    component = F.col("_component")
    return out.select("vec_id", F.col("_links").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


#: All pairs, exactly; the search finds them all unless a pair just over the limit collides too rarely (1 in 100 of pairs at the limit itself).
SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS row, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
usable AS (
  SELECT row, vec_id, list_transform(x, lambda y: y / sqrt(list_sum(list_transform(x, lambda z: z * z)))) AS u FROM v
  WHERE len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
links AS (SELECT a.row AS a, b.row AS b FROM usable a JOIN usable b ON a.row <> b.row AND len(a.u) = len(b.u) WHERE list_inner_product(a.u, b.u) >= 0.9),
reach AS (SELECT row AS a, row AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
components AS (SELECT r.a AS row, min(v.vec_id) AS component_id FROM reach r JOIN v ON v.row = r.b GROUP BY r.a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN components USING (row) LEFT JOIN (SELECT a AS row, count(*) AS n FROM links GROUP BY a) USING (row)
"""
