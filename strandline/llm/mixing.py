"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each source gets a target in words. A document's expected copies are target / size of its source; running along the
source's documents, the prefix sum of expected copies plus one random offset is followed, and a document is emitted once
for each whole number that its step crosses. A step is at most max_repeat, so a document is too.

The prefix sum is taken in two levels, so that no task holds a source: documents are dealt into strata (size by
quarters of doublings) and, within one, into salts by the hash of doc_id; only the counts of (source, stratum, salt), at most some
thousands for a source however many documents it has, are summed along the source, and each group numbers its own rows.
Going by strata also keeps each source's words near its target.

Defined results: null or empty text has size 0 and takes 0 words; a null source is a source of its own, last in order;
repeated rows are sampled each on its own; ties are in the order of the hash of doc_id; an empty table gives no rows; other columns are not looked at. expand
gives them back as they are, and where one is called copy_no the new one gets underscores after that name: it is always the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .common import unused, words


def allocate(sizes: DataFrame, weights: tuple[float, ...], share: float, max_repeat: float) -> DataFrame:
    """target by source of sizes (source, source_size): weights repeat along the sources by code point, null last.

    Targets stop at max_repeat times the source's size; the excess is dealt again by weight. Where the level (words per
    weight) ends up follows from prefix sums along the sources by the level at which each stops. sizes has a row a
    source: counts, not documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = (
        sizes.withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
        .withColumn("cap", F.col("source_size") * float(max_repeat))
    )
    by_stop = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, after = by_stop.rowsBetween(Window.unboundedPreceding, -1), by_stop.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    return (
        ranked.withColumn("order", F.row_number().over(by_stop))
        .withColumn("level", level)
        .withColumn("free", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("order", "level")))
        .withColumn("free", F.min("free").over(everything))
        .withColumn("target", F.coalesce(F.least("cap", F.col("free.level") * F.col("weight")), F.col("cap")))
        .select("source", "source_size", "target")
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, max_repeat: float = 2.0, seed: str = "mix-1") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, text_hash for each row of docs."""
    sized = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    dealt = written(
        sized.withColumn("key", key)
        .withColumn("stratum", F.expr("length(bin(size)) * 4 + shiftright(size * 8, length(bin(size))) % 4"))
        .withColumn("salt", F.conv(F.substring("key", 1, 2), 16, 10).cast("int") % 64)
        .withColumn("own", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))),
        "mix",
    )
    group = ["own", "stratum", "salt"]
    counts = dealt.groupBy(*group).agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    along = Window.partitionBy("own").orderBy("stratum", "salt").rowsBetween(Window.unboundedPreceding, -1)
    targets = allocate(
        counts.groupBy("own").agg(F.sum("words").alias("source_size")).withColumn("source", F.when(F.col("own") != "n", F.expr("substring(own, 2)"))), weights, share, max_repeat
    ).withColumn("own", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), "own")), 1, 5), 16, 10).cast("long") / F.lit(1048576.0)
    groups = (
        counts.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0)))
        .join(targets.drop("source"), "own")
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .withColumn("offset", offset)
        .drop("n", "words")
    )
    inside = Window.partitionBy(*group).orderBy("size", "key", F.col("doc_id").asc_nulls_last())
    crossed = lambda i: F.floor(i * F.col("rate") + F.col("offset"))
    return (
        dealt.withColumn("at", F.row_number().over(inside))
        .join(groups, group)
        .withColumn("at", F.col("at") + F.col("before"))
        .withColumn("copies", crossed(F.col("at")) - crossed(F.col("at") - 1))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "text_hash")
    )


def expand(docs: DataFrame, **parameters) -> DataFrame:
    """The mixed corpus: each row of docs, once for each copy, with copy_no from 0 as the last column.

    Rows that share doc_id, source and text are one: the copies of all are numbered on, and are those of any one of them.
    """
    name = unused(docs.columns, "copy_no")
    doc, source, text, copies, rows, block = (unused([*docs.columns, name], c) for c in ("of_doc", "of_source", "of_text", "copies", "rows", "block"))
    hashed = F.xxhash64(F.col("text").cast("string"))
    plan = written(
        mix(docs, **parameters).groupBy("doc_id", "source", "text_hash").agg(F.sum("copies").alias(copies), F.count("*").alias(rows)).where(F.col(copies) > 0)
        .select(F.col("doc_id").alias(doc), F.col("source").alias(source), F.col("text_hash").alias(text), copies, rows),
        "copies",
    )
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & F.col("source").eqNullSafe(F.col(source)) & (hashed == F.col(text))
    once = docs.join(plan.where(F.col(rows) == 1), same)
    again = docs.join(plan.where(F.col(rows) > 1), same).dropDuplicates([doc, source, text])
    # Numbers are made in two steps, so that no array grows with the copies of one row.
    size = 1000
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / size)))
    number = F.explode(F.sequence((F.col(block) * size).cast("int"), F.least(F.col(copies) - 1, F.col(block) * size + size - 1).cast("int")))
    return once.unionByName(again).withColumn(block, blocks).withColumn(name, number).select(*docs.columns, name)


def op4_mixing(spark, sf_dir) -> DataFrame:
    from .common import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key, coalesce('s' || source, 'n') AS own
  FROM documents),
sums AS (SELECT own, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY own),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight,
         source_size * 2.0::DOUBLE AS cap FROM sums),
levels AS (
  SELECT *, row_number() OVER w AS ord,
         ((SELECT sum(source_size) FROM sums)::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked WINDOW w AS (ORDER BY cap / weight, rank)),
free AS (SELECT arg_min(level, ord) AS level FROM levels WHERE level * weight <= cap),
targets AS (
  SELECT own, source_size, coalesce(least(cap, (SELECT level FROM free) * weight), cap) AS target FROM levels),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY own ORDER BY length(bin(size)) * 4 + ((size * 8) >> CAST(length(bin(size)) AS BIGINT)) % 4, CAST('0x' || substr(key, 1, 2) AS BIGINT) % 64, size, key, doc_id NULLS LAST) AS place,
         CAST('0x' || substr(md5('mix-1' || own), 1, 5) AS BIGINT) / 1048576.0::DOUBLE AS u
  FROM sized),
rated AS (
  SELECT p.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate
  FROM placed p JOIN targets t USING (own))
SELECT doc_id, size, source_size, target, source,
       CAST(floor(place * rate + u) - floor((place - 1) * rate + u) AS BIGINT) AS copies,
       CAST(floor(place * rate + u) - floor((place - 1) * rate + u) AS BIGINT) * size AS taken
FROM rated
"""
