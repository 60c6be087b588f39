"""The input tables of the genotyping operators, derived from the driver's tables. Every document is both a stretch of a chromosome and a source of reads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import dna
from .operators.windows import assembled, reference_codes, reference_context
from .session import written

READ, STEP, CHROMS = 150, 30, 22
#: Documents are cut into stretches of so many bases before reads are, so that no long text is copied to each of its reads.
STRETCH = 3000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lettered(spark, sf_dir, give, schema: str) -> DataFrame:
    """doc_id, chrom and what give makes of documents' texts (by dna.letters_kept), in Arrow batches: documents are the largest table, and Spark's regular expressions are the slower way."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.slice(k, 512)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), give(*dna.letters_kept(part.column("text")))], names=["doc_id", schema.split()[0]])

    rows = docs.mapInArrow(of, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}")
    return rows.withColumn("chrom", F.concat(F.lit("chr"), (1 + F.col("doc_id") % CHROMS).cast("string")))


def sequences(spark, sf_dir) -> DataFrame:
    """doc_id, seq, chrom."""
    return lettered(spark, sf_dir, lambda bases, edges: pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(bases)), "seq string")


def sizes(spark, sf_dir) -> DataFrame:
    """doc_id, n, chrom: how many bases each document has."""
    return written(lettered(spark, sf_dir, lambda bases, edges: pa.array(np.diff(edges).astype(np.int32)), "n int"), "sizes")


def offsets(rows: DataFrame) -> DataFrame:
    """doc_id, n, chrom, offset of sizes: where each document's bases stand on their chromosome. Offsets are sums over ranges of doc_id, then within a range: no task sums a whole chromosome's documents."""
    rows = rows.withColumn("range", F.floor(F.col("doc_id") / 10_000))
    before = lambda *keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("chrom", "range").agg(F.sum("n").alias("n"))
    ranges = ranges.select("chrom", "range", F.coalesce(F.sum("n").over(before("chrom", order="range")), F.lit(0)).alias("first"))
    within = F.coalesce(F.sum("n").over(before("chrom", "range", order="doc_id")), F.lit(0))
    return rows.withColumn("within", within).join(ranges, ["chrom", "range"]).select("doc_id", "n", "chrom", (F.col("first") + F.col("within")).alias("offset"))


def placed(spark, sf_dir, own: DataFrame | None = None) -> DataFrame:
    """doc_id, seq, chrom, offset of all documents; own is sizes, if the caller has them."""
    at = offsets(sizes(spark, sf_dir) if own is None else own).select("doc_id", "offset")
    return sequences(spark, sf_dir).join(at, "doc_id")


def lengths(own: DataFrame) -> DataFrame:
    """chrom, length, of sizes."""
    return own.groupBy("chrom").agg(F.sum("n").cast("int").alias("length"))


def reference(spark, sf_dir, own: DataFrame | None = None) -> DataFrame:
    """chrom, length, offset, base, piece: chromosomes as overlapping pieces (see operators.windows.chunks), put together from the documents that each touches."""
    own = sizes(spark, sf_dir) if own is None else own
    parts = placed(spark, sf_dir, own).select("chrom", F.col("offset").alias("begin"), "seq")
    return written(assembled(parts, F.broadcast(lengths(own))), "reference")  # a row a chromosome


def cut_reads(rows: DataFrame, least: int) -> DataFrame:
    """rows with o and bases: a read at every STEP-th base and one flush with the end; sequences of fewer than READ bases, but at least `least`, are one read."""
    n = F.length("seq")
    last = F.greatest(n - READ, F.lit(0))
    stretches = F.transform(F.sequence(F.lit(0), last, F.lit(STRETCH)), lambda i: F.struct(i.alias("first"), F.substring(F.col("seq"), i + 1, F.lit(STRETCH + READ)).alias("piece")))
    cut = rows.where(n >= least).withColumn("last", last).withColumn("s", F.explode(stretches)).drop("seq")
    first = F.col("s.first")
    regular = F.sequence(first, F.least(F.col("last"), first + STRETCH - 1), F.lit(STEP))
    offsets = F.when(F.col("last") < first + STRETCH, F.array_union(regular, F.array("last"))).otherwise(regular)
    return cut.withColumn("o", F.explode(offsets)).withColumn("bases", F.substring(F.col("s.piece"), F.col("o") - first + 1, F.lit(READ))).drop("s", "last")


def read_id(doc_id: Column, o: Column) -> Column:
    return doc_id * 1_000_000 + o


def sample_of(o: Column) -> Column:
    return (o / STEP).cast("int") % 2


def reads(spark, sf_dir) -> DataFrame:
    """read_id, sample, seq."""
    return cut_reads(sequences(spark, sf_dir), dna.K).select(read_id(F.col("doc_id"), F.col("o")).alias("read_id"), sample_of(F.col("o")).alias("sample"), F.col("bases").alias("seq"))


def tracks(spark, sf_dir, own: DataFrame | None = None) -> DataFrame:
    """track, chrom, begin, end, svtype, svlen, seq, genotype; one for each part, the first of those in one place. Written once: operators read it several times. They grow with the input, and their files are a
    fraction of what they are in memory: joins with them directly are told to sort, so that they don't go whole through the driver. own is sizes, if the caller has them."""
    own = sizes(spark, sf_dir) if own is None else own
    long = F.broadcast(lengths(own).select("chrom", F.col("length").cast("long").alias("n")))  # a row a chromosome
    by_id = Window.orderBy("item_id")  # of the benchmark, which is a fixed query set
    items = table(spark, sf_dir, "benchmark").where("text IS NOT NULL").select("item_id", dna.to_dna(F.col("text")).alias("insert")).withColumn("k", F.row_number().over(by_id) - 1).drop("item_id")
    many = items.count()
    p = F.col("p_partkey")
    rows = (
        table(spark, sf_dir, "part").select("p_partkey", "p_size")
        .withColumn("chrom", F.concat(F.lit("chr"), (1 + p % CHROMS).cast("string")))
        .join(long, "chrom").where("n > 1200")
        .withColumn("k", p % many).join(items, "k")
        .withColumn("begin", (300 + (p * 7919) % (F.col("n") - 1100)).cast("int"))
        .withColumn("size", (40 + F.col("p_size") * 4).cast("int"))
        .withColumn("svtype", F.element_at(F.array(F.lit("DEL"), F.lit("INS"), F.lit("INV")), (p % 3 + 1).cast("int")))
        .withColumn("end", F.col("begin") + F.when(F.col("svtype") == "INS", 1).otherwise(F.col("size")))
        .withColumn("seq", F.when(F.col("svtype") == "INS", F.substring(F.col("insert"), F.lit(1), F.col("size"))))
        .withColumn("svlen", F.coalesce(F.length("seq"), F.col("size")))
        .withColumn("genotype", F.element_at(F.array(*map(F.lit, ("0/0", "0/1", "1/0", "1/1"))), (p % 4 + 1).cast("int")))
    )
    first = F.min(F.struct("p_partkey", "svlen", "seq", "genotype")).alias("f")
    rows = rows.groupBy("chrom", "begin", "end", "svtype").agg(first)
    named = dna.track_name(F.col("svtype"), F.col("chrom"), F.col("begin"), F.col("end"))
    return written(rows.select(named.alias("track"), "chrom", "begin", "end", "svtype", "f.svlen", "f.seq", "f.genotype", F.col("f.p_partkey").alias("partkey")), "variants").hint("merge")


def sample_genotypes(variants: DataFrame) -> DataFrame:
    """sample, track, genotype of two samples, of tracks."""
    rows = variants.select("track", "partkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("sample"))
    g = F.element_at(F.array(*map(F.lit, ("0/0", "0/1", "1/0", "1/1"))), ((F.col("partkey") + F.col("sample")) % 4 + 1).cast("int"))
    return rows.select("sample", "track", g.alias("genotype"))


def depth_panel(spark, sf_dir, bases: DataFrame | None = None, text: bool = True) -> DataFrame:
    """kmer (packed without text); bases is the reference, if the caller has it."""
    codes = reference_codes(reference(spark, sf_dir) if bases is None else bases, 97)
    return codes.select("code").distinct().select((dna.decode(F.col("code")) if text else F.col("code")).alias("kmer"))


def gc_panel(spark, sf_dir, bases: DataFrame | None = None, text: bool = True) -> DataFrame:
    """kmer (packed without text), gc; bases is the reference, if the caller has it."""
    bases = reference(spark, sf_dir) if bases is None else bases
    return reference_context(bases, 61).groupBy("code").agg(F.min("gc").alias("gc")).select((dna.decode(F.col("code")) if text else F.col("code")).alias("kmer"), "gc")


def alignments(spark, sf_dir, own: DataFrame | None = None) -> DataFrame:
    """sample, read_id, chrom, pos, cigar, read of whole reads at their place; the cigar goes by the read. own is sizes, if the caller has them."""
    rows = cut_reads(placed(spark, sf_dir, own), READ)
    return aligned(rows, F.col("bases").alias("read"))


def alignment_places(own: DataFrame) -> DataFrame:
    """alignments without their reads, of sizes alone: no text is read for them."""
    n = F.col("n")
    last = n - READ
    starts = F.array_union(F.sequence(F.lit(0), last, F.lit(STEP)), F.array(last))
    return aligned(offsets(own).where(n >= READ).withColumn("o", F.explode(starts)))


def aligned(rows: DataFrame, *more: Column) -> DataFrame:
    """sample, read_id, chrom, pos, cigar and more of reads (doc_id, chrom, offset, o)."""
    op = lambda *ops: F.array(*[F.struct(F.lit(o).alias("op"), F.lit(n).alias("len")) for o, n in ops])
    kind = (F.col("doc_id") + (F.col("o") / STEP).cast("int")) % 5
    cigar = (
        F.when(kind == 0, op(("M", 150))).when(kind == 1, op(("S", 60), ("M", 90))).when(kind == 2, op(("M", 90), ("S", 60)))
        .when(kind == 3, op(("S", 20), ("M", 110), ("S", 20))).otherwise(op(("M", 50), ("D", 140), ("M", 100)))
    )
    return rows.select(sample_of(F.col("o")).alias("sample"), read_id(F.col("doc_id"), F.col("o")).alias("read_id"), "chrom", (F.col("offset") + F.col("o")).cast("int").alias("pos"), cigar.alias("cigar"), *more)
