"""Files: track lists, sequences, reads, panels, counts, k-mers, calls."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dna
from ..operators.windows import assembled
from . import bam, entries

GENOTYPES = ("0/0", "0/1", "1/0", "1/1")
#: Numbers of k-mer and locus types in k-mer files.
TYPES = {"JUNCTION": 0, "INNER": 1, "REF": 2}
LOCUS = "struct<chrom:string,position:int,masks:map<string,int>,type:int,gc:int,trend:boolean>"
BODY = (
    f"struct<count:bigint,reference:int,loci:array<{LOCUS}>,junction_loci:array<{LOCUS}>,filtered_loci:array<{LOCUS}>,total:bigint,tracks:map<string,int>,"
    "inverse:boolean,trend:boolean,gc:int,type:int,weight:double>"
)


def read_bed(spark: SparkSession, *paths: str, strict_genotypes: bool = True) -> DataFrame:
    """file, line, chrom, begin, end, svtype, svlen, seq, genotype of track lists.

    The first line is a header that begins with #; the first three columns stand by place, SEQ, GENOTYPE, SVTYPE and SVLEN by name. A missing type is DEL;
    a missing length is that of SEQ for INS, else end - begin. With strict_genotypes an unusual genotype ends the run.
    """
    out = None
    for n, path in enumerate(paths):
        head = spark.read.text(path).first()
        if head is None or not head[0].startswith("#"):
            raise ValueError(f"{path} has no header")
        names = [c.upper() for c in head[0].lstrip("#").split()]
        rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("c"), F.monotonically_increasing_id().alias("line")).where(~F.startswith(F.col("c")[0], F.lit("#")) & (F.size("c") >= 3))
        cell = lambda name, names=names: F.get(F.col("c"), F.lit(names.index(name))) if name in names else F.lit(None).cast("string")
        chrom = F.when(F.startswith(F.col("c")[0], F.lit("chr")), F.col("c")[0]).otherwise(F.concat(F.lit("chr"), F.col("c")[0]))
        begin, end = F.col("c")[1].cast("int"), F.col("c")[2].cast("int")
        kind = F.coalesce(cell("SVTYPE"), F.lit("DEL"))
        kind = F.when(kind.isin("DEL", "INS"), kind).otherwise("INV")
        svlen = F.coalesce(F.abs(cell("SVLEN").cast("int")), F.when((kind == "INS") & cell("SEQ").isNotNull(), F.length(cell("SEQ"))).otherwise(end - begin))
        genotype = cell("GENOTYPE")
        if strict_genotypes and "GENOTYPE" in names:
            genotype = F.when(genotype.isin(*GENOTYPES), genotype).otherwise(F.raise_error(F.concat(F.lit("genotype "), F.coalesce(genotype, F.lit("missing")))).cast("string"))
        rows = rows.select(F.lit(n).alias("file"), "line", chrom.alias("chrom"), begin.alias("begin"), end.alias("end"), kind.alias("svtype"), svlen.alias("svlen"), cell("SEQ").alias("seq"), genotype.alias("genotype"))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("track", dna.track_name(F.col("svtype"), F.col("chrom"), F.col("begin"), F.col("end")))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """chrom, seq of the chromosomes 1 to 22, X and Y, with or without chr; headers with a description are left out."""
    parts = spark.read.option("lineSep", ">").text(path).where("value <> ''")
    name = F.regexp_extract("value", r"^([^\n]*)", 1)
    seq = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", ""))
    plain = F.regexp_replace(F.trim(name), "^chr", "")
    return parts.where(name.rlike(r"^(chr)?([1-9]|1\d|2[0-2]|X|Y)\r?$")).select(F.concat(F.lit("chr"), F.regexp_replace(plain, r"\r", "")).alias("chrom"), seq.alias("seq"))


#: Chromosomes that are read, with or without chr before them.
CHROMOSOME = re.compile(r"(?:chr)?([1-9]|1\d|2[0-2]|X|Y)")
#: Bases of a part of a chromosome that a task gives out at once.
PART = 1 << 16


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """chrom, length, offset, base, piece of the chromosomes 1 to 22, X and Y of FASTA files, as operators.windows.chunks has them. Files are cut anywhere: a split first counts the bases after
    each of its headers, sums over the splits before say where they stand (a row a split and header), then each split's bases are given out in parts with their place."""
    lines = entries.splits(spark, path)

    def runs(batches: Iterator[pa.RecordBatch], parts: bool, starts: dict | None = None) -> Iterator[pa.RecordBatch]:
        """A row for each run of bases after a header or a split's begin: its name (null at a split's begin) and number of bases; with parts, the bases themselves in parts, by starts."""
        now, nth, name, count, held = None, 0, None, 0, []
        out: list[tuple] = []

        def told(last: bool) -> None:
            nonlocal count, held
            if parts and held:
                place = starts.get((*now, nth))
                if place is not None:
                    out.append((place[0], place[1] + count - sum(map(len, held)), "".join(held)))
                held = []
            if last and not parts and now is not None:
                out.append((*now, nth, name, count))

        def flush() -> pa.RecordBatch:
            kinds = [("chrom", pa.string()), ("begin", pa.int64()), ("seq", pa.string())] if parts else [("file", pa.string()), ("block", pa.int64()), ("nth", pa.int32()), ("name", pa.string()), ("n", pa.int64())]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), kinds, strict=True)], names=[k for k, _ in kinds])
            out.clear()
            return batch

        for batch in batches:
            for file, block, value in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value")), strict=True):
                if (file, block) != now or value.startswith(">"):
                    told(True)
                    if (file, block) != now:
                        now, nth, name = (file, block), 0, None
                    if value.startswith(">"):
                        nth, name = nth + 1, value[1:].rstrip("\r")
                    count = 0
                    if value.startswith(">"):
                        continue
                bases = "".join(value.split()).upper()
                count += len(bases)
                if parts:
                    held.append(bases)
                    if sum(map(len, held)) >= PART:
                        told(False)
            if out:
                yield flush()
        told(True)
        if out:
            yield flush()

    found = lines.mapInArrow(lambda batches: runs(batches, False), "file string, block long, nth int, name string, n long").collect()  # a row a split and header
    starts, name, at = {}, None, 0
    lengths: dict[str, int] = {}
    for r in sorted(found, key=lambda r: (r["file"], r["block"], r["nth"])):
        if r["name"] is not None or r["block"] == 0 and r["nth"] == 0:
            name, at = r["name"], 0
        kept = CHROMOSOME.fullmatch(name or "")
        if kept:
            chrom = f"chr{kept[1]}"
            if r["name"] is not None and chrom in lengths:
                raise ValueError(f"{chrom} stands twice in {path}")
            starts[r["file"], r["block"], r["nth"]] = chrom, at
            at += r["n"]
            lengths[chrom] = at
    sizes = spark.createDataFrame(list(lengths.items()), "chrom string, length int")
    return assembled(lines.mapInArrow(lambda batches: runs(batches, True, starts), "chrom string, begin long, seq string"), F.broadcast(sizes))  # 24 rows


def read_fastq(spark: SparkSession, *paths: str, partitions: int | None = None) -> DataFrame:
    """read_id, seq of FASTQ files of four lines a read (gzip too: one task a file, then dealt into `partitions`).

    Spark keeps a file's lines in order within a split; a line's number in its file comes from the counts of the splits before, so files are cut anywhere.
    """
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), "value")
    sizes = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("nth").alias("base"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.join(F.broadcast(sizes.withColumn("before", before).drop("n")), ["file", "block"]).withColumn("line", F.col("before") + F.col("nth") - F.col("base"))
    reads = placed.where("line % 4 = 1").select(F.xxhash64("file", "line").alias("read_id"), F.upper(F.trim("value")).alias("seq"))
    return reads.repartition(partitions) if partitions else reads


def read_fasta_reads(spark: SparkSession, *paths: str) -> DataFrame:
    """read_id, seq of reads in FASTA files, of any names and of one or several lines each."""
    rows = spark.read.option("lineSep", ">").text(list(paths)).where("trim(value) <> ''").select(F.col("_metadata.file_path").alias("file"), "value")
    seq = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", ""))
    return rows.select(F.xxhash64("file", "value").alias("read_id"), seq.alias("seq")).where("seq <> ''")


def read_sam(spark: SparkSession, *paths: str, sample: str = "") -> DataFrame:
    """sample, read_id, chrom, pos (from 0), cigar, read of SAM text."""
    rows = spark.read.text(list(paths)).where(~F.startswith("value", F.lit("@"))).select(F.split("value", "\t").alias("c"))
    ops = F.transform(F.regexp_extract_all(F.col("c")[5], F.lit(r"(\d+[MIDNSHP=X])"), 1), lambda o: F.struct(F.substring(o, -1, 1).alias("op"), F.regexp_extract(o, r"^(\d+)", 1).cast("int").alias("len")))
    return rows.select(F.lit(sample).alias("sample"), F.xxhash64("c").alias("read_id"), F.col("c")[2].alias("chrom"), (F.col("c")[3].cast("int") - 1).alias("pos"), ops.alias("cigar"), F.upper(F.col("c")[9]).alias("read"))


def read_reads(spark: SparkSession, path: str) -> DataFrame:
    """read_id, seq by the path's ending: .parquet, .sam, .bam, .fa and .fasta (.gz too), else FASTQ."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".sam"):
        return read_sam(spark, path).select("read_id", F.col("read").alias("seq"))
    if path.removesuffix(".gz").endswith((".fa", ".fasta")):
        return read_fasta_reads(spark, path)
    if path.endswith((".bam", ".cram")):
        return read_alignments(spark, path).select("read_id", F.col("read").alias("seq"))
    return read_fastq(spark, path)


def read_alignments(spark: SparkSession, path: str, sample: str = "") -> DataFrame:
    """sample, read_id, chrom, pos, cigar, read by the path's ending: .bam, else SAM text. CRAM, whose reads are differences from a reference that it doesn't hold, is to be converted first."""
    if path.endswith(".cram"):
        raise ValueError(f"{path}: convert CRAM to BAM first")
    return bam.read_bam(spark, path, sample=sample) if path.endswith(".bam") else read_sam(spark, path, sample=sample)


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """kmer (canonical), gc of a JSON object by k-mer; gc is null in a depth panel."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", T.MapType(T.StringType(), T.StringType()))).alias("kmer", "body"))
    return rows.select(dna.canonical(F.col("kmer")).alias("kmer"), F.get_json_object("body", "$.gc").cast("int").alias("gc")).groupBy("kmer").agg(F.min("gc").alias("gc"))


def read_counts(spark: SparkSession, *paths: str) -> DataFrame:
    """kmer (canonical), count, total of lines KMER:count:total of either strand."""
    rows = spark.read.schema("kmer string, count long, total long").csv(list(paths), sep=":")
    return rows.groupBy(dna.canonical(F.col("kmer")).alias("kmer")).agg(F.sum("count").alias("count"), F.sum("total").alias("total"))


def write_counts(counts: DataFrame, path: str, files: int = 100) -> None:
    """Lines KMER:count:total."""
    counts.select("kmer", "count", "total").repartition(files).write.csv(path, sep=":")


def write_kmers(kmers: DataFrame, path: str, files: int = 100) -> None:
    """kmer, body (BODY) as `files` files of one JSON object each, {kmer: body, ...}, with an entry a line: written as rows come, however many there are."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "{"
        for batch in batches:
            out = []
            for kmer, body in zip(batch.column("kmer").to_pylist(), batch.column("body").to_pylist(), strict=True):
                out.append(f'{lead}"{kmer}": {body}')
                lead = ","
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["}" if lead == "," else "{}"], pa.string())], names=["value"])

    rows = kmers.select("kmer", F.to_json("body", {"ignoreNullFields": "false"}).alias("body"))
    rows.repartition(files, "kmer").mapInArrow(lines, "value string").write.text(path)


def kmer_entries(spark: SparkSession, *paths: str) -> DataFrame:
    """file, kmer, body, text, reason of k-mer files in any layout: an entry a line as write_kmers has them, indented over many lines, or a whole object in one. Files are read in splits.
    Where an entry can't be read, reason says why, and text is what stands there."""
    found = entries.entries(entries.cut(entries.splits(spark, *paths)))
    parsed = found.withColumn("e", F.get(F.map_entries(F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), f"map<string,{BODY}>")), F.lit(0)))
    body = F.col("e.value")
    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("e.key").isNull() | body.isNull(), "not JSON, or of other types")
        .when(~F.col("e.key").rlike(f"^[ACGT]{{{dna.K}}}$"), "the name is no k-mer")
        .when(body["loci"].isNull() | body["tracks"].isNull() | body["type"].isNull(), "loci, tracks or type missing")
    )
    return parsed.select("file", F.col("e.key").alias("kmer"), body.alias("body"), "text", reason.alias("reason"))


def read_kmers(spark: SparkSession, *paths: str, strict: bool = True) -> DataFrame:
    """kmer, body of k-mer files in any layout. With strict, the first entry that can't be read ends the run and is named; else such entries are left out (kmer_entries has them)."""
    rows = kmer_entries(spark, *paths)
    if strict:
        wrong = F.raise_error(F.concat(F.col("file"), F.lit(": "), F.col("reason"), F.lit(": "), F.substring("text", 1, 200)))
        return rows.where(F.when(F.col("reason").isNull(), F.lit(True)).otherwise(wrong.cast("boolean"))).select("kmer", "body")
    return rows.where("reason IS NULL").select("kmer", "body")


def write_calls(calls: DataFrame, path: str) -> None:
    """#CHROM BEGIN END SVTYPE LP GENOTYPE, split by tabs."""
    names = ["#CHROM", "BEGIN", "END", "SVTYPE", "LP", "GENOTYPE"]
    calls.select("chrom", "begin", "end", "svtype", "lp", "genotype").toDF(*names).write.option("comment", "\u0000").csv(path, sep="\t", header=True)
