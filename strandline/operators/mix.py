"""k-mers that hold in several samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from . import junction


def called(calls: DataFrame, truth: DataFrame, strict: bool = False) -> DataFrame:
    """track, samples (in how many it was called) of tracks that some sample carries by truth (sample, track, genotype). A ./. call empties its track; with strict, so does a call that
    disagrees with the truth on who carries."""
    carried = truth.where(dna.carries(F.col("genotype"))).select("track").distinct()
    known = truth.select("sample", "track", F.col("genotype").alias("true"))
    rows = calls.join(carried, "track", "left_semi").join(known, ["sample", "track"], "left")
    wrong = F.col("genotype") == "./."
    if strict:
        wrong = wrong | (dna.carries(F.col("genotype")) != dna.carries(F.col("true")))
    return rows.groupBy("track").agg(F.count_distinct("sample").alias("samples"), F.bool_or(wrong).alias("spoiled")).where("NOT spoiled").drop("spoiled")


def intersect(kmers: DataFrame, calls: DataFrame, truth: DataFrame, strict: bool = False) -> DataFrame:
    """track, kmer: k-mers (sample, track, kmer) that every sample in which the track was called (sample, track, genotype) has; see called."""
    have = kmers.join(calls.select("sample", "track"), ["sample", "track"], "left_semi").groupBy("track", "kmer").agg(F.count_distinct("sample").alias("have"))
    return have.join(called(calls, truth, strict), "track").where("have = samples").select("track", "kmer")


def intersect_reads(alignments: DataFrame, tracks: DataFrame, calls: DataFrame, truth: DataFrame, strict: bool = False) -> DataFrame:
    """intersect of the junction k-mers of alignments, which are never shuffled: samples are counted where a track's k-mers are made."""
    wanted = tracks.join(called(calls, truth, strict).withColumnRenamed("samples", "need"), "track")
    flags = calls.select("sample", "track", F.lit(True).alias("present"), F.lit(False).alias("absent"))
    return junction.tallied(alignments, wanted, flags, unknown=False).select("track", dna.decode(F.col("code")).alias("kmer"))


def union_tracks(tracks: DataFrame) -> DataFrame:
    """One row for each (chrom, begin, end, svtype) of tracks (file, line, ...): that of the first file and line."""
    rest = [c for c in tracks.columns if c not in ("chrom", "begin", "end", "svtype", "file", "line")]
    first = F.min_by(F.struct(*rest), F.struct("file", "line")).alias("first")
    return tracks.groupBy("chrom", "begin", "end", "svtype").agg(first).select("chrom", "begin", "end", "svtype", "first.*")
