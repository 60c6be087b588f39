"""k-mers that hold in several samples, from each sample's panel and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna
from ..operators import mix
from ..sources import files
from .preprocess import from_bodies


def sample_calls(spark: SparkSession, calls: dict[str, str]) -> DataFrame:
    """sample, track, genotype of a track list with genotypes for each sample; 1/0 is told as 0/1."""
    parts = [files.read_bed(spark, path).select(F.lit(name).alias("sample"), "track", dna.normal_genotype(F.col("genotype")).alias("genotype")) for name, path in calls.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sample_kmers(spark: SparkSession, kmers: dict[str, str]) -> DataFrame:
    """sample, track, kmer of each sample's k-mer files."""
    parts = [from_bodies(files.read_kmers(spark, path)).kmer_tracks.select(F.lit(name).alias("sample"), "track", "kmer") for name, path in kmers.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bodies(spark: SparkSession, kmers: dict[str, str], mixed: DataFrame) -> DataFrame:
    """kmer, body of mixed (track, kmer), each k-mer once however many tracks have it: as the first sample, in the order of kmers, has it at one of these tracks."""
    parts = [files.read_kmers(spark, path).select(F.lit(nth).alias("nth"), "kmer", "body") for nth, path in enumerate(kmers.values())]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    at = rows.select("nth", "kmer", F.explode(F.map_keys("body.tracks")).alias("track")).join(mixed, ["track", "kmer"], "left_semi").groupBy("kmer").agg(F.min("nth").alias("nth"))
    return rows.join(at, ["kmer", "nth"], "left_semi").groupBy("kmer").agg(F.min_by("body", F.to_json("body")).alias("body"))


def run(spark: SparkSession, kmers: dict[str, str], calls: dict[str, str], truth: dict[str, str], strict: bool = False) -> DataFrame:
    """track, kmer that every sample in which the track was called has (see operators.mix.intersect). All paths are by sample."""
    return mix.intersect(sample_kmers(spark, kmers), sample_calls(spark, calls), sample_calls(spark, truth), strict)
