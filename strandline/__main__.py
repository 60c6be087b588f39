"""python -m strandline preprocess | genotype | mix: the plans over files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import dna
from .operators import counting
from .operators.mix import union_tracks
from .plans import genotype, mix, preprocess
from .session import written
from .sources import files, sinks


def options(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser("strandline")
    tasks = parser.add_subparsers(dest="task", required=True)
    pre = tasks.add_parser("preprocess", help="k-mers of tracks")
    pre.add_argument("--reference", required=True)
    pre.add_argument("--bed", nargs="+", required=True, help="track lists; with --alignments one for each sample, with its genotypes")
    pre.add_argument("--alignments", nargs="*", default=[], help="BAM or SAM text for each sample")
    pre.add_argument("--by_track", action="store_true", help="also a folder of k-mers for each track")
    gen = tasks.add_parser("genotype", help="calls from reads")
    gen.add_argument("--kmers", required=True)
    gen.add_argument("--reads", nargs="+", required=True)
    gen.add_argument("--gc_kmers", required=True)
    gen.add_argument("--depth_kmers", required=True)
    gen.add_argument("--bed", help="known genotypes")
    gen.add_argument("--select", action="store_true", help="keep k-mers that agree with the known genotypes")
    gen.add_argument("--unique", action="store_true")
    gen.add_argument("--lp", action="store_true", help="solve clusters of several tracks")
    gen.add_argument("--export", action="store_true", help="with --lp, also the programs of clusters of several tracks as text")
    gen.add_argument("--reduce", action="store_true", help="take the counts that an earlier run left in workdir")
    both = tasks.add_parser("mix", help="k-mers that all samples have")
    for name in ("--samples", "--kmers", "--calls", "--bed"):
        both.add_argument(name, nargs="+", required=True)
    both.add_argument("--strict", action="store_true")
    for p in (pre, gen, both):
        p.add_argument("--workdir", required=True)
        p.add_argument("--files", type=int, default=100)
    return parser.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    o = options(argv)
    spark = spark or SparkSession.builder.appName("strandline").getOrCreate()
    if o.task == "preprocess":
        reference = written(files.read_reference(spark, o.reference), "reference")
        listed = written(files.read_bed(spark, *o.bed), "tracks")
        tracks = union_tracks(listed)
        if o.alignments:
            parts = [files.read_alignments(spark, path, sample=str(k)) for k, path in enumerate(o.alignments)]
            aligned = parts[0]
            for p in parts[1:]:
                aligned = aligned.unionByName(p)
            known = listed.select(F.col("file").cast("string").alias("sample"), "track", "genotype")
            panel = preprocess.preprocess(reference, tracks, aligned, known)
        else:
            panel = preprocess.preprocess(reference, tracks)
        bodies = written(preprocess.to_bodies(panel), "bodies")
        files.write_kmers(bodies, f"{o.workdir}/kmers", o.files)
        panel.rejects.write.csv(f"{o.workdir}/rejects", sep="\t", header=True)
        if o.by_track:
            sinks.write_kmers_by(bodies.select("kmer", "body", F.explode(F.map_keys("body.tracks")).alias("track")), f"{o.workdir}/kmers_by_track")
    elif o.task == "genotype":
        panel = preprocess.from_bodies(written(files.read_kmers(spark, o.kmers), "bodies"))
        reads = [files.read_reads(spark, path).select("read_id", "seq") for path in o.reads]
        seqs = reads[0]
        for r in reads[1:]:
            seqs = seqs.unionByName(r)
        if not o.reduce:
            files.write_counts(counting.count_masked(seqs, genotype.masks_of(panel)), f"{o.workdir}/counts", o.files)
        counts = files.read_counts(spark, f"{o.workdir}/counts")
        known = files.read_bed(spark, o.bed).select("track", "genotype") if o.select and o.bed else None
        depth, gc = files.read_panel(spark, o.depth_kmers).select("kmer"), files.read_panel(spark, o.gc_kmers)
        calls = genotype.genotype(panel, seqs, depth, gc, known=known, cluster_solver="lp" if o.lp else "none", unique=o.unique, counts=counts, programs=f"{o.workdir}/programs" if o.export else None)
        places = panel.kmer_tracks.select("track").distinct().withColumn("p", dna.parse_track_name(F.col("track")))
        files.write_calls(calls.join(places, "track").select("p.chrom", "p.begin", "p.end", "p.svtype", "lp", "genotype"), f"{o.workdir}/genotypes")
    else:
        by = lambda paths: dict(zip(o.samples, paths, strict=True))
        mixed = written(mix.run(spark, by(o.kmers), by(o.calls), by(o.bed), o.strict), "mixed")
        mixed.write.csv(f"{o.workdir}/mix", sep="\t", header=True)
        files.write_kmers(mix.bodies(spark, by(o.kmers), mixed), f"{o.workdir}/mix_kmers", o.files)


if __name__ == "__main__":
    main()
