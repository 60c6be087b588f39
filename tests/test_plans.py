"""The plans over files, from the command line's functions: a panel written and read again gives the same calls, counts can be resumed, samples are mixed."""

import json
import os

import numpy as np
from pyspark.sql import functions as F

from strandline.__main__ import main
from strandline.functions import dna
from strandline.operators.windows import reference_kmers
from strandline.plans.genotype import genotype
from strandline.plans.preprocess import from_bodies, preprocess, to_bodies
from strandline.sources import files


def bases(n, seed):
    return "".join(np.random.default_rng(seed).choice(list("ACGT"), n))


REF = bases(6000, 1)
INSERT = bases(150, 2)


def haplotypes():
    """DEL at 1500 on both, INS at 3500 on one, DEL at 4500 on none."""
    return [REF[:1500] + REF[1700:3501] + INSERT + REF[3501:], REF[:1500] + REF[1700:]]


def lines_of(folder):
    return [line for f in sorted(os.listdir(folder)) if f.startswith("part") for line in open(os.path.join(folder, f))]


def test_files_and_command_line(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    (tmp_path / "ref.fa").write_text(f">chr1\n{REF[:3000]}\n{REF[3000:]}\n")
    (tmp_path / "a.bed").write_text(f"#CHROM BEGIN END SVTYPE SEQ GENOTYPE\nchr1 1500 1700 DEL . 1/1\nchr1 3500 3501 INS {INSERT} 0/1\nchr1 4500 4650 DEL . 0/0\n")
    reads = [h[o : o + 100] for h in haplotypes() for o in range(0, len(h) - 100, 7)]
    (tmp_path / "reads.fa").write_text("".join(f">r{k} x\n{r[:50]}\n{r[50:]}\n" for k, r in enumerate(reads)))
    (tmp_path / "reads.fq").write_text("".join(f"@r{k}\n{r}\n+\n{'I' * 100}\n" for k, r in enumerate(reads)))
    ref = files.read_fasta(spark, at("ref.fa"))
    kept = [r.kmer for r in reference_kmers(ref, 37).where("pos < 1400 OR (pos > 1800 AND pos < 4400) OR pos > 4700").collect()]
    (tmp_path / "gc.json").write_text(json.dumps({k: {"gc": 50} for k in kept}))
    (tmp_path / "depth.json").write_text(json.dumps({k: {} for k in kept}))
    assert sorted(r.seq for r in files.read_reads(spark, at("reads.fa")).collect()) == sorted(reads)

    main(["preprocess", "--reference", at("ref.fa"), "--bed", at("a.bed"), "--workdir", at("pre"), "--files", "3", "--by_track"], spark)
    assert sorted(f for f in os.listdir(at("pre/kmers_by_track")) if f.startswith("track=")) == ["track=DEL@chr1_1500_1700", "track=DEL@chr1_4500_4650", "track=INS@chr1_3500_3501"]
    assert {line.strip() for line in lines_of(at("pre/rejects"))} <= {"kmer\treason", ""}
    parts = [f for f in os.listdir(at("pre/kmers")) if f.startswith("part")]
    objects = [json.load(open(at(f"pre/kmers/{f}"))) for f in parts]  # each file is one JSON object
    panel = preprocess(ref, files.read_bed(spark, at("a.bed")))
    assert sorted(k for o in objects for k in o) == sorted(r.kmer for r in panel.kmers.collect())
    again = from_bodies(files.read_kmers(spark, at("pre/kmers")))
    for x, y, names in ((panel.kmers, again.kmers, "kmer type inverse"), (panel.kmer_tracks, again.kmer_tracks, "kmer track chrom begin end mult"), (panel.kmer_loci, again.kmer_loci, "kmer chrom pos type gc trend")):
        assert sorted(map(tuple, x.select(*names.split()).collect())) == sorted(map(tuple, y.select(*names.split()).collect()))
    # A file that is one line, as other writers have it.
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "kmers.json").write_text(json.dumps({k: v for o in objects for k, v in o.items()}))
    assert files.read_kmers(spark, at("one")).count() == panel.kmers.count()

    want = {("chr1", "1500", "1/1"), ("chr1", "3500", "1/0"), ("chr1", "4500", "0/0")}
    args = ["genotype", "--kmers", at("pre/kmers"), "--gc_kmers", at("gc.json"), "--depth_kmers", at("depth.json"), "--files", "3"]
    main([*args, "--reads", at("reads.fq"), "--workdir", at("run")], spark)
    calls = lambda folder: {(c[0], c[1], c[5]) for c in (line.split() for line in lines_of(folder)) if c[0] != "#CHROM"}
    assert calls(at("run/genotypes")) == want
    assert {line.split()[0] for line in lines_of(at("run/genotypes")) if line.startswith("#")} == {"#CHROM"}
    # Resumed from its counts, even without the panel's reads.
    os.makedirs(at("resumed"))
    os.rename(at("run/counts"), at("resumed/counts"))
    main([*args, "--reads", at("reads.fa"), "--workdir", at("resumed"), "--reduce"], spark)
    assert calls(at("resumed/genotypes")) == want

    main(["mix", "--samples", "a", "b", "--kmers", at("pre/kmers"), at("pre/kmers"), "--calls", at("a.bed"), at("a.bed"), "--bed", at("a.bed"), at("a.bed"), "--workdir", at("mixed")], spark)
    mixed = {tuple(line.split()) for line in lines_of(at("mixed/mix")) if not line.startswith("track")}
    carried = {"DEL@chr1_1500_1700", "INS@chr1_3500_3501"}
    assert mixed == {(r.track, r.kmer) for r in panel.kmer_tracks.collect() if r.track in carried}
    assert sorted(r.kmer for r in files.read_kmers(spark, at("mixed/mix_kmers")).collect()) == sorted({k for _, k in mixed})


def test_counts_of_a_panel_give_the_same_calls(spark):
    ref = spark.createDataFrame([("chr1", REF)], "chrom string, seq string")
    tracks = spark.createDataFrame([("DEL@chr1_1500_1700", "chr1", 1500, 1700, "DEL", 200, None)], "track string, chrom string, begin int, end int, svtype string, svlen int, seq string")
    panel = preprocess(ref, tracks)
    reads = spark.createDataFrame([(k, h[o : o + 100]) for k, h in enumerate(haplotypes()) for o in range(0, len(h) - 100, 7)], "read_id long, seq string")
    depth = reference_kmers(ref, 37).where("pos < 1400").select("kmer")
    gc = depth.selectExpr("kmer", "50 AS gc")
    same = genotype(from_bodies(to_bodies(panel)), reads, depth, gc)
    assert [tuple(r) for r in genotype(panel, reads, depth, gc).collect()] == [tuple(r) for r in same.collect()] == [("DEL@chr1_1500_1700", 1.0, "1/1")]


def test_names(spark):
    names = ["DEL@chr1_10_20", "INS@chrX_5_6", "chr2_7_9"]
    got = [tuple(r.p) for r in spark.createDataFrame([(n,) for n in names], "n string").select(dna.parse_track_name(F.col("n")).alias("p")).collect()]
    assert got == [("DEL", "chr1", 10, 20), ("INS", "chrX", 5, 6), ("INV", "chr2", 7, 9)]
    assert spark.range(1).select(dna.normal_genotype(F.lit("1/0")).alias("g")).first().g == "0/1"
