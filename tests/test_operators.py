"""Operators on planted cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import dna
from strandline.operators import clusters, counting, depth, inner, junction, likelihood, locate, mix, selection
from strandline.operators.components import components
from strandline.operators.windows import gc_of_reference, reference_kmers, with_context
from strandline.plans.genotype import genotype
from strandline.plans.preprocess import preprocess
from strandline.sources import files

RC = str.maketrans("ACGT", "TGCA")


def canon(k):
    return min(k, k.translate(RC)[::-1])


def bases(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def test_packed_form_and_complement(spark):
    rows = spark.createDataFrame([("G" * 32,), ("T" + "A" * 31,), (bases(32, 1),)], "k string")
    out = rows.select("k", dna.encode(F.col("k")).alias("e"), dna.decode(dna.encode(F.col("k"))).alias("d"), dna.canonical(F.col("k")).alias("c")).collect()
    assert [r.e for r in out[:2]] == [-1, -9223372036854775808]
    assert all(r.d == r.k and r.c == canon(r.k) for r in out)


def test_subsequence(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(40):
        mask, flank = "".join(rng.choice("AC") for _ in range(32)), "".join(rng.choice("AC") for _ in range(32))
        rows.append((mask, mask[1:] + "A" if rng.random() < 0.5 else flank))

    def fits(x, y):
        j = 4
        for c in y:
            j += j < 28 and x[j] == c
        return j == 28

    out = spark.createDataFrame(rows, "m string, f string").select("m", "f", dna.is_subsequence(F.col("m"), F.col("f")).alias("x")).collect()
    assert [r.x for r in out] == [fits(r.m, r.f) for r in out] and len({r.x for r in out}) == 2


def test_reference_windows_cross_chunks(spark):
    seq = bases(3000, 2)
    ref = spark.createDataFrame([("chr1", seq), ("chr2", "ACGT")], "chrom string, seq string")
    rows = with_context(reference_kmers(ref), ref).orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(234, 2500))
    for r in rows:
        window = seq[r.pos - 234 : r.pos + 266]
        assert (r.kmer, r.left, r.right, r.gc) == (canon(seq[r.pos : r.pos + 32]), seq[r.pos - 32 : r.pos], seq[r.pos + 32 : r.pos + 64], (window.count("C") + window.count("G")) // 5)
    rolled = {r.pos: r.gc for r in gc_of_reference(ref).collect()}
    assert rolled == {r.pos: r.gc for r in rows}


def test_counting(spark):
    reads = spark.createDataFrame([(1, bases(60, 4)), (2, bases(60, 4).translate(RC)[::-1]), (3, "ACGTN")], "read_id long, seq string")
    out = {r.kmer: r.total for r in counting.count_all(reads).collect()}
    want = {}
    for s in range(29):
        k = canon(bases(60, 4)[s : s + 32])
        want[k] = want.get(k, 0) + 2
    assert out == want
    panel = spark.createDataFrame([(next(iter(want)),), ("A" * 32,)], "kmer string")
    assert {r.kmer: r.total for r in counting.count_panel(reads, panel).collect()} == {next(iter(want)): 2, "A" * 32: 0}


def test_depth_settles():
    assert depth.settle({10: 50, 11: 50, 1000: 1}) == (10, pytest.approx(np.sqrt(50 / 100)), 2)
    with pytest.raises(ValueError):
        depth.settle({})


@pytest.mark.parametrize(("n", "want"), [(94, 0), (95, 1), (96, 1), (150, 55)])
def test_insertion_body_size(spark, n, want):
    ref = spark.createDataFrame([("chr1", bases(3000, 5))], "chrom string, seq string")
    track = spark.createDataFrame([("INS@chr1_1000_1001", "chr1", 1000, 1001, "INS", n, bases(n, 6), "1/1")], "track string, chrom string, begin int, end int, svtype string, svlen int, seq string, genotype string")
    assert inner.bodies(track, ref).count() == want


def test_clips_and_components(spark):
    rows = spark.createDataFrame([([("S", 60), ("M", 90)], 140), ([("M", 50), ("D", 130), ("S", 20)], 140)], "cigar array<struct<op:string,len:int>>, svlen int")
    out = [[(c.begin, c.end, c.soft, c.first) for c in r.c] for r in rows.select(junction.clips(F.col("cigar"), F.col("svlen")).alias("c")).collect()]
    assert out == [[(0, 60, True, True)], [(50, 180, False, False), (180, 200, True, False)]]
    links = spark.createDataFrame([(k, k + 1) for k in range(30) if k % 10 != 9] + [(100, 5)], "a long, b long")
    assert {r.v: r.root for r in components(links).collect()} == {k: k // 10 * 10 for k in range(30)} | {100: 0}


def test_least_deviation_against_grid():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 5):
        a, b = rng.integers(-3, 4, (6, n)).astype(float), rng.integers(0, 4, 6).astype(float)
        x = clusters.least_deviation(a, b)
        grid = min(np.abs(a @ np.array(g) - b).sum() for g in itertools.product(np.linspace(0, 1, 11 if n < 4 else 5), repeat=n))
        assert ((x >= 0) & (x <= 1)).all()
        if n <= 3:
            assert np.abs(a @ x - b).sum() <= grid + 1e-9


def test_selection_and_mix(spark):
    tracks = spark.createDataFrame([("k1", "t1", 1), ("k2", "t1", 1), ("k2", "t2", 1), ("k3", "t1", 1), ("k3", "t3", 1), ("k4", "t3", 2)], "kmer string, track string, mult int")
    assert {r.kmer for r in selection.without_needless(tracks).collect()} == {"k1", "k2", "k4"}
    kmers = spark.createDataFrame([(0, "t1", "a"), (1, "t1", "a"), (0, "t1", "b"), (0, "t2", "c"), (1, "t2", "c")], "sample int, track string, kmer string")
    calls = spark.createDataFrame([(0, "t1", "0/1"), (1, "t1", "1/1"), (0, "t2", "./."), (1, "t2", "1/1")], "sample int, track string, genotype string")
    assert [tuple(r) for r in mix.intersect(kmers, calls, calls).collect()] == [("t1", "a")]


def test_junction_verdicts(spark):
    rows = [("a", None, "x", "JUNCTION", "active"), ("a", "l", "r", "REF", "filtered"), ("b", None, "x", "JUNCTION", "active"), ("b", "l", "r", "REF", "filtered"), ("b", "l", "r", "REF", "active"), ("c", "l", "x", "JUNCTION", "active"), ("c", "l", "r", "REF", "filtered")]
    out = locate.decide(spark.createDataFrame(rows, "kmer string, left string, right string, type string, state string"))
    assert {r.kmer: r.verdict for r in out.collect()} == {"a": "inverse", "b": "drop", "c": "keep"}


def test_argmax_keeps_its_habit(spark):
    tracks = spark.createDataFrame([("k1", "t1"), ("k2", "t2")], "kmer string, track string")
    lls = spark.createDataFrame([("k1", 0, 5.0), ("k1", 1, 1.0), ("k1", 2, -9.0), ("k2", 0, -5.0), ("k2", 1, -1.0), ("k2", 2, -9.0)], "kmer string, combo int, ll double")
    own = spark.createDataFrame([("t1", "t1"), ("t2", "t2")], "track string, cluster string")
    assert {r.track: r.genotype for r in likelihood.call(lls, tracks, own).collect()} == {"t1": "1/1", "t2": "1/0"}
    assert {r.track: r.genotype for r in likelihood.call(lls, tracks, own, compat_argmax=False).collect()} == {"t1": "0/0", "t2": "1/0"}


def test_planted_genotypes(spark):
    ref = bases(6000, 7)
    insert = bases(150, 8)
    carry = {"hom": (True, True), "het": (True, False)}
    tracks = [("DEL@chr1_1500_1700", "chr1", 1500, 1700, "DEL", 200, None, "1/1"), ("INS@chr1_3500_3501", "chr1", 3500, 3501, "INS", 150, insert, "0/1"), ("DEL@chr1_4500_4650", "chr1", 4500, 4650, "DEL", 150, None, "0/0")]
    haps = []
    for h in (0, 1):
        s = ref[:3500] + (insert if carry["het"][h] else "") + ref[3500:]
        haps.append(s[:1500] + s[1700:])
    reads = [(f * 10**6 + h * 10**5 + o, s[o : o + 100]) for f in range(1) for h, s in enumerate(haps) for o in range(0, len(s) - 100, 7)]
    ref_df = spark.createDataFrame([("chr1", ref)], "chrom string, seq string")
    track_df = spark.createDataFrame(tracks, "track string, chrom string, begin int, end int, svtype string, svlen int, seq string, genotype string")
    reads_df = spark.createDataFrame(reads, "read_id long, seq string")
    kept = reference_kmers(ref_df, 37).where("pos < 1400 OR (pos > 1800 AND pos < 4400) OR pos > 4700").select("kmer", F.lit(50).alias("gc"))
    calls = {r.track: r.genotype for r in genotype(preprocess(ref_df, track_df), reads_df, kept.select("kmer"), kept).collect()}
    assert calls == {"DEL@chr1_1500_1700": "1/1", "INS@chr1_3500_3501": "1/0", "DEL@chr1_4500_4650": "0/0"}


def test_files(spark, tmp_path):
    bed = tmp_path / "a.bed"
    bed.write_text("#CHROM BEGIN END SVTYPE SEQ GENOTYPE\n1 10 20 DEL . 0/1\nchr2 5 6 INS ACGTA 1/1\n")
    rows = files.read_bed(spark, str(bed)).orderBy("begin").collect()
    assert [(r.track, r.svlen, r.genotype) for r in rows] == [("INS@chr2_5_6", 5, "1/1"), ("DEL@chr1_10_20", 10, "0/1")]
    fasta = tmp_path / "a.fa"
    fasta.write_text(">chr1\nacgt\nAC\n>chrM\nAAA\n>2\nGG\n>chr3 described\nTT\n")
    assert {(r.chrom, r.seq) for r in files.read_fasta(spark, str(fasta)).collect()} == {("chr1", "ACGTAC"), ("chr2", "GG")}
    fastq = tmp_path / "a.fq"
    fastq.write_text("".join(f"@r{i}\n{'ACGT' * (i + 1)}\n+\n@{'I' * (4 * i + 3)}\n" for i in range(5)))
    assert sorted(len(r.seq) for r in files.read_fastq(spark, str(fastq)).collect()) == [4, 8, 12, 16, 20]
    counts = spark.createDataFrame([("A" * 32, 3, 4)], "kmer string, count long, total long")
    files.write_counts(counts, str(tmp_path / "counts"), 2)
    assert [tuple(r) for r in files.read_counts(spark, str(tmp_path / "counts")).collect()] == [("A" * 32, 3, 4)]
    sam = tmp_path / "a.sam"
    sam.write_text("@HD\tVN:1\nr1\t0\tchr1\t11\t60\t3S5M\t*\t0\t0\tACGTACGT\tIIIIIIII\n")
    r = files.read_sam(spark, str(sam)).first()
    assert (r.chrom, r.pos, [(c.op, c.len) for c in r.cigar], r.read) == ("chr1", 10, [("S", 3), ("M", 5)], "ACGTACGT")
    panel = tmp_path / "p.json"
    panel.write_text('{"' + "G" * 32 + '": {"gc": 40}}')
    assert [tuple(r) for r in files.read_panel(spark, str(panel)).collect()] == [("C" * 32, 40)]


def test_stream_equals_batch(spark, tmp_path):
    from strandline.streaming import counts as stream

    reads = spark.createDataFrame([(1, bases(60, 4)), (2, bases(60, 9))], "read_id long, seq string")
    reads.repartition(2).write.parquet(str(tmp_path / "in"))
    panel = counting.count_all(reads).select("kmer")
    query = stream.count_panel(stream.stream_reads(spark, str(tmp_path / "in")), panel).writeStream.outputMode("complete").format("memory").queryName("seen").start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("seen").collect()} == {tuple(r) for r in counting.count_panel(reads, panel).collect()}
