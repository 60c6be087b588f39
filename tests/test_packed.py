"""Packed k-mers are decoded and compared by arrays, not letter by letter in SQL."""

import random

from pyspark.sql import functions as F

from strandline import queries
from strandline.functions import dna
from strandline.functions.masks import packed_fits, within
from strandline.operators import counting


def test_decode_is_the_inverse_of_encode(spark):
    rng = random.Random(3)
    kmers = ["".join(rng.choice("ACGT") for _ in range(32)) for _ in range(300)] + ["A" * 32, "G" * 32, "T" * 32, None]
    rows = spark.createDataFrame([(k,) for k in kmers], "kmer string").select("kmer", dna.decode(dna.encode(F.col("kmer"))).alias("back")).collect()
    assert len(rows) == len(kmers) and all(r.kmer == r.back for r in rows)


def test_shifted_masks_equal_the_strings(spark):
    rng = random.Random(4)
    kmers = ["".join(rng.choice("AC" if k % 3 else "ACGT") for _ in range(32)) for k in range(200)] + ["A" * 32, "ACGT" * 8]
    df = spark.createDataFrame([(k, o) for k, o in zip(kmers, kmers[-3:] + kmers[:-3])] + [(k, k) for k in kmers], "left string, other string")
    plain = dna.is_subsequence(F.col("other"), F.concat(F.substring("left", 2, 31), F.lit("A")))
    packed = packed_fits(dna.encode(F.col("other")), F.shiftleft(dna.encode(F.col("left")), 2), within)
    rows = df.select(plain.alias("a"), packed.alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and {r.a for r in rows} == {True, False}


def test_plans_have_no_step_for_each_base(spark):
    """The gapped subsequence was folded over letters by SQL, and every counted k-mer was made by conv."""
    sf = "/root/testdata/sf0.001"
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "aggregate(" not in plan(queries.subsequence_match(spark, sf))
    reads = spark.createDataFrame([("ACGT" * 20,)], "seq string")
    assert "conv(" not in plan(counting.count_all(reads))
    assert {(r.kmer, r.total) for r in counting.count_all(reads).collect()} == {("ACGT" * 8, 13), ("CGTA" * 8, 24), ("GTAC" * 8, 12)}
