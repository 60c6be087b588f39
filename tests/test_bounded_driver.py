"""What comes to the driver is of bounded size, however many k-mers a panel has."""

import random

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import dna
from strandline.operators import counting, locate
from strandline.operators.windows import Sieve


@pytest.fixture(scope="module")
def genome():
    rng = random.Random(11)
    return "".join(rng.choice("ACGT") for _ in range(30_000))


@pytest.fixture()
def few_rows(monkeypatch):
    """Rows and tables that the driver takes, by number of rows."""
    taken = []
    for name in ("toPandas", "toArrow", "collect"):
        whole = getattr(DataFrame, name)

        def counted(self, *args, _whole=whole, **kw):
            out = _whole(self, *args, **kw)
            taken.append(len(out))
            return out

        monkeypatch.setattr(DataFrame, name, counted)
    return taken


def test_sieve_has_no_false_negatives_and_few_false_positives(spark):
    rng = np.random.default_rng(2)
    codes = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, 200_000))
    sieve = Sieve.of(spark.createDataFrame([(int(c),) for c in codes[::2]], "code long"), len(codes[::2]))
    assert len(sieve.bits) <= 8 * len(codes)
    assert len(sieve.among(codes[::2])) == len(codes[::2])
    assert len(sieve.among(codes[1::2])) < 0.03 * len(codes)


def test_large_panels_are_counted_without_the_driver(spark, genome, few_rows):
    reads = spark.createDataFrame([(genome[k : k + 150],) for k in range(0, 29_800, 40)], "seq string")
    kmers = spark.createDataFrame([(genome[k : k + 32],) for k in range(0, 29_900, 3)] + [("A" * 32,)], "kmer string").select(dna.canonical(F.col("kmer")).alias("kmer")).distinct()
    masks = kmers.select("kmer", F.lit(genome[:32]).alias("mask"))
    sent = counting.count_panel(reads, kmers), counting.count_masked(reads, masks)
    before = [sorted(map(tuple, df.collect())) for df in sent]
    few_rows.clear()
    joined = counting.count_panel(reads, kmers, most=1000), counting.count_masked(reads, masks, most=1000)
    assert max(few_rows, default=0) <= 1000
    assert [sorted(map(tuple, df.collect())) for df in joined] == before


def test_places_of_many_kmers_are_found_without_the_driver(spark, genome, few_rows):
    ref = spark.createDataFrame([("chr1", genome), ("chr2", genome[3000:12000])], "chrom string, seq string")
    kmers = spark.createDataFrame([(genome[k : k + 32],) for k in range(0, 29_900, 3)], "kmer string").select(dna.canonical(F.col("kmer")).alias("kmer"))
    before = sorted(map(tuple, locate.loci(kmers, ref).collect()))
    few_rows.clear()
    many = locate.loci(kmers, ref, sent=1000)
    assert max(few_rows, default=0) <= 1000
    assert sorted(map(tuple, many.collect())) == before
