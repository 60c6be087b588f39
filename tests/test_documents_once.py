"""Documents are the largest table: queries read them no more often than they need, and without regular expressions."""

import random

import pytest
from pyspark.sql import functions as F

from strandline import fixtures as fx
from strandline import queries
from strandline.functions import dna
from strandline.operators import inner

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def documents(monkeypatch):
    """Grows by one with each scan of documents that is set up."""
    scans, table = [], fx.table
    monkeypatch.setattr(fx, "table", lambda spark, sf, name: (scans.append(name) if name == "documents" else None, table(spark, sf, name))[1])
    return scans


@pytest.mark.parametrize("query, most", [("cigar_clips", 1), ("inner_merge", 2), ("kmer_spectrum", 1)])
def test_documents_are_read_as_often_as_needed(spark, documents, query, most):
    plan = queries.QUERIES[query](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(documents) <= most
    assert "regexp_replace" not in plan


def test_bases_are_those_of_the_definition(spark, tmp_path):
    texts = [(1, "aé1Z b"), (2, ""), (3, None), (4, "日本"), (5, "ACGT qßİ"), (6, "The quick brown fox\njumps OVER 12 lazy dogs")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    want = {r.doc_id: r.seq for r in docs.where("text IS NOT NULL").select("doc_id", dna.to_dna(F.col("text")).alias("seq")).collect()}
    assert {r.doc_id: r.seq for r in fx.sequences(spark, str(tmp_path)).collect()} == want
    assert {r.doc_id: r.n for r in fx.sizes(spark, str(tmp_path)).collect()} == {k: len(v) for k, v in want.items()}


def test_places_without_reads(spark):
    own = fx.sizes(spark, SF)
    whole = fx.alignments(spark, SF, own).drop("read")
    places = fx.alignment_places(own)
    assert places.count() == whole.count()
    assert places.exceptAll(whole).count() == 0


def test_packed_insertions_are_those_of_the_strings(spark):
    rng = random.Random(4)
    genome = "".join(rng.choice("ACGT") for _ in range(4000))
    inserts = [genome[1000:1200], "A" * 150, genome[990:1010] + "ACGTACGT" * 20, genome[5:99], genome[5:100], genome[5:101], "ACGT", (genome[1500:1540] * 5)]
    rows = [(f"t{k}", "chr1", 600 + 300 * k, 601 + 300 * k, "INS", len(s), s) for k, s in enumerate(inserts)] + [("d", "chr1", 3200, 3300, "DEL", 100, None)]
    tracks = spark.createDataFrame(rows, "track string, chrom string, begin int, end int, svtype string, svlen int, seq string")
    reference = spark.createDataFrame([("chr1", genome)], "chrom string, seq string")
    want = sorted(map(tuple, inner.insertions(tracks, reference)[0].select("track", "kmer", "mult").collect()))
    got = inner.inserted(tracks, reference).select("track", dna.decode(F.col("code")).alias("kmer"), "mult")
    assert sorted(map(tuple, got.collect())) == want
