"""Steps by k-mer are dealt by it once, and what a step needed goes with its end."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from strandline import queries, session
from strandline.operators import counting, inner, likelihood, locate
from strandline.session import dealt, freed, written

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def bases(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


@pytest.fixture()
def joined_by_sorting(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_what_is_dealt_is_not_shuffled_again_and_goes_when_freed(spark, joined_by_sorting):
    rows = spark.range(1000).selectExpr("id % 50 AS kmer", "id")
    table = written(dealt(rows, "kmer"), "rows")
    both = table.join(table.groupBy("kmer").agg(F.count("*").alias("n")), "kmer")
    assert "Exchange" not in plan(both) and sorted(map(tuple, both.collect())) == sorted((k % 50, k, 20) for k in range(1000))
    path, name = table._written_to
    folder = path.removeprefix("file:").replace("///", "/")
    assert os.path.isdir(folder)
    freed(table)
    assert not os.path.exists(folder) and not spark.catalog.tableExists(name)


def test_shuffle_files_go_with_the_write(spark):
    """They stayed until the driver happened to collect its garbage."""
    found = lambda: {f for d in spark._jsc.sc().env().blockManager().diskBlockManager().localDirsString() for f in glob.glob(f"{d}/*/shuffle_*")}
    before = found()
    written(spark.range(10_000).repartition(7, "id"), "ids")
    assert not found() - before
    assert spark.conf.get(session.CLEANUP) == "false"


def test_deletions_are_counted_where_they_are(spark):
    """Also a k-mer that stands more than once in a window; no sum is shuffled."""
    ref = bases(1000, 1) + "ACGT" * 40 + bases(1000, 2)
    tracks = spark.createDataFrame([("DEL@chr1_990_1100", "chr1", 990, 1100, "DEL", 110), ("DEL@chr1_400_460", "chr1", 400, 460, "DEL", 60)], "track string, chrom string, begin int, end int, svtype string, svlen int")
    reference = spark.createDataFrame([("chr1", ref)], "chrom string, seq string")
    got = inner.deletions(tracks, reference, carried=("begin",))
    assert "partial_count" not in plan(got)
    complement = str.maketrans("ACGT", "TGCA")
    want = {}
    for t, b, n in (("DEL@chr1_990_1100", 990, 110), ("DEL@chr1_400_460", 400, 60)):
        w = ref[b - 32 : b + n + 32]
        for k in (min(w[i : i + 32], w[i : i + 32][::-1].translate(complement)) for i in range(len(w) - 31)):
            want[t, b, k] = want.get((t, b, k), 0) + 1
    assert max(want.values()) > 1 and {(r.track, r.begin, r.kmer): r.mult for r in got.collect()} == want


def test_hits_are_counted_without_places(spark):
    ref = bases(3000, 5)
    reference = spark.createDataFrame([("chr1", ref + ref[500:1500] * 6 + bases(900, 6)), ("chr2", ref[:2500] + bases(900, 7))], "chrom string, seq string")
    kmers = locate.dna.encode(locate.dna.canonical(F.col("kmer"))).alias("kmer")
    own = spark.createDataFrame([(ref[k : k + 32],) for k in range(0, 2900, 7)] + [("A" * 32,)], "kmer string").select(kmers)
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(locate.hits(own, locate.loci(own, reference, text=False)))
    assert {n for _, n in want} >= {0, 2, 5}
    for sent in (10**6, 3):
        assert rows(locate.counted_hits(own, reference, sent=sent)) == want


def test_first_places_equal_all_pairs(spark, joined_by_sorting):
    """Places of inserted sequence and junctions before those of the reference, then by place; of each track, and none where none is near."""
    rng = random.Random(9)
    kmers = [(k, "JUNCTION" if k % 3 == 0 else "INNER", False, 1, 1) for k in range(6)]
    tracks = sorted({(k, n, f"chr{n % 2}", b := rng.randrange(500), b + rng.choice((1, 40)), 1) for k in range(6) for n in range(60)})
    loci = [(k, f"chr{rng.randrange(2)}", rng.randrange(500), t, rng.randrange(101), trend) for k in range(6) for t, trend, n in (("REF", False, 3), ("INNER", False, 4), ("INNER", True, 5), ("JUNCTION", True, 80)) for _ in range(n)]
    own = spark.createDataFrame(kmers, "kmer long, type string, inverse boolean, count long, total long")
    named = spark.createDataFrame(tracks, "kmer long, track long, chrom string, begin int, end int, mult long")
    places = spark.createDataFrame(loci, "kmer long, chrom string, pos int, type string, gc int, trend boolean")
    kind = {k[0]: k[1] for k in kmers}
    want = {}
    for k, t, c, b, e, _ in tracks:
        low, high = (b, b) if kind[k] == "JUNCTION" else (b - 32, e)
        near = [(not trend, p, gc) for kk, cc, p, of, gc, trend in loci if kk == k and cc == c and of == kind[k] and low <= p <= high]
        first = min(near, default=None)
        want[k, t] = (False, None) if first is None else (not first[0], first[2])
    got = {(r.kmer, r.track): (r.trend, r.gc) for r in likelihood.matched(own, named, places).collect()}
    assert got == want and len({v[0] for v in want.values() if v[1] is not None}) == 2 and (False, None) in want.values()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_gc_depth_reads_the_reads_once(spark, monkeypatch):
    scans = []
    monkeypatch.setattr(counting, "panel_windows", lambda *a, _own=counting.panel_windows, **k: scans.append(1) or _own(*a, **k))
    assert queries.gc_depth(spark, SF).count() == 101 and len(scans) == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_masked_panel_stays_packed(spark):
    assert "conv(" not in queries.panel_count_masked(spark, SF)._jdf.queryExecution().analyzed().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["cigar_clips", "track_components"])
def test_variants_are_not_sent_whole(spark, name):
    """They are small as files, and were sent to all tasks through the driver."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        df = queries.QUERIES[name](spark, SF)
        assert df.count()
        text = df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "strategy=merge" in text
