"""Masked counts over a stream that is stopped and goes on, FASTA in splits, and programs whose deviations are held."""

import itertools

import numpy as np
import pytest

from strandline.operators import clusters, counting
from strandline.operators.windows import CHUNK, chunks
from strandline.sources import files
from strandline.streaming import counts


def bases(n, seed):
    return "".join(np.random.default_rng(seed).choice(list("ACGT"), n))


def test_a_stopped_stream_goes_on(spark, tmp_path, monkeypatch):
    genome = bases(2000, 1)
    masks = spark.createDataFrame([(min(k, k[::-1].translate(str.maketrans("ACGT", "TGCA"))), m) for a in range(100, 1800, 50) for k, m in [(genome[a : a + 32], genome[a - 32 : a])]] + [("A" * 32, None)], "kmer string, mask string")
    rng = np.random.default_rng(2)
    every = []
    (tmp_path / "in").mkdir()

    def arrive(k):
        reads = [(int(i), genome[a : a + 120]) for i, a in enumerate(rng.integers(0, 1880, 40))]
        every.extend(reads)
        spark.createDataFrame(reads, "read_id long, seq string").coalesce(1).write.parquet(str(tmp_path / "tmp" / str(k)))
        part = next((tmp_path / "tmp" / str(k)).glob("part-*.parquet"))
        part.rename(tmp_path / "in" / f"{k}.parquet")

    def run():
        stream = spark.readStream.schema("read_id long, seq string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = counts.start_masked(stream, masks, str(tmp_path / "out"), str(tmp_path / "check"), compact_every=3)
        query.awaitTermination(120)

    for k in range(3):
        arrive(k)
    run()
    for k in range(3, 6):
        arrive(k)
    own, calls = counting.count_masked, itertools.count()

    def breaks(batch, known):
        out = own(batch, known)
        if next(calls) == 1:  # the batch's sums have been written when the stream breaks
            out.write.mode("overwrite").parquet(str(tmp_path / "out/batches/number=4"))
            raise RuntimeError("an executor is lost")
        return out

    monkeypatch.setattr(counting, "count_masked", breaks)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(counting, "count_masked", own)
    run()
    rows = lambda df: sorted(tuple(r) for r in df.select("kmer", "count", "total").collect())
    want = rows(counting.count_masked(spark.createDataFrame(every, "read_id long, seq string"), masks))
    assert rows(counts.read_masked(spark, str(tmp_path / "out"))) == want and sum(r[1] for r in want) > 0
    assert counts.finished(spark, str(tmp_path / "out/snapshots")) == [2, 5] and counts.finished(spark, str(tmp_path / "out/batches")) == list(range(6))
    assert counts.read_masked(spark, str(tmp_path / "nothing")).count() == 0


@pytest.mark.parametrize("size", ["128m", "3000"])
def test_fasta_in_splits(spark, tmp_path, size):
    seqs = {"chr1": bases(3 * CHUNK + 77, 3), "2": bases(50, 4), "chrX": bases(CHUNK, 5), "chrUn_1": bases(500, 6), "chr3 description": bases(90, 7), "chr4": ""}
    text = "".join(f">{name}\n" + "".join(s[k : k + 61].lower() + "\n" for k in range(0, len(s), 61)) for name, s in seqs.items())
    (tmp_path / "a.fa").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = files.read_reference(spark, str(tmp_path / "a.fa")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = chunks(files.read_fasta(spark, str(tmp_path / "a.fa")).where("seq <> ''")).collect()
    key = lambda rows: sorted((r.chrom, r.length, r.offset, r.base, r.piece) for r in rows)
    assert key(got) == key(want) and {r.chrom for r in got} == {"chr1", "chr2", "chrX"}
    (tmp_path / "twice.fa").write_text(">chr1\nACGT\n>1\nACGT\n")
    with pytest.raises(ValueError, match="twice"):
        files.read_reference(spark, str(tmp_path / "twice.fa"))


def held_by_enumeration(a, b, w, most):
    """Least sum over a grid, with deviations held."""
    best = None
    for x in itertools.product(np.linspace(0, 1, 41), repeat=a.shape[1]):
        r = np.abs(a @ np.array(x) - b)
        if r.max() <= most + 1e-9:
            best = min(best, float(w @ r)) if best is not None else float(w @ r)
    return best


def test_deviations_are_held():
    rng = np.random.default_rng(8)
    seen = {"free": 0, "held": 0, "none": 0}
    for _ in range(60):
        a = rng.integers(-3, 4, (8, 2)).astype(float) * 10
        b, w, most = rng.integers(-30, 40, 8).astype(float), rng.integers(1, 5, 8).astype(float), float(rng.choice([18, 25, 35, 1000]))
        at, of = np.nonzero(a)
        if len(set(of)) < 2:
            continue
        x = clusters.held_deviation(at, of, a[at, of], b, w, 2, most)
        grid = held_by_enumeration(a, b, w, most)
        if x is None:
            assert grid is None
            seen["none"] += 1
            continue
        r = np.abs(a @ x - b)
        assert r.max() <= most * (1 + 1e-6) and (grid is None or w @ r <= grid + 1e-6)
        plain = clusters.least_deviation(a, b, w)
        seen["held" if np.abs(a @ plain - b).max() > most + 1e-6 else "free"] += 1
    assert min(seen.values()) >= 3


def test_impossible_clusters_have_minus_one(spark):
    clustered = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")], "track string, cluster string")
    terms = spark.createDataFrame([("k1", "a", 20.0), ("k1", "b", 20.0), ("k2", "c", 20.0), ("k2", "d", 20.0)], "kmer string, track string, coef double")
    targets = spark.createDataFrame([("k1", 40.0), ("k2", 5000.0)], "kmer string, target double")
    got = {r.track: r.lp for r in clusters.solve(clustered, terms, targets).collect()}
    assert got == {"a": 1.0, "b": 1.0, "c": -1.0, "d": -1.0}
