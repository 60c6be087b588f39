"""k-mer files in every layout, cut anywhere."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.plans.preprocess import Panel, from_bodies, to_bodies
from strandline.sources import entries, files


def kmer(seed):
    return "".join(np.random.default_rng(seed).choice(list("ACGT"), 32))


def body(n):
    locus = lambda k, t: {"chrom": "chr1", "gc": 40 + k, "masks": {kmer(1000 + k): 0, kmer(2000 + k): 0}, "position": 10 * k, "trend": False, "type": t}
    return {
        "count": 0, "filtered_loci": [locus(n + 5, 2)] if n % 3 == 0 else [], "gc": 0, "inverse": n % 5 == 0, "junction_loci": [locus(n + 7, 0)] if n % 5 == 0 else [],
        "loci": [locus(n + j, 1 if j == 0 else 2) for j in range(n % 3 + 1)], "reference": 0, "total": 0, "tracks": {f"DEL@chr1_{n}_{n + 50}": 1, f"INS@chr2_{n}_{n + 1}": 2}, "trend": False, "type": 1, "weight": 1.0,
    }


ENTRIES = {kmer(n): body(n) for n in range(120)}


def indented():
    """An entry over many lines, as a writer of indented JSON that joins entries by hand has them."""
    return "{\n" + ",\n".join(f'"{k}":{json.dumps(v, indent=4)}' for k, v in ENTRIES.items()) + "\n}\n"


LAYOUTS = {
    "indented": indented(),
    "whole": json.dumps(ENTRIES),
    "pretty": json.dumps(ENTRIES, indent=2),
    "tabs": json.dumps(ENTRIES, indent="\t").replace(": {", ":\n{"),
    "by line": "{" + "\n,".join(f'"{k}": {json.dumps(v)}' for k, v in ENTRIES.items()) + "\n}",
    "two objects": json.dumps(dict(list(ENTRIES.items())[:50])) + "\n" + json.dumps(dict(list(ENTRIES.items())[50:]), indent=1),
}


@pytest.mark.parametrize("size", ["128m", "20k", "700"])
@pytest.mark.parametrize("layout", sorted(LAYOUTS))
def test_layouts_and_splits(spark, tmp_path, layout, size):
    (tmp_path / "kmers_batch_0.json").write_text(LAYOUTS[layout])
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        if size == "20k" and layout != "whole":
            assert entries.splits(spark, str(tmp_path)).select("file", "block").distinct().count() >= 3
        rows = files.read_kmers(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {r.kmer: r.body.asDict(recursive=True) for r in rows}
    assert len(rows) == len(ENTRIES) and got == ENTRIES


def test_what_cannot_be_read_is_told(spark, tmp_path):
    good = {kmer(k): body(k) for k in range(3)}
    text = "{\n" + ",\n".join(f'"{k}":{json.dumps(v, indent=4)}' for k, v in good.items())
    (tmp_path / "a.json").write_text(text + f',\n"{kmer(9)}": {{"loci": [}}\n,"NOTAKMER": {json.dumps(body(1))},\n"{kmer(8)}": {{"type": 1}}\n, 17\n}}\n')
    (tmp_path / "b.json").write_text(f'stray {{"{kmer(20)}": {json.dumps(body(2), indent=1)[:-4]}')
    found = files.kmer_entries(spark, str(tmp_path)).collect()
    assert sorted(r.kmer for r in found if r.reason is None) == sorted(good)
    reasons = sorted(r.reason for r in found if r.reason)
    assert reasons == sorted(["not JSON, or of other types", "the name is no k-mer", "loci, tracks or type missing", "no entry", "outside of an object", "the file ends within an entry"])
    assert files.read_kmers(spark, str(tmp_path), strict=False).count() == 3
    with pytest.raises(Exception, match="(within an entry|no k-mer|missing|no entry|outside|not JSON)"):
        files.read_kmers(spark, str(tmp_path)).collect()


def test_all_lists_of_places_round_trip(spark, tmp_path):
    (tmp_path / "in.json").write_text(indented())
    panel = from_bodies(files.read_kmers(spark, str(tmp_path / "in.json")))
    files.write_kmers(to_bodies(panel), str(tmp_path / "out"), 3)
    again = from_bodies(files.read_kmers(spark, str(tmp_path / "out")))
    rows = lambda df, drop=(): sorted(map(repr, df.drop(*drop).collect()))
    for name in ("kmers", "kmer_tracks", "kmer_loci", "set_aside"):
        assert rows(getattr(panel, name)) == rows(getattr(again, name)) and rows(getattr(panel, name))
    assert panel.set_aside.groupBy("list").count().count() == 2
    assert isinstance(panel, Panel) and panel.kmer_loci.where(F.col("left").isNull()).count() == 0
