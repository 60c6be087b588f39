"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from strandline import fixtures
from strandline.queries import QUERIES
from strandline.session import local_session

HEADLINE = [
    "kmer_spectrum", "panel_count", "depth_estimate", "gc_window", "inner_merge", "reference_hit_filter", "cigar_clips", "present_minus_absent", "common_kmers", "mix_intersection", "track_components", "genotype_calls",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    QUERIES["bed_union"](spark, sf_dir).count()  # starts the JVM's compilers
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 2)
    reads = fixtures.reads(spark, sf_dir).count()
    print(json.dumps({"metric": "headline_queries", "value": round(sum(took.values()), 2), "unit": "sec", "queries": took, "reads_per_sec": {k: round(reads / took[k]) for k in ("kmer_spectrum", "panel_count")}, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}), flush=True)


if __name__ == "__main__":
    main()
