"""The driver's contract, and the oracle on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries that take some seconds; the others are held against their SQL in the same way by the driver's run.
QUICK = """kmer_spectrum packed_kmers panel_count panel_count_masked depth_estimate gc_depth gc_window del_inner_kmers ins_body_kmers ins_inner_kmers cigar_clips junction_kmers
present_minus_absent common_kmers mix_intersection bed_union subsequence_match locus_filter""".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, data):
    key = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(key(r[c]) for c in columns) for r in data), key=repr)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_oracle(spark, duck, name):
    got = [r.asDict() for r in entry_module.queries()[name](spark, SF).collect()]
    want = duck.sql(entry_module.oracle_sql()[name])
    names = want.columns
    want = [dict(zip(names, r, strict=True)) for r in want.fetchall()]
    assert got and sorted(got[0]) == sorted(names)
    assert rows(sorted(names), got) == rows(sorted(names), want)


def test_entry(spark):
    assert entry_module.entry(spark).limit(3).count() == 3
    assert not math.isnan(len(entry_module.queries()))


def test_oracle_names_are_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
