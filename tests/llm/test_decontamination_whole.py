"""Benchmark items without an item_id count."""

import duckdb
import pytest

from strandline.llm import decontamination


@pytest.mark.parametrize("parameters", [{}, {"block_windows": 2, "shard_words": 20}])
def test_null_item_id(spark, parameters):
    only, both = " ".join(f"alone{k}" for k in range(12)), " ".join(f"both{k}" for k in range(11))
    docs = spark.createDataFrame([(1, f"before {only} after"), (2, f"before {both} after"), (3, "nothing")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, only), (None, both), (7, both)], "item_id long, text string")
    got = {r.doc_id: ([tuple(s) for s in r["_spans"]], r["_items"]) for r in decontamination.judge(docs, benchmark, **parameters).collect()}
    assert got == {1: ([(1, 13)], [None]), 2: ([(1, 12)], ["7", None]), 3: ([], [])}
    assert {r.doc_id: r.text for r in decontamination.clean(docs, benchmark, **parameters).collect()} == {1: "before  after", 2: "before  after", 3: "nothing"}


def test_null_item_id_as_in_sql(spark, tmp_path):
    only, both = " ".join(f"alone{k}" for k in range(12)), " ".join(f"both{k}" for k in range(11))
    spark.createDataFrame([(1, f"before {only} after"), (2, f"before {both} after"), (3, "nothing")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, only), (None, both), (7, both)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = db.execute(decontamination.SQL).fetchall()
    assert sorted(tuple(r) for r in decontamination.op10_decontamination(spark, str(tmp_path)).collect()) == sorted(want)


@pytest.mark.parametrize("parameters", [{}, {"block_windows": 2, "shard_words": 20}])
def test_texts_are_cut_where_spans_are_found(spark, parameters):
    """A second worker with the same texts once took an executor beyond its memory."""
    only = " ".join(f"alone{k}" for k in range(12))
    rows = [(1, f"before {only} after", "a"), (2, only, "b"), (3, None, "c"), (4, "", "d"), (5, "nothing", None), (6, f"é {only}", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    cleaned = decontamination.clean(docs, spark.createDataFrame([(1, only)], "item_id long, text string"), **parameters)
    assert sorted(map(tuple, cleaned.collect()), key=lambda r: r[0]) == [(1, "before  after", "a"), (3, None, "c"), (4, "", "d"), (5, "nothing", None), (6, "é ", "f")]
    assert cleaned.schema == docs.schema
    assert cleaned._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
