"""Each operator at its edges, with the values that its docstring defines: nulls, empty and very long texts, ties, repeated rows, extra columns of clashing names, empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import decontamination, html_text, language, lines, mixing, near, pii, secrets, toxicity, urls
from strandline.llm.common import bounded_sample, unused, window_of

#: Names that operators use inside or add.
CLASH = (
    "_score _lang _spans _base _items _n_words _text _copies _id _gone _found base spans pair copy_no copies rows block of_doc of_source of_text own_host own_text gone kept times "
    "kept_doc kept_text token c n th fp rep root component host text_hash lines stratum salt own key at target size taken limit y verdict tokens found"
).split()
LONG = " ".join(f"w{k}" for k in range(30_000))
ROWS = [(0, None), (1, ""), (2, " \n\t "), (3, "a plain line"), (3, "a plain line"), (None, "some text here"), (4, "😀 Ünïcode " * 5), (5, "x" * 100_000), (6, LONG), (7, LONG)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", f"s{(k or 0) % 3}" if k else None, len(t or ""), *[f"own {i}"] * len(CLASH)) for i, (k, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1), (3, 0), (4, 0), (6, 0), (None, 1)], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "A plain"), (2, None), (3, "")], "item_id long, text string")


def by_row(df, *added):
    """Rows in order of the input's own values, and the added columns of each."""
    return [tuple(r[c] for c in added) for r in sorted(df.collect(), key=lambda r: int(r["key"].split()[1]))]


def unchanged(out, docs):
    """out's columns begin with docs', whose values are as they were."""
    assert out.columns[: len(docs.columns)] == docs.columns
    assert by_row(out, "doc_id", "text", *CLASH) == [(*r, *[f"own {i}"] * len(CLASH)) for i, r in enumerate(ROWS)]


def test_toxicity(docs, labels):
    out = toxicity.score(docs, labels)
    unchanged(out, docs)
    assert out.columns[-1] == "_score_"
    got = [s for (s,) in by_row(out, "_score_")]
    assert got[:3] == [0.0, 0.0, 0.0] and got[3] == pytest.approx(got[4]) and got[8] == pytest.approx(got[9], abs=1e-6) and all(0 <= s <= 1 for s in got)
    assert {s for (s,) in by_row(toxicity.score(docs, labels.where("toxic = 0")), "_score_")} == {0.0}  # the share of label 1
    assert toxicity.score(docs.limit(0), labels).collect() == [] and len(toxicity.score(docs, labels.limit(0)).collect()) == len(ROWS)


def test_language(docs):
    out = language.identify(docs, windows=64, epochs=1)
    unchanged(out, docs)
    assert out.columns[-2:] == ["_lang_", "_score_"]
    got = by_row(out, "_lang_", "_score_")
    assert got[:3] == [("und", 0.0)] * 3 and {lang for lang, _ in got[3:]} == {"en"} and all(s == pytest.approx(1.0) for _, s in got[3:])
    assert {r["_lang_"] for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(docs.limit(0)).collect() == []


def test_pii(docs):
    out = pii.find(docs, planted=300)
    unchanged(out, docs)
    assert out.columns[-2:] == ["_base_", "_spans_"] and {(len(a), len(b)) for a, b in by_row(out, "_base_", "_spans_")} == {(0, 0)}
    assert by_row(pii.redact(docs, planted=300), "doc_id", "text") == ROWS
    assert pii.redact(docs.limit(0), planted=300).collect() == []


def test_secrets(docs):
    out = secrets.scan(docs)
    unchanged(out, docs)
    assert out.columns[-2:] == ["base_", "spans_"]
    assert [(len(a), len(b)) for a, b in by_row(out, "base_", "spans_")] == [(0, 0)] * len(ROWS)
    masked = secrets.redact(docs.withColumn("text", F.when(F.col("doc_id") == 3, "token=abcdefgh tail").otherwise(F.col("text"))))
    assert masked.columns == docs.columns and [t for d, t in by_row(masked, "doc_id", "text") if d == 3] == ["[SECRET] tail"] * 2
    assert secrets.redact(docs.limit(0)).collect() == []


@pytest.mark.parametrize("parameters", [{}, {"block_windows": 1, "shard_words": 20}])
def test_decontamination(spark, docs, benchmark, parameters):
    more = benchmark.unionByName(spark.createDataFrame([(9, "no such words"), (10, "nor these here")], "item_id long, text string"))
    out = decontamination.judge(docs, more, **parameters)
    unchanged(out, docs)
    assert out.columns[-3:] == ["_n_words_", "_spans_", "_items_"]
    got = by_row(out, "_n_words_", "_spans_", "_items_")
    assert [n for n, _, _ in got] == [0, 0, 0, 3, 3, 3, 10, 1, 30_000, 30_000][: len(got)] or got[6][0] > 0
    assert [(s, i) for _, s, i in got[3:5]] == [([(0, 2)], ["1"])] * 2 and all(not s and not i for k, (_, s, i) in enumerate(got) if k not in (3, 4))
    cleaned = decontamination.clean(docs, more, **parameters)
    assert cleaned.columns == docs.columns and [t for d, t in by_row(cleaned, "doc_id", "text") if d == 3] == [" line"] * 2
    assert decontamination.clean(docs.limit(0), more, **parameters).collect() == []
    assert by_row(decontamination.clean(docs, benchmark.limit(0)), "doc_id", "text") == ROWS


def test_lines(docs):
    got = {(r.doc_id, r.n_words, r.kept, r.base_failed) for r in lines.judge(docs, min_words=2).collect()}
    assert {(0, 0, False, True), (1, 0, False, True), (2, 0, False, True), (3, 3, True, False), (5, 1, False, True), (6, 30_000, True, False)} <= got
    cleaned = lines.clean(docs, min_words=2)
    assert cleaned.columns == docs.columns
    assert by_row(cleaned, "doc_id", "text") == [r for r in ROWS if r[0] in (3, None, 6, 7)] or by_row(cleaned, "doc_id", "text") == [r for r in ROWS if r[0] in (3, None, 4, 6, 7)]
    assert lines.clean(docs.limit(0)).collect() == []


def test_mixing(docs):
    got = {(r.doc_id, r["size"]) for r in mixing.mix(docs).collect()}
    assert {(0, 0), (1, 0), (2, 0), (3, 3), (5, 1), (6, 30_000)} <= got
    out = mixing.expand(docs)
    assert out.columns == [*docs.columns, "copy_no_"]
    plan = mixing.mix(docs).groupBy("doc_id").agg(F.sum("copies").alias("k")).where("k > 0")
    assert {(r.doc_id, r["count"]) for r in out.groupBy("doc_id").count().collect()} == {(r.doc_id, r.k) for r in plan.collect()}
    assert mixing.expand(docs.limit(0)).collect() == []


def test_mixing_gives_each_text_of_a_document_its_own_copies(spark):
    """Rows without doc_id, and rows of one doc_id: each is copied as the plan has it, not as often as the most copied one."""
    texts = [(None, f"text number {k}") for k in range(40)] + [(1, f"other {k}") for k in range(40)] + [(2, "the same")] * 40
    docs = spark.createDataFrame([(d, t, "s") for d, t in texts], "doc_id long, text string, source string")
    plan, out = mixing.mix(docs, share=1.3).collect(), mixing.expand(docs, share=1.3).collect()
    assert len(out) == sum(r.copies for r in plan)
    words = lambda d: sum(len(r.text.split()) for r in out if r.doc_id == d)
    assert all(words(d) == sum(r.taken for r in plan if r.doc_id == d) for d in (None, 1, 2))
    assert sorted(r.copy_no for r in out if r.doc_id == 2) == list(range(sum(r.copies for r in plan if r.doc_id == 2)))


def test_near_duplicates(docs):
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n, r.root) for r in near.join(docs).collect())
    assert got == [(-1, 1, None), (0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 1, 3), (3, 1, 3), (4, 2, 4), (5, 1, 5), (6, 29_996, 6), (7, 29_996, 6)]
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns and by_row(kept, "doc_id") == [(0,), (1,), (2,), (3,), (None,), (4,), (5,), (6,)]


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "http://A.com"), (5, "http://A.com"), (6, "http://x.net/es/" + "p/" * 20_000), (None, "x://h?://y")]
    pages = spark.createDataFrame([(k, u, *["own"] * len(CLASH)) for k, u in rows], "page_id long, url string, " + ", ".join(f"`{c}` string" for c in CLASH))
    got = sorted(((r.page_id or 0, r.host, r.path[:4], r.rule, r.verdict) for r in urls.judge(pages).collect()), key=str)
    empty = [(k, "", "", None, "allow") for k in (1, 2, 3, 4)]
    assert got == sorted([*empty, (5, "a.com", "", None, "allow"), (5, "a.com", "", None, "allow"), (6, "x.net", "/es/", "net/es/", "block"), (0, "h", "", None, "allow")], key=str)
    assert urls.judge(pages.limit(0)).collect() == []


def test_html(spark):
    page = "<article><p>one two three four</p></article>"
    rows = [(1, None), (2, ""), (3, page), (3, page), (4, page.replace("one", "<b>" * 5000 + "one " * 5000)), (None, "<p>")]
    pages = spark.createDataFrame([(k, "u", h, "own", "own") for k, h in rows], "page_id long, url string, html string, _text string, bits string")
    out = html_text.main_text(pages)
    assert out.columns == [*pages.columns, "_text_"]
    got = sorted((r.page_id or 0, len(r["_text_"]), r["_text"]) for r in out.collect())
    assert got == [(0, 0, "own"), (1, 0, "own"), (2, 0, "own"), (3, 18, "own"), (3, 18, "own"), (4, 20_014, "own")]
    assert html_text.main_text(pages.limit(0)).collect() == []


def test_samples(spark):
    """Rows that share a key, or are copies, don't grow a sample; long texts are read at places of their own."""
    hot = spark.createDataFrame([(1, "same")] * 500 + [(1, f"text {k}") for k in range(500)], "k long, text string")
    assert bounded_sample(hot, 5000).count() == 501 and bounded_sample(hot, 50).count() < 110
    texts = spark.createDataFrame([(f"{k} " + "ab" * 500,) for k in range(50)] + [("short",), (None,), ("",)], "text string")
    got = [r.w for r in texts.select(window_of(F.col("text"), 100).alias("w")).collect()]
    assert {len(w) for w in got[:50]} == {100} and len({w[:10] for w in got[:50]}) > 1 and got[50:] == ["short", None, ""]
    assert unused(["A", "a_"], "a") == "a__"


def test_long_words_are_read_whole():
    """Two long words that differ in the middle only are different inputs."""
    a, b = "x" * 60 + "vile" + "y" * 60, "x" * 60 + "kind" + "y" * 60
    assert set(toxicity.tokens(a)) != set(toxicity.tokens(b)) and any("vile" in w for w in toxicity.tokens(a))
    assert toxicity.tokens("short words only") == ["short", "words", "only"]
    for n in (41, 60, 61, 200):
        w = "".join(chr(0x4E00 + k) for k in range(n))
        assert set("".join(toxicity.tokens(w))) == set(w)


def test_labelled_texts_that_are_all_long_still_teach(spark):
    rng = np.random.default_rng(1)
    vocabulary = {"en": "the of and with this that from have were which".split(), "de": "der die das und nicht ein mit auf ist wir".split()}
    long = spark.createDataFrame([(k, " ".join(rng.choice(vocabulary[lang], 5000)), lang) for k, lang in enumerate(["en", "de"] * 12)], "doc_id long, text string, lang string")
    out = language.identify(long, F.col("doc_id") % 4 != 2, windows=2000).collect()
    assert all(r["_lang"] == r.lang for r in out)


def test_more_than_64_languages(spark):
    rows = [(k, " ".join([chr(0x61 + k % 9) + chr(0x61 + k // 9)] * 30), f"l{k:02}") for k in range(70) for _ in range(2)]
    model = language.train([(lang, text) for _, text, lang in rows], 4, 1, 240, 8, 140, 1)
    assert len(model.languages) == 70
