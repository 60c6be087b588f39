"""Near duplicates whose links were once lost, and blocks that only the trees can join."""

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import near


def text(seed, n=60):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 10**6, n))


def changed(t, *places):
    w = t.split()
    for p in places:
        w[p] = f"other{p}"
    return " ".join(w)


def roots(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n, r.root) for r in df.collect())


def test_a_document_of_two_texts_has_the_links_of_each(spark):
    a, b = text(1), text(2)
    docs = spark.createDataFrame([(5, a), (5, b), (7, changed(b, 3)), (9, changed(a, 3)), (6, text(3))], "doc_id long, text string")
    assert {(r.doc_id, r.root) for r in near.join(docs).collect()} == {(5, 5), (7, 5), (9, 5), (6, 6)}
    kept = [(r.doc_id, r.text) for r in near.keep_one(docs).collect()]
    assert sorted(kept) == sorted([(5, a), (5, b), (6, text(3))])


def test_string_ids_nulls_and_clashing_columns(spark):
    a = text(1)
    rows = [("b", a, 1), ("a", changed(a, 3), 2), (None, changed(a, 4), 3), (None, text(9), 4), ("c", "", 5), ("c", "", 6), ("d", None, 7), ("b", a, 1)]
    schema = "doc_id string, text string, " + ", ".join(f"{c} long" for c in ("c", "th", "n", "fp", "rep", "root", "token", "kept_doc", "kept_text", "TIMES", "bits"))
    docs = spark.createDataFrame([(d, t, *[k] * 11) for d, t, k in rows], schema)
    got = sorted((r.doc_id or "", r.root or "") for r in near.join(docs).collect())
    assert got == [("", ""), ("", "a"), ("a", "a"), ("b", "a"), ("b", "a"), ("c", "c"), ("c", "c"), ("d", "d")]
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id or "", r.n) for r in kept.collect())) == [("", 4), ("a", 2), ("c", 5), ("c", 6), ("d", 7)]
    assert near.join(docs.limit(0)).collect() == [] == near.keep_one(docs.limit(0)).collect()


@pytest.mark.parametrize("parameters", [{}, {"block": 8}, {"held": 200}, {"block": 16, "held": 300}])
def test_groups_just_below_the_limit(spark, parameters):
    """Copies with a few words changed each, some of which link and most of which don't: as brute force has it."""
    rng = np.random.default_rng(8)
    base = text(4, 80)
    texts = [changed(base, *rng.choice(80, int(rng.integers(1, 4)), replace=False)) for _ in range(60)] + [base + " tail " + text(k, 30) for k in range(20)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    got = near.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **parameters)
    assert roots(got) == [(k, len(sets[k]), root[k]) for k in range(len(texts))]


def test_forest_has_fewer_links_than_members():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**40, 200)
    sets = [np.unique(np.concatenate([rng.choice(base, 190, replace=False), rng.integers(0, 2**40, 3)])) for _ in range(100)]
    zero = np.zeros(100, np.int64)
    rows = pa.table({k: zero for k in (*near.KEY, "part")} | {"c": np.arange(100), "n": np.array([len(s) for s in sets]), "root": np.arange(100)})
    a, b = near.proved_forest(near.Blocks(rows, by_component=True), np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets]))), 80)
    assert len(a) == 99 and len({*a.tolist(), *b.tolist()}) == 100


def test_a_member_of_a_joined_component_keeps_its_own_pair():
    """a1 may link with b1, a2 with b2; each of both is in the cluster, though a1 and a2 are one component."""
    zero = np.zeros(4, np.int64)
    rows = pa.table({k: zero for k in (*near.KEY, "part")} | {"c": np.arange(4), "n": zero + 8, "root": np.array([0, 0, 2, 2])})
    bits = np.array([[0b11111111], [0b11111111 << 16], [0b11111111], [0b11111111 << 16]], np.uint64)
    a, b = near.Blocks(rows, by_component=False).forest({64: (bits, np.arange(4))}, 80)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 2), (1, 3)]


def test_bitmaps_of_several_widths_lose_nothing():
    """Sets of 500 to 5,000 shingles, in pairs that link: the forest of what may link joins each pair, and leaves most others out."""
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**63, int(n)).astype(np.uint64)) for n in rng.integers(500, 5000, 60)]
    sets += [np.unique(np.concatenate([s[len(s) // 12 :], rng.integers(0, 2**63, len(s) // 40).astype(np.uint64)])) for s in sets]
    maps = [near.bitmap(h[(h >> np.uint64(40)) & np.uint64(1) == 0], near.width_of(len(h) // 2, near.NARROW)).view(np.uint64) for h in sets]
    assert len({len(m) for m in maps}) > 2
    n, zero = np.array([len(s) for s in sets]), np.zeros(120, np.int64)
    rows = pa.table({k: zero for k in (*near.KEY, "part")} | {"c": np.arange(120), "n": n, "root": np.arange(120)})
    by_width = near.by_width(np.concatenate(maps), np.concatenate(([0], np.cumsum([len(m) for m in maps]))))
    a, b = near.Blocks(rows, by_component=False).forest(by_width, 80)
    assert {(k, k + 60) for k in range(60)} <= set(zip(a.tolist(), b.tolist(), strict=True)) and len(a) < 70


def dealt_rows(spark, n, root, limit, threshold=80):
    """One block of members 0, 1, ... of sizes n and components root, dealt."""
    rows = spark.createDataFrame([(7, c, int(n[c]), int(root[c]), 1) for c in range(len(n))], "block long, c long, n long, root long, weight long")
    totals = spark.createDataFrame([(7, len(n))], "block long, total long")
    return near.dealt(rows, totals, threshold, limit)


@pytest.mark.parametrize("roots_of", ["own", "few", "one large"])
def test_each_pair_that_may_link_meets_once(spark, roots_of):
    rng = np.random.default_rng(3)
    n = np.concatenate([rng.integers(5, 60, 150), np.full(90, 30)])
    root = {"own": np.arange(240), "few": np.arange(240) % 3, "one large": np.where(np.arange(240) < 200, 0, np.arange(240))}[roots_of]
    got = dealt_rows(spark, n, root, 16).toPandas()
    assert (got.part.eq(got.p) | got.part.eq(got.q)).all()
    met = []
    for (p, q), rows in got.groupby(["p", "q"]):
        c, part = rows.c.to_numpy(), rows.part.to_numpy()
        assert len(c) == len(set(c)) and len(c) < 90
        x, y = np.triu_indices(len(c), 1)
        on = (p == q) | (part[x] != part[y])
        met += [(min(a, b), max(a, b)) for a, b in zip(c[x[on]].tolist(), c[y[on]].tolist(), strict=True)]
    wanted = {(a, b) for b in range(240) for a in range(b) if root[a] != root[b] and 100 * min(n[a], n[b]) >= 80 * max(n[a], n[b])}
    assert len(met) == len(set(met)) and wanted <= set(met)


def test_rows_of_a_large_block_of_many_sizes(spark):
    """256,000 members of one block, of sizes from 50 to 5,000 and 200,000 components, one of which has a fifth of all: under four rows a member."""
    k = spark.range(256_000).withColumnRenamed("id", "c")
    rows = k.select(near.F.lit(7).cast("long").alias("block"), "c", (50 + near.F.pmod(near.F.xxhash64("c"), near.F.lit(4951))).alias("n"), near.F.when(near.F.col("c") < 56_000, 0).otherwise(near.F.col("c")).alias("root"), near.F.lit(128).alias("weight"))
    got = near.dealt(rows, rows.groupBy("block").agg(near.F.sum("weight").alias("total")), 80, 32_768 * 128)
    assert 200_000 < got.count() < 4 * 256_000
    assert got.groupBy("p", "q").count().agg({"count": "max"}).first()[0] < 2.5 * 32_768
