"""Conversation trie, spelling variants and embedding duplicates, against brute force, SQL and at their edges."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import conversations, embeddings, spelling


def sql(query, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        frame = df.toArrow()  # noqa: F841
        con.sql(f"CREATE TABLE {name} AS SELECT * FROM frame")
    out = con.sql(query)
    return out.columns, sorted(out.fetchall(), key=repr)


def same(got, want):
    columns, rows = want
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == rows


# Conversations


def built(rows, stems=5):
    """Rebuilt conversations of (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(ts, key=lambda x: (x[0], x[1] or 0, x[2], hashlib.md5(f"{len(x[2])}:{x[2]}{x[3]}".encode()).hexdigest()))] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        stem = c - int(np.fmod(c, stems))
        out[c] = own.get(stem, [])[:h] + turns[h:]
    return out


def brute_trie(rows, stems=5):
    members = defaultdict(list)
    whole = built(rows, stems)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)

    def under(k):
        yield k
        for x in kids[k]:
            yield from under(x)

    out = []
    for k, cs in members.items():
        ids = ",".join(map(str, sorted(c for c in cs if len(whole[c]) == len(k))))
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under(k) if x)
        out.append((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), len(kids[k]), sum(not kids[x] for x in under(k)), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=repr)


def talks(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(rng.randrange(0, 6)):
            rows.append((c, turn if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), rng.choice(["yes", "no", "", None, "ünï"])))
    rows += [(None, 0, "user", "nobody's"), (-7, 0, "user", "yes"), (-5, 0, "user", "no")]
    return rows


CONVERSATION = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("partitions", ["1", "5", "23"])
def test_trie_equals_brute_force(spark, partitions):
    """Any number of ranges, so that nodes are open across some of them."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = talks(int(partitions), 150)
        out = conversations.trie(spark.createDataFrame(rows, CONVERSATION)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, out), key=repr) == brute_trie(rows)


def test_sweep_stitches(spark):
    """Every way of cutting a row of paths into ranges gives the same nodes."""
    rows = [(c, t, "u", x) for c, x in enumerate("a ab abc abd b bb bba bbab c".split()) for t, x in enumerate(x)]
    want = brute_trie(rows, 1)
    for n in ("1", "3", "9", "20"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            assert sorted(map(tuple, conversations.trie(spark.createDataFrame(rows, CONVERSATION), stems=1).collect()), key=repr) == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_trie_sql_and_edges(spark):
    df = spark.createDataFrame(talks(3, 60) + [(500, k, "user", "again") for k in range(300)], CONVERSATION)
    same(conversations.trie(df), sql(conversations.SQL, conversations=df))
    assert conversations.trie(df.limit(0)).count() == 0
    copies = spark.createDataFrame([(5 * k, 0, "u", "x" * 100_000) for k in range(40)], CONVERSATION).withColumn("path", F.lit("z"))
    out = {r.depth: r for r in conversations.trie(copies, longest=1).collect()}
    assert out[1].n_convs == 40 and out[1].saved_tokens == out[0].saved_tokens == 39 * 100_000
    assert out[1].ends_sha256 == hashlib.sha256(",".join(str(5 * k) for k in range(40)).encode()).hexdigest()


def test_ends_across_chunks(spark):
    ids = spark.range(0, 120_000).select(F.lit(b"k").alias("fp"), F.col("id").alias("conv_id"))
    row = conversations.ends(ids).first()
    assert (row.low, row.n, row.ends_sha256) == (0, 120_000, hashlib.sha256(",".join(map(str, range(120_000))).encode()).hexdigest())


# Spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def some_words(seed, n):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(n)})


def test_active_nodes_equal_brute_force():
    for seed in range(5):
        words = some_words(seed, 150)
        got = list(spelling.near_within(words))
        assert len(got) == len(set(got)) and set(got) == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b)}


@pytest.mark.parametrize("parts", [1, 6, 40])
def test_pairs_across_slices(spark, parts):
    words = [*some_words(9, 300), "x" * 3000, "x" * 3001, "y" + "x" * 3000]
    df = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "w long, word string")
    got = [tuple(r) for r in spelling.near_pairs(df, parts).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b)}


def test_forms_and_roots(spark):
    words = [("variant", 100_000), ("varient", 9_000), ("variemt", 900), ("varimt", 90), ("variantt", 10_001), ("alone", 3), ("tiedaaa", 5), ("tiedbaa", 60), ("tiedcaa", 60)]
    out = {r.word: r for r in spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert out["varient"].form == "variant" and out["variemt"].form == "varient" and out["varimt"].form == "variemt"
    assert out["varimt"].root == "variant" and out["variemt"].root == "variant" and out["variant"].root == "variant"
    assert out["variantt"].form is None and out["variantt"].n_near == 1 and out["alone"].n_near == 0
    assert out["tiedaaa"].form == "tiedbaa" and out["tiedaaa"].form_n == 60 and out["tiedaaa"].n_near == 2


def brute_vocabulary(docs):
    import re

    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def test_vocabulary_and_sql(spark):
    rng = random.Random(4)
    stems = ["".join(rng.choice("abcdefgÉß") for _ in range(rng.randint(5, 10))) for _ in range(60)]
    docs = [(k if k else None, " ".join(rng.choice(stems).capitalize() for _ in range(60)) + "1x2") for k in range(80)] + [(900, None), (901, ""), (902, "q" * 50_000), (903, "q" * 50_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("run", F.lit(1))
    assert {r.word: r.n for r in spelling.vocabulary(df).collect()} == brute_vocabulary(docs)
    small = df.where("doc_id IS NULL OR doc_id < 900")
    same(spelling.variants(spelling.vocabulary(small)), sql(spelling.SQL, documents=small))
    assert spelling.variants(spelling.vocabulary(df.limit(0))).count() == 0


# Vectors


def vectors(seed, groups, dim=32):
    rng = np.random.default_rng(seed)
    out = []
    for size, noise in groups:
        centre = rng.standard_normal(dim)
        out += [centre + noise * rng.standard_normal(dim) for _ in range(size)]
    return np.array(out).astype(np.float32)


def exact(x, cosine=0.9):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    return u @ u.T >= cosine


def test_recall_and_no_false_links(spark):
    """Groups from far over the limit to just at it, among strangers."""
    x = vectors(1, [(1, 0.0)] * 1500 + [(20, 0.05)] * 3 + [(3, 0.3)] * 200)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r._links for r in embeddings.near_duplicates(df, cell=32).collect()}
    links = exact(x)
    np.fill_diagonal(links, False)
    want = links.sum(axis=1)
    assert all(got[k] <= want[k] for k in got)
    assert want.sum() > 1000 and sum(got.values()) >= 0.98 * want.sum()


def test_large_cells_are_dealt(spark):
    x = vectors(2, [(300, 0.02), (40, 0.02)])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r._links, r._component) for r in embeddings.near_duplicates(df, block=64).collect()}
    assert all(got[k] == ((299, 0) if k < 300 else (39, 300)) for k in range(340))


def test_vector_edges(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a), (2, a), (2, a), (3, [5.0, 0.0, 0.0]), (4, b), (5, None), (6, []), (7, [0.0, 0.0, 0.0]), (8, [1.0, None, 0.0]), (9, [float("nan"), 1.0, 0.0]), (10, [float("inf"), 1.0, 0.0]), (11, [1.0, 0.0]), (None, b), (12, [1e30, 1e30, 0.0]), (13, [-0.0, 0.0, 1.0]), (14, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"fp": F.lit("x"), "_links": F.lit(0), "c": F.lit(1)})
    out = embeddings.near_duplicates(df)
    assert out.columns == [*df.columns, "_links_", "_component"]
    got = Counter((r.vec_id, r._links_, r._component) for r in out.collect())
    want = [(1, 3, 1), (2, 3, 1), (2, 3, 1), (3, 3, 1), (4, 1, 4), (None, 1, 4), *((k, 0, k) for k in (5, 6, 7, 8, 9, 10, 11, 12)), (13, 1, 13), (14, 1, 13)]
    assert got == Counter(want)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    plain = df.select("vec_id", "embedding")
    out = embeddings.near_duplicates(plain).select("vec_id", F.col("_links").alias("n_links"), F.col("_component").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("_component")).alias("kept"))
    same(out, sql(embeddings.SQL, embeddings=plain))


def test_calibration():
    for n in (10, 1000, 100_000, 10**9):
        lines, least = embeddings.calibrated(n, 0.9, 0.99, 256, 1)
        assert least >= 1 and lines.tables < 2000
    rng = np.random.default_rng(3)
    lines, least = embeddings.calibrated(50_000, 0.9, 0.99, 256, 1)
    a = rng.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((400, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    (ca, za), (cb, zb) = lines.places(a), lines.places(b)
    assert np.mean(((ca == cb) & (np.abs(za - zb) <= lines.window)).sum(axis=1) >= least) >= 0.97
