"""Toxicity by a bidirectional gated recurrent network with attention pooling over character and word inputs.

A word's input is its word vector (one vector for all words outside the vocabulary) beside the mean vector of its character 3- and 4-grams, hashed to
`grams` rows. The network reads windows of `window` words that overlap by half, pools its states by attention and gives the window's probability; a document's
score is its highest window's. All windows of the whole text are scored; a text of fewer words is one window. A run of letters of over 40 characters (words run
together, scripts without spaces) is read as overlapping pieces, each a word of the window.

Trained by backpropagation through time in numpy, on the driver, over about per_class documents of each label (chosen by hash), of max_chars characters
together: whole texts where they fit, as a toxic passage may stand anywhere in a long one; else an equal share each, from a place that the text's hash gives. Labels are of documents, so the windows to learn from are chosen: of a toxic document the
windows_up windows that look worst, first by log odds of words and character grams, then by the model itself; of others some
at random, then also those that look worst. The first component of the vectors begins as these log odds.

A task projects each distinct word to the gates' inputs once and reads windows as rows of word numbers.

Defined results: a null text, or one without a word, scores 0; without rows of both labels to learn from, all score their share of label 1; repeated rows
each get a row; an empty table gives no rows. Where doc_id has several labels, the highest counts. Other columns stay as they are, and where one is
called _score the new one gets underscores after that name; it is always the last.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import gru
from ..session import written
from .common import bounded_sample, table, unused, window_of

TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str | None, longest: int = 40) -> list[str]:
    """Runs of letters and digits in lower case; longer ones as overlapping pieces of `longest` characters, the last one flush with the end."""
    out = TOKEN.findall(text.lower()) if text else []
    if all(len(w) <= longest for w in out):
        return out
    cut = lambda w: [w[i : i + longest] for i in (*range(0, len(w) - longest, longest // 2), len(w) - longest)] if len(w) > longest else [w]
    return [piece for w in out for piece in cut(w)]


def gram_ids(words: list[bytes], grams: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: which words, and the rows of all their character grams."""
    by_length = defaultdict(lambda: ([], []))
    for k, w in enumerate(words):
        w = b"<" + w + b">"
        by_length[len(w)][0].append(k)
        by_length[len(w)][1].append(w)
    out = {}
    for n, (at, rows) in by_length.items():
        b = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, n).astype(np.uint64)
        parts = []
        for size in (3, 4):
            if n >= size:
                h = np.zeros((len(b), n - size + 1), np.uint64)
                for j in range(size):
                    h = (h + b[:, j : n - size + 1 + j] + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                parts.append((h >> np.uint64(20)) % np.uint64(grams))
        out[n] = (np.array(at), np.concatenate(parts, axis=1).astype(np.int64))
    return out


def windows(n: int, window: int) -> list[tuple[int, int]]:
    """Begins and ends of overlapping windows over n words, the last one flush with the end."""
    if n <= window:
        return [(0, n)] if n else []
    begins = [*range(0, n - window, window // 2), n - window]
    return [(b, b + window) for b in begins]


class Scorer:
    def __init__(self, vocabulary: dict[str, int], grams: int, width: int, hidden: int, window: int, seed: int):
        rng = np.random.default_rng(seed)
        self.vocabulary, self.grams, self.window, self.hidden = vocabulary, grams, window, hidden
        self.p = {"words": gru.weights(rng, len(vocabulary) + 1, width, scale=0.1), "chars": gru.weights(rng, grams, width, scale=0.1)}
        for d in "fb":
            self.p |= {"x" + d: gru.weights(rng, 2 * width, 3 * hidden), "b" + d: np.zeros(3 * hidden, np.float32), "u" + d: gru.weights(rng, hidden, 3 * hidden)}
        self.p |= {"a": gru.weights(rng, 2 * hidden, hidden), "v": gru.weights(rng, hidden), "o": gru.weights(rng, 2 * hidden), "c": np.zeros(1, np.float32)}

    def vectors(self, words: list[str]) -> np.ndarray:
        """[word, 2 * width]: word and character inputs."""
        own = self.p["words"][[self.vocabulary.get(w, 0) for w in words]] if words else np.zeros((0, self.p["words"].shape[1]), np.float32)
        chars = np.zeros((len(words), self.p["chars"].shape[1]), np.float32)
        for at, ids in gram_ids([w.encode() for w in words], self.grams).values():
            for i in range(0, len(at), 4096):
                chars[at[i : i + 4096]] = self.p["chars"][ids[i : i + 4096]].mean(axis=1)
        return np.concatenate((own, chars), axis=1)

    def projected(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        return {d: vectors @ self.p["x" + d] + self.p["b" + d] for d in "fb"}

    def logits(self, projected: dict[str, np.ndarray], ids: np.ndarray, keep: bool = False):
        """Of windows given as rows of word numbers, all of one length."""
        both = [gru.forward(lambda t, x=projected[d]: x[ids[:, t]], ids.shape[1], self.p["u" + d], d == "b", keep) for d in "fb"]
        h = np.concatenate([b[0] for b in both], axis=2)
        s = np.tanh(h @ self.p["a"])
        e = s @ self.p["v"]
        e = np.exp(e - e.max(axis=0))
        e /= e.sum(axis=0)
        pooled = (e[:, :, None] * h).sum(axis=0)
        out = pooled @ self.p["o"] + self.p["c"]
        return (out, h, s, e, pooled, [b[1] for b in both]) if keep else out

    def gradients(self, vectors: np.ndarray, ids: np.ndarray, label: np.ndarray):
        """Of the mean cross entropy: of the parameters past the vectors, and of the vectors."""
        out, h, s, e, pooled, tapes = self.logits(self.projected(vectors), ids, keep=True)
        d = (gru.sigmoid(out.astype(np.float32)) - label) / np.float32(len(ids))
        g = {"o": pooled.T @ d, "c": d.sum(keepdims=True)}
        d_pooled = d[:, None] * self.p["o"]
        d_e = (d_pooled * h).sum(axis=2)
        d_e = e * (d_e - (e * d_e).sum(axis=0))
        g["v"] = np.einsum("tb,tbk->k", d_e, s)
        d_s = d_e[:, :, None] * self.p["v"] * (1 - s * s)
        g["a"] = np.einsum("tbh,tbk->hk", h, d_s, optimize=True)
        d_h = e[:, :, None] * d_pooled + d_s @ self.p["a"].T
        d_vectors = np.zeros_like(vectors)
        for k, way in enumerate("fb"):
            d_in, g["u" + way] = gru.backward(d_h[:, :, k * self.hidden : (k + 1) * self.hidden], tapes[k], self.p["u" + way])
            by_word = np.zeros((len(vectors), d_in.shape[2]), np.float32)
            np.add.at(by_word, ids.T, d_in)
            g["x" + way], g["b" + way] = vectors.T @ by_word, by_word.sum(axis=0)
            d_vectors += by_word @ self.p["x" + way].T
        return g, d_vectors

    def scores(self, projected: dict[str, np.ndarray], documents: list[np.ndarray], batch: int = 4096) -> tuple[list[np.ndarray], list[list[tuple[int, int]]]]:
        """For each document (word numbers): its windows' logits and places."""
        places = [windows(len(d), self.window) for d in documents]
        out = [np.empty(len(p), np.float32) for p in places]
        by_length = defaultdict(list)
        for k, p in enumerate(places):
            if p:
                by_length[p[0][1] - p[0][0]].append(k)
        for n, docs in by_length.items():
            begins = [np.array([a for a, _ in places[k]], np.int64) for k in docs]
            flat, shift = np.concatenate([documents[k] for k in docs]), np.cumsum([0] + [len(documents[k]) for k in docs])
            starts = np.concatenate([b + s for b, s in zip(begins, shift, strict=False)])
            got = np.empty(len(starts), np.float32)
            for i in range(0, len(starts), batch):
                got[i : i + batch] = self.logits(projected, flat[starts[i : i + batch, None] + np.arange(n)])
            for k, part in zip(docs, np.split(got, np.cumsum([len(b) for b in begins])[:-1]), strict=True):
                out[k] = part
        return out, places


def odds(documents: Iterable[np.ndarray], labels: np.ndarray, n: int) -> np.ndarray:
    """Log odds of label 1, by number, over those of any document; shrunk to 0 as if eight documents of the usual share had it too."""
    up, down, share = np.zeros(n), np.zeros(n), labels.mean()
    for d, y in zip(documents, labels, strict=True):
        (up if y else down)[np.unique(d)] += 1
    p = (up + 8 * share) / (up + down + 8)
    return np.log(p / (1 - p)) - np.log(share / (1 - share))


def train(rows: list[tuple[str, int]], grams: int, width: int, hidden: int, window: int, epochs: int, windows_up: int, seed: int, least_steps: int = 300) -> Scorer | float:
    """A scorer from (text, label), or the share of label 1 where one label is missing. Few rows are gone over more often, for least_steps steps in all."""
    labels = np.array([y for _, y in rows], np.int64)
    if not len(rows) or labels.min() == labels.max():
        return float(labels.mean()) if len(rows) else 0.0
    rng = np.random.default_rng(seed)
    number: defaultdict = defaultdict(count().__next__)
    documents = [np.array([number[w] for w in tokens(text)], np.int32) for text, _ in rows]
    del rows
    words, n = list(number), len(number)
    in_docs = np.zeros(n, np.int32)
    for d in documents:
        in_docs[np.unique(d)] += 1
    common = [w for w in range(n) if in_docs[w] >= 3]
    model = Scorer({words[w]: k + 1 for k, w in enumerate(common)}, grams, width, hidden, window, seed)
    vocabulary = np.zeros(n, np.int64)
    vocabulary[common] = np.arange(len(common)) + 1
    lengths = np.zeros(n, np.int64)
    by_length = gram_ids([w.encode() for w in words], grams)
    for at, ids in by_length.values():
        lengths[at] = ids.shape[1]
    begins = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    flat = np.empty(int(lengths.sum()), np.int32)
    for at, ids in by_length.values():
        flat[begins[at][:, None] + np.arange(ids.shape[1])] = ids
    del by_length

    def grams_in(used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Grams of words, and the place in `used` of the word of each."""
        sizes = lengths[used]
        take = np.repeat(begins[used] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        return flat[take], np.repeat(np.arange(len(used)), sizes)

    word_odds = odds(documents, labels, n)
    gram_odds = odds((grams_in(np.unique(d))[0] for d in documents), labels, grams)  # a text's grams at a time
    model.p["words"][1:, 0] = word_odds[common]
    model.p["chars"][:, 0] = gram_odds
    looks = word_odds * (vocabulary > 0) + np.add.reduceat(gram_odds[flat], begins) / lengths
    adams = {"past": gru.Adam({k: v for k, v in model.p.items() if k not in ("words", "chars")}, 0.01), "vectors": gru.Adam({k: model.p[k] for k in ("words", "chars")}, 0.005)}
    places = [windows(len(d), window) for d in documents]

    def ranked() -> list[np.ndarray]:
        out = []
        for i in range(0, len(documents), 200):
            part = documents[i : i + 200]
            used, ids = np.unique(np.concatenate(part), return_inverse=True)
            cut = np.split(ids, np.cumsum([len(d) for d in part])[:-1])
            out += model.scores(model.projected(model.vectors([words[w] for w in used])), cut, 512)[0]
        return out

    score = [np.array([looks[d[a:b]].max() for a, b in p]) for d, p in zip(documents, places, strict=True)]
    steps, epoch = 0, 0
    while epoch < epochs or steps < least_steps:
        epoch += 1
        chosen = []
        for d, p, s, y in zip(documents, places, score, labels, strict=True):
            worst = [int(k) for k in np.argsort(-s, kind="stable")[: windows_up if y else 4]]
            if y and len(worst) > 1:
                worst = worst[:1] + [k for k in worst[1:] if s[k] >= s[worst[0]] - 1]
            picks = worst if y else {*worst, *(int(k) for k in rng.integers(0, len(p), 3))} if p else ()
            chosen += [(p[k][1] - p[k][0], d[p[k][0] : p[k][1]], y) for k in picks]
        by_length = defaultdict(list)
        for size, ids, y in chosen:
            by_length[size].append((ids, y))
        batches = [[group[k] for k in part] for group in by_length.values() for part in np.array_split(rng.permutation(len(group)), -(-len(group) // 128))]
        steps += len(batches)
        for k in rng.permutation(len(batches)):
            ids, y = np.stack([i for i, _ in batches[k]]), np.array([y for _, y in batches[k]], np.float32)
            used, ids = np.unique(ids, return_inverse=True)
            ids = ids.reshape(len(y), -1)
            gram, of = grams_in(used)
            sizes = lengths[used]
            chars = np.zeros((len(used), width), np.float32)
            np.add.at(chars, of, model.p["chars"][gram])
            vectors = np.concatenate((model.p["words"][vocabulary[used]], chars / sizes[:, None].astype(np.float32)), axis=1)
            g, d_vectors = model.gradients(vectors, ids, y)
            d_words, d_chars = np.zeros_like(model.p["words"]), np.zeros_like(model.p["chars"])
            np.add.at(d_words, vocabulary[used], d_vectors[:, :width])
            np.add.at(d_chars, gram, (d_vectors[:, width:] / sizes[:, None])[of].astype(np.float32))
            adams["past"].step(g)
            adams["vectors"].step({"words": d_words, "chars": d_chars})
        for a in adams.values():
            a.rate *= 0.7 ** min(1.0, len(batches) * epochs / least_steps)
        score = ranked()
    return model


def sample(docs: DataFrame, labels: DataFrame, label: str, may_learn: Column, per_class: int, max_chars: int) -> list[tuple[str, int]]:
    """(text, label) of the rows to learn from, in a fixed order. Documents are chosen first by the hash of doc_id, then, where a doc_id has many texts, by that of the text."""
    known = labels.where(may_learn & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}  # two rows
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for y in (0, 1) for x in (y, int(min(1.0, per_class / max(1, counts.get(y, 0))) * (1 << 30)))])
    picked = known.where(place < share[F.col("y")])  # about per_class distinct doc_ids of each label: so many are sent to the tasks
    texts = docs.where(F.length("text") > 0).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = written(texts.select("text", "y").distinct(), "sample")
    chosen = bounded_sample(rows.where("y = 1"), 2 * per_class).unionByName(bounded_sample(rows.where("y = 0"), 2 * per_class))
    n, total = chosen.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    most = max_chars // n if total > max_chars else max_chars
    return sorted((r["text"], r["y"]) for r in chosen.select(window_of(F.col("text"), most).alias("text"), "y").collect())


def score(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    may_learn: Column | None = None,
    per_class: int = 1800,
    max_chars: int = 50_000_000,
    grams: int = 1 << 14,
    width: int = 8,
    hidden: int = 12,
    window: int = 32,
    epochs: int = 5,
    windows_up: int = 2,
    kept_words: int = 150_000,
    seed: int = 5,
) -> DataFrame:
    """docs with _score, the last column. A task keeps the inputs of up to kept_words distinct words at a time."""
    name = unused(docs.columns, "_score")
    model = train(sample(docs, labels, label, F.lit(True) if may_learn is None else may_learn, per_class, max_chars), grams, width, hidden, window, epochs, windows_up, seed)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        number: defaultdict = defaultdict(count().__next__)
        projected = None
        for batch in batches:
            texts = batch.column("text")
            out = np.full(len(texts), model if isinstance(model, float) else 0.0)
            begin = 0
            while begin < len(texts) and not isinstance(model, float):
                documents, size, end = [], 0, begin
                while end < len(texts) and size < 200_000:
                    w = tokens(texts[end].as_py())
                    documents.append(np.fromiter(map(number.__getitem__, w), np.int64, len(w)))
                    size, end = size + len(w), end + 1
                fresh = list(number)[0 if projected is None else len(projected["f"]) :]
                if fresh:
                    more = model.projected(model.vectors(fresh))
                    projected = more if projected is None else {d: np.concatenate((projected[d], more[d])) for d in "fb"}
                if projected is not None:
                    logits, _ = model.scores(projected, documents)
                    out[begin:end] = [1 / (1 + np.exp(-float(s.max()))) if len(s) else 0.0 for s in logits]
                if len(number) > kept_words:
                    number, projected = defaultdict(count().__next__), None
                begin = end
            yield batch.append_column(name, pa.array(out, pa.float64()))

    return docs.mapInArrow(judged, schema)


def op5_toxicity(spark, sf_dir) -> DataFrame:
    left = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5
    scored = score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), may_learn=left != 0)
    return scored.select("doc_id", (left == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
