"""Language identification by a bidirectional gated recurrent network over bytes.

The network, its gates by the hard sigmoid, reads a text's bytes in both directions, across words, and labels every position with probabilities of the languages. A text is read
in windows of `window` bytes; each window also reads `margin` bytes before and after, so that its states are warm where its own positions begin, and
only its own positions count. A document's probabilities are the mean over all positions of the whole text.

Training is by backpropagation through time in numpy, on the driver, over about rows distinct texts, an equal share of each language, fewer where it has fewer, one at least
(chosen by hash; of a text of over max_chars characters, that many from a place that its hash gives). A position's label is its document's language.
Every language that has a row to learn from can be predicted: their number is that of the distinct values of lang, which the model holds.

Defined results: `und` with score 0 for a null text or one without a letter, and where there is nothing to learn from; repeated
rows each get a row; an empty table gives no rows; other columns stay as they are, and where one is called _lang or _score the new one gets underscores after
that name: they are always the last two.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import gru
from .common import table, unused, window_of

#: A letter, or a number that isn't a digit (² or ½): has_letter tells them apart.
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


class ByteTagger:
    """Byte inputs, hidden states both ways, languages out at every position."""

    def __init__(self, languages: list[str], hidden: int, window: int, margin: int, seed: int):
        rng = np.random.default_rng(seed)
        self.languages, self.window, self.margin = languages, window, margin
        self.p = {f"{k}{d}": gru.weights(rng, *shape, scale=scale) for d in "fb" for k, shape, scale in (("x", (256, 3 * hidden), 0.3), ("u", (hidden, 3 * hidden), None))}
        self.p |= {"o": gru.weights(rng, 2 * hidden, len(languages)), "c": np.zeros(len(languages), np.float32)}

    def states(self, rows: np.ndarray, keep: bool = False):
        both = [gru.forward(lambda t, x=self.p["x" + d]: x[rows[:, t]], rows.shape[1], self.p["u" + d], d == "b", keep, hard=True) for d in "fb"]
        return np.concatenate([b[0] for b in both], axis=2), [b[1] for b in both]

    def probabilities(self, rows: np.ndarray, keep: bool = False):
        """[position, row, language], the states, and what backpropagation needs."""
        h, tapes = self.states(rows, keep)
        logits = h @ self.p["o"] + self.p["c"]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        return e / e.sum(axis=2, keepdims=True), h, tapes

    def gradients(self, rows: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy of all positions."""
        p, h, tapes = self.probabilities(rows, keep=True)
        steps, hidden = rows.shape[1], h.shape[2] // 2
        p[:, np.arange(len(rows)), label] -= 1
        d = (p / (len(rows) * steps)).astype(h.dtype)
        g = {"o": np.einsum("tbh,tbk->hk", h, d, optimize=True), "c": d.sum(axis=(0, 1))}
        d_h = d @ self.p["o"].T
        for k, way in enumerate("fb"):
            d_in, g["u" + way] = gru.backward(d_h[:, :, k * hidden : (k + 1) * hidden], tapes[k], self.p["u" + way], hard=True)
            g["x" + way] = np.zeros_like(self.p["x" + way])
            np.add.at(g["x" + way], rows.T, d_in)
        return g

    def fit(self, rows: np.ndarray, labels: np.ndarray, epochs: int, batch: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        adam = gru.Adam(self.p, 0.01)
        for epoch in range(epochs):
            adam.rate = 0.01 * (1 - epoch / epochs)
            for at in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
                adam.step(self.gradients(rows[at], labels[at]))

    def sums(self, rows: np.ndarray, length: np.ndarray) -> np.ndarray:
        """[row, language]: probabilities summed over each row's own positions, `length` of them after the first margin. States lie feature by feature, which is quickest."""
        steps, hidden = rows.shape[1], self.p["uf"].shape[0]
        at = np.ascontiguousarray(rows.T).astype(np.intp)
        logits = np.empty((steps, len(self.languages), len(rows)), np.float32)
        logits[:] = self.p["c"][:, None]
        for k, way in enumerate("fb"):
            x, u = np.ascontiguousarray(self.p["x" + way].T), np.ascontiguousarray(self.p["u" + way].T)
            o = np.ascontiguousarray(self.p["o"][k * hidden : (k + 1) * hidden].T)
            # The slope of the gates goes into their weights.
            x[: 2 * hidden] = x[: 2 * hidden] * 0.25 + 0.5
            u[: 2 * hidden] *= 0.25
            h = np.zeros((hidden, len(rows)), np.float32)
            v = np.empty((3 * hidden, len(rows)), np.float32)
            for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
                np.take(x, at[t], axis=1, out=v, mode="clip")
                a = u @ h
                gates = v[: 2 * hidden]
                gates += a[: 2 * hidden]
                np.clip(gates, 0, 1, out=gates)
                new, rest = v[2 * hidden :], a[2 * hidden :]
                rest *= gates[hidden:]
                new += rest
                np.tanh(new, out=new)
                h -= new
                h *= gates[:hidden]
                h += new
                logits[t] += o @ h
        own = logits[self.margin : steps - self.margin]
        own -= own.max(axis=1, keepdims=True)
        np.exp(own, out=own)
        own *= ((np.arange(len(own))[:, None] < length) / own.sum(axis=1))[:, None, :].astype(np.float32)
        return own.sum(axis=0).T.astype(np.float64)

    def document_sums(self, texts: list[bytes], batch: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """For each text: probabilities summed over all its positions, and the number of these."""
        out, sizes = np.zeros((len(texts), len(self.languages))), np.array([len(t) for t in texts], np.int64)
        # Texts lie one after another, spaces between them: a margin never reads another text.
        gap = b" " * self.margin
        flat = np.frombuffer(gap + gap.join(texts) + gap + b" " * self.window, np.uint8)
        starts = self.margin + np.cumsum(np.concatenate(([0], (sizes + self.margin)[:-1]))) if len(texts) else np.zeros(0, np.int64)
        n = -(-sizes // self.window)
        of = np.repeat(np.arange(len(texts)), n)
        place = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * self.window
        length = np.minimum(self.window, sizes[of] - place)
        # Last windows are filled up with spaces to one of a few lengths.
        steps = -(-length // 48) * 48
        for step in np.unique(steps):
            which = np.flatnonzero(steps == step)
            for i in range(0, len(which), batch):
                w = which[i : i + batch]
                across = np.arange(step + 2 * self.margin)
                rows = flat[(starts[of[w]] + place[w] - self.margin)[:, None] + across]
                rows[across >= np.minimum(length[w] + self.margin + self.margin * (place[w] + length[w] < sizes[of[w]]), len(across))[:, None]] = 32
                np.add.at(out, of[w], self.sums(rows, length[w]))
        return out, sizes


def sample(docs: DataFrame, may_learn: Column, rows: int, max_chars: int) -> list[tuple[str, str]]:
    """(lang, text) to learn from, in a fixed order."""
    usable = docs.where(may_learn & F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", window_of(F.col("text"), max_chars).alias("text"))
    key = F.xxhash64("lang", "text")
    # A row a language: how many distinct texts it has, told by a sketch, and one of them, so that none is left without any.
    told = usable.groupBy("lang").agg(F.approx_count_distinct(key, 0.02).alias("n"), F.min_by("text", key).alias("text")).collect()
    counts = {r["lang"]: max(1, r["n"]) for r in told}
    if not counts:
        return []
    share = {lang: min(1.0, 1.1 * rows / len(counts) / n) for lang, n in counts.items()}
    limits = docs.sparkSession.createDataFrame([(lang, int(x * (1 << 30))) for lang, x in share.items()], "lang string, limit long")
    picked = usable.join(F.broadcast(limits), "lang").where(F.pmod(key, F.lit(1 << 30)) < F.col("limit"))
    return sorted({(r["lang"], r["text"]) for r in [*told, *picked.select("lang", "text").distinct().collect()]})


def train(rows: list[tuple[str, str]], hidden: int, epochs: int, window: int, margin: int, windows: int, seed: int, length: int = 64) -> ByteTagger | None:
    """A tagger from (lang, text): `windows` pieces of `length` bytes, as many of each language, from places drawn at random."""
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    pieces, labels = [], []
    for k, lang in enumerate(languages):
        texts = [t.encode() for own, t in rows if own == lang]
        weights = np.array([len(t) for t in texts], np.float64)
        for i in rng.choice(len(texts), size=-(-windows // len(languages)), p=weights / weights.sum()):
            t = texts[i]
            at = int(rng.integers(0, max(1, len(t) - length + 1)))
            pieces.append(t[at : at + length].ljust(length))
            labels.append(k)
    model = ByteTagger(languages, hidden, window, margin, seed)
    model.fit(np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, length), np.array(labels), epochs, 128, seed)
    return model


def identify(
    docs: DataFrame, may_learn: Column | None = None, rows: int = 2000, max_chars: int = 4_000, windows: int = 8_000, hidden: int = 12, epochs: int = 3, window: int = 240, margin: int = 8, seed: int = 7
) -> DataFrame:
    """docs with _lang and _score, the last two columns."""
    model = train(sample(docs, F.lit(True) if may_learn is None else may_learn, rows, max_chars), hidden, epochs, window, margin, windows, seed)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = unused(docs.columns, "_lang"), unused(docs.columns, "_score")
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = batch.column("text")
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            begin = 0
            while begin < len(texts) and model is not None:
                some, size, end = {}, 0, begin
                while end < len(texts) and size < 12_000_000:
                    t = texts[end].as_py()
                    if t and has_letter(t):
                        some[end] = t.encode()
                        size += len(some[end])
                    end += 1
                for k, total, n in zip(some, *model.document_sums(list(some.values())), strict=True):
                    best = int(total.argmax())
                    langs[k], scores[k] = model.languages[best], min(1.0, float(total[best] / n))
                begin = end
            yield batch.append_column(names[0], pa.array(langs, pa.string())).append_column(names[1], pa.array(scores, pa.float64()))

    return docs.mapInArrow(label, schema)


def op7_language(spark, sf_dir) -> DataFrame:
    left = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, left != 2).select("doc_id", (left == 2).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
