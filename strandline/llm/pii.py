"""Personal data by candidates and gradient boosting.

Generators of high recall propose overlapping spans: whatever looks like an e-mail address (also spelled with at and dot), an
IP address (also version 6), and every run of digit groups, in every stretch of groups that could be a card or telephone number. Boosted
trees score each by its format and its surroundings; a span is redacted if its score passes its kind's threshold, which is
calibrated on candidates kept back from training so that `precision` of those over it are right. Of overlapping spans the higher score
wins. Spans of the base rules always stay.

Learning: candidates in about sample_docs texts that have a digit or an @ (by hash; of a text of over max_chars characters, that many from a place that its hash
gives), labelled by the base rules, and `planted` made-up values in other notations, and numbers that are none, put into the words of these documents.

Spans are (kind, start, end) in code points, end exclusive, by kind as listed, then start.

Defined results: a null or empty text has no spans; repeated rows each get a row; an empty table gives no rows; other columns stay as they are, and where
one is called _base or _spans the new one gets underscores after that name: they are always the last two.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, table, unused, window_of
from .trees import Boosted

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SPELLED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:\s?[\[({]\s?(?:at|AT|@)\s?[\])}]\s?|\s(?:at|AT)\s|@)"
    r"[A-Za-z0-9-]{1,63}(?:(?:\s?[\[({]\s?(?:dot|DOT|\.)\s?[\])}]\s?|\s(?:dot|DOT)\s|\.)[A-Za-z0-9-]{2,63}){1,3}"
)
IP6 = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Fa-f:])")
RUN = re.compile(r"[+(]{0,2}[0-9](?:[\x20().-]{0,2}[0-9])+")
GROUP = re.compile(r"[0-9]+")
HAS_DIGIT = re.compile(r"[0-9]")
CUES = {
    "email": re.compile(r"(?i)mail|contact|write|reply"),
    "ip": re.compile(r"(?i)\bip|host|server|address|login"),
    "card": re.compile(r"(?i)card|visa|credit|debit|payment|account"),
    "phone": re.compile(r"(?i)phone|tel\b|tel[.:]|call|mobile|fax|whatsapp"),
}
OTHER = re.compile(r"(?i)version|isbn|order|date|page|licen[cs]e|invoice|number|\bno\b|\bid\b")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(GROUP.findall(s))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, @ and domain, found from each @ outwards: linear in any text."""
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if HAS_DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
        out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping spans that may be personal data."""
    found = set()
    if "@" in text:
        found.update(("email", a, b) for a, b in emails(text))
    if "dot" in text or "DOT" in text or "@" in text:
        found.update(("email", m.start(), m.end()) for m in SPELLED.finditer(text))
    if not HAS_DIGIT.search(text):
        return sorted(found)
    found.update(("ip", m.start(), m.end()) for m in IP.finditer(text))
    if ":" in text:
        found.update(("ip", m.start(), m.end()) for m in IP6.finditer(text) if HAS_DIGIT.search(m[0]))
    for m in RUN.finditer(text):
        groups = [(g.start() + m.start(), g.end() + m.start()) for g in GROUP.finditer(m[0])]
        for i, (a, _) in enumerate(groups):
            n = 0
            for x, b in groups[i : i + 19]:
                n += b - x
                if n > 19:
                    break
                begin = a
                while begin > m.start() and text[begin - 1] in "+(":
                    begin -= 1
                if 13 <= n <= 19:
                    found.add(("card", a, b))
                if 7 <= n <= 15:
                    found.add(("phone", begin, b))
    return sorted(found)


def kind_of(c: str) -> int:
    return 1 if c.isdigit() else 2 if c.isalpha() else 3 if c.isspace() else 4 if c in ".,;:!?)\"'" else 5


def features(text: str, kind: str, a: int, b: int) -> list[float]:
    s = text[a:b]
    d = digits_of(s)
    groups = [len(g) for g in GROUP.findall(s)]
    before, after = text[max(0, a - 24) : a], text[b : b + 24]
    parts = s.split(".")
    return [
        *(float(kind == k) for k in KINDS),
        len(s), len(d), sum(c.isalpha() for c in s), len(groups), max(groups, default=0), min(groups, default=0), len(set(d)),
        s[0] == "+", s[0] == "(", s.count(" "), s.count("-"), s.count("."), s.count("(") + s.count(")"), s.count(":"), s.count("@"),
        luhn(d) if d else 0, len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts), any(p[:1] == "0" and len(p) > 1 for p in parts),
        len(parts[-1]), bool(re.search(r"(?i)\bdot\b", s)), "555" in d,
        kind_of(before[-1]) if before else 0, kind_of(after[0]) if after else 0, before[-1:] in "+.-@/" and before != "", after[:1] in "-@/" and after != "",
        len(GROUP.findall(before)), len(GROUP.findall(after)), bool(CUES[kind].search(before)), bool(OTHER.search(before)),
    ]


def made_up(rng: np.random.Generator) -> tuple[str, str, bool]:
    """kind, string, whether it is personal data: notations beyond the base rules', and lookalikes."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    w = lambda n: "".join(rng.choice(list(string.ascii_lowercase), n))
    pick = lambda *x: x[int(rng.integers(len(x)))]

    def card(n: int, good: bool) -> str:
        body = pick("4", "5", "37") + d(n)
        body = body[: n - 1]
        body += str((10 - sum((int(c) if k % 2 else int(c) * 2 - 9 * (int(c) > 4)) for k, c in enumerate(reversed(body))) % 10) % 10)
        if not good:
            body = body[:-1] + str((int(body[-1]) + int(rng.integers(1, 10))) % 10)
        cut = pick("", " ", "-")
        return cut.join(body[i : i + 4] for i in range(0, len(body), 4)) if cut else body

    return pick(
        lambda: ("email", f"{w(6)} at {w(5)} dot {pick('com', 'org', 'net', 'de')}", True),
        lambda: ("email", f"{w(5)}.{w(4)}{pick('@', ' [at] ', '(at)')}{w(6)}{pick('.', ' [dot] ', '(dot)')}{pick('com', 'org', 'net')}", True),
        lambda: ("email", f"{w(4)} at {w(2)} dot {w(2)}{w(7)}", False),
        lambda: ("ip", ".".join(str(rng.integers(1, 256)) for _ in range(4)), True),
        lambda: ("ip", ".".join(str(rng.integers(200, 999)) for _ in range(4)), False),
        lambda: ("ip", ":".join(f"{int(rng.integers(0, 65536)):x}" for _ in range(8)), True),
        lambda: ("ip", ":".join(d(2) for _ in range(4)), False),
        lambda: ("card", card(16, True), True),
        lambda: ("card", card(15, True), True),
        lambda: ("card", card(16, False), False),
        lambda: ("card", d(int(rng.integers(13, 20))), False),
        lambda: ("phone", f"({d(3)}) {d(3)}-{d(4)}", True),
        lambda: ("phone", f"{d(3)}-{d(3)}-{d(4)}", True),
        lambda: ("phone", f"+{d(2)} {d(3)} {d(4)} {d(3)}", True),
        lambda: ("phone", f"00{d(2)} {d(3)} {d(6)}", True),
        lambda: ("phone", f"{pick('19', '20')}{d(2)}-{d(2)}-{d(2)}", False),
        lambda: ("phone", d(int(rng.integers(7, 13))), False),
        lambda: ("phone", f"{d(1)}.{d(3)}.{d(3)}", False),
        lambda: ("phone", f"{d(4)} {d(4)}", False),
    )()


class Redactor:
    """Trees and thresholds by kind."""

    def __init__(self, texts: list[str], planted: int, precision: float, seed: int):
        rng = np.random.default_rng(seed)
        x, y, kinds = [], [], []

        def learn(text: str, kind: str, a: int, b: int, good: bool) -> None:
            x.append(features(text, kind, a, b))
            y.append(float(good))
            kinds.append(kind)

        for text in texts:
            base = base_spans(text)
            for kind, a, b in candidates(text):
                if (kind, a, b) in base or all(b <= s or e <= a for _, s, e in base) or rng.random() < 0.2:
                    learn(text, kind, a, b, (kind, a, b) in base)
        words = [w for t in texts for w in t.split() if w.isalpha()][:20_000] or ["and", "the", "of"]
        some = lambda: " ".join(rng.choice(words, 6))
        for _ in range(planted):
            kind, s, good = made_up(rng)
            cue = "" if rng.random() < 0.7 else {"email": "mail ", "ip": "server ", "card": "card ", "phone": "tel. "}[kind] if good else "order no. "
            lead = f"{some()} {cue}"
            number = "" if rng.random() < 0.8 else " " + "-".join(str(rng.integers(1, 3000)) for _ in range(rng.integers(1, 4)))
            text = f"{lead}{s}{number} {some()}"
            for k, a, b in candidates(text):
                whole = (k, a, b) == (kind, len(lead), len(lead) + len(s))
                if whole or rng.random() < 0.5:
                    learn(text, k, a, b, good and whole)
        x, y, kinds = np.array(x, np.float64), np.array(y), np.array(kinds)
        back = rng.random(len(y)) < 0.25
        self.trees = Boosted().fit(x[~back], y[~back])
        p = self.trees.predict(x[back])
        self.threshold = {}
        for kind in KINDS:
            of = kinds[back] == kind
            order = np.argsort(-p[of], kind="stable")
            right = np.cumsum(y[back][of][order]) / (np.arange(len(order)) + 1)
            fine = np.flatnonzero(right >= precision)
            self.threshold[kind] = max(0.5, float(p[of][order][fine[-1]])) if len(fine) else 1.1

    def spans(self, text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Base spans and all spans."""
        text = text or ""
        base = base_spans(text)
        rest = [c for c in candidates(text) if all(c[2] <= s or e <= c[1] for _, s, e in base)]
        taken = list(base)
        if rest:
            p = self.trees.predict(np.array([features(text, *c) for c in rest], np.float64))
            for i in np.argsort(-p, kind="stable"):
                kind, a, b = rest[i]
                if p[i] >= self.threshold[kind] and all(b <= s or e <= a for _, s, e in taken[len(base) :]):
                    taken.append((kind, a, b))
        by = lambda s: (KINDS.index(s[0]), s[1], s[2])
        return sorted(base, key=by), sorted(taken, key=by)


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find(docs: DataFrame, sample_docs: int = 2000, max_chars: int = 20_000, planted: int = 4000, precision: float = 0.97, seed: int = 2) -> DataFrame:
    """docs with _base and _spans, the last two columns."""
    usable = docs.select(window_of(F.col("text"), max_chars).alias("text")).where(F.col("text").rlike("[0-9@]"))
    sample = sorted(r["text"] for r in bounded_sample(usable, sample_docs).collect())
    sent = docs.sparkSession.sparkContext.broadcast(Redactor(sample, planted, precision, seed))
    names = unused(docs.columns, "_base"), unused(docs.columns, "_spans")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, SPANS) for c in names)])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        redactor = sent.value
        named = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for batch in batches:
            both = [redactor.spans(t.as_py()) for t in batch.column("text")]
            yield batch.append_column(names[0], pa.array([named(b) for b, _ in both], SPANS_ARROW)).append_column(names[1], pa.array([named(s) for _, s in both], SPANS_ARROW))

    return docs.mapInArrow(judged, schema)


def redact(docs: DataFrame, **parameters) -> DataFrame:
    """docs with each span of text, overlapping ones joined, put as its kind in brackets."""
    found = find(docs, **parameters)
    spans = F.col(found.columns[-1])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    cut = F.aggregate(
        ordered,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda s, x: F.when(x["end"] <= s["at"], s)
        .when(x["start"] < s["at"], F.struct(s["out"].alias("out"), x["end"].alias("at")))
        .otherwise(F.struct(F.concat(s["out"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out"), x["end"].alias("at"))),
        lambda s: F.concat(s["out"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.length("text"))),
    )
    return found.withColumn("text", F.when(F.size(spans) > 0, cut).otherwise(F.col("text"))).select(*docs.columns)


def op2_pii(spark, sf_dir) -> DataFrame:
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *map(n, KINDS), F.sha2(joined("_base"), 256).alias("base_sha256"), joined("_spans").alias("spans"))
