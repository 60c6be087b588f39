"""Secret scan, in DataFrame operations only.

Base rules: assignments to names like password or token, access keys, long hexadecimal runs. The method adds runs of
key characters whose Shannon entropy, in a window of `window` characters that slides along the run, gets over the limit
of the run's character class (hexadecimal, letters and digits of one case, of both cases, with signs). The window's counts are kept incrementally: a step
adds one character and takes one away, and the sum of c * log2(c) changes by those two. Runs that hold an allow-listed string, or that overlap
a base span, are suppressed.

Spans are (kind, start, end) in code points, end exclusive. Java's regular expressions walk the text once for the pieces
between matches and once for the matches; running sums of lengths give the places, and running ends and starts tell which runs overlap a base span: no step looks at all spans.

Defined results: a null or empty text has no spans; repeated rows each get a row; an empty table gives no rows; other columns stay as they are, and where
one is called base or spans the new one gets underscores after that name: they are always the last two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running, table, unused

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
#: Runs of key characters long enough for a window; only those with a digit and a letter are weighed.
RUN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Entropy limits in bits by character class, for a window of 20.
LIMITS = {"hex": 3.0, "lower": 3.6, "mixed": 3.7, "signs": 3.8}
#: Strings that mark a run as no secret.
ALLOW = ("EXAMPLE", "example", "0123456789", "abcdefghij", "ABCDEFGHIJ", "sha256-", "sha384-", "sha512-")
EMPTY = "array<struct<kind:string,start:bigint,end:bigint,body:string>>"


def found(text: Column, pattern: str, kind: str, body_group: int = 0) -> Column:
    """Spans of all matches of pattern: kind, start, end, body (the group's text)."""
    whole = F.regexp_extract_all(text, F.lit(pattern), 0)
    bodies = whole if body_group == 0 else F.regexp_extract_all(text, F.lit(pattern), body_group)
    pieces = F.split(text, pattern, -1)
    each = F.transform(F.arrays_zip(F.slice(pieces, F.lit(1), F.size(whole)).alias("p"), whole.alias("m"), bodies.alias("b")), lambda x: F.struct(F.length(x["p"]).cast("long").alias("gap"), F.length(x["m"]).cast("long").alias("n"), x["b"].alias("b")))

    def placed(spans):
        starts = running(F.transform(spans, lambda x: x["gap"] + x["n"]), F.lit(0).cast("long"), lambda a, b: a + b)
        return F.transform(F.arrays_zip(spans.alias("x"), starts.alias("at")), lambda z: let(z["at"] + z["x"]["gap"], lambda begin: F.struct(F.lit(kind).alias("kind"), begin.alias("start"), (begin + z["x"]["n"]).alias("end"), z["x"]["b"].alias("body"))))

    return F.when(F.regexp_like(text, F.lit(pattern)), let(each, placed)).otherwise(F.array().cast(EMPTY))


def apart(runs: Column, base: Column) -> Column:
    """The runs that no base span overlaps. Both in one order of starts: a run is overlapped if a base span before it ends after its start, or the next one begins before its end."""
    tagged = F.array_sort(F.concat(F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("rank"), b["end"].alias("end"), b["body"].alias("body"))), F.transform(runs, lambda r: F.struct(r["start"].alias("start"), F.lit(1).alias("rank"), r["end"].alias("end"), r["body"].alias("body")))))
    far = F.lit(1 << 60).cast("long")

    def kept(all_):
        ended = running(F.transform(all_, lambda x: F.when(x["rank"] == 0, x["end"]).otherwise(F.lit(-1).cast("long"))), F.lit(-1).cast("long"), lambda a, b: F.greatest(a, b))
        follows = F.reverse(running(F.reverse(F.transform(all_, lambda x: F.when(x["rank"] == 0, x["start"]).otherwise(far))), far, lambda a, b: F.least(a, b)))
        free = F.filter(F.arrays_zip(all_.alias("x"), ended.alias("ended"), follows.alias("next")), lambda z: (z["x"]["rank"] == 1) & (z["ended"] <= z["x"]["start"]) & (z["next"] >= z["x"]["end"]))
        return F.transform(free, lambda z: F.struct(F.lit("entropy").alias("kind"), z["x"]["start"].alias("start"), z["x"]["end"].alias("end"), z["x"]["body"].alias("body")))

    return let(tagged, kept)


def class_of(run: Column) -> Column:
    is_ = lambda p: F.regexp_like(run, F.lit(p))
    return F.when(is_("[+/_=-]"), "signs").when(is_("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(is_("^([0-9a-z]+|[0-9A-Z]+)$"), "lower").otherwise("mixed")


def peak_entropy(run: Column, window: int) -> Column:
    """The highest entropy of a window (of 64 at most) along run, by incremental counts: one character of `n` a kind of character, of which a step rewrites two."""
    weight = F.array(*[F.lit(0.0)] + [F.lit(float(c)) * F.log2(F.lit(float(c))) for c in range(1, window + 1)])
    places = F.transform(F.regexp_extract_all(run, F.lit("."), 0), lambda c: F.instr(F.lit(ALPHABET), c))
    went = F.concat(F.array_repeat(F.lit(0), window), F.slice(places, F.lit(1), F.greatest(F.size(places) - window, F.lit(0))))
    count = lambda n, k: F.ascii(F.substring(n, k, F.lit(1))) - 48
    put = lambda n, k, c: F.overlay(n, F.chr((c + 48).cast("long")), k, F.lit(1))

    def step(s, x):
        def less(c):
            # What leaves first, then what comes: their counts before, and the sum of c * log2(c) moved by both.
            gone = F.when(x["go"] == 0, s["n"]).otherwise(put(s["n"], F.greatest(x["go"], F.lit(1)), c - 1))
            lost = F.when(x["go"] == 0, F.lit(0.0)).otherwise(F.element_at(weight, c + 1) - F.element_at(weight, F.greatest(c, F.lit(1))))
            return let(F.struct(gone.alias("n"), (s["sum"] - lost).alias("sum")), lambda g: let(count(g["n"], x["come"]), lambda k: F.struct(put(g["n"], x["come"], k + 1).alias("n"), (g["sum"] + F.element_at(weight, k + 2) - F.element_at(weight, k + 1)).alias("sum"))))

        after = F.when(x["come"] == x["go"], F.struct(s["n"].alias("n"), s["sum"].alias("sum"))).otherwise(let(F.when(x["go"] == 0, F.lit(1)).otherwise(count(s["n"], F.greatest(x["go"], F.lit(1)))), less))
        return let(after, lambda a: F.struct(a["n"].alias("n"), a["sum"].alias("sum"), (s["seen"] + 1).alias("seen"), F.when(s["seen"] + 1 >= window, F.greatest(s["peak"], F.log2(F.lit(float(window))) - a["sum"] / F.lit(float(window)))).otherwise(s["peak"]).alias("peak")))

    start = F.struct(F.lit("0" * len(ALPHABET)).alias("n"), F.lit(0.0).alias("sum"), F.lit(0).alias("seen"), F.lit(0.0).alias("peak"))
    return F.aggregate(F.arrays_zip(places.alias("come"), went.alias("go")), start, step, lambda s: s["peak"])


def scan(docs: DataFrame, window: int = 20, limits: dict = LIMITS, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """docs with base (the base spans) and spans (base and added ones), the last two columns, each by start, then kind as listed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rank = lambda s: F.struct(s["start"], F.array_position(F.array(*map(F.lit, ("assign", "access", "hex", "entropy"))), s["kind"]).alias("rank"), s["end"], s["kind"])
    plain = lambda spans: F.transform(F.array_sort(F.transform(spans, rank)), lambda s: F.struct(s["kind"], s["start"], s["end"]))
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])

    def base_spans(t):
        return F.concat(
            F.filter(found(t, ASSIGN, "assign", 2), lambda s: F.length(s["body"]) >= 8),
            F.filter(found(t, ACCESS, "access"), lambda s: F.length(s["body"]) >= 16),
            found(t, HEX, "hex"),
        )

    def added(t, base):
        runs = F.filter(found(t, RUN, "entropy"), lambda s: F.regexp_like(s["body"], F.lit("[0-9]")) & F.regexp_like(s["body"], F.lit("[A-Za-z]")))
        listed = lambda s: F.exists(F.array(*map(F.lit, allow)), lambda a: F.contains(s["body"], a))
        return F.filter(apart(runs, base), lambda s: ~listed(s) & (peak_entropy(s["body"], window) >= F.element_at(limit, class_of(s["body"]))))

    both = let(text, lambda t: let(base_spans(t), lambda base: F.struct(plain(base).alias("base"), plain(F.concat(base, added(t, base))).alias("spans"))))
    pair = unused(docs.columns, "pair")
    names = {unused([*docs.columns, pair], c): F.col(pair)[c] for c in ("base", "spans")}
    return docs.withColumn(pair, both).withColumns(names).drop(pair)


def redact(docs: DataFrame, mask: str = "[SECRET]", **parameters) -> DataFrame:
    """docs with every span of text, overlapping ones joined, put as mask; a text without spans, or null, stays as it is."""
    out = scan(docs, **parameters)
    spans = F.col(out.columns[-1])
    cut = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda s, x: F.when(x["end"] <= s["at"], s)
        .when(x["start"] < s["at"], F.struct(s["out"].alias("out"), x["end"].alias("at")))
        .otherwise(F.struct(F.concat(s["out"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mask)).alias("out"), x["end"].alias("at"))),
        lambda s: F.concat(s["out"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.length("text"))),
    )
    return out.withColumn("text", F.when(F.size(spans) > 0, cut).otherwise(F.col("text"))).select(*docs.columns)


def op6_secrets(spark, sf_dir) -> DataFrame:
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _spans_sql(name: str, pattern: str, kind: str, rank: int, group: int, fits: str) -> str:
    """Common table expressions that end in `name` (row, text, body, b, e, kind, rank): the matches of pattern in d, with places."""
    return f"""
{name}_cut AS (SELECT row, text, string_split_regex(text, '{pattern}') AS pieces, regexp_extract_all(text, '{pattern}') AS hits, regexp_extract_all(text, '{pattern}', {group}) AS bodies FROM d WHERE regexp_matches(text, '{pattern}')),
{name}_each AS (SELECT row, text, unnest(range(1, len(hits) + 1)) AS k, pieces, hits, bodies FROM {name}_cut),
{name} AS (
  SELECT row, text, bodies[k] AS body, b, b + length(hits[k]) AS e, '{kind}' AS kind, {rank} AS rank
  FROM (SELECT *, CAST(length(array_to_string(pieces[1:k], '')) + length(array_to_string(hits[1:k - 1], '')) AS BIGINT) AS b FROM {name}_each) WHERE {fits.replace('body', 'bodies[k]')}),"""


def _sql() -> str:
    quoted = lambda s: s.replace("'", "''")
    limits = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in LIMITS.items())
    allowed = " OR ".join(f"contains(body, '{a}')" for a in ALLOW)
    spans = "coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank), '')"
    return (
        "WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),"
        + _spans_sql("assign", quoted(ASSIGN), "assign", 1, 2, "length(body) >= 8")
        + _spans_sql("access", ACCESS, "access", 2, 0, "length(body) >= 16")
        + _spans_sql("hexes", HEX, "hex", 3, 0, "true")
        + _spans_sql("runs", RUN, "entropy", 4, 0, "regexp_matches(body, '[0-9]') AND regexp_matches(body, '[A-Za-z]')")
        + f"""
base AS (SELECT row, b, e, kind, rank FROM assign UNION ALL SELECT row, b, e, kind, rank FROM access UNION ALL SELECT row, b, e, kind, rank FROM hexes),
free AS (SELECT * FROM runs r WHERE NOT ({allowed}) AND NOT EXISTS (SELECT 1 FROM base x WHERE x.row = r.row AND x.b < r.e AND r.b < x.e)),
windows AS (SELECT row, b, body, i, unnest(string_split(substr(body, i, 20), '')) AS c FROM (SELECT row, b, body, unnest(range(1, length(body) - 18)) AS i FROM free)),
entropies AS (SELECT row, b, body, i, -sum(n / 20 * log2(n / 20)) AS h FROM (SELECT row, b, body, i, c, count(*)::DOUBLE AS n FROM windows WHERE c <> '' GROUP BY ALL) GROUP BY ALL),
strong AS (
  SELECT row, b FROM entropies GROUP BY row, b, body
  HAVING max(h) >= CASE CASE WHEN regexp_matches(body, '[+/_=-]') THEN 'signs' WHEN regexp_matches(body, '^([0-9a-f]+|[0-9A-F]+)$') THEN 'hex' WHEN regexp_matches(body, '^([0-9a-z]+|[0-9A-Z]+)$') THEN 'lower' ELSE 'mixed' END {limits} END),
every AS (SELECT * FROM base UNION ALL SELECT row, f.b, e, kind, rank FROM free f JOIN strong USING (row, b)),
told AS (SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, {spans} AS told FROM base GROUP BY row),
listed AS (SELECT row, {spans} AS spans FROM every GROUP BY row)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(told, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (row) LEFT JOIN listed USING (row)
"""
    )


SQL = _sql()
