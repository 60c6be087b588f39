"""Quality rules with cross-document line frequency, in DataFrame operations only.

A document fails the base rules if it has fewer than min_words words, or if more than max_repeat percent of its words lie
in windows of `window` words that its text has at least twice. The method then looks across documents: lines, normalised (A-Z lowered, digits as 0,
white space as one space, trimmed), are hashed; for each host and hash the distinct documents are counted; lines that over
max_docs documents of a host, and over a share of max_share of its documents, share are removed, and a document is rejected if that leaves under min_left
of its words.

A document contributes each distinct line once, so counts are plain sums that are combined before the shuffle; a line that a third of all
documents has is one key with one partial sum a task. Flags go back to the documents' lines by an equal join whose left side
Spark can split. Only hashes are shuffled, never text, and all lines that have a word, however short (min_line can leave out shorter ones).

Exact copies of a whole document would make all their lines frequent, so a host's copies of one text count as one document:
the text's hash stands for the document. A host's documents, of which max_share is a share, are its distinct texts that have a counted line.

Defined results: null or empty text has no words and fails; repeated rows each get a row; a null host is a host of its own; an
empty table gives no rows; other columns are not looked at, and clean gives them back as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import SPACE, ascii_lower, let, table, unused, words

SYMBOLS = "#*$%&|<>"


def repeated_words(tokens: Column, window: int = 8) -> Column:
    """Number of tokens inside windows that tokens has twice or more, the first included.

    Windows are compared by 64-bit hash. Most texts repeat none: they stop at the distinct count. In the others, (hash, place)
    pairs are sorted, neighbours with equal hashes give the places, and a walk along the places adds up what they cover.
    """

    def places(hashes):
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def marked(pairs):
            same = lambda i, j: F.coalesce(F.get(pairs, i)["h"] == F.get(pairs, j)["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(pairs, lambda p, j: same(j, j - 1) | same(j, j + 1)), lambda p: p["i"]))

        return let(pairs, marked)

    def covered(places):
        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(places, start, lambda s, i: F.struct((i + window).cast("int").alias("end"), (s["n"] + F.least(F.lit(window), i + window - s["end"])).cast("long").alias("n")), lambda s: s["n"])

    def of(t):
        hashes = F.transform(F.sequence(F.lit(1), F.size(t) - (window - 1)), lambda i: F.xxhash64(F.slice(t, i, window)))
        return F.when(F.size(t) < window + 1, F.lit(0).cast("long")).otherwise(
            let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(places(h))))
        )

    return let(tokens, of)


def lines_of(text: Column) -> Column:
    """\\n-split lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda l: F.regexp_like(l, F.lit(r"[^\x20\x09-\x0D]")))


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(ascii_lower(line), "[0-9]", "0"), SPACE + "+", " "))


def base_rules(docs: DataFrame, host: str, min_words: int, max_repeat: int) -> DataFrame:
    """doc_id, host, the base counts, base_failed, and the text's hash and lines (hash, words) for the method."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def counts(t):
        return let(
            lines_of(text),
            lambda l: F.struct(
                F.size(t).cast("long").alias("n_words"),
                F.length(F.array_join(t, "")).cast("long").alias("word_chars"),
                (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
                (F.size(l) - F.size(F.array_distinct(l))).cast("long").alias("n_dup_lines"),
                repeated_words(t).alias("n_repeat_words"),
                F.transform(l, lambda x: F.struct(F.xxhash64(normalised(x)).alias("hash"), F.size(F.array_remove(F.split(x, SPACE + "+"), "")).alias("words"))).alias("lines"),
            ),
        )

    return (
        docs.select("doc_id", F.col(host).alias("host"), F.xxhash64(text).alias("text_hash"), let(words(F.col("text")), counts).alias("c"))
        .select("doc_id", F.coalesce(F.concat(F.lit("h"), "host"), F.lit("n")).alias("host"), "text_hash", "c.*")
        .withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")))
    )


def frequent(mine: DataFrame, texts: DataFrame, max_docs: int, max_share: float) -> DataFrame:
    """host, hash of mine (host, text_hash, hash; distinct) that more of its host's texts (host, text_hash; distinct) have than max_docs and their share.

    Only hosts large enough for the share to count have a limit of their own: at most max_share / max_docs of the number of texts. Spark sends these to the tasks
    if they are small, else splits the hosts of many lines.
    """
    limits = texts.groupBy("host").agg((F.count("*") * max_share).alias("limit")).where(F.col("limit") > max_docs)
    counted = mine.groupBy("host", "hash").count().where(F.col("count") > max_docs)
    return counted.join(limits, "host", "left").where(F.col("limit").isNull() | (F.col("count") > F.col("limit"))).select("host", "hash")


def judge(
    docs: DataFrame, host: str = "source", min_words: int = 20, max_repeat: int = 30, min_line: int = 1, max_docs: int = 20, min_left: float = 0.5, max_share: float = 0.05
) -> DataFrame:
    """doc_id, host and text_hash (which say whose lines were counted together), the base counts, base_failed, removed_words, removed_lines, kept for each row of docs."""
    ruled = written(base_rules(docs, host, min_words, max_repeat), "lines")
    long_lines = F.filter("lines", lambda l: l["words"] >= min_line)
    # One row a distinct text of a host, from all rows, failed ones included; each of its distinct lines once.
    texts = ruled.where(F.size(long_lines) > 0).groupBy("host", "text_hash").agg(F.min(F.array_sort(long_lines)).alias("lines"))
    mine = texts.select("host", "text_hash", F.explode("lines").alias("l")).groupBy("host", "text_hash", F.col("l.hash").alias("hash")).agg(F.sum("l.words").alias("words"), F.count("*").alias("times"))
    shared = frequent(mine, ruled.where(F.size(long_lines) > 0).select("host", "text_hash").distinct(), max_docs, max_share)
    lost = mine.join(shared, ["host", "hash"]).groupBy("host", "text_hash").agg(F.sum("words").alias("removed_words"), F.sum("times").alias("removed_lines"))
    return (
        ruled.join(lost, ["host", "text_hash"], "left")
        .withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("removed_words", "removed_lines")})
        .withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("removed_words") >= min_left * F.col("n_words")))
        .drop("lines")
    )


def clean(docs: DataFrame, host: str = "source", min_line: int = 1, max_docs: int = 20, max_share: float = 0.05, **parameters) -> DataFrame:
    """docs that judge keeps, their texts without the lines that too many documents of their host share."""
    own_host, own_text, gone = (unused(docs.columns, c) for c in ("own_host", "own_text", "gone"))
    hashed = lambda l: F.xxhash64(normalised(l))
    long_line = lambda l: F.size(F.array_remove(F.split(l, SPACE + "+"), "")) >= min_line
    key, text = F.coalesce(F.concat(F.lit("h"), F.col(host)), F.lit("n")), F.xxhash64(F.coalesce("text", F.lit("")))
    # A verdict is of a host's text: rows of one doc_id with several texts are judged each on its own.
    kept = written(judge(docs, host, min_line=min_line, max_docs=max_docs, max_share=max_share, **parameters).where("kept").select("host", "text_hash").distinct(), "kept")
    mine = docs.select(key.alias("host"), text.alias("text_hash"), F.explode(F.array_distinct(F.transform(F.filter(lines_of(F.col("text")), long_line), hashed))).alias("hash")).distinct()
    shared = frequent(mine, mine.select("host", "text_hash").distinct(), max_docs, max_share)
    lost = mine.join(shared, ["host", "hash"]).groupBy("host", "text_hash").agg(F.collect_set("hash").alias("lines"))
    plan = kept.join(lost, ["host", "text_hash"], "left").select(F.col("host").alias(own_host), F.col("text_hash").alias(own_text), F.col("lines").alias(gone))
    without = F.array_join(F.filter(F.split("text", "\n"), lambda l: ~(F.array_contains(F.col(gone), hashed(l)) & long_line(l))), "\n")
    rows = docs.join(plan, (key == F.col(own_host)) & (text == F.col(own_text)))
    return rows.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(without)).select(*docs.columns)


def op8_lines(spark, sf_dir) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words", "removed_lines"
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce('h' || source, 'n') AS host, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (SELECT row, i, array_to_string(words[i:i + 7], ' ') AS win FROM (SELECT row, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, win) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT row, count(DISTINCT place) AS n FROM (SELECT row, unnest(range(i, i + 8)) AS place FROM twice) GROUP BY row),
base AS (
  SELECT w.row, doc_id, host, text, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN repeats USING (row)),
texts AS (SELECT host, text, any_value(lines) AS lines FROM w WHERE len(lines) > 0 GROUP BY host, text),
lines AS (
  SELECT host, text, trim(regexp_replace(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line,
         len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT host, text, unnest(lines) AS l FROM texts)),
mine AS (SELECT host, text, line, sum(n) AS words, count(*) AS times FROM lines GROUP BY ALL),
hosts AS (SELECT host, count(*) * 0.05::DOUBLE AS most FROM texts GROUP BY host),
shared AS (SELECT host, line FROM mine JOIN hosts USING (host) GROUP BY host, line, most HAVING count(*) > 20 AND (most <= 20 OR count(*) > most)),
lost AS (SELECT host, text, sum(words) AS words, sum(times) AS lines FROM mine JOIN shared USING (host, line) GROUP BY host, text)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - coalesce(words, 0) >= 0.5 * n_words AS kept,
       CAST(coalesce(words, 0) AS BIGINT) AS removed_words, CAST(coalesce(lines, 0) AS BIGINT) AS removed_lines
FROM base LEFT JOIN lost USING (host, text)
"""
