"""What the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space of the contracts: 0x20 and 0x09-0x0D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns: list[str], name: str) -> str:
    """name, with underscores after it until no column is called so (Spark's names know no case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(c: Column) -> Column:
    """A-Z to lower case, all else as it is."""
    return F.translate(c, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """The runs of characters other than the contracts' white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's variable isn't computed again at each use."""
    return F.transform(F.array(value), body)[0]


def bounded_sample(df: DataFrame, rows: int) -> DataFrame:
    """About `rows` distinct rows of df (all, if it has fewer), the same each time: those whose hash falls into the share that makes
    this number. No row moves to be ranked or counted, and repeated rows, however many, count as one: distinct hashes are counted by a sketch, to 2 %."""
    key = F.xxhash64(*df.columns)
    share = min(1.0, 1.1 * rows / max(1, df.agg(F.approx_count_distinct(key, 0.02)).first()[0]))
    return df.where(F.pmod(key, F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).distinct()


def running(values: Column, zero: Column, plus) -> Column:
    """For each element of an array, zero and all elements before it taken together by plus.

    A fold that appends to an array copies it at each step; so elements are folded in slices of about the cube root of their number, each from what the slices before make.
    """
    plain = lambda xs, start: F.aggregate(xs, F.struct(start.alias("now"), F.slice(F.array(zero), F.lit(1), F.lit(0)).alias("out")), lambda s, x: F.struct(plus(s["now"], x).alias("now"), F.array_append(s["out"], s["now"]).alias("out")), lambda s: s["out"])

    def sliced(v):
        n = F.size(v)
        each = F.greatest(F.lit(1), F.ceil(F.cbrt(2 * n)).cast("int"))
        cut = let(each, lambda e: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / e).cast("int")), lambda i: F.slice(v, i * e + 1, e)))
        before = lambda parts: plain(F.transform(parts, lambda part: F.aggregate(part, zero, plus)), zero)
        return let(cut, lambda parts: F.flatten(F.transform(F.arrays_zip(parts.alias("part"), before(parts).alias("start")), lambda p: plain(p["part"], p["start"]))))

    return let(values, sliced)


def window_of(text: Column, max_chars: int) -> Column:
    """text, or, of a longer one, max_chars characters at a place that its hash gives."""
    at = 1 + F.pmod(F.xxhash64(text), F.greatest(F.length(text) - max_chars, F.lit(1)).cast("long"))
    return F.when(F.length(text) <= max_chars, text).otherwise(F.substring(text, at.cast("int"), F.lit(max_chars)))
