"""Column functions over DNA strings, 32 bases to a k-mer. Positions count from 0."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F

K = 32
#: The base that each letter A..Z stands for.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = "ACCTTGGAACCTTGGAACCTTGGAAC"
#: Digits of the packed form, first base most significant.
DIGITS = {"A": "0", "C": "1", "T": "2", "G": "3"}


def to_dna(text: Column) -> Column:
    """Letters of any text as bases; everything else goes."""
    return F.translate(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")), LETTERS, BASES)


#: For each byte of UTF-8: the base that a letter stands for, in upper or lower case; 0 for all else.
BASE_OF = np.zeros(256, np.uint8)
for _case in (LETTERS, LETTERS.lower()):
    BASE_OF[np.frombuffer(_case.encode(), np.uint8)] = np.frombuffer(BASES.encode(), np.uint8)


def letters_kept(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of texts without nulls, as to_dna has them: all bases one after another, and where each text's begin and end."""
    texts = texts.cast(pa.large_string())
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    bases = BASE_OF[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]] if len(texts) else np.zeros(0, np.uint8)
    # Whole texts are counted one by one: sums along all bytes would be eight times their size.
    at = edges - edges[0]
    sizes = np.fromiter((np.count_nonzero(bases[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)), np.int64, len(texts))
    return bases[bases != 0], np.concatenate(([0], np.cumsum(sizes)))


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement, A < C < G < T."""
    return F.least(kmer, reverse_complement(kmer))


def encode(kmer: Column) -> Column:
    """Packed to a signed 64-bit integer, two bits a base."""
    return F.conv(F.translate(kmer, "".join(DIGITS), "".join(DIGITS.values())), 4, -10).cast("long")


#: The letters of 8 packed bases, for each 16 bits.
EIGHTS = np.stack([np.frombuffer("".join(DIGITS).encode(), np.uint8)[(np.arange(1 << 16) >> 2 * i) & 3] for i in range(7, -1, -1)], axis=1).copy().view(np.uint64).ravel()


def letters(codes: np.ndarray) -> pa.Array:
    """Packed k-mers (longs) as strings."""
    data = EIGHTS[np.ascontiguousarray(codes).view(np.uint16).reshape(-1, 4)[:, ::-1]]
    edges = np.arange(len(codes) + 1, dtype=np.int32) * np.int32(K)
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data)))


def decode(packed: Column) -> Column:
    @F.arrow_udf("string")
    def text(codes: pa.Array) -> pa.Array:
        out = letters(codes.fill_null(0).to_numpy(zero_copy_only=False))
        return out if not codes.null_count else pa.compute.if_else(codes.is_valid(), out, None)

    return text(packed)


def gc_count(s: Column) -> Column:
    return F.length(s) - F.length(F.translate(s, "CG", ""))


def kmer_at(seq: Column, start: Column) -> Column:
    return F.substring(seq, (start + 1).cast("int"), F.lit(K))


def left_of(seq: Column, start: Column) -> Column:
    """The 32 bases before a k-mer; null where there are fewer."""
    return F.when(start >= K, F.substring(seq, (start - K + 1).cast("int"), F.lit(K)))


def right_of(seq: Column, start: Column) -> Column:
    return F.when(start + 2 * K <= F.length(seq), F.substring(seq, (start + K + 1).cast("int"), F.lit(K)))


def gc_percent(seq: Column, start: Column) -> Column:
    """C and G in the 500 bases that begin 234 before a k-mer, by fives. Bases past the ends don't count."""
    begin = start - 234
    return F.floor(gc_count(F.substring(seq, (F.greatest(begin, F.lit(0)) + 1).cast("int"), (F.lit(500) + F.least(begin, F.lit(0))).cast("int"))) / 5).cast("int")


def is_subsequence(mask: Column, flank: Column) -> Column:
    """Whether the mask's middle 24 bases occur in flank in order, with gaps."""
    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(K)),
        F.lit(1),
        lambda j, i: F.when((j <= 24) & (F.substring(mask, (j + 4), F.lit(1)) == F.substring(flank, i, F.lit(1))), j + 1).otherwise(j),
    )
    return found == 25


def is_canonical_subsequence(mask: Column, flank: Column) -> Column:
    return is_subsequence(mask, flank) | is_subsequence(reverse_complement(mask), flank)


def overlap(a_begin: Column, a_end: Column, b_begin: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_begin, b_begin))


def log_density(x: Column, mean: Column, spread: Column) -> Column:
    """Of the model's normal density, which divides by the spread, not by its square; null for a spread of 0."""
    return F.when(spread > 0, -(F.log(spread) + 0.5 * (F.log(F.lit(2.0)) + F.log(F.lit(3.141592653589793)))) - 0.5 * (x - mean) * (x - mean) / spread)


def track_name(svtype: Column, chrom: Column, begin: Column, end: Column) -> Column:
    """DEL@chr1_10_20; types other than DEL and INS have no prefix."""
    return F.concat(F.when(svtype.isin("DEL", "INS"), F.concat(svtype, F.lit("@"))).otherwise(F.lit("")), chrom, F.lit("_"), begin.cast("string"), F.lit("_"), end.cast("string"))


def parse_track_name(name: Column) -> Column:
    place = F.regexp_extract(name, r"^(?:[A-Z]+@)?(.+)_(\d+)_(\d+)$", 1)
    number = lambda g: F.regexp_extract(name, r"^(?:[A-Z]+@)?(.+)_(\d+)_(\d+)$", g).cast("int")
    kind = F.regexp_extract(name, r"^([A-Z]+)@", 1)
    return F.struct(F.when(kind == "", "INV").otherwise(kind).alias("svtype"), place.alias("chrom"), number(2).alias("begin"), number(3).alias("end"))


def normal_genotype(g: Column) -> Column:
    return F.regexp_replace(g, "^1/0$", "0/1")


def carries(g: Column) -> Column:
    return F.coalesce(F.contains(g, F.lit("1")), F.lit(False))


def genotype_of(lp: Column) -> Column:
    return F.when(lp == -1, "./.").when(lp >= 0.75, "1/1").when(lp >= 0.25, "1/0").otherwise("0/0")
